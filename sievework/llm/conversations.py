"""Repair of conversation structure by a generalised LR parse with weighted edits.

The roles of a conversation have to follow a grammar.  Rows are read in order; every row is kept, given another role
or deleted, and rows with empty text may be inserted anywhere, each at a cost.  All stacks that the LR tables allow
are followed at once.  Stacks with equal tops allow the same continuations, so of these only the one with the smallest
(cost, audit) lives on: a frontier has at most one stack for each LR state.  The tables are worked out from the grammar.

Audits are compared without keeping them in the frontier.  Two audits of equal cost over the same rows differ before
either ends, because what one has more could only be insertions, and these cost; so the order of the stacks' audits
and the insertions since the last row decide all later comparisons.  Each stack carries the hash of its repaired
conversation, so the texts are streamed through once and not held.

A conversation is one chain (its hash is), read in order by one task: one shuffle by conversation, two external sorts
that may spill, and a stream over Arrow batches.  What is held of a conversation are its audits, a byte for each row
and stack.  Faults of rows are worked out by built-in expressions before.

Nulls: a role or text that is null counts as one space, a null id is a conversation of its own, null turns come first
and don't count for gaps.  Rows with one turn are ordered by role and text; equal rows are exchangeable.  A role of no
characters starts with none, so it can't be kept.  Texts may have any length.  An empty table gives no rows.  Other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Start symbol first; small letters are the initials of roles.
GRAMMAR = (("S", ""), ("S", "P"), ("S", "sP"), ("P", "ua"), ("P", "Pua"))
ROLES = {"u": "user", "a": "assistant"}
COST = {"K": 0, "R": 1, "D": 2, "I": 5, "truncated": 5}
LEGAL = frozenset({"su", "ua", "au"})
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
SPACE = " \t\n\x0b\x0c\r"
#: Characters of an audit that a stack holds as one piece.
PIECE = 4096


class Tables:
    """LR(0) item sets of a grammar, with reductions applied as soon as a rule is complete inside the text.

    Rules of the start symbol are only reduced at the end.  A stack is a tuple of state numbers.
    """

    def __init__(self, grammar: tuple[tuple[str, str], ...] = GRAMMAR):
        self.grammar, self.start = grammar, grammar[0][0]
        self.states = [self._closed({(r, 0) for r, (left, _) in enumerate(grammar) if left == self.start})]
        self.goto: dict[tuple[int, str], int] = {}
        for number, items in enumerate(self.states):  # grows while it is walked
            for symbol in sorted({grammar[r][1][d] for r, d in items if d < len(grammar[r][1])}):
                moved = self._closed({(r, d + 1) for r, d in items if grammar[r][1][d : d + 1] == symbol})
                if moved not in self.states:
                    self.states.append(moved)
                self.goto[number, symbol] = self.states.index(moved)
        self.shift = cache(self._shift)
        self.accepts = cache(self._accepts)

    def _closed(self, items: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        while True:
            heads = {self.grammar[r][1][d] for r, d in items if d < len(self.grammar[r][1])}
            more = {(r, 0) for r, (left, _) in enumerate(self.grammar) if left in heads} - items
            if not more:
                return frozenset(items)
            items = items | more

    def _shift(self, stack: tuple[int, ...], symbol: str) -> tuple[int, ...] | None:
        if (stack[-1], symbol) not in self.goto:
            return None
        stack += (self.goto[stack[-1], symbol],)
        while True:
            done = [r for r, d in self.states[stack[-1]] if d == len(self.grammar[r][1]) and self.grammar[r][0] != self.start]
            if not done:
                return stack
            left, right = self.grammar[done[0]]
            stack = stack[: len(stack) - len(right)]
            stack += (self.goto[stack[-1], left],)

    def _accepts(self, stack: tuple[int, ...]) -> bool:
        whole = [self.grammar[r][1] for r, d in self.states[stack[-1]] if d == len(self.grammar[r][1]) and self.grammar[r][0] == self.start]
        return any(len(right) == len(stack) - 1 for right in whole)


class Stack:
    """A stack of the frontier: its cost, the order of its audit up to the last row, insertions since, audit and hash."""

    __slots__ = ("states", "cost", "order", "inserted", "audit", "hash", "rows")

    def __init__(self, states, cost, order, inserted, audit, hash_, rows):
        self.states, self.cost, self.order, self.inserted, self.audit, self.hash, self.rows = states, cost, order, inserted, audit, hash_, rows

    def rank(self) -> tuple[int, int, int]:
        return self.cost, self.order, self.inserted


def _longer(audit: tuple, letter: str) -> tuple:
    """A rope of pieces, so that stacks share their past."""
    before, piece = audit
    return ((audit, letter) if len(piece) >= PIECE else (before, piece + letter))


def _spelled(audit: tuple | None) -> str:
    pieces = []
    while audit is not None:
        audit, piece = audit
        pieces.append(piece)
    return "".join(reversed(pieces))


def _written(stack: Stack, role: str, text: bytes):
    new = stack.hash.copy()
    new.update((b"\n" if stack.rows else b"") + role.encode() + b":" + text)
    return new


class Parse:
    """One conversation, row by row."""

    def __init__(self, tables: Tables):
        self.tables = tables
        first = Stack((0,), 0, 0, 0, (None, ""), hashlib.sha256(), 0)
        self.frontier = self._with_insertions({0: first})
        self.faults = [0, 0, 0, 0]
        self.illegal = self.turns = 0
        self.low = self.high = self.last = None

    def _with_insertions(self, frontier: dict[int, Stack]) -> dict[int, Stack]:
        todo = sorted(frontier.values(), key=Stack.rank)
        while todo:
            stack = todo.pop(0)
            if frontier[stack.states[-1]] is not stack:
                continue
            for symbol, role in ROLES.items():
                states = self.tables.shift(stack.states, symbol)
                if states is None:
                    continue
                rank = (stack.cost + COST["I"], stack.order, stack.inserted + 1)
                have = frontier.get(states[-1])
                if have is None or rank < have.rank():
                    new = Stack(states, *rank, _longer(stack.audit, "I"), _written(stack, role, b""), stack.rows + 1)
                    frontier[states[-1]] = new
                    todo.append(new)
        return frontier

    def read(self, turn: int | None, role: str, text: bytes, fault: int) -> None:
        self.faults[fault] += 1
        if turn is not None:
            self.turns += self.high is None or turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.illegal += self.last is not None and self.last + role[:1] not in LEGAL
        self.last = role[:1]
        # Of every top the best way there, by (cost, audit); the audit's order is that of its parent, then its last letters.
        best: dict[int, tuple] = {}
        for stack in self.frontier.values():
            ways = [("D", "", stack.states, COST["D"])]
            if fault in (0, TRUNCATED):
                more = COST["truncated"] if fault else 0
                ways += [("K", role, self.tables.shift(stack.states, role[:1]), COST["K"] + more)]
                ways += [("R", ROLES[s], self.tables.shift(stack.states, s), COST["R"] + more) for s in ROLES]
            for letter, given, states, cost in ways:
                if states is None:
                    continue
                key = (stack.cost + cost, stack.order, "I" * stack.inserted + letter)
                if states[-1] not in best or key < best[states[-1]][0]:
                    best[states[-1]] = (key, letter, given, states, stack)
        orders = {key: i for i, key in enumerate(sorted({found[0][1:] for found in best.values()}))}
        frontier = {}
        for top, (key, letter, given, states, old) in best.items():
            kept = letter != "D"
            frontier[top] = Stack(states, key[0], orders[key[1:]], 0, _longer(old.audit, letter), _written(old, given, text) if kept else old.hash, old.rows + kept)
        self.frontier = self._with_insertions(frontier)

    def result(self) -> tuple:
        end = min((s for s in self.frontier.values() if self.tables.accepts(s.states)), key=Stack.rank)
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return gaps, *self.faults[1:], self.illegal, end.cost, _spelled(end.audit), end.hash.hexdigest()


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, lost`` after the damage that the CRC-32 of ``conv_id:turn`` modulo 20 stands for.

    0 loses the row, 1 empties its text, 2 takes all of ``.!?`` out of it, 3 repeats it, 4 makes it the user's.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace(filled("text"), "[.!?]", "")).otherwise(filled("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(filled("role"))
    marked = rows.select("conv_id", "turn", "role", "text", code.alias("code"))
    once = marked.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("code") == 0).alias("lost"), F.when(F.col("code") == 3, 2).otherwise(1).alias("times"))
    return once.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("times")


def repair(rows: DataFrame, lost: Column | None = None, grammar: tuple[tuple[str, str], ...] = GRAMMAR) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every conversation.

    ``rows`` has ``conv_id, turn, role, text``; rows that ``lost`` marks only keep their conversation in the result.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    gone = F.coalesce(lost, F.lit(False)) if lost is not None else F.lit(False)
    text = F.coalesce("text", F.lit(" "))
    plain = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.when(~gone, text).otherwise("").alias("text"), gone.alias("lost"))
    bare = F.rtrim("text", F.lit(SPACE))
    plain = plain.withColumns({"blank": F.length(bare) == 0, "open": ~F.substring(bare, -1, 1).isin(".", "!", "?")})
    # One shuffle: the window's key holds the conversation, by which the rows lie already.
    same = Window.partitionBy("conv_id", "role", "lost", F.md5(F.col("text").cast("binary"))).orderBy(F.col("turn").asc_nulls_first())
    seen = plain.repartition("conv_id").withColumn("seen", F.row_number().over(same) - 1)
    fault = F.when(F.col("blank"), BLANK).when(F.col("seen") > 0, DUPLICATE).when(F.col("open"), TRUNCATED).otherwise(0)
    ordered = seen.sortWithinPartitions(F.col("conv_id"), F.col("turn").asc_nulls_first(), "role", "text", "seen").select("conv_id", "turn", "role", "text", fault.alias("fault"), "lost")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, parse, current, any_row = Tables(grammar), None, None, False
        names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

        def batch_of(results, id_type):
            columns = list(zip(*results))
            kinds = [id_type, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

        id_type = None
        for batch in batches:
            results, id_type = [], batch.schema.field(0).type
            ids, turns, roles = (batch.column(i).to_pylist() for i in range(3))
            texts, faults, losts = batch.column(3).cast(pa.binary()), batch.column(4).to_pylist(), batch.column(5).to_pylist()
            for i, key in enumerate(ids):
                if not any_row or key != current:
                    if any_row:
                        results.append((current, *parse.result()))
                    parse, current, any_row = Parse(tables), key, True
                if not losts[i]:
                    parse.read(turns[i], roles[i], texts[i].as_py(), faults[i])
            if results:
                yield batch_of(results, id_type)
        if any_row:
            yield batch_of([(current, *parse.result())], id_type)

    return ordered.mapInArrow(work, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
