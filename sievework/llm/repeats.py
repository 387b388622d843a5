"""Repeated substrings by prefix-free parsing and the suffix orders of dictionary and parse.

A hash rolling over eight bytes triggers the borders of phrases, the same ones wherever the same bytes stand.  A
window of ``WINDOW`` bytes is named by its first trigger and by how far it reaches to the left of it, so equal
windows are the end of a phrase of the dictionary with the same reach, followed by the parse from the same trigger
on.  In each part of the corpus that shares what follows triggers, the texts after triggers are put in suffix order
(the parse) and the texts before them in order from the right (the dictionary), with the common lengths of
neighbours.  For every reach, runs of neighbours that agree for long enough give classes on both sides; windows in
equal classes on both sides are equal, byte by byte.

Before any text travels, 256 bytes around each border are hashed; borders whose hash occurs once can't belong to a
repeated window, and only the others send their surroundings.  Long gaps between triggers are cut at fixed steps
to the left of a trigger, and windows without any trigger stand for themselves.  Copies of a text are one row: its
windows occur again by definition, so the text is removed as a whole.

Null texts are empty; texts shorter than the window lose nothing; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import bounds, mix64, stored, text_bytes

WINDOW, TRIGGER, RATE = 400, 8, 64
#: The left reach of one record, and the bytes from a border on that all its windows share.
STEP, SHARED = 144, WINDOW - 144
#: Borders of a bucket and records of a part that one task holds on average.
BUCKET, PART = 500_000, 10_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the base and of its inverse."""
    if len(_powers[0]) < n:
        for i, b in enumerate((_BASE, _INVERSE)):
            _powers[i] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, b, np.uint64))])
    return _powers[0][:n], _powers[1][:n]


def borders(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Records of a batch of texts: row, border, least and greatest reach, and two hashes.

    The first hash is of what all windows of a record share, the second of all its surroundings.
    """
    n = len(data)
    empty = np.empty(0, np.int64)
    if n < WINDOW:
        return empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    value = np.zeros(n - TRIGGER + 1, np.uint64)
    for k in range(TRIGGER):
        value |= data[k : n - TRIGGER + 1 + k].astype(np.uint64) << np.uint64(8 * k)
    at = np.flatnonzero(mix64(value) % np.uint64(RATE) == 0)
    row = np.searchsorted(offsets, at, "right") - 1
    inside = at + TRIGGER <= offsets[row + 1]
    # every text gets one more, endless trigger behind its end
    rows = np.concatenate([row[inside], np.arange(len(offsets) - 1)])
    spots = np.concatenate([at[inside], np.full(len(offsets) - 1, 1 << 60)])
    order = np.lexsort((spots, rows))
    rows, spots = rows[order], spots[order]
    start, last = offsets[rows], offsets[rows + 1] - WINDOW
    before = np.concatenate([[-1], spots[:-1]])
    before = np.where(np.concatenate([[True], rows[1:] != rows[:-1]]), start - 1, before)
    reach = WINDOW - TRIGGER
    found = []
    for r in range(-(-reach // STEP)):
        low = np.maximum(before + 1, spots - min(STEP * (r + 1), reach))
        high = np.minimum(spots - STEP * r - (r > 0), last)
        ok = low <= high
        border = (spots - STEP * r)[ok]
        found.append((rows[ok], border, border - high[ok], border - low[ok], np.full(ok.sum(), SHARED)))
    low, high = before + 1, np.minimum(spots - reach - 1, last)
    ok = low <= high
    if ok.any():
        count = (high - low + 1)[ok]
        alone = np.repeat(low[ok] - np.cumsum(count) + count, count) + np.arange(count.sum())
        zero = np.zeros(len(alone), np.int64)
        found.append((np.repeat(rows[ok], count), alone, zero, zero, np.full(len(alone), WINDOW)))
    row, border, least, most, size = (np.concatenate(c) for c in zip(*found))
    power, inverse = _power(n + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n])])
    between = lambda a, b: (sums[b] - sums[a]) * inverse[a]
    key = mix64(between(border, border + size) + size.astype(np.uint64))
    end = np.minimum(border + WINDOW, offsets[row + 1])
    whole = mix64(mix64(between(border - most, end) + (end - border).astype(np.uint64)) + (least * 1000 + most).astype(np.uint64))
    return row, border, least, most, key, whole


def suffix_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of fixed-width strings and the common length of each with the next."""
    width = rows.shape[1]
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{width}")[:, 0], kind="stable")
    common = np.empty(max(0, len(order) - 1), np.int16)
    for i in range(0, len(common), 8192):
        here = order[i : i + 8193]
        same = rows[here[1:]] == rows[here[:-1]]
        common[i : i + 8192] = np.where(same.all(1), width, same.argmin(1))
    return order, common


def collapsed(names: np.ndarray, rows_of) -> tuple[np.ndarray, np.ndarray]:
    """First places of distinct records and each record's place among them, by their hashes.

    ``rows_of(places)`` gives the records themselves; if two with one hash differ, all are kept apart.
    """
    _, first, place = np.unique(names, return_index=True, return_inverse=True)
    copies = np.flatnonzero(first[place] != np.arange(len(names)))
    for i in range(0, len(copies), 8192):
        here = copies[i : i + 8192]
        if not (rows_of(here) == rows_of(first[place[here]])).all():
            return np.arange(len(names)), np.arange(len(names))
    return first, place


def expand(counts: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Places of the items of the chosen groups, group after group, where group g holds ``counts[g]`` items in a row."""
    n = counts[chosen]
    return np.repeat((np.cumsum(counts) - counts)[chosen], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def repeated(right: np.ndarray, left: np.ndarray, least: np.ndarray, most: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which windows of a part occur twice or more: record and first and last of its consecutive reaches.

    ``right`` holds the bytes from each border on (zeros behind the text), ``left`` those before it, from the border
    to the left, ``times`` how often a record occurs.  A window that reaches k to the left needs k equal bytes there
    and WINDOW - k to the right.
    """
    (by_right, common_right), (by_left, common_left) = suffix_order(right), suffix_order(left)
    n = len(least)
    hit = np.zeros((n, STEP + 3), np.int8)  # one free column on each side
    for k in range(int(least.min()), int(most.max()) + 1):
        live = np.flatnonzero((least <= k) & (k <= most))
        if not len(live):
            continue
        a, b = np.empty(n, np.int64), np.empty(n, np.int64)
        a[by_right] = np.concatenate([[0], np.cumsum(common_right < WINDOW - k)])
        b[by_left] = np.concatenate([[0], np.cumsum(common_left < k)])
        _, name = np.unique(a[live] * n + b[live], return_inverse=True)
        count = np.bincount(name, weights=times[live])
        hit[live[count[name] > 1], k + 1] = 1
    change = np.diff(hit, axis=1)
    record, start = np.nonzero(change == 1)
    _, behind = np.nonzero(change == -1)
    return record, start, behind - 1


def flat(table: pa.Table, name: str, kind: type) -> np.ndarray:
    """All values of a binary column end to end, without copies where it is one piece."""
    parts = []
    for chunk in table[name].chunks:
        if len(chunk):
            ends = np.frombuffer(chunk.buffers()[1], np.int64 if pa.types.is_large_binary(chunk.type) else np.int32)
            parts.append(np.frombuffer(chunk.buffers()[2], np.uint8)[ends[chunk.offset] : ends[chunk.offset + len(chunk)]].view(kind))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def distinct_texts(docs: DataFrame) -> DataFrame:
    """``text_key, rid, copies, text`` of every distinct text, stored; ``rid`` numbers the rows."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.sha2(text.cast("binary"), 256).alias("text_key"), text.alias("text"))
    grouped = rows.groupBy("text_key").agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    return stored(grouped.withColumn("rid", F.monotonically_increasing_id()), "repeat-texts")


def _keys(texts: DataFrame, buckets: int) -> DataFrame:
    """Packed hashes of all borders by bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(buckets)]
            for i, j in bounds(batch.column(1), 1 << 20):
                part = batch.slice(i, j - i)
                data, offsets = text_bytes(part.column(1))
                row, border, _, _, key, _ = borders(data, offsets)
                rid, spot = part.column(0).to_numpy()[row], (border - offsets[row]).astype(np.int32)
                bucket = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
                order = np.lexsort((spot, rid, bucket))
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                for b in range(buckets):
                    at = order[cuts[b] : cuts[b + 1]]
                    if len(at):
                        held[b].append((rid[at], spot[at], key[at].astype(np.uint32)))
            rows = [b for b in range(buckets) if held[b]]
            if rows:
                cols = [[np.concatenate([x[c] for x in held[b]]).tobytes() for b in rows] for c in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), *[pa.array(c, pa.binary()) for c in cols]], ["bucket", "rids", "spots", "keys"])

    return texts.select("rid", "text").mapInArrow(work, "bucket int, rids binary, spots binary, keys binary")


def _twice(table: pa.Table) -> pa.Table:
    """For each text of a bucket the borders whose hash isn't alone."""
    rid, spot, key = flat(table, "rids", np.int64), flat(table, "spots", np.int32), flat(table, "keys", np.uint32)
    _, name, count = np.unique(key, return_inverse=True, return_counts=True)
    live = np.flatnonzero(count[name] > 1)
    live = live[np.lexsort((spot[live], rid[live]))]
    ids, first = np.unique(rid[live], return_index=True)
    return pa.table({"rid": pa.array(ids, pa.int64()), "spots": pa.array([x.tobytes() for x in np.split(spot[live], first[1:])] if len(ids) else [], pa.binary())})


def _records(marked: DataFrame, parts: int) -> DataFrame:
    """Packed records of the marked borders by part, with their surroundings; equal ones of a batch are one, with all their places."""
    reach = np.arange(WINDOW)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in bounds(batch.column(1), 1 << 20):
                part = batch.slice(i, j - i)
                data, offsets = text_bytes(part.column(1))
                row, border, least, most, key, whole = borders(data, offsets)
                wanted = np.zeros(len(data) + 1, bool)
                for start, lists in zip(offsets[:-1], part.column(2).to_pylist()):
                    for raw in lists:
                        wanted[start + np.frombuffer(raw, np.int32)] = True
                at = np.flatnonzero(wanted[border])
                row, border, least, most, key, whole = (x[at] for x in (row, border, least, most, key, whole))
                padded, end = np.concatenate([data, np.zeros(WINDOW, np.uint8)]), offsets[row + 1]

                def right_of(x: np.ndarray) -> np.ndarray:
                    rows = padded[border[x, None] + reach]  # noqa: B023
                    rows[reach >= (end[x] - border[x])[:, None]] = 0  # noqa: B023
                    return rows

                def left_of(x: np.ndarray) -> np.ndarray:
                    rows = data[np.maximum(border[x, None] - 1 - reach[:STEP], 0)]  # noqa: B023
                    rows[reach[:STEP] >= most[x, None]] = 0  # noqa: B023
                    return rows

                first, place = collapsed(whole, lambda x: np.concatenate([right_of(x), left_of(x), least[x, None], most[x, None]], 1))  # noqa: B023
                times = np.bincount(place, minlength=len(first))
                by = np.argsort(place, kind="stable")
                ids, spots = part.column(0).to_numpy()[row], (border - offsets[row]).astype(np.int32)
                home = (key[first] % np.uint64(parts)).astype(np.int64)
                order = np.argsort(home, kind="stable")
                for a in range(0, len(order), 8192):
                    some = order[a : a + 8192]
                    cuts = np.flatnonzero(np.concatenate([[True], np.diff(home[some]) != 0, [True]]))
                    pairs = [some[p:q] for p, q in zip(cuts[:-1], cuts[1:])]
                    pack = lambda take: pa.array([np.ascontiguousarray(take(g)).tobytes() for g in pairs], pa.binary())  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(home[some][cuts[:-1]], pa.int64()), pack(lambda g: ids[by[expand(times, g)]]), pack(lambda g: spots[by[expand(times, g)]]), pack(lambda g: times[g].astype(np.int32)),  # noqa: B023
                            pack(lambda g: least[first[g]].astype(np.int16)), pack(lambda g: most[first[g]].astype(np.int16)), pack(lambda g: right_of(first[g])), pack(lambda g: left_of(first[g])),  # noqa: B023
                        ],
                        ["part", "rids", "spots", "times", "least", "most", "rights", "lefts"],
                    )

    return marked.select("rid", "text", "spots").mapInArrow(work, "part long, rids binary, spots binary, times binary, least binary, most binary, rights binary, lefts binary")


def _compare(table: pa.Table) -> pa.Table:
    """Starts of repeated windows: ``rid`` with packed pairs of first and last start of each run."""
    rid, spot, times = flat(table, "rids", np.int64), flat(table, "spots", np.int32).astype(np.int64), flat(table, "times", np.int32).astype(np.int64)
    least, most = flat(table, "least", np.int16).astype(np.int64), flat(table, "most", np.int16).astype(np.int64)
    record, first, last = repeated(flat(table, "rights", np.uint8).reshape(-1, WINDOW), flat(table, "lefts", np.uint8).reshape(-1, STEP), least, most, times)
    where = expand(times, record)  # every place of a record has the record's runs
    first, last = np.repeat(first, times[record]), np.repeat(last, times[record])
    runs = np.stack([spot[where] - last, spot[where] - first], 1)
    order = np.lexsort((runs[:, 0], rid[where]))
    rid, runs = rid[where][order], runs[order]
    # runs that touch become one
    new = np.ones(len(rid), bool)
    new[1:] = (rid[1:] != rid[:-1]) | (runs[1:, 0] > runs[:-1, 1] + 1)
    heads = np.flatnonzero(new)
    merged = np.stack([runs[heads, 0], np.maximum.reduceat(runs[:, 1], heads)], 1) if len(heads) else np.empty((0, 2), np.int64)
    ids, cut = np.unique(rid[heads], return_index=True)
    return pa.table({"rid": pa.array(ids, pa.int64()), "runs": pa.array([x.tobytes() for x in np.split(merged, cut[1:])] if len(ids) else [], pa.binary())})


def covered(runs: np.ndarray) -> np.ndarray:
    """Removed stretches, begin and end, from runs of window starts."""
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    begin, end = runs[:, 0], np.maximum.accumulate(runs[:, 1] + WINDOW)
    new = np.concatenate([[True], begin[1:] > end[:-1]])
    return np.stack([begin[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]], 1)


def find(texts: DataFrame) -> DataFrame:
    """``rid, spans, kept``: for distinct texts with repeated windows, packed removed stretches (bytes) and the bytes that stay."""
    long = texts.filter(F.octet_length("text") >= WINDOW)
    size = long.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = -(-size // (RATE * BUCKET)) or 1
    twice = _keys(long, buckets).groupBy("bucket").applyInArrow(_twice, "rid long, spots binary")
    marks = twice.groupBy("rid").agg(F.collect_list("spots").alias("spots"))
    marked = stored(long.select("rid", "text").join(marks, "rid"), "repeat-marked")
    borders_ = (marked.agg(F.sum(F.aggregate("spots", F.lit(0).cast("long"), lambda a, s: a + F.octet_length(s)))).first()[0] or 0) // 4
    runs = _records(marked, -(-borders_ // PART) or 1).groupBy("part").applyInArrow(_compare, "rid long, runs binary")
    starts = runs.groupBy("rid").agg(F.collect_list("runs").alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, kept = [], []
            for text, lists in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = text.encode()
                gone = covered(np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in lists]))
                spans.append(gone.tobytes())
                edges = [0, *gone.ravel().tolist(), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.binary()), pa.array(kept, pa.binary())], ["rid", "spans", "kept"])

    return marked.select("rid", "text").join(starts, "rid").select("rid", "text", "runs").mapInArrow(cut, "rid long, spans binary, kept binary")


def remove(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row of ``docs`` (``doc_id, text``)."""
    texts = distinct_texts(docs)
    found = find(texts).select("rid", (F.octet_length("spans") / 16).cast("long").alias("s"), F.octet_length("kept").cast("long").alias("k"), F.sha2("kept", 256).alias("h"))
    size = F.octet_length("text").cast("long")
    whole = (F.col("copies") > 1) & (size >= WINDOW)
    sized = texts.select("text_key", "rid", size.alias("n_bytes"), whole.alias("whole"))
    told = sized.join(found, "rid", "left").select(
        "text_key", "n_bytes",
        F.when(F.col("whole"), F.col("n_bytes")).otherwise(F.col("n_bytes") - F.coalesce("k", "n_bytes")).alias("n_removed"),
        F.when(F.col("whole"), F.lit(1)).otherwise(F.coalesce("s", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("whole"), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("h", "text_key")).alias("kept_sha256"),
    )
    rows = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_key"))
    return rows.join(told, "text_key").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
