"""BPE encoding and decoding of whole texts by a trie of distinct words.

A byte-level vocabulary is read from a tokenizers JSON file.  A sequence of tokens is what merging by rank gives
exactly if every neighbouring pair of its tokens comes out of merging that pair's own bytes.  Therefore each
prefix of a word has one possible last token: the suffix token that fits the last token of what stands before it.
The distinct words of a batch of texts form a trie; a depth-first walk hands each node the last tokens of the
prefixes above it, so words that share a prefix share its states, and a word's tokens are read off backwards.

Work is done in Arrow batches inside the scan's own tasks: no shuffle, nothing is kept but a bounded store of
encoded words, which only saves time.  Special tokens of the file are recognised in the text, as the library does.
Null texts are empty ones; other columns aren't touched.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm.common import bounds

#: How the byte-level pre-tokenizer of such files cuts words (fixed value).
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words in each of the two halves of what a process remembers between batches; it only saves time.
STORE = 120_000


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in such files: itself, or the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in plain}
    others = [b for b in range(256) if b not in set(plain)]
    return names | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tokens as bytes, merges by rank, special tokens by text."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        names = byte_names()
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.text: dict[int, bytes] = {t["id"]: t["content"].encode() for t in data["added_tokens"]}
        ids: dict[bytes, int] = {}
        for word, i in data["model"]["vocab"].items():
            if word not in self.special:
                ids[raw := bytes(names[c] for c in word)] = i
                self.text[i] = raw
        as_bytes = lambda word: bytes(names[c] for c in word)
        pairs = ((m if isinstance(m, list) else m.split(" ")) for m in data["model"]["merges"])
        self.rank = {(ids[a], ids[b]): (r, ids[a + b]) for r, (a, b) in enumerate((as_bytes(x), as_bytes(y)) for x, y in pairs)}
        self.bytes = [ids[bytes([b])] for b in range(256)]
        self.longest = max(map(len, ids))
        self.halves = {whole: (x, y, r) for (x, y), (r, whole) in reversed(self.rank.items())}
        self.ends: dict[int, tuple[list, list]] = {}
        self.fits_known: dict[tuple[int, int], bool] = {}
        self.ids = {raw: i for raw, i in ids.items() if self.merged(raw) == [i]}  # a token that its own bytes don't merge to never comes out

    def merged(self, raw: bytes) -> list[int]:
        """Plain merging by rank; used once for every token."""
        parts = [self.bytes[b] for b in raw]
        while len(parts) > 1:
            best = min(((self.rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in self.rank), default=None)
            if best is None:
                break
            (_, token), i = best
            parts[i : i + 2] = [token]
        return parts

    def spine(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """The pieces that stand at one end of a token while it is merged: piece, rank that made it, rank that used it."""
        out, used = [], 1 << 30
        while True:
            halves = self.halves.get(token)
            out.append((token, halves[2] if halves else -1, used))
            if not halves:
                return out
            token, used = halves[side], halves[2]

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the bytes of ``a`` and ``b`` gives the two tokens: no merge across the border comes first.

        Two end pieces meet while both exist.  Their merge fires if it ranks before the merges that would use
        either; of equal ranks the left one goes first.
        """
        ends = self.ends
        if a not in ends:
            ends[a] = self.spine(a, 1), self.spine(a, 0)
        if b not in ends:
            ends[b] = self.spine(b, 1), self.spine(b, 0)
        rank = self.rank.get
        for x, made_x, used_x in ends[a][0]:
            for y, made_y, used_y in ends[b][1]:
                if made_x < used_y and made_y < used_x and (r := rank((x, y))) is not None and r[0] < used_x and r[0] <= used_y:
                    return False
        return True

    def extend(self, word: bytes, first: int, last: list[int]) -> None:
        """Append the last tokens of the prefixes of ``word`` from length ``first`` on; ``last[i]`` is that of ``word[:i]``."""
        if len(self.fits_known) > 4 * STORE:
            self.fits_known.clear()
        get, known, known_all = self.ids.get, self.fits_known.get, self.fits_known
        for end in range(first, len(word) + 1):
            for start in range(end - self.longest if end > self.longest else 0, end):
                token = get(word[start:end])
                if token is not None:
                    if not start:
                        break
                    fit = known(pair := (last[start], token))
                    if fit is None:
                        fit = known_all[pair] = self.fits(*pair)
                    if fit:
                        break
            else:
                raise ValueError(f"no token ends {word[:end]!r}")
            last.append(token)


class Encoder:
    """Encodes batches of texts."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.cut = regex.compile(CUT)
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(vocabulary.special, key=len, reverse=True))) if vocabulary.special else None
        self.store: dict[str | int, bytes] = {}
        self.older: dict[str | int, bytes] = {}

    def learn(self, words: set[str | int]) -> None:
        """Put the words into a trie and walk it depth first.

        Sorted words visit the trie's edges in depth-first order: the states of the prefix shared with the word
        before stay on the stack, deeper ones are popped, and only new nodes are worked out.
        """
        states, before = [0], b""
        extend, text = self.v.extend, self.v.text
        self.store.update((w, w.to_bytes(4, "little")) for w in words if isinstance(w, int))
        for word, name in sorted((w.encode(), w) for w in words if isinstance(w, str)):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del states[shared + 1 :]
            extend(word, shared + 1, states)
            tokens, at = [], len(word)
            while at:
                tokens.append(states[at])
                at -= len(text[states[at]])
            self.store[name] = np.array(tokens[::-1], "<u4").tobytes()
            before = word

    def pieces(self, text: str) -> list[str | int]:
        """Words and ids of special tokens."""
        if self.special is None or not self.special.search(text):
            return self.cut.findall(text)
        out: list[str | int] = []
        at = 0
        for m in self.special.finditer(text):
            out += self.cut.findall(text[at : m.start()])
            out.append(self.v.special[m.group()])
            at = m.end()
        return out + self.cut.findall(text[at:])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        if len(self.store) > STORE:  # words that come again move on from the older half, so frequent ones aren't learned anew
            self.older, self.store = self.store, {}
        cut = [self.pieces(t) for t in texts]
        new = set().union(*cut) - self.store.keys()
        known = {w: self.older[w] for w in new & self.older.keys()}
        self.store.update(known)
        self.learn(new - known.keys())
        get = self.store.__getitem__
        return [b"".join(map(get, pieces)) for pieces in cut]

    def decode(self, ids: bytes) -> str:
        get = self.v.text.__getitem__
        return b"".join(map(get, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_LOADED: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One for each Python process, which runs many tasks one after another."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(Vocabulary(path))
    return _LOADED[path]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None, chunk_bytes: int = 1 << 20) -> DataFrame:
    """``docs`` with the token ids of ``text`` as binary (little-endian unsigned 32-bit) and, if asked for, decoded text.

    ``path`` is a vocabulary file that every executor has.  The new columns replace ones of the same name.  A null
    text gives empty ids; the number of tokens is a quarter of the binary's length.
    """
    new = [ids, decoded] if decoded else [ids]
    kept = [c for c in docs.columns if c.lower() not in {n.lower() for n in new}]
    source = docs.select(*[F.col(f"`{c}`") for c in kept])
    place = kept.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            for start, end in bounds(batch.column(place), chunk_bytes):
                part = batch.slice(start, end - start)
                texts = [t or "" for t in part.column(place).to_pylist()]
                coded = encoder.encode(texts)
                arrays = [*part.columns, pa.array(coded, pa.binary())]
                if decoded:
                    arrays.append(pa.array([encoder.decode(c) for c in coded], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, [*kept, *new])

    fields = [*source.schema.fields, T.StructField(ids, T.BinaryType())]
    if decoded:
        fields.append(T.StructField(decoded, T.StringType()))
    return source.mapInArrow(work, T.StructType(fields))


def decode(coded: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``coded`` with the text of its ids; null ids give null."""
    kept = [c for c in coded.columns if c.lower() != text.lower()]
    place = kept.index(ids)
    source = coded.select(*[F.col(f"`{c}`") for c in kept])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            texts = [None if x is None else encoder.decode(x) for x in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*kept, text])

    return source.mapInArrow(work, T.StructType([*source.schema.fields, T.StructField(text, T.StringType())]))
