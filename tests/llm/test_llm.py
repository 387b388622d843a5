"""Operators of the training-data subpackage against brute force on small tables with every odd case."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievework.llm import bpe, jaccard, language, mixing, neighbours, quality, repeats, secrets, shingles, topk, toxicity
from sievework.llm.common import scratch
from sievework.llm.queries import vocabulary_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, score double, findings string"
WORDS = [f"w{i}" for i in range(400)]


def text_of(seed, n=120, change=()):
    words = [WORDS[i] for i in np.random.default_rng(seed).integers(0, 400, n)]
    for i in change:
        words[i] = f"changed{i}"
    return " ".join(words)


ROWS = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", "a"), (4, "one", "en", "b"), (5, "One", None, "b"),
    (6, text_of(1), "en", "a"), (7, text_of(1).upper(), "en", "a"), (8, text_of(1, change=[5]), "de", "a"), (9, text_of(1, change=[5, 60]), "de", None),
    (10, text_of(2, 3000), "fr", "c"), (11, text_of(1), "en", "a"), (11, text_of(1), "en", "a"), (12, "a b c d e f g", "fr", "c"), (13, "a b c d e f g h", "fr", "c"),
    (14, "x" * 900, "en", "c"), (15, "password = hunter22 token=a AKIA" + "Q" * 17 + " " + "af" * 15, "en", "b"), (16, text_of(3) + " " + text_of(4), "es", "b"),
    (17, text_of(5) + " " + text_of(4), "es", "b"), (None, "without id", "en", "a"), (18, "é😀 <|endoftext|> é", "fr", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), 1.0, "x") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("doc_id < 0")


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets, parent = [(i, shingle_set(t)) for i, t, *_ in rows if i is not None], {i: i for i, *_ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i < j and a and 100 * len(a & b) >= 75 * len(a | b):
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    return {i: root(i) for i in parent}


def test_jaccard(docs, none):
    got = jaccard.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    want = brute_components(ROWS)
    assert {r.doc_id: r.component_id for r in got if r.doc_id} == want
    assert {r.doc_id: r.n_shingles for r in got if r.doc_id} == {i: len(shingle_set(t)) for i, t, *_ in ROWS if i}
    assert jaccard.near_duplicates(none).count() == 0


def test_jaccard_signatures_find_every_link():
    rng = np.random.default_rng(0)
    for n in [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 14, 21, 22, 30, 43, 44, 60, 90, 200, 351, 352, 700]:
        for _ in range(30):
            b = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            d = int(rng.integers(0, jaccard.difference(len(b)) + 1))
            gone = int(rng.integers(0, d + 1))
            if gone * 2 < d or len(b) - gone + d - gone > len(b) or gone >= len(b):
                continue
            a = np.unique(np.concatenate([rng.permutation(b)[gone:], rng.integers(0, 1 << 63, d - gone, dtype=np.uint64)]))
            if jaccard.linked(a, b) and not jaccard.weak(b):
                (x, _), (y, need) = jaccard.signatures(a), jaccard.signatures(b)
                assert set(x.tolist()) & set(y[need].tolist()), (n, d)


def test_repeats(docs, none):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove(docs.select("doc_id", "text")).collect()}
    seen, raws = {}, [(i, (t or "").encode()) for i, t, *_ in ROWS]
    for _, b in raws:
        for i in range(len(b) - 399):
            seen[b[i : i + 400]] = seen.get(b[i : i + 400], 0) + 1
    for d, b in raws:
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = 1
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone])) == 1).sum())
        assert got[d] == (len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    assert repeats.remove(none.select("doc_id", "text")).count() == 0


def test_secrets_and_ledger(spark, docs, none):
    ledger = secrets.BlobLedger(spark, scratch(spark, "ledger"))
    versions = docs.withColumnRenamed("text", "content")
    ledger.scan(versions)
    n = ledger.pairs().count()
    assert n == 3 * len({t or "" for _, t, *_ in ROWS})
    ledger.scan(versions)  # nothing is new
    assert ledger.pairs().count() == n
    ledger.scan(versions, [*secrets.RULES[:2], secrets.Rule("hex", "[0-9a-f]{24,}", version=2)])
    assert ledger.pairs().count() == n + n // 3
    found = {r.doc_id: r.findings for r in ledger.findings(versions).collect()}
    text = dict((i, t) for i, t, *_ in ROWS)[15]
    assert [(text[f.start : f.end], f.kind) for f in found[15]] == [("password = hunter22", 0), ("AKIA" + "Q" * 17, 1), ("af" * 15, 2)]
    assert all(not f for i, f in found.items() if i != 15)
    clean = ledger.findings(versions).select("doc_id", secrets.redact(F.col("content"), F.col("findings")).alias("t")).filter("doc_id = 15").first().t
    assert clean == "[SECRET] token=a [SECRET] [SECRET]"
    assert ledger.findings(none.withColumnRenamed("text", "content")).count() == 0


def test_mixing(docs, none):
    mix = mixing.Mixture(docs, shards=3, block_words=200)
    rows = mix.documents().collect()
    assert len(rows) == len(ROWS)
    total = sum(r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault((r.source_size, r.target), []).append(r)
        assert r.taken <= 3 * r.size and len(r.shards) in (0, 1, 2, 3)
    assert abs(sum(t for _, t in by) - total) < 1e-6
    for (size, target), own in by.items():
        assert target <= 3 * size and abs(sum(r.taken for r in own) - target) <= max(r.size for r in own)
    drawn = mix.rows()
    assert drawn.columns == docs.columns and drawn.count() == sum(len(r.shards) for r in rows)
    assert sorted(map(str, mixing.Mixture(docs, shards=3, block_words=200).documents().collect())) == sorted(map(str, rows))
    assert mixing.Mixture(none).documents().count() == 0


def test_mixing_long_document_first_in_its_block(spark):
    text = lambda i, long: "w " * (110 if i == long else 10)
    place = lambda i, long: int(hashlib.md5(f"mix|{i}|{hashlib.md5(text(i, long).encode()).hexdigest()}".encode()).hexdigest()[:15], 16)
    for long in range(40):  # one of them is the first of its block if it is the long one
        ids = sorted(range(40), key=lambda i: place(i, long))
        block = [(place(i, long) >> 29) * 5 >> 31 for i in ids]
        first = ids.index(long)
        if block[first] == 3 and block.index(3) == first:
            break
    assert block.index(3) == ids.index(long)
    # source a: 39 x 10 + 110 words in five blocks; its target, a third of all words, ends 20 words into the long document
    sizes = {i: 110 if i == ids[first] else 10 for i in ids}
    rest = 10 * first + 20
    rows = [(i, "w " * n, "a") for i, n in sizes.items()] + [(100, "w " * (3 * rest - 500), "b")]
    taken = {r.doc_id: r.taken for r in mixing.Mixture(spark.createDataFrame(rows, "doc_id long, text string, source string"), shards=3, block_words=100).documents().collect()}
    assert {i: taken[i] for i in ids} == {i: 10 if at < first else 0 for at, i in enumerate(ids)}


def test_hypergeometric(spark):
    df = spark.range(20000).select(mixing.hypergeometric(F.lit(50), F.lit(20), F.lit(10), (F.col("id") + 0.5) / 20000).alias("x"))
    mean, spread = df.agg(F.avg("x"), F.var_pop("x")).first()
    assert abs(mean - 4) < 0.01 and abs(spread - 10 * 0.4 * 0.6 * 40 / 49) < 0.01


def test_bpe(docs, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path())
    rows = bpe.encode(docs, vocabulary_path(), decoded="decoded").collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.decode(bpe.encode(docs, vocabulary_path()), vocabulary_path()).filter("coalesce(text, '') <> decoded").count() == 0
    assert bpe.encode(none, vocabulary_path()).count() == 0


def vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [(i, [0.5] * 8) for i in range(300, 420)] + [(420, None), (421, [None] * 8), (422, [float("nan")] * 8), (423, [0.0] * 8), (440, []), (0, rows[0][1])]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")


def test_topk(spark):
    rows, df = vectors(spark)
    ints = {i: np.floor(np.array(v, np.float32).astype(float) * 64) for i, v in rows if v and None not in v and np.isfinite(v).all()}
    got = {}
    some = df.filter(topk.usable(F.col("embedding"))).select("vec_id", topk.whole_numbers(F.col("embedding")).alias("ints"))
    for r in topk.search(some, F.col("vec_id") % 20 == 0, block=100, queries_block=8).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in [i for i in ints if i % 20 == 0]:
        best = sorted(((-int(ints[q] @ v), i) for i, v in ints.items() if i != q))[:20]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]


def test_neighbours(spark):
    rows, df = vectors(spark)
    good = {i: np.array(v, np.float32).astype(float) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    hit = total = 0
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 10 == 0).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert abs(r.score - np.sqrt(((good[r.query_id] - good[r.vec_id]) ** 2).sum())) < 1e-12
    for q in [i for i in good if i % 10 == 0]:
        best = sorted((np.sqrt(((good[q] - v) ** 2).sum()), i) for i, v in good.items() if i != q)[:10]
        hit, total = hit + len({i for _, i in best} & set(got[q])), total + 10
    assert hit >= 0.9 * total
    assert neighbours.nearest(df.filter("vec_id < 0"), F.col("vec_id") % 10 == 0).count() == 0


def test_models_on_given_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    held = lambda parts, out: {i for i in range(5000) if zlib.crc32(str(i).encode()) % parts == out}
    model = quality.train(docs, labels)
    rows = quality.score(docs, model).join(labels, "doc_id").select("doc_id", "quality", "score").collect()
    test = [r for r in rows if r.doc_id in held(4, 2)]
    assert np.mean([(r.score >= 0.7) == r.quality for r in test]) > 0.9
    said = language.predict(docs, language.train(docs)).select("doc_id", "lang", "lang_pred").collect()
    assert np.mean([r.lang == r.lang_pred for r in said if r.doc_id in held(5, 0)]) > 0.95
    toxic = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").select("toxic", "score").collect()
    assert np.mean([(r.score >= 0.5) == r.toxic for r in toxic]) > 0.9


def test_models_on_odd_rows(docs, none, spark):
    labels = spark.createDataFrame([(6, 1, 0), (10, 0, 1), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    for scored in (quality.score(docs, quality.train(docs, labels)), quality.score(docs, quality.train(none, labels)), toxicity.score(docs, toxicity.train(docs, labels)), toxicity.score(docs, toxicity.train(none, labels))):
        assert scored.count() == len(ROWS) and scored.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    said = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs, language.train(docs)).collect()}
    assert said[1] == ("und", 0.0) and said[3] == ("und", 0.0) and said[6][0] in ("en", "de", "fr", "es")
    assert {r.lang_pred for r in language.predict(docs, language.train(none)).collect()} == {"und"}


def test_shingles_of_long_words():
    a, b = "x" * 5000 + "y" + "z" * 5000, "x" * 5000 + "z" + "z" * 5000
    first, second = shingles.sets(pa.array([a, b]))
    assert first.tolist() != second.tolist()


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.round_trip and r.n_tokens * 4 == len(r.ids) for r in rows)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(r.doc_id for r in kept) == sorted(set(want.values()))


def test_rare_language_beside_a_frequent_one(spark):
    rows = [(i, text_of(i, 20), "en") for i in range(3000)] + [(10**6 + i, f"żółć gęślą jaźń łąka źdźbło {i}", "pl") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs, parts=10**9, out=-1, limit=100)
    assert model.languages == ["en", "pl"]
    assert model.predict(["gęślą jaźń źdźbło", rows[0][1]])[0] == ["pl", "en"]
    assert language.shared_out({"en": 3000, "pl": 4, "fr": 60}, 100) == {"pl": 4, "fr": 48, "en": 48}
    df, documents = language.document_frequencies(docs)
    want = np.zeros_like(df)
    for ids, _ in language.counts([r[1] for r in rows]):
        want[ids] += 1
    assert documents == len(rows) and (df == want).all()
