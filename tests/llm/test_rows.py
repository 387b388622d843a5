"""Rows that share an id, lack one, or hold odd values, in the operators that join on ids."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from sievework.llm import jaccard, mixing, neighbours, topk

from .test_llm import SCHEMA, text_of


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", len(t or ""), 1.0, "mine") for i, t in rows], SCHEMA)


def test_all_texts_of_an_id_are_joined(spark):
    """Texts a and b under one id, each with a near copy: both near copies are linked to it."""
    a, b = text_of(21), text_of(22)
    rows = [(5, a), (5, b), (8, a + " tail"), (9, b + " tail"), (11, text_of(23))]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.near_duplicates(frame(spark, rows)).collect()}
    assert set(got.values()) == {5, 11} and {i for (i, _), c in got.items() if c == 5} == {5, 8, 9}


def test_texts_without_id_bridge(spark):
    a = text_of(31, 200).split()
    steps = [" ".join([f"x{i}" for i in range(18 * k)] + a[18 * k :]) for k in range(3)]
    sets = [set(zip(*[t.split()[i:] for i in range(5)])) for t in steps]
    alike = lambda x, y: 100 * len(x & y) >= 75 * len(x | y)
    assert alike(sets[0], sets[1]) and alike(sets[1], sets[2]) and not alike(sets[0], sets[2])
    df = frame(spark, [(7, steps[0]), (None, steps[1]), (3, steps[2]), (None, text_of(32))])
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.near_duplicates(df).collect()), key=str)
    assert got == [(3, 3), (7, 3), (None, 3), (None, None)]
    kept = corpus_pipeline.drop_near_duplicates(spark, df, "").collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("3", steps[2]), ("None", text_of(32))])


def test_pipeline_keeps_different_texts_of_an_id(spark):
    rows = [(5, text_of(41)), (5, text_of(42)), (5, text_of(41)), (6, text_of(42) + " more"), (5, None), (5, "")]
    kept = corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), "").collect()
    assert sorted((r.doc_id, r.text or "") for r in kept) == sorted([(5, text_of(41)), (5, text_of(42)), (5, ""), (5, "")])
    assert kept[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars", "score", "findings"}


def test_pipeline_keeps_a_column_named_findings(spark):
    secret = "password = hunter22"
    got = {r.doc_id: r for r in corpus_pipeline.redact_secrets(spark, frame(spark, [(1, secret), (2, "none"), (3, None)]), "").collect()}
    assert {r.findings for r in got.values()} == {"mine"} and "hunter22" not in got[1].text and got[2].text == "none" and got[3].text is None
    assert got[1].n_chars == len(got[1].text)


def test_mixing_spreads_rows_without_id(spark):
    rng = np.random.default_rng(5)
    rows = [(None if i < 200 else i, " ".join(map(str, rng.integers(0, 999, 20))), "a") for i in range(300)] + [(1000 + i, "w " * 20, "b") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.Mixture(df, shards=3, block_words=1000).documents().join(df.select("doc_id", "source").distinct(), "doc_id", "left").collect()
    of_a = [r for r in mixing.Mixture(df, shards=3, block_words=1000).documents().collect() if r.source_size == 6000]
    assert len(got) >= 800 and len(of_a) == 300
    assert abs(sum(r.taken for r in of_a) - of_a[0].target) <= 20


def test_neighbours_of_one_id(spark):
    """Two different vectors of one id are two candidates."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    base = rows[100][1]
    rows += [(7000, [x + 0.002 for x in base]), (7000, [x + 0.3 for x in base]), (7000, [x + 0.002 for x in base])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [r for r in neighbours.nearest(df, F.col("vec_id") == 100).collect()]
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])][:2] == [7000, 7000]
    assert [round(r.score, 4) for r in sorted(got, key=lambda r: r["rank"])][:2] == [round(0.002 * 8**0.5, 4), round(0.3 * 8**0.5, 4)]


def test_topk_of_large_components(spark):
    rows = [(20, [1e7 + 3, -3.5]), (1, [2.0, 1.0]), (2, [1e7 + 1, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [1e7 + 1, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("vec_id", "embedding", topk.whole_numbers(F.col("embedding")).alias("ints")).filter(topk.usable(F.col("embedding")))
    got = [(r.vec_id, r.score) for r in topk.search(df, F.col("vec_id") % 20 == 0).orderBy("rank").collect()]
    of = lambda a, b: int(64 * (1e7 + 3)) * a - 224 * b
    assert got == [(2, of(64 * (10**7 + 1), 0)), (5, of(64 * (10**7 + 1), 64)), (1, of(128, 64))] and got[0][1] > 2**53
    none = topk.search(df.filter("vec_id < 0"), F.col("vec_id") % 20 == 0)
    assert none.count() == 0
