"""Detectors against recomputation in numpy and pandas, for several partitionings."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievework.operators import anomalies, detectors, outliers, series
from sievework.operators.clusters import Clustering
from sievework.operators.ordering import dense_positions
from sievework.operators import quantiles
from sievework.operators.quantiles import exact_quantiles
from sievework.plans.reports import facility_ranking


@pytest.fixture(scope="module")
def numbers():
    rng = np.random.default_rng(7)
    values = np.concatenate([rng.normal(50, 5, 960), rng.normal(50, 60, 20), np.full(15, 50.0), [np.nan] * 5])
    rng.shuffle(values)
    return values


@pytest.mark.parametrize("accuracy", [10, 1000])
def test_outliers(spark, numbers, accuracy):
    df = spark.createDataFrame(pd.DataFrame({"id": range(len(numbers)), "x": numbers}))
    tests = outliers.outlier_tests(df, ["x"], accuracy=accuracy)
    found = outliers.outlier_rows(df, tests, ["id"]).groupBy("method").agg(F.collect_set("id").alias("ids")).collect()
    x = numbers[~np.isnan(numbers)]
    q1, q3, mid = np.percentile(x, [25, 75, 50])
    mad = np.median(np.abs(x - mid))
    with np.errstate(invalid="ignore"):
        wanted = {
            "z_score": np.abs((numbers - x.mean()) / x.std()) > 3,
            "iqr": (numbers < q1 - 1.5 * (q3 - q1)) | (numbers > q3 + 1.5 * (q3 - q1)),
            "modified_z_score": np.abs(0.6745 * (numbers - mid) / mad) > 3.5,
        }
    assert {r.method: set(r.ids) for r in found} == {m: set(np.flatnonzero(hit).tolist()) for m, hit in wanted.items()}
    summary = {r.detector_name: r for r in outliers.outlier_summary(df, tests, ["x"]).collect()}
    assert summary["z_score"].severity_score == pytest.approx(min(np.abs((x - x.mean()) / x.std()).max() / 6, 1.0))
    beyond = max(q1 - 1.5 * (q3 - q1) - x.min(), x.max() - q3 - 1.5 * (q3 - q1))
    assert summary["iqr"].severity_score == pytest.approx(min(beyond / (q3 - q1) / 5, 1.0))


def test_degenerate_columns_have_no_outliers(spark):
    df = spark.createDataFrame([(5.0, None), (5.0, None), (5.0, 1.0), (5.0, None)], "same double, few double")
    out = outliers.outlier_summary(df, outliers.outlier_tests(df, ["same", "few"]), ["same", "few"]).collect()
    assert len(out) == 6 and all(r.anomaly_count == 0 for r in out)


@pytest.mark.parametrize("accuracy", [1, 7, 100, 10_000])
def test_quantiles(spark, accuracy):
    rng = np.random.default_rng(1)
    frames = {"a": rng.integers(0, 20, 3000).astype(float), "b": rng.normal(size=3000), "c": np.where(rng.random(3000) < 0.4, 7.5, rng.exponential(9, 3000))}
    df = spark.createDataFrame(pd.DataFrame(frames)).repartition(5)
    df = df.withColumns({"few": F.when(F.col("b") > 3.2, F.col("b")), "none": F.lit(None).cast("double")})
    frames["few"] = frames["b"][frames["b"] > 3.2]
    points = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    found = exact_quantiles(df, {c: F.col(c) for c in df.columns}, points, accuracy)
    assert found["none"] == [None] * len(points)
    for name, values in frames.items():
        assert found[name] == pytest.approx(list(np.quantile(values, points)))


def test_quantiles_do_not_rely_on_the_sketch(spark, monkeypatch):
    rng = np.random.default_rng(2)
    values = rng.normal(size=2000)
    df = spark.createDataFrame(pd.DataFrame({"x": values}))
    wrong = [(-1.0, -0.9), (0.5, 0.6), (0.8, 0.9)]
    monkeypatch.setattr(quantiles, "_sketched", lambda *_: ({"x": 2000}, {"x": list(wrong)}))
    points = [0.02, 0.17, 0.5, 0.7, 0.99]
    assert exact_quantiles(df, {"x": F.col("x")}, points)["x"] == pytest.approx(list(np.quantile(values, points)))


@pytest.mark.parametrize("rows", [500, 60_000])
def test_quantiles_scan_the_source_twice(spark, rows):
    """An accumulator counts how often the source, one partition, is read."""
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        seen.add(1)
        yield from batches

    made = spark.range(rows, numPartitions=1).select((F.hash("id") % 1000).cast("double").alias("a"), F.rand(1).alias("b"), F.randn(2).alias("c"))
    df = made.mapInPandas(look, "a double, b double, c double")
    exact_quantiles(df, {c: F.col(c) for c in "abc"}, [0.25, 0.5, 0.75], accuracy=1000)
    assert seen.value == 2


def points_of(n, seed=3):
    rng = np.random.default_rng(seed)
    values = np.cumsum(rng.normal(size=n))
    values[n // 2 : n // 2 + min(30, n // 4)] = 1.5  # a constant run
    values[n // 3] += 80
    return values


def spread(spark, values, parts):
    return spark.createDataFrame(pd.DataFrame({"t": range(len(values)), "x": values})).repartition(parts)


@pytest.mark.parametrize("n, bucket, parts", [(400, 1_000_000, 4), (400, 64, 1), (400, 64, 17), (16, 1_000_000, 3), (5, 1_000_000, 2)])
def test_spike_scores(spark, n, bucket, parts):
    values = points_of(n)
    out = series.spike_scores(spread(spark, values, parts), [], ["t"], "x", bucket_rows=bucket).orderBy("t").toPandas()
    size = min(7, n // 3)
    rolling = pd.Series(values).rolling(size, center=True)
    wanted = ((values - rolling.mean()) / rolling.std()).where(rolling.std() > 1e-9)
    got = out.z_score.where(wanted.notna())
    assert np.allclose(got.dropna(), wanted.dropna(), atol=1e-6) and got.notna().equals(wanted.notna())
    assert series.spikes(spread(spark, values, parts), [], ["t"], "x").count() == 0  # a point in its own window never reaches 5


def test_leave_one_out_finds_the_spike(spark):
    assert [r.t for r in series.spikes(spread(spark, points_of(400), 4), [], ["t"], "x", leave_one_out=True, bucket_rows=64).collect() if r.z_score > 20] == [133]


def trend_changes_by_hand(values):
    n = len(values)
    half = min(10, n // 2)
    previous, found = None, {}
    for i in range(half, n - half):
        window = values[i - half : i + half]
        if window.max() == window.min():
            continue
        r = np.corrcoef(np.arange(len(window)), window)[0, 1]
        if previous is not None and abs(r - previous) > 0.8:
            found[i] = r
        previous = r
    return found


@pytest.mark.parametrize("bucket, parts", [(1_000_000, 4), (50, 1), (50, 17), (20, 4)])
def test_trend_changes(spark, bucket, parts):
    rng = np.random.default_rng(11)
    growing = rng.normal(size=120) * 0.01
    for k in range(6):  # every pair dwarfs the one that leaves the window as it enters
        growing[20 * k + 5 : 20 * k + 7] += 100.0**k
    values = np.concatenate([growing, np.full(45, 2.0), growing, rng.normal(size=60)])
    got = {r.t: r.correlation for r in series.trend_changes(spread(spark, values, parts), [], ["t"], "x", bucket_rows=bucket).collect()}
    wanted = trend_changes_by_hand(values)
    assert len(wanted) > 3 and set(got) == set(wanted) and all(math.isclose(got[i], wanted[i], abs_tol=1e-6) for i in wanted)


def test_short_series_are_skipped(spark):
    df = spark.createDataFrame([("one", 1, 5.0), ("two", 1, 5.0), ("two", 2, 9.0), ("gap", 1, None)], "k string, t int, x double")
    assert series.trend_changes(df, ["k"], ["t"], "x").count() == 0
    assert series.spikes(df, ["k"], ["t"], "x", leave_one_out=True).count() == 0
    assert series.trend(df, ["k"], ["t"], "x").count() == 1


def test_year_spikes(spark):
    rows = [("a", 2000, 1.0), ("a", 2001, 11.5), ("a", 2002, 12.0), ("b", 2000, 0.0), ("b", 2001, 0.0), ("b", 2002, 5.0), ("c", 2000, 1.0), ("c", 2001, 99.0)]
    df = spark.createDataFrame(rows, "f string, y int, v double")
    for bucket in (1, 2, 1_000_000):
        found = series.year_spikes(df, "f", ["y"], "v", bucket_rows=bucket)
        assert {(r.f, r.y) for r in found.collect()} == {("a", 2001), ("b", 2002)}


@pytest.mark.parametrize("bucket, parts", [(10, 3), (10, 16), (10_000, 2)])
def test_positions_are_dense(spark, bucket, parts):
    placed = dense_positions(spark.range(0, 500, 5).repartition(parts), ["id"], bucket).orderBy("id").collect()
    assert [r.position for r in placed] == list(range(100))


def test_ranking_is_dense(spark):
    df = spark.createDataFrame([("a", 5.0), ("a", 7.0), ("b", 6.0), ("c", 9.0), ("d", 1.0)], "f string, s double")
    assert {r.f: r.quality_rank for r in facility_ranking(df, "f", "s").collect()} == {"c": 1, "a": 2, "b": 2, "d": 3}


def dbscan_by_hand(points, eps, least):
    scaled = (points - points.mean(0)) / np.where(points.std(0) > 0, points.std(0), 1)
    near = ((scaled[:, None] - scaled[None]) ** 2).sum(-1) <= eps * eps
    core = near.sum(1) >= least
    noise = {i for i in range(len(points)) if not core[i] and not (near[i] & core).any()}
    label = -np.ones(len(points), int)
    groups = 0
    for start in np.flatnonzero(core):
        if label[start] >= 0:
            continue
        stack, groups = [start], groups + 1
        while stack:
            i = stack.pop()
            if label[i] < 0:
                label[i] = groups
                stack += list(np.flatnonzero(near[i] & core & (label < 0)))
    return noise, groups


@pytest.mark.parametrize("seed, eps", [(1, 0.5), (2, 0.2), (3, 0.08)])
def test_density_clusters(spark, seed, eps):
    rng = np.random.default_rng(seed)
    points = np.concatenate([rng.normal([0, 0], 0.3, (150, 2)), rng.normal([6, 5], 0.4, (120, 2)), rng.uniform(-10, 15, (60, 2)), np.repeat([[20.0, 20.0]], 6, 0), np.repeat([[-20.0, 20.0]], 4, 0),
                             np.stack([np.linspace(-9, 9, 80), np.full(80, -12.0)], 1)])
    df = spark.createDataFrame(pd.DataFrame({"id": range(len(points)), "lat": points[:, 0], "lon": points[:, 1]})).repartition(5)
    clusters = Clustering(df, "lat", "lon", eps=eps)
    noise, groups = dbscan_by_hand(points, eps, 5)
    assert {r.id for r in clusters.noise_rows(["id"]).collect()} == noise
    assert clusters.cluster_count() == groups


def test_too_few_points_have_no_noise(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 9.0, 9.0)], "id int, lat double, lon double")
    assert Clustering(df, "lat", "lon").noise_rows(["id"]).count() == 0


def test_positions_and_business_detectors(spark):
    rows = [(1, 34.0522, -118.2437), (2, 0.0, 0.0), (3, 91.0, -181.0), (4, 0.5, 0.5), (5, 10.123456789, 20.5), (6, 30.1, -90.2), (7, None, 5.0)]
    df = spark.createDataFrame(rows, "id int, latitude double, longitude double")
    hits = lambda d: {r.id for r in detectors.flagged_rows(df, [d], ["id"]).collect()}
    assert hits(detectors.impossible_locations("latitude", "longitude")) == {2, 3, 4, 5}
    assert hits(detectors.coarse_locations("latitude", "longitude")) == {3, 4, 5, 6}
    zeros = spark.createDataFrame([(0.0,), (0.0005,), (0.0,), (5.0,)], "e double")
    assert detectors.summarise(zeros, [detectors.zero_emissions("e")]).first().anomaly_count == 3
    assert detectors.summarise(zeros.limit(0).union(spark.createDataFrame([(0.0,), (5.0,)], "e double")), [detectors.zero_emissions("e")]).first().anomaly_count == 0


def test_all_detectors_of_a_table(spark):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"facility_id": range(60), "latitude": rng.normal(40, 1, 60), "longitude": rng.normal(-90, 1, 60), "reporting_year": 2000 + np.arange(60) % 20,
                          "annual_emission_amount": rng.uniform(0, 10, 60), "violation_count": 1, "inspection_count": 0, "penalty_amount": 2e6, "compliance_status": "good"})
    found = anomalies.all_anomalies(spark.createDataFrame(frame), ["facility_id"]).collect()
    counts = {r.detector_name: r.anomaly_count for r in found}
    assert counts["excessive_penalties"] == counts["compliance_inconsistencies"] == counts["violations_without_inspections"] == 60
    assert {"z_score", "iqr", "modified_z_score", "spike_detection", "trend_change", "impossible_locations", "coordinate_precision", "geographic_clustering", "zero_emissions", "emission_spikes"} <= set(counts)


def test_series_summaries_of_many_columns_equal_those_of_each_column(spark):
    rows = spark.range(90).select(
        F.col("id"), (F.col("id") % 2).alias("site"), F.when(F.col("id") % 7 > 0, F.sin(F.col("id") * 1.7) * 10).alias("wave"),
        F.when(F.col("id") == 45, 1000000).otherwise(-F.col("id")).alias("turn"), F.lit(3).alias("flat"), F.lit(None).cast("double").alias("none"),
    )
    columns = ["wave", "turn", "flat", "none", "id"]
    for keys in ([], ["site"]):
        together = series.series_summaries(rows, ["id"], columns, keys).collect()
        single = {(r.column_name, r.detector_name): r for r in together}
        assert len(together) == len(single) == 2 * len(columns)
        for c in columns:
            spikes, changes = series.spikes(rows, keys, ["id"], c).count(), series.trend_changes(rows, keys, ["id"], c).count()
            assert (single[c, "spike_detection"].anomaly_count, single[c, "trend_change"].anomaly_count) == (spikes, changes)
            filled = rows.filter(F.col(c).isNotNull()).count()
            assert single[c, "trend_change"].severity_score == (changes / filled if filled else 0.0)
            assert single[c, "spike_detection"].total_count == 90
        assert sum(r.anomaly_count for r in together) > 0


def test_series_summaries_place_all_series_once_and_agree_over_buckets(spark, monkeypatch):
    rows = spark.range(400).select(
        F.col("id"), (F.sin(F.col("id") * 1.7) * 10).alias("wave"), F.when(F.col("id").between(90, 300), 3.0).otherwise(F.abs(F.col("id") % 37 - 18)).alias("gap"),
        F.when(F.col("id") % 50 == 45, 1000000).otherwise(-F.col("id")).alias("turn"),  # a change at 336, where a bucket starts
    )
    columns, placings = ["wave", "gap", "turn"], []
    placed = series.positions
    monkeypatch.setattr(series, "positions", lambda *args: placings.append(args) or placed(*args))
    found = [sorted(tuple(r) for r in series.series_summaries(rows, ["id"], columns, bucket_rows=n).collect()) for n in (16, 32, 1000)]
    assert len(placings) == 3 and found[0] == found[1] == found[2]
    single = {(r[0], r[2]): r[3] for r in found[0]}
    for c in columns:
        assert single["trend_change", c] == series.trend_changes(rows, [], ["id"], c, 32).count()
    assert single["trend_change", "turn"] > 0
