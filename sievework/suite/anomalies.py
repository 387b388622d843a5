"""Outliers, time series, positions, business-rule detectors, trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.operators import anomalies, detectors, outliers, series
from sievework.operators.clusters import Clustering
from sievework.session import settle
from sievework.suite.frames import EMISSIONS, FACILITIES, cte
from sievework.suite.registry import frame, query, rounded, table

_LINE_IDS = ["l_orderkey", "l_linenumber", "l_partkey"]


@query(
    "zscore",
    """WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS d FROM events)
    SELECT event_id, value, round(abs((value - m) / d), 4) AS score FROM events CROSS JOIN s WHERE abs((value - m) / d) > 3""",
)
def zscore(spark, sf):
    rows = table(spark, sf, "events")
    tests = outliers.outlier_tests(rows, ["value"], ["z_score"])
    return rounded(outliers.outlier_rows(rows, tests, ["event_id"]).select("event_id", "value", "score"), 4)


@query(
    "iqr",
    """WITH q AS (SELECT quantile_cont(l_extendedprice * l_discount, 0.25) AS q1, quantile_cont(l_extendedprice * l_discount, 0.75) AS q3 FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * l_discount, 4) AS value FROM lineitem CROSS JOIN q
    WHERE l_extendedprice * l_discount < q1 - 1.5e0 * (q3 - q1) OR l_extendedprice * l_discount > q3 + 1.5e0 * (q3 - q1)""",
)
def iqr(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("rebate", F.col("l_extendedprice") * F.col("l_discount"))
    tests = outliers.outlier_tests(rows, ["rebate"], ["iqr"])
    return rounded(outliers.outlier_rows(rows, tests, _LINE_IDS).select(*_LINE_IDS, "value"), 4)


_MODIFIED = """WITH m AS (SELECT median(value) AS mid FROM events), d AS (SELECT median(abs(value - mid)) AS mad FROM events CROSS JOIN m)
    SELECT event_id, value, round(abs((value - mid) * 0.6745e0 / mad), 4) AS score FROM events CROSS JOIN m CROSS JOIN d WHERE abs((value - mid) * 0.6745e0 / mad) > 3.5e0"""


@query("modified_z", _MODIFIED)
def modified_z(spark, sf):
    rows = table(spark, sf, "events")
    tests = outliers.outlier_tests(rows, ["value"], ["modified_z_score"])
    return rounded(outliers.outlier_rows(rows, tests, ["event_id"]).select("event_id", "value", "score"), 4)


@query("modified_z_long_column", _MODIFIED)
def modified_z_long_column(spark, sf):
    """The same with the rank search that columns beyond the exact limit use."""
    rows = table(spark, sf, "events")
    tests = outliers.outlier_tests(rows, ["value"], ["modified_z_score"], accuracy=100)
    return rounded(outliers.outlier_rows(rows, tests, ["event_id"]).select("event_id", "value", "score"), 4)


_NUMERIC = ("l_quantity", "l_extendedprice", "l_discount")
_OUTLIER_PARTS = []
for _c in _NUMERIC:
    _OUTLIER_PARTS.append(
        f"""SELECT '{_c}' AS column_name, 'z_score' AS detector_name, count(*) FILTER (WHERE abs((x - m) / d) > 3) AS anomaly_count, count(*) AS total_count,
        round(least(max(abs((x - m) / d)) / 6, 1e0), 6) AS severity_score FROM (SELECT {_c} AS x, (SELECT avg({_c}) FROM lineitem) AS m, (SELECT stddev_pop({_c}) FROM lineitem) AS d FROM lineitem) AS t"""
    )
    _OUTLIER_PARTS.append(
        f"""SELECT '{_c}', 'iqr', count(*) FILTER (WHERE x < a - 1.5e0 * (b - a) OR x > b + 1.5e0 * (b - a)), count(*),
        round(least(greatest(coalesce(max((a - 1.5e0 * (b - a) - x) / (b - a)), 0), coalesce(max((x - b - 1.5e0 * (b - a)) / (b - a)), 0), 0e0) / 5, 1e0), 6)
        FROM (SELECT {_c} AS x, (SELECT quantile_cont({_c}, 0.25) FROM lineitem) AS a, (SELECT quantile_cont({_c}, 0.75) FROM lineitem) AS b FROM lineitem) AS t"""
    )
    _OUTLIER_PARTS.append(
        f"""SELECT '{_c}', 'modified_z_score', count(*) FILTER (WHERE abs((x - m) * 0.6745e0 / d) > 3.5e0), count(*), round(least(max(abs((x - m) * 0.6745e0 / d)) / 7, 1e0), 6)
        FROM (SELECT {_c} AS x, (SELECT median({_c}) FROM lineitem) AS m, (SELECT median(abs({_c} - (SELECT median({_c}) FROM lineitem))) FROM lineitem) AS d FROM lineitem) AS t"""
    )


@query("outlier_summary", " UNION ALL ".join(_OUTLIER_PARTS))
def outlier_summary(spark, sf):
    rows = table(spark, sf, "lineitem")
    found = outliers.outlier_summary(rows, outliers.outlier_tests(rows, _NUMERIC), _NUMERIC)
    return rounded(found.select("column_name", "detector_name", "anomaly_count", "total_count", "severity_score"))


@query(
    "two_sigma",
    """SELECT 'value' AS column_name, count(value) AS values_checked, count(*) FILTER (WHERE abs(value - m) > 2 * d) AS anomaly_count
    FROM events CROSS JOIN (SELECT avg(value) AS m, stddev_samp(value) AS d FROM events) AS s""",
)
def two_sigma(spark, sf):
    return outliers.two_sigma(table(spark, sf, "events"), "value")


# Every user has well over 21 events, so each window has seven points (sf0.001: checked in tests).
_SPIKES = """WITH w AS (SELECT user_id, event_id, value, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
      avg(value) OVER f AS m, stddev_samp(value) OVER f AS d, sum(value) OVER f AS s, sum(value * value) OVER f AS q FROM events
      WINDOW f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))"""


@query(
    "rolling_spike",
    _SPIKES + "SELECT event_id, CASE WHEN pos >= 3 AND pos + 3 <= n - 1 THEN round((value - m) / d, 4) END AS z_score FROM w",
)
def rolling_spike(spark, sf):
    scored = series.spike_scores(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value")
    return rounded(scored.select("event_id", "z_score"), 4)


@query(
    "rolling_spike_one_series",
    """WITH w AS (SELECT event_id, value, count(*) OVER () AS n, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, avg(value) OVER f AS m, stddev_samp(value) OVER f AS d
      FROM events WINDOW f AS (ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
    SELECT event_id, CASE WHEN pos >= 3 AND pos + 3 <= n - 1 THEN round((value - m) / d, 4) END AS z_score FROM w""",
)
def rolling_spike_one_series(spark, sf):
    """No series key: the whole table is one series and is cut into buckets."""
    scored = series.spike_scores(table(spark, sf, "events"), [], ["ts", "event_id"], "value", bucket_rows=1000)
    return rounded(scored.select("event_id", "z_score"), 4)


@query(
    "leave_one_out_spike",
    """WITH w AS (SELECT user_id, event_id, ts, value, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
      list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS b,
      list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS a FROM events),
    o AS (SELECT *, list_concat(b, a) AS l FROM w WHERE pos >= 3 AND pos + 3 <= n - 1)
    SELECT event_id, round((value - list_avg(l)) / list_stddev_samp(l), 4) AS z_score FROM o WHERE list_stddev_samp(l) > 0 AND abs((value - list_avg(l)) / list_stddev_samp(l)) > 5""",
)
def leave_one_out_spike(spark, sf):
    found = series.spikes(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value", leave_one_out=True)
    return rounded(found.select("event_id", "z_score"), 4)


def trend_sql(partition: str) -> str:
    over = f"({partition} ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING)"
    return f"""WITH w AS (SELECT user_id, event_id, ts, value, count(*) OVER ({partition}) AS n, row_number() OVER ({partition} ORDER BY ts, event_id) - 1 AS pos FROM events),
      c AS (SELECT *, corr(value, CAST(pos AS DOUBLE)) OVER {over} AS r FROM w),
      k AS (SELECT * FROM c WHERE pos >= 10 AND pos < n - 10),
      j AS (SELECT *, abs(r - lag(r) OVER ({partition} ORDER BY ts, event_id)) AS jump FROM k)
      SELECT event_id, round(r, 6) AS correlation FROM j WHERE jump > 0.4"""


def trend_rows(spark, sf, keys, bucket_rows):
    scored = series.trend_scores(table(spark, sf, "events"), keys, ["ts", "event_id"], "value", bucket_rows)
    return rounded(scored.filter(F.abs(F.col("correlation") - F.col("previous")) > 0.4).select("event_id", "correlation"))


@query("trend_change", trend_sql("PARTITION BY user_id"))
def trend_change(spark, sf):
    """Per user; jumps above 0.4, because the published 0.8 finds nothing in these values."""
    return trend_rows(spark, sf, ["user_id"], series.BUCKET_ROWS)


@query("trend_change_one_series", trend_sql(""))
def trend_change_one_series(spark, sf):
    return trend_rows(spark, sf, [], 1000)


@query(
    "series_summary",
    _SPIKES
    + f"""SELECT 'spike_detection' AS detector_name, 'time_series_spike' AS anomaly_type, 'value' AS column_name, hits AS anomaly_count, total AS total_count, round(hits * 100e0 / total, 6) AS anomaly_rate,
      CASE WHEN hits > 0 THEN round(least(worst / 6, 1e0), 6) ELSE 0e0 END AS severity_score, 'Time series spikes/drops in value' AS description
      FROM (SELECT count(*) FILTER (WHERE z > 3) AS hits, max(z) AS worst, (SELECT count(*) FROM events) AS total FROM (SELECT abs((value - m) / d) AS z FROM w WHERE pos >= 3 AND pos + 3 <= n - 1) AS y) AS x
    UNION ALL SELECT 'trend_change', 'trend_change', 'value', n, t, round(n * 100e0 / t, 6), round(n / CAST(t AS DOUBLE), 6), 'Trend changes in value'
      FROM (SELECT (SELECT count(*) FROM ({trend_sql("PARTITION BY user_id").replace("jump > 0.4", "jump > 0.8")}) AS k) AS n, (SELECT count(*) FROM events) AS t) AS c""",
)
def series_summary(spark, sf):
    rows = table(spark, sf, "events")
    return rounded(series.series_summaries(rows, ["ts", "event_id"], ["value"], ["user_id"]))


@query(
    "yearly_spike",
    cte(e=EMISSIONS)
    + """, s AS (SELECT facility_id, reporting_year, l_orderkey, l_linenumber, l_partkey, annual_emission_amount AS v,
      lag(annual_emission_amount) OVER (PARTITION BY facility_id ORDER BY reporting_year, l_orderkey, l_linenumber, l_partkey, annual_emission_amount) AS p,
      count(*) OVER (PARTITION BY facility_id) AS n FROM e WHERE annual_emission_amount IS NOT NULL)
    SELECT facility_id, l_orderkey, l_linenumber, l_partkey, round(v, 2) AS annual_emission_amount, round(p, 2) AS previous_value FROM s
    WHERE n >= 3 AND CASE WHEN p = 0 THEN v > 0 ELSE v / p - 1 > 10 END""",
)
def yearly_spike(spark, sf):
    order = ["reporting_year", "l_orderkey", "l_linenumber", "l_partkey", "annual_emission_amount"]
    found = series.year_spikes(frame(spark, sf, EMISSIONS), "facility_id", order[:-1] + ["annual_emission_amount"], "annual_emission_amount")
    return rounded(found.select("facility_id", *order[1:], "previous_value"), 2)


@query(
    "impossible_locations",
    cte(f=FACILITIES)
    + """SELECT facility_id FROM f WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND (latitude < -90 OR latitude > 90 OR longitude < -180 OR longitude > 180
      OR (latitude = longitude AND abs(latitude) < 1) OR length(rtrim(split_part(CAST(latitude AS VARCHAR), '.', 2), '0')) > 8)""",
)
def impossible_locations(spark, sf):
    found = detectors.flagged_rows(frame(spark, sf, FACILITIES), [detectors.impossible_locations("latitude", "longitude")], ["facility_id"])
    return found.select("facility_id")


@query(
    "coarse_locations",
    cte(f=FACILITIES)
    + """SELECT facility_id FROM f WHERE latitude IS NOT NULL AND longitude IS NOT NULL
      AND ((length(rtrim(split_part(CAST(latitude AS VARCHAR), '.', 2), '0')) < 3 AND latitude <> 0) OR longitude <> 0)""",
)
def coarse_locations(spark, sf):
    found = detectors.flagged_rows(frame(spark, sf, FACILITIES), [detectors.coarse_locations("latitude", "longitude")], ["facility_id"])
    return found.select("facility_id")


def core_sql(frame_name: str, x: str, y: str, eps: float = 0.5) -> str:
    return f"""p AS (SELECT {x} AS lat, {y} AS lon, count(*) AS weight FROM {frame_name} WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY 1, 2),
      s AS (SELECT avg({x}) AS mx, stddev_pop({x}) AS sx, avg({y}) AS my, stddev_pop({y}) AS sy FROM {frame_name} WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
      z AS (SELECT lat, lon, weight, (lat - mx) / sx AS a, (lon - my) / sy AS b FROM p CROSS JOIN s),
      core AS MATERIALIZED (SELECT l.lat, l.lon, any_value(l.a) AS a, any_value(l.b) AS b FROM z AS l JOIN z AS r ON (l.a - r.a) ** 2 + (l.b - r.b) ** 2 <= {eps}e0 * {eps}e0 GROUP BY l.lat, l.lon HAVING sum(r.weight) >= 5),
      noise AS (SELECT lat, lon FROM z WHERE NOT EXISTS (SELECT 1 FROM core WHERE (z.a - core.a) ** 2 + (z.b - core.b) ** 2 <= {eps}e0 * {eps}e0))"""


def noise_sql(frame_name: str, ids: str, x: str, y: str, eps: float = 0.5) -> str:
    return core_sql(frame_name, x, y, eps) + f"""
      SELECT {ids} FROM {frame_name} JOIN noise ON {x} = lat AND {y} = lon"""


SPREAD_POINTS = "SELECT event_id, value * value * value AS x, CAST(user_id AS DOUBLE) * value AS y FROM events"


@query("dbscan_noise", cte(t=SPREAD_POINTS) + ", " + noise_sql("t", "event_id", "x", "y"))
def dbscan_noise(spark, sf):
    clustering = Clustering(frame(spark, sf, SPREAD_POINTS), "x", "y")
    return clustering.noise_rows(["event_id"]).select("event_id")


@query("dbscan_facilities", cte(f=FACILITIES) + ", " + noise_sql("f", "facility_id", "latitude", "longitude", 0.02))
def dbscan_facilities(spark, sf):
    """A radius at which some facilities are alone."""
    return Clustering(frame(spark, sf, FACILITIES), "latitude", "longitude", eps=0.02).noise_rows(["facility_id"]).select("facility_id")


def clusters_sql(frame_name: str, x: str, y: str, eps: float = 0.5) -> tuple[str, str]:
    """Tables of the clusters, and their summary row.

    Core points of one cell belong together, so the recursion goes over cells with core points within reach.
    """
    return core_sql(frame_name, x, y, eps) + f""",
      c AS MATERIALIZED (SELECT a, b, floor(a / ({eps}e0 / sqrt(2e0))) AS i, floor(b / ({eps}e0 / sqrt(2e0))) AS j FROM core),
      near AS MATERIALIZED (SELECT DISTINCT l.i, l.j, r.i AS ri, r.j AS rj FROM c AS l JOIN c AS r ON r.i BETWEEN l.i - 2 AND l.i + 2 AND r.j BETWEEN l.j - 2 AND l.j + 2
        AND (l.a - r.a) ** 2 + (l.b - r.b) ** 2 <= {eps}e0 * {eps}e0),
      reach AS (SELECT DISTINCT i, j, i AS ri, j AS rj FROM c UNION SELECT reach.i, reach.j, near.ri, near.rj FROM reach JOIN near ON near.i = reach.ri AND near.j = reach.rj),
      groups AS (SELECT count(DISTINCT first) AS n FROM (SELECT i, j, min({{'i': ri, 'j': rj}}) AS first FROM reach GROUP BY i, j) AS firsts),
      alone AS (SELECT count(*) AS n FROM {frame_name} JOIN noise ON {x} = lat AND {y} = lon),
      whole AS (SELECT count(*) AS n, count(*) FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL) AS placed FROM {frame_name})""", f"""
      SELECT 'geographic_clustering' AS detector_name, 'clustering_anomaly' AS anomaly_type, NULL::VARCHAR AS column_name, alone.n AS anomaly_count, whole.n AS total_count,
        round(alone.n * 100e0 / whole.n, 6) AS anomaly_rate, round(least(alone.n::DOUBLE / placed, 1e0), 6) AS severity_score,
        'Points that belong to no cluster; clusters found: ' || groups.n AS description FROM alone, whole, groups"""


@query("dbscan_summary", cte(t=SPREAD_POINTS).replace("WITH", "WITH RECURSIVE", 1) + ", " + "".join(clusters_sql("t", "x", "y")))
def dbscan_summary(spark, sf):
    """Noise count and number of clusters."""
    return rounded(Clustering(frame(spark, sf, SPREAD_POINTS), "x", "y").summary())


@query(
    "shared_points",
    "SELECT c_nationkey, c_mktsegment, count(*) AS rows_at_point FROM customer GROUP BY ALL HAVING count(*) > 5",
)
def shared_points(spark, sf):
    return detectors.shared_points(table(spark, sf, "customer"), "c_nationkey", "c_mktsegment")


@query(
    "compliance_detectors",
    cte(f=FACILITIES)
    + """SELECT 'violations_without_inspections' AS detector_name, count(*) FILTER (WHERE violation_count > 0 AND inspection_count = 0) AS anomaly_count,
      round(count(*) FILTER (WHERE violation_count > 0 AND inspection_count = 0) / CAST(count(*) AS DOUBLE), 6) AS severity_score FROM f
    UNION ALL SELECT 'excessive_penalties', count(*) FILTER (WHERE penalty_amount > 1000000), round(count(*) FILTER (WHERE penalty_amount > 1000000) / CAST(count(penalty_amount) AS DOUBLE), 6) FROM f
    UNION ALL SELECT 'compliance_inconsistencies', count(*) FILTER (WHERE c), round(count(*) FILTER (WHERE c) / CAST(count(*) AS DOUBLE), 6) FROM (SELECT
      (violation_count > 0 AND upper(compliance_status) IN ('COMPLIANT', 'GOOD', 'CLEAN')) OR (violation_count = 0 AND upper(compliance_status) IN ('NON-COMPLIANT', 'VIOLATION', 'SNC')) AS c FROM f) AS t""",
)
def compliance_detectors(spark, sf):
    rows = frame(spark, sf, FACILITIES)
    found = detectors.summarise(rows, detectors.compliance_detectors(rows.columns))
    return rounded(found.select("detector_name", "anomaly_count", "severity_score"))


@query(
    "flagged_facilities",
    cte(f=FACILITIES)
    + """SELECT 'violations_without_inspections' AS detector_name, facility_id FROM f WHERE violation_count > 0 AND inspection_count = 0
    UNION ALL SELECT 'excessive_penalties', facility_id FROM f WHERE penalty_amount > 1000000
    UNION ALL SELECT 'compliance_inconsistencies', facility_id FROM f WHERE (violation_count > 0 AND upper(compliance_status) IN ('COMPLIANT', 'GOOD', 'CLEAN'))
      OR (violation_count = 0 AND upper(compliance_status) IN ('NON-COMPLIANT', 'VIOLATION', 'SNC'))""",
)
def flagged_facilities(spark, sf):
    rows = frame(spark, sf, FACILITIES)
    return detectors.flagged_rows(rows, detectors.compliance_detectors(rows.columns), ["facility_id"])


MOSTLY_ZERO = f"SELECT facility_id, state_code, CASE WHEN annual_emission_amount > 900000000 THEN annual_emission_amount WHEN annual_emission_amount > 0 THEN 0.0005e0 ELSE 0e0 END AS few, annual_emission_amount AS many FROM ({FACILITIES}) AS f"


@query(
    "zero_emissions",
    cte(t=MOSTLY_ZERO)
    + """SELECT 'few' AS column_name, count(*) FILTER (WHERE few <= 0.001e0) AS anomaly_count, round(least(1e0, 2 * count(*) FILTER (WHERE few <= 0.001e0) / CAST(count(few) AS DOUBLE)), 6) AS severity_score FROM t
    UNION ALL SELECT 'many', 0, 0e0""",
)
def zero_emissions(spark, sf):
    found = detectors.summarise(frame(spark, sf, MOSTLY_ZERO), [detectors.zero_emissions("few"), detectors.zero_emissions("many")])
    return rounded(found.select("column_name", "anomaly_count", "severity_score"))


@query("zero_emission_rows", cte(t=MOSTLY_ZERO) + "SELECT 'zero_emissions' AS detector_name, facility_id FROM t WHERE few <= 0.001e0")
def zero_emission_rows(spark, sf):
    """Gates: the column with many zeros is reported, the other is not."""
    return detectors.flagged_rows(frame(spark, sf, MOSTLY_ZERO), [detectors.zero_emissions("few"), detectors.zero_emissions("many")], ["facility_id"])


def row_sql(kind: str, name: str, column: str | None, hits: str, severity: str, description: str, source: str) -> str:
    """A summary row; ``hits``, ``severity`` and ``description`` are expressions over ``source``."""
    shown = f"'{column}'" if column else "NULL"
    return f"""SELECT '{name}' AS detector_name, '{kind}' AS anomaly_type, {shown}::VARCHAR AS column_name, CAST({hits} AS BIGINT) AS anomaly_count, (SELECT count(*) FROM f) AS total_count,
      {hits} * 100e0 / (SELECT count(*) FROM f) AS anomaly_rate, {severity} AS severity_score, {description} AS description FROM {source}"""


def outlier_rows_sql(c: str) -> list[str]:
    """The three statistical detectors; one that has too few values or no spread cannot be tested."""
    untested = f"'{c} cannot be tested'"
    stats = f"(SELECT count({c}) AS n, avg({c}) AS m, stddev_pop({c}) AS d, quantile_cont({c}, 0.25) AS q1, median({c}) AS mid, quantile_cont({c}, 0.75) AS q3 FROM f) AS s"
    z = f"(SELECT n, d, coalesce(max(abs({c} - m)) / nullif(d, 0), 0) AS worst, count(*) FILTER (WHERE d > 0 AND n >= 3 AND abs(({c} - m) / d) > 3) AS hits FROM f CROSS JOIN {stats} GROUP BY n, d) AS t"
    far = "greatest(q1 - 1.5e0 * (q3 - q1) - low, high - q3 - 1.5e0 * (q3 - q1), 0e0)"
    iqr = f"(SELECT n, q1, q3, min({c}) AS low, max({c}) AS high, count(*) FILTER (WHERE n >= 4 AND ({c} < q1 - 1.5e0 * (q3 - q1) OR {c} > q3 + 1.5e0 * (q3 - q1))) AS hits FROM f CROSS JOIN {stats} GROUP BY n, q1, q3) AS t"
    mad = f"(SELECT median(abs({c} - (SELECT median({c}) FROM f))) AS mad FROM f) AS a"
    modified = f"(SELECT n, mad, coalesce(max(abs({c} - mid)) * 0.6745e0 / nullif(mad, 0), 0) AS worst, count(*) FILTER (WHERE n >= 3 AND mad > 0 AND abs(({c} - mid) * 0.6745e0 / mad) > 3.5e0) AS hits FROM f CROSS JOIN {stats} CROSS JOIN {mad} GROUP BY n, mad) AS t"
    return [
        row_sql("statistical_outlier", "z_score", c, "hits", "CASE WHEN n >= 3 THEN least(worst / 6, 1e0) ELSE 0e0 END", f"CASE WHEN n >= 3 AND d > 0 THEN 'Z-score outliers in {c} (threshold: 3.0)' ELSE {untested} END", z),
        row_sql(
            "statistical_outlier", "iqr", c, "hits", f"CASE WHEN hits > 0 THEN least(coalesce({far} / nullif(q3 - q1, 0), 5e0) / 5, 1e0) ELSE 0e0 END",
            f"CASE WHEN n >= 4 THEN 'IQR outliers in {c} (multiplier: 1.5)' ELSE {untested} END", iqr,
        ),
        row_sql(
            "statistical_outlier", "modified_z_score", c, "hits", "CASE WHEN n >= 3 THEN least(worst / 7, 1e0) ELSE 0e0 END",
            f"CASE WHEN n >= 3 AND mad > 0 THEN 'Modified Z-score outliers in {c}' ELSE {untested} END", modified,
        ),
    ]


def series_rows_sql(c: str, order: str) -> list[str]:
    """Spikes and trend changes of one long series (at least 21 values, so that every window has its full length)."""
    near = f"""(SELECT {c} AS v, row_number() OVER (ORDER BY {order}) - 1 AS pos, count(*) OVER () AS n, avg({c}) OVER w AS m, stddev_samp({c}) OVER w AS d, min({c}) OVER w AS low, max({c}) OVER w AS high
      FROM f WHERE {c} IS NOT NULL WINDOW w AS (ORDER BY {order} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))"""
    spikes = f"(SELECT count(*) FILTER (WHERE z > 3) AS hits, max(z) FILTER (WHERE z > 3) AS worst FROM (SELECT abs((v - m) / d) AS z FROM {near} AS x WHERE pos >= 3 AND pos + 3 < n AND high > low) AS y) AS t"
    placed = f"(SELECT CAST({c} AS DOUBLE) AS v, row_number() OVER (ORDER BY {order}) - 1 AS pos, count(*) OVER () AS n FROM f WHERE {c} IS NOT NULL)"
    judged = f"""(SELECT r, pos FROM (SELECT pos, n, corr(v, CAST(pos AS DOUBLE)) OVER w AS r, min(v) OVER w AS low, max(v) OVER w AS high FROM {placed} AS p
      WINDOW w AS (ORDER BY pos ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING)) AS q WHERE pos >= 10 AND pos < n - 10 AND high > low)"""
    trends = f"(SELECT count(*) FILTER (WHERE jump > 0.8e0) AS hits, (SELECT count({c}) FROM f) AS n FROM (SELECT abs(r - lag(r) OVER (ORDER BY pos)) AS jump FROM {judged} AS j) AS k) AS t"
    return [
        row_sql("time_series_spike", "spike_detection", c, "hits", "CASE WHEN hits > 0 THEN least(worst / 6, 1e0) ELSE 0e0 END", f"'Time series spikes/drops in {c}'", spikes),
        row_sql("trend_change", "trend_change", c, "hits", "least(coalesce(hits / CAST(nullif(n, 0) AS DOUBLE), 0e0), 1e0)", f"'Trend changes in {c}'", trends),
    ]


def detector_row_sql(kind: str, name: str, column: str | None, hit: str, base: str, description: str, scale: int = 1, gate: float | None = None) -> str:
    """A detector over single rows; severity is the share of the rows looked at, nothing is reported below the gate."""
    counted = f"(SELECT count(*) FILTER (WHERE ({base}) AND ({hit})) AS found, count(*) FILTER (WHERE {base}) AS base FROM f)"
    shown = f"found > base * {gate}" if gate is not None else "true"
    source = f"(SELECT CASE WHEN {shown} THEN found ELSE 0 END AS hits, base FROM {counted} AS c) AS t"
    return row_sql(kind, name, column, "hits", f"least(coalesce(hits / CAST(nullif(base, 0) AS DOUBLE), 0e0) * {scale}, 1e0)", f"'{description}'", source)


_PLACES = "length(rtrim(split_part(CAST({} AS VARCHAR), '.', 2), '0'))"
_CHECKED = (
    "latitude", "longitude", "epa_region", "annual_emission_amount", "ph_level", "measurement_year", "compliance_violations", "violation_count", "inspection_count", "penalty_amount",
    "data_quality_score",
)
_LOCATED = "latitude IS NOT NULL AND longitude IS NOT NULL"
_CLUSTERS = clusters_sql("f", "latitude", "longitude")
_EVERY_ROW = [
    *[part for c in _CHECKED for part in outlier_rows_sql(c)],
    *[part for c in _CHECKED if c != "measurement_year" for part in series_rows_sql(c, "measurement_year, facility_id")],
    detector_row_sql(
        "geographic_impossible", "impossible_locations", None,
        f"latitude < -90 OR latitude > 90 OR longitude < -180 OR longitude > 180 OR (latitude = longitude AND abs(latitude) < 1) OR {_PLACES.format('latitude')} > 8",
        _LOCATED, "Points outside the globe or at a placeholder position",
    ),
    detector_row_sql(
        "precision_anomaly", "coordinate_precision", None, f"({_PLACES.format('latitude')} < 3 AND latitude <> 0) OR longitude <> 0", _LOCATED,
        "Points given with too few decimals", scale=2,
    ),
    detector_row_sql("compliance_anomaly", "violations_without_inspections", None, "violation_count > 0 AND inspection_count = 0", "true", "Violations on record, yet nobody inspected"),
    detector_row_sql("compliance_anomaly", "excessive_penalties", "penalty_amount", "penalty_amount > 1000000", "penalty_amount IS NOT NULL", "Penalties above one million dollars"),
    detector_row_sql(
        "compliance_anomaly", "compliance_inconsistencies", None,
        """(violation_count > 0 AND upper(compliance_status) IN ('COMPLIANT', 'GOOD', 'CLEAN')) OR (violation_count = 0 AND upper(compliance_status) IN ('NON-COMPLIANT', 'VIOLATION', 'SNC'))""",
        "true", "Status and number of violations contradict each other",
    ),
    detector_row_sql(
        "emission_anomaly", "zero_emissions", "annual_emission_amount", "annual_emission_amount <= 0.001e0", "annual_emission_amount IS NOT NULL",
        "Unusually many emissions at or near zero", scale=2, gate=0.5,
    ),
]
_FACILITY_ANOMALIES = (
    cte(f=FACILITIES).replace("WITH", "WITH RECURSIVE", 1).replace(" AS (", " AS MATERIALIZED (", 1) + ", " + _CLUSTERS[0] + _CLUSTERS[1] + "".join(f" UNION ALL {part}" for part in _EVERY_ROW)
)


def anomalies_of(spark, sf):
    return settle(anomalies.all_anomalies(frame(spark, sf, FACILITIES), ["facility_id"]))


@query(
    "all_anomalies",
    f"""SELECT detector_name, anomaly_type, column_name, anomaly_count, total_count, round(anomaly_rate, 6) AS anomaly_rate, round(severity_score, 6) AS severity_score, description
      FROM ({_FACILITY_ANOMALIES}) AS a""",
)
def all_anomalies(spark, sf):
    return rounded(anomalies_of(spark, sf))


@query(
    "anomaly_summary",
    f"""SELECT total_detectors, detectors_with_anomalies, records_analyzed, anomalies_found, round(average_severity, 6) AS average_severity, round(anomalies_found * 100e0 / records_analyzed, 6) AS overall_anomaly_rate
      FROM (SELECT count(*) AS total_detectors, count(*) FILTER (WHERE anomaly_count > 0) AS detectors_with_anomalies, CAST(floor(sum(total_count) / count(*)) AS BIGINT) AS records_analyzed,
        CAST(sum(anomaly_count) AS BIGINT) AS anomalies_found, coalesce(avg(severity_score) FILTER (WHERE severity_score > 0), 0) AS average_severity FROM ({_FACILITY_ANOMALIES}) AS a) AS s""",
)
def anomaly_summary(spark, sf):
    return rounded(anomalies.anomaly_summary(anomalies_of(spark, sf)))


@query(
    "anomalies_by_type",
    f"""SELECT anomaly_type, count(*) AS detectors, CAST(sum(anomaly_count) AS BIGINT) AS total_anomalies, count(*) FILTER (WHERE severity_score > 0.7e0) AS high_severity
      FROM ({_FACILITY_ANOMALIES}) AS a GROUP BY anomaly_type""",
)
def anomalies_by_type(spark, sf):
    found = anomalies_of(spark, sf)
    severe = anomalies.high_severity(found).groupBy("anomaly_type").agg(F.count(F.lit(1)).alias("high_severity"))
    return anomalies.by_type(found).join(severe, "anomaly_type", "left").fillna(0)


# Trends over daily means of the events.
DAILY = "SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS day, avg(value) AS score, 100e0 * avg(CASE WHEN value > 100 THEN 1e0 ELSE 0e0 END) AS error_rate FROM events GROUP BY 1, 2"

_TREND = """, p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS x FROM d),
    t AS (SELECT event_type, count(*) AS points, regr_slope(score, x) AS slope, regr_intercept(score, x) AS intercept, max_by(score, x) AS current_value,
      min(score) AS min_value, max(score) AS max_value, avg(score) AS average_value, stddev_pop(score) AS volatility FROM p GROUP BY event_type)"""


@query(
    "trend_fit",
    cte(d=DAILY)
    + _TREND
    + """SELECT event_type, points, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(current_value, 6) AS current_value, round(min_value, 6) AS min_value,
    round(max_value, 6) AS max_value, round(average_value, 6) AS average_value, round(volatility, 6) AS volatility,
    CASE WHEN slope > 0.1e0 THEN 'improving' WHEN slope < -0.1e0 THEN 'declining' ELSE 'stable' END AS trend_direction FROM t""",
)
def trend_fit(spark, sf):
    return rounded(series.trend(frame(spark, sf, DAILY), ["event_type"], ["day"], "score", stable_within=0.1))


@query(
    "forecast",
    cte(d=DAILY)
    + _TREND
    + "SELECT event_type, period, round(greatest(0e0, least(100e0, slope * (points + period - 1) + intercept)), 6) AS forecast_score, round(slope, 6) AS slope FROM t CROSS JOIN (SELECT unnest([1::BIGINT, 2, 3]) AS period) AS n",
)
def forecast(spark, sf):
    return rounded(series.forecast(series.trend(frame(spark, sf, DAILY), ["event_type"], ["day"], "score"), ["event_type"]))


DAILY_ALL = "SELECT CAST(date_trunc('day', ts) AS DATE) AS day, avg(value) AS score, 100e0 * avg(CASE WHEN value > 100 THEN 1e0 ELSE 0e0 END) AS error_rate FROM events GROUP BY 1"


@query(
    "first_to_last",
    cte(d=DAILY_ALL)
    + """, e AS (SELECT min(day) AS a, max(day) AS b, min_by(score, day) AS s0, max_by(score, day) AS s1, min_by(error_rate, day) AS r0, max_by(error_rate, day) AS r1 FROM d)
    SELECT CAST(a AS VARCHAR) AS period_start, CAST(b AS VARCHAR) AS period_end, round(s1 - s0, 6) AS quality_gain, round((s1 - s0) / s0 * 100, 6) AS quality_gain_percent,
    round(r0 - r1, 6) AS error_reduction, round(CASE WHEN r0 > 0 THEN (r0 - r1) / r0 * 100 ELSE 0 END, 6) AS error_reduction_percent,
    CASE WHEN r0 > 0 THEN (r0 - r1) / r0 * 100 ELSE 0 END >= 42 AS target_met FROM e""",
)
def first_to_last(spark, sf):
    ends = series.first_to_last(frame(spark, sf, DAILY_ALL), "day", "score", "error_rate")
    return rounded(ends.withColumns({"period_start": F.col("period_start").cast("string"), "period_end": F.col("period_end").cast("string")}))
