"""Connectome / signal queries on events as a long (scan, t, roi, value) table.

scan = user, t = day, roi = event type, value = the day's mean value.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from clinlake.functions.exprs import nan_to_null
from clinlake.operators import connectome, signal
from clinlake.session import table


def _long(spark, sf):
    ev = table(spark, sf, "events", ["ts", "user_id", "event_type", "value"])
    return ev.groupBy(F.col("user_id").alias("scan"), F.to_date("ts").alias("t"),
                      F.col("event_type").alias("roi")).agg(F.avg("value").alias("value"))


_LONG_CTE = """lg AS (SELECT user_id AS scan, CAST(ts AS DATE) AS t, event_type AS roi, avg(value) AS value FROM events GROUP BY ALL),
pc AS (SELECT a.scan, a.roi AS roi_i, b.roi AS roi_j, corr(a.value, b.value) AS r, count(*) AS n
       FROM lg a JOIN lg b ON a.scan = b.scan AND a.t = b.t AND a.roi < b.roi GROUP BY ALL)"""


def pair_correlation_edges(spark, sf):
    pc = connectome.pair_correlations(_long(spark, sf), "scan", "t", "roi", "value")
    return pc.select("scan", "roi_i", "roi_j", F.round(nan_to_null("r"), 6).alias("r"), "n")


_PC_SQL = f"""WITH {_LONG_CTE}
SELECT scan, roi_i, roi_j, round(CASE WHEN isnan(r) THEN NULL ELSE r END, 6) AS r, n FROM pc"""


def proportional_threshold(spark, sf):
    pc = connectome.pair_correlations(_long(spark, sf), "scan", "t", "roi", "value").withColumn("r", nan_to_null("r"))
    th = connectome.proportional_threshold(pc, 0.85)
    return th.select("scan", "src", "dst", F.round("r", 6).alias("r"))


_PT_SQL = f"""WITH {_LONG_CTE},
nz AS (SELECT * , round(abs(r), 9) AS a FROM pc WHERE r IS NOT NULL AND NOT isnan(r) AND r <> 0),
cut AS (SELECT scan, quantile_cont(a, 0.85) AS c FROM nz GROUP BY scan),
k AS (SELECT nz.* FROM nz JOIN cut USING (scan) WHERE a >= c)
SELECT scan, roi_i AS src, roi_j AS dst, round(r, 6) AS r FROM k
UNION ALL SELECT scan, roi_j, roi_i, round(r, 6) FROM k"""


def population_edge_frequency(spark, sf):
    pc = connectome.pair_correlations(_long(spark, sf), "scan", "t", "roi", "value") \
        .withColumn("r", nan_to_null("r")).dropna(subset=["r"])
    pe = connectome.population_edges(pc, "r", top_frac=0.10, min_share=0.30)
    return pe.select("roi_i", "roi_j", "n_scans", F.round("mean_importance", 6).alias("mean_importance"))


_POP_SQL = f"""WITH {_LONG_CTE},
v AS (SELECT * FROM pc WHERE r IS NOT NULL AND NOT isnan(r)),
rk AS (SELECT *, row_number() OVER (PARTITION BY scan ORDER BY abs(r) DESC, roi_i, roi_j) AS rk,
              count(*) OVER (PARTITION BY scan) AS nn FROM v),
top AS (SELECT * FROM rk WHERE rk <= greatest(1, floor(nn * 0.10))),
ns AS (SELECT count(DISTINCT scan) AS ns FROM v),
a AS (SELECT roi_i, roi_j, count(*) AS n_scans, avg(abs(r)) AS mi FROM top GROUP BY ALL)
SELECT roi_i, roi_j, n_scans, round(mi, 6) AS mean_importance FROM a, ns WHERE n_scans >= 0.30 * ns"""


def otsu_threshold(spark, sf):
    pc = connectome.pair_correlations(_long(spark, sf), "scan", "t", "roi", "value") \
        .withColumn("r", nan_to_null("r")).dropna(subset=["r"])
    o = connectome.otsu_threshold(pc.select(F.abs("r").alias("a")), "a", 128)
    return o.select(F.round("threshold", 9).alias("threshold"), F.round("between_var", 6).alias("between_var"))


_OTSU_SQL = f"""WITH {_LONG_CTE},
v AS (SELECT abs(r) AS a FROM pc WHERE r IS NOT NULL AND NOT isnan(r)),
rg AS (SELECT min(a) AS lo, max(a) AS hi FROM v),
b AS (SELECT CAST(coalesce(least(greatest(floor((a - lo) / nullif((hi - lo) / 128, 0)), 0), 127), 0) AS INTEGER) AS bin, lo, hi FROM v, rg),
h AS (SELECT bin, lo, hi, count(*) AS c, lo + (bin + 0.5) * ((hi - lo) / 128) AS center FROM b GROUP BY ALL),
cs AS (SELECT *, sum(c) OVER w AS w0, sum(c * center) OVER w AS s0, sum(c) OVER () AS n, sum(c * center) OVER () AS s
       FROM h WINDOW w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
bv AS (SELECT bin, lo + (bin + 1) * ((hi - lo) / 128) AS thr,
              CASE WHEN n - w0 > 0 THEN w0 * (n - w0) * (s0 / w0 - (s - s0) / (n - w0)) ** 2 ELSE 0.0 END AS bvar FROM cs)
SELECT round(arg_max(thr, (bvar, -bin)), 9) AS threshold, round(max(bvar), 6) AS between_var FROM bv"""


def histogram_entropy(spark, sf):
    ev = table(spark, sf, "events", ["user_id", "value"])
    h = connectome.histogram_entropy(ev, ["user_id"], "value", 32)
    return h.select("user_id", F.round("entropy", 6).alias("entropy"))


_ENTROPY_SQL = """
WITH r AS (SELECT user_id, min(value) AS lo, max(value) AS hi, count(value) AS n FROM events GROUP BY user_id),
b AS (SELECT e.user_id, CAST(coalesce(least(greatest(floor((value - lo) / nullif((hi - lo) / 32, 0)), 0), 31), 0) AS INTEGER) AS bin,
             lo, hi, n FROM events e JOIN r USING (user_id) WHERE value IS NOT NULL),
h AS (SELECT user_id, bin, count(*) / (max(n) * ((max(hi) - max(lo)) / 32)) AS d FROM b GROUP BY ALL)
SELECT user_id, round(sum(CASE WHEN d > 0 THEN -d * ln(d) END), 6) AS entropy FROM h GROUP BY user_id
"""


def peak_count(spark, sf):
    """Steps of each user: peaks of the event values, ten samples apart at least."""
    ev = table(spark, sf, "events", ["event_id", "ts", "user_id", "value"])
    found = signal.peaks(ev, ["user_id"], ["ts", "event_id"], "value", 10)
    n = found.groupBy("user_id").agg(F.count(F.lit(1)).alias("steps"), F.max("height").alias("highest"), F.sum("pos").alias("places"))
    return ev.select("user_id").distinct().join(n, "user_id", "left").select(
        "user_id", F.coalesce("steps", F.lit(0)).alias("steps"), "highest", "places")


def peak_count_by_type(spark, sf):
    """The same over the long series of every event type."""
    ev = table(spark, sf, "events", ["event_id", "ts", "event_type", "value"])
    found = signal.peaks(ev, ["event_type"], ["ts", "event_id"], "value", 10)
    return found.groupBy("event_type").agg(F.count(F.lit(1)).alias("steps"), F.sum("pos").alias("places"))


def _peaks_sql(key, select):
    """Peaks one by one from the highest down; each names the later-ranked ones that it rules out."""
    return f"""
WITH RECURSIVE x AS (SELECT {key} AS g, value AS x, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) - 1 AS pos FROM events
    WHERE value IS NOT NULL AND NOT isnan(value)),
c AS (SELECT *, CASE WHEN lag(x) OVER w = x THEN 0 ELSE 1 END AS new FROM x WINDOW w AS (PARTITION BY g ORDER BY pos)),
r AS (SELECT g, x, pos, sum(new) OVER (PARTITION BY g ORDER BY pos) AS run FROM c),
runs AS (SELECT g, run, min(pos) AS lo, max(pos) AS hi, any_value(x) AS x FROM r GROUP BY g, run),
tops AS (SELECT g, x, (lo + hi) // 2 AS pos, lag(x) OVER w < x AND lead(x) OVER w < x AS top FROM runs WINDOW w AS (PARTITION BY g ORDER BY run)),
p AS MATERIALIZED (SELECT g, x, pos, row_number() OVER (PARTITION BY g ORDER BY x DESC, pos DESC) AS k FROM tops WHERE top),
near AS MATERIALIZED (SELECT a.g, a.k, list(b.pos) AS others FROM p a JOIN p b ON a.g = b.g AND a.k < b.k AND abs(a.pos - b.pos) < 10 GROUP BY ALL),
run AS (SELECT DISTINCT g, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS gone FROM p
    UNION ALL SELECT run.g, p.k, CASE WHEN list_contains(gone, p.pos) THEN gone ELSE list_concat(gone, coalesce(others, [])) END
    FROM run JOIN p ON p.g = run.g AND p.k = run.k + 1 LEFT JOIN near ON near.g = p.g AND near.k = p.k),
last AS (SELECT g, arg_max(gone, k) AS gone FROM run GROUP BY g),
kept AS (SELECT p.* FROM p JOIN last ON last.g = p.g WHERE NOT list_contains(gone, p.pos))
{select}"""


_PEAKS_SQL = _peaks_sql("user_id", """SELECT u.user_id, count(pos) AS steps, max(x) AS highest, CAST(sum(pos) AS BIGINT) AS places
FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN kept ON g = user_id GROUP BY u.user_id""")
_PEAKS_TYPE_SQL = _peaks_sql("event_type", "SELECT g AS event_type, count(*) AS steps, CAST(sum(pos) AS BIGINT) AS places FROM kept GROUP BY g")


QUERIES = {
    "peak_count": peak_count,
    "peak_count_by_type": peak_count_by_type,
    "pair_correlation_edges": pair_correlation_edges,
    "proportional_threshold": proportional_threshold,
    "population_edge_frequency": population_edge_frequency,
    "otsu_threshold": otsu_threshold,
    "histogram_entropy": histogram_entropy,
}

ORACLE = {
    "peak_count": _PEAKS_SQL,
    "peak_count_by_type": _PEAKS_TYPE_SQL,
    "pair_correlation_edges": _PC_SQL,
    "proportional_threshold": _PT_SQL,
    "population_edge_frequency": _POP_SQL,
    "otsu_threshold": _OTSU_SQL,
    "histogram_entropy": _ENTROPY_SQL,
}
