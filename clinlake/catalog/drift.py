"""Drift queries: PSI in three smoothings, drift report, mean shift, KS."""

from __future__ import annotations

from pyspark.sql import functions as F

from clinlake.operators import drift, profile
from clinlake.session import table

LI_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
# Reference period: lines shipped before this date; later lines are the current batch.
SPLIT_DATE = "1998-05-24"


def _lineitem_long(spark, sf):
    li = table(spark, sf, "lineitem", ["l_shipdate", *LI_FEATURES])
    side = F.when(F.col("l_shipdate") < F.lit(SPLIT_DATE).cast("timestamp_ntz"), "ref").otherwise("cur")
    return profile.to_long(li.withColumn("side", side), LI_FEATURES, ["side"])


def _long_sql():
    return " UNION ALL ".join(
        f"SELECT CASE WHEN l_shipdate < TIMESTAMP '{SPLIT_DATE}' THEN 'ref' ELSE 'cur' END AS side, "
        f"'{c}' AS feature, {c} AS value FROM lineitem" for c in LI_FEATURES)


def psi_three_modes(spark, sf):
    j = drift.psi_modes(_lineitem_long(spark, sf))
    return j.select("feature", *[F.round(x, 6).alias(x) for x in ("psi_smoothed", "psi_widened", "psi_prediction")])


def _psi_core(lo_adj: str, hi_adj: str) -> str:
    return f"""
r AS (SELECT feature, min(value) {lo_adj} AS lo, max(value) {hi_adj} AS hi,
             count(*) FILTER (WHERE side = 'ref') AS n_ref, count(*) FILTER (WHERE side = 'cur') AS n_cur
      FROM l WHERE value IS NOT NULL GROUP BY feature),
b AS (SELECT l.feature, l.side, CAST(coalesce(least(greatest(floor((value - lo) / nullif((hi - lo) / 10, 0)), 0), 9), 0) AS INTEGER) AS bin
      FROM l JOIN r USING (feature) WHERE value IS NOT NULL),
c AS (SELECT feature, bin, count(*) FILTER (WHERE side = 'ref') AS c_ref, count(*) FILTER (WHERE side = 'cur') AS c_cur
      FROM b GROUP BY feature, bin),
g AS (SELECT r.feature, n_ref, n_cur, CAST(x AS INTEGER) AS bin FROM r, range(0, 10) t(x)),
j AS (SELECT g.feature, g.n_ref::DOUBLE AS nr, g.n_cur::DOUBLE AS nc, coalesce(c_ref, 0)::DOUBLE AS cr,
             coalesce(c_cur, 0)::DOUBLE AS cc FROM g LEFT JOIN c ON g.feature = c.feature AND g.bin = c.bin)"""


def _psi_sql():
    return f"""
WITH l AS ({_long_sql()}),
s AS (WITH {_psi_core('', '')[1:]}
      SELECT feature, max(nr) AS nr, max(nc) AS nc,
             sum(((cc + 1e-6) / (nc + 1e-6 * 10) - (cr + 1e-6) / (nr + 1e-6 * 10))
                 * ln(((cc + 1e-6) / (nc + 1e-6 * 10)) / ((cr + 1e-6) / (nr + 1e-6 * 10)))) AS psi,
             sum((cc / greatest(nc, 1.0) - cr / greatest(nr, 1.0))
                 * ln((cc / greatest(nc, 1.0) + 1e-8) / (cr / greatest(nr, 1.0) + 1e-8))) AS psi_p
      FROM j GROUP BY feature),
w AS (WITH {_psi_core('- 1e-8', '+ 1e-8')[1:]}
      SELECT feature, sum(((cc / greatest(nc, 1.0) + 1e-8) - (cr / greatest(nr, 1.0) + 1e-8))
                 * ln((cc / greatest(nc, 1.0) + 1e-8) / (cr / greatest(nr, 1.0) + 1e-8))) AS psi
      FROM j GROUP BY feature)
SELECT s.feature,
       round(CASE WHEN s.nr < 10 OR s.nc < 10 THEN 0.0 ELSE greatest(s.psi, 0.0) END, 6) AS psi_smoothed,
       round(greatest(w.psi, 0.0), 6) AS psi_widened,
       round(s.psi_p, 6) AS psi_prediction
FROM s JOIN w USING (feature)
"""


def drift_report(spark, sf):
    rep = drift.drift_report(_lineitem_long(spark, sf))
    return rep.select("feature", F.round("psi", 6).alias("psi"), "severity", "overall_severity")


def _drift_report_sql():
    return f"""
WITH l AS ({_long_sql()}),
w AS (WITH {_psi_core('- 1e-8', '+ 1e-8')[1:]}
      SELECT feature, greatest(sum(((cc / greatest(nc, 1.0) + 1e-8) - (cr / greatest(nr, 1.0) + 1e-8))
                 * ln((cc / greatest(nc, 1.0) + 1e-8) / (cr / greatest(nr, 1.0) + 1e-8))), 0.0) AS psi
      FROM j GROUP BY feature),
s AS (SELECT feature, psi, CASE WHEN psi >= 0.25 THEN 'CRITICAL' WHEN psi >= 0.20 THEN 'WARNING'
             WHEN psi >= 0.10 THEN 'MINOR' ELSE 'NO_DRIFT' END AS severity,
             CASE WHEN psi >= 0.25 THEN 3 WHEN psi >= 0.20 THEN 2 WHEN psi >= 0.10 THEN 1 ELSE 0 END AS rk FROM w)
SELECT feature, round(psi, 6) AS psi, severity,
       CASE max(rk) OVER () WHEN 3 THEN 'CRITICAL' WHEN 2 THEN 'WARNING' WHEN 1 THEN 'MINOR' ELSE 'NO_DRIFT' END
         AS overall_severity
FROM s
"""


def mean_shift_drift(spark, sf):
    ms = drift.mean_shift(_lineitem_long(spark, sf))
    return ms.select("feature", F.round("shift_score", 6).alias("shift_score"), "drifted")


def _mean_shift_sql():
    return f"""
WITH l AS ({_long_sql()}),
s AS (SELECT feature, avg(value) FILTER (WHERE side = 'ref') AS m_ref, avg(value) FILTER (WHERE side = 'cur') AS m_cur,
             stddev_pop(value) FILTER (WHERE side = 'ref') AS sd_ref FROM l WHERE value IS NOT NULL GROUP BY feature)
SELECT feature,
       round(CASE WHEN m_ref IS NULL OR m_cur IS NULL THEN 0.0 ELSE abs(m_ref - m_cur) / (sd_ref + 1e-6) END, 6) AS shift_score,
       CASE WHEN m_ref IS NULL OR m_cur IS NULL THEN 0.0 ELSE abs(m_ref - m_cur) / (sd_ref + 1e-6) END > 0.15 AS drifted
FROM s
"""


def ks_two_sample(spark, sf):
    ev = table(spark, sf, "events", ["ts", "event_type", "value"])
    long = ev.select(F.col("event_type").alias("feature"), F.col("value").cast("double").alias("value"),
                     F.when(F.dayofmonth("ts") <= 15, "ref").otherwise("cur").alias("side"))
    ks = drift.ks_two_sample(long)
    return ks.select("feature", F.round("ks_stat", 6).alias("ks_stat"), F.round("p_value", 6).alias("p_value"),
                     "n_ref", "n_cur")


_KS_SQL = """
WITH l AS (SELECT event_type AS feature, value, CASE WHEN dayofmonth(ts) <= 15 THEN 'ref' ELSE 'cur' END AS side
           FROM events WHERE value IS NOT NULL),
c AS (SELECT feature, value, count(*) FILTER (WHERE side = 'ref') AS c_ref, count(*) FILTER (WHERE side = 'cur') AS c_cur
      FROM l GROUP BY feature, value),
cum AS (SELECT feature, value, sum(c_ref) OVER w AS cr, sum(c_cur) OVER w AS cc,
               sum(c_ref) OVER (PARTITION BY feature) AS n_ref, sum(c_cur) OVER (PARTITION BY feature) AS n_cur
        FROM c WINDOW w AS (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
d AS (SELECT feature, max(abs(cr / n_ref - cc / n_cur)) AS d, max(n_ref) AS n_ref, max(n_cur) AS n_cur
      FROM cum GROUP BY feature),
x AS (SELECT *, sqrt(n_ref * n_cur / (n_ref + n_cur)) * d AS x FROM d)
SELECT feature,
  round(CASE WHEN n_ref < 10 OR n_cur < 10 THEN 0.0 ELSE d END, 6) AS ks_stat,
  round(CASE WHEN n_ref < 10 OR n_cur < 10 THEN 1.0 WHEN x <= 0 THEN 1.0 ELSE
    least(greatest(2.0 * list_reduce(list_transform(range(1, 101), lambda k: power(-1.0, k - 1) * exp(-2.0 * k * k * x * x)),
                                     lambda a, b: a + b), 0.0), 1.0) END, 6) AS p_value,
  CAST(n_ref AS BIGINT) AS n_ref, CAST(n_cur AS BIGINT) AS n_cur
FROM x
"""


QUERIES = {
    "psi_three_modes": psi_three_modes,
    "drift_report": drift_report,
    "mean_shift_drift": mean_shift_drift,
    "ks_two_sample": ks_two_sample,
}

ORACLE = {
    "psi_three_modes": _psi_sql(),
    "drift_report": _drift_report_sql(),
    "mean_shift_drift": _mean_shift_sql(),
    "ks_two_sample": _KS_SQL,
}
