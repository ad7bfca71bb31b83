"""Longitudinal and wearable window queries.

Role mapping: orders per customer = visits per patient (months since 1990
from o_orderdate); events per user = wearable readings, event_type = metric
(click = tremor, view = gait, purchase = bradykinesia, error = freezing);
'signup' readings carry no measurement (they are the gaps of a series).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from clinlake.operators import panel
from clinlake.session import table

METRIC_OF = {"click": "tremor_index", "view": "gait_cadence", "purchase": "bradykinesia_score",
             "error": "freezing_episodes"}
TRAILING_WINDOW_US = 6 * 3600 * 1_000_000


def _months(c):
    return (F.year(c) - 1990) * 12 + F.month(c) - 1


def visit_number_rate_accel(spark, sf):
    o = table(spark, sf, "orders", ["o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"])
    o = o.withColumn("month", _months(F.col("o_orderdate")))
    order = ["month", "o_orderkey"]
    v = panel.visit_index(o, ["o_custkey"], order)
    r = panel.rate_and_acceleration(v, ["o_custkey"], order, "o_totalprice", "month", "price")
    return r.select("o_custkey", "o_orderkey", "visit_number", "time_idx",
                    F.round("delta_price", 6).alias("delta_price"), F.round("accel_price", 6).alias("accel_price"))


_VISIT_SQL = """
WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice,
                  (year(o_orderdate) - 1990) * 12 + month(o_orderdate) - 1 AS month FROM orders),
a AS (SELECT *, row_number() OVER w AS visit_number,
             (o_totalprice - lag(o_totalprice) OVER w) / nullif(month - lag(month) OVER w, 0) AS d
      FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY month, o_orderkey)),
b AS (SELECT *, coalesce(d, 0.0) AS delta FROM a)
SELECT o_custkey, o_orderkey, visit_number, CAST(visit_number - 1 AS INTEGER) AS time_idx,
       round(delta, 6) AS delta_price,
       round(coalesce(delta - lag(delta) OVER (PARTITION BY o_custkey ORDER BY month, o_orderkey), 0.0), 6) AS accel_price
FROM b
"""


def _series(spark, sf):
    ev = table(spark, sf, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    return ev.withColumn("x", F.when(F.col("event_type") != "signup", F.col("value")))


def ffill_limit2(spark, sf):
    s = _series(spark, sf)
    order = ["ts", "event_id"]
    f = panel.forward_fill(s, ["user_id"], order, "x", limit=2, out="x_ffill")
    u = panel.rolling_null_ok(f, ["user_id"], order, "x", 3, 2, out="x_usable")
    return u.select("event_id", "user_id", "x_ffill", "x_usable")


_FFILL_SQL = """
WITH s AS (SELECT event_id, ts, user_id, CASE WHEN event_type <> 'signup' THEN value END AS x FROM events)
SELECT event_id, user_id,
  last(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS x_ffill,
  sum(CASE WHEN x IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id
      ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) <= 2 AS x_usable
FROM s
"""


def interpolate_edges(spark, sf):
    s = _series(spark, sf)
    out = panel.interpolate_fill(s, ["user_id"], ["ts", "event_id"], "x", out="x_filled")
    return out.select("event_id", "user_id", F.round("x_filled", 6).alias("x_filled"))


_INTERP_SQL = """
WITH s AS (SELECT event_id, ts, user_id, CASE WHEN event_type <> 'signup' THEN value END AS x,
                  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
k AS (SELECT *, CASE WHEN x IS NOT NULL THEN pos END AS kp FROM s),
n AS (SELECT *,
   last(kp IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pp,
   last(CASE WHEN x IS NOT NULL THEN x END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
   first(kp IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS np,
   first(CASE WHEN x IS NOT NULL THEN x END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv
  FROM k)
SELECT event_id, user_id, round(CASE WHEN x IS NOT NULL THEN x
  WHEN pp IS NOT NULL AND np IS NOT NULL THEN coalesce(pv + (nv - pv) * (pos - pp)::DOUBLE / nullif(np - pp, 0)::DOUBLE, pv)
  WHEN pp IS NOT NULL THEN pv ELSE nv END, 6) AS x_filled
FROM n
"""


def running_drug_burden(spark, sf):
    li = table(spark, sf, "lineitem", ["l_suppkey", "l_returnflag", "l_shipdate", "l_orderkey", "l_linenumber",
                                       "l_quantity"])
    keys, order = ["l_suppkey", "l_returnflag"], ["l_shipdate", "l_orderkey", "l_linenumber"]
    out = panel.cumulative_sum(li, keys, order, "l_quantity", "drug_burden")
    return out.select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "drug_burden")


_BURDEN_SQL = """
SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag,
  sum(coalesce(l_quantity, 0.0)) OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS drug_burden
FROM lineitem
"""


def _metrics(spark, sf):
    ev = table(spark, sf, "events", ["ts", "user_id", "event_type", "value"])
    return ev


def daily_motor_summary(spark, sf):
    ev = _metrics(spark, sf)
    aggs = []
    for et in ("view", "click", "purchase"):
        name = METRIC_OF[et]
        x = F.when(F.col("event_type") == et, F.col("value"))
        aggs += [F.round(F.avg(x), 6).alias(f"avg_{name}"), F.round(F.stddev_samp(x), 6).alias(f"std_{name}")]
    return ev.groupBy("user_id", F.date_trunc("day", F.col("ts")).alias("date")).agg(*aggs)


def _daily_sql():
    cols = []
    for et in ("view", "click", "purchase"):
        n = METRIC_OF[et]
        cols += [f"round(avg(value) FILTER (WHERE event_type = '{et}'), 6) AS avg_{n}",
                 f"round(stddev_samp(value) FILTER (WHERE event_type = '{et}'), 6) AS std_{n}"]
    return f"SELECT user_id, date_trunc('day', ts) AS date, {', '.join(cols)} FROM events GROUP BY 1, 2"


def _weekly(ev):
    def avg_of(et):
        return F.avg(F.when(F.col("event_type") == et, F.col("value")))
    return ev.groupBy("user_id", F.date_trunc("week", F.col("ts")).alias("week")).agg(
        (F.lit(0.4) * (avg_of("click") - avg_of("view")) + F.lit(0.4) * avg_of("purchase")
         + F.lit(0.2) * avg_of("error")).alias("deterioration_index"))


def weekly_deterioration(spark, sf):
    w = _weekly(_metrics(spark, sf))
    return w.select("user_id", "week", F.round("deterioration_index", 6).alias("deterioration_index"))


_WEEKLY_CTE = """
w AS (SELECT user_id, date_trunc('week', ts) AS week,
             0.4 * (avg(value) FILTER (WHERE event_type = 'click') - avg(value) FILTER (WHERE event_type = 'view'))
             + 0.4 * avg(value) FILTER (WHERE event_type = 'purchase')
             + 0.2 * avg(value) FILTER (WHERE event_type = 'error') AS deterioration_index
      FROM events GROUP BY 1, 2)"""

_WEEKLY_SQL = f"WITH {_WEEKLY_CTE} SELECT user_id, week, round(deterioration_index, 6) AS deterioration_index FROM w"


def second_difference_flag(spark, sf):
    w = _weekly(_metrics(spark, sf))
    f = panel.second_difference_flag(w, ["user_id"], ["week"], "deterioration_index")
    return f.select("user_id", "week", F.round("first_diff", 6).alias("first_diff"),
                    F.round("second_diff", 6).alias("second_diff"), "acceleration_flag")


_SECOND_DIFF_SQL = f"""
WITH {_WEEKLY_CTE},
d1 AS (SELECT *, deterioration_index - lag(deterioration_index) OVER (PARTITION BY user_id ORDER BY week) AS first_diff FROM w),
d2 AS (SELECT *, first_diff - lag(first_diff) OVER (PARTITION BY user_id ORDER BY week) AS second_diff FROM d1),
st AS (SELECT user_id, avg(second_diff) AS m, stddev_pop(second_diff) AS s FROM d2 GROUP BY user_id)
SELECT user_id, week, round(first_diff, 6) AS first_diff, round(second_diff, 6) AS second_diff,
       coalesce(second_diff > m + 2.0 * s, false) AS acceleration_flag
FROM d2 JOIN st USING (user_id)
"""


def sliding_sequences(spark, sf):
    ev = table(spark, sf, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    seq = panel.sliding_sequences(ev, ["user_id"], ["ts", "event_id"], "event_type", "value", 4, 2)
    return seq.select("user_id", "start", F.array_join("items", ",").alias("sequence"), "label")


_SEQ_SQL = """
WITH s AS (SELECT user_id, row_number() OVER w AS rn,
                  list(event_type) OVER (w ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS items,
                  max(value) OVER (w ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS label
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, CAST(rn - 1 AS INTEGER) AS start, array_to_string(items, ',') AS sequence, label
FROM s WHERE (rn - 1) % 2 = 0 AND len(items) = 4
"""


def trailing_window_stats(spark, sf):
    ev = table(spark, sf, "events", ["ts", "user_id", "event_type", "value"])
    out = panel.trailing_window(ev, ["user_id", "event_type"], "ts", "value", TRAILING_WINDOW_US)
    return out.select("user_id", "event_type", "window_start", "window_end", "count",
                      F.round("mean", 6).alias("mean"), F.round("sd_pop", 4).alias("sd_pop"))


_TRAILING_SQL = f"""
WITH p AS (SELECT user_id, event_type, epoch_us(ts) AS t, count(value) AS n, sum(value) AS s, sum(value * value) AS ss
           FROM events GROUP BY 1, 2, 3),
a AS (SELECT user_id, event_type, t, sum(n) OVER w AS count, sum(s) OVER w AS sm, sum(ss) OVER w AS sq, min(t) OVER w AS f
      FROM p WINDOW w AS (PARTITION BY user_id, event_type ORDER BY t RANGE BETWEEN {TRAILING_WINDOW_US} PRECEDING AND CURRENT ROW))
SELECT user_id, event_type, make_timestamp(f) AS window_start, make_timestamp(t) AS window_end, count,
       round(sm / count, 6) AS mean, round(sqrt(greatest(sq / count - (sm / count) * (sm / count), 0.0)), 4) AS sd_pop
FROM a WHERE count >= 2
"""


def stratified_split(spark, sf):
    labels = table(spark, sf, "labels", ["doc_id", "quality"])
    return panel.stratified_folds(labels, "doc_id", ["quality"], 5, seed=42)


_SPLIT_SQL = """
SELECT doc_id, quality,
  CAST((row_number() OVER (PARTITION BY quality ORDER BY (doc_id * 2654435761 + 42) % 4294967296, doc_id) - 1) % 5 AS INTEGER) AS fold
FROM (SELECT DISTINCT ON (doc_id) doc_id, quality FROM labels)
"""


def first_visits_per_patient(spark, sf):
    o = table(spark, sf, "orders", ["o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus"])
    first = panel.first_n_per_key(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], 3)
    label = o.groupBy("o_custkey").agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey"))
                                       .alias("last_status"))
    return first.join(label, "o_custkey").select("o_custkey", "o_orderkey", "o_orderdate", "last_status")


_FIRST_SQL = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders),
l AS (SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS last_status FROM orders GROUP BY 1)
SELECT r.o_custkey, o_orderkey, o_orderdate, last_status FROM r JOIN l USING (o_custkey) WHERE rn <= 3
"""


def quantile_bin_weights(spark, sf):
    o = table(spark, sf, "orders", ["o_orderkey", "o_totalprice"])
    out = panel.quantile_bin_weights(o, "o_totalprice", 4)
    return out.select("o_orderkey", "bin", F.round("weight", 9).alias("weight"))


_QBIN_SQL = """
WITH e AS (SELECT list_distinct(list_sort([quantile_cont(o_totalprice, 0.0), quantile_cont(o_totalprice, 0.25),
              quantile_cont(o_totalprice, 0.5), quantile_cont(o_totalprice, 0.75), quantile_cont(o_totalprice, 1.0)])) AS edges
           FROM orders),
b AS (SELECT o_orderkey, greatest(len(list_filter(edges, lambda x: x < o_totalprice)) - 1, 0) AS bin FROM orders, e),
f AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
SELECT o_orderkey, CAST(bin AS INTEGER) AS bin, round(1.0 / n, 9) AS weight FROM b JOIN f USING (bin)
"""


QUERIES = {
    "visit_number_rate_accel": visit_number_rate_accel,
    "ffill_limit2": ffill_limit2,
    "interpolate_edges": interpolate_edges,
    "running_drug_burden": running_drug_burden,
    "daily_motor_summary": daily_motor_summary,
    "weekly_deterioration": weekly_deterioration,
    "second_difference_flag": second_difference_flag,
    "sliding_sequences": sliding_sequences,
    "trailing_window_stats": trailing_window_stats,
    "stratified_split": stratified_split,
    "first_visits_per_patient": first_visits_per_patient,
    "quantile_bin_weights": quantile_bin_weights,
}

ORACLE = {
    "visit_number_rate_accel": _VISIT_SQL,
    "ffill_limit2": _FFILL_SQL,
    "interpolate_edges": _INTERP_SQL,
    "running_drug_burden": _BURDEN_SQL,
    "daily_motor_summary": _daily_sql(),
    "weekly_deterioration": _WEEKLY_SQL,
    "second_difference_flag": _SECOND_DIFF_SQL,
    "sliding_sequences": _SEQ_SQL,
    "trailing_window_stats": _TRAILING_SQL,
    "stratified_split": _SPLIT_SQL,
    "first_visits_per_patient": _FIRST_SQL,
    "quantile_bin_weights": _QBIN_SQL,
}
