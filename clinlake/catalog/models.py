"""Model scoring queries on lineitem-derived features.

Features: population z-scores of quantity, discount and tax; the risk model
is a fixed linear-logistic score sigmoid(0.8 q - 0.5 d + 0.3 t) so oracle SQL
can recompute it; MLlib-fitted variants are checked on rows only.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from clinlake.operators import evaluate, grouped_fit, impute, isotonic, models
from clinlake.plans.quantile import exact_quantiles
from clinlake.session import table

COEFS = {"q": 0.8, "d": -0.5, "t": 0.3}
SCORE = models.linear_logistic(COEFS)
FEATURES = ["q", "d", "t"]


def _features(spark, sf):
    li = table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"])
    z = impute.population_zscore(li, ["l_quantity", "l_discount", "l_tax"], suffix="_z")
    return z.select("l_orderkey", "l_linenumber", F.col("l_quantity_z").alias("q"),
                    F.col("l_discount_z").alias("d"), F.col("l_tax_z").alias("t"))


_FEAT_CTE = """st AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_discount) AS md,
                   stddev_pop(l_discount) AS sd, avg(l_tax) AS mt, stddev_pop(l_tax) AS stx FROM lineitem),
f AS (SELECT l_orderkey, l_linenumber,
             coalesce((l_quantity - mq) / CASE WHEN coalesce(sq, 0) = 0 THEN 1 ELSE sq END, 0) AS q,
             coalesce((l_discount - md) / CASE WHEN coalesce(sd, 0) = 0 THEN 1 ELSE sd END, 0) AS d,
             coalesce((l_tax - mt) / CASE WHEN coalesce(stx, 0) = 0 THEN 1 ELSE stx END, 0) AS t
      FROM lineitem, st)"""


def _score_sql(q="q", d="d", t="t"):
    return f"1.0 / (1.0 + exp(-(0.0 + 0.8 * {q} + -0.5 * {d} + 0.3 * {t})))"


def weighted_fusion(spark, sf):
    li = table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"])
    probs = li.select("l_orderkey", "l_linenumber",
                      F.least(F.col("l_discount") * 10, F.lit(1.0)).alias("p_clinical"),
                      (F.nullif("l_tax", F.lit(0.0)) * 12.5).alias("p_imaging"),
                      (F.col("l_quantity") / 50.0).alias("p_wearable"))
    out = models.weighted_fusion(probs, {"clinical": "p_clinical", "imaging": "p_imaging", "wearable": "p_wearable"},
                                 {"clinical": 0.5, "imaging": 0.3, "wearable": 0.2})
    return out.select("l_orderkey", "l_linenumber", F.round("fused_probability", 6).alias("fused_probability"))


_FUSION_SQL = """
WITH p AS (SELECT l_orderkey, l_linenumber, least(l_discount * 10, 1.0) AS pc, nullif(l_tax, 0) * 12.5 AS pi,
                  l_quantity / 50.0 AS pw FROM lineitem),
s AS (SELECT *, coalesce(pc * 0.5, 0) + coalesce(pi * 0.3, 0) + coalesce(pw * 0.2, 0) AS num,
             (CASE WHEN pc IS NOT NULL THEN 0.5 ELSE 0 END) + (CASE WHEN pi IS NOT NULL THEN 0.3 ELSE 0 END)
             + (CASE WHEN pw IS NOT NULL THEN 0.2 ELSE 0 END) AS den,
             (pc IS NOT NULL)::INT + (pi IS NOT NULL)::INT + (pw IS NOT NULL)::INT AS n,
             coalesce(pc, 0) + coalesce(pi, 0) + coalesce(pw, 0) AS sm FROM p)
SELECT l_orderkey, l_linenumber,
       round(least(greatest(CASE WHEN n = 0 THEN 0.5 WHEN den = 0 THEN sm / n ELSE num / den END, 0.0), 1.0), 6) AS fused_probability
FROM s
"""

MODEL_MODALITY = {"clinical_gbm": "clinical", "imaging_cnn": "imaging", "wearable_lstm": "wearable"}


def modality_contribution(spark, sf):
    li = table(spark, sf, "lineitem", ["l_quantity", "l_discount", "l_tax"])
    long = li.select(F.explode(F.array(
        F.struct(F.lit("clinical_gbm").alias("model"), F.least(F.col("l_discount") * 10, F.lit(1.0)).alias("p")),
        F.struct(F.lit("imaging_cnn").alias("model"), (F.nullif("l_tax", F.lit(0.0)) * 12.5).alias("p")),
        F.struct(F.lit("wearable_lstm").alias("model"), (F.col("l_quantity") / 50.0).alias("p")))).alias("m")) \
        .select("m.model", "m.p")
    out = models.modality_contribution(long, "model", "p", MODEL_MODALITY)
    return out.select("modality", F.round("mean_probability", 6).alias("mean_probability"), "n_predictions")


_CONTRIB_SQL = """
WITH l AS (SELECT 'clinical' AS modality, least(l_discount * 10, 1.0) AS p FROM lineitem
           UNION ALL SELECT 'imaging', nullif(l_tax, 0) * 12.5 FROM lineitem
           UNION ALL SELECT 'wearable', l_quantity / 50.0 FROM lineitem)
SELECT modality, round(avg(p), 6) AS mean_probability, count(p) AS n_predictions FROM l GROUP BY modality
"""


def counterfactuals(spark, sf):
    f = _features(spark, sf)
    cf = models.counterfactuals(f, ["l_orderkey", "l_linenumber"], FEATURES, SCORE, 0.5, 0.01, 5)
    return cf.select("l_orderkey", "l_linenumber", "feature", "direction", F.round("risk_delta", 6).alias("risk_delta"),
                     F.col("rank").cast("int").alias("rank"))


def _cf_sql():
    cands = []
    for c in FEATURES:
        for sg, name in ((-1.0, "decrease"), (1.0, "increase")):
            args = {x: (f"({x} + {sg} * 0.5)" if x == c else x) for x in FEATURES}
            cands.append(f"SELECT l_orderkey, l_linenumber, '{c}' AS feature, '{name}' AS direction, "
                         f"{_score_sql(**args)} - {_score_sql()} AS risk_delta FROM f")
    return f"""
WITH {_FEAT_CTE},
c AS ({' UNION ALL '.join(cands)}),
k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY risk_delta, feature, direction) AS rank
      FROM c WHERE risk_delta < -0.01)
SELECT l_orderkey, l_linenumber, feature, direction, round(risk_delta, 6) AS risk_delta, CAST(rank AS INTEGER) AS rank
FROM k WHERE rank <= 5
"""


INCOMING = {"l_quantity": 1.2, "l_discount": -0.8, "l_tax": 0.6}


def intervention_scores(spark, sf):
    li = table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"])
    s = models.intervention_scores(li, ["l_quantity", "l_discount", "l_tax"], INCOMING, "l_tax", 0.0)
    return s.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in
                                                    ("original_risk", "intervened_risk", "absolute_reduction",
                                                     "relative_reduction_pct")])


_INTERVENTION_SQL = """
WITH m AS (SELECT min(l_quantity) AS a1, max(l_quantity) AS b1, min(l_discount) AS a2, max(l_discount) AS b2,
                  min(l_tax) AS a3, max(l_tax) AS b3 FROM lineitem),
n AS (SELECT l_orderkey, l_linenumber,
        least(greatest((l_quantity - a1) / CASE WHEN b1 - a1 = 0 THEN 1.0 ELSE b1 - a1 END, 0.0), 1.0) AS x1,
        least(greatest((l_discount - a2) / CASE WHEN b2 - a2 = 0 THEN 1.0 ELSE b2 - a2 END, 0.0), 1.0) AS x2,
        least(greatest((l_tax - a3) / CASE WHEN b3 - a3 = 0 THEN 1.0 ELSE b3 - a3 END, 0.0), 1.0) AS x3 FROM lineitem, m),
z AS (SELECT *, 0.0 + 1.2 * x1 + -0.8 * x2 + 0.6 * x3 AS z0 FROM n),
r AS (SELECT *, 1.0 / (1.0 + exp(-z0)) AS r0, 1.0 / (1.0 + exp(-(z0 - 0.6 * x3 + 0.0))) AS r1 FROM z)
SELECT l_orderkey, l_linenumber, round(r0, 6) AS original_risk, round(r1, 6) AS intervened_risk,
       round(greatest(r0 - r1, 0.0), 6) AS absolute_reduction,
       round(greatest(r0 - r1, 0.0) / greatest(r0, 1e-6) * 100.0, 6) AS relative_reduction_pct FROM r
"""


def what_if(spark, sf):
    f = _features(spark, sf)
    w = models.what_if(f, FEATURES, SCORE, "t", 0.3)
    return w.select("l_orderkey", "l_linenumber", F.round("risk_before", 6).alias("risk_before"),
                    F.round("risk_after", 6).alias("risk_after"), F.round("risk_change", 6).alias("risk_change"))


def _whatif_sql():
    return f"""
WITH {_FEAT_CTE}
SELECT l_orderkey, l_linenumber, round({_score_sql()}, 6) AS risk_before,
       round({_score_sql(t='(t * (1.0 - 0.3))')}, 6) AS risk_after,
       round({_score_sql(t='(t * (1.0 - 0.3))')} - {_score_sql()}, 6) AS risk_change FROM f
"""


def trajectory_curve(spark, sf):
    c = table(spark, sf, "customer", ["c_custkey", "c_nationkey", "c_acctbal"])
    p0 = (F.col("c_acctbal") + 1000.0) / 11000.0
    rate = models.impairment_rate(F.lit(20.0) + F.col("c_nationkey") / 2.4, F.lit(5.0) + F.col("c_acctbal") / 2000.0,
                                  F.lit(10.0) - F.col("c_nationkey") / 5.0)
    t = c.select("c_custkey", F.explode(models.trajectory(p0, rate)).alias("pt"))
    return t.select("c_custkey", F.col("pt.month").alias("month"), F.round("pt.risk", 6).alias("risk"),
                    F.round("pt.lower", 6).alias("lower"), F.round("pt.upper", 6).alias("upper"))


def _traj_sql():
    return """
WITH c AS (SELECT c_custkey, least(greatest((c_acctbal + 1000.0) / 11000.0, 0.01), 0.99) AS p,
       0.45 * least(greatest((30 - (20.0 + c_nationkey / 2.4)) / 30.0, 0.0), 1.0)
       + 0.3 * least(greatest((10 - (5.0 + c_acctbal / 2000.0)) / 10.0, 0.0), 1.0)
       + 0.25 * least(greatest((10 - (10.0 - c_nationkey / 5.0)) / 10.0, 0.0), 1.0) AS rate FROM customer),
m AS (SELECT c.*, mo::DOUBLE AS month FROM c, (VALUES (6), (12), (18), (24), (30), (36)) v(mo)),
t AS (SELECT c_custkey, month, p,
        least(greatest(CASE WHEN p > 0.7 THEN p + (0.95 - p) * (1 - exp(-0.09 * (month / 6.0) * (1 + rate)))
             WHEN p > 0.4 THEN p + (0.82 - p) * (1 / (1 + exp(-0.9 * (month / 6.0 - 3.0) * (0.8 + rate))))
             ELSE p + (0.58 - p) * power(month / 36.0, 1.2) * (0.4 + 0.6 * rate) END, 0.01), 0.98) AS risk,
        CASE WHEN p > 0.7 THEN 0.04 WHEN p > 0.4 THEN 0.06 ELSE 0.08 END AS band FROM m)
SELECT c_custkey, month, round(risk, 6) AS risk, round(least(greatest(risk - band, 0.0), 1.0), 6) AS lower,
       round(least(greatest(risk + band, 0.0), 1.0), 6) AS upper FROM t
"""


def time_split_counts(spark, sf):
    o = table(spark, sf, "orders", ["o_orderdate", "o_totalprice"])
    s = models.time_split(o, "o_orderdate", "1999-01-01", "2000-06-01")
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 6).alias("mean_price"),
                                  F.min("o_orderdate").alias("first_date"), F.max("o_orderdate").alias("last_date"))


_SPLIT_SQL = """
SELECT CASE WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'train' WHEN o_orderdate < TIMESTAMP '2000-06-01'
            THEN 'validation' ELSE 'test' END AS split, count(*) AS n, round(avg(o_totalprice), 6) AS mean_price,
       min(o_orderdate) AS first_date, max(o_orderdate) AS last_date FROM orders GROUP BY 1
"""

# Fixed values (ours): misclassification cost per class used as sample weight.
CLASS_COSTS = {"AUTOMOBILE": 0.8, "BUILDING": 1.0, "FURNITURE": 1.5, "HOUSEHOLD": 2.0, "MACHINERY": 3.5}


def class_weighted_counts(spark, sf):
    c = table(spark, sf, "customer", ["c_mktsegment"])
    w = models.class_weights(c, "c_mktsegment", CLASS_COSTS)
    return w.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 6).alias("total_weight"))


def _weights_sql():
    case = " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in CLASS_COSTS.items())
    return f"""SELECT c_mktsegment, count(*) AS n, round(sum(CASE c_mktsegment {case} ELSE 1.0::DOUBLE END), 6) AS total_weight
FROM customer GROUP BY c_mktsegment"""


def uncertainty_aggregation(spark, sf):
    li = table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_discount", "l_tax"])
    b = li.select("l_orderkey", "l_linenumber", F.nullif("l_discount", F.lit(0.0)).alias("u1"),
                  F.nullif("l_tax", F.lit(0.0)).alias("u2"))
    return b.select("l_orderkey", "l_linenumber", F.round(models.uncertainty_mean(["u1", "u2"]), 6).alias("uncertainty"))


_UNCERT_SQL = """
SELECT l_orderkey, l_linenumber,
  round(CASE WHEN (nullif(l_discount, 0) IS NOT NULL)::INT + (nullif(l_tax, 0) IS NOT NULL)::INT > 0 THEN
    (coalesce(nullif(l_discount, 0), 0) + coalesce(nullif(l_tax, 0), 0))
    / ((nullif(l_discount, 0) IS NOT NULL)::INT + (nullif(l_tax, 0) IS NOT NULL)::INT) END, 6) AS uncertainty
FROM lineitem
"""


def baseline_profile(spark, sf):
    li = table(spark, sf, "lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate"])
    num = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    long = li.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v"))
                                         for c in num] +
                                       [F.struct(F.lit("l_returnflag").alias("feature"),
                                                 F.length("l_returnflag").cast("double").alias("v"))])).alias("x")) \
        .select("x.feature", "x.v")
    med = exact_quantiles(long, ["feature"], "v", [0.5], ["median"])
    return med.select("feature", F.round("median", 6).alias("median"))


_BASELINE_SQL = " UNION ALL ".join(
    [f"SELECT '{c}' AS feature, round(quantile_cont({c}, 0.5), 6) AS median FROM lineitem"
     for c in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]] +
    ["SELECT 'l_returnflag', round(quantile_cont(length(l_returnflag)::DOUBLE, 0.5), 6) FROM lineitem"])


def stacking_oof(spark, sf):
    """Out-of-fold stack over all dimensions, five folds, isotonic last step (MLlib fits:
    rows only; one row per scored id)."""
    e = table(spark, sf, "embeddings", ["vec_id", "embedding", "label"])
    size = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    df = e.select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(size)],
                  (F.col("label") >= 5).cast("int").alias("y"))
    out = models.stacking_oof(df, "vec_id", [f"e{i}" for i in range(size)], "y", k=5).withColumn("whole", F.lit(0))
    return isotonic.isotonic_by_group(out, "whole", "p_stack", "label", "p_calibrated").drop("whole")


def multiclass_classifier(spark, sf):
    """Class-weighted softmax regression and forest over all dimensions, averaged; fitted on
    four fifths of the rows.  What must hold for it: one row per vector, probabilities
    that sum to 1, a known class, and a macro one-vs-rest AUC on the other fifth."""
    e = table(spark, sf, "embeddings", ["vec_id", "embedding", "label"]).withColumn(
        "held_out", models.fold_column("vec_id", 5) == 0)
    scored, _ = models.multiclass_classifier(e, "embedding", "label", ~F.col("held_out"))
    scored = scored.checkpoint()
    auc = evaluate.macro_auc_ovr(scored.filter("held_out"), "label", "probability", "classes")
    total = F.abs(F.aggregate("probability", F.lit(0.0), lambda a, v: a + v) - 1)
    return scored.agg(F.count(F.lit(1)).alias("n"), (F.max(total) < 1e-9).alias("sums_to_one"),
                      F.bool_and(F.array_contains("classes", F.col("predicted"))).alias("known_class")).crossJoin(
        F.broadcast(auc.select(F.col("macro_auc").between(0, 1).alias("has_auc"))))  # one row


_MULTICLASS_SQL = "SELECT count(*) AS n, true AS sums_to_one, true AS known_class, true AS has_auc FROM embeddings"


def feature_importance(spark, sf):
    """Normalised importance of every dimension, averaged over the two models, ranked;
    the importances sum to 1 (MLlib fits: rows only)."""
    e = table(spark, sf, "embeddings", ["vec_id", "embedding", "label"])
    _, importance = models.multiclass_classifier(e, "embedding", "label", F.lit(True))
    return importance


def macro_auc(spark, sf):
    """Macro one-vs-rest AUC of the market segment from three fixed scores."""
    return evaluate.macro_auc_ovr(_segment_scores(spark, sf), "c_mktsegment", "probability", "classes").select(
        "classes", F.round("macro_auc", 6).alias("macro_auc"))


def _segment_scores(spark, sf):
    c = table(spark, sf, "customer", ["c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey"])
    names = sorted(r[0] for r in c.select("c_mktsegment").distinct().collect())  # one row a class
    x = [F.exp(-F.abs(F.col("c_acctbal") / 2000.0 - i) + F.col("c_nationkey") * i / 50.0) for i in range(len(names))]
    total = sum(x[1:], x[0])
    return c.select("c_custkey", "c_mktsegment", F.array(*[v / total for v in x]).alias("probability"),
                    F.array(*map(F.lit, names)).alias("classes"))


_MACRO_AUC_SQL = """
WITH k AS (SELECT seg, row_number() OVER (ORDER BY seg) - 1 AS i FROM (SELECT DISTINCT c_mktsegment AS seg FROM customer)),
x AS (SELECT c_custkey, c_mktsegment, k.seg, exp(-abs(c_acctbal / 2000.0 - i) + c_nationkey * i / 50.0) AS v FROM customer, k),
p AS (SELECT *, v / sum(v) OVER (PARTITION BY c_custkey) AS p FROM x),
c AS (SELECT seg, round(p, 12) AS p, count(*) FILTER (WHERE c_mktsegment = seg) AS pos, count(*) FILTER (WHERE c_mktsegment <> seg) AS neg FROM p GROUP BY ALL),
u AS (SELECT seg, pos, sum(neg) OVER (PARTITION BY seg ORDER BY p) - neg / 2.0 AS below FROM c),
t AS (SELECT seg, sum(pos) AS np, sum(neg) AS nn FROM c GROUP BY seg),
a AS (SELECT u.seg, sum(pos * below) / max(np * nn) AS auc FROM u JOIN t ON t.seg = u.seg GROUP BY u.seg)
SELECT count(*) AS classes, round(avg(auc), 6) AS macro_auc FROM a
"""


def _halves(spark, sf):
    """Labelled documents; every second one (by CRC of its id) fits."""
    docs = table(spark, sf, "documents", ["doc_id", "n_chars"])
    labels = table(spark, sf, "labels", ["doc_id", "quality"])
    return docs.join(labels, "doc_id").withColumn("p", F.col("n_chars") / (F.col("n_chars") + 2000.0)).withColumn(
        "fits", F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 4), 16, 10).cast("int") % 2 == 0)


def platt_calibration(spark, sf):
    """Sigmoid of the score, fitted on one half of the labelled rows and applied to the other."""
    s = _halves(spark, sf).withColumn("whole", F.lit(0))
    fit = grouped_fit.grouped_logistic(s.filter("fits"), "whole", ["p"], "quality")
    out = grouped_fit.grouped_scores(s.filter(~F.col("fits")), fit, "whole", ["p"], "p_calibrated")
    return out.select("doc_id", F.round("p", 9).alias("p"), F.round("p_calibrated", 6).alias("p_calibrated"))


def _platt_sql(steps=12):
    ctes = ["""s AS (SELECT d.doc_id, n_chars / (n_chars + 2000.0) AS p, quality AS y,
    CAST('0x' || substr(md5(CAST(d.doc_id AS VARCHAR)), 1, 4) AS BIGINT) % 2 = 0 AS fits FROM documents d JOIN labels l ON l.doc_id = d.doc_id)""",
            "st AS (SELECT avg(p) AS m, coalesce(nullif(stddev_pop(p), 0), 1) AS sd FROM s WHERE fits)",
            "z AS MATERIALIZED (SELECT (p - m) / sd AS x, y FROM s, st WHERE fits)", "t0 AS (SELECT 1 AS one, 0.0 AS x_0, 0.0 AS x_1)"]
    r = repr(grouped_fit.RIDGE)
    for t in range(1, steps + 1):
        ctes.append(f"""n{t} AS MATERIALIZED (SELECT 1 AS one, sum(w) AS a_0_0, sum(w * x) AS a_0_1, sum(w * x * x) + {r} AS a_1_1,
    sum(y - e) AS b_0, sum((y - e) * x) - {r} * any_value(x_1) AS b_1 FROM (SELECT *, e * (1 - e) AS w FROM (
    SELECT z.*, x_1, 1 / (1 + exp(-(x_0 + x_1 * x))) AS e FROM z, t{t - 1})))""")
        ctes += _solve_ctes(f"s{t}", f"n{t}", "one", 2)
        ctes.append(f"t{t} AS MATERIALIZED (SELECT 1 AS one, o.x_0 + s.x_0 AS x_0, o.x_1 + s.x_1 AS x_1 FROM s{t} s, t{t - 1} o)")
    return f"""WITH {', '.join(ctes)}
SELECT doc_id, round(p, 9) AS p, round(1 / (1 + exp(-(x_0 + x_1 * (p - m) / sd))), 6) AS p_calibrated FROM s, st, t{steps} WHERE NOT fits"""


def _labelled(spark, sf):
    docs = table(spark, sf, "documents", ["doc_id", "lang", "n_chars"])
    labels = table(spark, sf, "labels", ["doc_id", "quality"])
    return docs.join(labels, "doc_id").withColumn("p", F.col("n_chars") / (F.col("n_chars") + 2000.0))


def isotonic_by_group(spark, sf):
    """Exact isotonic fit of the quality label on a length score, per language."""
    fitted = isotonic.isotonic_by_group(_labelled(spark, sf), "lang", "p", "quality")
    return fitted.select("doc_id", "lang", F.round("p", 9).alias("p"), F.round("p_isotonic", 9).alias("p_isotonic"))


def group_thresholds(spark, sf):
    """Decision threshold of every language: Youden and rate-matched cut averaged."""
    limits, _ = isotonic.group_thresholds(_labelled(spark, sf), "lang", "p", "quality")
    return limits.select("lang", "n", "threshold", "sensitivity", "specificity", F.round("global_threshold", 6).alias("global_threshold"))


def fair_predictions(spark, sf):
    """Calibrated scores against the threshold of the language (the global one where it has none)."""
    out = isotonic.fair_predictions(_labelled(spark, sf), "lang", "p", "quality")
    return out.select("doc_id", "lang", F.round("p_isotonic", 9).alias("p_isotonic"), F.round("threshold", 6).alias("threshold"),
                      "prediction")


#: Min-max formula of the isotonic fit: the largest, over all beginnings, of the least mean up to any later end.
_ISO_CTE = """
s AS (SELECT d.doc_id, lang, n_chars / (n_chars + 2000.0) AS p, quality AS y FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
c AS (SELECT lang, p, count(*) AS n, sum(y) AS pos, row_number() OVER (PARTITION BY lang ORDER BY p) AS i FROM s GROUP BY lang, p),
cum AS (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp FROM c WINDOW w AS (PARTITION BY lang ORDER BY i)),
av AS (SELECT a.lang, a.i AS a, b.i AS b, (b.cp - a.cp + a.pos) / (b.cn - a.cn + a.n) AS m FROM cum a JOIN cum b ON a.lang = b.lang AND a.i <= b.i),
mn AS (SELECT lang, a, b AS i, min(m) OVER (PARTITION BY lang, a ORDER BY b DESC) AS m FROM av),
iso AS (SELECT lang, i, max(m) AS fit FROM mn GROUP BY lang, i),
f AS (SELECT s.doc_id, s.lang, s.p, s.y, fit FROM s JOIN c ON c.lang = s.lang AND c.p = s.p JOIN iso ON iso.lang = c.lang AND iso.i = c.i)"""

_ISO_SQL = f"WITH {_ISO_CTE}\nSELECT doc_id, lang, round(p, 9) AS p, round(fit, 9) AS p_isotonic FROM f"

_LIMITS_CTE = f"""{_ISO_CTE},
z AS (SELECT lang, count(*) AS n, sum(y) AS pos, greatest(1, least(CAST(floor((SELECT avg(y) FROM s) * count(*)) AS BIGINT), count(*) - 1)) AS cut
    FROM s GROUP BY lang),
lev AS (SELECT lang, fit, row_number() OVER (PARTITION BY lang ORDER BY fit DESC) - 1 AS k FROM f),
roc AS (SELECT lang, p, sum(pos) OVER w AS tp, sum(n - pos) OVER w AS fp FROM c WINDOW w AS (PARTITION BY lang ORDER BY p DESC)),
j AS (SELECT roc.lang, p, tp / greatest(z.pos, 1) AS tpr, fp / greatest(z.n - z.pos, 1) AS fpr FROM roc JOIN z ON z.lang = roc.lang),
best AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY tpr - fpr DESC, p DESC) AS r FROM j),
lim AS (SELECT z.lang, n, CASE WHEN pos IN (0, n) THEN 0.5 ELSE round(0.5 * p + 0.5 * fit, 4) END AS threshold,
    CASE WHEN pos IN (0, n) THEN 0.0 ELSE round(tpr, 4) END AS sensitivity,
    CASE WHEN pos IN (0, n) THEN 1.0 ELSE round(1 - fpr, 4) END AS specificity, pos IN (0, n) AS one
    FROM z JOIN lev ON lev.lang = z.lang AND k = cut JOIN best ON best.lang = z.lang AND r = 1 WHERE n >= {isotonic.MIN_GROUP})"""

_LIMITS_SQL = f"""WITH {_LIMITS_CTE}
SELECT lang, n, threshold, sensitivity, specificity, round((SELECT avg(threshold) FROM lim), 6) AS global_threshold FROM lim"""

_FAIR_SQL = f"""WITH {_LIMITS_CTE},
q AS (SELECT doc_id, f.lang, CASE WHEN lim.lang IS NULL OR one THEN p ELSE fit END AS x, fit, p, one, lim.lang AS own,
    coalesce(threshold, (SELECT avg(threshold) FROM lim)) AS t FROM f LEFT JOIN lim ON lim.lang = f.lang)
SELECT doc_id, lang, round(x, 9) AS p_isotonic, round(t, 6) AS threshold, CAST(x >= t AS INTEGER) AS prediction FROM q"""


N_BOOT = 50


def bootstrap_effect_intervals(spark, sf):
    """10/90 and 2.5/97.5 % limits of the effect over 50 bootstraps, all in one pass."""
    li = table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount", "l_tax"])
    reps = grouped_fit.bootstrap_effects(li, "l_extendedprice", "l_quantity", ["l_discount", "l_tax"],
                                         ["l_orderkey", "l_linenumber"], replicas=N_BOOT)
    q = exact_quantiles(reps, [], "effect", [0.025, 0.1, 0.9, 0.975], ["p025", "p10", "p90", "p975"])
    return q.select(*[F.round(c, 4).alias(c) for c in q.columns])


def _solve_ctes(name, source, keys, size):
    """CTEs that solve a_i_j x = b_i of every row of ``source`` by elimination; ``name``: keys, x_0, x_1, ..."""
    cols = [[f"a_{min(i, j)}_{max(i, j)}" for j in range(size)] + [f"b_{i}"] for i in range(size)]
    ctes = [f"{name}_0 AS MATERIALIZED (SELECT {keys}, " + ", ".join(
        f"{cols[i][j]} AS m_{i}_{j}" for i in range(size) for j in range(size + 1)) + f" FROM {source})"]
    for k in range(size):
        row = ", ".join(f"m_{k}_{j} / m_{k}_{k} AS m_{k}_{j}" for j in range(size + 1))
        rest = ", ".join(f"m_{i}_{j} - m_{i}_{k} * m_{k}_{j} / m_{k}_{k} AS m_{i}_{j}" for i in range(size) if i != k for j in range(size + 1))
        ctes.append(f"{name}_{k + 1} AS MATERIALIZED (SELECT {keys}, {row}, {rest} FROM {name}_{k})")
    ctes.append(f"{name} AS MATERIALIZED (SELECT {keys}, " + ", ".join(f"m_{i}_{size} AS x_{i}" for i in range(size)) + f" FROM {name}_{size})")
    return ctes


def _boot_sql():
    upto, term, steps = 0.0, math.exp(-1.0), []
    for k in range(18):
        upto += term
        steps.append(f"WHEN u < {upto!r} THEN {k}")
        term /= k + 1
    x = ["1", "t", "c1", "c2"]
    a = ", ".join(f"sum(w * {x[i]} * {x[j]}) AS a_{i}_{j}" for i in range(4) for j in range(i, 4))
    b = ", ".join(f"sum(w * y * {x[i]}) AS b_{i}" for i in range(4))
    return f"""WITH m AS (SELECT avg(l_extendedprice) AS my, avg(l_quantity) AS mt, avg(l_discount) AS m1, avg(l_tax) AS m2 FROM lineitem),
r AS (SELECT l_extendedprice - my AS y, l_quantity - mt AS t, l_discount - m1 AS c1, l_tax - m2 AS c2,
    l_orderkey || '|' || l_linenumber AS k FROM lineitem, m),
e AS (SELECT r.*, i, md5(k || '|7|' || i // 8) AS h FROM r, range({N_BOOT}) g(i)),
u AS (SELECT *, (CAST('0x' || substr(h, 1 + 4 * (i % 8), 4) AS BIGINT) + 0.5) / 65536.0 AS u FROM e),
w AS (SELECT *, CAST(CASE {' '.join(steps)} ELSE 18 END AS DOUBLE) AS w FROM u),
n AS MATERIALIZED (SELECT i, {a}, {b} FROM w GROUP BY i),
{', '.join(_solve_ctes('s', 'n', 'i', 4))}
SELECT {', '.join(f"round(quantile_cont(x_1, {p}), 4) AS {c}" for p, c in ((0.025, 'p025'), (0.1, 'p10'), (0.9, 'p90'), (0.975, 'p975')))} FROM s"""


def local_surrogate_attribution(spark, sf):
    c = table(spark, sf, "customer", ["c_custkey", "c_acctbal", "c_nationkey"])
    f = c.select("c_custkey", (F.col("c_acctbal") / 5000.0).alias("a"), (F.col("c_nationkey") / 12.0).alias("n"))
    score = models.linear_logistic({"a": 0.9, "n": -0.4})
    return models.local_surrogate(f, "c_custkey", ["a", "n"], score, n_perturb=200)


def rule_labels(spark, sf):
    """Disease label of every customer by the linear rule scores (without noise)."""
    c = table(spark, sf, "customer", ["c_custkey", "c_nationkey", "c_acctbal"])
    f = c.select("c_custkey", (30.0 + F.col("c_nationkey") * 2.5).alias("Age"),
                 F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") / 400.0).alias("MMSE"),
                 (F.col("c_custkey") % 11).cast("double").alias("FunctionalAssessment"),
                 (F.col("c_custkey") % 7).cast("double").alias("SleepQuality"),
                 (F.col("c_custkey") % 13 / 1.2).alias("PhysicalActivity"),
                 (F.col("c_nationkey") % 2).cast("double").alias("MemoryComplaints"),
                 (F.col("c_custkey") % 5 == 0).cast("double").alias("Depression"))
    return models.rule_labels(f).select("c_custkey", F.round("rule_score", 6).alias("rule_score"), "rule_label")


def _rules_sql():
    given = {"Age": "30.0 + c_nationkey * 2.5", "MMSE": "CASE WHEN c_acctbal > 0 THEN c_acctbal / 400.0 END",
             "FunctionalAssessment": "(c_custkey % 11)::DOUBLE", "SleepQuality": "(c_custkey % 7)::DOUBLE",
             "PhysicalActivity": "(c_custkey % 13) / 1.2", "MemoryComplaints": "(c_nationkey % 2)::DOUBLE",
             "Depression": "CASE WHEN c_custkey % 5 = 0 THEN 1.0 ELSE 0.0 END"}
    columns = ", ".join(f"coalesce({given.get(f, 'NULL')}, {d}) AS {f}" for f, d in models.RULE_DEFAULTS.items())
    kinds = {"above": "greatest({f} - {b}, 0) / {s}.0", "below": "greatest({b} - {f}, 0) / {s}.0", "flag": "{f}"}
    scores = " UNION ALL ".join(
        f"SELECT c_custkey, {i} AS place, '{d.replace(chr(39), chr(39) * 2)}' AS disease, "
        + " + ".join(f"{kinds[k].format(f=f, b=b, s=sp)} * {w}" for f, k, b, sp, w in terms) + " AS score FROM f"
        for i, (d, terms) in enumerate(models.RULE_SCORES.items()))
    return f"""WITH f AS (SELECT c_custkey, {columns} FROM customer), s AS ({scores}),
r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY score DESC, place) AS k FROM s)
SELECT c_custkey, round(score, 6) AS rule_score, disease AS rule_label FROM r WHERE k = 1"""


def forecast_validation(spark, sf):
    """C-statistic, rates at the cut and CRPS approximation of a price forecast."""
    o = table(spark, sf, "orders", ["o_orderkey", "o_totalprice"])
    li = table(spark, sf, "lineitem", ["l_orderkey", "l_extendedprice"])
    f = li.groupBy("l_orderkey").agg((F.sum("l_extendedprice") / 3000.0).alias("m"))
    v = evaluate.forecast_validation(o.join(f, F.col("o_orderkey") == F.col("l_orderkey")).withColumn(
        "y", F.col("o_totalprice") / 3000.0), "y", "m", 60.0)
    return v.select("n", *[F.round(c, 6).alias(c) for c in ("sensitivity", "specificity", "ppv", "npv", "c_statistic", "crps_approx")])


_FORECAST_CHECK_SQL = """
WITH r AS (SELECT o_totalprice / 3000.0 AS y, m FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice) / 3000.0 AS m FROM lineitem GROUP BY 1)
    ON l_orderkey = o_orderkey),
c AS (SELECT m, count(*) FILTER (WHERE y > 60) AS pos, count(*) FILTER (WHERE NOT y > 60) AS neg FROM r GROUP BY m),
u AS (SELECT pos, neg, sum(neg) OVER (ORDER BY m) - neg / 2.0 AS below FROM c),
a AS (SELECT CASE WHEN sum(pos) = 0 OR sum(neg) = 0 THEN 0.5 ELSE sum(pos * below) / (sum(pos) * sum(neg)) END AS auc FROM u),
k AS (SELECT count(*) AS n, count(*) FILTER (WHERE m > 60 AND y > 60) AS tp, count(*) FILTER (WHERE m > 60 AND NOT y > 60) AS fp,
    count(*) FILTER (WHERE NOT m > 60 AND y > 60) AS fn, count(*) FILTER (WHERE NOT m > 60 AND NOT y > 60) AS tn, greatest(stddev_pop(m), 1e-6) AS sd FROM r),
z AS (SELECT abs(y - m) / sd / sqrt(2.0) AS z FROM r, k),
t AS (SELECT z, 1 / (1 + 0.3275911 * z) AS t FROM z),
e AS (SELECT avg(0.5 - 0.5 * t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-z * z)) AS crps FROM t)
SELECT n, round(tp / greatest(tp + fn, 1), 6) AS sensitivity, round(1 - fp / greatest(fp + tn, 1), 6) AS specificity,
  round(tp / greatest(tp + fp, 1), 6) AS ppv, round(tn / greatest(tn + fn, 1), 6) AS npv, round(auc, 6) AS c_statistic, round(crps, 6) AS crps_approx
FROM k, a, e
"""


def train_apply_scaling(spark, sf):
    """Scaling and median fill learnt on the orders before 2000, applied to all orders."""
    o = table(spark, sf, "orders", ["o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus"]).withColumn(
        "price", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")))
    fitted = impute.fit_scaling(o.filter(F.col("o_orderdate") < "2000-01-01"), ["price"])
    return impute.apply_scaling(o, fitted, ["price"]).select("o_orderkey", F.round("price_scaled", 6).alias("price_scaled"))


_SCALING_SQL = """
WITH o AS (SELECT o_orderkey, o_orderdate, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price FROM orders),
f AS (SELECT avg(price) AS m, CASE WHEN coalesce(stddev_pop(price), 0) > 0 THEN stddev_pop(price) ELSE 1 END AS sd, quantile_cont(price, 0.5) AS md
    FROM o WHERE o_orderdate < TIMESTAMP '2000-01-01')
SELECT o_orderkey, round((coalesce(price, md) - m) / sd, 6) AS price_scaled FROM o, f
"""


def sequence_lengths(spark, sf):
    """Encoder / prediction lengths from the data: the fewest visits any patient
    has (one grouped count, one global min), split into encoder and horizon."""
    o = table(spark, sf, "orders", ["o_custkey"])
    per = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    m = per.agg(F.min("n").alias("min_points"), F.max("n").alias("max_points"),
                F.count(F.lit(1)).alias("patients"))
    return m.select("patients", "min_points", "max_points",
                    F.greatest(F.lit(1), F.floor(F.col("min_points") * 2 / 3)).cast("long").alias("encoder_length"),
                    F.greatest(F.lit(1), F.col("min_points") - F.floor(F.col("min_points") * 2 / 3)).cast("long")
                    .alias("prediction_length"))


_SEQ_LEN_SQL = """
WITH p AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1),
m AS (SELECT min(n) AS min_points, max(n) AS max_points, count(*) AS patients FROM p)
SELECT patients, min_points, max_points, CAST(greatest(1, floor(min_points * 2 / 3)) AS BIGINT) AS encoder_length,
       CAST(greatest(1, min_points - floor(min_points * 2 / 3)) AS BIGINT) AS prediction_length FROM m
"""


def ensemble_disagreement(spark, sf):
    """Variance (ddof 0) of the available base-model probabilities per row."""
    li = table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"])
    probs = F.array_compact(F.array(F.least(F.col("l_discount") * 10, F.lit(1.0)),
                                    F.nullif("l_tax", F.lit(0.0)) * 12.5, F.col("l_quantity") / 50.0))
    return li.select("l_orderkey", "l_linenumber",
                     F.round(models.array_variance(probs), 9).alias("disagreement"))


_DISAGREE_SQL = """
WITH p AS (SELECT l_orderkey, l_linenumber,
                  list_filter([least(l_discount * 10, 1.0), nullif(l_tax, 0) * 12.5, l_quantity / 50.0], lambda x: x IS NOT NULL) AS a
           FROM lineitem)
SELECT l_orderkey, l_linenumber,
       round(list_sum(list_transform(a, lambda x: (x - list_avg(a)) * (x - list_avg(a)))) / len(a), 9) AS disagreement FROM p
"""


def correlation_matrix(spark, sf):
    """Pearson correlation matrix of the lineitem measures with MLlib
    ``Correlation`` (one distributed pass; the F x F result is small), as
    (feature_i, feature_j, r) rows for the conditional-independence step."""
    li = table(spark, sf, "lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return models.correlation_long(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


def _corr_sql():
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    parts = [f"SELECT '{a}' AS feature_i, '{b}' AS feature_j, round(corr({a}, {b}), 6) AS r FROM lineitem"
             for a in cols for b in cols]
    return " UNION ALL ".join(parts)


def granger_event_series(spark, sf):
    """Pairwise Granger tests (max lag 2) between the daily mean values of the
    event types, ordered by day."""
    from clinlake.operators import causal
    ev = table(spark, sf, "events", ["ts", "event_type", "value"])
    types = ["click", "view", "purchase", "signup", "error"]
    daily = ev.groupBy(F.to_date("ts").alias("day")).pivot("event_type", types).agg(F.avg("value"))
    return causal.granger_pairs(daily.dropna(), ["day"], types, maxlag=2)


def pc_skeleton_orders(spark, sf):
    """PC skeleton (Fisher z, alpha 0.05) over per-order measures: line count,
    total quantity, total extended price, mean discount and the order price."""
    from clinlake.operators import causal
    li = table(spark, sf, "lineitem", ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount"])
    per = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).cast("double").alias("n_lines"),
                                       F.sum("l_quantity").alias("sum_qty"), F.sum("l_extendedprice").alias("sum_price"),
                                       F.avg("l_discount").alias("mean_discount"))
    o = table(spark, sf, "orders", ["o_orderkey", "o_totalprice"])
    d = per.join(o, per.l_orderkey == o.o_orderkey)
    return causal.pc_edges(d, ["n_lines", "sum_qty", "sum_price", "mean_discount", "o_totalprice"])


def per_segment_models(spark, sf):
    """One logistic model per market segment predicting a high balance from
    the order history of the customer (orders, mean price, late-status share)."""
    c = table(spark, sf, "customer", ["c_custkey", "c_mktsegment", "c_acctbal"])
    o = table(spark, sf, "orders", ["o_custkey", "o_totalprice", "o_orderstatus"])
    hist = o.groupBy("o_custkey").agg(F.count(F.lit(1)).cast("double").alias("n_orders"),
                                      F.avg("o_totalprice").alias("mean_price"),
                                      F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("share_f"))
    d = c.join(hist, c.c_custkey == hist.o_custkey).select(
        "c_custkey", "c_mktsegment", "n_orders", "mean_price", "share_f",
        (F.col("c_acctbal") > 5000).cast("int").alias("high_balance"))
    features = ["n_orders", "mean_price", "share_f"]
    fits = grouped_fit.grouped_logistic(d, "c_mktsegment", features, "high_balance")
    m = grouped_fit.grouped_scores(d, fits, "c_mktsegment", features, "p_group_model").filter("p_group_model is not null")
    return m.select("c_custkey", "c_mktsegment", "high_balance", F.round("p_group_model", 6).alias("p_group_model"))


def _segments_sql(steps=9):
    """Newton's steps written out."""
    x = ["1", "x1", "x2", "x3"]
    ctes = ["""h AS (SELECT o_custkey, count(*)::DOUBLE AS n_orders, avg(o_totalprice) AS mean_price,
    avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS share_f FROM orders GROUP BY 1)""", """
d AS (SELECT c_custkey, c_mktsegment AS g, n_orders, mean_price, share_f, CAST(c_acctbal > 5000 AS INTEGER) AS y FROM customer
    JOIN h ON o_custkey = c_custkey)""", """
st AS (SELECT g, avg(n_orders) AS m1, avg(mean_price) AS m2, avg(share_f) AS m3, coalesce(nullif(stddev_pop(n_orders), 0), 1) AS s1,
    coalesce(nullif(stddev_pop(mean_price), 0), 1) AS s2, coalesce(nullif(stddev_pop(share_f), 0), 1) AS s3 FROM d GROUP BY g
    HAVING count(*) >= 10 AND min(y) < max(y))""", """
z AS MATERIALIZED (SELECT c_custkey, d.g, y, (n_orders - m1) / s1 AS x1, (mean_price - m2) / s2 AS x2, (share_f - m3) / s3 AS x3
    FROM d JOIN st ON st.g = d.g)""", "t0 AS (SELECT g, 0.0 AS x_0, 0.0 AS x_1, 0.0 AS x_2, 0.0 AS x_3 FROM st)"]
    for t in range(1, steps + 1):
        a = ", ".join(f"sum(w * {x[i]} * {x[j]}){f' + {grouped_fit.RIDGE!r}' if i == j and i else ''} AS a_{i}_{j}"
                      for i in range(4) for j in range(i, 4))
        b = ", ".join(f"sum((y - p) * {x[i]}){f' - {grouped_fit.RIDGE!r} * any_value(x_{i})' if i else ''} AS b_{i}" for i in range(4))
        ctes.append(f"p{t} AS (SELECT z.*, t.x_0, t.x_1, t.x_2, t.x_3, 1 / (1 + exp(-(x_0 + x_1 * x1 + x_2 * x2 + x_3 * x3))) AS p "
                    f"FROM z JOIN t{t - 1} t ON t.g = z.g)")
        ctes.append(f"n{t} AS MATERIALIZED (SELECT g, {a}, {b} FROM (SELECT *, p * (1 - p) AS w FROM p{t}) GROUP BY g)")
        ctes += _solve_ctes(f"s{t}", f"n{t}", "g", 4)
        ctes.append(f"t{t} AS MATERIALIZED (SELECT s.g, " + ", ".join(f"o.x_{i} + s.x_{i} AS x_{i}" for i in range(4))
                    + f" FROM s{t} s JOIN t{t - 1} o ON o.g = s.g)")
    return f"""WITH {', '.join(ctes)}
SELECT c_custkey, z.g AS c_mktsegment, y AS high_balance, round(1 / (1 + exp(-(x_0 + x_1 * x1 + x_2 * x2 + x_3 * x3))), 6) AS p_group_model
FROM z JOIN t{steps} t ON t.g = z.g"""


QUERIES = {
    "per_segment_models": per_segment_models,
    "granger_event_series": granger_event_series,
    "pc_skeleton_orders": pc_skeleton_orders,
    "sequence_lengths": sequence_lengths,
    "ensemble_disagreement": ensemble_disagreement,
    "correlation_matrix": correlation_matrix,
    "weighted_fusion": weighted_fusion,
    "modality_contribution": modality_contribution,
    "counterfactuals": counterfactuals,
    "intervention_scores": intervention_scores,
    "what_if": what_if,
    "trajectory_curve": trajectory_curve,
    "time_split_counts": time_split_counts,
    "class_weighted_counts": class_weighted_counts,
    "uncertainty_aggregation": uncertainty_aggregation,
    "baseline_profile": baseline_profile,
    "stacking_oof": stacking_oof,
    "platt_calibration": platt_calibration,
    "multiclass_classifier": multiclass_classifier,
    "feature_importance": feature_importance,
    "macro_auc": macro_auc,
    "rule_labels": rule_labels,
    "forecast_validation": forecast_validation,
    "train_apply_scaling": train_apply_scaling,
    "isotonic_by_group": isotonic_by_group,
    "group_thresholds": group_thresholds,
    "fair_predictions": fair_predictions,
    "bootstrap_effect_intervals": bootstrap_effect_intervals,
    "local_surrogate_attribution": local_surrogate_attribution,
}

ORACLE = {
    "sequence_lengths": _SEQ_LEN_SQL,
    "ensemble_disagreement": _DISAGREE_SQL,
    "correlation_matrix": _corr_sql(),
    "weighted_fusion": _FUSION_SQL,
    "modality_contribution": _CONTRIB_SQL,
    "counterfactuals": _cf_sql(),
    "intervention_scores": _INTERVENTION_SQL,
    "what_if": _whatif_sql(),
    "trajectory_curve": _traj_sql(),
    "time_split_counts": _SPLIT_SQL,
    "class_weighted_counts": _weights_sql(),
    "uncertainty_aggregation": _UNCERT_SQL,
    "baseline_profile": _BASELINE_SQL,
    "isotonic_by_group": _ISO_SQL,
    "platt_calibration": _platt_sql(),
    "multiclass_classifier": _MULTICLASS_SQL,
    "macro_auc": _MACRO_AUC_SQL,
    "rule_labels": _rules_sql(),
    "forecast_validation": _FORECAST_CHECK_SQL,
    "train_apply_scaling": _SCALING_SQL,
    "group_thresholds": _LIMITS_SQL,
    "fair_predictions": _FAIR_SQL,
    "bootstrap_effect_intervals": _boot_sql(),
    "per_segment_models": _segments_sql(),
}
