"""Evaluation, fairness and gate queries.

Score table: labelled documents, y = labels.quality, p = n / (n + 2000) of the
document length (a deterministic score), protected attributes lang and source.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from clinlake.operators import evaluate
from clinlake.session import table


def _scores(spark, sf):
    docs = table(spark, sf, "documents", ["doc_id", "lang", "source", "n_chars"])
    labels = table(spark, sf, "labels", ["doc_id", "quality", "toxic"])
    j = docs.join(labels, "doc_id", "inner")
    return j.withColumn("p", F.col("n_chars") / (F.col("n_chars") + F.lit(2000.0))).withColumnRenamed("quality", "y")


_SCORES_CTE = """s AS (SELECT d.doc_id, lang, source, n_chars, quality AS y, toxic, n_chars / (n_chars + 2000.0) AS p
       FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def _r(c, k=6):
    return F.round(c, k).alias(c if isinstance(c, str) else None)


def roc_auc_by_group(spark, sf):
    s = _scores(spark, sf)
    per = evaluate.roc_auc(s, ["lang"], "y", "p")
    allg = evaluate.roc_auc(s.withColumn("lang", F.lit("ALL")), ["lang"], "y", "p")
    return per.unionByName(allg).select("lang", F.round("auc", 6).alias("auc"), "n_pos", "n_neg")


_AUC_SQL = f"""
WITH {_SCORES_CTE},
g AS (SELECT lang, y, p FROM s UNION ALL SELECT 'ALL', y, p FROM s),
c AS (SELECT lang, p, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM g GROUP BY 1, 2),
k AS (SELECT *, sum(neg) OVER (PARTITION BY lang ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS neg_le FROM c),
a AS (SELECT lang, sum(pos * (neg_le - neg + neg * 0.5)) AS u, sum(pos) AS n_pos, sum(neg) AS n_neg FROM k GROUP BY lang)
SELECT lang, round(CASE WHEN n_pos = 0 OR n_neg = 0 THEN 0.5 ELSE u / (n_pos * n_neg) END, 6) AS auc,
       CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg FROM a
"""


def youden_threshold(spark, sf):
    y = evaluate.youden(_scores(spark, sf), [], "y", "p")
    return y.select(F.round("threshold", 9).alias("threshold"), F.round("tpr", 6).alias("tpr"),
                    F.round("fpr", 6).alias("fpr"), F.round("j", 6).alias("j"))


_YOUDEN_SQL = f"""
WITH {_SCORES_CTE},
c AS (SELECT p, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM s GROUP BY p),
k AS (SELECT p, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS tot_pos, sum(neg) OVER () AS tot_neg
      FROM c WINDOW w AS (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
r AS (SELECT p, tp / greatest(tot_pos, 1) AS tpr, fp / greatest(tot_neg, 1) AS fpr FROM k)
SELECT round(arg_max(p, (tpr - fpr, p)), 9) AS threshold, round(arg_max(tpr, (tpr - fpr, p)), 6) AS tpr,
       round(arg_max(fpr, (tpr - fpr, p)), 6) AS fpr, round(max(tpr - fpr), 6) AS j FROM r
"""


def average_precision_by_group(spark, sf):
    ap = evaluate.average_precision(_scores(spark, sf), ["lang"], "y", "p")
    return ap.select("lang", F.round("average_precision", 6).alias("average_precision"))


_AP_SQL = f"""
WITH {_SCORES_CTE},
c AS (SELECT lang, p, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM s GROUP BY 1, 2),
k AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY lang) AS tot_pos
      FROM c WINDOW w AS (PARTITION BY lang ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT lang, round(sum(pos / greatest(tot_pos, 1) * (tp / (tp + fp))), 6) AS average_precision FROM k GROUP BY lang
"""


def ece_bins(spark, sf):
    b = evaluate.calibration_bins(_scores(spark, sf), "y", "p", 15)
    return b.select("bin", "count", F.round("confidence", 6).alias("confidence"),
                    F.round("accuracy", 6).alias("accuracy"))


def _edges_sql(n=15):
    return "[" + ", ".join(repr(e) for e in evaluate.ece_edges(n)) + "]"


_ECE_BINS_SQL = f"""
WITH {_SCORES_CTE},
b AS (SELECT len(list_filter({_edges_sql()}::DOUBLE[], lambda e: e <= p)) AS bin, p, y FROM s),
st AS (SELECT bin, count(*) AS count, avg(p) AS conf, avg(y::DOUBLE) AS acc FROM b GROUP BY bin)
SELECT CAST(g.x AS INTEGER) AS bin, coalesce(count, 0) AS count, round(coalesce(conf, 0.0), 6) AS confidence,
       round(coalesce(acc, 0.0), 6) AS accuracy
FROM range(0, 15) g(x) LEFT JOIN st ON st.bin = g.x
"""


def ece_summary(spark, sf):
    e = evaluate.calibration_summary(_scores(spark, sf), "y", "p", 15)
    return e.select(*[F.round(c, 6).alias(c) for c in ("ece", "mce", "brier")])


_ECE_SQL = f"""
WITH {_SCORES_CTE},
b AS (SELECT len(list_filter({_edges_sql()}::DOUBLE[], lambda e: e <= p)) AS bin, p, y FROM s),
st AS (SELECT bin, count(*) AS n, avg(p) AS conf, avg(y::DOUBLE) AS acc FROM b GROUP BY bin),
t AS (SELECT count(*) AS total, avg((p - y) * (p - y)) AS brier FROM s)
SELECT round(sum(n / total * abs(acc - conf)), 6) AS ece, round(max(abs(acc - conf)), 6) AS mce,
       round(max(brier), 6) AS brier FROM st, t
"""


def grid_threshold(spark, sf):
    g = evaluate.threshold_grid(_scores(spark, sf), "y", "p")
    return g.select(F.round("threshold", 9).alias("threshold"), F.round("score", 6).alias("score"))


def _grid_sql():
    step = (0.75 - 0.30) / 45
    return f"""
WITH {_SCORES_CTE},
g AS (SELECT i, 0.3::DOUBLE + i * {step!r}::DOUBLE AS t FROM range(0, 46) r(i)),
m AS (SELECT i, t, count(*) FILTER (WHERE y = 1 AND p >= t) AS tp, count(*) FILTER (WHERE y = 0 AND p < t) AS tn,
             count(*) FILTER (WHERE y = 1) AS np_, count(*) FILTER (WHERE y = 0) AS nn_ FROM g, s GROUP BY i, t),
sc AS (SELECT i, t, 0.6 * CASE WHEN np_ > 0 AND nn_ > 0 THEN (tp / np_ + tn / nn_) / 2 WHEN np_ > 0 THEN tp / np_ ELSE tn / nn_ END
                 + 0.4 * (tp + tn) / (np_ + nn_) AS score FROM m)
SELECT round(arg_max(t, (score, -i)), 9) AS threshold, round(max(score), 6) AS score FROM sc
"""


def classification_report(spark, sf):
    m = evaluate.classification_metrics(_scores(spark, sf), "y", "p", 0.5)
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


_CLASS_SQL = f"""
WITH {_SCORES_CTE},
c AS (SELECT count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND y = 0) AS fp,
             count(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn, count(*) FILTER (WHERE p < 0.5 AND y = 0) AS tn,
             count(*) AS n,
             avg(-(y * ln(least(greatest(p, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(p, 1e-15), 1 - 1e-15)))) AS ll
      FROM s),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS prec,
             CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS rec,
             CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0.0 END AS spec FROM c)
SELECT round((tp + tn) / n, 6) AS accuracy, round(prec, 6) AS precision, round(rec, 6) AS recall,
       round(spec, 6) AS specificity, round(CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END, 6) AS f1,
       round((rec + spec) / 2, 6) AS balanced_accuracy, round(ll, 6) AS log_loss FROM r
"""


def fairness_report(spark, sf):
    g = evaluate.fairness_groups(_scores(spark, sf), ["lang", "source"], "y", "p", 0.5)
    return g.select("attribute", "group", "n", *[F.round(c, 6).alias(c) for c in
                                                 ("positive_rate", "tpr", "fpr", "ppv", "npv", "auc")])


def _fair_groups_sql(k: int = 6):
    def rd(e):
        return f"round({e}, {k})" if k else f"({e})"
    return f"""
WITH {_SCORES_CTE},
l AS (SELECT 'lang' AS attribute, lang AS "group", y, p FROM s UNION ALL SELECT 'source', source, y, p FROM s),
m AS (SELECT attribute, "group", count(*) AS n,
             count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND y = 0) AS fp,
             count(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn, count(*) FILTER (WHERE p < 0.5 AND y = 0) AS tn,
             avg(CASE WHEN p >= 0.5 THEN 1.0 ELSE 0.0 END) AS positive_rate FROM l GROUP BY 1, 2),
c AS (SELECT attribute, "group", p, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM l GROUP BY 1, 2, 3),
k AS (SELECT *, sum(neg) OVER (PARTITION BY attribute, "group" ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS le FROM c),
a AS (SELECT attribute, "group", CASE WHEN sum(pos) = 0 OR sum(neg) = 0 THEN 0.5
             ELSE sum(pos * (le - neg + neg * 0.5)) / (sum(pos) * sum(neg)) END AS auc FROM k GROUP BY 1, 2)
SELECT m.attribute, m."group", n, {rd('positive_rate')} AS positive_rate,
       {rd('tp / greatest(tp + fn, 1)')} AS tpr, {rd('fp / greatest(fp + tn, 1)')} AS fpr,
       {rd('tp / greatest(tp + fp, 1)')} AS ppv, {rd('tn / greatest(tn + fn, 1)')} AS npv, {rd('auc')} AS auc
FROM m LEFT JOIN a ON m.attribute = a.attribute AND m."group" = a."group" WHERE n >= 10
"""


def _fairness_summary_df(spark, sf):
    g = evaluate.fairness_groups(_scores(spark, sf), ["lang", "source"], "y", "p", 0.5)
    return evaluate.fairness_summary(g)


def fairness_summary(spark, sf):
    s = _fairness_summary_df(spark, sf)
    return s.select(*[F.round(c, 6).alias(c) for c in ("demographic_parity_ratio", "equalized_odds_ratio",
                                                         "ppv_ratio", "tpr_gap", "auc_gap")],
                    "n_groups", "passes_parity")


def _fair_summary_sql():
    def pr(c):
        return (f"CASE WHEN count(*) FILTER (WHERE {c} > 0) < 2 THEN 1.0 ELSE "
                f"min({c}) FILTER (WHERE {c} > 0) / max({c}) FILTER (WHERE {c} > 0) END")
    inner = _fair_groups_sql(0)
    return f"""
WITH f AS ({inner}),
s AS (SELECT {pr('positive_rate')} AS dpr, {pr('tpr')} AS eor, {pr('ppv')} AS ppvr,
             max(tpr) - min(tpr) AS tpr_gap, max(auc) - min(auc) AS auc_gap, count(*) AS n_groups FROM f)
SELECT round(dpr, 6) AS demographic_parity_ratio, round(eor, 6) AS equalized_odds_ratio, round(ppvr, 6) AS ppv_ratio,
       round(tpr_gap, 6) AS tpr_gap, round(auc_gap, 6) AS auc_gap, n_groups, eor >= 0.8 AND eor <= 1.25 AS passes_parity FROM s
"""


def gate_decision(spark, sf):
    s = _scores(spark, sf)
    auc = evaluate.roc_auc(s, [], "y", "p").select(F.lit("auc").alias("metric"), F.col("auc").alias("value"))
    ece = evaluate.calibration_summary(s, "y", "p").select(F.lit("ece").alias("metric"), F.col("ece").alias("value"))
    eor = _fairness_summary_df(spark, sf).select(F.lit("equalized_odds_ratio").alias("metric"),
                                                 F.col("equalized_odds_ratio").alias("value"))
    metrics = auc.unionByName(ece).unionByName(eor)
    d = evaluate.gate_decision(metrics)
    return d.select("gate", "kind", "metric", F.round("value", 6).alias("value"), "threshold", "result",
                    "hard_fails", "soft_warns", "decision")


def _gate_sql():
    auc = _AUC_SQL.replace("SELECT lang, round(CASE", "SELECT lang, (CASE").replace("END, 6) AS auc", "END) AS auc")
    ece = _ECE_SQL.replace("round(sum(n / total * abs(acc - conf)), 6)", "sum(n / total * abs(acc - conf))")
    fair = _fair_summary_sql().replace("round(eor, 6) AS equalized_odds_ratio", "eor AS equalized_odds_ratio")
    rows = ", ".join(f"('{g}', '{k}', '{m}', '{o}', {t}::DOUBLE)" for g, k, m, o, t in evaluate.GATES)
    return f"""
WITH a AS ({auc}), e AS ({ece}), f AS ({fair}),
metrics AS (SELECT 'auc' AS metric, auc AS value FROM a WHERE lang = 'ALL'
            UNION ALL SELECT 'ece', ece FROM e UNION ALL SELECT 'equalized_odds_ratio', equalized_odds_ratio FROM f),
rules(gate, kind, metric, op, threshold) AS (VALUES {rows}),
r AS (SELECT gate, kind, rules.metric, value, threshold,
        CASE WHEN coalesce(CASE WHEN op = '>=' THEN value >= threshold ELSE value <= threshold END, false) THEN 'PASS'
             WHEN kind = 'hard' THEN 'HARD_FAIL' ELSE 'SOFT_WARN' END AS result
      FROM rules LEFT JOIN metrics ON rules.metric = metrics.metric)
SELECT gate, kind, metric, round(value, 6) AS value, threshold, result,
  count(*) FILTER (WHERE result = 'HARD_FAIL') OVER () AS hard_fails,
  count(*) FILTER (WHERE result = 'SOFT_WARN') OVER () AS soft_warns,
  CASE WHEN count(*) FILTER (WHERE result = 'HARD_FAIL') OVER () > 0 THEN 'REJECT'
       WHEN count(*) FILTER (WHERE result = 'SOFT_WARN') OVER () > 0 THEN 'HUMAN_REVIEW' ELSE 'PROMOTE' END AS decision
FROM r
"""


def _is_calib(c):
    return F.pmod(F.col(c) * F.lit(2654435761) + F.lit(7), F.lit(4294967296)) % 2 == 0


def conformal_coverage(spark, sf):
    s = _scores(spark, sf)
    calib, test = s.filter(_is_calib("doc_id")), s.filter(~_is_calib("doc_id"))
    c = evaluate.conformal_lac(calib, test, "y", "p", [0.05, 0.10, 0.20])
    return c.select("alpha", F.round("qhat", 9).alias("qhat"), F.round("coverage", 6).alias("coverage"),
                    F.round("mean_set_size", 6).alias("mean_set_size"))


_CONFORMAL_SQL = f"""
WITH {_SCORES_CTE},
cal AS (SELECT 1.0 - CASE WHEN y = 1 THEN p ELSE 1 - p END AS sc FROM s WHERE ((doc_id * 2654435761 + 7) % 4294967296) % 2 = 0),
tst AS (SELECT y, p FROM s WHERE ((doc_id * 2654435761 + 7) % 4294967296) % 2 <> 0),
n AS (SELECT count(*) AS n FROM cal),
a AS (SELECT alpha, least(CAST(ceil((n + 1) * (1 - alpha)) AS BIGINT), n) AS k FROM n, (VALUES (0.05::DOUBLE), (0.10::DOUBLE), (0.20::DOUBLE)) v(alpha)),
o AS (SELECT sc, row_number() OVER (ORDER BY sc) AS rk FROM cal),
q AS (SELECT alpha, sc AS qhat FROM a JOIN o ON o.rk = a.k)
SELECT alpha, round(qhat, 9) AS qhat,
  round(avg(CASE WHEN (y = 1 AND 1.0 - p <= qhat) OR (y = 0 AND p <= qhat) THEN 1.0 ELSE 0.0 END), 6) AS coverage,
  round(avg((CASE WHEN 1.0 - p <= qhat THEN 1.0 ELSE 0.0 END) + (CASE WHEN p <= qhat THEN 1.0 ELSE 0.0 END)), 6) AS mean_set_size
FROM tst, q GROUP BY alpha, qhat
"""


def interval_metrics(spark, sf):
    li = table(spark, sf, "lineitem", ["l_quantity", "l_extendedprice"])
    d = li.select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 950.0).alias("lower"),
                  (F.col("l_quantity") * 1050.0).alias("upper"))
    m = evaluate.interval_metrics(d, "y", "lower", "upper", 0.2, 0.1, 0.9)
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


_INTERVAL_SQL = """
WITH d AS (SELECT l_extendedprice AS y, l_quantity * 950.0 AS lo, l_quantity * 1050.0 AS hi FROM lineitem)
SELECT round(avg(CASE WHEN y >= lo AND y <= hi THEN 1.0 ELSE 0.0 END), 6) AS coverage,
       round(avg(hi - lo), 6) AS mean_width,
       round(avg((hi - lo) + CASE WHEN y < lo THEN (2.0 / 0.2) * (lo - y) WHEN y > hi THEN (2.0 / 0.2) * (y - hi) ELSE 0.0 END), 6) AS winkler,
       round(avg(greatest(0.1 * (y - lo), (0.1 - 1.0) * (y - lo))), 6) AS pinball_lower,
       round(avg(greatest(0.9 * (y - hi), (0.9 - 1.0) * (y - hi))), 6) AS pinball_upper
FROM d
"""


def kappa_quadratic(spark, sf):
    s = _scores(spark, sf)
    r = s.select(F.least(F.lit(5), F.lit(1) + F.floor(F.col("n_chars") / 2000)).alias("a"),
                 (F.lit(1) + F.col("y") * 2 + F.col("toxic") * 2).alias("b"))
    return evaluate.quadratic_kappa(r, "a", "b").select(F.round("kappa", 6).alias("kappa"))


_KAPPA_SQL = f"""
WITH {_SCORES_CTE},
r AS (SELECT least(5, 1 + floor(n_chars / 2000))::DOUBLE AS a, (1 + y * 2 + toxic * 2)::DOUBLE AS b FROM s),
m AS (SELECT sum((a - b) * (a - b)) AS obs, sum(a) AS s1a, sum(b) AS s1b, sum(a * a) AS s2a, sum(b * b) AS s2b,
             count(*) AS n FROM r)
SELECT round(1.0 - obs / (s2a + s2b - 2.0 * s1a * s1b / n), 6) AS kappa FROM m
"""


def concordance_ratings(spark, sf):
    """C-index of a length-based rating (1..5) against the label rating (1, 3, 5)."""
    s = _scores(spark, sf)
    r = s.select((F.lit(1) + F.col("y") * 2 + F.col("toxic") * 2).alias("truth"),
                 F.least(F.lit(5), F.lit(1) + F.floor(F.col("n_chars") / 2000)).alias("rating"))
    c = evaluate.concordance_index(r, "truth", "rating")
    return c.select(F.col("concordant").cast("long").alias("concordant"),
                    F.col("discordant").cast("long").alias("discordant"),
                    F.col("tied").cast("long").alias("tied"), F.round("c_index", 6).alias("c_index"))


_CONCORDANCE_SQL = f"""
WITH {_SCORES_CTE},
r AS (SELECT (1 + y * 2 + toxic * 2)::DOUBLE AS truth, least(5, 1 + floor(n_chars / 2000))::DOUBLE AS rating FROM s),
p AS (SELECT a.rating AS ra, b.rating AS rb FROM r a JOIN r b ON a.truth < b.truth),
c AS (SELECT count(*) FILTER (WHERE ra < rb) AS concordant, count(*) FILTER (WHERE ra > rb) AS discordant,
             count(*) FILTER (WHERE ra = rb) AS tied FROM p)
SELECT CAST(concordant AS BIGINT) AS concordant, CAST(discordant AS BIGINT) AS discordant, CAST(tied AS BIGINT) AS tied,
       round((concordant + 0.5 * tied) / (concordant + discordant + tied), 6) AS c_index FROM c
"""


QUERIES = {
    "concordance_ratings": concordance_ratings,
    "roc_auc_by_group": roc_auc_by_group,
    "youden_threshold": youden_threshold,
    "average_precision_by_group": average_precision_by_group,
    "ece_bins": ece_bins,
    "ece_summary": ece_summary,
    "grid_threshold": grid_threshold,
    "classification_report": classification_report,
    "fairness_report": fairness_report,
    "fairness_summary": fairness_summary,
    "gate_decision": gate_decision,
    "conformal_coverage": conformal_coverage,
    "interval_metrics": interval_metrics,
    "kappa_quadratic": kappa_quadratic,
}

ORACLE = {
    "concordance_ratings": _CONCORDANCE_SQL,
    "roc_auc_by_group": _AUC_SQL,
    "youden_threshold": _YOUDEN_SQL,
    "average_precision_by_group": _AP_SQL,
    "ece_bins": _ECE_BINS_SQL,
    "ece_summary": _ECE_SQL,
    "grid_threshold": _grid_sql(),
    "classification_report": _CLASS_SQL,
    "fairness_report": _fair_groups_sql(),
    "fairness_summary": _fair_summary_sql(),
    "gate_decision": _gate_sql(),
    "conformal_coverage": _CONFORMAL_SQL,
    "interval_metrics": _INTERVAL_SQL,
    "kappa_quadratic": _KAPPA_SQL,
}
