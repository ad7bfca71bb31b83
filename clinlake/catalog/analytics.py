"""Further analytics queries: drift triggers, evidence blocks, class reports,
forecast metrics, augmentation, polygenic scores, connectome node features,
transition graphs, motion scrubbing, attribution stability and the
model-based (rows-checked) operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from clinlake.catalog import drift as drift_q
from clinlake.catalog import models as models_q
from clinlake.catalog import signal as signal_q
from clinlake.catalog import text as text_q
from clinlake.operators import connectome, drift, evaluate, graph, grouped_fit, impute, retrieval, signal, sparse_search, text
from clinlake.functions.exprs import pearson
from clinlake.session import table


def _r(c, k=6):
    return F.round(c, k).alias(c)


def retrain_trigger(spark, sf):
    rep = drift.drift_report(drift_q._lineitem_long(spark, sf))
    t = drift.retrain_trigger(rep)
    return t.select("should_retrain", "n_critical", "critical_features", _r("psi_max"), "reason")


def _retrain_sql():
    base = drift_q._drift_report_sql()
    return f"""
WITH r AS ({base})
SELECT count(*) FILTER (WHERE severity = 'CRITICAL') > 0 AS should_retrain,
       count(*) FILTER (WHERE severity = 'CRITICAL') AS n_critical,
       coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (WHERE severity = 'CRITICAL'), '') AS critical_features,
       round(max(psi), 6) AS psi_max,
       'critical drift in ' || count(*) FILTER (WHERE severity = 'CRITICAL') || ' feature(s)' AS reason
FROM r
"""


def evidence_context(spark, sf):
    docs = table(spark, sf, "documents", ["doc_id", "text", "lang", "source"])
    qs = table(spark, sf, "benchmark", ["item_id", "text"])
    top = sparse_search.bm25_top_k(docs.select("doc_id", "text"), "doc_id", "text", qs, "item_id", "text", 5)
    j = top.join(docs, "doc_id")
    block = text.evidence_block(j, "item_id", "rank", "doc_id", "lang", "source", "text")
    return block.select("item_id", "n_passages", F.length("context").alias("context_chars"),
                        F.sha2("context", 256).alias("context_sha"))


def _evidence_sql():
    nl = "chr(10)"
    passage = (f"'[' || rank || '] DOC' || d.doc_id || ' (' || lang || ', ' || source || ')' || {nl} || 'Text: ' || "
               f"substr(d.text, 1, 600) || CASE WHEN length(d.text) > 600 THEN '…' ELSE '' END || {nl}")
    return f"""
WITH {text_q._BM25_CTE},
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc),
p AS (SELECT item_id, rank, {passage} AS passage FROM r JOIN documents d ON d.doc_id = r.doc_id WHERE rank <= 5),
c AS (SELECT item_id, count(*) AS n_passages,
             'Relevant documents:' || {nl} || string_agg(passage, {nl} ORDER BY rank) AS context FROM p GROUP BY item_id)
SELECT item_id, n_passages, CAST(length(context) AS INTEGER) AS context_chars, sha256(context) AS context_sha FROM c
"""


def nearest_centroid_report(spark, sf):
    emb = table(spark, sf, "embeddings", ["vec_id", "embedding", "label"])
    cents = text_q._centroids(emb)
    pred = retrieval.nearest_centroid(emb, "embedding", cents, "label", "centroid", out="predicted")
    rep = evaluate.per_class_report(pred, "label", "predicted")
    return rep.select("class", "support", "n_predicted", _r("precision"), _r("recall"), _r("f1"))


_CENTROID_REPORT_SQL = f"""
WITH {text_q._CENTROID_CTE},
s AS (SELECT e.vec_id, e.label, c.label AS cl, list_cosine_similarity(e.embedding::DOUBLE[], c.centroid) AS sim
      FROM embeddings e, c),
p AS (SELECT vec_id, any_value(label) AS label, arg_max(cl, (sim, -cl)) AS predicted FROM s GROUP BY vec_id),
k AS (SELECT label AS class FROM p UNION SELECT predicted FROM p),
m AS (SELECT k.class, (SELECT count(*) FROM p WHERE label = k.class) AS support,
             (SELECT count(*) FROM p WHERE predicted = k.class) AS n_predicted,
             (SELECT count(*) FROM p WHERE label = k.class AND predicted = k.class) AS tp FROM k)
SELECT class, support, n_predicted,
  round(CASE WHEN n_predicted > 0 THEN tp / n_predicted ELSE 0.0 END, 6) AS precision,
  round(CASE WHEN support > 0 THEN tp / support ELSE 0.0 END, 6) AS recall,
  round(CASE WHEN tp > 0 THEN 2.0 * tp / (support + n_predicted) ELSE 0.0 END, 6) AS f1 FROM m
"""


def forecast_metrics(spark, sf):
    o = table(spark, sf, "orders", ["o_orderkey", "o_totalprice", "o_orderpriority"])
    li = table(spark, sf, "lineitem", ["l_orderkey", "l_extendedprice", "l_discount", "l_tax"])
    pred = li.groupBy("l_orderkey").agg(
        (F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))) / 1000.0).alias("pred"))
    j = o.join(pred, o.o_orderkey == pred.l_orderkey).withColumn("y", F.col("o_totalprice") / 1000.0)
    m = evaluate.regression_metrics(j, ["o_orderpriority"], "y", "pred", band=5.0)
    return m.select("o_orderpriority", "n", _r("rmse"), _r("mae"), _r("band_coverage"))


_FORECAST_SQL = """
WITH p AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) / 1000.0 AS pred FROM lineitem GROUP BY 1),
j AS (SELECT o_orderpriority, o_totalprice / 1000.0 AS y, pred FROM orders JOIN p ON o_orderkey = l_orderkey)
SELECT o_orderpriority, count(*) AS n, round(sqrt(avg((y - pred) * (y - pred))), 6) AS rmse, round(avg(abs(y - pred)), 6) AS mae,
       round(avg(CASE WHEN y >= pred - 5.0 AND y <= pred + 5.0 THEN 1.0 ELSE 0.0 END), 6) AS band_coverage
FROM j GROUP BY o_orderpriority
"""


def augmentation_plan(spark, sf):
    lab = table(spark, sf, "labels", ["quality", "toxic"])
    counts = lab.groupBy(F.format_string("q%d_t%d", "quality", "toxic").alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    return impute.augmentation_plan(counts, "cls", min_n=150, max_frac=0.3)


_AUG_SQL = """
WITH c AS (SELECT 'q' || quality || '_t' || toxic AS cls, count(*) AS n FROM labels GROUP BY 1)
SELECT cls, n, CAST(greatest(CASE WHEN n < 150 THEN least(150 - n, CAST(floor(n / (1.0 - 0.3) * 0.3) AS BIGINT)) ELSE 0 END, 0) AS BIGINT) AS n_add
FROM c
"""


def polygenic_score(spark, sf):
    li = table(spark, sf, "lineitem", ["l_partkey", "l_suppkey"])
    g = li.groupBy("l_partkey", "l_suppkey").agg(F.least(F.count(F.lit(1)), F.lit(2)).alias("dosage"))
    part = table(spark, sf, "part", ["p_partkey", "p_type", "p_retailprice"])
    betas = part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("trait"),
                        ((F.col("p_retailprice") - 1400.0) / 1000.0).alias("beta"))
    from clinlake.operators import genomics
    prs = genomics.polygenic_scores(g, betas, "l_partkey", "l_suppkey", "dosage", "trait")
    return prs.select("l_suppkey", "trait", _r("prs"), _r("prs_z"))


_PRS_SQL = """
WITH g AS (SELECT l_partkey, l_suppkey, least(count(*), 2) AS d FROM lineitem GROUP BY ALL),
s AS (SELECT l_suppkey, p_type AS trait, sum((p_retailprice - 1400.0) / 1000.0 * d) AS prs
      FROM g JOIN part ON l_partkey = p_partkey GROUP BY ALL),
st AS (SELECT trait, avg(prs) AS m, stddev_pop(prs) AS sd FROM s GROUP BY trait)
SELECT l_suppkey, s.trait, round(prs, 6) AS prs,
       round(coalesce((prs - m) / CASE WHEN coalesce(sd, 0) = 0 THEN 1 ELSE sd END, 0), 6) AS prs_z
FROM s JOIN st ON s.trait = st.trait
"""


def node_features(spark, sf):
    long = signal_q._long(spark, sf)
    pc = connectome.pair_correlations(long, "scan", "t", "roi", "value").withColumn(
        "r", F.when(F.isnan("r"), None).otherwise(F.col("r")))
    edges = connectome.proportional_threshold(pc, 0.85)
    nf = connectome.node_features(long, edges, "scan", "roi", "value")
    return nf.select("scan", "roi", _r("mean_abs"), _r("variance"), "n_points", "degree")


def _node_sql():
    return f"""WITH {signal_q._LONG_CTE},
nz AS (SELECT * , round(abs(r), 9) AS a FROM pc WHERE r IS NOT NULL AND NOT isnan(r) AND r <> 0),
cut AS (SELECT scan, quantile_cont(a, 0.85) AS c FROM nz GROUP BY scan),
k AS (SELECT nz.* FROM nz JOIN cut USING (scan) WHERE a >= c),
e AS (SELECT scan, roi_i AS src FROM k UNION ALL SELECT scan, roi_j FROM k),
deg AS (SELECT scan, src AS roi, count(*) AS degree FROM e GROUP BY ALL),
f AS (SELECT scan, roi, avg(abs(value)) AS mean_abs, var_pop(value) AS variance, count(*) AS n_points FROM lg GROUP BY ALL)
SELECT f.scan, f.roi, round(mean_abs, 6) AS mean_abs, round(variance, 6) AS variance, n_points,
       coalesce(degree, 0) AS degree FROM f LEFT JOIN deg ON f.scan = deg.scan AND f.roi = deg.roi"""


def normative_zscore(spark, sf):
    long = signal_q._long(spark, sf)
    z = connectome.normative_z(long, "roi", "value", clip_at=5.0)
    return z.select("scan", "t", "roi", _r("z"))


_NORM_SQL = """
WITH lg AS (SELECT user_id AS scan, CAST(ts AS DATE) AS t, event_type AS roi, avg(value) AS value FROM events GROUP BY ALL),
st AS (SELECT roi, avg(value) AS m, stddev_pop(value) AS s FROM lg GROUP BY roi)
SELECT scan, t, lg.roi, round(least(greatest((value - m) / CASE WHEN coalesce(s, 0) = 0 THEN 1 ELSE s END, -5.0), 5.0), 6) AS z
FROM lg JOIN st ON lg.roi = st.roi
"""

TYPES = ["click", "view", "purchase", "signup", "error"]


def _transition_shares(spark, sf, run=None):
    from clinlake.plans.halo import bucket_window, drop_halo, with_halo
    ev = table(spark, sf, "events", ["event_id", "ts", "user_id", "event_type"])
    h = with_halo(ev, ["user_id"], ["ts", "event_id"], ahead=1)  # a user's next event, split over buckets
    w = bucket_window(["user_id"], ["ts", "event_id"])
    tr = drop_halo(h.withColumn("b", F.lead("event_type").over(w))).filter(F.col("b").isNotNull()) \
        .withColumnRenamed("event_type", "a")
    keys = ["user_id"] if run is None else [run]
    if run == "week":
        tr = tr.withColumn("week", F.date_trunc("week", "ts"))
    cnt = tr.groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    tot = cnt.groupBy(*keys, "a").agg(F.sum("n").alias("t"))
    return cnt.join(tot, [*keys, "a"]).withColumn("w", F.col("n") / F.col("t"))


def adjacency_edges(spark, sf):
    sh = _transition_shares(spark, sf)
    rows = sh.groupBy("user_id", "a").agg(
        F.map_from_entries(F.collect_list(F.struct("b", "w"))).alias("_m"))  # <= 5 entries per row
    levels = F.array(*[F.lit(t) for t in TYPES])
    mat = rows.select("user_id", (F.array_position(levels, F.col("a")).cast("int") - 1).alias("row"),
                      F.transform(levels, lambda t: F.coalesce(F.try_element_at(F.col("_m"), t), F.lit(0.0)))
                      .alias("weights"))
    e = graph.adjacency_edges(mat, "user_id", "row", TYPES, 0.3)
    return e.select("user_id", "src", "dst", _r("w"), "edge_type", graph.causal_role("w").alias("role"))


_ADJ_SQL = """
WITH t AS (SELECT user_id, event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events),
c AS (SELECT user_id, a, b, count(*) AS n FROM t WHERE b IS NOT NULL GROUP BY ALL),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id, a) AS w FROM c),
p AS (SELECT *, list_position(['click', 'view', 'purchase', 'signup', 'error'], a) - 1 AS i,
             list_position(['click', 'view', 'purchase', 'signup', 'error'], b) - 1 AS j FROM s)
SELECT user_id, a AS src, b AS dst, round(w, 6) AS w, CASE WHEN abs(i - j) = 1 THEN 'direct' ELSE 'indirect' END AS edge_type,
       CASE WHEN w < 0.35 THEN 'protective' WHEN w > 0.45 THEN 'amplifier' ELSE 'neutral' END AS role
FROM p WHERE abs(w) > 0.3
"""


def edge_stability(spark, sf):
    sh = _transition_shares(spark, sf, run="week")
    st = graph.edge_stability(sh, "week", "a", "b", "w", threshold=0.25)
    return st.select("a", "b", _r("stability"))


_STAB_SQL = """
WITH t AS (SELECT date_trunc('week', ts) AS week, event_type AS a,
                  lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events),
c AS (SELECT week, a, b, count(*) AS n FROM t WHERE b IS NOT NULL GROUP BY ALL),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY week, a) AS w FROM c),
r AS (SELECT count(DISTINCT week) AS runs FROM s)
SELECT a, b, round(count(*) FILTER (WHERE w > 0.25) / max(runs), 6) AS stability FROM s, r GROUP BY a, b
"""


def motion_scrub(spark, sf):
    ev = table(spark, sf, "events", ["event_id", "ts", "user_id", "value"]).withColumn("fd", F.col("value") / 100.0)
    out = connectome.motion_scrub(ev, "user_id", ["ts", "event_id"], "fd", "value", fd_max=0.5, max_bad=0.2)
    return out.select("event_id", "user_id", _r("value"))


_SCRUB_SQL = """
WITH keep AS (SELECT user_id FROM events GROUP BY user_id HAVING avg(CASE WHEN value / 100.0 > 0.5 THEN 1.0 ELSE 0.0 END) <= 0.2),
s AS (SELECT event_id, ts, e.user_id, CASE WHEN value / 100.0 > 0.5 THEN NULL ELSE value END AS x,
             row_number() OVER (PARTITION BY e.user_id ORDER BY ts, event_id) AS pos
      FROM events e JOIN keep ON e.user_id = keep.user_id),
k AS (SELECT *, CASE WHEN x IS NOT NULL THEN pos END AS kp FROM s),
n AS (SELECT *,
   last(kp IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pp,
   last(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
   first(kp IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS np,
   first(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv
  FROM k)
SELECT event_id, user_id, round(CASE WHEN x IS NOT NULL THEN x
  WHEN pp IS NOT NULL AND np IS NOT NULL THEN coalesce(pv + (nv - pv) * (pos - pp)::DOUBLE / nullif(np - pp, 0)::DOUBLE, pv)
  WHEN pp IS NOT NULL THEN pv ELSE nv END, 6) AS value
FROM n
"""

N_REPLICAS, TOP = 5, 5


def attribution_jaccard(spark, sf):
    emb = table(spark, sf, "embeddings", ["vec_id", "embedding", "label"])
    rep = F.pmod(F.col("vec_id") * F.lit(2654435761) + F.lit(13), F.lit(4294967296)) % N_REPLICAS
    long = emb.select(rep.alias("replica"), (F.col("label") >= 5).cast("double").alias("y"),
                      F.posexplode("embedding").alias("dim", "x"))
    imp = long.groupBy("replica", "dim").agg(F.abs(pearson(F.col("x").cast("double"), "y")).alias("importance"))
    j = evaluate.attribution_stability(imp, "replica", "dim", "importance", TOP)
    return j.select("n_pairs", _r("mean_jaccard"))


_JACCARD_SQL = f"""
WITH e AS (SELECT ((vec_id * 2654435761 + 13) % 4294967296) % {N_REPLICAS} AS replica,
                  CASE WHEN label >= 5 THEN 1.0 ELSE 0.0 END AS y, embedding FROM embeddings),
l AS (SELECT replica, y, unnest(generate_series(0, len(embedding) - 1)) AS dim, unnest(embedding)::DOUBLE AS x FROM e),
imp AS (SELECT replica, dim, abs(corr(x, y)) AS importance FROM l GROUP BY ALL),
t AS (SELECT replica, dim FROM (SELECT *, row_number() OVER (PARTITION BY replica ORDER BY round(importance, 9) DESC, dim) AS rk FROM imp) WHERE rk <= {TOP}),
reps AS (SELECT DISTINCT replica FROM imp),
pairs AS (SELECT a.replica AS r1, b.replica AS r2 FROM reps a JOIN reps b ON a.replica < b.replica),
inter AS (SELECT a.replica AS r1, b.replica AS r2, count(*) AS i FROM t a JOIN t b ON a.dim = b.dim AND a.replica < b.replica GROUP BY ALL),
jac AS (SELECT coalesce(i, 0) / ({2 * TOP} - coalesce(i, 0)) AS jac FROM pairs LEFT JOIN inter USING (r1, r2))
SELECT count(*) AS n_pairs, round(avg(jac), 6) AS mean_jaccard FROM jac
"""


def cycle_break(spark, sf):
    sh = _transition_shares(spark, sf).filter(F.col("w") > 0.1).filter(F.col("a") != F.col("b"))
    return graph.break_cycles(sh.select("user_id", F.col("a").alias("src"), F.col("b").alias("dst"), "w"), "user_id")


def spectral_features(spark, sf):
    ev = table(spark, sf, "events", ["event_id", "ts", "user_id", "value"])
    psd = signal.welch_psd(ev, ["user_id"], ["ts", "event_id"], "value", fs=50.0, nperseg=256)
    bands = signal.band_features(psd, ["user_id"])
    low = signal.low_activity_counts(ev.withColumn("value", F.col("value") / 100.0), ["user_id"], "value")
    return bands.join(low, "user_id", "left")


def regression_impute(spark, sf):
    """Ten rounds of round-robin regression of discount and tax (0 is missing)."""
    li = table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"])
    d = li.select("l_orderkey", "l_linenumber", "l_quantity", F.nullif("l_discount", F.lit(0.0)).alias("l_discount"),
                  F.nullif("l_tax", F.lit(0.0)).alias("l_tax"))
    out = grouped_fit.iterative_impute(d, ["l_quantity", "l_discount", "l_tax"], rounds=IMPUTE_ROUNDS)
    return out.select("l_orderkey", "l_linenumber", "l_quantity", _r("l_discount"), _r("l_tax"))


IMPUTE_ROUNDS = 10


def _impute_sql():
    ctes = ["""r0 AS MATERIALIZED (SELECT row_number() OVER () AS id, l_orderkey, l_linenumber, l_quantity AS q, nullif(l_discount, 0) AS d0,
    nullif(l_tax, 0) AS t0, coalesce(nullif(l_discount, 0), (SELECT avg(nullif(l_discount, 0)) FROM lineitem)) AS d,
    coalesce(nullif(l_tax, 0), (SELECT avg(nullif(l_tax, 0)) FROM lineitem)) AS t FROM lineitem)"""]
    last = "r0"
    for i in range(1, IMPUTE_ROUNDS + 1):
        for c, other in (("d", "t"), ("t", "d")):
            x, name = ["1", "q", other], f"{c}{i}"
            a = ", ".join(f"sum({x[j]} * {x[k]})::DOUBLE AS a_{j}_{k}" for j in range(3) for k in range(j, 3))
            b = ", ".join(f"sum({c}0 * {x[j]}) AS b_{j}" for j in range(3))
            ctes.append(f"n{name} AS MATERIALIZED (SELECT 1 AS one, {a}, {b} FROM {last} WHERE {c}0 IS NOT NULL)")
            ctes += models_q._solve_ctes(f"s{name}", f"n{name}", "one", 3)
            keep = f"{other}, coalesce({c}0, x_0 + x_1 * q + x_2 * {other}) AS {c}"
            ctes.append(f"r{name} AS MATERIALIZED (SELECT id, l_orderkey, l_linenumber, q, d0, t0, {keep} FROM {last}, s{name})")
            last = f"r{name}"
    return f"WITH {', '.join(ctes)} SELECT l_orderkey, l_linenumber, q AS l_quantity, round(d, 6) AS l_discount, round(t, 6) AS l_tax FROM {last}"


def combat_harmonise(spark, sf):
    s = table(spark, sf, "supplier", ["s_suppkey", "s_nationkey", "s_acctbal"])
    out = impute.combat_location_scale(s, ["s_acctbal"], "s_nationkey", suffix="_combat")
    return out.select("s_suppkey", "s_nationkey", _r("s_acctbal"), _r("s_acctbal_combat"))


_COMBAT_SQL = """
WITH p AS (SELECT avg(s_acctbal) AS pm, stddev_pop(s_acctbal) AS ps FROM supplier),
z AS (SELECT supplier.*, (s_acctbal - pm) / nullif(ps, 0) AS z, pm, ps FROM supplier, p),
g AS (SELECT s_nationkey, count(*)::DOUBLE AS n, avg(z) AS g, coalesce(var_pop(z), 0) AS d FROM z GROUP BY 1),
h AS (SELECT avg(g) AS gb, coalesce(var_pop(g), 0) AS t2, avg(d) AS db FROM g),
w AS (SELECT s_nationkey, CASE WHEN n * t2 + d = 0 THEN gb ELSE (n * t2 * g + d * gb) / (n * t2 + d) END AS gs,
    CASE WHEN n * t2 + d = 0 THEN 0 ELSE n * t2 / (n * t2 + d) END AS w, d, db FROM g, h),
k AS (SELECT s_nationkey, gs, CASE WHEN w * d + (1 - w) * db <= 0 THEN 1 ELSE w * d + (1 - w) * db END AS ds FROM w)
SELECT s_suppkey, z.s_nationkey, round(s_acctbal, 6) AS s_acctbal, round((z - gs) / sqrt(ds) * ps + pm, 6) AS s_acctbal_combat
FROM z JOIN k ON k.s_nationkey = z.s_nationkey
"""


def bootstrap_oversample(spark, sf):
    docs = table(spark, sf, "documents", ["doc_id", "n_chars", "source"])
    lab = table(spark, sf, "labels", ["doc_id", "quality", "toxic"])
    d = docs.join(lab, "doc_id").withColumn("cls", F.format_string("q%d_t%d", "quality", "toxic")) \
            .withColumn("n_chars", F.col("n_chars").cast("double")).withColumnRenamed("source", "data_source")
    counts = d.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    plan = impute.augmentation_plan(counts, "cls", min_n=150, max_frac=0.3)
    return impute.bootstrap_oversample(d, "cls", plan, ["n_chars"], seed=42)


def robustness_suite(spark, sf):
    f = models_q._features(spark, sf)
    li = table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_returnflag"])
    d = f.join(li, ["l_orderkey", "l_linenumber"]).withColumn("y", (F.col("l_returnflag") == "R").cast("int")) \
         .withColumn("rid", F.xxhash64("l_orderkey", "l_linenumber"))
    return evaluate.robustness_suite(d, "rid", models_q.FEATURES, "y", models_q.SCORE)


def fusion_weight_grid(spark, sf):
    from clinlake.operators import models
    docs = table(spark, sf, "documents", ["doc_id", "n_chars"])
    lab = table(spark, sf, "labels", ["doc_id", "quality"])
    d = docs.join(lab, "doc_id").select(
        "quality", (F.col("n_chars") / (F.col("n_chars") + 2000.0)).alias("p_text"),
        (F.col("n_chars") / (F.col("n_chars") + 8000.0)).alias("p_long"),
        (F.lit(1.0) - F.col("n_chars") / (F.col("n_chars") + 500.0)).alias("p_short"),
        (F.pmod(F.col("doc_id") * F.lit(2654435761) + F.lit(3), F.lit(4294967296)) % 5).alias("fold"))
    g = models.fusion_weight_search(d, "quality", ["p_text", "p_long", "p_short"], "fold", step=0.25)
    return g.select("trial", "w_p_text", "w_p_long", "w_p_short", _r("mean_auc"), "is_best")


def _fusion_grid_sql():
    from clinlake.operators.models import weight_grid
    trials = ", ".join(f"({i}, {w[0]!r}::DOUBLE, {w[1]!r}::DOUBLE, {w[2]!r}::DOUBLE)"
                       for i, w in enumerate(weight_grid(3, 0.25)))
    return f"""
WITH d AS (SELECT quality AS y, n_chars / (n_chars + 2000.0) AS p1, n_chars / (n_chars + 8000.0) AS p2,
                  1.0 - n_chars / (n_chars + 500.0) AS p3, ((d.doc_id * 2654435761 + 3) % 4294967296) % 5 AS fold
           FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
t(trial, w1, w2, w3) AS (VALUES {trials}),
s AS (SELECT trial, fold, y, 0.0 + w1 * p1 + w2 * p2 + w3 * p3 AS p FROM d, t),
c AS (SELECT trial, fold, p, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM s GROUP BY ALL),
k AS (SELECT *, sum(neg) OVER (PARTITION BY trial, fold ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS le FROM c),
a AS (SELECT trial, fold, CASE WHEN sum(pos) = 0 OR sum(neg) = 0 THEN 0.5
             ELSE sum(pos * (le - neg + neg * 0.5)) / (sum(pos) * sum(neg)) END AS auc FROM k GROUP BY ALL),
m AS (SELECT trial, avg(auc) AS mean_auc FROM a GROUP BY trial),
b AS (SELECT arg_max(trial, (round(mean_auc, 12), -trial)) AS best FROM m)
SELECT m.trial, w1 AS w_p_text, w2 AS w_p_long, w3 AS w_p_short, round(mean_auc, 6) AS mean_auc, m.trial = best AS is_best
FROM m JOIN t ON m.trial = t.trial, b
"""


QUERIES = {
    "fusion_weight_grid": fusion_weight_grid,
    "retrain_trigger": retrain_trigger,
    "evidence_context": evidence_context,
    "nearest_centroid_report": nearest_centroid_report,
    "forecast_metrics": forecast_metrics,
    "augmentation_plan": augmentation_plan,
    "polygenic_score": polygenic_score,
    "node_features": node_features,
    "normative_zscore": normative_zscore,
    "adjacency_edges": adjacency_edges,
    "edge_stability": edge_stability,
    "motion_scrub": motion_scrub,
    "attribution_jaccard": attribution_jaccard,
    "cycle_break": cycle_break,
    "spectral_features": spectral_features,
    "regression_impute": regression_impute,
    "combat_harmonise": combat_harmonise,
    "bootstrap_oversample": bootstrap_oversample,
    "robustness_suite": robustness_suite,
}

ORACLE = {
    "fusion_weight_grid": _fusion_grid_sql(),
    "retrain_trigger": _retrain_sql(),
    "evidence_context": _evidence_sql(),
    "nearest_centroid_report": _CENTROID_REPORT_SQL,
    "forecast_metrics": _FORECAST_SQL,
    "augmentation_plan": _AUG_SQL,
    "polygenic_score": _PRS_SQL,
    "node_features": _node_sql(),
    "normative_zscore": _NORM_SQL,
    "adjacency_edges": _ADJ_SQL,
    "edge_stability": _STAB_SQL,
    "motion_scrub": _SCRUB_SQL,
    "attribution_jaccard": _JACCARD_SQL,
    "combat_harmonise": _COMBAT_SQL,
    "regression_impute": _impute_sql(),
}
