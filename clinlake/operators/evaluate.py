"""Model evaluation on score tables: ROC/AUC, calibration, thresholds, fairness,
gates, conformal sets, interval metrics, kappa (SURVEY 2.17).

Input is a score table (group..., y, p).  Scores are first reduced to counts
per distinct score (map-side combined), and everything that needs an order
over scores uses the skew-safe prefix plan, so no task ever holds a whole
group.  Outputs are one row per group, per bin or per threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinlake.functions.exprs import hash_normal, hash_uniform, nan_to_null
from clinlake.plans.broadcast import bounded_broadcast
from clinlake.plans.prefix import bucket_column, running_sum
from clinlake.plans.quantile import exact_quantiles
from clinlake.session import checkpoint_dir


def _scored(df: DataFrame, p: str) -> DataFrame:
    """Rows with a score: a null or NaN score has no place in an order and is left out."""
    s = F.col(p).cast("double")
    return df.filter(s.isNotNull() & ~F.isnan(s))


def _score_counts(df: DataFrame, groups: Sequence[str], y: str, p: str) -> DataFrame:
    return _scored(df, p).groupBy(*groups, F.col(p).cast("double").alias("_s")).agg(
        F.count(F.when(F.col(y) == 1, 1)).alias("_pos"), F.count(F.when(F.col(y) == 0, 1)).alias("_neg"))


def roc_auc(df: DataFrame, groups: Sequence[str], y: str, p: str) -> DataFrame:
    """Mann-Whitney AUC per group with ties counted 1/2; a single class -> 0.5.
    Rows without a score (null or NaN) are left out; n_pos and n_neg count the rest.

    AUC = sum_s pos(s) * (neg(< s) + neg(s)/2) / (P * N).
    """
    g = list(groups)
    c = _score_counts(df, g, y, p)
    bkt = bucket_column(_scored(df, p).select(*g, F.col(p).cast("double").alias("_s")), g + ["_s"])
    return _auc_of_counts(c, g, bkt)


def _auc_of_counts(c: DataFrame, g: list[str], bkt: Column) -> DataFrame:
    """``roc_auc`` from score counts and the range bucket of (groups, score)."""
    cum = running_sum(c, g, ["_s"], ["_neg"], ["_neg_le"], bucket=bkt)
    term = F.col("_pos") * (F.col("_neg_le") - F.col("_neg") + F.col("_neg") * 0.5)
    agg = cum.groupBy(*g).agg(F.sum(term).alias("_u"), F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"))
    auc = F.when((F.col("n_pos") == 0) | (F.col("n_neg") == 0), F.lit(0.5)).otherwise(
        F.col("_u") / (F.col("n_pos") * F.col("n_neg")))
    return agg.select(*g, auc.alias("auc"), "n_pos", "n_neg")


def roc_points(df: DataFrame, groups: Sequence[str], y: str, p: str) -> DataFrame:
    """ROC points at each distinct score t: tpr = P(p >= t | y=1), fpr = P(p >= t | y=0);
    precision = tp / (tp + fp)."""
    g = list(groups)
    c = _score_counts(df, g, y, p).withColumn("_neg_s", -F.col("_s"))
    bkt = bucket_column(_scored(df, p).select(*g, (-F.col(p).cast("double")).alias("_neg_s")), g + ["_neg_s"])
    cum = running_sum(c, g, ["_neg_s"], ["_pos", "_neg"], ["tp", "fp"], bucket=bkt)
    tot = c.groupBy(*g).agg(F.sum("_pos").alias("_P"), F.sum("_neg").alias("_N"))
    j = cum.join(bounded_broadcast(tot), on=g, how="inner") if g else cum.crossJoin(bounded_broadcast(tot))
    return j.select(*g, F.col("_s").alias("threshold"), "tp", "fp",
                    (F.col("tp") / F.greatest(F.col("_P"), F.lit(1))).alias("tpr"),
                    (F.col("fp") / F.greatest(F.col("_N"), F.lit(1))).alias("fpr"),
                    (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def youden(df: DataFrame, groups: Sequence[str], y: str, p: str) -> DataFrame:
    """Threshold maximising tpr - fpr; ties go to the highest threshold (first on a
    decreasing-threshold curve)."""
    g = list(groups)
    pts = roc_points(df, g, y, p).withColumn("j", F.col("tpr") - F.col("fpr"))
    best = F.max_by(F.struct("threshold", "tpr", "fpr", "j"), F.struct("j", "threshold"))
    return pts.groupBy(*g).agg(best.alias("_b")).select(*g, "_b.threshold", "_b.tpr", "_b.fpr", "_b.j")


def average_precision(df: DataFrame, groups: Sequence[str], y: str, p: str) -> DataFrame:
    """AP = sum_k (R_k - R_{k-1}) P_k over decreasing distinct thresholds."""
    g = list(groups)
    pts = roc_points(df, g, y, p)
    c = _score_counts(df, g, y, p)
    j = pts.join(c.select(*g, F.col("_s").alias("threshold"), "_pos"), on=[*g, "threshold"])
    tot = c.groupBy(*g).agg(F.sum("_pos").alias("_P"))
    j = j.join(bounded_broadcast(tot), on=g) if g else j.crossJoin(bounded_broadcast(tot))
    term = F.col("_pos") / F.greatest(F.col("_P"), F.lit(1)) * F.col("precision")
    return j.groupBy(*g).agg(F.sum(term).alias("average_precision"))


def ece_edges(n_bins: int) -> list[float]:
    """NumPy ``linspace(0, 1, n_bins + 1)`` interior edges."""
    step = 1.0 / n_bins
    return [i * step for i in range(1, n_bins)]


def calibration_bins(df: DataFrame, y: str, p: str, n_bins: int = 15) -> DataFrame:
    """Reliability bins (half-open, last closed): count, mean confidence, accuracy."""
    edges = F.array(*[F.lit(e) for e in ece_edges(n_bins)])
    pc = F.col(p).cast("double")
    b = F.size(F.filter(edges, lambda e: e <= pc))
    binned = df.select(b.alias("bin"), pc.alias("_p"), F.col(y).cast("double").alias("_y"))
    stats = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("count"), F.avg("_p").alias("confidence"),
                                      F.avg("_y").alias("accuracy"))
    grid = df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    return (bounded_broadcast(grid).join(stats, "bin", "left")
            .select("bin", F.coalesce("count", F.lit(0)).alias("count"),
                    F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
                    F.coalesce("accuracy", F.lit(0.0)).alias("accuracy")))


def calibration_summary(df: DataFrame, y: str, p: str, n_bins: int = 15) -> DataFrame:
    """ECE = sum (n_b/N)|acc - conf|, MCE = max gap over non-empty bins, Brier = mean (p - y)^2."""
    bins = calibration_bins(df, y, p, n_bins)
    n = df.agg(F.count(F.lit(1)).alias("_n"),
               F.avg(F.pow(F.col(p).cast("double") - F.col(y).cast("double"), 2)).alias("brier"))
    gap = F.abs(F.col("accuracy") - F.col("confidence"))
    j = bins.crossJoin(bounded_broadcast(n))
    return j.groupBy().agg(F.sum(F.col("count") / F.col("_n") * gap).alias("ece"),
                           F.coalesce(F.max(F.when(F.col("count") > 0, gap)), F.lit(0.0)).alias("mce"),
                           F.max("brier").alias("brier"))


def confusion_metrics(df: DataFrame, groups: Sequence[str], y: str, y_hat: Column) -> DataFrame:
    """tp/fp/fn/tn and rates with max(den, 1) denominators, per group."""
    g = list(groups)
    yy, yh = F.col(y), y_hat
    agg = df.groupBy(*g).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((yh == 1) & (yy == 1)).alias("tp"), F.count_if((yh == 1) & (yy == 0)).alias("fp"),
        F.count_if((yh == 0) & (yy == 1)).alias("fn"), F.count_if((yh == 0) & (yy == 0)).alias("tn"),
        F.avg(yy.cast("double")).alias("prevalence"), F.avg(yh.cast("double")).alias("positive_rate"))

    def r(a, b):
        return F.col(a) / F.greatest(F.col(a) + F.col(b), F.lit(1))
    return agg.select(*g, "n", "tp", "fp", "fn", "tn", "prevalence", "positive_rate",
                      r("tp", "fn").alias("tpr"), r("fp", "tn").alias("fpr"),
                      r("tp", "fp").alias("ppv"), r("tn", "fn").alias("npv"))


def classification_metrics(df: DataFrame, y: str, p: str, threshold: float = 0.5, eps: float = 1e-15) -> DataFrame:
    """accuracy, precision, recall, specificity, F1, balanced accuracy, log loss (0 when undefined)."""
    yh = (F.col(p) >= threshold).cast("int")
    m = confusion_metrics(df, [], y, yh)
    pc = F.least(F.greatest(F.col(p).cast("double"), F.lit(eps)), F.lit(1 - eps))
    ll = df.agg(F.avg(-(F.col(y) * F.log(pc) + (1 - F.col(y)) * F.log(1 - pc))).alias("log_loss"))
    prec = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    rec = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    spec = F.when(F.col("tn") + F.col("fp") > 0, F.col("tn") / (F.col("tn") + F.col("fp"))).otherwise(0.0)
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    return m.crossJoin(ll).select(
        ((F.col("tp") + F.col("tn")) / F.col("n")).alias("accuracy"), prec.alias("precision"),
        rec.alias("recall"), spec.alias("specificity"), f1.alias("f1"),
        ((rec + spec) / 2).alias("balanced_accuracy"), "log_loss")


def threshold_grid(df: DataFrame, y: str, p: str, lo: float = 0.30, hi: float = 0.75, n: int = 46,
                   w_balanced: float = 0.6, w_accuracy: float = 0.4) -> DataFrame:
    """Grid search of a decision threshold scoring w_b * balanced accuracy + w_a * accuracy.

    Each score is mapped to its grid cell b = #{t_i <= s} in one pass (so
    s >= t_i exactly when i < b) and counted per cell: a table of at most
    n + 1 rows.  tp(i) and tn(i) are then sums over cells, a join of two
    tables bounded by the grid size.  First best (lowest threshold) wins.
    """
    spark = df.sparkSession
    step = (hi - lo) / (n - 1)
    ts = [lo + i * step for i in range(n)]
    arr = F.array(*[F.lit(t) for t in ts])
    sc = F.col(p).cast("double")
    cells = df.groupBy(F.size(F.filter(arr, lambda t: t <= sc)).alias("b")).agg(
        F.count(F.when(F.col(y) == 1, 1)).alias("pos"), F.count(F.when(F.col(y) == 0, 1)).alias("neg"))
    grid = spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "i int, t double")
    j = bounded_broadcast(grid).join(bounded_broadcast(cells), how="inner")  # <= n x (n + 1) rows
    per_t = j.groupBy("i", "t").agg(
        F.sum(F.when(F.col("b") > F.col("i"), F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("b") <= F.col("i"), F.col("neg")).otherwise(0)).alias("tn"),
        F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    tpr = F.when(F.col("P") > 0, F.col("tp") / F.col("P")).otherwise(0.0)
    tnr = F.when(F.col("N") > 0, F.col("tn") / F.col("N")).otherwise(0.0)
    acc = (F.col("tp") + F.col("tn")) / (F.col("P") + F.col("N"))
    bal = F.when((F.col("P") > 0) & (F.col("N") > 0), (tpr + tnr) / 2).otherwise(
        F.when(F.col("P") > 0, tpr).otherwise(tnr))
    scored = per_t.select("i", "t", (F.lit(w_balanced) * bal + F.lit(w_accuracy) * acc).alias("score"))
    best = F.max_by(F.struct("t", "score"), F.struct("score", -F.col("i")))
    return scored.groupBy().agg(best.alias("_b")).select(F.col("_b.t").alias("threshold"),
                                                         F.col("_b.score").alias("score"))


# Fairness parity bounds and age groups.
PARITY_LOWER, PARITY_UPPER = 0.80, 1.25
AGE_BINS = [0, 55, 65, 75, 85, 200]
AGE_LABELS = ["<55", "55-64", "65-74", "75-84", "85+"]


def age_group(age: str | Column) -> Column:
    a = F.col(age) if isinstance(age, str) else age
    out = None
    for lo, hi, lab in zip(AGE_BINS[:-1], AGE_BINS[1:], AGE_LABELS):
        cond = (a >= lo) & (a < hi)
        out = F.when(cond, lab) if out is None else out.when(cond, lab)
    return out.otherwise("nan")


def fairness_groups(df: DataFrame, attributes: Sequence[str], y: str, p: str, threshold: float = 0.5,
                    min_group: int = 10) -> DataFrame:
    """Per (attribute, group) metrics; groups with fewer than ``min_group`` rows dropped.

    Attributes are stacked with ``unpivot`` so all of them go through one
    grouped aggregate.
    """
    long = df.select(F.col(y).alias("_y"), F.col(p).cast("double").alias("_p"),
                     *[F.col(a).cast("string").alias(a) for a in attributes]) \
             .unpivot(["_y", "_p"], list(attributes), "attribute", "group")
    yh = (F.col("_p") >= threshold).cast("int")
    m = confusion_metrics(long, ["attribute", "group"], "_y", yh).filter(F.col("n") >= min_group)
    auc = roc_auc(long, ["attribute", "group"], "_y", "_p")
    return m.join(auc.select("attribute", "group", "auc"), ["attribute", "group"], "left")


def parity_ratio(c: str) -> Column:
    """min/max over non-zero values; fewer than two non-zero -> 1."""
    nz = F.when(F.col(c) > 0, F.col(c))
    return F.when(F.count(nz) < 2, F.lit(1.0)).otherwise(F.min(nz) / F.max(nz))


def fairness_summary(groups: DataFrame) -> DataFrame:
    """DPR, EOR and PPV ratios across all kept groups, plus max gaps and the parity check."""
    s = groups.agg(parity_ratio("positive_rate").alias("demographic_parity_ratio"),
                   parity_ratio("tpr").alias("equalized_odds_ratio"),
                   parity_ratio("ppv").alias("ppv_ratio"),
                   (F.max("tpr") - F.min("tpr")).alias("tpr_gap"),
                   (F.max("auc") - F.min("auc")).alias("auc_gap"),
                   F.count(F.lit(1)).alias("n_groups"))
    return s.withColumn("passes_parity", (F.col("equalized_odds_ratio") >= PARITY_LOWER) &
                        (F.col("equalized_odds_ratio") <= PARITY_UPPER))


# Promotion gates (name, kind, metric, comparison, threshold).
GATES = [
    ("auc_threshold", "hard", "auc", ">=", 0.92),
    ("fairness_equalized_odds_low", "hard", "equalized_odds_ratio", ">=", 0.80),
    ("fairness_equalized_odds_high", "hard", "equalized_odds_ratio", "<=", 1.25),
    ("calibration_ece", "soft", "ece", "<=", 0.05),
]


def gate_decision(metrics: DataFrame, gates=GATES) -> DataFrame:
    """metrics (metric, value) joined to the gate rule table -> per-gate result and
    the decision: any hard fail -> REJECT, else any soft warn -> HUMAN_REVIEW, else PROMOTE."""
    spark = metrics.sparkSession
    rules = spark.createDataFrame(list(gates), "gate string, kind string, metric string, op string, threshold double")
    j = bounded_broadcast(rules).join(metrics, "metric", "left")
    ok = (F.when(F.col("op") == ">=", F.col("value") >= F.col("threshold"))
          .when(F.col("op") == "<=", F.col("value") <= F.col("threshold")))
    res = F.when(F.coalesce(ok, F.lit(False)), "PASS").when(F.col("kind") == "hard", "HARD_FAIL").otherwise("SOFT_WARN")
    per = j.select("gate", "kind", "metric", "value", "threshold", res.alias("result"))
    summ = per.agg(F.count_if(F.col("result") == "HARD_FAIL").alias("hard_fails"),
                   F.count_if(F.col("result") == "SOFT_WARN").alias("soft_warns"))
    dec = (F.when(F.col("hard_fails") > 0, "REJECT").when(F.col("soft_warns") > 0, "HUMAN_REVIEW")
           .otherwise("PROMOTE"))
    return per.crossJoin(summ.select("hard_fails", "soft_warns", dec.alias("decision")))


def conformal_lac(calib: DataFrame, test: DataFrame, y: str, p: str, alphas: Sequence[float]) -> DataFrame:
    """Binary LAC conformal sets: s = 1 - p_true on calibration rows,
    qhat = the ceil((n+1)(1-a))-th smallest score (capped at the max), a class is in
    the set when 1 - p_class <= qhat; coverage and mean set size on test rows.
    Rows without a score or label are left out of both."""
    calib, test = (_scored(d, p).filter(F.col(y).isNotNull()) for d in (calib, test))
    sc = calib.select((F.lit(1.0) - F.when(F.col(y) == 1, F.col(p)).otherwise(1 - F.col(p))).alias("s"))
    n = sc.agg(F.count(F.lit(1)).alias("n"))
    rows = []
    for a in alphas:
        rows.append(F.struct(F.lit(float(a)).alias("alpha"),
                             F.least(F.ceil((F.col("n") + 1) * (1 - a)), F.col("n")).alias("k")))
    ks = n.select(F.explode(F.array(*rows)).alias("r")).select("r.alpha", "r.k")
    ranked = _kth_smallest(sc, ks)
    pt = F.col(p).cast("double")
    in1 = (F.lit(1.0) - pt) <= F.col("qhat")
    in0 = pt <= F.col("qhat")
    j = test.select(F.col(y).alias("_y"), pt.alias("_p")).crossJoin(bounded_broadcast(ranked))
    in1 = (F.lit(1.0) - F.col("_p")) <= F.col("qhat")
    in0 = F.col("_p") <= F.col("qhat")
    covered = F.when(F.col("_y") == 1, in1).otherwise(in0)
    return j.groupBy("alpha", "qhat").agg(F.avg(covered.cast("double")).alias("coverage"),
                                          F.avg(in1.cast("double") + in0.cast("double")).alias("mean_set_size"))


def _kth_smallest(scores: DataFrame, ks: DataFrame) -> DataFrame:
    """The k-th smallest score for each (alpha, k) via counts per distinct score and
    a skew-safe running count (no sort of the whole column in one task)."""
    c = scores.groupBy("s").agg(F.count(F.lit(1)).alias("_c"))
    cum = running_sum(c, [], ["s"], ["_c"], ["_cum"], bucket=bucket_column(scores, ["s"]))
    j = cum.crossJoin(bounded_broadcast(ks))
    hit = (F.col("_cum") - F.col("_c") < F.col("k")) & (F.col("_cum") >= F.col("k"))
    return j.filter(hit).select("alpha", F.col("s").alias("qhat"))


def interval_metrics(df: DataFrame, y: str, lower: str, upper: str, alpha: float,
                     q_lower: float, q_upper: float) -> DataFrame:
    """Coverage, mean width, Winkler score and pinball loss of the two bounds."""
    yy, lo, hi = F.col(y).cast("double"), F.col(lower).cast("double"), F.col(upper).cast("double")
    wink = (hi - lo) + F.when(yy < lo, (2.0 / alpha) * (lo - yy)).when(yy > hi, (2.0 / alpha) * (yy - hi)).otherwise(0.0)

    def pin(q, pred):
        d = yy - pred
        return F.greatest(F.lit(q) * d, F.lit(q - 1.0) * d)
    return df.agg(F.avg(((yy >= lo) & (yy <= hi)).cast("double")).alias("coverage"),
                  F.avg(hi - lo).alias("mean_width"), F.avg(wink).alias("winkler"),
                  F.avg(pin(q_lower, lo)).alias("pinball_lower"), F.avg(pin(q_upper, hi)).alias("pinball_upper"))


def quadratic_kappa(df: DataFrame, a: str, b: str, k: int = 5) -> DataFrame:
    """Quadratic weighted kappa of two integer ratings with k levels, in one pass.

    With w_ij = (i - j)^2 / (k - 1)^2, observed = sum (a - b)^2 and expected
    = sum_ij (i - j)^2 n_a(i) n_b(j) / N = S2a + S2b - 2 S1a S1b / N, so both
    come from first and second moments; no rating-pair table is formed.
    """
    x, z = F.col(a).cast("double"), F.col(b).cast("double")
    m = df.agg(F.sum(F.pow(x - z, 2)).alias("obs"), F.sum(x).alias("s1a"), F.sum(z).alias("s1b"),
               F.sum(x * x).alias("s2a"), F.sum(z * z).alias("s2b"), F.count(F.lit(1)).alias("n"))
    exp = F.col("s2a") + F.col("s2b") - F.lit(2.0) * F.col("s1a") * F.col("s1b") / F.col("n")
    return m.select((F.lit(1.0) - F.col("obs") / exp).alias("kappa"))


def brier_by_group(df: DataFrame, groups: Sequence[str], y: str, p: str) -> DataFrame:
    return df.groupBy(*groups).agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"))


def score_quantiles(df: DataFrame, groups: Sequence[str], p: str, probs: Sequence[float]) -> DataFrame:
    return exact_quantiles(df, groups, p, probs)


def _uniform(seed: int, *cols) -> Column:
    """Repeatable U(0,1) per row from a seeded hash of the given columns."""
    return hash_uniform(seed, *cols)


def robustness_suite(df: DataFrame, id_col: str, features: Sequence[str], label: str, score,
                     seed: int = 11, max_drop: float = 0.05) -> DataFrame:
    """Re-score under perturbations and report the AUC change per test.

    Tests: Gaussian noise (0.1 sd), 20 % dropout to the median, +0.5 sd
    covariate shift of each feature, 10 % label noise.  Perturbations are
    drawn from a hash of the row's id and the seed, so a rerun gives the same
    table under any partitioning; each test is one AUC over the whole table
    (distributed score counts).  The input and the score counts of all tests are
    computed once, in the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    df = df.select(*dict.fromkeys([id_col, *features, label])).checkpoint()
    stats = df.agg(*[F.stddev_pop(c).alias(f"_sd_{c}") for c in features])
    meds = None
    for c in features:
        m = exact_quantiles(df, [], c, [0.5], [f"_med_{c}"])
        meds = m if meds is None else meds.crossJoin(m)
    base = df.crossJoin(bounded_broadcast(stats)).crossJoin(bounded_broadcast(meds))
    x = {c: F.col(c) for c in features}
    tests = {"baseline": (score(x), F.col(label))}
    tests["gaussian_noise"] = (score({c: F.col(c) + hash_normal(seed + i, F.col(id_col)) * 0.1 * F.col(f"_sd_{c}")
                                      for i, c in enumerate(features)}), F.col(label))
    tests["dropout_to_median"] = (score({c: F.when(_uniform(seed + i, F.col(id_col)) < 0.2, F.col(f"_med_{c}"))
                                         .otherwise(F.col(c)) for i, c in enumerate(features)}), F.col(label))
    for c in features:
        tests[f"shift_{c}"] = (score({**x, c: F.col(c) + 0.5 * F.col(f"_sd_{c}")}), F.col(label))
    flip = _uniform(seed + 99, F.col(id_col)) < 0.1
    tests["label_noise"] = (score(x), F.when(flip, 1 - F.col(label)).otherwise(F.col(label)))
    long = base.select(F.explode(F.array(*[F.struct(F.lit(i).alias("_i"), s.alias("p"), y.alias("y"))
                                           for i, (s, y) in enumerate(tests.values())])).alias("t")).select("t.*")
    counts = _score_counts(long, ["_i"], "y", "p").checkpoint()
    name = F.element_at(F.array(*[F.lit(n) for n in tests]), F.col("_i") + 1)
    auc = _auc_of_counts(counts, ["_i"], bucket_column(counts, ["_i", "_s"])).withColumn("test", name).checkpoint()
    b = auc.filter(F.col("test") == "baseline").select(F.col("auc").alias("_base"))
    out = auc.crossJoin(bounded_broadcast(b)).withColumn("auc_drop", F.col("_base") - F.col("auc"))
    return out.select("test", "auc", "auc_drop", (F.col("auc_drop") <= max_drop).alias("passed"))


def per_class_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Per-class support, predictions, precision, recall and F1 from one
    (label, predicted) count table (at most classes^2 rows)."""
    c = df.groupBy(F.col(label).alias("_l"), F.col(predicted).alias("_p")).agg(F.count(F.lit(1)).alias("n"))
    sup = c.groupBy(F.col("_l").alias("class")).agg(F.sum("n").alias("support"))
    prd = c.groupBy(F.col("_p").alias("class")).agg(F.sum("n").alias("n_predicted"))
    tp = c.filter(F.col("_l") == F.col("_p")).select(F.col("_l").alias("class"), F.col("n").alias("tp"))
    j = sup.join(prd, "class", "full").join(tp, "class", "left").fillna(0, ["support", "n_predicted", "tp"])
    prec = F.when(F.col("n_predicted") > 0, F.col("tp") / F.col("n_predicted")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(F.col("tp") > 0, 2.0 * F.col("tp") / (F.col("support") + F.col("n_predicted"))).otherwise(0.0)
    return j.select("class", "support", "n_predicted", prec.alias("precision"), rec.alias("recall"), f1.alias("f1"))


def regression_metrics(df: DataFrame, groups: Sequence[str], y: str, pred: str, band: float) -> DataFrame:
    """RMSE, MAE and the share of truths within pred +- band, per group (horizon)."""
    d = F.col(y) - F.col(pred)
    return df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(d * d)).alias("rmse"),
                                   F.avg(F.abs(d)).alias("mae"),
                                   F.avg(((F.col(y) >= F.col(pred) - band) & (F.col(y) <= F.col(pred) + band))
                                         .cast("double")).alias("band_coverage"))


def attribution_stability(importance: DataFrame, replica: str, feature: str, value: str, top: int = 5) -> DataFrame:
    """Mean pairwise Jaccard of the top-``top`` feature sets across replicas.

    Intersections come from joining the top sets on the feature; replica pairs
    come from the replica list (bounded by the replica count)."""
    from pyspark.sql import Window
    w = Window.partitionBy(replica).orderBy(F.round(F.col(value), 9).desc(), F.col(feature))  # features per replica
    t = importance.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= top).select(replica, feature)
    a, b = t.alias("a"), t.alias("b")
    inter = a.join(b, (F.col(f"a.{feature}") == F.col(f"b.{feature}")) & (F.col(f"a.{replica}") < F.col(f"b.{replica}"))) \
             .groupBy(F.col(f"a.{replica}").alias("r1"), F.col(f"b.{replica}").alias("r2")).agg(F.count(F.lit(1)).alias("i"))
    reps = importance.select(replica).distinct()
    pairs = reps.alias("x").join(reps.alias("y"), F.col(f"x.{replica}") < F.col(f"y.{replica}")) \
                .select(F.col(f"x.{replica}").alias("r1"), F.col(f"y.{replica}").alias("r2"))
    j = pairs.join(inter, ["r1", "r2"], "left").fillna(0, ["i"])
    jac = F.col("i") / (F.lit(2 * top) - F.col("i"))
    return j.agg(F.count(F.lit(1)).alias("n_pairs"), F.avg(jac).alias("mean_jaccard"))


def concordance_index(df: DataFrame, y: str, p: str, levels: int | None = None) -> DataFrame:
    """Harrell's C without censoring: over pairs with different y, the share
    ordered the same way by p (ties in p count 1/2).

    Rows are reduced to counts per (y, p) level; concordant / discordant /
    tied pair counts come from joining that level table with itself on
    y_a < y_b, so no row pairs are formed.  With ``levels`` set, p is first cut
    into that many equal-width bins (exact when p has at most that many
    distinct values, approximate otherwise); the level table is bounded by
    distinct(y) x distinct(p)."""
    pc = F.col(p).cast("double")
    if levels is not None:
        rng = df.agg(F.min(p).alias("_lo"), F.max(p).alias("_hi"))
        from clinlake.functions.exprs import equal_width_bin
        df = df.crossJoin(bounded_broadcast(rng)).withColumn("_pl", equal_width_bin(p, "_lo", "_hi", levels))
        pc = F.col("_pl").cast("double")
    cells = df.groupBy(F.col(y).cast("double").alias("_y"), pc.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    a, b = cells.alias("a"), cells.alias("b")
    pairs = a.join(b, F.col("a._y") < F.col("b._y"))
    w = F.col("a._n") * F.col("b._n")
    agg = pairs.agg(F.sum(F.when(F.col("a._p") < F.col("b._p"), w).otherwise(0)).alias("concordant"),
                    F.sum(F.when(F.col("a._p") > F.col("b._p"), w).otherwise(0)).alias("discordant"),
                    F.sum(F.when(F.col("a._p") == F.col("b._p"), w).otherwise(0)).alias("tied"))
    total = F.col("concordant") + F.col("discordant") + F.col("tied")
    return agg.select("concordant", "discordant", "tied",
                      F.when(total > 0, (F.col("concordant") + 0.5 * F.col("tied")) / total).alias("c_index"))


def macro_auc_ovr(df: DataFrame, label: str, probability: str, classes: str) -> DataFrame:
    """(classes, macro_auc): the mean over the classes of the AUC of each against the rest.

    ``probability`` and ``classes`` are arrays in the same order; scores that agree to 12
    digits tie.  A class that does not occur (or is alone) counts 0.5."""
    each = df.select(F.col(label).alias("_l"), F.explode(F.arrays_zip(F.col(classes).alias("c"), F.col(probability).alias("p"))).alias("z"))
    rows = each.select(F.col("z.c").alias("c"), F.coalesce(F.col("_l") == F.col("z.c"), F.lit(False)).cast("int").alias("y"),
                       F.round("z.p", 12).alias("p"))
    return roc_auc(rows, ["c"], "y", "p").agg(F.count(F.lit(1)).alias("classes"), F.avg("auc").alias("macro_auc"))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function by a five-term rational approximation of
    the error function (absolute error under 1.5e-7)."""
    # The published coefficients of the approximation.
    rate, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    z = F.abs(x) / F.lit(2.0 ** 0.5)
    t = 1.0 / (1.0 + rate * z)
    poly = t * (a[0] + t * (a[1] + t * (a[2] + t * (a[3] + t * a[4]))))
    tail = 0.5 * poly * F.exp(-z * z)
    return F.when(x >= 0, 1.0 - tail).otherwise(tail)


def forecast_validation(df: DataFrame, y: str, median: str, cut: float = 60.0) -> DataFrame:
    """One row: C-statistic of the median forecast for outcomes above ``cut`` (0.5 with one
    class), sensitivity, specificity, PPV and NPV of a forecast above it, and the CRPS
    approximation: the mean distance of the normal distribution function at the error
    over the forecasts' deviation from one half.  Rows without either value are left out."""
    rows = df.select(nan_to_null(F.col(y).cast("double")).alias("y"), nan_to_null(F.col(median).cast("double")).alias("m")).dropna()
    flagged = rows.select("y", "m", (F.col("y") > cut).cast("int").alias("label"))
    auc = roc_auc(flagged, [], "label", "m").select(F.col("auc").alias("c_statistic"))
    rates = confusion_metrics(flagged, [], "label", (F.col("m") > cut).cast("int")).select(
        "n", F.col("tpr").alias("sensitivity"), (1 - F.col("fpr")).alias("specificity"), "ppv", "npv")
    sd = rows.agg(F.greatest(F.stddev_pop("m"), F.lit(1e-6)).alias("_sd"))
    crps = rows.crossJoin(bounded_broadcast(sd)).agg(
        F.avg(F.abs(normal_cdf((F.col("y") - F.col("m")) / F.col("_sd")) - 0.5)).alias("crps_approx"))
    return rates.crossJoin(bounded_broadcast(auc)).crossJoin(bounded_broadcast(crps))  # one row each
