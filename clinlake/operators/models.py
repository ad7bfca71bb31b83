"""Model pipelines and batch scoring.

A model is either an MLlib estimator fitted on a DataFrame or a linear-logistic
score given as a column expression, so scoring whole cohorts, perturbations
and counterfactuals stays JVM-side.  Per-row expansions (perturbations,
(feature, sign) pairs, grid trials) are bounded by parameters, never by data.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinlake.functions.exprs import clip, hash_normal, hash_uniform, nan_to_null, when_chain
from clinlake.plans.broadcast import bounded_broadcast

ScoreFn = Callable[[Mapping[str, Column]], Column]


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def linear_logistic(coefs: Mapping[str, float], intercept: float = 0.0) -> ScoreFn:
    """Score function sigmoid(b + sum w_i x_i) over named feature columns."""
    def score(x: Mapping[str, Column]) -> Column:
        z = F.lit(float(intercept))
        for c, w in coefs.items():
            z = z + F.lit(float(w)) * x[c]
        return sigmoid(z)
    return score


def weighted_fusion(df: DataFrame, prob_cols: Mapping[str, str], weights: Mapping[str, float],
                    default: float = 0.5, out: str = "fused_probability") -> DataFrame:
    """Late fusion over the available modalities: sum(w p) / sum(w) over
    non-null probabilities; plain mean when their weights sum to 0; default
    when no modality is available."""
    num = sum((F.coalesce(F.col(c) * F.lit(weights.get(m, 0.0)), F.lit(0.0)) for m, c in prob_cols.items()),
              F.lit(0.0))
    den = sum((F.when(F.col(c).isNotNull(), F.lit(weights.get(m, 0.0))).otherwise(0.0)
               for m, c in prob_cols.items()), F.lit(0.0))
    n = sum((F.col(c).isNotNull().cast("double") for c in prob_cols.values()), F.lit(0.0))
    s = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in prob_cols.values()), F.lit(0.0))
    fused = (F.when(n == 0, F.lit(default)).when(den == 0, s / n).otherwise(num / den))
    return df.withColumn(out, clip(fused, 0.0, 1.0))


def modality_contribution(long: DataFrame, model_col: str, prob_col: str,
                          model_modality: Mapping[str, str]) -> DataFrame:
    """Mean probability per modality through a (fixed) model -> modality map."""
    spark = long.sparkSession
    dim = spark.createDataFrame(sorted(model_modality.items()), f"{model_col} string, modality string")
    j = long.join(bounded_broadcast(dim), model_col)
    return j.groupBy("modality").agg(F.avg(prob_col).alias("mean_probability"),
                                     F.count(prob_col).alias("n_predictions"))


def counterfactuals(df: DataFrame, id_cols: Sequence[str], features: Sequence[str], score: ScoreFn,
                    delta: float = 0.5, min_gain: float = 0.01, k: int = 5) -> DataFrame:
    """One-at-a-time counterfactuals: every feature shifted by -delta and +delta,
    re-scored; changes lowering the risk by more than ``min_gain`` kept, best
    ``k`` per row (most negative change first).  Each row expands to
    2 x len(features) candidates (bounded by the feature list)."""
    base = score({c: F.col(c) for c in features})
    cands = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(sg).alias("sign"))
                      for c in features for sg in (-1.0, 1.0)])
    ex = df.select(*id_cols, *features, base.alias("_p0"), F.explode(cands).alias("_c"))
    mod = {c: F.col(c) + F.when(F.col("_c.feature") == c, F.col("_c.sign") * delta).otherwise(0.0) for c in features}
    ex = ex.withColumn("risk_delta", score(mod) - F.col("_p0"))
    cur = F.element_at(F.array(*[F.col(c) for c in features]),
                       F.array_position(F.array(*[F.lit(c) for c in features]), F.col("_c.feature")).cast("int"))
    kept = ex.filter(F.col("risk_delta") < -min_gain).select(
        *id_cols, F.col("_c.feature").alias("feature"),
        F.when(F.col("_c.sign") < 0, "decrease").otherwise("increase").alias("direction"),
        cur.alias("current_value"), (cur + F.col("_c.sign") * delta).alias("target_value"), "risk_delta")
    w = Window.partitionBy(*id_cols).orderBy("risk_delta", "feature", "direction")  # <= 2F rows per id
    return kept.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def minmax_normalise(df: DataFrame, columns: Sequence[str], suffix: str = "_norm") -> DataFrame:
    """(x - min)/(max - min) with a zero range -> 1, clipped to 0..1 (one aggregate)."""
    st = df.agg(*[e for c in columns for e in (F.min(c).alias(f"_mn_{c}"), F.max(c).alias(f"_mx_{c}"))])
    j = df.crossJoin(bounded_broadcast(st))
    outs = {}
    for c in columns:
        rng = F.col(f"_mx_{c}") - F.col(f"_mn_{c}")
        outs[f"{c}{suffix}"] = clip((F.col(c) - F.col(f"_mn_{c}")) / F.when(rng == 0, 1.0).otherwise(rng), 0.0, 1.0)
    return j.withColumns(outs).drop(*[f"_{p}_{c}" for c in columns for p in ("mn", "mx")])


def intervention_scores(df: DataFrame, columns: Sequence[str], incoming: Mapping[str, float], variable: str,
                        new_value: float) -> DataFrame:
    """Closed-form intervention: risk = sigmoid(w . x_norm) before and after setting
    ``variable`` (normalised) to ``new_value``; absolute and relative reduction."""
    n = minmax_normalise(df, columns)
    z0 = sum((F.lit(float(incoming.get(c, 0.0))) * F.col(f"{c}_norm") for c in columns), F.lit(0.0))
    nv = min(max(new_value, 0.0), 1.0)
    z1 = z0 - F.lit(float(incoming.get(variable, 0.0))) * F.col(f"{variable}_norm") + \
        F.lit(float(incoming.get(variable, 0.0)) * nv)
    r0, r1 = sigmoid(z0), sigmoid(z1)
    red = F.greatest(r0 - r1, F.lit(0.0))
    return n.select("*", r0.alias("original_risk"), r1.alias("intervened_risk"), red.alias("absolute_reduction"),
                    (red / F.greatest(r0, F.lit(1e-6)) * 100.0).alias("relative_reduction_pct"))


def what_if(df: DataFrame, features: Sequence[str], score: ScoreFn, column: str, factor: float) -> DataFrame:
    """Scale one biomarker by (1 - factor) and score before / after."""
    before = score({c: F.col(c) for c in features})
    after = score({c: (F.col(c) * (1.0 - factor) if c == column else F.col(c)) for c in features})
    return df.select("*", before.alias("risk_before"), after.alias("risk_after"),
                     (after - before).alias("risk_change"))


# Months of the curve, and the regimes by starting risk: lower
# bound of the start, level that the curve tends to, half width of its band.
TRAJECTORY_MONTHS = [6.0, 12.0, 18.0, 24.0, 30.0, 36.0]
TRAJECTORY_REGIMES = [(0.7, 0.95, 0.04), (0.4, 0.82, 0.06), (0.0, 0.58, 0.08)]
# Speed per half year and order of the three growth curves.
SATURATION_SPEED, LOGISTIC_SPEED, LOGISTIC_SHIFT, LOGISTIC_BASE = 0.09, 0.9, 3.0, 0.8
POWER, POWER_BASE, POWER_GAIN = 1.2, 0.4, 0.6
# Best score and weight of each impairment scale.
IMPAIRMENT_SCALES = [(30.0, 0.45), (10.0, 0.3), (10.0, 0.25)]


def trajectory(p0: Column, rate: Column) -> Column:
    """Risk over 6..36 months as an array of structs (month, risk, lower, upper).

    One rule for all regimes: the start moves towards its regime's level by the
    share that the regime's growth curve has covered at that month."""
    start = clip(p0, 0.01, 0.99)
    bounds = [bound for bound, _, _ in TRAJECTORY_REGIMES[:-1]]
    pick = lambda values: when_chain([(start > bound, x) for bound, x in zip(bounds, values)], values[-1])
    level = pick([F.lit(x) for _, x, _ in TRAJECTORY_REGIMES])
    band = pick([F.lit(x) for _, _, x in TRAJECTORY_REGIMES])

    def covered(month: Column) -> Column:
        half_years, share = month / TRAJECTORY_MONTHS[0], month / TRAJECTORY_MONTHS[-1]
        return pick([
            F.lit(1.0) - F.exp((rate + 1.0) * half_years * -SATURATION_SPEED),
            F.lit(1.0) / (F.exp((rate + LOGISTIC_BASE) * (F.lit(LOGISTIC_SHIFT) - half_years) * LOGISTIC_SPEED) + 1.0),
            (rate * POWER_GAIN + POWER_BASE) * F.pow(share, F.lit(POWER))])

    at = F.transform(F.array(*[F.lit(m) for m in TRAJECTORY_MONTHS]), lambda m: F.struct(
        m.alias("month"), clip(start + (level - start) * covered(m), 0.01, 0.98).alias("risk")))
    return F.transform(at, lambda x: F.struct(
        x["month"].alias("month"), x["risk"].alias("risk"), clip(x["risk"] - band, 0.0, 1.0).alias("lower"),
        clip(x["risk"] + band, 0.0, 1.0).alias("upper")))


def impairment_rate(mmse: Column, functional: Column, adl: Column) -> Column:
    """Weighted mean shortfall from the best score of each scale."""
    return sum((clip((best - score) / best, 0.0, 1.0) * weight
                for score, (best, weight) in zip((mmse, functional, adl), IMPAIRMENT_SCALES)), F.lit(0.0))


def class_weights(df: DataFrame, label: str, costs: Mapping[str, float], default: float = 1.0,
                  out: str = "weight") -> DataFrame:
    """Sample weights by class cost through a fixed map."""
    m = F.create_map(*[x for k, v in costs.items() for x in (F.lit(k), F.lit(float(v)))])
    return df.withColumn(out, F.coalesce(F.try_element_at(m, F.col(label).cast("string")), F.lit(default)))


def time_split(df: DataFrame, date_col: str, val_start, test_start, out: str = "split") -> DataFrame:
    d = F.col(date_col)
    return df.withColumn(out, F.when(d < F.lit(val_start), "train").when(d < F.lit(test_start), "validation")
                         .otherwise("test"))


def uncertainty_mean(bounds: Sequence[str]) -> Column:
    """Mean of the available (non-null) bounds; null when none."""
    s = sum((F.coalesce(nan_to_null(F.col(b)), F.lit(0.0)) for b in bounds), F.lit(0.0))
    n = sum((nan_to_null(F.col(b)).isNotNull().cast("double") for b in bounds), F.lit(0.0))
    return F.when(n > 0, s / n)


def fold_column(id_col: str, k: int, seed: int = 42) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(k)).cast("int")


def _assemble(df: DataFrame, features: Sequence[str]):
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep").transform(
        df.fillna(0.0, subset=list(features)))


def stacking_oof(df: DataFrame, id_col: str, features: Sequence[str], label: str, k: int = 5,
                 seed: int = 42) -> DataFrame:
    """Out-of-fold stacking: per fold, a logistic regression and a random forest are
    fitted on the other folds (MLlib, distributed) and score the held-out fold;
    a logistic meta-learner is fitted on the out-of-fold probabilities."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.functions import vector_to_array
    base = _assemble(df.withColumn("_fold", fold_column(id_col, k, seed)), features) \
        .withColumn("_y", F.col(label).cast("double"))
    oof = None
    for f in range(k):
        train, hold = base.filter(F.col("_fold") != f), base.filter(F.col("_fold") == f)
        lr = LogisticRegression(featuresCol="_features", labelCol="_y", maxIter=50).fit(train)
        rf = RandomForestClassifier(featuresCol="_features", labelCol="_y", numTrees=20, maxDepth=5,
                                    seed=seed).fit(train)
        drop = ["rawPrediction", "probability", "prediction"]
        one = lr.transform(hold).withColumn("p_lr", vector_to_array("probability")[1]).drop(*drop)
        part = rf.transform(one).select(id_col, "_y", "p_lr", vector_to_array("probability")[1].alias("p_rf"))
        oof = part if oof is None else oof.unionByName(part)
    meta_in = _assemble(oof, ["p_lr", "p_rf"])
    meta = LogisticRegression(featuresCol="_features", labelCol="_y", maxIter=50).fit(meta_in)
    return meta.transform(meta_in).select(id_col, "p_lr", "p_rf",
                                          vector_to_array("probability")[1].alias("p_stack"),
                                          F.col("_y").alias("label"))


def multiclass_classifier(df: DataFrame, vector: str, label: str, fits: Column, trees: int = 30, depth: int = 6,
                          seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(scored, importance).  Softmax regression and a random forest, each row weighted by
    n / (classes * n of its class), fitted on the rows where ``fits`` holds; ``scored`` is
    ``df`` with classes (the labels in order), probability (the models' mean, one per
    class) and predicted.  ``importance`` (dimension, importance, rank) is the mean of the
    models' normalised importances (the softmax's: mean absolute coefficient).

    The number of classes is counted on the fitted rows; rows without a label are scored
    too, rows without a vector are left out."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    rows = df.filter(F.col(vector).isNotNull()).withColumn("_x", array_to_vector(F.col(vector).cast("array<double>")))
    train = rows.filter(fits & F.col(label).isNotNull())
    sizes = {r[label]: r["n"] for r in train.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a class
    names = sorted(sizes)
    number = F.create_map(*[F.lit(x) for i, c in enumerate(names) for x in (c, float(i))])
    weight = F.create_map(*[F.lit(x) for c, n in sizes.items() for x in (c, sum(sizes.values()) / len(sizes) / n)])
    train = train.select("_x", F.element_at(number, F.col(label)).alias("_y"), F.element_at(weight, F.col(label)).alias("_w"))
    softmax = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", family="multinomial", maxIter=60,
                                 regParam=1e-3).fit(train)
    forest = RandomForestClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", numTrees=trees, maxDepth=depth,
                                    seed=seed).fit(train)
    drop = ["rawPrediction", "prediction", "probability"]
    scored = softmax.transform(rows).withColumn("_a", vector_to_array("probability")).drop(*drop)
    scored = forest.transform(scored).withColumn("_b", vector_to_array("probability")).drop(*drop)
    classes = F.array(*map(F.lit, names))
    mean = renormalise(F.zip_with("_a", "_b", lambda a, b: (a + b) / 2))
    scored = scored.select(*df.columns, classes.alias("classes"), mean.alias("probability"))
    scored = scored.withColumn("predicted", F.element_at("classes", F.array_position(
        "probability", F.array_max("probability")).cast("int")))
    slope = np.abs(softmax.coefficientMatrix.toArray()).mean(axis=0)
    gain = forest.featureImportances.toArray()
    share = (slope / max(slope.sum(), 1e-300) + gain / max(gain.sum(), 1e-300)) / 2
    order = np.argsort(-share, kind="stable")
    importance = df.sparkSession.createDataFrame([(int(i), float(share[i]), r) for r, i in enumerate(order, 1)],
                                                 "dimension int, importance double, rank int")
    return scored, importance


def renormalise(probs: Column) -> Column:
    """Divide an array of class probabilities by its sum (rows sum to 1)."""
    total = F.aggregate(probs, F.lit(0.0), lambda a, v: a + v)
    return F.transform(probs, lambda v: F.when(total > 0, v / total).otherwise(v))


def adjusted_effect(df: DataFrame, outcome: str, treatment: str, confounders: Sequence[str]) -> float:
    """Backdoor-adjusted linear effect: the treatment coefficient of an MLlib OLS
    of the outcome on treatment + common causes (one number)."""
    from pyspark.ml.regression import LinearRegression
    x = _assemble(df, [treatment, *confounders]).withColumn("_y", F.col(outcome).cast("double"))
    m = LinearRegression(featuresCol="_features", labelCol="_y", regParam=0.0, solver="normal").fit(x)
    return float(m.coefficients[0])


def poisson_limits() -> list[float]:
    """Upper ends of the uniforms that give 0 to 17 of a Poisson(1)."""
    limits, upto, term = [], 0.0, float(np.exp(-1.0))
    for k in range(18):
        upto += term
        limits.append(upto)
        term /= k + 1
    return limits


def poisson_one(u: Column) -> Column:
    """Poisson(1) by inverse CDF of a uniform (up to 18, beyond which a double has no mass left)."""
    return when_chain([(u < upto, k) for k, upto in enumerate(poisson_limits())], 18)


def local_surrogate(df: DataFrame, id_col: str, features: Sequence[str], score: ScoreFn, n_perturb: int = 200,
                    sigma: float = 0.3, alpha: float = 1.0, seed: int = 42, top: int = 10) -> DataFrame:
    """Local surrogate attribution per row: ``n_perturb`` Gaussian perturbations
    (a hash of the row's id, repeat and seed), scored with the model expression, kernel-weighted
    (width sqrt(F) * 0.75), and a weighted ridge fitted per row from its normal equations:
    grouped sums, added up where the perturbations are made (n_perturb + 1 a row), then
    solved for many rows at a time."""
    nf = len(features)
    width = np.sqrt(nf) * 0.75
    ex = df.select(id_col, *features, F.explode(F.sequence(F.lit(0), F.lit(n_perturb))).alias("_i"))
    noise = {c: F.when(F.col("_i") == 0, F.lit(0.0)).otherwise(hash_normal(seed + j, F.col(id_col), F.col("_i")) * sigma) for j, c in enumerate(features)}
    ex = ex.withColumns({f"_d_{c}": v for c, v in noise.items()})
    ex = ex.withColumn("_p", score({c: F.col(c) + F.col(f"_d_{c}") for c in features}))
    dist2 = sum((F.col(f"_d_{c}") * F.col(f"_d_{c}") for c in features), F.lit(0.0))
    ex = ex.withColumn("_w", F.when(F.col("_i") == 0, 1.0).otherwise(F.exp(-dist2 / (2 * width * width))))
    d = [F.col(f"_d_{c}") for c in features]
    idt = df.schema[id_col].dataType.simpleString()
    w, p = F.col("_w"), F.coalesce("_p", F.lit(float("nan")))  # no score: no weights either
    upper = [(i, j) for i in range(nf) for j in range(i, nf)]
    sums = ex.groupBy(id_col).agg(
        F.array(F.sum(w), F.sum(w * p), *[F.sum(w * x) for x in d], *[F.sum(w * x * p) for x in d],
                *[F.sum(w * d[i] * d[j]) for i, j in upper]).alias("_s"))

    def fit(frames):
        for pdf in frames:
            if not len(pdf):
                continue
            s = np.array(pdf["_s"].tolist(), dtype=float)
            sw, wx = s[:, :1], s[:, 2:2 + nf]
            a = np.empty((len(s), nf, nf))
            for k, (i, j) in enumerate(upper):
                a[:, i, j] = a[:, j, i] = s[:, 2 + 2 * nf + k] - wx[:, i] * wx[:, j] / sw[:, 0]
            b = s[:, 2 + nf:2 + 2 * nf] - wx * s[:, 1:2] / sw
            coef = np.linalg.solve(a + alpha * np.eye(nf), b[:, :, None])[:, :, 0]
            order = np.argsort(-np.abs(coef), axis=1, kind="stable")[:, :top]
            n = order.shape[1]
            yield pd.DataFrame({id_col: pdf[id_col].repeat(n).array, "feature": np.array(features, dtype=object)[order].ravel(),
                                "weight": np.take_along_axis(coef, order, 1).ravel(), "rank": np.tile(np.arange(1, n + 1), len(s))})

    return sums.mapInPandas(fit, f"{id_col} {idt}, feature string, weight double, rank long")


def weight_grid(n_modalities: int, step: float) -> list[tuple[float, ...]]:
    """All weight vectors on a simplex grid (weights multiples of ``step`` summing to 1)."""
    k = int(round(1 / step))
    out = []

    def rec(prefix, left, slots):
        if slots == 1:
            out.append(tuple(prefix + [left * step]))
            return
        for i in range(left + 1):
            rec(prefix + [i * step], left - i, slots - 1)
    rec([], k, n_modalities)
    return out


def fusion_weight_search(df: DataFrame, label: str, prob_cols: Sequence[str], fold: str, step: float = 0.25) -> DataFrame:
    """Score every weight vector of the grid on every fold by AUC; mean AUC per trial.

    Rows are expanded by the (fixed, parameter-bounded) trial list and the AUC
    is the distributed rank-count AUC grouped by (trial, fold)."""
    from clinlake.operators.evaluate import roc_auc
    trials = weight_grid(len(prob_cols), step)
    arr = F.array(*[F.struct(F.lit(i).alias("trial"), *[F.lit(float(w)).alias(f"w{j}") for j, w in enumerate(ws)])
                    for i, ws in enumerate(trials)])
    ex = df.select(F.col(label).alias("_y"), F.col(fold).alias("fold"), *prob_cols, F.explode(arr).alias("_t"))
    fused = sum((F.col(f"_t.w{j}") * F.col(c) for j, c in enumerate(prob_cols)), F.lit(0.0))
    scored = ex.select("_y", "fold", F.col("_t.trial").alias("trial"), fused.alias("_p"))
    auc = roc_auc(scored, ["trial", "fold"], "_y", "_p")
    per = auc.groupBy("trial").agg(F.avg("auc").alias("mean_auc"))
    spark = df.sparkSession
    dim = spark.createDataFrame([(i, *map(float, ws)) for i, ws in enumerate(trials)],
                                "trial int, " + ", ".join(f"w_{c} double" for c in prob_cols))
    best = per.agg(F.max_by("trial", F.struct(F.round("mean_auc", 12), -F.col("trial"))).alias("_best"))
    return per.join(bounded_broadcast(dim), "trial").crossJoin(bounded_broadcast(best)) \
              .withColumn("is_best", F.col("trial") == F.col("_best")).drop("_best")


def array_variance(a: Column) -> Column:
    """Population variance of the values of an array (null for an empty array)."""
    n = F.size(a).cast("double")
    mean = F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v) / n
    ss = F.aggregate(a, F.lit(0.0), lambda acc, v: acc + (v - mean) * (v - mean))
    return F.when(n > 0, ss / n)


def correlation_long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson matrix with MLlib ``Correlation`` over assembled rows (rows with a
    missing value dropped), returned as (feature_i, feature_j, r) rows."""
    from pyspark.ml.stat import Correlation
    x = _assemble(df.dropna(subset=list(columns)), columns)
    m = Correlation.corr(x, "_features", "pearson").head()[0].toArray()  # F x F, bounded by the columns
    spark = df.sparkSession
    rows = [(a, b, float(round(m[i][j], 6))) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return spark.createDataFrame(rows, "feature_i string, feature_j string, r double")


# The linear disease scores.  (feature, kind, reference, span, weight): "above" and
# "below" are the distance beyond the reference over the span, "flag" the value itself.
RULE_DEFAULTS = {"Age": 70.0, "MMSE": 25.0, "FunctionalAssessment": 6.0, "ADL": 6.0, "MemoryComplaints": 0.0,
                 "FamilyHistoryAlzheimers": 0.0, "Depression": 0.0, "SleepQuality": 5.0, "PhysicalActivity": 5.0,
                 "BehavioralProblems": 0.0}
RULE_SCORES = {
    "Alzheimer's Disease": [("Age", "above", 60, 40, 0.25), ("MMSE", "below", 30, 30, 0.35), ("MemoryComplaints", "flag", 0, 1, 0.20),
                            ("FamilyHistoryAlzheimers", "flag", 0, 1, 0.15), ("FunctionalAssessment", "below", 10, 10, 0.05)],
    "Parkinson's Disease": [("Age", "above", 55, 45, 0.20), ("MMSE", "below", 30, 30, 0.15), ("Depression", "flag", 0, 1, 0.20),
                            ("PhysicalActivity", "below", 10, 10, 0.25), ("SleepQuality", "below", 10, 10, 0.20)],
    "Multiple Sclerosis": [("Age", "below", 60, 60, 0.35), ("Depression", "flag", 0, 1, 0.20), ("FunctionalAssessment", "below", 10, 10, 0.20),
                           ("SleepQuality", "below", 10, 10, 0.15), ("BehavioralProblems", "flag", 0, 1, 0.10)],
    "Epilepsy": [("Age", "below", 55, 55, 0.30), ("SleepQuality", "below", 10, 10, 0.30), ("Depression", "flag", 0, 1, 0.15),
                 ("BehavioralProblems", "flag", 0, 1, 0.15), ("PhysicalActivity", "below", 10, 10, 0.10)],
    "ALS": [("Age", "above", 45, 55, 0.15), ("FunctionalAssessment", "below", 10, 10, 0.35), ("ADL", "below", 10, 10, 0.35),
            ("PhysicalActivity", "below", 10, 10, 0.15)],
    "Huntington's Disease": [("Age", "above", 30, 50, 0.15), ("MemoryComplaints", "flag", 0, 1, 0.25), ("BehavioralProblems", "flag", 0, 1, 0.25),
                             ("MMSE", "below", 30, 30, 0.20), ("Depression", "flag", 0, 1, 0.15)],
}


def rule_labels(df: DataFrame, noise_key: Sequence[str] = (), noise: float = 0.05, seed: int = 42) -> DataFrame:
    """``df`` with rule_score (the highest of the linear disease scores) and rule_label (its
    disease; of equal scores the first).  Absent columns and missing values take the default (a
    NaN comes back as null).
    With ``noise_key`` every score gets a uniform draw under ``noise``, a hash of those columns."""
    def value(f: str) -> Column:
        given = nan_to_null(F.col(f).cast("double")) if f in df.columns else F.lit(None).cast("double")
        return F.coalesce(given, F.lit(RULE_DEFAULTS[f]))

    def term(f: str, kind: str, base: float, span: float, weight: float) -> Column:
        beyond = {"above": value(f) - base, "below": base - value(f)}.get(kind)
        return (value(f) if beyond is None else F.greatest(beyond, F.lit(0.0)) / span) * weight
    scores = []
    for i, (disease, terms) in enumerate(RULE_SCORES.items()):
        total = sum((term(*t) for t in terms[1:]), term(*terms[0]))
        if noise_key:
            total = total + hash_uniform(seed + i, *[F.col(c) for c in noise_key]) * noise
        scores.append(F.struct(total.alias("score"), F.lit(-i).alias("place"), F.lit(disease).alias("disease")))
    best = F.array_max(F.array(*scores))
    given = [nan_to_null(F.col(c)).alias(c) if c in RULE_DEFAULTS and t in ("double", "float") else c for c, t in df.dtypes]
    return df.withColumn("_b", best).select(*given, F.col("_b.score").alias("rule_score"), F.col("_b.disease").alias("rule_label"))
