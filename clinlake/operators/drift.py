"""Distribution drift: PSI (three smoothings), KS two-sample, mean shift, severity.

Input is a long table (feature, side, value) with side in {'ref', 'cur'}
(see ``profile.to_long``).  Every statistic is a grouped aggregate; the only
per-feature tables are one row per feature or per (feature, bin).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinlake.plans.broadcast import bounded_broadcast
from clinlake.plans.prefix import bucket_column, running_sum

# PSI severity tiers and thresholds.
PSI_MINOR, PSI_WARNING, PSI_CRITICAL = 0.10, 0.20, 0.25
SEVERITY_RANK = {"NO_DRIFT": 0, "MINOR": 1, "WARNING": 2, "CRITICAL": 3}
MEAN_SHIFT_THRESHOLD = 0.15
PREDICTION_PSI_ALERT = 0.25


PSI_MODES = ("smoothed", "widened", "prediction")


def psi_modes(long: DataFrame, modes=PSI_MODES, n_bins: int = 10, min_n: int = 10) -> DataFrame:
    """PSI per feature between side 'ref' and side 'cur', for several smoothings in one pass.

    mode 'smoothed': bins over the joint [min, max]; pct = (c + 1e-6)/(N + 1e-6 n);
        either side with fewer than ``min_n`` values -> 0.
    mode 'widened': bins over [min - 1e-8, max + 1e-8]; pct = c/max(N,1) + 1e-8.
    mode 'prediction': bins over [min, max]; pct = c/max(N,1); log((cur+1e-8)/(ref+1e-8)).
    The result is floored at 0 for 'smoothed' and 'widened'.

    One range aggregate, then one grouped count per (feature, plain bin,
    widened bin) serves every mode; the rest works on (feature x bin) rows.
    """
    v = long.dropna(subset=["value"])
    rng = v.groupBy("feature").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.count(F.when(F.col("side") == "ref", 1)).alias("n_ref"),
        F.count(F.when(F.col("side") == "cur", 1)).alias("n_cur"))

    def bin_of(lo: Column, hi: Column) -> Column:
        width = (hi - lo) / F.lit(n_bins)
        raw = F.floor(F.try_divide(F.col("value") - lo, F.nullif(width, F.lit(0.0))))
        return F.coalesce(F.least(F.greatest(raw, F.lit(0)), F.lit(n_bins - 1)), F.lit(0)).cast("int")

    binned = v.join(bounded_broadcast(rng.select("feature", "lo", "hi")), "feature").select(
        "feature", "side", bin_of(F.col("lo"), F.col("hi")).alias("b_plain"),
        bin_of(F.col("lo") - F.lit(1e-8), F.col("hi") + F.lit(1e-8)).alias("b_wide"))
    counts = binned.groupBy("feature", "b_plain", "b_wide").agg(
        F.count(F.when(F.col("side") == "ref", 1)).alias("c_ref"),
        F.count(F.when(F.col("side") == "cur", 1)).alias("c_cur"))
    grid = rng.select("feature", "n_ref", "n_cur", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    out = rng.select("feature", "n_ref", "n_cur")
    for mode in modes:
        bcol = "b_wide" if mode == "widened" else "b_plain"
        per = counts.groupBy("feature", F.col(bcol).alias("bin")).agg(F.sum("c_ref").alias("c_ref"),
                                                                      F.sum("c_cur").alias("c_cur"))
        g = grid.join(per, ["feature", "bin"], "left").fillna(0, ["c_ref", "c_cur"])
        cr, cc = F.col("c_ref").cast("double"), F.col("c_cur").cast("double")
        nr, nc = F.col("n_ref").cast("double"), F.col("n_cur").cast("double")
        if mode == "smoothed":
            eps = F.lit(1e-6)
            e = (cr + eps) / (nr + eps * n_bins)
            a = (cc + eps) / (nc + eps * n_bins)
            term = (a - e) * F.log(a / e)
        elif mode == "widened":
            e = cr / F.greatest(nr, F.lit(1.0)) + F.lit(1e-8)
            a = cc / F.greatest(nc, F.lit(1.0)) + F.lit(1e-8)
            term = (a - e) * F.log(a / e)
        elif mode == "prediction":
            e = cr / F.greatest(nr, F.lit(1.0))
            a = cc / F.greatest(nc, F.lit(1.0))
            term = (a - e) * F.log((a + F.lit(1e-8)) / (e + F.lit(1e-8)))
        else:
            raise ValueError(mode)
        agg = g.groupBy("feature").agg(F.sum(term).alias(f"psi_{mode}"))
        out = out.join(agg, "feature")
        val = F.col(f"psi_{mode}")
        if mode in ("smoothed", "widened"):
            val = F.greatest(val, F.lit(0.0))
        if mode == "smoothed":
            val = F.when((F.col("n_ref") < min_n) | (F.col("n_cur") < min_n), F.lit(0.0)).otherwise(val)
        out = out.withColumn(f"psi_{mode}", val)
    return out.drop("n_ref", "n_cur")


def psi(long: DataFrame, mode: str = "smoothed", n_bins: int = 10, min_n: int = 10) -> DataFrame:
    """PSI in one smoothing mode (see ``psi_modes``)."""
    return psi_modes(long, (mode,), n_bins, min_n).withColumnRenamed(f"psi_{mode}", "psi")


def severity(p: str | Column) -> Column:
    p = F.col(p) if isinstance(p, str) else p
    return (F.when(p >= PSI_CRITICAL, "CRITICAL").when(p >= PSI_WARNING, "WARNING")
            .when(p >= PSI_MINOR, "MINOR").otherwise("NO_DRIFT"))


def drift_report(long: DataFrame, n_bins: int = 10) -> DataFrame:
    """Per-feature PSI (widened bins), severity and the overall (worst) severity."""
    p = psi(long, "widened", n_bins).withColumn("severity", severity("psi"))
    rank = F.create_map(*[x for k, r in SEVERITY_RANK.items() for x in (F.lit(k), F.lit(r))])
    p = p.withColumn("_rank", F.try_element_at(rank, F.col("severity")))
    worst = p.agg(F.max("_rank").alias("_worst"))
    inv = F.create_map(*[x for k, r in SEVERITY_RANK.items() for x in (F.lit(r), F.lit(k))])
    return (p.crossJoin(bounded_broadcast(worst))
            .withColumn("overall_severity", F.try_element_at(inv, F.col("_worst")))
            .drop("_rank", "_worst"))


def mean_shift(long: DataFrame, threshold: float = MEAN_SHIFT_THRESHOLD) -> DataFrame:
    """|mean_ref - mean_cur| / (sd_pop_ref + 1e-6) per feature and a drifted flag."""
    v = long.dropna(subset=["value"])
    s = v.groupBy("feature").agg(
        F.avg(F.when(F.col("side") == "ref", F.col("value"))).alias("m_ref"),
        F.avg(F.when(F.col("side") == "cur", F.col("value"))).alias("m_cur"),
        F.stddev_pop(F.when(F.col("side") == "ref", F.col("value"))).alias("sd_ref"))
    score = F.abs(F.col("m_ref") - F.col("m_cur")) / (F.col("sd_ref") + F.lit(1e-6))
    score = F.when(F.col("m_ref").isNull() | F.col("m_cur").isNull(), F.lit(0.0)).otherwise(score)
    return s.select("feature", score.alias("shift_score"), (score > threshold).alias("drifted"))


def _kolmogorov_sf(x: Column, terms: int = 100) -> Column:
    """Asymptotic Kolmogorov survival Q(x) = 2 sum_{k>=1} (-1)^(k-1) exp(-2 k^2 x^2), clipped to [0,1]."""
    s = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
                    lambda acc, k: acc + F.pow(F.lit(-1.0), k - 1) * F.exp(F.lit(-2.0) * k * k * x * x))
    return F.when(x <= 0, F.lit(1.0)).otherwise(F.least(F.greatest(F.lit(2.0) * s, F.lit(0.0)), F.lit(1.0)))


def ks_two_sample(long: DataFrame, min_n: int = 10) -> DataFrame:
    """KS statistic max|F_ref - F_cur| and asymptotic p-value per feature.

    Counts per (feature, value) are combined on the map side; the empirical
    CDFs are skew-safe running sums over the distinct values (a feature with
    most of the rows is split across range buckets).  p = Q(sqrt(m n/(m+n)) D).
    Fewer than ``min_n`` values on a side -> (0, 1).
    """
    v = long.dropna(subset=["value"])
    counts = v.groupBy("feature", "value").agg(
        F.count(F.when(F.col("side") == "ref", 1)).alias("c_ref"),
        F.count(F.when(F.col("side") == "cur", 1)).alias("c_cur"))
    bkt = bucket_column(v.select("feature", "value"), ["feature", "value"])
    cum = running_sum(counts, ["feature"], ["value"], ["c_ref", "c_cur"], ["cum_ref", "cum_cur"], bucket=bkt)
    sizes = counts.groupBy("feature").agg(F.sum("c_ref").alias("n_ref"), F.sum("c_cur").alias("n_cur"))
    j = cum.join(bounded_broadcast(sizes), "feature")
    diff = F.abs(F.col("cum_ref") / F.col("n_ref") - F.col("cum_cur") / F.col("n_cur"))
    d = j.groupBy("feature").agg(F.max(diff).alias("d"), F.max("n_ref").alias("n_ref"),
                                 F.max("n_cur").alias("n_cur"))
    en = F.sqrt(F.col("n_ref") * F.col("n_cur") / (F.col("n_ref") + F.col("n_cur")))
    small = (F.col("n_ref") < min_n) | (F.col("n_cur") < min_n)
    stat = F.when(small, F.lit(0.0)).otherwise(F.col("d"))
    pval = F.when(small, F.lit(1.0)).otherwise(_kolmogorov_sf(en * F.col("d")))
    return d.select("feature", stat.alias("ks_stat"), pval.alias("p_value"), "n_ref", "n_cur")


def retrain_trigger(report: DataFrame) -> DataFrame:
    """One-row retrain record from a drift report: critical features (sorted,
    comma-joined; bounded by the feature count), max PSI and a reason."""
    crit = F.col("severity") == "CRITICAL"
    row = report.agg(F.count_if(crit).alias("n_critical"),
                     F.array_join(F.sort_array(F.collect_list(F.when(crit, F.col("feature")))), ",")
                     .alias("critical_features"),
                     F.max("psi").alias("psi_max"))
    return row.select((F.col("n_critical") > 0).alias("should_retrain"), "n_critical", "critical_features", "psi_max",
                      F.format_string("critical drift in %d feature(s)", F.col("n_critical")).alias("reason"))
