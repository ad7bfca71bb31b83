"""Imputation, scaling and harmonisation.

Population statistics are one aggregate row per group (or one row overall),
joined back to the data.  The statistics table has one row per group, so it
is broadcast only behind a size check.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinlake.functions.exprs import hash_normal, nan_to_null, safe_div
from clinlake.plans.broadcast import bounded_broadcast, runtime_sized, sized_broadcast
from clinlake.plans.quantile import exact_quantiles
from clinlake.session import checkpoint_dir


def _join_stats(df: DataFrame, stats: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    if not group_cols:
        return df.crossJoin(bounded_broadcast(stats))  # one row by construction
    checkpoint_dir(df.sparkSession)  # computed once, and sized before the join: few groups move no row of df
    return df.join(sized_broadcast(stats.checkpoint()), on=list(group_cols), how="left")


def median_fill(df: DataFrame, columns: Sequence[str], group_cols: Sequence[str] = (),
                zero_fallback: bool = True) -> DataFrame:
    """Fill nulls/NaN with the (group) median; a group with no value falls back to 0.

    The medians are exact (linear interpolation) and computed with the
    distributed quantile plan, one pass per column.
    """
    g = list(group_cols)
    out = df.withColumns({c: nan_to_null(F.col(c).cast("double")) for c in columns})
    for c in columns:
        med = exact_quantiles(out, g, c, [0.5], [f"_med_{c}"])
        out = _join_stats(out, med, g)
        fill = F.col(f"_med_{c}")
        if zero_fallback:
            fill = F.coalesce(fill, F.lit(0.0))
        out = out.withColumn(c, F.coalesce(F.col(c), fill)).drop(f"_med_{c}")
    return out


def mean_fill(df: DataFrame, columns: Sequence[str], group_cols: Sequence[str] = ()) -> DataFrame:
    """Fill nulls with the (group) mean; one aggregate for all columns."""
    g = list(group_cols)
    stats = df.groupBy(*g).agg(*[F.avg(nan_to_null(F.col(c).cast("double"))).alias(f"_mean_{c}")
                                 for c in columns])
    out = _join_stats(df, stats, g)
    out = out.withColumns({c: F.coalesce(nan_to_null(F.col(c).cast("double")), F.col(f"_mean_{c}"))
                           for c in columns})
    return out.drop(*[f"_mean_{c}" for c in columns])


def population_zscore(df: DataFrame, columns: Sequence[str], group_cols: Sequence[str] = (),
                      log1p_cols: Sequence[str] = (), null_to_zero: bool = True,
                      suffix: str = "") -> DataFrame:
    """(x - mean) / sd_pop; log1p first for ``log1p_cols``; sd 0 -> 1; nulls -> 0."""
    g = list(group_cols)
    x = {c: (F.log1p(F.col(c).cast("double")) if c in log1p_cols else F.col(c).cast("double"))
         for c in columns}
    base = df.withColumns({f"_x_{c}": nan_to_null(v) for c, v in x.items()})
    stats = base.groupBy(*g).agg(*[e for c in columns for e in (
        F.avg(f"_x_{c}").alias(f"_m_{c}"), F.stddev_pop(f"_x_{c}").alias(f"_s_{c}"))])
    j = _join_stats(base, stats, g)
    outs = {}
    for c in columns:
        sd = F.when(F.coalesce(F.col(f"_s_{c}"), F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col(f"_s_{c}"))
        z = (F.col(f"_x_{c}") - F.col(f"_m_{c}")) / sd
        outs[f"{c}{suffix}"] = F.coalesce(z, F.lit(0.0)) if null_to_zero else z
    j = j.withColumns(outs)
    return j.drop(*[f"_{p}_{c}" for c in columns for p in ("x", "m", "s")])


def baseline_composite(df: DataFrame, columns: Sequence[str], weights: Sequence[float],
                       baseline: Column, signs: Sequence[float] | None = None,
                       out: str = "composite", lo: float = 0.0, hi: float = 100.0,
                       scale: float = 10.0, centre: float = 50.0) -> DataFrame:
    """Baseline-referenced composite: z against the baseline rows' mean/sd_pop
    (sd 0 -> 1), weighted sum, mapped to ``centre + scale * score`` and clipped."""
    signs = list(signs or [1.0] * len(columns))
    ref = df.filter(baseline).agg(*[e for c in columns for e in (
        F.avg(nan_to_null(F.col(c).cast("double"))).alias(f"_m_{c}"),
        F.stddev_pop(nan_to_null(F.col(c).cast("double"))).alias(f"_s_{c}"))])
    j = df.crossJoin(bounded_broadcast(ref))
    score = F.lit(0.0)
    for c, w, s in zip(columns, weights, signs):
        sd = F.when(F.coalesce(F.col(f"_s_{c}"), F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col(f"_s_{c}"))
        z = F.coalesce((nan_to_null(F.col(c).cast("double")) - F.col(f"_m_{c}")) / sd, F.lit(0.0))
        score = score + F.lit(float(w) * float(s)) * z
    val = F.least(F.greatest(F.lit(centre) + F.lit(scale) * score, F.lit(lo)), F.lit(hi))
    return j.withColumn(out, val).drop(*[f"_{p}_{c}" for c in columns for p in ("m", "s")])


def prior_fill(df: DataFrame, column: str, key: str, literature: DataFrame, file_scores: DataFrame,
               out: str | None = None) -> DataFrame:
    """Fill missing cells by a per-key prior; file scores override literature priors.

    ``literature`` and ``file_scores`` are (key, prior) tables.  The merged
    prior is ``coalesce(file, literature)`` per key (map_concat LAST_WIN
    semantics), joined back once.
    """
    out = out or column
    lit_t = literature.select(F.col(key), F.col("prior").alias("_lit"))
    file_t = file_scores.select(F.col(key), F.col("prior").alias("_file"))
    priors = lit_t.join(file_t, on=key, how="full").select(
        key, F.coalesce(F.col("_file"), F.col("_lit")).alias("_prior"))
    j = df.join(runtime_sized(priors), on=key, how="left")
    return j.withColumn(out, F.coalesce(nan_to_null(F.col(column).cast("double")), F.col("_prior"))).drop("_prior")


def site_demean(df: DataFrame, columns: Sequence[str], site: str, add_global_mean: bool = False,
                suffix: str = "") -> DataFrame:
    """Remove the per-site mean (optionally add back the global mean)."""
    site_stats = df.groupBy(site).agg(*[F.avg(nan_to_null(F.col(c).cast("double"))).alias(f"_sm_{c}")
                                        for c in columns])
    j = df.join(runtime_sized(site_stats), on=site, how="left")
    if add_global_mean:
        g = df.agg(*[F.avg(nan_to_null(F.col(c).cast("double"))).alias(f"_gm_{c}") for c in columns])
        j = j.crossJoin(bounded_broadcast(g))
    outs = {}
    for c in columns:
        v = nan_to_null(F.col(c).cast("double")) - F.col(f"_sm_{c}")
        if add_global_mean:
            v = v + F.col(f"_gm_{c}")
        outs[f"{c}{suffix}"] = v
    j = j.withColumns(outs).drop(*[f"_sm_{c}" for c in columns])
    return j.drop(*[f"_gm_{c}" for c in columns]) if add_global_mean else j


def combat_location_scale(df: DataFrame, columns: Sequence[str], site: str, suffix: str = "") -> DataFrame:
    """Site harmonisation by location/scale with empirical-Bayes shrinkage (ComBat-style,
    no covariates): per-site moments by one ``groupBy``, shrinkage on the small
    (site x feature) table, applied by a join.

    gamma* = (n t2 g + d2 g_bar)/(n t2 + d2) shrinks each site mean toward the
    mean of site means; delta* is the site variance shrunk toward the mean
    site variance with the same weight.  Output = (x - m - gamma*)/sqrt(delta*) * s + m.
    """
    g = {c: nan_to_null(F.col(c).cast("double")) for c in columns}
    pooled = df.agg(*[e for c in columns for e in (F.avg(g[c]).alias(f"_pm_{c}"),
                                                     F.stddev_pop(g[c]).alias(f"_ps_{c}"))])
    j = df.crossJoin(bounded_broadcast(pooled))
    std = {c: safe_div(g[c] - F.col(f"_pm_{c}"), F.col(f"_ps_{c}")) for c in columns}
    j = j.withColumns({f"_z_{c}": v for c, v in std.items()})
    per_site = j.groupBy(site).agg(F.count(F.lit(1)).alias("_n"), *[e for c in columns for e in (
        F.avg(f"_z_{c}").alias(f"_g_{c}"), F.var_pop(f"_z_{c}").alias(f"_d_{c}"))])
    hyper = per_site.agg(*[e for c in columns for e in (
        F.avg(f"_g_{c}").alias(f"_gb_{c}"), F.var_pop(f"_g_{c}").alias(f"_t2_{c}"),
        F.avg(f"_d_{c}").alias(f"_db_{c}"))])
    shrunk = per_site.crossJoin(bounded_broadcast(hyper))
    cols = [site]
    for c in columns:
        t2 = F.coalesce(F.col(f"_t2_{c}"), F.lit(0.0))
        d2 = F.coalesce(F.col(f"_d_{c}"), F.lit(0.0))
        n = F.col("_n").cast("double")
        den = n * t2 + d2
        gs = F.when(den == 0, F.col(f"_gb_{c}")).otherwise(
            (n * t2 * F.col(f"_g_{c}") + d2 * F.col(f"_gb_{c}")) / den)
        w = F.when(den == 0, F.lit(0.0)).otherwise(n * t2 / den)
        ds = w * d2 + (F.lit(1.0) - w) * F.col(f"_db_{c}")
        cols += [gs.alias(f"_gs_{c}"), ds.alias(f"_ds_{c}")]
    params = shrunk.select(*cols)
    k = j.join(runtime_sized(params), on=site, how="left")
    outs = {}
    for c in columns:
        ds = F.when(F.coalesce(F.col(f"_ds_{c}"), F.lit(0.0)) <= 0, F.lit(1.0)).otherwise(F.col(f"_ds_{c}"))
        adj = (F.col(f"_z_{c}") - F.col(f"_gs_{c}")) / F.sqrt(ds)
        outs[f"{c}{suffix}"] = adj * F.col(f"_ps_{c}") + F.col(f"_pm_{c}")
    k = k.withColumns(outs)
    return k.drop(*[f"_{p}_{c}" for c in columns for p in ("pm", "ps", "z", "gs", "ds")])


def augmentation_plan(counts: DataFrame, label: str, min_n: int, max_frac: float = 0.3) -> DataFrame:
    """Rare-class plan: add min(min_n - n, int(n/(1-f)*f)) rows to classes under ``min_n``."""
    n = F.col("n")
    cap = F.floor(n / F.lit(1.0 - max_frac) * F.lit(max_frac)).cast("long")
    need = F.when(n < min_n, F.least(F.lit(min_n) - n, cap)).otherwise(F.lit(0))
    return counts.select(label, n.alias("n"), F.greatest(need, F.lit(0)).cast("long").alias("n_add"))


def bootstrap_oversample(df: DataFrame, label: str, plan: DataFrame, noise_cols: Sequence[str],
                         seed: int = 42, noise_frac: float = 0.05, source_col: str = "data_source",
                         tag: str = "bootstrap_augmented") -> DataFrame:
    """Bootstrap rows of each planned class with Gaussian jitter N(0, f*sd).

    Rows are drawn by explode of a per-row Poisson-like repeat count from a
    seeded hash, so the draw is repeatable and fully distributed: a row of a
    class with n rows and n_add planned copies is repeated
    floor(n_add/n) times plus once more with probability (n_add mod n)/n.
    """
    sd = df.groupBy(label).agg(*[F.stddev_pop(nan_to_null(F.col(c).cast("double"))).alias(f"_sd_{c}")
                                 for c in noise_cols])
    p = plan.filter(F.col("n_add") > 0).join(runtime_sized(sd), on=label, how="left")
    j = df.join(runtime_sized(p), on=label, how="inner")
    u = (F.xxhash64(*[F.col(c) for c in df.columns], F.lit(seed)).cast("double") / F.lit(2.0 ** 63) + 1) / 2
    base = F.floor(F.col("n_add") / F.col("n"))
    extra = (u < (F.col("n_add") % F.col("n")) / F.col("n")).cast("long")
    reps = (base + extra).cast("int")
    ex = j.filter(reps > 0).withColumn("_rep", F.explode(F.sequence(F.lit(1), reps)))
    outs = {c: F.col(c).cast("double") + hash_normal(seed + i, *[F.col(x) for x in df.columns], F.col("_rep")) * F.lit(noise_frac) *
            F.coalesce(F.col(f"_sd_{c}"), F.lit(0.0)) for i, c in enumerate(noise_cols)}
    outs[source_col] = F.lit(tag)
    ex = ex.withColumns(outs)
    return ex.select(*[c for c in df.columns if c != source_col], source_col)


def exclude_augmented(df: DataFrame, source_col: str = "data_source") -> DataFrame:
    """Drop synthetic / augmented rows (source tagged *augmented* or *synthetic*)
    before drift or quality statistics."""
    return df.filter(~F.coalesce(F.lower(F.col(source_col)).rlike("augmented|synthetic"), F.lit(False)))


def fit_scaling(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row of the training rows' medians, means and standard deviations (population;
    0 or null counts as 1), for ``apply_scaling``."""
    v = {c: nan_to_null(F.col(c).cast("double")) for c in columns}
    flat = train.select(*[v[c].alias(c) for c in columns])
    sd = {c: F.stddev_pop(c) for c in columns}
    moments = flat.agg(*[F.avg(c).alias(f"_mean_{c}") for c in columns],
                       *[F.when(F.coalesce(sd[c], F.lit(0.0)) > 0, sd[c]).otherwise(1.0).alias(f"_sd_{c}") for c in columns])
    for c in columns:
        moments = moments.crossJoin(bounded_broadcast(exact_quantiles(flat, [], c, [0.5], [f"_med_{c}"])))
    return moments


def apply_scaling(df: DataFrame, fitted: DataFrame, columns: Sequence[str], suffix: str = "_scaled") -> DataFrame:
    """``df`` with missing values of the columns filled by the training median and scaled by
    the training mean and deviation: nothing is learnt from the rows it is applied to."""
    j = df.crossJoin(bounded_broadcast(fitted))
    out = {f"{c}{suffix}": (F.coalesce(nan_to_null(F.col(c).cast("double")), F.col(f"_med_{c}")) - F.col(f"_mean_{c}"))
           / F.col(f"_sd_{c}") for c in columns}
    return j.withColumns(out).select(*df.columns, *out)
