"""One-pass column statistics, completeness, histograms, outliers.

Everything is computed for all columns in as few passes as possible: one wide
``agg`` for moments, one ``unpivot`` + grouped count for histograms.  Results
are small by construction (one row per feature, or per feature and bin).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinlake.functions.exprs import equal_width_bin, nan_to_null
from clinlake.plans.broadcast import bounded_broadcast
from clinlake.plans.quantile import exact_quantiles


def to_long(df: DataFrame, columns: Sequence[str], id_cols: Sequence[str] = (),
            feature: str = "feature", value: str = "value") -> DataFrame:
    """Wide -> long (feature, value) with NaN -> null; a narrow Expand, no shuffle."""
    cast = df.select(*id_cols, *[nan_to_null(F.col(c).cast("double")).alias(c) for c in columns])
    return cast.unpivot(list(id_cols), list(columns), feature, value)


def summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """mean, sd (ddof=0), min, max, non-null count per feature: one aggregate pass.

    The mean is a decimal sum (12 places, exact in any order) divided once, so it
    does not depend on how the rows are partitioned."""
    aggs = []
    for c in columns:
        x = nan_to_null(F.col(c).cast("double"))
        aggs += [(F.sum(x.cast("decimal(28,12)")).cast("double") / F.count(x)).alias(f"{c}\u0001mean"), F.stddev_pop(x).alias(f"{c}\u0001sd"),
                 F.min(x).alias(f"{c}\u0001min"), F.max(x).alias(f"{c}\u0001max"),
                 F.count(x).alias(f"{c}\u0001n")]
    wide = df.agg(*aggs)
    stack = F.array(*[F.struct(F.lit(c).alias("feature"),
                               F.col(f"`{c}\u0001mean`").alias("mean"), F.col(f"`{c}\u0001sd`").alias("sd"),
                               F.col(f"`{c}\u0001min`").alias("min"), F.col(f"`{c}\u0001max`").alias("max"),
                               F.col(f"`{c}\u0001n`").alias("n")) for c in columns])
    return wide.select(F.inline(stack))


def completeness(df: DataFrame, columns: Sequence[str], group_cols: Sequence[str] = (),
                 scale: int = 4) -> DataFrame:
    """1 - null rate per column (NaN counts as missing), rounded; optional groups."""
    aggs = [F.avg(nan_to_null(F.col(c)).isNotNull().cast("double")
                  if _is_float(df, c) else F.col(c).isNotNull().cast("double")).alias(c) for c in columns]
    wide = df.groupBy(*group_cols).agg(*aggs)
    long = wide.unpivot(list(group_cols), list(columns), "column", "completeness")
    return long.withColumn("completeness", F.round("completeness", scale))


def _is_float(df: DataFrame, c: str) -> bool:
    return df.schema[c].dataType.typeName() in ("double", "float")


def value_counts(df: DataFrame, column: str, rare_below: int | None = None, scale: int = 2) -> DataFrame:
    """Count and percentage per value; the total is a one-row aggregate of the
    grouped table (the same exchange is reused), joined by broadcast."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    out = counts.crossJoin(bounded_broadcast(total)).withColumn(
        "pct", F.round(F.col("n") * 100.0 / F.col("_total"), scale)).drop("_total")
    if rare_below is not None:
        out = out.withColumn("is_rare", F.col("n") < rare_below)
    return out


def histogram(df: DataFrame, columns: Sequence[str], n_bins: int) -> DataFrame:
    """NumPy-rule equal-width histogram per feature (half-open bins, last closed),
    zero-filled: (feature, bin, lo, hi, count)."""
    long = to_long(df, columns).dropna(subset=["value"])
    rng = long.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    binned = long.join(bounded_broadcast(rng), "feature").withColumn(
        "bin", equal_width_bin("value", "lo", "hi", n_bins))
    counts = binned.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("count"))
    grid = rng.select("feature", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / F.lit(n_bins)
    out = grid.join(counts, ["feature", "bin"], "left")
    return out.select("feature", "bin", (F.col("lo") + F.col("bin") * width).alias("bin_lo"),
                      (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
                      F.coalesce("count", F.lit(0)).alias("count"))


def bucket_pivot(df: DataFrame, value: str, buckets: Sequence[tuple[str, float, float]],
                 category: str, levels: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """Half-open [lo, hi) buckets of ``value`` x category levels, zero-filled counts.

    The bucket table is a fixed list, so every bucket appears even when empty.
    """
    names = list(names or levels)
    spark = df.sparkSession
    dim = spark.createDataFrame([(lab, float(lo), float(hi), i) for i, (lab, lo, hi) in enumerate(buckets)],
                                "range string, lo double, hi double, ord int")
    v = F.col(value).cast("double")
    bucket = None
    for lab, lo, hi in buckets:
        cond = (v >= lo) & (v < hi)
        bucket = F.when(cond, F.lit(lab)) if bucket is None else bucket.when(cond, F.lit(lab))
    tagged = df.select(bucket.alias("range"), F.col(category).alias("_cat")).dropna(subset=["range"])
    counts = tagged.groupBy("range").agg(*[F.count(F.when(F.col("_cat") == lv, 1)).alias(n)
                                           for lv, n in zip(levels, names)])
    return (bounded_broadcast(dim).join(counts, "range", "left")
            .select("range", "ord", *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in names]))


def outlier_counts(df: DataFrame, columns: Sequence[str], z_threshold: float = 4.0,
                   iqr_factor: float = 3.0, min_n: int = 10) -> DataFrame:
    """max(z-score outliers, IQR outliers) per feature; fewer than ``min_n`` values -> 0.

    Pass 1: mean/sd_pop per feature and exact quartiles (distributed quantile
    plan).  Pass 2: conditional counts for all features at once on the long
    table joined with the per-feature statistics (one row per feature).
    """
    long = to_long(df, columns).dropna(subset=["value"])
    moments = long.groupBy("feature").agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"),
                                          F.count(F.lit(1)).alias("n"))
    quart = exact_quantiles(long, ["feature"], "value", [0.25, 0.75], ["q1", "q3"])
    stats = moments.join(quart, "feature")
    j = long.join(bounded_broadcast(stats), "feature")
    iqr = F.col("q3") - F.col("q1")
    z_out = F.abs(F.try_divide(F.col("value") - F.col("mu"), F.nullif(F.col("sd"), F.lit(0.0)))) > z_threshold
    iqr_out = (iqr > 0) & ((F.col("value") < F.col("q1") - iqr_factor * iqr) |
                           (F.col("value") > F.col("q3") + iqr_factor * iqr))
    counts = j.groupBy("feature").agg(F.count_if(F.coalesce(z_out, F.lit(False))).alias("z_outliers"),
                                      F.count_if(iqr_out).alias("iqr_outliers"), F.max("n").alias("n"))
    return counts.select("feature", "n", "z_outliers", "iqr_outliers",
                         F.when(F.col("n") < min_n, F.lit(0))
                         .otherwise(F.greatest("z_outliers", "iqr_outliers")).cast("long").alias("outliers"))


def density_rich(columns: Sequence[str], min_non_null: int) -> Column:
    """Row has at least ``min_non_null`` non-null features."""
    return sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0)) >= min_non_null
