"""Exact, linearly interpolated quantiles per group (NumPy / ``percentile`` rule).

Spark's ``percentile``/``median`` keep a map of every distinct value of a
group in one task; with a hot group that map is unbounded.  This plan counts
rows per (group, value) first (map-side combined), takes skew-safe running
counts over the distinct values (``plans.prefix.running_sum``), and picks the
order statistics at ``floor(p*(n-1))`` and ``ceil(p*(n-1))`` with a grouped
aggregate.  Nothing holds a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinlake.functions.exprs import nan_to_null
from clinlake.plans.prefix import bucket_column, running_sum


def exact_quantiles(df: DataFrame, group_cols: Sequence[str], value_col: str,
                    probs: Sequence[float], names: Sequence[str] | None = None) -> DataFrame:
    """One row per group with a column per probability (null for an empty group)."""
    names = list(names or [f"q{int(round(p * 1000)):03d}" for p in probs])
    g = list(group_cols)
    vals = df.select(*g, nan_to_null(F.col(value_col).cast("double")).alias("_v")).dropna(subset=["_v"])
    counts = vals.groupBy(*g, "_v").agg(F.count(F.lit(1)).alias("_c"))
    # split points sampled from the scan itself, so sampling never re-runs the aggregate
    bkt = bucket_column(vals, g + ["_v"])
    cum = running_sum(counts, g, ["_v"], ["_c"], ["_cum"], bucket=bkt)
    sizes = counts.groupBy(*g).agg(F.sum("_c").alias("_n"))
    j = cum.join(sizes, on=g, how="inner") if g else cum.crossJoin(F.broadcast(sizes))  # one row
    aggs = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        start = F.col("_cum") - F.col("_c")
        has_lo = (start <= lo) & (lo < F.col("_cum"))
        has_hi = (start <= hi) & (hi < F.col("_cum"))
        j = j.withColumn(f"_frac{i}", pos - lo)
        aggs += [F.max(F.when(has_lo, F.col("_v"))).alias(f"_lo{i}"),
                 F.max(F.when(has_hi, F.col("_v"))).alias(f"_hi{i}"),
                 F.max(F.col(f"_frac{i}")).alias(f"_f{i}")]
    res = j.groupBy(*g).agg(*aggs)
    return res.select(*g, *[(F.col(f"_lo{i}") + F.col(f"_f{i}") * (F.col(f"_hi{i}") - F.col(f"_lo{i}")))
                            .alias(n) for i, n in enumerate(names)])


def exact_median(df: DataFrame, group_cols: Sequence[str], value_col: str, name: str = "median") -> DataFrame:
    return exact_quantiles(df, group_cols, value_col, [0.5], [name])
