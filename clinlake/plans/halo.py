"""Ordered per-key windows split across range buckets ("halo" plan).

A window ``partitionBy(key).orderBy(t)`` runs a whole key in one task.  Here
the ordering (key..., order...) is cut into range buckets (same sampling as
``plans.prefix``); a frame that looks at most ``behind`` rows back and
``ahead`` rows forward is computed per (bucket, key) after copying the last
``behind`` rows of the previous bucket and the first ``ahead`` rows of the
next bucket of the same key in as halo rows.  Halo rows are dropped after the
window.  Frames must be shorter than a bucket (buckets hold ~2M rows, frames
here hold a handful).

For unbounded look-back / look-ahead of the last / next non-null value
(forward fill, interpolation) ``carry_last_non_null`` passes the value
across buckets through a table with one row per (bucket, key).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinlake.plans.prefix import bucket_column


def with_halo(df: DataFrame, keys: Sequence[str], order: Sequence[str], behind: int = 0, ahead: int = 0,
              rows_per_bucket: int | None = None, bucket: Column | None = None) -> DataFrame:
    """Rows of ``df`` tagged with ``_bkt`` plus halo copies (``_halo`` true)."""
    k = list(keys)
    bcol = bucket if bucket is not None else bucket_column(df, k + list(order), rows_per_bucket=rows_per_bucket)
    b = df.withColumn("_bkt", bcol).withColumn("_halo", F.lit(False))
    parts = [b]
    if behind > 0:
        w = Window.partitionBy("_bkt", *k).orderBy(*[F.col(c).desc() for c in order])
        tail = b.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= behind).drop("_r")
        parts.append(tail.withColumn("_bkt", F.col("_bkt") + 1).withColumn("_halo", F.lit(True)))
    if ahead > 0:
        w = Window.partitionBy("_bkt", *k).orderBy(*order)
        head = b.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= ahead).drop("_r")
        parts.append(head.withColumn("_bkt", F.col("_bkt") - 1).withColumn("_halo", F.lit(True)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def bucket_window(keys: Sequence[str], order: Sequence[str]):
    """The window spec to use on a ``with_halo`` frame."""
    return Window.partitionBy("_bkt", *keys).orderBy(*order)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("_halo")).drop("_bkt", "_halo")


def carry_last_non_null(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column,
                        out: str, forward: bool = True, bucket: Column | None = None) -> DataFrame:
    """Last (forward) or next (backward) non-null ``value`` at or before / after
    each row of its key, across buckets.

    Within a (bucket, key) the ordinary ignore-nulls window is used; a row with
    nothing in its own bucket takes the value carried from the nearest earlier
    (later) bucket of the same key, found on the per-(bucket, key) table."""
    k = list(keys)
    v = value
    bcol = bucket if bucket is not None else bucket_column(df, k + list(order))
    b = df.withColumn("_bkt", bcol).withColumn("_v", v)
    w = Window.partitionBy("_bkt", *k).orderBy(*order)
    if forward:
        inner = F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        edge = b.groupBy("_bkt", *k).agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_e"))
        wb = Window.partitionBy(*k).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
        carry = edge.select("_bkt", *k, F.last("_e", ignorenulls=True).over(wb).alias("_carry"))
    else:
        inner = F.first("_v", ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        edge = b.groupBy("_bkt", *k).agg(F.min_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_e"))
        wb = Window.partitionBy(*k).orderBy("_bkt").rowsBetween(1, Window.unboundedFollowing)
        carry = edge.select("_bkt", *k, F.first("_e", ignorenulls=True).over(wb).alias("_carry"))
    j = b.withColumn("_in", inner).join(carry, ["_bkt", *k], "left")
    return j.withColumn(out, F.coalesce("_in", "_carry")).drop("_bkt", "_v", "_in", "_carry")
