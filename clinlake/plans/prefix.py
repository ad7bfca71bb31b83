"""Prefix sums and ranks without a single-task window.

``Window.partitionBy(key).orderBy(t)`` puts a whole key into one task and
``Window.orderBy(t)`` puts the whole table into one task.  Here the ordering
``(key..., order...)`` is cut into range buckets; every bucket is summed
where it lies, per-bucket totals (a table of at most buckets x keys-in-bucket
rows) give each (bucket, key) its offset, and the window inside a bucket only
spans that bucket.  A key holding a third of all rows is thus spread over a
third of the buckets.

Split points come from a bounded random sample collected to the driver
(``SAMPLE_ROWS`` rows at most), so nothing large passes through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_ROWS = 20_000
ROWS_PER_BUCKET = 4_000_000
MAX_BUCKETS = 4_096


def _n_buckets(n_rows: int, rows_per_bucket: int) -> int:
    return int(max(1, min(MAX_BUCKETS, -(-n_rows // rows_per_bucket))))


def bucket_column(df: DataFrame, order_cols: Sequence[str], n_rows: int | None = None,
                  rows_per_bucket: int | None = None, seed: int = 17) -> Column:
    """Range-bucket id over ``order_cols`` (lexicographic), from sampled split points.

    The order is Spark's ascending order in every bucket count: a null key lies
    before all others (first bucket), NaN after them (last bucket).
    ``rows_per_bucket`` defaults to the module's ``ROWS_PER_BUCKET`` read at call
    time (tests lower it to force many buckets on small tables)."""
    if rows_per_bucket is None:
        rows_per_bucket = ROWS_PER_BUCKET
    if n_rows is None:
        n_rows = df.select(*order_cols).count()
    n = _n_buckets(n_rows, rows_per_bucket)
    if n == 1 or n_rows == 0:
        return F.lit(0)
    # half the room, so the limit below does not cut the draw off at one end
    frac = min(1.0, SAMPLE_ROWS / 2 / max(n_rows, 1))
    sample = (df.select(*order_cols).sample(fraction=frac, seed=seed)
              .dropna().limit(SAMPLE_ROWS).collect())
    keys = sorted(tuple(r) for r in sample)
    if not keys:
        return F.lit(0)
    splits = sorted({keys[(i * len(keys)) // n] for i in range(1, n)})
    types = [df.schema[c].dataType for c in order_cols]
    if len(order_cols) == 1:
        key = F.col(order_cols[0])
        lits = [F.lit(sp[0]).cast(types[0]) for sp in splits]
    else:
        key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order_cols)])
        lits = [F.struct(*[F.lit(v).cast(types[i]).alias(f"k{i}") for i, v in enumerate(sp)]) for sp in splits]
    return _search_tree(key, lits, 0, len(lits))


def _search_tree(key: Column, splits: list[Column], lo: int, hi: int) -> Column:
    """Bucket id = number of sorted split points <= key, as a balanced tree of
    native comparisons (log2(n) comparisons per row, no lambda)."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi + 1) // 2  # buckets lo..mid-1 lie below splits[mid-1]
    return F.when(F.coalesce(key < splits[mid - 1], F.lit(True)), _search_tree(key, splits, lo, mid - 1)).otherwise(
        _search_tree(key, splits, mid, hi))


def running_sum(df: DataFrame, partition_cols: Sequence[str], order_cols: Sequence[str],
                value_cols: Sequence[str], out_cols: Sequence[str] | None = None,
                rows_per_bucket: int | None = None, bucket: Column | None = None) -> DataFrame:
    """Inclusive running sums of ``value_cols`` per ``partition_cols`` along ``order_cols``.

    ``order_cols`` must be unique within a partition (add a tiebreaker), as
    for a ROWS frame.  Output has the input columns plus ``out_cols``.
    ``bucket`` reuses a bucket column already computed for the same ordering.
    """
    out_cols = list(out_cols or [f"cum_{v}" for v in value_cols])
    keys = list(partition_cols)
    bcol = bucket if bucket is not None else bucket_column(df, keys + list(order_cols),
                                                           rows_per_bucket=rows_per_bucket)
    b = df.withColumn("_bkt", bcol)
    totals = b.groupBy("_bkt", *keys).agg(*[F.sum(v).alias(f"_t{i}") for i, v in enumerate(value_cols)])
    w_tot = Window.partitionBy(*keys).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_bkt", *keys, *[
        F.coalesce(F.sum(f"_t{i}").over(w_tot), F.lit(0)).alias(f"_o{i}") for i in range(len(value_cols))])
    w_in = (Window.partitionBy("_bkt", *keys).orderBy(*order_cols)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inner = b.withColumns({f"_c{i}": F.sum(v).over(w_in) for i, v in enumerate(value_cols)})
    joined = inner.join(offsets, on=["_bkt", *keys], how="inner")
    return joined.select(*df.columns, *[(F.col(f"_c{i}") + F.col(f"_o{i}")).alias(o)
                                        for i, o in enumerate(out_cols)])


def row_index(df: DataFrame, partition_cols: Sequence[str], order_cols: Sequence[str],
              out: str = "row_idx", rows_per_bucket: int | None = None, bucket: Column | None = None) -> DataFrame:
    """1-based ``row_number()`` per partition along a unique order, skew-safe."""
    one = df.withColumn("_one", F.lit(1))
    res = running_sum(one, partition_cols, order_cols, ["_one"], [out], rows_per_bucket, bucket)
    return res.drop("_one")


def dense_codes(df: DataFrame, value_col: str, out: str = "code",
                rows_per_bucket: int | None = None) -> DataFrame:
    """Sorted dictionary codes 0..k-1 for the distinct values of ``value_col``.

    Returns a (value, code) table with one row per distinct value.
    """
    distinct = df.select(value_col).distinct()
    bkt = bucket_column(df.select(value_col), [value_col], rows_per_bucket=rows_per_bucket)
    idx = row_index(distinct, [], [value_col], "_rn", rows_per_bucket, bucket=bkt)
    return idx.select(value_col, (F.col("_rn") - 1).cast("int").alias(out))
