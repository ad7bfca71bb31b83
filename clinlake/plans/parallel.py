"""Keep CPU-heavy per-row work parallel.

Tokenising or regex-scanning long texts is per-row CPU work.  An input with
fewer partitions than the cluster has task slots (a few large files, one
row group) would run it in a handful of tasks; ``spread`` then hash-partitions
the rows by a key over the default parallelism (deterministic under task
retries, no sort).  Inputs that already have enough partitions, and inputs above ``SMALL_BYTES``
(by the optimizer's size estimate), are returned unchanged, so no large table
is shuffled for this.  No operator's result depends on the layout: random draws
come from hashes of the row (``functions.exprs.hash_uniform``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


SMALL_BYTES = 1 << 28


def _size_estimate(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, key_cols: Sequence[str] | None = None) -> DataFrame:
    """Hash-partition ``df`` over the task slots when it has fewer partitions
    than slots (by ``key_cols``, or a hash of all columns); else unchanged."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    if _size_estimate(df) > SMALL_BYTES or df.rdd.getNumPartitions() >= slots:
        return df
    if not key_cols:
        first = df.schema.fields[0]
        # an integer id leads most tables: hashing it is cheap and well spread
        key_cols = [first.name] if first.dataType.typeName() in ("long", "integer") else list(df.columns)
    return df.repartition(slots, F.xxhash64(*[F.col(c) for c in key_cols]))
