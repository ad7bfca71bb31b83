"""Shared helpers of the training-data operators: table access, staged tables,
whitespace word expressions and skew-safe row numbers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import clinlake
from clinlake.plans.broadcast import sized_broadcast
from clinlake.session import checkpoint_dir

# functions travel to the executors with their code: the package need not be installed there
cloudpickle.register_pickle_by_value(clinlake)

#: The separators of a word: space, tab, line feed, vertical tab, form feed, carriage return.
WS = r"[\x20\x09-\x0D]+"
#: Rows of one numbering bucket (see ``hash_index``).
BUCKET_ROWS = 10_000


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One input table through Spark's reader, pruned to ``columns``."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Lists that take down the paths of staged tables, see ``staging``.
_NOTED: list[list[str]] = []


@contextlib.contextmanager
def staging() -> Iterator[list[str]]:
    """The paths of all tables that are staged meanwhile."""
    _NOTED.append([])
    try:
        yield _NOTED[-1]
    finally:
        _NOTED.pop()


def drop_staged(spark: SparkSession, paths: Sequence[str]) -> None:
    """Delete staged tables that nothing reads any more, in whatever store they lie."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends
    there, and a lost executor costs no recomputation of what lies before."""
    path = scratch(df.sparkSession, name)
    for noted in _NOTED:
        noted.append(path)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_memory() -> None:
    """Give freed memory back to the system at the end of a Python task: the
    worker stays alive for later stages, and what it holds counts there."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def words(text: Column) -> Column:
    """Maximal runs of non-separators, in order."""
    return F.array_remove(F.split(text, WS), "")


def unit(hash64: Column) -> Column:
    """The upper 31 bits of a 64-bit hash as an integer (order-preserving)."""
    return F.shiftrightunsigned(hash64, 33)


def unused(columns: Sequence[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to be none of ``columns``."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def file_order(df: DataFrame, out: str) -> DataFrame:
    """``df``, read from Parquet files that Spark wrote, with each row's gapless
    0-based place in the order of the files' numbers and of the rows in them.
    ``out`` must be the name of no column."""
    file, row, of, n, first = unused([*df.columns, out], "_file", "_row", "_of", "_n", "_first")
    name = F.col("_metadata.file_name")
    rows = df.select("*", name.alias(file), F.col("_metadata.row_index").alias(row))
    number = [F.regexp_extract(of, pattern, 1).try_cast("long") for pattern in (r"part-(\d+)", r"-c(\d+)\.")]
    before = Window.orderBy(*number, of).rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = df.select(name.alias(of)).groupBy(of).agg(F.count(F.lit(1)).alias(n)).select(
        of, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(first))
    return rows.join(sized_broadcast(files), F.col(file) == F.col(of)).select(
        *df.columns, (F.col(first) + F.col(row)).alias(out))


def hash_index(df: DataFrame, groups: Sequence[str], order: Sequence[str], out: str,
               n_rows: int | None = None, bucket_rows: int | None = None) -> DataFrame:
    """Gapless 0-based position of each row within its group, along a seeded
    hash of the ``order`` columns (ties: the columns themselves; rows equal in
    all of them are interchangeable).

    The hash range is cut into buckets, each (group, bucket) is numbered on its
    own and shifted by the counts of the buckets before it, so a group with a
    third of all rows spreads over a third of the tasks.  The result does not
    depend on the number of buckets."""
    n_rows = df.count() if n_rows is None else n_rows
    n = max(1, -(-n_rows // (bucket_rows or BUCKET_ROWS)))
    h = df.withColumn("_h", F.xxhash64(F.lit(out), *order))
    h = h.withColumn("_b", F.floor(unit(F.col("_h")) * F.lit(n) / F.lit(2 ** 31)).cast("int"))
    keys = [*groups, "_b"]
    before = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = h.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inner = Window.partitionBy(*keys).orderBy(unit(F.col("_h")), "_h", *order)
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    numbered = h.withColumn("_r", F.row_number().over(inner)).join(offsets, cond)
    return numbered.select(*df.columns, (F.col("_r") - 1 + F.col("_o")).cast("long").alias(out))
