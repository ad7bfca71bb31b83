"""Table writes: partitioned sink, validated append, upserts, keyset reads.

Upserts are expressed as set operations over the target and the batch
(anti join + union, or latest-wins per key), written as one new snapshot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinlake.plans.broadcast import runtime_sized


def write_partitioned(df: DataFrame, path: str, partition_cols: Sequence[str] = (),
                      mode: str = "overwrite") -> None:
    """Parquet sink; dynamic partition overwrite replaces only touched partitions."""
    w = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    if partition_cols:
        w = w.partitionBy(*partition_cols)
    w.parquet(path)


def stamp_audit(df: DataFrame, schema_version: int, at: Column | None = None) -> DataFrame:
    """Audit columns of a validated append: ``schema_version``, ``updated_at``."""
    return df.withColumns({"schema_version": F.lit(schema_version).cast("int"),
                           "updated_at": at if at is not None else F.current_timestamp()})


def replace_by_key(target: DataFrame, batch: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """Per key, every stored row is replaced by the batch's rows for that key."""
    keys = batch.select(*key_cols).distinct()
    kept = target.join(runtime_sized(keys), on=list(key_cols), how="left_anti")
    return kept.unionByName(batch.select(*target.columns))


def upsert_do_nothing(target: DataFrame, batch: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """INSERT ... ON CONFLICT DO NOTHING: only batch rows with new keys are added."""
    new = batch.join(target.select(*key_cols), on=list(key_cols), how="left_anti")
    return target.unionByName(new.select(*target.columns))


def upsert_latest_wins(target: DataFrame, batch: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """INSERT ... ON CONFLICT DO UPDATE: the batch row wins for existing keys.

    One aggregate per key (``max_by`` over a priority) instead of a sort.
    """
    cols = [c for c in target.columns if c not in key_cols]
    both = (target.withColumn("_prio", F.lit(0))
            .unionByName(batch.select(*target.columns).withColumn("_prio", F.lit(1))))
    picked = both.groupBy(*key_cols).agg(F.max_by(F.struct(*cols), F.col("_prio")).alias("_r"))
    return picked.select(*key_cols, *[F.col(f"_r.{c}").alias(c) for c in cols])


def conditional_update(df: DataFrame, condition: Column, assignments: dict[str, Column]) -> DataFrame:
    """UPDATE ... SET col = v WHERE cond, as a rewrite of the touched columns."""
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in assignments.items()})


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """DELETE ... WHERE cond; rows where cond is null are kept (SQL semantics)."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def predicate_overwrite(df: DataFrame, condition: Column, replacement: DataFrame) -> DataFrame:
    """Overwrite the rows matching ``condition`` by ``replacement``; all other
    rows (including rows where the predicate is null) are kept exactly once."""
    keep = df.filter(~F.coalesce(condition, F.lit(False)))
    return keep.unionByName(replacement.select(*df.columns))


def after_high_water_mark(df: DataFrame, key: str, hwm, upto=None) -> DataFrame:
    """Keyset read: ``key > hwm`` (and ``<= upto``), a range that never splits a key."""
    cond = F.col(key) > F.lit(hwm)
    if upto is not None:
        cond = cond & (F.col(key) <= F.lit(upto))
    return df.filter(cond)


def keyset_pages(df: DataFrame, key: str, page_width: int) -> DataFrame:
    """Assign every row to a keyset page ``[lo, lo + width)`` of the key range.

    Pages are key ranges, so a key's rows never straddle two pages and all
    pages can be read in parallel (the bulk form of a cursor loop).
    """
    return df.withColumn("page_id", F.floor(F.col(key) / F.lit(page_width)).cast("long"))


def preview_page(df: DataFrame, order_cols: Sequence[str], offset: int, limit: int) -> DataFrame:
    """Offset/limit preview (small pages only; bulk reads use keyset pages)."""
    return df.orderBy(*order_cols).offset(offset).limit(limit)
