"""Audit hash chains.

An entry's hash is sha256(previous_hash || '|' || payload).  Appending is
sequential within a chain by definition; ``append_batch`` folds only the new
batch of each chain (bounded by the ingestion batch, not the chain history),
starting from the chain's stored tail hash.  Verification is a distributed
join: every entry is matched with its predecessor by (chain, position - 1) and
both the link and the hash itself are recomputed.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinlake.plans.prefix import row_index

GENESIS = "GENESIS"


def entry_hash(previous: Column, payload: Column) -> Column:
    return F.sha2(F.concat(previous, F.lit("|"), payload), 256)


def _py_hash(previous: str, payload: str) -> str:
    return hashlib.sha256(f"{previous}|{payload}".encode("utf-8")).hexdigest()


def append_batch(stored: DataFrame | None, batch: DataFrame, chain: str, order: list[str], payload: str) -> DataFrame:
    """Hash a new batch onto each chain's tail (sequential fold per chain batch).

    Returns the batch rows with ``previous_hash`` and ``entry_hash``."""
    if stored is not None:
        tails = stored.groupBy(chain).agg(F.max_by("entry_hash", F.struct(*order)).alias("_tail"))
        b = batch.join(tails, chain, "left")
    else:
        b = batch.withColumn("_tail", F.lit(None).cast("string"))
    cols = list(batch.columns)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        prev = pdf["_tail"].iloc[0] if pdf["_tail"].notna().iloc[0] else GENESIS
        prevs, hashes = [], []
        for p in pdf[payload].astype(str):
            h = _py_hash(prev, p)
            prevs.append(prev)
            hashes.append(h)
            prev = h
        out = pdf[cols].copy()
        out["previous_hash"] = prevs
        out["entry_hash"] = hashes
        return out

    schema = ", ".join([f"`{c}` {batch.schema[c].dataType.simpleString()}" for c in cols]
                       + ["previous_hash string", "entry_hash string"])
    return b.groupBy(chain).applyInPandas(fold, schema)


def verify_chain(entries: DataFrame, chain: str, order: list[str], payload: str) -> DataFrame:
    """Per entry: link_ok (previous_hash equals the predecessor's entry_hash, or
    GENESIS for the first entry) and hash_ok (entry_hash recomputed)."""
    pos = row_index(entries, [chain], order, "_pos")
    pred = pos.select(F.col(chain).alias("_c"), (F.col("_pos") + 1).alias("_next"),
                      F.col("entry_hash").alias("_pred_hash"))
    j = pos.join(pred, (pos[chain] == pred["_c"]) & (pos["_pos"] == pred["_next"]), "left")
    expected_prev = F.when(F.col("_pos") == 1, F.lit(GENESIS)).otherwise(F.col("_pred_hash"))
    link_ok = F.coalesce(F.col("previous_hash") == expected_prev, F.lit(False))
    hash_ok = F.col("entry_hash") == entry_hash(F.col("previous_hash"), F.col(payload).cast("string"))
    return j.select(*entries.columns, link_ok.alias("link_ok"), hash_ok.alias("hash_ok"))


def chain_summary(verified: DataFrame, chain: str) -> DataFrame:
    return verified.groupBy(chain).agg(F.count(F.lit(1)).alias("entries"),
                                       F.count_if(~F.col("link_ok")).alias("broken_links"),
                                       F.count_if(~F.col("hash_ok")).alias("bad_hashes")) \
        .withColumn("valid", (F.col("broken_links") == 0) & (F.col("bad_hashes") == 0))


def audit_counts(log: DataFrame, kind: str) -> DataFrame:
    """Entries per event type / action (audit summary)."""
    return log.groupBy(kind).agg(F.count(F.lit(1)).alias("entries"))
