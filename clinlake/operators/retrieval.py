"""Retrieval: exact cosine top-k, partial top-k, reciprocal-rank fusion,
semantic chunking (SURVEY 2.16.8-2.16.14, 2.6.14; see also ``sparse_search`` and
``vector_index``).

* Exact dense top-k scores every document against a size-checked query set
  inside each partition (NumPy matrix product in ``mapInPandas``), keeps a
  partial top-k per partition and merges: only P x Q x k rows are shuffled.
* Top-k per group runs in two phases (per group and salt, then per group),
  so a hot group is never sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinlake.functions.exprs import cosine
from clinlake.plans.broadcast import bounded_broadcast, is_small
from clinlake.plans.prefix import running_sum

BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
RRF_K = 60


def top_k_per_group(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column], k: int,
                    salt_of: Column | None = None, salts: int = 16, rank_col: str = "rank") -> DataFrame:
    """Rows with rank <= k per group along ``order``; ranks are 1-based.

    Phase 1 keeps the top k per (group, salt); phase 2 ranks the at most
    salts x k survivors per group.
    """
    g = list(group_cols)
    salt = F.pmod(salt_of if salt_of is not None else F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts))
    w1 = Window.partitionBy(*g, "_salt").orderBy(*order)
    part = df.withColumn("_salt", salt).withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= k)
    w2 = Window.partitionBy(*g).orderBy(*order)
    return part.withColumn(rank_col, F.row_number().over(w2)).filter(F.col(rank_col) <= k).drop("_salt", "_r1")


def bm25_idf(df_t: DataFrame, n_docs: DataFrame) -> DataFrame:
    """Okapi idf = ln(N - df + 0.5) - ln(df + 0.5) from a (term, df) table; negative
    idf replaced by epsilon x the mean idf over all terms."""
    raw = df_t.crossJoin(bounded_broadcast(n_docs)).withColumn(
        "idf_raw", F.log(F.col("_N") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    avg = raw.agg(F.avg("idf_raw").alias("_avg_idf"))
    j = raw.crossJoin(bounded_broadcast(avg))
    return j.select("term", F.when(F.col("idf_raw") < 0, F.lit(BM25_EPSILON) * F.col("_avg_idf"))
                    .otherwise(F.col("idf_raw")).alias("idf"))


def dense_top_k(docs: DataFrame, doc_id: str, vec_col: str, queries: DataFrame, q_id: str, q_vec: str,
                k: int, max_queries: int = 50_000) -> DataFrame:
    """Exact cosine top-k of every query over all documents.

    The query set is checked to hold at most ``max_queries`` rows before it
    is shipped to the executors; documents stay distributed and are scored
    by a NumPy matrix product per Arrow batch, keeping a partial top-k per
    batch, then the partial lists are merged per query.
    """
    if not is_small(queries, max_queries):
        raise ValueError(f"query set larger than {max_queries}; use vector_index.top_k")
    qrows = queries.select(q_id, q_vec).collect()  # bounded by the check above
    qids = [r[0] for r in qrows]
    qmat = np.array([np.asarray(r[1], dtype=np.float64) for r in qrows])
    qn = qmat / np.maximum(np.linalg.norm(qmat, axis=1, keepdims=True), 1e-300)
    sc = docs.sparkSession.sparkContext
    bq = sc.broadcast((qids, qn))
    id_type = docs.schema[doc_id].dataType.simpleString()
    q_type = queries.schema[q_id].dataType.simpleString()

    def score(batches):
        ids, mat = bq.value
        for pdf in batches:
            if pdf.empty:
                continue
            d = np.vstack(pdf[vec_col].map(lambda a: np.asarray(a, dtype=np.float64)).to_numpy())
            dn = d / np.maximum(np.linalg.norm(d, axis=1, keepdims=True), 1e-300)
            sims = dn @ mat.T  # rows: docs, cols: queries
            kk = min(k, len(pdf))
            doc_ids = pdf[doc_id].to_numpy()
            out_q, out_d, out_s = [], [], []
            for j, qid in enumerate(ids):
                col = sims[:, j]
                order = np.lexsort((doc_ids, -col))[:kk]
                out_q += [qid] * kk
                out_d += doc_ids[order].tolist()
                out_s += col[order].tolist()
            yield pd.DataFrame({"_q": out_q, "_d": out_d, "score": out_s})

    part = docs.select(doc_id, vec_col).mapInPandas(score, f"_q {q_type}, _d {id_type}, score double")
    part = part.withColumnRenamed("_q", q_id).withColumnRenamed("_d", doc_id)
    return top_k_per_group(part, [q_id], [F.col("score").desc(), F.col(doc_id)], k, salt_of=F.xxhash64(doc_id))


def rrf(rankings: Sequence[DataFrame], q_id: str, doc_id: str, rank_col: str = "rank", k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion: sum over lists of 1 / (k + rank) per (query, doc)."""
    u = None
    for r in rankings:
        part = r.select(q_id, doc_id, (F.lit(1.0) / (F.lit(k) + F.col(rank_col))).alias("_rr"))
        u = part if u is None else u.unionByName(part)
    return u.groupBy(q_id, doc_id).agg(F.sum("_rr").alias("rrf_score"))


def semantic_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], vec_col: str,
                    threshold: float = 0.85) -> DataFrame:
    """Gaps and islands: a new chunk starts where cos(previous, current) < threshold.

    The break flag uses ``lag`` per (range bucket, key) with one halo row
    from the previous bucket; the chunk number is a skew-safe running sum of
    breaks; chunks are summarised with one grouped aggregate.
    """
    from clinlake.plans.halo import bucket_window, drop_halo, with_halo
    h = with_halo(df, keys, order, behind=1)
    prev = F.lag(vec_col).over(bucket_window(keys, order))
    brk = F.when(prev.isNull(), F.lit(1)).when(cosine(prev, F.col(vec_col)) < threshold, F.lit(1)).otherwise(0)
    flagged = drop_halo(h.withColumn("_brk", brk))
    numbered = running_sum(flagged, keys, order, ["_brk"], ["chunk_no"])
    first, last = F.struct(*[F.col(c) for c in order]), F.struct(*[F.col(c) for c in order])
    return numbered.groupBy(*keys, "chunk_no").agg(F.min(first).alias("_first"), F.max(last).alias("_last"),
                                                   F.count(F.lit(1)).alias("n_members"))


def nearest_centroid(df: DataFrame, vec_col: str, centroids: DataFrame, label: str, centroid_col: str,
                     out: str = "predicted", max_classes: int = 10_000) -> DataFrame:
    """Predicted class = the centroid with the highest cosine similarity.

    The centroid table (one row per class) is checked to be small, folded into
    one array row and attached by broadcast; similarities are array
    expressions (JVM-side)."""
    if not is_small(centroids, max_classes):
        raise ValueError("too many classes for a broadcast centroid table")
    packed = centroids.agg(F.collect_list(F.struct(F.col(label).alias("l"), F.col(centroid_col).alias("c")))
                           .alias("_cents"))
    j = df.crossJoin(F.broadcast(packed))  # one row, size checked above
    v = F.col(vec_col).cast("array<double>")
    sims = F.transform("_cents", lambda s: F.struct(cosine(s["c"], v).alias("sim"), (-s["l"]).alias("neg"),
                                                   s["l"].alias("l")))
    best = F.array_max(sims)
    return j.withColumn(out, best["l"]).drop("_cents")
