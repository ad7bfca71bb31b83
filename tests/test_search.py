"""Sparse and dense search against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from clinlake.operators import sparse_search, vector_index


def corpus(n=400, seed=3):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(120)]
    weights = [1 / (i + 1) for i in range(120)]  # some words stand in nearly all documents
    docs = [(i, " ".join(rnd.choices(vocab, weights, k=rnd.randint(0, 60)))) for i in range(n)]
    docs += [(n + i, docs[5][1].upper()) for i in range(7)] + [(n + 7, None), (n + 8, " \t\n")]
    queries = [(f"q{i}", " ".join(rnd.choices(vocab, weights, k=rnd.randint(1, 9)))) for i in range(40)] + [("none", "xyz"), ("empty", "")]
    return docs, queries


def bm25(docs, queries, k):
    toks = {i: (t or "").lower().split() for i, t in docs}
    n, mean = len(docs), sum(map(len, toks.values())) / len(docs)
    df = Counter(t for ts in toks.values() for t in set(ts))
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: floor if v < 0 else v for t, v in raw.items()}
    out = {}
    for q, text in queries:
        scores = {}
        for i, ts in toks.items():
            tf, shared = Counter(ts), [t for t in text.lower().split() if t in set(ts)]
            if shared:
                scores[i] = sum(idf[t] * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(ts) / mean)) for t in shared)
        out[q] = [i for i, _ in sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]]
    return {q: r for q, r in out.items() if r}


def ranked(df, q, d):
    out = {}
    for r in df.orderBy(q, "rank").collect():
        out.setdefault(r[q], []).append(r[d])
    return out


@pytest.mark.parametrize("block_docs, block_terms, parts", [(512, 2_000_000, 3), (16, 60, 1), (3, 25, 5)])
def test_bm25_and_jaccard_against_brute_force(spark, monkeypatch, block_docs, block_terms, parts):
    """Small blocks make the bounds of the k-th score skip documents and terms."""
    monkeypatch.setattr(sparse_search, "BLOCK_DOCS", block_docs)
    monkeypatch.setattr(sparse_search, "HELD_TERMS", 50 if block_docs < 512 else 400_000)
    docs, queries = corpus()
    d = spark.createDataFrame(docs, "doc string, body string".replace("doc string", "doc long")).repartition(parts)
    q = spark.createDataFrame(queries, "item string, ask string")
    assert ranked(sparse_search.bm25_top_k(d, "doc", "body", q, "item", "ask", 5, block_terms), "item", "doc") == bm25(docs, queries, 5)
    sets = {i: set((t or "").lower().split()) for i, t in docs}
    expected = {}
    for item, text in queries:
        a = set(text.split())
        scored = [(-len(a & s) / len(a | s), i) for i, s in sets.items() if a & s]
        if scored:
            expected[item] = [i for _, i in sorted(scored)[:4]]
    assert ranked(sparse_search.jaccard_top_k(d, "doc", "body", q, "item", "ask", 4, block_terms), "item", "doc") == expected


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "doc long, body string")
    q = spark.createDataFrame([("a", "x y")], "item string, ask string")
    for search in (sparse_search.bm25_top_k, sparse_search.jaccard_top_k):
        assert search(none, "doc", "body", q, "item", "ask", 3).count() == 0
        some = spark.createDataFrame([(1, "x")], "doc long, body string")
        assert search(some, "doc", "body", q.filter("1 = 0"), "item", "ask", 3).count() == 0


def test_only_the_best_of_each_task_are_shuffled(spark):
    docs, queries = corpus()
    d = spark.createDataFrame(docs, "doc long, body string").repartition(4)
    low = sparse_search._low(d, "doc", "body")
    terms = sparse_search.QueryTerms([(q, t, 1.0) for q, text in queries for t in set(text.split())])
    sent = spark.sparkContext.broadcast(vars(terms))
    rows = low.mapInArrow(sparse_search._scorer(sent, 3, lambda tf, dl: tf / (tf + 1), None), "q string, d long, score double")
    assert rows.count() <= low.rdd.getNumPartitions() * len(queries) * 3


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_vector_index_recall(spark, sf):
    """50 row vectors as queries, top 10 of all rows by cosine: at least 0.9 found."""
    emb = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet").select("vec_id", "embedding")
    pdf = emb.toPandas().sort_values("vec_id")
    x = np.stack(pdf["embedding"].to_numpy()).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = pdf["vec_id"].to_numpy()
    chosen = np.linspace(0, len(ids) - 1, 50).astype(int)
    asked = emb.filter(F.col("vec_id").isin(ids[chosen].tolist())).withColumnsRenamed({"vec_id": "q", "embedding": "v"})
    for cell_rows in (vector_index.CELL_ROWS, 20):  # whole cells, and cells in parts
        index = vector_index.build(emb, "vec_id", "embedding", cell_rows=cell_rows)
        assert index.codes.count() == len(ids)
        got = ranked(vector_index.top_k(index, asked, "q", "v", 10), "q", "vec_id")
        hits = sum(len(set(ids[np.lexsort((ids, -(x @ x[i])))[:10]]) & set(got[ids[i]])) for i in chosen)
        assert hits >= 0.9 * 500 and all(len(v) == 10 for v in got.values())


def test_vector_index_edges(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [0.5, 0.5])],
                               "id long, vec array<float>")
    q = spark.createDataFrame([("a", [2.0, 0.0])], "q string, v array<double>")
    rows = vector_index.top_k(vector_index.build(df, "id", "vec"), q, "q", "v", 9).orderBy("rank").collect()
    assert [r.id for r in rows] == [1, 2, 5] and abs(rows[0].score - 1) < 1e-6
    assert vector_index.top_k(vector_index.build(df.filter("1 = 0"), "id", "vec"), q, "q", "v", 9).count() == 0
