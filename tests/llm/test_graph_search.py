import numpy as np
import pytest
from pyspark.sql import functions as F

from clinlake.llm import graph_search
from tests.llm.data import SMOKE


def brute(rows, query_ids, k):
    """rows: id -> vector (float64)."""
    out = {}
    for q in query_ids:
        scores = [(-float((np.asarray(v) * np.asarray(rows[q])).sum()), i) for i, v in rows.items()
                  if i != q and len(v) == len(rows[q])]
        out[q] = sorted(scores)[:k]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, expected):
    """Share of the true nearest found; the scores and the order of those found are exact."""
    for q, rows in got.items():
        assert rows == sorted(rows) and len(set(rows)) == len(rows) and q not in [v for _, v in rows]
        assert len(rows) == len(expected[q])
        true = dict((v, s) for s, v in expected[q])
        assert all(abs(s - true[v]) < 1e-12 for s, v in rows if v in true)
    assert set(got) == set(expected)
    return sum(len({v for _, v in got[q]} & {v for _, v in expected[q]}) for q in got) / max(1, sum(map(len, expected.values())))


@pytest.mark.parametrize("sf,shard_rows", [("0.01", 8_192), ("0.01", 100), ("0.1", 8_192), ("0.1", 700)])
def test_recall_against_brute_force(spark, sf, shard_rows):
    df = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet")
    rows = {r.vec_id: r.embedding for r in df.collect()}
    got = found(graph_search.nearest(df, df.filter("vec_id % 20 = 0"), shard_rows=shard_rows, query_rows=30))
    assert recall(got, brute(rows, [i for i in rows if i % 20 == 0], 20)) >= 0.95


def test_query_on_smoke_table(spark):
    out = graph_search.op13_pruned_graph(spark, SMOKE)
    assert out.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    assert out.groupBy("query_id").count().filter("count <> 20").count() == 0


def test_recall_with_different_lengths_and_tight_groups():
    """Lengths that differ by half, a third of all points in one very tight group."""
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(3_000, 16))
    x[:1_000] = x[0] + rnd.normal(size=(1_000, 16)) * 1e-5
    x *= rnd.lognormal(0, 0.2, size=(3_000, 1)) / np.sqrt((x ** 2).sum(1, keepdims=True))
    points = graph_search.lifted(x, np.sqrt((x ** 2).sum(1).max()))
    graph = graph_search.build(points)
    assert (graph.edges >= 0).sum(1).max() <= graph_search.DEGREE
    asked = x[::20]
    targets = np.concatenate([asked / np.sqrt((asked ** 2).sum(1, keepdims=True)), np.zeros((len(asked), 1))], 1)
    got = graph.search(targets, 64)
    best = np.argsort(-(asked @ x.T), axis=1)[:, :20]
    hits = sum(len(set(g) & set(b)) for g, b in zip(got, best))
    assert hits / best.size >= 0.9


def test_prune_keeps_what_lies_in_other_directions():
    points = np.array([[0, 0], [1, 0], [2, 0], [0, 3], [-1, -1], [1.1, 0]])
    out = graph_search.prune(points, np.array([0]), np.array([[5, 4, 3, 2, 1, 0, 1, -1]]), 4, 1.2)
    assert list(out[0]) == [1, 4, 3, -1]  # 5 and 2 lie behind 1
    assert list(graph_search.prune(points, np.array([0]), np.array([[5, 4, 3, 2, 1]]), 2, 1.2)[0]) == [1, 4]


NAN, INF = float("nan"), float("inf")


def test_edges(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (20, [0.0, 2.0]), (40, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]),
            (4, [0.5, 0.5]), (5, None), (60, [0.0, 0.0]), (80, [NAN, 1.0]), (100, [INF, 1.0]), (7, [None, 1.0]), (8, []),
            (None, [1.0, 1.0]), (120, [1.0, 2.0, 3.0]), (9, [1.0, 2.0, 3.0]), (140, [1.0])]
    df = spark.createDataFrame([(i, v, "a", 1) for i, v in rows], "vec_id long, embedding array<float>, id string, vector int")
    for shard_rows in (8_192, 1):
        got = found(graph_search.nearest(df, df.filter("vec_id % 20 = 0"), shard_rows=shard_rows))
        usable = {0: [1, 0], 20: [0, 2], 40: [1, 0], 3: [1, 0], 2: [1, 0], 4: [0.5, 0.5], 120: [1, 2, 3], 9: [1, 2, 3], 140: [1]}
        assert got == {q: r for q, r in brute(usable, [0, 20, 40, 120, 140], 20).items() if r}
    none = df.filter("1 = 0")
    assert graph_search.nearest(none, none).count() == 0 and graph_search.nearest(df, none).count() == 0


def test_many_equal_vectors(spark):
    """A third of all rows hold one vector: it is one node, and all its rows are candidates."""
    rnd = np.random.default_rng(1)
    rows = {i: ([0.6, 0.8, 0.0] if i % 3 == 0 else rnd.normal(size=3).round(3).tolist()) for i in range(600)}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>").repartition(4)
    out = graph_search.nearest(df, df.filter(F.col("vec_id") % 20 == 0), shard_rows=90)
    assert recall(found(out), brute(rows, range(0, 600, 20), 20)) >= 0.95
