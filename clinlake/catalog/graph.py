"""Graph queries over the customer-nation-region and part-supplier edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from clinlake.operators import graph
from clinlake.session import table


def _edges(spark, sf):
    c = table(spark, sf, "customer", ["c_custkey", "c_nationkey"]).select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("src"),
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("dst"))
    s = table(spark, sf, "supplier", ["s_suppkey", "s_nationkey"]).select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("src"),
        F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("dst"))
    n = table(spark, sf, "nation", ["n_nationkey", "n_regionkey"]).select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("src"),
        F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("dst"))
    p = table(spark, sf, "lineitem", ["l_partkey", "l_suppkey"]).select(
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst")).distinct()
    return c.unionByName(s).unionByName(n).unionByName(p)


_EDGES_SQL = """
e AS (SELECT DISTINCT src, dst FROM (
  SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
  UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem))"""


def pagerank_20(spark, sf):
    pr = graph.pagerank(_edges(spark, sf), iterations=20, damping=0.85)
    return pr.select("node", F.round("rank", 12).alias("rank"))


def _pagerank_sql(iters=20, d=0.85):
    ctes = [_EDGES_SQL.strip(),
            "nodes AS (SELECT src AS node FROM e UNION SELECT dst FROM e)",
            "nn AS (SELECT count(*)::DOUBLE AS n FROM nodes)",
            "od AS (SELECT src, count(*) AS outdeg FROM e GROUP BY src)",
            "r0 AS (SELECT node, 1.0 / n AS rank, coalesce(outdeg, 0) AS outdeg FROM nodes, nn LEFT JOIN od ON od.src = node)"]
    for i in range(1, iters + 1):
        p = f"r{i - 1}"
        ctes.append(
            f"c{i} AS (SELECT e.dst, sum(rank / outdeg) AS c FROM e JOIN {p} ON e.src = {p}.node GROUP BY e.dst), "
            f"dm{i} AS (SELECT coalesce(sum(rank) FILTER (WHERE outdeg = 0), 0.0) AS dm FROM {p}), "
            f"r{i} AS (SELECT {p}.node, {1 - d!r} / n + {d!r} * (coalesce(c, 0.0) + dm / n) AS rank, outdeg "
            f"FROM {p} LEFT JOIN c{i} ON c{i}.dst = {p}.node, dm{i}, nn)")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT node, round(rank, 12) AS rank FROM r{iters}"


def ancestors_count(spark, sf):
    edges = _edges(spark, sf)
    regions = edges.filter(F.col("dst").startswith("r")).select(F.col("dst").alias("node"))
    return (graph.reachable_ancestors(edges, targets=regions).groupBy("node")
            .agg(F.count(F.lit(1)).alias("n_ancestors")))


_ANCESTORS_SQL = f"""
WITH RECURSIVE {_EDGES_SQL.strip()},
reach(node, ancestor) AS (SELECT dst, src FROM e
                          UNION SELECT r.node, e.src FROM reach r JOIN e ON e.dst = r.ancestor)
SELECT node, count(*) AS n_ancestors FROM reach WHERE node LIKE 'r%' GROUP BY node
"""


def _weighted_edges(spark, sf):
    li = table(spark, sf, "lineitem", ["l_partkey", "l_suppkey"])
    ps = li.groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    tot = li.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("t"))
    pw = ps.join(tot, "l_partkey").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"),
                                          F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"),
                                          (F.col("n") / F.col("t")).alias("w"))
    rest = _edges(spark, sf).filter(~F.col("src").startswith("p")).withColumn("w", F.lit(1.0))
    return pw.unionByName(rest)


def path_effects(spark, sf):
    e = _weighted_edges(spark, sf)
    targets = table(spark, sf, "region", ["r_regionkey"]).select(
        F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("target"))
    pe = graph.path_effects(e, targets, max_len=5)
    return pe.select("source", "target", F.round("total_effect", 9).alias("total_effect"), "n_paths", "shortest")


_PATH_SQL = f"""
WITH RECURSIVE {_EDGES_SQL.strip()},
pw AS (SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, count(*) / sum(count(*)) OVER (PARTITION BY l_partkey) AS w
       FROM lineitem GROUP BY l_partkey, l_suppkey),
we AS (SELECT src, dst, w FROM pw UNION ALL SELECT src, dst, 1.0 FROM e WHERE src NOT LIKE 'p%'),
fr(target, head, effect, path, len) AS (
  SELECT 'r' || r_regionkey, 'r' || r_regionkey, 1.0::DOUBLE, ['r' || r_regionkey], 0 FROM region
  UNION ALL
  SELECT fr.target, we.src, fr.effect * we.w, list_prepend(we.src, fr.path), fr.len + 1
  FROM fr JOIN we ON we.dst = fr.head WHERE fr.len < 5 AND NOT list_contains(fr.path, we.src))
SELECT head AS source, target, round(sum(effect), 9) AS total_effect, count(*) AS n_paths, CAST(min(len) AS INTEGER) AS shortest
FROM fr WHERE len > 0 GROUP BY head, target
"""


def literature_agreement(spark, sf):
    li = table(spark, sf, "lineitem", ["l_partkey", "l_suppkey", "l_returnflag"])
    learned = li.filter(F.col("l_returnflag") == "R").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    known = li.filter(F.col("l_returnflag") == "A").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    a = graph.edge_agreement(learned, known)
    return a.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "shd")


_AGREE_SQL = """
WITH a AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_returnflag = 'R'),
b AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_returnflag = 'A'),
c AS (SELECT count(*) FILTER (WHERE a.src IS NOT NULL AND b.src IS NOT NULL) AS tp,
             count(*) FILTER (WHERE a.src IS NOT NULL AND b.src IS NULL) AS fp,
             count(*) FILTER (WHERE a.src IS NULL AND b.src IS NOT NULL) AS fn
      FROM a FULL JOIN b ON a.src = b.src AND a.dst = b.dst),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS pr,
             CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS rc FROM c)
SELECT tp, fp, fn, round(pr, 6) AS precision, round(rc, 6) AS recall,
       round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END, 6) AS f1, fp + fn AS shd FROM m
"""


def betweenness_centrality(spark, sf):
    """Exact Brandes betweenness (every node a source) on the directed
    customer / part -> supplier -> nation -> region graph."""
    b = graph.betweenness(_edges(spark, sf))
    return b.select("node", F.round("betweenness", 6).alias("betweenness"))


def _betweenness_sql(depth: int = 4):
    ctes = [_EDGES_SQL.strip(), "nodes AS (SELECT src AS node FROM e UNION SELECT dst FROM e)",
            "l0 AS (SELECT node AS s, node AS v, 1.0::DOUBLE AS sigma FROM nodes)"]
    seen = ["l0"]
    for d in range(1, depth + 1):
        excl = " AND ".join(f"NOT EXISTS (SELECT 1 FROM {x} WHERE {x}.s = p.s AND {x}.v = e.dst)" for x in seen)
        ctes.append(f"l{d} AS (SELECT p.s, e.dst AS v, sum(p.sigma) AS sigma FROM l{d - 1} p JOIN e ON p.v = e.src "
                    f"WHERE {excl} GROUP BY p.s, e.dst)")
        seen.append(f"l{d}")
    ctes.append(f"b{depth} AS (SELECT s, v, sigma, 0.0::DOUBLE AS delta FROM l{depth})")
    for d in range(depth - 1, 0, -1):
        ctes.append(
            f"c{d} AS (SELECT p.s, p.v, sum(p.sigma / w.sigma * (1 + w.delta)) AS delta FROM l{d} p "
            f"JOIN e ON p.v = e.src JOIN b{d + 1} w ON w.s = p.s AND w.v = e.dst GROUP BY p.s, p.v), "
            f"b{d} AS (SELECT l{d}.s, l{d}.v, l{d}.sigma, coalesce(c{d}.delta, 0.0) AS delta FROM l{d} "
            f"LEFT JOIN c{d} ON c{d}.s = l{d}.s AND c{d}.v = l{d}.v)")
    union = " UNION ALL ".join(["SELECT node, 0.0::DOUBLE AS delta FROM nodes",
                                *[f"SELECT v AS node, delta FROM b{d}" for d in range(1, depth + 1)]])
    return ("WITH " + ",\n".join(ctes) + f"\nSELECT node, round(sum(delta), 6) AS betweenness FROM ({union}) "
            "GROUP BY node")


QUERIES = {
    "betweenness_centrality": betweenness_centrality,
    "pagerank_20": pagerank_20,
    "ancestors_count": ancestors_count,
    "path_effects": path_effects,
    "literature_agreement": literature_agreement,
}

ORACLE = {
    "betweenness_centrality": _betweenness_sql(),
    "pagerank_20": _pagerank_sql(),
    "ancestors_count": _ANCESTORS_SQL,
    "path_effects": _PATH_SQL,
    "literature_agreement": _AGREE_SQL,
}
