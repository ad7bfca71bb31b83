"""Graph operators over edge DataFrames.

Iterative algorithms are loops of joins and grouped aggregates with the
lineage cut by ``DataFrame.checkpoint()`` into the session's shared
``spark.checkpoint.dir`` every few rounds, so a lost executor recomputes at
most a few rounds.  All per-node state stays distributed.
"""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinlake.plans.broadcast import bounded_broadcast, sized_broadcast
from clinlake.session import checkpoint_dir

CHECKPOINT_EVERY = 5


def _cut(df: DataFrame, i: int, every: int = CHECKPOINT_EVERY) -> DataFrame:
    if (i + 1) % every == 0:
        checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    return df


def pagerank(edges: DataFrame, src: str = "src", dst: str = "dst", iterations: int = 20,
             damping: float = 0.85) -> DataFrame:
    """PageRank with uniform teleport and dangling mass spread uniformly.

    r' = (1 - d)/N + d * (sum_{u->v} r(u)/outdeg(u) + dangling/N)

    Teleport and dangling mass are the same for all nodes, so a round's result is a sum
    of the vectors y_j = (d P')^j (1/N), weighted by one number each.  A round is then one
    join of the edges (kept partitioned by their source) with the last y and one
    grouped sum; nodes without mass have no row, and the rounds end when none has.  The
    weights follow from the dangling mass of each y, iterations + 1 numbers."""
    checkpoint_dir(edges.sparkSession)
    e = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct()
    outdeg = e.groupBy("src").agg((F.lit(damping) / F.count(F.lit(1))).alias("w"))
    e = e.join(outdeg, "src").repartition("src").checkpoint(eager=True)
    nodes = e.select(F.col("src").alias("node")).union(e.select(F.col("dst").alias("node"))).distinct().checkpoint(eager=True)
    n = max(nodes.count(), 1)
    y, found = nodes.withColumn("y", F.lit(1.0 / n)), nodes.limit(0).select("node", F.lit(0).alias("j"), F.lit(0.0).alias("y"))
    for j in range(1, iterations + 1):
        y = e.join(y.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(
            F.sum(F.col("w") * F.col("y")).alias("y")).checkpoint(eager=True)
        if y.isEmpty():
            break
        found = found.unionByName(y.select("node", F.lit(j).alias("j"), "y"))
    dangling = nodes.join(e.select(F.col("src").alias("node")).distinct(), "node", "left_anti").checkpoint(eager=True)
    lost = {r["j"]: r["s"] for r in found.join(dangling, "node", "left_semi").groupBy("j").agg(F.sum("y").alias("s")).collect()}
    lost[0] = dangling.count() / n
    alpha: list[float] = []  # what every node gets in a round, times N
    for t in range(iterations):
        mass = lost.get(t, 0.0) + sum(alpha[t - 1 - j] * lost.get(j, 0.0) for j in range(t))
        alpha.append(1.0 - damping + damping * mass)
    weight = F.element_at(F.array(*[F.lit(a) for a in [*alpha[::-1], 1.0]]), F.col("j") + 1)
    first = (alpha[-1] if iterations else 1.0) / n
    moved = found.groupBy("node").agg(F.sum(weight * F.col("y")).alias("m"))
    return nodes.join(moved, "node", "left").select("node", (F.lit(first) + F.coalesce("m", F.lit(0.0))).alias("rank"))


def reachable_ancestors(edges: DataFrame, src: str = "src", dst: str = "dst", targets: DataFrame | None = None) -> DataFrame:
    """(node, ancestor) for every transitive predecessor of the ``targets``
    (column node; all nodes when None), by frontier joins to the fixpoint.  The
    edges are materialised once; only the targets' ancestors are built."""
    checkpoint_dir(edges.sparkSession)
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).distinct().checkpoint(eager=True)
    reach = e.select(F.col("b").alias("node"), F.col("a").alias("ancestor"))
    if targets is not None:
        reach = reach.join(targets.select("node").distinct(), "node", "left_semi")
    frontier = reach
    for i in itertools.count():
        step = (frontier.join(e, frontier.ancestor == e.b)
                .select("node", F.col("a").alias("ancestor")).distinct())
        new = step.join(reach, ["node", "ancestor"], "left_anti")
        new = _cut(new, i, every=1)
        if new.isEmpty():
            break
        reach = _cut(reach.unionByName(new), i)
        frontier = new
    return reach


def path_effects(edges: DataFrame, targets: DataFrame, src: str = "src", dst: str = "dst",
                 weight: str = "w", max_len: int = 5) -> DataFrame:
    """Sum over all simple paths of at most ``max_len`` edges from each source to
    each target of the product of edge weights.

    Backward frontier expansion from the targets: each round joins the
    frontier's head with incoming edges, skipping nodes already on the path
    (``array_contains`` on the carried path), and multiplies the weight.  The edges are
    written once, partitioned by their head, for all rounds.
    """
    checkpoint_dir(edges.sparkSession)
    e = edges.select(F.col(src).alias("_s"), F.col(dst).alias("_d"), F.col(weight).cast("double").alias("_w"))
    e = e.repartition("_d").checkpoint(eager=True)
    frontier = targets.select(F.col("target"), F.col("target").alias("head"), F.lit(1.0).alias("effect"),
                              F.array(F.col("target")).alias("path"))
    found = None
    for i in range(max_len):
        step = frontier.join(e, frontier["head"] == e["_d"]).filter(~F.array_contains("path", F.col("_s")))
        frontier = step.select("target", F.col("_s").alias("head"), (F.col("effect") * F.col("_w")).alias("effect"),
                               F.concat(F.array(F.col("_s")), F.col("path")).alias("path"))
        frontier = _cut(frontier, i)
        hop = frontier.select("target", F.col("head").alias("source"), "effect", F.lit(i + 1).alias("length"))
        found = hop if found is None else found.unionByName(hop)
    return found.groupBy("source", "target").agg(F.sum("effect").alias("total_effect"),
                                                  F.count(F.lit(1)).alias("n_paths"),
                                                  F.min("length").alias("shortest"))


def edge_agreement(learned: DataFrame, known: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Precision, recall, F1 and structural Hamming distance of two edge sets
    (one full outer join with presence flags)."""
    a = learned.select(src, dst).distinct().withColumn("_in_l", F.lit(1))
    b = known.select(src, dst).distinct().withColumn("_in_k", F.lit(1))
    j = a.join(b, [src, dst], "full")
    c = j.agg(F.count_if(F.col("_in_l").isNotNull() & F.col("_in_k").isNotNull()).alias("tp"),
              F.count_if(F.col("_in_l").isNotNull() & F.col("_in_k").isNull()).alias("fp"),
              F.count_if(F.col("_in_l").isNull() & F.col("_in_k").isNotNull()).alias("fn"))
    prec = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    rec = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    return c.select("tp", "fp", "fn", prec.alias("precision"), rec.alias("recall"), f1.alias("f1"),
                    (F.col("fp") + F.col("fn")).alias("shd"))


def edge_stability(runs: DataFrame, run_col: str, src: str, dst: str, weight: str, threshold: float = 0.7) -> DataFrame:
    """Share of runs in which an edge has weight above ``threshold``."""
    n = runs.agg(F.countDistinct(run_col).alias("_runs"))
    per = runs.groupBy(src, dst).agg(F.count_if(F.col(weight) > threshold).alias("_hits"))
    return per.crossJoin(bounded_broadcast(n)).select(src, dst, (F.col("_hits") / F.col("_runs")).alias("stability"))


def adjacency_edges(matrix: DataFrame, id_col: str, row_col: str, names: list[str], threshold: float) -> DataFrame:
    """Adjacency matrix rows (id, row index, array of weights) -> edges with
    |w| > threshold via ``posexplode`` (type by index distance)."""
    ex = matrix.select(id_col, row_col, F.posexplode(F.col("weights")).alias("j", "w"))
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("j") + 1)
    src = F.element_at(F.array(*[F.lit(n) for n in names]), F.col(row_col) + 1)
    return ex.filter(F.abs("w") > threshold).select(id_col, src.alias("src"), name.alias("dst"), "w",
                                                    F.when(F.abs(F.col(row_col) - F.col("j")) == 1, "direct")
                                                    .otherwise("indirect").alias("edge_type"))


def break_cycles(edges: DataFrame, graph_id: str, src: str = "src", dst: str = "dst", weight: str = "w") -> DataFrame:
    """Make every graph acyclic: while a cycle exists, remove its weakest edge (|w|).

    Graphs are processed independently (``groupBy(graph).applyInPandas``); a
    graph's size is bounded by its node set (variables of one patient's causal
    model), not by the data volume.  Cycles are found by a DFS over nodes in
    sorted order, so the result is repeatable.
    """
    gtype = edges.schema[graph_id].dataType.simpleString()
    stype = edges.schema[src].dataType.simpleString()

    def fix(pdf: pd.DataFrame) -> pd.DataFrame:
        adj: dict = {}
        wt: dict = {}
        for s, d, w in zip(pdf[src], pdf[dst], pdf[weight]):
            adj.setdefault(s, set()).add(d)
            wt[(s, d)] = float(w)

        def find_cycle():
            color: dict = {}
            stack: list = []

            def dfs(u):
                color[u] = 1
                stack.append(u)
                for v in sorted(adj.get(u, ())):
                    if color.get(v, 0) == 1:
                        return stack[stack.index(v):] + [v]
                    if color.get(v, 0) == 0:
                        c = dfs(v)
                        if c:
                            return c
                stack.pop()
                color[u] = 2
                return None

            for node in sorted(set(adj) | {v for vs in adj.values() for v in vs}):
                if color.get(node, 0) == 0:
                    c = dfs(node)
                    if c:
                        return c
            return None

        while True:
            cyc = find_cycle()
            if not cyc:
                break
            cyc_edges = list(zip(cyc[:-1], cyc[1:]))
            weak = min(cyc_edges, key=lambda e: (abs(wt[e]), e))
            adj[weak[0]].discard(weak[1])
            del wt[weak]
        rows = [(pdf[graph_id].iloc[0], s, d, w) for (s, d), w in sorted(wt.items())]
        return pd.DataFrame(rows, columns=[graph_id, src, dst, weight])

    return edges.select(graph_id, src, dst, F.col(weight).cast("double").alias(weight)).groupBy(graph_id) \
        .applyInPandas(fix, f"{graph_id} {gtype}, {src} {stype}, {dst} {stype}, {weight} double")


# Causal role cut points on edge weight.
PROTECTIVE_BELOW, AMPLIFIER_ABOVE = 0.35, 0.45


def causal_role(w: str):
    c = F.col(w)
    return F.when(c < PROTECTIVE_BELOW, "protective").when(c > AMPLIFIER_ABOVE, "amplifier").otherwise("neutral")


def betweenness(edges: DataFrame, src: str = "src", dst: str = "dst", sources: DataFrame | None = None) -> DataFrame:
    """Brandes betweenness (directed) from the given source nodes (all nodes when None).

    Forward: a BFS for every source at once by joins, keeping (source, node,
    sigma = number of shortest paths) one level at a time (lineage cut per level).
    The first level is the edges themselves.  Beyond it only edges whose tail is
    itself reached go on (broadcast when they are few), and a level's rows are told
    from nodes met before in the aggregate that sums sigma, among nodes that this
    level can reach.  Backward: dependencies
    delta(s, v) = sum over successors w on the next level of
    sigma(v) / sigma(w) * (1 + delta(s, w)), level by level from the deepest; those
    of the first level are summed per node at once.
    Betweenness(v) = sum over sources of delta(s, v).  Sampling sources gives
    the usual approximation; all sources give the exact value.
    """
    checkpoint_dir(edges.sparkSession)
    e = edges.select(F.col(src).alias("_a"), F.col(dst).alias("_b")).distinct().checkpoint(eager=True)
    nodes = e.select(F.col("_a").alias("node")).union(e.select(F.col("_b").alias("node"))).distinct()
    e = e.filter("_a <> _b")  # loops are on no shortest path
    level = e.select(F.col("_a").alias("s"), F.col("_b").alias("v"), F.lit(1.0).alias("sigma"))
    if sources is not None:
        level = _cut(level.join(sources.select(F.col("node").alias("s")).distinct(), "s", "left_semi"), 0, every=1)
    inner = _cut(e.join(e.select(F.col("_b").alias("_a")).distinct(), "_a", "left_semi"), 0, every=1)
    seen = level.select("s", "v")
    levels, steps = [level], []  # steps[i]: the edges from nodes of levels[i]
    for i in itertools.count():
        reached = level.select(F.col("v").alias("_a")).distinct()
        step = _cut(inner.join(reached, "_a", "left_semi"), 0, every=1)
        if step.isEmpty():
            break
        heads = sized_broadcast(step.select(F.col("_b").alias("v")).distinct())
        step = sized_broadcast(step)
        met = seen.join(heads, "v", "left_semi").select("s", "v", F.lit(0.0).alias("sigma"), F.lit(True).alias("_met"))
        found = level.join(step, F.col("v") == F.col("_a")).filter("s <> _b").select(
            "s", F.col("_b").alias("v"), "sigma", F.lit(False).alias("_met"))
        nxt = found.unionByName(met).groupBy("s", "v").agg(F.sum("sigma").alias("sigma"), F.max("_met").alias("_met"))
        nxt = _cut(nxt.filter("not _met").drop("_met"), 0, every=1)
        if nxt.isEmpty():
            break
        levels.append(nxt)
        steps.append(step)
        seen = _cut(seen.unionByName(nxt.select("s", "v")), i)
        level = nxt
    out = nodes.select("node", F.lit(0.0).alias("delta"))  # nodes on no shortest path score 0
    deeper = levels[-1].withColumn("delta", F.lit(0.0))
    for cur, step in zip(reversed(levels[:-1]), reversed(steps)):
        w = deeper.select("s", F.col("v").alias("_b"), F.col("sigma").alias("_sw"), F.col("delta").alias("_dw"))
        share = (F.col("sigma") / F.col("_sw") * (1 + F.col("_dw"))).alias("delta")
        if cur is levels[0]:
            out = out.unionByName(cur.join(step, F.col("v") == F.col("_a")).join(w, ["s", "_b"]).select(
                F.col("v").alias("node"), share))
            break
        paths = cur.join(step, F.col("v") == F.col("_a"), "left").join(w, ["s", "_b"], "left")
        deeper = _cut(paths.groupBy("s", "v").agg(F.max("sigma").alias("sigma"), F.coalesce(F.sum(share), F.lit(0.0)).alias(
            "delta")), 0, every=1)
        out = out.unionByName(deeper.select(F.col("v").alias("node"), "delta"))
    return out.groupBy("node").agg(F.sum("delta").alias("betweenness"))
