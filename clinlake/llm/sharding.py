"""K-d tree sharding by bytes.

A document is a point whose coordinates come from its text alone: size in
bytes, share of multi-byte characters and line density.  Equal texts are the
same point and always share a shard.  The tree splits a node along its widest
coordinate at the weighted median (weighted quantile when the node holds an odd
number of leaves) until every leaf is one shard.  A point that outweighs a shard takes one to
itself; the tree divides the others among the remaining shards, and a cut that falls
beside its quantile leaves each side shards by the weight that lies there.

The split point is found without sorting or collecting rows: a coordinate and
the text's hash are joined into one 42-bit integer, and three rounds of 14-bit
histograms, aggregated per open node, narrow it down.  Only one row per open
node reaches the driver.  Rows that share a coordinate value are divided by
their hash, so a value held by a third of all rows does not unbalance a split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinlake.llm.common import hash_index, read, staged, unit

COORD_BITS, HASH_BITS, ROUND_BITS = 16, 26, 14
ROUNDS = (COORD_BITS + HASH_BITS) // ROUND_BITS


def points(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, size, crc, k0..k2): each k is a coordinate quantised to 16 bits
    followed by 26 bits of the text's hash."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("id"), t.alias("t"), F.octet_length(t).cast("long").alias("n"),
                     F.length(t).cast("long").alias("c"), F.size(F.split(t, "\n")).alias("ls"))
    top = 2 ** COORD_BITS - 1
    coords = [F.log2(F.col("n") + 1) / 40,
              (F.col("n") - F.col("c")) / F.greatest(F.col("n"), F.lit(1)),
              F.log2(F.col("ls")) / (F.log2(F.col("n") + 1) + 1)]
    tie = F.shiftright(unit(F.xxhash64(F.lit("shard"), "t")), 31 - HASH_BITS)
    return df.select(
        "id", (F.col("n") + 16).alias("size"), F.crc32(F.encode("t", "UTF-8")).alias("crc"),
        *[(F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * top).cast("long") * F.lit(2 ** HASH_BITS)
           + tie).alias(f"k{i}") for i, x in enumerate(coords)])


def _assign(tree: dict, dims: Sequence[str], number: dict | None = None) -> Column:
    """Node id of each row's leaf (or its ``number``) as nested comparisons."""
    def walk(node):
        if node not in tree:
            return F.lit(number[node] if number else node)
        dim, cut, left, right = tree[node]
        return F.when(F.col(dims[dim]) < F.lit(cut), walk(left)).otherwise(walk(right))
    return walk(0)


def _narrow(rows: DataFrame, state: list[dict]) -> list[dict]:
    """One histogram round: for each open node the bin of its key range in which
    the target weight is reached, and the weight below that bin."""
    st = F.broadcast(rows.sparkSession.createDataFrame(  # one row per open node
        [(s["node"], s["lo"], s["width"], float(s["want"])) for s in state],
        "sn int, lo long, width long, want double"))
    b = rows.join(st, F.col("node") == F.col("sn")).filter(
        (F.col("key") >= F.col("lo")) & (F.col("key") < F.col("lo") + F.col("width") * F.lit(2 ** ROUND_BITS)))
    hist = b.groupBy("node", "want", F.floor((F.col("key") - F.col("lo")) / F.col("width")).alias("bin")).agg(
        F.sum("size").alias("w"))
    upto = F.sum("w").over(Window.partitionBy("node").orderBy("bin"))  # at most 2^14 rows a node
    hit = (hist.withColumn("upto", upto).filter(F.col("upto") >= F.col("want"))
           .groupBy("node").agg(F.min_by(F.struct("bin", "w", "upto"), "bin").alias("h")).collect())
    found = {r["node"]: r["h"] for r in hit}
    out = []
    for s in state:
        h = found[s["node"]]
        out.append(s | {"lo": s["lo"] + h["bin"] * s["width"], "want": s["want"] - (h["upto"] - h["w"]),
                        "bin_w": h["w"], "width": s["width"] // 2 ** ROUND_BITS})
    return out


def kd_tree(pts: DataFrame, n_leaves: int) -> dict:
    """node -> (dimension, cut, left, right); nodes not in it are leaves (a node of
    a single point is always one).  Leaf ids are turned into 0..n-1 by ``leaf_numbers``."""
    dims = [c for c in pts.columns if c.startswith("k")]
    tree, open_nodes, fresh = {}, {0: n_leaves}, 1
    while open_nodes:
        rows = pts.withColumn("node", _assign(tree, dims))
        spans = rows.groupBy("node").agg(F.sum("size").alias("w"), *[
            (F.max(k) - F.min(k)).alias(f"s{i}") for i, k in enumerate(dims)]).collect()  # a row per node
        info = {r["node"]: r for r in spans}
        if not tree:  # spans are compared as shares of the whole table's
            scale = [max((r[f"s{i}"] for r in spans), default=0) or 1 for i in range(len(dims))]
        state = []
        for node, leaves in open_nodes.items():
            if leaves < 2 or node not in info:
                continue
            r = info[node]
            wide = max(range(len(dims)), key=lambda i: (r[f"s{i}"] / scale[i], -i))
            if not r[f"s{wide}"]:
                continue
            state.append({"node": node, "dim": wide, "lo": 0, "width": 2 ** (ROUND_BITS * (ROUNDS - 1)),
                          "want": r["w"] * (leaves // 2) / leaves, "leaves": leaves, "w": r["w"],
                          "goal": r["w"] * (leaves // 2) / leaves})
        if not state:
            break
        pick = F.coalesce(*[F.when(F.col("node") == s["node"], F.col(dims[s["dim"]])) for s in state])
        keyed = rows.select("node", pick.alias("key"), "size").filter(F.col("key").isNotNull())
        for _ in range(ROUNDS):
            state = _narrow(keyed, state)
        following = {}
        for s in state:
            # the last bin is one key: it goes to the side it unbalances less, but no side stays empty
            below = round(s["goal"] - s["want"])
            key_left = not below or (s["want"] * 2 >= s["bin_w"] and below + s["bin_w"] < s["w"])
            tree[s["node"]] = (s["dim"], s["lo"] + key_left, fresh, fresh + 1)
            left = round(s["leaves"] * (below + key_left * s["bin_w"]) / s["w"])
            following[fresh] = min(max(left, 1), s["leaves"] - 1)
            following[fresh + 1] = s["leaves"] - following[fresh]
            fresh += 2
        open_nodes = following
    return tree


def leaf_numbers(tree: dict) -> dict:
    """node id of a leaf -> shard number, in tree order."""
    numbers = {}

    def walk(node):
        if node not in tree:
            numbers[node] = len(numbers)
            return
        walk(tree[node][2])
        walk(tree[node][3])
    walk(0)
    return numbers


def heavy_points(pts: DataFrame, n_shards: int, total: int) -> list[tuple]:
    """The points that outweigh an equal part of what the others leave, heaviest
    first (fewer than ``n_shards``)."""
    dims = [c for c in pts.columns if c.startswith("k")]
    most = pts.groupBy(*dims).agg(F.sum("size").alias("w")).filter(F.col("w") * F.lit(2 * n_shards) > F.lit(total))
    heavy, left = [], total
    for r in most.orderBy(F.desc("w"), *dims).limit(n_shards - 1).collect():
        if r["w"] * (n_shards - len(heavy)) <= left:
            break
        heavy.append(tuple(r[c] for c in dims))
        left -= r["w"]
    return heavy


def shard(docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: size (UTF-8 bytes plus 16), crc32 of the text, shard
    and slot (0-based, gapless within the shard).

    Give ``n_shards``, or ``target_bytes`` for as many leaves as that needs.
    Nulls: a null text is empty; a null id stays.  Repeated rows share a shard
    and take a slot each.  An empty table gives an empty table."""
    pts = staged(points(docs, id_col, text_col), "points")
    total = pts.agg(F.sum("size").alias("w")).first()["w"] or 0
    if n_shards is None:
        n_shards = max(1, -(-total // target_bytes))
    dims = [c for c in pts.columns if c.startswith("k")]
    rest, own = pts, None
    if heavy := heavy_points(pts, n_shards, total) if n_shards > 1 else []:
        alone = F.broadcast(docs.sparkSession.createDataFrame(  # fewer rows than shards
            [(*k, i) for i, k in enumerate(heavy)], [*(f"h{c}" for c in dims), "own"]))
        same = [F.col(c) == F.col(f"h{c}") for c in dims]
        pts = staged(pts.join(alone, same, "left").select(*pts.columns, "own"), "points")
        rest, own = pts.filter("own is null"), F.col("own")
    tree = kd_tree(rest, n_shards - len(heavy))
    numbers = leaf_numbers(tree)
    in_tree = _assign(tree, dims, numbers)
    number = in_tree if own is None else F.coalesce(own + F.lit(len(numbers)), in_tree)
    rows = pts.select("id", "size", "crc", number.cast("int").alias("shard"))
    return hash_index(rows, ["shard"], ["id", "crc"], "slot").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", "slot")


def op7_kd_shards(spark, sf_dir):
    out = shard(read(spark, sf_dir, "documents", "doc_id", "text"), n_shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op7_kd_shards": op7_kd_shards}
