"""Exact n-gram Jaccard join in the metric space of shingle sets.

Two documents link when the Jaccard similarity of their shingle sets is at
least ``num / den``.  The size of the symmetric difference, |x ^ y|, is a metric
on sets, and a link whose smaller set has a members needs
|x ^ y| <= a * (den - num) / num.

Pivots and regions.  Unrelated shingle sets are all equally far apart, so cells
around whole documents alone would hold everything.  The space is divided twice
by pivots at which distances do separate:

* The empty set.  Its distance to x is |x|, its cells are size rings, and by the
  triangle inequality a document near the border of a ring is copied into the
  ring below (``rings``).
* In each ring the shingle universe is split by a hash into more parts than a
  linked pair can have differences, so two linked documents have the same
  projection on some part.  Every projection is a pivot; its region holds the
  documents at distance 0 from it there (``region_keys``).

A region of at most four members is joined pair by pair.  Inside a larger one
the pivot is a document p, the member that meets most others
(regions of one family agree on it, and are joined together).  Every member x is
described by its difference D(x) = x ^ p, for which |D(x) ^ D(y)| = |x ^ y|:

* a member within the limit of p links with p;
* if |D(x)| + |D(y)| is within the limit, the triangle inequality puts both
  within the limit of p, so p connects them;
* otherwise x and y share part of their differences, and the join goes down one
  level, to regions around single elements: in any order that both keep (here
  those that fewest members of p differ in come first), the first
  shared element lies among the first K/2 + 1 of the smaller difference and the
  first K + 1 of the larger (K: the limit).  Where it is the i-th and the j-th
  (from 0), i + j elements before it are differences of x and y, and so is what one has more
  behind it than the other: pairs for which that is more than K do not meet.  As what x
  and y share with other members comes last, that is close to their distance.

Members of one class need not meet again.  Candidates that remain are cut down
by a lower bound of the distance (64-bin histograms) and decided on the full
sets, so no link is lost or invented; only collisions of 64-bit hashes are
neglected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinlake.llm.common import read, release_memory, staged
from clinlake.plans.broadcast import sized_broadcast

BINS = 64
RING = 1.4
MAX_WORDS = 100_000
NO_KEYS = np.empty(0, np.int64)
#: So many keys of regions with several members are sent to all executors (8 bytes
#: each); more are joined by a shuffle.
LIVE_KEYS, BLOCK_KEYS = 3_000_000, 400_000
#: Regions of so many members are joined pair by pair.
FEW = 4


class WordHash(dict):
    """word -> 64-bit hash; remembers a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MAX_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int, known: WordHash) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a text (A-Z lower-cased,
    words split at ASCII white space); a shorter text is one shingle, no word: none."""
    found = text.encode("utf-8", "replace").lower().split() if isinstance(text, str) else []
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, found), dtype=np.uint64, count=len(found))
    w = min(k, len(h))
    x = np.full(len(h) - w + 1, w, dtype=np.uint64)
    for i in range(w):  # order-sensitive: each word is mixed into what came before
        x = mix(x * np.uint64(0x9E3779B97F4A7C15) + h[i:len(h) - w + 1 + i])
    return np.unique(x)


def parities(s: np.ndarray) -> np.ndarray:
    """For each of 256 classes of elements whether the set holds an odd number: four words.
    The parities of two sets differ in at most as many classes as the sets have differences."""
    odd = np.bincount(((s >> np.uint64(20)) & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def set_id(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - 2 ** 63


def most_differences(a: int, num: int, den: int) -> int:
    """Largest symmetric difference of a linked pair whose smaller set has ``a`` members."""
    return a * (den - num) // num


def rings(n: int, num: int, den: int) -> list[tuple[int, int, int]]:
    """(ring, parts, differences) of every ring that may hold the smaller set of
    a link with a set of size ``n`` (its own ring, and the one below near the border)."""
    least, lo, ring, out = -(-n * num // den), 1, 0, []
    while lo <= n:
        hi = max(lo + 1, int(lo * RING))  # sizes lo .. hi - 1
        if hi > least:
            k = most_differences(hi - 1, num, den)
            spare = k // 4 if 6 * (den - num) > num else k // 10
            out.append((ring, k + 2 + spare, k))
        lo, ring = hi, ring + 1
    return out


def region_keys(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of the regions that a set lies in: its projections on the parts of each ring.

    With p parts and at most d differences, p - d parts agree.  Projections of
    few members are weak pivots, many unrelated sets share them.  Where fewer
    than p - d parts have less than three (or two) members, those are left out:
    an agreeing part is still among the others.  Else parts of one member count
    in twos: if no agreeing part has two members, then of the p - d at least
    p - d - z have one (z: empty parts), so two of them lie at most
    (p - 1) / (p - d - z - 1) parts apart; each such two make one key.  Where z
    leaves less than two, the weak parts are keys themselves."""
    keys = []
    base = mix(s ^ np.uint64(0x51ED270B))
    value = mix(base + np.uint64(0x632BE59BD9B4E019))
    for ring, parts, differ in rings(len(s), num, den):
        part = (base >> np.uint64(32)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        size = np.bincount(part.astype(np.int64), minlength=parts)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(value[order], dtype=np.uint64)])
        ends = np.cumsum(size)
        total, agree = sums[ends] - sums[ends - size], parts - differ
        tag = np.uint64((ring + 1) << 32)
        key = mix(total ^ mix(tag + np.arange(parts, dtype=np.uint64)) ^ (size.astype(np.uint64) << np.uint64(20)))
        least = next((m for m in (3, 2) if (size < m).sum() < agree), 0)
        keys.append(key[size >= (least or 2)])
        if least:
            continue
        empty, single = int((size == 0).sum()), np.flatnonzero(size == 1)
        sure = agree - empty >= 2
        apart = (parts - 1) // (agree - empty - 1) if sure else parts
        for step in range(1, len(single)):
            near = single[step:] - single[:-step] <= apart
            if not near.any():
                break
            keys.append(mix(key[single[:-step][near]] * np.uint64(0x9E3779B97F4A7C15) + key[single[step:][near]]))
        if not sure:
            keys.append(key[single])
            if empty >= agree:
                keys.append(key[size == 0])
    return np.concatenate(keys) if keys else np.empty(0, np.uint64)


def _signed(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(id, sid, n, hist, keys) of each document; an empty set has a null sid.
    A set met before in the same task has no keys again, so a group of copies
    weighs as much as the tasks that hold it."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, seen = WordHash(), set()

        def keys(s):
            if (sid := set_id(s)) in seen:
                return NO_KEYS
            if len(seen) > MAX_WORDS:
                seen.clear()
            seen.add(sid)
            return region_keys(s, num, den).view(np.int64)
        for pdf in batches:
            for lo in range(0, len(pdf), 1_000):
                part = pdf.iloc[lo:lo + 1_000]
                sets = [shingles(t, k, known) for t in part["t"]]
                yield pd.DataFrame({
                    "id": part["id"].astype("Int64"),
                    "sid": pd.array([set_id(s) if len(s) else None for s in sets], dtype="Int64"),
                    "n": [len(s) for s in sets],
                    "hist": [np.minimum(np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=BINS), 65535)
                             .astype("<u2").tobytes() for s in sets],
                    "keys": [keys(s) for s in sets]})
        known.clear()
        seen.clear()
        release_memory()
    return docs.mapInPandas(run, "id long, sid long, n long, hist binary, keys array<long>")


def _full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(sid, members) of the sets of the documents whose ids are in ``wanted``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHash()
        for pdf in batches:
            for lo in range(0, len(pdf), 1_000):
                sets = [s for t in pdf["t"].iloc[lo:lo + 1_000] if len(s := shingles(t, k, known))]
                yield pd.DataFrame({"sid": [set_id(s) for s in sets], "members": [s.tobytes() for s in sets]})
    ids = wanted.select(F.col("rep").alias("wid")).distinct()
    hit = docs.join(sized_broadcast(ids), F.col("id").eqNullSafe(F.col("wid")), "left_semi")
    return hit.mapInPandas(run, "sid long, members binary")


def _near(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose sizes and histograms allow a link."""
    side = lambda c: sets.select(F.col("sid").alias(f"s{c}"), F.col("n").alias(f"n{c}"),
                                 F.col("hist").alias(f"h{c}"))
    both = (pairs.join(side("a"), F.col("a") == F.col("sa")).join(side("b"), F.col("b") == F.col("sb"))
            .filter(F.least("na", "nb") * den >= F.greatest("na", "nb") * num))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x, y = (np.frombuffer(b"".join(pdf[c]), dtype="<u2").reshape(len(pdf), BINS).astype(np.int32)
                        for c in ("ha", "hb"))
                ok = np.abs(x - y).sum(1) <= np.minimum(pdf["na"], pdf["nb"]).to_numpy() * (den - num) // num
                yield pdf.loc[ok, ["a", "b"]]
    return both.select("a", "b", "na", "nb", "ha", "hb").mapInPandas(run, "a long, b long")


def _members_of(docs: DataFrame, ids: DataFrame, k: int, name: str) -> DataFrame:
    return staged(_full_sets(docs, ids, k).dropDuplicates(["sid"]), f"sets-{name}")


def _links(near: DataFrame, members: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that are links, decided on the full sets."""
    side = lambda c: members.select(F.col("sid").alias(f"s{c}"), F.col("members").alias(f"m{c}"))
    both = near.join(side("a"), F.col("a") == F.col("sa")).join(side("b"), F.col("b") == F.col("sb"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = []
            for x, y in zip(pdf["ma"], pdf["mb"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                inter = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(den * inter >= num * (len(x) + len(y) - inter))
            yield pdf.loc[np.array(ok, dtype=bool), ["a", "b"]]
    return staged(both.select("a", "b", "ma", "mb").mapInPandas(run, "a long, b long"), "links")


def _around_pivots(pairs: DataFrame, members: DataFrame, num: int, den: int) -> DataFrame:
    """(p, x, k, d, linked, diff, odd) of each member x of a pivot p: its limit k, the
    size of its difference, whether it links with p, (where p has further
    members) the difference, and the parities of x."""
    many = pairs.groupBy("p").agg((F.count(F.lit(1)) > 1).alias("many")).withColumnRenamed("p", "gp")
    side = lambda c: members.select(F.col("sid").alias(f"s{c}"), F.col("members").alias(f"m{c}"))
    both = (pairs.join(many, F.col("p") == F.col("gp")).join(side("x"), F.col("x") == F.col("sx"))
            .join(side("p"), F.col("p") == F.col("sp")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p, x, more, mx, mp in zip(pdf["p"], pdf["x"], pdf["many"], pdf["mx"], pdf["mp"]):
                a, b = np.frombuffer(mx, np.uint64), np.frombuffer(mp, np.uint64)
                own, lost = np.setdiff1d(a, b, assume_unique=True), np.setdiff1d(b, a, assume_unique=True)
                k, d, inter = most_differences(len(a), num, den), len(own) + len(lost), len(a) - len(own)
                out.append((p, x, k, d, den * inter >= num * (inter + d),
                            np.concatenate([own, lost]).view(np.int64) if more else None, parities(a)))
            yield pd.DataFrame(out, columns=["p", "x", "k", "d", "linked", "diff", "odd"])
    return both.select("p", "x", "many", "mx", "mp").mapInPandas(
        run, "p long, x long, k int, d int, linked boolean, diff array<long>, odd array<long>")


def _ordered_differences(around: DataFrame, labels: DataFrame) -> DataFrame:
    """(p, x, k, d, c, o0 to o3, skip, es): of each member x of class c the elements ``es`` of
    its difference that members of p of another class have too, those of the fewest members
    first, up to the (k + 1)-th of the whole difference; the ``skip`` others come before them."""
    rows = around.filter("diff is not null").join(labels, F.col("x") == F.col("v"), "left").select(
        "p", "x", "k", "d", "diff", F.coalesce("c", "x").alias("c"), *[F.col("odd")[i].alias(f"o{i}") for i in range(4)])
    elements = rows.select("p", "x", "c", F.explode("diff").alias("e")).select("p", "x", "c", F.xxhash64("p", "e").alias("e"))
    common = elements.groupBy("e").agg(F.count(F.lit(1)).alias("f"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter(
        "lo <> hi").select(F.col("e").alias("ce"), "f")
    shared = elements.join(common, F.col("e") == F.col("ce")).groupBy(F.col("p").alias("sp"), F.col("x").alias("sx")).agg(
        F.sort_array(F.collect_list(F.struct("f", "e"))).alias("es"))
    skip = F.col("d") - F.size("es")
    return staged(rows.drop("diff").join(shared, (F.col("p") == F.col("sp")) & (F.col("x") == F.col("sx"))).select(
        "p", "x", "k", "d", "c", *[f"o{i}" for i in range(4)], skip.alias("skip"),
        F.slice(F.col("es.e"), F.lit(1), F.greatest(F.col("k") + 1 - skip, F.lit(0))).alias("es")), "ordered")


def _shared_differences(around: DataFrame, labels: DataFrame) -> DataFrame:
    """Candidate pairs (a, b): members of one pivot, of different classes, whose differences
    share an element early enough, and whose parities allow a link (before a row
    is made of a pair, so that families of texts just below the limit make few)."""
    rows = _ordered_differences(around, labels)

    def side(take, i):
        kd = F.shiftleft(F.col("k").cast("long"), 32) + F.col("d")  # two words of the shuffled row
        at = F.shiftleft(F.col("i").cast("long"), 32) + (F.col("d") - 1 - F.col("i"))  # elements before and behind
        return rows.select("k", "d", F.col("x").alias(f"x{i}"), F.col("c").alias(f"c{i}"), "skip", F.posexplode(take).alias(
            "pos", f"e{i}"), *[F.col(f"o{j}").alias(f"o{j}_{i}") for j in range(4)]).withColumn("i", F.col("skip") + F.col("pos")).select(
            f"e{i}", f"x{i}", kd.alias(f"kd{i}"), at.alias(f"at{i}"), f"c{i}", *[f"o{j}_{i}" for j in range(4)])
    half = F.greatest(F.floor(F.col("k") / 2).cast("int") + 1 - F.col("skip"), F.lit(0))
    small, large = side(F.slice("es", F.lit(1), half), 1), side(F.col("es"), 2)
    low = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))
    d1, d2 = low("kd1"), low("kd2")
    k = F.least(F.shiftright("kd1", 32), F.shiftright("kd2", 32))
    apart = sum((F.bit_count(F.col(f"o{j}_1").bitwiseXOR(F.col(f"o{j}_2"))) for j in range(1, 4)),
                F.bit_count(F.col("o0_1").bitwiseXOR(F.col("o0_2"))))
    before = F.shiftright("at1", 32) + F.shiftright("at2", 32) + F.abs(low("at1") - low("at2"))
    meet = small.join(large, (F.col("e1") == F.col("e2")) & (F.col("c1") != F.col("c2")) & (before <= k) & (apart <= k)
                      & ((d1 < d2) | ((d1 == d2) & (F.col("x1") < F.col("x2")))) & (d2 - d1 <= k))
    return meet.select(F.col("x1").alias("a"), F.col("x2").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(v, c): the smallest vertex reachable from each vertex that has a link.
    Every round each vertex moves to its smallest neighbour and the edges move
    with it, until no edge is left; a round is written and read again."""
    edges = staged(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                   .distinct(), "edges")
    labels = staged(edges.select(F.explode(F.array("a", "b")).alias("v")).distinct()
                    .select("v", F.col("v").alias("c")), "labels")
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("w"), F.least("a", "m").alias("to"))
        step = staged(step, "step")
        go = lambda df, c: df.join(step, F.col(c) == F.col("w"), "left").withColumn(
            c, F.coalesce("to", c)).drop("w", "to")
        labels = staged(go(labels, "c"), "labels")
        moved = go(go(edges, "a"), "b").filter("a <> b")
        edges = staged(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return labels


def _classes(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, F.col("sid") == F.col("v"), "left").withColumn(
        "c", F.coalesce("c", "sid")).drop("v")


def _members_of_live(in_regions: DataFrame, live: DataFrame) -> DataFrame:
    """(key, sid) of the regions with several members.  Up to ``LIVE_KEYS`` such
    keys are sent to the executors, a block of ``BLOCK_KEYS`` at a time; more
    are joined by a shuffle."""
    n = live.count()
    if n > LIVE_KEYS:
        return staged(in_regions.join(live, F.col("key") == F.col("lk"), "left_semi").distinct().select("key", "sid"),
                      "members")
    blocks, out = max(1, -(-n // BLOCK_KEYS)), None
    for i in range(blocks):
        mine = lambda c: F.pmod(F.col(c), F.lit(blocks)) == i  # noqa: B023, E731  used at once
        part = staged(in_regions.filter(mine("key")).join(
            F.broadcast(live.filter(mine("lk"))), F.col("key") == F.col("lk"), "left_semi").distinct().select("key", "sid"),
            "members")
        out = part if out is None else out.union(part)
    return out


def join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable
    by links, its own included).

    Nulls: a null text has the empty set, which links with nothing; a null id
    takes part in links but is never a component's smallest id unless all are
    null.  Repeated rows are equal sets.  An empty table gives an empty table;
    other columns are ignored."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    signed = staged(_signed(docs, k, num, den), "signed")
    sets = staged(signed.filter("sid is not null").groupBy("sid").agg(
        F.first("n").alias("n"), F.first("hist").alias("hist"), F.min("id").alias("rep")), "sets")
    in_regions = signed.select("sid", F.explode("keys").alias("key"))
    live = staged(in_regions.groupBy("key").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi"))
                  .filter("lo <> hi").select(F.col("key").alias("lk")), "live")
    placed = _members_of_live(in_regions, live)
    sizes = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("key", "nk")
    sized = staged(placed.join(sizes, F.col("key") == F.col("nk")).select("key", "sid", "n"), "sized")
    # a region of a few members: all its pairs (at most three a member)
    few = sized.filter(F.col("n") <= FEW)
    couples = few.select("key", F.col("sid").alias("a")).join(
        few.select(F.col("key").alias("k2"), F.col("sid").alias("b")), (F.col("key") == F.col("k2")) & (F.col("a") < F.col("b")))
    near = staged(_near(couples.select("a", "b").distinct(), sets, num, den), "near")
    # a larger one: around its pivot
    large = sized.filter(F.col("n") > FEW)
    met = large.groupBy("sid").agg(F.sum("n").alias("met")).withColumnRenamed("sid", "ms")
    pivots = large.join(met, F.col("sid") == F.col("ms")).groupBy("key").agg(
        F.max(F.struct("met", "sid")).alias("top")).select(F.col("key").alias("pk"), F.col("top.sid").alias("p"))
    pairs = staged(large.join(pivots, F.col("key") == F.col("pk")).filter("sid <> p")
                   .select("p", F.col("sid").alias("x")).distinct(), "pairs")
    wanted = (pairs.select(F.explode(F.array("p", "x")).alias("w"))
              .union(near.select(F.explode(F.array("a", "b")).alias("w"))).distinct())
    reps = staged(sets.join(wanted, F.col("sid") == F.col("w"), "left_semi").select("rep"), "wanted")
    members = _members_of(docs, reps, k, "pivots")
    around = staged(_around_pivots(pairs, members, num, den), "around")
    direct = around.filter("linked").select(F.col("p").alias("a"), F.col("x").alias("b")).union(
        _links(near, members, num, den))
    shared = _near(_shared_differences(around, components(direct)), sets, num, den)
    labels = components(direct.union(_links(shared, members, num, den)))
    named = sets.select("sid", "rep").join(labels, F.col("sid") == F.col("v"), "left").select(
        "sid", "rep", F.coalesce("c", "sid").alias("c"))
    least = named.groupBy("c").agg(F.min("rep").alias("least")).withColumnRenamed("c", "lc")
    to = named.join(least, F.col("c") == F.col("lc")).select(F.col("sid").alias("ts"), "least")
    return signed.join(to, F.col("sid") == F.col("ts"), "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("sid").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))


def op2_voronoi_join(spark, sf_dir):
    return join(read(spark, sf_dir, "documents", "doc_id", "text"), k=3, num=90, den=100)


QUERIES = {"op2_voronoi_join": op2_voronoi_join}

ORACLE = {"op2_voronoi_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, ws[i:i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i
                                                     FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
links AS (SELECT p.x, p.y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b
                                ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2) p
          JOIN n nx ON nx.doc_id = p.x JOIN n ny ON ny.doc_id = p.y WHERE 100 * p.c >= 90 * (nx.k + ny.k - p.c)),
e AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON e.x = r.y),
low AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT w.doc_id, coalesce(n.k, 0) AS n_shingles, least(w.doc_id, coalesce(low.y, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN low ON low.x = w.doc_id
"""}
