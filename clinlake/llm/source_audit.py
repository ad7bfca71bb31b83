"""Source divergence audit by a minimal-perfect-hash recount.

How far are a language's sources apart in their use of words?  The first pass
over the corpus counts the documents of each (language, term) exactly and keeps
the frequent terms.  These are cut into shards of bounded size, and a task per
shard builds a minimal perfect hash: the shard's n terms get the slots 0 to
n - 1, and the terms themselves are stored by slot.  Blocks of shards under a
byte bound are broadcast, and a second pass per block looks every word up: its
shard, its slot, and the stored term at that slot, which must equal the word.
Counts are added to dense arrays, one per (language, source, shard).  Memory
thus depends on neither the number of different words nor of groups: arrays
beyond a bound are handed on and begun anew.

From the exact counts follow smoothed shares in whole billionths, the sum of
their absolute differences for every two sources of a language, and the terms
that a source uses more than its language does.
"""

from __future__ import annotations

import pickle
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinlake.llm.common import read, release_memory, staged, unit
from clinlake.operators.retrieval import top_k_per_group
from clinlake.plans.broadcast import runtime_sized

#: What is no part of a term becomes a space, A-Z become a-z (bytes of UTF-8).
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SHARD_TERMS = 50_000
#: Perfect hashes broadcast at a time, and dense counts that a task holds.
BLOCK_BYTES = 128 << 20
DENSE_BYTES = 96 << 20
#: Different words that a task holds before it hands them on.
HELD_WORDS = 400_000
HELD_TOKENS = 2_000_000
#: Cells (terms x sources) of one block of the comparison, and sources of one tile.
BLOCK_CELLS = 4_000_000
TILE_SOURCES = 256
LEVELS = 24
SEED = 42  # of Spark's xxhash64


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def hashes(terms: Iterable[bytes], n: int) -> np.ndarray:
    """Spark's ``xxhash64`` of each term."""
    return np.fromiter((xxhash.xxh64_intdigest(t, SEED) for t in terms), np.uint64, n)


def scrambled(h: np.ndarray, level: int) -> np.ndarray:
    x = h + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % 2 ** 64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Slots 0 to n - 1 for n different terms, one each.

    On each level the open terms are hashed to twice as many places; a term alone
    at its place is settled there, and its slot is the number of settled terms
    before it.  Terms that no level settles (equal 64-bit hashes) are listed.  The
    terms are stored by slot, so that a look-up tells members from others."""

    def __init__(self, terms: list[bytes]):
        self.levels, self.rest, names = [], {}, np.array(terms, dtype=object)
        h, settled = hashes(terms, len(terms)), []
        for level in range(LEVELS):
            if not len(h):
                break
            places = scrambled(h, level) % np.uint64(max(64, 2 * len(h)))
            alone = np.bincount(places.astype(np.int64), minlength=max(64, 2 * len(h))) == 1
            hit = alone[places]
            settled.extend(names[hit][np.argsort(places[hit])])
            self.levels.append(alone)
            h, names = h[~hit], names[~hit]
        self.rest = {t: len(settled) + i for i, t in enumerate(sorted(names))}
        settled.extend(sorted(names))
        self.keys = b"".join(settled)
        self.ends = np.cumsum([0, *map(len, settled)])

    def __len__(self) -> int:
        return len(self.ends) - 1

    def packed(self) -> bytes:
        return pickle.dumps(([(len(x), np.packbits(x)) for x in self.levels], self.rest, self.keys, self.ends))

    @classmethod
    def unpacked(cls, data: bytes) -> PerfectHash:
        made = cls([])
        packed, made.rest, made.keys, made.ends = pickle.loads(data)
        made.levels = [np.unpackbits(x, count=n).astype(bool) for n, x in packed]
        return made

    def term(self, slot: int) -> bytes:
        return self.keys[self.ends[slot]:self.ends[slot + 1]]

    def ranks(self) -> list[np.ndarray]:
        """Settled terms before each place, over all levels."""
        if not hasattr(self, "_ranks"):
            first = np.cumsum([0, *(x.sum() for x in self.levels)])
            self._ranks = [(np.cumsum(x) - x + f).astype(np.int32) for x, f in zip(self.levels, first)]
        return self._ranks

    def slots(self, terms: list[bytes], h: np.ndarray) -> np.ndarray:
        """The slot of each term, -1 for a term that is no member."""
        out, left = np.full(len(terms), -1, np.int64), np.arange(len(terms))
        for level, (alone, rank) in enumerate(zip(self.levels, self.ranks())):
            places = scrambled(h[left], level) % np.uint64(len(alone))
            hit = alone[places]
            out[left[hit]] = rank[places[hit]]
            left = left[~hit]
        keys, ends = self.keys, self.ends
        lo, hi = ends[out].tolist(), ends[out + 1].tolist()
        wrong = [i for i, (t, s) in enumerate(zip(terms, out.tolist())) if s >= 0 and keys[lo[i]:hi[i]] != t]
        out[wrong] = -1
        if self.rest:
            for i, t in enumerate(terms):
                out[i] = self.rest.get(t, out[i])
        return out


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(33)) * np.uint64(shards)) >> np.uint64(31)


def frequent_terms(rows: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term) in at least ``min_docs`` of a language's rows.  A task counts its
    documents in a bounded table and hands on (lang, term, documents)."""
    schema = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def drain():
            for lang, counted in held.items():
                for lo in range(0, len(counted), 100_000):
                    part = list(counted)[lo:lo + 100_000]
                    yield pa.record_batch([pa.array([lang] * len(part), pa.string()), pa.array(part, pa.binary()),
                                           pa.array([counted[t] for t in part], pa.int64())], schema=schema)
            held.clear()
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                held[lang].update(set(words(text)))
                if sum(map(len, held.values())) > HELD_WORDS:
                    yield from drain()
        yield from drain()
        release_memory()
    counted = rows.select("lang", "text").mapInArrow(count, "lang string, term binary, n long")
    return counted.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs).select("lang", "term")


def perfect_hashes(kept: DataFrame, shard_terms: int) -> DataFrame:
    """A row per shard: lang, shard, shards (of the language), terms, mph."""
    sizes = kept.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / shard_terms).alias("shards"))
    shard = F.shiftright(unit(F.xxhash64("term")) * F.col("shards"), 31).cast("int")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        made = PerfectHash(sorted(map(bytes, pdf["term"])))
        first = pdf.iloc[0]
        return pd.DataFrame({"lang": [first["lang"]], "shard": [first["shard"]], "shards": [first["shards"]],
                             "terms": [len(made)], "mph": [made.packed()]})
    return kept.join(runtime_sized(sizes), "lang").withColumn("shard", shard).groupBy("lang", "shard").applyInPandas(
        build, "lang string, shard int, shards long, terms long, mph binary")


def stored_terms(shards: DataFrame) -> DataFrame:
    """(lang, shard, slot, term) of every stored term."""
    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for lang, shard, mph in zip(pdf["lang"], pdf["shard"], pdf["mph"]):
                made = PerfectHash.unpacked(mph)
                yield pd.DataFrame({"lang": lang, "shard": shard, "slot": np.arange(len(made), dtype=np.int32),
                                    "term": [made.term(i).decode() for i in range(len(made))]})
    return shards.select("lang", "shard", "mph").mapInPandas(unpack, "lang string, shard int, slot int, term string")


def in_blocks(shards: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, int, int, bytes]]]:
    """The shards in blocks of at most ``block_bytes`` (or of one shard)."""
    block, size = [], 0
    for r in shards.select("lang", "shard", "shards", "mph").toLocalIterator():
        if block and size + len(r.mph) > block_bytes:
            yield block
            block, size = [], 0
        block.append((r.lang, r.shard, r.shards, bytes(r.mph)))
        size += len(r.mph)
    if block:
        yield block


def recount(rows: DataFrame, block: list[tuple[str, int, int, bytes]], dense_bytes: int) -> DataFrame:
    """(lang, source, shard, slot, n): occurrences of the block's terms."""
    sent = rows.sparkSession.sparkContext.broadcast(block)
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("shard", pa.int32()),
                        ("slots", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, dict[int, PerfectHash]] = defaultdict(dict)
        n_shards = {}
        for lang, shard, shards, mph in sent.value:
            tables[lang][shard], n_shards[lang] = PerfectHash.unpacked(mph), shards
        held: dict[tuple, Counter] = defaultdict(Counter)
        dense: dict[tuple, np.ndarray] = {}
        size = tokens = 0

        def drain():
            for (lang, source, shard), counts in dense.items():
                used = np.flatnonzero(counts)
                yield pa.record_batch([pa.array([lang]), pa.array([source]), pa.array([shard], pa.int32()),
                                       pa.array([used.astype(np.int32)]), pa.array([counts[used]])], schema=schema)
            dense.clear()

        def settle():
            """Words held as such go to the dense arrays."""
            nonlocal size
            for (lang, source), counted in held.items():
                terms, n = list(counted), np.fromiter(counted.values(), np.int64, len(counted))
                h = hashes(terms, len(terms))
                at = shard_of(h, n_shards[lang])
                for shard, made in tables[lang].items():
                    mine = np.flatnonzero(at == shard)
                    slots = made.slots([terms[i] for i in mine], h[mine])
                    if (slots >= 0).any():
                        if (lang, source, shard) not in dense:
                            if size + 8 * len(made) > dense_bytes:
                                yield from drain()
                                size = 0
                            dense[lang, source, shard] = np.zeros(len(made), np.int64)
                            size += 8 * len(made)
                        dense[lang, source, shard][slots[slots >= 0]] += n[mine[slots >= 0]]
            held.clear()
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
                if lang in tables:
                    found = words(text)
                    held[lang, source].update(found)
                    tokens += len(found)
                    if tokens > HELD_TOKENS:
                        yield from settle()
                        tokens = 0
        yield from settle()
        yield from drain()
        tables.clear()
        release_memory()
    parts = rows.mapInArrow(count, "lang string, source string, shard int, slots array<int>, counts array<long>")
    cells = parts.select("lang", "source", "shard", F.explode(F.arrays_zip("slots", "counts")).alias("c"))
    return cells.groupBy("lang", "source", "shard", F.col("c.slots").alias("slot")).agg(F.sum("c.counts").alias("n"))


def share(n: str, total: str) -> Column:
    """1 + floor(10^9 (n + 5) / total), three digits at a time: whole numbers of 64
    bits are exact while a group has fewer than 9 x 10^15 words."""
    left, out = f"({n} + 5)", "1"
    for digit in (1_000_000, 1_000, 1):
        out += f" + {digit} * (({left} * 1000) div {total})"
        left = f"(({left} * 1000) % {total})"
    return F.expr(out).cast("long")


def compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """Summed differences of the shares of a tile's sources from all sources, over the
    terms of one block.  Rows with slot -1 hold each source's share of absent terms."""
    tile, absent = pdf["tile"].iloc[0], pdf[pdf["slot"] < 0].sort_values("s")
    cells = pdf[pdf["slot"] >= 0]
    at, slots = pd.factorize(cells["slot"])
    p = np.repeat(absent["p"].to_numpy(np.int64)[:, None], len(slots), axis=1)
    p[cells["s"].to_numpy(), at] = cells["p"].to_numpy()
    out = []
    for i in range(tile * TILE_SOURCES, min(len(p), (tile + 1) * TILE_SOURCES)):
        value = np.abs(p - p[i]).sum(axis=1)
        out.append(pd.DataFrame({"lang": pdf["lang"].iloc[0], "i": i, "j": np.arange(len(p)), "value": value}).drop(i))
    return pd.concat(out)


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
          min_docs: int = 30, top: int = 50, shard_terms: int = SHARD_TERMS, block_bytes: int = BLOCK_BYTES,
          dense_bytes: int = DENSE_BYTES) -> DataFrame:
    """lang, source, part, item, value, rank.  Part ``pair``: the distance to each
    other source of the language, largest first.  Part ``term``: the ``top`` terms
    whose share in the source is most above that in the language.

    Nulls in any of the three columns count as "".  Every occurring (lang, source)
    is a group, even without words; in a language without frequent terms all
    distances are 0.  Texts are read whole, whatever their length.  Repeated rows
    count as often as they occur; ties go by the item's bytes.  Other columns are not
    read, so their names cannot clash; an empty table gives an empty table."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in (
        (lang_col, "lang"), (source_col, "source"))], text.alias("text"))
    kept = staged(frequent_terms(rows, min_docs), "kept")
    shards = staged(perfect_hashes(kept, shard_terms), "perfect")
    cells = None
    for block in in_blocks(shards, block_bytes):
        part = staged(recount(rows, block, dense_bytes), "recount")
        cells = part if cells is None else cells.unionByName(part)
    if cells is None:
        cells = docs.sparkSession.createDataFrame([], "lang string, source string, shard int, slot int, n long")

    lang_terms = shards.groupBy("lang").agg(F.sum("terms").alias("v"))
    in_lang, by_source = Window.partitionBy("lang"), Window.partitionBy("lang").orderBy("source")
    zero = F.lit(0).cast("long")
    groups = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("docs"))
    groups = groups.join(cells.groupBy("lang", "source").agg(F.sum("n").alias("words")), ["lang", "source"], "left")
    groups = groups.join(lang_terms, "lang", "left").select(
        "lang", "source", (F.coalesce("words", zero) + 5 * F.coalesce("v", zero)).alias("total"),
        (F.sum(F.coalesce("words", zero)).over(in_lang) + 5 * F.coalesce("v", zero)).alias("lang_total"),
        (F.row_number().over(by_source) - 1).alias("s"), F.count(F.lit(1)).over(in_lang).alias("sources"))
    groups = staged(groups, "groups")  # one row a group
    terms_a_block = F.greatest(F.lit(1), F.least(F.lit(shard_terms), F.floor(F.lit(BLOCK_CELLS) / F.col("sources"))))
    cells = cells.join(runtime_sized(groups), ["lang", "source"]).select(
        "lang", "source", "s", "sources", "shard", "slot", "n", "lang_total", share("n", "total").alias("p"),
        F.floor(F.col("slot") / terms_a_block).cast("int").alias("block"))

    blocks = cells.select("lang", "shard", "block").distinct().unionByName(
        groups.filter("total = 0").select("lang", F.lit(-1).alias("shard"), F.lit(0).alias("block")).distinct())
    absent = blocks.join(runtime_sized(groups), "lang").select(
        "lang", "shard", "block", "sources", F.lit(-1).alias("slot"), "s",
        F.when(F.col("total") > 0, share("0", "greatest(total, 1)")).otherwise(zero).alias("p"))
    tiles = F.explode(F.sequence(F.lit(0), F.floor((F.col("sources") - 1) / TILE_SOURCES).cast("int")))
    dealt = cells.select(*absent.columns).unionByName(absent).filter("sources > 1").withColumn("tile", tiles)
    sums = dealt.groupBy("lang", "shard", "block", "tile").applyInPandas(compare, "lang string, i int, j int, value long")
    sums = sums.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    names = groups.select("lang", "source", "s")
    for number, name in (("i", "source"), ("j", "item")):
        sums = sums.join(runtime_sized(names.select("lang", F.col("source").alias(name), F.col("s").alias(number))),
                         ["lang", number])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = sums.select("lang", "source", F.lit("pair").alias("part"), "item", "value",
                        F.row_number().over(order).alias("rank"))

    in_term = Window.partitionBy("lang", "shard", "slot")  # one row a source
    above = cells.withColumn("m", F.sum("n").over(in_term)).withColumn("q", share("m", "lang_total")).filter("p > q")
    above = above.join(runtime_sized(stored_terms(shards)), ["lang", "shard", "slot"]).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    best = top_k_per_group(above, ["lang", "source"], [F.desc("value"), F.col("item")], top, salt_of=F.xxhash64("item"))
    return pairs.unionByName(best.select(*pairs.columns))


def op11_mph_divergence(spark, sf_dir):
    return audit(read(spark, sf_dir, "documents", "lang", "source", "text"))


QUERIES = {"op11_mph_divergence": op11_mph_divergence}

ORACLE = {"op11_mph_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT d, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT d) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, coalesce(n, 0)::HUGEINT AS n FROM g JOIN k ON k.lang = g.lang
    LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL) x
      ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
p AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS gn, count(*) OVER (PARTITION BY lang, source) AS v,
    sum(n) OVER (PARTITION BY lang, term) AS ln FROM c),
l AS (SELECT lang, sum(n) AS total FROM c GROUP BY lang),
r AS (SELECT p.lang, source, term, n, 1 + (1000000000 * (n + 5)) // (gn + 5 * v)::HUGEINT AS p,
    1 + (1000000000 * (ln + 5)::HUGEINT) // (l.total + 5 * v)::HUGEINT AS q FROM p JOIN l ON l.lang = p.lang),
pr AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN r x ON x.lang = a.lang AND x.source = a.source
    LEFT JOIN r y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
al AS (SELECT lang, source, 'pair' AS part, item, value FROM pr
    UNION ALL SELECT lang, source, 'term', term, p - q FROM r WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
  CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM al QUALIFY part = 'pair' OR rank <= 50
"""}
