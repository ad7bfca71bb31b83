"""Mixing sources to target weights by Pfair scheduling (native).

Each source's documents (in the order of a hash of their id) are cut into
blocks.  Block i of a source with weight w has a release time and a deadline:
the times at which an ideal fluid mix, which serves all sources that still have
blocks in proportion to their weights, begins and completes that block.  An
earliest-deadline-first schedule over unit slots meets every deadline and never
starts a block early, so after every slot each source is less than one block
away from the fluid mix.

Release times and deadlines are computed in whole numbers from the exact weights,
so nothing adds up over a long mix.  The driver schedules all blocks, in
chunks that are written to the shared folder as they are made: it holds one
entry a source and one chunk.  Every source has a queue of its own.  Every block
then finds its slot by a join with that table; no block is dropped or repeated.
Documents pass through DataFrame functions only.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import accumulate, islice
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinlake.llm.common import hash_index, read, scratch, staged
from clinlake.plans.broadcast import sized_broadcast

BLOCK_DOCS = 32
#: Blocks of the schedule that the driver holds at a time.
CHUNK_BLOCKS = 500_000


def cycle_shares(weights: Mapping[str, float], cycle: int) -> dict[str, int]:
    """Whole blocks of each queue in a cycle (largest remainders, one at least)."""
    total = sum(weights.values())
    exact = {s: max(1.0, w / total * cycle) for s, w in weights.items()}
    share = {s: int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (share[s] - exact[s], s))[:max(0, cycle - sum(share.values()))]:
        share[s] += 1
    return share


def edf(blocks: Mapping[str, int], weights: Mapping[str, float]) -> Iterator[tuple[str, int, int, int, int]]:
    """The schedule, slot by slot: (queue, block, slot, release, deadline).  Release
    and deadline are those of the fluid mix, rounded outwards.

    The fluid mix has served min(blocks, weight * v) of each queue at its own
    time v, so block j of a queue ends when v is (j + 1) / weight.  Between two ends of
    queues the slots are linear in v: what the ended queues had, and v times the
    weight of the others."""
    names = sorted(s for s in blocks if blocks[s])
    exact = [Fraction(weights[s]) for s in names]
    if any(w <= 0 for w in exact):
        raise ValueError("weights must be positive")
    unit = lcm(*(w.denominator for w in exact))
    w, n = [int(x * unit) for x in exact], [blocks[s] for s in names]
    by_end = sorted(range(len(names)), key=lambda q: Fraction(n[q], w[q]))
    ends = [Fraction(n[q], w[q]) for q in by_end]
    ended = [0, *accumulate(n[q] for q in by_end)]
    left = [sum(w), *(sum(w) - x for x in accumulate(w[q] for q in by_end))]
    rank = [0] * len(names)  # the stretch between two ends in which each queue is
    upto = [(0, 1)] * len(names)

    def times(q: int, j: int) -> tuple[int, int]:
        """Release and deadline of block j; the blocks of a queue are asked for in order."""
        k = rank[q]
        begins = ended[k] + left[k] * j // w[q]
        if (j + 1) * upto[q][1] > upto[q][0] * w[q] or not j:  # it ends in a later stretch
            k = rank[q] = bisect.bisect_left(ends, Fraction(j + 1, w[q]))
            upto[q] = ends[k].numerator, ends[k].denominator
        return begins, ended[k] - (-left[k] * (j + 1) // w[q])

    coming, ready = [(*times(q, 0), q, 0) for q in range(len(names))], []
    heapq.heapify(coming)
    for slot in range(sum(n)):
        while coming and coming[0][0] <= slot:
            release, deadline, q, j = heapq.heappop(coming)
            heapq.heappush(ready, (deadline, q, j, release))
        deadline, q, j, release = heapq.heappop(ready)
        yield names[q], j, slot, release, deadline
        if j + 1 < n[q]:
            heapq.heappush(coming, (*times(q, j + 1), q, j + 1))


def timetable(spark, count: Mapping[str, int], weights: Mapping[str, float], block_docs: int) -> DataFrame:
    """A row for each block (queue ``q``, block ``j``): slot, release, deadline and
    the position of its first document (the last block of a queue can be short)."""
    path, first = scratch(spark, "slots"), 0
    schema = "q string, j long, s long, r long, d long, p long"
    rows = edf({s: -(-n // block_docs) for s, n in count.items()}, weights)
    chunks = iter(lambda: list(islice(rows, CHUNK_BLOCKS)), [])
    spark.createDataFrame([], schema).write.parquet(path)
    for chunk in chunks:
        size = [min(block_docs, count[q] - j * block_docs) for q, j, *_ in chunk]
        columns = [*map(list, zip(*chunk)), list(accumulate(size, initial=first))[:-1]]
        first += sum(size)
        spark.createDataFrame(pa.table(columns, names=list("qjsrdp")), schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, id_col: str = "doc_id",
        source_col: str = "source", exponent: float = 0.5, block_docs: int = BLOCK_DOCS,
        cycle: int | None = None) -> DataFrame:
    """``row`` (the input row as a struct), queue, block (0-based within its
    queue), release, deadline and slot of the block, and position: the gapless
    place of the document in the mix.

    ``weights`` gives each source's target weight; without it the weights are
    the sources' numbers of blocks to the power ``exponent``.  They are kept exactly;
    only a caller that gives a ``cycle`` has them rounded to whole blocks of so
    many slots.  Nulls: a null source is the source "", a null id sorts by its hash
    like any other.  Repeated rows are placed one after the other.  An empty table
    gives an empty table; other columns travel inside ``row``, whatever their names."""
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    rows = docs.select(source.alias("queue"), F.col(id_col).cast("string").alias("id"), F.struct("*").alias("row"))
    count = {r["queue"]: r["n"] for r in rows.groupBy("queue").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    target = {s: weights[s] if weights else (-(-n // block_docs)) ** exponent for s, n in count.items()}
    if cycle:
        target = cycle_shares(target, max(cycle, len(target)))
    slots = sized_broadcast(timetable(docs.sparkSession, count, target, block_docs))
    placed = hash_index(rows, ["queue"], ["id", "row"], "pos", n_rows=sum(count.values()))
    placed = placed.withColumn("block", F.floor(F.col("pos") / block_docs))
    placed = placed.join(slots, (F.col("queue") == F.col("q")) & (F.col("block") == F.col("j")))
    return placed.select("row", "queue", "block", F.col("r").alias("release"), F.col("d").alias("deadline"),
                         F.col("s").alias("slot"), (F.col("p") + F.col("pos") % block_docs).alias("position"))


def op4_pfair_mix(spark, sf_dir):
    out = mix(staged(read(spark, sf_dir, "documents", "doc_id", "source"), "mix"))
    return out.select(F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), "block", "release",
                      "deadline", "slot", "position")


QUERIES = {"op4_pfair_mix": op4_pfair_mix}
