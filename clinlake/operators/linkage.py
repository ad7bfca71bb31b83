"""Linkage disequilibrium: packed genotypes, LD pairs, pruning, clumping, genotype
components (SURVEY 2.13.3, 2.13.6-2.13.8).

Genotypes arrive sparse: (variant, sample, dosage) rows for the calls that are not
homozygous reference; a null dosage is a missing call, an absent row dosage 0.

* A variant is packed to two bits a sample.  r^2 of a pair is made of eight bit
  counts, so missing calls are left out pair by pair and all sums are exact.
* Pairs are formed inside blocks of the position axis only: a block holds its own
  variants and copies of the earlier ones that its windows reach, however many
  blocks that spans.  No pair outside a window is ever formed.  A task computes its
  blocks as a stream, the pairs of many small blocks at once.
* Pruning is order-dependent.  Buckets of windows run side by side, each from an
  assumed state (which variants before it are gone); a bucket whose incoming state
  turns out different runs again, until no state changes.  By induction over the
  buckets that is the result of one pass in order.
* Clumping takes, per round, every variant whose p-value is the smallest among its
  open neighbours; what they claim is closed, until none is open.
* Components come from a randomised block range finder: products with the sparse
  matrix are joins and grouped sums over both axes, only blocks of at most
  ``k + extra`` columns squared pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinlake.functions.exprs import hash_normal
from clinlake.operators.genomics import HWE_CHI2_MAX, hwe_chi2
from clinlake.plans.broadcast import bounded_broadcast, runtime_sized
from clinlake.plans.prefix import dense_codes, row_index
from clinlake.plans.suppress import greedy_leads
from clinlake.session import checkpoint_dir

#: Variants of one pruning bucket (a multiple of the window's step is used).
BUCKET_VARIANTS = 50_000
#: Genotypes that one step of packing holds, words of genotypes that one step of pairing holds.
CELLS = 1 << 22


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once, in the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sparse_variant_qc(calls: DataFrame, variant: str, dosage: str, n_samples: DataFrame, min_af: float = 0.01,
                      min_call_rate: float = 0.98) -> DataFrame:
    """Allele frequency, call rate and HWE chi-square of sparse calls, with the
    rules of ``genomics.variant_qc``; ``n_samples`` is one row (``_n_samples``)."""
    g = F.col(dosage)
    c = calls.groupBy(variant).agg(F.count_if(g.isNull()).alias("missing"), F.count_if(g == 1).alias("n1"),
                                   F.count_if(g == 2).alias("n2")).crossJoin(bounded_broadcast(n_samples))
    called = F.col("_n_samples") - F.col("missing")
    c = c.select(variant, called.alias("called"), (called - F.col("n1") - F.col("n2")).alias("n0"), "n1", "n2",
                 (F.col("n1") + 2 * F.col("n2")).alias("alt"), "_n_samples")
    p = F.try_divide(F.col("alt"), 2.0 * F.col("called"))
    c = c.withColumn("maf", F.least(p, 1 - p)).withColumn("call_rate", F.col("called") / F.col("_n_samples"))
    chi2 = hwe_chi2(F.col("called").cast("double"), p)
    good = (F.col("maf") >= min_af) & (F.col("call_rate") >= min_call_rate) & (chi2 <= HWE_CHI2_MAX)
    return c.select(variant, "called", "n0", "n1", "n2", "alt", "maf", "call_rate", chi2.alias("hwe_chi2"),
                    F.coalesce(good, F.lit(False)).alias("pass_qc"))


def packed_variants(calls: DataFrame, samples: DataFrame, variants: DataFrame, variant: str, sample: str,
                    dosage: str) -> DataFrame:
    """``variants`` (variant, chrom, pos, maf) with their genotypes packed and their
    place ``ord`` (0-based along pos and variant) in the chromosome.

    ``samples`` lists all samples once.  Columns low and high hold the two bits of
    each sample in the order of the sorted samples; ``n`` is the number of samples."""
    codes = dense_codes(samples.select(sample), sample, "_s")
    width = codes.agg(F.count(F.lit(1)).alias("n"))
    g = F.when(F.col(dosage).isNull(), 3).otherwise(F.col(dosage)).cast("int")
    rows = calls.join(runtime_sized(codes), sample).groupBy(variant).agg(
        F.collect_list(F.col("_s").cast("long") * 4 + g).alias("calls"))  # at most one a sample
    placed = row_index(variants, ["chrom"], ["pos", variant], "ord")
    rows = placed.withColumn("ord", F.col("ord") - 1).join(rows, variant, "left").crossJoin(bounded_broadcast(width))
    kind = variants.schema[variant].dataType.simpleString()
    chrom = variants.schema["chrom"].dataType.simpleString()

    def pack(frames):
        for pdf in frames:
            width_ = -(-int(pdf["n"].iloc[0]) // 64) * 64 if len(pdf) else 64  # n is the same in all rows
            step = max(1, CELLS // max(width_, 1))
            for lo in range(0, len(pdf), step):
                part = pdf.iloc[lo:lo + step]
                calls_ = [np.zeros(0, np.int64) if c is None else np.asarray(c, np.int64) for c in part["calls"]]
                flat = np.concatenate(calls_)
                codes_ = np.zeros((len(part), width_), np.uint8)
                codes_[np.repeat(np.arange(len(part)), [len(c) for c in calls_]), flat >> 2] = flat & 3
                low, high = ([r.tobytes() for r in np.packbits(bits, axis=1)] for bits in (codes_ & 1, codes_ >> 1))
                yield part[[variant, "chrom", "pos", "maf", "ord", "n"]].assign(low=low, high=high)
    return rows.select(variant, "chrom", F.col("pos").cast("long").alias("pos"), F.col("maf").cast("double").alias("maf"),
                       F.col("ord").cast("long").alias("ord"), "n", "calls").mapInPandas(
        pack, f"{variant} {kind}, chrom {chrom}, pos long, maf double, ord long, n long, low binary, high binary")


def planes(packed: Sequence[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.uint64).reshape(len(packed), -1)


def r_squared(one: np.ndarray, two: np.ndarray, valid: np.ndarray, j: int, others: slice) -> np.ndarray:
    """Squared correlation of variant ``j`` with the ``others`` over the samples
    that both call; -1 where one of them does not vary there.  From bit counts."""
    def count(a, b):
        return np.bitwise_count(a[others] & b[j]).sum(1, dtype=np.int64)
    n = count(valid, valid)
    x1, x2, y1, y2 = count(one, valid), count(two, valid), count(valid, one), count(valid, two)
    xy = count(one, one) + 2 * (count(one, two) + count(two, one)) + 4 * count(two, two)
    x, y = x1 + 2 * x2, y1 + 2 * y2
    vx, vy, cov = n * (x1 + 4 * x2) - x * x, n * (y1 + 4 * y2) - y * y, n * xy - x * y
    both = (vx > 0) & (vy > 0)
    return np.where(both, cov.astype(float) * cov / np.where(both, vx.astype(float) * vy, 1.0), -1.0)


def ld_pairs(packed: DataFrame, variant: str, min_r2: float, axis: str, block: int, reach: int,
             first: Column | None = None, strict: bool = True) -> DataFrame:
    """(chrom, i, j, left, right, maf_i, maf_j, r2) for pairs in order (``i`` before ``j``
    by ord; left and right are their ids) whose r^2 passes ``min_r2``.

    A pair is formed when ``axis`` (ord or pos) of i is at least ``first`` of j (default:
    axis of j less ``reach``).  ``first`` is never below that."""
    low = F.col(axis) - reach if first is None else first
    rows = packed.withColumn("first", low).withColumn("own", F.floor(F.col(axis) / block))
    rows = rows.withColumn("block", F.explode(F.sequence("own", F.floor((F.col(axis) + reach) / block))))
    kind = packed.schema[variant].dataType.simpleString()
    chrom = packed.schema["chrom"].dataType.simpleString()

    def pairs(pdf: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        low_, high = planes(pdf["low"]), planes(pdf["high"])
        samples = np.zeros(low_.shape[1] * 64, np.uint8)
        samples[:pdf["n"].iloc[0]] = 1
        valid = ~(low_ & high) & np.packbits(samples).view(np.uint64)
        one, two = low_ & valid, high & valid
        at, lowest, k = pdf[axis].to_numpy(), pdf["first"].to_numpy(), np.arange(len(pdf))
        begin = np.concatenate([s + np.searchsorted(at[s:e], lowest[s:e]) for s, e in zip(starts, [*starts[1:], len(pdf)])])
        many = np.where(pdf["own"] == pdf["block"], k - np.minimum(begin, k), 0)  # earlier variants that each meets
        ends, step = np.cumsum(many), max(1, CELLS // max(1, 8 * low_.shape[1]))
        col = {c: pdf[c].to_numpy() for c in ("chrom", "ord", variant, "maf")}
        lo = 0
        while lo < len(pdf):  # as many variants as make ``step`` pairs, one at least
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - many[lo] + step, "right")))
            j = np.repeat(k[lo:hi], many[lo:hi])
            i = np.arange(len(j)) - np.repeat(ends[lo:hi] - many[lo:hi] - (ends[lo] - many[lo]), many[lo:hi]) + begin[j]
            r = r_squared(one, two, valid, j, i)
            hit = r > min_r2 if strict else r >= min_r2
            i, j, lo = i[hit], j[hit], hi
            yield pd.DataFrame({"chrom": col["chrom"][j], "i": col["ord"][i], "j": col["ord"][j],
                                "left": col[variant][i], "right": col[variant][j], "maf_i": col["maf"][i],
                                "maf_j": col["maf"][j], "r2": r[hit]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # of the last block met, which may go on

        def whole() -> Iterator[pd.DataFrame]:
            pdf = pd.concat(held, ignore_index=True)
            return pairs(pdf, np.flatnonzero(pdf["new"].to_numpy(bool)))
        for pdf in frames:
            new = np.flatnonzero(pdf["new"].to_numpy(bool))
            if len(new) and (new[-1] or held):
                held.append(pdf.iloc[:new[-1]])
                yield from whole()
                held, pdf = [], pdf.iloc[new[-1]:]
            held.append(pdf)
        if sum(map(len, held)):
            yield from whole()
    # the blocks of a task follow each other, ``new`` marks the first row of each
    in_block = Window.partitionBy("chrom", "block").orderBy("ord", variant)
    rows = rows.withColumn("new", F.row_number().over(in_block) == 1)
    return rows.mapInPandas(
        run, f"chrom {chrom}, i long, j long, left {kind}, right {kind}, maf_i double, maf_j double, r2 double")


def ld_prune(packed: DataFrame, variant: str, window: int = 1000, step: int = 200, max_r2: float = 0.3,
             bucket_variants: int | None = None) -> DataFrame:
    """(chrom, ord, variant, kept): greedy pruning in windows of ``window`` variants
    that move by ``step``.

    Windows go in order, the pairs of a window by (i, j); a pair of two variants
    that are both still there and whose r^2 is above ``max_r2`` loses the one with the
    smaller allele frequency (the later one if equal).  A pair that stands in
    several windows is met in the first."""
    packed = stored(packed)
    start = F.greatest(F.lit(0), F.floor((F.col("ord") - window) / step) + 1) * step  # first window that holds j
    pairs = ld_pairs(packed, variant, max_r2, "ord", max(step, 512), window, first=start)
    per = max(1, (bucket_variants or BUCKET_VARIANTS) // step)
    first_window = F.greatest(F.lit(0), F.floor((F.col("j") - window) / step) + 1)
    events = stored(pairs.select("chrom", F.floor(first_window / per).alias("bucket"), first_window.alias("w"), "i", "j",
                                 F.when(F.col("maf_i") < F.col("maf_j"), F.col("i")).otherwise(F.col("j")).alias("loser")))
    last = F.floor(F.floor(F.greatest(F.lit(0), F.max("ord") - window + step) / step) / per)
    buckets = packed.groupBy("chrom").agg(last.alias("last")).select(
        "chrom", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("bucket"))
    chrom = packed.schema["chrom"].dataType.simpleString()

    def run(events_: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if not len(state):
            raise ValueError("a bucket without a state")
        before = set(state["incoming"].iloc[0])
        gone = set(before)
        for i, j, loser in events_.sort_values(["w", "i", "j"])[["i", "j", "loser"]].itertuples(index=False):
            if i not in gone and j not in gone:
                gone.add(loser)
        bucket = int(state["bucket"].iloc[0])
        carried = sorted(v for v in gone if v >= (bucket + 1) * per * step)  # what later windows can still hold
        return pd.DataFrame({"chrom": [state["chrom"].iloc[0]], "bucket": [bucket], "incoming": [sorted(before)],
                             "carried": [carried], "gone": [sorted(gone - before)]})
    schema = f"chrom {chrom}, bucket long, incoming array<long>, carried array<long>, gone array<long>"
    none = F.array().cast("array<long>")
    state = stored(buckets.select("chrom", "bucket", none.alias("incoming")))
    keys, done = ["chrom", "bucket"], None
    while not state.isEmpty():  # at most as many rounds as buckets; a state seldom reaches further than one
        mine = events.join(runtime_sized(state.select(*keys)), keys, "left_semi")
        ran = mine.groupBy(*keys).cogroup(state.groupBy(*keys)).applyInPandas(run, schema)
        done = stored(ran if done is None else done.join(state.select(*keys), keys, "left_anti").unionByName(ran))
        given = done.select("chrom", (F.col("bucket") + 1).alias("bucket"), F.col("carried").alias("given"))
        state = stored(done.join(given, keys).filter(F.col("given") != F.col("incoming")).select(
            *keys, F.col("given").alias("incoming")))
    if done is None:
        return packed.select("chrom", "ord", variant, F.lit(True).alias("kept"))
    gone = done.select("chrom", F.explode("gone").alias("ord")).withColumn("kept", F.lit(False))
    return packed.select("chrom", "ord", variant).join(gone, ["chrom", "ord"], "left").select(
        "chrom", "ord", variant, F.coalesce("kept", F.lit(True)).alias("kept"))


def clump(edges: DataFrame, candidates: DataFrame, keys: Sequence[str], variant: str, p_value: str) -> DataFrame:
    """Lead variants among ``candidates`` (keys, variant, p_value): in order of the
    p-value (then the id) each one not yet claimed leads and claims its neighbours,
    the ``edges`` (left, right)."""
    return greedy_leads(candidates, edges, keys, variant, F.struct(F.col(p_value).alias("p"), F.col(variant).alias("v")))


def times(df: DataFrame, keep: str, columns: Sequence[str], matrix: np.ndarray) -> DataFrame:
    """``keep`` and the columns times a small matrix (rows: columns), as c0, c1, ..."""
    names = [f"c{j}" for j in range(matrix.shape[1])]

    def multiply(frames):
        for pdf in frames:
            out = pd.DataFrame(pdf[list(columns)].to_numpy(float) @ matrix, columns=names)
            out.insert(0, keep, pdf[keep].to_numpy())
            yield out
    kind = df.schema[keep].dataType.simpleString()
    return df.select(keep, *columns).mapInPandas(multiply, f"{keep} {kind}, " + ", ".join(f"{c} double" for c in names))


def gram(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Inner products of the columns over all rows (a matrix of their number squared),
    summed per task first."""
    def part(frames):
        total = np.zeros((len(columns), len(columns)))
        for pdf in frames:
            x = pdf.to_numpy(float)
            total += x.T @ x
        yield pd.DataFrame({"i": np.repeat(np.arange(len(columns)), len(columns)),
                            "j": np.tile(np.arange(len(columns)), len(columns)), "v": total.ravel()})
    rows = df.select(*columns).mapInPandas(part, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((len(columns), len(columns)))
    for r in rows.collect():
        out[r.i, r.j] = r.v
    return out


def orthonormal(df: DataFrame, keep: str, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """An orthonormal base of the columns' span (twice through their Gram matrix, for
    accuracy); directions without weight are left out."""
    for _ in range(2):
        value, vector = np.linalg.eigh(gram(df, columns))
        good = value > max(value.max() * 1e-12, 1e-300)
        df = stored(times(df, keep, columns, vector[:, good] / np.sqrt(value[good])))
        columns = [f"c{j}" for j in range(good.sum())]
    return df, columns


def genotype_components(calls: DataFrame, samples: DataFrame, qc: DataFrame, variant: str, sample: str, dosage: str,
                        k: int = 10, extra: int = 22, tolerance: float = 1e-6, max_rounds: int = 20,
                        seed: int = 5) -> tuple[DataFrame, list[tuple[float, float]]]:
    """The first ``k`` principal components of all samples over all variants of ``qc``
    (variant, maf from alt / called), and per component (eigenvalue, share of the
    total variance).

    Calls are centred on twice the allele frequency and divided by the binomial
    standard deviation; missing calls count as the mean.  The block of k + extra
    columns is multiplied by the matrix and its transpose until the eigenvalues
    move by less than ``tolerance`` (relative); a component's sign makes its
    largest entry positive."""
    af = F.col("alt") / (2.0 * F.col("called"))
    scale = qc.select(variant, (2 * af).alias("mu"), F.sqrt(2 * af * (1 - af)).alias("sd")).filter("sd > 0")
    n_samples, n_variants = samples.count(), scale.count()
    z = stored(calls.join(runtime_sized(scale), variant).select(
        F.col(variant).alias("v"), F.col(sample).alias("s"), "mu", "sd",
        F.coalesce(F.col(dosage).cast("double"), F.col("mu")).alias("g")))
    scale = stored(scale.withColumnRenamed(variant, "v"))
    people = samples.select(F.col(sample).alias("s")).distinct()
    # every variant adds ((n - n1 - n2) mu^2 + sum (g - mu)^2) / sd^2 to the total variance
    per = z.groupBy("v").agg(F.sum((F.col("g") - F.col("mu")) ** 2).alias("q"), F.count(F.lit(1)).alias("c"))
    total = scale.join(per, "v", "left").agg(F.sum((F.coalesce("q", F.lit(0.0)) + (n_samples - F.coalesce("c", F.lit(0)))
                                                    * F.col("mu") ** 2) / F.col("sd") ** 2)).first()[0] or 0.0

    def by_variant(w: DataFrame, columns: list[str]) -> DataFrame:
        """Z w: one row a variant."""
        sums = w.agg(*[F.sum(c).alias(f"t{c}") for c in columns])
        got = z.join(runtime_sized(w), "s").groupBy("v").agg(*[F.sum(F.col("g") * F.col(c)).alias(c) for c in columns])
        rows = scale.join(got, "v", "left").crossJoin(bounded_broadcast(sums))
        return stored(rows.select("v", *[((F.coalesce(c, F.lit(0.0)) - F.col("mu") * F.col(f"t{c}")) / F.col("sd")).alias(c)
                                         for c in columns]))

    def by_sample(y: DataFrame, columns: list[str]) -> DataFrame:
        """Z' y: one row a sample."""
        y = y.join(scale, "v").select("v", *[(F.col(c) / F.col("sd")).alias(c) for c in columns], "mu")
        less = y.agg(*[F.sum(F.col(c) * F.col("mu")).alias(f"t{c}") for c in columns])
        got = z.select("v", "s", "g").join(y, "v").groupBy("s").agg(*[F.sum(F.col("g") * F.col(c)).alias(c) for c in columns])
        rows = people.join(got, "s", "left").crossJoin(bounded_broadcast(less))
        return stored(rows.select("s", *[(F.coalesce(c, F.lit(0.0)) - F.coalesce(f"t{c}", F.lit(0.0))).alias(c) for c in columns]))

    width = max(1, min(k + extra, n_samples))
    columns = [f"c{j}" for j in range(width)]
    w, columns = orthonormal(people.select("s", *[hash_normal(seed + j, F.col("s")).alias(c) for j, c in enumerate(columns)]),
                             "s", columns)
    before = None
    for _ in range(max_rounds):
        y = by_variant(w, columns)
        value, vector = np.linalg.eigh(gram(y, columns))
        order = np.argsort(-value)[:k]
        value, vector = np.maximum(value[order], 0), vector[:, order]
        if width == n_samples or before is not None and np.allclose(value, before, rtol=tolerance, atol=0):
            break
        before = value
        w, columns = orthonormal(by_sample(y, columns), "s", columns)
    found = stored(times(w, "s", columns, vector))
    names = [f"pc{j + 1}" for j in range(len(value))]
    biggest = found.agg(*[F.max_by(f"c{j}", F.abs(f"c{j}")).alias(f"m{j}") for j in range(len(names))]).first()
    signed = found.select(F.col("s").alias(sample), *[(F.col(f"c{j}") * (-1.0 if (biggest[j] or 0) < 0 else 1.0)).alias(c)
                                                     for j, c in enumerate(names)])
    return signed, [(float(v) / max(n_variants, 1), float(v) / total if total else 0.0) for v in value]
