"""I-Match document fingerprints.

A document's terms (lower-cased runs of letters and digits) are kept when their
inverse document frequency lies in a band, that is when their share of all
documents lies between ``min_share`` and ``max_share``.  The lower share bounds
the lexicon by construction: at most (mean distinct terms per document) /
min_share terms, however large the corpus.  The sorted distinct kept terms are
hashed whole (SHA-1, the classic signature) and once per randomised lexicon
subset; a subset signature survives every edit outside its subset.

Subsets come in nested levels (level l keeps each term with probability 2^-l).
A fingerprint holds three levels around the one where a subset keeps one or two
of the document's terms, so short and long texts compare equally well.  The
likeness of two fingerprints is the share of equal signatures among the subsets
that are not empty in both.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinlake.llm.common import read

SUBSETS = 24
LEVELS = 3
#: Upper case to lower, ASCII white space and punctuation to the space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
SEEDS = np.array([xxhash.xxh3_64_intdigest(f"subset {i}") for i in range(SUBSETS)], dtype=np.uint64)
FLUSH_TERMS = 400_000


def terms(text: str) -> set[bytes]:
    return set(text.encode("utf-8", "replace").translate(FOLD).split())


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (wrap-around arithmetic)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Lexicon(dict):
    """word -> hash, or 0 outside the band; remembers a bounded number of words."""

    def __init__(self, hashes: np.ndarray):
        self.band = frozenset(hashes.tolist())

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) > FLUSH_TERMS:
            self.clear()
        self[word] = h = h if h in self.band else 0
        return h


def fingerprint(text: str, lexicon: Lexicon) -> tuple[str, int, np.ndarray] | None:
    """(kind and SHA-1 of the kept terms, first level, signatures [level, subset]).

    No word: None.  No word in the band: all words are kept (kind "a")."""
    found = terms(text)
    if not found:
        return None
    kept = np.fromiter(map(lexicon.__getitem__, found), dtype=np.uint64, count=len(found))
    kept = kept[kept != 0]
    kind = "b"
    if not len(kept):
        kind = "a"
        kept = np.array([xxhash.xxh3_64_intdigest(w) for w in found], dtype=np.uint64)
    kept = np.unique(kept)  # sorted, distinct
    whole = hashlib.sha1(kept.tobytes()).hexdigest()[:16]
    first = max(0, int(np.log2(len(kept))) - 1)
    drawn = mix(kept[:, None] ^ SEEDS[None, :])
    value = mix(kept + np.uint64(0x9E3779B97F4A7C15))[:, None]
    sig = np.zeros((LEVELS, SUBSETS), dtype=np.uint64)
    for i in range(LEVELS):
        if level := first + i:
            inside = drawn < np.uint64(2 ** (64 - level))
        else:
            inside = np.ones(drawn.shape, dtype=bool)
        # the signature of a set of terms: independent of their order, never 0 unless empty
        sig[i] = np.where(inside.any(0), mix((value * inside).sum(0, dtype=np.uint64)) >> np.uint64(48), 0)
        sig[i][(sig[i] == 0) & inside.any(0)] = 1
    return kind + whole, first, sig


def text_of(fp: tuple | None) -> str:
    """The fingerprint as a string: kind, SHA-1 part, first level, signatures."""
    return "-" if fp is None else f"{fp[0]}{fp[1]:02x}{fp[2].astype('>u2').tobytes().hex()}"


def likeness(a: tuple | None, b: tuple | None) -> float:
    """0 to 1; equal fingerprints give 1, a fingerprint without words only matches another."""
    if a is None or b is None:
        return float(a is b)
    if a[0] == b[0]:
        return 1.0
    if a[0][0] != b[0][0]:
        return 0.0
    best = 0.0
    for level in range(min(a[1], b[1]) + LEVELS - 1, max(a[1], b[1]) - 1, -1):
        if not (0 <= level - a[1] < LEVELS and 0 <= level - b[1] < LEVELS):
            continue
        x, y = a[2][level - a[1]], b[2][level - b[1]]
        filled = ((x > 0) | (y > 0)).sum()
        if filled:
            best = float(((x == y) & (x > 0)).sum() / filled)
            if 2 * filled >= SUBSETS:
                break
    return best


def document_frequencies(docs: DataFrame, text_col: str) -> DataFrame:
    """(term hash, documents that hold it).  Each task counts its own documents
    in a bounded table and hands on (hash, count) pairs."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()

        def drain():
            for lo in range(0, len(words := list(held)), 100_000):
                part = words[lo:lo + 100_000]
                yield pd.DataFrame({"h": np.array([xxhash.xxh3_64_intdigest(w) for w in part], dtype=np.uint64)
                                    .view(np.int64), "n": [held[w] for w in part]})
            held.clear()
        for pdf in batches:
            for t in pdf["t"]:
                if isinstance(t, str):
                    held.update(terms(t))
                    if len(held) > FLUSH_TERMS:
                        yield from drain()
        yield from drain()
    counted = docs.select(F.col(text_col).alias("t")).mapInPandas(count, "h long, n long")
    return counted.groupBy("h").agg(F.sum("n").alias("df"))


def lexicon(docs: DataFrame, text_col: str, min_share: float, max_share: float) -> np.ndarray:
    """Hashes of the terms whose document share lies in the band.  Collected: at
    most (mean distinct terms per document) / min_share of them."""
    n = docs.count()
    band = document_frequencies(docs, text_col).filter(
        (F.col("df") >= max(1.0, min_share * n)) & (F.col("df") <= max(1.0, max_share * n))).select("h")
    return np.array(band.toPandas()["h"], dtype=np.int64).view(np.uint64)


def fingerprint_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_share: float = 5e-4,
                          max_share: float = 0.1, bucket_rows: int = 2_000) -> DataFrame:
    """Fingerprints of each document and of its edited text (the last quarter of
    its code points replaced by the first as many of the next document's).

    The documents are range-partitioned by id and streamed in order; the first
    document of a range is also sent to the end of the range before it, so each
    task holds one document besides the current.  After the last id comes the
    first.  Nulls: a null text is empty, a null id sorts first; rows that repeat
    an id follow each other in the order of their compressed text.  An empty
    table gives an empty table."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    words = lexicon(src, "t", min_share, max_share)
    order = F.coalesce(F.col("id"), F.lit(-2 ** 63).cast("long"))
    n = src.count()
    buckets = min(20_000, max(1, -(-n // bucket_rows)))  # at most 20,000 split points reach the driver
    cuts = src.agg(F.min(order).alias("least"), F.percentile_approx(
        order, F.array(*[F.lit(i / buckets) for i in range(1, buckets)]) if buckets > 1 else F.array(F.lit(0.5)),
        10 * buckets).alias("cuts")).first()
    least = cuts["least"]
    splits = np.array(sorted(set(cuts["cuts"] or []) - {least}) if buckets > 1 else [], dtype=np.int64)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(level=1)
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            k = pdf["k"].to_numpy(dtype=np.int64)
            b = np.searchsorted(splits, k, side="right")
            z = [pack.compress((t if isinstance(t, str) else "").encode("utf-8", "replace")) for t in pdf["t"]]
            out = pd.DataFrame({"b": b, "last": 0, "id": pdf["id"].astype("Int64"), "k": k, "z": z})
            yield out
            first = np.isin(k, splits) | (k == least)  # the first document of its range: seen from the range before
            if first.any():
                again = out[first].copy()
                again["b"] = np.where(again["k"] == least, len(splits), again["b"] - 1)
                again["last"] = 1
                yield again

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack, lex = zstandard.ZstdDecompressor(), Lexicon(words)
        held, out = None, []

        def close(cur, nxt):
            (doc, text, fp), (_, after, fp_after) = cur, nxt
            q = len(text) // 4
            edited = text[:len(text) - q] + after[:q]
            e = fp if edited == text else fingerprint(edited, lex)
            return (doc, len(text), hashlib.sha256(edited.encode("utf-8")).hexdigest(), text_of(fp), text_of(e),
                    likeness(fp, e), likeness(fp, fp_after))

        def table():
            pdf = pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"id": "Int64"})
            out.clear()
            return pdf
        for pdf in batches:
            for last, doc, z in zip(pdf["last"], pdf["id"], pdf["z"]):
                if held is None and last:
                    continue  # further copies of the next range's first id
                text = unpack.decompress(z).decode("utf-8")
                now = (None if pd.isna(doc) else int(doc), text, fingerprint(text, lex))
                if held is not None:
                    out.append(close(held, now))
                held = None if last else now
                if len(out) >= 500:
                    yield table()
        if out:
            yield table()
    routed = src.select("id", order.alias("k"), "t").mapInPandas(
        route, "b int, last int, id long, k long, z binary")
    done = routed.repartition("b").sortWithinPartitions("b", "last", "k", "z").mapInPandas(stream, SCHEMA)
    return done.withColumnRenamed("id", id_col)


SCHEMA = ("id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def op1_imatch(spark, sf_dir):
    return fingerprint_with_next(read(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {"op1_imatch": op1_imatch}
