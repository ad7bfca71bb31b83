"""Quality classifier: hashed word n-gram logistic regression, trained with
follow-the-regularised-leader (FTRL-proximal) updates.

Tokens are runs of letters and digits (lower case; a run of capitals is
preceded by a marker token), runs of punctuation, and a marker where a token
repeats the one before it, or a word the one before that.  Unigrams and bigrams of the token stream are
hashed into 2^20 coordinates with weight sqrt(count), scaled to unit length.

Training reads at most ``max_train`` labelled rows (those with the smallest
hash of their id): they are dealt to ``shards`` tasks, each runs FTRL over its
rows, and the models are averaged.  Scoring covers every document; a score is a
sparse dot product with the averaged weights, of which the driver holds at most
2^20.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinlake.llm.common import read, release_memory

DIMS = 2 ** 20
TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
CAPITALS, AGAIN = "<capitals>", "<again>"
MAX_WORDS = 100_000


class WordHash(dict):
    """token -> 64-bit hash; remembers a bounded number of tokens."""

    def __missing__(self, token: str) -> int:
        if len(self) > MAX_WORDS:
            self.clear()
        self[token] = h = xxhash.xxh3_64_intdigest(token)
        return h


def tokens(text: str) -> list[str]:
    out, before, earlier = [], None, None
    for t in TOKEN.findall(text):
        if t.isupper() and len(t) > 1:
            out.append(CAPITALS)
        t = t.lower()
        out.append(AGAIN if t == before or (t == earlier and t.isalnum()) else t)
        before, earlier = t, before
    return out


def vector(text: str, known: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Sorted coordinates and their unit-length weights; no token: none."""
    found = tokens(text)
    if not found:
        return np.empty(0, np.int64), np.empty(0)
    h = np.fromiter(map(known.__getitem__, found), dtype=np.uint64, count=len(found))
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + (h[1:] ^ (h[1:] >> np.uint64(29)))
    grams = np.concatenate([h, pairs * np.uint64(0xBF58476D1CE4E5B9)]) >> np.uint64(44)
    at, n = np.unique(grams, return_counts=True)
    x = np.sqrt(n)
    return at.astype(np.int64), x / np.sqrt((x * x).sum())


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 10, alpha: float = 2.0, beta: float = 1.0,
         l1: float = 0.005, l2: float = 0.01) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal over (label, coordinates, weights): the non-zero
    coordinates, their weights and the bias."""
    z, n = np.zeros(DIMS + 1), np.zeros(DIMS + 1)

    def weights(i):
        w = -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(z[i]) <= l1, 0.0, w)
    for _ in range(epochs):
        for y, at, x in rows:
            at, x = np.append(at, DIMS), np.append(x, 0.3)  # the last coordinate is the bias
            w = weights(at)
            g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    used = np.flatnonzero(n[:-1])
    w = weights(used)
    return used[w != 0], w[w != 0], float(weights(np.array([DIMS]))[0] * 0.3)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt; a null id is not held out (it has no label)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", max_train: int = 20_000, shards: int = 4) -> tuple[np.ndarray, float]:
    """Dense weights (2^20) and bias.  Repeated labels of a document count as
    their mean; null labels, labels of held-out rows and labels without a
    document are not used; without any label all weights are 0."""
    mark = (labels.select(F.col(id_col).alias("lid"), F.col(label_col).cast("double").alias("y"))
            .filter(F.col("lid").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("lid")))
            .groupBy("lid").agg(F.avg("y").alias("y")))
    sample = mark.orderBy(F.xxhash64(F.lit("train"), "lid"), "lid").limit(max_train)
    rows = docs.select(F.col(id_col).alias("lid"), F.col(text_col).alias("t")).join(
        F.broadcast(sample), "lid").groupBy("lid").agg(  # at most max_train rows; repeated ids train once
            F.min(F.coalesce(F.col("t"), F.lit(""))).alias("t"), F.min("y").alias("y"))

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["o", "lid"])
        known = WordHash()
        at, w, bias = ftrl([(float(y >= 0.5), *vector(t, known)) for y, t in zip(pdf["y"], pdf["t"])])
        return pd.DataFrame({"at": np.append(at, -1), "w": np.append(w, bias)})
    dealt = rows.select("lid", "t", "y", F.xxhash64(F.lit("order"), "lid").alias("o"),
                        F.pmod(F.xxhash64(F.lit("deal"), "lid"), F.lit(shards)).alias("shard"))
    model = dealt.groupBy("shard").applyInPandas(learn, "at long, w double").groupBy("at").agg(
        F.sum("w").alias("w")).toPandas()
    weights = np.zeros(DIMS)
    bias = 0.0
    if len(model):
        used = model["at"].to_numpy()
        mean = model["w"].to_numpy() / shards
        weights[used[used >= 0]] = mean[used >= 0]
        bias = float(mean[used < 0].sum())
    return weights, bias


def scorer(weights: np.ndarray, bias: float):
    """A pandas UDF: text -> score.  A null text is empty and scores by the bias."""
    at = np.flatnonzero(weights)
    pairs = at, weights[at].astype(np.float32)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = np.zeros(DIMS)
        w[pairs[0]] = pairs[1]
        known = WordHash()
        for texts in batches:
            s = []
            for t in texts:
                i, x = vector(t if isinstance(t, str) else "", known)
                s.append(1.0 / (1.0 + np.exp(-np.clip(bias + w[i] @ x, -35, 35))))
            yield pd.Series(s, dtype="float64")
        known.clear()
        release_memory()
    return run


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality", **kw) -> DataFrame:
    """(id, held_out, score, predicted) of every document.  Nulls, empty texts
    and repeated rows: see ``train`` and ``scorer``; an empty table gives an
    empty table; other columns are ignored."""
    weights, bias = train(docs, labels, id_col, text_col, label_col, **kw)
    out = docs.select(id_col, scorer(weights, bias)(text_col).alias("score"))
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_ftrl_quality(spark, sf_dir):
    return classify(read(spark, sf_dir, "documents", "doc_id", "text"),
                    read(spark, sf_dir, "labels", "doc_id", "quality"))


QUERIES = {"op3_ftrl_quality": op3_ftrl_quality}
