"""Top-k by BM25 or token Jaccard without pairs of all queries and documents
(SURVEY 2.16.11, 2.16.14).

Two passes, no postings table.  The first counts, per task in a bounded table, the
documents of every term; only (term, count) rows are shuffled.  The second sends
the terms of the queries to the executors, in blocks of queries under a bound,
and scores the documents where they are read: a task keeps the best k documents
of each query and hands on those alone, so at most tasks x queries x k rows are
shuffled, whatever the number of documents that share a term with a query.

Once a query has k documents in a task, its terms are divided by their upper
bounds: documents that hold only terms whose bounds together stay below the k-th
score are never scored for it, and the other terms of the rest are looked up."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinlake.operators.retrieval import BM25_B, BM25_K1, bm25_idf, top_k_per_group
from clinlake.operators.text import whitespace_tokens
from clinlake.plans.parallel import spread
from clinlake.plans.broadcast import bounded_broadcast
from clinlake.session import checkpoint_dir

#: Query terms sent to the executors at a time.
BLOCK_TERMS = 2_000_000
#: Different terms that a task counts before it hands them on; documents scored together.
HELD_TERMS, BLOCK_DOCS = 400_000, 512
#: Scores closer than this count as equal (then the id decides).
SCORE_DIGITS = 9


def _low(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, t): the lower-cased text as bytes, which split at the white space that ``\\s`` is."""
    return spread(docs.select(doc_id, text), [doc_id]).select(
        F.col(doc_id).alias("id"), F.lower(F.coalesce(F.col(text), F.lit(""))).cast("binary").alias("t"))


def document_frequencies(low: DataFrame) -> DataFrame:
    """(term, df, tokens): documents and occurrences of every term."""
    schema = pa.schema([("term", pa.binary()), ("df", pa.int64()), ("tokens", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, tokens = Counter(), Counter()

        def drain():
            terms = list(docs)
            for lo in range(0, len(terms), 100_000):
                part = terms[lo:lo + 100_000]
                yield pa.record_batch([pa.array(part, pa.binary()), pa.array([docs[t] for t in part], pa.int64()),
                                       pa.array([tokens[t] for t in part], pa.int64())], schema=schema)
            docs.clear()
            tokens.clear()
        for batch in batches:
            for t in batch.column("t").to_pylist():
                found = t.split()
                tokens.update(found)
                docs.update(set(found))
                if len(docs) > HELD_TERMS:
                    yield from drain()
        yield from drain()
    return low.select("t").mapInArrow(count, "term binary, df long, tokens long").groupBy(
        F.col("term").cast("string").alias("term")).agg(F.sum("df").alias("df"), F.sum("tokens").alias("tokens"))


class QueryTerms:
    """The queries' terms as rows of a sparse matrix: for each term the queries that
    hold it and their weights; and for each query its terms by rising weight."""

    def __init__(self, rows: list[tuple]):
        """rows: (query id, term, weight)."""
        self.ids = sorted({r[0] for r in rows})
        number = {q: i for i, q in enumerate(self.ids)}
        self.terms: dict[bytes, int] = {}
        t = np.array([self.terms.setdefault(r[1].encode(), len(self.terms)) for r in rows], np.int64)
        q, w = np.array([number[r[0]] for r in rows], np.int64), np.array([r[2] for r in rows], float)
        order = np.lexsort((q, t))
        self.term, self.query, self.weight = t[order], q[order], w[order]
        self.first = np.searchsorted(self.term, np.arange(len(self.terms) + 1))
        rise = np.lexsort((self.weight, self.query))
        upto = np.cumsum(np.maximum(self.weight[rise], 0))
        start = np.searchsorted(self.query[rise], np.arange(len(self.ids)))
        before = np.concatenate([[0.0], upto])[start]
        self.upto = np.empty(len(rows))  # the weights of the query's terms up to this one
        self.upto[rise] = upto - before[self.query[rise]]

    @classmethod
    def of(cls, state: dict) -> QueryTerms:
        made = cls.__new__(cls)
        made.__dict__.update(state)
        return made

    def entries(self, terms: np.ndarray, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``terms``, entry of the matrix) for all chosen entries of each term."""
        n = self.first[terms + 1] - self.first[terms]
        which = np.repeat(np.arange(len(terms)), n)
        entry = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[terms], n)
        if chosen is not None:
            keep = chosen[entry]
            which, entry = which[keep], entry[keep]
        return which, entry


class Best:
    """The k best (rounded score, id) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.queries, self.k, self.rows = queries, k, None
        self.least = np.full(queries, -np.inf)  # the k-th score

    def add(self, query: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        rows = [query, doc, score]
        if self.rows is not None:
            rows = [np.concatenate(x) for x in zip(self.rows, rows)]
        order = np.lexsort((rows[1], -np.round(rows[2], SCORE_DIGITS), rows[0]))
        rows = [x[order] for x in rows]
        place = np.arange(len(order)) - np.searchsorted(rows[0], rows[0])
        self.rows = [x[place < self.k] for x in rows]
        last = place == self.k - 1
        self.least[rows[0][last]] = rows[2][last]


Score = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _scorer(sent, k: int, part: Score, finish: Callable | None):
    """The second pass: the best k documents of each query in a task's rows.

    ``part(tf, dl)`` is a term's share of a score before its weight; ``finish`` (sums, dl,
    query) turns sums into scores (None: they are the scores, and bounds apply)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = QueryTerms.of(sent.value)
        n_terms, n_queries = len(q.terms), len(q.ids)
        best = Best(n_queries, k)

        def score(ids: list, lengths: list, counted: list) -> None:
            doc = np.repeat(np.arange(len(ids)), [len(c) for c in counted])
            term = np.fromiter((t for c in counted for t in c), np.int64, len(doc))
            tf = np.fromiter((n for c in counted for n in c.values()), float, len(doc))
            dl = np.array(lengths, float)
            share = part(tf, dl[doc])
            # documents without one of these terms stay below the k-th score
            strong = None if finish else q.upto >= best.least[q.query] - 10.0 ** -SCORE_DIGITS
            which, entry = q.entries(term, strong)
            at = doc[which] * n_queries + q.query[entry]
            sums = np.bincount(at, weights=share[which] * q.weight[entry], minlength=len(ids) * n_queries)
            pair = np.unique(at)
            d, query = pair // n_queries, pair % n_queries
            value = sums[pair]
            if strong is not None and not strong.all():
                weak = np.flatnonzero(~strong)
                weak = weak[np.argsort(q.query[weak], kind="stable")]
                begin = np.searchsorted(q.query[weak], np.arange(n_queries + 1))
                n = (begin[1:] - begin[:-1])[query]
                one = np.repeat(np.arange(len(pair)), n)
                e = weak[np.arange(len(one)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[query], n)]
                held = doc * n_terms + term
                order = np.argsort(held)
                asked = d[one] * n_terms + q.term[e]
                place = np.minimum(np.searchsorted(held[order], asked), len(held) - 1) if len(held) else asked[:0]
                hit = held[order][place] == asked
                value = value + np.bincount(one[hit], weights=share[order][place[hit]] * q.weight[e[hit]], minlength=len(pair))
            if finish:
                value = finish(value, dl[d], query)
            good = value >= best.least[query] - 10.0 ** -SCORE_DIGITS
            best.add(query[good], np.array(ids)[d[good]], value[good])
        ids, lengths, counted = [], [], []
        for batch in batches:
            for i, t in zip(batch.column("id").to_pylist(), batch.column("t").to_pylist()):
                found = t.split()
                if finish:
                    found = set(found)
                c = Counter(map(q.terms.get, found))
                c.pop(None, None)
                if c:
                    ids.append(i)
                    lengths.append(len(found))
                    counted.append(c)
                if len(ids) >= BLOCK_DOCS:
                    score(ids, lengths, counted)
                    ids, lengths, counted = [], [], []
        if ids:
            score(ids, lengths, counted)
        if best.rows is not None:
            query, doc, value = best.rows
            yield pa.RecordBatch.from_arrays([pa.array([q.ids[i] for i in query]), pa.array(doc.tolist()),
                                              pa.array(value, pa.float64())], names=["q", "d", "score"])
    return run


def _blocks(qt: DataFrame, n_terms: int, block_terms: int) -> Iterator[list[tuple]]:
    """Rows (query, term, ...) of the queries, a block of queries at a time."""
    n = max(1, -(-n_terms // block_terms))
    for i in range(n):
        rows = [tuple(r) for r in qt.filter(F.pmod(F.xxhash64("q"), F.lit(n)) == i).collect()]
        if rows:
            yield rows


def _best(parts: list[DataFrame], schema: str, spark, doc_id: str, q_id: str, k: int, digits: int | None) -> DataFrame:
    found = spark.createDataFrame([], schema)
    for p in parts:
        found = found.unionByName(p)
    by = F.round("score", digits).desc() if digits else F.col("score").desc()
    top = top_k_per_group(found, ["q"], [by, F.col("d")], k, salt_of=F.xxhash64("d"))
    return top.withColumnsRenamed({"q": q_id, "d": doc_id})


def bm25_top_k(docs: DataFrame, doc_id: str, doc_text: str, queries: DataFrame, q_id: str, q_text: str, k: int,
               block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(q_id, doc_id, score, rank): the k best documents of every query by BM25
    (Okapi, negative idf floored at a quarter of the mean idf), ties by id.

    Documents without a term of the query are not ranked.  A null text has no terms."""
    spark = docs.sparkSession
    checkpoint_dir(spark)
    low = _low(docs, doc_id, doc_text)
    terms = document_frequencies(low).checkpoint(eager=True)
    n_docs = docs.agg(F.count(F.lit(1)).alias("_N"))
    asked = queries.select(F.col(q_id).alias("q"), F.explode(whitespace_tokens(q_text)).alias("term")).groupBy("q", "term").agg(
        F.count(F.lit(1)).alias("qtf"))
    qt = asked.join(bm25_idf(terms, n_docs), "term").select("q", "term", (F.col("qtf") * F.col("idf")).alias("w")).checkpoint()
    stats = terms.agg(F.sum("tokens").alias("t")).crossJoin(bounded_broadcast(n_docs)).first()
    mean = (stats["t"] or 0) / max(stats["_N"], 1)
    schema = f"q {queries.schema[q_id].dataType.simpleString()}, d {docs.schema[doc_id].dataType.simpleString()}, score double"

    def part(tf, dl):
        return tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * dl / mean))
    parts = []
    for rows in _blocks(qt, qt.count(), block_terms):
        # the weights are upper bounds once they hold the largest share that a term can have
        sent = spark.sparkContext.broadcast(vars(QueryTerms([(q, t, w * (BM25_K1 + 1)) for q, t, w in rows])))
        parts.append(low.mapInArrow(_scorer(sent, k, lambda tf, dl: part(tf, dl) / (BM25_K1 + 1), None), schema))
    return _best(parts, schema, spark, doc_id, q_id, k, SCORE_DIGITS)


def jaccard_top_k(docs: DataFrame, doc_id: str, doc_text: str, queries: DataFrame, q_id: str, q_text: str, k: int,
                  block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(q_id, doc_id, score, rank): the k documents whose sets of lower-cased words are
    most like the query's, ties by id; documents that share no word are not ranked."""
    spark = docs.sparkSession
    low = _low(docs, doc_id, doc_text)
    qt = queries.select(F.col(q_id).alias("q"), F.explode(F.array_distinct(whitespace_tokens(q_text))).alias("term"))
    schema = f"q {queries.schema[q_id].dataType.simpleString()}, d {docs.schema[doc_id].dataType.simpleString()}, score double"
    parts = []
    for rows in _blocks(qt, qt.count(), block_terms):
        terms = QueryTerms([(q, t, 1.0) for q, t in rows])
        size = np.bincount(terms.query, minlength=len(terms.ids))
        sent = spark.sparkContext.broadcast(vars(terms))
        parts.append(low.mapInArrow(_scorer(sent, k, lambda tf, dl: np.ones(len(tf)),
                                            lambda shared, dl, q, size=size: shared / (dl + size[q] - shared)), schema))
    return _best(parts, schema, spark, doc_id, q_id, k, None)
