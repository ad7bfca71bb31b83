"""Mixture-controlled packing of token streams.

Every source is a queue of documents (in the order of a hash of their id).  A
window of ``window_tokens`` tokens takes from each queue its share of the target
proportions: the deficit round robin gives queue s a quantum per window, the
fraction of a token that it could not spend is carried to the next window, and
since both are functions of the window number alone every partition continues
where the one before it stopped.  In closed form queue s has spent
``m * k // K`` tokens after window k, where m is its length and K the number of
windows.  With other targets than the natural proportions the queues end one
after the other; each stretch between two ends is a phase of its own in which
the remaining queues share the windows in proportion to their weights.

Documents that come in an order of their own (those of a mix) keep it as far as the
windows allow.  The mix sets the target proportions there: a phase lasts until a source ends
and every source has been visited, and its rounds (as many as the mix comes back to that
source, of those not ended before, which it visits least) share it evenly.  A round's windows
take from each queue, whose documents stand in the order of the mix, its share of the
round as above, and lay what they took out in the order of the mix.

The windows laid end to end are one stream without gaps, cut into sequences of
``seq_len`` tokens; only the last sequence can be short.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterable, Iterator, Mapping
from fractions import Fraction
from itertools import accumulate

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinlake.llm.common import read, release_memory, staged, unit
from clinlake.plans.broadcast import sized_broadcast
from clinlake.plans.prefix import running_sum

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
SEQ_LEN = 4096
WINDOW_TOKENS = 16 * SEQ_LEN
#: Numbers that ``Spent`` remembers.
MAX_SPENT = 200_000
BUCKET_DOCS = 4_000
#: Documents of one bucket of places.
PLACE_DOCS = 500
#: A text without any of these is cut into pieces here: no other character has a
#: case or normal form that depends on its neighbours, all other white space is plain.
ODD = "[^ \\n!-~¡-įı-ɏ‐-‧‰-⁞€]|<\\|"
#: The tokenizer's own pieces of such a text: runs of letters, single digits,
#: English endings, runs of anything else (fixed by the vocabulary file).
LETTERS, DIGITS = "a-zªµºß-öø-ɏ", "0-9²³¹¼-¾"
PIECES = re.compile(f"[{LETTERS}]+|[{DIGITS}]|'(?:s|t|re|ve|m|ll|d)|[^ {LETTERS}{DIGITS}]+| ")
MAX_WORDS = 1_000_000


class Numbered(dict):
    """string -> number, in the order of first use."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


def spans(stop: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the values of ``items`` laid end to end, where item n's values
    lie between stop[n] and stop[n + 1]; and where each item ends."""
    first = stop[items]
    size = stop[items + 1] - first
    upto = np.zeros(len(items) + 1, dtype=np.int32)  # a batch holds far fewer than 2^31 ids
    np.cumsum(size, out=upto[1:])
    first -= upto[:-1]
    places = np.repeat(first, size)
    places += np.arange(upto[-1], dtype=np.int32)
    return places, upto


class TextIds:
    """Token ids of texts as bytes of unsigned integers.

    The vocabulary drops white space and never merges across pieces, so a text's
    ids are those of its words in a row, and a word's those of its pieces.  New
    words of a batch are cut into pieces together, new pieces are encoded
    together (joined by spaces; the ids are cut after each end-of-word token).
    The memory of words and pieces is bounded.  A text of other characters goes
    through the tokenizer whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.piecewise = Tokenizer.from_file(path)
        self.piecewise.normalizer = None  # pieces are lower case and in normal form
        vocab = self.tokenizer.get_vocab()
        size = max(vocab.values()) + 1
        self.dtype = np.dtype("<u2" if size <= 2 ** 16 else "<u4")
        self.ends = np.zeros(size, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.words, self.pieces = Numbered(), Numbered({" ": 0})  # a space is a piece without ids
        self.piece_stop, self.piece_ids = np.zeros(2, dtype=np.int32), np.empty(0, self.dtype)
        self.word_stop, self.word_ids = np.zeros(1, dtype=np.int32), np.empty(0, self.dtype)

    def learn(self) -> None:
        new = list(self.words)[len(self.word_stop) - 1:]
        if not new:
            return
        found = PIECES.findall(" ".join(new).lower())
        items = np.fromiter(map(self.pieces.__getitem__, found), np.int32, len(found))
        fresh = list(self.pieces)[len(self.piece_stop) - 1:]
        stops, known = [self.piece_stop], [self.piece_ids]
        for lo in range(0, len(fresh), 1_000):
            part = fresh[lo:lo + 1_000]
            ids = np.array(self.piecewise.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.dtype)
            cuts = np.flatnonzero(self.ends[ids]).astype(np.int32) + 1
            if len(cuts) != len(part):
                raise ValueError("pieces and end-of-word tokens do not pair up")
            stops.append(cuts + stops[-1][-1])
            known.append(ids)
        self.piece_stop, self.piece_ids = np.concatenate(stops), np.concatenate(known)
        places, upto = spans(self.piece_stop, items)
        ends = np.concatenate([upto[:-1][items == 0], upto[-1:]])  # words end at the spaces between them
        self.word_stop = np.concatenate([self.word_stop, ends + self.word_stop[-1]])
        self.word_ids = np.concatenate([self.word_ids, self.piece_ids[places]])

    def encode(self, texts: pa.StringArray) -> list[bytes]:
        if len(self.words) > MAX_WORDS:
            self.forget()
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, ODD)
        split = pc.split_pattern(pc.replace_substring(pc.if_else(odd, "", texts), "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        number = np.fromiter(map(self.words.__getitem__, coded.dictionary.to_pylist()), np.int32, len(coded.dictionary))
        self.learn()
        places, upto = spans(self.word_stop, number[coded.indices.to_numpy()])
        ids, at = self.word_ids[places], upto[split.offsets.to_numpy()]
        out = [ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
            whole = self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids
            out[i] = np.array(whole, self.dtype).tobytes()
        return out


def tokenised(docs: DataFrame, id_col: str, text_col: str, source_col: str, tokenizer: str,
              place_col: str | None = None) -> DataFrame:
    """(id, queue, h, n, ids) written once: token ids of each document with the
    end id, and its place hash (or its place)."""
    queue = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    h = F.col(place_col).cast("long") if place_col else F.xxhash64(F.lit("pack"), F.col(id_col).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = TextIds(tokenizer)
        end = np.array([END_ID], ids_of.dtype).tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 4_000):
                part = batch.slice(lo, 4_000)
                ids = [x + end for x in ids_of.encode(pa.concat_arrays([part.column("t")]).cast(pa.string()))]
                n = pa.array([len(x) // ids_of.dtype.itemsize for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("queue"), part.column("h"), n,
                                                  pa.array(ids, pa.binary())], ["id", "queue", "h", "n", "ids"])
        ids_of.forget()
        release_memory()
    src = docs.select(F.col(id_col).cast("long").alias("id"), queue.alias("queue"), h.alias("h"),
                      F.col(text_col).alias("t"))
    return src.mapInArrow(run, "id long, queue string, h long, n long, ids binary")


class Spent:
    """Tokens that each queue has given after k windows, and those of the queues
    before each (the last few are remembered)."""

    def __init__(self, m: list[int], windows: int):
        self.m, self.windows, self.known = m, windows, {}

    def __call__(self, k: int) -> tuple[list[int], list[int]]:
        if k not in self.known:
            if len(self.known) * len(self.m) > MAX_SPENT:
                self.known.clear()
            given = [m * k // self.windows for m in self.m]
            self.known[k] = given, list(accumulate(given, initial=0))
        return self.known[k]


def phases(tokens: Mapping[str, int], weights: Mapping[str, float] | None, window_tokens: int) -> list[dict]:
    """Stretches of windows with the same live queues: for each the tokens that
    every queue gives (``m``), what it gave before (``base``), the number of
    windows and the place in the stream where the stretch starts."""
    names = sorted(tokens)
    ends = {s: Fraction(tokens[s]) / Fraction(weights[s]) for s in names if tokens[s]} if weights else \
        {s: Fraction(1) for s in names if tokens[s]}
    out, spent, start = [], dict.fromkeys(names, 0), 0
    for v in sorted(set(ends.values())):
        upto = {s: tokens[s] if s not in ends or ends[s] <= v else int(Fraction(weights[s]) * v) for s in names}
        m = [upto[s] - spent[s] for s in names]
        if total := sum(m):
            out.append({"m": m, "base": [spent[s] for s in names], "windows": -(-total // window_tokens),
                        "start": start, "spent": Spent(m, -(-total // window_tokens))})
            start += total
        spent = upto
    return out


def place(queue: int, x: int, n: int, plan: list[dict], seq_len: int) -> list[tuple[int, int, int, int]]:
    """Pieces (start, length, sequence, offset) of a document that holds tokens
    x .. x+n-1 of its queue."""
    out, done = [], 0
    for ph in plan:
        m, base, k_all = ph["m"][queue], ph["base"][queue], ph["windows"]
        lo, hi = max(x + done, base), min(x + n, base + m)
        if lo >= hi or lo != x + done:
            continue
        spent, a = ph["spent"], lo
        while a < hi:
            k = ((a - base + 1) * k_all - 1) // m  # the window of token a; a short queue skips windows
            (before, ahead), (after, ahead_after) = spent(k), spent(k + 1)
            b = min(hi, base + after[queue])
            g = ph["start"] + ahead[-1] + ahead_after[queue] - ahead[queue] + a - base - before[queue]
            while a < b:
                take = min(b - a, seq_len - g % seq_len)
                out.append((a - x, take, g // seq_len, g % seq_len))
                a, g = a + take, g + take
        done = hi - x
        if done == n:
            break
    return out


def with_digest(doc: int, queue: str, n: int, ids: bytes, cuts: Iterable[tuple[int, int, int, int]]) -> list[tuple]:
    """The rows of a document's pieces (start, length, sequence, offset)."""
    wide = np.frombuffer(ids, dtype="<u2" if len(ids) == 2 * n else "<u4").astype("<u4").tobytes()
    return [(doc, start, length, zlib.crc32(wide[4 * start:4 * (start + length)]), n, seq, off, queue)
            for start, length, seq, off in cuts]


def in_sequences(pieces: Iterable[tuple[int, int, int]], seq_len: int) -> Iterator[tuple[int, int, int, int]]:
    """Pieces (start, length, place in the stream) cut where a sequence ends: (start, length,
    sequence, offset)."""
    for start, length, at in pieces:
        while length:
            take = min(length, seq_len - at % seq_len)
            yield start, take, at // seq_len, at % seq_len
            start, length, at = start + take, length - take, at + take


def cutter(seq_len: int):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, queue, n, ids, *cuts in zip(*[pdf[c] for c in ("id", "queue", "n", "ids", "start", "length", "at")]):
                out += with_digest(doc, queue, n, ids, in_sequences(zip(*[c.tolist() for c in cuts]), seq_len))
            yield pd.DataFrame(out, columns=PIECE_NAMES).astype({"id": "Int64"})
    return cut


def share(x: str, of: str, parts: str) -> Column:
    """x * of / parts rounded down, the product in 38 digits."""
    return F.expr(f"cast({x} as decimal(19,0)) * {of} div {parts}")


def share_up(x: str, of: str, parts: str) -> Column:
    """x * of / parts rounded up."""
    return F.expr(f"(cast({x} as decimal(19,0)) * {of} + {parts} - 1) div {parts}")


def rounds(rows: DataFrame) -> DataFrame:
    """``rows`` (queue, place ``h``, bucket ``b``, tokens ``n``) with the place ``s`` at which the
    round of each begins, and the tokens ``at`` of all places before it.

    The visits of a queue are its runs of neighbouring places.  A phase ends with the
    first end of a queue behind the first visits of all queues that live at its start, so no run
    reaches over it.  It has as many rounds, of equally many places, as the least visited
    of the queues that do not end inside it has visits.  The driver holds two numbers a queue."""
    last = rows.groupBy(F.col("queue").alias("q")).agg(F.max("h").alias("last"))
    rows = rows.join(sized_broadcast(last), F.col("queue") == F.col("q")).select(
        "h", "b", "queue", "n", (F.col("h") == F.col("last")).cast("long").alias("ends"))
    buckets = Window.orderBy("b")  # one row per bucket
    inside = Window.partitionBy("b").orderBy("h")

    def earlier(total: str, over) -> Column:
        return F.coalesce(F.sum(total).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    first = rows.groupBy("b").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"), F.max_by("queue", "h").alias("q")).select(
        F.col("b").alias("ob"), earlier("n", buckets).alias("on"), earlier("ends", buckets).alias("oe"),
        F.lag("q").over(buckets).alias("oq"))
    previous = F.coalesce(F.lag("queue").over(inside), F.col("oq"))
    rows = staged(rows.join(sized_broadcast(first), F.col("b") == F.col("ob")).select(
        "h", "b", "queue", "n", (F.col("on") + earlier("n", inside)).alias("at"),
        (F.col("oe") + earlier("ends", inside)).alias("phase"),
        F.coalesce(previous != F.col("queue"), F.lit(True)).cast("long").alias("visit")), "places")
    per = Window.partitionBy("queue")
    seen = rows.groupBy("phase", "queue").agg(
        F.sum("visit").alias("v"), F.count(F.lit(1)).alias("d"), F.min("h").alias("f")).select(
        "phase", "queue", "v", "d", "f", F.max("phase").over(per).alias("z"),
        F.coalesce(F.lag("phase").over(per.orderBy("phase")), F.lit(-1).cast("long")).alias("since"))
    ends = sorted(r["last"] for r in last.toLocalIterator())
    met = {r["since"]: r["f"] for r in seen.groupBy("since").agg(F.max("f").alias("f")).toLocalIterator()}
    upto = list(accumulate((met.get(j, -1) for j in range(-1, len(ends))), max))  # where all that live have been met
    whole = []
    while len(whole) < len(ends):
        j = len(whole)
        k = bisect.bisect_left(ends, upto[j])
        whole += [(i, k, ends[j - 1] + 1 if j else 0) for i in range(j, k + 1)]
    whole = sized_broadcast(rows.sparkSession.createDataFrame(whole, "i long, k long, f long"))
    phases = seen.drop("f").join(whole, F.col("phase") == F.col("i")).groupBy("k", "f", "queue").agg(
        F.sum("v").alias("v"), F.sum("d").alias("d"), F.max("z").alias("z")).groupBy(F.col("k").alias("p"), "f").agg(
        F.min(F.when(F.col("z") >= F.col("k"), F.col("v"))).alias("v"), F.sum("d").alias("d"))
    rows = rows.join(whole.drop("f"), F.col("phase") == F.col("i"))
    rows = rows.join(sized_broadcast(phases), F.col("k") == F.col("p")).withColumn("r", share("h - f", "v", "d"))
    return rows.select("h", "b", "queue", "n", "at", (F.col("f") + share_up("r", "d", "v")).alias("s"))


def mixed_pieces(rows: DataFrame, window_tokens: int) -> DataFrame:
    """``start`` and ``length`` of each document's pieces and their places ``at`` in the
    stream (arrays), one row per place ``h``, where the windows of a round take
    from each queue its share of the round.  Rows as ``rounds`` takes them."""
    rows = staged(rounds(rows), "rounds")
    own = Window.partitionBy("s", "queue")
    before = own.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("s", "queue", "b").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    queues = rows.groupBy("s", "queue", "b").agg(F.sum("n").alias("n")).select(
        F.col("s").alias("os"), F.col("queue").alias("oq"), F.col("b").alias("ob"),
        F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("o"), F.sum("n").over(own).alias("m"))
    stretches = rows.groupBy(F.col("s").alias("ts")).agg(
        F.expr(f"(sum(n) + {window_tokens - 1}) div {window_tokens}").alias("w"), F.min("at").alias("base"))
    rows = rows.join(sized_broadcast(queues), (F.col("s") == F.col("os")) & (F.col("queue") == F.col("oq")) & (
        F.col("b") == F.col("ob"))).join(sized_broadcast(stretches), F.col("s") == F.col("ts"))
    rows = rows.withColumn("x", F.col("o") + F.coalesce(F.sum("n").over(inside), F.lit(0).cast("long")))
    # i: the windows of a document or, where its queue has less than a token a window, its tokens
    short = F.col("m") <= F.col("w")
    pieces = rows.withColumn("i", F.explode(F.sequence(
        F.when(short, F.col("x")).otherwise(share_up("x + 1", "w", "m") - 1),
        F.when(short, F.expr("x + n - 1")).otherwise(share_up("x + n", "w", "m") - 1))))
    pieces = pieces.select(
        "s", "h", "base", "x", F.when(short, share_up("i + 1", "w", "m") - 1).otherwise(F.col("i")).alias("k"),
        F.when(short, F.col("i")).otherwise(F.greatest("x", share("i", "m", "w"))).alias("lo"),
        F.when(short, F.expr("i + 1")).otherwise(F.least(F.expr("x + n"), share("i + 1", "m", "w"))).alias("hi"))
    pieces = staged(pieces.select("s", "k", "h", "base", F.expr("lo - x").alias("start"), F.expr("hi - lo").alias("length")), "taken")
    windows = running_sum(pieces.groupBy("s", "k").agg(F.sum("length").alias("n")), ["s"], ["k"], ["n"], ["upto"]).select(
        F.col("s").alias("os"), F.col("k").alias("ok"), (F.col("upto") - F.col("n")).alias("o"))
    taken = Window.partitionBy("s", "k").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("base") + F.col("o") + F.coalesce(F.sum("length").over(taken), F.lit(0).cast("long"))
    placed = pieces.join(sized_broadcast(windows), (F.col("s") == F.col("os")) & (F.col("k") == F.col("ok"))).select(
        "h", F.struct("start", "length", at.alias("at")).alias("piece"))
    found = placed.groupBy("h").agg(F.sort_array(F.collect_list("piece")).alias("p"))
    return found.select("h", *[F.col("p").getField(c).alias(c) for c in ("start", "length", "at")])


def pack(docs: DataFrame, weights: Mapping[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text",
         source_col: str = "source", seq_len: int = SEQ_LEN, window_tokens: int = WINDOW_TOKENS,
         tokenizer: str | None = None, bucket_docs: int | None = None, place_col: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and the queue.

    ``weights`` gives every queue's target share (None: in proportion to its
    tokens, so that each window mirrors the corpus).  Nulls: a null text is
    empty and packs its end id alone, a null source is the queue "", a null id
    stays.  Repeated rows are packed each.  An empty table gives no piece.

    ``place_col`` names a gapless 0-based place: the documents are then mixed
    already.  The queues follow that order and its proportions, round by round of the
    mix (``weights`` do not apply); see the head of this module."""
    if place_col and weights:
        raise ValueError("documents with a place are mixed already")
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    n_docs = docs.count()
    buckets = max(1, min(20_000, -(-n_docs // (bucket_docs or (PLACE_DOCS if place_col else BUCKET_DOCS)))))
    t = tokenised(docs, id_col, text_col, source_col, path, place_col)
    part = F.col("h") / F.lit(max(n_docs, 1)) if place_col else unit(F.col("h")) / F.lit(2 ** 31)
    t = t.withColumn("b", F.floor(part * F.lit(buckets)).cast("int"))
    if place_col:
        t = staged(t, "tokens", "zstd")
        cuts = mixed_pieces(t.select("queue", "h", "b", "n"), window_tokens)
        return t.join(cuts, "h").mapInPandas(cutter(seq_len), PIECE).withColumnRenamed("id", id_col)
    earlier = (Window.partitionBy("queue", "b").orderBy(unit(F.col("h")), "h", "id", "ids")
               .rowsBetween(Window.unboundedPreceding, -1))
    t = staged(t.withColumn("x", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long"))), "tokens", "zstd")
    totals = t.groupBy("queue", "b").agg(F.sum("n").alias("n"))
    lengths = {r["queue"]: r["n"] for r in totals.groupBy("queue").agg(F.sum("n").alias("n")).toLocalIterator()}
    names, plan = sorted(lengths), phases(lengths, weights, window_tokens)
    number = {s: i for i, s in enumerate(names)}
    before = Window.partitionBy("queue").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("queue").alias("oq"), F.col("b").alias("ob"),
                            F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("o"))
    rows = t.join(sized_broadcast(offsets), (F.col("queue") == F.col("oq")) & (F.col("b") == F.col("ob"))).select(
        "id", "queue", (F.col("x") + F.col("o")).alias("x"), "n", "ids")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, queue, x, n, ids in zip(pdf["id"], pdf["queue"], pdf["x"], pdf["n"], pdf["ids"]):
                out += with_digest(doc, queue, n, ids, place(number[queue], x, n, plan, seq_len))
            yield pd.DataFrame(out, columns=PIECE_NAMES).astype({"id": "Int64"})
    pieces = rows.mapInPandas(cut, PIECE)
    return pieces.withColumnRenamed("id", id_col)


PIECE = ("id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
         "queue string")
PIECE_NAMES = [c.split()[0] for c in PIECE.split(", ")]


def op5_mixture_packing(spark, sf_dir):
    return pack(read(spark, sf_dir, "documents", "doc_id", "text", "source"))


QUERIES = {"op5_mixture_packing": op5_mixture_packing}
