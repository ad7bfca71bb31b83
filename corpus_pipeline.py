"""Corpus pipeline: quality classifier, near duplicates, PII, mixing, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame that works on all
that the stage before it kept; its result is written as Parquet and read again
as the next stage's docs.  All stages but the last return the columns of
``documents``, and further columns that ``documents`` may have, whatever their names.
A table without rows goes through all stages.  When a stage begins, the tables
that the one before it staged are dropped: its result is written by then."""

from __future__ import annotations

import functools

from pyspark.sql import Window
from pyspark.sql import functions as F

from clinlake.llm import jaccard_join, mixing, packing, pii_spans, quality_model
from clinlake.llm.common import drop_staged, file_order, read, staged, staging, unused
from clinlake.plans.broadcast import sized_broadcast

_left: dict[str, list[str]] = {}  # stage -> paths that its result is computed from


def after(before):
    """Decorator: a stage that drops what the stage ``before`` (a name, None: the
    first) staged, and keeps note of what it stages itself."""
    def wrap(stage):
        @functools.wraps(stage)
        def run(spark, docs, sf_dir):
            drop_staged(spark, _left.pop(before, []))
            with staging() as paths:
                out = stage(spark, docs, sf_dir)
            _left[stage.__name__] = paths
            return out
        return run
    return wrap



@after(None)
def keep_good(spark, docs, sf_dir):
    """Operator 3: documents scored below 0.5 go.  A null or empty text has the score
    of the empty text; repeated rows stay or go together, rows without an id are
    scored like any other."""
    labels = read(spark, sf_dir, "labels", "doc_id", "quality")
    weights, bias = quality_model.train(docs, labels)
    return docs.filter(quality_model.scorer(weights, bias)("text") >= 0.5)


@after("keep_good")
def drop_near_duplicates(spark, docs, sf_dir):
    """Operator 2 (five words, similarity 0.8): of each group of linked documents
    the one with the smallest doc_id stays.  Of rows with equal doc_id and text one
    stays: the first by a hash of all its columns.  Rows without an id stay, and
    so do documents without words, which link with nothing."""
    g, r, h = unused(docs.columns, "g", "r", "h")
    groups = staged(jaccard_join.join(docs.select("doc_id", "text"), k=5, num=80, den=100), "groups")
    named = groups.filter("doc_id is not null").groupBy(F.col("doc_id").alias(g)).agg(
        F.max(F.col("doc_id") == F.col("component_id")).alias("stays"), F.count(F.lit(1)).alias("n"))
    gone = sized_broadcast(staged(named.filter(~F.col("stays")).select(g), "gone"))
    again = sized_broadcast(staged(named.filter("stays and n > 1").select(g), "again"))
    left = docs.join(gone, F.col("doc_id") == F.col(g), "left_anti")
    once = left.join(again, F.col("doc_id") == F.col(g), "left_anti")
    same = Window.partitionBy("doc_id", "text").orderBy(h)
    repeated = left.join(again, F.col("doc_id") == F.col(g), "left_semi").withColumn(h, F.xxhash64(*docs.columns))
    return once.unionByName(repeated.withColumn(r, F.row_number().over(same)).filter(F.col(r) == 1).drop(h, r))


@after("drop_near_duplicates")
def redact_personal_data(spark, docs, sf_dir):
    """Operator 6: every span is replaced by its kind; n_chars follows the text.  A
    text without spans, and a null text, stays as it is, and so do repeated rows."""
    found = pii_spans.detect(docs, keep_rows=True)
    text = pii_spans.redact(F.col("row.text"), F.col("spans"))
    fields = {"text": text.alias("text"), "n_chars": F.when(F.size("spans") > 0, F.length(text)).otherwise(
        F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars")}
    return found.select(*[fields.get(c, F.col("row").getField(c).alias(c)) for c in docs.columns])


@after("redact_personal_data")
def mix_sources(spark, docs, sf_dir):
    """Operator 4: the rows in the order of the mix (files and rows in position order).

    The schedule is made for (source, doc_id, place in the files) alone; the texts
    move once, to their position (twice where the positions are too many to
    broadcast).  A null source is the source "", repeated rows follow each other."""
    place, at, position = unused([*docs.columns, "doc_id", "source"], "place", "at", "position")
    rows = file_order(docs, place)
    mixed = mixing.mix(rows.select("doc_id", "source", place))
    to = staged(mixed.select(F.col("row").getField(place).alias(at), F.col("position").alias(position)), "positions")
    placed = rows.join(sized_broadcast(to), F.col(place) == F.col(at))
    return placed.repartitionByRange(position).sortWithinPartitions(position).select(*docs.columns)


@after("mix_sources")
def pack_windows(spark, docs, sf_dir):
    """Operator 5: the pieces of all documents, one stream.  Every source is a queue in the
    order of the mix (the order of the rows in the Parquet files that the stage before
    it wrote); the windows of each round of the mix take from every queue its share of that round.
    A null text packs its end id alone, a null source is the queue "", repeated rows are
    packed each."""
    place, = unused(docs.columns, "place")
    return packing.pack(file_order(docs, place), place_col=place)


STAGES = [("quality", keep_good), ("near_duplicates", drop_near_duplicates), ("pii", redact_personal_data),
          ("mix", mix_sources), ("pack", pack_windows)]

#: A trained model, an exact set join and tokenised packing are not SQL:
#: tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs, paths = read(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        with staging() as written:
            docs = staged(out, name)
        drop_staged(spark, paths)
        paths = written
    return STAGES[-1][1](spark, docs, sf_dir)
