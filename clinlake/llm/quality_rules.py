"""Quality rules by cross-document line frequency (native).

Every line is normalised (white space collapsed, lower case) and hashed.  For
each host the number of *distinct documents* (equal texts count once) that hold
a line is counted; a line held by more than the host's limit is boilerplate and
is removed.  A document that loses more than ``1 - min_left`` of its words that
way is depleted and rejected, as are documents that fail the base rules.

Only DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinlake.llm.common import WS, staged, words
from clinlake.plans.broadcast import sized_broadcast

#: Characters that count as symbols (fixed by the contract of the query).
SYMBOLS = r"[#*$%&|<>]"


def repeated_word_count(df: DataFrame, words_col: str, out: str) -> DataFrame:
    """Number of words covered by 3-word windows that occur at least twice.

    Window hashes are sorted with their positions, so a text of n words costs
    n log n; texts whose window hashes are all distinct stop after the first
    step.  Fewer than four words: 0."""
    n = F.size(words_col)
    grams = F.when(n >= 4, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(
        F.get(F.col(words_col), i), F.get(F.col(words_col), i + 1), F.get(F.col(words_col), i + 2))))
    df = df.withColumn("_g", grams)
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.sort_array(
        F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    near = lambda x, j: x["g"] == F.get(F.col("_s"), j)["g"]
    hit = F.transform("_s", lambda x, j: F.when(
        F.coalesce(near(x, j + 1), F.lit(False)) | ((j > 0) & near(x, F.greatest(j - 1, F.lit(0)))), x["i"]))
    df = df.withColumn("_p", F.sort_array(F.filter(hit, lambda i: i.isNotNull())))
    covered = F.transform("_p", lambda i, j: F.least(F.lit(3), F.get(F.col("_p"), j + 1) - i))
    df = df.withColumn(out, F.coalesce(F.aggregate(covered, F.lit(0).cast("long"),
                                                   lambda a, x: a + x), F.lit(0).cast("long")))
    return df.drop("_g", "_s", "_p")


def _lines(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, WS, " ")))


def frequent_lines(docs: DataFrame, text_col: str, host_col: str, max_share: float, max_docs: int) -> DataFrame:
    """(host, line): hashes of the lines held by more than
    ``max(max_docs, max_share * documents of the host)`` distinct documents."""
    src = docs.select(F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
                      F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    src = src.select("host", F.xxhash64("t").alias("th"), F.array_distinct(
        F.transform(_lines(F.col("t")), lambda x: F.xxhash64(_normal(x)))).alias("ls"))
    held = src.select("host", "th", F.explode("ls").alias("line")).distinct()
    per_line = held.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    per_host = (src.select("host", "th").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
                .withColumnRenamed("host", "h"))
    limit = F.greatest(F.lit(float(max_docs)), F.col("docs") * F.lit(max_share))
    return (per_line.filter(F.col("n") > max_docs).join(per_host, F.col("host") == F.col("h"))
            .filter(F.col("n") > limit).select("host", "line"))


def line_frequency_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                         max_share: float = 0.02, max_docs: int = 20, min_left: float = 0.5,
                         min_words: int = 50) -> DataFrame:
    """One row per document: base counts, ``removed_words`` and the verdict.

    Nulls: a null text is empty, a null host is the host "".  A null id stays
    null.  Empty texts fail the base rules.  Repeated rows give repeated equal
    results.  An empty table gives an empty table.  Other columns are ignored,
    whatever their names."""
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
                      F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    frequent = sized_broadcast(staged(frequent_lines(docs, text_col, host_col, max_share, max_docs), "lines"))
    lines = src.select("id", "host", F.xxhash64("t").alias("th"), F.posexplode(_lines(F.col("t"))).alias("pos", "x"))
    lines = lines.select("id", "host", "th", "pos", F.xxhash64(_normal(F.col("x"))).alias("line"), "x")
    hits = lines.join(frequent.withColumnRenamed("host", "fh").withColumnRenamed("line", "fl"),
                      (F.col("host") == F.col("fh")) & (F.col("line") == F.col("fl")))
    # repeated rows of one document hold the same lines at the same positions: they count once
    removed = (hits.select("id", "host", "th", "pos", F.size(words(F.col("x"))).alias("w")).distinct()
               .groupBy("id", "host", "th").agg(F.sum("w").alias("removed"))
               .select(F.col("id").alias("ri"), F.col("host").alias("rh"), F.col("th").alias("rt"), "removed"))
    stats = src.select("id", "host", F.xxhash64("t").alias("th"), "t", words(F.col("t")).alias("w"),
                       _lines(F.col("t")).alias("ls"))
    stats = repeated_word_count(stats, "w", "n_repeat_words")
    stats = stats.select(
        "id", "host", "th", F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.size(F.split("t", SYMBOLS)) - 1).cast("long").alias("n_symbols"),
        (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"), "n_repeat_words")
    out = stats.join(removed, F.col("id").eqNullSafe(F.col("ri")) & (F.col("host") == F.col("rh"))
                     & (F.col("th") == F.col("rt")), "left")
    gone = F.coalesce(F.col("removed"), F.lit(0))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("n_words") - gone >= F.lit(min_left) * F.col("n_words"))).alias("kept"),
        gone.cast("long").alias("removed_words"))


def op10_line_rules(spark, sf_dir):
    from clinlake.llm.common import read

    return line_frequency_rules(read(spark, sf_dir, "documents", "doc_id", "text", "source"))


QUERIES = {"op10_line_rules": op10_line_rules}

ORACLE = {"op10_line_rules": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
grams AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c
          FROM (SELECT doc_id, i, ws[i:i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d))),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
            FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM grams WHERE c >= 2) GROUP BY doc_id),
lines AS (SELECT doc_id, host, t, x, lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))) AS line
          FROM (SELECT doc_id, host, t, unnest(string_split(t, chr(10))) AS x FROM d)
          WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
doubles AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n_dup_lines FROM lines GROUP BY doc_id),
hosts AS (SELECT host, count(DISTINCT t) AS docs FROM d GROUP BY host),
frequent AS (SELECT l.host, l.line FROM lines l JOIN hosts h ON l.host = h.host GROUP BY l.host, l.line, h.docs
             HAVING count(DISTINCT l.t) > greatest(20.0, 0.02 * h.docs)),
gone AS (SELECT l.doc_id, sum(len(regexp_extract_all(l.x, '[^\x20\x09-\x0D]+'))) AS removed
         FROM lines l JOIN frequent f ON l.host = f.host AND l.line = f.line GROUP BY l.doc_id),
s AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(removed, 0) AS BIGINT) AS removed_words
      FROM d LEFT JOIN repeats r ON r.doc_id = d.doc_id LEFT JOIN doubles u ON u.doc_id = d.doc_id
      LEFT JOIN gone g ON g.doc_id = d.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words - removed_words >= 0.5 * n_words AS kept, removed_words FROM f
"""}
