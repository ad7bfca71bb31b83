"""Fill-in-the-middle transformation with counted regular expressions.

A text is a sequence of units: a run of ASCII letters, or any other single code
point.  ``regexp_count`` gives their number n; two hashed draws in 0..n, in order,
are the cuts a and b.  A pattern made for the row, ``(unit{a}+)(unit{b-a}+)(rest)``,
then captures prefix, middle and suffix in one match, and the replacement string
of the same call puts them in the order of the row's form.

The counted groups are possessive: Java runs those in a loop, so a count of a
million needs no more stack than a count of one, and nothing is tried twice.
Everything is native: each row is rewritten where it was read, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinlake.llm.common import read

#: One unit: a run of ASCII letters, or one other code point.
UNIT = "[A-Za-z]+|[^A-Za-z]"
COUNTED = "(?:[A-Za-z]++|[^A-Za-z])"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: What the match is replaced by, and which parts of an output (split at the
#: marks; the first part is empty) are the prefix, the middle and the suffix.
FORMS = {"psm": (f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2", (1, 3, 2)), "spm": (f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2", (2, 3, 1))}


def draws(seed: int, id_col: Column) -> list[Column]:
    """Four whole numbers under 2^32 from the SHA-256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1,
              plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """``row`` (the input row as a struct), n (units), form (plain, psm or spm) and
    output: the text as it is, or prefix, suffix and middle behind their marks.

    A text stays plain for ``plain_percent`` of the ids, when it is empty, and when
    it holds a mark itself.  Of the others ``spm_percent`` put the suffix first.
    Nulls: a null text is the empty text, a null id draws as the empty id.  Whole
    texts of any length are cut; the units of one text are counted through an array
    of them, so a task needs memory in proportion to its longest text.  Equal rows
    give equal rows (nothing depends on the order or the layout), an empty table
    an empty one; other columns travel inside ``row``, whatever their names."""
    text = F.coalesce(F.col(f"row.{text_col}"), F.lit(""))
    h1, h2, h3, h4 = draws(seed, F.col(f"row.{id_col}"))
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (text == "") | marked | (h3 % 100 >= 100 - plain_percent)
    rows = docs.select(F.struct("*").alias("row"))
    cut = rows.select("row", F.regexp_count(text, F.lit(UNIT)).cast("long").alias("n"),
                      F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm").alias("form"))
    first, second = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    a, b = F.least(first, second), F.greatest(first, second)
    pattern = F.format_string(f"(?s)\\A({COUNTED}{{%d}}+)({COUNTED}{{%d}}+)(.*)\\z", a, b - a)
    order = F.when(F.col("form") == "psm", F.lit(FORMS["psm"][0])).otherwise(F.lit(FORMS["spm"][0]))
    return cut.select("row", "n", "form", F.when(F.col("form") == "plain", text).otherwise(
        F.regexp_replace(text, pattern, order)).alias("output"))


def parts(output: Column, form: Column) -> Column:
    """Prefix, middle and suffix of an output as an array of strings; null if plain.

    No mark can begin inside a part: a marked text stays plain, and a piece of a
    mark at the end of a part never completes one with the mark that follows it."""
    split = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "psm", F.array(*[split[i] for i in FORMS["psm"][1]])) \
            .when(form == "spm", F.array(*[split[i] for i in FORMS["spm"][1]]))


def restore(output: Column, form: Column) -> Column:
    """The text from which ``transform`` made an output of this form."""
    return F.when(form == "plain", output).otherwise(F.array_join(parts(output, form), ""))


def op12_regex_fim(spark, sf_dir):
    out = transform(read(spark, sf_dir, "documents", "doc_id", "text"))
    cut = out.select("row.doc_id", "n", "form", "output", parts(F.col("output"), F.col("form")).alias("pieces"))
    text = F.when(F.col("form") == "plain", F.col("output")).otherwise(F.array_join("pieces", ""))
    return cut.select("doc_id", "n", "form", F.char_length(F.col("pieces")[0]).cast("long").alias("prefix_chars"),
                      F.char_length(F.col("pieces")[1]).cast("long").alias("middle_chars"),
                      F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


QUERIES = {"op12_regex_fim": op12_regex_fim}

ORACLE = {"op12_regex_fim": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
  sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
w AS (SELECT *, len(u) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS r FROM d),
f AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 90 THEN 'plain'
       WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM w),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid,
  array_to_string(u[b + 1:], '') AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                   ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""}
