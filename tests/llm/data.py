"""Shared inputs of the operator tests."""

import re

SMOKE = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
EXTRA = "id string, t string, row string, queue string, _h long, _b int, c string, spans string, n double, key string"

EDGE = [
    (1, "The quick brown fox jumps over the lazy dog near 10.0.0.1 today", "a"),
    (2, "The quick brown fox jumps over the lazy dog near 10.0.0.1 today", "a"),
    (2, "The quick brown fox jumps over the lazy dog near 10.0.0.1 today", "a"),
    (3, None, "a"), (4, "", None), (5, " \n\t ", "b"), (6, "one", "b"), (7, "one two", None),
    (None, "a row without an id but with words", "b"), (None, None, None),
    (8, LONG, "a"), (9, "é ü ñ 漢字 😀 mail me: x@y.org", "c"),
]


def edge(spark):
    """Documents with nulls, empty and long texts, repeated rows, and extra
    columns whose names clash with the operators' own."""
    rows = [(d, t, None, s, None, "x", "y", "z", "q", 1, 2, "c", "s", 0.5, "k") for d, t, s in EDGE]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}") \
        .repartition(3)


def empty(spark):
    return edge(spark).filter("1 = 0")


def documents(spark, sf=SMOKE):
    return spark.read.parquet(f"{sf}/documents.parquet")


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
