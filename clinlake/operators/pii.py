"""PII detection, scrubbing and de-identification.

Regexes run JVM-side (``rlike``/``regexp_replace``/``regexp_extract``); the
``(?U)`` flag gives Unicode word boundaries as in Python 3 ``re``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# PII patterns (name -> regex), in scrub order.
PII_PATTERNS: dict[str, str] = {
    "mrn": r"\b\d{7,10}\b",
    "ssn": r"\b\d{3}[-]?\d{2}[-]?\d{4}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "name_prefix": r"\b(?:Dr|Mr|Mrs|Ms|Prof|Patient)\.\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b",
    "date_of_birth": r"(?i)\b(?:DOB|Date of Birth|Born)[:\s]*\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}\b",
}

# De-identification rules for notes (case-insensitive) and their tags.
DEID_PATTERNS: dict[str, tuple[str, str]] = {
    "mrn": (r"(?i)\b(?:MRN|MEDICAL\s*RECORD\s*NUMBER)\s*[:#-]?\s*\d{4,12}\b", "[MRN_REDACTED]"),
    "dob": (r"(?i)\b(?:DOB|Date\s*of\s*Birth)\s*[:#-]?\s*\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", "[DOB_REDACTED]"),
}

# Neurology lexicon counted by term frequency.
NEURO_TERMS = ["hippocampus", "amygdala", "entorhinal", "tau", "amyloid", "alzheimers", "dementia",
               "mmse", "moca", "nfl", "ptau181", "connectome", "parcellation", "atrophy"]


def java_pattern(p: str) -> str:
    """Prefix (?U) so \\b and \\w are Unicode-aware (Python 3 semantics)."""
    return "(?U)" + p


def pii_hits(df: DataFrame, id_col: str, text_cols: Sequence[str],
             patterns: Mapping[str, str] = PII_PATTERNS, preview_len: int = 50) -> DataFrame:
    """(column, row id, pattern, preview) for every cell matching a pattern.

    Text columns are stacked with ``unpivot`` (narrow), each pattern is one
    ``rlike``; hits are exploded from an array of matched pattern names.
    """
    from clinlake.plans.parallel import spread
    long = spread(df.select(id_col, *text_cols), [id_col]).unpivot([id_col], list(text_cols), "column", "text")
    long = long.dropna(subset=["text"])
    matched = F.array_compact(F.array(*[F.when(F.col("text").rlike(java_pattern(p)), F.lit(n))
                                        for n, p in patterns.items()]))
    preview = F.when(F.length("text") > preview_len,
                     F.concat(F.substring("text", 1, preview_len), F.lit("..."))).otherwise(F.col("text"))
    return (long.select("column", id_col, F.explode(matched).alias("pattern"), preview.alias("preview")))


def scrub(c: str | Column, patterns: Mapping[str, str] = PII_PATTERNS) -> Column:
    """Ordered replacement with ``[REDACTED_<NAME>]``; null stays null."""
    out = F.col(c) if isinstance(c, str) else c
    for name, p in patterns.items():
        out = F.regexp_replace(out, java_pattern(p), f"[REDACTED_{name.upper()}]")
    return out


def deidentify(c: str | Column, rules: Mapping[str, tuple[str, str]] = DEID_PATTERNS) -> Column:
    out = F.col(c) if isinstance(c, str) else c
    for _, (p, tag) in rules.items():
        out = F.regexp_replace(out, java_pattern(p), tag)
    return out


def any_pii(c: str | Column, patterns: Mapping[str, str] = PII_PATTERNS) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    out = F.lit(False)
    for p in patterns.values():
        out = out | F.coalesce(col.rlike(java_pattern(p)), F.lit(False))
    return out


def pattern_row_counts(df: DataFrame, text_col: str, patterns: Mapping[str, str]) -> DataFrame:
    """Rows matching each pattern, one aggregate pass."""
    return df.agg(*[F.count_if(F.coalesce(F.col(text_col).rlike(java_pattern(p)), F.lit(False))).alias(n)
                    for n, p in patterns.items()])
