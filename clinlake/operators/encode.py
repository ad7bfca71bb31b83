"""Categorical encodings, classifications and bands."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinlake.functions.exprs import clip, col, count_char, when_chain
from clinlake.plans.broadcast import bounded_broadcast, runtime_sized
from clinlake.plans.prefix import dense_codes


def normalised_label(c: str | Column) -> Column:
    """lower(trim(x)); a missing value becomes the text 'nan' (pandas factorize of astype(str))."""
    return F.coalesce(F.lower(F.trim(col(c).cast("string"))), F.lit("nan"))


def label_encode_sorted(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """``pd.factorize(sort=True)`` over normalised strings.

    The dictionary (one row per distinct value) is built with the skew-safe
    rank plan and joined back; it is broadcast only when proven small.
    """
    out = out or f"{column}_code"
    norm = df.withColumn("_lbl", normalised_label(column))
    codes = dense_codes(norm, "_lbl", out)
    return norm.join(runtime_sized(codes), on="_lbl", how="left").drop("_lbl")


def ordered_substring_class(c: str | Column, aliases: Sequence[tuple[str, str]], fallback: str) -> Column:
    """First alias (in list order) contained in the lower-cased text wins."""
    s = F.lower(col(c).cast("string"))
    return when_chain([(s.contains(k), v) for k, v in aliases], fallback)


def prefix_dimension(spark: SparkSession, mapping: Mapping[str, str], key: str = "prefix",
                     value: str = "mapped") -> DataFrame:
    return spark.createDataFrame(sorted(mapping.items()), f"{key} string, {value} string")


def code_prefix_map(df: DataFrame, code_col: str, mapping: Mapping[str, str], prefix_len: int,
                    out: str = "mapped", default: str | None = None) -> DataFrame:
    """Map ``substring(code, 1, prefix_len)`` through a fixed prefix table
    (bounded by the rule list, so broadcast), left join + default."""
    spark = df.sparkSession
    dim = prefix_dimension(spark, mapping, "_prefix", "_mapped")
    keyed = df.withColumn("_prefix", F.upper(F.substring(F.col(code_col), 1, prefix_len)))
    j = keyed.join(bounded_broadcast(dim), on="_prefix", how="left")
    return j.withColumn(out, F.coalesce(F.col("_mapped"), F.lit(default))).drop("_prefix", "_mapped")


def prefix_set_predicate(columns: Sequence[str], prefixes: Sequence[str], prefix_len: int = 3) -> Column:
    """Any of ``columns`` starts with one of ``prefixes`` (ICD-style)."""
    preds = [F.upper(F.substring(F.col(c), 1, prefix_len)).isin(list(prefixes)) for c in columns]
    out = preds[0]
    for p in preds[1:]:
        out = out | p
    return F.coalesce(out, F.lit(False))


def code_map(c: str | Column, mapping: Mapping[str, object], default: object) -> Column:
    """Categorical code map with a default; multi-valued 'a&b' takes the first."""
    first = F.split(col(c).cast("string"), "&").getItem(0)
    m = F.create_map(*[x for kv in mapping.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.coalesce(F.try_element_at(m, first), F.lit(default))


def apoe_e4_dosage(c: str | Column) -> Column:
    """Count of '4' after removing 'e' (e.g. 'e3/e4' -> 1); null stays null."""
    s = F.replace(F.lower(col(c).cast("string")), F.lit("e"), F.lit(""))
    return count_char(s, "4")


# Risk-band and confidence-band cut points.
RISK_BANDS = [(0.8, "Critical"), (0.65, "High"), (0.4, "Moderate")]
RISK_FALLBACK = "Low"
CONFIDENCE_BANDS = [(0.3, "High"), (0.15, "Medium")]
CONFIDENCE_FALLBACK = "Low"


def risk_band(p: str | Column) -> Column:
    p = col(p)
    return when_chain([(p >= t, lab) for t, lab in RISK_BANDS], RISK_FALLBACK)


def confidence_band(p: str | Column) -> Column:
    d = F.abs(col(p) - F.lit(0.5))
    return when_chain([(d >= t, lab) for t, lab in CONFIDENCE_BANDS], CONFIDENCE_FALLBACK)


def visit_month(visit_code: str | Column, mapping: Mapping[str, int]) -> Column:
    """Visit code -> month via a fixed map; unknown -> 0."""
    m = F.create_map(*[x for kv in mapping.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.coalesce(F.try_element_at(m, F.upper(col(visit_code))), F.lit(0))


def cdr_expansion(cdr: str | Column) -> dict[str, Column]:
    """CDR rule expansion: functional/ADL scores and threshold flags (as doubles)."""
    c = col(cdr).cast("double")
    # CDR thresholds per derived flag.
    flags = {
        "MemoryComplaints": c > 0,
        "BehavioralProblems": c >= 1,
        "Confusion": c >= 1,
        "Disorientation": c >= 1,
        "PersonalityChanges": c >= 0.5,
        "DifficultyCompletingTasks": c >= 0.5,
        "Forgetfulness": c > 0,
    }
    out = {
        "FunctionalAssessment": clip(F.lit(10.0) - c * F.lit(3.0), 0.0, 10.0),
        "ADL": clip(F.lit(10.0) - c * F.lit(2.5), 0.0, 10.0),
    }
    out.update({k: v.cast("double") for k, v in flags.items()})
    return out
