"""Rule-table contract validation with lazy (all-failures) reporting.

A contract is a list of rules; one projection adds a ``violations`` array
(every failed rule, not just the first) and the table splits into valid and
quarantined rows without a second scan of the source.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    column: str
    kind: str  # not_null | range | in_set | regex | type
    lo: float | None = None
    hi: float | None = None
    values: tuple = field(default_factory=tuple)
    pattern: str | None = None
    dtype: str | None = None
    nullable: bool = True
    lo_open: bool = False  # strict lower bound (x > lo)

    @property
    def name(self) -> str:
        return f"{self.column}:{self.kind}"


def rule_violation(rule: Rule) -> Column:
    """True when the row violates ``rule`` (null where the rule does not apply)."""
    c = F.col(rule.column)
    null_bad = F.lit(not rule.nullable)
    if rule.kind == "not_null":
        return c.isNull()
    if rule.kind == "range":
        x = c.try_cast("double")
        bad = F.lit(False)
        if rule.lo is not None:
            bad = bad | ((x <= rule.lo) if rule.lo_open else (x < rule.lo))
        if rule.hi is not None:
            bad = bad | (x > rule.hi)
        return F.when(c.isNull(), null_bad).otherwise(bad | (x.isNull() & c.isNotNull()) | F.isnan(x))
    if rule.kind == "in_set":
        return F.when(c.isNull(), null_bad).otherwise(~c.cast("string").isin(list(rule.values)))
    if rule.kind == "regex":
        return F.when(c.isNull(), null_bad).otherwise(~c.cast("string").rlike(rule.pattern))
    if rule.kind == "type":
        return F.when(c.isNull(), null_bad).otherwise(c.try_cast(rule.dtype).isNull())
    raise ValueError(rule.kind)


def validate(df: DataFrame, rules: Sequence[Rule], out: str = "violations") -> DataFrame:
    """Add ``violations`` (array of failed rule names) and ``is_valid``."""
    arr = F.array_compact(F.array(*[F.when(rule_violation(r), F.lit(r.name)) for r in rules]))
    return df.withColumn(out, arr).withColumn("is_valid", F.size(F.col(out)) == 0)


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    return validated.filter("is_valid"), validated.filter(~F.col("is_valid"))


def violation_summary(validated: DataFrame, out: str = "violations") -> DataFrame:
    """Failure count per rule (one grouped aggregate over the exploded arrays)."""
    return (validated.select(F.explode(out).alias("rule")).groupBy("rule")
            .agg(F.count(F.lit(1)).alias("failures")))


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    """Schema gate on names only (driver side, no data read)."""
    return [c for c in required if c not in df.columns]


def schema_gate(df: DataFrame, required: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """Connector gate: one-row table with row count, missing columns and
    per-rule violation counts from one aggregate pass."""
    missing = missing_columns(df, required)
    present = [r for r in rules if r.column in df.columns]
    aggs = [F.count(F.lit(1)).alias("n_rows")] + [
        F.count_if(F.coalesce(rule_violation(r), F.lit(False))).alias(r.name) for r in present]
    row = df.agg(*aggs)
    return row.withColumn("missing_columns", F.array(*[F.lit(m) for m in missing]).cast("array<string>"))
