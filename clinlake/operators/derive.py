"""Derived clinical features and interaction terms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinlake.functions.exprs import clip, col, nan_to_null, safe_div


def _d(c: str) -> Column:
    return nan_to_null(F.col(c).cast("double"))


def interaction_features(df: DataFrame, spec: Mapping[str, Sequence]) -> DataFrame:
    """Products ``a_x_b``, ratios ``a_per_b`` = a/(|b|+1e-6), squares ``a_sq``.

    Each term is added only when all its inputs exist in ``df``.
    """
    have = set(df.columns)
    new: dict[str, Column] = {}
    for a, b in spec.get("products", []):
        if a in have and b in have:
            new[f"{a}_x_{b}"] = _d(a) * _d(b)
    for a, b in spec.get("ratios", []):
        if a in have and b in have:
            new[f"{a}_per_{b}"] = _d(a) / (F.abs(_d(b)) + F.lit(1e-6))
    for a in spec.get("squares", []):
        if a in have:
            new[f"{a}_sq"] = _d(a) * _d(a)
    return df.withColumns(new) if new else df


def sum_present(columns: Sequence[str]) -> Column:
    """Sum of ``coalesce(c, 0)`` over the columns that are given."""
    return sum((F.coalesce(_d(c), F.lit(0.0)) for c in columns), F.lit(0.0))


def clinical_derived(df: DataFrame) -> DataFrame:
    """The five derived clinical features, each only if its inputs exist."""
    have = set(df.columns)
    new = {}
    vasc = [c for c in ("Hypertension", "Diabetes", "CardiovascularDisease", "Smoking") if c in have]
    if vasc:
        new["VascularRiskComposite"] = sum_present(vasc)
    if {"EducationLevel", "MMSE"} <= have:
        new["CognitiveReserve"] = _d("EducationLevel") + _d("MMSE") / F.lit(30.0)
    symp = [c for c in ("MemoryComplaints", "BehavioralProblems", "Confusion", "Disorientation",
                        "PersonalityChanges", "DifficultyCompletingTasks", "Forgetfulness") if c in have]
    if symp:
        new["SymptomBurden"] = sum_present(symp)
    com = [c for c in ("Hypertension", "Diabetes", "CardiovascularDisease", "Depression", "HeadInjury")
           if c in have]
    if com:
        new["ComorbidityCount"] = sum_present(com)
    if {"CSF_Abeta42", "CSF_pTau"} <= have:
        new["AbetaTauRatio"] = safe_div(_d("CSF_Abeta42"), _d("CSF_pTau"))
    return df.withColumns(new) if new else df


def bmi_from_cm(weight_kg: str | Column, height_cm: str | Column) -> Column:
    """BMI = kg / m^2, clipped to 10..60."""
    m = col(height_cm).cast("double") / F.lit(100.0)
    return clip(safe_div(col(weight_kg).cast("double"), m * m), 10.0, 60.0)


def threshold_flag(c: str | Column, op: str, value: float) -> Column:
    """Integer 0/1 flag for ``c <op> value``; null stays null."""
    x = col(c).cast("double")
    cond = {">": x > value, ">=": x >= value, "<": x < value, "<=": x <= value, "==": x == value}[op]
    return cond.cast("int")
