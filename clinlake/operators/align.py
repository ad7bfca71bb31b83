"""Schema alignment, heterogeneous union and de-duplication."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinlake.functions.exprs import nan_to_null, normalise_header


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename map to canonical names; absent source columns are ignored."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def normalise_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[normalise_header(c) for c in df.columns])


def first_available(df: DataFrame, candidates: Sequence[str], default=None) -> Column:
    """First candidate column that exists (driver decides on names), else default.

    When several exist the value is ``coalesce`` over them in candidate order.
    """
    present = [c for c in candidates if c in df.columns]
    if not present:
        return F.lit(default)
    return F.coalesce(*[F.col(c) for c in present], *( [F.lit(default)] if default is not None else []))


def align_to_schema(df: DataFrame, schema: T.StructType, defaults: Mapping[str, object] | None = None,
                    keep_extra: bool = False) -> DataFrame:
    """Project onto ``schema``: cast present columns (bad values -> null), add
    missing ones as their default (null when none is given)."""
    defaults = dict(defaults or {})
    out = []
    for f in schema.fields:
        if f.name in df.columns:
            c = F.col(f.name).try_cast(f.dataType)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
                c = nan_to_null(c)
            if f.name in defaults:
                c = F.coalesce(c, F.lit(defaults[f.name]).cast(f.dataType))
        else:
            c = F.lit(defaults.get(f.name)).cast(f.dataType)
        out.append(c.alias(f.name))
    if keep_extra:
        names = {f.name for f in schema.fields}
        out += [F.col(c) for c in df.columns if c not in names]
    return df.select(*out)


def union_aligned(frames: Sequence[DataFrame], schema: T.StructType,
                  defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Union by name of heterogeneous sources, all aligned to ``schema``."""
    aligned = [align_to_schema(f, schema, defaults) for f in frames]
    out = aligned[0]
    for f in aligned[1:]:
        out = out.unionByName(f)
    return out


def left_join_suffix(left: DataFrame, right: DataFrame, keys: Sequence[str], suffix: str) -> DataFrame:
    """Left join on several keys; right-side columns that clash with left ones
    get ``suffix`` (pandas ``merge(suffixes=("", suffix))``)."""
    ren = {c: f"{c}{suffix}" for c in right.columns if c in left.columns and c not in keys}
    return left.join(right.withColumnsRenamed(ren), on=list(keys), how="left")


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def non_null_count(columns: Sequence[str]) -> Column:
    return sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))


def conditional_dedupe(df: DataFrame, feature_cols: Sequence[str], key_cols: Sequence[str],
                       min_non_null: int = 10) -> DataFrame:
    """Drop exact duplicates on ``key_cols`` only among rich rows
    (>= ``min_non_null`` non-null features); sparse rows are all kept."""
    dens = non_null_count(feature_cols)
    rich = df.filter(dens >= min_non_null).dropDuplicates(list(key_cols))
    sparse = df.filter(dens < min_non_null)
    return rich.unionByName(sparse)


def keep_first(df: DataFrame, key_cols: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """Deterministic ``drop_duplicates(keep='first')``: the row with the
    smallest order per key, via ``min_by`` (an aggregate, no sort of the key)."""
    others = [c for c in df.columns if c not in key_cols]
    order = F.struct(*[F.col(c) for c in order_cols])
    picked = df.groupBy(*key_cols).agg(F.min_by(F.struct(*others), order).alias("_r"))
    return picked.select(*key_cols, *[F.col(f"_r.{c}").alias(c) for c in others])


def latest_per_key(df: DataFrame, key_cols: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """DISTINCT ON (key) ... ORDER BY order DESC: the row with the largest order."""
    others = [c for c in df.columns if c not in key_cols]
    order = F.struct(*[F.col(c) for c in order_cols])
    picked = df.groupBy(*key_cols).agg(F.max_by(F.struct(*others), order).alias("_r"))
    return picked.select(*key_cols, *[F.col(f"_r.{c}").alias(c) for c in others])


def duplicate_keys(df: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """Uniqueness-constraint check: keys present more than once, with counts."""
    return df.groupBy(*key_cols).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def pad_array(c: str | Column, length: int, fill: float = 0.0) -> Column:
    """Column-wise feature padding: array cut or padded with ``fill`` to ``length``."""
    a = F.col(c) if isinstance(c, str) else c
    pad = F.array_repeat(F.lit(fill), F.greatest(F.lit(length) - F.size(a), F.lit(0)))
    return F.slice(F.concat(a, pad), 1, length)


def field_id_columns(df: DataFrame, mapping: Mapping[str, str], instance: int = 0) -> DataFrame:
    """Coded biobank headers ``f.<field>.<instance>.<array>`` -> named columns.

    Only the given instance is used; for each mapped field id the first array
    column present wins (decided on column names, driver side).  Columns are
    kept as they are typed (codes such as ICD-10 stay strings)."""
    picked = {}
    for c in df.columns:
        parts = c.split(".")
        if len(parts) == 4 and parts[0] == "f" and parts[2] == str(instance) and parts[1] in mapping:
            name = mapping[parts[1]]
            if name not in picked or int(parts[3]) < int(picked[name].split(".")[3]):
                picked[name] = c
    keep = [c for c in df.columns if not c.startswith("f.")]
    return df.select(*keep, *[F.col(f"`{src}`").alias(dst) for dst, src in picked.items()])
