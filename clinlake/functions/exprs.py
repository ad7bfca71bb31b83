"""Column expressions shared by all operators (JVM-side, codegen friendly).

Null policy: pandas treats NaN as missing in every statistic, Spark treats it
as a value.  Every scan of a numeric column and every division goes through
``nan_to_null`` / ``safe_div`` so NaN never reaches an aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMERIC = (T.DoubleType, T.FloatType)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    c = col(c)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def nan_to_null_all(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Replace NaN with null in every floating column (or the given ones)."""
    names = list(columns) if columns is not None else [
        f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]
    if not names:
        return df
    return df.withColumns({n: nan_to_null(n) for n in names})


def safe_div(num: str | Column, den: str | Column) -> Column:
    """num / den with 0 or null denominators giving null (never NaN or an error)."""
    return F.try_divide(col(num), F.nullif(col(den), F.lit(0)))


def pearson(x: str | Column, y: str | Column) -> Column:
    """Aggregate: Pearson r over the rows that have both; null where a side is constant
    (``corr`` divides by zero there, an error under ANSI)."""
    x, y = col(x), col(y)
    sd_x, sd_y = F.stddev_pop(F.when(y.isNotNull(), x)), F.stddev_pop(F.when(x.isNotNull(), y))
    return F.try_divide(F.covar_pop(x, y), sd_x * sd_y)


def clip(c: str | Column, lo: float | None, hi: float | None) -> Column:
    """Clip like pandas: nulls stay null (Spark greatest/least skip nulls)."""
    c = col(c)
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(c.isNull(), F.lit(None)).otherwise(out)


def round_half_even(c: str | Column, scale: int = 0) -> Column:
    """Python/NumPy round (banker's rounding)."""
    return F.bround(col(c), scale)


def binarise(c: str | Column) -> Column:
    """fillna(0) -> clip 0..1 -> round half-even, as a double."""
    return F.bround(clip(F.coalesce(col(c).cast("double"), F.lit(0.0)), 0.0, 1.0), 0)


def to_double(c: str | Column) -> Column:
    """pd.to_numeric(errors='coerce'): unparsable -> null, NaN -> null."""
    return nan_to_null(F.expr(f"try_cast({c} AS DOUBLE)") if isinstance(c, str)
                       else c.try_cast("double"))


def equal_width_bin(x: str | Column, lo: str | Column | float, hi: str | Column | float,
                    n_bins: int) -> Column:
    """NumPy histogram bin index: half-open bins, the last bin closed.

    A zero-width range puts every value in bin 0.
    """
    x, lo_c, hi_c = col(x), _lit_or_col(lo), _lit_or_col(hi)
    width = (hi_c - lo_c) / F.lit(n_bins)
    raw = F.floor(F.try_divide(x - lo_c, F.nullif(width, F.lit(0.0))))
    return F.when(x.isNull(), F.lit(None)).otherwise(
        F.coalesce(F.least(F.greatest(raw, F.lit(0)), F.lit(n_bins - 1)), F.lit(0)).cast("int"))


def _lit_or_col(v) -> Column:
    if isinstance(v, (int, float)):
        return F.lit(float(v))
    return col(v)


def when_chain(cases: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """First matching case wins (ordered CASE WHEN)."""
    out = None
    for cond, val in cases:
        v = val if isinstance(val, Column) else F.lit(val)
        out = F.when(cond, v) if out is None else out.when(cond, v)
    d = default if isinstance(default, Column) else F.lit(default)
    return d if out is None else out.otherwise(d)


def count_char(c: str | Column, ch: str) -> Column:
    """Occurrences of a single character."""
    c = col(c)
    return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))


def hmac_sha256_hex(message: str | Column, key: str) -> Column:
    """HMAC-SHA256 as hex, natively: sha2((k^opad) || unhex(sha2((k^ipad) || m))).

    Built from ``sha2``/``unhex``/``concat`` on binary so it stays JVM-side.
    Keys longer than the 64-byte block are hashed first, as RFC 2104 says.
    """
    import hashlib

    kb = key.encode("utf-8")
    if len(kb) > 64:
        kb = hashlib.sha256(kb).digest()
    kb = kb.ljust(64, b"\0")
    ipad = bytes(b ^ 0x36 for b in kb).hex()
    opad = bytes(b ^ 0x5C for b in kb).hex()
    msg = col(message).cast("binary")
    inner = F.unhex(F.sha2(F.concat(F.unhex(F.lit(ipad)), msg), 256))
    return F.sha2(F.concat(F.unhex(F.lit(opad)), inner), 256)


def hash_uniform(seed: int, *keys: Column) -> Column:
    """U(0, 1) from a hash of ``keys`` and ``seed``: the same row draws the same
    value whatever its partition."""
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11)
    return (h.cast("double") + 0.5) / F.lit(2.0 ** 53)


def hash_normal(seed: int, *keys: Column) -> Column:
    """N(0, 1) from two hash uniforms (Box-Muller)."""
    radius = F.sqrt(F.lit(-2.0) * F.log(hash_uniform(2 * seed, *keys)))
    return radius * F.cos(F.lit(2.0 * math.pi) * hash_uniform(2 * seed + 1, *keys))


def dot(a: str | Column, b: str | Column) -> Column:
    """Dot product of two numeric arrays of equal length."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def l2_norm(a: str | Column) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def cosine(a: str | Column, b: str | Column) -> Column:
    return safe_div(dot(a, b), l2_norm(a) * l2_norm(b))


def normalise_header(name: str) -> str:
    """strip, lower, space/slash/hyphen -> underscore (driver-side on names only)."""
    out = name.strip().lower()
    for ch in (" ", "/", "-"):
        out = out.replace(ch, "_")
    return out
