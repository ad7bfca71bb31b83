"""Broadcast behind a checked size bound, with a shuffle join beyond it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A dimension side is broadcast only when it has at most this many rows.
DEFAULT_MAX_ROWS = 1_000_000


def is_small(df: DataFrame, max_rows: int = DEFAULT_MAX_ROWS) -> bool:
    """True when ``df`` has at most ``max_rows`` rows.

    ``limit(max_rows + 1).count()`` stops reading once the bound is passed, so
    the check costs at most ``max_rows`` rows however large ``df`` is.
    """
    return df.limit(max_rows + 1).count() <= max_rows


def sized_broadcast(df: DataFrame, max_rows: int = DEFAULT_MAX_ROWS) -> DataFrame:
    """``broadcast(df)`` if its row count is proven under the bound, else ``df``.

    Without the hint the join is planned by Catalyst/AQE (sort-merge or
    shuffled hash, with AQE's own runtime broadcast conversion).
    """
    return F.broadcast(df) if is_small(df, max_rows) else df


def runtime_sized(df: DataFrame) -> DataFrame:
    """A join side that is an aggregate (one row per group of a key).

    No hint: with AQE on, Spark materialises this side first and turns the
    join into a broadcast join only when its measured size is under
    ``spark.sql.adaptive.autoBroadcastJoinThreshold``; beyond it the join stays
    a shuffle join.  That is the size check, done on the real data and
    without computing the aggregate twice (``sized_broadcast`` would run it
    once for the count and again for the join).
    """
    return df


def bounded_broadcast(df: DataFrame) -> DataFrame:
    """Broadcast a side whose size is bounded by construction.

    Only for frames built from a fixed rule table, a fixed list of levels or
    an aggregate over a fixed set of groups (for example one row per feature
    or per bin).  Data-dependent sides go through ``sized_broadcast`` (a
    cheap side whose rows can be counted) or ``runtime_sized`` (aggregates).
    """
    return F.broadcast(df)
