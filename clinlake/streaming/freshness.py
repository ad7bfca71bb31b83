"""Source freshness: sources that send nothing for seven days are pending.

The batch rule looks at each source's last event.  The stream keeps, per source, the
session that its last events form (gaps within the limit); when the watermark passes
the session's end, the source was silent from its last event on, and one row says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinlake.plans.broadcast import bounded_broadcast

MAX_SILENCE_DAYS = 7


def source_status(events: DataFrame, source: str, ts: str, now: Column | None = None,
                  days: int = MAX_SILENCE_DAYS) -> DataFrame:
    """(source, last_seen, status): pending when the last event lies more than ``days``
    before ``now`` (default: the last event of all), else active.  Sources whose events
    have no time are pending, with a null ``last_seen``."""
    last = events.groupBy(source).agg(F.max(F.col(ts).cast("timestamp")).alias("last_seen"))
    if now is None:
        last = last.crossJoin(bounded_broadcast(last.agg(F.max("last_seen").alias("_now"))))
    else:
        last = last.withColumn("_now", now)
    fresh = F.col("last_seen") >= F.col("_now") - F.expr(f"INTERVAL {days} DAYS")
    return last.select(source, "last_seen", F.when(fresh, "active").otherwise("pending").alias("status"))


def silences(events: DataFrame, source: str, source_type: str, ts: str, watermark: str,
             days: int = MAX_SILENCE_DAYS) -> DataFrame:
    """(source, silent_since): event times that no event of the source follows within
    ``days``, emitted once the watermark lies more than ``days`` behind them (append mode).

    A session of a source ends where nothing follows within the limit; its last event is
    the gap before its end.  A session is settled when the watermark passes its end, as no
    event within the watermark's delay can reach back into it.  State per source: the open
    sessions (a start and an end each), kept and merged by Spark's session windows."""
    gap = F.expr(f"INTERVAL {days} DAYS")  # sessions that touch are merged: an event exactly on the limit is no silence
    prepared = events.filter(F.col(ts).isNotNull()).select(F.col(source).cast(source_type).alias(source), ts)
    sessions = prepared.withWatermark(ts, watermark).groupBy(
        source, F.session_window(F.col(ts), f"{days} days").alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    return sessions.select(source, (F.col("_s.end") - gap).alias("silent_since"))
