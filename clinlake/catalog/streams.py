"""Structured Streaming queries over the events table as a landing folder.

Each query drains the events (landed as several files out of time order, one
per batch, trigger availableNow) through the validated foreachBatch sink into a fresh folder under the session's shared
checkpoint directory and returns the sink read back; the result must equal
the batch operator on the same rows.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from clinlake.catalog.panel import _TRAILING_SQL, _WEEKLY_SQL, METRIC_OF, TRAILING_WINDOW_US, _daily_sql
from clinlake.streaming import events as sev
from clinlake.streaming import freshness, sinks, windows


#: Slices of arrival time (a batch each), how late events arrive, and rows of a landing file.
SLICES, LATE_S, FILE_ROWS = 8, 1_800, 2_000_000


def _event_stream(spark, sf, repeats=False):
    """The events as a landing folder, read one slice of arrival time per batch.

    Events arrive up to half an hour late, so slices overlap in event time and
    none is sorted; with ``repeats`` every tenth event arrives twice.  The arrivals are
    scanned once and cut into slices; every slice then lands, in order, as the same number
    of files, as many as its rows need, which are one batch."""
    ev = spark.read.parquet(os.path.join(sf, "events.parquet"))
    late = lambda salt: F.pmod(F.xxhash64(F.lit(salt), "event_id"), F.lit(LATE_S))
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    arrivals = ev.withColumn("_at", at + late("first"))
    if repeats:
        arrivals = arrivals.union(ev.filter(F.xxhash64("event_id") % 10 == 0).withColumn("_at", at + late("again")))
    lo, hi, rows = arrivals.agg(F.min("_at"), F.max("_at"), F.count(F.lit(1))).first()
    part = F.floor((F.col("_at") - F.lit(lo)) * SLICES / F.lit((hi or 0) - (lo or 0) + 1)).cast("int")
    cut, path = sinks.scratch_path(spark, "arrivals"), sinks.scratch_path(spark, "landing")
    arrivals.withColumn("_slice", part).drop("_at").write.partitionBy("_slice").parquet(cut)
    files = max(1, -(-rows // (SLICES * FILE_ROWS)))
    for i in range(SLICES):  # written in the order of arrival; an empty slice lands as empty files
        mine = spark.read.schema(ev.schema).parquet(f"{cut}/_slice={i}") if i in _slices(spark, cut) else ev.limit(0)
        mine.repartition(files, "event_id").write.mode("append").parquet(path)
    s = sev.file_stream(spark, path, ev.schema, "parquet", max_files_per_trigger=files)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def _slices(spark, cut):
    return {r[0] for r in spark.read.parquet(cut).select("_slice").distinct().collect()}  # one row a slice


def stream_daily_summary(spark, sf):
    ev = _event_stream(spark, sf)
    metrics = [(et, METRIC_OF[et]) for et in ("view", "click", "purchase")]
    agg = windows.daily_summary(ev, ["user_id"], "ts", "value", "event_type", metrics, watermark="1 day")
    path = sinks.scratch_path(spark, "daily")
    sinks.run_available_now(agg, path, output_mode="update")
    out = sinks.latest_per_key(sinks.read_sink(spark, path).drop("schema_version", "updated_at"), ["user_id", "date"])
    cols = [c for c in out.columns if c.startswith(("avg_", "std_"))]
    return out.select("user_id", F.col("date").cast("timestamp_ntz").alias("date"),
                      *[F.round(c, 6).alias(c) for c in cols])


def stream_trailing_window(spark, sf):
    ev = _event_stream(spark, sf).select("user_id", "event_type", "ts", "value")
    st = windows.trailing_window_stateful(ev, ["user_id", "event_type"], ["long", "string"], "ts", "value",
                                          TRAILING_WINDOW_US, watermark="1 day")
    path = sinks.scratch_path(spark, "trailing")
    sinks.run_available_now(st, path, output_mode="update")
    out = sinks.latest_per_key(sinks.read_sink(spark, path).drop("schema_version", "updated_at"),
                               ["user_id", "event_type", "window_end"])
    return out.select("user_id", "event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                      F.col("window_end").cast("timestamp_ntz").alias("window_end"), "count",
                      F.round("mean", 6).alias("mean"), F.round("sd_pop", 4).alias("sd_pop"))


def stream_weekly_deterioration(spark, sf):
    """Monday-aligned weekly deterioration index as a streaming window aggregate
    (update mode; the latest emission per (user, week) is the result)."""
    ev = _event_stream(spark, sf)

    def avg_of(et):
        return F.avg(F.when(F.col("event_type") == et, F.col("value")))
    agg = (ev.withWatermark("ts", "1 day").groupBy("user_id", windows.weekly_window("ts").alias("w"))
           .agg((F.lit(0.4) * (avg_of("click") - avg_of("view")) + F.lit(0.4) * avg_of("purchase")
                 + F.lit(0.2) * avg_of("error")).alias("deterioration_index"))
           .select("user_id", F.col("w.start").alias("week"), "deterioration_index"))
    path = sinks.scratch_path(spark, "weekly")
    sinks.run_available_now(agg, path, output_mode="update")
    out = sinks.latest_per_key(sinks.read_sink(spark, path).drop("schema_version", "updated_at"), ["user_id", "week"])
    return out.select("user_id", F.col("week").cast("timestamp_ntz").alias("week"),
                      F.round("deterioration_index", 6).alias("deterioration_index"))


def stream_segment_activity(spark, sf):
    """Stream-static join: each event is enriched with its user's market segment
    from the static customer table, then counted per (segment, day) in a
    watermarked window (update mode; latest emission per key)."""
    from clinlake.session import table
    ev = _event_stream(spark, sf).select("user_id", "ts", "value")
    cust = table(spark, sf, "customer", ["c_custkey", "c_mktsegment"])
    enriched = ev.join(cust, ev.user_id == cust.c_custkey, "inner")
    agg = (enriched.withWatermark("ts", "1 day")
           .groupBy("c_mktsegment", F.window("ts", "1 day").alias("w"))
           .agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value_sum"))
           .select("c_mktsegment", F.col("w.start").alias("day"), "events", "value_sum"))
    path = sinks.scratch_path(spark, "segments")
    sinks.run_available_now(agg, path, output_mode="update")
    out = sinks.latest_per_key(sinks.read_sink(spark, path).drop("schema_version", "updated_at"),
                               ["c_mktsegment", "day"])
    return out.select("c_mktsegment", F.col("day").cast("timestamp_ntz").alias("day"), "events",
                      F.round("value_sum", 6).alias("value_sum"))


_SEGMENT_SQL = """
SELECT c_mktsegment, date_trunc('day', ts) AS day, count(*) AS events, round(sum(value), 6) AS value_sum
FROM events JOIN customer ON user_id = c_custkey GROUP BY 1, 2
"""


def stream_ring_features(spark, sf):
    """Ring-buffer signal features per modality stream (last 4096 samples,
    emitted from 128 samples on, value / 100 as the magnitude)."""
    ev = _event_stream(spark, sf).select("event_type", "ts", (F.col("value") / 100.0).alias("mag"))
    feats = windows.ring_buffer_features(ev, ["event_type"], ["string"], "ts", "mag", capacity=4096, min_samples=128)
    path = sinks.scratch_path(spark, "ring")
    sinks.run_available_now(feats, path)
    return sinks.read_sink(spark, path).select("event_type", "ts", "n_samples", "gait_cadence", "tremor_index",
                                               "bradykinesia_score")


def stream_dedupe(spark, sf):
    ev = _event_stream(spark, sf, repeats=True)
    d = windows.dedupe_within_watermark(ev, ["event_id"], "ts", "1 hour").select("event_id", "user_id", "event_type")
    path = sinks.scratch_path(spark, "dedupe")
    sinks.run_available_now(d, path, output_mode="append")
    return sinks.read_sink(spark, path).select("event_id", "user_id", "event_type")


def _sources(ev):
    """A source: the events of one type from one user."""
    return ev.select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("source"), "ts")


def source_freshness(spark, sf):
    """A source is pending when its last event is more than 7 days older than the last of all."""
    from clinlake.session import table
    ev = _sources(table(spark, sf, "events", ["user_id", "event_type", "ts"]))
    return freshness.source_status(ev, "source", "ts").select(
        "source", F.col("last_seen").cast("timestamp_ntz").alias("last_seen"), "status")


_FRESH_SQL = """
SELECT user_id || ':' || event_type AS source, max(ts) AS last_seen,
  CASE WHEN max(ts) < (SELECT max(ts) FROM events) - INTERVAL 7 DAY THEN 'pending' ELSE 'active' END AS status
FROM events GROUP BY 1
"""


def stream_silences(spark, sf):
    """Timers: each time a source fell silent for more than 7 days, found while the events
    stream in; equal to the gaps of the whole table, whatever the order of arrival."""
    ev = _sources(_event_stream(spark, sf))
    path = sinks.scratch_path(spark, "silences")
    sinks.run_available_now(freshness.silences(ev, "source", "string", "ts", watermark="1 day"), path, output_mode="append")
    out = sinks.read_sink(spark, path)
    last = spark.read.parquet(os.path.join(sf, "events.parquet")).agg(F.max(F.col("ts").cast("timestamp")).alias("m"))
    # silences that the watermark (a day behind) has passed
    return out.join(F.broadcast(last), F.col("silent_since") < F.col("m") - F.expr("INTERVAL 9 DAYS")).select(
        "source", F.col("silent_since").cast("timestamp_ntz").alias("silent_since"))


_SILENCE_SQL = """
WITH g AS (SELECT user_id || ':' || event_type AS source, ts, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS next,
    (SELECT max(ts) FROM events) AS m FROM events)
SELECT source, ts AS silent_since FROM g WHERE (next IS NULL OR next - ts > INTERVAL 7 DAY) AND ts < m - INTERVAL 9 DAY
"""


QUERIES = {
    "source_freshness": source_freshness,
    "stream_silences": stream_silences,
    "stream_daily_summary": stream_daily_summary,
    "stream_trailing_window": stream_trailing_window,
    "stream_dedupe": stream_dedupe,
    "stream_weekly_deterioration": stream_weekly_deterioration,
    "stream_segment_activity": stream_segment_activity,
    "stream_ring_features": stream_ring_features,
}

ORACLE = {
    "source_freshness": _FRESH_SQL,
    "stream_silences": _SILENCE_SQL,
    "stream_daily_summary": _daily_sql(),
    "stream_trailing_window": _TRAILING_SQL,
    "stream_dedupe": "SELECT DISTINCT ON (event_id) event_id, user_id, event_type FROM events",
    "stream_weekly_deterioration": _WEEKLY_SQL,
    "stream_segment_activity": _SEGMENT_SQL,
}
