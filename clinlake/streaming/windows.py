"""Streaming window operators.

Late-data policy (a decision of ours; the reference has none): events are
ordered by event time, and an event later than the watermark is dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def daily_summary(events: DataFrame, keys: Sequence[str], ts: str, value: str, metric: str,
                  metrics: Sequence[tuple[str, str]], watermark: str = "1 day") -> DataFrame:
    """Tumbling 1-day windows per key: avg and sample sd of each metric
    (``metrics`` = [(metric value, output name)])."""
    aggs = []
    for m, name in metrics:
        x = F.when(F.col(metric) == m, F.col(value))
        aggs += [F.avg(x).alias(f"avg_{name}"), F.stddev_samp(x).alias(f"std_{name}")]
    return (events.withWatermark(ts, watermark)
            .groupBy(*keys, F.window(F.col(ts), "1 day").alias("w")).agg(*aggs)
            .withColumn("date", F.col("w.start")).drop("w"))


def weekly_window(ts: str):
    """Monday-aligned 7-day windows (the epoch was a Thursday: start offset 4 days)."""
    return F.window(F.col(ts), "7 days", "7 days", "4 days")


def dedupe_within_watermark(events: DataFrame, keys: Sequence[str], ts: str, watermark: str) -> DataFrame:
    """At-least-once sources: drop repeats of a key seen within the watermark."""
    return events.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(list(keys))


TRAILING_OUT = ("window_start timestamp, window_end timestamp, count long, mean double, sd_pop double")


def trailing_window_stateful(events: DataFrame, keys: Sequence[str], key_types: Sequence[str], ts: str,
                             value: str, window_us: int, watermark: str, min_count: int = 2,
                             buckets: int = 1024) -> DataFrame:
    """Per-event trailing window with keyed state (``applyInPandasWithState``, update mode).

    For every distinct event time t of a key, count / mean / sd_pop over the
    events in [t - window, t] are emitted when count >= ``min_count``; peers at
    the same instant form one emission, as in the batch operator.  An accepted
    late event emits its own time and emits again every later time whose window
    holds it, so the latest emission per (key, window_end) equals the batch
    result (``sinks.latest_per_key``).  State reaches back to the watermark less
    one window, as far as an accepted event can look back.  Events later than the
    watermark are dropped by Spark before reaching the function.

    A call costs far more than the few events of a key in a batch, so keys are dealt to
    ``buckets`` by hash and a call handles all keys of one bucket together.
    """
    state_schema = "k array<string>, ts array<long>, v array<double>"
    columns = ["_k", "window_start", "window_end", "count", "mean", "sd_pop"]

    def step(_, pdfs, state):
        if state.hasTimedOut:  # no accepted event can reach back to this bucket's events any more
            state.remove()
            return
        old_k, old_t, old_v = state.get if state.exists else ([], [], [])
        ks, times = [np.asarray(old_k, dtype=object)], [np.asarray(old_t, dtype=np.int64)]
        values, fresh = [np.asarray(old_v, dtype=np.float64)], [np.zeros(len(old_t), dtype=bool)]
        for pdf in pdfs:
            ks.append(pdf["_k"].to_numpy(dtype=object))
            times.append(pdf["_t"].to_numpy(dtype=np.int64))
            values.append(pdf[value].to_numpy(dtype=np.float64))
            fresh.append(np.ones(len(pdf), dtype=bool))
        names, t, v = np.concatenate(ks), np.concatenate(times), np.concatenate(values)
        code, unique = pd.factorize(names)
        order = np.lexsort((t, code))
        code, t, v, names = code[order], t[order], v[order], names[order]
        for at, lo, hi in _windows_to_emit(code, t, np.concatenate(fresh)[order], window_us):
            n, mean, sd = _segment_stats(v, lo, hi)
            some = n >= min_count
            yield pd.DataFrame({"_k": unique[code[at[some]]], "window_start": pd.to_datetime(t[lo[some]], unit="us"),
                                "window_end": pd.to_datetime(t[at[some]], unit="us"), "count": n[some],
                                "mean": mean[some], "sd_pop": sd[some]}, columns=columns)
        mark = state.getCurrentWatermarkMs()
        keep = t >= mark * 1000 - window_us
        state.update((names[keep].tolist(), t[keep].tolist(), v[keep].tolist()))
        state.setTimeoutTimestamp(max(int(t.max()) // 1000 + window_us // 1000, mark) + 1)

    text = F.to_json(F.struct(*[F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)]))
    prepared = events.withWatermark(ts, watermark).select(
        F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("_bucket"), text.alias("_k"), F.unix_micros(F.col(ts)).alias("_t"),
        F.col(value).cast("double").alias(value), ts)
    out = prepared.groupBy("_bucket").applyInPandasWithState(
        step, f"_k string, {TRAILING_OUT}", state_schema, "update", GroupStateTimeout.EventTimeTimeout)
    parsed = F.from_json("_k", ", ".join(f"k{i} string" for i in range(len(keys))))
    return out.withColumn("_p", parsed).select(
        *[F.col(f"_p.k{i}").cast(t).alias(k) for i, (k, t) in enumerate(zip(keys, key_types))], *columns[1:])


def _windows_to_emit(code, t, fresh, window_us, most: int = 1_000_000):
    """(at, lo, hi) in blocks of at most ``most`` rows in windows (or one window): of rows sorted
    by key and time, one row of each distinct time at or after a fresh event and within one
    window of the last fresh event before it, and the range of the rows of its window."""
    starts = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (t[1:] != t[:-1])])
    ends = np.r_[starts[1:], len(t)]
    has_fresh = np.maximum.reduceat(fresh, starts)
    last = np.maximum.accumulate(np.where(has_fresh, np.arange(len(starts)), -1))
    near = (last >= 0) & (code[starts] == code[starts[last]]) & (t[starts] - t[starts[last]] <= window_us)
    at, hi = starts[near], ends[near]
    # rows before (key, time - window): a merge of the rows and the window starts, which go first among equals
    n = len(t)
    order = np.lexsort((np.r_[np.ones(n), np.zeros(len(at))], np.r_[t, t[at] - window_us], np.r_[code, code[at]]))
    is_row = order < n
    lo = np.empty(len(at), dtype=np.int64)
    lo[order[~is_row] - n] = np.cumsum(is_row)[~is_row]
    total, first = np.cumsum(hi - lo), 0
    while first < len(at):
        done = total[first - 1] if first else 0
        past = max(first + 1, int(np.searchsorted(total, done + most, side="right")))
        yield at[first:past], lo[first:past], hi[first:past]
        first = past


def _segment_stats(v, lo, hi):
    """Count, mean and population sd of the non-NaN values of each range lo:hi (none empty)."""
    size = hi - lo
    offsets = np.cumsum(size) - size
    x = v[np.arange(size.sum()) + np.repeat(lo - offsets, size)]
    seen = ~np.isnan(x)
    n = np.add.reduceat(seen.astype(np.int64), offsets)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.add.reduceat(np.where(seen, x, 0.0), offsets) / n
        sd = np.sqrt(np.add.reduceat(np.where(seen, x - np.repeat(mean, size), 0.0) ** 2, offsets) / n)
    return n, mean, sd


#: New samples of one block, which a task turns into features together.
RING_BLOCK = 2048
RING_OUT = "ts timestamp, n_samples long, gait_cadence double, tremor_index double, bradykinesia_score double"


def ring_buffer_features(events: DataFrame, keys: Sequence[str], key_types: Sequence[str], ts: str, value: str,
                         capacity: int = 4096, min_samples: int = 128, fs: float = 50.0,
                         watermark: str = "1 hour") -> DataFrame:
    """Per-key ring buffer of the last ``capacity`` samples (keyed state,
    ``applyInPandasWithState``); every new sample, once at least
    ``min_samples`` are buffered, emits the features of the buffer.  The stateful
    step only hands on blocks of new samples with the samples before them; the
    features are computed from the blocks, which are dealt over all tasks, so a
    few busy keys do not hold them up (over sliding windows of one array, each
    segment and bin once).  State is bounded by ``capacity``; it is dropped when the
    key's event time falls behind the watermark."""
    from clinlake.operators.signal import sliding_features
    key_schema = ", ".join(f"{k} {t}" for k, t in zip(keys, key_types))
    columns = [*keys, "ts", "n_samples", "gait_cadence", "tremor_index", "bradykinesia_score"]

    def step(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        held = np.asarray(state.get[0] if state.exists else [], dtype=np.float64)
        latest = 0
        for pdf in pdfs:  # one Arrow batch at a time
            pdf = pdf.sort_values("_t", kind="stable")
            t = pdf["_t"].to_numpy(dtype=np.int64)
            latest = max(latest, int(t.max()))
            x = np.concatenate([held, pdf[value].to_numpy(dtype=np.float64)])
            for lo in range(0, len(t), RING_BLOCK):
                hi, first = min(lo + RING_BLOCK, len(t)), max(0, len(held) + lo + 1 - capacity)
                yield pd.DataFrame([(*key, lo, t[lo:hi], x[first:len(held) + hi])], columns=[*keys, "_lo", "_t", "_x"])
            held = x[-capacity:]
        state.update((held.tolist(),))
        state.setTimeoutTimestamp(max(latest // 1000 + 3_600_000, state.getCurrentWatermarkMs() + 1))

    def features(frames):
        for pdf in frames:
            for *key, t, x in pdf[[*keys, "_t", "_x"]].itertuples(index=False):
                t, x = np.asarray(t, dtype=np.int64), np.asarray(x, dtype=np.float64)
                ends = np.arange(len(x) - len(t) + 1, len(x) + 1)
                size = np.minimum(ends, capacity)  # samples in the buffer after each event
                got = np.empty((len(t), 3))
                for n in np.unique(size[size >= min_samples]):  # one length once full
                    at = np.flatnonzero(size == n)  # neighbours
                    got[at] = sliding_features(x[ends[at[0]] - n:ends[at[-1]]], n, fs)
                out = pd.DataFrame(got, columns=columns[-3:])
                out.insert(0, "n_samples", size.astype(np.int64))
                out.insert(0, "ts", pd.to_datetime(t, unit="us"))
                for i, k in enumerate(keys):
                    out.insert(i, k, key[i])
                yield out[size >= min_samples]

    prepared = events.withWatermark(ts, watermark).withColumn("_t", F.unix_micros(F.col(ts)))
    blocks = prepared.groupBy(*keys).applyInPandasWithState(
        step, f"{key_schema}, _lo long, _t array<long>, _x array<double>", "buf array<double>", "append",
        GroupStateTimeout.EventTimeTimeout)
    # the projection also makes the rows that a shuffle takes
    dealt = blocks.withColumn("_part", F.xxhash64(*keys, "_lo", F.col("_t")[0])).repartition("_part")
    return dealt.mapInPandas(features, f"{key_schema}, {RING_OUT}")
