"""Silences of sources in a stream equal the gaps of the whole table."""

import random
from datetime import datetime, timedelta

import pytest

from clinlake.streaming import freshness, sinks
from clinlake.streaming import events as sev

DAY0 = datetime(2024, 1, 1)


def test_status_of_sources(spark):
    rows = [("a", DAY0), ("a", DAY0 + timedelta(days=20)), ("b", DAY0 + timedelta(days=13)), ("c", DAY0 + timedelta(days=12, hours=23)), ("d", None)]
    got = {r.s: r.status for r in freshness.source_status(spark.createDataFrame(rows, "s string, t timestamp"), "s", "t").collect()}
    assert got == {"a": "active", "b": "active", "c": "pending", "d": "pending"}


@pytest.mark.parametrize("files", [1, 6])
def test_silences_of_unordered_files(spark, tmp_path, files):
    rnd = random.Random(3)
    rows = [(s, DAY0 + timedelta(hours=h)) for s in "abcde" for h in sorted(rnd.sample(range(0, 24 * 60), 25 if s < "d" else 6))]
    rows += [("f", DAY0), ("f", DAY0), ("z", DAY0 + timedelta(days=70))]  # z moves the watermark on at the end
    expected = set()
    for s in {s for s, _ in rows if s != "z"}:
        t = sorted({x for q, x in rows if q == s})
        expected |= {(s, a) for a, b in zip(t, t[1:] + [None]) if b is None or b - a > timedelta(days=7)}
    path = str(tmp_path / "landing")
    cut = DAY0 + timedelta(days=70, seconds=1)
    for i in range(files):  # arrival order; inside a file no order
        lo, hi = (DAY0 + (cut - DAY0) * j / files for j in (i, i + 1))
        part = [r for r in rows if lo <= r[1] < hi]
        rnd.shuffle(part)
        spark.createDataFrame(part, "s string, t timestamp").repartition(1).write.mode("append").parquet(path)
    stream = sev.file_stream(spark, path, "s string, t timestamp", "parquet", max_files_per_trigger=1)
    out = sinks.scratch_path(spark, "silent")
    sinks.run_available_now(freshness.silences(stream, "s", "string", "t", "1 day"), out, output_mode="append")
    got = [(r.s, r.silent_since) for r in sinks.read_sink(spark, out).collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_silences_hold_sessions_only(spark, tmp_path):
    """No Python call per source and batch; an event exactly on the limit is no silence."""
    rows = [("a", DAY0), ("a", DAY0 + timedelta(days=7)), ("b", DAY0), ("b", DAY0 + timedelta(days=7, microseconds=1)),
            (None, DAY0), ("z", None), ("z", DAY0 + timedelta(days=70))]
    path = str(tmp_path / "landing")
    spark.createDataFrame(rows, "s string, t timestamp").write.parquet(path)
    found = freshness.silences(sev.file_stream(spark, path, "s string, t timestamp"), "s", "string", "t", "1 day")
    assert "Pandas" not in found._jdf.queryExecution().logical().toString()
    out = sinks.scratch_path(spark, "silent")
    sinks.run_available_now(found, out, output_mode="append")
    got = {(r.s, r.silent_since) for r in sinks.read_sink(spark, out).collect()}
    assert got == {("a", DAY0 + timedelta(days=7)), ("b", DAY0), ("b", DAY0 + timedelta(days=7, microseconds=1)), (None, DAY0)}
