"""Operators without a registered query, checked against brute force."""

import io
import os
import struct
import tempfile
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from clinlake.operators import align, audit, connectome, derive, encode, graph, signal
from clinlake.sources import readers
from clinlake.streaming import events as sev


def test_zip_member_lines(spark):
    d = tempfile.mkdtemp(prefix="clinlake-zip-")
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("readme.txt", "ignore me")
        z.writestr("parkinsons.data", "a,b\n1,2\n3,4")
    with open(os.path.join(d, "uci.zip"), "wb") as fh:
        fh.write(buf.getvalue())
    lines = [r["value"] for r in readers.zip_member_lines(spark, d).collect()]
    assert lines == ["a,b", "1,2", "3,4"]


def test_packet_decode(spark):
    pkt = struct.pack("<qfffff", 1_700_000_000_123_456_789, 0.5, -1.0, 9.75, 36.5, 120.0)
    df = spark.createDataFrame([(1, bytearray(pkt)), (2, bytearray(b"short"))], "dev long, payload binary")
    rows = {r["dev"]: r for r in sev.decode_packets(df).collect()}
    assert rows[1]["valid"] and rows[1]["ts_ns"] == 1_700_000_000_123_456_789
    assert (rows[1]["x"], rows[1]["y"], rows[1]["z"]) == (0.5, -1.0, 9.75) and not rows[2]["valid"]


def test_parse_events_filters_and_defaults(spark):
    raw = spark.createDataFrame([('{"patient_id":"p1","modality":"Heart_Rate","timestamp":"2026-04-08T10:00:00Z","value":72}',),
                                 ('{"patient_id":"p2","modality":"gps","timestamp":"2026-04-08T10:00:00Z","value":1}',)],
                                "value string")
    rows = sev.parse_events(raw).collect()
    assert len(rows) == 1 and rows[0]["patient_cohort"] == "unknown" and rows[0]["modality"] == "heart_rate"


def test_small_expressions(spark):
    df = spark.createDataFrame([("e3/e4", "missense_variant&splice", 70.0, 175.0, [1.0, 2.0])],
                               "apoe string, csq string, kg double, cm double, arr array<double>")
    r = df.select(encode.apoe_e4_dosage("apoe").alias("d"),
                  encode.code_map("csq", {"missense_variant": 2, "stop_gained": 3}, 0).alias("c"),
                  F.round(derive.bmi_from_cm("kg", "cm"), 4).alias("bmi"),
                  align.pad_array("arr", 4).alias("p")).collect()[0]
    assert r["d"] == 1 and r["c"] == 2 and r["bmi"] == round(70 / 1.75 ** 2, 4) and r["p"] == [1.0, 2.0, 0.0, 0.0]


def test_headers_aliases_and_duplicates(spark):
    df = spark.createDataFrame([(1, None, 5), (1, 7, 5)], "`Subject ID` int, `M/F` int, `Age-Years` int")
    n = align.normalise_headers(df)
    assert n.columns == ["subject_id", "m_f", "age_years"]
    first = n.select(align.first_available(n, ["sex", "m_f", "age_years"]).alias("v")).collect()
    assert [r["v"] for r in first] == [5, 7]
    assert align.duplicate_keys(n, ["subject_id"]).collect()[0]["n"] == 2


def test_audit_chain_append_and_verify(spark):
    rows = [("u1", i, f"payload-{i}") for i in range(5)] + [("u2", i, f"x{i}") for i in range(3)]
    df = spark.createDataFrame(rows, "chain string, seq int, payload string")
    first = audit.append_batch(None, df.filter("seq < 3"), "chain", ["seq"], "payload")
    second = audit.append_batch(first, df.filter("seq >= 3"), "chain", ["seq"], "payload")
    stored = first.unionByName(second)
    # brute force: the same chain built in plain Python
    import hashlib
    exp = {}
    for c in ("u1", "u2"):
        prev = "GENESIS"
        for _, s, p in sorted(r for r in rows if r[0] == c):
            prev = hashlib.sha256(f"{prev}|{p}".encode()).hexdigest()
            exp[(c, s)] = prev
    got = {(r["chain"], r["seq"]): r["entry_hash"] for r in stored.collect()}
    assert got == exp
    ok = audit.chain_summary(audit.verify_chain(stored, "chain", ["seq"], "payload"), "chain").collect()
    assert all(r["valid"] for r in ok)
    tampered = stored.withColumn("payload", F.when(F.col("seq") == 1, F.lit("forged")).otherwise(F.col("payload")))
    bad = {r["chain"]: r for r in audit.chain_summary(audit.verify_chain(tampered, "chain", ["seq"], "payload"),
                                                      "chain").collect()}
    assert bad["u1"]["bad_hashes"] == 1 and bad["u2"]["bad_hashes"] == 1 and not bad["u1"]["valid"]


def test_break_cycles_brute_force(spark):
    edges = [("g", "a", "b", 0.9), ("g", "b", "c", 0.2), ("g", "c", "a", 0.8), ("g", "c", "d", 0.5)]
    df = spark.createDataFrame(edges, "gid string, src string, dst string, w double")
    kept = {(r["src"], r["dst"]) for r in graph.break_cycles(df, "gid").collect()}
    assert kept == {("a", "b"), ("c", "a"), ("c", "d")}  # the weakest edge of the cycle a->b->c->a goes


def test_welch_matches_direct_numpy(spark):
    fs, n, nper = 50.0, 700, 256
    t = np.arange(n) / fs
    x = np.sin(2 * np.pi * 1.5 * t) + 0.3 * np.sin(2 * np.pi * 6.0 * t)
    pdf = pd.DataFrame({"k": 1, "i": np.arange(n), "v": x})
    got = signal.welch_psd(spark.createDataFrame(pdf), ["k"], ["i"], "v", fs=fs, nperseg=nper).toPandas()
    got = got.sort_values("f_idx")
    # direct definition: periodic Hann, 50 % overlap, constant detrend, density scaling, mean over segments
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(nper) / nper)
    step = nper - nper // 2
    specs = []
    for s in range(0, n - nper + 1, step):
        seg = x[s:s + nper]
        p = np.abs(np.fft.rfft((seg - seg.mean()) * w)) ** 2 / (fs * (w ** 2).sum())
        p[1:-1] *= 2
        specs.append(p)
    exp = np.mean(specs, axis=0)
    assert np.allclose(got["psd"].to_numpy(), exp)
    feats = signal.band_features(spark.createDataFrame(got.assign(k=1)), ["k"]).collect()[0]
    assert abs(feats["gait_cadence"] - 1.5 * 60) < fs / nper * 60 + 1e-9


def test_field_id_columns(spark):
    df = spark.createDataFrame([(1, 61, 62, "G30", "G20", 5)],
                               "eid int, `f.21003.0.0` int, `f.21003.1.0` int, `f.41270.0.1` string, "
                               "`f.41270.0.0` string, `f.999.0.0` int")
    out = align.field_id_columns(df, {"21003": "age", "41270": "icd10_primary"})
    r = out.collect()[0]
    assert out.columns == ["eid", "age", "icd10_primary"] and (r["age"], r["icd10_primary"]) == (61, "G20")


def test_betweenness_brute_force(spark):
    edges = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "f"), ("b", "e"), ("f", "a")]
    nodes = sorted({x for e in edges for x in e})
    adj = {n: [b for a, b in edges if a == n] for n in nodes}

    def bfs(s):
        dist, sig, q = {s: 0}, {s: 1}, [s]
        for u in q:
            for v in adj[u]:
                if v not in dist:
                    dist[v], sig[v] = dist[u] + 1, 0
                    q.append(v)
                if dist[v] == dist[u] + 1:
                    sig[v] += sig[u]
        return dist, sig
    info = {s: bfs(s) for s in nodes}
    exp = {v: 0.0 for v in nodes}
    for s in nodes:
        ds, ss = info[s]
        for t in nodes:
            if t == s or t not in ds:
                continue
            for v in nodes:
                if v in (s, t) or v not in ds:
                    continue
                dv, sv = info[v]
                if t in dv and ds[v] + dv[t] == ds[t]:
                    exp[v] += ss[v] * sv[t] / ss[t]
    df = spark.createDataFrame(edges, "src string, dst string")
    got = {r["node"]: r["betweenness"] for r in graph.betweenness(df).collect()}
    assert all(abs(got.get(v, 0.0) - exp[v]) < 1e-9 for v in nodes)


def test_betweenness_levels_are_not_joined_by_what_was_seen(spark, monkeypatch):
    """Layers x -> y -> z with loops, repeated edges and null ends; a level is written once, and
    no level but the first holds what cannot go on."""
    edges = [(f"x{i}", f"y{i % 7}") for i in range(60)] + [(f"x{i}", f"y{i % 5}") for i in range(60)]
    edges += [(f"y{i}", f"z{i % 2}") for i in range(7)] + [("z0", "z0"), ("y1", "z1"), ("x1", "y1"), (None, "y1"), ("z1", None)]
    df = spark.createDataFrame(edges, "src string, dst string")
    written, cut = [], graph._cut

    def noted(d, i, every=graph.CHECKPOINT_EVERY):
        out = cut(d, i, every)
        if (i + 1) % every == 0:
            written.append(out.count())
        return out
    monkeypatch.setattr(graph, "_cut", noted)
    got = {r["node"]: r["betweenness"] for r in graph.betweenness(df).collect()}
    real = {e for e in edges if None not in e and e[0] != e[1]}
    succ = {a: sorted(b for x, b in real if x == a) for a, _ in real}
    exp = {n: 0.0 for e in edges for n in e}
    for x in (f"x{i}" for i in range(60)):
        for z in {z for y in succ[x] for z in succ[y]}:
            via = [y for y in succ[x] if z in succ[y]]
            for y in via:
                exp[y] += 1 / len(via)
    assert got.keys() == exp.keys() and all(abs(got[n] - exp[n]) < 1e-9 for n in exp)
    assert sum(written) < len(real) + 60


def test_motion_scrub_sorts_once_a_stage(spark):
    rows = [(e, e % 3, float(e), 1.0 if e % 7 == 2 and e % 3 < 2 or e % 3 == 2 else 0.0, None if e % 11 == 0 else e * 2.0)
            for e in range(120)]
    df = spark.createDataFrame(rows, "event_id long, scan int, ts double, fd double, value double")
    out = connectome.motion_scrub(df, "scan", ["ts", "event_id"], "fd", "value")
    got = {r.event_id: r.value for r in out.collect()}
    exp = {}
    for scan in (0, 1):  # the third one has bad frames only
        mine = [r for r in rows if r[1] == scan]
        x = np.array([np.nan if r[3] > 0.5 or r[4] is None else r[4] for r in mine])
        ok = np.flatnonzero(~np.isnan(x))
        exp |= dict(zip((r[0] for r in mine), np.interp(np.arange(len(x)), ok, x[ok])))
    assert got.keys() == exp.keys() and all(abs(got[e] - exp[e]) < 1e-9 for e in exp)
    plan = out._jdf.queryExecution().executedPlan().toString()
    initial = plan[plan.index("Initial Plan"):] if "Initial Plan" in plan else plan
    assert initial.count("Sort [") <= 5 and initial.count("SortMergeJoin") + initial.count("BroadcastHashJoin") <= 1


def test_f_tail_and_granger_against_numpy(spark):
    from clinlake.operators import causal
    assert abs(causal.f_sf(4.9646, 1, 10) - 0.05) < 1e-4
    rng = np.random.default_rng(7)
    n = 200
    x = rng.normal(size=n)
    y = np.zeros(n)
    for t in range(1, n):
        y[t] = 0.8 * x[t - 1] + 0.3 * rng.normal()
    df = spark.createDataFrame(pd.DataFrame({"t": np.arange(n), "x": x, "y": y}))
    got = {(r["cause"], r["effect"]): r["p_value"] for r in causal.granger_pairs(df, ["t"], ["x", "y"], 2).collect()}
    assert got[("x", "y")] < 1e-6 and got[("y", "x")] > 0.01

    def brute(cause, effect, L):
        yy, xx = {"x": x, "y": y}[effect], {"x": x, "y": y}[cause]
        rows = range(L, n)
        own = np.array([[1.0] + [yy[t - k] for k in range(1, L + 1)] for t in rows])
        full = np.array([[1.0] + [yy[t - k] for k in range(1, L + 1)] + [xx[t - k] for k in range(1, L + 1)] for t in rows])
        target = np.array([yy[t] for t in rows])
        rss = [float(((target - a @ np.linalg.lstsq(a, target, rcond=None)[0]) ** 2).sum()) for a in (own, full)]
        dfd = len(target) - 2 * L - 1
        return causal.f_sf(((rss[0] - rss[1]) / L) / (rss[1] / dfd), L, dfd)
    exp = min(brute("y", "x", 1), brute("y", "x", 2))
    assert abs(got[("y", "x")] - exp) < 1e-9


def test_pc_skeleton_chain(spark):
    from clinlake.operators import causal
    rng = np.random.default_rng(3)
    n = 3000
    a = rng.normal(size=n)
    b = a + 0.5 * rng.normal(size=n)
    c = b + 0.5 * rng.normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "c": c}))
    edges = {(r["source"], r["target"]) for r in causal.pc_edges(df, ["a", "b", "c"]).collect()}
    assert edges == {("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")}


def test_imaging_qc_deid_volume(spark):
    from clinlake.operators import imaging
    hdr = spark.createDataFrame([("s1", 1.0, 1.0, 1.0, "100010", 3.0), ("s2", 0.9, 0.9, 1.2, "100001", 3.0),
                                 ("s3", 1.0, 1.0, 5.0, "100001", 7.0)],
                                "scan string, px double, py double, thk double, orient string, fs double")
    q = {r["scan"]: (r["qc_pass"], r["qc_flags"]) for r in
         imaging.qc_flags(hdr, "px", "py", "thk", "orient", "fs", (1.0, 3.5)).collect()}
    assert q["s1"] == (False, ["orientation_unexpected"]) and q["s2"] == (True, [])
    assert q["s3"] == (False, ["voxel_size_outlier", "field_strength_outlier"])
    tags = spark.createDataFrame([("f1", 0x0010, 0x0010, "Doe^Jane", "p1"), ("f1", 0x0010, 0x0020, "MRN1", "p1"),
                                  ("f1", 0x0008, 0x0060, "MR", "p1")],
                                 "file string, grp int, elem int, value string, patient string")
    out = {(r["grp"], r["elem"]): r["value"] for r in
           imaging.deidentify_tags(tags, "grp", "elem", "value", "patient", "k").collect()}
    assert out[(0x0010, 0x0010)] == "" and out[(0x0008, 0x0060)] == "MR" and len(out[(0x0010, 0x0020)]) == 64
    vox = spark.createDataFrame([("s1", v, 1.0, 1.0, 2.0) for v in (0, 3, 5, 0, 1)],
                                "scan string, v int, vx double, vy double, vz double")
    assert imaging.scan_volumes(vox, "scan", "v", "vx", "vy", "vz").collect()[0]["volume_mm3"] == 6.0


def test_ring_buffer_stream_features(spark):
    from clinlake.operators.signal import window_features
    from clinlake.streaming import sinks, windows
    rng = np.random.default_rng(11)
    n, cap, minimum = 300, 200, 128
    t0 = pd.Timestamp("2026-04-08 10:00:00")
    vals = np.sin(2 * np.pi * 1.2 * np.arange(n) / 50.0) + 0.2 * rng.normal(size=n)
    pdf = pd.DataFrame({"device": "d1", "ts": [t0 + pd.Timedelta(milliseconds=20 * i) for i in range(n)], "mag": vals})
    src = tempfile.mkdtemp(prefix="clinlake-ring-")
    spark.createDataFrame(pdf).coalesce(1).write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    feats = windows.ring_buffer_features(stream, ["device"], ["string"], "ts", "mag", capacity=cap, min_samples=minimum)
    path = sinks.scratch_path(spark, "ring")
    sinks.run_available_now(feats, path)
    got = sinks.read_sink(spark, path).orderBy("ts").toPandas()
    assert len(got) == n - minimum + 1
    last = window_features(vals[None, -cap:])[0]
    assert got["n_samples"].iloc[-1] == cap
    assert np.allclose(got[["gait_cadence", "tremor_index", "bradykinesia_score"]].iloc[-1].to_numpy(), last)


def test_report_metrics(spark):
    import json
    from clinlake.operators import text
    good = {"intervention_recommendations": [{"intervention": "x", "supporting_pmids": ["1", "2"]}],
            "deterioration_forecast": {"dci_median": [50, 60], "dci_ci_80_lower": [40, 70], "dci_ci_80_upper": [60, 80],
                                       "months_to_clinical_threshold": {"estimate": 12}},
            "uncertainty_flags": ["small cohort"]}
    other = {"intervention_recommendations": [{"intervention": "y", "supporting_pmids": ["3"]}],
             "deterioration_forecast": {"dci_median": [10], "dci_ci_80_lower": [5], "dci_ci_80_upper": [20],
                                        "months_to_clinical_threshold": {"estimate": 0}},
             "uncertainty_flags": []}
    reps = spark.createDataFrame([(1, json.dumps(good)), (2, json.dumps(other)), (3, "not json")], "id int, js string")
    known = spark.createDataFrame([("1",), ("3",)], "pmid string")
    r = text.report_metrics(reps, "id", "js", known, "pmid").collect()[0]
    assert abs(r["json_validity_rate"] - 2 / 3) < 1e-12
    assert abs(r["pmid_hallucination_rate"] - 1 / 3) < 1e-12
    # report 1: one implausible point (-0.25); report 2: estimate <= 0 and no flags (-0.5); report 3: invalid (0)
    assert abs(r["clinical_plausibility"] - (0.75 + 0.5 + 0.0) / 3) < 1e-12


def test_derived_clinical_and_augmented_guard(spark):
    from clinlake.operators import impute
    df = spark.createDataFrame([(1.0, 0.0, None, 1.0, 16.0, 27.0, 600.0, 30.0, "adni"),
                                (0.0, 1.0, 1.0, None, 12.0, 20.0, 500.0, 0.0, "bootstrap_augmented")],
                               "Hypertension double, Diabetes double, CardiovascularDisease double, Smoking double, "
                               "EducationLevel double, MMSE double, CSF_Abeta42 double, CSF_pTau double, data_source string")
    out = derive.clinical_derived(df).collect()
    assert out[0]["VascularRiskComposite"] == 2.0 and out[1]["ComorbidityCount"] == 2.0
    assert out[0]["AbetaTauRatio"] == 20.0 and out[1]["AbetaTauRatio"] is None
    assert abs(out[0]["CognitiveReserve"] - (16 + 27 / 30)) < 1e-12
    assert [r["data_source"] for r in impute.exclude_augmented(df, "data_source").collect()] == ["adni"]


def test_constant_region_has_no_correlation(spark):
    from clinlake.operators import connectome
    rows = [(s, t, r, v) for s, r, vs in ((1, "a", [1.0, 1.0, 1.0]), (1, "b", [1.0, 2.0, 4.0]), (2, "a", [1.0, 2.0, None]),
                                          (2, "b", [3.0, 1.0, 9.0]), (3, "a", [1.0]), (3, "b", [2.0])) for t, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "scan int, t int, roi string, value double")
    got = {r.scan: (r.r, r.n) for r in connectome.pair_correlations(df, "scan", "t", "roi", "value").collect()}
    assert got[1] == (None, 3) and got[3] == (None, 1) and got[2][1] == 2 and abs(got[2][0] + 1) < 1e-12


def test_trailing_windows_of_many_keys_in_one_call(spark, tmp_path):
    """Keys are dealt to buckets: a call handles many keys, null ones too, and mixes none."""
    import datetime as dt

    from clinlake.streaming import sinks, windows
    t = dt.datetime(2026, 4, 8, 10, 0, 0)
    rows = [(k, t + dt.timedelta(minutes=m), float((k or 7) * m)) for k in [None, *range(40)] for m in (0, 1, 4, 30)]
    path, schema = str(tmp_path / "landing"), "k long, ts timestamp, v double"
    spark.createDataFrame(rows, schema).write.parquet(path)
    st = windows.trailing_window_stateful(sev.file_stream(spark, path, schema), ["k"], ["long"], "ts", "v",
                                          3 * 60 * 1_000_000, "1 day", buckets=2)
    out = sinks.scratch_path(spark, "many")
    sinks.run_available_now(st, out, output_mode="update")
    got = sorted(((r.k is None, r.k), r.window_start, r.window_end, r["count"], r["mean"], r.sd_pop)
                 for r in sinks.read_sink(spark, out).fillna(-1, ["k"]).collect())
    exp = sorted(((False, -1 if k is None else k), t + dt.timedelta(minutes=a), t + dt.timedelta(minutes=b), 2,
                  (k or 7) * (a + b) / 2, (k or 7) * (b - a) / 2) for k in [None, *range(40)] for a, b in ((0, 1), (1, 4)))
    assert got == exp


def test_sliding_features_equal_those_of_each_window():
    from clinlake.operators.signal import sliding_features, window_features
    rng = np.random.default_rng(3)
    series = (rng.exponential(1, 900).round(3), np.r_[np.zeros(400), rng.normal(size=300)], np.arange(600.0))
    for x in series:
        for n in (128, 129, 300, 512):
            full = np.lib.stride_tricks.sliding_window_view(x, n)
            assert np.array_equal(sliding_features(x, n), window_features(full))


def test_ring_blocks_are_dealt_over_tasks(spark, tmp_path, monkeypatch):
    """One busy key: its features are computed by several tasks, from blocks of a few samples."""
    from clinlake.operators.signal import window_features
    from clinlake.streaming import sinks, windows
    monkeypatch.setattr(windows, "RING_BLOCK", 16)
    vals = np.random.default_rng(5).normal(size=400)
    pdf = pd.DataFrame({"device": "d", "ts": pd.to_datetime(np.arange(400) + 86_400, unit="s"), "mag": vals})
    spark.createDataFrame(pdf).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("device string, ts timestamp, mag double").parquet(str(tmp_path / "in"))
    feats = windows.ring_buffer_features(stream, ["device"], ["string"], "ts", "mag", capacity=200, min_samples=128)
    out = str(tmp_path / "out")
    sinks.run_available_now(feats.withColumn("task", F.spark_partition_id()), out)
    got = sinks.read_sink(spark, out).orderBy("ts").toPandas()
    assert got["task"].nunique() > 1 and len(got) == 400 - 127
    for i, r in enumerate(got.itertuples(), 128):
        want = window_features(vals[None, max(0, i - 200):i])[0]
        assert r.n_samples == min(i, 200)
        assert np.allclose((r.gait_cadence, r.tremor_index, r.bradykinesia_score), want, rtol=1e-12, atol=0)
