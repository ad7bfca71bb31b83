"""Linkage operators against plain loops."""

import random

import numpy as np
import pytest

from clinlake.operators import genomics, linkage


def cohort(spark, n_variants=90, n_samples=40, seed=2, missing=0.03):
    """Sparse calls of correlated blocks of variants on two chromosomes."""
    rnd = random.Random(seed)
    rows, variants, g = [], [], {}
    base = None
    for v in range(n_variants):
        if v % 6 == 0:
            base = [rnd.choices((0, 1, 2), (5, 3, 2))[0] for _ in range(n_samples)]
        calls = [b if rnd.random() < 0.75 else rnd.choices((0, 1, 2), (5, 3, 2))[0] for b in base]
        g[v] = [None if rnd.random() < missing else c for c in calls]
        rows += [(v, s, c) for s, c in enumerate(g[v]) if c is None or c > 0]
        called = [c for c in g[v] if c is not None]
        p = sum(called) / (2 * len(called))
        variants.append((v, v % 4 // 3, (v * 7919) % 1000, min(p, 1 - p)))
    calls = spark.createDataFrame(rows, "v long, s long, d int").repartition(3)
    samples = spark.createDataFrame([(s,) for s in range(n_samples)], "s long")
    table = spark.createDataFrame(variants, "v long, chrom int, pos long, maf double")
    return calls, samples, table, variants, g


def r2(a, b):
    both = [(x, y) for x, y in zip(a, b) if x is not None and y is not None]
    x, y = np.array(both, float).T
    return -1.0 if x.std() == 0 or y.std() == 0 else float(np.corrcoef(x, y)[0, 1] ** 2)


def plain_prune(variants, g, window, step, limit):
    kept = {}
    for chrom in {c for _, c, _, _ in variants}:
        order = sorted((x for x in variants if x[1] == chrom), key=lambda x: (x[2], x[0]))
        gone = set()
        for start in range(0, max(1, len(order)), step):
            inside = range(start, min(len(order), start + window))
            for i in inside:
                for j in inside:
                    if i < j and i not in gone and j not in gone and r2(g[order[i][0]], g[order[j][0]]) > limit:
                        gone.add(i if order[i][3] < order[j][3] else j)
        kept |= {order[i][0]: i not in gone for i in range(len(order))}
    return kept


@pytest.mark.parametrize("window, step, bucket", [(1000, 200, 50_000), (12, 3, 50_000), (12, 3, 3), (12, 3, 37), (7, 7, 7), (20, 1, 4)])
def test_pruning_against_a_plain_loop(spark, window, step, bucket):
    calls, samples, table, variants, g = cohort(spark)
    packed = linkage.packed_variants(calls, samples, table, "v", "s", "d")
    got = {r.v: r.kept for r in linkage.ld_prune(packed, "v", window, step, 0.3, bucket_variants=bucket).collect()}
    expected = plain_prune(variants, g, window, step, 0.3)
    assert got == expected and 10 < sum(expected.values()) < 90


def test_pairs_reach_over_many_blocks(spark):
    calls, samples, table, variants, g = cohort(spark, n_variants=40)
    packed = linkage.packed_variants(calls, samples, table, "v", "s", "d").checkpoint()
    place = {v: (c, p) for v, c, p, _ in variants}
    expected = {(a, b) for a in place for b in place if place[a][0] == place[b][0] and (place[a][1], a) < (place[b][1], b)
                and place[b][1] - place[a][1] <= 300 and r2(g[a], g[b]) >= 0.2}
    for block in (30, 300, 5_000):
        pairs = linkage.ld_pairs(packed, "v", 0.2, "pos", block, 300, strict=False)
        rows = [(r.left, r.right) for r in pairs.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == expected


@pytest.mark.parametrize("per_batch, cells", [(10_000, 1 << 22), (7, 16)])
def test_pairs_of_many_small_blocks_in_one_call(spark, monkeypatch, per_batch, cells):
    """Blocks that end in and reach over Arrow batches; a block is no Python call of its own."""
    calls, samples, table, variants, g = cohort(spark)
    monkeypatch.setattr(linkage, "CELLS", cells)
    packed = linkage.packed_variants(calls, samples, table, "v", "s", "d")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(per_batch))
    try:
        pairs = linkage.ld_pairs(packed, "v", 0.05, "pos", 30, 75, strict=False)
        assert "FlatMapGroupsInPandas" not in pairs._jdf.queryExecution().executedPlan().toString()
        got = sorted((r.chrom, r.left, r.right, round(r.r2, 9)) for r in pairs.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    exp = []
    for a, ca, pa, _ in variants:
        for b, cb, pb, _ in variants:
            if ca == cb and (pa, a) < (pb, b) and pb - pa <= 75 and r2(g[a], g[b]) >= 0.05:
                exp.append((ca, a, b, round(r2(g[a], g[b]), 9)))
    assert got == sorted(exp) and len(exp) > 20


def test_no_variants(spark):
    calls, samples, table, _, _ = cohort(spark, n_variants=6)
    packed = linkage.packed_variants(calls, samples, table.filter("1 = 0"), "v", "s", "d")
    assert linkage.ld_prune(packed, "v").count() == 0


def test_clumping_against_a_plain_loop(spark):
    rnd = random.Random(1)
    p = {(t, v): rnd.choice((1e-9, 1e-8, 2e-8, rnd.random() * 1e-7)) for t in "ab" for v in range(60)}
    edges = {(x, y) for x in range(60) for y in range(x) if rnd.random() < 0.08}
    leads = set()
    for t in "ab":
        claimed = set()
        for _, v in sorted((p[t, v], v) for v in range(60)):
            if v not in claimed:
                leads.add((t, v))
                claimed |= {y for x, y in edges if x == v} | {x for x, y in edges if y == v}
    cand = spark.createDataFrame([(t, v, x) for (t, v), x in p.items()], "trait string, v long, p double")
    e = spark.createDataFrame([e if rnd.random() < 0.5 else e[::-1] for e in edges], "left long, right long")
    got = linkage.clump(e, cand, ["trait"], "v", "p")
    assert {(r.trait, r.v) for r in got.collect()} == leads and got.columns == cand.columns
    assert linkage.clump(e.filter("1 = 0"), cand, ["trait"], "v", "p").count() == 120


@pytest.mark.parametrize("extra", [22, 6])
def test_components_against_svd(spark, extra):
    calls, samples, table, variants, g = cohort(spark, n_variants=60, n_samples=30)
    n = samples.selectExpr("count(1) as _n_samples")
    qc = linkage.sparse_variant_qc(calls, "v", "d", n, min_call_rate=0.5).filter("maf > 0")
    pcs, values = linkage.genotype_components(calls, samples, qc, "v", "s", "d", k=3, extra=extra, tolerance=1e-9, max_rounds=60)
    used = {r.v: r.alt / (2 * r.called) for r in qc.collect()}
    z = np.array([[0 if x is None else (x - 2 * f) / np.sqrt(2 * f * (1 - f)) for x in g[v]] for v, f in sorted(used.items())])
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    assert np.allclose([v for v, _ in values], s[:3] ** 2 / len(z), rtol=1e-5)
    assert np.allclose([v for _, v in values], s[:3] ** 2 / (s ** 2).sum(), rtol=1e-5)
    got = pcs.toPandas().sort_values("s")[["pc1", "pc2", "pc3"]].to_numpy()
    for j in range(3):
        want = vt[j] * np.sign(vt[j][np.abs(vt[j]).argmax()])
        assert np.abs(got[:, j] - want).max() < 1e-2


def test_feature_matrix_of_one_annotated_variant(spark):
    row = spark.createDataFrame([("p1", "1:100:A:T", "1:100", "T", "missense_variant", "MODERATE", "APOE", 25.0, 0.001,
                                  "pathogenic", 0.02, 0.85), ("p1", "x", "bad", None, None, None, None, 99.0, None, "?", None, None)],
                                "patient_id string, variant_id string, Location string, Allele string, Consequence string, "
                                "IMPACT string, SYMBOL string, CADD_PHRED double, gnomADg_AF double, ClinVar_CLNSIG string, "
                                "SIFT double, PolyPhen double")
    prs = spark.createDataFrame([("p1", 0.1, 0.2, -0.1)], "patient_id string, prs_ad double, prs_pd double, prs_als double")
    out = genomics.variant_feature_matrix(row, prs)
    assert len(out.columns) == 2 + 16
    a, b = out.orderBy("variant_id").collect()
    assert tuple(a)[2:] == ("APOE", "1", 100, "T", "T", 3, 1, 0.5, 0.001, 2, 0.02, 0.85, 0.0, 0.1, 0.2, -0.1)
    assert tuple(b)[2:] == ("UNK", "bad", 0, "N", "N", 0, -1, 1.0, 0.0, 0, 0.5, 0.5, 0.0, 0.1, 0.2, -0.1)
    bare = genomics.variant_feature_matrix(row.select("patient_id"), prs.select("patient_id"))
    assert bare.count() == 2 and len(bare.columns) == 18
