"""Calibration, grouped fits, greedy selection and peaks against plain NumPy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import clinlake.plans.prefix as prefix
from clinlake.functions.exprs import hash_normal
from clinlake.operators import evaluate, graph, grouped_fit, isotonic, models, signal


def plain_isotonic(points):
    """points: (score, label); the fit of each distinct score."""
    xs = sorted({p for p, _ in points})
    blocks = [[sum(y for p, y in points if p == x), sum(1 for p, _ in points if p == x), [x]] for x in xs]
    i = 0
    while i + 1 < len(blocks):
        if blocks[i][0] / blocks[i][1] >= blocks[i + 1][0] / blocks[i + 1][1]:
            blocks[i] = [a + b for a, b in zip(blocks[i], blocks.pop(i + 1))]
            i = max(0, i - 1)
        else:
            i += 1
    return {x: s / n for s, n, group in blocks for x in group}


@pytest.mark.parametrize("bucket, falling", [(4_000_000, False), (7, False), (3, True), (40, True)])
def test_isotonic_fit_is_exact(spark, bucket, falling):
    """Also where all buckets end up in one block (a label that falls with the score)."""
    rnd = random.Random(6)
    rows = []
    for i in range(400):
        p = round(rnd.random(), 2)
        rows.append((i, "a" if i % 3 == 0 else rnd.choice("bc"), p, int(rnd.random() < ((1 - p) if falling else p))))
    rows += [(400, "a", None, 1), (401, "a", float("nan"), 0), (402, "b", 0.5, None), (403, None, 0.2, 1), (404, None, 0.1, 1)]
    df = spark.createDataFrame(rows, "id int, g string, p double, y int").repartition(3)
    out = isotonic.isotonic_by_group(df, "g", "p", "y", rows_per_bucket=bucket).collect()
    assert len(out) == len(rows)
    fits = {g: plain_isotonic([(p, y) for _, h, p, y in rows if h == g and p is not None and p == p and y is not None])
            for g in ("a", "b", "c", None)}
    for r in out:
        want = fits[r.g].get(r.p) if r.p is not None and r.p == r.p else None
        assert r.p_isotonic is None if want is None else abs(r.p_isotonic - want) < 1e-12


def test_group_thresholds_and_fallback(spark):
    rnd = np.random.default_rng(2)
    rows = [("big", p, int(rnd.random() < p)) for p in rnd.random(200).round(3)] + \
           [("one", p, 0) for p in rnd.random(30).round(3)] + [("few", p, 1) for p in rnd.random(5).round(3)]
    df = spark.createDataFrame([(g, float(p), y) for g, p, y in rows], "g string, p double, y int")
    limits, _ = isotonic.group_thresholds(df, "g", "p", "y")
    got = {r.g: r for r in limits.collect()}
    assert set(got) == {"big", "one"} and got["one"].threshold == 0.5 and got["one"].specificity == 1.0
    p, y = (np.array(x) for x in zip(*[(p, y) for g, p, y in rows if g == "big"]))
    cuts = sorted(set(p), reverse=True)
    j = [((p >= c) & (y == 1)).sum() / (y == 1).sum() - ((p >= c) & (y == 0)).sum() / (y == 0).sum() for c in cuts]
    fit = plain_isotonic(list(zip(p, y)))
    rate = np.mean([y for _, _, y in rows])
    level = sorted((fit[x] for x in p), reverse=True)[max(1, min(int(rate * 200), 199))]
    assert got["big"].threshold == round(0.5 * cuts[int(np.argmax(j))] + 0.5 * level, 4)
    whole = (got["big"].threshold + 0.5) / 2
    out = isotonic.fair_predictions(df, "g", "p", "y").collect()
    for r in out:
        limit = {"big": got["big"].threshold, "one": 0.5, "few": whole}[r.g]
        value = fit[r.p] if r.g == "big" else r.p
        assert abs(r.threshold - limit) < 1e-12 and r.prediction == int(value >= limit)
    assert len(out) == len(rows)


def test_grouped_logistic_against_newton(spark):
    """More groups than any bound of old, a hot one, a separable one, skipped ones."""
    rnd = np.random.default_rng(3)
    rows = []
    for g in range(120):
        n = 400 if g == 0 else 5 if g == 1 else 30
        x = rnd.normal(size=(n, 2)) * [1, 50] + [0, 100]
        y = (rnd.random(n) < 1 / (1 + np.exp(-(x[:, 0] - (x[:, 1] - 100) / 60)))).astype(int)
        if g == 2:
            y = (x[:, 0] > 0).astype(int)
        if g == 3:
            y[:] = 1
        rows += [(g, float(a), float(b), int(c)) for (a, b), c in zip(x, y)]
    df = spark.createDataFrame(rows + [(4, None, 1.0, 1), (4, 1.0, 1.0, None)], "g int, a double, b double, y int").repartition(4)
    models = grouped_fit.grouped_logistic(df, "g", ["a", "b"], "y")
    got = {r.g: r for r in models.collect()}
    assert set(got) == set(range(120)) - {1, 3}
    scored = grouped_fit.grouped_scores(df, models, "g", ["a", "b"], "p")
    by_row = {(r.g, r.a, r.b): r.p for r in scored.collect()}
    for g in (0, 5, 77):
        x = np.array([(a, b) for h, a, b, _ in rows if h == g])
        y = np.array([c for h, _, _, c in rows if h == g])
        z = np.column_stack([np.ones(len(x)), (x - x.mean(0)) / x.std(0)])
        beta = np.zeros(3)
        for _ in range(40):
            p = 1 / (1 + np.exp(-z @ beta))
            ridge = 1e-6 * np.array([0, 1, 1])
            beta += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * beta)
        assert np.allclose(got[g].beta, beta, atol=1e-6)
        assert all(abs(by_row[g, a, b] - v) < 1e-6 for (a, b), v in zip(x, 1 / (1 + np.exp(-z @ beta))))
    assert scored.filter("g in (1, 3)").filter("p is not null").count() == 0


def test_bootstrap_effects(spark):
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(3_000, 2))
    rows = [(i, float(a), float(b), float(2 * a - b + e)) for i, ((a, b), e) in enumerate(zip(x, rnd.normal(size=3_000)))]
    df = spark.createDataFrame(rows, "id int, t double, c double, y double")
    one = sorted(map(tuple, grouped_fit.bootstrap_effects(df.repartition(1), "y", "t", ["c"], ["id"], replicas=50).collect()))
    many = sorted(map(tuple, grouped_fit.bootstrap_effects(df.repartition(7), "y", "t", ["c"], ["id"], replicas=50).collect()))
    assert [r for r, _ in one] == list(range(50)) and np.allclose(one, many)
    effects = np.array([e for _, e in one])
    assert abs(effects.mean() - 2) < 0.05 and 0.01 < effects.std() < 0.03  # 1 / sqrt(3000) = 0.018
    w = grouped_fit.poisson_replicas(df, ["id"], 12, 7).groupBy("replica").agg(F.avg("w"), F.var_pop("w")).collect()
    assert len(w) == 12 and all(abs(r[1] - 1) < 0.1 and abs(r[2] - 1) < 0.15 for r in w)


def plain_peaks(x, distance):
    found, i = [], 1
    while i < len(x) - 1:
        if x[i - 1] < x[i]:
            j = i
            while j < len(x) - 1 and x[j + 1] == x[i]:
                j += 1
            if j < len(x) - 1 and x[j + 1] < x[i]:
                found.append((i + j) // 2)
                i = j
        i += 1
    keep = set(found)
    for p in sorted(found, key=lambda p: (x[p], p), reverse=True):
        if p in keep:
            keep -= {q for q in keep if q != p and abs(q - p) < distance}
    return sorted(keep)


@pytest.mark.parametrize("bucket, distance", [(4_000_000, 10), (23, 10), (7, 3), (11, 1), (5, 60)])
def test_peaks_against_a_plain_loop(spark, monkeypatch, bucket, distance):
    """Plateaus and neighbourhoods that span many buckets."""
    monkeypatch.setattr(prefix, "ROWS_PER_BUCKET", bucket)
    rnd = random.Random(8)
    series = {"hot": [rnd.randrange(6) for _ in range(500)], "flat": [1] * 60, "ramp": list(range(40)), "one": [3],
              "steps": [0] + [2] * 30 + [1] + [2] * 31 + [0], "wave": [abs(i % 14 - 7) for i in range(200)]}
    rows = [(k, t, float(v)) for k, xs in series.items() for t, v in enumerate(xs)]
    df = spark.createDataFrame(rows + [("wave", 500, None), ("wave", 501, float("nan"))], "k string, t int, v double").repartition(3)
    got = {}
    for r in signal.peaks(df, ["k"], ["t"], "v", distance).collect():
        got.setdefault(r.k, []).append(r.pos)
        assert r.height == series[r.k][r.pos]
    for k, xs in series.items():
        assert sorted(got.get(k, [])) == plain_peaks(xs, distance)


def test_pagerank_with_cycles_and_dangling_nodes(spark):
    rnd = random.Random(5)
    edges = {(rnd.randrange(40), rnd.randrange(60)) for _ in range(150)} | {(1, 1), (2, 3), (3, 2)}
    nodes = sorted({v for e in edges for v in e})
    out = {v: [d for s, d in edges if s == v] for v in nodes}
    for rounds in (0, 1, 20):
        r = {v: 1 / len(nodes) for v in nodes}
        for _ in range(rounds):
            lost = sum(r[v] for v in nodes if not out[v])
            new = {v: 0.15 / len(nodes) + 0.85 * lost / len(nodes) for v in nodes}
            for v in nodes:
                for d in out[v]:
                    new[d] += 0.85 * r[v] / len(out[v])
            r = new
        df = spark.createDataFrame(list(edges) + [(2, 3)], "src int, dst int")
        got = {x.node: x["rank"] for x in graph.pagerank(df, iterations=rounds).collect()}
        assert set(got) == set(r) and all(abs(got[v] - r[v]) < 1e-12 for v in r)


def test_multiclass_classifier_on_separable_classes(spark):
    """A class with a third of the rows and a rare one; the weights keep the rare one in."""
    rnd = np.random.default_rng(7)
    rows = []
    for c, n in (("a", 200), ("b", 190), ("c", 190), ("rare", 20)):
        centre = np.eye(4)["abcr".index(c[0])] * 4
        rows += [(len(rows) + i, c, (centre + rnd.normal(size=4)).tolist()) for i in range(n)]
    df = spark.createDataFrame(rows + [(9_999, None, [4.0, 0.0, 0.0, 0.0]), (10_000, "a", None)], "id int, c string, x array<double>")
    scored, importance = models.multiclass_classifier(df, "x", "c", F.col("id") % 3 != 0)
    out = {r.id: r for r in scored.collect()}
    assert len(out) == 601 and out[9_999].predicted == "a" and all(abs(sum(r.probability) - 1) < 1e-9 for r in out.values())
    held = [r for r in out.values() if r.id % 3 == 0 and r.c]
    assert np.mean([r.predicted == r.c for r in held]) > 0.95 and all(r.predicted == "rare" for r in held if r.c == "rare")
    auc = evaluate.macro_auc_ovr(scored.filter("id % 3 = 0 and c is not null"), "c", "probability", "classes").first()
    assert auc.classes == 4 and auc.macro_auc > 0.98
    shares = importance.collect()
    assert abs(sum(r.importance for r in shares) - 1) < 1e-9 and [r["rank"] for r in shares] == [1, 2, 3, 4]


def test_iterative_imputation(spark):
    rnd = np.random.default_rng(9)
    x = rnd.normal(size=600)
    rows = [(i, float(a), float(2 * a + 1), float(-a)) for i, a in enumerate(x)]
    gaps = [(i, a, None if i % 5 == 0 else b, float("nan") if i % 7 == 0 else c) for i, a, b, c in rows]
    df = spark.createDataFrame(gaps, "id int, a double, b double, c double")
    out = {r.id: r for r in grouped_fit.iterative_impute(df, ["a", "b", "c"], 10).collect()}
    assert all(abs(out[i].b - b) < 1e-6 and abs(out[i].c - c) < 1e-6 for i, _, b, c in rows)
    none = df.withColumn("b", F.lit(None).cast("double"))
    assert grouped_fit.iterative_impute(none, ["a", "b"], 2).filter("b is not null").count() == 0


def test_rule_labels(spark):
    rows = [(1, 85.0, 10.0, 1.0, 1.0, 0.0), (2, 25.0, 30.0, 0.0, 0.0, 1.0), (3, None, float("nan"), None, None, None)]
    df = spark.createDataFrame(rows, "id int, Age double, MMSE double, MemoryComplaints double, FamilyHistoryAlzheimers double, Depression double")
    out = {r.id: r for r in models.rule_labels(df).collect()}
    assert out[1].rule_label == "Alzheimer's Disease" and abs(out[1].rule_score - (0.15625 + 0.7 / 3 + 0.35 + 0.02)) < 1e-12
    assert out[2].rule_label == "Multiple Sclerosis"
    best = max(models.RULE_SCORES, key=lambda d: sum(
        {"above": max(models.RULE_DEFAULTS[f] - b, 0) / s, "below": max(b - models.RULE_DEFAULTS[f], 0) / s,
         "flag": models.RULE_DEFAULTS[f]}[k] * w for f, k, b, s, w in models.RULE_SCORES[d]))
    assert out[3].rule_label == best
    noisy = [models.rule_labels(df.repartition(n), ["id"]).orderBy("id").collect() for n in (1, 3)]
    assert noisy[0] == noisy[1] and all(0 <= n.rule_score - out[n.id].rule_score <= 0.05 for n in noisy[0] if n.id == 1)


def test_normal_cdf(spark):
    import math
    xs = [-6.0, -2.5, -1.0, -0.1, 0.0, 0.3, 1.96, 5.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", evaluate.normal_cdf(F.col("x")).alias("p")).collect()
    assert all(abs(r.p - 0.5 * (1 + math.erf(r.x / math.sqrt(2)))) < 2e-7 for r in got)


def test_surrogate_fits_from_sums(spark):
    """One row of sums a row is shuffled, no group of perturbations; equal to a fit of each group."""
    df = spark.createDataFrame([(1, 0.5, -1.0), (2, 2.0, 0.25), (None, 1.0, 1.0)], "id long, a double, b double")
    got = models.local_surrogate(df, "id", ["a", "b"], models.linear_logistic({"a": 0.9, "b": -0.4}), n_perturb=50)
    assert "FlatMapGroups" not in got._jdf.queryExecution().optimizedPlan().toString()
    out = {(r.id, r.feature): (r.weight, r["rank"]) for r in got.collect()}
    noise = df.crossJoin(spark.range(1, 51).select(F.col("id").cast("int").alias("i"))).select(
        "id", "a", "b", *[(hash_normal(42 + j, F.col("id"), F.col("i")) * 0.3).alias(f"d{j}") for j in range(2)]).toPandas()
    for (a, b), g in noise.groupby(["a", "b"]):
        x = np.vstack([[0.0, 0.0], g[["d0", "d1"]].to_numpy()])
        y = 1 / (1 + np.exp(-(0.9 * (a + x[:, 0]) - 0.4 * (b + x[:, 1]))))
        w = np.exp(-(x ** 2).sum(1) / (2 * 2 * 0.75 ** 2))
        xc, yc = x - np.average(x, axis=0, weights=w), y - np.average(y, weights=w)
        coef = np.linalg.solve((xc * w[:, None]).T @ xc + np.eye(2), (xc * w[:, None]).T @ yc)
        i = None if np.isnan(g["id"].iloc[0]) else int(g["id"].iloc[0])
        for k, f in enumerate("ab"):
            assert abs(out[i, f][0] - coef[k]) < 1e-9 and out[i, f][1] == 1 + (abs(coef[1 - k]) > abs(coef[k]))


def test_bootstrap_sums_without_repeated_rows(spark):
    df = spark.range(300).select("id", (F.col("id") % 7).cast("double").alias("x"), F.lit(1.0).alias("one")).repartition(3)
    got = grouped_fit.poisson_moments(df, ["id"], ["x", "one"], 20, 7)
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    exp = grouped_fit.poisson_replicas(df, ["id"], 20, 7).groupBy("replica").agg(
        F.sum(F.col("w") * F.col("x")).alias("x"), F.sum("w").alias("one")).collect()
    assert {r.replica: tuple(r.m) for r in got.collect()} == {r.replica: (r.x, r.one) for r in exp}
