"""Skew-safe plan shapes against brute force, with a hot key forced over many buckets."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from clinlake.operators.retrieval import top_k_per_group
from clinlake.plans.prefix import dense_codes, row_index, running_sum
from clinlake.plans.quantile import exact_quantiles


def _hot_frame(spark, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    # key 0 holds a third of the rows
    keys = np.where(rng.random(n) < 1 / 3, 0, rng.integers(1, 20, n))
    pdf = pd.DataFrame({"k": keys.astype("int64"), "t": np.arange(n, dtype="int64"),
                        "v": rng.normal(size=n).round(3)})
    return spark.createDataFrame(pdf), pdf


def test_running_sum_matches_cumsum(spark):
    df, pdf = _hot_frame(spark)
    out = running_sum(df, ["k"], ["t"], ["v"], ["cv"], rows_per_bucket=100).toPandas()
    exp = pdf.sort_values(["k", "t"]).assign(cv=lambda d: d.groupby("k")["v"].cumsum())
    got = out.sort_values(["k", "t"])
    assert len(got) == len(exp)
    assert np.allclose(got["cv"].to_numpy(), exp["cv"].to_numpy())


def test_row_index_global_and_keyed(spark):
    df, pdf = _hot_frame(spark)
    g = row_index(df, [], ["t"], "rn", rows_per_bucket=97).toPandas().sort_values("t")
    assert g["rn"].tolist() == list(range(1, len(pdf) + 1))
    k = row_index(df, ["k"], ["t"], "rn", rows_per_bucket=97).toPandas().sort_values(["k", "t"])
    exp = pdf.sort_values(["k", "t"]).groupby("k").cumcount() + 1
    assert k["rn"].tolist() == exp.tolist()


def test_exact_quantiles_match_numpy(spark):
    df, pdf = _hot_frame(spark)
    q = exact_quantiles(df, ["k"], "v", [0.1, 0.5, 0.9], ["a", "b", "c"]).toPandas().set_index("k")
    for key, grp in pdf.groupby("k"):
        exp = np.percentile(grp["v"], [10, 50, 90])
        assert np.allclose(q.loc[key, ["a", "b", "c"]].to_numpy(dtype=float), exp)


def test_dense_codes_sorted(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "x string")
    codes = {r.x: r.code for r in dense_codes(df, "x").collect()}
    assert codes == {"a": 0, "b": 1, "c": 2}


def test_top_k_per_group_two_phase(spark):
    df, pdf = _hot_frame(spark)
    top = top_k_per_group(df, ["k"], [F.col("v").desc(), F.col("t")], 5, salt_of=F.xxhash64("t"), salts=8).toPandas()
    exp = pdf.sort_values(["k", "v", "t"], ascending=[True, False, True]).groupby("k").head(5)
    assert sorted(zip(top["k"], top["t"])) == sorted(zip(exp["k"], exp["t"]))


def test_null_and_nan_keys_under_any_buckets_and_partitions(spark, monkeypatch):
    """Order keys with nulls and NaN: Spark's order, whatever the bucket size and partitioning."""
    import random

    import clinlake.plans.prefix as prefix
    from clinlake.operators import evaluate
    rnd = random.Random(4)
    rows = [(i, i % 2 if rnd.random() < 0.8 else 1 - i % 2,
             None if i % 9 == 0 else float("nan") if i % 31 == 0 else round(rnd.random() + (i % 2) * 0.2, 2))
            for i in range(400)]
    df = spark.createDataFrame(rows, "id int, y int, p double")
    results = []
    for per_bucket in (4_000_000, 20):
        monkeypatch.setattr(prefix, "ROWS_PER_BUCKET", per_bucket)
        for parts in (1, 3, 16):
            d = df.repartition(parts)
            index = {r["id"]: r["at"] for r in prefix.row_index(d, [], ["p", "id"], "at").collect()}
            single = prefix.row_index(d.groupBy("p").count(), [], ["p"], "at").collect()
            auc = evaluate.roc_auc(d, [], "y", "p").first()
            best = evaluate.youden(d, [], "y", "p").first()
            sets = [tuple(r) for r in evaluate.conformal_lac(d, d, "y", "p", [0.1, 0.2]).orderBy("alpha").collect()]
            results.append((index, sorted((str(r["p"]), r["at"]) for r in single), tuple(auc), tuple(best), sets))
    assert all(r == results[0] for r in results)
    assert [i for i, _ in sorted(results[0][0].items(), key=lambda x: x[1])][:45] == [i for i in range(400) if i % 9 == 0]


def test_draws_do_not_depend_on_partitions(spark):
    from pyspark.sql import functions as F

    from clinlake.functions.exprs import hash_normal, hash_uniform
    df = spark.range(20_000).select("id", hash_uniform(3, F.col("id")).alias("u"), hash_normal(3, F.col("id")).alias("z"))
    a, b = (sorted(map(tuple, df.repartition(n).collect())) for n in (1, 7))
    assert a == b
    s = df.agg(F.avg("u"), F.stddev("u"), F.avg("z"), F.stddev("z")).first()
    assert abs(s[0] - 0.5) < 0.01 and abs(s[1] - 12 ** -0.5) < 0.01 and abs(s[2]) < 0.03 and abs(s[3] - 1) < 0.03


def test_group_statistics_are_broadcast(spark):
    """Few groups move no row of the data, whatever the optimizer knows of their size."""
    from clinlake.operators import impute
    df = spark.range(200).select("id", (F.col("id") % 2).alias("g"), F.when(F.col("id") % 4 > 1, F.col("id")).alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = impute.median_fill(df, ["v"], ["g"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        want = {0: float(np.median(np.arange(2, 200, 4))), 1: float(np.median(np.arange(3, 200, 4)))}
        assert all(r.v == (r.id if r.id % 4 > 1 else want[r.g]) for r in out.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_robustness_suite_computes_its_input_once(spark):
    from clinlake.operators import evaluate
    seen = spark.sparkContext.accumulator(0)

    def touch(x):
        seen.add(1)
        return x
    df = spark.range(300).select("id", F.udf(touch, "double")((F.col("id") * 7 % 101).cast("double")).alias("a"),
                                 (F.col("id") % 3 == 0).cast("int").alias("y"))
    out = evaluate.robustness_suite(df, "id", ["a"], "y", lambda x: x["a"] / 100).collect()
    assert seen.value == 300
    assert sorted(r.test for r in out) == ["baseline", "dropout_to_median", "gaussian_noise", "label_noise", "shift_a"]
    p, y = np.arange(300) * 7 % 101, np.arange(300) % 3 == 0
    auc = ((p[y][:, None] > p[~y]) + 0.5 * (p[y][:, None] == p[~y])).mean()
    assert all(abs(r.auc - auc) < 1e-12 and r.passed for r in out if r.test in ("baseline", "shift_a"))
