"""Linear and logistic fits of any number of groups at once.

A fit needs its normal equations only: sums of products of a few columns.  They are
grouped aggregates (partial sums per task, one small row a group), so all groups,
or all bootstrap replicas, share each pass over the rows; the equations of many
groups are then solved side by side.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinlake.functions.exprs import nan_to_null
from clinlake.operators.models import poisson_limits, poisson_one
from clinlake.plans.broadcast import bounded_broadcast, runtime_sized
from clinlake.session import checkpoint_dir

#: Newton steps, and the largest step of a coefficient that ends them.
MAX_STEPS, TOLERANCE = 30, 1e-9
#: Weight of the ridge that keeps separable groups finite.
RIDGE = 1e-6


def _products(columns: Sequence[str], weight: Column) -> list[Column]:
    """Sums of weight x column x column, for i <= j."""
    return [F.sum(weight * F.col(a) * F.col(b)).alias(f"a_{i}_{i + j}") for i, a in enumerate(columns)
            for j, b in enumerate(columns[i:])]


def _solve(moments: DataFrame, keep: Sequence[str], size: int, ridge: float, start: str | None = None) -> DataFrame:
    """beta of every row's equations (a_i_j, b_i): A beta = b, plus ``start``.  The ridge
    spares the first column (the intercept)."""
    kinds = ", ".join(f"`{c}` {moments.schema[c].dataType.simpleString()}" for c in keep)

    def solve(frames):
        for pdf in frames:
            if len(pdf):
                a = np.empty((len(pdf), size, size))
                for i in range(size):
                    for j in range(i, size):
                        a[:, i, j] = a[:, j, i] = pdf[f"a_{i}_{j}"]
                b = pdf[[f"b_{i}" for i in range(size)]].to_numpy(float)
                old = np.stack(pdf[start].to_numpy()) if start else np.zeros((len(pdf), size))
                push = ridge * (np.arange(size) > 0)
                a[:, np.arange(size), np.arange(size)] += push
                step = np.stack([np.linalg.lstsq(x, y, rcond=None)[0] for x, y in zip(a, b - push * old)])
                yield pdf[list(keep)].assign(beta=list(old + step), step=np.abs(step).max(axis=1))
    return moments.mapInPandas(solve, f"{kinds}, beta array<double>, step double")


def grouped_logistic(df: DataFrame, group: str, features: Sequence[str], label: str, min_rows: int = 10,
                     max_steps: int = MAX_STEPS) -> DataFrame:
    """(group, n, beta, mean, sd): a logistic regression per group by Newton's steps on
    standardised features; beta begins with the intercept.

    Groups with fewer than ``min_rows`` complete rows or one class are left out.  Rows with a
    missing feature or label take no part.  A step is one aggregate over the rows of all
    groups that still move."""
    checkpoint_dir(df.sparkSession)
    f = [F.col(c).cast("double") for c in features]
    rows = df.select(group, F.col(label).cast("double").alias("y"), *[c.alias(f"f{i}") for i, c in enumerate(f)]).dropna(
        subset=["y", *[f"f{i}" for i in range(len(features))]])
    names = [f"f{i}" for i in range(len(features))]
    size = len(names) + 1
    stats = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi"),
                                    F.array(*[F.avg(c) for c in names]).alias("mean"),
                                    F.array(*[F.stddev_pop(c) for c in names]).alias("sd"))
    stats = stats.filter((F.col("n") >= min_rows) & (F.col("lo") < F.col("hi"))).select(
        group, "n", "mean", F.transform("sd", lambda s: F.when(s > 0, s).otherwise(1.0)).alias("sd")).checkpoint()
    state = stats.select(group, F.array_repeat(F.lit(0.0), size).alias("beta"), F.lit(1.0).alias("step"))
    x = ["x0", *[f"x{i + 1}" for i in range(len(names))]]
    for _ in range(max_steps):
        moving = state.filter(F.col("step") > TOLERANCE)
        j = rows.join(runtime_sized(moving.join(stats, group)), group).select(
            group, "beta", "y", F.lit(1.0).alias("x0"),
            *[((F.col(c) - F.col("mean")[i]) / F.col("sd")[i]).alias(x[i + 1]) for i, c in enumerate(names)])
        eta = sum((F.col("beta")[i] * F.col(c) for i, c in enumerate(x[1:], 1)), F.col("beta")[0])
        j = j.withColumn("p", 1.0 / (1.0 + F.exp(-eta)))
        w = F.col("p") * (1.0 - F.col("p"))
        moments = j.groupBy(group).agg(F.first("beta").alias("beta"), *_products(x, w),
                                       *[F.sum((F.col("y") - F.col("p")) * F.col(c)).alias(f"b_{i}") for i, c in enumerate(x)])
        stepped = _solve(moments, [group], size, RIDGE, "beta")
        state = state.filter(F.col("step") <= TOLERANCE).unionByName(stepped.select(group, "beta", "step")).checkpoint()
        if state.filter(F.col("step") > TOLERANCE).isEmpty():
            break
    return state.select(group, "beta").join(stats, group).select(group, "n", "beta", "mean", "sd")


def grouped_scores(df: DataFrame, models: DataFrame, group: str, features: Sequence[str], out: str) -> DataFrame:
    """``df`` with the probability of its group's model (null: no model, or a missing feature)."""
    m = models.select(F.col(group).alias("_g"), "beta", "mean", "sd")
    eta = sum((F.col("beta")[i + 1] * (F.col(c).cast("double") - F.col("mean")[i]) / F.col("sd")[i]
               for i, c in enumerate(features)), F.col("beta")[0])
    return df.join(runtime_sized(m), F.col(group) == F.col("_g"), "left").withColumn(out, 1.0 / (1.0 + F.exp(-eta))).drop(
        "_g", "beta", "mean", "sd")


def poisson_replicas(df: DataFrame, key: Sequence[str], replicas: int, seed: int) -> DataFrame:
    """``df`` once per replica (0-based), with a Poisson(1) weight ``w`` that is a function of
    the row's ``key``: 16 bits of an MD5 digest of the key, the seed and a counter."""
    each = df.select("*", F.posexplode(F.array(*_digests(key, replicas, seed))).alias("_block", "_h")).withColumn("_d", F.explode(F.array(*map(F.lit, range(8)))))
    each = each.withColumn("replica", F.col("_block") * 8 + F.col("_d")).filter(F.col("replica") < replicas)
    bits = F.conv(F.substr("_h", F.col("_d") * 4 + 1, F.lit(4)), 16, 10).cast("double")
    return each.withColumn("w", poisson_one((bits + 0.5) / 65536.0).cast("double")).drop("_block", "_h", "_d")


def _digests(key: Sequence[str], replicas: int, seed: int) -> list[Column]:
    """MD5 digests of a row's key, the seed and a counter, one for eight replicas."""
    row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key])
    return [F.md5(F.concat_ws("|", row, F.lit(str(seed)), F.lit(str(i)))) for i in range(-(-replicas // 8))]


def poisson_moments(df: DataFrame, key: Sequence[str], columns: Sequence[str], replicas: int, seed: int) -> DataFrame:
    """(replica, m): the sums of weight x column for each of ``columns``, with the weights of
    ``poisson_replicas``.  A row is not repeated: a batch of rows gives its sums over all
    replicas in one product of matrices, and only these sums are shuffled."""
    limits = np.array(poisson_limits())
    weight_of = np.searchsorted(limits, (np.arange(65536) + 0.5) / 65536.0, side="right").astype(float)
    names = list(columns)

    def sums(frames):
        total = None
        for pdf in frames:
            if len(pdf):
                bits = np.frombuffer(b"".join(pdf["_bits"]), ">u2").reshape(len(pdf), -1)[:, :replicas]
                part = weight_of[bits].T @ pdf[names].to_numpy(dtype=float)
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"replica": np.arange(replicas, dtype=np.int32), "m": list(total)})

    parts = df.select(F.unhex(F.concat(*_digests(key, replicas, seed))).alias("_bits"), *names).mapInPandas(
        sums, "replica int, m array<double>")
    return parts.groupBy("replica").agg(F.array(*[F.sum(F.col("m")[i]) for i in range(len(names))]).alias("m"))


def bootstrap_effects(df: DataFrame, outcome: str, treatment: str, confounders: Sequence[str], key: Sequence[str],
                      replicas: int = 50, seed: int = 7) -> DataFrame:
    """(replica, effect): the treatment's coefficient in a least-squares fit with the
    confounders, for each of ``replicas`` Poisson bootstraps, all in one pass.

    ``key`` columns tell rows apart (they seed the weights).  Rows with a missing value take
    no part.  Values are centred by their means, so large sums lose no digits."""
    columns = [treatment, *confounders]
    rows = df.dropna(subset=[outcome, *columns])
    means = rows.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate([outcome, *columns])])
    centred = rows.crossJoin(bounded_broadcast(means)).select(
        F.array(*[F.col(c).cast("string") for c in key]).alias("key"), (F.col(outcome) - F.col("m0")).alias("y"),
        F.lit(1.0).alias("x0"), *[(F.col(c) - F.col(f"m{i + 1}")).alias(f"x{i + 1}") for i, c in enumerate(columns)])
    x = [f"x{i}" for i in range(len(columns) + 1)]
    terms = {f"a_{i}_{j}": F.col(x[i]) * F.col(x[j]) for i in range(len(x)) for j in range(i, len(x))}
    terms |= {f"b_{i}": F.col("y") * F.col(c) for i, c in enumerate(x)}
    rows = centred.select(F.array_join("key", "|", "").alias("key"), *[v.alias(c) for c, v in terms.items()])
    moments = poisson_moments(rows, ["key"], list(terms), replicas, seed).select(
        "replica", *[F.col("m")[i].alias(c) for i, c in enumerate(terms)])
    return _solve(moments, ["replica"], len(x), 0.0).select("replica", F.col("beta")[1].alias("effect"))


def iterative_impute(df: DataFrame, columns: Sequence[str], rounds: int = 10) -> DataFrame:
    """Round-robin regression imputation of ``columns``: missing cells (null, NaN) begin as
    the column's mean; in every round each incomplete column is fitted by least squares on
    the others over its observed rows, and its missing cells become the prediction.

    A fit is one aggregate (products of the columns); its few numbers go through the driver.
    The table is written once a round.  A column without any value stays null."""
    checkpoint_dir(df.sparkSession)
    seen = {c: f"_o{i}" for i, c in enumerate(columns)}
    cur = df.withColumns({o: nan_to_null(F.col(c).cast("double")) for c, o in seen.items()})
    first = cur.agg(*[F.avg(o).alias(o) for o in seen.values()], *[F.count_if(F.col(o).isNull()).alias(f"n{o}")
                                                                   for o in seen.values()]).first()
    cur = cur.withColumns({c: F.coalesce(F.col(o), F.lit(first[o])) for c, o in seen.items()}).checkpoint()
    gaps = [c for c in columns if first[f"n{seen[c]}"] and first[seen[c]] is not None]
    for _ in range(rounds):
        for c in gaps:
            x = [F.lit(1.0), *[F.col(o) for o in columns if o != c and first[seen[o]] is not None]]
            pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
            sums = cur.filter(F.col(seen[c]).isNotNull()).agg(*[F.sum(x[i] * x[j]).alias(f"a_{i}_{j}") for i, j in pairs],
                                                              *[F.sum(F.col(seen[c]) * v).alias(f"b_{i}") for i, v in enumerate(x)]).first()
            a = np.zeros((len(x), len(x)))
            for i, j in pairs:
                a[i, j] = a[j, i] = sums[f"a_{i}_{j}"]
            beta = np.linalg.lstsq(a, np.array([sums[f"b_{i}"] for i in range(len(x))]), rcond=None)[0]
            guess = sum((v * float(b) for v, b in zip(x[1:], beta[1:])), F.lit(float(beta[0])))
            cur = cur.withColumn(c, F.coalesce(F.col(seen[c]), guess))
        cur = cur.checkpoint()
    return cur.select(*df.columns)
