"""Exact isotonic calibration and group thresholds.

The isotonic fit of a group is made of blocks of neighbouring scores.  Rows are
reduced to (group, score) counts; range buckets of these are pooled side by
side (pool adjacent violators), and while the last block of a bucket lies above
the first of the next one, the two buckets are pooled together.  Pooling inside a
range never changes what pooling over all of it gives, so the result is exact;
a task holds two buckets, and no scores are binned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clinlake.operators.evaluate import youden
from clinlake.plans.broadcast import bounded_broadcast, runtime_sized
from clinlake.plans.prefix import bucket_column, running_sum
from clinlake.session import checkpoint_dir

#: Groups below this size keep no threshold of their own.
MIN_GROUP = 20


def pooled(total: np.ndarray, weight: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of the blocks after pooling adjacent violators of total / weight."""
    blocks: list[list[float]] = []
    for i, (t, w) in enumerate(zip(total, weight)):
        blocks.append([t, w, i, i + 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            t2, w2, _, end = blocks.pop()
            blocks[-1][0] += t2
            blocks[-1][1] += w2
            blocks[-1][3] = end
    return [(int(b[2]), int(b[3])) for b in blocks]


def isotonic_blocks(df: DataFrame, group: str, score: str, label: str, rows_per_bucket: int | None = None
                    ) -> tuple[DataFrame, DataFrame]:
    """(scores, blocks): (_g, s, n, pos, bucket) per group and distinct score, and the blocks
    (_g, lo, hi, n, pos, first, last) of the fit, which is pos / n from score lo to hi;
    first and last are the buckets that a block spans.  Null and NaN scores, and
    null labels, are left out."""
    checkpoint_dir(df.sparkSession)
    s = F.col(score).cast("double")
    rows = df.filter(s.isNotNull() & ~F.isnan(s) & F.col(label).isNotNull()).select(F.col(group).alias("_g"), s.alias("s"), F.col(label).alias("y"))
    bucket = bucket_column(rows, ["_g", "s"], rows_per_bucket=rows_per_bucket)
    scores = rows.groupBy("_g", "s").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("double")).alias("pos")) \
        .withColumn("bucket", bucket.cast("int")).checkpoint()
    kind = df.schema[group].dataType.simpleString()
    schema = f"_g {kind}, lo double, hi double, n long, pos double, first int, last int"

    def pool(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lo", ignore_index=True)
        spans = pooled(pdf["pos"].to_numpy(), pdf["n"].to_numpy())
        a, b = [x for x, _ in spans], [y - 1 for _, y in spans]
        return pd.DataFrame({"_g": pdf["_g"].iloc[0], "lo": pdf["lo"].to_numpy()[a], "hi": pdf["hi"].to_numpy()[b],
                             "n": np.add.reduceat(pdf["n"].to_numpy(), a), "pos": np.add.reduceat(pdf["pos"].to_numpy(), a),
                             "first": pdf["first"].to_numpy()[a], "last": pdf["last"].to_numpy()[b]})
    single = scores.select("_g", F.col("s").alias("lo"), F.col("s").alias("hi"), "n", "pos", F.col("bucket").alias("first"),
                           F.col("bucket").alias("last"), F.col("bucket").alias("b"))
    blocks = single.groupBy("_g", "b").applyInPandas(pool, schema).checkpoint()
    order = Window.partitionBy("_g").orderBy("b")  # one row a bucket
    mean = F.col("pos") / F.col("n")
    while True:
        # a block belongs to the bucket where it begins; a bucket joins the next one that has blocks, if they violate
        ends = blocks.groupBy("_g", F.col("first").alias("b")).agg(F.min_by(mean, "lo").alias("begin"), F.max_by(mean, "lo").alias("end"))
        ends = ends.withColumn("clash", F.coalesce(F.col("end") >= F.lead("begin").over(order), F.lit(False)))
        ends = ends.withColumn("at", F.row_number().over(order)).withColumn(
            "pair", F.col("clash") & (~F.coalesce(F.lag("clash").over(order), F.lit(False)) | (F.col("at") % 2 == 1)))
        # of neighbouring pairs one waits: a bucket is the left or the right half of one pair at most
        ends = ends.withColumn("left", F.col("pair") & ~(F.coalesce(F.lag("pair").over(order), F.lit(False)) & (F.col("at") % 2 == 0)))
        ends = ends.withColumn("right", F.coalesce(F.lag("left").over(order), F.lit(False)) & ~F.col("left"))
        told = ends.select(F.col("_g").alias("_t"), "b", F.when(F.col("left"), F.col("b")).when(
            F.col("right"), F.lag("b").over(order)).alias("to")).filter("to is not null").checkpoint()
        if told.isEmpty():
            return scores, blocks
        same = (F.col("_g").eqNullSafe(F.col("_t"))) & (F.col("first") == F.col("b"))
        moved = blocks.join(runtime_sized(told), same).drop("_t", "b")
        stay = blocks.join(runtime_sized(told), same, "left_anti")
        blocks = stay.unionByName(moved.groupBy("_g", "to").applyInPandas(pool, schema)).checkpoint()


def isotonic_fit(df: DataFrame, group: str, score: str, label: str, rows_per_bucket: int | None = None
                 ) -> tuple[DataFrame, DataFrame]:
    """(fit, blocks): the calibrated value ``fit`` of each (_g, s) that occurs, and the blocks."""
    scores, blocks = isotonic_blocks(df, group, score, label, rows_per_bucket)
    spread = blocks.select("_g", "lo", "hi", (F.col("pos") / F.col("n")).alias("fit"),
                           F.explode(F.sequence("first", "last")).alias("b"))
    kind = df.schema[group].dataType.simpleString()

    def look_up(s: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("lo")
        at = np.searchsorted(b["lo"].to_numpy(), s["s"].to_numpy(), side="right") - 1
        return pd.DataFrame({"_g": s["_g"], "s": s["s"], "n": s["n"], "fit": b["fit"].to_numpy()[at]})
    fit = scores.groupBy("_g", "bucket").cogroup(spread.groupBy("_g", "b")).applyInPandas(
        look_up, f"_g {kind}, s double, n long, fit double")
    return fit, blocks


def isotonic_by_group(df: DataFrame, group: str, score: str, label: str, out: str = "p_isotonic",
                      rows_per_bucket: int | None = None) -> DataFrame:
    """``df`` with the isotonic fit of the label on the score within the row's group."""
    fit, _ = isotonic_fit(df, group, score, label, rows_per_bucket)
    f = fit.select("_g", F.col("s").alias("_s"), F.col("fit").alias(out))
    return df.join(f, F.col(group).eqNullSafe(F.col("_g")) & (F.col(score).cast("double") == F.col("_s")), "left").drop("_g", "_s")


def group_thresholds(df: DataFrame, group: str, score: str, label: str, min_group: int = MIN_GROUP,
                     rows_per_bucket: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(thresholds, fit).  Per group with ``min_group`` rows: the mean of the Youden
    threshold of the raw scores and the calibrated score at the place where the
    whole table's positive rate cuts the group; 0.5 where a group has one class.
    ``global_threshold`` (on every row) is their mean, for all other groups."""
    s = F.col(score).cast("double")
    rows = df.filter(s.isNotNull() & ~F.isnan(s) & F.col(label).isNotNull())
    fit, blocks = isotonic_fit(rows, group, score, label, rows_per_bucket)
    y = F.col(label).cast("double")
    rate = rows.agg(F.avg(y).alias("rate"))
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("size"), F.sum(y).alias("positives")).filter(F.col("size") >= min_group)
    sizes = sizes.crossJoin(bounded_broadcast(rate)).withColumn(
        "cut", F.greatest(F.lit(1), F.least(F.floor(F.col("rate") * F.col("size")), F.col("size") - 1)))
    # the blocks of a group from the highest down; blocks differ in their fit
    own = blocks.select(F.col("_g").alias(group), (-F.col("lo")).alias("neg"), F.col("n").alias("held"), "pos")
    down = running_sum(own, [group], ["neg"], ["held"], ["upto"], rows_per_bucket)
    level = down.join(runtime_sized(sizes.select(group, "cut")), group).filter(
        (F.col("upto") > F.col("cut")) & (F.col("upto") - F.col("held") <= F.col("cut"))).select(
        group, (F.col("pos") / F.col("held")).alias("level"))
    best = youden(rows, [group], label, score).select(group, F.col("threshold").alias("base"), "tpr", "fpr")
    one_class = (F.col("positives") == 0) | (F.col("positives") == F.col("size"))
    out = sizes.join(level, group, "left").join(best, group, "left").select(
        group, F.col("size").alias("n"),
        F.when(one_class, 0.5).otherwise(F.round(0.5 * F.col("base") + 0.5 * F.col("level"), 4)).alias("threshold"),
        F.when(one_class, 0.0).otherwise(F.round("tpr", 4)).alias("sensitivity"),
        F.when(one_class, 1.0).otherwise(F.round(1 - F.col("fpr"), 4)).alias("specificity"))
    return out.crossJoin(bounded_broadcast(out.agg(F.avg("threshold").alias("global_threshold")))), fit


def fair_predictions(df: DataFrame, group: str, score: str, label: str, min_group: int = MIN_GROUP,
                     rows_per_bucket: int | None = None) -> DataFrame:
    """``df`` with p_isotonic (groups of one class or too few rows keep their scores),
    threshold and prediction: the calibrated score against the group's threshold, or
    the global one."""
    limits, fit = group_thresholds(df, group, score, label, min_group, rows_per_bucket)
    limits = limits.checkpoint()
    whole = limits.agg(F.max("global_threshold").alias("_all"))
    both = df.filter(F.col(label).isNotNull()).groupBy(group).agg(F.countDistinct(label).alias("_k"))
    known = limits.join(both, group).select(F.col(group).alias("_g"), F.col("threshold").alias("_t"), (F.col("_k") > 1).alias("_own"))
    f = fit.select(F.col("_g").alias("_fg"), F.col("s").alias("_s"), F.col("fit").alias("_fit"))
    s = F.col(score).cast("double")
    j = df.join(runtime_sized(known), F.col(group).eqNullSafe(F.col("_g")), "left").crossJoin(bounded_broadcast(whole))
    j = j.join(f, F.col(group).eqNullSafe(F.col("_fg")) & (s == F.col("_s")), "left")
    p = F.when(F.col("_own"), F.col("_fit")).otherwise(s)
    limit = F.coalesce("_t", "_all")
    return j.select(*df.columns, p.alias("p_isotonic"), limit.alias("threshold"), (p >= limit).cast("int").alias("prediction"))
