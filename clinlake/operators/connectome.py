"""Signal and connectome operators on a long table (scan, t, roi, value).

Region pairs are formed within one (scan, t) only, so the number of pairs per
row group is bounded by the atlas size (ROI count), not by the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clinlake.functions.exprs import equal_width_bin, pearson
from clinlake.plans.broadcast import bounded_broadcast, runtime_sized
from clinlake.plans.quantile import exact_quantiles
from clinlake.session import checkpoint_dir


def pair_correlations(long: DataFrame, scan: str, t: str, roi: str, value: str) -> DataFrame:
    """Pearson r per (scan, roi_i < roi_j) over the time points both regions have
    (null where one of them is constant there)."""
    a = long.select(F.col(scan).alias("scan"), F.col(t).alias("t"), F.col(roi).alias("roi_i"),
                    F.col(value).cast("double").alias("x"))
    b = long.select(F.col(scan).alias("scan"), F.col(t).alias("t"), F.col(roi).alias("roi_j"),
                    F.col(value).cast("double").alias("y"))
    j = a.join(b, ["scan", "t"]).filter(F.col("roi_i") < F.col("roi_j")).dropna(subset=["x", "y"])
    return j.groupBy("scan", "roi_i", "roi_j").agg(pearson("x", "y").alias("r"), F.count(F.lit(1)).alias("n"))


def proportional_threshold(edges: DataFrame, q: float = 0.85) -> DataFrame:
    """Keep |r| >= the per-scan q-quantile of the non-zero |r| (linear
    interpolation) and add reversed edges (symmetric edge list)."""
    # |r| to 9 decimals: r = +-1 from two points differs in the last bits between engines
    nz = edges.filter(F.col("r").isNotNull() & (F.col("r") != 0)).withColumn("_a", F.round(F.abs("r"), 9))
    cut = exact_quantiles(nz, ["scan"], "_a", [q], ["_cut"])
    kept = nz.join(runtime_sized(cut), "scan").filter(F.col("_a") >= F.col("_cut"))
    fwd = kept.select("scan", F.col("roi_i").alias("src"), F.col("roi_j").alias("dst"), "r")
    return fwd.unionByName(fwd.select("scan", F.col("dst").alias("src"), F.col("src").alias("dst"), "r"))


def population_edges(edges: DataFrame, importance: str, top_frac: float = 0.10,
                     min_share: float = 0.30) -> DataFrame:
    """Edges in each scan's top ``top_frac`` by |importance| (by rank), kept when
    present in at least ``min_share`` of scans; mean importance."""
    w = Window.partitionBy("scan").orderBy(F.abs(F.col(importance)).desc(), "roi_i", "roi_j")
    per = edges.withColumn("_rk", F.row_number().over(w)).withColumn(
        "_n", F.count(F.lit(1)).over(Window.partitionBy("scan")))
    top = per.filter(F.col("_rk") <= F.greatest(F.lit(1), F.floor(F.col("_n") * top_frac)))
    n_scans = edges.agg(F.countDistinct("scan").alias("_scans"))
    agg = top.groupBy("roi_i", "roi_j").agg(F.count(F.lit(1)).alias("n_scans"),
                                            F.avg(F.abs(importance)).alias("mean_importance"))
    j = agg.crossJoin(bounded_broadcast(n_scans))
    return j.filter(F.col("n_scans") >= F.lit(min_share) * F.col("_scans")).drop("_scans")


def otsu_threshold(values: DataFrame, value: str, n_bins: int = 128) -> DataFrame:
    """Otsu threshold: maximise between-class variance over an n-bin histogram
    of ``value``; the histogram is small (n rows), cumulative sums by window."""
    rng = values.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    b = values.crossJoin(bounded_broadcast(rng)).withColumn("bin", equal_width_bin(value, "lo", "hi", n_bins))
    h = b.groupBy("bin", "lo", "hi").agg(F.count(F.lit(1)).alias("c"))
    width = (F.col("hi") - F.col("lo")) / n_bins
    h = h.withColumn("center", F.col("lo") + (F.col("bin") + 0.5) * width)
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # n_bins rows only
    tot = Window.partitionBy()
    c = h.select("bin", "lo", "hi", "c", "center",
                 F.sum("c").over(w).alias("w0"), F.sum(F.col("c") * F.col("center")).over(w).alias("s0"),
                 F.sum("c").over(tot).alias("n"), F.sum(F.col("c") * F.col("center")).over(tot).alias("s"))
    w1 = F.col("n") - F.col("w0")
    m0 = F.col("s0") / F.col("w0")
    m1 = (F.col("s") - F.col("s0")) / w1
    between = F.when(w1 > 0, F.col("w0") * w1 * F.pow(m0 - m1, 2)).otherwise(F.lit(0.0))
    thr = F.col("lo") + (F.col("bin") + 1) * width
    return c.select(thr.alias("threshold"), between.alias("between_var"), "bin") \
            .groupBy().agg(F.max_by(F.struct("threshold", "between_var"), F.struct("between_var", -F.col("bin"))).alias("b")) \
            .select("b.threshold", "b.between_var")


def histogram_entropy(df: DataFrame, keys: list[str], value: str, n_bins: int = 32) -> DataFrame:
    """-sum h ln h of the NumPy density histogram (h = count / (n * bin width)) per key."""
    rng = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"),
                                F.count(value).alias("_n"))
    j = df.join(rng, keys).withColumn("_bin", equal_width_bin(value, "_lo", "_hi", n_bins))
    h = j.groupBy(*keys, "_bin", "_lo", "_hi", "_n").agg(F.count(F.lit(1)).alias("_c"))
    width = (F.col("_hi") - F.col("_lo")) / n_bins
    dens = F.col("_c") / (F.col("_n") * width)
    return h.groupBy(*keys).agg(F.sum(F.when(dens > 0, -dens * F.log(dens))).alias("entropy"))


def motion_scrub(df: DataFrame, scan: str, order: list[str], fd: str, value: str, fd_max: float = 0.5,
                 max_bad: float = 0.2) -> DataFrame:
    """Frames with FD > fd_max are replaced by linear interpolation of the
    neighbouring good frames; scans with more than ``max_bad`` bad frames dropped.
    The frames of the scans that stay are stored once, for all steps after."""
    from clinlake.operators.panel import interpolate_fill
    bad = F.col(fd) > fd_max
    x = df.withColumn("_x", F.when(bad, F.lit(None)).otherwise(F.col(value).cast("double")))
    share = df.groupBy(scan).agg(F.avg(bad.cast("double")).alias("_bad"))
    keep = share.filter(F.col("_bad") <= max_bad).select(scan)
    checkpoint_dir(df.sparkSession)
    kept = x.join(runtime_sized(keep), scan, "left_semi").checkpoint(eager=True)
    filled = interpolate_fill(kept, [scan], list(order), "_x", out=value)
    return filled.drop("_x")


def node_features(long: DataFrame, edges: DataFrame, scan: str, roi: str, value: str) -> DataFrame:
    """Per (scan, roi): mean |value|, variance (ddof 0), points, degree in the
    thresholded (symmetric) edge list."""
    f = long.groupBy(scan, roi).agg(F.avg(F.abs(value)).alias("mean_abs"), F.var_pop(value).alias("variance"),
                                    F.count(F.lit(1)).alias("n_points"))
    deg = edges.groupBy(F.col("scan").alias(scan), F.col("src").alias(roi)).agg(F.count(F.lit(1)).alias("degree"))
    return f.join(deg, [scan, roi], "left").fillna(0, ["degree"])


def normative_z(long: DataFrame, roi: str, value: str, clip_at: float = 5.0) -> DataFrame:
    """z against the population mean / sd (ddof 0) of each region, sd 0 -> 1, clipped."""
    st = long.groupBy(roi).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    j = long.join(runtime_sized(st), roi)
    sd = F.when(F.coalesce(F.col("_s"), F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("_s"))
    z = F.least(F.greatest((F.col(value) - F.col("_m")) / sd, F.lit(-clip_at)), F.lit(clip_at))
    return j.withColumn("z", z).drop("_m", "_s")
