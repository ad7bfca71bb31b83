"""Genomics queries; lineitem rows act as variant calls.

Role mapping: patient = l_suppkey, gene = part brand, variant = l_partkey,
impact = l_linenumber, allele frequency = l_discount, CADD = l_quantity,
pathway = part type (its brands are the pathway genes).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from clinlake.operators import genomics, impute
from clinlake.session import table


def _variants(spark, sf):
    li = table(spark, sf, "lineitem", ["l_suppkey", "l_partkey", "l_linenumber", "l_discount", "l_quantity"])
    part = table(spark, sf, "part", ["p_partkey", "p_brand"])
    return li.join(part, li.l_partkey == part.p_partkey)


def variant_burden(spark, sf):
    b = genomics.rare_burden(_variants(spark, sf), "l_suppkey", "p_brand", "l_linenumber", "l_discount", "l_quantity")
    return b.select("l_suppkey", "p_brand", F.round("burden", 6).alias("burden"))


_BURDEN_CTE = """b AS (SELECT l_suppkey, p_brand, sum(l_quantity * least(1.0, -log10(l_discount + 1e-6))) AS burden
      FROM lineitem JOIN part ON l_partkey = p_partkey
      WHERE l_linenumber IN (1, 2) AND l_discount < 0.01 GROUP BY l_suppkey, p_brand)"""

_BURDEN_SQL = f"WITH {_BURDEN_CTE} SELECT l_suppkey, p_brand, round(burden, 6) AS burden FROM b"


def pathway_burden(spark, sf):
    b = genomics.rare_burden(_variants(spark, sf), "l_suppkey", "p_brand", "l_linenumber", "l_discount", "l_quantity")
    members = table(spark, sf, "part", ["p_type", "p_brand"])
    pb = genomics.pathway_burden(b, members, "l_suppkey", "p_brand", "p_type")
    return pb.select("l_suppkey", "p_type", F.round("pathway_burden", 6).alias("pathway_burden"))


_PATHWAY_SQL = f"""
WITH {_BURDEN_CTE},
m AS (SELECT DISTINCT p_type, p_brand FROM part),
sz AS (SELECT p_type, count(DISTINCT p_brand) AS size FROM part GROUP BY p_type)
SELECT l_suppkey, m.p_type, round(sum(burden) / max(size), 6) AS pathway_burden
FROM b JOIN m ON b.p_brand = m.p_brand JOIN sz ON sz.p_type = m.p_type GROUP BY l_suppkey, m.p_type
"""


def genomic_risk(spark, sf):
    supp = table(spark, sf, "supplier", ["s_suppkey", "s_acctbal"])
    z = impute.population_zscore(supp, ["s_acctbal"], suffix="_z")
    b = genomics.rare_burden(_variants(spark, sf), "l_suppkey", "p_brand", "l_linenumber", "l_discount", "l_quantity")
    tot = b.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.sum("burden").alias("rare"))
    j = z.join(tot, "s_suppkey", "left").withColumn("rare", F.coalesce(F.col("rare") / 100.0, F.lit(0.0)))
    return j.select("s_suppkey", F.round(genomics.risk_blend("s_acctbal_z", "rare"), 6).alias("risk"))


_RISK_SQL = f"""
WITH {_BURDEN_CTE},
t AS (SELECT l_suppkey, sum(burden) AS rare FROM b GROUP BY l_suppkey),
st AS (SELECT avg(s_acctbal) AS m, stddev_pop(s_acctbal) AS s FROM supplier),
z AS (SELECT s_suppkey, coalesce((s_acctbal - m) / CASE WHEN coalesce(s, 0) = 0 THEN 1 ELSE s END, 0) AS z FROM supplier, st)
SELECT s_suppkey, round(1.0 / (1.0 + exp(-(0.7 * z + 0.3 * tanh(coalesce(rare / 100.0, 0.0))))), 6) AS risk
FROM z LEFT JOIN t ON t.l_suppkey = s_suppkey
"""


def _genotypes(spark, sf):
    li = table(spark, sf, "lineitem", ["l_partkey", "l_suppkey"])
    return li.groupBy("l_partkey", "l_suppkey").agg(F.least(F.count(F.lit(1)), F.lit(2)).alias("dosage"))


def variant_qc(spark, sf):
    g = _genotypes(spark, sf)
    n = table(spark, sf, "supplier", ["s_suppkey"]).agg(F.count(F.lit(1)).alias("_n_samples"))
    q = genomics.variant_qc(g, "l_partkey", "l_suppkey", "dosage", n)
    return q.select("l_partkey", "called", "n0", "n1", "n2", F.round("maf", 6).alias("maf"),
                    F.round("call_rate", 6).alias("call_rate"), F.round("hwe_chi2", 6).alias("hwe_chi2"), "pass_qc")


def _qc_sql():
    return f"""
WITH g AS (SELECT l_partkey, l_suppkey, least(count(*), 2) AS d FROM lineitem GROUP BY ALL),
c AS (SELECT l_partkey, count(d) AS called, count(*) FILTER (WHERE d = 0) AS n0, count(*) FILTER (WHERE d = 1) AS n1,
             count(*) FILTER (WHERE d = 2) AS n2, sum(d) AS alt FROM g GROUP BY l_partkey),
ns AS (SELECT count(*) AS ns FROM supplier),
x AS (SELECT *, alt / (2.0 * called) AS p, called::DOUBLE AS n FROM c),
y AS (SELECT *, n * (1 - p) * (1 - p) AS e0, 2 * n * p * (1 - p) AS e1, n * p * p AS e2 FROM x)
SELECT l_partkey, called, n0, n1, n2, round(least(p, 1 - p), 6) AS maf, round(n / ns, 6) AS call_rate,
  round((CASE WHEN e0 > 0 THEN (n0 - e0) ** 2 / e0 ELSE 0 END) + (CASE WHEN e1 > 0 THEN (n1 - e1) ** 2 / e1 ELSE 0 END)
        + (CASE WHEN e2 > 0 THEN (n2 - e2) ** 2 / e2 ELSE 0 END), 6) AS hwe_chi2,
  least(p, 1 - p) >= 0.01 AND n / ns >= 0.98 AND ((CASE WHEN e0 > 0 THEN (n0 - e0) ** 2 / e0 ELSE 0 END)
        + (CASE WHEN e1 > 0 THEN (n1 - e1) ** 2 / e1 ELSE 0 END) + (CASE WHEN e2 > 0 THEN (n2 - e2) ** 2 / e2 ELSE 0 END))
        <= {genomics.HWE_CHI2_MAX!r} AS pass_qc
FROM y, ns
"""


def interval_lift_join(spark, sf):
    o = table(spark, sf, "orders", ["o_orderkey"])
    seg = (o.groupBy(F.floor(F.col("o_orderkey") / 2000).alias("page"))
           .agg(F.min("o_orderkey").alias("start"), (F.max("o_orderkey") + 1).alias("end"))
           .select("start", "end", (F.col("page") * 100000).alias("new_start"),
                   F.when(F.col("page") % 2 == 0, "+").otherwise("-").alias("strand")))
    li = table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber"])
    out = genomics.interval_lift(li, "l_orderkey", seg, bin_size=1000)
    return out.select("l_orderkey", "l_linenumber", F.col("lifted").cast("long").alias("lifted"), "mapped")


_LIFT_SQL = """
WITH s AS (SELECT floor(o_orderkey / 2000) AS page, min(o_orderkey) AS st, max(o_orderkey) + 1 AS en FROM orders GROUP BY 1),
seg AS (SELECT st, en, page * 100000 AS ns, CASE WHEN page % 2 = 0 THEN '+' ELSE '-' END AS strand FROM s)
SELECT l_orderkey, l_linenumber,
  CAST(coalesce(CASE WHEN strand = '-' THEN ns + (en - 1 - l_orderkey) ELSE ns + (l_orderkey - st) END, l_orderkey) AS BIGINT) AS lifted,
  st IS NOT NULL AS mapped
FROM lineitem LEFT JOIN seg ON l_orderkey >= st AND l_orderkey < en
"""


def sample_qc(spark, sf):
    """Per-sample call rate over the variant set, pass at >= 0.95."""
    g = _genotypes(spark, sf)
    nv = table(spark, sf, "part", ["p_partkey"]).agg(F.count(F.lit(1)).alias("_n_variants"))
    q = genomics.sample_call_rate(g, "l_suppkey", "dosage", nv, 0.95)
    return q.select("l_suppkey", F.round("call_rate", 6).alias("call_rate"), "pass_qc")


_SAMPLE_QC_SQL = """
WITH g AS (SELECT l_suppkey, l_partkey FROM lineitem GROUP BY ALL),
c AS (SELECT l_suppkey, count(*) AS called FROM g GROUP BY 1),
n AS (SELECT count(*) AS nv FROM part)
SELECT l_suppkey, round(called / nv, 6) AS call_rate, called / nv >= 0.95 AS pass_qc FROM c, n
"""


QUERIES = {
    "sample_qc": sample_qc,
    "variant_burden": variant_burden,
    "pathway_burden": pathway_burden,
    "genomic_risk": genomic_risk,
    "variant_qc": variant_qc,
    "interval_lift_join": interval_lift_join,
}

ORACLE = {
    "sample_qc": _SAMPLE_QC_SQL,
    "variant_burden": _BURDEN_SQL,
    "pathway_burden": _PATHWAY_SQL,
    "genomic_risk": _RISK_SQL,
    "variant_qc": _qc_sql(),
    "interval_lift_join": _LIFT_SQL,
}
