"""Table building queries on the driver tables.

Role mapping: customer = patients (nation = site, segment = disease group),
orders = visits / analyses, lineitem = feature rows, events = wearable
events (user = patient, event_type = modality).
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinlake.functions.exprs import binarise, clip
from clinlake.operators import align, encode, features, impute
from clinlake.session import table
from clinlake.sources import sinks

# The event types of the driver's events table (pivot levels).
MODALITIES = ["click", "view", "purchase", "signup", "error"]


def patient_feature_matrix(spark, sf):
    ev = table(spark, sf, "events", ["user_id", "event_type", "value"])
    cust = table(spark, sf, "customer", ["c_custkey", "c_acctbal"])
    orders = table(spark, sf, "orders", ["o_custkey"])
    out = features.patient_feature_matrix(
        ev, cust, orders, MODALITIES, patient="user_id", modality="event_type", metric="value",
        conn_patient="c_custkey", conn_value="c_acctbal", var_patient="o_custkey")
    return out.select(F.col("user_id").alias("patient_id"),
                      *[F.round(m, 6).alias(m) for m in MODALITIES],
                      F.round("connectivity_mean", 6).alias("connectivity_mean"), "variant_count")


_PFM_SQL = """
WITH ts AS (
  SELECT user_id AS patient_id,
    avg(CASE WHEN event_type='click' THEN value END) AS click,
    avg(CASE WHEN event_type='view' THEN value END) AS view,
    avg(CASE WHEN event_type='purchase' THEN value END) AS purchase,
    avg(CASE WHEN event_type='signup' THEN value END) AS signup,
    avg(CASE WHEN event_type='error' THEN value END) AS error
  FROM events GROUP BY user_id),
cn AS (SELECT c_custkey AS patient_id, avg(c_acctbal) AS connectivity_mean FROM customer GROUP BY c_custkey),
vr AS (SELECT o_custkey AS patient_id, count(*) AS variant_count FROM orders GROUP BY o_custkey),
ids AS (SELECT patient_id FROM ts UNION SELECT patient_id FROM cn UNION SELECT patient_id FROM vr)
SELECT ids.patient_id,
  round(coalesce(click,0),6) AS click, round(coalesce(view,0),6) AS view,
  round(coalesce(purchase,0),6) AS purchase, round(coalesce(signup,0),6) AS signup,
  round(coalesce(error,0),6) AS error,
  round(coalesce(connectivity_mean,0),6) AS connectivity_mean,
  coalesce(variant_count,0) AS variant_count
FROM ids LEFT JOIN ts USING (patient_id) LEFT JOIN cn USING (patient_id) LEFT JOIN vr USING (patient_id)
"""

_ALIGN_SCHEMA = T.StructType([
    T.StructField("patient_id", T.LongType()),
    T.StructField("site", T.IntegerType()),
    T.StructField("acctbal", T.DoubleType()),
    T.StructField("segment", T.StringType()),
    T.StructField("data_source", T.StringType()),
])


def schema_align_union(spark, sf):
    cust = align.rename(table(spark, sf, "customer"),
                        {"c_custkey": "patient_id", "c_nationkey": "site", "c_acctbal": "acctbal",
                         "c_mktsegment": "segment"}).withColumn("data_source", F.lit("customer"))
    supp = align.rename(table(spark, sf, "supplier"),
                        {"s_suppkey": "patient_id", "s_nationkey": "site", "s_acctbal": "acctbal"}
                        ).withColumn("data_source", F.lit("supplier"))
    return align.union_aligned([cust, supp], _ALIGN_SCHEMA, {"segment": "Unknown"})


_ALIGN_SQL = """
SELECT c_custkey AS patient_id, c_nationkey AS site, c_acctbal AS acctbal,
       coalesce(c_mktsegment, 'Unknown') AS segment, 'customer' AS data_source FROM customer
UNION ALL
SELECT s_suppkey, s_nationkey, s_acctbal, 'Unknown', 'supplier' FROM supplier
"""

_DEDUPE_FEATURES = ["quantity", "discount", "tax", "returnflag", "linestatus"]


def _dedupe_input(spark, sf):
    li = table(spark, sf, "lineitem", ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"])
    # zero discount / tax are missing measurements in this role mapping
    return li.select(F.col("l_quantity").alias("quantity"),
                     F.nullif("l_discount", F.lit(0.0)).alias("discount"),
                     F.nullif("l_tax", F.lit(0.0)).alias("tax"),
                     F.col("l_returnflag").alias("returnflag"), F.col("l_linestatus").alias("linestatus"))


def conditional_dedupe(spark, sf):
    df = _dedupe_input(spark, sf)
    return align.conditional_dedupe(df, _DEDUPE_FEATURES, _DEDUPE_FEATURES, min_non_null=5)


_DEDUPE_SQL = """
WITH t AS (SELECT l_quantity AS quantity, nullif(l_discount, 0) AS discount, nullif(l_tax, 0) AS tax,
                  l_returnflag AS returnflag, l_linestatus AS linestatus FROM lineitem),
d AS (SELECT *, (quantity IS NOT NULL)::INT + (discount IS NOT NULL)::INT + (tax IS NOT NULL)::INT
              + (returnflag IS NOT NULL)::INT + (linestatus IS NOT NULL)::INT AS nn FROM t)
SELECT DISTINCT quantity, discount, tax, returnflag, linestatus FROM d WHERE nn >= 5
UNION ALL
SELECT quantity, discount, tax, returnflag, linestatus FROM d WHERE nn < 5
"""


def latest_per_key_join(spark, sf):
    cust = table(spark, sf, "customer", ["c_custkey", "c_name", "c_mktsegment"])
    orders = table(spark, sf, "orders", ["o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"])
    latest = align.latest_per_key(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    j = cust.join(latest, cust.c_custkey == latest.o_custkey, "left")
    out = j.select("c_custkey", "c_name", "c_mktsegment", F.col("o_orderkey").alias("latest_orderkey"),
                   F.col("o_orderdate").alias("latest_orderdate"), F.col("o_totalprice").alias("latest_totalprice"))
    return out.orderBy(F.col("latest_orderdate").desc_nulls_last(), F.col("c_custkey")).limit(50)


_LATEST_SQL = """
WITH l AS (
  SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest_orderkey,
         max(o_orderdate) AS latest_orderdate,
         arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS latest_totalprice
  FROM orders GROUP BY o_custkey)
SELECT c_custkey, c_name, c_mktsegment, latest_orderkey, latest_orderdate, latest_totalprice
FROM customer LEFT JOIN l ON c_custkey = o_custkey
ORDER BY latest_orderdate DESC NULLS LAST, c_custkey LIMIT 50
"""


def keyset_pages(spark, sf):
    orders = table(spark, sf, "orders", ["o_orderkey", "o_totalprice"])
    paged = sinks.keyset_pages(orders, "o_orderkey", 2000)
    return paged.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_rows"),
                                        F.min("o_orderkey").alias("first_key"),
                                        F.max("o_orderkey").alias("last_key"),
                                        F.round(F.sum("o_totalprice"), 2).alias("page_total"))


_KEYSET_SQL = """
SELECT CAST(floor(o_orderkey / 2000) AS BIGINT) AS page_id, count(*) AS n_rows,
       min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, round(sum(o_totalprice), 2) AS page_total
FROM orders GROUP BY 1
"""


def replace_by_key_upsert(spark, sf):
    orders = table(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"])
    target = orders.filter(F.col("o_orderstatus").isin("F", "O"))
    batch = orders.filter(F.col("o_orderstatus") == "P")
    return sinks.replace_by_key(target, batch, ["o_custkey"])


_REPLACE_SQL = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders
WHERE o_orderstatus IN ('F','O') AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'P'
"""


def _upsert_sides(spark, sf):
    orders = table(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"])
    target = orders.filter(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"))
    batch = (orders.filter(F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))
             .withColumn("o_totalprice", F.col("o_totalprice") + F.lit(1.0)))
    return target, batch


def upsert_do_nothing(spark, sf):
    target, batch = _upsert_sides(spark, sf)
    return sinks.upsert_do_nothing(target, batch, ["o_orderkey"])


_DO_NOTHING_SQL = """
WITH t AS (SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'),
b AS (SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice + 1.0 AS o_totalprice FROM orders
      WHERE o_orderdate >= TIMESTAMP '1995-01-01')
SELECT * FROM t UNION ALL SELECT * FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM t)
"""


def upsert_latest_wins(spark, sf):
    target, batch = _upsert_sides(spark, sf)
    return sinks.upsert_latest_wins(target, batch, ["o_orderkey"])


_LATEST_WINS_SQL = """
WITH t AS (SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'),
b AS (SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice + 1.0 AS o_totalprice FROM orders
      WHERE o_orderdate >= TIMESTAMP '1995-01-01')
SELECT * FROM b UNION ALL SELECT * FROM t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)
"""


def conditional_update(spark, sf):
    orders = table(spark, sf, "orders", ["o_orderkey", "o_orderstatus", "o_orderdate", "o_orderpriority"])
    stale = (F.col("o_orderstatus") == "O") & (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"))
    upd = sinks.conditional_update(orders, stale, {"o_orderstatus": F.lit("PENDING")})
    return sinks.delete_where(upd, F.col("o_orderpriority") == "5-LOW")


_UPDATE_SQL = """
SELECT o_orderkey,
       CASE WHEN o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1996-01-01' THEN 'PENDING' ELSE o_orderstatus END AS o_orderstatus,
       o_orderdate, o_orderpriority
FROM orders WHERE NOT coalesce(o_orderpriority = '5-LOW', false)
"""

# Literature prior of account balance per region (the fallback).
REGION_PRIORS = {0: 4500.0, 1: 4600.0, 2: 4400.0, 3: 4550.0, 4: 4450.0}


def prior_fill_override(spark, sf):
    cust = table(spark, sf, "customer", ["c_custkey", "c_nationkey", "c_acctbal"])
    nation = table(spark, sf, "nation", ["n_nationkey", "n_regionkey"])
    supp = table(spark, sf, "supplier", ["s_nationkey", "s_acctbal"])
    prior_map = F.create_map(*[x for k, v in REGION_PRIORS.items() for x in (F.lit(k), F.lit(v))])
    literature = nation.select(F.col("n_nationkey").alias("c_nationkey"),
                               F.try_element_at(prior_map, F.col("n_regionkey")).alias("prior"))
    file_scores = supp.groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.avg("s_acctbal").alias("prior"))
    # a negative balance is an invalid measurement -> missing
    data = cust.withColumn("acctbal", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")))
    filled = impute.prior_fill(data, "acctbal", "c_nationkey", literature, file_scores, out="acctbal_filled")
    return filled.select("c_custkey", "c_nationkey", F.round("acctbal_filled", 6).alias("acctbal_filled"),
                         F.col("acctbal").isNull().alias("was_filled"))


_PRIOR_SQL = """
WITH lit AS (SELECT n_nationkey AS k, CASE n_regionkey WHEN 0 THEN 4500.0 WHEN 1 THEN 4600.0 WHEN 2 THEN 4400.0
                    WHEN 3 THEN 4550.0 WHEN 4 THEN 4450.0 END AS prior FROM nation),
fs AS (SELECT s_nationkey AS k, avg(s_acctbal) AS prior FROM supplier GROUP BY s_nationkey),
p AS (SELECT coalesce(lit.k, fs.k) AS k, coalesce(fs.prior, lit.prior) AS prior FROM lit FULL JOIN fs ON lit.k = fs.k)
SELECT c_custkey, c_nationkey,
       round(coalesce(CASE WHEN c_acctbal >= 0 THEN c_acctbal END, p.prior), 6) AS acctbal_filled,
       (CASE WHEN c_acctbal >= 0 THEN c_acctbal END) IS NULL AS was_filled
FROM customer LEFT JOIN p ON c_nationkey = p.k
"""


def clip_and_binarise(spark, sf):
    li = table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"])
    return li.select("l_orderkey", "l_linenumber",
                     clip("l_quantity", 5.0, 45.0).alias("quantity_clipped"),
                     clip("l_discount", 0.0, 0.08).alias("discount_clipped"),
                     binarise(F.col("l_tax") * 12.5).alias("tax_flag"))


_CLIP_SQL = """
SELECT l_orderkey, l_linenumber, least(greatest(l_quantity, 5.0), 45.0) AS quantity_clipped,
       least(greatest(l_discount, 0.0), 0.08) AS discount_clipped,
       round_even(least(greatest(coalesce(l_tax * 12.5, 0.0), 0.0), 1.0), 0) AS tax_flag
FROM lineitem
"""


def label_encode_sorted(spark, sf):
    part = table(spark, sf, "part", ["p_partkey", "p_type"])
    return encode.label_encode_sorted(part, "p_type", "type_code").select("p_partkey", "type_code")


_LABEL_SQL = """
SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY coalesce(lower(trim(p_type)), 'nan')) - 1 AS INTEGER) AS type_code
FROM part
"""


def derived_and_interactions(spark, sf):
    from clinlake.operators.derive import interaction_features
    li = table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                                       "l_discount", "l_tax"])
    spec = {
        "products": [("l_quantity", "l_discount"), ("l_discount", "l_tax")],
        "ratios": [("l_extendedprice", "l_quantity")],
        "squares": ["l_discount"],
    }
    out = interaction_features(li, spec)
    new = [c for c in out.columns if c not in li.columns]
    return out.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in new])


_DERIVED_SQL = """
SELECT l_orderkey, l_linenumber,
       round(l_quantity * l_discount, 6) AS l_quantity_x_l_discount,
       round(l_discount * l_tax, 6) AS l_discount_x_l_tax,
       round(l_extendedprice / (abs(l_quantity) + 1e-6), 6) AS l_extendedprice_per_l_quantity,
       round(l_discount * l_discount, 6) AS l_discount_sq
FROM lineitem
"""

# Ordered keyword -> class list (first match wins) and fallback.
PART_CLASSES = [("ring", "AD"), ("widget", "PD"), ("bolt", "MS"), ("gear", "ALS"), ("nut", "HD")]
PART_FALLBACK = "AD"


def ordered_substring_class(spark, sf):
    part = table(spark, sf, "part", ["p_partkey", "p_name"])
    return part.select("p_partkey", encode.ordered_substring_class("p_name", PART_CLASSES, PART_FALLBACK)
                       .alias("disease"))


_SUBSTR_SQL = """
SELECT p_partkey, CASE WHEN contains(lower(p_name), 'ring') THEN 'AD' WHEN contains(lower(p_name), 'widget') THEN 'PD'
  WHEN contains(lower(p_name), 'bolt') THEN 'MS' WHEN contains(lower(p_name), 'gear') THEN 'ALS'
  WHEN contains(lower(p_name), 'nut') THEN 'HD' ELSE 'AD' END AS disease
FROM part
"""

# Brand-code prefixes mapped to a disease (ICD-style prefix map).
BRAND_PREFIX = {"BRAND#1": "Alzheimer", "BRAND#2": "Parkinson", "BRAND#3": "Multiple Sclerosis"}


def code_prefix_map(spark, sf):
    part = table(spark, sf, "part", ["p_partkey", "p_brand"])
    out = encode.code_prefix_map(part, "p_brand", BRAND_PREFIX, 7, out="disease", default="Other")
    return out.select("p_partkey", "disease",
                      encode.prefix_set_predicate(["p_brand"], ["BRAND#1", "BRAND#2"], 7).alias("in_panel"))


_PREFIX_SQL = """
SELECT p_partkey,
  CASE upper(substr(p_brand, 1, 7)) WHEN 'BRAND#1' THEN 'Alzheimer' WHEN 'BRAND#2' THEN 'Parkinson'
       WHEN 'BRAND#3' THEN 'Multiple Sclerosis' ELSE 'Other' END AS disease,
  coalesce(upper(substr(p_brand, 1, 7)) IN ('BRAND#1', 'BRAND#2'), false) AS in_panel
FROM part
"""


def risk_bands(spark, sf):
    cust = table(spark, sf, "customer", ["c_custkey", "c_acctbal"])
    p = clip((F.col("c_acctbal") + F.lit(1000.0)) / F.lit(11000.0), 0.0, 1.0)
    return cust.select("c_custkey", F.round(p, 6).alias("risk_score"),
                       encode.risk_band(p).alias("risk_level"), encode.confidence_band(p).alias("confidence"))


_RISK_SQL = """
WITH t AS (SELECT c_custkey, least(greatest((c_acctbal + 1000.0) / 11000.0, 0.0), 1.0) AS p FROM customer)
SELECT c_custkey, round(p, 6) AS risk_score,
  CASE WHEN p >= 0.8 THEN 'Critical' WHEN p >= 0.65 THEN 'High' WHEN p >= 0.4 THEN 'Moderate' ELSE 'Low' END AS risk_level,
  CASE WHEN abs(p - 0.5) >= 0.3 THEN 'High' WHEN abs(p - 0.5) >= 0.15 THEN 'Medium' ELSE 'Low' END AS confidence
FROM t
"""


def grouped_median_fill(spark, sf):
    li = table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_returnflag", "l_discount"])
    data = li.withColumn("discount", F.nullif("l_discount", F.lit(0.0)))
    out = impute.median_fill(data, ["discount"], ["l_returnflag"])
    return out.select("l_orderkey", "l_linenumber", "l_returnflag", F.round("discount", 6).alias("discount_filled"))


_MEDIAN_SQL = """
WITH d AS (SELECT l_orderkey, l_linenumber, l_returnflag, nullif(l_discount, 0) AS discount FROM lineitem),
m AS (SELECT l_returnflag, quantile_cont(discount, 0.5) AS med FROM d GROUP BY l_returnflag)
SELECT l_orderkey, l_linenumber, d.l_returnflag, round(coalesce(discount, med, 0.0), 6) AS discount_filled
FROM d LEFT JOIN m ON d.l_returnflag = m.l_returnflag
"""


def zscore_population(spark, sf):
    li = table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"])
    out = impute.population_zscore(li, ["l_quantity", "l_extendedprice"], log1p_cols=["l_extendedprice"],
                                   suffix="_z")
    return out.select("l_orderkey", "l_linenumber", F.round("l_quantity_z", 6).alias("l_quantity_z"),
                      F.round("l_extendedprice_z", 6).alias("l_extendedprice_z"))


_ZSCORE_SQL = """
WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq,
                  avg(ln(1 + l_extendedprice)) AS me, stddev_pop(ln(1 + l_extendedprice)) AS se FROM lineitem)
SELECT l_orderkey, l_linenumber,
  round(coalesce((l_quantity - mq) / CASE WHEN coalesce(sq, 0) = 0 THEN 1 ELSE sq END, 0), 6) AS l_quantity_z,
  round(coalesce((ln(1 + l_extendedprice) - me) / CASE WHEN coalesce(se, 0) = 0 THEN 1 ELSE se END, 0), 6) AS l_extendedprice_z
FROM lineitem, s
"""


def baseline_composite(spark, sf):
    o = table(spark, sf, "orders", ["o_orderkey", "o_orderstatus", "o_totalprice"])
    out = impute.baseline_composite(o, ["o_totalprice"], [1.0], F.col("o_orderstatus") == "F", out="dci")
    return out.select("o_orderkey", F.round("dci", 6).alias("dci"))


_DCI_SQL = """
WITH r AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders WHERE o_orderstatus = 'F')
SELECT o_orderkey, round(least(greatest(50 + 10 * coalesce((o_totalprice - m) / CASE WHEN coalesce(s,0) = 0 THEN 1 ELSE s END, 0), 0), 100), 6) AS dci
FROM orders, r
"""


def site_demean(spark, sf):
    supp = table(spark, sf, "supplier", ["s_suppkey", "s_nationkey", "s_acctbal"])
    out = impute.site_demean(supp, ["s_acctbal"], "s_nationkey", add_global_mean=True, suffix="_harmonised")
    return out.select("s_suppkey", F.round("s_acctbal_harmonised", 6).alias("s_acctbal_harmonised"))


_DEMEAN_SQL = """
WITH sm AS (SELECT s_nationkey, avg(s_acctbal) AS m FROM supplier GROUP BY s_nationkey),
g AS (SELECT avg(s_acctbal) AS gm FROM supplier)
SELECT s_suppkey, round(s_acctbal - m + gm, 6) AS s_acctbal_harmonised
FROM supplier JOIN sm USING (s_nationkey), g
"""


QUERIES = {
    "patient_feature_matrix": patient_feature_matrix,
    "schema_align_union": schema_align_union,
    "conditional_dedupe": conditional_dedupe,
    "latest_per_key_join": latest_per_key_join,
    "keyset_pages": keyset_pages,
    "replace_by_key_upsert": replace_by_key_upsert,
    "upsert_do_nothing": upsert_do_nothing,
    "upsert_latest_wins": upsert_latest_wins,
    "conditional_update": conditional_update,
    "prior_fill_override": prior_fill_override,
    "clip_and_binarise": clip_and_binarise,
    "label_encode_sorted": label_encode_sorted,
    "derived_and_interactions": derived_and_interactions,
    "ordered_substring_class": ordered_substring_class,
    "code_prefix_map": code_prefix_map,
    "risk_bands": risk_bands,
    "grouped_median_fill": grouped_median_fill,
    "zscore_population": zscore_population,
    "baseline_composite": baseline_composite,
    "site_demean": site_demean,
}

ORACLE = {
    "patient_feature_matrix": _PFM_SQL,
    "schema_align_union": _ALIGN_SQL,
    "conditional_dedupe": _DEDUPE_SQL,
    "latest_per_key_join": _LATEST_SQL,
    "keyset_pages": _KEYSET_SQL,
    "replace_by_key_upsert": _REPLACE_SQL,
    "upsert_do_nothing": _DO_NOTHING_SQL,
    "upsert_latest_wins": _LATEST_WINS_SQL,
    "conditional_update": _UPDATE_SQL,
    "prior_fill_override": _PRIOR_SQL,
    "clip_and_binarise": _CLIP_SQL,
    "label_encode_sorted": _LABEL_SQL,
    "derived_and_interactions": _DERIVED_SQL,
    "ordered_substring_class": _SUBSTR_SQL,
    "code_prefix_map": _PREFIX_SQL,
    "risk_bands": _RISK_SQL,
    "grouped_median_fill": _MEDIAN_SQL,
    "zscore_population": _ZSCORE_SQL,
    "baseline_composite": _DCI_SQL,
    "site_demean": _DEMEAN_SQL,
}
