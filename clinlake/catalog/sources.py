"""Source and sink queries: each writes a driver table through
Spark into a fresh folder under the shared checkpoint directory in the landed
format, then reads it back with the library's readers."""

from __future__ import annotations


from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinlake.operators import align
from clinlake.session import table
from clinlake.sources import readers, sinks
from clinlake.streaming.sinks import scratch_path

CUSTOMER_SCHEMA = T.StructType([
    T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()),
    T.StructField("c_nationkey", T.IntegerType()), T.StructField("c_acctbal", T.DoubleType()),
    T.StructField("c_mktsegment", T.StringType())])


def csv_scan(spark, sf):
    path = scratch_path(spark, "csv")
    table(spark, sf, "customer").write.option("header", True).csv(path)
    return readers.read_csv(spark, path, CUSTOMER_SCHEMA)


_CUSTOMER_SQL = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


def tsv_comment_scan(spark, sf):
    path = scratch_path(spark, "tsv")
    s = table(spark, sf, "supplier")
    note = spark.createDataFrame([("# supplier export, tab separated",)], "value string")
    body = s.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in s.columns]).alias("value"))
    note.unionByName(body).write.text(path)  # comment lines may land in any file
    raw = readers.read_tsv_strings(spark, path, ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"], header=False)
    schema = T.StructType([T.StructField("s_suppkey", T.LongType()), T.StructField("s_name", T.StringType()),
                           T.StructField("s_nationkey", T.IntegerType()), T.StructField("s_acctbal", T.DoubleType())])
    return align.align_to_schema(raw, schema)


_SUPPLIER_SQL = "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"


def whitespace_scan(spark, sf):
    path = scratch_path(spark, "ws")
    o = table(spark, sf, "orders", ["o_orderkey", "o_totalprice"])
    head = spark.createDataFrame([("FID   IID   PRS",)], "value string")
    body = o.select(F.format_string("%d  %d    %s", F.col("o_orderkey"), F.col("o_orderkey"),
                                    F.col("o_totalprice").cast("string")).alias("value"))
    head.unionByName(body).write.text(path)  # header rows are dropped wherever they land
    df = readers.read_whitespace(spark, path, ["FID", "IID", "PRS"])
    return df.select(F.col("IID").cast("long").alias("patient_id"), F.col("PRS").try_cast("double").alias("prs_price"))


_WS_SQL = "SELECT o_orderkey AS patient_id, o_totalprice AS prs_price FROM orders"

EVENT_JSON_SCHEMA = "event_id long, ts string, user_id long, event_type string, value double, props string"


def jsonl_scan(spark, sf):
    path = scratch_path(spark, "jsonl")
    ev = table(spark, sf, "events")
    ev.withColumn("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).write.json(path)
    back = readers.read_jsonl(spark, path, EVENT_JSON_SCHEMA)
    props = F.from_json("props", "k long")
    return back.select("event_id", F.to_timestamp_ntz("ts").alias("ts"), "user_id", "event_type", "value",
                       props["k"].alias("prop_k"))


_JSONL_SQL = """SELECT event_id, ts, user_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS prop_k FROM events"""

# Questionnaire item ids -> feature names (SleepQuality inverted).
ITEM_MAP = {"12": "MemoryComplaints", "13": "BehavioralProblems", "15": "Confusion", "16": "Depression",
            "17": "Disorientation", "21": "DifficultyCompletingTasks", "23": "SleepQuality"}


def questionnaire_flatten(spark, sf):
    """Conversations as nested questionnaire documents: one document per
    conversation, one item per turn (link_id = zero-padded 2*turn + 11,
    answer = assistant turn), flattened to one row per subject."""
    path = scratch_path(spark, "nms")
    conv = table(spark, sf, "conversations", ["conv_id", "turn", "role", "text"])
    item = F.struct(F.lpad((F.col("turn") * 2 + 11).cast("string"), 3, "0").alias("link_id"),
                    F.col("text"), (F.col("role") == "assistant").alias("answer"))
    docs = conv.groupBy(F.col("conv_id").alias("subject_id")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("turn"), item.alias("it")))).alias("_items"))
    docs = docs.select(F.lit("QuestionnaireResponse").alias("resource_type"), "subject_id",
                       F.transform("_items", lambda s: s["it"]).alias("item"))
    docs.write.json(path)
    schema = ("resource_type string, subject_id long, "
              "item array<struct<link_id: string, text: string, answer: boolean>>")
    nested = readers.read_jsonl(spark, path, schema)
    return readers.flatten_items(nested, "subject_id", "item", ITEM_MAP, invert=["SleepQuality"])


def _questionnaire_sql():
    cols = []
    for link, feat in ITEM_MAP.items():
        v = "(CASE WHEN role = 'assistant' THEN 1.0 ELSE 0.0 END)"
        if feat == "SleepQuality":
            v = f"(1.0 - {v})"
        cols.append(f"max(CASE WHEN CAST(turn * 2 + 11 AS VARCHAR) = '{link}' THEN {v} END) AS {feat}")
    return f"SELECT conv_id AS subject_id, {', '.join(cols)} FROM conversations GROUP BY conv_id"


def multi_source_discovery(spark, sf):
    df = readers.discover(spark, sf, ["customer", "supplier", "nation"], skip=[r"^nation\."])
    df = readers.drop_sources_without(df, F.coalesce(F.col("c_acctbal"), F.col("s_acctbal")) > 0)
    return df.select("data_source", F.coalesce("c_custkey", "s_suppkey").alias("key"),
                     F.coalesce("c_acctbal", "s_acctbal").alias("acctbal"))


_DISCOVER_SQL = """
SELECT 'customer' AS data_source, c_custkey AS key, c_acctbal AS acctbal FROM customer
UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier
"""


def partitioned_catalog_roundtrip(spark, sf):
    """Identity-partitioned table: validated appends with audit columns, an
    add-only column migration (second batch brings a new column; read with
    mergeSchema), then a partition-pruned read."""
    path = scratch_path(spark, "catalog")
    o = table(spark, sf, "orders", ["o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice", "o_orderpriority"])
    o = o.withColumn("order_year", F.year("o_orderdate"))
    first = sinks.stamp_audit(o.filter(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
                              .drop("o_orderpriority"), 1)
    second = sinks.stamp_audit(o.filter(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
                               .withColumn("priority_rank", F.substring("o_orderpriority", 1, 1).cast("int"))
                               .drop("o_orderpriority"), 2)
    sinks.write_partitioned(first, path, ["o_orderstatus", "order_year"], mode="append")
    sinks.write_partitioned(second, path, ["o_orderstatus", "order_year"], mode="append")
    back = spark.read.option("mergeSchema", True).parquet(path)
    f = back.filter(F.col("o_orderstatus") == "F")
    return f.select("o_orderkey", "o_orderstatus", F.col("order_year").cast("int").alias("order_year"),
                    "o_totalprice", "priority_rank", "schema_version")


_CATALOG_SQL = """
SELECT o_orderkey, o_orderstatus, CAST(year(o_orderdate) AS INTEGER) AS order_year, o_totalprice,
       CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) END AS priority_rank,
       CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN 2 ELSE 1 END AS schema_version
FROM orders WHERE o_orderstatus = 'F'
"""


def predicate_overwrite(spark, sf):
    """Rows with harmonized_flag = false are replaced by their site-demeaned
    version (flag true); rows already true and rows with a null flag are kept
    exactly once."""
    from clinlake.operators.impute import site_demean
    s = table(spark, sf, "supplier", ["s_suppkey", "s_nationkey", "s_acctbal"])
    t = s.withColumn("harmonized_flag", F.when(F.col("s_nationkey") < 20, F.col("s_acctbal") > 5000))
    cond = F.col("harmonized_flag") == F.lit(False)
    repl = site_demean(t.filter(cond), ["s_acctbal"], "s_nationkey").withColumn("harmonized_flag", F.lit(True))
    out = sinks.predicate_overwrite(t, cond, repl)
    return out.select("s_suppkey", "s_nationkey", F.round("s_acctbal", 6).alias("s_acctbal"), "harmonized_flag")


_OVERWRITE_SQL = """
WITH t AS (SELECT *, CASE WHEN s_nationkey < 20 THEN s_acctbal > 5000 END AS flag FROM supplier),
f AS (SELECT * FROM t WHERE flag = false),
m AS (SELECT s_nationkey, avg(s_acctbal) AS m FROM f GROUP BY 1)
SELECT s_suppkey, s_nationkey, round(s_acctbal, 6) AS s_acctbal, flag AS harmonized_flag FROM t WHERE NOT coalesce(flag = false, false)
UNION ALL SELECT s_suppkey, f.s_nationkey, round(s_acctbal - m, 6), true FROM f JOIN m ON f.s_nationkey = m.s_nationkey
"""


def domain_contract_append(spark, sf):
    """Orders as model predictions through the domain contract: valid rows are
    appended identity-partitioned by (patient_cohort, ingestion_date) with
    audit columns, failing rows quarantined; counts per cohort."""
    from clinlake import schema
    o = table(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                                    "o_orderpriority"])
    preds = o.select(F.col("o_orderkey").cast("string").alias("prediction_id"),
                     F.col("o_custkey").cast("string").alias("patient_id"),
                     F.col("o_orderpriority").alias("patient_cohort"),
                     # one ingestion batch per order year
                     F.to_date(F.date_trunc("year", "o_orderdate")).alias("ingestion_date"),
                     F.lit("price_model").alias("model_name"),
                     F.lit("v1").alias("model_version"), F.col("o_orderdate").cast("timestamp").alias("prediction_time"),
                     (F.col("o_totalprice") / 450000.0).alias("risk_score"), F.col("o_orderstatus").alias("risk_label"))
    good, bad = schema.contract_append(preds, "model_predictions")
    path = scratch_path(spark, "predictions")
    sinks.write_partitioned(good, path, schema.PARTITION_COLS, mode="append")
    stored = spark.read.parquet(path).groupBy("patient_cohort").agg(F.count(F.lit(1)).alias("n_valid"))
    q = bad.groupBy("patient_cohort").agg(F.count(F.lit(1)).alias("n_quarantined"))
    return stored.join(q, "patient_cohort", "full").fillna(0, ["n_valid", "n_quarantined"])


_DOMAIN_SQL = """
SELECT o_orderpriority AS patient_cohort,
       count(*) FILTER (WHERE o_totalprice / 450000.0 BETWEEN 0.0 AND 1.0) AS n_valid,
       count(*) FILTER (WHERE NOT (o_totalprice / 450000.0 BETWEEN 0.0 AND 1.0)) AS n_quarantined
FROM orders GROUP BY 1
"""


def merged_table_build(spark, sf):
    """The batch table build as one DAG: two heterogeneous sources aligned to
    one schema and unioned, rich rows de-duplicated, invalid balances nulled,
    imputed with the source median (zero fallback), clipped, binarised,
    validated and written partitioned by source; the written table read back."""
    from clinlake.functions.exprs import binarise, clip
    from clinlake.operators import contracts, impute
    from clinlake.catalog.frames import _ALIGN_SCHEMA
    cust = align.rename(table(spark, sf, "customer", ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"]),
                        {"c_custkey": "patient_id", "c_nationkey": "site", "c_acctbal": "acctbal",
                         "c_mktsegment": "segment"}).withColumn("data_source", F.lit("customer"))
    supp = align.rename(table(spark, sf, "supplier", ["s_suppkey", "s_nationkey", "s_acctbal"]),
                        {"s_suppkey": "patient_id", "s_nationkey": "site", "s_acctbal": "acctbal"}
                        ).withColumn("data_source", F.lit("supplier"))
    merged = align.union_aligned([cust, supp], _ALIGN_SCHEMA, {"segment": "Unknown"})
    merged = align.conditional_dedupe(merged, ["patient_id", "site", "acctbal", "segment"],
                                      ["patient_id", "data_source"], min_non_null=4)
    merged = merged.withColumn("acctbal", F.when(F.col("acctbal") >= 0, F.col("acctbal")))
    filled = impute.median_fill(merged, ["acctbal"], ["data_source"])
    out = filled.select("patient_id", "site", "segment", "data_source",
                        clip("acctbal", 0.0, 9000.0).alias("acctbal"),
                        binarise(F.col("acctbal") / 5000.0 - 0.5).alias("high_balance"))
    checked = contracts.validate(out, [contracts.Rule("acctbal", "range", lo=0.0, hi=9000.0, nullable=False)])
    path = scratch_path(spark, "merged")
    sinks.write_partitioned(checked.drop("violations"), path, ["data_source"])
    back = spark.read.parquet(path)
    return back.select("patient_id", "site", "segment", "data_source", F.round("acctbal", 6).alias("acctbal"),
                       "high_balance", "is_valid")


_MERGED_SQL = """
WITH u AS (SELECT c_custkey AS patient_id, c_nationkey AS site, c_acctbal AS acctbal, coalesce(c_mktsegment, 'Unknown') AS segment,
                  'customer' AS data_source FROM customer
           UNION ALL SELECT s_suppkey, s_nationkey, s_acctbal, 'Unknown', 'supplier' FROM supplier),
d AS (SELECT DISTINCT ON (patient_id, data_source) * FROM u),
n AS (SELECT patient_id, site, segment, data_source, CASE WHEN acctbal >= 0 THEN acctbal END AS acctbal FROM d),
m AS (SELECT data_source, quantile_cont(acctbal, 0.5) AS med FROM n GROUP BY data_source),
f AS (SELECT n.patient_id, site, segment, n.data_source, coalesce(acctbal, med, 0.0) AS acctbal FROM n JOIN m ON n.data_source = m.data_source)
SELECT patient_id, site, segment, data_source, round(least(greatest(acctbal, 0.0), 9000.0), 6) AS acctbal,
       round_even(least(greatest(coalesce(acctbal / 5000.0 - 0.5, 0.0), 0.0), 1.0), 0) AS high_balance,
       least(greatest(acctbal, 0.0), 9000.0) BETWEEN 0.0 AND 9000.0 AS is_valid
FROM f
"""


QUERIES = {
    "merged_table_build": merged_table_build,
    "domain_contract_append": domain_contract_append,
    "csv_scan": csv_scan,
    "tsv_comment_scan": tsv_comment_scan,
    "whitespace_scan": whitespace_scan,
    "jsonl_scan": jsonl_scan,
    "questionnaire_flatten": questionnaire_flatten,
    "multi_source_discovery": multi_source_discovery,
    "partitioned_catalog_roundtrip": partitioned_catalog_roundtrip,
    "predicate_overwrite": predicate_overwrite,
}

ORACLE = {
    "merged_table_build": _MERGED_SQL,
    "domain_contract_append": _DOMAIN_SQL,
    "csv_scan": _CUSTOMER_SQL,
    "tsv_comment_scan": _SUPPLIER_SQL,
    "whitespace_scan": _WS_SQL,
    "jsonl_scan": _JSONL_SQL,
    "questionnaire_flatten": _questionnaire_sql(),
    "multi_source_discovery": _DISCOVER_SQL,
    "partitioned_catalog_roundtrip": _CATALOG_SQL,
    "predicate_overwrite": _OVERWRITE_SQL,
}
