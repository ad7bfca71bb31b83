"""Join, filter, selection and scalar-function queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from clinlake.functions.exprs import hmac_sha256_hex
from clinlake.operators import align, encode, panel
from clinlake.operators.retrieval import top_k_per_group
from clinlake.plans.broadcast import runtime_sized
from clinlake.plans.prefix import row_index
from clinlake.plans.quantile import exact_quantiles
from clinlake.session import table


def two_key_left_join(spark, sf):
    li = table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_discount"])
    right = li.filter(F.col("l_returnflag") == "R").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    j = align.left_join_suffix(li.select("l_orderkey", "l_linenumber", "l_quantity"), right,
                               ["l_orderkey", "l_linenumber"], "_UPENN")
    return j.select("l_orderkey", "l_linenumber", "l_quantity", "l_quantity_UPENN", "l_discount")


_TWO_KEY_SQL = """
SELECT a.l_orderkey, a.l_linenumber, a.l_quantity, b.l_quantity AS l_quantity_UPENN, b.l_discount
FROM lineitem a LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R') b
  ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber
"""


def multi_join_on_predicates(spark, sf):
    c = table(spark, sf, "customer", ["c_custkey"])
    o = table(spark, sf, "orders", ["o_orderkey", "o_custkey"])
    li = table(spark, sf, "lineitem", ["l_orderkey", "l_partkey"])
    p = table(spark, sf, "part", ["p_partkey", "p_size"])
    j = (c.join(o, c.c_custkey == o.o_custkey).join(li, o.o_orderkey == li.l_orderkey)
         .join(p, (li.l_partkey == p.p_partkey) & (p.p_size > 40), "left"))
    return j.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n_lines"), F.count("p_partkey").alias("n_big_parts"))


_MULTI_JOIN_SQL = """
SELECT c_custkey, count(*) AS n_lines, count(p_partkey) AS n_big_parts
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
LEFT JOIN part ON l_partkey = p_partkey AND p_size > 40 GROUP BY c_custkey
"""


def override_merge(spark, sf):
    n = table(spark, sf, "nation", ["n_nationkey", "n_name"])
    s = table(spark, sf, "supplier", ["s_nationkey", "s_name", "s_acctbal"])
    overrides = s.filter(F.col("s_acctbal") > 9000).groupBy(F.col("s_nationkey").alias("n_nationkey")) \
        .agg(F.max("s_name").alias("name_override"))
    j = n.join(runtime_sized(overrides), "n_nationkey", "left")
    return j.select("n_nationkey", F.coalesce("name_override", "n_name").alias("name"))


_OVERRIDE_SQL = """
WITH o AS (SELECT s_nationkey, max(s_name) AS name_override FROM supplier WHERE s_acctbal > 9000 GROUP BY 1)
SELECT n_nationkey, coalesce(name_override, n_name) AS name FROM nation LEFT JOIN o ON n_nationkey = s_nationkey
"""


def first_claim(spark, sf):
    """Each part goes to the supplier that shipped it first (earlier claims win,
    later claimants are anti-joined away) as one min_by aggregate per key."""
    li = table(spark, sf, "lineitem", ["l_partkey", "l_suppkey", "l_shipdate"])
    return li.groupBy("l_partkey").agg(F.min_by("l_suppkey", F.struct("l_shipdate", "l_suppkey")).alias("first_suppkey"))


_FIRST_CLAIM_SQL = "SELECT l_partkey, arg_min(l_suppkey, (l_shipdate, l_suppkey)) AS first_suppkey FROM lineitem GROUP BY 1"


def graph_pattern_join(spark, sf):
    r = table(spark, sf, "region", ["r_regionkey", "r_name"])
    n = table(spark, sf, "nation", ["n_nationkey", "n_regionkey"])
    s = table(spark, sf, "supplier", ["s_suppkey", "s_nationkey"])
    li = table(spark, sf, "lineitem", ["l_suppkey", "l_partkey"])
    j = li.join(s, li.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey) \
          .join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("r_name").agg(F.countDistinct("l_partkey").alias("n_parts"),
                                   F.countDistinct("s_suppkey").alias("n_suppliers"))


_PATTERN_SQL = """
SELECT r_name, count(DISTINCT l_partkey) AS n_parts, count(DISTINCT s_suppkey) AS n_suppliers
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY r_name
"""


def document_quality_filter(spark, sf):
    d = table(spark, sf, "documents", ["doc_id", "lang", "text", "n_chars"])
    keep = (F.col("lang") == "en") & (F.col("n_chars") > 200) & ~F.lower("text").contains("case report")
    return d.filter(keep).select("doc_id", "n_chars")


_DOC_FILTER_SQL = """SELECT doc_id, n_chars FROM documents
WHERE lang = 'en' AND n_chars > 200 AND NOT contains(lower(text), 'case report')"""

REQUIRED_STATUSES = ["F", "O"]


def availability_probe(spark, sf):
    c = table(spark, sf, "customer", ["c_custkey"])
    o = table(spark, sf, "orders", ["o_custkey", "o_orderstatus"])
    active = c.join(o, c.c_custkey == o.o_custkey, "left_semi")
    avail = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        *[F.max(F.col("o_orderstatus") == s).alias(f"has_{s}") for s in REQUIRED_STATUSES])
    j = active.join(avail, "c_custkey")
    return j.select("c_custkey", F.expr(" AND ".join(f"has_{s}" for s in REQUIRED_STATUSES)).alias("all_available"))


_AVAIL_SQL = """
SELECT c_custkey, bool_or(o_orderstatus = 'F') AND bool_or(o_orderstatus = 'O') AS all_available
FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey
"""


def group_size_filter(spark, sf):
    c = table(spark, sf, "customer", ["c_nationkey"])
    return c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 60)


_GROUP_SIZE_SQL = "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) >= 60"

ID_PATTERN = r"^Customer#[0-9]{9}$"


def regex_id_check(spark, sf):
    c = table(spark, sf, "customer", ["c_custkey", "c_name"])
    return c.select("c_custkey", F.col("c_name").rlike(ID_PATTERN).alias("valid_id"))


_REGEX_SQL = f"SELECT c_custkey, regexp_matches(c_name, '{ID_PATTERN}') AS valid_id FROM customer"


def global_topk_abs(spark, sf):
    li = table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_extendedprice"])
    m = li.agg(F.avg("l_extendedprice").alias("_m"))
    dev = li.crossJoin(F.broadcast(m)).withColumn("deviation", F.col("l_extendedprice") - F.col("_m"))  # one-row side
    top = dev.orderBy(F.abs("deviation").desc(), "l_orderkey", "l_linenumber").limit(10)  # TakeOrderedAndProject
    return top.select("l_orderkey", "l_linenumber", F.round("deviation", 6).alias("deviation"))


_TOPK_SQL = """
WITH m AS (SELECT avg(l_extendedprice) AS m FROM lineitem)
SELECT l_orderkey, l_linenumber, round(l_extendedprice - m, 6) AS deviation FROM lineitem, m
ORDER BY abs(l_extendedprice - m) DESC, l_orderkey, l_linenumber LIMIT 10
"""


def quota_selection(spark, sf):
    """At most 50 documents per language (longest first), then a total cap of
    150 along the same global order (skew-safe row index)."""
    d = table(spark, sf, "documents", ["doc_id", "lang", "n_chars"]).withColumn("_neg", -F.col("n_chars"))
    per = top_k_per_group(d, ["lang"], [F.col("n_chars").desc(), F.col("doc_id")], 50, salt_of=F.xxhash64("doc_id"))
    ranked = row_index(per.drop("rank"), [], ["_neg", "doc_id"], "_g")
    return ranked.filter(F.col("_g") <= 150).select("doc_id", "lang")


_QUOTA_SQL = """
WITH q AS (SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents),
g AS (SELECT doc_id, lang, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS gr FROM q WHERE r <= 50)
SELECT doc_id, lang FROM g WHERE gr <= 150
"""


def segment_mode(spark, sf):
    c = table(spark, sf, "customer", ["c_nationkey", "c_mktsegment"])
    cnt = c.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    # mode with a deterministic tie-break (alphabetically first); the window spans the
    # grouped table, at most (nations x segments) rows
    w = Window.partitionBy("c_nationkey").orderBy(F.col("n").desc(), "c_mktsegment")
    return cnt.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(
        "c_nationkey", F.col("c_mktsegment").alias("mode_segment"), "n")


_MODE_SQL = """
WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS rk FROM c)
SELECT c_nationkey, c_mktsegment AS mode_segment, n FROM r WHERE rk = 1
"""


def latency_percentiles(spark, sf):
    ev = table(spark, sf, "events", ["ts", "event_type", "value"])
    q = exact_quantiles(ev, ["event_type"], "value", [0.5, 0.95, 0.99], ["p50_ms", "p95_ms", "p99_ms"])
    span = ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), (F.unix_micros(F.max("ts").cast("timestamp"))
                                        - F.unix_micros(F.min("ts").cast("timestamp"))).alias("_us"))
    j = q.join(span, "event_type")
    return j.select("event_type", *[F.round(c, 6).alias(c) for c in ("p50_ms", "p95_ms", "p99_ms")],
                    F.round(F.col("n") / (F.col("_us") / 1e6), 9).alias("per_second"))


_LATENCY_SQL = """
SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms,
       round(quantile_cont(value, 0.99), 6) AS p99_ms,
       round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 9) AS per_second
FROM events GROUP BY event_type
"""

# Gene-panel disease by brand prefix, PRS step and cap.
PANEL_DISEASE = {"Brand#1": "AD", "Brand#2": "PD"}
PRS_STEP, PRS_CAP = 0.15, 3.0


def gene_panel_summary(spark, sf):
    li = table(spark, sf, "lineitem", ["l_partkey", "l_linenumber", "l_discount"])
    p = table(spark, sf, "part", ["p_partkey", "p_brand"])
    v = li.join(p, li.l_partkey == p.p_partkey)
    path = F.col("l_linenumber").isin(1, 2)
    g = v.groupBy(F.col("p_brand").alias("gene")).agg(
        F.count(F.lit(1)).alias("n_total_variants"), F.count_if(path).alias("n_pathogenic"),
        F.coalesce(F.max(F.when(path, F.col("l_discount"))), F.lit(0.0)).alias("max_pathogenic_af"),
        F.round(F.coalesce(F.sum(F.when(path, F.col("l_discount"))), F.lit(0.0)), 8).alias("sum_pathogenic_af"))
    disease = encode.ordered_substring_class(F.col("gene"), [(k.lower(), v) for k, v in PANEL_DISEASE.items()], "other")
    g = g.withColumn("disease", F.when(F.substring("gene", 1, 7).isin(list(PANEL_DISEASE)), disease).otherwise("other"))
    per_d = g.groupBy("disease").agg(F.sum("n_pathogenic").alias("_nd"))
    g = g.join(runtime_sized(per_d), "disease").withColumn(
        "disease_prs", F.least(F.col("_nd") * PRS_STEP, F.lit(PRS_CAP))).drop("_nd")
    return g.select("gene", "disease", "n_total_variants", "n_pathogenic", "max_pathogenic_af", "sum_pathogenic_af",
                    F.round("disease_prs", 4).alias("disease_prs"))


_PANEL_SQL = """
WITH g AS (SELECT p_brand AS gene, count(*) AS n_total_variants, count(*) FILTER (WHERE l_linenumber IN (1, 2)) AS n_pathogenic,
                  coalesce(max(l_discount) FILTER (WHERE l_linenumber IN (1, 2)), 0.0) AS max_pathogenic_af,
                  round(coalesce(sum(l_discount) FILTER (WHERE l_linenumber IN (1, 2)), 0.0), 8) AS sum_pathogenic_af
           FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand),
d AS (SELECT *, CASE WHEN substr(gene, 1, 7) IN ('Brand#1', 'Brand#2') THEN
        CASE WHEN contains(lower(gene), 'brand#1') THEN 'AD' WHEN contains(lower(gene), 'brand#2') THEN 'PD' ELSE 'other' END
        ELSE 'other' END AS disease FROM g)
SELECT gene, disease, n_total_variants, n_pathogenic, max_pathogenic_af, sum_pathogenic_af,
       round(least(sum(n_pathogenic) OVER (PARTITION BY disease) * 0.15, 3.0), 4) AS disease_prs FROM d
"""


def top_n_collect(spark, sf):
    li = table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_discount"])
    p = table(spark, sf, "part", ["p_partkey", "p_brand"])
    v = li.join(p, li.l_partkey == p.p_partkey).filter(F.col("l_linenumber").isin(1, 2)) \
          .withColumn("variant", F.format_string("%d:%d", F.col("l_orderkey"), F.col("l_linenumber")))
    top = top_k_per_group(v, ["p_brand"], [F.col("l_discount").desc(), F.col("l_orderkey"), F.col("l_linenumber")],
                          20, salt_of=F.xxhash64("l_orderkey"))
    return top.groupBy("p_brand").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "variant"))), lambda s: s["variant"]),
                     ",").alias("top_variants"))


_TOPN_SQL = """
WITH v AS (SELECT p_brand, l_orderkey || ':' || l_linenumber AS variant,
                  row_number() OVER (PARTITION BY p_brand ORDER BY l_discount DESC, l_orderkey, l_linenumber) AS rk
           FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber IN (1, 2))
SELECT p_brand, string_agg(variant, ',' ORDER BY rk) AS top_variants FROM v WHERE rk <= 20 GROUP BY p_brand
"""

HMAC_KEY = "clinlake-demo-key"


def keyed_hash(spark, sf):
    c = table(spark, sf, "customer", ["c_custkey", "c_name"])
    return c.select("c_custkey", F.sha2(F.concat_ws("|", F.col("c_custkey").cast("string"), "c_name"), 256).alias("entry_hash"),
                    F.substring(hmac_sha256_hex(F.col("c_name"), HMAC_KEY), 1, 16).alias("pseudonym"))


def _hmac_sql():
    kb = HMAC_KEY.encode().ljust(64, b"\0")
    ipad = bytes(b ^ 0x36 for b in kb).hex()
    opad = bytes(b ^ 0x5C for b in kb).hex()
    inner = f"unhex(sha256(unhex('{ipad}') || c_name::BLOB))"
    return (f"SELECT c_custkey, sha256(concat_ws('|', CAST(c_custkey AS VARCHAR), c_name)) AS entry_hash, "
            f"substr(sha256(unhex('{opad}') || {inner}), 1, 16) AS pseudonym FROM customer")


def date_functions(spark, sf):
    o = table(spark, sf, "orders", ["o_orderkey", "o_orderdate"])
    ns = F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000
    label = F.date_format("o_orderdate", "yyyy MMM")
    return o.select(
        "o_orderkey",
        F.datediff(F.lit("2002-01-01").cast("date"), F.to_date("o_orderdate")).alias("age_days"),
        F.round(F.datediff(F.lit("2002-01-01").cast("date"), F.to_date("o_orderdate")) / 30.4375, 6).alias("age_months"),
        F.date_trunc("week", "o_orderdate").alias("week"),
        (F.floor(F.year("o_orderdate") / 10) * 10).cast("int").alias("decade"),
        F.split(label, r"\s+").getItem(0).try_cast("int").alias("year_parsed"),
        F.timestamp_micros(F.floor(ns / 1000)).cast("timestamp_ntz").alias("from_ns"))


_DATE_SQL = """
SELECT o_orderkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS INTEGER) AS age_days,
       round(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') / 30.4375, 6) AS age_months,
       date_trunc('week', o_orderdate) AS week, CAST(floor(year(o_orderdate) / 10) * 10 AS INTEGER) AS decade,
       CAST(year(o_orderdate) AS INTEGER) AS year_parsed, o_orderdate AS from_ns
FROM orders
"""


def json_roundtrip(spark, sf):
    ev = table(spark, sf, "events", ["event_id", "event_type", "props"])
    k = F.from_json("props", "k long")["k"]
    return ev.select("event_id", k.alias("k"),
                     F.to_json(F.struct(F.col("event_type"), k.alias("k"))).alias("payload"),
                     F.try_parse_json("props").isNotNull().alias("valid_json"))


_JSON_SQL = """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
       to_json({'event_type': event_type, 'k': CAST(json_extract(props, '$.k') AS BIGINT)}) AS payload,
       json_valid(props) AS valid_json FROM events
"""


def cdr_rule_expansion(spark, sf):
    p = table(spark, sf, "part", ["p_partkey", "p_size"])
    cdr = F.floor(F.col("p_size") / 10) / 2.0
    feats = encode.cdr_expansion(cdr)
    return p.select("p_partkey", cdr.alias("cdr"), *[v.alias(k) for k, v in feats.items()])


def _cdr_sql():
    c = "(floor(p_size / 10) / 2.0)"
    flags = {"MemoryComplaints": "> 0", "BehavioralProblems": ">= 1", "Confusion": ">= 1", "Disorientation": ">= 1",
             "PersonalityChanges": ">= 0.5", "DifficultyCompletingTasks": ">= 0.5", "Forgetfulness": "> 0"}
    cols = [f"least(greatest(10.0 - {c} * 3.0, 0.0), 10.0) AS FunctionalAssessment",
            f"least(greatest(10.0 - {c} * 2.5, 0.0), 10.0) AS ADL"]
    cols += [f"CAST({c} {op} AS DOUBLE) AS {k}" for k, op in flags.items()]
    return f"SELECT p_partkey, {c} AS cdr, {', '.join(cols)} FROM part"


def group_mean_fill(spark, sf):
    ev = table(spark, sf, "events", ["event_id", "user_id", "event_type", "value"])
    s = ev.withColumn("x", F.when(F.col("event_type") != "signup", F.col("value")))
    out = panel.group_mean_fill(s, ["user_id"], "x", out="x_filled")
    return out.select("event_id", "user_id", F.round("x_filled", 6).alias("x_filled"))


_GMF_SQL = """
WITH s AS (SELECT event_id, user_id, CASE WHEN event_type <> 'signup' THEN value END AS x FROM events)
SELECT event_id, user_id, round(coalesce(x, avg(x) OVER (PARTITION BY user_id)), 6) AS x_filled FROM s
"""


QUERIES = {
    "two_key_left_join": two_key_left_join,
    "multi_join_on_predicates": multi_join_on_predicates,
    "override_merge": override_merge,
    "first_claim": first_claim,
    "graph_pattern_join": graph_pattern_join,
    "document_quality_filter": document_quality_filter,
    "availability_probe": availability_probe,
    "group_size_filter": group_size_filter,
    "regex_id_check": regex_id_check,
    "global_topk_abs": global_topk_abs,
    "quota_selection": quota_selection,
    "segment_mode": segment_mode,
    "latency_percentiles": latency_percentiles,
    "gene_panel_summary": gene_panel_summary,
    "top_n_collect": top_n_collect,
    "keyed_hash": keyed_hash,
    "date_functions": date_functions,
    "json_roundtrip": json_roundtrip,
    "cdr_rule_expansion": cdr_rule_expansion,
    "group_mean_fill": group_mean_fill,
}

ORACLE = {
    "two_key_left_join": _TWO_KEY_SQL,
    "multi_join_on_predicates": _MULTI_JOIN_SQL,
    "override_merge": _OVERRIDE_SQL,
    "first_claim": _FIRST_CLAIM_SQL,
    "graph_pattern_join": _PATTERN_SQL,
    "document_quality_filter": _DOC_FILTER_SQL,
    "availability_probe": _AVAIL_SQL,
    "group_size_filter": _GROUP_SIZE_SQL,
    "regex_id_check": _REGEX_SQL,
    "global_topk_abs": _TOPK_SQL,
    "quota_selection": _QUOTA_SQL,
    "segment_mode": _MODE_SQL,
    "latency_percentiles": _LATENCY_SQL,
    "gene_panel_summary": _PANEL_SQL,
    "top_n_collect": _TOPN_SQL,
    "keyed_hash": _hmac_sql(),
    "date_functions": _DATE_SQL,
    "json_roundtrip": _JSON_SQL,
    "cdr_rule_expansion": _cdr_sql(),
    "group_mean_fill": _GMF_SQL,
}
