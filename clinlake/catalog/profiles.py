"""Profiling, contracts, PII and quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from clinlake.operators import contracts, drift, pii, profile
from clinlake.operators.contracts import Rule
from clinlake.session import table

LI_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _r6(c):
    return F.round(c, 6)


def profile_one_pass(spark, sf):
    li = table(spark, sf, "lineitem", LI_FEATURES)
    s = profile.summary(li, LI_FEATURES)
    return s.select("feature", _r6("mean").alias("mean"), _r6("sd").alias("sd"), "min", "max", "n")


def _profile_sql():
    parts = [f"SELECT '{c}' AS feature, round(CAST(sum(CAST({c} AS DECIMAL(28, 12))) AS DOUBLE) / count({c}), 6) AS mean, round(stddev_pop({c}), 6) AS sd, "
             f"min({c}) AS min, max({c}) AS max, count({c}) AS n FROM lineitem" for c in LI_FEATURES]
    return "\nUNION ALL\n".join(parts)


def completeness_by_group(spark, sf):
    li = table(spark, sf, "lineitem", ["l_returnflag", "l_quantity", "l_discount", "l_tax"])
    data = li.select("l_returnflag", F.col("l_quantity").alias("quantity"),
                     F.nullif("l_discount", F.lit(0.0)).alias("discount"),
                     F.nullif("l_tax", F.lit(0.0)).alias("tax"))
    return profile.completeness(data, ["quantity", "discount", "tax"], ["l_returnflag"])


_COMPLETENESS_SQL = "\nUNION ALL\n".join(
    f"SELECT l_returnflag, '{n}' AS column, round(avg(CASE WHEN {e} IS NOT NULL THEN 1.0 ELSE 0.0 END), 4) "
    f"AS completeness FROM lineitem GROUP BY l_returnflag"
    for n, e in [("quantity", "l_quantity"), ("discount", "nullif(l_discount, 0)"), ("tax", "nullif(l_tax, 0)")])


def value_prevalence(spark, sf):
    cust = table(spark, sf, "customer", ["c_mktsegment"])
    return profile.value_counts(cust, "c_mktsegment", rare_below=200)


_PREVALENCE_SQL = """
SELECT c_mktsegment, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS pct,
       count(*) < 200 AS is_rare
FROM customer GROUP BY c_mktsegment
"""

# Age bins (label, lo, hi) and disease columns of the age x disease table.
AGE_BINS = [("20-30", 20, 30), ("30-40", 30, 40), ("40-50", 40, 50),
            ("50-60", 50, 60), ("60-70", 60, 70), ("70+", 70, 200)]
DISEASES = ["Alzheimer's Disease", "Parkinson's Disease", "Multiple Sclerosis", "Epilepsy", "ALS",
            "Huntington's Disease"]
DISEASE_KEYS = ["ad", "pd", "ms", "ep", "als", "hd"]
# role mapping of market segments to diseases for the driver tables
SEGMENT_DISEASE = {"AUTOMOBILE": "Alzheimer's Disease", "BUILDING": "Parkinson's Disease",
                   "FURNITURE": "Multiple Sclerosis", "HOUSEHOLD": "Epilepsy", "MACHINERY": "ALS"}


def age_disease_histogram(spark, sf):
    cust = table(spark, sf, "customer", ["c_acctbal", "c_mktsegment"])
    m = F.create_map(*[x for k, v in SEGMENT_DISEASE.items() for x in (F.lit(k), F.lit(v))])
    data = cust.select((F.lit(20.0) + (F.col("c_acctbal") + F.lit(1000.0)) / F.lit(200.0)).alias("age"),
                       F.try_element_at(m, F.col("c_mktsegment")).alias("disease"))
    return profile.bucket_pivot(data, "age", AGE_BINS, "disease", DISEASES, DISEASE_KEYS)


def _age_sql():
    case_bin = " ".join(f"WHEN age >= {lo} AND age < {hi} THEN '{lab}'" for lab, lo, hi in AGE_BINS)
    case_dis = " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in SEGMENT_DISEASE.items())
    bins = ", ".join(f"('{lab}', {i})" for i, (lab, _, _) in enumerate(AGE_BINS))
    cols = ", ".join(f"coalesce(sum(CASE WHEN disease = '{d.replace(chr(39), chr(39) * 2)}' THEN 1 ELSE 0 END), 0) AS {k}"
                     for d, k in zip(DISEASES, DISEASE_KEYS))
    return f"""
WITH t AS (SELECT 20.0 + (c_acctbal + 1000.0) / 200.0 AS age,
                  CASE c_mktsegment {case_dis} END AS disease FROM customer),
b AS (SELECT CASE {case_bin} END AS range, disease FROM t),
dim(range, ord) AS (VALUES {bins})
SELECT dim.range, CAST(dim.ord AS INTEGER) AS ord, {cols}
FROM dim LEFT JOIN b ON dim.range = b.range GROUP BY dim.range, dim.ord
"""


def equal_width_histogram(spark, sf):
    li = table(spark, sf, "lineitem", ["l_quantity", "l_extendedprice"])
    h = profile.histogram(li, ["l_quantity", "l_extendedprice"], 20)
    return h.select("feature", "bin", _r6("bin_lo").alias("bin_lo"), _r6("bin_hi").alias("bin_hi"), "count")


def _hist_sql():
    long = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS value FROM lineitem" for c in
                              ["l_quantity", "l_extendedprice"])
    return f"""
WITH l AS ({long}),
r AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM l GROUP BY feature),
b AS (SELECT l.feature, CAST(coalesce(least(greatest(floor((value - lo) / nullif((hi - lo) / 20, 0)), 0), 19), 0) AS INTEGER) AS bin
      FROM l JOIN r USING (feature)),
c AS (SELECT feature, bin, count(*) AS n FROM b GROUP BY ALL),
g AS (SELECT feature, lo, hi, CAST(x AS INTEGER) AS bin FROM r, range(0, 20) t(x))
SELECT g.feature, g.bin, round(lo + g.bin * ((hi - lo) / 20), 6) AS bin_lo,
       round(lo + (g.bin + 1) * ((hi - lo) / 20), 6) AS bin_hi, coalesce(n, 0) AS count
FROM g LEFT JOIN c ON g.feature = c.feature AND g.bin = c.bin
"""


def outliers_iqr_z(spark, sf):
    li = table(spark, sf, "lineitem", LI_FEATURES)
    return profile.outlier_counts(li, LI_FEATURES)


def _outlier_sql():
    long = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS value FROM lineitem" for c in LI_FEATURES)
    return f"""
WITH l AS ({long}),
s AS (SELECT feature, avg(value) AS mu, stddev_pop(value) AS sd, count(*) AS n,
             quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM l GROUP BY feature),
c AS (SELECT feature, max(n) AS n,
        count(*) FILTER (WHERE abs((value - mu) / nullif(sd, 0)) > 4.0) AS z_outliers,
        count(*) FILTER (WHERE (q3 - q1) > 0 AND (value < q1 - 3.0 * (q3 - q1) OR value > q3 + 3.0 * (q3 - q1))) AS iqr_outliers
      FROM l JOIN s USING (feature) GROUP BY feature)
SELECT feature, n, z_outliers, iqr_outliers,
       CAST(CASE WHEN n < 10 THEN 0 ELSE greatest(z_outliers, iqr_outliers) END AS BIGINT) AS outliers FROM c
"""


ORDER_RULES = [
    Rule("o_totalprice", "range", lo=0.0, hi=400000.0, nullable=False),
    Rule("o_orderstatus", "in_set", values=("F", "O"), nullable=False),
    Rule("o_orderpriority", "regex", pattern="^[1-3]-", nullable=False),
    Rule("o_custkey", "not_null"),
]


def contract_quarantine(spark, sf):
    o = table(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority"])
    v = contracts.validate(o, ORDER_RULES)
    return v.select("o_orderkey", F.array_join("violations", ";").alias("violations"), "is_valid")


_CONTRACT_SQL = """
WITH v AS (SELECT o_orderkey, list_filter([
    CASE WHEN o_totalprice IS NULL OR o_totalprice < 0.0 OR o_totalprice > 400000.0 THEN 'o_totalprice:range' END,
    CASE WHEN o_orderstatus IS NULL OR o_orderstatus NOT IN ('F', 'O') THEN 'o_orderstatus:in_set' END,
    CASE WHEN o_orderpriority IS NULL OR NOT regexp_matches(o_orderpriority, '^[1-3]-') THEN 'o_orderpriority:regex' END,
    CASE WHEN o_custkey IS NULL THEN 'o_custkey:not_null' END], lambda x: x IS NOT NULL) AS arr FROM orders)
SELECT o_orderkey, array_to_string(arr, ';') AS violations, len(arr) = 0 AS is_valid FROM v
"""


def pii_scan(spark, sf):
    docs = table(spark, sf, "documents", ["doc_id", "text"])
    return pii.pii_hits(docs, "doc_id", ["text"])


def _pii_scan_sql():
    parts = []
    for n, p in pii.PII_PATTERNS.items():
        flags = ""
        pat = p
        if pat.startswith("(?i)"):
            pat, flags = pat[4:], ", 'i'"
        parts.append(f"SELECT 'text' AS column, doc_id, '{n}' AS pattern, "
                     f"CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END AS preview "
                     f"FROM documents WHERE text IS NOT NULL AND regexp_matches(text, $${pat}$${flags})")
    return "\nUNION ALL\n".join(parts)


def pii_scrub(spark, sf):
    docs = table(spark, sf, "documents", ["doc_id", "text"])
    return docs.select("doc_id", pii.scrub("text").alias("text_scrubbed"))


def _pii_scrub_sql():
    expr = "text"
    for n, p in pii.PII_PATTERNS.items():
        pat, flags = p, "'g'"
        if pat.startswith("(?i)"):
            pat, flags = pat[4:], "'gi'"
        expr = f"regexp_replace({expr}, $${pat}$$, '[REDACTED_{n.upper()}]', {flags})"
    return f"SELECT doc_id, {expr} AS text_scrubbed FROM documents"


def deid_counts(spark, sf):
    conv = table(spark, sf, "conversations", ["text"])
    rules = {k: p for k, (p, _) in pii.DEID_PATTERNS.items()}
    counts = pii.pattern_row_counts(conv, "text", rules)
    extra = conv.agg(F.count(F.lit(1)).alias("n_rows"),
                     F.count_if(~pii.any_pii("text")).alias("safe_rows"))
    return counts.crossJoin(extra).select(F.col("mrn").alias("mrn_rows"), F.col("dob").alias("dob_rows"),
                                          "n_rows", "safe_rows")


def _deid_sql():
    mrn = pii.DEID_PATTERNS["mrn"][0][4:]
    dob = pii.DEID_PATTERNS["dob"][0][4:]
    anyp = " OR ".join(
        f"coalesce(regexp_matches(text, $${p[4:] if p.startswith('(?i)') else p}$${', ' + chr(39) + 'i' + chr(39) if p.startswith('(?i)') else ''}), false)"
        for p in pii.PII_PATTERNS.values())
    return f"""
SELECT count(*) FILTER (WHERE regexp_matches(text, $${mrn}$$, 'i')) AS mrn_rows,
       count(*) FILTER (WHERE regexp_matches(text, $${dob}$$, 'i')) AS dob_rows,
       count(*) AS n_rows, count(*) FILTER (WHERE NOT ({anyp})) AS safe_rows
FROM conversations
"""


def quality_score(spark, sf):
    """Batch quality score of documents joined with their labels: mean
    completeness - 0.1 drift alert - min(0.2, 0.02 pii flags) - min(0.15, 0.5 outlier ratio)."""
    docs = table(spark, sf, "documents", ["doc_id", "text", "lang", "source", "n_chars"])
    labels = table(spark, sf, "labels", ["doc_id", "quality", "toxic"])
    batch = docs.join(labels, "doc_id", "left")
    cols = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]
    comp = profile.completeness(batch, cols).agg(F.avg("completeness").alias("completeness_avg"))
    long = batch.select(F.when(F.col("lang") == "en", "ref").otherwise("cur").alias("side"),
                        F.lit("n_chars").alias("feature"), F.col("n_chars").cast("double").alias("value"))
    p = drift.psi(long, "smoothed").agg(F.max(F.col("psi") >= drift.PSI_CRITICAL).alias("drift_alert"))
    flags = pii.pii_hits(batch, "doc_id", ["text", "lang", "source"]).agg(F.count(F.lit(1)).alias("pii_flags"))
    outl = profile.outlier_counts(batch, ["n_chars", "quality", "toxic"]).agg(
        F.sum("outliers").alias("outlier_count"))
    n = batch.agg(F.count(F.lit(1)).alias("n_rows"))
    one = comp.crossJoin(p).crossJoin(flags).crossJoin(outl).crossJoin(n)
    score = F.greatest(F.lit(0.0),
                       F.col("completeness_avg") - F.when(F.col("drift_alert"), 0.1).otherwise(0.0)
                       - F.least(F.lit(0.2), F.col("pii_flags") * 0.02)
                       - F.least(F.lit(0.15), F.col("outlier_count") / F.greatest(F.col("n_rows"), F.lit(1)) * 0.5))
    return one.select("n_rows", _r6("completeness_avg").alias("completeness_avg"), "drift_alert", "pii_flags",
                      F.col("outlier_count").cast("long").alias("outlier_count"), _r6(score).alias("quality_score"))


def _quality_sql():
    cols = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]
    comp = " + ".join(f"round(avg(CASE WHEN {c} IS NOT NULL THEN 1.0 ELSE 0.0 END), 4)" for c in cols)
    hits = []
    for n, p in pii.PII_PATTERNS.items():
        pat, flags = (p[4:], ", 'i'") if p.startswith("(?i)") else (p, "")
        for c in ("text", "lang", "source"):
            hits.append(f"SELECT 1 FROM b WHERE {c} IS NOT NULL AND regexp_matches({c}, $${pat}$${flags})")
    long = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM b" for c in
                              ("n_chars", "quality", "toxic"))
    return f"""
WITH b AS (SELECT d.doc_id, text, lang, source, n_chars, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
comp AS (SELECT ({comp}) / {len(cols)}.0 AS completeness_avg, count(*) AS n_rows FROM b),
l AS (SELECT CASE WHEN lang = 'en' THEN 'ref' ELSE 'cur' END AS side, CAST(n_chars AS DOUBLE) AS value FROM b),
r AS (SELECT min(value) AS lo, max(value) AS hi, count(*) FILTER (WHERE side = 'ref') AS n_ref,
             count(*) FILTER (WHERE side = 'cur') AS n_cur FROM l WHERE value IS NOT NULL),
bn AS (SELECT side, CAST(coalesce(least(greatest(floor((value - lo) / nullif((hi - lo) / 10, 0)), 0), 9), 0) AS INTEGER) AS bin
       FROM l, r WHERE value IS NOT NULL),
c AS (SELECT bin, count(*) FILTER (WHERE side = 'ref') AS c_ref, count(*) FILTER (WHERE side = 'cur') AS c_cur FROM bn GROUP BY bin),
g AS (SELECT CAST(x AS INTEGER) AS bin, n_ref::DOUBLE AS nr, n_cur::DOUBLE AS nc FROM range(0, 10) t(x), r),
j AS (SELECT nr, nc, coalesce(c_ref, 0)::DOUBLE AS cr, coalesce(c_cur, 0)::DOUBLE AS cc FROM g LEFT JOIN c ON g.bin = c.bin),
psi AS (SELECT CASE WHEN max(nr) < 10 OR max(nc) < 10 THEN 0.0 ELSE greatest(sum(((cc + 1e-6) / (nc + 1e-6 * 10) - (cr + 1e-6) / (nr + 1e-6 * 10))
              * ln(((cc + 1e-6) / (nc + 1e-6 * 10)) / ((cr + 1e-6) / (nr + 1e-6 * 10)))), 0.0) END AS psi FROM j),
pii AS (SELECT count(*) AS pii_flags FROM ({' UNION ALL '.join(hits)})),
ol AS ({long}),
os AS (SELECT feature, avg(value) AS mu, stddev_pop(value) AS sd, count(*) AS n,
              quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM ol WHERE value IS NOT NULL GROUP BY feature),
oc AS (SELECT feature, max(n) AS n, count(*) FILTER (WHERE abs((value - mu) / nullif(sd, 0)) > 4.0) AS z,
              count(*) FILTER (WHERE (q3 - q1) > 0 AND (value < q1 - 3.0 * (q3 - q1) OR value > q3 + 3.0 * (q3 - q1))) AS iq
       FROM ol JOIN os USING (feature) WHERE value IS NOT NULL GROUP BY feature),
o AS (SELECT sum(CASE WHEN n < 10 THEN 0 ELSE greatest(z, iq) END) AS outlier_count FROM oc)
SELECT n_rows, round(completeness_avg, 6) AS completeness_avg, psi >= 0.25 AS drift_alert, pii_flags,
       CAST(outlier_count AS BIGINT) AS outlier_count,
       round(greatest(0.0, completeness_avg - CASE WHEN psi >= 0.25 THEN 0.1 ELSE 0.0 END - least(0.2, pii_flags * 0.02)
                      - least(0.15, outlier_count / greatest(n_rows, 1) * 0.5)), 6) AS quality_score
FROM comp, psi, pii, o
"""


QUERIES = {
    "profile_one_pass": profile_one_pass,
    "completeness_by_group": completeness_by_group,
    "value_prevalence": value_prevalence,
    "age_disease_histogram": age_disease_histogram,
    "equal_width_histogram": equal_width_histogram,
    "outliers_iqr_z": outliers_iqr_z,
    "contract_quarantine": contract_quarantine,
    "pii_scan": pii_scan,
    "pii_scrub": pii_scrub,
    "deid_counts": deid_counts,
    "quality_score": quality_score,
}

ORACLE = {
    "profile_one_pass": _profile_sql(),
    "completeness_by_group": _COMPLETENESS_SQL,
    "value_prevalence": _PREVALENCE_SQL,
    "age_disease_histogram": _age_sql(),
    "equal_width_histogram": _hist_sql(),
    "outliers_iqr_z": _outlier_sql(),
    "contract_quarantine": _CONTRACT_SQL,
    "pii_scan": _pii_scan_sql(),
    "pii_scrub": _pii_scrub_sql(),
    "deid_counts": _deid_sql(),
    "quality_score": _quality_sql(),
}
