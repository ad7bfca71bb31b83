"""Linkage queries: pruning, clumping, components and the variant feature matrix.

Role mapping: variant = part, sample = nation of the customer, dosage = line items
of the part for that nation (2 at most; none: homozygous reference),
chromosome = brand number modulo 5, position = 5,000 base pairs a part; trait =
return flag, p-value = 10^(-quantity / 30), beta = mean discount - 0.0437.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from clinlake.operators import genomics, linkage
from clinlake.session import table

V, S, D = "variant", "sample", "dosage"
CLUMP_P, CLUMP_R2, CLUMP_BP = 5e-8, 0.1, 250_000


def _calls(spark, sf):
    li = table(spark, sf, "lineitem", ["l_partkey", "l_orderkey"])
    buyers = table(spark, sf, "orders", ["o_orderkey", "o_custkey"]).join(
        table(spark, sf, "customer", ["c_custkey", "c_nationkey"]), F.col("o_custkey") == F.col("c_custkey"))
    return li.join(buyers, li.l_orderkey == buyers.o_orderkey).groupBy(
        F.col("l_partkey").alias(V), F.col("c_nationkey").alias(S)).agg(F.least(F.count(F.lit(1)), F.lit(2)).alias(D))


def _samples(spark, sf):
    return table(spark, sf, "nation", ["n_nationkey"], spread_small=False).select(F.col("n_nationkey").alias(S))


def _qc(spark, sf, calls):
    """QC-passed variants with their place."""
    n = _samples(spark, sf).agg(F.count(F.lit(1)).alias("_n_samples"))
    good = linkage.sparse_variant_qc(calls, V, D, n).filter("pass_qc")
    part = table(spark, sf, "part", ["p_partkey", "p_brand"]).select(
        F.col("p_partkey").alias(V), (F.substring("p_brand", 7, 9).cast("int") % 5).alias("chrom"),
        (F.col("p_partkey") * 5000).alias("pos"))
    return good.join(part, V)


def _packed(spark, sf, calls, variants):
    return linkage.packed_variants(calls, _samples(spark, sf), variants.select(V, "chrom", "pos", "maf"), V, S, D)


def _pruned(spark, sf, window, step, max_r2):
    calls = linkage.stored(_calls(spark, sf))
    qc = linkage.stored(_qc(spark, sf, calls))
    return calls, qc, linkage.ld_prune(_packed(spark, sf, calls, qc), V, window, step, max_r2)


def sparse_variant_qc(spark, sf):
    n = _samples(spark, sf).agg(F.count(F.lit(1)).alias("_n_samples"))
    return linkage.sparse_variant_qc(_calls(spark, sf), V, D, n).select(
        V, "called", "n0", "n1", "n2", F.round("maf", 6).alias("maf"), F.round("hwe_chi2", 6).alias("hwe_chi2"), "pass_qc")


def ld_prune(spark, sf):
    """Windows of 1000 variants, step 200, r^2 0.3."""
    return _pruned(spark, sf, 1000, 200, 0.3)[2].select("chrom", "ord", V, "kept")


def ld_prune_sliding(spark, sf):
    """Windows of 50 variants, step 5, r^2 0.2: they slide on small tables too."""
    return _pruned(spark, sf, 50, 5, 0.2)[2].select("chrom", "ord", V, "kept")


def _leads(spark, sf):
    calls = linkage.stored(_calls(spark, sf))
    li = table(spark, sf, "lineitem", ["l_partkey", "l_returnflag", "l_quantity", "l_discount"])
    hits = li.groupBy(F.col("l_partkey").alias(V), F.col("l_returnflag").alias("trait")).agg(
        F.pow(F.lit(10.0), -F.sum("l_quantity") / 30.0).alias("p"), (F.avg("l_discount") - 0.0437).alias("beta"))
    qc = _qc(spark, sf, calls)
    candidates = linkage.stored(hits.filter(F.col("p") <= CLUMP_P).join(qc.select(V, "chrom", "pos", "maf"), V))
    edges = linkage.ld_pairs(_packed(spark, sf, calls, candidates.select(V, "chrom", "pos", "maf").distinct()), V, CLUMP_R2,
                             "pos", CLUMP_BP, CLUMP_BP, strict=False)
    return calls, linkage.clump(edges.select("left", "right"), candidates, ["trait"], V, "p")


def clumped_leads(spark, sf):
    """Lead variants per trait: p <= 5e-8, neighbours within 250 kb with r^2 >= 0.1 claimed."""
    return _leads(spark, sf)[1].select("trait", "chrom", V, F.round("beta", 9).alias("beta"))


def clumped_prs(spark, sf):
    """Polygenic score over the lead variants, z-scored per trait."""
    calls, leads = _leads(spark, sf)
    prs = genomics.polygenic_scores(calls, leads.select(V, "trait", "beta"), V, S, D)
    return prs.select(S, "trait", F.round("prs", 6).alias("prs"), F.round("prs_z", 6).alias("prs_z"))


N_PCS = 10


def _components(spark, sf):
    calls, qc, pruned = _pruned(spark, sf, 1000, 200, 0.3)
    kept = qc.join(pruned.filter("kept").select(V), V, "left_semi")
    return linkage.genotype_components(calls, _samples(spark, sf), kept, V, S, D, k=N_PCS)


def genotype_pca(spark, sf):
    """Ten principal components of every sample over all QC-passed, pruned variants."""
    pcs, _ = _components(spark, sf)
    return pcs.select(S, *[F.round(f"pc{i}", 5).alias(f"pc{i}") for i in range(1, N_PCS + 1)])


def genotype_pca_variance(spark, sf):
    """Eigenvalue and share of the variance of each component, and what remains
    unexplained after it (the relative squared reconstruction error)."""
    _, values = _components(spark, sf)
    left, rows = 1.0, []
    for i, (value, share) in enumerate(values, 1):
        left -= share
        rows.append((i, round(value, 6), round(share, 6), round(left, 6)))
    return spark.createDataFrame(rows, "component int, eigenvalue double, share double, unexplained double")


def variant_feature_matrix(spark, sf):
    """The 16 encoded columns of every annotated variant of every patient (supplier)."""
    su = table(spark, sf, "supplier", ["s_suppkey", "s_acctbal"])
    carried = table(spark, sf, "lineitem", ["l_suppkey", "l_partkey"]).distinct()
    part = table(spark, sf, "part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"])
    size = F.col("p_size")
    notes = part.select(
        "p_partkey", F.col("p_partkey").cast("string").alias("variant_id"), F.col("p_brand").alias("SYMBOL"),
        F.concat(F.substring("p_brand", 7, 9), F.lit(":"), F.when(size != 13, F.col("p_partkey").cast("string"))
                 .otherwise("unplaced")).alias("Location"), F.substring("p_name", 1, 1).alias("Allele"),
        F.element_at(F.array(*map(F.lit, CONSEQUENCES)), size % 7 + 1).alias("Consequence"),
        F.when(size % 5 < 4, F.element_at(F.array(*map(F.lit, IMPACTS)), F.least(size % 5, F.lit(3)) + 1)).alias("IMPACT"),
        F.when(size % 11 != 0, (size * 1.5).cast("string")).otherwise(".").alias("CADD_PHRED"),
        ((F.col("p_retailprice") - 900.0) / 80.0).alias("gnomADg_AF"),
        F.when(size % 3 != 0, F.element_at(F.array(*map(F.lit, CLINVARS)), size % 6 + 1)).alias("ClinVar_CLNSIG"),
        F.when(size % 4 != 0, (size / 50.0).cast("string")).otherwise("-").alias("SIFT"),
        F.when(size % 9 != 0, size / 100.0).alias("PolyPhen"))
    annotated = carried.join(notes, carried.l_partkey == notes.p_partkey).withColumnRenamed("l_suppkey", "patient_id")
    prs = su.select(F.col("s_suppkey").alias("patient_id"), (F.col("s_acctbal") / 10000.0).alias("prs_ad"),
                    F.when(F.col("s_acctbal") > 0, F.col("s_acctbal") / 5000.0).alias("prs_pd"))
    expression = part.filter("p_size > 25").groupBy(F.col("p_brand").alias("gene_symbol")).agg(
        F.max("p_retailprice").alias("gtex_brain_expression"))
    return genomics.variant_feature_matrix(annotated, prs, expression)


CONSEQUENCES = ["missense_variant,intron_variant", "intron_variant", "stop_gained", "frameshift_variant,stop_gained",
                "synonymous_variant", "start_lost", "unknown_kind"]
IMPACTS = ["LOW", "MODERATE", "HIGH", "MODIFIER"]
CLINVARS = ["Pathogenic", "likely_benign", "VUS", "likely_pathogenic", "benign", "conflicting"]


def _array(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _cases(column, mapping, default):
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in mapping.items()) + f" ELSE {default} END"


_MATRIX_SQL = f"""
WITH a AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem),
e AS (SELECT p_brand, max(p_retailprice) AS x FROM part WHERE p_size > 25 GROUP BY 1)
SELECT l_suppkey AS patient_id, CAST(p.p_partkey AS VARCHAR) AS variant_id, p.p_brand AS gene_symbol, substr(p.p_brand, 7) AS chromosome,
  CASE WHEN p_size <> 13 THEN p.p_partkey ELSE 0 END AS position, substr(p_name, 1, 1) AS ref, substr(p_name, 1, 1) AS alt,
  {_cases(f"string_split({_array(CONSEQUENCES)}[p_size % 7 + 1], ',')[1]", genomics.CONSEQUENCE_CODES, 0)} AS consequence_category,
  {_cases(f"CASE WHEN p_size % 5 < 4 THEN {_array(IMPACTS)}[p_size % 5 + 1] END", genomics.IMPACT_CODES, -1)} AS impact_score,
  CASE WHEN p_size % 11 <> 0 THEN least(p_size * 1.5, 50) / 50.0 ELSE 0 END AS cadd_phred,
  least(greatest((p_retailprice - 900.0) / 80.0, 0), 1) AS gnomad_af,
  {_cases(f"lower(CASE WHEN p_size % 3 <> 0 THEN {_array(CLINVARS)}[p_size % 6 + 1] END)", genomics.CLINVAR_CODES, 0)} AS clinvar_encoded,
  CASE WHEN p_size % 4 <> 0 THEN p_size / 50.0 ELSE 0.5 END AS sift_score,
  CASE WHEN p_size % 9 <> 0 THEN p_size / 100.0 ELSE 0.5 END AS polyphen_score, coalesce(e.x, 0.0) AS gtex_brain_expression,
  s_acctbal / 10000.0 AS prs_weight_ad, CASE WHEN s_acctbal > 0 THEN s_acctbal / 5000.0 ELSE 0.0 END AS prs_weight_pd,
  0.0 AS prs_weight_als
FROM a JOIN part p ON p.p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN e ON e.p_brand = p.p_brand
"""

_BASE_SQL = f"""
calls AS MATERIALIZED (SELECT l_partkey AS v, c_nationkey AS s, least(count(*), 2) AS g FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
counts AS (SELECT v, (SELECT count(*) FROM nation) AS n, count(*) FILTER (WHERE g = 1) AS n1, count(*) FILTER (WHERE g = 2) AS n2
    FROM calls GROUP BY v),
freq AS (SELECT *, n - n1 - n2 AS n0, (n1 + 2 * n2) / (2.0 * n) AS p FROM counts),
hwe AS (SELECT *, least(p, 1 - p) AS maf,
    CASE WHEN p < 1 THEN (n0 - n * (1 - p) * (1 - p)) ** 2 / (n * (1 - p) * (1 - p)) ELSE 0 END
    + CASE WHEN p > 0 AND p < 1 THEN (n1 - 2 * n * p * (1 - p)) ** 2 / (2 * n * p * (1 - p)) ELSE 0 END
    + CASE WHEN p > 0 THEN (n2 - n * p * p) ** 2 / (n * p * p) ELSE 0 END AS chi2 FROM freq),
good AS (SELECT v, n, p, maf, CAST(substr(p_brand, 7) AS INTEGER) % 5 AS chrom, v * 5000 AS pos FROM hwe JOIN part ON p_partkey = v
    WHERE maf >= 0.01 AND chi2 <= {genomics.HWE_CHI2_MAX!r})"""

_QC_SQL = f"""
WITH {_BASE_SQL}
SELECT v AS variant, n AS called, n0, n1, n2, round(maf, 6) AS maf, round(chi2, 6) AS hwe_chi2,
  maf >= 0.01 AND chi2 <= {genomics.HWE_CHI2_MAX!r} AS pass_qc FROM hwe
"""


def _pairs_sql(where):
    """r^2 of the placed variants' pairs (no call is missing here)."""
    return f"""
dense AS (SELECT o.chrom, o.ord, o.v, o.pos, o.maf, n_nationkey AS s, coalesce(g, 0) AS g FROM placed o CROSS JOIN nation
    LEFT JOIN calls ON calls.v = o.v AND calls.s = n_nationkey),
sums AS (SELECT v, count(*) AS n, sum(g) AS x, sum(g * g) AS xx FROM dense GROUP BY v),
prod AS (SELECT a.chrom, a.ord AS i, b.ord AS j, a.v AS l, b.v AS r, a.maf AS maf_i, b.maf AS maf_j, sum(a.g * b.g) AS xy
    FROM dense a JOIN dense b ON a.chrom = b.chrom AND a.s = b.s AND a.ord < b.ord AND {where} GROUP BY ALL),
pairs AS (SELECT prod.*, CAST(y.n * xy - y.x * z.x AS DOUBLE) * CAST(y.n * xy - y.x * z.x AS DOUBLE)
      / (CAST(y.n * y.xx - y.x * y.x AS DOUBLE) * CAST(z.n * z.xx - z.x * z.x AS DOUBLE)) AS r2
    FROM prod JOIN sums y ON y.v = l JOIN sums z ON z.v = r WHERE y.n * y.xx > y.x * y.x AND z.n * z.xx > z.x * z.x)"""


def _prune_sql(window, step, max_r2):
    """CTEs up to ``pruned``: the pairs taken one by one, in order."""
    first = f"greatest(0, CAST(floor((b.ord - {window}) / {step}.0) AS BIGINT) + 1) * {step}"
    return f"""{_BASE_SQL},
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY pos, v) - 1 AS ord FROM good),
{_pairs_sql(f"a.ord >= {first}")},
events AS MATERIALIZED (SELECT chrom, i, j, CASE WHEN maf_i < maf_j THEN i ELSE j END AS loser, row_number() OVER (PARTITION BY chrom
    ORDER BY greatest(0, CAST(floor((j - {window}) / {step}.0) AS BIGINT) + 1), i, j) AS k FROM pairs WHERE r2 > {max_r2}),
run AS (SELECT DISTINCT chrom, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS gone FROM placed
    UNION ALL SELECT run.chrom, events.k, CASE WHEN list_contains(gone, i) OR list_contains(gone, j) THEN gone
      ELSE list_append(gone, loser) END FROM run JOIN events ON events.chrom = run.chrom AND events.k = run.k + 1),
final AS (SELECT chrom, arg_max(gone, k) AS gone FROM run GROUP BY chrom),
pruned AS MATERIALIZED (SELECT placed.*, NOT list_contains(gone, ord) AS kept FROM placed JOIN final ON final.chrom = placed.chrom)"""


def _ld_sql(window, step, max_r2):
    return f"WITH RECURSIVE {_prune_sql(window, step, max_r2)}\nSELECT chrom, ord, v AS variant, kept FROM pruned"


_CLUMP_SQL = f"""{_BASE_SQL},
hits AS (SELECT l_partkey AS v, l_returnflag AS trait, power(10.0, -sum(l_quantity) / 30.0) AS p, avg(l_discount) - 0.0437 AS beta
    FROM lineitem GROUP BY ALL),
cand AS MATERIALIZED (SELECT hits.*, chrom, pos, row_number() OVER (PARTITION BY trait, chrom ORDER BY hits.p, v) AS k
    FROM hits JOIN good USING (v) WHERE hits.p <= {CLUMP_P!r}),
placed AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY pos, v) - 1 AS ord FROM good
    WHERE v IN (SELECT v FROM cand)),
{_pairs_sql(f"b.pos - a.pos <= {CLUMP_BP}")},
near AS MATERIALIZED (SELECT v, list(o) AS others FROM (SELECT l AS v, r AS o FROM pairs WHERE r2 >= {CLUMP_R2}
    UNION ALL SELECT r, l FROM pairs WHERE r2 >= {CLUMP_R2}) GROUP BY v),
run AS (SELECT DISTINCT trait, chrom, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS claimed FROM cand
    UNION ALL SELECT run.trait, run.chrom, cand.k, CASE WHEN list_contains(claimed, cand.v) THEN claimed
      ELSE list_concat(claimed, coalesce(others, [])) END
    FROM run JOIN cand ON cand.trait = run.trait AND cand.chrom = run.chrom AND cand.k = run.k + 1 LEFT JOIN near ON near.v = cand.v),
final AS (SELECT trait, chrom, arg_max(claimed, k) AS claimed FROM run GROUP BY ALL),
leads AS (SELECT cand.trait, cand.chrom, v, beta FROM cand JOIN final USING (trait, chrom) WHERE NOT list_contains(claimed, v))"""

_LEADS_SQL = f"WITH RECURSIVE {_CLUMP_SQL}\nSELECT trait, chrom, v AS variant, round(beta, 9) AS beta FROM leads"

_CLUMPED_PRS_SQL = f"""
WITH RECURSIVE {_CLUMP_SQL},
score AS (SELECT s, trait, sum(beta * g) AS prs FROM calls JOIN leads USING (v) GROUP BY ALL),
st AS (SELECT trait, avg(prs) AS m, stddev_pop(prs) AS sd FROM score GROUP BY trait)
SELECT s AS sample, score.trait, round(prs, 6) AS prs, round(coalesce((prs - m) / CASE WHEN coalesce(sd, 0) = 0 THEN 1 ELSE sd END, 0), 6) AS prs_z
FROM score JOIN st ON st.trait = score.trait
"""


def _components_sql(select):
    """Eigenvectors of the sample matrix one by one: squared 22 times (with trace 1) a
    matrix is its leading direction, which is then taken off."""
    ctes = [_prune_sql(1000, 200, 0.3), """
z AS (SELECT k.v, n_nationkey AS s, (coalesce(g, 0) - 2 * p) / sqrt(2 * p * (1 - p)) AS z FROM pruned k CROSS JOIN nation
    LEFT JOIN calls ON calls.v = k.v AND calls.s = n_nationkey WHERE kept),
size AS (SELECT count(*) AS m FROM pruned WHERE kept),
k1 AS MATERIALIZED (SELECT a.s AS i, b.s AS j, sum(a.z * b.z) AS x FROM z a JOIN z b USING (v) GROUP BY ALL),
total AS (SELECT sum(x) AS t FROM k1 WHERE i = j)"""]
    for c in range(1, N_PCS + 1):
        last = f"k{c}"
        for t in range(22):
            ctes.append(f"q{c}_{t} AS MATERIALIZED (SELECT a.i, b.j, sum(a.x * b.x) AS x FROM {last} a JOIN {last} b ON a.j = b.i GROUP BY ALL)")
            ctes.append(f"p{c}_{t} AS MATERIALIZED (SELECT i, j, x / (SELECT sum(x) FROM q{c}_{t} WHERE i = j) AS x FROM q{c}_{t})")
            last = f"p{c}_{t}"
        ctes.append(f"""m{c} AS MATERIALIZED (SELECT arg_max(i, x) AS m, max(x) AS d FROM {last} WHERE i = j),
u{c} AS MATERIALIZED (SELECT i, x / sqrt(d) AS u FROM {last}, m{c} WHERE j = m),
v{c} AS MATERIALIZED (SELECT i, u * CASE WHEN (SELECT arg_max(u, abs(u)) FROM u{c}) < 0 THEN -1 ELSE 1 END AS u FROM u{c}),
l{c} AS MATERIALIZED (SELECT sum(a.u * x * b.u) AS l FROM k{c} JOIN v{c} a ON a.i = k{c}.i JOIN v{c} b ON b.i = k{c}.j)""")
        ctes.append(f"k{c + 1} AS MATERIALIZED (SELECT k{c}.i, k{c}.j, x - l * a.u * b.u AS x FROM k{c} JOIN v{c} a ON a.i = k{c}.i "
                    f"JOIN v{c} b ON b.i = k{c}.j, l{c})")
    return f"WITH RECURSIVE {','.join(ctes)}\n{select}"


_PCA_SQL = _components_sql("SELECT v1.i AS sample, " + ", ".join(f"round(v{c}.u, 5) AS pc{c}" for c in range(1, N_PCS + 1))
                           + " FROM v1 " + " ".join(f"JOIN v{c} ON v{c}.i = v1.i" for c in range(2, N_PCS + 1)))
_VARIANCE_SQL = _components_sql(
    "SELECT component, round(l / m, 6) AS eigenvalue, round(l / t, 6) AS share, round(1 - sum(l / t) OVER (ORDER BY component), 6) AS unexplained "
    "FROM (" + " UNION ALL ".join(f"SELECT {c} AS component, l FROM l{c}" for c in range(1, N_PCS + 1)) + "), size, total")

QUERIES = {
    "sparse_variant_qc": sparse_variant_qc,
    "ld_prune": ld_prune,
    "ld_prune_sliding": ld_prune_sliding,
    "clumped_leads": clumped_leads,
    "clumped_prs": clumped_prs,
    "genotype_pca": genotype_pca,
    "genotype_pca_variance": genotype_pca_variance,
    "variant_feature_matrix": variant_feature_matrix,
}

ORACLE = {
    "sparse_variant_qc": _QC_SQL,
    "ld_prune": _ld_sql(1000, 200, 0.3),
    "ld_prune_sliding": _ld_sql(50, 5, 0.2),
    "clumped_leads": _LEADS_SQL,
    "clumped_prs": _CLUMPED_PRS_SQL,
    "genotype_pca": _PCA_SQL,
    "genotype_pca_variance": _VARIANCE_SQL,
    "variant_feature_matrix": _MATRIX_SQL,
}
