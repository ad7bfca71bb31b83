"""Genomic operators.

Variant tables are long (patient, gene, variant, annotations); every
operator is a filter, a grouped aggregate or an equi-join with a dimension.
The interval (liftover) join bins positions so it is an equi-join plus a
range filter instead of a nested loop.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinlake.functions.exprs import nan_to_null
from clinlake.plans.broadcast import bounded_broadcast, runtime_sized


def af_weight(af: str | Column) -> Column:
    """min(1, -log10(af + 1e-6)) (always 1 after an af < 0.01 filter; kept as given)."""
    a = F.col(af) if isinstance(af, str) else af
    return F.least(F.lit(1.0), -F.log10(a.cast("double") + F.lit(1e-6)))


def rare_burden(variants: DataFrame, patient: str, gene: str, impact: str, af: str, cadd: str,
                impacts=(1, 2), max_af: float = 0.01) -> DataFrame:
    """CADD rare-variant burden per (patient, gene): sum cadd * AF weight over
    variants with impact in ``impacts`` and af < ``max_af``."""
    v = variants.filter(F.col(impact).isin(list(impacts)) & (F.col(af) < max_af))
    return v.groupBy(patient, gene).agg(
        F.sum(nan_to_null(F.col(cadd).cast("double")) * af_weight(af)).alias("burden"))


def pathway_burden(burden: DataFrame, membership: DataFrame, patient: str, gene: str, pathway: str) -> DataFrame:
    """Mean gene burden over each pathway's genes, absent genes counting 0:
    sum of present burdens / pathway size (no patient x gene grid is built)."""
    size = membership.groupBy(pathway).agg(F.countDistinct(gene).alias("_size"))
    j = burden.join(membership.select(pathway, gene).distinct(), gene)
    s = j.groupBy(patient, pathway).agg(F.sum(F.coalesce("burden", F.lit(0.0))).alias("_sum"))
    return s.join(runtime_sized(size), pathway).select(patient, pathway, (F.col("_sum") / F.col("_size")).alias("pathway_burden"))


def risk_blend(prs: str | Column, rare: str | Column, w_prs: float = 0.7, w_rare: float = 0.3) -> Column:
    """sigmoid(0.7 * prs + 0.3 * tanh(rare))."""
    p = F.col(prs) if isinstance(prs, str) else prs
    r = F.col(rare) if isinstance(rare, str) else rare
    x = F.lit(w_prs) * p + F.lit(w_rare) * F.tanh(r)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def chi2_1df_critical(p: float) -> float:
    """x with P(chi2_1 > x) = p, from erfc by bisection (driver-side constant)."""
    lo, hi = 0.0, 200.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if math.erfc(math.sqrt(mid / 2)) > p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


HWE_P_MIN = 1e-6
HWE_CHI2_MAX = chi2_1df_critical(HWE_P_MIN)


def hwe_chi2(n: Column, p: Column) -> Column:
    """Chi-square (1 df) of the genotype counts n0, n1, n2 of ``n`` called samples
    against Hardy-Weinberg proportions at allele frequency ``p``."""
    q = 1 - p

    def term(o, e):
        return F.when(e > 0, F.pow(F.col(o) - e, 2) / e).otherwise(F.lit(0.0))
    return term("n0", n * q * q) + term("n1", 2 * n * p * q) + term("n2", n * p * p)


def variant_qc(genotypes: DataFrame, variant: str, sample: str, dosage: str, n_samples: Column,
               min_af: float = 0.01, min_call_rate: float = 0.98) -> DataFrame:
    """Per-variant allele frequency, call rate and HWE chi-square (1 df) from
    genotype counts; pass = af >= min_af, call rate >= min, HWE p >= 1e-6
    (equivalently chi2 <= the 1-df critical value)."""
    g = genotypes.select(variant, sample, F.col(dosage).cast("int").alias("_g"))
    c = g.groupBy(variant).agg(F.count("_g").alias("called"), F.count_if(F.col("_g") == 0).alias("n0"),
                               F.count_if(F.col("_g") == 1).alias("n1"), F.count_if(F.col("_g") == 2).alias("n2"),
                               F.sum("_g").alias("alt"))
    c = c.crossJoin(bounded_broadcast(n_samples))
    n = F.col("called").cast("double")
    p = F.col("alt") / (2 * n)
    chi2 = hwe_chi2(n, p)
    call_rate = n / F.col("_n_samples")
    af = F.least(p, 1 - p)
    return c.select(variant, "called", "n0", "n1", "n2", af.alias("maf"), call_rate.alias("call_rate"),
                    chi2.alias("hwe_chi2"),
                    ((af >= min_af) & (call_rate >= min_call_rate) & (chi2 <= HWE_CHI2_MAX)).alias("pass_qc"))


def sample_call_rate(genotypes: DataFrame, sample: str, dosage: str, n_variants: Column, min_rate: float = 0.95) -> DataFrame:
    s = genotypes.groupBy(sample).agg(F.count(dosage).alias("called"))
    s = s.crossJoin(bounded_broadcast(n_variants))
    rate = F.col("called") / F.col("_n_variants")
    return s.select(sample, rate.alias("call_rate"), (rate >= min_rate).alias("pass_qc"))


def interval_lift(positions: DataFrame, pos: str, segments: DataFrame, bin_size: int,
                  chrom: str | None = None) -> DataFrame:
    """Liftover by a binned range join.

    ``segments`` has (start, end, new_start, strand) with half-open [start, end).
    Each segment is exploded over the bins it covers (so the join is an
    equi-join on the bin), positions are matched with start <= pos < end, and
    lifted: new_start + (pos - start) on '+', new_start + (end - 1 - pos) on '-'.
    Unmapped positions keep their old value (left join).
    """
    keys = [chrom] if chrom else []
    seg = segments.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / bin_size),
                                                           F.floor((F.col("end") - 1) / bin_size))))
    p = positions.withColumn("_bin", F.floor(F.col(pos) / bin_size))
    cond = [p["_bin"] == seg["_bin"], p[pos] >= seg["start"], p[pos] < seg["end"]]
    cond += [p[k] == seg[k] for k in keys]
    j = p.join(seg.drop(*keys), cond, "left")
    lifted = F.when(F.col("strand") == "-", F.col("new_start") + (F.col("end") - 1 - F.col(pos))) \
              .otherwise(F.col("new_start") + (F.col(pos) - F.col("start")))
    out = j.withColumn("lifted", F.coalesce(lifted, F.col(pos))).withColumn("mapped", F.col("start").isNotNull())
    return out.drop(p["_bin"]).drop(seg["_bin"]).drop("start", "end", "new_start", "strand")


def parse_vcf_lines(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """VCF text lines -> variants: header lines skipped, tab split, first ALT only,
    INFO parsed with ``str_to_map`` (GENE taken from it)."""
    body = lines.filter(~F.col(text_col).startswith("#"))
    f = F.split(F.col(text_col), "\t")
    info = F.str_to_map(f.getItem(7), F.lit(";"), F.lit("="))
    return body.select(f.getItem(0).alias("chrom"), f.getItem(1).cast("long").alias("pos"),
                       f.getItem(2).alias("id"), f.getItem(3).alias("ref"),
                       F.split(f.getItem(4), ",").getItem(0).alias("alt"),
                       f.getItem(5).try_cast("double").alias("qual"),
                       f.getItem(6).alias("filter"), F.try_element_at(info, F.lit("GENE")).alias("gene"))


def polygenic_scores(genotypes: DataFrame, betas: DataFrame, variant: str, sample: str, dosage: str,
                     trait: str = "trait") -> DataFrame:
    """PRS = sum beta * dosage per (sample, trait), then z per trait (ddof 0, sd 0 -> 1)."""
    j = genotypes.join(betas, variant)
    prs = j.groupBy(sample, trait).agg(F.sum(F.col("beta") * F.col(dosage)).alias("prs"))
    st = prs.groupBy(trait).agg(F.avg("prs").alias("_m"), F.stddev_pop("prs").alias("_s"))
    k = prs.join(runtime_sized(st), trait)
    sd = F.when(F.coalesce(F.col("_s"), F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("_s"))
    return k.select(sample, trait, "prs", F.coalesce((F.col("prs") - F.col("_m")) / sd, F.lit(0.0)).alias("prs_z"))


# Codes of the annotation's categories.
CONSEQUENCE_CODES = {
    "intergenic_variant": 0, "intron_variant": 1, "synonymous_variant": 2, "missense_variant": 3, "stop_gained": 4,
    "splice_region_variant": 5, "splice_acceptor_variant": 6, "splice_donor_variant": 7, "frameshift_variant": 8,
    "start_lost": 9, "transcript_ablation": 10,
}
IMPACT_CODES = {"LOW": 0, "MODERATE": 1, "HIGH": 2, "MODIFIER": -1}
CLINVAR_CODES = {"benign": -1, "likely_benign": -1, "uncertain_significance": 0, "vus": 0, "likely_pathogenic": 1, "pathogenic": 2}


def variant_feature_matrix(annotated: DataFrame, prs: DataFrame, expression: DataFrame | None = None,
                           patient: str = "patient_id") -> DataFrame:
    """One row per (patient, annotated variant): the patient, variant_id and 16 encoded columns.

    ``annotated`` has the annotator's columns (any of them may be absent or null);
    ``prs`` (patient, prs_ad, prs_pd, prs_als) weighs every variant of a patient and
    ``expression`` (gene_symbol, gtex_brain_expression) every variant of a gene; what
    they lack counts as 0."""
    def given(name: str, default) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(default)) if name in annotated.columns else F.lit(default)

    def number(name: str, default: float) -> Column:
        return F.coalesce(nan_to_null(given(name, str(default)).try_cast("double")), F.lit(default))

    def code(value: Column, codes: dict[str, int], default: int) -> Column:
        known = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
        return F.coalesce(F.try_element_at(known, value), F.lit(default))
    place = F.split(given("Location", "0:0"), ":")
    rows = annotated.select(
        patient, given("variant_id", "").alias("variant_id"), given("SYMBOL", "UNK").alias("gene_symbol"),
        place[0].alias("chromosome"),
        F.coalesce(F.get(place, F.lit(1)).try_cast("double").cast("long"), F.lit(0)).alias("position"),
        given("Allele", "N").alias("ref"), given("Allele", "N").alias("alt"),
        code(F.split(given("Consequence", "intergenic_variant"), ",")[0], CONSEQUENCE_CODES, 0).alias("consequence_category"),
        code(given("IMPACT", "MODIFIER"), IMPACT_CODES, -1).alias("impact_score"),
        (F.least(F.greatest(number("CADD_PHRED", 0.0), F.lit(0.0)), F.lit(50.0)) / 50.0).alias("cadd_phred"),
        F.least(F.greatest(number("gnomADg_AF", 0.0), F.lit(0.0)), F.lit(1.0)).alias("gnomad_af"),
        code(F.lower(given("ClinVar_CLNSIG", "uncertain_significance")), CLINVAR_CODES, 0).alias("clinvar_encoded"),
        number("SIFT", 0.5).alias("sift_score"), number("PolyPhen", 0.5).alias("polyphen_score"))
    level = F.lit(0.0).alias("gtex_brain_expression")
    if expression is not None:
        rows = rows.join(runtime_sized(expression), "gene_symbol", "left")
        level = F.coalesce(F.col("gtex_brain_expression").cast("double"), F.lit(0.0)).alias("gtex_brain_expression")
    rows = rows.join(runtime_sized(prs), patient, "left")
    weights = [(F.coalesce(F.col(f"prs_{t}").cast("double"), F.lit(0.0)) if f"prs_{t}" in prs.columns else F.lit(0.0))
               .alias(f"prs_weight_{t}") for t in ("ad", "pd", "als")]
    return rows.select(patient, "variant_id", "gene_symbol", "chromosome", "position", "ref", "alt", "consequence_category",
                       "impact_score", "cadd_phred", "gnomad_af", "clinvar_encoded", "sift_score", "polyphen_score",
                       level, *weights)
