"""Text corpus operators: tokens, lexicon counts, claim support, citations,
sentence split, instruction split, corpus statistics (SURVEY 2.16).

All of it is native string/array expressions plus grouped aggregates; texts
are always processed whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinlake.plans.prefix import row_index

WORD_TOKEN = "[a-z0-9]+"


def whitespace_tokens(text: str | Column) -> Column:
    """``text.lower().split()``: lower-case, split on whitespace, no empty tokens."""
    t = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.lower(t), r"\s+"), "")


def word_set(text: str | Column) -> Column:
    """Distinct ``[a-z0-9]+`` tokens of the lower-cased text."""
    t = F.col(text) if isinstance(text, str) else text
    return F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(WORD_TOKEN), 0))


def term_frequency(df: DataFrame, text_col: str, lexicon: Sequence[str]) -> DataFrame:
    """Word-boundary occurrences of each lexicon term over the whole corpus:
    one ``regexp_count`` per term per row, summed in one aggregate, unpivoted."""
    low = F.lower(F.col(text_col))
    counts = df.agg(*[F.sum(F.regexp_count(low, F.lit(rf"\b{t}\b"))).alias(t) for t in lexicon])
    return counts.unpivot([], list(lexicon), "term", "count").withColumn(
        "count", F.coalesce(F.col("count"), F.lit(0)).cast("long"))


def sentences(df: DataFrame, text_col: str, pattern: str = "[.!?]") -> DataFrame:
    """Split on the sentence pattern, keep non-blank pieces, with their position."""
    pieces = df.select("*", F.posexplode(F.split(F.col(text_col), pattern)).alias("sentence_idx", "sentence"))
    return pieces.filter(F.trim("sentence") != "")


def claim_support(claims: DataFrame, evidence: DataFrame, keys: Sequence[str], claim_col: str,
                  evidence_col: str, threshold: float = 0.2) -> DataFrame:
    """support = |A n B| / |A| of claim and evidence word sets; unsupported below threshold."""
    j = claims.join(evidence.select(*keys, F.col(evidence_col).alias("_ev")), on=list(keys), how="left")
    a = word_set(claim_col)
    b = F.coalesce(word_set("_ev"), F.array().cast("array<string>"))
    support = F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))
    return j.withColumn("support", support).withColumn("unsupported", F.col("support") < threshold).drop("_ev")


def extract_ordered_unique(text: str | Column, pattern: str, group: int = 1) -> Column:
    """All matches of ``pattern`` (capture ``group``), distinct in first-appearance order."""
    t = F.col(text) if isinstance(text, str) else text
    return F.array_distinct(F.regexp_extract_all(t, F.lit(pattern), group))


def positional_split(df: DataFrame, order_cols: Sequence[str], fractions: Sequence[tuple[str, float]],
                     out: str = "split") -> DataFrame:
    """Split by position along ``order_cols``: cut points int(f * n) from the
    row count, positions from the skew-safe global row index."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    idx = row_index(df, [], list(order_cols), "_pos").crossJoin(F.broadcast(n))  # one-row side
    cond, acc = None, F.lit(0)
    names = [nm for nm, _ in fractions]
    for i, (nm, f) in enumerate(fractions[:-1]):
        acc = acc + F.floor(F.lit(f) * F.col("_n"))
        cond = F.when(F.col("_pos") <= acc, nm) if cond is None else cond.when(F.col("_pos") <= acc, nm)
    label = (cond.otherwise(names[-1]) if cond is not None else F.lit(names[-1]))
    return idx.withColumn(out, label).drop("_n")


# Chat template markers of the instruction format.
CHAT_TEMPLATE = ("<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n%s<|eot_id|>\n"
                 "<|start_header_id|>user<|end_header_id|>\n%s<|eot_id|>\n"
                 "<|start_header_id|>assistant<|end_header_id|>\n%s<|eot_id|>")


def chat_format(system: Column, user: Column, assistant: Column) -> Column:
    return F.format_string(CHAT_TEMPLATE, system, user, assistant)


def corpus_stats(df: DataFrame, group_cols: Sequence[str], length_col: str) -> DataFrame:
    return df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("records"),
                                       F.avg(length_col).alias("mean_length"),
                                       F.max(length_col).alias("max_length"))


def evidence_block(ranked: DataFrame, key: str, rank: str, doc_id: str, lang: str, source: str, text_col: str,
                   cut: int = 600, header: str = "Relevant documents:") -> DataFrame:
    """Numbered evidence passages per query (text cut to ``cut`` characters with an
    ellipsis), joined in rank order; a query holds at most its top-k rows."""
    body = F.substring(F.col(text_col), 1, cut)
    ell = F.when(F.length(text_col) > cut, F.lit("…")).otherwise(F.lit(""))
    passage = F.concat(F.lit("["), F.col(rank).cast("string"), F.lit("] DOC"), F.col(doc_id).cast("string"),
                       F.lit(" ("), F.col(lang), F.lit(", "), F.col(source), F.lit(")\nText: "), body, ell, F.lit("\n"))
    g = ranked.groupBy(key).agg(F.count(F.lit(1)).alias("n_passages"),
                                F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), passage.alias("p"))))
                                .alias("_ps"))
    return g.select(key, "n_passages",
                    F.concat(F.lit(header + "\n"), F.array_join(F.transform("_ps", lambda s: s["p"]), "\n")).alias("context"))


REPORT_SCHEMA = ("intervention_recommendations array<struct<intervention: string, supporting_pmids: array<string>>>, "
                 "deterioration_forecast struct<dci_median: array<double>, dci_ci_80_lower: array<double>, "
                 "dci_ci_80_upper: array<double>, months_to_clinical_threshold: map<string, double>>, "
                 "uncertainty_flags array<string>")


def report_metrics(reports: DataFrame, id_col: str, json_col: str, known_ids: DataFrame, known_col: str) -> DataFrame:
    """Validity, citation hallucination and plausibility of generated JSON reports.

    valid = parses against the report schema with its three sections present;
    hallucination = cited ids (over valid reports) missing from ``known_ids``,
    via explode + anti join; plausibility = 1 - 0.25 per forecast point not
    satisfying 0 <= lower < median < upper <= 100, - 0.25 for a non-positive
    months-to-threshold estimate, - 0.25 without uncertainty flags, floored at
    0 (0 for an invalid report).  One row of rates."""
    parsed = reports.select(id_col, F.from_json(F.col(json_col), REPORT_SCHEMA).alias("r"))
    valid = (F.col("r").isNotNull() & F.col("r.intervention_recommendations").isNotNull()
             & F.col("r.deterioration_forecast").isNotNull() & F.col("r.uncertainty_flags").isNotNull())
    p = parsed.withColumn("valid", valid)
    f = F.col("r.deterioration_forecast")
    pts = F.arrays_zip(f["dci_ci_80_lower"].alias("l"), f["dci_median"].alias("m"), f["dci_ci_80_upper"].alias("h"))
    bad_pts = F.size(F.filter(pts, lambda z: ~((z["l"] >= 0) & (z["l"] < z["m"]) & (z["m"] < z["h"]) & (z["h"] <= 100))))
    est = F.coalesce(F.try_element_at(f["months_to_clinical_threshold"], F.lit("estimate")), F.lit(0.0))
    score = (F.lit(1.0) - F.lit(0.25) * bad_pts - F.when(est <= 0, 0.25).otherwise(0.0)
             - F.when(F.size("r.uncertainty_flags") < 1, 0.25).otherwise(0.0))
    p = p.withColumn("plausibility", F.when(F.col("valid"), F.greatest(score, F.lit(0.0))).otherwise(0.0))
    cites = p.filter("valid").select(id_col, F.explode(F.flatten(F.transform(
        "r.intervention_recommendations", lambda rec: rec["supporting_pmids"]))).alias("_pmid"))
    bad = cites.join(known_ids.select(F.col(known_col).alias("_pmid")), "_pmid", "left_anti")
    counts = cites.agg(F.count(F.lit(1)).alias("_total")).crossJoin(bad.agg(F.count(F.lit(1)).alias("_bad")))
    rates = p.agg(F.avg(F.col("valid").cast("double")).alias("json_validity_rate"),
                  F.avg("plausibility").alias("clinical_plausibility"))
    return rates.crossJoin(counts).select(
        "json_validity_rate", (F.col("_bad") / F.greatest(F.col("_total"), F.lit(1))).alias("pmid_hallucination_rate"),
        "clinical_plausibility")
