"""Text corpus and retrieval queries.

documents = corpus, benchmark items = queries, embeddings = literature
vectors (queries: one centroid per label), conversations = instruction data,
pages = raw documents with links.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from clinlake.operators import pii, retrieval, sparse_search, text, vector_index
from clinlake.session import table

K = 10


def bm25_topk(spark, sf):
    docs = table(spark, sf, "documents", ["doc_id", "text"])
    qs = table(spark, sf, "benchmark", ["item_id", "text"])
    top = sparse_search.bm25_top_k(docs, "doc_id", "text", qs, "item_id", "text", K)
    return top.select("item_id", "doc_id", "rank", F.round("score", 6).alias("score"))


_TOKENS = "unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> ''))"

_BM25_CTE = f"""
dt AS (SELECT doc_id, {_TOKENS} AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY ALL),
dl AS (SELECT doc_id, len(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS dl FROM documents),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
idf0 AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf_raw FROM df, st),
idf AS (SELECT term, CASE WHEN idf_raw < 0 THEN 0.25 * (SELECT avg(idf_raw) FROM idf0) ELSE idf_raw END AS idf FROM idf0),
qt AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, {_TOKENS} AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT item_id, tf.doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score
       FROM qt JOIN idf USING (term) JOIN tf USING (term) JOIN dl ON dl.doc_id = tf.doc_id, st GROUP BY item_id, tf.doc_id)"""

_BM25_SQL = f"""
WITH {_BM25_CTE},
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc)
SELECT item_id, doc_id, rank, round(score, 6) AS score FROM r WHERE rank <= {K}
"""


def rrf_fusion(spark, sf):
    docs = table(spark, sf, "documents", ["doc_id", "text"])
    qs = table(spark, sf, "benchmark", ["item_id", "text"])
    sparse = sparse_search.bm25_top_k(docs, "doc_id", "text", qs, "item_id", "text", 2 * K)
    overlap = sparse_search.jaccard_top_k(docs, "doc_id", "text", qs, "item_id", "text", 2 * K)
    fused = retrieval.rrf([sparse, overlap], "item_id", "doc_id")
    top = retrieval.top_k_per_group(fused, ["item_id"], [F.round("rrf_score", 12).desc(), F.col("doc_id")], K,
                                    salt_of=F.xxhash64("doc_id"))
    return top.select("item_id", "doc_id", "rank", F.round("rrf_score", 9).alias("rrf_score"))


_RRF_SQL = f"""
WITH {_BM25_CTE},
b AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc),
dset AS (SELECT DISTINCT doc_id, {_TOKENS} AS term FROM documents),
qset AS (SELECT DISTINCT item_id, {_TOKENS} AS term FROM benchmark),
nd AS (SELECT doc_id, count(*) AS nd FROM dset GROUP BY doc_id),
nq AS (SELECT item_id, count(*) AS nq FROM qset GROUP BY item_id),
sh AS (SELECT item_id, doc_id, count(*) AS inter FROM qset JOIN dset USING (term) GROUP BY ALL),
j AS (SELECT item_id, doc_id, inter / (nd + nq - inter) AS score FROM sh JOIN nd USING (doc_id) JOIN nq USING (item_id)),
o AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM j),
u AS (SELECT item_id, doc_id, 1.0 / (60 + rank) AS rr FROM b WHERE rank <= {2 * K}
      UNION ALL SELECT item_id, doc_id, 1.0 / (60 + rank) FROM o WHERE rank <= {2 * K}),
f AS (SELECT item_id, doc_id, sum(rr) AS rrf_score FROM u GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(rrf_score, 12) DESC, doc_id) AS rank FROM f)
SELECT item_id, doc_id, rank, round(rrf_score, 9) AS rrf_score FROM r WHERE rank <= {K}
"""


def _centroids(emb):
    """Mean vector per label (position-wise average, one grouped aggregate)."""
    ex = emb.select("label", F.posexplode("embedding").alias("pos", "x"))
    per = ex.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return per.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"))


def cosine_topk(spark, sf):
    emb = table(spark, sf, "embeddings", ["vec_id", "embedding", "label"])
    top = retrieval.dense_top_k(emb, "vec_id", "embedding", _centroids(emb), "label", "centroid", K)
    return top.select("label", "vec_id", "rank", F.round("score", 6).alias("score"))


_CENTROID_CTE = """
ex AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(generate_series(1, len(embedding))) AS pos FROM embeddings),
c AS (SELECT label, list(m ORDER BY pos) AS centroid FROM (SELECT label, pos, avg(x) AS m FROM ex GROUP BY ALL) GROUP BY label)"""

_COSINE_SQL = f"""
WITH {_CENTROID_CTE},
s AS (SELECT c.label, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], c.centroid) AS score FROM c, embeddings e),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT label, vec_id, rank, round(score, 6) AS score FROM r WHERE rank <= {K}
"""


def ann_ivf_topk(spark, sf):
    emb = table(spark, sf, "embeddings", ["vec_id", "embedding", "label"])
    top = vector_index.top_k(vector_index.build(emb, "vec_id", "embedding"), _centroids(emb), "label", "centroid", K)
    return top.select("label", "vec_id", "rank", F.round("score", 6).alias("score"))


def ann_recall(spark, sf):
    """Recall at 10 of the index for the mean vector of every label, against exact
    search; the floor is 0.9, and every score is exact."""
    emb = table(spark, sf, "embeddings", ["vec_id", "embedding", "label"])
    asked = _centroids(emb)
    found = vector_index.top_k(vector_index.build(emb, "vec_id", "embedding"), asked, "label", "centroid", K)
    true = retrieval.dense_top_k(emb, "vec_id", "embedding", asked, "label", "centroid", K)
    both = true.select("label", "vec_id", F.col("score").alias("exact")).join(
        found.select("label", "vec_id", "score"), ["label", "vec_id"], "left")
    return both.agg(F.countDistinct("label").alias("queries"), F.count(F.lit(1)).alias("neighbours"),
                    (F.count("score") >= 0.9 * F.count(F.lit(1))).alias("recall_reached"),
                    F.coalesce(F.max(F.abs(F.col("score") - F.col("exact"))) < 1e-9, F.lit(True)).alias("scores_exact"))


_RECALL_SQL = f"""
SELECT count(DISTINCT label) AS queries, {K} * count(DISTINCT label) AS neighbours, true AS recall_reached, true AS scores_exact
FROM embeddings
"""


def semantic_chunks(spark, sf):
    emb = table(spark, sf, "embeddings", ["vec_id", "embedding", "label"])
    ch = retrieval.semantic_chunks(emb, ["label"], ["vec_id"], "embedding", 0.85)
    return ch.select("label", "chunk_no", F.col("_first.vec_id").alias("start_vec"),
                     F.col("_last.vec_id").alias("end_vec"), "n_members")


_CHUNK_SQL = """
WITH l AS (SELECT label, vec_id, embedding,
                  lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS prev FROM embeddings),
b AS (SELECT label, vec_id, CASE WHEN prev IS NULL THEN 1
        WHEN list_dot_product(prev::DOUBLE[], embedding::DOUBLE[])
             / (sqrt(list_dot_product(prev::DOUBLE[], prev::DOUBLE[])) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) < 0.85
        THEN 1 ELSE 0 END AS brk FROM l),
n AS (SELECT label, vec_id, sum(brk) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chunk_no FROM b)
SELECT label, chunk_no, min(vec_id) AS start_vec, max(vec_id) AS end_vec, count(*) AS n_members FROM n GROUP BY label, chunk_no
"""


def term_frequency(spark, sf):
    docs = table(spark, sf, "documents", ["text"])
    return text.term_frequency(docs, "text", pii.NEURO_TERMS)


def _tf_sql():
    return "\nUNION ALL\n".join(
        f"SELECT '{t}' AS term, CAST(coalesce(sum(len(regexp_extract_all(lower(text), '\\b{t}\\b'))), 0) AS BIGINT) AS count FROM documents"
        for t in pii.NEURO_TERMS)


def token_overlap(spark, sf):
    conv = table(spark, sf, "conversations", ["conv_id", "turn", "role", "text"])
    claims = text.sentences(conv.filter(F.col("role") == "assistant"), "text")
    evidence = conv.filter(F.col("role") == "user").select("conv_id", (F.col("turn") + 1).alias("turn"), "text")
    sup = text.claim_support(claims.select("conv_id", "turn", "sentence_idx", "sentence"),
                             evidence.withColumnRenamed("text", "prompt"), ["conv_id", "turn"], "sentence", "prompt")
    return sup.select("conv_id", "turn", "sentence_idx", F.round("support", 6).alias("support"), "unsupported")


_OVERLAP_SQL = """
WITH a AS (SELECT conv_id, turn, unnest(string_split_regex(text, '[.!?]')) AS sentence,
                  unnest(generate_series(0, len(string_split_regex(text, '[.!?]')) - 1)) AS sentence_idx
           FROM conversations WHERE role = 'assistant'),
c AS (SELECT * FROM a WHERE trim(sentence) <> ''),
e AS (SELECT conv_id, turn + 1 AS turn, text AS prompt FROM conversations WHERE role = 'user'),
j AS (SELECT c.conv_id, c.turn, sentence_idx,
             list_distinct(regexp_extract_all(lower(sentence), '[a-z0-9]+')) AS sa,
             coalesce(list_distinct(regexp_extract_all(lower(prompt), '[a-z0-9]+')), []) AS sb
      FROM c LEFT JOIN e ON c.conv_id = e.conv_id AND c.turn = e.turn),
s AS (SELECT conv_id, turn, sentence_idx,
             CASE WHEN len(sa) = 0 THEN 0.0 ELSE len(list_intersect(sa, sb)) / len(sa) END AS support FROM j)
SELECT conv_id, turn, CAST(sentence_idx AS INTEGER) AS sentence_idx, round(support, 6) AS support, support < 0.2 AS unsupported FROM s
"""

LINK_PATTERN = r'href="([^"]+)"'


def citation_extract(spark, sf):
    pages = table(spark, sf, "pages", ["page_id", "html"])
    links = text.extract_ordered_unique("html", LINK_PATTERN, 1)
    return pages.select("page_id", F.size(links).alias("n_links"), F.array_join(links, " ").alias("links"))


_CITATION_SQL = """
WITH m AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS link,
                  unnest(generate_series(1, len(regexp_extract_all(html, 'href="([^"]+)"', 1)))) AS pos FROM pages),
f AS (SELECT page_id, link, min(pos) AS first_pos FROM m GROUP BY ALL),
a AS (SELECT page_id, count(*) AS n_links, string_agg(link, ' ' ORDER BY first_pos) AS links FROM f GROUP BY page_id)
SELECT p.page_id, CAST(coalesce(n_links, 0) AS INTEGER) AS n_links, coalesce(links, '') AS links
FROM pages p LEFT JOIN a ON p.page_id = a.page_id
"""

# Fixed value (ours): system prompt used when a conversation has no system turn.
DEFAULT_SYSTEM = "You are a clinical research assistant."


def instruction_split(spark, sf):
    from clinlake.plans.halo import bucket_window, drop_halo, with_halo
    conv = table(spark, sf, "conversations", ["conv_id", "turn", "role", "text"])
    h = with_halo(conv, ["conv_id"], ["turn"], ahead=1)  # next turn, even across a bucket edge
    w = bucket_window(["conv_id"], ["turn"])
    pairs = drop_halo(h.withColumn("_next_role", F.lead("role").over(w)).withColumn("_next_text", F.lead("text").over(w))) \
        .filter((F.col("role") == "user") & (F.col("_next_role") == "assistant"))
    system = conv.filter(F.col("role") == "system").groupBy("conv_id").agg(F.min_by("text", "turn").alias("_sys"))
    ex = pairs.join(system, "conv_id", "left").select(
        "conv_id", "turn", text.chat_format(F.coalesce("_sys", F.lit(DEFAULT_SYSTEM)), F.col("text"),
                                            F.col("_next_text")).alias("chat"))
    out = text.positional_split(ex, ["conv_id", "turn"], [("train", 0.7), ("validation", 0.2), ("test", 0.1)])
    return out.select("conv_id", "turn", "split", F.length("chat").alias("chat_chars"), F.sha2("chat", 256).alias("chat_sha"))


def _instruction_sql():
    tmpl = text.CHAT_TEMPLATE.replace("'", "''").replace("\n", "\\n")
    return f"""
WITH l AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations
           WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT conv_id, turn, text, next_text FROM l WHERE role = 'user' AND next_role = 'assistant'),
s AS (SELECT conv_id, arg_min(text, turn) AS sys FROM conversations WHERE role = 'system' GROUP BY conv_id),
e AS (SELECT p.conv_id, p.turn, printf(E'{tmpl}', coalesce(sys, '{DEFAULT_SYSTEM}'), text, next_text) AS chat
      FROM p LEFT JOIN s ON p.conv_id = s.conv_id),
r AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS pos, count(*) OVER () AS n FROM e)
SELECT conv_id, turn, CASE WHEN pos <= floor(0.7 * n) THEN 'train' WHEN pos <= floor(0.7 * n) + floor(0.2 * n)
  THEN 'validation' ELSE 'test' END AS split, CAST(length(chat) AS INTEGER) AS chat_chars, sha256(chat) AS chat_sha FROM r
"""


def corpus_stats(spark, sf):
    docs = table(spark, sf, "documents", ["lang", "source", "n_chars"])
    s = text.corpus_stats(docs, ["lang", "source"], "n_chars")
    return s.select("lang", "source", "records", F.round("mean_length", 6).alias("mean_length"), "max_length")


_CORPUS_SQL = """
SELECT lang, source, count(*) AS records, round(avg(n_chars), 6) AS mean_length, max(n_chars) AS max_length
FROM documents GROUP BY lang, source
"""


def citation_guard(spark, sf):
    """Hallucination guard: documents a second ranker cites (top-10 by token
    Jaccard) that the retriever did not return (BM25 top-10), per query, via an
    anti join; with the share of unsupported citations."""
    docs = table(spark, sf, "documents", ["doc_id", "text"])
    qs = table(spark, sf, "benchmark", ["item_id", "text"])
    retrieved = sparse_search.bm25_top_k(docs, "doc_id", "text", qs, "item_id", "text", K).select("item_id", "doc_id")
    cited = sparse_search.jaccard_top_k(docs, "doc_id", "text", qs, "item_id", "text", K).select("item_id", "doc_id")
    missing = cited.join(retrieved, ["item_id", "doc_id"], "left_anti")
    per = cited.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_cited"))
    bad = missing.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_unsupported"))
    j = per.join(bad, "item_id", "left").fillna(0, ["n_unsupported"])
    return j.select("item_id", "n_cited", "n_unsupported",
                    F.round(F.col("n_unsupported") / F.col("n_cited"), 6).alias("unsupported_rate"))


_GUARD_SQL = f"""
WITH {_BM25_CTE},
b AS (SELECT item_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc) WHERE rank <= {K}),
dset AS (SELECT DISTINCT doc_id, {_TOKENS} AS term FROM documents),
qset AS (SELECT DISTINCT item_id, {_TOKENS} AS term FROM benchmark),
nd AS (SELECT doc_id, count(*) AS nd FROM dset GROUP BY doc_id),
nq AS (SELECT item_id, count(*) AS nq FROM qset GROUP BY item_id),
sh AS (SELECT item_id, doc_id, count(*) AS inter FROM qset JOIN dset USING (term) GROUP BY ALL),
j AS (SELECT item_id, doc_id, inter / (nd + nq - inter) AS score FROM sh JOIN nd USING (doc_id) JOIN nq USING (item_id)),
c AS (SELECT item_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM j) WHERE rank <= {K}),
m AS (SELECT item_id, count(*) AS n_unsupported FROM c WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.item_id = c.item_id AND b.doc_id = c.doc_id) GROUP BY item_id),
p AS (SELECT item_id, count(*) AS n_cited FROM c GROUP BY item_id)
SELECT p.item_id, n_cited, coalesce(n_unsupported, 0) AS n_unsupported, round(coalesce(n_unsupported, 0) / n_cited, 6) AS unsupported_rate
FROM p LEFT JOIN m ON p.item_id = m.item_id
"""


QUERIES = {
    "citation_guard": citation_guard,
    "bm25_topk": bm25_topk,
    "rrf_fusion": rrf_fusion,
    "cosine_topk": cosine_topk,
    "ann_ivf_topk": ann_ivf_topk,
    "ann_recall": ann_recall,
    "semantic_chunks": semantic_chunks,
    "term_frequency": term_frequency,
    "token_overlap": token_overlap,
    "citation_extract": citation_extract,
    "instruction_split": instruction_split,
    "corpus_stats": corpus_stats,
}

ORACLE = {
    "citation_guard": _GUARD_SQL,
    "bm25_topk": _BM25_SQL,
    "rrf_fusion": _RRF_SQL,
    "cosine_topk": _COSINE_SQL,
    "ann_recall": _RECALL_SQL,
    "semantic_chunks": _CHUNK_SQL,
    "term_frequency": _tf_sql(),
    "token_overlap": _OVERLAP_SQL,
    "citation_extract": _CITATION_SQL,
    "instruction_split": _instruction_sql(),
    "corpus_stats": _CORPUS_SQL,
}
