import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from clinlake.llm import source_audit
from tests.llm.data import SMOKE, documents, edge, empty

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_docs, top=50):
    """rows: (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    found = [(lang, source, TERM.findall(text.translate(LOWER))) for lang, source, text in rows]
    docs = Counter((lang, t) for lang, _, terms in found for t in set(terms))
    kept = defaultdict(list)
    for (lang, t), n in docs.items():
        if n >= min_docs:
            kept[lang].append(t)
    count = {(lang, s): Counter() for lang, s, _ in rows}
    for lang, s, terms in found:
        count[lang, s].update(t for t in terms if docs[lang, t] >= min_docs)
    whole = defaultdict(Counter)
    for (lang, _), c in count.items():
        whole[lang].update(c)

    def shares(c, lang):
        total = sum(c.values()) + 5 * len(kept[lang])
        return {t: 1 + 10 ** 9 * (c[t] + 5) // total for t in kept[lang]}
    out = set()
    p = {g: shares(c, g[0]) for g, c in count.items()}
    for (lang, s) in count:
        q = shares(whole[lang], lang)
        pairs = [(-sum(abs(p[lang, s][t] - p[lang, o][t]) for t in kept[lang]), o.encode())
                 for ln, o in count if ln == lang and o != s]
        terms = [(q[t] - p[lang, s][t], t.encode()) for t in kept[lang] if count[lang, s][t] and p[lang, s][t] > q[t]]
        for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out |= {(lang, s, part, item.decode(), -v, i) for i, (v, item) in enumerate(items, 1)}
    return out


def result(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


SMALL = {"shard_terms": 40, "block_bytes": 3_000, "dense_bytes": 2_000}


@pytest.mark.parametrize("how", [{}, SMALL])
def test_audit_against_brute_force(spark, how, monkeypatch):
    if how:  # many shards, blocks, drains, tiles and blocks of the comparison
        for name, value in (("HELD_WORDS", 500), ("HELD_TOKENS", 3_000), ("BLOCK_CELLS", 200)):
            monkeypatch.setattr(source_audit, name, value)
    docs = documents(spark)
    rows = [(r.lang, r.source, r.text) for r in docs.collect()]
    got = result(source_audit.audit(docs.repartition(3), min_docs=5, **how))
    assert got == brute(rows, 5) and {r[2] for r in got} == {"pair", "term"}


def test_query_against_its_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.01/documents.parquet')")
    rel = con.sql(source_audit.ORACLE["op11_mph_divergence"])
    got = source_audit.op11_mph_divergence(spark, "/root/testdata/sf0.01").select(*rel.columns)
    assert sorted(map(tuple, got.collect())) == sorted(rel.fetchall())


def test_a_third_of_all_rows_in_one_source_and_many_sources(spark):
    rnd = random.Random(3)
    rows = [("x" if i % 3 else "y", "hot" if i % 3 == 0 else f"s{rnd.randrange(300)}",
             " ".join(rnd.choice("abcdefghij") * 3 for _ in range(rnd.randrange(9)))) for i in range(1_500)]
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    assert result(source_audit.audit(df, min_docs=30)) == brute(rows, 30)


def test_edges(spark):
    rows = [(r.lang, r.source, r.text) for r in edge(spark).collect()]
    for min_docs in (1, 2, 30):  # with 30 there is no frequent term: all distances are 0
        got = result(source_audit.audit(edge(spark), min_docs=min_docs))
        assert got == brute(rows, min_docs) and got
    assert source_audit.audit(empty(spark)).count() == 0


def test_words_of_any_script(spark):
    rows = [("l", s, t) for s, t in [("a", "Ünï-CÖDE İstanbul ÀB c\u0085d"), ("b", "ünï cÖde 漢字 x_y\x00z\x7fw"),
                                     ("b", "İSTANBUL a 😀b"), (None, None)]]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    assert result(source_audit.audit(df, min_docs=1)) == brute(rows, 1)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5_000])
def test_perfect_hash(n):
    terms = [f"t{i}".encode() for i in range(n)]
    made = source_audit.PerfectHash.unpacked(source_audit.PerfectHash(terms).packed())
    asked = terms + [b"", b"other", *(f"u{i}".encode() for i in range(1_000))]
    slots = made.slots(asked, source_audit.hashes(asked, len(asked)))
    assert sorted(slots[:n]) == list(range(n)) and (slots[n:] == -1).all()
    assert [made.term(s) for s in slots[:n]] == terms


def test_equal_hashes_are_listed(monkeypatch):
    monkeypatch.setattr(source_audit.xxhash, "xxh64_intdigest", lambda t, seed: len(t))
    made = source_audit.PerfectHash([b"a", b"b", b"cc"])
    asked = [b"a", b"b", b"cc", b"d", b"ee"]
    slots = made.slots(asked, source_audit.hashes(asked, 5))
    assert sorted(slots[:3]) == [0, 1, 2] and list(slots[3:]) == [-1, -1]


def test_hash_equals_sparks(spark):
    words = [f"w{i}" * (i % 9) for i in range(200)]
    df = spark.createDataFrame([(w,) for w in words], "t string").select("t", F.xxhash64(F.col("t").cast("binary")).alias("h"))
    h = source_audit.hashes((r.t.encode() for r in df.collect()), 200).astype("int64").tolist()
    assert h == [r.h for r in df.collect()]


def test_smoothed_shares_are_exact(spark):
    cases = [(0, 1), (0, 7), (3, 11), (10 ** 15, 7 * 10 ** 15), (8 * 10 ** 15, 9 * 10 ** 15), (123_456_789, 987_654_321_987)]
    df = spark.createDataFrame(cases, "n long, v long").withColumn("total", F.col("n") + 5 * F.col("v"))
    for r in df.filter("total < 9e15").withColumn("p", source_audit.share("n", "total")).collect():
        assert r.p == 1 + 10 ** 9 * (r.n + 5) // r.total


def test_query_on_smoke_tables(spark):
    rows = [(r.lang, r.source, r.text) for r in documents(spark).collect()]
    assert result(source_audit.op11_mph_divergence(spark, SMOKE)) == brute(rows, 30)
