import hashlib
import re

from pyspark.sql import functions as F

from clinlake.llm import fill_middle
from tests.llm.data import EDGE, documents, edge, empty


def brute(doc_id, text, seed=1, plain_percent=10, spm_percent=20):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100 - plain_percent:
        return len(units), "plain", text, None, None
    if h4 % 100 < spm_percent:
        return len(units), "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return len(units), "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def outputs(df, **how):
    out = fill_middle.transform(df, **how)
    pieces = fill_middle.parts(F.col("output"), F.col("form"))
    return out.select("row.doc_id", "row.text", "n", "form", "output", pieces.alias("p"),
                      fill_middle.restore(F.col("output"), F.col("form")).alias("restored")).collect()


def check(rows, **how):
    for r in rows:
        n, form, output, prefix, middle = brute(r.doc_id, r.text, **how)
        assert (r.n, r.form, r.output) == (n, form, output)
        assert r.restored == (r.text or "")
        assert (r.p and len(r.p[0])) == prefix and (r.p and len(r.p[1])) == middle


def test_fill_in_the_middle_against_brute_force(spark):
    rows = outputs(documents(spark, "/root/testdata/sf0.01"))
    check(rows)
    assert {r.form for r in rows} == {"plain", "psm", "spm"} and len(rows) == 1000
    check(outputs(documents(spark), seed=7, plain_percent=0, spm_percent=100), seed=7, plain_percent=0, spm_percent=100)


def test_query_digests(spark):
    got = {r.doc_id: r for r in fill_middle.op12_regex_fim(spark, "/root/testdata/sf0.001").collect()}
    for r in documents(spark).collect():
        n, form, output, prefix, middle = brute(r.doc_id, r.text)
        assert tuple(got[r.doc_id])[1:] == (n, form, prefix, middle, hashlib.sha256(output.encode()).hexdigest(),
                                            hashlib.sha256((r.text or "").encode()).hexdigest())


def test_edges(spark):
    rows = outputs(edge(spark))
    check(rows)
    assert len(rows) == len(EDGE)
    assert fill_middle.transform(empty(spark)).count() == 0
    kept = fill_middle.transform(edge(spark)).select("row.*")
    assert kept.schema == edge(spark).schema


def test_marks_code_points_and_half_marks(spark):
    texts = ["a <P> b", "<S>", "x<M>", "<", "<P", "<<<SS>>M", "P>S>M> <S <M <P", "$1 \\1 $0 {2}", "\U0001F600\U0001F601é\u0000漢",
             "\r\n\n\r   \x0b", "a" * 70_000, "\U0001F600" * 70_000, "ab1 " * 300_000, "<S" * 50]
    df = spark.createDataFrame([(i * 31 + j, t) for i in range(12) for j, t in enumerate(texts)], "doc_id long, text string")
    rows = outputs(df, plain_percent=0)
    check(rows, plain_percent=0)
    marked = [r for r in rows if r.text in texts[:3]]
    assert all(r.form == "plain" and r.output == r.text for r in marked)
    assert {r.form for r in rows if r.text not in texts[:3]} == {"psm", "spm"}


def test_plan_is_one_pass(spark):
    plan = fill_middle.transform(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "InPandas" not in plan
