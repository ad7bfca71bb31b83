import base64
import hashlib
import html
import re

from clinlake.llm import common, html_text, warc
from tests.llm.data import SMOKE

SCHEMA = "page_id long, url string, html string, id string, t string, d string, n long, of long, rng int, text string"
ODD = [(1, "http://a.com/x", "same"), (5, "http://www.a.com/x", "same"), (5, "http://www.a.com/x", "same"),
       (None, "http://a.com/x", "same"), (7, None, None), (8, "http://b.com\n", "WARC/1.0\r\n\r\nfoo"),
       (9, "http://b.com", ""), (10, "http://[bad", "<p>" + "long text " * 20_000), (11, "http://c.org:8080/ü?q=1#f", "é漢😀")]


def pages(spark, rows=ODD):
    return spark.createDataFrame([(*r, "x", "y", "z", 1, 2, 3, "q") for r in rows], SCHEMA).repartition(3)


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_warc_round_trip(spark):
    df = spark.read.parquet(f"{SMOKE}/pages.parquet")
    rows = df.toPandas().set_index("page_id")
    got = warc.round_trip(df).toPandas()
    assert sorted(got.page_id) == sorted(rows.index)
    assert all(r.payload_digest == digest(rows.html[r.page_id]) and
               r.payload_bytes == len(rows.html[r.page_id].encode()) for r in got.itertuples())
    got = got.sort_values("position")
    assert list(got.position) == list(range(len(got))) and got.urlkey.is_monotonic_increasing


def test_warc_edges(spark):
    got = warc.round_trip(pages(spark)).toPandas().sort_values("position")
    assert len(got) == len(ODD) and list(got.position) == list(range(len(ODD)))
    of = {p: (t, None if r != r else r) for p, t, r in zip(got.page_id.fillna(-1), got.record_type, got.refers_to)}
    assert of[1] == ("revisit", 5) and of[-1] == ("revisit", 5) and of[5] == ("response", None)
    assert of[7] == ("revisit", 9) and of[9] == ("response", None) and of[8] == ("response", None)
    assert (got.page_id == 5).sum() == 2
    text = {r[0]: r[2] for r in ODD}
    for r in got[got.page_id.notna()].itertuples():
        assert r.payload_digest == digest(text[r.page_id]) and r.payload_bytes == len((text[r.page_id] or "").encode())
    assert warc.round_trip(pages(spark).filter("1 = 0")).count() == 0
    some = warc.round_trip(pages(spark), min_bytes=1).toPandas()
    assert set(some[some.payload_bytes == 0].record_type) == {"response"}


def test_capture_index_over_many_runs_and_ranges(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    hot = df.selectExpr("page_id + 10000 as page_id", "'http://hot.example.org/' as url", "html").limit(120)
    path = common.scratch(spark, "warc")
    warc.write_archives(df.unionByName(hot).repartition(7), path)
    runs = common.staged(warc.read_runs(spark, path), "cdx")
    assert runs.select("archive").distinct().count() == 7
    assert len(warc._splits(runs, 25)) > 8
    got = warc.merge_runs(runs, range_rows=25).toPandas().sort_values("position")
    assert list(got.position) == list(range(len(got)))
    keys = list(zip(got.urlkey, got.ts, got.page_id))
    assert keys == sorted(keys) and len(keys) == df.count() + 120


def test_split_points_cover_a_sorted_table_above_the_limit(spark):
    rows = spark.range(60_000, numPartitions=6).selectExpr(
        "format_string('org,h%05d)/', int(id / 10)) as urlkey", "'2024-01-01T00:00:00Z' as ts", "id as page_id",
        "format_string('a%02d.gz', int(id / 2500)) as archive", "id % 2500 * 300 as offset")
    splits = warc._splits(common.staged(rows, "sorted"), 1_000)
    ends = [0, *(s[3] for s in splits), 60_000]
    assert len(splits) == 59 and max(b - a for a, b in zip(ends, ends[1:])) < 2_000


def test_loser_tree():
    import random

    rnd = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rnd.randint(0, 40) for _ in range(rnd.randint(0, 12))) for _ in range(k)]
        assert list(warc.loser_tree_merge([iter(r) for r in runs])) == sorted(sum(runs, []))


def test_url_key():
    assert warc.url_key("https://www.Example.org:8080/a?b=c#d") == "org,example:8080)/a?b=c"
    assert warc.url_key(None) == "" and warc.url_key("http://x.y") == "y,x)/"


# ---- operator 9 -----------------------------------------------------------------------------------------------------

def test_text_of_the_given_pages(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = {r.page_id: r.html for r in df.collect()}
    for r in html_text.extract(df).collect():
        art = re.search(r"<article>(.*?)(</article>|\Z)", rows[r.page_id], re.S).group(1)
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", art)]
        assert r.text == "\n".join(x for x in want if x) and r.n_chars == len(r.text)


TEMPLATE = """<!doctype html><html><head><title>T</title><style>p{{color:red}}</style><script>if (a<b) x("</p>")</script></head>
<body class="page"><header class="top"><h1>Site name</h1><nav><ul><li><a href=/>Home</a></li><li><a href=/a>About us</a></li></ul></nav>
</header><div id="cookie-banner"><p>We use cookies to make this site better for all of our visitors, read on.</p><button>OK</button></div>
<div class="sidebar"><h3>Related</h3><ul><li><a href=/1>First other story</a></li><li><a href=/2>Second other story</a></li></ul></div>
<main class="content has-sidebar no-comments"><h2>The head&shy;line &amp; more</h2><p>{one}</p>
<div class="ad">Buy now, this is a long advert text that has very many words in it indeed</div>
<p>{two} <a href="/x">a link</a> inside.</p><blockquote>{three}</blockquote><ul><li>first point</li><li>second point</li></ul></main>
<form action=/q>Search <input name=q><select><option>all</option></select></form>
<section id="comments"><h3>Comments</h3><p>{four}</p></section><footer>&copy; 2024 all rights reserved, every word of it</footer></body></html>"""


def test_text_of_another_layout(spark):
    part = {k: " ".join(f"{k}{i}" for i in range(n)) for k, n in (("one", 40), ("two", 30), ("three", 15), ("four", 60))}
    df = spark.createDataFrame([(1, "u", TEMPLATE.format(**part))], "page_id long, url string, html string")
    got = html_text.extract(df).first().text.split("\n")
    assert got == ["The head­line & more", part["one"], part["two"] + " a link inside.", part["three"],
                   "first point", "second point"]


def test_text_edges(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "no tags at all"), (4, "u", "<p title='a>b'>x < y <b>z"),
            (4, "u", "<p title='a>b'>x < y <b>z"), (None, "u", "<article><p>kept text"), (6, "u", "<" * 3_000),
            (7, "u", "<article>" + "<div>" * 3_000 + "deep &#x41;&nbsp; text" + "</p>" * 3_000), (8, "u", "<p x='" + "a" * 20_000),
            (9, "u", "<article><p>" + "word " * 30_000 + "</p></article>")]
    got = html_text.extract(pages(spark, rows)).toPandas()
    assert len(got) == len(rows)
    text = dict(zip(got.page_id.fillna(-1), got.text))
    assert text[1] == text[2] == "" and text[-1] == "kept text" and text[7] == "deep A text"
    assert text[9] == ("word " * 30_000).strip()
    assert (got.n_chars == got.text.str.len()).all() and (got.page_id == 4).sum() == 2
    assert html_text.extract(pages(spark, rows).filter("1 = 0")).count() == 0


def test_tree_learns_its_table(spark):
    import numpy as np

    nodes = html_text.train_tree(spark)
    table = np.array(html_text.LABELLED, dtype=float)
    assert (html_text.classify(nodes, table[:, :-1]) == table[:, -1]).mean() >= 0.98
