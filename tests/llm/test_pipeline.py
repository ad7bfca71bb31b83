import zlib
from collections import Counter

import pytest

import corpus_pipeline as cp
from clinlake.llm import common, mixing, packing, quality_model
from tests.llm.data import texts
from tests.llm.test_documents import assert_packed, base_spans, brute_components, ids_of

SF = "/root/testdata/sf0.01"


def run(spark, name, docs):
    return common.staged(dict(cp.STAGES)[name](spark, docs, SF), name)


def test_stages_one_by_one(spark):
    docs = common.read(spark, SF, "documents")
    columns, rows = docs.columns, texts(docs)

    good = run(spark, "quality", docs)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = texts(good)
    assert good.columns == columns and all(kept[d] == rows[d] for d in kept)
    held = [d for d in labels if zlib.crc32(str(d).encode()) % 3 == 1]
    assert all(d in kept for d in held if labels[d] == 1)
    assert sum(d in kept for d in held if labels[d] == 0) <= 3
    weights, bias = quality_model.train(docs, common.read(spark, SF, "labels", "doc_id", "quality"))
    known = quality_model.WordHash()
    for d, t in rows.items():
        at, x = quality_model.vector(t, known)
        assert (bias + weights[at] @ x >= 0) == (d in kept)

    single = run(spark, "near_duplicates", good)
    one = texts(single)
    assert single.columns == columns and all(one[d] == kept[d] for d in one)
    groups = brute_components(sorted(kept.items()), 5, 80)
    assert set(one) == {c for _, c in groups.values()} and single.count() == len(one)

    clean = run(spark, "pii", single)
    after = {r.doc_id: r for r in clean.collect()}
    assert clean.columns == columns and set(after) == set(one)
    for d, t in one.items():
        spans = sorted(tuple(map(int, s.split(":")[1:])) for s in base_spans(t))
        if not spans:
            assert after[d].text == t
        else:
            assert not base_spans(after[d].text) and after[d].n_chars == len(after[d].text)
            assert after[d].text.startswith(t[:spans[0][0]])

    mixed = run(spark, "mix", clean)
    assert mixed.columns == columns
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, clean.collect()))

    packed = run(spark, "pack", mixed).toPandas()
    assert_packed(packed, {d: ids_of(t) for d, t in texts(mixed).items()}, 4096)


def test_stages_take_empty_and_odd_documents(spark):
    schema = common.read(spark, SF, "documents").schema
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "same words in here now", "en", "s", 22),
           (4, "same words in here now", "en", "s", 22), (4, "same words in here now", "en", "s", 22),
           (None, "no id: a@b.org", "en", None, 14)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in cp.STAGES[1:]:
            docs = common.staged(stage(spark, docs, SF), name)
            if name == "near_duplicates" and rows:
                assert sorted((r.doc_id for r in docs.collect()), key=str) == [1, 2, 3, None]
        assert docs.count() == (4 if rows else 0)


def test_clashing_columns_and_rows_that_differ_elsewhere(spark):
    """Names that the stages use themselves, and two rows equal in id and text only."""
    names = ["g", "r", "h", "n", "stays", "place", "at", "position", "_file", "_row", "_of", "_n", "row", "spans", "queue", "C"]
    text = "some words that stand here twice in the same table"
    rows = [(1, text, "en", s, 50, *[f"{s}{c}" for c in names]) for s in ("b", "a", "c")]
    rows += [(2, "other words of another document, mail x@y.org", None, "a", 45, *names), (3, None, "en", None, None, *names)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names)
    kept = []
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, schema)
        for name, stage in cp.STAGES[1:-1]:
            docs = common.staged(stage(spark, docs, SF), name)
            assert docs.columns == spark.createDataFrame([], schema).columns
        found = {r.doc_id: tuple(r) for r in docs.collect()}
        assert set(found) == {1, 2, 3} and found[1] in rows and found[2][5:] == tuple(names) and "[EMAIL]" in found[2][1]
        kept.append(found)
        assert run(spark, "pack", docs).select("doc_id").distinct().count() == 3
    assert kept[0] == kept[1]


def test_quality_stage_takes_odd_rows(spark):
    docs = common.read(spark, SF, "documents")
    odd = spark.createDataFrame([(-1, None, None, None, None), (-2, "", "en", "s", 0), (None, " \n", "en", "s", 3)], docs.schema)
    good = cp.keep_good(spark, docs.unionByName(odd).unionByName(odd), SF)
    counts = {r.doc_id: r["count"] for r in good.filter("doc_id < 0 or doc_id is null").groupBy("doc_id").count().collect()}
    assert len(counts) in (0, 3) and set(counts.values()) <= {2}  # one score for all that are empty


def test_tables_of_a_stage_go_when_the_next_one_begins(spark, tmp_path):
    import os

    docs = common.staged(common.read(spark, "/root/testdata/sf0.001", "documents"), "docs")
    single = run(spark, "near_duplicates", docs)
    old = list(cp._left["drop_near_duplicates"])
    assert old and all(os.path.isdir(p.removeprefix("file:")) for p in old)
    clean = run(spark, "pii", single)
    assert not any(os.path.exists(p.removeprefix("file:")) for p in old)
    assert clean.count() == single.count() and docs.count() == 200


def test_mix_weights_reach_the_sequences(spark, monkeypatch):
    docs = common.read(spark, "/root/testdata/sf0.001", "documents")
    sources = sorted(r.source for r in docs.select("source").distinct().collect())
    plain, found = mixing.mix, []
    for heavy in (sources[0], sources[-1]):
        weights = {s: 50.0 if s == heavy else 1.0 for s in sources}
        monkeypatch.setattr(mixing, "mix", lambda d, w=weights: plain(d, weights=w, block_docs=2))
        got = run(spark, "pack", run(spark, "mix", docs)).toPandas().sort_values(["sequence_id", "offset"])
        order, source = list(dict.fromkeys(got.doc_id)), {r.doc_id: r.source for r in docs.collect()}
        place = {r.row.doc_id: r.position for r in mixing.mix(docs).collect()}
        assert sorted(order) == sorted(source)
        assert [source[d] for d in order] == [source[d] for d in sorted(place, key=place.get)]
        assert_packed(got, {d: ids_of(t) for d, t in texts(docs).items()}, 4096)
        found.append(list(zip(got.doc_id, got.sequence_id, got.offset)))
    assert found[0] != found[1]


def brute_windows(order, window_tokens, seq_len):
    """Pieces (doc, start, length, sequence, offset, source) of documents (doc, source, tokens)
    in the order of a mix, token by token."""
    out, begin, g = [], 0, 0
    last = {s: i for i, (_, s, _) in enumerate(order)}
    while begin < len(order):
        met = max(next(i for i in range(begin, e + 1) if order[i][1] == s) for s, e in last.items() if e >= begin)
        end = min(e for e in last.values() if e >= met)
        phase, begin = order[begin:end + 1], end + 1
        runs = Counter(s for i, (_, s, _) in enumerate(phase) if not i or s != phase[i - 1][1])
        rounds = min(n for s, n in runs.items() if last[s] >= end)
        for r in range(rounds):
            docs = [x for i, x in enumerate(phase) if i * rounds // len(phase) == r]
            queues = {}
            for i, (_, s, n) in enumerate(docs):
                queues.setdefault(s, []).extend((i, t) for t in range(n))
            windows = -(-sum(map(len, queues.values())) // window_tokens)
            for k in range(windows):
                taken = [x for q in queues.values() for x in q[len(q) * k // windows:len(q) * (k + 1) // windows]]
                for i, t in sorted(taken):
                    doc, s, _ = docs[i]
                    if out and t and g % seq_len and out[-1][0] == doc and out[-1][1] + out[-1][2] == t and cut == (i, k):
                        out[-1][2] += 1
                    else:
                        out.append([doc, t, 1, g // seq_len, g % seq_len, s])
                    cut, g = (i, k), g + 1
    return sorted(map(tuple, out))


@pytest.mark.parametrize("block, rows", [
    (6, [(i, f"s{i % 5}", 5 + i * 7 % 90) for i in range(150)]),                             # even sources
    (4, [(i, "hot" if i % 3 else f"s{i % 7}", 1 + i * 11 % 60) for i in range(240)]),        # a hot one
    (200, [(i, "one" if i == 40 else None if i % 2 else "b", 30) for i in range(90)]),       # few visits, no source
    (50, [(i, "tiny" if i < 2 else "b", 1 if i < 2 else 300) for i in range(30)]),           # under a token a window
    (8, [(i, "alone", 40) for i in range(60)])])
def test_windows_share_the_rounds_of_a_mix(spark, block, rows):
    schema = "doc_id long, source string, text string"
    docs = spark.createDataFrame([(d, s, " ".join(["a"] * (n - 1))) for d, s, n in rows], schema)
    placed = mixing.mix(docs, block_docs=block).select("row.*", "position").cache()
    tokens = {d: (s or "", n) for d, s, n in rows}
    order = [(r.doc_id, *tokens[r.doc_id]) for r in placed.orderBy("position").collect()]
    want = brute_windows(order, 512, 64)
    for bucket in (7, None) if block == 6 else (7,):
        got = packing.pack(placed, seq_len=64, window_tokens=512, bucket_docs=bucket, place_col="position")
        assert sorted((r.doc_id, r.start, r.length, r.sequence_id, r.offset, r.queue) for r in got.collect()) == want


def test_pack_stage_mixes_the_sources_of_every_window(spark):
    """Blocks of 32 long documents: each window holds a fourth of every source, not two blocks."""
    rows = [(i, f"{'word ' * 1_000}{i}", "en", f"s{i % 4}", 5_000) for i in range(128)]
    docs = common.staged(spark.createDataFrame(rows, common.read(spark, SF, "documents").schema), "docs")
    got = run(spark, "pack", run(spark, "mix", docs)).toPandas()
    assert_packed(got, {d: ids_of(t) for d, t, *_ in rows}, packing.SEQ_LEN)
    assert all(q == f"s{d % 4}" for d, q in zip(got.doc_id, got["queue"]))
    total = got.length.sum()
    windows = -(-total // packing.WINDOW_TOKENS)
    assert windows > 1
    middle = got.sequence_id * packing.SEQ_LEN + got.offset + got.length / 2
    share = got.groupby([middle * windows // total, "queue"]).length.sum() * windows / total
    assert len(share) == 4 * windows and (abs(share - 0.25) < 0.001).all()
