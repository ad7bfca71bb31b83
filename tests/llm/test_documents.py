import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from clinlake.llm import (common, fingerprints, jaccard_join, mixing, packing, pii_spans, quality_model, quality_rules,
                          sharding)
from tests.llm.data import EDGE, LONG, SMOKE, WORD, documents, edge, empty, texts


# ---- operator 1 -----------------------------------------------------------------------------------------------------

def edited(rows):
    out = []
    for i, (d, t) in enumerate(rows):
        after, q = rows[(i + 1) % len(rows)][1], len(t) // 4
        out.append(hashlib.sha256((t[:len(t) - q] + after[:q]).encode()).hexdigest())
    return out


@pytest.mark.parametrize("bucket_rows", [2_000, 17])
def test_fingerprints_against_brute_force(spark, bucket_rows):
    docs = documents(spark)
    got = fingerprints.fingerprint_with_next(docs, bucket_rows=bucket_rows).toPandas().sort_values("doc_id")
    rows = sorted(texts(docs).items())
    assert list(got.doc_id) == [d for d, _ in rows]
    assert list(got.n_chars) == [len(t) for _, t in rows]
    assert list(got.edited_sha256) == edited(rows)
    by_text = defaultdict(set)
    for (_, t), fp in zip(rows, got.fingerprint):
        by_text[t].add(fp)
    assert all(len(v) == 1 for v in by_text.values())
    assert got.near_edited.between(0, 1).all() and got.near_next.between(0, 1).all()
    assert got.near_edited.mean() > 0.35 and got.near_next.mean() < 0.1


def test_lexicon_band_is_exact(spark):
    docs = documents(spark)
    rows = texts(docs)
    df = Counter(w for t in rows.values() for w in fingerprints.terms(t))
    import xxhash

    expected = {xxhash.xxh3_64_intdigest(w) for w, n in df.items() if 0.02 * len(rows) <= n <= 0.3 * len(rows)}
    assert set(fingerprints.lexicon(docs, "text", 0.02, 0.3).tolist()) == expected


def test_fingerprint_edges(spark):
    got = fingerprints.fingerprint_with_next(edge(spark), bucket_rows=2).toPandas()
    assert len(got) == len(EDGE) and got.doc_id.isna().sum() == 2
    rows = got[got.doc_id.notna()].sort_values("doc_id")
    assert list(rows.n_chars) == [len(t or "") for d, t, _ in EDGE if d is not None]
    assert rows[rows.doc_id == 2].fingerprint.nunique() == 1
    assert set(got[got.n_chars <= 4].fingerprint) >= {"-"}
    assert fingerprints.fingerprint_with_next(empty(spark)).count() == 0


def test_likeness():
    lex = fingerprints.Lexicon(np.empty(0, np.uint64))
    a, b = fingerprints.fingerprint("x y z", lex), fingerprints.fingerprint("z y x x", lex)
    assert fingerprints.likeness(a, b) == 1.0 and fingerprints.likeness(a, None) == 0.0
    assert fingerprints.likeness(None, None) == 1.0
    assert fingerprints.likeness(a, fingerprints.fingerprint("p q r s", lex)) < 0.2


# ---- operator 2 -----------------------------------------------------------------------------------------------------

def shingle_sets(rows, k):
    out = {}
    for d, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        out[d] = frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else \
            frozenset([tuple(w)] if w else [])
    return out


def brute_components(rows, k, num):
    sets = shingle_sets(rows, k)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids, holds = sorted(sets), defaultdict(list)
    for a in ids:
        met = Counter(b for g in sets[a] for b in holds[g])
        for b, inter in met.items():
            if 100 * inter >= num * (len(sets[a]) + len(sets[b]) - inter):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
        for g in sets[a]:
            holds[g].append(a)
    return {d: (len(sets[d]), find(d)) for d in ids}


def variants(seed):
    """Families of edited texts at every distance around the threshold."""
    rnd = random.Random(seed)
    vocab = [f"v{i}" for i in range(400)]
    rows, n = [], 0
    for size in (1, 4, 9, 11, 25, 60, 150):
        for _ in range(4):
            base = [rnd.choice(vocab) for _ in range(size)]
            for edits in (0, 0, 1, 1, 2, 3, 5, 8):
                w = list(base)
                for _ in range(min(edits, size)):
                    w[rnd.randrange(size)] = rnd.choice(vocab)
                if rnd.random() < 0.3:
                    w += [rnd.choice(vocab) for _ in range(rnd.randint(1, 4))]
                rows.append((n, " ".join(w)))
                n += 1
    base = [rnd.choice(vocab) for _ in range(100)]
    for _ in range(150):  # a family at all distances around its centre
        w = list(base)
        for _ in range(rnd.randint(1, 12)):
            w[rnd.randrange(100)] = rnd.choice(vocab[:60])
        rows.append((n, " ".join(w)))
        n += 1
    passage = " ".join(rnd.choice(vocab) for _ in range(40))
    for _ in range(30):
        rows.append((n, passage + " " + " ".join(rnd.choice(vocab) for _ in range(rnd.randint(5, 60)))))
        n += 1
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("k, num", [(3, 90), (5, 80), (2, 50)])
def test_join_against_brute_force(spark, k, num):
    rows = variants(num)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in
           jaccard_join.join(df, k=k, num=num, den=100).collect()}
    assert got == brute_components(rows, k, num)


def test_family_below_the_limit_meets_seldom(spark, monkeypatch):
    """60 long texts that each have own changes to one text: all pairs but the planted ones are
    just below the limit (of more than 128 differences), no link is lost."""
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(1_500)]

    def edited(words, n):
        out = list(words)
        for at in rnd.sample(range(0, len(out) // 8), n):
            out[at * 8] = f"n{rnd.random()}"
        return out
    family = [edited(base, 42) for _ in range(60)]
    family += [edited(w, 10) for w in family[:4]]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(family)], "doc_id long, text string")
    pairs, near = [], jaccard_join._near
    monkeypatch.setattr(jaccard_join, "_near", lambda p, *a: pairs.append(p.count()) or near(p, *a))
    got = {r.doc_id: r.component_id for r in jaccard_join.join(df, k=5, num=80, den=100).collect()}
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in family]
    to = list(range(len(sets)))
    links = [(x, y) for x in to for y in to[:x] if 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])]
    for _ in sets:
        for x, y in links:
            to[x] = to[y] = min(to[x], to[y])
    assert got == dict(enumerate(to)) and 4 <= len(to) - len(set(to)) < 20
    assert pairs[-1] < len(family)


def test_linked_sets_share_a_region():
    rnd = random.Random(4)
    for _ in range(1_500):
        num, n = rnd.choice((50, 80, 90)), rnd.choice((1, 2, 5, 9, 10, 20, 60, 200, 500))
        x = np.array([rnd.getrandbits(64) for _ in range(n)], dtype=np.uint64)
        y = x.copy()
        for i in rnd.sample(range(n), rnd.randint(0, max(0, n // 4))):
            y[i] = rnd.getrandbits(64)
        y = np.unique(np.append(y, [rnd.getrandbits(64) for _ in range(rnd.randint(0, n // 5 + 1))]).astype(np.uint64))
        x = np.unique(x)
        inter = len(np.intersect1d(x, y))
        if 100 * inter >= num * (len(x) + len(y) - inter):
            a, b = (set(jaccard_join.region_keys(s, num, 100).tolist()) for s in (x, y))
            assert a & b


def test_join_edges(spark):
    got = jaccard_join.join(edge(spark), k=3, num=90, den=100).toPandas()
    assert len(got) == len(EDGE)
    of = {d: g for d, g in zip(got.doc_id, got.component_id) if d == d}
    assert of[1] == of[2] == 1 and of[3] == 3 and of[4] == 4 and of[6] == 6
    n = dict(zip(got.doc_id.fillna(-1), got.n_shingles))
    assert n[3] == n[4] == n[5] == 0 and n[6] == n[7] == 1 and n[8] == len(shingle_sets([(8, LONG)], 3)[8])
    assert jaccard_join.join(empty(spark)).count() == 0


# ---- operator 3 -----------------------------------------------------------------------------------------------------

def test_quality_model(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_model.classify(documents(spark, sf), labels).toPandas()
    assert [zlib.crc32(str(d).encode()) % 3 == 1 for d in got.doc_id] == list(got.held_out)
    assert ((got.score >= 0.5) == (got.predicted == 1)).all() and got.score.between(0, 1).all()
    m = got.merge(labels.toPandas(), on="doc_id")
    m = m[m.held_out]
    assert (m.predicted == m.quality).mean() > 0.95


def test_quality_labels_of_held_out_rows_are_never_read(spark):
    from pyspark.sql import functions as F

    labels = spark.read.parquet(f"{SMOKE}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality_model.held_out(F.col("doc_id")), 1 - F.col("quality"))
                               .otherwise(F.col("quality")))
    a, b = (quality_model.train(documents(spark), x) for x in (labels, turned))
    assert a[1] == b[1] and (a[0] == b[0]).all()


def test_quality_edges(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (3, None), (99, 0)], "doc_id long, quality int")
    got = quality_model.classify(edge(spark), labels).toPandas()
    assert len(got) == len(EDGE) and got.score.notna().all() and not got[got.doc_id.isna()].held_out.any()
    assert got[got.doc_id.isin([3, 4, 5])].score.nunique() == 1
    none = quality_model.classify(edge(spark), labels.filter("1 = 0")).toPandas()
    assert (none.score == 0.5).all() and (none.predicted == 1).all()
    assert quality_model.classify(empty(spark), labels).count() == 0


# ---- operator 4 -----------------------------------------------------------------------------------------------------

def assert_pfair(got, block_docs, share):
    count = got.groupby("queue").size().to_dict()
    blocks = {q: -(-n // block_docs) for q, n in count.items()}
    slots = got.drop_duplicates("slot").sort_values("slot")
    assert list(slots.slot) == list(range(sum(blocks.values())))
    assert (got.groupby(["queue", "block"]).slot.nunique() == 1).all()
    assert (slots.release <= slots.slot).all() and (slots.slot < slots.deadline).all()
    assert sorted(got.position) == list(range(len(got)))
    done, v = dict.fromkeys(blocks, 0), Fraction(0)
    for q in slots["queue"]:  # the fluid mix, one slot at a time
        done[q] += 1
        rest = Fraction(1)
        while rest > 0:
            live = [u for u in blocks if share[u] * v < blocks[u]]
            step = min(rest / sum(share[u] for u in live), min(Fraction(blocks[u], share[u]) for u in live) - v)
            v, rest = v + step, rest - step * sum(share[u] for u in live)
        assert max(abs(done[u] - min(blocks[u], share[u] * v)) for u in blocks) < 1


@pytest.mark.parametrize("cycle", [20, 37])
def test_mix_deviates_by_less_than_a_block(spark, cycle):
    docs = documents(spark).select("doc_id", "source")
    rnd = random.Random(cycle)
    weights = {f"src{i}": rnd.random() + 0.05 for i in range(20)}
    got = mixing.mix(docs, weights=weights, block_docs=2, cycle=cycle).toPandas()
    assert len(got) == docs.count()
    assert_pfair(got, 2, mixing.cycle_shares({q: weights[q] for q in set(got["queue"])}, cycle))


@pytest.mark.parametrize("exponent", [0.0, 0.5])
def test_schedule_keeps_the_exact_weights(exponent):
    blocks = {f"s{i:02}": 200 + 17 * i for i in range(20)} | {"tiny": 3}
    weights = {s: n ** exponent for s, n in blocks.items()} | {"tiny": 1e-4}
    slots = list(mixing.edf(blocks, weights))
    assert sorted((q, j) for q, j, *_ in slots) == sorted((q, j) for q in blocks for j in range(blocks[q]))
    assert all(r <= s < d for _, _, s, r, d in slots)
    exact = {s: Fraction(w) for s, w in weights.items()}
    ends = sorted((Fraction(blocks[s]) / exact[s], s) for s in blocks)
    done, live, v, gone = dict.fromkeys(blocks, 0), sum(exact.values()), Fraction(0), 0
    for t, (q, *_) in enumerate(slots, 1):  # the fluid mix against the unrounded weights
        done[q] += 1
        while gone < len(ends) and sum(blocks[s] for _, s in ends[:gone]) + live * ends[gone][0] <= t:
            live -= exact[ends[gone][1]]
            gone += 1
        if live:
            v = (t - sum(blocks[s] for _, s in ends[:gone])) / live
        else:
            v = ends[-1][0]
        assert max(abs(done[s] - min(blocks[s], exact[s] * v)) for s in blocks) < 1


def test_mix_keeps_every_source_apart(spark, monkeypatch):
    rows = [(i, f"s{i % 300}" if i % 3 else "hot") for i in range(1800)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    weights = {f"s{i}": 1.0 + i % 5 for i in range(300)} | {"hot": 400.0}
    monkeypatch.setattr(mixing, "CHUNK_BLOCKS", 100)
    got = mixing.mix(docs, weights=weights, block_docs=2).toPandas()
    assert all(r["source"] == q for r, q in zip(got.row, got["queue"])) and got["queue"].nunique() == 201
    assert sorted(got.position) == list(range(1800))
    assert (got.sort_values("position").slot.diff().dropna() >= 0).all()
    assert (got.release <= got.slot).all() and (got.slot < got.deadline).all()


def test_mix_edges_and_buckets(spark, monkeypatch):
    one = mixing.mix(edge(spark), block_docs=1).toPandas()
    assert len(one) == len(EDGE) and sorted(one.position) == list(range(len(EDGE)))
    assert set(one["queue"]) == {"", "a", "b", "c"}
    monkeypatch.setattr(common, "BUCKET_ROWS", 2)
    many = mixing.mix(edge(spark).repartition(5), block_docs=1).toPandas()
    key = lambda df: sorted((p, str(r["doc_id"]), str(r["text"])[:20]) for p, r in zip(df.position, df.row))
    assert key(one) == key(many)
    assert mixing.mix(empty(spark)).count() == 0


# ---- operator 5 -----------------------------------------------------------------------------------------------------

def ids_of(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    return np.array(tok.encode(text or "", add_special_tokens=False).ids + [packing.END_ID], "<u4")


def assert_packed(got, ids, seq_len):
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.offset == got.groupby("sequence_id").length.cumsum() - got.length).all()
    filled = got.groupby("sequence_id").length.sum()
    assert list(filled.index) == list(range(len(filled))) and (filled.iloc[:-1] == seq_len).all()
    for d, x in got.sort_values("start").groupby("doc_id"):
        at = 0
        for r in x.itertuples():
            assert r.start == at and r.doc_tokens == len(ids[d])
            assert r.ids_crc32 == zlib.crc32(ids[d][at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids[d])


@pytest.mark.parametrize("weights", [None, lambda s: 1 + int(s[3:]) % 4])
def test_packing_round_trip(spark, weights):
    docs = documents(spark)
    sources = [r.source for r in docs.select("source").distinct().collect()]
    got = packing.pack(docs, weights=weights and {s: weights(s) for s in sources}, seq_len=256, window_tokens=2048,
                       bucket_docs=20).toPandas()
    ids = {d: ids_of(t) for d, t in texts(docs).items()}
    assert_packed(got, ids, 256)
    if weights:  # the windows of the first phase hold the target proportions, to a token a queue
        share = got[got.sequence_id < 4 * 8].groupby("queue").length.sum()
        total = sum(weights(s) for s in sources)
        assert all(abs(n - 4 * 2048 * weights(q) / total) < 2048 * weights(q) / total + 4 for q, n in share.items())


@pytest.mark.parametrize("weighted", [False, True])
def test_packing_keeps_every_source_apart(spark, weighted):
    rows = [(i, f"some words of number {i} " * (1 + i % 4), f"s{i % 300}" if i % 3 else "hot") for i in range(900)]
    weights = {f"s{i}": 1 + i % 5 for i in range(300)} | {"hot": 200}
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"),
                       weights=weights if weighted else None, seq_len=64, window_tokens=512, bucket_docs=50).toPandas()
    source = {d: s for d, _, s in rows}
    assert all(source[d] == q for d, q in zip(got.doc_id, got["queue"])) and got["queue"].nunique() == 201
    import public_tokenizers
    import pyarrow as pa

    coded = packing.TextIds(public_tokenizers.path(packing.TOKENIZER)).encode(pa.array([t for _, t, _ in rows]))
    assert_packed(got, {d: np.append(np.frombuffer(x, "<u2"), packing.END_ID).astype("<u4")
                        for (d, *_), x in zip(rows, coded)}, 64)


def test_packing_ids_of_odd_texts():
    import public_tokenizers

    rnd = random.Random(2)
    letters = "abTé'sSlLdmMİßΣσ 12½²\n\t ́‘’—€µ$#!<|>ŉǅñÑ…x\x85\x1c漢"
    some = ["".join(rnd.choice(letters[:rnd.choice((25, len(letters)))]) for _ in range(rnd.randint(0, 60)))
            for _ in range(2_000)] + ["<|endoftext|> a", "", "ΑΣ ΟΔΟΣ", "it's we'll '' 's", "''s", LONG]
    import pyarrow as pa
    from tokenizers import Tokenizer

    got = packing.TextIds(public_tokenizers.path(packing.TOKENIZER)).encode(pa.array([*some, None], pa.string()))
    tok = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    for t, x in zip([*some, ""], got):
        assert list(np.frombuffer(x, "<u2")) == tok.encode(t, add_special_tokens=False).ids


def test_packing_edges(spark):
    rows = edge(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    assert_packed(packing.pack(rows, seq_len=64, window_tokens=128).toPandas(),
                  {d: ids_of(t) for d, t, _ in EDGE if d is not None}, 64)
    few, many = (packing.pack(rows.repartition(p), bucket_docs=b).toPandas() for p, b in ((1, 100), (5, 2)))
    same = ["doc_id", "start", "length", "sequence_id", "offset"]
    assert sorted(map(tuple, few[same].to_numpy())) == sorted(map(tuple, many[same].to_numpy()))
    every = packing.pack(edge(spark)).toPandas()
    assert every[every.start == 0].shape[0] == len(EDGE)
    assert packing.pack(empty(spark)).count() == 0


# ---- operator 6 -----------------------------------------------------------------------------------------------------

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")),
                    "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_against_plain_patterns(spark):
    rnd = random.Random(5)
    letters = "ab1 2.3@4-+()%_é,\n0"
    rows = [(i, "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 200)))) for i in range(600)]
    rows += [(901, "1" * 4_000), (902, "a" * 50_000 + "@b.c%x@d.e"), (903, "+" * 2_000 + "1" * 3_000),
             (904, "4111 1111 1111 1111 x +49 (30) 1234-5678, 1.2.3.4.5.6.7.8 999.1.1.1 000.01.255.0255"),
             (905, "😀 a.b@c.d 😀+1 (017) 555-7713"), (906, "1." * 9_000), (907, "1 " * 9_000)]
    rows += list(texts(documents(spark, "/root/testdata/sf0.01")).items())[:300]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    out = pii_spans.detect(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    got = {r.id: (r.b, r.s) for r in out.select("id", pii_spans.span_text("base_spans").alias("b"),
                                                pii_spans.span_text("spans").alias("s")).collect()}
    for i, t in rows:
        assert got[i][0] == ",".join(base_spans(t))
        assert set(base_spans(t)) <= set(got[i][1].split(",")) | {""}


def test_pii_learns_from_all_candidates(spark, monkeypatch):
    """Every base candidate counts, not the first 20,000; the threshold is that of a plain scan."""
    from pyspark.sql import functions as F
    n = len(pii_spans.FEATURES)
    f = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == 1, F.col("id") % 500).when(
        i == 9, F.floor(F.col("id") / 7) % 60).otherwise(F.lit(0)).cast("double"))
    ok = (F.col("id") % 500 < 300) != (F.col("id") % 97 == 0)
    one = F.struct(F.lit(1).alias("k"), F.lit(True).alias("base"), F.lit(0).alias("s"), F.lit(9).alias("e"), ok.alias("ok"), f.alias("f"))
    cands = spark.range(45_000).select(F.array(one).alias("c"))
    kept = {}

    def staged(df, name):
        kept[name] = common.staged(df, name)
        return kept[name]
    monkeypatch.setattr(pii_spans, "staged", staged)
    model = pii_spans.train(cands, "c", trees=3, precision=0.9)
    assert kept["candidates"].agg(F.sum("n")).first()[0] == 45_000
    held = kept["candidates"].filter(F.pmod("h", F.lit(10)) >= 7).select("n", "label", pii_spans.margin(F.col("f"), model["trees"]).alias("z"))
    total, good, cut = 0, 0, None
    by_margin = held.groupBy("z").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("g"))
    for r in sorted(by_margin.collect(), key=lambda r: -r.z):
        total, good = total + r.n, good + r.g
        cut = r.z if good >= 0.9 * total else cut
    assert cut is not None and model["cuts"] == {1: cut}


def test_pii_edges_and_redaction(spark):
    from pyspark.sql import functions as F

    out = pii_spans.detect(edge(spark), keep_rows=True)
    got = out.select("id", pii_spans.span_text("spans").alias("s"),
                     pii_spans.redact(F.col("row.text"), F.col("spans")).alias("r")).toPandas()
    assert len(got) == len(EDGE)
    assert set(got[got.id == 1].r) == {"The quick brown fox jumps over the lazy dog near [IP] today"}
    assert set(got[got.id == 9].r) == {"é ü ñ 漢字 😀 mail me: [EMAIL]"}
    assert got[got.id == 3].r.isna().all() and set(got[got.id == 4].r) == {""}
    assert pii_spans.detect(empty(spark)).count() == 0


# ---- operator 7 -----------------------------------------------------------------------------------------------------

def test_shards(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    got = sharding.shard(docs, n_shards=40).toPandas()
    rows = texts(docs)
    assert all(s == len(rows[d].encode()) + 16 and c == zlib.crc32(rows[d].encode())
               for d, s, c in zip(got.doc_id, got["size"], got.text_crc32))
    held = got.groupby("shard").agg(n=("slot", "size"), most=("slot", "max"), each=("slot", "nunique"), b=("size", "sum"))
    assert len(held) == 40 and (held.n == held.most + 1).all() and (held.n == held.each).all()
    assert abs(held.b - held.b.mean()).max() <= max(got["size"].max(), 0.02 * held.b.mean())
    assert got.assign(t=[rows[d] for d in got.doc_id]).groupby("t")["shard"].nunique().max() == 1
    by_bytes = sharding.shard(docs, target_bytes=300_000).toPandas().groupby("shard")["size"].sum()
    assert len(by_bytes) == math.ceil(got["size"].sum() / 300_000)


def test_shard_edges(spark):
    got = sharding.shard(edge(spark), n_shards=40).toPandas()
    assert len(got) == len(EDGE) and got["shard"].between(0, 39).all()
    assert set(got[got.doc_id == 3]["size"]) == {16} and set(got[got.doc_id == 3].text_crc32) == {0}
    assert got[got.doc_id.isin([1, 2])]["shard"].nunique() == 1
    assert all(sorted(x.slot) == list(range(len(x))) for _, x in got.groupby("shard"))
    assert sharding.shard(empty(spark), n_shards=40).count() == 0


def test_shards_with_a_third_of_equal_texts(spark):
    rows = [(i, "the same text") for i in range(500)] + [(i, f"text number {i} of {i * 7}") for i in range(500, 1500)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), n_shards=8).toPandas()
    same = got[got.doc_id < 500]
    assert same["shard"].nunique() == 1 and got["shard"].nunique() >= 6


def test_no_shard_is_empty_beside_a_group_of_equal_texts(spark):
    rows = [(i, "the same text of a third of all rows") for i in range(2_000)]
    rows += [(i, f"text number {i} of {i * 7919 % 10_007} " + "x" * (i % 50)) for i in range(2_000, 6_000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), n_shards=40).toPandas()
    size = got.groupby("shard")["size"].sum()
    assert sorted(size.index) == list(range(40))
    group = got[got.doc_id < 2_000]["shard"].unique()
    rest = size.drop(group)
    assert len(group) == 1 and rest.max() <= 1.1 * rest.min()


# ---- operator 10 ----------------------------------------------------------------------------------------------------

def line_stats(text):
    w = WORD.findall(text or "")
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    count, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)),
            len(covered))


def brute_rules(rows, max_share, max_docs, min_left):
    norm = lambda x: " ".join(WORD.findall(x)).lower()
    held, hosts = defaultdict(set), defaultdict(set)
    for _, t, s in rows:
        hosts[s].add(t)
        for x in t.split("\n"):
            if WORD.search(x):
                held[s, norm(x)].add(t)
    out = {}
    for d, t, s in rows:
        n, *_, repeat = line_stats(t)
        gone = sum(len(WORD.findall(x)) for x in t.split("\n") if WORD.search(x)
                   and len(held[s, norm(x)]) > max(max_docs, max_share * len(hosts[s])))
        failed = n < 50 or 100 * repeat > 50 * n
        out[d] = (failed, not failed and n - gone >= min_left * n, gone)
    return out


def test_line_rules_against_brute_force(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    shared = [" ".join(f"Shared{n}word{j}" for j in range(18)) for n in "abc"]
    rows += [(5_000 + i, "\n".join([*shared, f"word{i} and {i}", shared[0].upper()]) + " end" * (i % 3), "h")
             for i in range(40)]  # depleted
    rows += [(6_000 + i, "\n".join([*shared, " ".join(f"own{i}x{j}" for j in range(70))]), "h") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = quality_rules.line_frequency_rules(df, max_share=0.1, max_docs=3).collect()
    expected = brute_rules(rows, 0.1, 3, 0.5)
    by_id = {d: t for d, t, _ in rows}
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == line_stats(by_id[r.doc_id])
        assert (r.base_failed, r.kept, r.removed_words) == expected[r.doc_id]
    assert len(got) == len(rows) and any(not k and not f for f, k, _ in expected.values())


def test_line_rules_edges(spark):
    got = quality_rules.line_frequency_rules(edge(spark), max_docs=0, max_share=0.0).toPandas()
    assert len(got) == len(EDGE)
    for d, t, _ in EDGE:
        if d is not None:
            r = got[got.doc_id == d].iloc[0]
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == line_stats(t)
            assert r.removed_words == r.n_words  # every line is above a limit of no document; repeated rows count once
    assert quality_rules.line_frequency_rules(empty(spark)).count() == 0
