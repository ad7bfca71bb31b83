"""Personal data by candidate gradient boosting (native).

High-recall generators propose spans: the base pattern of each kind and looser
ones (written-out e-mail addresses, national phone numbers, cards with odd
separators, IPv6), which may overlap.  Every candidate has format features
(lengths, digit groups, check digit, number range) and context features (the
characters and cue words around it).  Boosted trees are trained on all
candidates of the base patterns, whose checks give their labels (equal ones once,
weighted by their number); a threshold per kind is calibrated on held-out ones for
the wanted precision.  Matches of a base pattern that pass their checks are
always spans; looser candidates become spans when they do not overlap those and
reach their kind's threshold.

Texts are handled by DataFrame functions alone: regular expressions, higher-order
functions, and the trees as nested comparisons.  The patterns use possessive
repeats and look-behinds, which give the same leftmost matches as the plain ones
but take linear time on long runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinlake.llm.common import read, staged
from clinlake.plans.prefix import running_sum

KINDS = ["email", "ip", "card", "phone"]
#: (kind, base pattern?, pattern, a cheap test that a text can match)
GENERATORS = [
    (0, True, r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    (1, True, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    (2, True, r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9]"),
    (3, True, r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
    (0, False, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\[at\]|\(at\)|\{at\}|\x20at\x20)\x20?"
               r"[A-Za-z0-9-]{1,63}+(?:\x20?(?:\[dot\]|\(dot\)|\{dot\}|\x20dot\x20|\.)\x20?[A-Za-z0-9-]{1,63}+){1,4}",
     r"[\[({]at[\])}]|\x20at\x20[A-Za-z0-9-]{1,63}\x20dot\x20"),
    (1, False, r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
     r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:"),
    (1, False, r"(?<![0-9.])[0-9]{1,3}(?:\x20?\[?\.\]?\x20?[0-9]{1,3}){3}(?![0-9.])", r"[0-9](?:\x20\.|\.\x20|\[\.)"),
    (2, False, r"(?<![0-9])[0-9]{4}(?:[._/][0-9]{4}){3}(?![0-9])", r"[0-9]{4}[._/][0-9]{4}"),
    (3, False, r"(?<![0-9+.-])(?:00[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.-])",
     r"[0-9][\x20).-][\x20.-]?[0-9]{3,4}[\x20.-][0-9]{3}"),
]
CUES = r"(?i)(?:tel|phone|call|fax|mobil|handy|mail|contact|kontakt|card|visa|karte|tarjeta|carte|\bip\b|host|server|addr)"
FOUND = "array<struct<k:int,base:boolean,s:int,e:int,m:string,before:string,after:string>>"
FEATURES = ["kind", "length", "digits", "separators", "letters", "groups", "longest", "shortest", "check_digit",
            "largest", "joined_before", "joined_after", "cue", "assigned", "first"]


def find(text: str, kind: int, base: bool, hits: str, gaps: str) -> Column:
    """Spans of the matches (code points, end exclusive) from the matches and
    the gaps between them."""
    def step(acc, i):
        g, h = F.get(F.col(gaps), i), F.get(F.col(hits), i)
        s = acc["p"] + F.length(g)
        one = F.struct(F.lit(kind).alias("k"), F.lit(base).alias("base"), s.alias("s"), (s + F.length(h)).alias("e"),
                       h.alias("m"), F.right(g, F.lit(24)).alias("before"),
                       F.left(F.get(F.col(gaps), i + 1), F.lit(1)).alias("after"))
        return F.struct((s + F.length(h)).alias("p"), F.concat(acc["o"], F.array(one)).alias("o"))
    n = F.size(hits)
    return F.when(n > 0, F.aggregate(
        F.sequence(F.lit(0), n - 1), F.struct(F.lit(0).alias("p"), F.array().cast(FOUND).alias("o")), step,
        lambda acc: acc["o"])).otherwise(F.array().cast(FOUND))


def _digit_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits (null when empty)."""
    d = F.reverse(digits)
    each = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.substring(d, i, F.lit(1)).try_cast("int")
                       * F.when(i % 2 == 0, F.lit(2)).otherwise(F.lit(1)))
    return F.when(F.length(d) > 0, F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)))


def _described(x: Column) -> Column:
    """A candidate with its check (``ok``) and features (``f``)."""
    m = x["m"]
    digits = F.regexp_replace(m, "[^0-9]", "")
    groups = F.array_remove(F.split(m, "[^0-9]+"), "")
    sizes = F.transform(groups, lambda g: F.length(g))
    trimmed = F.transform(groups, lambda g: F.regexp_replace(g, "^0+(?=[0-9])", ""))
    largest = F.coalesce(F.array_max(F.transform(trimmed, lambda g: F.when(F.length(g) > 6, F.lit(1_000_000))
                                                 .otherwise(g.try_cast("int")))), F.lit(0))
    n = F.length(digits)
    luhn = F.when((n >= 8) & (n <= 24), F.coalesce(_digit_sum(digits) % 10 == 0, F.lit(False))).otherwise(F.lit(False))
    ok = (F.when(x["k"] == 0, F.lit(True)).when(x["k"] == 1, largest <= 255)
          .when(x["k"] == 2, (n >= 13) & (n <= 19) & luhn).otherwise((n >= 9) & (n <= 15)))
    flag = lambda c: c.cast("double")
    f = F.array(*[c.cast("double") for c in (
        x["k"], F.length(m), n, F.length(F.regexp_replace(m, "[0-9A-Za-z]", "")),
        F.length(F.regexp_replace(m, "[^A-Za-z]", "")), F.size(groups), F.coalesce(F.array_max(sizes), F.lit(0)),
        F.coalesce(F.array_min(sizes), F.lit(0)), flag(luhn), largest, flag(x["before"].rlike("[0-9A-Za-z]$")),
        flag(x["after"].rlike("[0-9A-Za-z]")), flag(x["before"].rlike(CUES)), flag(x["before"].rlike("[=\"'#/]\\s*$")),
        F.coalesce(F.left(digits, F.lit(1)).try_cast("int"), F.lit(-1)))])
    return F.struct(x["k"].alias("k"), x["base"].alias("base"), x["s"].alias("s"), x["e"].alias("e"), ok.alias("ok"),
                    f.alias("f"))


def candidates(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """``df`` with the array of all proposed spans of ``text_col``."""
    none = F.array().cast("array<string>")
    for i, (_, _, pattern, test) in enumerate(GENERATORS):
        can = F.col(text_col).contains(test) if test == "@" else F.col(text_col).rlike(test)
        df = df.withColumn(f"{out}_h{i}", F.when(can, F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0)))
                           .otherwise(none))
        df = df.withColumn(f"{out}_g{i}", F.when(F.size(f"{out}_h{i}") > 0, F.split(F.col(text_col), pattern, -1))
                           .otherwise(none))
    found = [find(text_col, k, base, f"{out}_h{i}", f"{out}_g{i}") for i, (k, base, _, _) in enumerate(GENERATORS)]
    df = df.withColumn(f"{out}_all", F.concat(*found))
    df = df.withColumn(out, F.transform(f"{out}_all", _described))
    return df.drop(f"{out}_all", *[f"{out}_{c}{i}" for c in "hg" for i in range(len(GENERATORS))])


def train(cands: DataFrame, col: str, trees: int = 20, precision: float = 0.98) -> dict:
    """Boosted trees and a threshold per kind, from all candidates of base patterns: those
    with equal features and label are one row weighted by their number.  Three tenths, by a
    hash of the features, are held out of the fit and give the thresholds.

    A kind without held-out positives, or whose wanted precision no threshold
    reaches, gets none, and then takes no looser candidates; with one label
    only, nothing is learnt."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    rows = cands.select(F.explode(F.filter(col, lambda x: x["base"])).alias("c")).groupBy(
        F.col("c.k").alias("k"), F.col("c.ok").cast("double").alias("label"), F.col("c.f").alias("f")).agg(
        F.count(F.lit(1)).alias("n")).withColumn("h", F.xxhash64("f"))
    # a fixed layout: the trees' split points do not depend on the shuffle's partitions
    rows = staged(rows.repartition(32, "h").sortWithinPartitions("h", "k", "label"), "candidates")
    fit, held = (rows.filter(F.pmod("h", F.lit(10)) < 7), rows.filter(F.pmod("h", F.lit(10)) >= 7))
    if rows.agg(F.countDistinct("label")).first()[0] < 2 or fit.isEmpty():
        return {"trees": [], "cuts": {}}
    model = GBTClassifier(featuresCol="x", weightCol="w", maxIter=trees, maxDepth=4, seed=1, stepSize=0.2).fit(
        fit.withColumn("x", array_to_vector("f")).withColumn("w", F.col("n").cast("double")))
    grown = [(w, _nodes(t._java_obj.rootNode())) for w, t in zip(model.treeWeights, model.trees)]
    scored = held.select("k", "n", (F.col("n") * F.col("label")).alias("good"), (-margin(F.col("f"), grown)).alias("z"))
    scored = staged(scored.groupBy("k", "z").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "scored")
    upto = running_sum(scored, ["k"], ["z"], ["n", "good"], ["n_upto", "good_upto"])  # from the highest margin down
    low = upto.filter(F.col("good_upto") >= precision * F.col("n_upto")).groupBy("k").agg(F.max("z").alias("z"))
    return {"trees": grown, "cuts": {r["k"]: -r["z"] for r in low.collect()}}  # one row a kind


def _nodes(node):
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    return node.split().featureIndex(), float(node.split().threshold()), _nodes(node.leftChild()), \
        _nodes(node.rightChild())


def margin(f: Column, trees: Sequence[tuple]) -> Column:
    """Weighted sum of the trees' answers as nested comparisons."""
    def walk(node):
        if isinstance(node, float):
            return F.lit(node)
        i, cut, left, right = node
        return F.when(F.get(f, F.lit(i)) <= cut, walk(left)).otherwise(walk(right))
    total = F.lit(0.0)
    for w, root in trees:
        total = total + F.lit(w) * walk(root)
    return total


def select_spans(df: DataFrame, col: str, model: dict) -> DataFrame:
    """``df`` with ``base_spans`` and ``spans``: arrays of (k, s, e) by kind, then start."""
    plain = lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"))
    base = F.sort_array(F.transform(F.filter(col, lambda x: x["base"] & x["ok"]), plain))
    df = df.withColumn("base_spans", base)
    if not model["cuts"]:
        return df.withColumn("spans", F.col("base_spans"))
    cut = F.lit(None).cast("double")
    reaches = lambda x: F.coalesce(margin(x["f"], model["trees"]) >= _cut(x["k"], model["cuts"], cut),
                                   F.lit(False))
    apart = lambda x, y: (x["e"] <= y["s"]) | (y["e"] <= x["s"])
    more = F.filter(F.filter(col, lambda x: ~x["base"]), lambda x: reaches(x) & F.forall(
        "base_spans", lambda y: apart(x, y)))
    df = df.withColumn("_more", F.sort_array(F.transform(more, lambda x: F.struct(
        x["s"].alias("s"), (-x["e"]).alias("e"), x["k"].alias("k")))))
    # left to right, the longest first: a later candidate that overlaps a chosen one is left out
    chosen = F.aggregate(
        "_more", F.struct(F.lit(0).alias("p"), F.array().cast("array<struct<k:int,s:int,e:int>>").alias("o")),
        lambda acc, x: F.when(x["s"] >= acc["p"], F.struct((-x["e"]).alias("p"), F.concat(acc["o"], F.array(
            F.struct(x["k"].alias("k"), x["s"].alias("s"), (-x["e"]).alias("e")))).alias("o"))).otherwise(acc),
        lambda acc: acc["o"])
    return df.withColumn("spans", F.sort_array(F.concat("base_spans", chosen))).drop("_more")


def _cut(kind: Column, cuts: dict, none: Column) -> Column:
    out = none
    for k, z in cuts.items():
        out = F.when(kind == k, F.lit(z)).otherwise(out)
    return out


def span_text(col: str) -> Column:
    """kind:start:end, comma-joined."""
    name = lambda k: F.get(F.array(*[F.lit(x) for x in KINDS]), k)
    return F.array_join(F.transform(col, lambda x: F.concat_ws(":", name(x["k"]), x["s"], x["e"])), ",")


def redact(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets; of spans that
    overlap, the earlier ends where the later begins."""
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ordered = F.sort_array(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))))
    done = F.aggregate(
        ordered, F.struct(F.lit(0).alias("p"), F.lit("").alias("o")),
        lambda acc, x: F.struct(F.greatest(x["e"], acc["p"]).alias("p"), F.concat(
            acc["o"], F.substring(text, acc["p"] + 1, F.greatest(x["s"] - acc["p"], F.lit(0))),
            F.get(marks, x["k"])).alias("o")),
        lambda acc: F.concat(acc["o"], F.substring(text, acc["p"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_rows: bool = False,
           **training) -> DataFrame:
    """id, base_spans, spans of each row (and with ``keep_rows`` the input row as
    the struct ``row``).

    Nulls: a null text is empty, a null id stays.  Repeated rows give repeated
    equal results.  An empty table gives an empty table.  Columns other than the
    two named travel inside ``row``, whatever their names."""
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"),
                      *([F.struct("*").alias("row")] if keep_rows else []))
    found = staged(candidates(src, "t", "c").drop("t"), "pii")
    return select_spans(found, "c", train(found, "c", **training)).drop("c")


def op6_boosted_pii(spark, sf_dir):
    out = detect(read(spark, sf_dir, "documents", "doc_id", "text"))
    count = lambda k: F.size(F.filter("base_spans", lambda x: x["k"] == k)).cast("long")
    return out.select(F.col("id").alias("doc_id"), *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
                      F.sha2(span_text("base_spans"), 256).alias("base_sha256"), span_text("spans").alias("spans"))


QUERIES = {"op6_boosted_pii": op6_boosted_pii}
