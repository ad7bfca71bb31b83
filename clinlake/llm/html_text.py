"""Main text of HTML pages.

A page is cut into flat text blocks (a block ends at every block-level tag).
Each block has its word count and link density, those of its neighbours, and
the kind of container it stands in; a decision tree trained on a small labelled
table of such blocks decides whether it belongs to the article.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinlake.llm.common import read

FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "boiler", "article",
            "heading"]

#: The labelled table: words and link density of a block, of the block before
#: and after it, its container (boiler: menu, header, footer, notice, advert,
#: form, comment or aside; article: article or main; heading) and whether it is
#: article text.
LABELLED = [
    # words, links, words_before, links_before, words_after, links_after, boiler, article, heading, content
    (120, 0.00, 80, 0.00, 95, 0.02, 0, 1, 0, 1),
    (65, 0.05, 40, 0.00, 70, 0.00, 0, 1, 0, 1),
    (30, 0.00, 9, 0.00, 45, 0.10, 0, 1, 0, 1),
    (6, 0.00, 0, 0.00, 85, 0.00, 0, 1, 1, 1),
    (9, 0.00, 1, 1.00, 60, 0.00, 0, 1, 1, 1),
    (3, 0.00, 60, 0.00, 40, 0.00, 0, 1, 0, 1),
    (1, 0.00, 50, 0.00, 0, 0.00, 0, 1, 0, 1),
    (2, 0.00, 4, 0.00, 3, 0.00, 0, 1, 0, 1),
    (14, 0.50, 70, 0.00, 60, 0.00, 0, 1, 0, 1),
    (5, 0.00, 120, 0.00, 8, 0.30, 0, 1, 0, 1),
    (40, 0.30, 25, 0.10, 30, 0.00, 0, 1, 0, 1),
    (8, 1.00, 45, 0.00, 50, 0.00, 0, 1, 0, 1),
    (1, 0.00, 1, 0.00, 1, 0.00, 0, 1, 0, 1),
    (10, 0.90, 9, 1.00, 8, 1.00, 0, 1, 0, 0),
    (4, 1.00, 3, 1.00, 5, 1.00, 0, 1, 0, 0),
    (2, 1.00, 2, 1.00, 2, 1.00, 0, 1, 0, 0),
    (3, 1.00, 60, 0.00, 3, 1.00, 0, 1, 0, 0),
    (90, 0.00, 70, 0.00, 60, 0.00, 0, 0, 0, 1),
    (45, 0.10, 20, 0.00, 35, 0.00, 0, 0, 0, 1),
    (25, 0.00, 60, 0.00, 8, 0.00, 0, 0, 0, 1),
    (18, 0.05, 30, 0.00, 80, 0.00, 0, 0, 0, 1),
    (12, 0.00, 55, 0.00, 60, 0.00, 0, 0, 0, 1),
    (7, 0.00, 2, 0.50, 75, 0.00, 0, 0, 1, 1),
    (5, 0.00, 40, 0.00, 50, 0.00, 0, 0, 1, 1),
    (11, 0.00, 0, 0.00, 30, 0.00, 0, 0, 1, 1),
    (4, 0.00, 45, 0.00, 40, 0.00, 0, 0, 0, 1),
    (30, 0.20, 0, 0.00, 0, 0.00, 0, 0, 0, 1),
    (22, 0.00, 0, 0.00, 0, 0.00, 0, 0, 0, 1),
    (2, 0.00, 3, 1.00, 2, 1.00, 0, 0, 0, 0),
    (3, 1.00, 2, 1.00, 2, 1.00, 0, 0, 0, 0),
    (1, 1.00, 1, 1.00, 1, 1.00, 0, 0, 0, 0),
    (15, 0.95, 12, 1.00, 14, 0.90, 0, 0, 0, 0),
    (40, 0.80, 30, 0.90, 20, 0.70, 0, 0, 0, 0),
    (6, 0.60, 4, 1.00, 5, 1.00, 0, 0, 0, 0),
    (4, 0.00, 3, 1.00, 5, 0.80, 0, 0, 1, 0),
    (8, 0.00, 2, 0.00, 3, 0.50, 0, 0, 0, 0),
    (5, 0.00, 6, 0.00, 2, 0.00, 0, 0, 0, 0),
    (3, 0.00, 0, 0.00, 2, 1.00, 0, 0, 0, 0),
    (3, 1.00, 80, 0.00, 60, 0.00, 0, 0, 0, 0),
    (1, 0.00, 2, 0.00, 0, 0.00, 0, 0, 0, 0),
    (120, 0.00, 60, 0.00, 80, 0.00, 1, 0, 0, 0),
    (60, 0.10, 5, 0.00, 40, 0.00, 1, 0, 0, 0),
    (45, 0.00, 50, 0.00, 70, 0.00, 1, 1, 0, 0),
    (25, 0.00, 90, 0.00, 100, 0.00, 1, 1, 0, 0),
    (8, 0.00, 1, 1.00, 40, 0.00, 1, 0, 0, 0),
    (7, 0.00, 1, 1.00, 12, 0.00, 1, 1, 0, 0),
    (2, 1.00, 1, 1.00, 3, 1.00, 1, 0, 0, 0),
    (1, 1.00, 0, 0.00, 1, 1.00, 1, 0, 0, 0),
    (12, 0.10, 60, 0.00, 0, 0.00, 1, 0, 0, 0),
    (4, 0.00, 80, 0.00, 30, 0.00, 1, 0, 1, 0),
    (5, 0.00, 70, 0.00, 20, 0.00, 1, 1, 1, 0),
    (30, 0.00, 6, 0.00, 0, 0.00, 1, 0, 0, 0),
]

#: Tags that neither end a block nor carry text of their own.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math "
                   "picture q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page.
SKIP = frozenset("script style noscript template svg iframe object canvas audio video head select textarea button "
                 "datalist title".split())
BOILER = frozenset("nav footer aside form menu dialog fieldset".split())
#: Names in class, id, role or label that mark a container as not the article.
BOILER_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|popups?|modal\w*|"
    r"overlay|newsletter|subscri\w*|signup|login|nav\w*|menus?|breadcrumbs?|sidebars?|side-?bar|widgets?|related|"
    r"recommend\w*|share|sharing|social|footer|foot|masthead|topbar|toolbar|pagination|pager|comments?|comment-?\w*|"
    r"disqus|respon[ds]e?s?|replies|reply|search\w*|copyright|legal|disclaimer|complementary|contentinfo|navigation|"
    r"alertdialog|dialog|alert)(?:$|[\s_-]|\d)", re.I)
#: Names that tell of something elsewhere ("has-sidebar"), and articles that are not the article.
STATE_NAME = re.compile(r"(?:has|with|no|show|hide|is|not)[_-]", re.I)
ARTICLE_LIKE = re.compile(r"(?:comments?|reply|replies|teasers?|related)(?:[_-]|$)", re.I)
HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?:\s|$|=)|aria-hidden\s*=\s*[\"']?true)|display\s*:\s*none", re.I)
NAMED = re.compile(r"\b(?:class|id|role|aria-label|data-role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)", re.S)
#: A paragraph ends where one of these opens.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer "
                   "form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())


ROOT = ("", False, False, False)


def _boiler(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in BOILER or (tag == "header" and not in_article):
        return True
    if not attrs or tag in ("html", "body"):
        return False
    if HIDDEN.search(attrs):
        return True
    names = [n for value in NAMED.findall(attrs) for n in "".join(value).split() if not STATE_NAME.match(n)]
    if tag in ("article", "main"):
        return any(ARTICLE_LIKE.match(n) for n in names)
    return any(BOILER_NAME.search(n) for n in names)


def blocks(page: str) -> list[tuple[str, int, int, int, int, int]]:
    """(text, words, words in links, boiler, article, heading) of each non-empty block."""
    out, parts, link_words = [], [], 0
    stack: list[tuple[str, bool, bool, bool]] = []  # open elements: tag, boiler, article, heading
    opened: Counter = Counter()
    links = 0
    pos, end = 0, len(page)

    def flush():
        nonlocal parts, link_words
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                _, boiler, article, heading = stack[-1] if stack else ROOT
                n = len(text.split(" "))
                out.append((text, n, min(n, link_words), int(boiler), int(article), int(heading)))
        parts, link_words = [], 0

    while pos < end:
        m = TOKEN.match(page, pos)
        if m is None:  # a tag whose quotes never close: it ends at the next ">"
            pos = (page.find(">", pos) + 1) or end
            continue
        pos = m.end()
        if (text := m["text"]) is not None:
            if "&" in text:
                text = html.unescape(text)
            parts.append(text)
            if links:
                link_words += len(text.split())
            continue
        if m["tag"] is None:
            continue
        tag, attrs = m["tag"].lower(), m["attrs"]
        if tag in SKIP:
            if not m["close"] and not attrs.endswith("/"):
                if tag not in ("svg", "button"):
                    flush()
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, pos)
                if close:
                    pos = close.end()
                elif tag in ("script", "style", "textarea"):
                    pos = end
            continue
        if tag == "br":
            parts.append(" ")
            continue
        inline = tag in INLINE
        if m["close"]:
            if tag == "a":
                links = max(0, links - 1)
            if not inline:
                flush()
            if opened[tag]:
                depth = len(stack) - 1
                while stack[depth][0] != tag and (not inline or stack[depth][0] in INLINE):
                    depth -= 1
                if stack[depth][0] == tag:
                    opened.subtract(t[0] for t in stack[depth:])
                    del stack[depth:]
            continue
        if not inline:
            flush()
            links = 0
            if tag in ENDS_P and opened["p"]:  # a paragraph that holds only inline elements ends here
                top = len(stack) - 1
                while top >= 0 and stack[top][0] in INLINE:
                    top -= 1
                if top >= 0 and stack[top][0] == "p":
                    opened.subtract(t[0] for t in stack[top:])
                    del stack[top:]
            if tag == "li" and stack and stack[-1][0] == "li":
                opened["li"] -= 1
                stack.pop()
        if tag in VOID or attrs.endswith("/"):
            continue
        if tag == "a":
            links += 1
        _, boiler, article, heading = stack[-1] if stack else ROOT
        mine = _boiler(tag, attrs, article)
        if inline and mine and not boiler:
            flush()
        opened[tag] += 1
        stack.append((tag, boiler or mine, article or tag in ("article", "main"),
                      heading or (len(tag) == 2 and tag[0] == "h" and tag[1] in "123456")))
    flush()
    return out


def features(found: Sequence[tuple]) -> np.ndarray:
    """A feature row per block (see ``FEATURES``)."""
    n = len(found)
    words = np.array([b[1] for b in found], dtype=float)
    dens = np.array([b[2] / b[1] for b in found], dtype=float)
    pad = lambda a, k: np.concatenate([[0.0], a[:-1]]) if k < 0 else np.concatenate([a[1:], [0.0]])
    return np.column_stack([words, dens, pad(words, -1), pad(dens, -1), pad(words, 1), pad(dens, 1),
                            [b[3] for b in found], [b[4] for b in found], [b[5] for b in found]]) if n else \
        np.empty((0, len(FEATURES)))


def train_tree(spark: SparkSession, labelled: Sequence[tuple] = LABELLED, max_depth: int = 6) -> list[tuple]:
    """The decision tree as flat nodes (feature, threshold, left, right, class);
    the training table is a small literal."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    df = spark.createDataFrame([tuple(float(v) for v in row) for row in labelled],
                               ", ".join(f"{c} double" for c in [*FEATURES, "label"])).coalesce(1)
    model = DecisionTreeClassifier(maxDepth=max_depth, minInstancesPerNode=1, seed=1, maxBins=64).fit(
        VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df))
    nodes: list = []

    def walk(node):
        at = len(nodes)
        nodes.append(None)
        if node.getClass().getSimpleName() == "LeafNode":
            nodes[at] = (-1, 0.0, -1, -1, int(node.prediction()))
        else:
            split = node.split()
            left = walk(node.leftChild())
            nodes[at] = (split.featureIndex(), split.threshold(), left, walk(node.rightChild()), -1)
        return at
    walk(model._java_obj.rootNode())
    return nodes


def classify(nodes: Sequence[tuple], x: np.ndarray) -> np.ndarray:
    """Class of each row, all rows descending the tree together."""
    feature, cut, left, right, label = (np.array(c) for c in zip(*nodes))
    at = np.zeros(len(x), dtype=int)
    while (inner := feature[at] >= 0).any():
        i = np.flatnonzero(inner)
        low = x[i, feature[at[i]]] <= cut[at[i]]
        at[i] = np.where(low, left[at[i]], right[at[i]])
    return label[at]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            nodes: Sequence[tuple] | None = None) -> DataFrame:
    """(id, url, text, n_chars, n_blocks, n_kept) of each page.

    Nulls: a null page is empty and gives the empty text; a null id or URL
    stays.  Repeated rows give repeated equal results; an empty table gives an
    empty table."""
    tree = list(nodes) if nodes is not None else train_tree(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 500):
                part = pdf.iloc[lo:lo + 500]
                found = [blocks(h) if isinstance(h, str) else [] for h in part["html"]]
                every = [features(b) for b in found]
                keep = classify(tree, np.vstack(every)) if every else np.empty(0, int)
                texts, kept, at = [], [], 0
                for b in found:
                    k = keep[at:at + len(b)]
                    at += len(b)
                    texts.append("\n".join(x[0] for x, y in zip(b, k) if y))
                    kept.append(int(k.sum()))
                yield pd.DataFrame({"id": part["id"], "url": part["url"], "text": texts,
                                    "n_chars": [len(t) for t in texts], "n_blocks": [len(b) for b in found],
                                    "n_kept": kept})
    src = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    out = src.mapInPandas(run, "id long, url string, text string, n_chars long, n_blocks int, n_kept int")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)


def op9_text_blocks(spark, sf_dir):
    return extract(read(spark, sf_dir, "pages", "page_id", "url", "html"))


QUERIES = {"op9_text_blocks": op9_text_blocks}
