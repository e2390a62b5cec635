"""Main text of HTML pages from flat text blocks.

A page is cut into text blocks at block-level tags. A block's features are its words and link
density, those of the blocks before and after it, and what it lies in; a decision tree trained
on the small labelled table below keeps it or drops it. Kept blocks are joined by line feeds.

Defined results: null or empty html gives an empty text; a page cut off anywhere is read as far
as it goes; repeated rows give repeated results; input columns other than the three used are
ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import tidy

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "article", "outside", "heading", "listed")

# Hand-labelled blocks: the features in order (words; share of words in links; both for the block
# before and after; inside an article; depth of containers that hold no article text; heading;
# item of a list or cell), and whether the block is article text.
LABELLED = """
1 1.0 0 0.0 1 1.0 0 1 0 1 0
1 1.0 1 1.0 1 1.0 0 1 0 1 0
2 1.0 1 1.0 12 0.0 0 1 0 1 0
3 1.0 2 1.0 4 1.0 0 0 0 1 0
1 1.0 1 1.0 1 1.0 0 0 0 1 0
2 0.9 0 0.0 8 0.0 0 0 0 0 0
9 0.0 1 1.0 7 0.0 0 1 0 0 0
14 0.0 2 1.0 9 0.0 0 1 0 0 0
30 0.1 2 1.0 9 0.0 0 1 0 0 0
60 0.0 3 0.0 40 0.0 0 1 0 0 0
25 0.0 80 0.0 0 0.0 0 1 0 0 0
5 0.2 60 0.0 0 0.0 0 1 0 0 0
8 0.0 40 0.0 0 0.0 0 2 0 0 0
12 0.0 50 0.0 6 0.5 0 1 0 1 0
4 0.0 9 0.0 30 0.0 0 1 1 0 0
2 0.0 0 0.0 50 0.0 0 1 1 0 0
20 0.0 25 0.0 30 0.0 1 1 0 0 0
45 0.0 60 0.0 30 0.0 1 1 0 0 0
70 0.0 8 0.0 12 0.0 1 1 0 0 0
6 0.0 80 0.0 90 0.0 1 1 0 0 0
3 0.0 90 0.0 20 0.0 1 1 1 0 0
2 1.0 80 0.0 3 1.0 1 1 0 1 0
6 1.0 80 0.0 6 1.0 1 1 0 1 0
15 0.0 70 0.0 20 0.0 1 2 0 0 0
40 0.0 3 0.0 2 0.0 1 2 0 0 0
3 1.0 70 0.0 4 1.0 1 0 0 1 0
5 1.0 90 0.0 0 0.0 1 0 0 0 0
7 0.0 9 0.0 30 0.0 1 0 1 0 1
1 0.0 12 0.0 90 0.0 1 0 1 0 1
12 0.0 1 1.0 1 0.0 1 0 1 0 1
3 0.0 60 0.0 70 0.0 1 0 1 0 1
9 1.0 1 1.0 60 0.0 1 0 1 0 1
80 0.0 7 0.0 50 0.0 1 0 0 0 1
120 0.05 90 0.0 30 0.0 1 0 0 0 1
30 0.0 1 0.0 1 0.0 1 0 0 0 1
1 0.0 40 0.0 1 0.0 1 0 0 0 1
1 0.0 1 0.0 90 0.0 1 0 0 0 1
2 0.0 3 0.0 2 0.0 1 0 0 0 1
5 0.0 100 0.0 9 0.1 1 0 0 0 1
6 0.0 50 0.0 0 0.0 1 0 0 0 1
15 0.4 60 0.0 50 0.0 1 0 0 0 1
25 0.5 60 0.0 50 0.0 1 0 0 0 1
10 0.6 60 0.0 50 0.0 1 0 0 0 1
8 0.0 40 0.0 9 0.0 1 0 0 1 1
4 0.0 8 0.0 4 0.0 1 0 0 1 1
12 0.5 9 0.0 10 0.0 1 0 0 1 1
3 0.0 3 0.0 3 0.0 1 0 0 1 1
60 0.0 7 0.0 80 0.0 0 0 0 0 1
90 0.1 60 0.0 40 0.0 0 0 0 0 1
40 0.0 90 0.0 5 0.0 0 0 0 0 1
20 0.0 60 0.0 70 0.0 0 0 0 0 1
12 0.0 40 0.0 35 0.0 0 0 0 0 1
16 0.3 40 0.0 50 0.0 0 0 0 0 1
3 0.0 45 0.0 60 0.0 0 0 0 0 1
6 0.0 5 1.0 80 0.0 0 0 1 0 1
5 0.0 60 0.0 70 0.0 0 0 1 0 1
9 0.0 30 0.0 40 0.0 0 0 0 1 1
5 0.0 40 0.0 6 0.0 0 0 0 1 1
6 0.0 5 0.0 60 0.0 0 0 0 1 1
6 0.0 2 1.0 4 0.0 0 0 0 0 0
4 0.0 0 0.0 2 1.0 0 0 0 0 0
7 0.3 3 1.0 0 0.0 0 0 0 0 0
10 0.8 60 0.0 6 1.0 0 0 0 0 0
8 0.0 5 1.0 3 1.0 0 0 0 0 0
5 0.5 50 0.0 0 0.0 0 0 0 0 0
20 0.8 15 0.9 12 1.0 0 0 0 1 0
15 0.9 70 0.0 30 0.0 0 0 0 1 0
40 0.0 2 1.0 40 0.0 1 0 0 0 1
40 0.0 40 0.0 2 0.5 1 0 0 0 1
90 0.05 3 1.0 3 0.5 1 0 0 0 1
30 0.0 3 1.0 3 1.0 1 0 0 0 1
35 0.0 2 1.0 38 0.0 0 0 0 0 1
35 0.0 38 0.0 2 0.5 0 0 0 0 1
25 0.0 1 1.0 0 0.0 0 0 0 0 1
60 0.0 6 1.0 5 1.0 0 0 0 0 1
45 0.1 3 1.0 4 0.4 0 0 0 0 1
50 0.0 4 1.0 50 0.0 0 0 0 1 1
50 0.0 50 0.0 4 0.5 0 0 0 1 1
7 0.0 0 0.0 30 0.0 1 0 1 0 1
5 0.0 0 0.0 12 0.0 1 0 1 0 1
3 0.0 2 1.0 12 0.0 1 0 1 0 1
40 0.0 0 0.0 40 0.0 1 0 0 0 1
12 0.0 0 0.0 2 0.0 1 0 0 0 1
3 0.0 0 0.0 6 0.0 1 0 0 0 1
4 0.0 0 0.0 0 0.0 1 0 0 0 1
4 0.1 2 1.0 2 1.0 1 0 0 0 1
9 0.2 3 1.0 2 1.0 1 0 0 0 1
30 0.0 0 0.0 30 0.0 0 0 0 0 1
40 0.0 0 0.0 0 0.0 0 0 0 0 1
6 0.0 0 0.0 60 0.0 0 0 1 0 1
4 0.0 2 1.0 12 0.0 0 0 1 0 1
2 1.0 0 0.0 40 0.0 1 0 0 1 0
1 0.0 12 0.0 2 0.0 0 0 0 0 1
2 0.0 1 0.0 2 0.0 0 0 0 1 1
10 0.0 2 0.0 0 0.0 0 0 0 0 1
10 0.0 2 0.0 3 0.5 0 0 0 0 1
7 0.0 20 0.0 0 0.0 0 0 0 0 1
"""

# How tags and names are read.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINERS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figure footer form header li main menu nav ol section table tbody td th thead tr ul".split())
OUTSIDE = frozenset("nav aside footer form menu dialog fieldset button".split())
SKIPPED = "script|style|noscript|template|textarea|title|svg|iframe|object|select|button|math|canvas|audio|video"
#: Parts of class names and ids that say that an element holds no article text.
_HINT = re.compile(
    r"(?:nav(?:bar|igation)?|menus?|footer|foot|side-?bar|sidenav|aside|ads?|advert\w*|adsense|adbox|sponsor\w*|promo\w*|banner|notices?|notification|cookies?|cookiebar|consent|gdpr|privacy|paywall|alert|popup|modal|overlay|newsletter|subscri\w*|signup|login|search|share|sharing|social|related|recommend\w*|trending|popular|teasers?|breadcrumbs?|pag(?:er|ination)|widgets?|comments?|commentlist|replies|reply|responses?|discussion|disqus|respond|feedback|toolbar|tags|copyright|legal|disclaimer|skip\w*)", re.I)
#: Parts that may stand beside a hint; with any other part a name is about something else, as
#: 'ad-hoc' and 'search-for-life' are.
_BESIDE = re.compile(
    r"(?:box|bar|block|wrap(?:per|ped)?|container|section|area|zone|region|list|items?|panel|form|field|input|top|bottom|left|right|center|main|mobile|desktop|site|page|global|primary|secondary|inner|outer|wide|narrow|sticky|fixed|links?|buttons?|btn|icons?|text|title|heading|header|head|body|content|module|inline|unit|slot|row|col(?:umn)?|group|set|stack|card|grid|strip|note|message|msg|warning|info|policy|terms|settings?|us|this|post|posts|article|articles|story|stories|entry|news|blog|reader|readers|user|users|author|guest|thread|count|counter|new|latest|more|to|the|and|your|our|by|for|in|up|down|on|off|el|js|ui|wp|id|rail|leader(?:board)?|large|small|medium|big|mini|s|m|l|xl|media|video|image|img|native|partner|content|outbrain|taboola|google|dfp|gpt|facebook|twitter|email|e|mail|toggle|open|close|closed|hidden|visible|\d+|[a-f0-9]{6,})", re.I)
_PARTS = re.compile(r"[_-]+")
#: Names that mean the page's head, unless inside an article.
_HEADS = re.compile(r"(?:header|masthead|topbar)", re.I)


def _condemned(name: str, in_article: bool) -> bool:
    """A class name or id all of whose parts are known, one of them as a hint."""
    hint = False
    for part in filter(None, _PARTS.split(name)):
        if _HINT.fullmatch(part) or (not in_article and _HEADS.fullmatch(part)):
            hint = True
        elif not _BESIDE.fullmatch(part):
            return False
    return hint


#: Names that describe a layout, not what an element holds.
_LAYOUT = re.compile(r"(?:has|with|no|is|layout|page|col|row)[_-]", re.I)
#: Elements that hold the page, whatever they are called.
_WHOLE = frozenset(("body", "main"))
_INSIDE = re.compile(r"(?:^|[_-])(?:article|post|entry|story|main|content)(?:$|[_-])", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<skip>{SKIPPED})(?=[\s/>])(?:(?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
#: End tags of skipped elements, and those elements that run to the page's end without one: what they hold is never text.
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in SKIPPED.split("|")}
_RAW = frozenset(("script", "style"))
#: Names of what an article is about, as blogs give them to its element.
_TERMS = re.compile(r"(?:tag|category)-", re.I)
_ATTR = re.compile(r"(?<![\w-])(class|id|role|hidden|style|itemprop|aria-hidden)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_HEADING = re.compile(r"h[1-6]$")
#: Words of a block that is long enough to be an article's.
LONG_BLOCK = 20


def _kind(tag: str, attrs: str, in_article: bool, nested: bool = False, names: bool = True) -> tuple[int, int]:
    """(opens an article, opens a container without article text). Names do not condemn an
    article, unless it is nested in another one, as comments and teasers are; with names=False
    they condemn nothing."""
    inside = 1 if tag in ("article", "main") else 0
    outside = 1 if tag in OUTSIDE or (tag == "header" and not in_article) else 0
    if attrs:
        known = [(name.lower(), a or b or c) for name, a, b, c in _ATTR.findall(attrs)]
        whole = not nested and (tag == "article" or any((n == "role" and v.lower() in ("main", "article")) or (n == "itemprop" and v.lower() == "articlebody") for n, v in known))
        for name, value in known:
            if name in ("class", "id"):
                for part in value.split():
                    if tag in _WHOLE or _LAYOUT.match(part) or _TERMS.match(part):
                        continue
                    outside = outside or (1 if names and not whole and _condemned(part, in_article) else 0)
                    inside = inside or (1 if _INSIDE.search(part) else 0)
            elif name == "role":
                outside = outside or (1 if value.lower() in _ROLES else 0)
                inside = inside or (1 if value.lower() in ("main", "article") else 0)
            elif name == "itemprop":
                inside = inside or (1 if value.lower() == "articlebody" else 0)
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
                outside = 1
    return (0 if outside else inside), outside


def blocks(page: str, names: bool = True) -> list[tuple[str, list[float]]]:
    """The page's text blocks in order, each with its own features: words, share of words in
    links, in an article, depth outside, heading, listed. names: class names and ids are read."""
    found: list[tuple[str, list[float]]] = []
    stack: list[tuple[str, int, int]] = []
    opened: Counter[str] = Counter()  # how often each tag lies on the stack
    text: list[str] = []
    linked: list[str] = []
    in_link = article = outside = heading = own = 0  # own: the block's element itself is outside
    at = 0

    def flush() -> None:
        nonlocal text, linked
        if text:
            words = html.unescape("".join(text)).split()
            if words:
                n = len(words)
                m = min(n, len(html.unescape(" ".join(linked)).split())) if linked else 0
                listed = 1 if stack and stack[-1][0] in ("li", "td", "th", "dd", "dt") else 0
                found.append((" ".join(words), [n, m / n, 1 if article else 0, outside + own, heading, listed]))
            text, linked = [], []

    unclosed: set[str] = set()  # skipped elements of which no end tag is left
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            piece = page[at : m.start()]
            text.append(piece)
            if in_link:
                linked.append(piece)
        at = m.end()
        if m["skip"] and not m[0].endswith("/>"):
            name = m["skip"].lower()
            end = None if name in unclosed else _ENDS[name].search(page, at)
            if end:
                at = end.end()
            elif name in _RAW:
                at = len(page)
            else:
                unclosed.add(name)
        tag = m["tag"]
        if tag is None:
            if m["skip"]:
                text.append(" ")
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if m["close"] else 1
            elif tag == "br":
                text.append(" ")
            continue
        flush()
        if _HEADING.match(tag):
            heading = 0 if m["close"] else 1
        elif tag == "p":
            heading = 0
        own = 0
        if not m["close"] and tag not in CONTAINERS and m["attrs"]:
            own = _kind(tag, m["attrs"], article > 0, names=names)[1]
        if tag in CONTAINERS:
            heading = in_link = 0
            if not m["close"]:
                if tag == "li" and stack and stack[-1][0] == "li":
                    _, a, o = stack.pop()
                    opened[tag] -= 1
                    article, outside = article - a, outside - o
                if not m["attrs"].endswith("/"):
                    a, o = _kind(tag, m["attrs"], article > 0, opened["article"] > 0, names)
                    stack.append((tag, a, o))
                    opened[tag] += 1
                    article, outside = article + a, outside + o
            elif opened[tag]:
                while True:
                    name, a, o = stack.pop()
                    opened[name] -= 1
                    article, outside = article - a, outside - o
                    if name == tag:
                        break
    if at < len(page):
        text.append(page[at:])
        if in_link:
            linked.append(page[at:])
    flush()
    return found


def features(found: list[tuple[str, list[float]]]) -> list[list[float]]:
    """Each block's features in the order of FEATURES, with those of its neighbours."""
    none = [0, 0.0]
    own = [x for _, x in found]
    return [
        [*x[:2], *(own[i - 1][:2] if i else none), *(own[i + 1][:2] if i + 1 < len(own) else none), *x[2:]]
        for i, x in enumerate(own)
    ]


def train(spark: SparkSession, labelled: str = LABELLED, depth: int = 6) -> tuple:
    """Train the tree on the labelled table; returns nested (feature, threshold, low, high)
    or a class, which tasks can evaluate without the model."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.linalg import Vectors

    rows = [[float(x) for x in line.split()] for line in labelled.strip().splitlines()]
    data = spark.createDataFrame([(Vectors.dense(r[:-1]), r[-1]) for r in rows], ["features", "label"]).coalesce(1)
    model = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=1, seed=1).fit(data)

    def read(node) -> tuple:
        if node.getClass().getSimpleName() == "LeafNode":
            return (int(node.prediction()),)
        s = node.split()
        return (s.featureIndex(), s.threshold(), read(node.leftChild()), read(node.rightChild()))

    return read(model._call_java("rootNode"))


def decide(tree: tuple, x: list[float]) -> int:
    while len(tree) > 1:
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def main_text(page: str | None, tree: tuple) -> str:
    """Kept blocks. If names of containers condemned all of a page that has blocks as long as
    those of articles, without links, the neighbours' words and links decide without the names."""
    for names in (True, False):
        found = blocks(page or "", names)
        kept = [b for (b, _), x in zip(found, features(found), strict=True) if decide(tree, x)]
        if kept or not any(x[0] >= LONG_BLOCK and x[1] < 0.3 for _, x in found):
            break
    return "\n".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", tree: tuple | None = None) -> DataFrame:
    """Per page: id, url, text and n_chars (code points)."""
    tree = tree or train(pages.sparkSession)
    used = pages.select(id_col, url_col, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # few texts at a time
                part = batch.slice(at, 256)
                texts = [main_text(p, tree) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=[id_col, url_col, "text", "n_chars"],
                )

    kinds = dict(used.dtypes)
    return used.mapInArrow(tidy(run), f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars bigint")
