"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

Every block element gets features of its subtree (text density, link density, marks, controls), of its attribute tokens and those
above it, of its depth and of its siblings. Boosted trees give the probability that its subtree holds main text. The labelling of a page
is the most likely one in which nothing below a rejected node is kept, found bottom-up; so no descendant contradicts its ancestor.

There are no labelled pages, so training pages are made: of a bounded sample of pages the text below `article`, `main` (or else of the
parent with most paragraph text) is taken as main text; it is set again into generated layouts with menus, banners, sidebars, notices, adverts,
comments and forms filled with other pages' sentences, where the label of each node is known. The sample is the only thing collected: of the
`SAMPLE_PAGES` pages with the smallest hash of their id, whole pages in that order, each that still fits into `SAMPLE_CHARS` characters. If no
page fits or none has text, layouts are filled with `STAND_IN`; there is always a model. Extraction is row-local.

Null and empty pages have an empty text. Repeated rows are answered one by one. Nothing of the kept text is cut."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dom import Page

SAMPLE_PAGES = 160
SAMPLE_CHARS = 9_600_000
LAYOUTS = 3
#: Sentences for layouts where the sample has none.
STAND_IN = ["The first rain of the year came late in the evening.", "Most of them had never seen the river so high, and they said so.", "A short note.",
            "It took two days, four boats and a good deal of patience to bring the cattle over to the other side of the valley.", "Nobody was hurt.",
            "Since then the bridge has been built again, wider than before, with stones from the old quarry and money from the town."]

KINDS = [("p",), ("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"), ("ul", "ol", "dl", "menu"), ("li", "dt", "dd"), ("table", "tbody", "tr"), ("td", "th"), ("div",),
         ("section",), ("article",), ("main",), ("nav",), ("header",), ("footer",), ("aside",), ("form", "fieldset"), ("html", "body", "#page"),
         ("blockquote", "pre", "figure", "figcaption")]
_KIND = {tag: k for k, tags in enumerate(KINDS) for tag in tags}
ABOVE = ("article", "main", "nav", "header", "footer", "aside", "form")
#: Attribute tokens by what they tell.
TOKENS = {
    "menu": "nav navbar navigation menu menus breadcrumb breadcrumbs crumbs pagination pager tabs toc toolbar skip topbar links",
    "head": "header masthead banner branding logo sitename tagline hero top",
    "foot": "footer foot bottom copyright legal colophon imprint",
    "side": "sidebar side aside rail widget widgets related recommended more trending popular archive tags tagcloud",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay dialog banner message privacy warning",
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion adsense doubleclick teaser",
    "comment": "comment comments reply replies respond disqus discussion reader readers feedback review reviews responses commentlist",
    "form": "form search login signup subscribe subscription newsletter register contact captcha poll field input",
    "share": "share sharing social follow facebook twitter like likes meta byline author print email",
    "content": "article articlebody content post story entry main body text maincontent page single blog news prose",
}
_TOKEN = {t: k for k, group in enumerate(TOKENS.values()) for t in group.split()}
_SPLIT = re.compile(r"[a-z]+|[A-Z][a-z]*")
FEATURES = 20 + len(KINDS) + 2 * len(TOKENS) + len(ABOVE)


@lru_cache(maxsize=10_000)
def _groups(value: str) -> int:
    """Bits of the groups that the tokens of an attribute value belong to."""
    bits = 0
    for token in _SPLIT.findall(value):
        k = _TOKEN.get(token.lower())
        if k is not None:
            bits |= 1 << k
    return bits


@dataclass
class Forest:
    """The nodes of several pages one after the other: features, parents (-1 for a page), depths and the first node of each page."""

    x: np.ndarray
    parents: np.ndarray
    depths: np.ndarray
    first: np.ndarray

    def levels(self) -> list[np.ndarray]:
        """Nodes of depth 1, 2, ..."""
        order = np.argsort(self.depths, kind="stable")
        return np.split(order, np.searchsorted(self.depths[order], np.arange(1, self.depths.max() + 1)))[1:]


def features(pages: list[Page], lengths: list[int]) -> Forest:
    """Features of every node of the pages (at least one), worked out level by level of their trees."""
    first = np.cumsum([0] + [len(p.tags) for p in pages])
    n = int(first[-1])
    which = np.repeat(np.arange(len(pages)), np.diff(first))
    line = lambda name: np.array([v for p in pages for v in getattr(p, name)])
    parents = line("parents")
    parents = np.where(parents < 0, -1, parents + first[which])
    depths, order, below = line("depths"), line("orders"), line("children")
    total = np.zeros((n, 10))
    runs = [(f + node, len(t), linked, t.count(".") + t.count(","), t.count(" ") + 1, 1) for f, p in zip(first, pages) for node, t, linked in p.runs]
    if runs:
        table = np.array(runs)
        for k in range(5):
            total[:, k] = np.bincount(table[:, 0], weights=table[:, k + 1], minlength=n)
    own = total[:, 0].copy()
    tags = [t for p in pages for t in p.tags]
    kind = np.array([_KIND.get(t, 6) for t in tags])
    total[:, 5:] = np.stack([line("inline"), line("controls"), np.ones(n), kind == 0, kind == 3], 1)
    groups, above = np.zeros((n, len(TOKENS)), bool), np.zeros((n, len(ABOVE)), bool)
    attributes = [a for p in pages for a in p.attributes]
    for i, values in enumerate(attributes):
        if values:
            bits = 0
            for name in ("class", "id", "role", "itemprop", "aria-label"):
                if name in values:
                    bits |= _groups(values[name])
            groups[i] = bits >> np.arange(len(TOKENS)) & 1
    for k, tag in enumerate(ABOVE):
        above[:, k] = [t == tag for t in tags]
    inherited = groups.copy()
    forest = Forest(np.zeros((n, FEATURES)), parents, depths, first)
    levels = forest.levels()
    for level in levels:
        inherited[level] |= inherited[parents[level]]
        above[level] |= above[parents[level]]
    for level in reversed(levels):
        np.add.at(total, parents[level], total[level])
    text, up = total[:, 0], np.maximum(parents, 0)
    before, after = np.zeros(n), np.zeros(n)
    siblings = np.lexsort((order, parents))
    left, right = siblings[:-1], siblings[1:]
    same = (parents[left] == parents[right]) & (parents[left] >= 0)
    before[right[same]], after[left[same]] = text[left[same]], text[right[same]]
    safe = np.maximum(1, text)
    forest.x[:, :20] = np.stack(
        [np.log1p(own), np.log1p(text), total[:, 1] / safe, total[:, 2] / safe * 100, np.log1p(total[:, 3] / np.maximum(1, total[:, 4])),
         np.log1p(text / (total[:, 5] + total[:, 7])), np.log1p(total[:, 5]), np.log1p(total[:, 6]), total[:, 6] / np.maximum(1, total[:, 3]), np.log1p(total[:, 8]),
         np.log1p(total[:, 9]), total[:, 9] / total[:, 7], depths, order / np.maximum(1, below[up]), np.log1p(below[up]), text / np.maximum(1, text[up]),
         np.log1p(before), np.log1p(after), text / np.maximum(1, text[first[which]]), line("starts") / np.maximum(1, np.array(lengths))[which]], 1)
    forest.x[np.arange(n), 20 + kind] = 1
    at = 20 + len(KINDS)
    forest.x[:, at:at + len(TOKENS)], forest.x[:, at + len(TOKENS):at + 2 * len(TOKENS)], forest.x[:, at + 2 * len(TOKENS):] = groups, inherited, above
    return forest


@dataclass
class Boosted:
    """Regression trees as flat arrays: inner nodes have a feature and a threshold, leaves a value."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    weights: np.ndarray
    depth: int

    @classmethod
    def of(cls, model) -> Boosted:
        rows: list[list[float]] = []

        def add(node) -> int:
            at = len(rows)
            rows.append([0, 0.0, at, at, float(node.prediction())])
            if node.subtreeDepth() > 0:
                split = node.split()
                rows[at][0], rows[at][1] = int(split.featureIndex()), float(split.threshold())
                rows[at][2] = add(node.leftChild())
                rows[at][3] = add(node.rightChild())
            return at

        roots = [add(tree._java_obj.rootNode()) for tree in model.trees]
        columns = list(zip(*rows))
        return cls(np.array(columns[0], int), np.array(columns[1]), np.array(columns[2], int), np.array(columns[3], int), np.array(columns[4]), np.array(roots),
                   np.array(model.treeWeights), max(t.depth for t in model.trees))

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(x))
        for root, weight in zip(self.roots, self.weights):
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[np.arange(len(x)), self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            margin += weight * self.value[at]
        return 1 / (1 + np.exp(-2 * margin))


def decode(probability: np.ndarray, forest: Forest) -> np.ndarray:
    """The most likely labelling in which every kept node has a kept parent. The root is kept: a page without markup is its text."""
    p = np.clip(probability, 1e-6, 1 - 1e-6)
    keep, reject = np.log(p), np.log(1 - p)
    levels, parents = forest.levels(), forest.parents
    for level in reversed(levels):
        np.add.at(keep, parents[level], np.maximum(keep[level], reject[level]))
        np.add.at(reject, parents[level], reject[level])
    kept = np.ones(len(p), bool)
    for level in levels:
        kept[level] = kept[parents[level]] & (keep[level] >= reject[level])
    return kept


def main_text(sources: list[str | None], model: Boosted) -> list[str]:
    """The main text of every page."""
    pages = [Page(s or "") for s in sources]
    if not pages:
        return []
    forest = features(pages, [len(s or "") for s in sources])
    kept = decode(model.probability(forest.x), forest)
    return ["\n".join(text for node, text, _ in page.runs if kept[first + node]) for first, page in zip(forest.first, pages)]


# -- training pages ---------------------------------------------------------------------------------------------------------------------------------

def _weak(page: Page) -> set[int]:
    """Nodes that hold main text by the page's own markup: below article or main, or else below the parent of most paragraph text."""
    root = next((i for i, t in enumerate(page.tags) if t in ("article", "main") or page.attributes[i].get("role") == "main"), None)
    if root is None:
        weight: dict[int, int] = {}
        for node, text, _ in page.runs:
            weight[page.parents[node]] = weight.get(page.parents[node], 0) + len(text) * (page.tags[node] == "p")
        root = max(weight, key=weight.get, default=None)
    inside = set()
    for i in range(len(page.tags)):
        if root is not None and (i == root or page.parents[i] in inside):
            inside.add(i)
    return inside


def _escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;")


def layout(blocks: list[tuple[str, str]], spare: list[str], rng: np.random.Generator) -> str:
    """A page around `blocks` (tag, text); what belongs to the main text stands in elements marked data-m."""
    pick = lambda *options: options[rng.integers(len(options))]
    some = lambda low, high: _escape(" ".join(" ".join(spare[rng.integers(len(spare))] for _ in range(3)).split()[:int(rng.integers(low, high))]))
    links = lambda n: "".join(f'<li><a href="/x">{some(1, 4)}</a></li>' for _ in range(int(rng.integers(2, n))))
    paragraphs = lambda n, high: "".join(f"<p>{some(4, high)}</p>" for _ in range(int(rng.integers(1, n + 1))))

    def box(tags: tuple[str, ...], names: str, body: str) -> str:
        tag, name = pick(*tags), pick(*names.split(), "")
        attribute = pick(f' class="{name}"', f' id="{name}"', f' class="{name} {pick("left", "wide", "inner", "box")}"') if name else ""
        return f"<{tag}{attribute}>{body}</{tag}>"

    menu = lambda: pick(f"<nav><ul>{links(9)}</ul></nav>", f'<div class="{pick("menu", "navbar", "nav", "breadcrumbs")}"><ul>{links(9)}</ul></div>', f"<nav>{links(6)}</nav>")
    banner = lambda: pick(f"<header><p>{some(2, 9)}</p>{menu()}</header>", f'<div class="{pick("header", "site-header", "masthead", "banner")}"><a href="/">{some(1, 3)}</a><p>{some(3, 14)}</p></div>',
                          f'<header class="site-header"><h2>{some(1, 4)}</h2><p>{some(3, 25)}</p></header>')
    advert = lambda: box(("div", "section", "aside"), "ad ads advert advertisement sponsored promo ad-slot", pick(some(3, 40), paragraphs(2, 30)))
    side = lambda: pick(f"<aside><h3>{some(1, 4)}</h3>{paragraphs(3, 60)}<ul>{links(7)}</ul></aside>",
                        f'<div class="{pick("sidebar", "side-bar", "widget", "rail", "related")}"><h3>{some(1, 4)}</h3>{pick(paragraphs(3, 60), f"<ul>{links(8)}</ul>")}</div>', f"<aside>{paragraphs(2, 80)}</aside>")
    notice = lambda: (f'<div {pick("class", "id")}="{pick("cookie-banner", "cookie-notice", "consent", "notice", "gdpr-popup", "alert")}">'  # noqa: E731
                      f'{pick(some(4, 40), paragraphs(2, 40))}{pick("", "<button>OK</button>")}</div>')
    comment = lambda: f'<{(t := pick("div", "li", "article", "p"))} class="{pick("comment", "comment-body", "reply", "comment")}">{some(4, 80) if t == "p" else paragraphs(3, 80)}</{t}>'
    comments = lambda: (f'<{(t := pick("section", "div", "ol"))} {pick("class", "id")}="{pick("comments", "comment-list", "comments-area", "reader-comments", "disqus_thread")}">'  # noqa: E731
                        f'{pick("", f"<h3>{some(1, 4)}</h3>")}{"".join(comment() for _ in range(int(rng.integers(1, 6))))}</{t}>')
    form = lambda: (f'<form class="{pick("search", "newsletter", "login", "contact", "")}"><p>{some(2, 25)}</p><label>{some(1, 3)}</label><input name="q">'  # noqa: E731
                    f'{pick("<button>Go</button>", "<input type=submit>", "<textarea></textarea>")}</form>')
    foot = lambda: pick(f"<footer><p>{some(2, 30)}</p></footer>", f"<footer>&copy; {some(2, 12)}</footer>",
                        f'<div {pick("class", "id")}="{pick("footer", "site-footer", "copyright")}">{pick(some(2, 20), paragraphs(2, 30))}</div>', f"<footer>{menu()}{paragraphs(1, 40)}</footer>")
    share = lambda: f'<div class="{pick("share", "social", "share-buttons")}"><ul>{links(5)}</ul></div>'

    body = []
    if blocks and rng.random() < 0.35:  # an article under a short heading
        blocks = [(pick("h1", "h1", "h2"), " ".join(spare[rng.integers(len(spare))].split()[:int(rng.integers(1, 5))])), *blocks[blocks[0][0] in ("h1", "h2"):]]
    for k, (tag, text) in enumerate(blocks):
        body.append(f"<{tag}>{_escape(text)}</{tag}>")
        if rng.random() < 0.1:  # a very short paragraph in bold type that nothing closes
            body.append(f"<p><b>{_escape(text[:int(rng.integers(1, 12))])}<br>")
        if k and rng.random() < 0.06:
            body.append("</x>" + pick(advert, share, notice, side, form)() + "<x>")
    if rng.random() < 0.25:
        body = [f"<header>{body[0]}</header>", *body[1:]]
    if rng.random() < 0.3:
        body.append("</x>" + pick(comments, share, form, side)() + "<x>")
    tag = pick("article", "article", "main", "div", "div", "section", "td")
    name = pick("content", "post", "entry-content", "article-body", "main", "story", "text", "", "", "", "c12")
    inner = "".join(body).replace("</x>", "").replace("<x>", "")
    core = f'<{tag}{pick(" class=", " id=") + chr(34) + name + chr(34) if name else ""} data-m="1">{inner}</{tag}>'
    if tag == "td":
        core = f"<table><tr><td>{links(6)}</td>{core}</tr></table>"
    head = [banner() if rng.random() < 0.6 else "", menu() if rng.random() < 0.7 else "", notice() if rng.random() < 0.3 else "", advert() if rng.random() < 0.5 else ""]
    tail = [comments() if rng.random() < 0.5 else "", side() if rng.random() < 0.5 else "", form() if rng.random() < 0.3 else "", advert() if rng.random() < 0.3 else "",
            notice() if rng.random() < 0.2 else ""]
    rng.shuffle(tail)
    if rng.random() < 0.3:
        head.append(side())
    middle = "".join([*head, core, *tail])
    if rng.random() < 0.5:
        middle = f'<div class="{pick("wrapper", "container", "page", "row")}">{middle}</div>'
    return f"<html><body>{middle}{foot()}</body></html>"


_BOILERPLATE = ("menu", "head", "foot", "side", "notice", "advert", "comment", "form", "share")


def _marked(page: Page) -> set[int]:
    """Main nodes of a generated page: below data-m, but for the boxes that the layout put between them."""
    groups = list(TOKENS)
    inside: set[int] = set()
    for i, tag in enumerate(page.tags):
        if page.attributes[i].get("data-m"):
            inside.add(i)
        elif page.parents[i] in inside:
            tokens = {groups[_TOKEN[t.lower()]] for name in ("class", "id") for t in _SPLIT.findall(page.attributes[i].get(name, "")) if t.lower() in _TOKEN}
            if not (tokens & set(_BOILERPLATE) or tag in ("nav", "aside", "form", "footer")):
                inside.add(i)
    return inside


def _labels(page: Page, inside: set[int]) -> np.ndarray:
    y = np.zeros(len(page.tags))
    for node, _, _ in page.runs:
        while node >= 0 and node not in inside:
            node = -1
        while node >= 0:
            y[node] = 1
            node = page.parents[node]
    return y


def training_rows(sources: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the nodes of the sample pages and of the layouts made from them (of `STAND_IN` if no page has text)."""
    rng = np.random.default_rng(11)
    pages = [(s, page) for s in sources if (page := Page(s)).runs]
    spare = [t for _, p in pages for _, t, _ in p.runs] or STAND_IN
    made = [(source, page, _weak(page)) for source, page in pages]
    contents = [[("p" if page.tags[node] not in ("h1", "h2", "h3", "h4", "blockquote", "pre") else page.tags[node], text)
                 for node, text, _ in page.runs if node in main] for source, page, main in made]
    if not any(contents):
        some = lambda high: " ".join(STAND_IN[k] for k in rng.integers(0, len(STAND_IN), int(rng.integers(1, high))))
        contents = [[("h1", some(3)), *(("p", some(int(rng.choice([2, 4, 40])))) for _ in range(int(rng.integers(1, 14))))] for _ in range(SAMPLE_PAGES)]
    for blocks in contents:
        for _ in range(LAYOUTS if blocks else 0):
            first = int(rng.integers(0, max(1, len(blocks) // 2))) if rng.random() < 0.3 else 0
            own = blocks[first:first + int(rng.integers(1, 14))]
            source = layout(own, spare, rng)
            made.append((source, fresh := Page(source), _marked(fresh)))
    return np.concatenate([features([p], [len(s)]).x for s, p, _ in made]), np.concatenate([_labels(p, m) for _, p, m in made])


def sample_pages(pages: DataFrame, limit: int = SAMPLE_PAGES, chars: int = SAMPLE_CHARS) -> list[str]:
    """Whole pages in the order of their id's hash: of the first `limit` each that still fits into `chars` characters. Only those reach the driver."""
    hashed = pages.select(F.xxhash64("page_id").alias("place"), F.length("html").alias("n"), "html").filter("n > 0")
    chosen, room = [], chars
    for r in sorted(set(map(tuple, hashed.select("place", "n").orderBy("place", "n").limit(limit).collect()))):
        if r[1] <= room:
            chosen.append(r)
            room -= r[1]
    if not chosen:
        return []
    wanted = pages.sparkSession.createDataFrame(chosen, "place long, n int")  # at most `limit` rows
    rows = hashed.join(F.broadcast(wanted), ["place", "n"]).groupBy("place", "n").agg(F.min("html").alias("html"))
    return [r["html"] for r in sorted(rows.collect())]


def fit(pages: DataFrame, limit: int = SAMPLE_PAGES, chars: int = SAMPLE_CHARS) -> Boosted:
    """Boosted trees from the sample and the layouts made from it."""
    x, y = training_rows(sample_pages(pages, limit, chars))
    table = pa.table({"label": y, "x": pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, FEATURES), pa.int32()), pa.array(x.ravel()))})
    rows = pages.sparkSession.createDataFrame(table).select("label", array_to_vector("x").alias("features")).coalesce(1).persist()
    model = Boosted.of(GBTClassifier(maxIter=16, maxDepth=5, stepSize=0.3, maxBins=32, seed=5, minInstancesPerNode=8).fit(rows))
    rows.unpersist()
    return model


def extract(pages: DataFrame, model: Boosted) -> DataFrame:
    """page_id, url, text, n_chars for every row of `pages`."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = main_text(part["html"].to_pylist(), trees)
                yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                                 names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def main_texts(pages: DataFrame) -> DataFrame:
    return extract(pages, fit(pages))
