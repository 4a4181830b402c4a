"""Main text of web pages by a tree-structured graphical model over the elements of a page.

1. ``parse`` makes a tree of block elements; each run of text between block tags is a leaf. Inline elements are part of their run.
2. Every node has a hidden label: none of its text is main text, all is, or (an element) both kinds are below it. Potentials of a node are what its tag, class words, length, links and punctuation say;
   potentials of an edge say how labels of parent and child go together, by the kind of both.
3. ``infer`` passes sum-product messages from the leaves to the root and back, so each node's marginal takes in the whole page. All pages of
   a batch step together, one level of depth at a time. Leaves of at least an even chance, in page order, are the text.
4. ``train`` counts features and edges by label over labelled pages, in partial sums per task: on a tree whose labels are known the
   likelihood has its maximum at these relative frequencies.

Labelled pages are (html, content) rows, content being the main text as this operator writes it. ``labelled_pages`` gets them from pages
that mark one article element: the content is the text of that element. The sample holds at most ``pages`` pages of at most
``LONGEST`` characters, those with the least hash. As such pages show one way of writing pages only, ``train`` lays the text of each out
anew in ``LAYOUTS`` ways (``compose``), with semantic elements or named containers, and menus, notices, adverts, forms, side
columns and comments around and inside the article.

Rows: null html is empty, and so is the text of a page without main text. Every row has a result, rows that repeat an id included. White
space is what Unicode calls so. Scripts, styles, form fields and other raw text never count; an unclosed tag or raw element ends the page,
as in HTML. Very long pages are parsed whole. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskmill.llm import kernels as K

LABELLED, LONGEST, LAYOUTS, INVENTED = 300, 100_000, 4, 48
BATCH = 4 << 20  # characters of pages that step together

#: HTML elements that stand as blocks, that have no end tag, and whose content is not text of the page.
BLOCKS = "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe select svg math object audio video canvas".split())
#: Words of classes and ids by what they tell.
NAMES = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toc skip",
    "head": "header masthead topbar logo branding",
    "foot": "footer copyright colophon legal",
    "side": "sidebar aside rail widget widgets related recommended trending popular more",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription paywall banner",
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted",
    "form": "form search login signup register contact",
    "talk": "comment comments reply replies disqus discussion respond thread",
    "share": "share sharing social follow",
    "main": "article content post entry story main body text prose",
}
_GROUP = {w: g for g, words in NAMES.items() for w in words.split()}
_SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_OPEN = re.compile(r"""<([a-zA-Z][^\s/>]*)((?:=\s*+(?:"[^"]*+"|'[^']*+')|[^>])*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_END_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}
_SIBLING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}

_BUCKETS = {"share": 5, "words": 6, "runlinks": 3, "stop": 2, "sign": 2}
FEATURES = {name: i for i, name in enumerate([*(f"tag={t}" for t in BLOCKS), *(f"name={g}" for g in NAMES), "name=other", "name=none", *(f"{k}={i}" for k, n in _BUCKETS.items() for i in range(n))])}
EDGES = 6  # parent is html or body, or another; child is a container, a plain block, or text
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote dt dd td th caption figcaption legend summary hr".split())
#: Plain blocks of a page and their texts resemble each other, so they are not so many independent signs: they count in part.
PART = 0.3
STATES = 3  # no main text, main text only, both
SIZE = STATES * len(FEATURES) + STATES * STATES * EDGES + STATES
#: Each group of features that a node has one of.
_ONE_OF = [[i for f, i in FEATURES.items() if f.startswith(p)] for p in ("tag=", *(f"{k}=" for k in _BUCKETS))]


class Page:
    """Nodes in page order, parents first. ``text`` is None for elements."""

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.tag: list[str] = []
        self.names: list[set[str]] = []
        self.text: list[str | None] = []
        self.linked: list[int] = []
        self.run: list[tuple[str, bool]] = []
        self.stack: list[int] = []
        self._push("html", set())

    def _add(self, tag: str, names: set[str], text: str | None, linked: int) -> int:
        up = self.stack[-1] if self.stack else -1
        self.parent.append(up)
        self.depth.append(self.depth[up] + 1 if up >= 0 else 0)
        self.tag.append(tag)
        self.names.append(names)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.tag) - 1

    def _push(self, tag: str, names: set[str]) -> None:
        self.stack.append(self._add(tag, names, None, 0))

    def flush(self) -> None:
        if self.run:
            text = " ".join("".join(x for x, _ in self.run).split())
            if text:
                self._add(self.tag[self.stack[-1]], set(), text, sum(len(x) for x, a in self.run if a))
            self.run.clear()

    def open(self, tag: str, names: set[str]) -> None:
        self.flush()
        if len(self.stack) > 1 and self.tag[self.stack[-1]] == "p":
            self.stack.pop()
        for _ in range(2):  # a row ends its cell, too
            if len(self.stack) > 1 and self.tag[self.stack[-1]] in _SIBLING.get(tag, ()):
                self.stack.pop()
        self._push(tag, names)
        if tag in VOID:
            self.stack.pop()

    def close(self, at: int) -> None:
        """Close the element at place ``at`` of the stack, and those inside it."""
        self.flush()
        del self.stack[at:]


def _names(attributes: str) -> set[str]:
    out: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() not in ("class", "id", "role"):
            continue
        words = [w.lower() for w in _SPLIT.findall(m[2] or m[3] or m[4] or "")]
        out |= {_GROUP[w] for w in words if w in _GROUP} or ({"other"} if words else set())
    return out


def parse(source: str) -> Page:
    page = Page()
    at, size, link = 0, len(source), False
    known = frozenset(BLOCKS)
    open_: dict[str, list[int]] = {}  # places of open elements in the stack, by tag
    while at < size:
        lt = source.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            page.run.append((entities.unescape(source[at:lt]), link))
        if lt == size:
            break
        after = source[lt + 1 : lt + 2]
        if after.isascii() and after.isalpha():
            m = _OPEN.match(source, lt)
            if not m:
                break
            tag, at = m[1].lower(), m.end()
            if tag in RAW:
                end = None if m[2].endswith("/") and tag in ("svg", "math") else _END_RAW[tag].search(source, at)
                if end is None and not m[2].endswith("/"):
                    break
                at = end.end() if end else at
            elif tag in known:
                page.open(tag, _names(m[2]) if m[2] else set())
                if tag not in VOID:
                    open_.setdefault(tag, []).append(len(page.stack) - 1)
            elif tag == "a":
                link = True
            elif tag == "br":
                page.run.append((" ", link))
        elif after == "/":
            gt = source.find(">", lt)
            if gt < 0:
                break
            tag, at = source[lt + 2 : gt].split(None, 1)[0].rstrip("/").lower() if source[lt + 2 : gt].strip() else "", gt + 1
            if tag == "a":
                link = False
            places = open_.get(tag, [])
            while places and not (places[-1] < len(page.stack) and page.tag[page.stack[places[-1]]] == tag):
                places.pop()  # it was closed with another
            if places and places[-1] > 0:
                page.close(places.pop())
        elif source.startswith("<!--", lt):
            end = source.find("-->", lt + 4)
            if end < 0:
                break
            at = end + 3
        elif after in ("!", "?"):
            gt = source.find(">", lt)
            if gt < 0:
                break
            at = gt + 1
        else:
            page.run.append(("<", link))
            at = lt + 1
    page.flush()
    return page


class Forest:
    """The pages of a batch as one set of arrays: ``features`` holds (node, feature) pairs, ``edge`` the kind of the edge to the parent."""

    def __init__(self, pages: list[Page]) -> None:
        size = np.array([len(p.tag) for p in pages], np.int64)
        self.first = np.cumsum(size) - size
        self.page = np.repeat(np.arange(len(pages)), size)
        flat = lambda f, kind=np.int64: np.array([x for p in pages for x in f(p)], kind)
        parent = flat(lambda p: p.parent)
        self.root = parent < 0
        self.parent = np.where(self.root, np.arange(len(parent)), parent + self.first[self.page])
        self.depth = flat(lambda p: p.depth)
        texts = [x for p in pages for x in p.text]
        self.is_text = np.array([x is not None for x in texts], bool)
        chars = np.array([len(x) if x else 0 for x in texts], np.int64)
        linked = np.minimum(flat(lambda p: p.linked), chars)
        order = np.argsort(self.depth, kind="stable")
        edges = np.searchsorted(self.depth[order], np.arange(self.depth.max(initial=-1) + 2))
        self.levels = [order[a:b] for a, b in zip(edges, edges[1:])]
        total = chars.copy()
        for level in self.levels[:0:-1]:
            np.add.at(total, self.parent[level], total[level])
        self.chars, self.total = chars, total
        tags = [t for p in pages for t in p.tag]
        names = [x for p in pages for x in p.names]
        wide = np.array([t in ("html", "body") for t in tags], bool)
        plain = np.array([t in PLAIN for t in tags], bool)
        self.edge = np.where(wide[self.parent], 0, 3) + np.where(self.is_text, 2, plain)
        node, feature = [], []

        def give(which: np.ndarray, name: str, bucket: np.ndarray) -> None:
            node.append(which)
            feature.append(FEATURES[f"{name}=0"] + bucket)

        text, element = np.flatnonzero(self.is_text), np.flatnonzero(~self.is_text)
        node.append(element)
        feature.append(np.array([FEATURES[f"tag={tags[i]}"] for i in element], np.int64))
        many = [sorted(names[i]) or ["none"] for i in element]
        node.append(np.repeat(element, [len(x) for x in many]).astype(np.int64))
        feature.append(np.array([FEATURES[f"name={g}"] for x in many for g in x], np.int64))
        whole = total[self.first[self.page[element]]]
        give(element, "share", np.digitize(total[element] / np.maximum(whole, 1), [1e-9, 0.03, 0.15, 0.5]))
        give(text, "words", np.digitize([texts[i].count(" ") + 1 for i in text], [2, 4, 8, 16, 40]))
        give(text, "runlinks", np.digitize(linked[text] / np.maximum(chars[text], 1), [1e-9, 0.5]))
        give(text, "stop", np.array([texts[i][-1] in ".!?…:;\"”»)。" for i in text], np.int64))
        give(text, "sign", np.array([any(c in texts[i] for c in "©|·•»›→") for i in text], np.int64))
        self.node, self.feature = np.concatenate(node), np.concatenate(feature)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def infer(forest: Forest, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Each node's chance to be main text and nothing else, by messages up and down the trees."""
    of_feature, of_edge, of_root = model
    n = len(forest.parent)
    below = np.stack([np.bincount(forest.node, of_feature[forest.feature, y], n) for y in range(STATES)], axis=1)
    below[forest.root] += of_root
    up = np.zeros((n, STATES))
    for level in forest.levels[:0:-1]:
        up[level] = _log_sum(of_edge[forest.edge[level]] + below[level][:, None, :], 2)
        np.add.at(below, forest.parent[level], up[level])
    belief = below
    for level in forest.levels[1:]:
        others = belief[forest.parent[level]] - up[level]
        belief[level] += _log_sum(of_edge[forest.edge[level]] + others[:, :, None], 1)
    chance = np.exp(belief - belief.max(axis=1, keepdims=True))
    return chance[:, 1] / chance.sum(axis=1)


def labels(forest: Forest, pages: list[Page], contents: list[set[str]]) -> np.ndarray:
    """The label of each node: a text is main if it is in the page's content; an empty element is like its parent, below a mixed one 0."""
    main = np.array([x in c if x is not None else False for p, c in zip(pages, contents) for x in p.text], bool)
    good = np.where(main, forest.chars, 0)
    for level in forest.levels[:0:-1]:
        np.add.at(good, forest.parent[level], good[level])
    out = np.where(good == 0, 0, np.where(good == forest.total, 1, 2))
    for level in forest.levels[1:]:
        empty = level[forest.total[level] == 0]
        out[empty] = out[forest.parent[empty]] % 2
    return out


def tally(pages: list[Page], contents: list[set[str]]) -> np.ndarray:
    """Counts of (feature, label), (edge, labels of parent and child) and the root's label."""
    forest = Forest(pages)
    y = labels(forest, pages, contents)
    inner = np.flatnonzero(~forest.root)
    f = np.bincount(STATES * forest.feature + y[forest.node], minlength=STATES * len(FEATURES))
    e = np.bincount((forest.edge[inner] * STATES + y[forest.parent[inner]]) * STATES + y[inner], minlength=STATES * STATES * EDGES)
    return np.concatenate((f, e, np.bincount(y[forest.root], minlength=STATES)))


def potentials(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logarithms of smoothed relative frequencies; what never occurred between parent and child is all but ruled out."""
    f, e = counts[: STATES * len(FEATURES)].reshape(-1, STATES) + 0.5, counts[STATES * len(FEATURES) : -STATES].reshape(EDGES, STATES, STATES) + 0.01
    elements = f[_ONE_OF[0]].sum(axis=0)
    for group in _ONE_OF:
        f[group] /= f[group].sum(axis=0)
    f[[i for k, i in FEATURES.items() if k.startswith("name=")]] /= elements  # an element may have several
    r = counts[-STATES:] + 1.0
    weight = np.array([PART if k.split("=")[0] in _BUCKETS or k.split("=")[1] in PLAIN else 1.0 for k in FEATURES])
    return np.log(f) * weight[:, None], np.log(e / e.sum(axis=2, keepdims=True)), np.log(r / r.sum())


# ---- labelled pages -------------------------------------------------------------------------------------------------


def article_text(source: str) -> list[str]:
    """Texts below the page's article element, or none if it has not exactly one."""
    page = parse(source)
    if page.tag.count("article") - sum(1 for t, x in zip(page.tag, page.text) if t == "article" and x is not None) != 1:
        return []
    inside = [False] * len(page.tag)
    out = []
    for i, up in enumerate(page.parent):
        inside[i] = up >= 0 and (inside[up] or (page.tag[i] == "article" and page.text[i] is None))
        if inside[i] and page.text[i] is not None:
            out.append(page.text[i])
    return out


def compose(rng: np.random.Generator, blocks: list[str], plain: bool) -> tuple[str, set[str]]:
    """A page with ``blocks`` as its article, laid out at random, and its content; one page in four keeps a few words only. ``plain``:
    containers have names instead of tags."""
    if rng.random() < 0.25:
        blocks = [" ".join(x.split()[: int(rng.integers(1, 5))]) for x in blocks[: int(rng.integers(1, 4))]]
    words = " ".join(blocks).split() or ["x"]
    made = 0

    def some(least: int, most: int, stop: str = "") -> str:
        nonlocal made
        made += 1
        n = int(rng.integers(least, most + 1))
        at = int(rng.integers(0, len(words)))
        return " ".join(words[(at + 7 * i + made) % len(words)] for i in range(n)) + stop

    def quote(x: str) -> str:
        return entities.escape(x, quote=False)

    def box(group: str, tag: str, inner: str) -> str:
        name = str(rng.choice(NAMES[group].split()))
        extra = str(rng.choice(["", "-wrap", "_box", " block", "-1"]))
        key = "id" if rng.random() < 0.3 else "class"
        if plain or tag in ("div", "section") or rng.random() < 0.3:
            own = "div" if plain or rng.random() < 0.5 else tag
            return f'<{own} {key}="{name}{extra}">{inner}</{own}>'
        return f"<{tag}>{inner}</{tag}>"

    def links(n: int) -> str:
        items = [f'<a href="/{i}">{quote(some(1, 3))}</a>' for i in range(n)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if rng.random() < 0.7 else " | ".join(items)

    def notes(n: int, least: int, most: int) -> str:
        return "".join(f"<p>{quote(some(least, most, '.'))}</p>" for _ in range(n))

    def remark() -> str:
        tag = "div" if plain else str(rng.choice(["div", "li", "article"]))
        return f'<{tag} class="{rng.choice(["comment", "reply", "item"])}"><p>{quote(some(1, 2))}</p>{notes(1, 5, 60)}</{tag}>'

    extras = {
        "ad": lambda: box("ad", "div", rng.choice([quote(some(3, 25, ".")), notes(1, 5, 25)])),
        "share": lambda: box("share", "div", links(3)),
        "side": lambda: box("side", "aside", f"<h3>{quote(some(1, 3))}</h3>" + rng.choice([links(5), notes(2, 8, 30)])),
        "form": lambda: box("form", "form", f"<p>{quote(some(3, 12, '.'))}</p><label>{quote(some(1, 2))}</label><input name='q'><button>{quote(some(1, 2))}</button>"),
        "notice": lambda: box("notice", "section", rng.choice([quote(some(8, 30, ".")), f"<p>{quote(some(8, 30, '.'))}</p><button>{quote(some(1, 1))}</button>"])),
        "talk": lambda: box("talk", "section", f"<h2>{quote(some(1, 2))}</h2>" + "".join(remark() for _ in range(int(rng.integers(1, 5))))),
    }

    def maybe(chance: float, *kinds: str) -> str:
        return "".join(extras[k]() for k in kinds if rng.random() < chance)

    title, rest = blocks[0], blocks[1:]
    parts = [f"<h1>{quote(title)}</h1>"]
    for k, x in enumerate(rest):
        shape = rng.random()
        parts.append(f"<h2>{quote(x)}</h2>" if shape < 0.1 and len(x) < 100 else f"<blockquote>{quote(x)}</blockquote>" if shape < 0.13 else f"<ul><li>{quote(x)}</li></ul>" if shape < 0.18 else f"<p>{quote(x)}</p>")
        if k and rng.random() < 0.04:
            parts.append(maybe(0.5, "ad", "side", "share"))
    main = "".join(parts) + maybe(0.15, "share", "form", "talk")
    if plain:
        main = f'<div class="{rng.choice(NAMES["main"].split())}{rng.choice(["", "-body", "_text"])}">{main}</div>' if rng.random() < 0.8 else main
    else:
        main = str(rng.choice([f"<article>{main}</article>", f"<main>{main}</main>", f"<main><article>{main}</article></main>", f'<section class="{rng.choice(NAMES["main"].split())}">{main}</section>']))
    top = maybe(0.4, "notice") + box("head", "header", f"<p>{quote(some(1, 4))}</p>" + (links(4) if rng.random() < 0.3 else "")) + box("nav", "nav", links(int(rng.integers(3, 9)))) + maybe(0.4, "ad", "form")
    tail = maybe(0.4, "side", "talk", "ad", "form") + box("foot", "footer", rng.choice([f"&copy; {quote(some(2, 8, '.'))}", notes(1, 3, 15), links(4)])) + maybe(0.2, "notice")
    middle = f'<div class="{rng.choice(["wrap", "container", "row", "page"])}">{main}{maybe(0.4, "side")}</div>' if rng.random() < 0.4 else main
    return f"<html><head><title>{quote(title)}</title></head><body>{top}{middle}{tail}</body></html>", set(blocks)


def _invented(k: int) -> list[str]:
    """An article of made-up words, for tables whose pages carry no labels."""
    rng = np.random.default_rng(k)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, int(rng.integers(1, 9))))
    return [" ".join(word() for _ in range(int(rng.integers(1, 80)))) + "." * int(k % 4 > 0) for _ in range(int(rng.integers(2, 12)))]


def labelled_pages(pages: DataFrame, most: int = LABELLED, html_col: str = "html") -> DataFrame:
    """(html, content) of at most ``most`` pages that mark their article, the ones with the least hash."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(x, "\n".join(article_text(x))) for x in batch.column(0).to_pylist()]
            rows = [r for r in rows if r[1]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["html", "content"])

    h = F.col(html_col).cast("string").alias("html")
    marked = pages.select(h).filter((F.length("html") <= LONGEST) & F.col("html").rlike(r"(?i)<article[\s>]"))
    return marked.orderBy(F.xxhash64("html"), "html").limit(most).repartition(8).mapInArrow(own, "html string, content string")


def train(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Potentials from (html, content) rows, from their text in other layouts, and from a few made-up pages."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE, np.int64)
        for batch in batches:
            for source, content in zip(batch.column("html").to_pylist(), batch.column("content").to_pylist()):
                blocks = content.split("\n")
                made = [(source, set(blocks))]
                rng = np.random.default_rng(zlib.crc32(source.encode()))
                made += [compose(rng, blocks, bool(k % 2)) for k in range(LAYOUTS)]
                total += tally([parse(x) for x, _ in made], [c for _, c in made])
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["at", "n"])

    counts = np.zeros(SIZE, np.int64)
    for r in labelled.select("html", "content").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # SIZE numbers
        counts[r["at"]] = r["n"]
    made = [compose(np.random.default_rng(k), _invented(k), bool(k % 2)) for k in range(INVENTED)]
    return potentials(counts + tally([parse(x) for x, _ in made], [c for _, c in made]))


def main_texts(sources: list[str], model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[str]:
    pages = [parse(x) for x in sources]
    if not pages:
        return []
    forest = Forest(pages)
    keep = (infer(forest, model) >= 0.5) & forest.is_text
    out: list[list[str]] = [[] for _ in pages]
    for i in np.flatnonzero(keep):
        k = forest.page[i]
        out[k].append(pages[k].text[i - forest.first[k]])
    return ["\n".join(x) for x in out]


def extract(pages: DataFrame, labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page. ``labelled``: (html, content) rows to learn from; by default pages that mark their article."""
    model = train(labelled_pages(pages, html_col=html_col) if labelled is None else labelled)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, size = 0, 0
            sources = [x or "" for x in batch.column("html").to_pylist()]
            for hi, x in enumerate(sources, 1):
                size += len(x)
                if size >= BATCH or hi == len(sources):
                    texts = main_texts(sources[lo:hi], model)
                    yield pa.RecordBatch.from_arrays([batch.column("page_id").slice(lo, hi - lo), batch.column("url").slice(lo, hi - lo), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
                    lo, size = hi, 0
        K.release()

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(read, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
