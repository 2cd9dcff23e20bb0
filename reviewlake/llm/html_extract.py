"""Main text of raw pages by wrapper induction: pages of one host are aligned, what is constant is template.

A page is a tree of block elements; like neighbours are folded into one repeated node. Trees of a host are
laid over each other by simple tree matching (the best order-keeping match of children, level by level)
and give the host's wrapper: every node with the number of pages it is on and a bounded summary of its
texts. Nodes whose text is the same on most pages are template, the others are slots of content. A
wrapper is a mergeable summary: tasks make one per host, these are merged in two rounds, so that a host
with a third of all pages is spread over all tasks and nothing grows with its pages.

What markup itself names (navigation, footers, forms, adverts, comments, ...) is no content even where it
varies. The article or main element holds the text; a host without one gets the deepest node of its
wrapper that holds most varying text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.sources.folders import stored

from .common import map_arrow, map_partition
from .page_tree import Block, Element, Page

SHARE, PAGES = 0.5, 3  # a text on more than this share of a host's pages, and on so many, is template
MAIN_SHARE, MAIN_PAGES = 0.9, 10  # inside an article: copies of one article may be a third of a host
LOOSE = 10  # a count may miss a tenth of the pages
HOLDS = 0.7  # share of the varying text that the content node holds
_NODES = 20_000  # wrapper nodes a task gathers before it passes them on
_MOST = 2_000  # nodes of a wrapper beyond which rare ones go
_BUCKETS = 32


class Fold:
    """Neighbouring elements of one label, their own texts and their folded children."""

    __slots__ = ("label", "elements", "kids")

    def __init__(self, label: str, elements: list[Element]):
        self.label, self.elements = label, elements
        self.kids: list[Fold] = []
        for element in elements:
            self.kids = _lay(self.kids, _runs(element.kids))

    def signature(self) -> str:
        return self.label + ("(" + ",".join(k.signature() for k in self.kids) + ")" if self.kids else "")


# Elements that follow each other in running text in any number and order.
_FLOW = frozenset("address blockquote caption dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr li ol p pre table tbody td th thead tr ul".split())
_SIBLINGS = 64  # more unnamed containers than this under one parent are one repeated node


def _runs(elements: list[Element]) -> list[Fold]:
    """Children folded: running text by label, in the order of labels; neighbours of one class; unnamed containers stay apart."""
    out: list[Fold] = []
    run: dict[str, list[Element]] = {}
    crowded = sum("." not in e.label for e in elements) > _SIBLINGS

    def close() -> None:
        out.extend(Fold(label, run[label]) for label in sorted(run))
        run.clear()

    named: list[Element] = []
    for element in [*elements, None]:
        if named and (element is None or element.label != named[-1].label):
            out.append(Fold(named[0].label, named))
            named = []
        if element is None or element.label.split(".")[0] in _FLOW or not element.kids and "." not in element.label:
            if element is not None:
                run.setdefault(element.label, []).append(element)
            continue
        close()
        if "." in element.label or crowded:
            named.append(element)
        else:
            out.append(Fold(element.label, [element]))
    close()
    return out


def _lay(left: list[Fold], right: list[Fold]) -> list[Fold]:
    """Both sequences of folds over each other, matched ones joined."""
    if not left:
        return right
    out, a, b = [], 0, 0
    for i, j in [*match(left, right), (len(left), len(right))]:
        out += left[a:i] + right[b:j]
        if i < len(left):
            left[i].elements = left[i].elements + right[j].elements
            left[i].kids = _lay(left[i].kids, right[j].kids)
            out.append(left[i])
        a, b = i + 1, j + 1
    return out


def match(left: list, right: list) -> list[tuple[int, int]]:
    """Simple tree matching of two sequences of children: the order-keeping pairs of most matched nodes."""
    labels = [x.label for x in left]
    if labels == [x.label for x in right] and len(set(labels)) == len(labels):
        return [(i, i) for i in range(len(labels))]
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    weight = {}
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            if x.label == y.label:
                weight[i, j] = _size(x, y)
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + weight.get((i, j), 0))
    out, i, j = [], len(left), len(right)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def _size(x, y) -> int:
    """Nodes that two trees of equal label have in common."""
    return 1 + sum(_size(x.kids[i], y.kids[j]) for i, j in match(x.kids, y.kids))


class Node:
    """A wrapper's node: pages, texts seen (bounded), text outside links, and children in order."""

    __slots__ = ("label", "pages", "mass", "error", "texts", "chars", "kids", "constant", "content")

    def __init__(self, label: str):
        self.label, self.pages, self.mass, self.error, self.chars = label, 0, 0, 0, 0
        self.texts: dict[int, list[int]] = {}  # hash -> [pages, length outside links]
        self.kids: list[Node] = []
        self.constant: frozenset[int] = frozenset()
        self.content = False

    def add_texts(self, texts: dict[int, int]) -> None:
        for key, length in texts.items():
            held = self.texts.setdefault(key, [0, length])
            held[0] += 1
            self.chars += length
        self.mass += len(texts)
        self.trim()

    def trim(self) -> None:
        """Misra-Gries: with LOOSE counters per text of a page, no count misses more than a LOOSE-th of the pages."""
        room = max(64, 2 * LOOSE * self.mass // max(1, self.pages))
        if len(self.texts) > 2 * room:
            fall = sorted((n for n, _ in self.texts.values()), reverse=True)[room]
            self.error += fall
            self.texts = {k: [n - fall, size] for k, (n, size) in self.texts.items() if n > fall}

    def join(self, other: Node) -> None:
        self.pages += other.pages
        self.mass += other.mass
        self.error += other.error
        self.chars += other.chars
        for key, (n, size) in other.texts.items():
            held = self.texts.setdefault(key, [0, size])
            held[0] += n
        self.trim()
        out, a, b = [], 0, 0
        for i, j in [*match(self.kids, other.kids), (len(self.kids), len(other.kids))]:
            out += self.kids[a:i] + other.kids[b:j]
            if i < len(self.kids):
                self.kids[i].join(other.kids[j])
                out.append(self.kids[i])
            a, b = i + 1, j + 1
        self.kids = out

    def take(self, fold: Fold) -> list[Node]:
        """Lay a page's tree over the wrapper, add what is new, and give the wrapper's nodes in the tree's order."""
        found = {j: self.kids[i] for i, j in match(self.kids, fold.kids)}
        for j, kid in enumerate(fold.kids):
            if j not in found:
                found[j] = Node(kid.label)
                before = self.kids.index(found[j - 1]) + 1 if j else 0
                self.kids.insert(before, found[j])
        return [self, *(n for j, kid in enumerate(fold.kids) for n in found[j].take(kid))]

    def find(self, fold: Fold) -> list[Node | None]:
        """The wrapper's node of each of a page's nodes, None where it has none."""
        found = {j: self.kids[i] for i, j in match(self.kids, fold.kids)}
        return [self, *(n for j, kid in enumerate(fold.kids) for n in (found[j].find(kid) if j in found else _nothing(kid)))]

    def count(self) -> int:
        return 1 + sum(k.count() for k in self.kids)

    def prune(self) -> Node:
        """Keep a wrapper that grew beyond _MOST nodes to those on a fiftieth of its pages: no rarer node is template."""
        if self.count() > _MOST:
            stack = [self]
            while stack:
                node = stack.pop()
                node.kids = [k for k in node.kids if 50 * k.pages >= self.pages]
                stack += node.kids
        return self

    def dump(self) -> list:
        return [self.label, self.pages, self.mass, self.error, self.chars, [[k, *v] for k, v in sorted(self.texts.items())], [k.dump() for k in self.kids]]


def load(data: list) -> Node:
    node = Node(data[0])
    _, node.pages, node.mass, node.error, node.chars, held, kids = data
    node.texts = {k: [n, size] for k, n, size in held}
    node.kids = [load(k) for k in kids]
    return node


def _nothing(fold: Fold) -> list[None]:
    return [None, *(n for k in fold.kids for n in _nothing(k))]


def _preorder(fold: Fold) -> list[Fold]:
    return [fold, *(f for k in fold.kids for f in _preorder(k))]


def key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1  # fits a signed number


def _own_texts(page: Page, tree: list[Fold]) -> list[dict[int, int]]:
    """For each node of a page's tree its distinct texts and their lengths outside links."""
    for i, fold in enumerate(tree):
        for element in fold.elements:
            element.at = i
    out: list[dict[int, int]] = [{} for _ in tree]
    for block in page.blocks:
        if block.element.at is not None:
            out[block.element.at][key(block.text)] = max(0, len(block.text) - block.linked)
    return out


class Inducer:
    """Wrappers of the hosts of one task."""

    def __init__(self):
        self.wrappers: dict[str, Node] = {}
        self.known: dict[tuple[str, str], list[Node]] = {}

    def add(self, host: str, html: str) -> None:
        page = Page(html)
        root = Fold(page.root.label, [page.root])
        tree = _preorder(root)
        shape = host, root.signature()
        if shape not in self.known:  # pages of one shape are laid over the wrapper once
            self.known[shape] = self.wrappers.setdefault(host, Node(root.label)).take(root)
        for node, texts in zip(self.known[shape], _own_texts(page, tree)):
            node.pages += 1
            node.add_texts(texts)

    def full(self) -> bool:
        return len(self.known) > 2000 or sum(len(n) for n in self.known.values()) > _NODES


def rule(wrapper: Node) -> list:
    """What extraction needs of a wrapper: labels, constant texts, and which node holds the content."""

    def varying(node: Node) -> int:
        constant = sum(n * size for n, size in node.texts.values() if n + node.error > SHARE * wrapper.pages and n >= PAGES)
        return max(0, node.chars - constant) + sum(varying(k) for k in node.kids)

    total, content = varying(wrapper), wrapper
    while total and (kid := next((k for k in content.kids if varying(k) >= HOLDS * total), None)):
        content = kid

    def shape(node: Node, inside: bool) -> list:
        inside = inside or node.label.split(".")[0] in ("article", "main")
        share, least = (MAIN_SHARE, MAIN_PAGES) if inside else (SHARE, PAGES)
        same = sorted(k for k, (n, _) in node.texts.items() if n > share * wrapper.pages and n >= least)
        return [node.label, int(node is content), same, [shape(k, inside) for k in node.kids]]

    return shape(wrapper, False)


def _rule_node(data: list) -> Node:
    node = Node(data[0])
    node.content, node.constant = bool(data[1]), frozenset(data[2])
    node.kids = [_rule_node(k) for k in data[3]]
    return node


class Rule:
    """A host's wrapper as extraction uses it; where pages of one shape lie in it is found once."""

    def __init__(self, data: str):
        self.root = _rule_node(json.loads(data))
        self.known: dict[str, list[Node | None]] = {}

    def find(self, fold: Fold) -> list[Node | None]:
        shape = fold.signature()
        if shape not in self.known:
            if len(self.known) > 500:
                self.known.clear()
            self.known[shape] = self.root.find(fold)
        return self.known[shape]


def main_blocks(html: str, wrapper: Rule | None) -> list[str]:
    """Texts of a page's main blocks in order."""
    page = Page(html)
    constant: dict[int, frozenset[int]] = {}
    marked = None
    if wrapper:
        root = Fold(page.root.label, [page.root])
        tree = _preorder(root)
        for i, (fold, node) in enumerate(zip(tree, wrapper.find(root))):
            if node:
                constant[i] = node.constant
                if node.content and marked is None:
                    marked = i
            for element in fold.elements:
                element.at = i
    total = sum(len(b.text) for b in page.blocks)

    def inside(element: Element | None, test) -> bool:
        while element:
            if test(element):
                return True
            element = element.parent
        return False

    for block in page.blocks:
        at = block.element
        while at:
            at.chars += len(block.text)
            at = at.parent
    around = lambda e: e.around(total)
    left = [b for b in page.blocks if not inside(b.element, around)]
    left = [b for b in left if b.element.at is None or key(b.text) not in constant.get(b.element.at, ())]
    mains = [m for m in page.mains if not inside(m, around)]
    articles = [m for m in mains if m.label.split(".")[0] == "article" and not inside(m.parent, lambda e: e.tag == "article")] or \
               [m for m in mains if not inside(m.parent, lambda e: e in mains)]
    if articles:
        chosen = _chosen(articles, left)
        return [b.text for b in left if inside(b.element, lambda e: e is chosen)]
    return [b.text for b in _without_main(left, marked, inside)]


def _chosen(articles: list[Element], blocks: list[Block]) -> Element:
    """The article that alone holds the page's first heading, else the one with most text outside links."""
    if len(articles) == 1:
        return articles[0]
    sizes, titled = {id(a): 0 for a in articles}, set()
    for block in blocks:
        at, heading = block.element, False
        while at:
            heading = heading or at.tag == "h1"
            if id(at) in sizes:
                sizes[id(at)] += len(block.text) - block.linked
                titled |= {id(at)} if heading else set()
            at = at.parent
    if len(titled) == 1:
        return next(a for a in articles if id(a) in titled)
    return max(articles, key=lambda a: sizes[id(a)])


def _without_main(blocks: list[Block], marked: int | None, inside) -> list[Block]:
    """No element is named as the article: the wrapper's content node, else the deepest element with most text."""
    blocks = [b for b in blocks if 2 * b.linked <= len(b.text)]
    weight: dict[int, int] = {}
    elements: dict[int, Element] = {}
    for block in blocks:
        at = block.element
        while at:
            weight[id(at)] = weight.get(id(at), 0) + len(block.text)
            elements[id(at)] = at
            at = at.parent
    if marked is not None and any(inside(b.element, lambda e: e.at == marked) for b in blocks):
        held = [b for b in blocks if inside(b.element, lambda e: e.at == marked)]
    else:
        total = sum(len(b.text) for b in blocks)
        deepest = max((e for i, e in elements.items() if weight[i] >= HOLDS * total), key=lambda e: e.depth, default=None)
        held = [b for b in blocks if inside(b.element, lambda e: e is deepest)] if deepest else []
    chosen = {id(b) for b in held}
    title = next((b for b in blocks if b.element.tag == "h1" and id(b) not in chosen), None)
    return [title, *held] if title and held and not any(b.element.tag == "h1" for b in held) else held


# The host of an absolute address, in lower case.
def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/:?#]*)", 1))


def _text_of(column: pa.Array) -> list[str]:
    return [(x or b"").decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def _merged(parts: DataFrame, by: list[str], last: bool) -> DataFrame:
    """Wrappers of the same key joined one after the other; in the last round they become rules."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
        current, wrapper = None, None

        def out() -> dict[str, object]:
            return {"host": [current[0]], "bucket": [0], "wrapper": [json.dumps(rule(wrapper) if last else wrapper.prune().dump())]}

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in by]
            for group, data in zip(zip(*columns), batch.column("wrapper").to_pylist()):
                if group != current:
                    if wrapper:
                        yield out()
                    current, wrapper = group, load(json.loads(data))
                else:
                    wrapper.join(load(json.loads(data)))
                    wrapper.prune()
        if wrapper:
            yield out()

    return map_partition(parts.repartition(*by).sortWithinPartitions(*by, "wrapper"), run, "host string, bucket int, wrapper string")


def induce(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper): one rule per host, from all its pages. Pages without a host give none."""
    base = pages.select(host_of(F.col(f"`{url_col}`").cast("string")).alias("host"), F.col(f"`{html_col}`").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
        bucket, found = TaskContext.get().partitionId() % _BUCKETS, Inducer()

        def rows() -> dict[str, object]:
            hosts = sorted(found.wrappers)
            return {"host": hosts, "bucket": [bucket] * len(hosts), "wrapper": [json.dumps(found.wrappers[h].prune().dump()) for h in hosts]}

        for batch in batches:
            for host, html in zip(batch.column("host").to_pylist(), _text_of(batch.column("html"))):
                found.add(host, html)
                if found.full():
                    yield rows()
                    found = Inducer()
        yield rows()

    parts = map_partition(base.where("host <> '' and html <> ''"), run, "host string, bucket int, wrapper string")
    return _merged(_merged(parts, ["host", "bucket"], False), ["host"], True).select("host", "wrapper")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page: its main blocks, joined by an empty line.

    A null or empty page, and one without main text, has the empty text. A page without a host is read by
    its own markup. Null ids and addresses stay, repeated rows are pages each, an empty table gives no
    rows, other columns are not read. Nothing of a block is cut, however long the page is.
    """
    rules = stored(induce(pages, url_col, html_col), "wrappers").select(F.col("host").alias("site"), "wrapper")
    base = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                        F.col(f"`{html_col}`").cast("string").alias("html"))
    joined = base.join(rules, host_of(base["url"]) == rules["site"], "left").select("page_id", "url", "html", "wrapper")
    known: dict[str | None, Rule | None] = {}

    def step(batch: pa.RecordBatch) -> dict[str, object]:
        found = []
        for html, data in zip(_text_of(batch.column("html")), batch.column("wrapper").to_pylist()):
            if len(known) > 200:
                known.clear()
            if data not in known:
                known[data] = Rule(data) if data else None
            found.append("\n\n".join(main_blocks(html, known[data])).encode("utf-8", "surrogatepass").decode("utf-8", "replace"))
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": found, "n_chars": [len(x) for x in found]}

    return map_arrow(joined, step, "page_id bigint, url string, text string, n_chars bigint")
