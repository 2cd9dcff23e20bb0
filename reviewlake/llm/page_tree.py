"""A raw page as a tree of elements with the blocks of text they hold, read once from left to right.

Broken markup is read as browsers do in the cases that matter for text: open paragraphs, list items and
cells end where the next begins, an end tag closes what it can see, the rest is ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

# Element names of the markup language by what they do to text.
VOID = frozenset("area base br col embed hr img input keygen link meta param source track wbr".split())
RAW = frozenset("iframe math noembed noframes noscript script style svg template textarea title xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
HEAD = frozenset("base link meta noscript script style template title".split())
UNSEEN = frozenset("area aside audio button canvas datalist dialog embed footer head iframe input map math menu meter nav noembed "
                   "noframes noscript object option output param progress script search select style svg template textarea title video xmp".split())
SCOPES = frozenset("caption html object table td template th".split())
# A start tag of the first kind ends open elements of the second, up to one of the third.
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
        "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table", "tbody", "thead", "tfoot")),
        "tbody": (("tbody", "thead", "tfoot"), ("table",)), "thead": (("tbody", "thead", "tfoot"), ("table",)),
        "tfoot": (("tbody", "thead", "tfoot"), ("table",)), "option": (("option",), ("select",))}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation note search status toolbar".split())
# Words of class and id that name what stands around an article. The second kind is also used for layout.
COMMENTS = frozenset("comment comments commentlist discussion disqus reactions replies reply respond responses".split())
NAMED = frozenset("ad ads adbox adsense advert advertisement advertising adverts breadcrumb breadcrumbs consent cookie cookies footer gdpr masthead "
                  "modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted promotion sidebar "
                  "signup skyscraper sponsor sponsored sponsors subscribe subscription teaser teasers toolbar topbar tracking".split())
LOOSE = frozenset("alert aside banner disclaimer form hidden legal login menu overlay rail recommended recommendations related search share "
                  "sharing skip social widget widgets".split())
HEADERS = frozenset(["header"])
NEGATIONS = frozenset("has no with without".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}
_DEEPEST = 64  # elements deeper than this hold no level of their own

PLAIN, MAIN, WEAK, STRONG, COMMENT, HEADWORD, HEADER, GONE = range(8)


@lru_cache(20_000)
def describe(tag: str, attributes: str) -> tuple[str, int]:
    """Label for alignment (name and digit-free classes and id) and what kind of element it is."""
    found = {k.lower(): (v[1:-1] if v[:1] in "\"'" and v else v) for k, v in _ATTRIBUTE.findall(attributes)} if attributes.strip(" \n/") else {}
    names = (found.get("class", "") + " " + found.get("id", "")).split()
    label = ".".join([tag, *sorted({n.lower() for n in names if not any(c.isdigit() for c in n)})])
    words = {w.lower() for n in names for w in _WORD.findall(n)}
    role = found.get("role", "").strip().lower()
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I)
    if tag in UNSEEN or (hidden and tag not in ("html", "body")):
        return label, GONE
    if tag in ("html", "body"):
        return tag, PLAIN
    if words & NEGATIONS:
        words = set()
    if words & COMMENTS:
        return label, COMMENT
    named = STRONG if words & NAMED else WEAK if words & LOOSE else PLAIN
    if tag in ("article", "main") or role in ("main", "article") or "articlebody" in found.get("itemprop", "").lower():
        return label, MAIN if tag == "main" or not named else named
    if tag == "header" or role == "banner":
        return label, HEADER
    if role in ROLES:
        return label, STRONG
    if named:
        return label, named
    if words & HEADERS:
        return label, HEADWORD
    return label, WEAK if tag == "form" else PLAIN


class Element:
    __slots__ = ("tag", "label", "kind", "parent", "kids", "depth", "inline", "inside_main", "holds_main", "gone", "chars", "at")

    def __init__(self, tag: str, label: str, kind: int, parent: Element | None):
        self.tag, self.label, self.kind, self.parent = tag, label, kind, parent
        self.kids: list[Element] = []
        self.depth = parent.depth + 1 if parent else 0
        self.inline = tag in INLINE
        self.inside_main = bool(parent) and (parent.inside_main or parent.kind == MAIN)
        self.gone = bool(parent) and parent.gone or kind == GONE or kind == HEADER and not self.inside_main
        self.holds_main, self.chars, self.at = False, 0, None

    def around(self, total: int) -> bool:
        """Named as something around the article, and not a wrapper of it or of most of the page's text."""
        if self.holds_main or self.kind in (PLAIN, MAIN) or self.kind == HEADWORD and self.inside_main:
            return False
        return self.kind == COMMENT or (10 * self.chars <= 9 * total if self.kind == STRONG else 2 * self.chars <= total)


class Block:
    """A block's text with white space as one blank, how much of it is link text, and the element that holds it."""

    __slots__ = ("element", "text", "linked")

    def __init__(self, element: Element, text: str, linked: int):
        self.element, self.text, self.linked = element, text, linked


class Page:
    def __init__(self, html: str):
        self.root = Element("#page", "#page", PLAIN, None)
        self.blocks: list[Block] = []
        self.mains: list[Element] = []
        self._stack, self._text, self._links, self._linked = [self.root], [], 0, 0
        self._read(html)
        for main in self.mains:
            at = main.parent
            while at and not at.holds_main:
                at.holds_main = True
                at = at.parent

    # Text between two block boundaries gathers here.
    def _put(self, text: str) -> None:
        if not self._stack[-1].gone:
            self._text.append(text)
            if self._links:
                self._linked += len(text.strip())

    def _flush(self) -> None:
        if self._text:
            text = " ".join((unescape(joined) if "&" in (joined := "".join(self._text)) else joined).split())
            if text:
                holder = self._stack[-1]
                while holder.inline:
                    holder = holder.parent
                self.blocks.append(Block(holder, text, self._linked))
            self._text, self._linked = [], 0

    def _open(self, tag: str, attributes: str) -> None:
        label, kind = describe(tag, attributes)
        stack = self._stack
        if tag not in INLINE:
            self._flush()
        parent = stack[-1]
        element = Element(tag, label, kind, parent)
        if parent.depth < _DEEPEST or kind not in (PLAIN, MAIN):
            if not element.inline and not element.gone:
                holder = parent
                while holder.inline:
                    holder = holder.parent
                holder.kids.append(element)
        else:  # too deep for a level of its own; its text belongs to the one above
            element.inline = True
        if kind == MAIN and not element.gone and not element.inline:
            self.mains.append(element)
        stack.append(element)
        self._links += tag == "a"

    def _close(self, place: int) -> None:
        """Close the elements from this place of the stack on."""
        stack = self._stack
        if any(e.tag not in INLINE for e in stack[place:]):
            self._flush()
        for element in stack[place:]:
            self._links -= element.tag == "a"
        del stack[place:]

    def _start(self, tag: str, attributes: str) -> None:
        stack = self._stack
        if tag in ("html", "body", "head") and len(stack) > 1:
            if tag == "body" and any(e.tag == "head" for e in stack):
                self._close(next(i for i, e in enumerate(stack) if e.tag == "head"))
            if any(e.tag == tag for e in stack) or tag == "html":
                return
        if stack[-1].tag == "head" and tag not in HEAD:
            self._close(len(stack) - 1)
        if tag not in INLINE:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p" or stack[i].tag in HEADINGS and tag in HEADINGS:
                    self._close(i)
                    break
                if stack[i].tag in SCOPES or stack[i].tag == "button":
                    break
        if tag in ENDS:
            ended, borders = ENDS[tag]
            last = 0
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in borders:
                    break
                if stack[i].tag in ended:
                    last = i
            if last:
                self._close(last)
        if tag == "a":  # links do not nest
            for i in range(len(stack) - 1, 0, -1):
                if not stack[i].inline:
                    break
                if stack[i].tag == "a":
                    self._close(i)
                    break
        self._open(tag, attributes)
        if tag in VOID:
            self._put(" ")
            self._close(len(stack) - 1)

    def _end(self, tag: str) -> None:
        stack = self._stack
        if tag == "br":
            self._put(" ")
            return
        if tag in ("body", "html"):  # what follows still belongs to the page
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == tag:
                self._close(i)
                return
            if stack[i].tag in SCOPES and tag not in ("table", "tr", "tbody", "thead", "tfoot") or tag in INLINE and stack[i].tag not in INLINE:
                break
        if tag == "p":
            self._flush()

    def _read(self, html: str) -> None:
        at, size = 0, len(html)
        search = _TAG.search
        while at < size:
            found = search(html, at)
            if not found:
                self._put(html[at:])
                break
            if found.start() > at:
                self._put(html[at:found.start()])
            at = found.end()
            tag = found[2] or found[5]
            if not tag:
                continue
            tag = tag.lower()
            if found[1] or found[4]:
                self._end(tag)
                continue
            attributes = found[3] or found[6] or ""
            if tag in RAW:
                closing = _RAW_ENDS[tag].search(html, at)
                if tag not in INLINE and tag in ("textarea", "iframe", "noscript", "xmp"):
                    self._flush()
                at = closing.end() if closing else size
                continue
            self._start(tag, attributes)
        self._flush()
