"""A forgiving HTML walker: leaf blocks and media references in page order.

A leaf block is the text between two boundaries of block elements or media references; other inline elements don't cut
it, `br` counts as white space. Contents of script, style, title, template, svg and the like (RAW) are dropped. Missing end tags of p, li,
dt, dd, tr, td, th and option are implied; stray end tags are ignored; `<` that begins no tag is text. A script, style, title
or textarea without an end lasts to the end of the page; any other of RAW ends where its container does, or at the next
block element.

Leaves share their ancestors, each a node that knows its parent, and open elements are found by tag, so a page costs in
proportion to its length, however deep it is.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

_TOKEN = re.compile(r"""<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>|<[!?][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Elements whose contents are no text of the page.
RAW = frozenset("script style template noscript title textarea iframe svg math object select datalist audio video canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q ruby rp rt s samp small source span strike strong sub sup time tt u var wbr picture".split())
#: Those of RAW whose missing end tag is the end of the page.
_TO_END = frozenset("script style title textarea".split())
#: Elements that a start tag of the same group ends, and the elements that keep it from doing so.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SCOPE = frozenset("td th table body button caption".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass(frozen=True)
class Element:
    tag: str
    #: Words of class, id and role.
    names: tuple[str, ...] = ()
    hidden: bool = False


class Node:
    """An element with its parent. new: names of features ("t:" tag, "c:" name, "hidden") that no ancestor has; block: the
    nearest element that is no inline one, itself included; figure: the outermost figure; caption: inside a figcaption;
    dropped: contents are no text."""

    __slots__ = ("element", "parent", "new", "block", "figure", "caption", "dropped")

    def __init__(self, element: Element, parent: Node | None, new: tuple[str, ...], dropped: bool = False):
        self.element, self.parent, self.new, self.dropped = element, parent, new, dropped
        self.block = self if element.tag not in INLINE else parent and parent.block
        self.figure = parent and parent.figure or (self if element.tag == "figure" else None)
        self.caption = element.tag == "figcaption" or bool(parent and parent.caption)


@dataclass
class Leaf:
    """text: white space as one blank, references decoded; node: the innermost element; link: characters inside links; ref:
    of a media reference, whose text is its caption or alternative text."""

    text: str
    node: Node | None
    link: int = 0
    ref: str | None = None

    @property
    def path(self) -> tuple[Element, ...]:
        """Elements from the outermost."""
        out, node = [], self.node
        while node is not None:
            out.append(node.element)
            node = node.parent
        return tuple(reversed(out))


@lru_cache(maxsize=20_000)
def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


@lru_cache(maxsize=20_000)
def element(tag: str, raw: str) -> Element:
    if not raw.strip(" /"):
        return Element(tag)
    a = attributes(raw)
    names = _WORDS.findall(" ".join(a.get(k, "") for k in ("class", "id", "role")))
    hidden = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
    return Element(tag, tuple(dict.fromkeys(n.lower() for n in names)), hidden)


def _features(e: Element) -> tuple[str, ...]:
    return ("t:" + e.tag, *("c:" + n for n in e.names), *(("hidden",) if e.hidden else ()))


class _Stack:
    """Open elements; each tag's places among them, and how many of them have a feature."""

    def __init__(self) -> None:
        self.nodes: list[Node] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.having: dict[str, int] = {}
        self.dropping: list[int] = []

    @property
    def top(self) -> Node | None:
        return self.nodes[-1] if self.nodes else None

    def last(self, *tags: str) -> int:
        """Place of the innermost element of one of the tags, or -1."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)

    def push(self, e: Element, dropped: bool = False) -> None:
        own = _features(e)
        new = tuple(f for f in own if not self.having.get(f))
        for f in own:
            self.having[f] = self.having.get(f, 0) + 1
        at = len(self.nodes)
        self.places.setdefault(e.tag, []).append(at)
        if e.tag not in INLINE:
            self.blocks.append(at)
        if dropped:
            self.dropping.append(at)
        self.nodes.append(Node(e, self.top, new, dropped))

    def cut(self, k: int) -> None:
        """Ends the elements from place k on."""
        for node in reversed(self.nodes[k:]):
            e = node.element
            self.places[e.tag].pop()
            for f in _features(e):
                self.having[f] -= 1
        del self.nodes[k:]
        for marks in (self.blocks, self.dropping):
            while marks and marks[-1] >= k:
                marks.pop()


def walk(html: str) -> list[Leaf]:
    """The page's leaf blocks with text, and its media references (img, and source or src of video, audio, embed)."""
    out: list[Leaf] = []
    stack = _Stack()
    words: list[str] = []
    state = {"node": None, "link": 0}
    unclosed: set[str] = set()

    def end_block() -> None:
        if words:
            text = " ".join("".join(words).split())
            if text:
                out.append(Leaf(text, state["node"], state["link"]))
            words.clear()
        state["link"] = 0

    def text(raw: str) -> None:
        if not raw or stack.dropping:
            return
        t = unescape(raw) if "&" in raw else raw
        if not words:
            if t.isspace():
                return
            state["node"] = stack.top
        words.append(t)
        if stack.places.get("a"):
            state["link"] += len(t.strip())

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag not in INLINE:
                end_block()
            k = stack.last(tag)
            if k >= 0 and (tag not in INLINE or not stack.blocks or k > stack.blocks[-1]):
                stack.cut(k)
            continue
        raw = m[3]
        if tag in ("img", "embed", "source", "video", "audio"):
            a = attributes(raw)
            if ref := a.get("src"):
                end_block()
                out.append(Leaf(" ".join(a.get("alt", a.get("title", "")).split()), stack.top, 0, ref))
        if tag == "br":
            text("\n") if words else None
            continue
        if tag not in INLINE:
            end_block()
            if tag in _CLOSES_P:
                if stack.dropping:
                    stack.cut(stack.dropping[0])
                k = stack.last("p")
                if k > stack.last("div", "article", "section", *_SCOPE):
                    stack.cut(k)
            if tag in _ENDS:
                ends, until = _ENDS[tag]
                k = stack.last(*ends)
                if k > stack.last(*until):
                    stack.cut(k)
        if tag in VOID:
            continue
        if tag in RAW:
            if raw.endswith("/") and tag in ("svg", "math"):
                continue
            close = None if tag in unclosed else re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            if close and tag in ("audio", "video", "object"):
                for s in _TOKEN.finditer(html, at, close.start()):
                    if s[2] and s[2].lower() in ("source", "embed", "img") and (ref := attributes(s[3]).get("src")):
                        out.append(Leaf("", stack.top, 0, ref))
            if close:
                at = close.end()
            elif tag in _TO_END:
                at = n
            else:
                unclosed.add(tag)
                stack.push(element(tag, raw), dropped=True)
            continue
        if not stack.dropping:
            stack.push(element(tag, raw))
    end_block()
    return out
