"""HTML as a tree of block elements and the runs of text in them: a small tolerant reader.

Only block elements are nodes. Inline elements leave no trace but for links, whose characters are counted. Scripts, styles, titles,
form controls, frames, comments and declarations give no text. Missing end tags of paragraphs, items, cells and rows are
implied; end tags that close nothing are passed over; what is open at the end is closed there.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

#: Elements of HTML that start a block of their own.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose inside is no text of the page, up to their end tag.
OPAQUE = frozenset("script style title textarea noscript iframe noframes noembed xmp template svg math select button object video audio canvas datalist head".split())
EMPTY = frozenset("hr area base br col embed img input link meta param source track wbr".split())
#: What a start tag closes, and what it doesn't look beyond.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "caption"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
}
CELLS = {"td", "th", "table", "caption"}
TABLE = CELLS | {"tr", "tbody", "thead", "tfoot"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

_TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^=>]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S
)
_NAMED = re.compile(r"(?:^|[\s\"'/])(class|id|role|itemprop|hidden|style|aria-hidden)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Page:
    """Nodes in page order, node 0 being the whole page. A run of text is a node, too: its tag is "" and its text is set."""

    parents: list[int] = field(default_factory=lambda: [-1])
    tags: list[str] = field(default_factory=lambda: ["html"])
    names: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    texts: list[str] = field(default_factory=lambda: [""])
    linked: list[int] = field(default_factory=lambda: [0])

    def add(self, parent: int, tag: str, names: tuple[str, ...] = (), text: str = "", linked: int = 0) -> int:
        self.parents.append(parent)
        self.tags.append(tag)
        self.names.append(names)
        self.texts.append(text)
        self.linked.append(linked)
        return len(self.tags) - 1


def attribute_words(rest: str) -> tuple[str, ...]:
    """The words of an element's class, id, role and itemprop, and "-hidden" if it isn't shown."""
    found: list[str] = []
    for m in _NAMED.finditer(rest):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            found.append("-hidden")
        elif name in ("class", "id", "role", "itemprop"):
            found += [w.lower() for w in _WORDS.findall(value)]
    return tuple(dict.fromkeys(found))


def read(html: str) -> Page:
    page = Page()
    stack, opened = [0], {"html": 1}
    pieces: list[str] = []
    linked, in_link = 0, False
    at, size = 0, len(html)

    def flush():
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                page.add(stack[-1], "", text=text, linked=min(linked, len(text)))
        linked = 0

    def pop_to(depth: int):
        while len(stack) > depth:
            opened[page.tags[stack.pop()]] -= 1

    def say(raw: str):
        nonlocal linked
        text = unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if in_link:
            linked += len(text.strip())

    while at < size:
        m = _TAG.search(html, at)
        if m is None:
            say(html[at:])
            break
        if m.start() > at:
            say(html[at : m.start()])
        at = m.end()
        if not m["name"]:
            continue
        tag, end = m["name"].lower(), bool(m["end"])
        if tag in OPAQUE and not end:
            if m["rest"].endswith("/") and tag in ("svg", "math"):
                continue
            until = re.compile(rf"<body\b|</{tag}(?=[\s/>])[^>]*>?" if tag == "head" else rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = size if until is None else until.start() if until[0][1] != "/" else until.end()
            pieces.append(" ")
        elif tag not in BLOCKS:
            if tag == "a":
                in_link = not end
            elif tag == "br" or tag == "img":
                pieces.append(" ")
        elif end:
            same = HEADINGS if tag in HEADINGS else {tag}
            if tag in ("html", "body") or not any(opened.get(t) for t in same):
                continue
            depth = len(stack) - 1
            while depth and page.tags[stack[depth]] not in same and (tag in TABLE or page.tags[stack[depth]] not in CELLS):
                depth -= 1
            if depth and page.tags[stack[depth]] in same:
                flush()
                in_link = False
                pop_to(depth)
        else:
            if tag == "html" or (tag == "body" and opened.get("body")):
                continue
            flush()
            in_link = False
            if page.tags[stack[-1]] == "p" or (tag in HEADINGS and page.tags[stack[-1]] in HEADINGS):
                pop_to(len(stack) - 1)
            closes, limit = CLOSES.get(tag, ((), ()))
            if any(opened.get(c) for c in closes):
                depth = len(stack) - 1
                while depth and page.tags[stack[depth]] not in closes and page.tags[stack[depth]] not in limit:
                    depth -= 1
                if depth and page.tags[stack[depth]] in closes:
                    pop_to(depth)
            if tag not in EMPTY:
                stack.append(page.add(stack[-1], tag, attribute_words(m["rest"]) if m["rest"] else ()))
                opened[tag] = opened.get(tag, 0) + 1
    flush()
    return page
