"""A forgiving HTML reader: a light tree of elements and text, and the blocks of its text."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable

#: Text and a whole tag whose quotes are plain, which most are: nothing is tried twice.
_PLAIN = re.compile(r"([^<]*+)<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\"[^\"<>]*+\"|='[^'<>]*+'|=(?![\s\"']))*+)>")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)[^>\"']*")
_SPECIAL = re.compile(r"[>\"']")
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: A new element of these kinds ends an open one of the set, unless one of the stops is between.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_P_STOPS = {"table", "td", "th", "object", "button", "caption", "template"}


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)} if "=" in raw or raw.strip(" /") else {}


def _tag_end(text: str, at: int) -> int:
    """Where a tag ends whose attributes are read up to ``at``: at the next > outside of quotes.  A quote that never
    closes, or closes in another tag's attribute only, is closed by the next >.  -1: the end of the text cuts it off."""
    while True:
        m = _SPECIAL.search(text, at)
        if m is None:
            return -1
        at = m.start()
        if text[at] == ">":
            return at
        if text[:at].endswith("=") if at < 64 else text[at - 64 : at].rstrip().endswith("="):
            close, end = text.find(text[at], at + 1), text.find(">", at + 1)
            if end < 0:
                return -1
            if close < 0 or close > end and not (text[close + 1 : close + 2].isspace() or text[close + 1 : close + 2] in ("", "/", ">") or text.find("<", end, close) < 0):
                return end
            at = close
        at += 1


class _Open:
    """The elements that are open, how many of each tag, and whether a p among them can be closed."""

    def __init__(self, root: Node):
        self.stack, self.tags = [root], Counter()
        self.in_p = [False]

    def push(self, node: Node) -> None:
        self.stack.append(node)
        self.tags[node.tag] += 1
        self.in_p.append(node.tag == "p" or (self.in_p[-1] and node.tag not in _P_STOPS))

    def close(self, names: set[str], stops: set[str]) -> None:
        if not any(self.tags[n] for n in names):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in names:
                for node in self.stack[k:]:
                    self.tags[node.tag] -= 1
                del self.stack[k:], self.in_p[k:]
                return
            if self.stack[k].tag in stops:
                return


def parse(text: str) -> Node:
    """The tree of a page, in one pass; unclosed, misplaced and cut-off tags never fail, at any depth."""
    root = Node("#root", {})
    opened, at, last = _Open(root), 0, text.rfind(">")
    stack = opened.stack
    while at < len(text):
        m = _PLAIN.match(text, at)
        if m is not None:
            before, shuts, name, raw = m.groups()
            if before:
                stack[-1].children.append(before)
            at = m.end()
        else:
            start = text.find("<", at)
            while 0 <= start and not (text[start + 1 : start + 2].isalpha() and text[start + 1] < "\x80" or text[start + 1 : start + 2] in ("/", "!", "?")):
                start = text.find("<", start + 1)
            if start < 0 or start > last:  # text to the end, or a tag that the end of the page cuts off
                if rest := text[at:] if start < 0 else text[at:start]:
                    stack[-1].children.append(rest)
                return root
            if start > at:
                stack[-1].children.append(text[at:start])
            if text.startswith("<!--", start):
                end = text.find("-->", start + 4)
                at = end + 3 if end >= 0 else len(text)
                continue
            m = _TAG.match(text, start)
            if m is None:  # a declaration, or no name after the slash: read as a comment
                at = text.find(">", start) + 1
                continue
            end = _tag_end(text, m.end())
            if end < 0:
                return root
            at = end + 1
            shuts, name, raw = m[1], m[2], text[m.end(2) : end]
        tag = name.lower()
        if shuts:
            if opened.tags[tag]:
                opened.close({tag}, set())
            if tag == "p" or tag == "br":
                stack[-1].children.append(Node("br", {}))
            continue
        if tag in _ENDS:
            opened.close(*_ENDS[tag])
        if opened.in_p[-1] and tag not in INLINE and tag not in ("br", "body", "html", "head"):
            opened.close({"p"}, _P_STOPS)
        node = Node(tag, _attributes(raw))
        stack[-1].children.append(node)
        if tag in RAW:
            shut = re.compile(rf"</{re.escape(tag)}\b", re.I).search(text, at)
            node.children.append(text[at : shut.start() if shut else len(text)])
            at = shut.start() if shut else len(text)
            if shut:
                close = text.find(">", at)
                at = close + 1 if close >= 0 else len(text)
        elif tag not in VOID and not raw.rstrip().endswith("/"):
            opened.push(node)
    return root


def blocks(nodes: list[Node], skip: Callable[[Node], bool]) -> list[str]:
    """Texts of the blocks under the nodes in page order: references decoded, white space squeezed, empty ones left out."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if held:
            if text := " ".join(html.unescape("".join(held)).split()):
                out.append(text)
            held.clear()

    for top in nodes:
        todo: list[Node | str | None] = [top]  # None: a block ends
        while todo:
            n = todo.pop()
            if n is None:
                flush()
            elif isinstance(n, str):
                held.append(n)
            elif n is top or not skip(n):
                if n.tag not in INLINE:
                    flush()
                    todo.append(None)
                todo += reversed(n.children)
        flush()
    return out
