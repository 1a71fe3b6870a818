"""A small, forgiving HTML parser: elements, text, implied end tags, and hashes of element subtrees."""

from __future__ import annotations

import re
from html import unescape

import xxhash

#: Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes plaintext".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 "
    "h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main "
    "menu nav ol p pre search section summary table ul li dd dt".split()
)
_SCOPE = frozenset("html body table td th caption template object marquee applet button".split())
#: What a start tag ends, and where the search for it stops.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th"}, {"tbody", "thead", "tfoot", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Node:
    __slots__ = ("attributes", "hash", "items", "parent", "raw", "size", "tag")

    def __init__(self, tag: str, raw: str, parent: Node | None):
        self.tag, self.raw, self.parent = tag, raw, parent
        self.items: list[str | Node] = []
        self.attributes: dict[str, str] | None = None
        self.hash = self.size = 0

    def get(self, name: str) -> str:
        if self.attributes is None:
            self.attributes = {}
            for m in _ATTRIBUTE.finditer(self.raw) if self.raw else ():
                self.attributes.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
        return self.attributes.get(name, "")

    def has(self, name: str) -> bool:
        self.get(name)
        return name in self.attributes

    def nodes(self):
        """This element and all within it, in page order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(x for x in reversed(node.items) if isinstance(x, Node))


def parse(html: str) -> Node:
    """The tree of a page under a nameless root. Any text gives a tree; nothing is dropped but markup and comments."""
    root = Node("", "", None)
    stack, at, n = [root], 0, len(html)
    search = _TOKEN.search
    while at < n:
        m = search(html, at)
        if m is None:
            stack[-1].items.append(html[at:])
            break
        if m.start() > at:
            stack[-1].items.append(html[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            if m[0].startswith("<![CDATA["):
                stack[-1].items.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag, closing, raw = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            _close(stack, tag)
            continue
        if tag in ("html", "body"):  # a second one adds nothing
            if any(x.tag == tag for x in stack):
                continue
        if tag in CLOSES_P:
            _end(stack, {"p"}, _SCOPE)
        if tag in _ENDS:
            _end(stack, *_ENDS[tag])
        node = Node(tag, raw, stack[-1])
        stack[-1].items.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            node.items.append(html[at : end.start() if end else n])
            at = end.end() if end else n
            continue
        stack.append(node)
    return root


def _end(stack: list[Node], tags: set[str], stop) -> None:
    """Ends the innermost open element of these tags, unless one that stops the search is open above it."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            del stack[i:]
            if len(tags) > 1:
                _end(stack, tags, stop)
            return
        if stack[i].tag in stop:
            return


def _close(stack: list[Node], tag: str) -> None:
    block = tag in BLOCK or tag in _SCOPE
    for i in range(len(stack) - 1, 0, -1):
        own = stack[i].tag
        if own == tag:
            if tag not in ("html", "body"):  # what follows still belongs to the page
                del stack[i:]
            return
        if own in _SCOPE and tag not in ("html", "body", "table", "tr", "tbody", "thead", "tfoot"):
            return
        if not block and own in BLOCK:  # an inline end tag doesn't end blocks
            return


def hash_subtrees(root: Node) -> None:
    """Sets hash (of tag, class, id and everything within, white space aside) and size (of the text) of each element."""
    order = list(root.nodes())
    for node in reversed(order):
        h = xxhash.xxh64(f"{node.tag}\0{node.get('class')}\0{node.get('id')}\0".encode(errors="replace"))
        size = 0
        for x in node.items:
            if isinstance(x, Node):
                h.update(x.hash.to_bytes(8, "little"))
                size += x.size
            elif words := " ".join(x.split()):
                h.update(b"\1" + words.encode(errors="replace"))
                size += len(words)
        node.hash, node.size = h.intdigest(), size
