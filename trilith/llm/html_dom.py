"""A small DOM for main-text extraction: elements, text pieces, features."""

from __future__ import annotations

import html
import math
import re
from collections import Counter

NAME_RE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
PLAIN_OR_QUOTED_RE = re.compile(r"[^>\"']++|\"[^\"]*+\"|'[^']*+'")
ATTRS_RE = re.compile(rf"(?:{PLAIN_OR_QUOTED_RE.pattern})*+")
ATTR_RE = re.compile(r"(?:^|\s)(class|id|role|itemprop|aria-label|data-part)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))",
                     re.I)
TOKEN_RE = re.compile(r"[a-z]+")
CAMEL_RE = re.compile(r"(?<=[a-z])(?=[A-Z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
#: Never text of an article.
SILENT = frozenset("head script style textarea title noscript template select option button svg iframe object".split())
BLOCKS = frozenset("html body main article section div header footer nav aside form fieldset p h1 h2 h3 h4 h5 h6 ul ol "
                   "li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address "
                   "details summary menu center hgroup dialog".split())
CLOSES_P = BLOCKS - frozenset("html body td th tr tbody thead tfoot caption".split()) | {"hr"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}}
FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"},
         "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

#: Beginnings of attribute tokens, by what they tell.
HINTS = {
    "main": "article content entry main post story text body prose".split(),
    "nav": "nav menu breadcrumb crumb pagination pager toc skip tabs toolbar".split(),
    "head": "header masthead topbar branding logo hero".split(),
    "foot": "footer foot copyright colophon legal imprint".split(),
    "side": "sidebar aside widget rail related recommend popular trending teaser complementary".split(),
    "ad": "ad ads advert adslot sponsor promo banner outbrain taboola doubleclick".split(),
    "notice": "notice cookie consent gdpr alert popup modal overlay paywall warning message".split(),
    "form": "form search login signup signin subscribe newsletter contact register".split(),
    "social": "share social follow like rating vote".split(),
    "comment": "comment reply respond disqus discussion feedback reader".split(),
}
EXACT = {"ad", "ads", "nav", "foot", "text", "body", "like", "form", "main", "rail", "post"}
GROUPS = [{"article", "main"}, {"nav", "menu"}, {"header"}, {"footer", "address"}, {"aside"},
          {"form", "fieldset", "dialog"}, {"p", "blockquote", "pre"}, {"h1"}, {"h2", "h3", "h4", "h5", "h6"},
          {"ul", "ol", "li", "dl", "dt", "dd"}, {"div", "section", "td", "center", "body", "html"}]


def hints(value: str) -> list[str]:
    """Kinds of hint among the tokens of an attribute value."""
    tokens = TOKEN_RE.findall(CAMEL_RE.sub(" ", value).lower())
    return [k for k, stems in HINTS.items()
            if any(t == s or s not in EXACT and t.startswith(s) for t in tokens for s in stems)]


class Node:
    __slots__ = ("tag", "parent", "children", "hints", "part", "block", "depth", "chars", "links", "words", "marks",
                 "tags", "paragraphs", "inputs", "start", "index", "silent")

    def __init__(self, tag, parent, value, part):
        self.tag, self.parent, self.part = tag, parent, part
        self.children, self.hints, self.block = [], hints(value) if value else [], tag in BLOCKS
        self.depth = parent.depth + 1 if parent else 0
        self.silent = tag in SILENT or (parent is not None and parent.silent)
        self.chars = self.links = self.words = self.marks = self.tags = self.paragraphs = self.inputs = 0
        self.start = self.index = 0


class Page:
    """Nodes in page order and the text pieces (node, text, block number)."""

    def __init__(self, source: str):
        self.nodes: list[Node] = []
        self.pieces: list[tuple[Node, str, int]] = []
        self._block, self._open, self._anchors = 0, [], 0
        self._places: dict[str, list[int]] = {}  # of the open elements, by tag; no empty lists
        self._stuck = None
        self.root = self._push("#root", "", None)
        self._parse(source)
        self._sum()

    def _push(self, tag, attrs, part):
        parent = self._open[-1][1] if self._open else None
        node = Node(tag, parent, attrs, part)
        if parent is not None:
            node.index = len(parent.children)
            parent.children.append(node)
        self.nodes.append(node)
        self._enter(tag, node)
        return node

    def _enter(self, tag, node) -> None:
        places = self._places.get(tag)
        if places is None:
            self._places[tag] = [len(self._open)]
        else:
            places.append(len(self._open))
        self._open.append((tag, node))

    def _pop_to(self, depth: int) -> None:
        while len(self._open) > depth:
            tag, _ = self._open.pop()
            places = self._places[tag]
            places.pop()
            if not places:
                del self._places[tag]
            if tag in BLOCKS:
                self._block += 1
            if tag == "a":
                self._anchors -= 1

    def _innermost(self, tags) -> int:
        at, places = 0, self._places
        if len(tags) < len(places):
            for t in tags:
                if t in places and places[t][-1] > at:
                    at = places[t][-1]
        else:
            for t, found in places.items():
                if t in tags and found[-1] > at:
                    at = found[-1]
        return at

    def _close(self, tags, fence=frozenset()) -> None:
        """Close the innermost open element of ``tags``, unless one of
        ``fence`` lies inside it."""
        at = self._innermost(tags)
        if at > 0 and at >= self._innermost(fence):
            self._pop_to(at)

    def _start(self, tag: str, attrs: str) -> None:
        if tag in CLOSES_P:
            self._close({"p"}, {"table", "button", "td", "th", "li", "div", "section", "article"} - {tag}
                        if tag != "p" else {"table", "td", "th", "li", "div", "section", "article", "blockquote"})
        if tag in SAME:
            self._close(SAME[tag], FENCE[tag])
        if tag == "a":
            self._close({"a"}, BLOCKS)
        node = self._open[-1][1]
        if tag in VOID:
            node.inputs += tag == "input"
            if tag == "br" or tag == "hr":
                self._block += tag == "hr"
                self.pieces.append((node, " ", self._block))
            return
        if tag in BLOCKS:
            self._block += 1
        value, part = "", None
        if "=" in attrs:
            found = ATTR_RE.findall(attrs)
            value = " ".join(b or c or d for a, b, c, d in found if a != "data-part")
            part = next((b or c or d for a, b, c, d in found if a == "data-part"), None)
        if tag in BLOCKS or value or part or tag in SILENT:
            self._push(tag, value, part)
        else:  # plain inline elements are no nodes
            self._enter(tag, node)
        self._anchors += tag == "a"
        node.tags += 1

    def _text(self, text: str) -> None:
        node = self._open[-1][1]
        if node.silent:
            return
        if "&" in text:
            text = html.unescape(text)
        self.pieces.append((node, text, self._block))
        if not text.isspace():
            spaces = text.count(" ")
            n = len(text) - spaces
            node.chars += n
            node.words += spaces + 1 if n else 0
        else:
            n = 0
        node.marks += text.count(".") + text.count(",")
        if self._anchors:
            node.links += n

    def _next_tag(self, source: str, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, slash, name, attributes) of the next tag or comment.

        A tag ends at the first ``>`` outside quotes, or if a quote is not
        closed, at the first ``>``.  Where a look for the end got stuck at an
        open quote, places outside quotes are marked: a later look from there
        would get stuck too, so a page is read a bounded number of times.
        """
        while True:
            start = source.find("<", at)
            if start < 0:
                return None
            name = NAME_RE.match(source, start)
            if not name:
                if source.startswith("<!--", start):
                    close = source.find("-->", start + 4)
                    return start, close + 3 if close >= 0 else len(source), "", "", ""
                if source[start + 1:start + 2] not in ("!", "?", "/"):
                    at = start + 1
                    continue
            first = source.find(">", start)
            if first < 0:  # no tag ends any more, and no comment
                comment = source.find("<!--", start)
                return (comment, len(source), "", "", "") if comment >= 0 else None
            if not name:
                return start, first + 1, "", "", ""
            at = name.end()
            if self._stuck is None or not self._stuck[at]:
                end = ATTRS_RE.match(source, at).end()
                if source[end:end + 1] == ">":
                    return start, end + 1, name[1], name[2], source[at:end]
                if self._stuck is None:
                    self._stuck = bytearray(len(source) + 1)
                for part in PLAIN_OR_QUOTED_RE.finditer(source, at, end):
                    if part[0][0] not in "\"'":
                        self._stuck[part.start():part.end()] = b"\1" * len(part[0])
            return start, first + 1, name[1], name[2], source[at:first]

    def _parse(self, source: str) -> None:
        at = 0
        while True:
            found = self._next_tag(source, at)
            stop = found[0] if found else len(source)
            if stop > at:
                self._text(source[at:stop])
            if not found:
                return
            _, at, end, tag, attrs = found
            if not tag:
                continue
            tag = tag.lower()
            if end:
                self._close({tag}, {"table"} if tag not in ("table", "body", "html", "article", "main", "div") else ())
                continue
            self._start(tag, attrs)
            if tag in RAW and not attrs.endswith("/"):
                close = re.compile(f"</{tag}", re.I).search(source, at)
                if tag == "xmp":
                    self._text(source[at:close.start() if close else len(source)])
                at = close.start() if close else len(source)

    def _sum(self) -> None:
        at = 0
        for node in self.nodes:
            node.start = at
            at += node.chars
            node.paragraphs += node.tag in ("p", "blockquote", "pre")
        for node in reversed(self.nodes):  # children come after their parent
            if node.parent is not None:
                for k in ("chars", "links", "words", "marks", "tags", "paragraphs", "inputs"):
                    setattr(node.parent, k, getattr(node.parent, k) + getattr(node, k))

    def features(self) -> list[list[float]]:
        """One row per node: tag group, hints (own and of any ancestor),
        depth, subtree density and statistics of the siblings."""
        total = self.root.chars or 1
        above: dict[int, tuple] = {}
        tags: dict[int, Counter] = {}  # of the children, counted once per parent
        rows = []
        kinds = list(HINTS)
        for node in self.nodes:
            own = [float(k in node.hints) for k in kinds]
            group = [float(node.tag in g) for g in GROUPS]
            up = above.get(id(node.parent), ((0.0,) * len(kinds), (0.0,) * 6))
            family = node.parent.children if node.parent is not None else [node]
            i, others = node.index, node.parent.chars - node.chars if node.parent is not None else 0
            before = family[i - 1].chars if i else 0
            after = family[i + 1].chars if i + 1 < len(family) else 0
            if id(node.parent) not in tags:
                tags[id(node.parent)] = Counter(x.tag for x in family)
            same = tags[id(node.parent)][node.tag]
            chars, around = node.chars, node.parent or node
            rows.append(group + own + list(up[0]) + list(up[1]) + [
                float(node.depth), math.log1p(chars), chars / total, node.links / chars if chars else 0.0,
                chars / (node.tags + 1), node.words / (node.tags + 1), node.marks / (chars + 1),
                chars / (node.words + 1), float(node.paragraphs), node.paragraphs / (node.tags + 1), float(node.inputs),
                node.start / total, float(i), float(len(family)), same / len(family),
                others / len(family), chars / (node.parent.chars or 1) if node.parent is not None else 1.0,
                math.log1p(before), math.log1p(after), around.chars / total, float(around.paragraphs),
                around.links / around.chars if around.chars else 0.0])
            above[id(node)] = (tuple(map(max, up[0], own)), tuple(map(max, up[1], group[:6])))
        return rows

    def text(self, kept: list[bool]) -> str:
        """The kept pieces: white space of a block as one space, blocks joined."""
        keep = {id(n) for n, k in zip(self.nodes, kept) if k}
        blocks: dict[int, list[str]] = {}
        for node, piece, block in self.pieces:
            if id(node) in keep:
                blocks.setdefault(block, []).append(piece)
        lines = (" ".join("".join(p).split()) for p in blocks.values())
        return "\n\n".join(x for x in lines if x)


N_FEATURES = len(GROUPS) + 2 * len(HINTS) + 6 + 22
