"""A forgiving HTML reader: pages as flat trees of elements and texts."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# their text is never shown
_UNSEEN = frozenset("script style noscript template iframe head title textarea select option button datalist".split())
# what may stand in a head; anything else ends it
_HEAD = frozenset("base basefont bgsound head html link meta noscript script style template title".split())
_RAW = frozenset("script style textarea title iframe noscript".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody "
    "td tfoot th thead tr ul".split())
# a start tag of the first kind ends an open element of the second
_ENDS_P = BLOCKS - frozenset("br body html td th tr tbody thead tfoot caption".split())
_KEEPS_P = frozenset("button table td th object article section div li".split())
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
         "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
         "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "tr", "td", "th"}, {"table"})}
# a comment, declaration or end tag, or the name of a start tag, whose end is looked for apart
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"""
                  r"""|<([a-zA-Z][^\s/>]*)""", re.S)
_STOP = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]++)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_CLOSE = {t: re.compile(rf"</{t}[^>]*(?:>|\Z)", re.I) for t in _RAW}


@dataclass
class Page:
    """Nodes in page order: ``parent`` (-1 for the root), ``tag`` ("#text" for texts), ``attributes``, ``text``."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    attributes: list[dict[str, str]] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    # position among the words of the page where an element ends, as the number of the next node
    end: list[int] = field(default_factory=list)

    def add(self, parent: int, tag: str, attributes: dict[str, str] | None = None, text: str = "") -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.attributes.append(attributes or {})
        self.text.append(text)
        self.end.append(-1)
        return len(self.tag) - 1


def read(source: str) -> Page:
    """The tree of a page in one pass, in time linear in its length.

    Missing, wrong and crossed end tags are accepted; a head ends where something starts that may not stand in it;
    unseen elements and comments leave no text.
    """
    page = Page()
    stack = [page.add(-1, "#page")]
    # places in the stack of the open elements of each name, and how many of the open ones are unseen
    held: dict[str, list[int]] = {}
    unseen = 0
    last = {q: source.rfind(q) for q in "\"'"}
    at = 0

    def close(to: int) -> None:
        nonlocal unseen
        while len(stack) > to:
            node = stack.pop()
            page.end[node] = len(page.tag)
            if stack:
                held[page.tag[node]].pop()
                unseen -= page.tag[node] in _UNSEEN

    def highest(names: set[str] | frozenset[str]) -> int:
        return max((held[t][-1] for t in names if held.get(t)), default=0)

    def words(a: int, b: int) -> None:
        if a >= b:
            return
        if unseen and page.tag[stack[-1]] == "head" and not source[a:b].isspace():
            close(len(stack) - 1)
        if not unseen:
            page.add(stack[-1], "#text", text=html.unescape(source[a:b]) if "&" in source[a:b] else source[a:b])

    def end_open(ends: set[str] | frozenset[str], within: set[str] | frozenset[str]) -> None:
        low = highest(ends)
        if low and low > highest(within):
            while low > 1 and page.tag[stack[low - 1]] in ends:
                low -= 1
            close(low)

    def tag_end(a: int) -> int:
        """Where the start tag whose name ends at ``a`` has its ``>``; quotes that never close are plain signs."""
        while m := _STOP.search(source, a):
            if m.group() == ">":
                return m.start()
            a = m.end() if m.start() == last[m.group()] else source.find(m.group(), m.end()) + 1
        return len(source)

    while True:
        m = _TAG.search(source, at)
        if m is None:
            words(at, len(source))
            break
        words(at, m.start())
        at = m.end()
        if m[1]:
            name = m[1].lower()
            if name == "br":
                page.add(stack[-1], "br")
                page.end[-1] = len(page.tag)
            if held.get(name):
                close(held[name][-1])
        elif m[2]:
            name = m[2].lower()
            stop = tag_end(at)
            said, at = source[at:stop], stop + 1
            attributes = {}
            for key, a, b, c in _ATTRIBUTE.findall(said) if said.strip() else ():
                attributes.setdefault(key.lower(), html.unescape(a or b or c))
            if held.get("head") and name not in _HEAD:
                close(held["head"][-1])
            if name in _ENDS_P:
                end_open({"p"}, _KEEPS_P - {name})
            if name in _ENDS:
                end_open(*_ENDS[name])
            node = page.add(stack[-1], name, attributes)
            if name in _VOID or said.rstrip().endswith("/") and name not in BLOCKS | _RAW:
                page.end[node] = len(page.tag)
                continue
            held.setdefault(name, []).append(len(stack))
            unseen += name in _UNSEEN
            stack.append(node)
            if name in _RAW:
                stop = _CLOSE[name].search(source, at)
                at = stop.end() if stop else len(source)
                close(len(stack) - 1)
    close(0)
    return page


def blocks_text(page: Page, keep: list[bool]) -> str:
    """The kept texts: white space within a block becomes one blank, blocks are joined by one blank."""
    parts, open_ = [], []
    for k, tag in enumerate(page.tag):
        while open_ and page.end[open_[-1]] <= k:
            open_.pop()
            parts.append(" ")
        if tag == "#text":
            if keep[k]:
                parts.append(page.text[k])
        elif tag in BLOCKS:
            parts.append(" ")
            open_.append(k)
    return " ".join("".join(parts).split())
