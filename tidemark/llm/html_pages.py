"""Labelled pages, written by a layout grammar: every text is marked as content of the article or as something else."""

from __future__ import annotations

import random

from tidemark.llm.dom import Page

# names that page makers give to the parts of a page
_PARTS = {
    "menu": (("nav", "ul", "div"), ("nav", "menu", "navbar", "main-nav", "breadcrumb", "breadcrumbs", "topnav", "links", "pagination")),
    "header": (("header", "div"), ("header", "site-header", "masthead", "banner", "top", "logo", "branding")),
    "footer": (("footer", "div"), ("footer", "site-footer", "bottom", "copyright", "colophon", "legal")),
    "sidebar": (("aside", "div", "section"), ("sidebar", "side", "widget", "related", "recommended", "popular", "rail", "tags", "archive")),
    "notice": (("div", "section", "dialog", "p"), ("cookie", "notice", "cookie-notice", "consent", "gdpr", "alert", "popup", "modal", "newsletter", "subscribe", "banner", "paywall")),
    "advert": (("div", "aside", "ins", "section", "p"), ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "adsbygoogle", "sponsor", "banner-ad")),
    "form": (("form",), ("search", "login", "signup", "contact", "comment-form", "subscribe")),
    "comments": (("section", "div", "ol", "ul"), ("comments", "comment-list", "comment", "replies", "discussion", "disqus", "responses", "feedback")),
    "share": (("div", "ul"), ("share", "social", "share-buttons", "follow", "author-box")),
}
_CONTENT = (("article", "main", "div", "section"), ("article", "content", "post", "entry", "entry-content", "post-body", "story",
                                                   "main-content", "article-body", "text", "body", "page-content", "hentry"))


_TOPICS = ("work", "history", "theory", "notes", "research", "methods", "studies", "design", "science", "culture")


class Writer:
    """One labelled page, as a tree with the label of every node."""

    def __init__(self, rng: random.Random):
        self.rng, self.page, self.labels = rng, Page(), []
        # some pages write without signs
        self.signs = ["", "", "", "", "", ",", "."] if rng.random() < 0.7 else [""]

    def node(self, parent: int, tag: str, label: int, attributes: dict[str, str] | None = None, text: str = "") -> int:
        self.labels.append(label)
        return self.page.add(parent, tag, attributes, text)

    def said(self, low: int, high: int) -> str:
        r = self.rng
        words = ["".join(r.choice("aeiounrstlm") for _ in range(r.randint(1, 9))) for _ in range(r.randint(low, high))]
        return " ".join(w + r.choice(self.signs) for w in words).capitalize() + r.choice(self.signs[-1:] * 3 + [""])

    def named(self, names: tuple[str, ...]) -> dict[str, str]:
        r = self.rng
        if r.random() < 0.15:
            return {}
        name = r.choice(names) + r.choice(["", "", "", f"-{r.randint(1, 99)}", " clearfix", "-wrap", "_box"])
        return {r.choice(["class", "class", "id"]): name}

    def inline(self, parent: int, label: int, low: int, high: int) -> None:
        r = self.rng
        for _ in range(r.choice([1, 1, 1, 2, 3])):
            self.node(parent, "#text", label, text=self.said(low, high))
            if r.random() < 0.3:
                inner = self.node(parent, r.choice(["a", "b", "strong", "em", "i", "span", "code", "sub", "small", "math", "svg", "object"]), label)
                if self.page.tag[inner] in ("math", "svg"):
                    inner = self.node(inner, r.choice(["mi", "mn", "g", "text"]), label)
                self.node(inner, "#text", label, text=self.said(1, 6))

    def article(self, parent: int, depth: int = 0) -> None:
        r = self.rng
        if depth == 0 and r.random() < 0.12:
            # no element around the article: its blocks stand between the other parts
            top = parent
        else:
            named = self.named(_CONTENT[1])
            tag = r.choice(_CONTENT[0]) if named or depth or r.random() < 0.6 else r.choice(["article", "main"])
            top = self.node(parent, tag, 1, named)
            if depth < 2 and r.random() < 0.3:
                return self.article(top, depth + 1)
        if r.random() < 0.15:
            self.entry(top)
            return
        if r.random() < 0.9:
            head = self.node(top, "header", 1) if r.random() < 0.1 else top
            self.inline(self.node(head, r.choice(["h1", "h1", "h2"]), 1), 1, 1, 14)
        # paragraphs of one page are alike: few or very many, of one word or of many
        lengths = r.choice([((1, 4, 12, 30), (30, 60, 120)), ((1,), (2, 4)), ((2, 5), (6, 12))])
        plain = r.random() < 0.4
        for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8, 14, 40, 120])):
            kind = 0 if plain else r.random()
            if kind < 0.6:
                p = self.node(top, r.choice(["p", "p", "p", "p", "div", "pre", "blockquote"]), 1)
                if r.random() < 0.15:
                    self.node(p, "br", 1)
                self.inline(p, 1, r.choice(lengths[0]), r.choice(lengths[1]))
            elif kind < 0.68:
                self.inline(self.node(top, r.choice(["h2", "h3", "h4"]), 1), 1, 1, 10)
            elif kind < 0.76:
                items = self.node(top, r.choice(["ul", "ol"]), 1)
                for _ in range(r.randint(1, 6)):
                    self.inline(self.node(items, "li", 1), 1, 2, 25)
            elif kind < 0.8:
                rows = self.node(top, "table", 1)
                for _ in range(r.randint(1, 4)):
                    # cells of a word or a number
                    row = self.node(rows, "tr", 1)
                    for _ in range(r.randint(1, 4)):
                        cell = self.node(row, r.choice(["td", "td", "th"]), 1)
                        if r.random() < 0.4:
                            self.node(cell, "#text", 1, text=str(r.randint(1, 999)))
                        else:
                            self.inline(cell, 1, 1, 6)
            elif kind < 0.85:
                figure = self.node(top, "figure", 1)
                self.node(figure, "img", 1)
                self.inline(self.node(figure, "figcaption", 1), 1, 2, 15)
            else:
                self.part(top, r.choice(["advert", "share", "notice", "sidebar", "comments", "form"]))

    def paragraphs(self, parent: int, count: int, low: int, high: int) -> None:
        for _ in range(count):
            self.inline(self.node(parent, "p", 1), 1, low, high)

    def entry(self, top: int) -> None:
        """An article with a head, a foot and notes at its side, and sections whose names sound like other parts."""
        r = self.rng
        if r.random() < 0.7:
            head = self.node(top, "header", 1)
            self.inline(self.node(head, r.choice(["h1", "h2"]), 1), 1, 1, 12)
        self.paragraphs(top, r.randint(1, 6), 5, r.choice([12, 40]))
        if r.random() < 0.5:
            odd = r.choice([n for _, names in _PARTS.values() for n in names if "-" not in n])
            inner = self.node(top, r.choice(["section", "section", "div"]), 1, {r.choice(["class", "id"]): f"{odd}-{r.choice(_TOPICS)}"})
            self.inline(self.node(inner, "h2", 1), 1, 1, 6)
            self.paragraphs(inner, r.randint(1, 4), 8, 40)
        if r.random() < 0.6:
            side = self.node(top, "aside", 0, self.named(_PARTS["sidebar"][1]) if r.random() < 0.5 else {})
            self.inline(self.node(side, r.choice(["p", "div", "h3"]), 0), 0, 1, r.choice([6, 25]))
        self.paragraphs(top, r.randint(0, 4), 5, 40)
        if r.random() < 0.7:
            foot = self.node(top, "footer", 0, self.named(("entry-footer", "meta", "post-meta", "tags")) if r.random() < 0.5 else {})
            self.inline(self.node(foot, r.choice(["p", "div", "span"]), 0), 0, 1, r.choice([4, 12]))

    def rows(self, parent: int, before: list[str], after: list[str]) -> None:
        """A page laid out as a table: one cell holds the article, the others what is around it."""
        r = self.rng
        table = self.node(parent, "table", 0)
        body = self.node(table, "tbody", 0) if r.random() < 0.3 else table
        for kinds in (before[:1], None, after[:1]):
            row = self.node(body, "tr", 0)
            if kinds is None:
                for kind in before[1:2]:
                    self.part(self.node(row, "td", 0), kind)
                self.article(self.node(row, "td", 1), 1)
                for kind in after[1:2]:
                    self.part(self.node(row, "td", 0), kind)
            for kind in kinds or ():
                self.part(self.node(row, "td", 0), kind)

    def part(self, parent: int, kind: str) -> None:
        """A part that is not content: links, short lines, or whole sentences, which only its place tells from content."""
        r = self.rng
        tags, names = _PARTS[kind]
        tag, named = r.choice(tags), self.named(names)
        if not named and tag in ("div", "section", "p", "ul", "ol", "dialog"):
            named = {"class": r.choice(names)}
        top = self.node(parent, tag, 0, named)
        if r.random() < 0.3:
            top = self.node(top, r.choice(["div", "section", "ul"]), 0)
        for _ in range(r.choice([1, 1, 2, 3, 6, 12])):
            form = r.random()
            if form < 0.35 or kind == "menu":
                items = self.node(top, r.choice(["ul", "ol", "div", "p"]), 0)
                for _ in range(r.randint(1, 8)):
                    item = self.node(items, "li", 0) if r.random() < 0.8 else items
                    link = self.node(item, "a", 0, {"href": "#"})
                    self.node(link, "#text", 0, text=self.said(1, 4))
            elif form < 0.6:
                self.node(top, "#text", 0, text=self.said(1, 25))
            elif form < 0.9:
                self.inline(self.node(top, r.choice(["p", "div", "li", "span", "h3", "h2"]), 0), 0, 1, r.choice([8, 25, 60]))
            if kind == "form" or r.random() < 0.1:
                self.node(self.node(top, r.choice(["label", "button", "legend"]), 0), "#text", 0, text=self.said(1, 4))


def labelled_page(seed: int) -> tuple[Page, list[int]]:
    """A page of a random layout and the label of every node: 1 for the article, 0 for the rest."""
    r = random.Random(seed)
    w = Writer(r)
    parent = w.node(-1, "#page", 0)
    if r.random() < 0.7:  # others are fragments
        parent = w.node(w.node(parent, "html", 0), "body", 0)
    while r.random() < 0.35:
        parent = w.node(parent, "div", 0, {r.choice(["class", "id"]): r.choice(["wrap", "container", "page", "row", "layout", "site"])})
    before = [k for k in ("header", "menu", "notice", "advert", "form", "sidebar") if r.random() < 0.5]
    after = [k for k in ("share", "comments", "sidebar", "advert", "form", "notice", "footer") if r.random() < 0.5]
    r.shuffle(before)
    if r.random() < 0.08:
        w.rows(parent, before, after)
        w.page.end = [len(w.page.tag)] * len(w.page.tag)
        return w.page, w.labels
    for kind in before:
        w.part(parent, kind)
    w.article(parent)
    for kind in after:
        w.part(parent, kind)
    w.page.end = [len(w.page.tag)] * len(w.page.tag)
    return w.page, w.labels
