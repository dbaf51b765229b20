"""Main text of pages by a tree-structured graphical model over their DOM."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import dom
from tidemark.llm.common import pick, strings
from tidemark.llm.html_pages import labelled_page

# labelled pages that the model is trained on, and steps of the training
PAGES, STEPS = 400, 150
# nodes that go through the message passing at once
FOREST = 50_000
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# marks inside a line
_TEXT = frozenset("#text a b strong em i span code br math mi mn mo mrow svg g text sub sup u small kbd mark abbr cite q time object font".split())


_LINES = frozenset("p div li blockquote pre td dd section".split())


# short ones among long ones are content all the same
_LEAVES = _TEXT | frozenset("p li h1 h2 h3 h4 td th tr".split())


def _kind(tag: str) -> str:
    """The class of an edge by the child's tag."""
    if tag == "#text":
        return "text"
    if tag in _TEXT:
        return "inline"
    if tag in ("h1", "h2", "h3", "h4"):
        return "heading"
    return tag if tag in ("article", "main", "section", "div", "p", "ul", "li", "body", "html", "td", "header", "footer", "aside", "form", "nav") else "other"


def node_features(page: dom.Page) -> list[list[str]]:
    """Names of each node's features: tag, words of class, id and role, share of linked text, length of text."""
    n = len(page.tag)
    size, linked, commas = [0] * n, [0] * n, [0] * n
    for k in range(n - 1, -1, -1):
        if page.tag[k] == "#text":
            size[k] = len(page.text[k].strip())
            commas[k] = page.text[k].count(",") + page.text[k].count(".")
        if page.tag[k] == "a":
            linked[k] = size[k]
        p = page.parent[k]
        if p >= 0:
            size[p] += size[k]
            linked[p] += linked[k]
            commas[p] += commas[k]
    # text that is no link, directly or by lines of markup, in an element's children of some length: the mark of running text
    running = [0] * n
    for k in range(1, n):
        if page.tag[k] in _LINES and size[k] - linked[k] >= 40:
            running[page.parent[k]] += 1
    total = max(1, size[0])
    out = []
    for k in range(n):
        tag, at, p = page.tag[k], page.attributes[k], page.parent[k]
        f = [f"t:{tag}", f"l:{_kind(tag)}:{min(8, size[k].bit_length())}"]
        if p >= 0:
            # the element around it; the share of the page's text in both, and its neighbours' running text
            f.append(f"p:{_kind(tag)}:{page.tag[p]}:{'named' if at else 'plain'}")
            f += [f"r:{_kind(tag)}:{4 * size[k] // total}", f"q:{_kind(tag)}:{4 * size[p] // total}",
                  f"m:{_kind(tag)}:{min(4, running[k].bit_length())}"]
            if tag not in _LEAVES:
                f.append(f"n:{_kind(tag)}:{min(4, running[p].bit_length())}")
        if tag != "#text":
            share = linked[k] / size[k] if size[k] else 0.0
            f.append(f"a:{_kind(tag)}:{int(share * 4)}")
            f.append(f"c:{_kind(tag)}:{min(4, commas[k].bit_length())}")
            for key in ("class", "id", "role", "itemprop", "aria-label"):
                if at.get(key):
                    f += [f"w:{w.lower()}" for w in set(_NAME.findall(at[key]))]
            if "hidden" in at or at.get("aria-hidden") == "true" or "display:none" in at.get("style", "").replace(" ", ""):
                f.append("hidden")
        out.append(f)
    return out


@dataclass(frozen=True)
class Model:
    """Weights of node features for content, and potentials of (parent label, child label) for each kind of edge."""

    features: dict[str, int]
    weights: np.ndarray
    kinds: dict[str, int]
    pairs: np.ndarray


class Forest:
    """Several pages as one array of nodes, for message passing level by level."""

    def __init__(self, pages: list[dom.Page], features: dict[str, int], kinds: dict[str, int], grow: bool = False):
        parent, depth, kind, rows, cols = [], [], [], [], []
        for page in pages:
            base = len(parent)
            for k, (p, tag, names) in enumerate(zip(page.parent, page.tag, node_features(page))):
                parent.append(p + base if p >= 0 else -1)
                depth.append(depth[p + base] + 1 if p >= 0 else 0)
                name = _kind(tag)
                if grow:
                    kinds.setdefault(name, len(kinds))
                kind.append(kinds.get(name, kinds.get("other", 0)))
                for f in names:
                    if grow:
                        features.setdefault(f, len(features))
                    if f in features:
                        rows.append(base + k)
                        cols.append(features[f])
        self.parent, self.kind = np.array(parent, np.int64), np.array(kind, np.int64)
        self.rows, self.cols = np.array(rows, np.int64), np.array(cols, np.int64)
        depth = np.array(depth, np.int64)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(order) else []
        # place of a node in its level, so that a level's messages are summed over the level above alone
        self.place = np.zeros(len(order), np.int64)
        for level in self.levels:
            self.place[level] = np.arange(len(level))

    def marginals(self, weights: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum-product: P(label) of every node, and P(parent label, child label) of every edge.

        Upward, a node sends its parent the sum over its own labels; downward, a parent sends each child
        what all others say. Messages are logs, normalised; one pass each way is exact on a tree.
        """
        n = len(self.parent)
        own = np.zeros((n, 2))
        own[:, 1] = np.bincount(self.rows, weights[self.cols], minlength=n)
        psi = pairs[self.kind]
        inside, up = own.copy(), np.zeros((n, 2))
        for above, level in zip(self.levels[-2::-1], self.levels[:0:-1]):
            m = np.logaddexp(psi[level, :, 0] + inside[level, None, 0], psi[level, :, 1] + inside[level, None, 1])
            m -= m.max(axis=1, keepdims=True)
            up[level] = m
            for s in (0, 1):
                inside[above, s] += np.bincount(self.place[self.parent[level]], m[:, s], minlength=len(above))
        down, joint = np.zeros((n, 2)), np.zeros((n, 2, 2))
        for level in self.levels[1:]:
            p = self.parent[level]
            rest = inside[p] + down[p] - up[level]
            both = rest[:, :, None] + psi[level]
            m = np.logaddexp(both[:, 0], both[:, 1])
            down[level] = m - m.max(axis=1, keepdims=True)
            both = both + inside[level][:, None, :]
            both = np.exp(both - both.max(axis=(1, 2), keepdims=True))
            joint[level] = both / both.sum(axis=(1, 2), keepdims=True)
        belief = inside + down
        belief = np.exp(belief - belief.max(axis=1, keepdims=True))
        return belief / belief.sum(axis=1, keepdims=True), joint


def train(pages: list[tuple[dom.Page, list[int]]], steps: int = STEPS, penalty: float = 0.005) -> Model:
    """Maximum likelihood of the labels of whole trees: the gradient is what is seen less what the marginals expect."""
    features: dict[str, int] = {}
    kinds: dict[str, int] = {}
    forest = Forest([p for p, _ in pages], features, kinds, grow=True)
    y = np.array([label for _, labels in pages for label in labels], np.int64)
    child = np.flatnonzero(forest.parent >= 0)
    cell = forest.kind[child] * 4 + 2 * y[forest.parent[child]] + y[child]
    seen_pairs = np.bincount(cell, minlength=4 * len(kinds)).reshape(-1, 2, 2)
    theta = np.zeros(len(features) + 4 * len(kinds))
    m = v = np.zeros_like(theta)
    for t in range(1, steps + 1):
        w, pairs = theta[:len(features)], theta[len(features):].reshape(-1, 2, 2)
        node, joint = forest.marginals(w, pairs)
        g_w = np.bincount(forest.cols, (y - node[:, 1])[forest.rows], minlength=len(features)) - penalty * w
        expected = np.stack([np.bincount(forest.kind[child], joint[child, a, b], minlength=len(kinds))
                             for a in (0, 1) for b in (0, 1)], axis=1).reshape(-1, 2, 2)
        g = np.concatenate([g_w, (seen_pairs - expected).ravel() - penalty * theta[len(features):]]) / len(pages)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-6)
    return Model(features, theta[:len(features)], kinds, theta[len(features):].reshape(-1, 2, 2))


def content(pages: list[dom.Page], model: Model) -> list[list[bool]]:
    """For every node of every page whether it is likelier content than not."""
    if not pages:
        return []
    node, _ = Forest(pages, model.features, model.kinds).marginals(model.weights, model.pairs)
    cuts = np.cumsum([len(p.tag) for p in pages])[:-1]
    return [part.tolist() for part in np.split(node[:, 1] > 0.5, cuts)]


_trained: dict[tuple[int, int], Model] = {}


def default_model(pages: int = PAGES, steps: int = STEPS) -> Model:
    """A model trained on ``pages`` labelled pages, once per process."""
    if (pages, steps) not in _trained:
        _trained[pages, steps] = train([labelled_page(seed) for seed in range(pages)], steps)
    return _trained[pages, steps]


def extract(pages: DataFrame, model: Model | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text): the main text of each page, one row per row of ``pages``.

    Null or empty html, and pages without content, give an empty text. Pages are read whole; broken markup is read as
    far as it goes. Null ids, repeated rows and any url are kept; further columns are ignored; an empty table gives no
    rows. No shuffle: pages are independent, and the model is of fixed size.
    """
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, held, nodes = [], [], 0
            for source in strings(b.column(2)):
                held.append(dom.read(source))
                nodes += len(held[-1].tag)
                if nodes > FOREST:
                    texts += [dom.blocks_text(p, keep) for p, keep in zip(held, content(held, model))]
                    held, nodes = [], 0
            texts += [dom.blocks_text(p, keep) for p, keep in zip(held, content(held, model))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())],
                                             names=["page_id", "url", "text"])

    return pick(pages, page_id=f"{page_id} bigint", url=f"{url} string", html=f"{html} string").mapInArrow(
        run, "page_id bigint, url string, text string")
