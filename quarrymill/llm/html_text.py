"""HTML extraction: which nodes of a page's tree hold the main text, by a tree-structured graphical model.

The variables are the block elements and runs of text of `html_blocks`, each content or not. A node's own potential is
log-linear in what it is and holds (tag, words of its class and id, length, links, punctuation, share of the page);
each edge has a potential of parent's and child's value, one table for each kind of child. Sum-product messages, upward
from the leaves and downward from the root, give the exact marginals of all nodes; a run of text is content if its
marginal is at least one half. Messages go level by level for all pages of a batch at once.

The model is trained from labelled pages (html, main text): a run of text is content if it is a block of the main text, in
order, an element if half of the characters below it are. The likelihood's gradient is observed less expected counts,
which the same messages give. Without labelled pages of one's own, `html_labelled` makes up `PAGES` of them; training is
bounded by that number and runs on the driver, extraction is one pass over the pages without an exchange.

Defined results: a null or empty page, and one without content, gives an empty text. Repeated pages are rows of their own; other columns don't
matter; an empty table gives an empty result. White space inside a block (also <br> and &nbsp;) is one space; blocks are joined
by two line ends. Everything in a run of content stays, however short.
"""

from __future__ import annotations

import difflib
import functools
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare
from .html_blocks import HEADINGS, Page, read
from .html_labelled import NAMES, labelled_pages

PAGES, STEPS, WEIGHT_DECAY = 600, 150, 0.003
KINDS = {"": 0, "p": 1, "blockquote": 1, "pre": 1, "figure": 1, "figcaption": 1, "address": 1, "ul": 3, "ol": 3, "dl": 3, "li": 3, "dd": 3, "dt": 3, "menu": 3}
KINDS |= dict.fromkeys(HEADINGS, 2) | dict.fromkeys("table tbody thead tfoot tr td th caption".split(), 4) | dict.fromkeys("nav header footer aside form dialog".split(), 5)
OTHER, EDGES = 6, 7
#: The kinds whose usual names hold a word.
_KINDS: dict[str, set[str]] = {}
for _kind, _names in NAMES.items():
    for _word in re.split(r"[\s-]+", _names):
        _KINDS.setdefault(_word, set()).add(_kind)


def _size(n: int) -> int:
    return min(n, 1 << 20).bit_length()


def describe(page: Page) -> list[list[str]]:
    """What each node's own potential sees."""
    n = len(page.tags)
    chars, linked, blocks = [len(t) for t in page.texts], list(page.linked), [int(bool(t)) for t in page.texts]
    for i in range(n - 1, 0, -1):
        p = page.parents[i]
        chars[p] += chars[i]
        linked[p] += linked[i]
        blocks[p] += blocks[i]
    whole = max(1, chars[0])
    out = []
    for i in range(n):
        tag = page.tags[i]
        links = int(4 * linked[i] / chars[i]) if chars[i] else 5
        if tag:
            share = int(6 * chars[i] / whole)
            seen = ["e", f"t:{tag}", f"l:{links}", f"s:{share}", f"z:{_size(chars[i] // 16)}", f"b:{_size(blocks[i])}", f"tl:{tag}:{links}"]
            kinds = set()
            for w in page.names[i]:
                seen.append(f"c:{w}")
                kinds.update(_KINDS.get(w, ()))
                if len(w) > 4:
                    seen.append(f"c4:{w[:4]}")
            seen += [f"g:{k}" for k in sorted(kinds)]
        else:
            text = page.texts[i]
            own = page.tags[page.parents[i]]
            words = _size(text.count(" ") + 1)
            seen = ["x", f"xt:{own}", f"xl:{links}", f"xw:{words}", f"xe:{text[-1] in '.!?:;\")'}", f"xc:{'©' in text}", f"xlw:{links}:{words}"]
        out.append(seen)
    return out


@dataclass
class Forest:
    """The trees of several pages: parents before children, with each node's level, edge kind and features."""

    parent: np.ndarray
    kind: np.ndarray
    levels: list[np.ndarray]
    row: np.ndarray
    feature: np.ndarray
    first: list[int]

    @classmethod
    def of(cls, pages: list[Page], numbers: dict[str, int], grow: bool = False) -> Forest:
        parent, kind, depth, row, feature, first = [], [], [], [], [], []
        for page in pages:
            base = len(parent)
            first.append(base)
            for i, (p, seen) in enumerate(zip(page.parents, describe(page))):
                parent.append(p + base if p >= 0 else -1)
                kind.append(KINDS.get(page.tags[i], OTHER))
                depth.append(depth[p + base] + 1 if p >= 0 else 0)
                for s in seen:
                    k = numbers.setdefault(s, len(numbers)) if grow else numbers.get(s)
                    if k is not None:
                        row.append(base + i)
                        feature.append(k)
        order = np.argsort(np.array(depth, np.int64), kind="stable")
        cuts = np.searchsorted(np.array(depth)[order], np.arange(1, max(depth, default=0) + 2)) if depth else []
        return cls(np.array(parent, np.int64), np.array(kind, np.int64), [order[a:b] for a, b in zip(cuts, cuts[1:])], np.array(row, np.int64), np.array(feature, np.int64), first)


def _log_add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def sum_product(forest: Forest, own: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log odds of the nodes' marginals, (n, 2, 2) joint marginals of parent and node; zeros for roots). own: log odds
    of the nodes' own potentials; edge: (kinds, 2, 2) log potentials of parent's and child's value."""
    n = len(own)
    e = edge[forest.kind]
    belief, up = own.copy(), np.zeros(n)
    for at in reversed(forest.levels):
        b = belief[at]
        up[at] = _log_add(e[at, 1, 0], e[at, 1, 1] + b) - _log_add(e[at, 0, 0], e[at, 0, 1] + b)
        np.add.at(belief, forest.parent[at], up[at])
    whole, joint = belief.copy(), np.zeros((n, 2, 2))
    for at in forest.levels:
        rest = whole[forest.parent[at]] - up[at]
        whole[at] = belief[at] + _log_add(e[at, 0, 1], e[at, 1, 1] + rest) - _log_add(e[at, 0, 0], e[at, 1, 0] + rest)
        both = e[at] + rest[:, None, None] * np.array([[0], [1]]) + belief[at][:, None, None] * np.array([[0, 1]])
        both = np.exp(both - both.max((1, 2), keepdims=True))
        joint[at] = both / both.sum((1, 2), keepdims=True)
    return whole, joint


def labels(page: Page, text: str) -> np.ndarray:
    """1 for the page's content nodes, given its main text."""
    runs = [i for i, t in enumerate(page.texts) if t]
    wanted = [b for b in (" ".join(x.split()) for x in text.split("\n\n")) if b]
    good, all_ = np.zeros(len(page.tags)), np.zeros(len(page.tags))
    found = np.zeros(len(page.tags), np.int64)
    for a, _, size in difflib.SequenceMatcher(None, [page.texts[i] for i in runs], wanted, autojunk=False).get_matching_blocks():
        found[runs[a : a + size]] = 1
    for i in range(len(page.tags) - 1, -1, -1):
        if page.tags[i]:
            found[i] = 2 * good[i] >= all_[i] > 0
        else:
            all_[i] = len(page.texts[i])
            good[i] = all_[i] * found[i]
        if i:
            good[page.parents[i]] += good[i]
            all_[page.parents[i]] += all_[i]
    return found


@dataclass
class Model:
    numbers: dict[str, int]
    weights: np.ndarray
    edge: np.ndarray

    def own(self, forest: Forest) -> np.ndarray:
        return np.bincount(forest.row, weights=self.weights[forest.feature], minlength=len(forest.parent)) if len(forest.parent) else np.zeros(0)

    def texts(self, htmls: list[str | None]) -> list[str]:
        """The main texts of pages."""
        pages = [read(h or "") for h in htmls]
        forest = Forest.of(pages, self.numbers)
        odds, _ = sum_product(forest, self.own(forest), self.edge)
        return ["\n\n".join(t for i, t in enumerate(p.texts, a) if t and odds[i] >= 0) for p, a in zip(pages, forest.first)]


def train(pages: list[tuple[str, str]], steps: int = STEPS, decay: float = WEIGHT_DECAY) -> Model:
    """The likeliest potentials, by gradient ascent with per-weight step sizes and a pull towards zero."""
    read_pages = [read(h) for h, _ in pages]
    numbers: dict[str, int] = {}
    forest = Forest.of(read_pages, numbers, grow=True)
    y = np.concatenate([labels(p, t) for p, (_, t) in zip(read_pages, pages)]) if pages else np.zeros(0, np.int64)
    model = Model(numbers, np.zeros(len(numbers)), np.zeros((EDGES, 2, 2)))
    if not len(y):
        return model
    child = np.flatnonzero(forest.parent >= 0)
    seen_edges = np.zeros((EDGES, 2, 2))
    np.add.at(seen_edges, (forest.kind[child], y[forest.parent[child]], y[child]), 1)
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in (model.weights, model.edge)]
    for step in range(1, steps + 1):
        odds, joint = sum_product(forest, model.own(forest), model.edge)
        miss = y - 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        expected = np.zeros((EDGES, 2, 2))
        np.add.at(expected, forest.kind[child], joint[child])
        slopes = (np.bincount(forest.feature, weights=miss[forest.row], minlength=len(numbers)), seen_edges - expected)
        rate = 0.15 * (1 - (step - 1) / steps)
        for w, slope, (mean, square) in zip((model.weights, model.edge), slopes, moments):
            slope = slope - decay * len(pages) * w
            mean += 0.1 * (slope - mean)
            square += 0.01 * (slope * slope - square)
            w += rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
    return model


@functools.lru_cache(2)
def default_model(pages: int = PAGES, seed: int = 14) -> Model:
    return train(labelled_pages(pages, seed))


def extract(df: DataFrame, model: Model | None = None, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """The columns of keep with text, the page's main text."""
    prepare(df.sparkSession)
    model = model or default_model()
    rows = df.select(F.col(f"`{html_col}`").cast("string").alias("html"), F.struct(*(F.col(f"`{c}`") for c in keep)).alias("kept"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(model.texts(part.column(0).to_pylist()), pa.string())], names=["kept", "text"])

    return rows.mapInArrow(run, f"kept {rows.schema['kept'].dataType.simpleString()}, text string").select("kept.*", "text")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
