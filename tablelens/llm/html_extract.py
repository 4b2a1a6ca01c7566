"""HTML extraction with a tree-structured graphical model (operator 6).

A page is the tree of its block elements. Each has a binary variable (part of
the article or not), a potential from its features (tag, names of class, id and
role, lengths, link density) and one with its parent. On a tree sum-product is
exact: one pass of messages up, one down, and every element has the marginal
probability of being content, given the whole page. Weights are those of
greatest penalised likelihood of labelled pages (html_pages), found by gradient
ascent with the same messages; they are a few hundred numbers.

A block of text is kept if its element's marginal is above one half.
References are decoded, white space in a block becomes one space, blocks are
joined in page order by two line ends. Null pages count as empty and give an
empty text; pages cut off anywhere are read as far as they go; pages of any
length and depth are read whole. Repeated rows give the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, steps
from .html_pages import labelled_pages
from .html_tree import Page, features, parse

#: Labelled pages that train, steps of the ascent, and the penalty of a squared weight.
TRAIN_PAGES, TURNS, PENALTY = 800, 150, 1e-4
#: Elements whose name says what they are for; others without class, id and role follow their parents more.
NAMED = frozenset("article aside footer form header main menu nav".split())


@dataclass
class Model:
    weight: dict[str, float]  # score of being content for each feature
    pair: np.ndarray  # (0 plain or 1 named or described child, parent's label, child's label)


@dataclass
class Forest:
    """Nodes of many pages, by depth: parents come before children."""

    parent: np.ndarray
    kind: np.ndarray  # 1 if the element is named or described
    levels: list[np.ndarray]


def forest(pages: list[Page]) -> Forest:
    parent, depth, base = [], [], 0
    for p in pages:
        parent += [n.parent + base if n.parent >= 0 else -1 for n in p.nodes]
        depth += [n.depth for n in p.nodes]
        base += len(p.nodes)
    depth = np.array(depth)
    order = np.argsort(depth, kind="stable")
    kind = np.array([int(bool(n.tokens) or n.tag in NAMED) for p in pages for n in p.nodes])
    return Forest(np.array(parent), kind, np.split(order, np.flatnonzero(np.diff(depth[order])) + 1))


def messages(trees: Forest, score: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals (nodes, 2), marginals of edges (nodes, parent's label, own label) and the log of the partition function."""
    n = len(score)
    up = np.stack([np.zeros(n), score], axis=1)  # own potential and what the children say
    to_parent = np.zeros((n, 2))
    for level in reversed(trees.levels[1:]):
        own = pair[trees.kind[level]]
        to_parent[level] = np.logaddexp(own[:, :, 0] + up[level, 0:1], own[:, :, 1] + up[level, 1:2])
        np.add.at(up, trees.parent[level], to_parent[level])
    down = np.zeros((n, 2))
    edge = np.zeros((n, 2, 2))
    for level in trees.levels[1:]:
        own = pair[trees.kind[level]]
        above = up[trees.parent[level]] + down[trees.parent[level]] - to_parent[level]
        down[level] = np.logaddexp(above[:, 0:1] + own[:, 0], above[:, 1:2] + own[:, 1])
        edge[level] = above[:, :, None] + own + up[level][:, None, :]
    both = up + down
    total = np.logaddexp(both[:, 0], both[:, 1])
    roots = trees.levels[0]
    return np.exp(both - total[:, None]), np.exp(edge - total[:, None, None]), float(total[roots].sum())


def train(sources: list[str], turns: int = TURNS, penalty: float = PENALTY) -> Model:
    """Gradient ascent (Adam) on the likelihood of the pages' labels."""
    pages = [parse(s) for s in sources]
    trees = forest(pages)
    nodes = [(p, i) for p in pages for i in range(len(p.nodes))]
    label = np.array([p.nodes[i].label == "1" for p, i in nodes], float)
    held = [features(p, i) for p, i in nodes]
    names = {f: k for k, f in enumerate(sorted({f for fs in held for f in fs}))}
    flat = np.array([names[f] for fs in held for f in fs])
    owner = np.repeat(np.arange(len(held)), [len(fs) for fs in held])
    child = np.flatnonzero(trees.parent >= 0)
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (trees.kind[child], label[trees.parent[child]].astype(int), label[child].astype(int)), 1)
    # A pair scores +a or -a for equal or different labels: a child that says nothing of itself says nothing of its parent.
    same = np.array([[1.0, -1.0], [-1.0, 1.0]])
    w = np.zeros(len(names) + 2)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, turns + 1):
        score = np.bincount(owner, w[: len(names)][flat], minlength=len(held))
        marginal, edge, _ = messages(trees, score, w[len(names) :, None, None] * same)
        expected = np.zeros((2, 2, 2))
        np.add.at(expected, trees.kind[child], edge[child])
        gain = np.concatenate([np.bincount(flat, (label - marginal[:, 1])[owner], minlength=len(names)), ((seen - expected) * same).sum(axis=(1, 2))])
        gain = gain / len(pages) - penalty * w
        first, second = 0.9 * first + 0.1 * gain, 0.99 * second + 0.01 * gain**2
        w += 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return Model({f: float(w[k]) for f, k in names.items()}, w[len(names) :, None, None] * same)


@lru_cache(maxsize=1)
def default_model() -> Model:
    return train(labelled_pages(TRAIN_PAGES))


def marginals(pages: list[Page], model: Model) -> list[np.ndarray]:
    """For each page the probability of each element to be content."""
    weight = model.weight
    score = np.array([sum(weight.get(f, 0.0) for f in features(p, i)) for p in pages for i in range(len(p.nodes))])
    got = messages(forest(pages), score, model.pair)[0][:, 1]
    return np.split(got, np.cumsum([len(p.nodes) for p in pages])[:-1])


def extract(sources: list[str], model: Model) -> list[str]:
    pages = [parse(s) for s in sources]
    return ["\n\n".join(text for node, text in p.runs if chance[node] > 0.5) for p, chance in zip(pages, marginals(pages, model))] if pages else []


def extract_pages(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), source: str = "html", model: Model | None = None) -> DataFrame:
    """The columns `keep`, text and n_chars of every page."""
    model = model or default_model()
    slim = pages.select(*keep, F.coalesce(F.col(source), F.lit("")).alias("__html"))
    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name != "__html")
    names = [*keep, "text", "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sources = b.column(len(names) - 2).to_pylist()
            for lo, hi in steps(sources, 500_000):
                text = extract(sources[lo:hi], model)
                kept = [c.slice(lo, hi - lo) for c in b.columns[:-1]]
                yield pa.record_batch([*kept, pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names)

    return map_arrow(slim, run, f"{typed}, text string, n_chars long")
