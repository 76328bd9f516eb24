"""Main text of web pages: boosted trees score the nodes of a page's block structure, and the best consistent choice of nodes is kept.

Each node (an element that begins a block, or a run of text) is described by its subtree (text, links, words, density), its and its ancestors'
elements and attribute words, its depth and its siblings. A node kept needs its parent kept, so of all such choices the one of the greatest
total of log odds is taken, from the leaves up: an ancestor can't be dropped around a descendant that is kept.

The trees are fitted by MLlib on layouts that are made from a bounded sample of the pages (see ``layouts``), then scored inside the tasks that
read the pages, each page where it lies: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize
from .dom import HINTS, KINDS, Page
from .layouts import MARK, Layout

#: Of the bounded training set: pages whose words are used, layouts made from each.
SAMPLE_PAGES, LAYOUTS = 160, 5
#: The classifier's size.
TREES, DEPTH = 24, 5
#: Characters of html whose nodes a task holds at a time (one page at least).
SLICE_CHARS = 4_000_000


@dataclass
class Forest:
    """Nodes of several pages, each page's root first; ``parent`` and ``end`` count from the first page's root."""

    pages: list[Page]

    def __post_init__(self) -> None:
        sizes = [len(p.parent) for p in self.pages]
        self.begin = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        shift = np.repeat(self.begin[:-1], sizes)

        def joined(name: str) -> np.ndarray:
            return np.concatenate([np.asarray(getattr(p, name), dtype=np.int64) for p in self.pages]) if self.pages else np.zeros(0, np.int64)

        self.parent, self.end = joined("parent") + shift, joined("end") + shift
        self.root = np.repeat(self.begin[:-1], sizes)
        self.parent = np.maximum(self.parent, self.root)  # a root is its own parent
        self.depth, self.kind, self.hint = joined("depth"), joined("kind"), joined("hint")
        self.own = {name: joined(name) for name in ("chars", "links", "words", "marks")}
        by_depth = np.argsort(self.depth, kind="stable")
        self.levels = np.split(by_depth, np.cumsum(np.bincount(self.depth))[:-1]) if len(self.depth) else []

    def below(self, numbers: np.ndarray) -> np.ndarray:
        """Sums over subtrees, which are ranges."""
        total = np.concatenate(([0], np.cumsum(numbers)))
        return total[self.end] - total[: len(numbers)]

    def inherited(self, bits: np.ndarray) -> np.ndarray:
        """The bits of all ancestors, without the node's own."""
        found = np.zeros_like(bits)
        for level in self.levels[1:]:
            up = self.parent[level]
            found[level] = found[up] | bits[up]
        return found

    def features(self) -> np.ndarray:
        """A row of numbers for each node."""
        n = len(self.depth)
        leaf = self.kind == 0
        sums = {k: self.below(v) for k, v in self.own.items()}
        runs, elements = self.below(leaf.astype(np.int64)), self.below((~leaf).astype(np.int64))
        chars, page = sums["chars"], sums["chars"][self.root]
        kind_bit = np.left_shift(1, self.kind)
        up_kinds, up_hints = self.inherited(kind_bit), self.inherited(self.hint)
        parent = self.parent
        order, inner = np.arange(n), self.root != np.arange(n)
        siblings = np.bincount(parent[inner], minlength=n)[parent]
        first = np.full(n, n)
        np.minimum.at(first, parent[inner], order[inner])
        before = np.concatenate(([0], np.cumsum(self.own["chars"])))[:n]
        page_before = before - before[self.root]
        alike = self._alike(inner)
        prior = np.where(inner & (order > first[parent]), self.parent_chars_before(chars, inner), -1)
        columns = [
            chars, sums["links"] / np.maximum(chars, 1), sums["words"], sums["marks"], sums["marks"] / np.maximum(sums["words"], 1), chars / np.maximum(sums["words"], 1),
            runs, elements, chars / np.maximum(elements + runs, 1), chars / np.maximum(runs, 1), self.depth, siblings, alike, prior,
            chars / np.maximum(chars[parent], 1), chars / np.maximum(page, 1), page_before / np.maximum(page, 1), page,
            chars[parent], sums["links"][parent] / np.maximum(chars[parent], 1), runs[parent], self.kind[parent], self.kind,
        ]
        columns += [leaf_of for k in ("p", "item", "heading", "control") for leaf_of in (self.below((self.kind == KINDS.index(k)).astype(np.int64)),)]
        columns += [(kind_bit >> i) & 1 for i in range(1, len(KINDS))]
        columns += [(up_kinds >> KINDS.index(k)) & 1 for k in ("article", "main", "section", "nav", "aside", "header", "footer", "form", "control", "list", "table", "inline")]
        columns += [(self.hint >> i) & 1 for i in range(len(HINTS))] + [(up_hints >> i) & 1 for i in range(len(HINTS))]
        against = ((1 << len(HINTS)) - 1) ^ 1
        columns += [(self.hint & against) != 0, (up_hints & against) != 0, self.below(((self.hint & against) != 0).astype(np.int64)), self.below((self.hint & 1).astype(np.int64))]
        return np.column_stack(columns).astype(np.float64) if n else np.zeros((0, len(columns)))

    def _alike(self, inner: np.ndarray) -> np.ndarray:
        """How many children of the node's parent are of its kind."""
        key = self.parent * len(KINDS) + self.kind
        _, at, count = np.unique(np.where(inner, key, -1), return_inverse=True, return_counts=True)
        return np.where(inner, count[at], 0)

    def parent_chars_before(self, chars: np.ndarray, inner: np.ndarray) -> np.ndarray:
        """Characters of the sibling before: the node that ends where this one begins, under the same parent."""
        n, found = len(chars), np.zeros(len(chars), dtype=np.int64)
        order = np.lexsort((np.arange(n), self.parent))
        same = (self.parent[order][1:] == self.parent[order][:-1]) & inner[order][1:] & inner[order][:-1]
        found[order[1:][same]] = chars[order[:-1][same]]
        return found

    def choose(self, scores: np.ndarray) -> np.ndarray:
        """Which nodes are kept: the choice of the greatest total score in which the parent of a kept node is kept; roots stay."""
        best = scores.copy()
        for level in self.levels[:0:-1]:
            np.add.at(best, self.parent[level], np.maximum(best[level], 0))
        kept = self.root == np.arange(len(scores))
        for level in self.levels[1:]:
            kept[level] = kept[self.parent[level]] & (best[level] > 0)
        return kept


@dataclass
class Trees:
    """A fitted classifier as arrays: per tree the feature, threshold, children and value of each node; a leaf is its own child."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    depth: int

    @classmethod
    def of(cls, model) -> Trees:  # noqa: ANN001  a GBTClassificationModel
        def rows(root) -> list[list[float]]:  # noqa: ANN001  a node of Spark's
            found, waiting = [], [(root, -1, 0)]
            while waiting:
                node, up, side = waiting.pop()
                at = len(found)
                if up >= 0:
                    found[up][2 + side] = at
                if node.subtreeDepth():
                    found.append([node.split().featureIndex(), node.split().threshold(), at, at, 0.0])
                    waiting += [(node.leftChild(), at, 0), (node.rightChild(), at, 1)]
                else:
                    found.append([0, 0.0, at, at, node.prediction()])
            return found

        trees = []
        for tree, weight in zip(model.trees, model.treeWeights, strict=True):
            t = np.array(rows(tree._call_java("rootNode")))
            trees.append((t[:, 0].astype(int), t[:, 1], t[:, 2].astype(int), t[:, 3].astype(int), t[:, 4] * weight))
        return cls(trees, max(tree.depth for tree in model.trees))

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(x), dtype=int)
            for _ in range(self.depth):
                at = np.where(x[rows, feature[at]] <= threshold[at], left[at], right[at])
            total += value[at]
        return 2 * total


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each sampled page's layouts, as one row of features and label for each node."""
    for b in batches:
        for html, seed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = " ".join(Page(html).texts.values()).split()
            laid = [Page(Layout(words, seed + k).page()) for k in range(LAYOUTS)] if words else []
            for p in laid:
                marked = {i: t for i, t in p.texts.items() if t.startswith(MARK)}
                for i, t in marked.items():
                    p.chars[i], p.texts[i] = len(t) - 1, t[1:]
                p.marked = [int(i in marked) for i in range(len(p.parent))]
            if laid:
                forest = Forest(laid)
                label = forest.below(np.concatenate([p.marked for p in laid])) > 0
                x = forest.features()
                yield pa.RecordBatch.from_arrays([pa.array(label.astype(float)), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "numbers"])


def fit(pages: DataFrame) -> Trees | None:
    """Trees fitted on layouts of ``SAMPLE_PAGES`` pages, those of the least hash; None where no page has a word."""
    hashed = pages.filter("html is not null").withColumn("hash", F.xxhash64("page_id", "url"))
    least = [r["hash"] for r in hashed.select("hash").orderBy("hash").limit(SAMPLE_PAGES).collect()]
    if not least:
        return None
    sample = hashed.filter(F.col("hash") <= least[-1]).select("html", "hash").limit(SAMPLE_PAGES)
    made = sample.select("html", F.shiftright("hash", 8).alias("seed")).mapInArrow(_examples, "label double, numbers array<double>")
    rows = materialize(made, "examples")
    if rows.filter("label = 1").isEmpty():
        return None
    trainer = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, stepSize=0.3, seed=7, featuresCol="features", labelCol="label")
    return Trees.of(trainer.fit(rows.select("label", array_to_vector("numbers").alias("features"))))


def texts(html: list[str | None], score: Callable[[np.ndarray], np.ndarray]) -> list[str]:
    """The main text of each page."""
    pages = [Page(h or "") for h in html]
    forest = Forest(pages)
    kept = forest.choose(score(forest.features()))
    return [" ".join(t for i, t in p.texts.items() if kept[at + i]) for p, at in zip(pages, forest.begin, strict=False)]


def extract(pages: DataFrame, trees: Trees | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``: its main text, blocks in page order joined by one space.

    Without ``trees`` they are fitted on the pages themselves. White space inside a block is one space, character references are decoded, and
    nothing is cut: a page of any length is read whole, elements nested deeper than ``dom.DEEPEST`` count as siblings. A null or empty html, or
    one without words, has an empty text. Rows of null or repeated ids are read each, equal rows fare alike; other columns are not read; no rows give no rows.
    """
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    trees = trees or fit(plain)
    score = trees.log_odds if trees else (lambda x: np.zeros(len(x)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            html, found, at = b.column(2).to_pylist(), [], 0
            while at < len(html):
                to, chars = at, 0
                while to < len(html) and (to == at or chars + len(html[to] or "") <= SLICE_CHARS):
                    chars += len(html[to] or "")
                    to += 1
                found += texts(html[at:to], score)
                at = to
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string())], names=["page_id", "url", "text"])

    out = plain.mapInArrow(run, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
