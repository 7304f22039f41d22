"""A quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed in Arrow batches. The trees are fitted with numpy on a
sample of labelled rows whose expected size is ``SAMPLE`` (a hash of the id
chooses; all if there are fewer); of those only the statistics, a few dozen
numbers a row, reach the driver. All trees have the same depth and lie in flat
arrays, so a batch goes down all of them level by level.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import small
from .language_id import sampled

SAMPLE, BINS, DEPTH, TREES, RATE = 20_000, 64, 4, 80, 0.15

FEATURES = (
    "log_bytes upper lower digit space newline beyond_ascii bang hash dollar percent amp star bar stop comma quote other "
    "entropy log_words word_length distinct_words top_word long_words short_words capital_words tail_marks log_lines distinct_lines line_words"
).split()
_MARKS = [ord(c) for c in "!#$%&*|.,\""]


def statistics(text: str | None) -> list[float]:
    """The features of one text; all zero for null and empty ones."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    h = np.bincount(raw, minlength=256) / len(raw)
    upper, lower, digit, space, high = h[65:91].sum(), h[97:123].sum(), h[48:58].sum(), h[[9, 11, 12, 13, 32]].sum(), h[128:].sum()
    marks = h[_MARKS]
    used = h[h > 0]
    words = text.split()
    lines = text.split("\n")
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), dtype=np.int32, count=len(words))
    seen = Counter(words)
    return [
        np.log1p(len(raw)), upper, lower, digit, space, h[10], high, *marks, 1 - upper - lower - digit - space - h[10] - high - marks.sum(),
        float(-(used * np.log2(used)).sum()), np.log1p(len(words)), lengths.sum() / n, len(seen) / n, max(seen.values(), default=0) / n,
        (lengths > 15).sum() / n, (lengths < 4).sum() / n, sum(map(str.istitle, words)) / n, sum(not w[-1].isalnum() for w in words) / n,
        np.log1p(len(lines)), len(set(lines)) / len(lines), n / len(lines),
    ]


@dataclass
class Trees:
    """Complete trees: inner node k has the children 2k+1 and 2k+2."""

    base: float
    feature: np.ndarray  # (trees, 2**depth - 1)
    limit: np.ndarray
    leaf: np.ndarray  # (trees, 2**depth)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1."""
        trees, inner = self.feature.shape
        feature, limit = self.feature.ravel(), self.limit.ravel()
        first = np.arange(trees) * inner
        rows = np.arange(len(x))[:, None]
        node = np.zeros((len(x), trees), dtype=np.int64)
        for _ in range(int(np.log2(inner + 1))):
            at = first + node
            node = 2 * node + 1 + (x[rows, feature[at]] > limit[at])
        total = self.leaf.ravel()[np.arange(trees) * (inner + 1) + node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-(self.base + total)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, smooth: float = 2.0) -> Trees:
    """Boost on logistic loss with gradient histograms."""
    n, width = x.shape if len(x) else (0, len(FEATURES))
    p = (y.sum() + 1) / (n + 2)
    out = Trees(float(np.log(p / (1 - p))), np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), np.inf), np.zeros((trees, 2**depth)))
    if n == 0 or y.min() == y.max():
        return out
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(width)], axis=1)
    flat = binned + np.arange(width) * BINS
    margin = np.full(n, out.base)
    for t in range(trees):
        q = 1 / (1 + np.exp(-margin))
        grad, hess = y - q, q * (1 - q)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            key = ((node - first)[:, None] * width * BINS + flat).ravel()
            g = np.bincount(key, np.repeat(grad, width), many * width * BINS).reshape(many, width, BINS).cumsum(axis=2)
            h = np.bincount(key, np.repeat(hess, width), many * width * BINS).reshape(many, width, BINS).cumsum(axis=2)
            ga, ha = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + smooth) + (ga - g) ** 2 / (ha - h + smooth) - ga**2 / (ha + smooth)
            gain[(h < 1) | (ha - h < 1)] = 0
            for k in range(many):
                f, b = np.unravel_index(gain[k].argmax(), gain[k].shape)
                if gain[k, f, b] > 1e-9 and b < len(cuts[f]):
                    out.feature[t, first + k], out.limit[t, first + k] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(n), out.feature[t, node]] > out.limit[t, node])
        leaf = node - (2**depth - 1)
        g, h = np.bincount(leaf, grad, 2**depth), np.bincount(leaf, hess, 2**depth)
        out.leaf[t] = rate * g / (h + smooth)
        margin += out.leaf[t][leaf]
    return out


def _stats_of(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=np.float64).reshape(len(texts), len(FEATURES))


def labelled(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """The texts of about ``most`` labels, chosen before the join so that few texts move.

    Labels and documents meet by doc_id, every row with every row of the same
    id; a null id meets nothing. ``fit`` bounds what repeated ids make of them.
    """
    labels = sampled(labels.where(F.col("quality").isNotNull()), most)
    return docs.select("doc_id", "text").join(labels.select("doc_id", "quality"), "doc_id")


def fit(labelled: DataFrame, most: int = SAMPLE) -> Trees:
    """Learn from ``text`` and ``quality`` (0 or 1) of ``labelled``, keyed by ``doc_id``.

    Rows without a label don't count. Without rows of both labels every text
    gets the share of label 1.
    """
    rows = sampled(labelled.where(F.col("quality").isNotNull()), most).select("doc_id", "text", F.col("quality").cast("double").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "y": b["y"], "x": pa.array(list(_stats_of(b["text"].to_pylist())), pa.list_(pa.float64()))})

    got = rows.select(F.col("doc_id").cast("long"), "text", "y").mapInArrow(run, "doc_id long, y double, x array<double>").toPandas().sort_values(["doc_id", "y"])
    x = np.array(list(got.x), dtype=np.float64).reshape(len(got), len(FEATURES))
    return fit_trees(x, got.y.to_numpy(dtype=np.float64))


def score(docs: DataFrame, model: Trees, at_least: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``at_least`` on).

    Only ``text`` is looked at; null counts as empty, and empty texts get a
    score too. Columns of ``docs`` named like the added ones are replaced;
    repeated rows give repeated results.
    """
    docs = docs.drop("score", "predicted")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # TREES x 2**DEPTH numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            s = sent.value.score(_stats_of(b["text"].to_pylist()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= at_least).astype(np.int32))], names=[*b.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, StructType(list(docs.schema.fields)).add("score", "double").add("predicted", "integer"))
