"""Quality scores by a generalised additive model with pairwise interactions.

Every feature of a text is cut into bins. The model is a lookup table for each feature, and one for each of a few pairs of features; a score
is the logistic function of the sum of what a document's bins hold. The tables are learned by cyclic boosting: round after
round every feature in turn gets one shallow tree over its bins, fitted to the gradient that is left and added with a small
rate. Pairs are ranked by what one cut in both directions would gain on the finished tables, and the best are boosted alike.

Learning takes at most ``TRAIN_DOCS`` labelled documents that are not held out (the first by a hash of doc_id); their features fit
the driver. Scoring is one pass over all documents: bins by binary search and vectorised additions.

* Null and empty texts have zero features and get the score of such documents.
* Labels that are null, of unknown documents, or contradict each other are not learned from.
* Without labels every score is 0.5; with labels of one kind only it is near that kind.
* Repeated rows get equal scores. Very long texts are read as a whole. An empty table gives an empty result.
* Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from metricledger.llm.common import labelled, slices, texts, written
from metricledger.llm.rules import base_counts

#: Labelled documents learned from, at most.
TRAIN_DOCS = 40_000
#: Bins of a feature; of a feature in a pair.
BINS, PAIR_BINS = 32, 8
ROUNDS, RATE, PAIRS, PAIR_ROUNDS = 200, 0.1, 6, 60
#: Leaves of a tree over one feature; the least hessian in a leaf; what is added to each leaf's hessian.
LEAVES, LEAST_HESSIAN, RIDGE = 4, 2.0, 1.0
FEATURES = (
    "words", "word_chars", "symbols", "upper", "digits", "exclamations", "bars", "stops",
    "dup_lines", "repeated", "distinct", "stutter", "line_words", "top_share",
)
_UPPER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91], _DIGIT[48:58] = True, True


def features(text: bytes | None) -> list[float]:
    """Numbers in the order of ``FEATURES``: shares of bytes or words, but for the first and the mean lengths."""
    text = text or b""
    n, chars, symbols, dup_lines, repeated = base_counts(text)
    if not n:
        return [0.0] * len(FEATURES)
    words = text.split()
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size, lines = len(text), text.count(b"\n") + 1
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    stutter = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        math.log1p(n),
        chars / n,
        symbols / size,
        float(counts[_UPPER].sum()) / size,
        float(counts[_DIGIT].sum()) / size,
        float(counts[33]) / n,
        float(counts[124]) / n,
        float(counts[46] + counts[44]) / n,
        dup_lines / lines,
        repeated / n,
        len(seen) / n,
        stutter / n,
        math.log1p(n / lines),
        max(seen.values()) / n,
    ]


@dataclass
class Table:
    """What the bins of one feature, or of a pair of them, add."""

    of: tuple[int, ...]
    edges: tuple[np.ndarray, ...]
    values: np.ndarray

    def bins(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        for f, e in zip(self.of, self.edges, strict=True):
            out = out * (len(e) + 1) + np.searchsorted(e, x[:, f], "right")
        return out


@dataclass
class Model:
    base: float = 0.0
    tables: list[Table] = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.tables:
            out += t.values[t.bins(x)]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins, method="higher"))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The step of each bin: a tree of at most ``LEAVES`` leaves, grown where a cut gains most."""
    cg, ch = np.concatenate([[0.0], np.cumsum(g)]), np.concatenate([[0.0], np.cumsum(h)])
    leaves = [(0, len(g))]
    while len(leaves) < LEAVES:
        best = (1e-9, 0, 0)
        for k, (a, b) in enumerate(leaves):
            if b - a < 2:
                continue
            at = np.arange(a + 1, b)
            lg, lh, rg, rh = cg[at] - cg[a], ch[at] - ch[a], cg[b] - cg[at], ch[b] - ch[at]
            gain = np.where((lh >= LEAST_HESSIAN) & (rh >= LEAST_HESSIAN), _gain(lg, lh) + _gain(rg, rh) - _gain(cg[b] - cg[a], ch[b] - ch[a]), 0.0)
            i = int(gain.argmax())
            best = max(best, (float(gain[i]), k, int(at[i])))
        if not best[2]:
            break
        a, b = leaves[best[1]]
        leaves[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + RIDGE)
    return out


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree with one cut in each direction over a grid: its gain, and the step of each cell."""

    def quadrants(x: np.ndarray) -> list[np.ndarray]:
        c = np.zeros((x.shape[0] + 1, x.shape[1] + 1))
        c[1:, 1:] = x.cumsum(0).cumsum(1)
        low = c[1:-1, 1:-1]
        return [low, c[1:-1, -1:] - low, c[-1:, 1:-1] - low, c[-1, -1] - c[1:-1, -1:] - c[-1:, 1:-1] + low]

    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)
    qg, qh = quadrants(g), quadrants(h)
    enough = np.minimum.reduce(qh) >= LEAST_HESSIAN
    gain = np.where(enough, sum(map(_gain, qg, qh)) - _gain(g.sum(), h.sum()), 0.0)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    if gain[i, j] <= 1e-9:
        return 0.0, np.zeros(g.shape)
    step = np.zeros(g.shape)
    sides = ((slice(None, i + 1), slice(None, j + 1)), (slice(None, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(None, j + 1)), (slice(i + 1, None), slice(j + 1, None)))
    for side, a, b in zip(sides, qg, qh, strict=True):
        step[side] = a[i, j] / (b[i, j] + RIDGE)
    return float(gain[i, j]), step


def train(x: np.ndarray, y: np.ndarray) -> Model:
    if not len(y):
        return Model()
    rate = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(math.log(rate / (1 - rate)))
    if y.min() == y.max():
        return model
    z = np.full(len(y), model.base)

    def slopes(bins: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return np.bincount(bins, y - p, n), np.bincount(bins, p * (1 - p), n)

    singles = [Table((f,), (e := _edges(x[:, f], BINS),), np.zeros(len(e) + 1)) for f in range(x.shape[1])]
    places = [t.bins(x) for t in singles]
    for _ in range(ROUNDS):
        for t, at in zip(singles, places, strict=True):
            step = RATE * _tree(*slopes(at, len(t.values)))
            t.values += step
            z += step[at]
    coarse = [_edges(x[:, f], PAIR_BINS) for f in range(x.shape[1])]
    pairs = [Table((a, b), (coarse[a], coarse[b]), np.zeros((len(coarse[a]) + 1) * (len(coarse[b]) + 1))) for a, b in combinations(range(x.shape[1]), 2)]

    def cross(t: Table, at: np.ndarray) -> tuple[float, np.ndarray]:
        shape = tuple(len(e) + 1 for e in t.edges)
        gain, step = _cross(*(s.reshape(shape) for s in slopes(at, len(t.values))))
        return gain, step.ravel()

    ranked = sorted(((cross(t, t.bins(x))[0], t) for t in pairs), key=lambda r: -r[0])[:PAIRS]
    chosen = [(t, t.bins(x)) for gain, t in ranked if gain > 0]
    for _ in range(PAIR_ROUNDS):
        for t, at in chosen:
            step = RATE * cross(t, at)[1]
            t.values += step
            z += step[at]
    model.tables = singles + [t for t, _ in chosen]
    return model


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    at = b.schema.get_field_index("text")
    return np.array([features(t) for part in slices(b) for t in part.column(at).cast(pa.binary()).to_pylist()], float).reshape(-1, len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = TRAIN_DOCS) -> Model:
    schema = pa.schema([("x", pa.list_(pa.float64())), ("y", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_matrix(b).tolist(), schema[0].type), b.column(b.schema.get_field_index("y"))], schema=schema)

    rows = written(labelled(docs, labels, label, limit).mapInArrow(run, "x array<double>, y int"), "quality_sample").collect()  # bounded by ``limit``
    rows = sorted((tuple(r["x"]), r["y"]) for r in rows)
    return train(np.array([x for x, _ in rows]).reshape(-1, len(FEATURES)), np.array([y for _, y in rows], float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent.value.scores(_matrix(b)), pa.float64())], names=["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double")
