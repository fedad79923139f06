"""Quality classifier: a generalised additive model with pairwise interactions.

Features are shares and means of a text's characters, words and lines, counted for all texts of an Arrow batch at once. Each
is cut into quantile bins. Boosting goes round the features again and again; each visit fits a shallow tree of one feature
(at most two levels of cuts over its bins) to the loss's gradient and adds it to the feature's table. The pairs whose
quadrant trees lower the remaining loss most then get tables of two features the same way. A score adds up bins of
the tables, and a logistic function makes it a share.

The model is fitted on the driver from a bounded sample of labelled rows (max_rows, lowest hashes of doc_id first), of
which only features arrive there. Scores use the text alone.

Rows: a null or empty text has features of 0 and a score; texts of any length are read whole; repeated rows and null doc_ids
are scored each; labels that are null or without a document are not learned from; other columns are not read; an empty
table gives no rows, and without labels of both kinds every score is the share of label 1, or a half.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import span_hashes, text_bytes
from .common import table
from .toxicity import sample, training_labels

#: Bins of a feature, rounds of the features and of the pairs, pairs, learning rate, and the least rows of a leaf.
BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, LEAF = 32, 120, 60, 8, 0.15, 20
#: Bytes of texts whose features are counted at a time, if a text isn't longer.
WINDOW = 2_000_000

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (9, 11, 12, 13, 32), "stop": (33, 44, 46, 58, 59, 63),
    "symbol": (35, 36, 37, 38, 42, 60, 62, 64, 94, 124, 126), "bracket": (40, 41, 47, 91, 92, 93, 95, 123, 125), "bang": (33,), "line": (10,), "high": range(128, 256),
}
NAMES = [*(f"share_{c}" for c in _CLASSES), "words", "word_bytes", "word_bytes_sd", "long_words", "different_words", "commonest_word", "line_words", "same_lines", "same_pairs", "shout_words", "signed_words"]


def _per_text(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[begin[1:]] - total[begin[:-1]]


def _different(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Different keys of each text, and how often the commonest comes."""
    mixed = keys * np.uint64(0x9E3779B97F4A7C15) ^ (owner.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    _, first, times = np.unique(mixed, return_index=True, return_counts=True)
    most = np.zeros(n)
    np.maximum.at(most, owner[first], times)
    return np.bincount(owner[first], minlength=n).astype(float), most


def features(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A row of features for each text; data: bytes of all texts, begin: where each begins, with the end."""
    n = begin.size - 1
    size = np.maximum(np.diff(begin), 1).astype(float)
    out = np.zeros((n, len(NAMES)))
    col = iter(range(len(NAMES)))
    for codes in _CLASSES.values():
        flag = np.zeros(256, np.uint8)
        flag[list(codes)] = 1
        out[:, next(col)] = _per_text(flag[data], begin) / size
    if not data.size:
        return out
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    inside = ~space[data]
    edge = np.zeros(data.size, bool)
    edge[begin[:-1][begin[:-1] < data.size]] = True
    starts = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | edge))
    stops = np.flatnonzero(inside & np.concatenate([~inside[1:] | edge[1:], [True]])) + 1
    owner = np.searchsorted(begin, starts, side="right") - 1
    words = np.bincount(owner, minlength=n).astype(float)
    some = np.maximum(words, 1)
    length = (stops - starts).astype(float)
    mean = np.bincount(owner, length, n) / some
    out[:, next(col)] = np.log1p(words)
    out[:, next(col)] = mean
    out[:, next(col)] = np.sqrt(np.maximum(np.bincount(owner, length**2, n) / some - mean**2, 0))
    out[:, next(col)] = np.bincount(owner, length > 12, n) / some
    h = span_hashes(data, starts, stops)
    kinds, most = _different(h, owner, n)
    # different words fall behind as a text grows; their share is taken against a power of the words
    out[:, next(col)] = kinds / some**0.9
    out[:, next(col)] = most / some
    at = np.flatnonzero((data == 10) | edge)
    line_from = at + (data[at] == 10)
    line_to = np.append(at[1:], data.size)
    full = line_from < line_to
    line_from, line_to = line_from[full], line_to[full]
    of = np.searchsorted(begin, line_from, side="right") - 1
    lines = np.bincount(of, minlength=n).astype(float)
    out[:, next(col)] = np.log1p(words / np.maximum(lines, 1))
    kinds, _ = _different(span_hashes(data, line_from, line_to), of, n)
    out[:, next(col)] = 1 - kinds / np.maximum(lines, 1)
    near = owner[1:] == owner[:-1]
    pair, pair_of = (h[1:] * np.uint64(3) + h[:-1])[near], owner[1:][near]
    kinds, _ = _different(pair, pair_of, n)
    out[:, next(col)] = 1 - kinds / np.maximum(np.bincount(pair_of, minlength=n), 1)
    upper, lower, sign = (np.concatenate([[0], np.cumsum(f)]) for f in ((data >= 65) & (data <= 90), (data >= 97) & (data <= 122), ((data >= 33) & (data <= 47)) | ((data >= 58) & (data <= 64)) | ((data >= 91) & (data <= 96)) | (data >= 123) & (data <= 126)))
    within = lambda c: c[stops] - c[starts]
    out[:, next(col)] = np.bincount(owner, (within(upper) > 1) & (within(lower) == 0), n) / some
    out[:, next(col)] = np.bincount(owner, within(sign) > 1, n) / some
    return out


def feature_windows(texts: pa.Array) -> np.ndarray:
    data, begin = text_bytes(texts)
    out, i, n = [np.zeros((0, len(NAMES)))], 0, begin.size - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(begin, begin[i] + WINDOW, side="right")) - 1)
        out.append(features(data[begin[i] : begin[j]], begin[i : j + 1] - begin[i]))
        i = j
    return np.concatenate(out)


def _split(g: np.ndarray, h: np.ndarray, c: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of bins with gradient, curvature and row sums; leaves keep at least LEAF rows."""
    gs, hs, cs = np.cumsum(g), np.cumsum(h), np.cumsum(c)
    left = gs[:-1] ** 2 / (hs[:-1] + 1)
    right = (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1)
    gain = np.where((cs[:-1] >= LEAF) & (cs[-1] - cs[:-1] >= LEAF), left + right - gs[-1] ** 2 / (hs[-1] + 1), -1.0)
    k = int(np.argmax(gain)) if gain.size else 0
    return (float(gain[k]) if gain.size else -1.0), k + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, c: np.ndarray, depth: int = 2) -> np.ndarray:
    """A step for each bin."""
    if depth and g.size > 1:
        gain, k = _split(g, h, c)
        if gain > 1e-6:
            return np.concatenate([shallow_tree(g[:k], h[:k], c[:k], depth - 1), shallow_tree(g[k:], h[k:], c[k:], depth - 1)])
    return np.full(g.size, g.sum() / (h.sum() + 1))


def quadrant_tree(g: np.ndarray, h: np.ndarray, c: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and steps of the best tree that cuts one feature once and the other once on either side."""
    best, steps = 0.0, np.full(g.shape, g.sum() / (h.sum() + 1))
    for turn in (False, True):
        G, H, C = (x.T if turn else x for x in (g, h, c))
        gains = []
        for k in range(1, len(G)):
            lo, hi = (_split(x[0], x[1], x[2]) for x in ((G[:k].sum(0), H[:k].sum(0), C[:k].sum(0)), (G[k:].sum(0), H[k:].sum(0), C[k:].sum(0))))
            base = sum(x.sum() ** 2 / (y.sum() + 1) for x, y in ((G[:k], H[:k]), (G[k:], H[k:]))) - G.sum() ** 2 / (H.sum() + 1)
            gains.append((base + max(lo[0], 0) + max(hi[0], 0), k, lo, hi))
        gain, k, lo, hi = max(gains, key=lambda x: x[0])
        if gain > best:
            out = np.empty(G.shape)
            for rows, (won, cut) in ((slice(0, k), lo), (slice(k, None), hi)):
                for cols in (slice(0, cut), slice(cut, None)) if won > 0 else (slice(None),):
                    out[rows, cols] = G[rows, cols].sum() / (H[rows, cols].sum() + 1)
            best, steps = gain, out.T if turn else out
    return best, steps


@dataclass
class Model:
    cuts: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], 1) if self.cuts else np.zeros((len(x), 0), int)

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, out = self.bins(x), np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            out += t[b[:, j]]
        for i, j, t in self.pairs:
            out += t[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """x: a row of features for each label of y."""
    m = Model()
    n, rate = len(y), float(np.mean(y)) if len(y) else 0.5
    m.base = math.log(max(rate, 1e-6) / max(1 - rate, 1e-6))
    if not n or not 0 < rate < 1:
        m.base = 0.0 if not n else math.copysign(6.0, rate - 0.5)
        return m
    m.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    b = m.bins(x)
    sizes = [len(c) + 1 for c in m.cuts]
    m.tables = [np.zeros(s) for s in sizes]
    z = np.full(n, m.base)
    counts = [np.bincount(b[:, j], minlength=s) for j, s in enumerate(sizes)]
    for _ in range(ROUNDS):
        for j, s in enumerate(sizes):
            p = 1 / (1 + np.exp(-z))
            step = RATE * shallow_tree(np.bincount(b[:, j], y - p, s), np.bincount(b[:, j], p * (1 - p), s), counts[j])
            m.tables[j] += step
            z += step[b[:, j]]
    m.coarse = [np.arange(s) * min(8, s) // s for s in sizes]
    k = [int(c[-1]) + 1 for c in m.coarse]
    c = np.stack([m.coarse[j][b[:, j]] for j in range(len(sizes))], 1)

    def grids(i: int, j: int, p: np.ndarray) -> tuple[np.ndarray, ...]:
        at = c[:, i] * k[j] + c[:, j]
        return tuple(np.bincount(at, w, k[i] * k[j]).reshape(k[i], k[j]) for w in (y - p, p * (1 - p), None))

    p = 1 / (1 + np.exp(-z))
    ranked = sorted(((quadrant_tree(*grids(i, j, p))[0], i, j) for i in range(len(sizes)) for j in range(i) if k[i] > 1 and k[j] > 1), reverse=True)[:PAIRS]
    m.pairs = [(i, j, np.zeros((k[i], k[j]))) for _, i, j in ranked]
    for _ in range(PAIR_ROUNDS):
        for i, j, t in m.pairs:
            p = 1 / (1 + np.exp(-z))
            step = RATE * quadrant_tree(*grids(i, j, p))[1]
            t += step
            z += step[c[:, i], c[:, j]]
    return m


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000) -> Model:
    """labels(doc_id, label): 1 for good rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = feature_windows(b.column(0))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "x"])

    rows = sample(docs, labels, max_rows).mapInArrow(run, "label int, x array<double>").toPandas()
    rows = rows[rows["label"].isin([0, 1])]
    x = np.array(rows["x"].tolist()).reshape(len(rows), len(NAMES))
    order = np.lexsort([rows["label"], *x.T])  # the same model however the rows arrive
    return fit(x[order], rows["label"].to_numpy(float)[order])


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """docs(keep..., text) as keep..., score."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(held.value.score(feature_windows(b.column(len(keep)))))], names=[*keep, "score"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{kinds}, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every document's quality score."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, training_labels(table(spark, sf_dir, "labels"), "quality", 4, 2))
    held = F.expr("coalesce(crc32(encode(cast(doc_id as string), 'UTF-8')) % 4 = 2, false)").alias("held_out")
    return score(docs, model, ["doc_id"]).select("doc_id", held, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
