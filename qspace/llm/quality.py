"""Quality rules: fixed base rules and gradient-boosted trees over document statistics.

Statistics of a whole text go into one row of numbers. Trees are grown on a bounded sample of labelled rows (SAMPLE, those with the
smallest hash of their id) by histograms of bins, with a logistic loss; splits on features with a sign in MONOTONE may only move the
score that way. The trees are then flattened into node arrays, complete to one depth, and a whole batch is scored by stepping all
its rows through all trees at once.

Defined cases: a null text has no words and fails the base rules; null or missing labels are not learnt from, and without any label
only the base rules decide; repeated rows are scored alike; an empty table gives an empty result; other columns are ignored by
quality() and kept by quality_filter().
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qspace.llm.common import arrow_map, records, stage

SAMPLE = 20_000
MIN_WORDS, MAX_REPEATED, WINDOW = 20, 30, 8
SYMBOLS = "#*$%&|<>"
THRESHOLD = 0.3
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words", "word_length", "symbols", "dup_lines", "repeated", "capitals", "digits", "marks", "shouts", "distinct", "short_words", "line_words"
)
#: More symbols, repeated lines, repeated words and exclamation marks never raise a score.
MONOTONE = {"symbols": -1, "dup_lines": -1, "repeated": -1, "shouts": -1}
BINS, DEPTH, TREES, RATE, LAMBDA, MIN_HESSIAN = 48, 4, 60, 0.15, 2.0, 3.0
_FACTORS = np.random.default_rng(8).integers(1, 2**63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CAPITALS, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window of words found twice or more. Windows of one hash are compared word by word."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    h = np.zeros(n, np.uint64)
    for j in range(window):
        h += ids[j : j + n].astype(np.uint64) * _FACTORS[j]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    first = np.concatenate([[False], same])
    leader = np.maximum.accumulate(np.where(first, 0, np.arange(n)))
    twice = np.flatnonzero(first)
    a, b = order[leader[twice]], order[twice]
    if all(np.array_equal(ids[a + j], ids[b + j]) for j in range(window)):
        starts = np.zeros(n, bool)
        starts[a] = starts[b] = True
    else:
        seen: dict[tuple, int] = {}
        keys = [tuple(ids[i : i + window]) for i in range(n)]
        for k in keys:
            seen[k] = seen.get(k, 0) + 1
        starts = np.array([seen[k] > 1 for k in keys])
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(starts)
    edge[at] += 1
    edge[at + window] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(text: str) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The counts of COUNTS and the values of FEATURES. bytes.split() splits at just the white space that is meant."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return (0, 0, sum(map(text.count, SYMBOLS)), 0, 0), (0.0,) * len(FEATURES)
    index: dict[bytes, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for w in words], np.int64)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    dup = len(lines) - len(set(lines))
    again = repeated_words(ids) if len(index) < n else 0
    size = len(raw)
    features = (
        float(np.log1p(n)), chars / n, symbols / n, dup / len(lines), again / n, (size - len(raw.translate(None, _CAPITALS))) / size,
        (size - len(raw.translate(None, _DIGITS))) / size, (raw.count(b".") + raw.count(b",")) / n, raw.count(b"!") / n, len(index) / n,
        sum(map(len, words)) / n / max(map(len, words)), n / len(lines),
    )
    return (n, chars, symbols, dup, again), features


def base_failed(counts: tuple[int, ...]) -> bool:
    return counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEATED * counts[0]


@dataclass
class Trees:
    """Complete binary trees as arrays: of node i the children are 2i + 1 and 2i + 2."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.feature):
            return np.full(len(x), 1 / (1 + np.exp(-self.bias)))
        node = np.zeros((len(x), len(self.feature)), np.int64)
        tree, row = np.arange(len(self.feature))[None, :], np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            right = x[row, self.feature[tree, node]] > self.threshold[tree, node]
            node = 2 * node + 1 + right
        return 1 / (1 + np.exp(-(self.bias + self.value[tree, node].sum(axis=1))))


def _split(binned: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float, signs: np.ndarray) -> tuple | None:
    """The best (gain, feature, bin, left value, right value) that the signs allow."""
    total_g, total_h = g.sum(), h.sum()
    best, parent = None, total_g**2 / (total_h + LAMBDA)
    for f in range(binned.shape[1]):
        gl = np.cumsum(np.bincount(binned[:, f], g, BINS))[:-1]
        hl = np.cumsum(np.bincount(binned[:, f], h, BINS))[:-1]
        gr, hr = total_g - gl, total_h - hl
        wl, wr = np.clip(-gl / (hl + LAMBDA), low, high), np.clip(-gr / (hr + LAMBDA), low, high)
        gain = gl**2 / (hl + LAMBDA) + gr**2 / (hr + LAMBDA) - parent
        gain[(hl < MIN_HESSIAN) | (hr < MIN_HESSIAN) | (signs[f] * (wr - wl) < 0)] = -1
        k = int(np.argmax(gain))
        if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
            best = (gain[k], f, k, wl[k], wr[k])
    return best


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    if not len(y):
        return Trees(np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 1)), 0.0)
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(prior / (1 - prior)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    signs = np.array([MONOTONE.get(name, 0) for name in FEATURES])
    nodes = 2 ** (DEPTH + 1) - 1
    feature, threshold, value = (np.zeros((TREES, nodes), t) for t in (np.int64, float, float))
    score = np.full(len(y), bias)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        threshold[t] = np.inf
        level = [(0, np.arange(len(y)), -np.inf, np.inf, float(-g.sum() / (h.sum() + LAMBDA)))]
        for _ in range(DEPTH):
            following = []
            for node, rows, low, high, now in level:
                found = _split(binned[rows], g[rows], h[rows], low, high, signs) if len(rows) > 1 else None
                if found is None:  # all rows go left, with the same value
                    following += [(2 * node + 1, rows, low, high, now), (2 * node + 2, rows[:0], low, high, now)]
                    continue
                _, f, k, wl, wr = found
                feature[t, node], threshold[t, node] = f, edges[f][k] if k < len(edges[f]) else np.inf
                left = binned[rows, f] <= k
                middle = (wl + wr) / 2
                bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}.get(signs[f], ((low, high), (low, high)))
                following += [(2 * node + 1, rows[left], *bounds[0], wl), (2 * node + 2, rows[~left], *bounds[1], wr)]
            level = following
        for node, rows, _, _, now in level:
            value[t, node] = RATE * now
            score[rows] += RATE * now
    return Trees(feature, threshold, value, bias)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(label, list(statistics(text or "")[1])) for label, text in records(batch, "label", "text")]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], names=["label", "x"]
        )


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Trees:
    """Trees from at most so many labelled rows; the sample is broadcast to the documents, its statistics come to the driver."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).cast("int").alias("label"))
    known = stage(known.orderBy(F.xxhash64("__id"), "__id").limit(sample), "labels")
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(known), "__id")
    got = arrow_map(rows.select("label", "text"), _featured, "label int, x array<double>").toPandas()
    got = got.assign(key=[tuple(v) for v in got["x"]]).sort_values(["key", "label"])  # the order of rows must not matter
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES))
    return fit(x, got["label"].to_numpy(float))


def _judge(model: Trees, batch: pa.RecordBatch, text_col: str, threshold: float) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    rows = [statistics(text or "") for (text,) in records(batch, text_col)]
    counts = [r[0] for r in rows]
    failed = np.array([base_failed(c) for c in counts], bool)
    score = model.score(np.array([r[1] for r in rows], float).reshape(len(rows), len(FEATURES)))
    return counts, failed, score, ~failed & (score >= threshold)


def quality(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the counts, base_failed, kept and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, failed, score, kept = _judge(model, batch, "text", threshold)
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(COUNTS))]
            arrays = [batch.column("doc_id"), *columns, pa.array(failed), pa.array(kept), pa.array(score)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *COUNTS, "base_failed", "kept", "score"])

    schema = f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, kept boolean, score double"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(rows, run, schema)


def quality_filter(docs: DataFrame, model: Trees, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that are kept, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_judge(model, batch, text_col, threshold)[3]))

    return arrow_map(docs, run, docs.schema)
