"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds to them.

The fixed patterns give spans of three kinds. The field tags every token of a text as a secret's begin, inside or outside, and texts are
decoded exactly by Viterbi, with outside on both ends. A token's features are its shape, its neighbouring words and signs, and features
of its file. It is trained on runs of tokens of a bounded sample of documents (SAMPLE, those with the smallest hash of their id, and of
these at most RUNS runs, those with a span first), the fixed patterns' spans being its labels; its spans are added with the kind "field" beside the fixed ones,
which stay as they are.

Defined cases: null and empty texts have no spans; a sample without a span trains a field that adds nothing; repeated rows are
scanned alike; null ids are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qspace.llm.common import arrow_map, records, stage

# The patterns and the least length of what they must match.
KINDS = ("assign", "access", "hex")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of [0-9a-f]+ with so many characters
LEAST_VALUE, LEAST_ACCESS = 12, 18
PADDING = re.compile(r"(?:={1,2}(?![^\s\"'`,;)\]}>]))?")  # of base64

SAMPLE, RUNS = 4_000, 20_000
#: Runs without a span are plenty and alike: so many of them are enough beside all that have one.
OTHERS = 4_000
#: Training runs have so many tokens at least; they are cut only between tokens outside of all spans.
WINDOW = 8
#: Tokens are what stands between these signs and white space.
SEPARATORS = "\"'`:=,;()[]{}<>|"
SPACES = (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
KEYWORD = re.compile("|".join(f"({k})" for k in sorted(KEYWORDS, key=len, reverse=True)), re.I | re.A)
BEGIN, INSIDE, OUTSIDE = 0, 1, 2
EPOCHS, STEP, RIDGE = 80, 0.15, 1e-3
_KINDS = (SEPARATORS + " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f", " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "={}:;\"'", ".")
_BREAK, _BLANK, _DIGIT, _UPPER, _LOWER, _HEX, _SIGN, _DOT = range(8)
#: For each sign the kinds that it is of, a bit each; signs beyond ASCII are of none.
_FLAGS = bytes(sum((chr(c) in kind) << k for k, kind in enumerate(_KINDS)) if c < 128 else 0 for c in range(256))


def holds_keyword(text: str) -> bool:
    """Whether the patterns for keywords, which are much slower, can match at all."""
    low = text.lower()
    return any(k in low for k in KEYWORDS)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), leftmost and without overlaps within a kind, by start and then kind as listed."""
    found = []
    if holds_keyword(text):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _levels(values: np.ndarray, *edges: float) -> np.ndarray:
    return np.searchsorted(edges, values, side="right")


#: How many values each column of features has.
SIZES = (16, 7, 6, 2, 4, 5, 5, 8, 8, 4, 4, 3, 2, 4, 2, 4, 4)
OFFSETS = np.cumsum((0, *SIZES))


def tokens(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all tokens, and a row of features of each, numbered over all columns."""
    if text.isascii():
        codes = chars = np.frombuffer(text.encode(), np.uint8)
    else:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        chars = np.minimum(codes, 128).astype(np.uint8)
    flags = np.frombuffer(chars.tobytes().translate(_FLAGS), np.uint8)

    def of(kind: int) -> np.ndarray:
        return flags >> kind & 1

    apart, blank = of(_BREAK).astype(bool), of(_BLANK).astype(bool)
    if codes is not chars:
        beyond = np.flatnonzero(codes > 127)
        beyond = beyond[np.isin(codes[beyond], SPACES)]
        apart[beyond] = blank[beyond] = True
    edges = np.flatnonzero(np.diff(np.concatenate([[True], apart, [True]])))
    a, b = edges[::2], edges[1::2]
    if not len(a):
        return a, b, np.zeros((0, len(SIZES)), np.int64)
    n = b - a

    def count(on: np.ndarray) -> np.ndarray:
        """How often on is set in each token; the sign after the last one is none."""
        return np.add.reduceat(np.append(on, on.dtype.type(0)), edges, dtype=np.int64)[::2]

    def changed(on: np.ndarray) -> np.ndarray:
        differs = np.zeros(len(on), np.uint8)
        np.not_equal(on[1:], on[:-1], out=differs[1:].view(bool))
        return count(differs) - differs[a]

    is_digit = of(_DIGIT)
    digits, upper, lower = count(is_digit), count(of(_UPPER)), count(of(_LOWER))
    rest = n - digits - upper - lower
    same = n - 1 - changed(codes)
    key = np.zeros(len(a), np.int64)
    for m in KEYWORD.finditer(text) if holds_keyword(text) else ():
        at = int(np.searchsorted(a, m.start(), side="right")) - 1
        key[at] = m.lastindex
    before, second = np.concatenate([[7], key[:-1]]), np.concatenate([[7, 7], key])[: len(a)]
    dark = np.flatnonzero(~blank)
    at = np.searchsorted(dark, a) - 1  # the last sign before a token that is no white space
    at = np.where(at >= 0, dark[np.maximum(at, 0)], -1)
    left = np.where(at >= 0, chars[np.maximum(at, 0)], 0)
    sign = np.select([at < 0, left == ord("="), left == ord(":"), left == ord('"')], [0, 1, 2, 3], 4)
    after = np.where(b < len(chars), chars[np.minimum(b, len(chars) - 1)], 0)
    keyed = (before > 0) & (before < 7)
    file_signs = int(_levels(of(_SIGN).mean(), 0.005, 0.02, 0.08))
    columns = [
        (digits > 0) + 2 * (upper > 0) + 4 * (lower > 0) + 8 * (rest > 0), _levels(n, 16, 20, 24, 32, 40, 64), _levels(digits / n, 0.05, 0.2, 0.4, 0.7, 1.0), count(of(_HEX)) == n,
        _levels(same / n, 0.1, 0.3, 0.6), _levels(changed(is_digit) / n, 0.05, 0.15, 0.3, 0.5), sign, before, second, keyed + 2 * ((sign > 0) & (sign < 4)),
        np.select([after == ord('"'), after == 0, after == ord(" ")], [0, 1, 2], 3), _levels(count(of(_DOT)), 1, 3), key > 0, _levels(rest / n, 0.01, 0.2, 0.5),
        (chars[a] == ord("A")) & (n > 3) & np.array([text.startswith("AKIA", i) for i in a]) if "AKIA" in text else np.zeros(len(a), bool),
        np.full(len(a), file_signs), np.full(len(a), _levels(len(a), 10, 100, 1000)),
    ]
    return a, b, np.stack(columns, axis=1).astype(np.int64) + OFFSETS[:-1]


def sequences(text: str) -> Iterator[tuple[list[tuple[int, int]], list[list[int]]]]:
    """All tokens of a text as one run, as (start, end), with their features."""
    a, b, x = tokens(text)
    if len(a):
        yield list(zip(a.tolist(), b.tolist(), strict=True)), x.tolist()


def tags(run: list[tuple[int, int]], spans: list[tuple[str, int, int]]) -> list[int]:
    """Training labels: a token that a span covers for the most part begins a secret, or is inside of the one before. A keyword, with
    which a span of the first kind begins, is none.
    """
    out, last = [], None
    for a, b in run:
        span = next((s for s in spans if min(b, s[2]) - max(a, s[1]) > (b - a) / 2 and not (s[0] == "assign" and a <= s[1] < b)), None)
        out.append(OUTSIDE if span is None else INSIDE if last is not None and span == last else BEGIN)
        last = span
    return out


def windows(text: str) -> Iterator[tuple[int, list[list[int]], list[int]]]:
    """Training runs, as (start, features, labels). What follows a keyword but is too short for the patterns has no known label: runs
    that hold it are left out.
    """
    spans = base_spans(text)
    short = [m.span(1) for m in ASSIGN.finditer(text) if len(m[1]) < LEAST_VALUE]
    for run, x in sequences(text):
        y = tags(run, spans)
        unknown = {i for s in short for i in range(bisect_right(run, (s[0], len(text))) - 1, len(run)) if run[i][0] < s[1]} if short else set()
        begin = 0
        for i in range(1, len(run) + 1):
            if i == len(run) or (i - begin >= WINDOW and y[i - 1] == y[i] == OUTSIDE):
                if not any(k in unknown and y[k] == OUTSIDE for k in range(begin, i)):
                    yield run[begin][0], x[begin:i], y[begin:i]
                begin = i


@dataclass
class Field:
    """Emission weights by feature and tag, and transition weights; runs have outside before and after."""

    index: dict[int, int]
    emit: np.ndarray
    move: np.ndarray

    def viterbi(self, features: list[list[int]]) -> list[int]:
        if not self.index:
            return [OUTSIDE] * len(features)
        score, back = self.move[OUTSIDE], []
        for t, names in enumerate(features):
            e = self.emit[[self.index[f] for f in names if f in self.index]].sum(axis=0)
            if t:
                options = score[:, None] + self.move
                back.append(options.argmax(axis=0))
                score = options.max(axis=0) + e
            else:
                score = score + e
        path = [int((score + self.move[:, OUTSIDE]).argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]

    @cached_property
    def table(self) -> np.ndarray:
        """Emission weights of all features, those that training did not see at zero."""
        out = np.zeros((OFFSETS[-1], 3))
        out[list(self.index)] = self.emit
        return out

    def decode(self, x: np.ndarray) -> np.ndarray:
        """viterbi() over all tokens. Where outside is better whatever the tags beside it are, it is in the best path; what lies between
        such tokens is decoded by itself.
        """
        e = self.table[x[:, 0]]
        for c in range(1, x.shape[1]):
            e += self.table[x[:, c]]
        gain = (self.move - self.move[:, OUTSIDE:]).max(axis=0) + (self.move - self.move[OUTSIDE]).max(axis=1)
        path = np.full(len(x), OUTSIDE)
        at = np.flatnonzero((e[:, :OUTSIDE] + gain[:OUTSIDE] >= e[:, OUTSIDE:]).any(axis=1))
        if not len(at):
            return path
        move = self.move.tolist()
        for part in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
            score, back = None, []
            for row in e[part].tolist():
                if score is None:
                    score = [move[OUTSIDE][k] + row[k] for k in range(3)]
                    continue
                best = [max(range(3), key=[score[j] + move[j][k] for j in range(3)].__getitem__) for k in range(3)]
                score = [score[best[k]] + move[best[k]][k] + row[k] for k in range(3)]
                back.append(best)
            tag = max(range(3), key=[score[k] + move[k][OUTSIDE] for k in range(3)].__getitem__)
            path[part[-1]] = tag
            for t, best in zip(part[-2::-1], reversed(back), strict=True):
                tag = best[tag]
                path[t] = tag
        return path

    def spans(self, text: str) -> list[tuple[int, int]]:
        a, b, x = tokens(text)
        if not self.index or not len(a):
            return []
        path, out, last = self.decode(x), [], -2
        for t in np.flatnonzero(path != OUTSIDE).tolist():
            if path[t] == INSIDE and last == t - 1:
                out[-1] = (out[-1][0], int(b[t]))
            else:
                out.append((int(a[t]), int(b[t])))
            last = t
        return [(s, e + len(PADDING.match(text, e)[0])) for s, e in out]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def fit(data: list[tuple[list[list[int]], list[int]]]) -> Field:
    """Maximum likelihood by gradient steps; marginals come from forward and backward sums over runs of one length at a time."""
    names = sorted({f for features, _ in data for token in features for f in token})
    index = {f: i for i, f in enumerate(names)}
    if not any(t != OUTSIDE for _, y in data for t in y):
        return Field({}, np.zeros((0, 3)), np.zeros((3, 3)))
    by_length: dict[int, list[int]] = {}
    for i, (features, _) in enumerate(data):
        by_length.setdefault(len(features), []).append(i)
    width = max(len(token) for features, _ in data for token in features)
    numbers: dict[tuple, int] = {}  # tokens of the same features are summed once
    groups = []
    for length, rows in sorted(by_length.items()):
        x = np.array([[numbers.setdefault(tuple(token), len(numbers)) for token in data[i][0]] for i in rows])
        groups.append((x, np.array([data[i][1] for i in rows])))
    kinds = np.full((len(numbers), width), len(names))  # the last row of the weights stays zero
    for token, k in numbers.items():
        kinds[k, : len(token)] = [index[f] for f in token]
    emit, move = np.zeros((len(names) + 1, 3)), np.zeros((3, 3))
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in (emit, move)]
    total = len(data)
    for epoch in range(1, EPOCHS + 1):
        g_emit, g_move = RIDGE * emit, RIDGE * move
        e_kinds, g_kinds = emit[kinds].sum(axis=1), np.zeros((len(kinds), 3))
        for x, y in groups:
            n, length = x.shape
            e = e_kinds[x]
            fore, aft = np.zeros((n, length, 3)), np.zeros((n, length, 3))
            fore[:, 0] = move[OUTSIDE] + e[:, 0]
            for t in range(1, length):
                fore[:, t] = _log_sum(fore[:, t - 1, :, None] + move, 1) + e[:, t]
            aft[:, -1] = move[:, OUTSIDE]
            for t in range(length - 2, -1, -1):
                aft[:, t] = _log_sum(move + (e[:, t + 1] + aft[:, t + 1])[:, None, :], 2)
            z = _log_sum(fore[:, -1] + move[:, OUTSIDE], 1)
            p = np.exp(fore + aft - z[:, None, None])
            d = p.copy()
            d[np.arange(n)[:, None], np.arange(length)[None, :], y] -= 1
            for tag in range(3):
                g_kinds[:, tag] += np.bincount(x.ravel(), d[:, :, tag].ravel(), len(kinds))
            g_move[OUTSIDE] += d[:, 0].sum(axis=0) / total
            g_move[:, OUTSIDE] += d[:, -1].sum(axis=0) / total
            for t in range(1, length):
                pair = np.exp(fore[:, t - 1, :, None] + move + (e[:, t] + aft[:, t])[:, None, :] - z[:, None, None])
                g_move += pair.sum(axis=0) / total
                np.subtract.at(g_move, (y[:, t - 1], y[:, t]), 1 / total)
        for tag in range(3):
            g_emit[:, tag] += np.bincount(kinds.ravel(), np.repeat(g_kinds[:, tag], width), len(names) + 1) / total
        for w, g, (m, v) in zip((emit, move), (g_emit, g_move), moments, strict=True):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            w -= STEP * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-8)
        emit[-1] = 0
    return Field(index, emit[:-1], move)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text in records(batch, "doc_id", "text"):
            rows += [(doc_id, *w) for w in windows(text or "")]
        types = (pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int32())), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["doc_id", "at", "x", "y"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, most: int = RUNS) -> Field:
    key = F.col(id_col).cast("long")
    chosen = docs.select(key.alias("doc_id")).where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(key.alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(stage(chosen, "scan-sample")), "doc_id")
    examples = stage(arrow_map(rows, _examples, "doc_id long, at long, x array<array<int>>, y array<int>"), "scan-runs")
    spanned = F.exists("y", lambda tag: tag != OUTSIDE)
    got: list = []
    for some, limit in ((spanned, most), (~spanned, OTHERS)):
        got += examples.where(some).orderBy(F.xxhash64("doc_id", "at"), "doc_id", "at").limit(min(limit, most - len(got))).collect()
    return fit([([list(t) for t in r["x"]], list(r["y"])) for r in got])


def secret_spans(text: str, field: Field) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The fixed spans, and all spans: these and the field's, which may overlap them."""
    base = base_spans(text)
    more = [("field", a, b) for a, b in field.spans(text)]
    return base, sorted(base + more, key=lambda s: (s[1], (*KINDS, "field").index(s[0])))


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def scan(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the number of spans of each fixed kind, the digest of the fixed spans, and all spans, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in records(batch, "doc_id", "text"):
                base, spans = secret_spans(text or "", field)
                counts = [sum(s[0] == kind for s in base) for kind in KINDS]
                rows.append((doc_id, *counts, hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
            types = (*[pa.int64()] * 4, pa.string(), pa.string())
            names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(rows, run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
