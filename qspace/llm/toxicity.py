"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses and its words are mapped to classes: insult, threat, target, negation, report and other. Three transducers
are composed into one machine that reads a clause's classes: the negation transducer carries a negation over the next few words, the
report transducer marks what follows a verb of saying, the target transducer remembers whether someone is addressed. Each insult or
threat leaves the machine as one of the KINDS with the weight of its pattern, and a clause's end adds what a target before or after it
adds. A text's features are sums over its matched clauses, and a logistic model, fitted with the labels' true rates, makes a score of
them. Its weights are never negative, and what is negated or reported counts in fewer features than what is said plainly: so a match
never lowers a score, and a negation or a verb of saying never raises it.

Insults and threats are patterns over a clause's words, parted and surrounded by single spaces: whole words, beginnings, endings and
insides of words, and two words in a row. They are learnt from one half of the labelled sample, the weights from the other. A
pattern is learnt where the words that it meets follow significantly more different words in toxic texts than in others (CERTAIN, by
the log-likelihood ratio); patterns are chosen by that ratio, each on the words that those before it left unexplained. Words around
matches become targets, negations or reports where they are significantly commoner, or rarer, in toxic texts, and a pattern is a
threat where targets follow it rather than precede it. Fixed words in four languages stand beside what is learnt.

Sample: at most SAMPLE labelled rows of either label, those with the smallest hash of their id; all that is learnt from it is kept,
whatever its number. Labels of held-out rows are never read; an id's labels, language and source are no input.

Defined cases: null and empty texts match nothing and get the score of such texts; null labels are not learnt from; without labels
the fixed words decide by PRIOR; an id with several labels counts as toxic if one says so; repeated rows are scored alike; null ids
are not held out; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qspace.llm.common import arrow_map, records, stage

# The words of each class in English, German, French and Spanish.
INSULTS = (
    "idiot idiots moron morons stupid scum loser losers worthless trash garbage pathetic disgusting clown imbecile filth filthy vermin coward "
    "dummkopf trottel abschaum arschloch connard imbécile ordure crétin imbécil estúpido estúpida basura escoria"
).split()
THREATS = "kill hurt destroy stab shoot umbringen töten verprügeln tuer égorger matar matarte destruir".split()
TARGETS = (
    "you your yours you're he she they him her them his their du dich dir ihr euch sie er ihn tu toi te vous il elle lui eux tú usted ustedes él ella"
).split()
NEGATIONS = "not no never neither nor isn't aren't wasn't don't doesn't didn't without nicht kein keine nie niemals ohne pas jamais sans nunca jamás sin".split()
REPORTS = (
    "said says say claims claimed wrote writes reported quoted quote called calls sagte sagt schrieb behauptet nannte dit disait écrit prétend dijo dice escribió llamó"
).split()
FIXED_WEIGHT = 2.5

SAMPLE = 4_000
#: Lengths of learnt patterns inside one padded word; whole words may be longer.
LENGTHS = range(4, 10)
#: A learnt pattern meets words after so many different ones in toxic texts, is so many times as common there, and by that log-likelihood ratio.
CONTEXTS, RATIO, CERTAIN = 8, 3.0, 12.0
STRONGEST = 5.0
THRESHOLD = 0.3
#: Words over which a negation holds, and a target's distance from a threat.
SCOPE = 3
TARGET_WEIGHT = 1.0
KINDS = ("insult", "negated_insult", "reported_insult", "threat", "negated_threat", "reported_threat")
FEATURES = ("matched", "plain", "threat", "targeted", "strongest", "clauses", "density")
#: Weights of the features and the bias before any label was seen, and how firmly they are held.
PRIOR = np.array([0.3, 0.8, 0.3, 0.3, 0.3, 0.3, 0.3, -3.0])
RIDGE = 0.3
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
_CLAUSE = re.compile(r"[.!?;:\n]+")
_MIXED = re.compile(r"[^\W\d_]+[0-57@$][^\W_]*")
#: Digits and signs that stand for letters inside words.
_PLAIN = str.maketrans("013457@$", "oieastas")


class Transducer:
    """A deterministic weighted transducer: step(state, symbol) gives the next state, the output symbol and a weight."""

    def __init__(self, start, step, final=None):
        self.start, self.step, self.final = start, step, final or (lambda state: 0.0)

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one puts out is read by the other; weights add up."""

        def step(state, symbol):
            a, middle, w = self.step(state[0], symbol)
            b, out, v = other.step(state[1], middle)
            return (a, b), out, w + v

        return Transducer((self.start, other.start), step, lambda state: self.final(state[0]) + other.final(state[1]))


def _negation(left: int, symbol: str):
    if symbol == "negation":
        return SCOPE, "other", 0.0
    if symbol in ("insult", "threat") and left:
        return left - 1, f"negated_{symbol}", 0.0
    return max(0, left - 1), symbol, 0.0


def _report(said: bool, symbol: str):
    if symbol == "report":
        return True, "other", 0.0
    if said and symbol in ("insult", "threat"):
        return said, f"reported_{symbol}", 0.0
    return said, symbol, 0.0


def _target(state: tuple[bool, bool], symbol: str):
    """State: a target was seen, a plain insult or threat was seen; both together weigh more, in either order."""
    target, match = state
    return (target or symbol == "target", match or symbol in ("insult", "threat")), symbol, 0.0


class Machine:
    """The composed grammar with its steps laid out as a table, as far as they have been met."""

    def __init__(self):
        self.grammar = Transducer(0, _negation).then(Transducer(False, _report)).then(
            Transducer((False, False), _target, lambda s: TARGET_WEIGHT if all(s) else 0.0)
        )
        self.table: dict = {}

    def read(self, symbols: list[tuple[str, float]]) -> tuple[list[tuple[str, float]], float]:
        """The matches (kind, weight) of one clause and the weight of its end."""
        state, found, table = self.grammar.start, [], self.table
        for symbol, weight in symbols:
            step = table.get((state, symbol))
            if step is None:
                step = table[(state, symbol)] = self.grammar.step(state, symbol)
            state, out, more = step
            if out in KINDS:
                found.append((out, weight + more))
        return found, self.grammar.final(state)


@dataclass
class Lexicon:
    """Patterns over padded clauses with class and weight, and the class of single words."""

    patterns: dict[str, tuple[str, float]]
    roles: dict[str, str]


@dataclass
class Model:
    """The lexicon, and the logistic weights of FEATURES with the bias last."""

    lexicon: Lexicon
    weights: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def fixed_lexicon() -> Lexicon:
    matches = {f" {w} ": (name, FIXED_WEIGHT) for name, words in (("insult", INSULTS), ("threat", THREATS)) for w in words}
    return Lexicon(matches, {w: name for name, words in (("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS)) for w in words})


def words_of(text: str) -> list[str]:
    return _WORD.findall(text)


def lowered(text: str) -> str:
    """Lower-cased, with digits and signs inside words read as the letters they stand for."""
    low = text.lower()
    return _MIXED.sub(lambda m: m[0].translate(_PLAIN) if len(m[0]) <= 20 else m[0], low)


class Reader:
    """Features of texts. An automaton over all patterns passes the texts and clauses without any."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.machine = lexicon, Machine()
        self.automaton = ahocorasick.Automaton()
        for p, (name, weight) in lexicon.patterns.items():
            self.automaton.add_word(p, (len(p) - 2 if p[-1] == " " else len(p) - 1, name, weight))  # from its last sign to its first
        if lexicon.patterns:
            self.automaton.make_automaton()

    def matches(self, padded: str) -> dict[int, tuple[str, float]]:
        """The heaviest pattern of each word that one ends in, by the word's number in the clause."""
        found: dict[int, tuple[str, float]] = {}
        counted, at = 0, 0
        for stop, (_, name, weight) in self.automaton.iter(padded):
            last = stop - (padded[stop] == " ")  # the last sign of the word that it ends in
            counted += padded.count(" ", at, last)
            at = last
            word = counted - 1
            best = found.get(word)
            if best is None or weight > best[1]:
                found[word] = (name, weight)
        return found

    def symbols(self, words: list[str]) -> tuple[list[tuple[str, float]], dict[int, tuple[str, float]]]:
        found = self.matches(f" {' '.join(words)} ")
        roles = self.lexicon.roles
        return [found.get(i) or (roles.get(w, "other"), 0.0) for i, w in enumerate(words)] if found else [], found

    def clauses(self, text: str) -> Iterator[tuple[list[str], list[tuple[str, float]]]]:
        """Words and symbols of the clauses that hold a match."""
        low = lowered(text)
        if not self.lexicon.patterns or next(self.automaton.iter(f" {' '.join(words_of(low))} "), None) is None:
            return
        for clause in _CLAUSE.split(low):
            words = words_of(clause)
            symbols, found = self.symbols(words) if words else ([], {})
            if found:
                yield words, symbols

    def features(self, text: str) -> list[float]:
        sums = dict.fromkeys(FEATURES, 0.0)
        for _, symbols in self.clauses(text):
            found, end = self.machine.read(symbols)
            plain = sum(w for kind, w in found if kind in ("insult", "threat"))
            sums["matched"] += sum(w for _, w in found)
            sums["plain"] += plain
            sums["threat"] += sum(w for kind, w in found if kind == "threat")
            sums["targeted"] += end
            sums["clauses"] += plain > 0
            sums["strongest"] = max(sums["strongest"], plain + end)
        if sums["plain"]:
            sums["density"] = 100 * sums["plain"] / len(words_of(lowered(text)))
        return [float(np.log1p(sums[f])) for f in FEATURES]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for label, text in records(batch, "label", "text"):
            words = words_of(lowered(text or ""))
            seen = list(set(zip(["", *words], words, [*words[1:], ""], strict=False)))
            for i in range(0, len(seen), 50_000):
                some = seen[i : i + 50_000]
                columns = [pa.array([s[k] for s in some], pa.string()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([label] * len(some), pa.int32())], names=["before", "word", "after", "label"])


def ratio_of(t: float, c: float, nt: float, nc: float) -> float:
    return ((t + 0.5) / (nt + 1)) / ((c + 0.5) / (nc + 1))


def certainty(t: float, c: float, nt: float, nc: float) -> float:
    """The log-likelihood ratio of two counts against one common rate; negative where the rate is lower among nt."""
    share, n = nt / (nt + nc), t + c
    parts = [x * np.log(x / (n * s)) for x, s in ((t, share), (c, 1 - share)) if x]
    return float(sum(parts)) * (1 if t * nc >= c * nt else -1)


def substrings(word: str) -> set[str]:
    """The patterns that meet a word: pieces of the padded word and all of it."""
    padded = f" {word} "
    found = {padded[i : i + n] for n in LENGTHS for i in range(len(padded) - n + 1)}
    found.add(padded)
    return found


def induce(words: Iterable[tuple[str, int, int]], nt: int, nc: int) -> dict[str, float]:
    """Patterns and weights from words and the numbers of their contexts in toxic and in clean texts."""
    words = sorted(words)
    toxic: Counter[str] = Counter()
    for w, t, _ in words:
        if t:
            for p in substrings(w):
                toxic[p] += t
    toxic = {p: t for p, t in toxic.items() if t >= CONTEXTS}
    clean: Counter[str] = Counter()
    for w, _, c in words:
        if c:
            for p in substrings(w):
                if p in toxic:
                    clean[p] += c

    def worth(p: str) -> float:
        t, c = toxic[p], clean[p]
        return certainty(t, c, nt, nc) if t >= CONTEXTS and ratio_of(t, c, nt, nc) >= RATIO else 0.0

    kept = {p for p in toxic if worth(p) >= CERTAIN}
    met: dict[str, list[int]] = defaultdict(list)
    for i, (w, _, _) in enumerate(words):
        for p in substrings(w) & kept:
            met[p].append(i)
    heap = [(-worth(p), -len(p), p) for p in kept]
    heapq.heapify(heap)
    chosen, explained = {}, set()
    while heap:
        value, size, p = heapq.heappop(heap)
        now = worth(p)
        if now < CERTAIN:
            continue
        if now < -value - 1e-9:  # words that it meets were explained since
            heapq.heappush(heap, (-now, size, p))
            continue
        chosen[p] = float(np.clip(np.log(ratio_of(toxic[p], clean[p], nt, nc)), 0.5, STRONGEST))
        for i in met[p]:
            if i not in explained:
                explained.add(i)
                w, t, c = words[i]
                for q in substrings(w) & kept:
                    toxic[q] -= t
                    clean[q] -= c
    return chosen


def _induced(nt: int, nc: int):
    """Runs over all words in one task: their number is bounded by the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(batch.column(n).to_pylist() for n in ("word", "t", "c")), strict=True)]
        found = sorted(induce(rows, nt, nc).items())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.float64()))], names=["pattern", "weight"])

    return run


def _surroundings(lexicon: Lexicon):
    """Words near matches: close before, farther before in the clause, and after; and the patterns' words beside targets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lexicon)
        for batch in batches:
            out: Counter[tuple[str, str, int]] = Counter()
            for label, text in records(batch, "label", "text"):
                seen: set[tuple[str, str]] = set()
                for words, symbols in reader.clauses(text or ""):
                    for i, (kind, _) in enumerate(symbols):
                        if kind in ("insult", "threat"):
                            out[("matches", "", label)] += 1
                            seen |= {("close", w) for w in words[max(0, i - SCOPE) : i]}
                            seen |= {("far", w) for w in words[: max(0, i - SCOPE)]} | {("after", w) for w in words[i + 1 :]}
                for place, w in seen:
                    out[(place, w, label)] += 1
                    out[("any", w, label)] += 1
                out[("texts", "", label)] += bool(seen)
            keys = list(out)
            arrays = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.int32()), pa.array([out[k] for k in keys], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["place", "word", "label", "n"])

    return run


def _features(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lexicon)
        for batch in batches:
            x = [reader.features(text or "") for (text,) in records(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(x, pa.list_(pa.float64()))], names=["label", "x"])

    return run


def fit(x: np.ndarray, y: np.ndarray, each: np.ndarray) -> np.ndarray:
    """Logistic weights near PRIOR, none but the bias below 0, by Newton steps over the weights that are free; each: a row's weight."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = PRIOR.copy(), np.full(len(PRIOR), RIDGE)
    ridge[-1] = 1e-6

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(each @ (np.logaddexp(0, z) - y * z) + (ridge * (w - PRIOR) ** 2).sum() / 2)

    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (each * (p - y)) + ridge * (w - PRIOR)
        h = (x * (each * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
        free = (w > 0) | (g < 0)
        free[-1] = True
        step = np.zeros_like(w)
        step[free] = np.linalg.solve(h[np.ix_(free, free)], g[free])
        size, new = 1.0, w
        while size > 1e-6:
            new = w - size * step
            new[:-1] = np.maximum(new[:-1], 0)
            if loss(new) <= loss(w):
                break
            size /= 2
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    return w


def _learn_patterns(rows: DataFrame) -> Lexicon:
    """Fixed and learnt patterns; two words in a row are one where neither is."""
    lexicon = fixed_lexicon()
    grams = arrow_map(rows, _trigrams, "before string, word string, after string, label int")
    flags = [F.max(F.col("label") == F.lit(v)).cast("int").alias(name) for v, name in ((1, "t"), (0, "c"))]
    sums = [F.sum(name).cast("long").alias(name) for name in ("t", "c")]
    pairs = stage(grams.groupBy("before", "word", "after").agg(*flags).groupBy("before", "word").agg(*sums), "toxic-pairs")
    once = [(F.col(name) > 0).cast("long").alias(name) for name in ("t", "c")]
    words = stage(pairs.select("word", *once).groupBy("word").agg(*sums), "toxic-words")
    (nt, nc), (pt, pc) = ((int(x or 0) for x in df.agg(F.sum("t"), F.sum("c")).first()) for df in (words, pairs))
    if not nt or not nc:
        return lexicon
    learnt = arrow_map(words.coalesce(1), _induced(nt, nc), "pattern string, weight double").collect()
    lexicon.patterns |= {r["pattern"]: ("insult", r["weight"]) for r in learnt}
    reader = Reader(lexicon)
    for r in pairs.where((F.col("t") >= CONTEXTS) & (F.col("before") != "") & (F.col("t") * pc >= RATIO * F.col("c") * pt)).collect():
        known = reader.matches(f" {r['before']} ") or reader.matches(f" {r['word']} ")
        if not known and certainty(r["t"], r["c"], pt, pc) >= CERTAIN and (ratio := ratio_of(r["t"], r["c"], pt, pc)) >= RATIO:
            lexicon.patterns[f" {r['before']} {r['word']} "] = ("insult", float(np.clip(np.log(ratio), 0.5, STRONGEST)))
    return lexicon


def _learn_roles(rows: DataFrame, lexicon: Lexicon) -> None:
    """Targets, negations and reports: words around matches that are commoner or rarer in toxic texts; then which patterns are threats."""
    counts = arrow_map(rows, _surroundings(lexicon), "place string, word string, label int, n long").groupBy("place", "word")
    counts = counts.agg(*(F.sum(F.when(F.col("label") == v, F.col("n")).otherwise(0)).alias(name) for v, name in ((1, "t"), (0, "c"))))
    counts = stage(counts, "toxic-surroundings")
    texts = counts.where("place = 'texts'").first()
    if texts is None or not texts["t"] or not texts["c"]:
        return
    nt, nc = texts["t"], texts["c"]
    places: dict[str, dict[str, float]] = defaultdict(dict)
    for r in counts.where(F.col("place").isin("close", "far", "any") & (F.col("t") + F.col("c") >= CONTEXTS)).collect():
        places[r["place"]][r["word"]] = certainty(r["t"], r["c"], nt, nc)
    for word, sure in sorted(places["any"].items()):
        close, far = places["close"].get(word, 0.0), places["far"].get(word, 0.0)
        if word not in lexicon.roles and not Reader(lexicon).matches(f" {word} "):
            if min(close, far) <= -CERTAIN:
                lexicon.roles[word] = "negation" if close <= far else "report"
            elif sure >= CERTAIN:
                lexicon.roles[word] = "target"


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Lexicon and weights from at most 2 * sample labelled rows outside the held-out ones, half of them for either."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = stage(known.groupBy(F.col(id_col).alias("__id")).agg((F.max(label_col) > 0).cast("int").alias("label")), "toxic-labels")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(counts) < 2:
        return Model(fixed_lexicon(), PRIOR)
    order = [F.xxhash64("__id"), F.col("__id")]
    some = [known.where(F.col("label") == v).orderBy(*order).limit(sample) for v in (0, 1)]
    chosen = F.broadcast(stage(some[0].unionByName(some[1]), "toxic-sample"))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(chosen, "__id")
    rows = stage(rows.select("label", "text", (F.pmod(F.xxhash64(F.lit(3), "__id"), F.lit(2)) == 0).alias("first")), "toxic-texts")
    first = rows.where("first").select("label", "text").repartition(8)
    lexicon = _learn_patterns(first)
    _learn_roles(first, lexicon)
    got = arrow_map(rows.where("not first").select("label", "text").repartition(8), _features(lexicon), "label int, x array<double>").toPandas()
    got = got.assign(key=[tuple(v) for v in got["x"]]).sort_values(["key", "label"])  # the order of rows must not matter
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES))
    y = got["label"].to_numpy(float)
    ratio = counts[0] / min(counts[0], sample) * min(counts[1], sample) / counts[1]  # clean rows may be sampled more thinly
    return Model(lexicon, fit(x, y, np.where(y == 1, 1.0, ratio)))


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.lexicon)
        for batch in batches:
            x = np.array([reader.features(text or "") for (text,) in records(batch, "text")], float).reshape(batch.num_rows, len(FEATURES))
            score = model.score(x)
            arrays = [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return arrow_map(rows, run, "doc_id long, held_out boolean, score double, predicted int")
