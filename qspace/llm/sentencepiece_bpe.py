"""SentencePiece encoding by a prefix table, and decoding.

A text is cut at places that no piece spans, which changes no id. For each chunk the table holds, for every prefix, the one piece
that ends the prefix's encoding: of the pieces that an Aho-Corasick automaton finds ending there, it is the one that forms a stable
pair with the last piece of the prefix before it, that is, the two pieces' text is merged into just these two. The ids are then
read backwards from the last prefix. Characters that are in no piece stand alone and become byte pieces.

Defined cases: a null or empty text has only the end id; texts may be of any length, without spaces too; rows are treated one by
one, so repeated rows give repeated results and an empty table an empty one; null ids are kept; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections import Counter, deque
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qspace.llm.common import MEMORIES, arrow_map, records

SPACE_MARK = "▁"
#: How many words and chunks a worker remembers in each of two generations, the longest of them, and how many pairs; all bound memory only.
#: Each number is just below one at which a dictionary doubles its room.
CACHE_ENTRIES, CACHE_LENGTH, PAIRS = 87_000, 48, 349_000
#: Marks for keys that were met once, a power of two.
MARKS = 1 << 22
#: Steps between states that an automaton keeps beside its tree.
STEPS = 300_000
#: Characters of texts that are encoded together.
SOME = 1_000_000
#: Where no cut by kinds of characters keeps all pieces whole, texts are cut before spaces only, or not at all.
SIGNS = frozenset(".,;:!?")
WORDS, WHOLE = rf"{SPACE_MARK}*[^{SPACE_MARK}]+|{SPACE_MARK}+", r"(?s:.+)"


def kinds_cut(signs: str) -> str:
    """Runs of letters, single digits, runs of other signs and of spaces; the given signs count as other ones."""
    letter, other = rf"[^\W\d_{signs}]", rf"(?:[^\w{SPACE_MARK}]|[_{signs}])"
    return rf"{SPACE_MARK}*{letter}+|{SPACE_MARK}*\d|{SPACE_MARK}*{other}+|{SPACE_MARK}+"


class Memory:
    """What was made of keys, in two generations: when the younger is full it becomes the older, from which what is asked for is taken over.

    A key is remembered when it is met again, as most words occur once: the first time only a mark is set, by its hash.
    """

    def __init__(self, make: Callable[[list[str]], list[bytes]]):
        self.make, self.young, self.old, self.met = make, {}, {}, bytearray(MARKS)

    def get(self, keys: list[str]) -> list[bytes]:
        """The values of distinct keys; what is lacking is made at once."""
        found = list(map(self.young.get, keys))
        lacking = [i for i, v in enumerate(found) if v is None]
        if lacking:
            new, again, met = [], [], self.met
            for i in lacking:
                key = keys[i]
                found[i] = self.old.get(key)
                if found[i] is None:
                    new.append(i)
                    place = hash(key) & MARKS - 1
                    if not met[place]:
                        met[place] = 1
                        continue
                if len(key) <= CACHE_LENGTH:
                    again.append(i)
            for i, value in zip(new, self.make([keys[i] for i in new]), strict=True):
                found[i] = value
            for start in range(0, len(again), CACHE_ENTRIES):
                some = again[start : start + CACHE_ENTRIES]
                if len(self.young) + len(some) > CACHE_ENTRIES:
                    self.old, self.young, self.met = self.young, {}, bytearray(MARKS)
                self.young.update([(keys[i], found[i]) for i in some])
        return found


class Automaton:
    """Finds all pieces that end at each place of a text, the longest first. Its state can be kept, so that a text may go on from any prefix."""

    def __init__(self, pieces: dict[str, int]):
        self.goto: list[dict[str, int]] = [{}]
        self.fail, self.out, queue = [0], [()], deque()
        for piece, i in pieces.items():
            state = 0
            for c in piece:
                after = self.goto[state].get(c)
                if after is None:
                    after = self.goto[state][c] = len(self.goto)
                    self.goto.append({})
                    self.fail.append(0)
                    self.out.append(())
                state = after
            self.out[state] = (i,)
        queue.extend(self.goto[0].values())
        while queue:  # by length, so that a state's shorter suffixes are ready before it
            state = queue.popleft()
            self.out[state] += self.out[self.fail[state]]
            for c, after in self.goto[state].items():
                self.fail[after] = self._search(self.fail[state], c)
                queue.append(after)
        self.room = STEPS

    def _search(self, state: int, c: str) -> int:
        while True:
            after = self.goto[state].get(c)
            if after is not None:
                return after
            if not state:
                return 0
            state = self.fail[state]

    def step(self, state: int, c: str) -> int:
        """The next state where there is no edge; the first STEPS of them are kept as edges."""
        after = self._search(state, c)
        if self.room and state:
            self.goto[state][c] = after
            self.room -= 1
        return after


class PrefixTable:
    """Encodes with the pieces and scores of a BPE model; merges are by score, the leftmost first among equals."""

    def __init__(self, model: str):
        sp = self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.end = sp.eos_id()
        size = sp.get_piece_size()
        self.code = "H" if size <= 1 << 16 else "I"
        normal = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.ids = {sp.id_to_piece(i): i for i in normal}
        self.score = {piece: sp.get_score(i) for piece, i in self.ids.items()}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.pairs: dict[int, bool] = {}
        self.chunks, self.words = Memory(self.many), Memory(self.word_ids)
        self.length = [0] * size
        met = {}
        place = {score: n for n, score in enumerate(sorted({s for p, s in self.score.items() if len(p) > 1}, reverse=True))}
        self.order = {p: place[s] if len(p) > 1 else -1 for p, s in self.score.items()}  # equal scores are merged in the order of the text
        seen = Counter(self.order.values())
        self.tied = {self.ids[p] for p, n in self.order.items() if n >= 0 and seen[n] > 1}
        self.halves: dict[int, tuple[int, int]] = {}
        for piece, i in self.ids.items():
            whole, halves = (True, None) if len(piece) == 1 else self.last_merge(piece)
            if whole:
                self.length[i] = len(piece)
                met[piece] = i
                if halves:
                    self.halves[i] = (self.ids[halves[0]], self.ids[halves[1]])
        self.automaton = Automaton(met)
        self.piece_of = {i: piece for piece, i in self.ids.items()}
        self.rank = [-1] * size
        for piece, i in self.ids.items():
            self.rank[i] = self.order[piece]
        self.joins = {
            self.ids[p[:n]] << 20 | self.ids[p[n:]]: self.order[p] for p in self.ids for n in range(1, len(p)) if p[:n] in self.ids and p[n:] in self.ids
        }
        self.lines_apart = not any("\n" in p for p in self.ids)
        written = [f"{i} ".encode() for i in range(size)]
        self.digits = np.zeros((size, max(map(len, written))), np.uint8)
        for i, w in enumerate(written):
            self.digits[i, : len(w)] = np.frombuffer(w, np.uint8)
        apart = {c for p in self.ids if not re.fullmatch(kinds_cut(""), p) for c in p if c.isalnum() and not c.isalpha()}
        cuts = (re.compile(cut) for cut in (kinds_cut(re.escape("".join(sorted(apart)))), WORDS, WHOLE))
        self.cut = next(c for c in cuts if all(c.fullmatch(p) for p in self.ids))
        self.kinds = self.cut.pattern not in (WORDS, WHOLE)

    def _steps(self, text: str) -> Iterator[list[str]]:
        """The parts of a short text before and after each merge."""
        parts, score = list(text), self.score
        while True:
            yield list(parts)
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def merged(self, text: str) -> list[str]:
        return list(self._steps(text))[-1]

    def last_merge(self, text: str) -> tuple[bool, tuple[str, str] | None]:
        """Whether merging step by step makes one piece of a short text, and which two it merged last."""
        *_, before, last = [None, *self._steps(text)]
        return len(last) == 1, tuple(before) if before and len(last) == 1 else None

    def stable(self, left: int, right: int) -> bool:
        """Whether two pieces side by side stay as they are.

        Their merges are undone, the latest first, down to the characters at the border: the pair is stable unless two parts that
        meet there at some time make a piece that would have been merged before what was undone since, or, of equal order on the
        right, as it is further left. Pieces of equal scores, such as runs of spaces, are merged step by step instead.
        """
        if left in self.tied or right in self.tied:
            a, b = self.piece_of[left], self.piece_of[right]
            return self.merged(a + b) == [a, b]
        rank, joins, halves = self.rank, self.joins, self.halves
        a, b, limit = left, right, 1 << 30
        while True:
            made = joins.get(a << 20 | b)
            if made is not None and made < limit:
                return False
            inner_a, inner_b = halves.get(a), halves.get(b)
            if inner_a is None and inner_b is None:
                return True
            if inner_b is None or (inner_a is not None and rank[a] > rank[b]):
                limit, a = rank[a], inner_a[1]
            else:
                limit, b = rank[b] + 1, inner_b[0]

    def many(self, chunks: list[str]) -> list[bytes]:
        """The ids of chunks by their prefix tables.

        Chunks are read in order, so that a table is kept as far as the chunk begins like the one before, and the automaton goes on
        from there. A prefix that no piece ends has an unknown character at its end.
        """
        goto, out, length, pairs, code = self.automaton.goto, self.automaton.out, self.length, self.pairs, self.code
        found: dict[str, bytes] = {}
        before_chunk, states, last = "", [0], [-1]
        for chunk in sorted(chunks):
            same, most = 0, min(len(chunk), len(before_chunk))
            while same < most and chunk[same] == before_chunk[same]:
                same += 1
            before_chunk = chunk
            del states[same + 1 :], last[same + 1 :]
            state, stop = states[same], same
            for c in chunk[same:]:
                after = goto[state].get(c)
                state = self.automaton.step(state, c) if after is None else after
                stop += 1
                token = -1
                for piece in out[state]:
                    start = stop - length[piece]
                    if start:
                        before = last[start]
                        if before >= 0:
                            ok = pairs.get(before << 20 | piece)
                            if ok is None:
                                if len(pairs) >= PAIRS:
                                    pairs.clear()
                                ok = pairs[before << 20 | piece] = self.stable(before, piece)
                            if not ok:
                                continue
                    token = piece
                    break
                states.append(state)
                last.append(token)
            ids, at = [], stop
            while at:
                piece = last[at]
                if piece >= 0:
                    ids.append(piece)
                    at -= length[piece]
                else:
                    at -= 1
                    ids.extend(self.bytes[b] for b in reversed(chunk[at].encode("utf-8", "surrogatepass")))
            ids.reverse()
            found[chunk] = array(code, ids).tobytes()
        return [found[c] for c in chunks]

    def parts(self, text: str) -> list[bytes]:
        """The ids of a text's chunks."""
        cut = self.cut.findall(text)
        known = dict.fromkeys(cut)
        known = dict(zip(known, self.chunks.get(list(known)), strict=True))
        return [known[c] for c in cut]

    def word_ids(self, words: list[str]) -> list[bytes]:
        """The ids of words and the space before them, or of line feeds and what follows them. Their chunks are encoded together."""
        feed, known, young, old = array(self.code, [self.bytes[10]]).tobytes(), {}, self.words.young, self.words.old
        heads, cuts = [], []
        for word in words:
            head, cut = b"", None
            if word.isalpha():
                cut = (SPACE_MARK + word,)
            elif word[:1] == "\n" and self.lines_apart:
                rest = word.lstrip("\n")
                head = feed * (len(word) - len(rest))
                cut = (rest,) if rest.isalpha() else self.cut.findall(rest)
            elif self.kinds and word[-1:] in SIGNS and word[:-1].isalpha():
                first = SPACE_MARK + word[:-1]
                cut = (first, word[-1])
                if first not in known:
                    same = young.get(word[:-1]) or old.get(word[:-1])
                    if same is not None:
                        known[first] = same
            else:
                cut = self.cut.findall(SPACE_MARK + word)
            heads.append(head)
            cuts.append(cut)
        new = [c for c in dict.fromkeys(chain.from_iterable(cuts)) if c not in known]
        known.update(zip(new, self.many(new), strict=True))
        return [head + (known[cut[0]] if len(cut) == 1 else b"".join([known[c] for c in cut])) for head, cut in zip(heads, cuts, strict=True)]

    def simple(self, text: str) -> bool:
        """Whether the text is words with one space between them; runs of spaces have pieces of their own."""
        return not ("  " in text or text[:1] in ("", " ") or text[-1] == " " or SPACE_MARK in text or (self.lines_apart and " \n" in text))

    def packed(self, text: str) -> np.ndarray:
        """All ids, the end id last."""
        if not text:
            raw = b""
        elif self.simple(text):
            words = (text.replace("\n", " \n") if self.lines_apart else text).split(" ")
            known = dict.fromkeys(words)
            known = dict(zip(known, self.words.get(list(known)), strict=True))
            raw = b"".join(map(known.__getitem__, words))
        else:
            raw = b"".join(self.parts(SPACE_MARK + text.replace(" ", SPACE_MARK)))
        return np.frombuffer(raw + array(self.code, [self.end]).tobytes(), self.code)

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """packed() of several texts; their words are looked up once."""
        plain = [i for i, t in enumerate(texts) if t and self.simple(t)]
        out: dict[int, np.ndarray] = {}
        if plain:
            some = pa.array([texts[i] for i in plain], pa.large_string())
            if self.lines_apart:
                some = pc.replace_substring(some, "\n", " \n")
            lists = pc.split_pattern(some, " ")
            words = lists.values.dictionary_encode()
            values = self.words.get(words.dictionary.to_numpy(zero_copy_only=False).tolist())
            width = array(self.code).itemsize
            sizes = np.fromiter(map(len, values), np.int64, len(values)) // width
            ids, starts = np.frombuffer(b"".join(values), self.code), np.cumsum(sizes) - sizes
            which = words.indices.to_numpy(zero_copy_only=False)
            each = sizes[which]
            stops = np.cumsum(each)
            place = np.int32 if stops[-1] < 1 << 31 and len(ids) < 1 << 31 else np.int64
            gathered = ids[np.repeat((starts[which] - stops + each).astype(place), each) + np.arange(int(stops[-1]), dtype=place)]
            bounds = np.concatenate([[0], stops])[lists.offsets.to_numpy()].tolist()
            end = np.asarray([self.end], self.code)
            for i, a, b in zip(plain, bounds, bounds[1:], strict=False):
                out[i] = np.concatenate([gathered[a:b], end])
        return [out[i] if i in out else self.packed(t) for i, t in enumerate(texts)]

    def written(self, ids: np.ndarray) -> bytes:
        """The ids as decimal numbers joined by a space."""
        spread = self.digits[ids].ravel()
        return spread[spread != 0].tobytes()[:-1]

    def encode(self, text: str) -> tuple[list[int], str]:
        """All ids with the end id, and the same as decimal numbers joined by a space."""
        ids = self.packed(text)
        return ids.tolist(), self.written(ids).decode()

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)


@lru_cache(maxsize=2)
def table(model: str) -> PrefixTable:
    return PrefixTable(model)


MEMORIES[__name__] = table


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _some(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of a few rows at a time, of about SOME characters."""
    held, size = [], 0
    for doc_id, text in records(batch, "doc_id", "text"):
        held.append((doc_id, text or ""))
        size += len(text or "")
        if size >= SOME:
            yield [x[0] for x in held], [x[1] for x in held]
            held, size = [], 0
    if held:
        yield [x[0] for x in held], [x[1] for x in held]


def _encoder(model: str, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = table(model)
        for batch in batches:
            for doc_ids, texts in _some(batch):
                rows: list[tuple] = []
                for doc_id, packed in zip(doc_ids, encoder.batch(texts), strict=True):
                    digest = hashlib.sha256(encoder.written(packed)).hexdigest()
                    ids = packed.tolist()
                    decoded = encoder.decode(ids)
                    said = hashlib.sha256(decoded.encode()).hexdigest()
                    rows.append((doc_id, len(ids), digest, said, *((ids, decoded) if with_ids else ())))
                    if with_ids and len(rows) >= 64:
                        yield _batch(rows, with_ids)
                        rows = []
                yield _batch(rows, with_ids)

    return run


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    types = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    types |= {"ids": pa.list_(pa.int32()), "decoded": pa.string()} if with_ids else {}
    columns = list(zip(*rows, strict=True)) or [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], names=list(types))


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, with_ids, the ids and the decoded text."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(rows, _encoder(model or default_model(), with_ids), schema)
