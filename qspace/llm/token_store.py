"""Token ids in a content-addressed store.

Each text's ids are cut into chunks where a rolling hash of the last ids says so; a chunk's address is a digest of its bytes, and of
equal chunks one is stored. A document's recipe lists its chunks' addresses and has their Merkle root. A store is a folder with

    chunks/   key (16 bytes), n, body: n ids, little-endian, 2 bytes each where the vocabulary allows it, else 4
    recipes/  in ascending order of doc_id, a file per range of ids: part, row, doc_id, n, at (ids before it in its part), keys, root
    manifest/ one row per part: ids before the part, its documents, its ids, the Merkle root of its documents' roots, bytes of an id

Readers check every chunk's digest and every root before they return anything.

Defined cases: a null or empty text has only the end id; a null doc_id comes first; repeated rows are documents of their own, in no
particular order; an empty table gives an empty store and an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qspace.llm.common import MEMORIES, arrow_map, maybe_broadcast, new_path, records

END_ID = 2
#: Ids in the rolling hash; a chunk ends, on average, after 2**BITS ids, and has at least LEAST and at most MOST of them.
ROLL, BITS, LEAST, MOST = 8, 9, 64, 4096
KEY = 16
#: Ids hashed at a time, as many as a processor's cache holds.
BLOCK = 1 << 14
#: Words and units in each generation of a worker's memory, and chunk keys that a task remembers as sent; all bound memory only.
CACHE_WORDS, CACHE_UNITS, CACHE_KEYS = 250_000, 500_000, 100_000
#: Bytes of texts that are encoded together.
SOME = 12_000_000
#: Words without any of the other characters consist of units that are encoded each by itself: letters, digits, runs of other signs.
OTHER = re.compile(r"[^A-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-/:-@\[-`{-~\n]")
UNITS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+|\n")
#: Signs that make a unit of their own after letters.
SIGNS = frozenset(".,;:!?")
#: All characters of units.
ALPHABET = "".join(c for c in map(chr, range(0x21, 0x100)) if c != "\n" and UNITS.fullmatch(c))
SEPARATOR = "<|startoftext|>"
_GEAR = np.random.default_rng(5).integers(0, 2**64, 1 << 16, dtype=np.uint64)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, j, 2**64) for j in range(ROLL)], np.uint64)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Words:
    """Ids of words as bytes. Pieces never span ASCII white space, so words are encoded once and remembered."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.type = "<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) < 1 << 16 else "<u4"
        self.apart = self.tokenizer.token_to_id(SEPARATOR)
        vocabulary_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends = np.zeros(vocabulary_size, bool)
        for piece, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.ends[i] = piece.endswith("</w>")
        self.mark = np.iinfo(self.type).max  # no id
        self.model = self.tokenizer.model
        self.bytes_of = [self._packed([i]) for i in range(vocabulary_size)]
        self.direct = self._goes_direct()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}
        self.old_units: dict[str, bytes] = {}

    def _packed(self, ids) -> bytes:
        return np.asarray(ids, self.type).tobytes()

    def _encoded(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.type)

    def _goes_direct(self) -> bool:
        """Whether the model alone encodes units: the normalizer leaves their characters as they are and the pre-tokenizer replaces each
        by itself, which is tried with all of them, alone and in runs. The model's own memory is of no use to units that are asked for once."""
        normalizer, cutter = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        if normalizer is not None and any(normalizer.normalize_str(c) != c for c in (*ALPHABET, ALPHABET)):
            return False
        self.replaced = {}
        for c in ALPHABET:
            parts = cutter.pre_tokenize_str(c) if cutter is not None else [(c, None)]
            if len(parts) != 1:
                return False
            if parts[0][0] != c:
                self.replaced[ord(c)] = parts[0][0]
        runs = [u * n for u in UNITS.findall(ALPHABET) for n in (1, 2)]
        tried = [*ALPHABET, *runs, *(u[::-1] for u in runs), *(c * 2 for c in ALPHABET if not c.isdigit())]
        tried = [u for u in tried if UNITS.fullmatch(u)]
        if any(self._unit(u) != self._encoded(u).tobytes() for u in tried):
            return False
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)
        return True

    def _unit(self, unit: str) -> bytes:
        """The ids of a unit by the model alone."""
        bytes_of = self.bytes_of
        return b"".join([bytes_of[t.id] for t in self.model.tokenize(unit if unit.isascii() else unit.translate(self.replaced))])

    def _cut(self, ids: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> list[bytes]:
        raw, size = ids.tobytes(), ids.itemsize
        return [raw[a:b] for a, b in zip((starts * size).tolist(), (stops * size).tolist(), strict=True)]

    def _by_units(self, words: list[str], text: str) -> None:
        """Words joined by line feeds."""
        ids = np.frombuffer(b"".join(self.of_units(UNITS.findall(text.lower()))) + self._packed([self.mark]), self.type)
        stops = np.flatnonzero(ids == self.mark)
        self.young.update(zip(words, self._cut(ids, np.concatenate([[0], stops[:-1] + 1]), stops), strict=True))

    def of_units(self, parts: list[str]) -> list[bytes]:
        """The ids of units, a mark for line feeds. New ones go to the model, or are encoded together, parted by
        spaces; each gives one piece that ends a word."""
        if len(self.units) > CACHE_UNITS or not self.units:
            self.old_units, self.units = self.units, {"\n": self._packed([self.mark])}
        found = list(map(self.units.get, parts))
        lacking = [i for i, v in enumerate(found) if v is None]
        if not lacking:
            return found
        fresh = {parts[i] for i in lacking}
        old = self.old_units
        known = [u for u in fresh if u in old]  # intersection() would go through all of old
        self.units.update([(u, old[u]) for u in known])
        fresh = list(fresh.difference(known))
        if self.direct:
            self.units.update(zip(fresh, map(self._unit, fresh), strict=True))
            fresh = []
        for i in range(0, len(fresh), 4096):
            some = fresh[i : i + 4096]
            ids = self._encoded(" ".join(some))
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some):
                self.units.update(zip(some, self._cut(ids, np.concatenate([[0], stops[:-1]]), stops), strict=True))
            else:
                self.units.update((u, self._encoded(u).tobytes()) for u in some)
        units = self.units
        for i in lacking:
            found[i] = units[parts[i]]
        return found

    def _by_separator(self, words: list[str]) -> None:
        for i in range(0, len(words), 4096):
            some = words[i : i + 4096]
            ids = self._encoded(SEPARATOR.join(some))
            cuts = np.flatnonzero(ids == self.apart)
            found = self._cut(ids, np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(ids)]]))
            self.young.update(zip(some, found, strict=True))

    def learn(self, words: list[str]) -> None:
        simple, other = [], []
        for w, known in zip(words, map(self.old.get, words), strict=True):
            if known is not None:
                self.young[w] = known
            elif "<|" in w or self.apart is None:  # it may hold the separator itself
                self.young[w] = self._encoded(w).tobytes()
            else:
                simple.append(w)
        text = "\n".join(simple)
        if OTHER.search(text):
            other = [w for w in simple if OTHER.search(w)]
            simple = [w for w in simple if not OTHER.search(w)]
            text = "\n".join(simple)
        if simple:
            self._by_units(simple, text)
        if other:
            self._by_separator(other)

    def _letters(self, words: list[str], chosen: list[bool]) -> tuple[list[bool], list[bytes]]:
        """Which of the chosen words, which are of letters only, are units as a whole, and these units' ids."""
        text = "\n".join(compress(words, chosen))
        if OTHER.search(text):
            chosen = [c and not OTHER.search(w) for w, c in zip(words, chosen, strict=True)]
            text = "\n".join(compress(words, chosen))
        if not any(chosen):
            return chosen, []
        return chosen, self.of_units(text.lower().split("\n"))

    def values(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words; what is lacking is learnt at once. Letters, also with one sign after them, are looked up by unit,
        and other words are remembered as they are."""
        found: list[bytes | None] = [None] * len(words)
        whole, ids = self._letters(words, list(map(str.isalpha, words)))
        for i, v in zip(compress(range(len(words)), whole), ids, strict=True):
            found[i] = v
        rest = [i for i, done in enumerate(whole) if not done]
        stems = [words[i][:-1] if words[i][-1:] in SIGNS else "" for i in rest]
        ended, ids = self._letters(stems, list(map(str.isalpha, stems)))
        if ids:
            signs = dict(zip(SIGNS, self.of_units(list(SIGNS)), strict=True))
            for i, v in zip(compress(rest, ended), ids, strict=True):
                found[i] = v + signs[words[i][-1]]
        rest = [i for i, done in zip(rest, ended, strict=True) if not done]
        if rest:
            if len(self.young) > CACHE_WORDS:
                self.old, self.young = self.young, {}
            known = list(map(self.young.get, [words[i] for i in rest]))
            self.learn([words[i] for i, v in zip(rest, known, strict=True) if v is None])
            for i, v in zip(rest, known, strict=True):
                found[i] = self.young[words[i]] if v is None else v
        return found

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts one after the other, an end id after each, and where each begins and the last one ends."""
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        values = self.values(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        width = np.dtype(self.type).itemsize
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // width
        ids, starts = np.frombuffer(b"".join(values), self.type), np.cumsum(sizes) - sizes
        which = words.indices.to_numpy(zero_copy_only=False)
        each = sizes[which]
        stops = np.cumsum(each)
        total = int(stops[-1]) if len(stops) else 0
        counts = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
        bounds = np.concatenate([[0], stops])[counts]  # of texts among ids without end ids
        place = np.int32 if max(total, len(ids)) < 1 << 30 else np.int64
        out = np.full(total + len(texts), end, self.type)
        inside = np.ones(len(out), bool)
        inside[bounds[1:] + np.arange(len(texts))] = False
        out[inside] = ids[np.repeat((starts[which] - stops + each).astype(place), each) + np.arange(total, dtype=place)]
        return out, bounds + np.arange(len(texts) + 1)


@lru_cache(maxsize=2)
def words_of(vocabulary: str) -> Words:
    return Words(vocabulary)


MEMORIES[__name__] = words_of


def borders(ids: np.ndarray) -> np.ndarray:
    """Places after ids at which the rolling hash has BITS zeros. LEAST ids go before a cut, so what is before a document never matters."""
    found = [np.zeros(0, np.int64)]
    for low in range(0, len(ids), BLOCK):
        first = max(0, low - ROLL + 1)  # a block begins with what rolls into it
        gear = _GEAR[ids[first : low + BLOCK] & 0xFFFF]
        n = len(gear)
        h = np.zeros(n, np.uint64)
        for j in range(min(ROLL, n)):
            h[j:] += gear[: n - j] * _POWERS[j]
        found.append(np.flatnonzero(h[low - first :] >> np.uint64(64 - BITS) == 0) + low + 1)
    return np.concatenate(found)


def cuts(found: list[int], start: int, stop: int) -> list[int]:
    """Where the chunks of the document from start to stop end, given the borders inside: within the bounds of a chunk's size."""
    ends, last = [], start
    for c in found:
        while c - last > MOST:
            last += MOST
            ends.append(last)
        if c - last >= LEAST:
            ends.append(c)
            last = c
    while stop - last > MOST:
        last += MOST
        ends.append(last)
    if last < stop:
        ends.append(stop)
    return ends


def address(body: bytes) -> bytes:
    return blake2b(body, digest_size=KEY).digest()


class Merkle:
    """The root of a binary tree over leaves that come one by one; leaves and inner nodes are told apart by their first byte. Of every
    level only a node that waits for its neighbour is held. A node without neighbour goes up alone."""

    def __init__(self):
        self.waiting: list[bytes | None] = []

    @staticmethod
    def _node(*parts: bytes) -> bytes:
        return blake2b(b"\1" + b"".join(parts), digest_size=KEY).digest()

    def add(self, leaf: bytes) -> None:
        node, waiting = blake2b(b"\0" + leaf, digest_size=KEY).digest(), self.waiting
        for level, other in enumerate(waiting):
            if other is None:
                waiting[level] = node
                return
            node, waiting[level] = self._node(other, node), None
        waiting.append(node)

    def root(self) -> bytes:
        carried = None
        for level, node in enumerate(self.waiting):
            parts = [p for p in (node, carried) if p is not None]
            if len(parts) == 1 and level + 1 == len(self.waiting):
                return parts[0]
            carried = self._node(*parts) if parts else None
        return carried if carried is not None else blake2b(b"", digest_size=KEY).digest()


def merkle(keys: Iterable[bytes]) -> bytes:
    tree = Merkle()
    for k in keys:
        tree.add(k)
    return tree.root()


def column_list(column: pa.Array) -> list:
    """to_pylist(), faster; columns of numbers with nulls keep them."""
    return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()


def split_keys(keys: bytes) -> list[bytes]:
    return [keys[i : i + KEY] for i in range(0, len(keys), KEY)]


PACK = "kind string, key binary, doc_id long, n long, body binary, root binary"


def _pack_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["kind", "key", "doc_id", "n", "body", "root"])


def _some(batches: Iterator[pa.RecordBatch], most: int = SOME) -> Iterator[tuple[list, pa.Array]]:
    """Ids and texts of a few documents at a time, of about so many bytes."""
    for batch in batches:
        texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
        doc_ids = batch.column("doc_id")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        low = 0
        while low < len(sizes):
            high = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + most, "right")))
            yield doc_ids.slice(low, high - low).to_pylist(), texts.slice(low, high - low)
            low = high


def _encode(vocabulary: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sent, row = words_of(vocabulary), set(), 0
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        for doc_ids, texts in _some(batches):
            rows: list[tuple] = []
            ids, bounds = words.encode(texts, end)
            raw, size, found = ids.tobytes(), ids.itemsize, borders(ids)
            inner = np.searchsorted(found, bounds).tolist()
            bounds, found = bounds.tolist(), found.tolist()
            for i, doc_id in enumerate(doc_ids):
                start, stop, keys = bounds[i], bounds[i + 1], []
                last = start
                for cut in cuts(found[inner[i] : inner[i + 1]], start, stop):
                    body = raw[last * size : cut * size]
                    key = address(body)
                    keys.append(key)
                    if key not in sent:
                        if len(sent) >= CACHE_KEYS:
                            sent.clear()
                        sent.add(key)
                        rows.append(("chunks", key, None, cut - last, body, None))
                    last = cut
                row += 1
                rows.append(("documents", address(f"{task}:{row}".encode()), doc_id, stop - start, b"".join(keys), merkle(keys)))
            yield _pack_batch(rows)

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key: the first chunk of each address goes on, and all documents. Only the last key is remembered."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, chunk = batch.column("key"), pc.equal(batch.column("kind"), "chunks")
        new = np.ones(batch.num_rows, bool)
        new[1:] = pc.not_equal(keys.slice(1), keys.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
        new[0] = keys[0].as_py() != last
        last = keys[-1].as_py()
        yield batch.filter(pa.array(new | ~chunk.to_numpy(zero_copy_only=False)))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to the sorted documents of a range its part, their row and the ids before them in the part."""
    part, row, at = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n = np.asarray(batch.column("n").to_pylist(), np.int64)
        starts = at + np.cumsum(n) - n
        at += int(n.sum())
        rows = np.arange(row, row + len(n))
        row += len(n)
        arrays = [pa.array(np.full(len(n), part)), pa.array(rows), batch.column("doc_id"), batch.column("n"), pa.array(starts), batch.column("keys"), batch.column("root")]
        yield pa.RecordBatch.from_arrays(arrays, names=["part", "row", "doc_id", "n", "at", "keys", "root"])


RECIPES = "part long, row long, doc_id long, n long, at long, keys binary, root binary"
PARTS = "part long, documents long, n long, root binary"
MANIFEST = "part long, first long, documents long, n long, root binary, size int"


def _manifest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per file of recipes, with the Merkle root of its documents' roots, which come in order."""
    rows: list[list] = []
    tree = Merkle()
    for batch in batches:
        for part, n, root in records(batch, "part", "n", "root"):
            if not rows or rows[-1][0] != part:
                if rows:
                    rows[-1][3] = tree.root()
                rows.append([part, 0, 0, b""])
                tree = Merkle()
            tree.add(root)
            rows[-1][1] += 1
            rows[-1][2] += n
    if rows:
        rows[-1][3] = tree.root()
    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], names=["part", "documents", "n", "root"])


def _parts(recipes: DataFrame) -> DataFrame:
    return arrow_map(recipes.select("part", "row", "n", "root").repartition("part").sortWithinPartitions("part", "row"), _manifest, PARTS)


def write_store(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end: int = END_ID) -> None:
    """end must be below the size of the vocabulary."""
    spark, vocabulary = docs.sparkSession, vocabulary or default_vocabulary()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    packed = arrow_map(rows, _encode(vocabulary, end), PACK).repartition("key").sortWithinPartitions("key")
    arrow_map(packed, _once, PACK).write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/packed")
    documents = spark.read.schema(PACK).parquet(f"{path}/packed").where("kind = 'documents'")
    ordered = documents.select("doc_id", "n", F.col("body").alias("keys"), "root").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    arrow_map(ordered, _numbered, RECIPES).write.parquet(f"{path}/recipes")
    first = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    size = F.lit(np.dtype(words_of(vocabulary).type).itemsize).cast("int").alias("size")
    recipes = spark.read.schema(RECIPES).parquet(f"{path}/recipes")
    _parts(recipes).select("part", first.alias("first"), "documents", "n", "root", size).coalesce(1).write.parquet(f"{path}/manifest")


def _checked(with_body: bool, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sums, counts = [], [], []
            for key, n, body in zip(*(column_list(batch.column(c)) for c in ("key", "n", "body")), strict=True):
                if address(body) != key or len(body) != n * size:
                    raise ValueError(f"chunk {key.hex()} is damaged")
                keys.append(key)
                counts.append(n)
                sums.append(zlib.crc32(np.frombuffer(body, f"<u{size}").astype("<u4").tobytes()))
            arrays = [pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays + [batch.column("body")] * with_body, names=["key", "held", "crc", *["body"] * with_body])

    return run


def _times(matrix: list[int], vector: int) -> int:
    out, i = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector >>= 1
        i += 1
    return out


@lru_cache(maxsize=1)
def _doublings() -> np.ndarray:
    """What 1, 2, 4, ... zero bytes do to a crc32: for each of its four bytes and each value of that byte the part of the outcome."""
    matrix = [0xEDB88320, *[1 << i for i in range(31)]]  # one zero bit, as a matrix over bits
    out = np.zeros((48, 4, 256), np.uint32)
    for n in range(-3, len(out)):
        if n >= 0:
            for byte in range(4):
                out[n, byte] = [_times(matrix, v << 8 * byte) for v in range(256)]
        matrix = [_times(matrix, v) for v in matrix]
    return out


def shifted(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The part of some bytes' crc32 in that of a longer string that so many bytes follow them in; the parts' exclusive or is its crc32."""
    crc, left, tables = crc.astype(np.uint32), lengths.astype(np.int64), _doublings()
    for t in tables:
        if not left.any():
            break
        odd = np.flatnonzero(left & 1)
        c = crc[odd]
        crc[odd] = t[0][c & 255] ^ t[1][c >> 8 & 255] ^ t[2][c >> 16 & 255] ^ t[3][c >> 24]
        left >>= 1
    return crc


def _whole(with_ids: bool, size: int):
    """Documents put together from their chunks' rows, after the check of their roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            doc_ids, starts, tokens, roots = (column_list(batch.column(c)) for c in ("doc_id", "start", "n", "root"))
            lists = batch.column("parts")
            counts = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            parts = lists.flatten()
            keys, held = column_list(parts.field("key")), pc.fill_null(parts.field("held"), -1).to_numpy(zero_copy_only=False)
            after = np.cumsum(counts)
            ends = np.cumsum(held)
            document = np.repeat(np.arange(len(counts)), counts)
            totals = np.bincount(document, np.maximum(held, 0), len(counts)).astype(np.int64)
            lost = np.bincount(document, held < 0, len(counts)) > 0
            bases = np.cumsum(totals)  # right where nothing is lost, and else reading fails
            for i in np.flatnonzero(lost | (counts == 0) | (totals != np.asarray(tokens))).tolist()[:1]:
                raise ValueError(f"document {doc_ids[i]} can't be put together")
            crcs = shifted(parts.field("crc").to_numpy(zero_copy_only=False), 4 * (bases[document] - ends))
            crcs = np.bitwise_xor.reduceat(crcs, after - counts)
            bodies, ids = column_list(parts.field("body")) if with_ids else [], []
            for i, (low, high) in enumerate(zip((after - counts).tolist(), after.tolist(), strict=True)):
                if merkle(keys[low:high]) != roots[i]:
                    raise ValueError(f"document {doc_ids[i]} can't be put together")
                if with_ids:
                    ids.append(np.frombuffer(b"".join(bodies[low:high]), f"<u{size}").astype(np.int32))
            arrays = [batch.column("doc_id"), pa.array(starts, pa.int64()), pa.array(tokens, pa.int64()), pa.array(crcs.astype(np.int64))]
            arrays += [pa.array(ids, pa.list_(pa.int32()))] * with_ids
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    return run


def check_manifest(recipes: DataFrame, manifest: DataFrame) -> int:
    """Compares the recipes with the manifest, part by part, and gives the bytes of an id; ValueError if anything differs."""
    read = _parts(recipes).withColumnsRenamed({"documents": "d", "n": "m", "root": "r"})
    same = F.col("documents").eqNullSafe(F.col("d")) & F.col("n").eqNullSafe(F.col("m")) & F.col("root").eqNullSafe(F.col("r"))
    found = manifest.join(read, "part", "full").agg(F.sum((~same).cast("int")).alias("wrong"), F.min("size").alias("low"), F.max("size").alias("size")).first()
    if found["wrong"] or found["low"] != found["size"]:
        raise ValueError(f"{found['wrong']} parts differ from the manifest")
    return found["size"] or 2


def read_store(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, with_ids, ids. Without ids only digests of chunks are moved, not their bodies.

    Every part's root, documents and ids are compared with the manifest first. A chunk that is missing, as one that is damaged, makes
    reading fail, so no document is ever left out.
    """
    recipes = spark.read.schema(RECIPES).parquet(f"{path}/recipes")
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    size = check_manifest(recipes, manifest)
    chunks = spark.read.schema(PACK).parquet(f"{path}/packed").where("kind = 'chunks'").select("key", "n", "body")
    chunks = arrow_map(chunks, _checked(with_ids, size), "key binary, held long, crc long" + ", body binary" * with_ids)
    keys = F.transform(F.sequence(F.lit(0), (F.length("keys") / KEY).cast("int") - 1), lambda i: F.substring("keys", i * KEY + 1, F.lit(KEY)))
    asked = recipes.select("part", "row", F.posexplode(keys).alias("pos", "key")).join(chunks, "key", "left")
    one = F.struct("pos", "key", "held", "crc", *["body"] * with_ids)
    parts = asked.groupBy("part", "row").agg(F.sort_array(F.collect_list(one)).alias("parts"))
    starts = recipes.drop("keys").join(maybe_broadcast(manifest.select("part", "first")), "part")
    met = starts.join(parts, ["part", "row"], "left").select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n", "root", "parts")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return arrow_map(met, _whole(with_ids, size), schema)


def store_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Write the documents' ids to a new store and read back where each begins, its length and the crc32 of its ids."""
    path = path or new_path(docs.sparkSession, "tokens")
    write_store(docs, path, id_col, text_col)
    return read_store(docs.sparkSession, path, with_ids=False)
