"""Near-duplicate groups by circulant MinHash.

A text's set holds the hashes of its word shingles. One permutation scatters them over a ring of 2**32 places; a second one, shifted
around the ring by 0, 1, 2, ... places, gives all coordinates of the signature, of which 16 bits each are kept. Documents with equal
sets form a class, and from there on classes stand for their documents. Bands of coordinates put classes into buckets; a candidate
pair is one from a bucket whose sizes and signatures do not rule the similarity out (PLAY is over four standard deviations). Each
candidate is confirmed on the full sets of both texts. Confirmed links are joined into components by large-star and small-star steps.

No bucket's pairs are written out: first each class is tried with the likeliest of its buckets' smallest members. Buckets that still
hold several components are then compared in blocks of a bounded number of classes: first by signature, which leaves the classes
with a likely partner in another component, then by these classes' full sets, the likeliest pairs first and those left out that a
link found before has joined; each pair is looked at in the first bucket that it shares. So a link between any two components is
found, whatever a bucket's size, and a block gives fewer links than it has classes.
With BANDS x ROWS a pair at the threshold of 0.8 shares no bucket with a chance of about 6e-7.

Defined cases: null and empty texts have an empty set and are linked with nothing; with fewer words than a shingle the whole sequence
is one; repeated rows are copies of each other, and each is reported; rows with a null id are alone and kept, without a component;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qspace.llm.common import arrow_map, maybe_broadcast, records, stage

WORDS, THRESHOLD = 5, 80
BANDS, ROWS = 36, 5
COORDINATES = BANDS * ROWS
#: By so much may a signature's estimate fall short of the threshold.
PLAY = 0.135
#: Members of a bucket that are compared with each other in one block.
BLOCK = 256
#: Sets that a task which confirms pairs remembers, with this many hashes in all.
CACHE_SETS, CACHE_HASHES = 4_000, 4_000_000
_SHIFTS = np.arange(COORDINATES, dtype=np.uint32)[:, None]
_M1, _M2 = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted set of 64-bit hashes of a text's shingles. bytes.lower() and bytes.split() know ASCII only."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    size = min(words, len(parts))
    n = len(parts) - size + 1
    out = np.full(n, size, np.uint64)
    for j in range(size):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(out ^ (out >> np.uint64(32)))


def signature(hashes: np.ndarray) -> np.ndarray:
    """Coordinate k is the least of the second permutation over the places shifted by k."""
    places = ((hashes * np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(places), 1024):
        x = places[None, i : i + 1024] + _SHIFTS
        x *= _M1
        x ^= x >> np.uint32(15)
        x *= _M2
        np.minimum(least, x.min(axis=1), out=least)
    return (least ^ (least >> np.uint32(16))).astype("<u2")


def _signed(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, prints, signs = [], [], [], []
            for doc_id, text in records(batch, "doc_id", "text"):
                s = shingles(text, words)
                ids.append(doc_id)
                sizes.append(len(s))
                prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                signs.append(signature(s).tobytes() if len(s) else None)
            arrays = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(signs, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "fp", "sig"])

    return run


def _bands(classes: DataFrame, *more: str) -> DataFrame:
    width = 2 * ROWS
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("sig", i * width + 1, F.lit(width))))
    return classes.select("rep", *more, F.posexplode(keys).alias("band", "key"))


def _possible(n_a, n_b, threshold: int):
    return 100 * F.least(n_a, n_b) >= threshold * F.greatest(n_a, n_b)


def _likely(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, COORDINATES) for c in ("sig_a", "sig_b"))
                est = (a == b).mean(axis=1)
            else:
                est = np.zeros(0)
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(est)], names=["a", "b", "est"])
            yield out.filter(pa.array(est >= threshold / 100 - PLAY))

    return run


def similar(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    """Whether two sorted sets have at least threshold per cent of their union in common."""
    few, many = (a, b) if len(a) <= len(b) else (b, a)
    if not len(few):
        return False
    at = np.searchsorted(many, few)
    both = int((many[np.minimum(at, len(many) - 1)] == few).sum())
    return 100 * both >= threshold * (len(a) + len(b) - both)


class _Sets:
    """Shingle sets by id, the latest ones kept."""

    def __init__(self, words: int):
        self.words, self.held, self.size = words, {}, 0

    def __call__(self, doc_id: int, text: str) -> np.ndarray:
        found = self.held.get(doc_id)
        if found is None:
            found = shingles(text, self.words)
            if len(self.held) >= CACHE_SETS or self.size + len(found) > CACHE_HASHES:
                self.held, self.size = {}, 0
            self.held[doc_id] = found
            self.size += len(found)
        return found


def _confirm(words: int, threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets(words)
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("a", "b"))
            text_a, text_b = batch.column("text_a"), batch.column("text_b")
            out: list[tuple[int, int]] = []
            for i in range(batch.num_rows):
                mine = sets.held.get(a[i])
                mine = sets(a[i], text_a[i].as_py()) if mine is None else mine
                other = sets.held.get(b[i])
                other = sets(b[i], text_b[i].as_py()) if other is None else other
                if similar(mine, other, threshold):
                    out.append((a[i], b[i]))
            arrays = [pa.array([x[i] for x in out], pa.int64()) for i in range(2)]
            yield pa.RecordBatch.from_arrays(arrays, names=["a", "b"])

    return run


def confirmed(texts: DataFrame, pairs: DataFrame, words: int, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. Only texts that are in a pair move, each to the partner that it has as a."""
    small = maybe_broadcast(pairs)
    ones = texts.join(maybe_broadcast(stage(pairs.select(F.col("a").alias("doc_id")).distinct(), "firsts")), "doc_id", "left_semi")
    ones = ones.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    others = texts.join(small.withColumnRenamed("b", "doc_id"), "doc_id").select("a", F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    met = others.join(ones.hint("merge"), "a").select("a", "b", "text_a", "text_b")
    return stage(arrow_map(met, _confirm(words, threshold), "a long, b long").distinct(), "links")


def components(links: DataFrame) -> DataFrame:
    """(node, least): for each node of a link the least node that it reaches, itself excepted."""
    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
        large = stage(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "large")
        least = stage(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        met = large.join(least, "u")
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = stage(small.where("u != v").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("least"))
        before = now


def _likely_pairs(rows: list[tuple], threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and estimate of the likely pairs of unlike components in a block of (band, side, rep, comp, n, sig)."""
    band, side, _, comp, n = (np.array([r[i] for r in rows], np.int64) for i in range(5))
    sig = np.frombuffer(b"".join(r[5] for r in rows), "<u2").reshape(len(rows), COORDINATES)
    first, second, ests = [], [], []
    for i in range(len(rows) - 1):
        ok = (comp[i + 1 :] != comp[i]) & (100 * np.minimum(n[i + 1 :], n[i]) >= threshold * np.maximum(n[i + 1 :], n[i]))
        if side[0] >= 0:  # two blocks: only across
            ok &= side[i + 1 :] != side[i]
        j = np.flatnonzero(ok) + i + 1
        if len(j):
            same = sig[j] == sig[i]
            est = same.mean(axis=1)
            shared = same.reshape(len(j), BANDS, ROWS).all(axis=2).argmax(axis=1)
            good = (est >= threshold / 100 - PLAY) & (shared == band[i])
            second.append(j[good])
            first.append(np.full(len(second[-1]), i))
            ests.append(est[good])
    if not first:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(first), np.concatenate(second), np.concatenate(ests)


BLOCK_COLUMNS = ("band", "side", "rep", "comp", "n", "sig")
BLOCK_SCHEMA = "block long, band int, side int, rep long, comp long, n long, sig binary"


def _blocks(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[int, list[tuple]]]:
    """Blocks with their rows, which follow each other."""
    at, rows = None, []
    for batch in batches:
        for block, *rest in records(batch, "block", *columns):
            if block != at:
                if rows:
                    yield at, rows
                at, rows = block, []
            rows.append(tuple(rest))
    if rows:
        yield at, rows


def _suspects(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        for block, rows in _blocks(batches, *BLOCK_COLUMNS):
            if len({r[3] for r in rows}) > 1:
                i, j, _ = _likely_pairs(rows, threshold)
                out = [(block, *rows[k]) for k in np.union1d(i, j)]
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x[k] for x in out], t) for k, t in enumerate(types)], names=["block", *BLOCK_COLUMNS]
                    )

    return run


def _links(words: int, threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets(words)
        for _, rows in _blocks(batches, *BLOCK_COLUMNS, "text"):
            i, j, est = _likely_pairs(rows, threshold)
            joined = {r[3]: r[3] for r in rows}

            def root(x: int, joined: dict[int, int] = joined) -> int:
                while joined[x] != x:
                    joined[x] = x = joined[joined[x]]
                return x

            out = []
            for k in np.argsort(-est, kind="stable"):
                x, y = rows[i[k]], rows[j[k]]
                a, b = root(x[3]), root(y[3])
                if a != b and similar(sets(x[2], x[6]), sets(y[2], y[6]), threshold):
                    joined[max(a, b)] = min(a, b)
                    out.append((x[2], y[2]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], names=["a", "b"])

    return run


def across(texts: DataFrame, classes: DataFrame, reached: DataFrame, words: int, threshold: int) -> DataFrame:
    """Confirmed links between components that meet in a bucket."""
    labelled = classes.join(maybe_broadcast(reached), F.col("rep") == F.col("node"), "left")
    labelled = labelled.select("rep", "n", "sig", F.coalesce("least", "rep").alias("comp"))
    bands = _bands(labelled, "comp")
    mixed = bands.groupBy("key").agg(F.count(F.lit(1)).alias("held"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    mixed = maybe_broadcast(stage(mixed.where("low != high").select("key", F.ceil(F.col("held") / BLOCK).alias("blocks")), "mixed"))
    members = _bands(labelled, "comp", "n", "sig").join(mixed, "key").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    spread = members.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("with"), -1).otherwise((F.col("own") > F.col("with")).cast("int"))
    block = F.xxhash64("key", F.least("own", "with"), F.greatest("own", "with"))
    rows = spread.select(block.alias("block"), "band", side.alias("side"), "rep", "comp", "n", "sig")
    rows = rows.repartition("block").sortWithinPartitions("block")
    suspects = stage(arrow_map(rows, _suspects(threshold), BLOCK_SCHEMA), "suspects")
    asked = maybe_broadcast(stage(suspects.select(F.col("rep").alias("doc_id")).distinct(), "asked"))
    known = texts.join(asked, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    met = suspects.join(known, F.col("rep") == F.col("doc_id")).select("block", *BLOCK_COLUMNS, "text")
    met = met.repartition("block").sortWithinPartitions("block")
    return stage(arrow_map(met, _links(words, threshold), "a long, b long").distinct(), "links")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row; threshold is in per cent of the union."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = stage(arrow_map(texts, _signed(words), "doc_id long, n long, fp binary, sig binary"), "signed")
    named = signed.where("doc_id is not null and fp is not null")
    reps = stage(named.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    several = maybe_broadcast(reps.where("copies > 1").select("fp", "rep"))
    member = stage(signed.select("doc_id", "n", "fp").join(several, "fp", "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")), "members")
    first = named.join(maybe_broadcast(reps), (named["fp"] == reps["fp"]) & (named["doc_id"] == reps["rep"])).select("rep", "n", "sig")
    classes = stage(first.dropDuplicates(["rep"]), "reps")
    texts = texts.where("doc_id is not null")

    hubs = _bands(classes).groupBy("key").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("held")).where("held > 1").select("key", "hub")
    hubs = maybe_broadcast(stage(hubs, "hubs"))
    tries = _bands(classes).join(hubs, "key").where("rep != hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    tries = maybe_broadcast(stage(tries, "tries"))
    left = tries.join(classes.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b")), "b")
    both = left.join(classes.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a")), "a")
    rated = arrow_map(both.where(_possible(F.col("n_a"), F.col("n_b"), threshold)).select("a", "b", "sig_a", "sig_b"), _likely(threshold), "a long, b long, est double")
    best = rated.groupBy("b").agg(F.max(F.struct("est", (-F.col("a")).alias("a"))).alias("best"))
    pairs = stage(best.select((-F.col("best.a")).alias("a"), "b"), "pairs")
    links = confirmed(texts, pairs, words, threshold)
    reached = components(links)
    links = links.unionByName(across(texts, classes, reached, words, threshold))
    reached = components(links)
    result = member.join(maybe_broadcast(reached), F.col("rep") == F.col("node"), "left")
    component = F.coalesce("least", "rep")
    return result.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )
