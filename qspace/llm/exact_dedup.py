"""Exact dedup of a batch against immutable snapshots.

A snapshot holds the digests of earlier documents: one row per digest with the smallest id and the number of rows, and, per shard of
digests, a static binary-fuse filter with 8-bit fingerprints. A batch's digests are grouped among themselves; each distinct one is
screened by its shard's filter. A negative is certainly new. Positives join the snapshot's exact buckets, and every row of a group
of two or more has its whole text compared with that of the row that stays; should texts of one digest differ, they are grouped anew
by text. Shards are numbered so that a filter's keys stay under a fixed count at every size of the input.

Defined cases: a null text is empty; repeated rows and rows with one id are reported as often as they come, and all rows with the
id that stays are kept; a null id counts as larger than any other. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qspace.llm.common import SPACE, maybe_broadcast, ship, stage

SHARD_KEYS = 50_000
FILTER_SCHEMA = "shard int, seed long, segment int, count int, bits binary"
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", " ")


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys + np.uint64(seed & (2**64 - 1))
    x = (x ^ (x >> np.uint64(33))) * _MIX1
    x = (x ^ (x >> np.uint64(33))) * _MIX2
    return x ^ (x >> np.uint64(33))


def _slots(keys: np.ndarray, seed: int, segment: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Three slots in consecutive segments, and the fingerprint."""
    h = _mix(keys, seed)
    first = ((h >> np.uint64(40)) * np.uint64(count) >> np.uint64(24)).astype(np.int64)
    mask = np.uint64(segment - 1)
    spread = _mix(h, 0x9E3779B97F4A7C15)
    at = [first * segment + ((spread >> np.uint64(20 * i)) & mask).astype(np.int64) + i * segment for i in range(3)]
    return np.stack(at), (h & np.uint64(0xFF)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """A binary-fuse filter of distinct 64-bit keys: seed, segment length, segments to begin in, fingerprints.

    Slots that one key alone uses are peeled round by round; fingerprints are then set in the opposite order, so that the three
    slots of each key give its fingerprint by exclusive or.
    """
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    segment = max(4, 1 << int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
    segment = min(segment, 1 << 18)
    size = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2))) if n > 1 else 3
    count = max(1, int(np.ceil(n * size / segment)) - 2)
    for attempt in range(200):
        seed = 0x5DEECE66D * (attempt + 1)
        if attempt and attempt % 10 == 0:
            count += 1 + count // 10
        slots, prints = _slots(keys, seed, segment, count)
        total = (count + 2) * segment
        degree = np.bincount(slots.ravel(), minlength=total)
        users = np.zeros(total, np.uint64)
        index = np.arange(n, dtype=np.uint64)
        for i in range(3):
            np.bitwise_xor.at(users, slots[i], index)
        alive, order = np.ones(n, bool), []
        ready = np.flatnonzero(degree == 1)
        while len(ready):
            key, pick = np.unique(users[ready].astype(np.int64), return_index=True)
            here = ready[pick]
            alive[key] = False
            order.append((key, here))
            touched = slots[:, key]
            for i in range(3):
                np.subtract.at(degree, touched[i], 1)
                np.bitwise_xor.at(users, touched[i], key.astype(np.uint64))
            again = np.unique(touched)
            ready = again[degree[again] == 1]
        if not alive.any():
            bits = np.zeros(total, np.uint8)
            for key, here in reversed(order):
                three = slots[:, key]
                bits[here] = 0
                bits[here] = prints[key] ^ bits[three[0]] ^ bits[three[1]] ^ bits[three[2]]
            return seed, segment, count, bits.tobytes()
    raise ValueError(f"no filter found for {n} keys")


def test_filter(keys: np.ndarray, seed: int, segment: int, count: int, bits: bytes) -> np.ndarray:
    """True where the key may be in the filter; never False for one that is."""
    table = np.frombuffer(bits, np.uint8)
    slots, prints = _slots(keys.astype(np.uint64), seed, segment, count)
    return prints == table[slots[0]] ^ table[slots[1]] ^ table[slots[2]]


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    found = build_filter(pdf["key64"].to_numpy())
    return pd.DataFrame([(int(pdf["shard"].iloc[0]), *found)], columns=["shard", "seed", "segment", "count", "bits"])


def _screen(batch: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    if len(batch):
        seen = np.zeros(len(batch), bool)
        for f in filters.itertuples():
            seen |= test_filter(batch["key64"].to_numpy(), f.seed, f.segment, f.count, f.bits)
        batch = batch.assign(seen=seen)
    else:
        batch = batch.assign(seen=pd.Series(dtype=bool))
    return batch[["dig", "keep_id", "n", "seen"]]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("dig"))


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("dig").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))


class Snapshot:
    """Immutable: the exact buckets and the filters of one set of digests."""

    def __init__(self, rows: DataFrame, shards: int):
        self.shards = shards
        ship(rows.sparkSession)
        self.buckets = stage(_groups(rows), "buckets")
        self.filters = stage(self.sharded(self.buckets).select("shard", "key64").groupBy("shard").applyInPandas(_build, FILTER_SCHEMA), "fuse")

    def sharded(self, groups: DataFrame) -> DataFrame:
        key = F.xxhash64("dig")
        return groups.withColumns({"key64": key, "shard": F.pmod(F.xxhash64(F.lit(3), F.col("dig")), F.lit(self.shards)).cast("int")})

    def screen(self, groups: DataFrame) -> DataFrame:
        """The batch's groups with seen: False is certain, True asks for the exact buckets."""
        left = self.sharded(groups).groupBy("shard")
        schema = "dig binary, keep_id long, n long, seen boolean"
        return left.cogroup(self.filters.groupBy("shard")).applyInPandas(_screen, schema)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row.

    Rows up to the id cut are the snapshot and the others the new batch; by default the ids are halved.
    """
    rows = stage(digests(docs, id_col, text_col), "digests")
    low, high, n = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    cut = cut if cut is not None else ((low or 0) + (high or 0)) // 2
    old = F.coalesce(F.col("doc_id") <= cut, F.lit(False))
    snapshot = Snapshot(rows.where(old), max(1, -(-n // SHARD_KEYS)))
    screened = stage(snapshot.screen(_groups(rows.where(~old))), "screened")
    positives = screened.where("seen").select("dig", F.col("keep_id").alias("b_keep"), F.col("n").alias("b_n"))
    merged = snapshot.buckets.join(positives, "dig", "full").select(
        "dig",
        F.least("keep_id", "b_keep").alias("keep_id"),
        (F.coalesce("n", F.lit(0)) + F.coalesce("b_n", F.lit(0))).alias("n"),
    )
    groups = merged.unionByName(screened.where("not seen").select("dig", "keep_id", "n"))
    several = maybe_broadcast(stage(groups.where("n > 1"), "groups"))
    differing = stage(_differing(docs, several, id_col, text_col), "differing").distinct()
    result = rows.join(several, "dig", "left").select(
        "doc_id", F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), "dig"
    )
    if not differing.isEmpty():
        result = _split(docs, result, differing, id_col, text_col)
    return result.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("dig")).alias("text_sha256"),
    )


def _differing(docs: DataFrame, several: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Digests of groups with a text that is not, byte for byte, that of the row that stays."""
    text = normalised(F.col(text_col))
    members = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t"), F.unhex(F.sha2(text, 256)).alias("dig"))
    members = members.join(several, "dig").select("doc_id", "dig", "t", "keep_id")
    stays = members.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("dig").agg(F.min("t").alias("stay"))
    # Spark splits a join's large groups only between plain exchanges: so the texts that stay are staged, and no distinct follows
    return members.join(stage(stays, "stays"), "dig").where(F.col("t") != F.col("stay")).select("dig")


def _split(docs: DataFrame, result: DataFrame, differing: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Group the rows of digests that stand for several texts by their text."""
    text = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t"), F.unhex(F.sha2(text, 256)).alias("dig"))
    rows = stage(rows.join(differing, "dig", "left_semi"), "collisions")
    by_text = rows.groupBy("dig", "t").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    anew = rows.join(by_text, ["dig", "t"]).select("doc_id", F.coalesce("keep_id", "doc_id").alias("keep_id"), "group_size", "dig")
    return result.join(differing, "dig", "left_anti").select("doc_id", "keep_id", "group_size", "dig").unionByName(anew)
