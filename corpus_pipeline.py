"""The corpus pipeline: quality rules, line dedup, near dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read back as the next stage's docs.
All but the last return the columns of documents; every stage works on all rows that its predecessor kept. Without labels the quality
stage applies its base rules only; empty documents pass through every stage. n_chars follows the text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qspace.llm.common import collect_heaps, maybe_broadcast, read, remove_staged, stage, staged_count
from qspace.llm.line_dedup import line_dedup
from qspace.llm.mixing import mix
from qspace.llm.near_dedup import near_dedup
from qspace.llm.quality import quality_filter, train
from qspace.llm.sentencepiece_bpe import encode_decode

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def from_small_heaps(step: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The stage begins with heaps that hold nothing of the stages before, as heap and Python workers share an executor's memory."""

    @wraps(step)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        collect_heaps(spark)
        return step(spark, docs, sf_dir)

    return run


@from_small_heaps
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the trees reject go."""
    return quality_filter(docs.select(*COLUMNS), train(docs, read(spark, sf_dir, "labels")))


@from_small_heaps
def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten or more documents share go from all of them."""
    cut = line_dedup(docs.select(*COLUMNS))
    text = F.col("kept_text")
    return cut.select("doc_id", text.alias("text"), "lang", "source", F.char_length(text).cast("long").alias("n_chars"))


@from_small_heaps
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8 the document with the smallest id stays."""
    gone = stage(near_dedup(docs).where("not kept").select("doc_id"), "near-copies")
    return docs.select(*COLUMNS).join(maybe_broadcast(gone), "doc_id", "left_anti")


@from_small_heaps
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in as many copies as the mix takes, none included."""
    mixed = mix(docs.select(*COLUMNS))
    return mixed.select(*COLUMNS, F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy")).select(*COLUMNS)


@from_small_heaps
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The number of ids and the digests of ids and decoded text of each row."""
    return encode_decode(docs, with_ids=False)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", drop_shared_lines),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Trees, MinHash and SentencePiece have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Once a stage is written, what its operator and the stage before it left in the shared folder goes."""
    docs, before = read(spark, sf_dir, "documents"), staged_count()
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
        written = staged_count() - 1
        remove_staged(before, written)
        before = written
    return STAGES[-1][1](spark, docs, sf_dir)
