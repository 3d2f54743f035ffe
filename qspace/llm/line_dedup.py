"""Drop lines that many documents share, with DataFrame functions only.

Lines are exploded once with their places, and their keys are hashed to 128 bits and written beside the hash of their row. Distinct
documents are counted per hash: equal lines of one document are combined before the first shuffle, which goes by line and document, so
that a line in a third of all documents is spread over all tasks, and counts are combined again before the second. The dropped
hashes find the places that go by a join with what was written; texts move once, with the places, and only those that lose lines are
taken apart again.

Defined cases: a null or empty text is one empty line with an empty key, which min_chars=1 never drops. Rows with one id are one
document, whatever their texts, and rows without an id are one together; every row is returned and is cut by its own text. An empty
table gives an empty result. Other columns stay as they are; kept_text, n_lines and n_dropped are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qspace.llm.common import BROADCAST_ROWS, SPACE_CHARS, small, stage

MIN_CHARS = 1
MIN_DOCUMENTS = 10


def stripped(line: Column) -> Column:
    """Without white space at either end. btrim() walks through the whole line, so it runs only where there is something to strip."""
    ends = [test(line, F.lit(c)) for c in SPACE_CHARS for test in (F.startswith, F.endswith)]
    found = ends[0]
    for end in ends[1:]:
        found = found | end
    return F.when(found, F.btrim(line, F.lit(SPACE_CHARS))).otherwise(line)


def folded(line: Column) -> Column:
    """A text that is equal for lines that differ in A-Z and a-z only.

    lower() is right for ASCII. Other lines are read as Latin-1 first, one character a byte: lower() then also changes the first bytes
    of two-byte characters, to ones that begin longer characters; as the number of bytes that follow tells them apart, no two lines
    that differ otherwise become equal.
    """
    ascii_only = F.octet_length(line) == F.char_length(line)
    return F.lower(F.when(ascii_only, line).otherwise(F.decode(line.cast("binary"), "ISO-8859-1")))


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_documents: int = MIN_DOCUMENTS,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """docs with three columns more: kept_text, n_lines, n_dropped. A column of these names in docs is replaced."""
    docs = docs.drop("kept_text", "n_lines", "n_dropped")
    body = F.coalesce(F.col(text_col), F.lit(""))
    row = [F.xxhash64(F.col(id_col)).alias("document"), F.xxhash64(F.lit(9), body).alias("body")]
    lines = docs.select(*row, F.posexplode(F.split(body, "\n")).alias("pos", "line"))
    lines = lines.select("document", "body", "pos", stripped(F.col("line")).alias("line")).where(F.char_length("line") >= min_chars)
    lines = lines.select("document", "body", "pos", folded(F.col("line")).alias("key"))
    lines = stage(lines.select("document", "body", "pos", F.xxhash64("key").alias("a"), F.xxhash64(F.lit(8), "key").alias("b")), "lines")
    counts = lines.groupBy("a", "b").agg(F.count_distinct("document").alias("n"))
    frequent = stage(counts.where(F.col("n") >= min_documents).select("a", "b"), "shared-lines")
    found = F.broadcast(frequent) if small(frequent, broadcast_rows) else frequent
    hits = lines.join(found, ["a", "b"]).groupBy("document", "body").agg(F.collect_set("pos").alias("gone"))
    joined = docs.select(F.struct("*").alias("row"), *row).join(hits, ["document", "body"], "left")
    text = F.coalesce(F.col(f"row.{text_col}"), F.lit(""))
    parts = joined.select("row", "gone", F.split(text, "\n").alias("parts"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone"))
    kept = F.array_join(F.transform(stay, lambda i: F.get("parts", i)), "\n")
    cut = parts.select(  # apart from the columns of docs, whose names may be any
        "row",
        F.when(F.col("gone").isNull(), text).otherwise(kept).alias("kept_text"),
        F.size("parts").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    return cut.select("row.*", "kept_text", "n_lines", "n_dropped")
