"""Mixing sources to target weights by entropy balancing.

Each source has a target number of words. Among all rates between 0 and max_copies that reach it, the balanced ones stay closest to 1
in relative (bounded) entropy: the rate of a document with x times its source's mean size is

    max_copies / (1 + (max_copies - 1) * exp(-tilt * x)),

with one dual variable, the tilt, per source. The dual is convex; Newton steps, kept inside a bracket, find its minimum. A rate
depends on source and size alone, so every step is a distributed aggregate over the counts by source and size, not over documents.
The counts are then rounded, the large sizes first and each size making up for the ones before it, and every class of equal source
and size hands its copies to its documents in the order of a hash of their ids. Large classes are ranked in buckets.

Defined cases: a null text has size 0; a null source is a source and comes last; documents of size 0 count one copy and no words;
repeated rows are documents of their own; an empty table gives an empty result; columns of docs stay, those added are size,
source_size, target, copies and taken and replace columns of these names.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qspace.llm.common import maybe_broadcast, ship, stage

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
#: Ranked together are at most about so many documents.
BUCKET_ROWS = 100_000
STEPS, TOLERANCE = 60, 1e-9
ADDED = ("size", "source_size", "target", "copies", "taken")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(counts: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """source, source_size, n_docs, target from source, size and n, one row per source.

    Sources in order take weights in turn and share all words by them. A target over most times its source is cut to that and the
    rest shared again; in the order of cap by weight, the sources that are cut come first, so one pass finds them all.
    """
    each = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (order % len(weights) + 1).cast("int"))
    ranked = each.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * most).cast("double"))
    whole = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    ranked = ranked.withColumns({"total": F.sum("source_size").over(everything), "weights": F.sum("weight").over(everything)})
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    cut = ranked.withColumn("cut", F.col("cap") * open_weight < left * F.col("weight"))
    spent, used = (F.coalesce(F.sum(F.when(F.col("cut"), F.col(c))).over(everything), F.lit(0.0)) for c in ("cap", "weight"))
    cut = cut.withColumns({"spent": spent, "used": used})
    share = (F.col("total") - F.col("spent")) * F.col("weight") / (F.col("weights") - F.col("used"))
    return cut.select(
        "source",
        "source_size",
        "n_docs",
        F.when(F.col("cut") | (F.col("weights") == F.col("used")), F.col("cap")).otherwise(F.least(share, F.col("cap"))).alias("target"),
    )


def _rate(x: Column, tilt: Column, most: int) -> Column:
    return most / (1 + (most - 1) * F.exp(F.least(F.greatest(-tilt * x, F.lit(-700.0)), F.lit(700.0))))


def balance(counts: DataFrame, goal: DataFrame, most: int = MAX_COPIES) -> DataFrame:
    """goal with the tilt of each source; the tilt is null where a source is wanted whole, at most copies of everything."""
    uniform = F.least(F.greatest(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)), F.lit(1e-9)), F.lit(most - 1e-9))
    full = F.col("target") >= F.col("source_size") * most * (1 - 1e-12)
    state = goal.withColumns(
        {
            "tilt": F.when(~full, F.log(uniform * (most - 1) / (most - uniform))),
            "low": F.lit(-1e9),
            "high": F.lit(1e9),
            "off": F.lit(1.0),
        }
    )
    state = stage(state, "tilts")
    x = F.col("size") * F.col("n_docs") / F.greatest(F.col("source_size"), F.lit(1))
    for _ in range(STEPS):
        open_rows = state.where(F.col("tilt").isNotNull() & (F.col("off") > TOLERANCE))
        if open_rows.isEmpty():
            break
        key = open_rows.select(F.col("source").alias("s"), "tilt", "n_docs", "source_size")
        rate = _rate(x, F.col("tilt"), most)
        words = F.col("size") * F.col("n")
        sums = (
            counts.join(maybe_broadcast(key), F.col("source").eqNullSafe(F.col("s")))
            .groupBy("s")
            .agg(F.sum(words * rate).alias("got"), F.sum(words * x * rate * (1 - rate / most)).alias("slope"))
        )
        over = F.col("got") > F.col("target")
        low, high = F.when(over, F.col("low")).otherwise(F.col("tilt")), F.when(over, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - F.try_divide(F.col("got") - F.col("target"), F.col("slope"))
        inside = F.coalesce((newton > low) & (newton < high), F.lit(False))
        off = F.abs(F.col("got") - F.col("target")) / F.greatest(F.col("target"), F.lit(1.0))
        stepped = open_rows.join(sums, F.col("source").eqNullSafe(F.col("s"))).select(
            "source",
            "source_size",
            "n_docs",
            "target",
            F.when(off <= TOLERANCE, F.col("tilt")).when(inside, newton).otherwise((low + high) / 2).alias("tilt"),
            low.alias("low"),
            high.alias("high"),
            off.alias("off"),
        )
        rest = state.where(F.col("tilt").isNull() | (F.col("off") <= TOLERANCE))
        state = stage(rest.unionByName(stepped), "tilts")
    return state.select("source", "source_size", "n_docs", "target", "tilt")


def _round(most: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Whole copies for the classes of one source, of which there are as many as it has sizes."""
        pdf = pdf.sort_values("size", ascending=False)
        rows = list(zip(pdf["size"].tolist(), pdf["n"].tolist(), pdf["rate"].tolist(), strict=True))
        error, out = 0.0, []
        for size, n, rate in rows:
            m = min(most * n, max(0, round(rate * n + (error / size if size else 0.0))))
            error += (rate * n - m) * size
            out.append(m)
        for i, (size, n, _) in enumerate(rows):  # what is left because small sizes had reached a bound
            if size and abs(error) > size / 2:
                m = min(most * n, max(0, out[i] + round(error / size)))
                error -= (m - out[i]) * size
                out[i] = m
        return pdf.assign(copies=out)[["source", "size", "n", "copies", "source_size", "target"]]

    return run


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MAX_COPIES,
) -> DataFrame:
    """docs with size, source_size, target, copies and taken = copies * size."""
    ship(docs.sparkSession)
    docs = docs.drop(*ADDED)
    source, doc_id = F.col(source_col), F.col(id_col)
    sized = docs.select(F.struct("*").alias("row"), source.alias("source"), doc_id.alias("id"), word_count(F.col(text_col)).alias("size"))
    counts = stage(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "counts")
    state = balance(counts, stage(targets(counts, weights, most), "targets"), most)
    state = stage(state, "balanced")
    key = state.withColumnRenamed("source", "s")
    x = F.col("size") * F.col("n_docs") / F.greatest(F.col("source_size"), F.lit(1))
    rate = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(F.coalesce(_rate(x, F.col("tilt"), most), F.lit(float(most))))
    rated = counts.join(maybe_broadcast(key), F.col("source").eqNullSafe(F.col("s"))).select(
        "source", "size", "n", rate.alias("rate"), "source_size", "target"
    )
    schema = "source string, size long, n long, copies long, source_size long, target double"
    classes = stage(rated.groupBy("source").applyInPandas(_round(most), schema), "classes")
    largest = classes.agg(F.max("n")).first()[0] or 0
    buckets = max(64, -(-largest // BUCKET_ROWS))
    tag = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")).alias("tag")
    bucket = F.pmod(F.xxhash64(F.lit(6), "id"), F.lit(buckets)).alias("bucket")
    tagged = sized.select("row", "id", "size", tag, bucket)
    held = tagged.groupBy("tag", "size", "bucket").agg(F.count(F.lit(1)).alias("held"))
    classes = classes.select(tag, "size", "n", "copies", "source_size", "target")
    upto = F.sum("held").over(Window.partitionBy("tag", "size").orderBy("bucket"))
    over = F.col("copies") % F.col("n")
    quota = held.join(classes, ["tag", "size"]).withColumn("upto", upto)
    extra = F.floor(over * F.col("upto") / F.col("n")) - F.floor(over * (F.col("upto") - F.col("held")) / F.col("n"))
    every = F.floor(F.col("copies") / F.col("n"))
    quota = stage(quota.select("tag", "size", "bucket", "source_size", "target", every.alias("every"), extra.alias("extra")), "quota")
    rank = F.row_number().over(Window.partitionBy("tag", "size", "bucket").orderBy(F.xxhash64(F.lit(7), "id"), "id"))
    copies = (F.col("every") + F.when(rank <= F.col("extra"), 1).otherwise(0)).cast("long")
    mixed = tagged.join(quota, ["tag", "size", "bucket"]).withColumn("copies", copies)
    own = [F.col("row").getField(c).alias(c) for c in docs.columns]  # under their struct, the columns of docs clash with no name used here
    return mixed.select(*own, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
