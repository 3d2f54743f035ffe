r"""Chat formatting from an event log, with DataFrame functions only.

A log has one row per event: conversation, turn, sequence number, kind, role and text. Kinds are "message" (opens a message),
"delta" (appends to the turn's last message), "edit" (replaces its text) and "regenerate" (empties it, later deltas build it anew);
a null kind is a message. Events are partitioned by conversation and turn, sorted by sequence and folded into final messages; these are
grouped by block of turns and rendered, and a second grouping joins the blocks. So one long conversation is folded by many tasks, only
its rendered text meets in one row, and all work grows with the events, whether of many turns or of one.

The template is <|im_start|>role\ntext<|im_end|>\n. In roles and texts a backslash is doubled and "<|" becomes "<\|", so that no
text can hold a control string and unescape() gives back exactly what was written; in roles a line feed becomes "\n".

Defined cases: null roles and texts are empty; null conversations form one conversation; null turns and sequence numbers come first;
events that tie are ordered by kind, role and text; a delta, edit or regenerate without a message opens one; repeated message rows
are messages of their own; events of an unknown kind are left out, and with them a conversation that has no others. An empty log gives an empty result, and other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: Turns folded by one group.
BLOCK = 64
KINDS = ("message", "delta", "edit", "regenerate")


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.when(~F.contains(text, F.lit("\\")), text).otherwise(F.regexp_replace(text, r"\\([\\|])", "$1"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    """Doubled backslashes separate the pieces in which a single one begins an escape."""
    pieces = F.transform(
        F.split(role, r"\\\\"), lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|"))
    )
    return F.when(~F.contains(role, F.lit("\\")), role).otherwise(F.array_join(pieces, "\\"))


def _folded(events: DataFrame) -> DataFrame:
    """The messages that events (conv_id, turn, seq, rank, role, text) leave, numbered within their turn.

    A message's text is what its last event but deltas wrote, with the deltas after it; so the events of a turn are numbered by the
    message that they touch and by how often it was written anew, and only the last writing is put together.
    """
    turn = Window.partitionBy("conv_id", "turn").orderBy("seq", "rank", "role", "text")
    opens = (F.col("rank") == 0) | (F.col("at") == 1)
    told = events.withColumn("at", F.row_number().over(turn))
    told = told.withColumn("text", F.when(F.col("rank") == 3, "").otherwise(F.col("text")))
    turn = Window.partitionBy("conv_id", "turn").orderBy("at")
    numbered = told.select("*", F.sum(opens.cast("int")).over(turn).alias("message"), F.sum((opens | (F.col("rank") != 1)).cast("int")).over(turn).alias("writing"))
    pieces = F.sort_array(F.collect_list(F.struct("at", "text")))
    written = numbered.groupBy("conv_id", "turn", "message", "writing").agg(F.min(F.struct("at", "role")).alias("first"), pieces.alias("pieces"))
    last = written.groupBy("conv_id", "turn", "message").agg(F.min("first").alias("first"), F.max_by("pieces", "writing").alias("pieces"))
    return last.select("conv_id", "turn", "message", F.col("first.role").alias("role"), F.array_join(F.col("pieces.text"), "").alias("text"))


def _before(lengths: Column) -> Column:
    """For each of some lengths the sum of those before it. It runs over the blocks of a conversation, not over its turns."""
    sums = F.aggregate(lengths, F.array(F.lit(0).cast("long")), lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n)))
    return F.slice(sums, F.lit(1), F.size(lengths))


def _placed(lengths: Column, loss_role: str) -> Column:
    """Where the turns of one block lie in the block's text."""
    places = _before(F.transform(lengths, lambda x: (x["head"] + x["body"] + len(END)).cast("long")))
    return F.zip_with(lengths, places, lambda x, at: F.struct(
        x["role"].alias("role"), at.alias("at"), (at + x["head"]).alias("start"), x["body"].cast("long").alias("length"), (x["role"] == loss_role).alias("loss")
    ))


def chat_format(
    events: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    seq_col: str | None = None,
    kind_col: str | None = None,
    role_col: str = "role",
    text_col: str = "text",
    loss_role: str = "assistant",
    block: int = BLOCK,
) -> DataFrame:
    """One row per conversation: conv_id, formatted, and turns, an array of (role, at, start, length, loss).

    at is where the turn begins in formatted, start and length say where its escaped text lies, in code points, and loss whether
    that text counts for the loss. seq_col and kind_col may be missing: then each row is a message.
    """
    log = events.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        (F.col(seq_col) if seq_col else F.col(turn_col)).cast("long").alias("seq"),
        (F.array_position(F.array(*map(F.lit, KINDS)), F.coalesce(F.col(kind_col), F.lit("message"))) - 1 if kind_col else F.lit(0)).cast("int").alias("rank"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    if kind_col:
        log = _folded(log.where("rank >= 0")).withColumnRenamed("message", "seq")
    part = F.coalesce(F.floor(F.col("turn") / block), F.lit(-(2**62)))
    blocks = log.groupBy("conv_id", part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("turn", "seq", "role", "text"))).alias("messages"))
    rendered = F.transform(
        "messages",
        lambda m: F.struct(
            F.concat(F.lit(START), escape_role(m["role"]), F.lit("\n")).alias("head"), escape(m["text"]).alias("body"), m["role"].alias("role")
        ),
    )
    pieces = blocks.select("conv_id", "part", rendered.alias("r")).select(
        "conv_id",
        F.struct(
            "part",
            F.array_join(F.transform("r", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "").alias("text"),
            F.transform(
                "r", lambda x: F.struct(x["role"].alias("role"), F.char_length(x["head"]).alias("head"), F.char_length(x["body"]).alias("body"))
            ).alias("lengths"),
        ).alias("piece"),
    )
    placed = pieces.select("conv_id", F.struct("piece.part", "piece.text", _placed(F.col("piece.lengths"), loss_role).alias("turns"), F.char_length("piece.text").cast("long").alias("length")).alias("piece"))
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list("piece")).alias("p"))
    whole = whole.select("conv_id", "p", _before(F.col("p.length")).alias("before"))
    moved = F.zip_with("p", "before", lambda x, by: F.transform(x["turns"], lambda t: F.struct(
        t["role"].alias("role"), (t["at"] + by).alias("at"), (t["start"] + by).alias("start"), t["length"].alias("length"), t["loss"].alias("loss")
    )))
    return whole.select("conv_id", F.array_join(F.col("p.text"), "").alias("formatted"), F.flatten(moved).alias("turns"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, messages as (role, text) parsed from the rendered text alone, and loss_text cut out by the mask's spans."""
    segments = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, 2**31 - 1)
    parsed = F.transform(
        "segments",
        lambda s: F.struct(
            unescape_role(F.substring_index(s, "\n", 1)).alias("role"),
            unescape(s.substr(F.char_length(F.substring_index(s, "\n", 1)) + 2, F.char_length(s) - F.char_length(F.substring_index(s, "\n", 1)) - 1 - len(END))).alias("text"),
        ),
    )
    spans = F.zip_with(
        "segments",
        "turns",
        lambda s, t: F.when(t["loss"], unescape(s.substr((t["start"] - t["at"] - len(START) + 1).cast("int"), t["length"].cast("int")))),
    )
    return formatted.select("conv_id", "formatted", "turns", segments.alias("segments")).select(
        "conv_id", "formatted", parsed.alias("messages"), F.array_join(spans, "").alias("loss_text")
    )
