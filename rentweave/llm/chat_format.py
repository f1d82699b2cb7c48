"""Chat formatting by prefix-target expansion. DataFrame operations only.

A conversation becomes one stream of formatted turns. Every assistant turn is an example of its own: all turns before it as context,
and its reply alone under the loss mask. An example is always a prefix of its conversation's stream, so the expansion names it by
offsets into the stream (`examples`) and repeats no context; the stored size is that of the turns, not of their square. `example_texts`
writes the strings out for a consumer that wants them, which is quadratic in a conversation's turns by definition.

Offsets come from prefix sums on two levels, runs of RUN turn numbers and the turns within a run, so a conversation with a third of all rows
is dealt over many tasks. (Rows of one conversation that all carry nearly the same turn number would share a run.)

Template: ``<|im_start|>role<|im_sep|>text<|im_end|>``. Control strings inside roles and texts, its own and those of other common
templates, get a backslash after their first character; a string that already looks like this gets one more, so the way back is exact.

Defined results: null role or text: empty; a null conv_id is a conversation; null turn numbers come first; turns of one
number are ordered by role and text; repeated rows are turns of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template's marks, and the control strings of common chat templates.
OPEN, SEP, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = r"\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|system\|>|\|user\|>|\|assistant\|>|\|endoftext\|>|/?s>|/?INST\]"
TRAINED = "assistant"
RUN = 1024


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[]\\*)({CONTROL})", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[]\\*)\\({CONTROL})", "$1$2")


def format_turns(turns: DataFrame) -> DataFrame:
    """The streams: (conv_id, turn, role, piece, start, stop, loss_start, loss_stop), offsets in code points from the start of the
    conversation's stream; the last two are null for turns that are not trained on."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    rows = rows.withColumn("head", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(SEP))).withColumn("body", escape(F.col("text")))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(CLOSE))).withColumn("size", F.char_length("piece").cast("long"))
    rows = rows.withColumn("run", F.coalesce(F.floor(F.col("turn") / RUN), F.lit(-(1 << 62)))).withColumn("conv", F.struct(F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit(0)).alias("id")))
    before = Window.partitionBy("conv").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy("conv", "run").agg(F.sum("size").alias("all")).select("conv", "run", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("conv", "run").orderBy(F.asc_nulls_first("turn"), "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("upto", F.sum("size").over(within)).join(runs, ["conv", "run"])
    stop = F.col("base") + F.col("upto")
    start = stop - F.col("size")
    trained = F.col("role") == TRAINED
    first = start + F.char_length("head")
    return placed.select(
        "conv_id", "turn", "role", "piece", start.alias("start"), stop.alias("stop"),
        F.when(trained, first).alias("loss_start"), F.when(trained, first + F.char_length("body")).alias("loss_stop"),
    )


def examples(stream: DataFrame) -> DataFrame:
    """One row for every assistant turn: (conv_id, turn, context_stop, loss_start, loss_stop, stop). Its text is the conversation's stream
    up to ``stop``; context is what lies before ``context_stop``."""
    return stream.filter(F.col("loss_start").isNotNull()).select(
        "conv_id", "turn", F.col("start").alias("context_stop"), "loss_start", "loss_stop", "stop"
    )


def example_texts(stream: DataFrame) -> DataFrame:
    """``examples`` with their whole text written out."""
    whole = stream.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("start", "piece"))).alias("p"))
    whole = whole.select(F.col("conv_id").alias("own"), F.array_join("p.piece", "").alias("all"))
    found = examples(stream)
    found = found.join(whole, found["conv_id"].eqNullSafe(whole["own"]))
    return found.select(*examples(stream).columns, F.substring("all", F.lit(1), F.col("stop").cast("int")).alias("text"))


def read_examples(stream: DataFrame) -> DataFrame:
    """``examples`` with the text under their loss mask, unescaped, read from the turn of the stream that they end with."""
    turns = stream.select(F.col("conv_id").alias("own"), F.col("start").alias("begin"), "piece")
    found = examples(stream)
    found = found.join(turns, found["conv_id"].eqNullSafe(turns["own"]) & (found["context_stop"] == turns["begin"]))
    masked = F.substring("piece", (F.col("loss_start") - F.col("begin") + 1).cast("int"), (F.col("loss_stop") - F.col("loss_start")).cast("int"))
    return found.select("conv_id", "turn", "context_stop", "loss_start", "loss_stop", "stop", unescape(masked).alias("loss"))


def read_back(stream: DataFrame) -> DataFrame:
    """Each formatted turn read again: (conv_id, start, stop, role, text)."""
    inner = F.substring("piece", F.lit(len(OPEN) + 1), F.char_length("piece") - (len(OPEN) + len(CLOSE)))
    parts = stream.withColumn("inner", inner).withColumn("role_at", F.instr("inner", SEP))
    return parts.select(
        "conv_id",
        "start",
        "stop",
        unescape(F.substring("inner", F.lit(1), F.col("role_at") - 1)).alias("role"),
        unescape(F.substring("inner", F.col("role_at") + len(SEP), F.char_length("inner"))).alias("text"),
    )


def digests(stream: DataFrame) -> DataFrame:
    """Per conversation what its turns hold and what its examples train on. The digest of a whole conversation needs its text in one value."""
    no = F.lit(None)
    said = F.concat("role", F.lit("\n"), "text", F.lit("\n"))
    turns = read_back(stream).select("conv_id", "start", "stop", said.alias("said"), no.cast("string").alias("loss"), no.cast("long").alias("chars"))
    trained = read_examples(stream).select("conv_id", F.col("context_stop").alias("start"), no.cast("long").alias("stop"), no.cast("string").alias("said"), "loss", F.col("stop").alias("chars"))
    whole = turns.unionByName(trained).groupBy("conv_id").agg(
        F.count("said").alias("n_turns"), F.max("stop").alias("formatted_chars"), F.count("loss").alias("n_examples"), F.sum("chars").alias("chars"),
        F.array_sort(F.collect_list(F.struct("start", "said", "loss"))).alias("all"),
    )
    loss = F.array_join("all.loss", "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join("all.said", ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
        F.col("n_examples").cast("long").alias("n_examples"),
        F.coalesce("chars", F.lit(0)).cast("long").alias("example_chars"),
    )
