"""Conversation structure repair by generalised LR parsing.

Every conversation is brought into the role grammar of `role_grammar` by the cheapest edits. Spark does what is wide: turns are put in one total order by
range, which spreads a conversation of any size over tasks; faults are found by grouping on hashes of (role, text); turns become one letter each, and
runs of RUN turns are parsed apart. A conversation meets again as its runs' summaries alone (25 short strings a run). Texts join the edits by a unique number.
The audit of a conversation is one value by definition.

Faults, the first one counts: blank (no visible character), duplicate (role and text seen earlier in the conversation), truncated (the last visible
character ends no sentence). Blank and duplicate turns must go; truncated ones cost more.

Defined results: a null role or text is one blank; a null conversation id is a conversation; null turn numbers come first; turns of one number are ordered by role
and text; a role is known by its initial, and an empty one has none, so it can't be kept. Equal rows are turns of their own, of which all
but the first are duplicates; they are counted before any shuffle. Figures beyond 64 bits are null. An empty table gives empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentweave.llm.common import staged
from rentweave.llm.role_grammar import ROLES, repairer, summary

#: What is not visible, and what ends a sentence.
BLANKS = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
LEGAL = ("su", "ua", "au")
#: Turns to a run, as a power of two.
RUN_BITS = 10


class Repaired(NamedTuple):
    turns: DataFrame  # (conv_id, run, step, edit, role, text), in order of (run, step); deleted turns are not there
    summary: DataFrame  # (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation with turns


def _ordered(turns: DataFrame) -> DataFrame:
    """Different rows with their number ``n``, in total order by ``at``."""
    rows = turns.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("n"))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    # Beginnings of role and text spread turns of one number too, and rise with the whole strings.
    begin = [F.substring("role", 1, 64), F.when(F.length("role") <= 64, F.substring("text", 1, 64))]
    dealt = rows.repartitionByRange(*order[:2], *[b.asc_nulls_first() for b in begin]).sortWithinPartitions(*order)
    core = F.rtrim(F.col("text"), F.lit(BLANKS))
    dealt = dealt.withColumn("at", F.monotonically_increasing_id())
    return staged(
        dealt.select(
            "at",
            "conv",
            "turn",
            "role",
            "text",
            "n",
            F.substring("role", 1, 1).alias("initial"),
            (core == "").alias("blank"),
            (~F.substring(core, -1, 1).isin(*ENDS)).alias("cut"),
            F.xxhash64("role", "text").alias("h1"),
            F.xxhash64("text", F.lit(1), "role").alias("h2"),
        ),
        "turns",
    )


def _illegal(before: Column, after: Column) -> Column:
    return F.when(F.concat(before, after).isin(*LEGAL), 0).otherwise(1)


def _pairs(array: Column) -> Column:
    """Illegal neighbours in an array of (first, last) initials."""
    n = F.size(array) - 1
    broken = F.zip_with(F.slice(array, 1, n), F.slice(array, 2, n), lambda a, b: _illegal(a["last"], b["first"]))
    return F.when(n > 0, F.aggregate(broken, F.lit(0).cast("long"), lambda s, x: s + x)).otherwise(F.lit(0).cast("long"))


def _runs(rows: DataFrame) -> DataFrame:
    """(conv, run, symbols, ats, illegal, first, last, faults): one row a run."""
    narrow = rows.drop("text", "role")
    firsts = narrow.groupBy("conv", "h1", "h2").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("fresh"))
    known = narrow.join(firsts, "at", "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))
    role = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    kept = ~F.col("blank") & F.col("fresh")
    more = (F.col("n") - 1).cast("int")
    symbols = F.when(kept, F.concat(F.when(F.col("cut"), F.upper(role)).otherwise(role), F.repeat(F.lit("x"), more)))
    known = known.withColumn("symbols", symbols.otherwise(F.repeat(F.lit("x"), F.col("n").cast("int"))))
    run = known.groupBy("conv", F.shiftright("at", RUN_BITS).alias("run")).agg(
        F.array_sort(F.collect_list(F.struct("at", "symbols", "initial", "n"))).alias("rows"),
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(F.col("n") - F.when(F.col("fresh"), 1).otherwise(0))).alias("duplicate"),
        F.sum(F.when(kept & F.col("cut"), 1).otherwise(0)).alias("truncated"),
        F.sum(F.col("n") - 1).alias("again"),
    )
    initials = F.transform("rows", lambda r: F.struct(r["initial"].alias("first"), r["initial"].alias("last")))
    return run.select(
        "conv",
        "run",
        F.array_join(F.transform("rows", lambda r: r["symbols"]), "").alias("symbols"),
        F.flatten(F.transform("rows", lambda r: F.array_repeat(r["at"], r["n"].cast("int")))).alias("ats"),
        (F.col("again") + _pairs(initials)).alias("illegal"),
        F.get("rows", F.lit(0))["initial"].alias("first"),
        F.element_at("rows", -1)["initial"].alias("last"),
        "blank",
        "duplicate",
        "truncated",
    )


def _edits(conversations: DataFrame) -> DataFrame:
    """(conv, run, step, edit, role, at) of every turn that stays or comes in; ``at`` is null for the latter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, steps, letters, roles, ats = [], [], [], [], []
            for i, (codes, places) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3))):
                code = np.array(list(codes.encode()), np.uint8).view("S1")
                takes = ~np.isin(code, [b"U", b"A"])
                place = np.asarray(places.values.to_numpy(zero_copy_only=False), np.int64)
                at = np.full(len(code), -1, np.int64)
                at[takes] = place[: takes.sum()]
                stay = np.flatnonzero(code != b"D")
                rows.append(np.full(len(stay), i))
                steps.append(stay)
                letters.append(np.where(code == b"K", "K", np.where(takes, "R", "I"))[stay])
                roles.append(np.where(code == b"K", "", np.where(np.isin(code, [b"u", b"U"]), ROLES["u"], ROLES["a"]))[stay])
                ats.append(at[stay])
            if not rows:
                continue
            index, at = pa.array(np.concatenate(rows)), np.concatenate(ats)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(index),
                    batch.column(1).take(index),
                    pa.array(np.concatenate(steps).astype(np.int32)),
                    pa.array(np.concatenate(letters).astype(str)),
                    pa.array(np.concatenate(roles).astype(str)),
                    pa.array(at, mask=at < 0),
                ],
                ["conv", "run", "step", "edit", "given", "at"],
            )

    schema = T.StructType(
        [
            conversations.schema["conv"],
            T.StructField("run", T.LongType()),
            T.StructField("step", T.IntegerType()),
            T.StructField("edit", T.StringType()),
            T.StructField("given", T.StringType()),
            T.StructField("at", T.LongType()),
        ]
    )
    parts = conversations.select("conv", F.explode(F.arrays_zip("runs", "codes")).alias("p"))
    return parts.select("conv", "p.runs.run", F.col("p.codes").alias("codes"), F.col("p.runs.ats").alias("ats")).mapInArrow(run, schema)


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repaired:
    blank = F.lit(" ")
    rows = _ordered(
        turns.select(
            F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, blank).alias("role"), F.coalesce(text, blank).alias("text")
        )
    )

    @F.pandas_udf("string")
    def parsed(symbols: pd.Series) -> pd.Series:
        return symbols.map(summary)

    @F.pandas_udf("cost long, audit string, codes array<string>")
    def joined(ways: pd.Series, symbols: pd.Series) -> pd.DataFrame:
        tool, out = repairer(), []
        for parts, text in zip(ways, symbols):
            cost, audit = tool.join(parts)
            out.append((cost, audit, tool.steps(text, audit)))
        return pd.DataFrame(out, columns=["cost", "audit", "codes"])

    runs = _runs(rows).withColumn("ways", parsed("symbols"))
    faults = ["blank", "duplicate", "truncated"]
    whole = runs.groupBy("conv").agg(
        F.array_sort(F.collect_list(F.struct("run", "first", "last", "illegal", "ways", "symbols", "ats"))).alias("runs"), *[F.sum(f).alias(f) for f in faults]
    )
    made = whole.withColumn("made", joined(F.col("runs.ways"), F.array_join("runs.symbols", "\n")))
    ends = F.transform("runs", lambda r: F.struct(r["first"].alias("first"), r["last"].alias("last")))
    illegal = F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + r["illegal"]) + _pairs(ends)
    done = staged(
        made.select(
            "conv",
            *[F.col(f).cast("long").alias(f) for f in faults],
            illegal.alias("illegal"),
            F.col("made.cost").alias("cost"),
            F.col("made.audit").alias("audit"),
            F.col("made.codes").alias("codes"),
            F.transform("runs", lambda r: F.struct(r["run"].alias("run"), r["ats"].alias("ats"))).alias("runs"),
        ),
        "repairs",
    )
    span = rows.groupBy("conv").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.count_distinct("turn").alias("seen"))
    wide = F.try_subtract(F.try_add(F.try_subtract("high", "low"), F.lit(1).cast("long")), F.col("seen"))
    span = span.select(F.col("conv").alias("_conv"), F.when(F.col("seen") == 0, F.lit(0).cast("long")).otherwise(wide).alias("gaps"))
    told = done.join(span, done["conv"].eqNullSafe(span["_conv"])).select(F.col("conv").alias(conv), "gaps", *faults, "illegal", "cost", "audit")

    edits = staged(_edits(done), "edits")
    texts = rows.select("at", F.col("role").alias("own"), "text")
    held = edits.filter("at IS NOT NULL").join(texts, "at").withColumn("role", F.when(F.col("edit") == "K", F.col("own")).otherwise(F.col("given")))
    new = edits.filter("at IS NULL").withColumn("role", F.col("given")).withColumn("text", F.lit(""))
    columns = [F.col("conv").alias(conv), "run", "step", "edit", "role", "text"]
    return Repaired(held.select(*columns).unionByName(new.select(*columns)), told)
