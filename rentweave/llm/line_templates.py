"""Line dedup by a log-template tree.

A line's tokens (runs of no white space) with a digit become the wildcard ``<*>``. The tree is of fixed depth: token count, then
the leading tokens. In a leaf a line belongs to its full masked form and, from WIDE tokens on, to two generalised ones in which
every second token after the leading ones is a wildcard too: the tokens at even or at odd places stay fixed. Lines whose
variable field is one word thus share a template however that word varies, and half of the tokens always agree. No order
of arrival matters, so a template is just a key to count by.

A template that ``min_docs`` documents of different text hold is dropped from all of them but the first (``keep_first``, least
doc_id), or from all. Copies of one text count once and share their fate, so whole copied documents are left to document dedup.
Blank lines and lines of fewer than LEAST tokens are never templates.

Counting combines before its shuffle; a third of all lines under one template make one row a task. Templates and the drop lists are
broadcast only where a count shows them few.

Defined results: a null text stays null, an empty one empty; a text may become empty. Repeated rows are treated alike. Keys are 64-bit
hashes of the template, texts are told apart by 96 bits of hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentweave.functions.plan import keep_where
from rentweave.llm.common import small, staged

LEAST, WIDE, DEPTH = 3, 8, 2
WILD = "<*>"
FEW_TEMPLATES, FEW_DOCS = 1_000_000, 200_000


def template_keys(line: Column) -> Column:
    """Keys of the templates that a line belongs to."""
    # Trimmed first, a line has no empty token (a blank one has a single empty token, which is no template).
    tokens = F.split(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+")
    wild = F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), WILD).otherwise(t))
    # Few lines have a digit; the others need no look at each token.
    masked = F.when(line.rlike("[0-9]"), wild).otherwise(tokens)

    def forms(m: Column) -> Column:
        path = [F.size(m), F.slice(m, 1, DEPTH)]
        full = F.xxhash64(F.lit("full"), *path, m)
        halves = [
            F.xxhash64(F.lit("even"), *path, F.filter(m, lambda t, i: i % 2 == 0)),
            F.xxhash64(F.lit("odd"), *path, F.filter(m, lambda t, i: i % 2 == 1)),
        ]
        return F.when(F.size(m) < LEAST, F.array().cast("array<bigint>")).when(F.size(m) < WIDE, F.array(full)).otherwise(F.array(full, *halves))

    # The masked tokens are bound once and used by all forms.
    return F.flatten(F.transform(F.array(masked), forms))


def dropped_lines(docs: DataFrame, min_docs: int, keep_first: bool, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(m1, m2, drops): places of the lines to drop in each text that loses any."""
    body = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).filter("text IS NOT NULL")
    # Marks are made before the lines are dealt out, so a text is hashed once and does not travel with each of its lines.
    lines = body.select("id", *_marks("text"), F.split("text", "\n").alias("lines")).select("id", "m1", "m2", F.posexplode("lines").alias("at", "line"))
    keyed = lines.select("id", "m1", "m2", "at", template_keys(F.col("line")).alias("keys"))
    lines = staged(keep_where(keyed, F.size("keys") > 0), "lines")
    held = lines.select("id", "m1", "m2", F.explode("keys").alias("key"))
    held = held.groupBy("key", "m1", "m2").agg(F.min(F.struct(F.col("id").isNull().alias("nameless"), "id")).alias("id"))
    first = F.min(F.struct("id", "m1", "m2")).alias("first")
    templates = staged(held.groupBy("key").agg(F.count("*").alias("n"), first).filter(F.col("n") >= min_docs), "templates")

    hit = lines.select("m1", "m2", "at", F.explode("keys").alias("key")).join(small(templates, FEW_TEMPLATES), "key")
    if keep_first:
        hit = hit.filter((F.col("m1") != F.col("first.m1")) | (F.col("m2") != F.col("first.m2")))
    return staged(hit.groupBy("m1", "m2").agg(F.collect_set("at").alias("drops")), "drops")


def _marks(text: str) -> list[Column]:
    return [F.xxhash64(text).alias("m1"), F.hash(text).alias("m2")]


def drop_templates(
    docs: DataFrame, min_docs: int = 3, keep_first: bool = True, text: str = "text", id_column: str = "doc_id"
) -> DataFrame:
    """(doc, drops): every row as a struct with its recurring template lines taken out of the text, and the places of those lines
    (null: none)."""
    drops = dropped_lines(docs, min_docs, keep_first, text, id_column)
    body = docs.select(F.struct("*").alias("doc"), *_marks(text))
    body = body.join(small(drops, FEW_DOCS), ["m1", "m2"], "left")

    def without(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drops"))
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    # The lines are bound once and used for every place that stays.
    left = F.get(F.transform(F.array(F.split(F.col("doc")[text], "\n")), without), 0)
    return body.select(F.col("doc").withField(text, F.when(F.col("drops").isNull(), F.col("doc")[text]).otherwise(left)).alias("doc"), "drops")


def dedup_lines(docs: DataFrame, min_docs: int = 3, keep_first: bool = True) -> DataFrame:
    """The documents without recurring template lines; n_chars, if there is such a column, is counted anew."""
    out = drop_templates(docs, min_docs, keep_first)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        fresh = F.when(F.col("drops").isNull(), F.col("doc.n_chars")).otherwise(F.char_length("doc.text").cast(kind))
        out = out.select(F.col("doc").withField("n_chars", fresh).alias("doc"))
    return out.select("doc.*")
