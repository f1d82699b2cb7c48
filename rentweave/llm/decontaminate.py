"""Benchmark decontamination over a distributed positional inverted index. DataFrame operations only.

`positional_index` stores one posting (term, row, position) for every training token that some test item asks for, in segments that
hold the documents of one scan task each, ordered by term: no shuffle, a look-up reads the row groups of its terms. A posting
of the empty term carries each document's id and length.

`phrase_matches` takes test phrases, orders the terms of each by how rare they are over the whole index, and intersects
offset-adjusted lists: the rarest term's postings give candidate places, the second rarest cuts them down, and all further
terms are then looked up at the places left. With ``slack`` each term may stand so many words off its place
(proximity); ``exact`` says that none does.

Terms, windows and the rows of candidates are broadcast only where a count shows them to be few; beyond that these
joins shuffle.

Defined results: null and empty texts have no words and no hits. Repeated documents, and different ones of one id, are judged row by row.
A test item without an id marks words and documents like any other, but has no name: it is neither in ``items`` nor in ``n_items``. Repeated items
count once by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentweave.llm.common import hex_digest, small, staged, words

#: Rows up to which a counted table is broadcast: terms and windows (below 100 bytes each), numbers of candidate documents.
FEW_TERMS, FEW_ROWS = 500_000, 2_000_000


def windows(items: DataFrame, size: int = 10, id_column: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, phrase): every run of ``size`` words of an item; a shorter one with words is one phrase. Words are joined by a space."""
    parts = items.select(F.col(id_column).alias("item_id"), words(F.col(text)).alias("w"))
    parts = parts.filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    return parts.select("item_id", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, size), " "))).alias("phrase")).distinct()


def phrase_terms(phrases: DataFrame) -> DataFrame:
    """(phrase, size, offset, term) of each distinct phrase."""
    parts = phrases.select("phrase").distinct().withColumn("w", F.split("phrase", " "))
    return parts.select("phrase", F.size("w").alias("size"), F.posexplode("w").alias("offset", "term"))


def positional_index(docs: DataFrame, terms: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Postings (term, row, pos) of the given terms, stored; the empty term's posting has (doc_id, length as pos)."""
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("doc_id"), words(F.col(text)).alias("w"))
    tokens = source.select("row", "doc_id", F.posexplode(F.concat("w", F.array(F.lit("")))).alias("pos", "term"))
    asked = terms.select("term").distinct().union(docs.sparkSession.range(1).select(F.lit("")))
    postings = tokens.join(small(staged(asked, "terms"), FEW_TERMS), "term")
    postings = postings.select("term", "row", "pos", F.when(F.col("term") == "", F.col("doc_id")).alias("doc_id"))
    return staged(postings.sortWithinPartitions("term", "row", "pos"), "index")


def phrase_matches(index: DataFrame, terms: DataFrame, slack: int = 0) -> DataFrame:
    """(phrase, row, start, size, exact): places at which a phrase of ``phrase_terms`` occurs; start is its first word's place."""
    postings = index.filter("term <> ''").select("term", "row", "pos")
    spread = postings.groupBy("term").agg(F.count("*").alias("held"))
    known = terms.join(spread, "term", "left")
    ranked = known.groupBy("phrase", "size").agg(F.array_sort(F.collect_list(F.struct("held", "offset", "term"))).alias("t"), F.count("held").alias("n"))
    # A phrase with a term that no document has cannot occur.
    ranked = staged(ranked.filter("n = size").select("phrase", "size", "t"), "ranked")

    near = F.sequence(F.lit(-slack), F.lit(slack))
    first = small(staged(ranked.select("phrase", "size", "t", F.col("t")[0]["term"].alias("term")), "first"), FEW_TERMS)
    lead = postings.join(first, "term").select("phrase", "size", "t", "row", (F.col("pos") - F.col("t")[0]["offset"]).alias("start"))
    lead = lead.filter("start >= 0" if slack == 0 else "true")

    # Second list: the candidate looks for its term at the place, or up to `slack` words off it.
    asks = lead.filter("size > 1").withColumn("d", F.explode(near))
    asks = asks.withColumn("pos", F.col("start") + F.col("t")[1]["offset"] + F.col("d")).withColumn("term", F.col("t")[1]["term"])
    second = small(staged(ranked.filter("size > 1").select(F.col("t")[1]["term"].alias("term")).distinct(), "second"), FEW_TERMS)
    pairs = asks.join(postings.join(second, "term", "left_semi"), ["term", "row", "pos"])
    left = pairs.groupBy("phrase", "row", "start").agg(F.first("size").alias("size"), F.first("t").alias("t"), F.min(F.abs("d")).alias("off"))
    left = staged(left, "candidates")

    rest = left.filter("size > 2").withColumn("x", F.explode(F.slice("t", F.lit(3), F.col("size"))))
    rest = rest.withColumn("d", F.explode(near)).select(
        "phrase", "row", "start", "size", "off", "d", F.col("x.offset").alias("offset"), F.col("x.term").alias("term"),
        (F.col("start") + F.col("x.offset") + F.col("d")).alias("pos"),
    )
    rows = small(staged(left.filter("size > 2").select("row").distinct(), "rows"), FEW_ROWS)
    found = rest.join(postings.join(rows, "row", "left_semi"), ["term", "row", "pos"])
    found = found.groupBy("phrase", "row", "start", "size", "offset").agg(F.min(F.abs("d")).alias("d"), F.first("off").alias("off"))
    found = found.groupBy("phrase", "row", "start", "size").agg(F.count("*").alias("n"), F.max("d").alias("d"), F.first("off").alias("off"))
    found = found.filter("n = size - 2").select("phrase", "row", "start", "size", ((F.col("d") == 0) & (F.col("off") == 0)).alias("exact"))
    two = left.filter("size = 2").select("phrase", "row", "start", "size", (F.col("off") == 0).alias("exact"))
    one = lead.filter("size = 1").select("phrase", "row", "start", "size", F.lit(True).alias("exact"))
    return found.union(two).union(one)


def contamination(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """Per document row: row, doc_id, n_words, n_hit (words inside any occurrence of an item's window), n_items, items (sorted as
    strings), contaminated."""
    asked = staged(windows(items, size), "windows")
    terms = staged(phrase_terms(asked), "phrases")
    index = positional_index(docs, terms)
    hits = staged(phrase_matches(index, terms).select("phrase", "row", "start", "size"), "matches")

    spans = hits.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("stop")))).alias("spans"))
    empty = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    covered = F.aggregate(
        "spans",
        empty,
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(x["stop"] - F.greatest(acc["to"], x["start"]), F.lit(0))).alias("n"), F.greatest(acc["to"], x["stop"]).alias("to")
        ),
    )
    spans = spans.select("row", covered["n"].cast("long").alias("n_hit"))
    named = hits.select("phrase", "row").distinct().join(small(asked, FEW_TERMS), "phrase").select("row", F.col("item_id").cast("string").alias("item"))
    named = named.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = index.filter("term = ''").select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))
    out = out.join(spans.join(named, "row"), "row", "left")
    return out.select(
        "row",
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def contamination_digest(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    out = contamination(docs, items, size)
    return out.select("doc_id", "n_words", "n_hit", "n_items", hex_digest(F.array_join("items", ",")).alias("items_sha256"), "contaminated")


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """The documents in which no window of an item occurs, columns as they are. Rows of one id and one text share their fate."""
    body = docs.select(F.struct("*").alias("doc"), F.struct("doc_id", F.xxhash64("text").alias("mark")).alias("doc_id"), "text")
    bad = contamination(body, items, size).filter("contaminated").select("doc_id.*").distinct()
    own = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_mark"))
    return own.join(bad, [own["own_mark"] == bad["mark"], own["own_id"].eqNullSafe(bad["doc_id"])], "left_anti").select("doc.*")
