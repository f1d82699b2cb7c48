"""Self-join of documents on the Jaccard similarity of their word n-grams, by MinHash banding.

1. One pass hashes each text's n-grams (words of WORD, five in a row; a shorter text is one n-gram) and keeps the set's
   fingerprint and its band hashes. Texts with equal sets are one *class*, aggregated before anything is shuffled.
2. Band and row counts come from the wanted recall at the threshold (`banding`). Classes are shuffled on band hashes; a
   bucket gives a star around its least class, never its pairs. Components of the stars are the candidate groups.
3. The texts of candidates alone are fetched again, and within a group all pairs of classes are verified on their full n-gram sets.
   A large group is dealt into blocks, each pair of blocks a task of bounded text; what leaves a task is one row a class (number of
   linked documents, local root), so the output grows with documents, not with pairs.

Memory: a task holds two blocks of at most BLOCK classes and BLOCK_CHARS characters (or one longer text each). All pairs within
a candidate group are verified, a group's work is quadratic in its number of different texts.

Defined results: null texts and texts without a word have no n-grams, no links and a class of their own. Rows that repeat a
document are documents of their own, copies of each other. A class or group is named by its least doc_id.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentweave.llm.common import small, small_batches, staged
from rentweave.llm.components import connected_components

BLOCK, BLOCK_CHARS = 1024, 8 << 20
FEW_GROUPS = 500_000
_GAP = bytes(c if chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams, from prefix sums of a polynomial over its bytes."""
    plain = b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_GAP).split())
    if not plain:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(plain, np.uint8)
    gaps = np.flatnonzero(data == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(data)]])
    power, inverse = _powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1])])
    width = min(n, len(starts))
    first, last = starts[: len(starts) - width + 1], ends[width - 1 :]
    return np.unique(mix((sums[last] - sums[first]) * inverse[first] + (last - first).astype(np.uint64)))


def banding(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """Bands and rows: most rows a band (fewest false candidates) with which `most` hashes give the recall at the threshold."""
    best = None
    for rows in range(1, most + 1):
        chance = threshold**rows
        bands = 1 if chance >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-chance))
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError("no banding of so few hashes gives this recall")
    return best


class Sketcher:
    def __init__(self, n: int, bands: int, rows: int):
        rng = np.random.default_rng(9)
        self.n, self.bands, self.rows = n, bands, rows
        self.mult = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.plus = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def __call__(self, text: str | None) -> tuple[str | None, list[int] | None]:
        """Fingerprint of the n-gram set and its band hashes."""
        grams = shingles(text, self.n)
        if not len(grams):
            return None, None
        least = np.full(len(self.mult), np.uint64(0xFFFFFFFFFFFFFFFF))
        for i in range(0, len(grams), 4096):
            part = grams[i : i + 4096]
            least = np.minimum(least, (self.mult[:, None] * part[None, :] + self.plus[:, None]).min(axis=1))
        total = np.zeros(self.bands, np.uint64)
        for column in mix(least).reshape(self.bands, self.rows).T:
            total = mix(total * np.uint64(0x94D049BB133111EB) + column)
        total = mix(total + np.arange(self.bands, dtype=np.uint64) * np.uint64(_BASE))
        return hashlib.blake2b(grams.tobytes(), digest_size=16).hexdigest(), total.view(np.int64).tolist()


def sketches(docs: DataFrame, sketch: Sketcher, text: str, id_column: str) -> DataFrame:
    """(doc_id, mark, key, bands) of every row; mark is a hash of the text."""
    small_batches(docs.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            both = [sketch(x) for x in part["text"]]
            yield pd.DataFrame({"id": part["id"], "mark": part["mark"], "key": [k for k, _ in both], "bands": [b for _, b in both]})

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"), mark(text).alias("mark"))
    return rows.mapInPandas(run, f"id {kind}, mark long, key string, bands array<long>")


def mark(text: str) -> Column:
    return F.xxhash64(F.col(text))


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections. Hashes in one set only are left out; the others are columns of a 0/1 matrix that is
    multiplied with itself a bounded number of columns at a time, over the rows that have any of them."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # Columns in the order of their first owner: unrelated sets then meet in few chunks.
    shared = np.flatnonzero(count[column] > 1)
    first = np.full(len(count), n)
    np.minimum.at(first, column[shared], owner[shared])
    rank = np.empty(len(count), np.int64)
    rank[np.lexsort((np.arange(len(count)), first))] = np.arange(len(count))
    place = rank[column[shared]]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[shared][order]
    out = np.zeros((n, n), np.float32)
    chunk = max(64, (4 << 20) // max(n, 1))
    at = 0
    while at < len(place):
        end = np.searchsorted(place, place[at] + chunk)
        rows, local = np.unique(owner[at:end], return_inverse=True)
        grid = np.zeros((len(rows), place[end - 1] - place[at] + 1), np.float32)
        grid[local, place[at:end] - place[at]] = 1
        out[np.ix_(rows, rows)] += grid @ grid.T
        at = end
    return out


def local_roots(linked: np.ndarray) -> np.ndarray:
    """Least index reachable from each index."""
    root = np.full(len(linked), -1)
    for i in range(len(linked)):
        if root[i] < 0:
            front = np.array([i])
            while len(front):
                root[front] = i
                front = np.flatnonzero(linked[front].any(axis=0) & (root < 0))
    return root


def verifier(n: int, threshold: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key", kind="stable")
        sets = [shingles(x, n) for x in group["text"]]
        size = np.array([len(s) for s in sets], np.float32)
        shared = intersections(sets)
        linked = shared >= threshold * (size[:, None] + size[None, :] - shared) - 1e-3
        block = group["block"].to_numpy()
        if group["i"].iloc[0] != group["j"].iloc[0]:
            linked &= block[:, None] != block[None, :]
        np.fill_diagonal(linked, False)
        root = local_roots(linked)
        keys = group["key"].to_numpy()
        return pd.DataFrame({"key": keys, "links": linked @ group["copies"].to_numpy(), "root": keys[root], "whole": group["blocks"].to_numpy() == 1})

    return run


def ngram_join(
    docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9995, text: str = "text", id_column: str = "doc_id"
) -> DataFrame:
    """One row for each document: id, mark (hash of its text), copy_of (least id with the same n-gram set), class_id (least id
    of its group of linked documents), n_links (documents at the threshold or above, copies included), first (it is the one
    document that stands for its group)."""
    rows = staged(sketches(docs, Sketcher(n, *banding(threshold, recall)), text, id_column), "sketches")
    lead = F.struct(F.col("id").isNull().alias("nameless"), "id", "mark")
    classes = rows.filter("key IS NOT NULL").groupBy("key").agg(
        F.count("*").alias("copies"), F.min(lead).alias("rep"), F.first("bands").alias("bands")
    )
    classes = staged(classes, "classes")
    buckets = classes.select("key", F.explode("bands").alias("bucket"))
    hubs = buckets.groupBy("bucket").agg(F.min("key").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    stars = buckets.join(hubs.select("bucket", "hub"), "bucket").filter("key <> hub").select("key", "hub")
    groups = connected_components(stars, "key", "hub").withColumnRenamed("node", "key")

    wanted = groups.join(classes.select("key", "copies", "rep.id", "rep.mark"), "key")
    source = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).withColumn("mark", mark("text"))
    # The hash of the text finds the row; the id only parts texts of equal hash. Identical rows meet in dropDuplicates.
    found = wanted.join(source, [wanted["mark"] == source["mark"], wanted["id"].eqNullSafe(source["id"])])
    members = staged(found.select("component", "key", "copies", "text").dropDuplicates(["key"]), "members")
    sizes = members.groupBy("component").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("chars") / BLOCK_CHARS)).cast("long")
    # Stored apart from the members, so that neither side of this join has to come in the other's partitioning: a large group can be split.
    sizes = staged(sizes.select("component", blocks.alias("blocks")), "sizes")
    dealt = members.join(small(sizes, FEW_GROUPS), "component")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other")
    seen = dealt.groupBy("component", "i", "j").applyInPandas(verifier(n, threshold), "key string, links long, root string, whole boolean")
    seen = staged(seen, "links")

    links = seen.groupBy("key").agg(F.sum("links").alias("links"))
    roots = seen.filter("whole").select("key", "root").union(
        connected_components(seen.filter("NOT whole"), "key", "root").select(F.col("node").alias("key"), F.col("component").alias("root"))
    )
    known = classes.join(links, "key", "left").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    names = known.groupBy("root").agg(F.min("rep").alias("chief"))
    known = known.join(names, "root").select("key", "copies", "rep", "chief", F.coalesce("links", F.lit(0)).alias("links"))
    out = rows.select("id", "mark", "key").join(known, "key", "left")
    alone = F.col("key").isNull()
    return out.select(
        F.col("id").alias(id_column),
        "mark",
        F.when(alone, F.col("id")).otherwise(F.col("rep.id")).alias("copy_of"),
        F.when(alone, F.col("id")).otherwise(F.col("chief.id")).alias("class_id"),
        F.when(alone, F.lit(0)).otherwise(F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"),
        (alone | (lead == F.col("chief"))).alias("first"),
    )


def keep_one(docs: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """The first document (least id) of each group, its columns as they are. Rows without n-grams all stay."""
    first = ngram_join(docs, n, threshold).filter("first").groupBy("doc_id", "mark").agg(F.max("n_links").alias("n"))
    body = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("own_id"), mark("text").alias("own_mark"))
    kept = body.join(first, [body["own_mark"] == first["mark"], body["own_id"].eqNullSafe(first["doc_id"])])
    once = kept.filter("n > 0").dropDuplicates(["own_mark", "own_id"])
    return kept.filter("n = 0").union(once).select("doc.*")
