"""Hard negatives by shared lists of anchor clusters.

Anchors of like direction form a cluster, and a cluster is cut into blocks of bounded size. A candidate p at angle t to the block's centre scores at
most |a| * |p| * cos(max(0, t - w)) with any anchor a of the block, w being the widest angle of its anchors. For each block and shard of
candidates the list is sorted by |p| * cos(..) once, and all anchors of the block walk down that one list together; an anchor stops where the
bound shows that nothing further can enter its result. That certifies the result: it is exact, whatever the clusters are.

Two walks: the first finds each anchor's best rows of its own label, the second, for each score s of those, the best rows of other labels
that score between ``low`` and ``high`` per cent of s. Before a walk the same bound, against the scores that the anchors of a block reach among
themselves (first walk) or must reach (second walk), tells which candidates can matter to which block; only those are sent there.
The centres of blocks go to the tasks in waves of at most WAVE_BYTES, so there may be any number of blocks.

Candidates are dealt to shards and anchors of a cluster to blocks by a hash of their row number: a vector or a label that a third of all rows share
is no hot spot. Where the vectors are near random (no direction stands out) nearly all candidates reach all blocks: work and shuffle are
then candidates times blocks. Only the centres are fitted on a sample (FIT anchors of least hash); all anchors and all candidates take part.

Arithmetic is exact: vectors are whole numbers, in double precision below 2**53 and in 64-bit integers beyond.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part, nor do those whose squared length is 2**59
or more (their scores may not fit 64 bits). Rows are compared with those of their own vector length. Repeated rows are rows of their own, also those
that share an id. Rows without an id are candidates, after all others of their score, but never anchors. Empty vectors score 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentweave.llm.common import staged

#: Anchors to a block, values to a shard of candidates, steps of a walk.
BLOCK, SHARD_VALUES, STEP = 1024, 1 << 19, 256
#: Anchors that centres are fitted on, and how many of them a centre stands for.
FIT, PER_CENTRE, ROUNDS = 8192, 64, 8
WAVE_BYTES = 8 << 20
SLACK = 1e-9
LAST = np.iinfo(np.int64).max


def usable(vector: Column) -> Column:
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))


def matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column]) if len(column) else np.zeros((0, dim))


def unit(rows: np.ndarray) -> np.ndarray:
    norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def centres(sample: np.ndarray) -> np.ndarray:
    """Directions by spherical k-means, from evenly spaced rows on."""
    rows = unit(sample)
    found = rows[np.linspace(0, len(rows) - 1, max(1, len(rows) // PER_CENTRE)).astype(int)]
    for _ in range(ROUNDS):
        near = (rows @ found.T).argmax(axis=1)
        total = np.zeros_like(found)
        np.add.at(total, near, rows)
        found = np.where((total != 0).any(axis=1, keepdims=True), unit(total), found)
    return found


def bounds(points: np.ndarray, centre: np.ndarray, width: np.ndarray) -> np.ndarray:
    """For each point (row) and block (column): the most that the point scores with an anchor of length one."""
    norm = np.sqrt((points * points).sum(axis=1))
    angle = np.arccos(np.clip(unit(points) @ centre.T, -1, 1))
    return norm[:, None] * np.cos(np.maximum(angle - width[None, :] - SLACK, 0)) * (1 + SLACK) + SLACK


class Best:
    """The k best finds of each asker so far: by score, then id, those without an id last."""

    def __init__(self, askers: int, k: int):
        self.k, self.worst = k, np.full(askers, np.iinfo(np.int64).min)
        self.found = [np.zeros(0, np.int64) for _ in range(5)]  # asker, score, nameless, id, row

    def add(self, *new: np.ndarray) -> None:
        asker, score, nameless, ids, row = (np.concatenate(x) for x in zip(self.found, new))
        order = np.lexsort((row, ids, nameless, -score, asker))
        asker, score, nameless, ids, row = (x[order] for x in (asker, score, nameless, ids, row))
        start = np.flatnonzero(np.concatenate([[True], asker[1:] != asker[:-1]]))
        rank = np.arange(len(asker)) - np.repeat(start, np.diff(np.append(start, len(asker))))
        self.worst[asker[rank == self.k - 1]] = score[rank == self.k - 1]
        self.found = [x[rank < self.k] for x in (asker, score, nameless, ids, row)]


class List:
    """The candidates of a shard in the order of a block's bound, and the block's anchors."""

    def __init__(self, points: pd.DataFrame, anchors: pd.DataFrame, dim: int):
        candidates, self.a = matrix(points["v"], dim), matrix(anchors["v"], dim)
        centre = unit(unit(self.a).sum(axis=0, keepdims=True))
        width = np.arccos(np.clip(unit(self.a) @ centre[0], -1, 1)).max(keepdims=True)
        bound = bounds(candidates, centre, width)[:, 0]
        order = np.argsort(-bound, kind="stable")
        self.p, self.bound = candidates[order], bound[order]
        self.length = np.sqrt((self.a * self.a).sum(axis=1))
        longest = math.sqrt((self.p * self.p).sum(axis=1).max(initial=0.0)) * self.length.max(initial=0.0)
        if longest >= 2.0**53:
            self.p, self.a = self.p.astype(np.int64), self.a.astype(np.int64)
        ids = points["id"].isna().to_numpy()[order]
        self.nameless = ids.astype(np.int64)
        self.ids = points["id"].fillna(LAST).to_numpy(np.int64)[order] if ids.any() else points["id"].to_numpy(np.int64)[order]
        self.label, self.row = points["label"].to_numpy()[order], points["row"].to_numpy()[order]
        self.a_label, self.a_row = anchors["label"].to_numpy(), anchors["row"].to_numpy()
        self.seen = 0

    def walk(self, best: Best, anchor: np.ndarray, floor: np.ndarray, fits: Callable) -> None:
        """Askers stand for anchors (``anchor``) and want scores of at least ``floor``; ``fits(askers, step, scores)`` tells which count."""
        for at in range(0, len(self.row), STEP):
            need = np.maximum(floor, best.worst.astype(np.float64))
            open_ = np.flatnonzero(self.bound[at] * self.length[anchor] * (1 + SLACK) + SLACK >= need)
            if not len(open_):
                return
            step = slice(at, at + STEP)
            some, where = np.unique(anchor[open_], return_inverse=True)
            score = (self.a[some] @ self.p[step].T).astype(np.int64)[where]
            self.seen += score.size
            q, c = np.nonzero(fits(open_, step, score) & (score >= best.worst[open_][:, None]))
            best.add(open_[q], score[q, c], self.nameless[step][c], self.ids[step][c], self.row[step][c])


def _given_blocks(anchors: DataFrame) -> DataFrame:
    """The anchors with the number of their block."""
    least = anchors.orderBy(F.xxhash64("row"), "row").limit(FIT).select("dim", "v").toPandas()
    fitted = {int(dim): centres(matrix(part["v"], dim)) for dim, part in least.groupby("dim")}

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            rows = rows.assign(cluster=0)
            for dim, part in rows.groupby("dim"):
                if dim in fitted:
                    rows.loc[part.index, "cluster"] = (unit(matrix(part["v"], dim)) @ fitted[dim].T).argmax(axis=1)
            yield rows

    rows = anchors.mapInPandas(assign, anchors.select("*", F.lit(0).cast("long").alias("cluster")).schema)
    rows = staged(rows, "anchors")
    sizes = rows.groupBy("dim", "cluster").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    # At most one row for each centre and vector length; the numbers of the blocks follow their order.
    before = Window.orderBy("dim", "cluster").rowsBetween(Window.unboundedPreceding, -1)
    sizes = staged(sizes.withColumn("base", F.coalesce(F.sum("parts").over(before), F.lit(0))), "clusters")
    block = F.col("base") + F.pmod(F.xxhash64("row"), F.col("parts"))
    return staged(rows.join(sizes, ["dim", "cluster"]).select(block.alias("block"), *anchors.columns), "blocks")


def _told(blocks: DataFrame, k: int, column: str | None) -> DataFrame:
    """(block, dim, centre, width, floor): the bound that a candidate must reach to matter to some anchor of the block."""

    def tell(rows: pd.DataFrame) -> pd.DataFrame:
        dim = int(rows["dim"].iloc[0])
        a = matrix(rows["v"], dim)
        centre = unit(unit(a).sum(axis=0, keepdims=True))
        width = float(np.arccos(np.clip(unit(a) @ centre[0], -1, 1)).max())
        length = np.sqrt((a * a).sum(axis=1))
        if column:
            need = rows[column].to_numpy(np.float64)
        else:
            score = a @ a.T
            score[rows["label"].to_numpy()[:, None] != rows["label"].to_numpy()[None, :]] = -np.inf
            np.fill_diagonal(score, -np.inf)
            need = np.sort(score, axis=1)[:, -k] if len(a) >= k else np.full(len(a), -np.inf)
        floor = np.divide(need, length, out=np.full(len(a), -np.inf), where=(length > 0) & np.isfinite(need))
        floor[np.isposinf(need)] = np.inf
        return pd.DataFrame({"block": rows["block"].iloc[:1], "dim": [dim], "centre": [centre[0]], "width": [width], "floor": [float(floor.min())]})

    return staged(blocks.groupBy("block").applyInPandas(tell, "block long, dim int, centre array<double>, width double, floor double"), "bounds")


def _sent(points: DataFrame, told: DataFrame, shards: int, widest: int) -> Iterator[DataFrame]:
    """The candidates, once for each block that they can matter to: a table for each wave of blocks."""
    wave = max(1, WAVE_BYTES // (8 * max(1, widest)))
    last = told.agg(F.max("block")).first()[0]
    for begin in range(0, 0 if last is None else last + 1, wave):
        info = told.filter((F.col("block") >= begin) & (F.col("block") < begin + wave)).toPandas()
        by_dim = {int(d): (p["block"].to_numpy(), matrix(p["centre"], d), p["width"].to_numpy(), p["floor"].to_numpy()) for d, p in info.groupby("dim")}

        def send(batches: Iterator[pd.DataFrame], by_dim=by_dim) -> Iterator[pd.DataFrame]:
            for rows in batches:
                for dim, part in rows.groupby("dim"):
                    if dim not in by_dim:
                        continue
                    block, centre, width, floor = by_dim[dim]
                    reach = bounds(matrix(part["v"], dim), centre, width) * (1 + SLACK) + SLACK >= floor[None, :]
                    for number, column in zip(block.tolist(), reach.T):
                        if column.any():
                            yield part[column].assign(block=number)

        rows = points.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
        yield rows.mapInPandas(send, rows.select("*", F.lit(0).cast("long").alias("block")).schema)


def _walked(points: DataFrame, blocks: DataFrame, told: DataFrame, shards: int, widest: int, run: Callable, schema: str) -> DataFrame:
    every = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

    def walk(some: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        if not len(some) or not len(anchors):
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        return run(List(some, anchors, int(anchors["dim"].iloc[0])), anchors)

    out = None
    for sent in _sent(points, told, shards, widest):
        part = sent.groupBy("block", "shard").cogroup(every.groupBy("block", "shard")).applyInPandas(walk, schema)
        out = part if out is None else out.unionByName(part)
    return out


def _first(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("found").asc_nulls_last(), "found_row")
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _finds(best: Best, **more) -> pd.DataFrame:
    asker, score, nameless, ids, row = best.found
    found = pd.array(ids, "Int64")
    found[nameless == 1] = pd.NA
    return pd.DataFrame({**{name: values[asker] for name, values in more.items()}, "score": score, "found": found, "found_row": row})


def mine(rows: DataFrame, k: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows``: id, label, v (array of whole numbers), anchor (boolean). For each of an anchor's first ``k`` other rows of its label, the first
    ``k`` rows of other labels with ``low * positive_score <= 100 * negative_score <= high * positive_score``.
    """
    v = F.col("v").cast("array<double>")
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), v.alias("v"), F.coalesce("anchor", F.lit(False)).alias("anchor"))
    rows = rows.filter(F.col("label").isNotNull() & usable(F.col("v"))).filter(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x) < 2.0**59)
    rows = staged(rows.withColumn("dim", F.size("v")).withColumn("row", F.monotonically_increasing_id()), "points")
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    size = rows.agg(F.count("*").alias("n"), F.max("dim").alias("widest"), F.count_if("anchor").alias("anchors")).first()
    if not size["anchors"]:
        return rows.sparkSession.createDataFrame([], empty)
    widest = size["widest"]
    shards = max(1, math.ceil(size["n"] * max(1, widest) / SHARD_VALUES))
    points = rows.select("row", "id", "label", "dim", "v")
    blocks = _given_blocks(rows.filter(F.col("anchor") & F.col("id").isNotNull()).select("row", "id", "label", "dim", "v"))

    def positives(shared: List, anchors: pd.DataFrame) -> pd.DataFrame:
        best, all_ = Best(len(anchors), k), np.arange(len(anchors))

        def fits(askers, step, score):
            same = shared.a_label[askers][:, None] == shared.label[step][None, :]
            return same & (shared.a_row[askers][:, None] != shared.row[step][None, :])

        shared.walk(best, all_, np.full(len(anchors), -np.inf), fits)
        return _finds(best, row=shared.a_row)

    schema = "row long, score long, found long, found_row long"
    near = _walked(points, blocks, _told(blocks, k, None), shards, widest, positives, schema)
    near = staged(_first(near, ["row"], k).select("row", "rank", F.col("score").alias("goal"), F.col("found").alias("positive_id")), "positives")

    goals = near.filter("goal >= 0").groupBy("row").agg(F.array_sort(F.collect_set("goal")).alias("goals"))
    # The least score that may count: low per cent of the least goal.
    asked = blocks.join(goals, "row").withColumn("need", F.col("goals")[0] * (low / 100.0) - 1)
    asked = staged(asked, "asked")

    def negatives(shared: List, anchors: pd.DataFrame) -> pd.DataFrame:
        count = anchors["goals"].map(len).to_numpy()
        anchor, goal = np.repeat(np.arange(len(anchors)), count), np.concatenate([np.asarray(g, np.int64) for g in anchors["goals"]])
        least = np.array([-(-low * int(g) // 100) for g in goal], np.int64)
        most = np.array([high * int(g) // 100 for g in goal], np.int64)
        best = Best(len(goal), k)

        def fits(askers, step, score):
            other = shared.a_label[anchor[askers]][:, None] != shared.label[step][None, :]
            return other & (score >= least[askers][:, None]) & (score <= most[askers][:, None])

        shared.walk(best, anchor, least.astype(np.float64), fits)
        return _finds(best, row=shared.a_row[anchor], goal=goal)

    far = _walked(points, asked, _told(asked, k, "need"), shards, widest, negatives, "row long, goal long, score long, found long, found_row long")
    if far is None:  # no anchor has a positive that a negative could come near
        return rows.sparkSession.createDataFrame([], empty)
    far = _first(far, ["row", "goal"], k).select("row", "goal", F.col("rank").alias("place"), F.col("found").alias("negative_id"), F.col("score").alias("negative_score"))
    named = near.join(blocks.select("row", F.col("id").alias("anchor_id")), "row")
    return named.join(far, ["row", "goal"]).select(
        "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), "negative_id", F.col("goal").alias("positive_score"), "negative_score"
    )
