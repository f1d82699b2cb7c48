"""Nearest neighbours by cosine with vantage-point trees, one for each shard.

Vectors are dealt to shards by a hash of their id, SHARD at most in the mean, whatever their values: a value that a third of all rows
have is no hot spot. Queries are dealt to blocks. A (shard, block) pair is one cogroup of bounded size: it builds the shard's tree,
takes every query of the block through it, and returns the shard's nearest for each query; the best of all shards are merged by
a top-k per query.

The tree works on the chord between unit vectors, which is a metric and falls as the cosine rises. A query first goes
down to its own leaf, which bounds its k-th distance; a subtree is then left out if its lower bound from the triangle inequality, times
``factor``, exceeds that distance. Factor 1 leaves out only what cannot matter (exact search, up to ties by id); a larger one prunes
more. All queries of a block move through the tree together as numpy arrays. Scores of what is returned are computed from the original vectors
in double precision, each alike, so equal vectors tie exactly.

Defined results: vectors that are null, empty, zero, or hold null or non-finite parts take no part, nor do rows without an id; vectors
are compared with those of their own length; rows of the query's id are its own. Fewer candidates than k: all of them. Every query row is answered
by itself, also where several share an id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentweave.llm.common import staged

SHARD, BLOCK, LEAF = 8192, 1024, 96
EPS = 1e-9


class Tree:
    """A vantage-point tree over unit vectors. Each inner node has the range of distances to its vantage point on both sides."""

    def __init__(self, unit: np.ndarray, seed: int = 7):
        self.unit, self.rng = unit, np.random.default_rng(seed)
        self.nodes: list[tuple] = []  # (vantage, mu, inner, outer, inner range, outer range) or (rows,)
        self._build(np.arange(len(unit)))

    def _build(self, rows: np.ndarray) -> int:
        at = len(self.nodes)
        self.nodes.append((rows,))
        if len(rows) <= LEAF:
            return at
        vantage = int(rows[self.rng.integers(len(rows))])
        dist = chord(self.unit[rows] @ self.unit[vantage])
        mu = float(np.median(dist))
        near = dist <= mu
        if near.all():  # ties at the median: part at the largest value below it
            below = dist[dist < mu]
            if not len(below):
                return at
            mu = float(below.max())
            near = dist <= mu
        spans = [(float(dist[m].min()), float(dist[m].max())) for m in (near, ~near)]
        inner, outer = self._build(rows[near]), self._build(rows[~near])
        self.nodes[at] = (vantage, mu, inner, outer, *spans)
        return at


def chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * cosine, 0.0))


class Search:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, factor: float):
        self.ids, self.raw, self.k, self.factor = ids, vectors, k, factor
        self.norm = np.sqrt((vectors * vectors).sum(axis=1))
        self.tree = Tree(vectors / self.norm[:, None])
        self.looked = 0

    def run(self, query_ids: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position of the query, candidate id, score) of the nearest ones found."""
        self.qid, self.q = query_ids, queries
        self.qnorm = np.sqrt((queries * queries).sum(axis=1))
        self.unit = queries / self.qnorm[:, None]
        n = len(queries)
        self.best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.worst = np.full(n, -np.inf)  # the k-th score so far
        self.home = np.full(n, -1)
        self._descend(0, np.arange(n))
        self._visit(0, np.arange(n))
        return self.best

    def _descend(self, at: int, active: np.ndarray) -> None:
        node = self.tree.nodes[at]
        if len(node) == 1:
            self.home[active] = at
            self._leaf(node[0], active)
            return
        near = chord(self.unit[active] @ self.tree.unit[node[0]]) <= node[1]
        for child, part in ((node[2], active[near]), (node[3], active[~near])):
            if len(part):
                self._descend(child, part)

    def _visit(self, at: int, active: np.ndarray) -> None:
        node = self.tree.nodes[at]
        if len(node) == 1:
            active = active[self.home[active] != at]
            if len(active):
                self._leaf(node[0], active)
            return
        dist = chord(self.unit[active] @ self.tree.unit[node[0]])
        for child, (low, high) in ((node[2], node[4]), (node[3], node[5])):
            bound = np.maximum(np.maximum(dist - high, low - dist), 0.0)
            open_ = bound * self.factor <= chord(self.worst[active]) + EPS
            if open_.any():
                self._visit(child, active[open_])

    def _leaf(self, rows: np.ndarray, active: np.ndarray) -> None:
        for i in range(0, len(rows), 4096):
            part = rows[i : i + 4096]
            self.looked += len(part) * len(active)
            rough = self.unit[active] @ self.tree.unit[part].T
            rough[self.qid[active][:, None] == self.ids[part][None, :]] = -np.inf
            bar = self.worst[active]
            if len(part) > self.k:
                bar = np.maximum(bar, np.partition(rough, len(part) - self.k, axis=1)[:, len(part) - self.k])
            a, b = np.nonzero((rough >= bar[:, None] - EPS) & (rough > -np.inf))
            self._merge(active[a], part[b])

    def _merge(self, q: np.ndarray, c: np.ndarray) -> None:
        if not len(q):
            return
        score = (self.q[q] * self.raw[c]).sum(axis=1) / (self.qnorm[q] * self.norm[c])
        touched = np.zeros(len(self.qid), bool)
        touched[q] = True
        old = touched[self.best[0]]
        rest = [x[~old] for x in self.best]
        q, i, s = (np.concatenate([x[old], y]) for x, y in zip(self.best, (q, self.ids[c], score)))
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
        kth = rank == self.k - 1
        self.worst[q[kth]] = s[kth]
        keep = rank < self.k
        self.best = tuple(np.concatenate([x, y[keep]]) for x, y in zip(rest, (q, i, s)))


def usable(vector: Column) -> Column:
    whole = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column])


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, factor: float = 1.0, id_column: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of ``vectors`` for each row of ``queries`` (same columns)."""

    def part(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        return staged(rows.filter(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("dim", F.size("v")), name)

    base, asked = part(vectors, "vectors"), part(queries, "queries").withColumn("asker", F.monotonically_increasing_id())
    asked = staged(asked, "askers")
    shards, blocks = max(1, -(-base.count() // SHARD)), max(1, -(-asked.count() // BLOCK))
    left = base.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int"))
    right = right.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

    def search(points: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(points) or not len(wanted):
            return pd.DataFrame({"asker": [], "query_id": [], "vec_id": [], "score": []})
        points = points.sort_values("id", kind="stable")
        tool = Search(points["id"].to_numpy(), matrix(points["v"]), k, factor)
        ids = wanted["id"].to_numpy()
        q, found, score = tool.run(ids, matrix(wanted["v"]))
        return pd.DataFrame({"asker": wanted["asker"].to_numpy()[q], "query_id": ids[q], "vec_id": found, "score": score})

    keys = ["dim", "shard", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "asker long, query_id long, vec_id long, score double")
    order = Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
