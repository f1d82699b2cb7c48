"""Hot-key detection and arrival-order chunks.

Everything here only decides how work is split; results do not depend on it. The sketches have a fixed size,
so what reaches the driver is bounded whatever the data holds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentweave.session import passing_shuffles

# A key is hot when it holds more than 1/HOT_SHARE of the rows and more than HOT_ROWS of them.
HOT_SHARE = 10_000
HOT_ROWS = 200_000
# A hot key's rows are cut into this many runs of arrival order.
CHUNKS = 512
# Counters kept by the frequent-items sketch.
_SKETCH = 200_000


# Rows of hot keys looked at, for each run, to place the boundaries.
_LOOKED = 20


@dataclass(frozen=True)
class HotKeys:
    """Hashes of the hot keys (at most HOT_SHARE of them) and boundaries of their arrival order (at most CHUNKS)."""

    hashes: list[int]
    bounds: list[tuple]
    kinds: tuple[T.DataType, ...] = ()

    def __bool__(self) -> bool:
        return bool(self.hashes)

    def is_hot(self, key: Column) -> Column:
        return F.xxhash64(key).isin(self.hashes) if self.hashes else F.lit(False)

    def chunk(self, order: Sequence[Column]) -> Column:
        """Number of boundaries at or below the row: grows with arrival order. The whole order counts, so rows that share its first
        column (one file, one batch) are cut too."""
        place = F.struct(*[c.cast(k) for c, k in zip(order, self.kinds)]) if self.kinds else F.lit(0)
        marks = [F.struct(*[F.lit(v).cast(k) for v, k in zip(b, self.kinds)]) for b in self.bounds]
        return _count_below(place, marks, 0, len(marks))


def _count_below(x: Column, bounds: list[Column], low: int, high: int) -> Column:
    """Binary search written as nested conditions, so that a row makes about ten comparisons."""
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(x >= bounds[mid], _count_below(x, bounds, mid + 1, high)).otherwise(_count_below(x, bounds, low, mid))


def find_hot_keys(
    rows: DataFrame,
    key: str,
    order: Sequence[Column],
    share: int = HOT_SHARE,
    min_rows: int = HOT_ROWS,
    chunks: int = CHUNKS,
) -> HotKeys:
    """One narrow pass with a fixed-size sketch per task; no shuffle of rows.

    ``approx_top_k`` never misses an item above its error bound, and 200,000 counters put that bound far below
    ``1/share`` of the rows. Boundaries come from a bounded number of the hot keys' rows, chosen by a hash of their order.
    """
    names = [f"o{i}" for i in range(len(order))]
    probe = rows.select(F.xxhash64(F.col(key)).alias("h"), *[c.alias(n) for c, n in zip(order, names)])
    with passing_shuffles(rows.sparkSession):
        top = probe.agg(
            F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(h, {share}, {_SKETCH})").alias("top")
        ).first()
    floor = max(top["n"] / share, min_rows)
    hashes = [item["item"] for item in (top["top"] or []) if item["count"] > floor]
    if not hashes:
        return HotKeys([], [])
    with passing_shuffles(rows.sparkSession):
        looked = probe.filter(F.col("h").isin(hashes)).orderBy(F.xxhash64(*names)).limit(_LOOKED * chunks).select(*names).collect()
    # Nulls first, as in Spark's order.
    places = sorted((tuple(r) for r in looked), key=lambda t: [(v is not None, v) for v in t])
    cuts = [places[i * len(places) // chunks] for i in range(1, chunks)]
    return HotKeys(hashes, list(dict.fromkeys(cuts)), tuple(probe.schema[n].dataType for n in names))
