"""Rows go through a merge's shuffle once, as short texts that give every value back, and a step's shuffle files go with it."""

import re
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rentweave import schema as S
from rentweave.operators import merge as M
from rentweave.operators.packing import PACKED, pack, unpack
from rentweave.operators.skew import HotKeys
from rentweave.session import cut_lineage
from tests.test_merge import frame, make_rows

AT = datetime(2024, 2, 29, 23, 59, 59, 123456)
NONE = {f: None for f, _ in S.LISTING_FIELDS}
ODD = [
    NONE,
    NONE | {"price": (None,) * 5, "location": (None,) * 7, "contact": ("", None, " \x00\"\\"), "features": {}, "photos": [], "enriched": (None,) * 5},
    NONE
    | {
        "canonical_key": "k", "rooms": float("inf"), "area_m2": -0.0, "floor": 0.1 + 0.2, "built_year": 5e-324, "photos": ["", None, "ä🏠"], "available_from": AT, "lease_until": datetime(9999, 12, 31),
        "features": {"": None, "a.b": "null", "ü": ""}, "price": (1e300, None, 0.0, "CHF", None), "source_priority": -1, "last_seen_at": datetime(1969, 12, 31, 23, 59, 59, 999999),
        "enriched": ({"s": "1"}, None, [None], {}, {"office": {"transit": (7, 1.5, AT), "walk": None}, "home": None}),
    },
]


def test_packed_rows_come_back_as_they_were(spark):
    rows = spark.createDataFrame([tuple(r[f] for f, _ in S.LISTING_FIELDS) for r in ODD], S.LISTING_DDL).withColumn("day", F.lit(AT).cast("date"))
    slim, kinds = pack(rows, ["canonical_key"])
    assert slim.columns == ["canonical_key", "day", PACKED]
    back = unpack(slim, kinds).select(*rows.columns)
    shown = lambda df: sorted(map(repr, df.collect()))
    assert back.dtypes == rows.dtypes and shown(back) == shown(rows)
    assert shown(unpack(slim, kinds, ["photos", "enriched"]).select("photos", "enriched")) == shown(rows.select("photos", "enriched"))
    nan = spark.range(1).select(F.lit("k").alias("k"), F.lit(float("nan")).alias("x"), F.lit("y" * 30).alias("z"))
    assert repr(unpack(*pack(nan, ["k"])).first()["x"]) == "nan"


@pytest.fixture
def settled_plans(spark):
    """Plans that are settled before they run, and joins as between large tables."""
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    own = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in own.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("kind", ["listings", "history"])
def test_rows_of_a_merge_move_once(spark, settled_plans, kind):
    rows, none = frame(spark, make_rows(5, keys=4, most=4)), HotKeys([], [])
    made = M.merge_listings(rows, ["seq"], hot=none) if kind == "listings" else M.merge_history(rows, ["seq"], hot=none, collections=True)
    plan = made._jdf.queryExecution().executedPlan().toString()
    moves = [line for line in plan.splitlines() if re.search(r"(?<!Reused)Exchange hashpartitioning\(canonical_key", line) and "ReusedExchange" not in line]
    assert len(moves) == 1 and "ReusedExchange" in plan


def test_listings_asked_for_in_part_leave_the_rest_behind(spark, settled_plans):
    rows = frame(spark, make_rows(5, keys=4, most=4))
    keys = M.merge_listings(rows, ["seq"], hot=HotKeys([], []), whole=False).select(M.KEY)
    plan = keys._jdf.queryExecution().optimizedPlan().toString()
    assert "to_json" not in plan.lower() and "structstojson" not in plan.lower()
    want = {r[M.KEY] for r in rows.select(M.KEY).distinct().collect()}
    assert {r[M.KEY] for r in keys.collect()} == want


def test_shuffle_files_go_with_their_step(spark):
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def held():
        return {f.getName() for f in (files.apply(i) for files in [disk.getAllFiles()] for i in range(files.size())) if f.getName().startswith("shuffle_")}

    before = held()
    kept = cut_lineage(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count())
    until = time.time() + 20
    while held() - before and time.time() < until:
        time.sleep(0.2)
    assert not held() - before and kept.count() == 10
