"""Work that a plan must not do twice."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from checks import stores
from rentweave.operators import merge as M
from rentweave.operators.skew import HotKeys
from rentweave.sources import homegate, immoscout
from tests.test_merge import frame, make_rows


def plan(df, name="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), name)().toString()


@pytest.fixture
def sorted_joins(spark):
    """Joins as between large tables."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    own = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, own)


def test_history_moves_wide_rows_once(spark, sorted_joins):
    history = M.merge_history(frame(spark, make_rows(3, keys=4, most=4)), ["seq"], hot=HotKeys([], []))
    assert not re.search(r"hashpartitioning\(canonical_key#\w+, _ord", plan(history, "executedPlan"))


def test_rejects_do_not_parse_again(spark):
    texts = spark.createDataFrame([('{"id": "1", "listing": {"id": "2"}}',), ('{"id": "1"}',), ('{"id": ',)], "t STRING")
    parsed = texts.select(F.from_json("t", homegate.ENVELOPE_DDL + ", _corrupt_record STRING", {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("e"))
    good, bad = homegate.reject_malformed(parsed.select("e.*"))
    assert [r["listing"]["id"] for r in good.collect()] == ["2"]
    assert sorted(r["problem"] for r in bad.collect()) == ["listing: required", "malformed record"]
    for rows in (good, bad):
        assert not [line for line in plan(rows).splitlines() if "Filter" in line and "from_json" in line]


def test_later_wrappers_are_parsed_only_if_needed(spark):
    page = '{"listings":[],"page":%d,"pageCount":1,"resultCount":0,"itemsPerPage":20,"hasNextPage":false,"hasPreviousPage":false}'
    bodies = [(page % 1,), ('{"result":%s,"data":%s}' % (page % 2, page % 3),), ('{"result":{},"data":%s}' % (page % 4),), ('{"resultList":%s}' % (page % 5),), ("{",), (None,)]
    got = spark.createDataFrame(bodies, "body STRING").select(immoscout.unwrap_result_page(F.col("body")).alias("p"))
    assert [r["p"] and r["p"]["page"] for r in got.collect()] == [1, 2, 4, 5, None, None]
    # One parse for each place, so that those behind the first whole page are left out.
    assert plan(got).count("from_json") == 4


@pytest.mark.parametrize("query", [stores.upsert, stores.upsert_again])
def test_stored_listings_are_made_once(spark, tmp_path, query):
    line = "l_orderkey BIGINT, l_linenumber INT, l_partkey BIGINT, l_suppkey BIGINT, l_quantity DOUBLE, l_extendedprice DOUBLE, l_shipdate TIMESTAMP"
    rows = [(k, 1 + k % 3, k % 2, k, 5.0, 10.0, datetime(1998, 1, 1 + k)) for k in range(6)]
    spark.createDataFrame(rows, line).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(0, 3), (1, 4)], "p_partkey BIGINT, p_size INT").write.parquet(f"{tmp_path}/part.parquet")
    out = query(spark, str(tmp_path))
    assert "LogicalRDD" in plan(out) and out.count()
