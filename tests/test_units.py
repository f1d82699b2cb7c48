"""Literal inputs and outputs of single operators, and file scans."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentweave import schema as S
from rentweave import session
from rentweave.functions.dates import next_weekday_at, parse_date_strict
from rentweave.functions.keys import key_material
from rentweave.functions.normalize import Band, Linear, Step
from rentweave.functions.numbers import leading_number, number_text, parse_price_like, round_half_up, to_number
from rentweave.functions.rental_term import classify_rental_term
from rentweave.functions.text import html_entity_decode, slugify
from rentweave.operators.commute import Target, enrich_commute, targets_frame
from rentweave.operators.filters import FieldRule
from rentweave.operators.gate import RentalPolicy, Stay
from rentweave.operators.scoring import Dim, NotImplementedDim, score_listing
from rentweave.operators.upsert import changed_flag
from rentweave.operators.merge import merge_listings
from rentweave.plans.run_scan import stamp
from rentweave.sources import flatfox, homegate, realadvisor
from rentweave.sources.landing import failure_log
from rentweave.sources.sitemap import scan_sitemap


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("x,want", [(-2.5, -2), (2.5, 3), (0.5, 1), (-0.4, 0)])
def test_round_half_up(spark, x, want):
    assert one(spark, round_half_up(F.lit(x))) == want


@pytest.mark.parametrize("x,want", [(4.0, "4"), (4.5, "4.5"), (12345678.25, "12345678.25"), (-0.5, "-0.5"), (0.0001, "0.0001")])
def test_number_text(spark, x, want):
    assert one(spark, number_text(F.lit(x))) == want


@pytest.mark.parametrize(
    "facts,want",
    [
        (("8001", 3.6, 82.4, 2074.0), "8001|3.5|80|2050"),
        (("8001", 3.75, 82.5, 2075.0), "8001|4|85|2100"),
        (("", 1.0, 10.0, 100.0), "|1|10|100"),
        ((None, 1.0, 10.0, 100.0), "url:u"),
        (("8001", 1.0, None, 100.0), "url:u"),
    ],
)
def test_key_material(spark, facts, want):
    plz, rooms, area, price = (F.lit(v).cast(t) for v, t in zip(facts, ("string", "double", "double", "double")))
    assert one(spark, key_material(plz, rooms, area, price, F.lit("u"))) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("31.12.2025", datetime(2025, 12, 31)),
        ("1/2/70", datetime(1970, 2, 1)),
        ("1.2.69", datetime(2069, 2, 1)),
        ("31.02.2025", None),
        ("1.2.0050", None),
        ("2025-01-01", None),
        ("1.13.2025", None),
    ],
)
def test_parse_date_strict(spark, text, want):
    assert one(spark, parse_date_strict(F.lit(text))) == want


@pytest.mark.parametrize(
    "text,term,end",
    [
        ("**befristet** bis 1.3.2030", "short", datetime(2030, 3, 1)),
        ("bis 31.2.2030, unbefristet", "short", None),
        ("UNBEFRISTET", "long", None),
        ("éfurnished", "short", None),
        ("unfurnished", "long", None),
        ("auf Zeit", "short", None),
        ("shortterm", "short", None),
        ("", "unknown", None),
        (None, "unknown", None),
    ],
)
def test_rental_term(spark, text, term, end):
    df = spark.range(1).withColumn("d", F.lit(text).cast("string"))
    row = classify_rental_term(df, F.col("d")).first()
    assert (row["rental_term"], row["lease_until"]) == (term, end)


@pytest.mark.parametrize("text,want", [("1'234.50", 1234.5), ("1.234.567", 1234567.0), ("2 400.-", 2400.0), ("n/a", None)])
def test_price_text(spark, text, want):
    assert one(spark, parse_price_like(F.lit(text))) == want


@pytest.mark.parametrize("text,want", [("3.5abc", 3.5), ("abc", None), (" 7", 7.0), (".5", 0.5)])
def test_leading_number(spark, text, want):
    assert one(spark, leading_number(F.lit(text))) == want


@pytest.mark.parametrize("text,want", [("3.5", 3.5), ("3,5", None), ("", 0.0), ("1e3", 1000.0), ("Infinity", None)])
def test_to_number(spark, text, want):
    assert one(spark, to_number(F.lit(text))) == want


def test_text_helpers(spark):
    assert one(spark, slugify(F.lit("Wäldi-Berg / Süd"))) == "waldi-berg-sud"
    assert one(spark, html_entity_decode(F.lit("&#x41;&#66;&amp;lt;&quot;"))) == 'AB<"'


@pytest.mark.parametrize(
    "day,hhmm,want",
    [("wed", "12:30", datetime(2024, 5, 1, 12, 30)), ("wed", "11:00", datetime(2024, 5, 8, 11)), ("mon", "08:00", datetime(2024, 5, 6, 8))],
)
def test_next_weekday(spark, day, hhmm, want):
    assert one(spark, next_weekday_at(F.lit(day), F.lit(hhmm), F.lit(datetime(2024, 5, 1, 12)))) == want


def test_normalisers_on_null_and_ties(spark):
    from pyspark.sql.types import DoubleType

    null = F.lit(None).cast("double")
    assert one(spark, Linear(1, 2).compile(null, DoubleType())) == 0.0
    assert one(spark, Step([Band(5, lt=3)]).compile(null, DoubleType())) == 0.0
    assert one(spark, Step([Band(5, otherwise=True)]).compile(null, DoubleType())) == 0.5


def test_configuration_is_checked():
    with pytest.raises(NotImplementedDim):
        Dim("taste", 1, "x", Linear(1, 2), type="llm")
    with pytest.raises(ValueError):
        FieldRule("rooms", "~", 3)
    with pytest.raises(ValueError):
        RentalPolicy("long", stay=Stay())
    with pytest.raises(ValueError):
        Target("t", "08:00", "mon", ["transit"])


def raw(spark, **over):
    base = {"url": "https://x.example/1", "source": "a", "id": "1", "rooms": 3.0, "plugin": "source-flatfox"} | over
    df = spark.createDataFrame([base], ", ".join(f"{k} {'DOUBLE' if isinstance(v, float) else 'STRING'}" for k, v in base.items()))
    return S.conform_raw(df, "plugin").withColumn("position", F.lit(1).cast("bigint"))


def test_empty_scoring_and_breakdown(spark):
    row = score_listing(raw(spark), [Dim("a", 2, "rooms", Linear(3, 0)), Dim("b", 5, "features.x", Linear(1, 0), "skip_dim")]).first()
    assert row["final"] == 100 and row["breakdown"] == {"a": 1.0}


def test_changed_flag_ignores_last_seen(spark):
    now, later = F.lit(datetime(2024, 1, 1)), F.lit(datetime(2025, 1, 1))
    first = merge_listings(stamp(raw(spark), now), ["position"])
    same = first.withColumn("last_seen_at", later)
    moved = first.withColumn("rooms", F.lit(4.0))
    assert changed_flag(first, same).first()["changed"] is False
    assert changed_flag(first, moved).first()["changed"] is True
    assert changed_flag(first.limit(0), first).first()["is_new"] is True


def test_enrich_commute_replaces_the_map(spark):
    listing = merge_listings(stamp(raw(spark), F.lit(datetime(2024, 1, 1))), ["position"])
    location = F.col("location").withField("coords", F.struct(F.lit(8.5).alias("lng"), F.lit(47.25).alias("lat")))
    geo = spark.createDataFrame([("weg 1", 47.0, 8.0)], "address_norm STRING, lat DOUBLE, lng DOUBLE")
    targets = targets_frame(spark, [Target("office", "08:30", "mon", ["transit", "cycling"], coords=(8.0, 47.0))])
    cache = spark.createDataFrame(
        [(472500, 85000, "office", "transit", "mon", 510, 1530, 2500)],
        "lat_q BIGINT, lng_q BIGINT, target STRING, mode STRING, weekday STRING, arrive_by_min INT, duration_s INT, distance_m INT",
    )
    out = enrich_commute(listing.withColumn("location", location), targets.withColumnRenamed("id", "target"), geo, cache, F.lit(datetime(2024, 1, 1)))
    cell = out.first()["enriched"]["commute"]
    assert set(cell) == {"office"} and set(cell["office"]) == {"transit"}
    assert cell["office"]["transit"]["duration_min"] == 26 and cell["office"]["transit"]["distance_km"] == 2.5


def test_scan_sitemap_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        '<?xml version="1.0"?><urlset><url><loc>https://a.ch/1</loc><lastmod>2024-01-02</lastmod></url>'
        "<url><loc>https://a.ch/2</loc></url></urlset>"
    )
    (tmp_path / "b.xml").write_text("<urlset><url><loc>https://b.ch/3</loc></url></urlset>")
    rows = scan_sitemap(spark, str(tmp_path)).collect()
    assert {(r["loc"], r["lastmod"]) for r in rows} == {
        ("https://a.ch/1", "2024-01-02"), ("https://a.ch/2", None), ("https://b.ch/3", None),
    }


def test_scan_landed_json(spark, tmp_path):
    (tmp_path / "page.json").write_text('{"results": [{"pk": 7, "zipcode": 8000, "number_of_rooms": "2.5", "images": [1]}], "next": null}')
    (tmp_path / "broken.json").write_text('{"results": [')
    out = flatfox.map_listings(flatfox.scan(spark, str(tmp_path))[0], "file", "position", "item").collect()
    assert [(r["id"], r["url"], r["rooms"], r["photos"]) for r in out] == [("flatfox:7", "https://flatfox.ch/en/flat/7/", 2.5, [])]
    (tmp_path / "hits").mkdir()
    (tmp_path / "hits" / "p.json").write_text('{"listings": [{"id": 5, "postcode": "8001", "locality": "Zürich"}, {"id": ""}, {}]}')
    hits = realadvisor.map_listings(realadvisor.scan(spark, str(tmp_path / "hits"))[0]).collect()
    assert [h["url"] for h in hits] == ["https://realadvisor.ch/en/rent/8001-zurich/apartment"]


def test_malformed_rows_reach_the_failure_log(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": "1", "listing": {"id": "a"}}\n{"id": "2", "listing": \n{"listing": {"id": "b"}}\n')
    good, bad = homegate.scan(spark, str(tmp_path))
    assert [r["id"] for r in homegate.map_listings(good).collect()] == ["homegate:a"]
    log = failure_log(bad, "source-homegate", F.lit(datetime(2024, 1, 1)))
    assert sorted(r["message"] for r in log.collect()) == ["id: required", "malformed record"]


def test_unparsable_pages_are_set_aside(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"results": [{"pk": 1}, {"pk": 2}]}')
    (tmp_path / "b.json").write_text('{"results": [{"pk": 3}, {"p')
    rows, bad = flatfox.scan(spark, str(tmp_path))
    assert rows.count() == 2
    log = failure_log(bad, flatfox.PLUGIN, F.lit("2026-01-01 00:00:00")).collect()
    assert [r["plugin"] for r in log] == ["source-flatfox"] and log[0]["message"].startswith("malformed page")


def test_null_map_entries_are_no_change(spark):
    from rentweave.operators.upsert import content_text
    from rentweave.schema import LISTING_DDL

    base = spark.createDataFrame([(1,)], "x int").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(LISTING_DDL).fields])
    kind = base.schema["enriched"].dataType
    none = F.map_from_arrays(F.array(F.lit("k")), F.array(F.lit(None).cast("string")))

    def text(lister):
        parts = [(lister if f.name in ("lister", "attrs", "external_ids") else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields]
        return base.withColumn("enriched", F.struct(*parts)).select(content_text()).first()[0]

    assert text(none) == text(F.create_map().cast("map<string,string>"))


def test_paths_below_an_open_map(spark):
    from rentweave.functions.paths import resolve_path

    df = spark.createDataFrame([({"a": '{"b":3,"c":null,"d":[{"e":"x"}]}', "f": "7"},)], "features map<string,string>")

    def found(path):
        r = resolve_path(df.schema, path)
        return df.select(r.value.cast("string"), r.missing).first()

    assert tuple(found("features.a.b")) == ("3", False) and tuple(found("features.a.c")) == (None, False)
    assert tuple(found("features.a.d.0.e")) == ('"x"', False) and found("features.a.z")[1] and found("features.f.g")[1]


def test_spread_looks_at_rows_not_at_splits(spark, tmp_path):
    """One row group in many splits, of which one has all rows, is dealt out; an even table stays as it is."""
    path = str(tmp_path / "one_group")
    spark.range(50_000, numPartitions=1).withColumn("text", F.sha2(F.col("id").cast("string"), 256)).write.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        rows = spark.read.parquet(path)
        splits = rows.rdd.getNumPartitions()
        assert splits >= cores > 1
        sizes = [r["count"] for r in session.spread(rows, "id").groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 50_000 and max(sizes) * cores <= 1.5 * 50_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    even = spark.range(1000, numPartitions=4 * cores)
    assert session.spread(even, "id") is even
