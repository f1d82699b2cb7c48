"""Listing-shaped views over the driver tables, once as DataFrames and once as DuckDB SQL.

Both sides state the same arithmetic; the checks then compare operators, not fixtures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rentweave import schema as S
from rentweave.functions.keys import listing_key
from rentweave.operators.priority import with_priority
from rentweave.session import compile_wide_rows, pin_utc, spread

ARRIVAL = [
    "l_orderkey",
    "l_linenumber",
    "l_partkey",
    "l_suppkey",
    "l_quantity",
    "l_extendedprice",
    "l_shipdate",
]

# One phrase per line of text: every language, both date styles, and no marker at all.
PHRASES = [
    "Helle Wohnung, befristet bis zum 31.12.2025 zu vermieten",
    "Verfügbar bis 1/7/26, ruhige Lage",
    "Libre jusqu'au 30.6.2027 au centre",
    "Libero fino al 31.02.2026",
    "Available until 05/11/99 only",
    "Schöne MÖBLIERTE Wohnung auf Zeit",
    "Appartement meublé, bail temporaire",
    "Appartamento ammobiliato in centro",
    "Unbefristet zu vermieten, Erstbezug",
    "Bail indéterminé, première occupation",
    "Tempo indeterminato, prima occupazione",
    "Unfurnished flat, long-term, see https://www.nordhaus-living.ch/unit/12.",
    "A *short* term let, 2 years limited, www.seeblick-immo.ch",
    "Quiet flat near the lake",
]


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


PHRASES_SQL = "[" + ", ".join(sql_text(p) for p in PHRASES) + "]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    compile_wide_rows(pin_utc(spark))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _phrase(index: Column) -> Column:
    return F.get(F.array(*[F.lit(p) for p in PHRASES]), index.cast("int"))


def raw_listings(spark: SparkSession, sf_dir: str, line: DataFrame | None = None, *keep: str) -> DataFrame:
    """lineitem x part as raw listings with stamps and the arrival columns."""
    if line is None:
        line = spread(table(spark, sf_dir, "lineitem").select(*ARRIVAL), *ARRIVAL)
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    rows = line.join(part, line.l_partkey == part.p_partkey)
    sid = F.col("l_suppkey") % 5
    no, pk, sk = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    text = lambda c: c.cast("string")
    shipped = F.col("l_shipdate").cast("timestamp")
    agency = F.concat(F.lit("Agency "), text(sk % 11))
    site = F.concat(F.lit("https://www.agency"), text(sk % 13), F.lit(".ch/kontakt"))
    source = (
        F.when(sid == 0, "flatfox")
        .when(sid == 1, "homegate")
        .when(sid == 2, "source-immoscout24")
        .when(sid == 3, F.concat(F.lit("agency:schemaorg:a"), text(sk % 7)))
        .otherwise("source-realadvisor")
    )
    plugin = F.get(
        F.array(
            *[
                F.lit(p)
                for p in (
                    "source-flatfox",
                    "source-homegate",
                    "source-immoscout24",
                    "source-schemaorg",
                    "source-realadvisor",
                )
            ]
        ),
        sid.cast("int"),
    )
    url = F.concat(
        F.lit("https://s"),
        text(sid),
        F.lit(".example/"),
        F.concat_ws(
            "-",
            F.col("l_orderkey"),
            no,
            pk,
            sk,
            F.col("l_quantity").cast("bigint"),
            F.floor(F.col("l_extendedprice") * 100 + 0.5),
            F.date_format(shipped, "yyyyMMdd"),
        ),
    )
    rooms = F.lit(1.0) + (pk % 8) * 0.5 + F.when(no % 2 == 1, 0.125).otherwise(0.0)
    photo = lambda k: F.concat(
        F.lit("https://img.example/"), text(pk % 50), F.lit("/"), text(k % 5)
    )
    photos = F.transform(
        F.filter(F.array(*[F.lit(i) for i in range(3)]), lambda i: i < no % 4), lambda i: photo(i + no)
    )
    features = F.map_from_entries(
        F.array_compact(
            F.array(
                F.when(
                    no % 2 == 0,
                    F.struct(
                        F.lit("pets_allowed").alias("key"),
                        F.when(sk % 2 == 0, "true").otherwise("false").alias("value"),
                    ),
                ),
                F.when(
                    sid == 2, F.struct(F.lit("has_garage").alias("key"), F.lit(None).cast("string").alias("value"))
                ),
                F.when(
                    sk % 3 == 0, F.struct(F.lit("bathrooms").alias("key"), text(no).alias("value"))
                ),
            )
        )
    )
    staged = rows.select(
        F.concat(source, F.lit("-"), text(F.col("l_orderkey"))).alias("id"),
        source.alias("source"),
        plugin.alias("plugin"),
        url.alias("url"),
        S.price_of(
            rent_net=F.when(no % 3 != 0, 800 + F.col("l_quantity")),
            extras=F.when(no % 3 == 1, (F.col("l_quantity") % 7) * 10),
            total=(1000 + (pk % 40) * 50 + F.col("l_quantity") % 20),
            deposit_months=F.when(sk % 4 == 0, 3.0),
        ).alias("price"),
        rooms.alias("rooms"),
        F.when(F.col("l_quantity") != 13, 40 + (pk % 20) * 5 + no % 3 - 1.0).alias("area_m2"),
        F.when(no % 3 == 2, (pk % 6).cast("double")).alias("floor"),
        F.when(no % 3 == 0, (1950 + pk % 70).cast("double")).alias("built_year"),
        S.location_of(
            coords=F.when(
                sk % 9 != 0,
                F.struct(
                    (8.4 + (pk % 100) / 500.0).alias("lng"), (47.3 + (sk % 100) / 500.0).alias("lat")
                ),
            ),
            address=F.when(sk % 3 == 0, F.concat(F.lit("Strasse "), text(pk % 97))),
            postal_code=text(8000 + F.col("p_size")),
            city=F.when(no != 5, F.concat(F.lit("City"), text(F.col("p_size") % 10))),
            region=F.get(F.array(F.lit("ZH"), F.lit("BE"), F.lit(None), F.lit("ZG")), (sk % 4).cast("int")),
        ).alias("location"),
        features.alias("features"),
        _phrase(F.col("l_orderkey") % len(PHRASES)).alias("description"),
        photos.alias("photos"),
        shipped.alias("available_from"),
        F.when(
            F.col("l_orderkey") % 5 == 0,
            F.add_months(shipped, F.col("l_quantity").cast("int")).cast("timestamp"),
        ).alias("lease_until"),
        F.get(F.array(F.lit("unknown"), F.lit("short"), F.lit("long")), (F.col("l_orderkey") % 3).cast("int")).alias(
            "rental_term"
        ),
        F.when(no % 2 == 0, agency).alias("agency"),
        S.contact_of(
            phone=F.when(sk % 2 == 0, F.concat(F.lit("+41"), text(sk))),
            email=F.when(no == 3, F.concat(F.lit("a"), text(sk % 11), F.lit("@mail.example"))),
        ).alias("contact"),
        S.enriched_of(
            lister=S.sparse_map(
                legal_name=F.when(no % 2 == 0, F.concat(agency, F.lit(" Immobilien AG"))),
                website=F.when(sk % 3 == 1, site),
            ),
            cross_listed_on=F.when(
                sid == 2, F.array(F.concat(F.lit("p"), text(no)), F.lit("home"))
            ),
        ).alias("enriched"),
        shipped.alias("first_seen_at"),
        shipped.alias("last_seen_at"),
        *ARRIVAL,
        *keep,
    )
    shaped = S.conform_raw(staged, "plugin", "first_seen_at", "last_seen_at", *ARRIVAL, *keep)
    shaped = with_priority(shaped).withColumn("seen_on_sources", F.array("source"))
    # The portal's own id goes under the source's name.
    enriched = F.col("enriched").withField("external_ids", F.create_map("source", "id"))
    return shaped.withColumn("enriched", enriched).withColumn("canonical_key", listing_key())


RAW_SQL = f"""
raw0 AS (
  SELECT l.*, p.p_size, l_suppkey % 5 AS sid
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
),
raw1 AS (
  SELECT *,
    CASE sid WHEN 0 THEN 'flatfox' WHEN 1 THEN 'homegate' WHEN 2 THEN 'source-immoscout24'
      WHEN 3 THEN 'agency:schemaorg:a' || CAST(l_suppkey % 7 AS VARCHAR) ELSE 'source-realadvisor' END AS source,
    (['source-flatfox','source-homegate','source-immoscout24','source-schemaorg','source-realadvisor'])[sid + 1] AS plugin,
    CASE sid WHEN 0 THEN 80 WHEN 4 THEN 50 ELSE 70 END AS source_priority,
    'https://s' || CAST(sid AS VARCHAR) || '.example/' || concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
      CAST(l_quantity AS BIGINT), CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT), strftime(l_shipdate, '%Y%m%d')) AS url,
    CASE WHEN l_linenumber % 3 <> 0 THEN 800 + l_quantity END AS rent_net,
    CASE WHEN l_linenumber % 3 = 1 THEN (l_quantity % 7) * 10 END AS extras,
    1000 + (l_partkey % 40) * 50 + l_quantity % 20 AS price_total,
    CASE WHEN l_suppkey % 4 = 0 THEN 3.0::DOUBLE END AS deposit_months,
    1.0::DOUBLE + (l_partkey % 8) * 0.5::DOUBLE + CASE WHEN l_linenumber % 2 = 1 THEN 0.125::DOUBLE ELSE 0 END AS rooms,
    CASE WHEN l_quantity <> 13 THEN CAST(40 + (l_partkey % 20) * 5 + l_linenumber % 3 - 1 AS DOUBLE) END AS area_m2,
    CASE WHEN l_linenumber % 3 = 2 THEN CAST(l_partkey % 6 AS DOUBLE) END AS floor_no,
    CASE WHEN l_linenumber % 3 = 0 THEN CAST(1950 + l_partkey % 70 AS DOUBLE) END AS built_year,
    CASE WHEN l_suppkey % 9 <> 0 THEN 8.4::DOUBLE + CAST(l_partkey % 100 AS DOUBLE) / 500.0::DOUBLE END AS lng,
    CASE WHEN l_suppkey % 9 <> 0 THEN 47.3::DOUBLE + CAST(l_suppkey % 100 AS DOUBLE) / 500.0::DOUBLE END AS lat,
    CASE WHEN l_suppkey % 3 = 0 THEN 'Strasse ' || CAST(l_partkey % 97 AS VARCHAR) END AS address,
    CAST(8000 + p_size AS VARCHAR) AS postal_code,
    CASE WHEN l_linenumber <> 5 THEN 'City' || CAST(p_size % 10 AS VARCHAR) END AS city,
    (['ZH','BE',NULL,'ZG'])[l_suppkey % 4 + 1] AS region,
    ({PHRASES_SQL})[l_orderkey % {len(PHRASES)} + 1] AS description,
    l_shipdate AS available_from,
    CASE WHEN l_orderkey % 5 = 0 THEN l_shipdate + to_months(CAST(l_quantity AS INTEGER)) END AS lease_until,
    (['unknown','short','long'])[l_orderkey % 3 + 1] AS rental_term,
    CASE WHEN l_linenumber % 2 = 0 THEN 'Agency ' || CAST(l_suppkey % 11 AS VARCHAR) END AS agency,
    CASE WHEN l_linenumber % 2 = 0 THEN 'Agency ' || CAST(l_suppkey % 11 AS VARCHAR) || ' Immobilien AG' END AS legal_name,
    CASE WHEN l_suppkey % 3 = 1 THEN 'https://www.agency' || CAST(l_suppkey % 13 AS VARCHAR) || '.ch/kontakt' END AS website,
    CASE WHEN l_suppkey % 2 = 0 THEN '+41' || CAST(l_suppkey AS VARCHAR) END AS phone,
    CASE WHEN l_linenumber = 3 THEN 'a' || CAST(l_suppkey % 11 AS VARCHAR) || '@mail.example' END AS email,
    [('https://img.example/' || CAST(l_partkey % 50 AS VARCHAR) || '/' || CAST((i + l_linenumber) % 5 AS VARCHAR))
      FOR i IN range(0, l_linenumber % 4)] AS photos,
    l_shipdate AS first_seen_at,
    row_number() OVER (ORDER BY {", ".join(ARRIVAL)}) AS seq
  FROM raw0
),
raw2 AS (
  SELECT *, floor(rooms * 2 + 0.5) / 2 AS rb, CAST(floor(area_m2 / 5 + 0.5) * 5 AS BIGINT) AS ab,
    CAST(floor(price_total / 50 + 0.5) * 50 AS BIGINT) AS pb
  FROM raw1
),
raw_listings AS (
  SELECT *, sha256(CASE WHEN area_m2 IS NULL THEN 'url:' || url
    ELSE postal_code || '|' || CASE WHEN rb = floor(rb) THEN CAST(CAST(rb AS BIGINT) AS VARCHAR) ELSE CAST(rb AS VARCHAR) END
      || '|' || CAST(ab AS VARCHAR) || '|' || CAST(pb AS VARCHAR) END) AS canonical_key
  FROM raw2
)"""


def with_sql(*ctes: str, select: str, recursive: bool = False) -> str:
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(c.strip() for c in ctes) + "\n" + select.strip()


# Running ranks as plain windows, the definition of a record row.
RANKED_SQL = """
ranked0 AS (
  SELECT *, row_number() OVER k AS ord,
    max(source_priority) OVER (PARTITION BY canonical_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top_p,
    min(first_seen_at) OVER (PARTITION BY canonical_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old_f
  FROM raw_listings WINDOW k AS (PARTITION BY canonical_key ORDER BY seq)
),
ranked AS (
  SELECT *, (top_p IS NULL OR source_priority > top_p OR (source_priority = top_p AND first_seen_at < old_f)) AS rec
  FROM ranked0
)"""
