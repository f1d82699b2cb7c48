"""Text classification and scalar functions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.views import PHRASES, PHRASES_SQL, table
from rentweave.functions.dates import hhmm_to_min, next_weekday_at, parse_date_strict, utc_day
from rentweave.functions.names import candidate_domains
from rentweave.functions.numbers import parse_price_like, quantize, round_half_up, to_number
from rentweave.functions.rental_term import DATED_MARKERS, LONG_MARKERS, SHORT_MARKERS, classify_rental_term
from rentweave.functions.text import html_entity_decode, normalize_address, slugify
from rentweave.operators.candidates import is_new_build

# RE2 has no Unicode \s; every space class is spelled out.
RE2_SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def re2(pattern: str) -> str:
    out = pattern.replace(r"[-\s]", "[-" + RE2_SPACE[1:]).replace(r"’\s]", "’" + RE2_SPACE[1:])
    for mark in "+*?":
        out = out.replace("\\s" + mark, RE2_SPACE + mark)
    return ("(?i)" + out).replace("'", "''")


def listing_text(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents, each with one of the phrases appended."""
    docs = table(spark, sf, "documents")
    phrase = F.get(F.array(*[F.lit(p) for p in PHRASES]), (F.col("doc_id") % len(PHRASES)).cast("int"))
    return docs.select("doc_id", "lang", F.concat("text", F.lit(" "), phrase).alias("description"))


TEXT_SQL = f"""
listing_text AS (SELECT doc_id, lang, text || ' ' || ({PHRASES_SQL})[doc_id % {len(PHRASES)} + 1] AS description FROM documents),
plain AS (SELECT *, regexp_replace(description, '[*_]+', ' ', 'g') AS t FROM listing_text)"""


def classify(spark: SparkSession, sf: str) -> DataFrame:
    rows = listing_text(spark, sf)
    out = classify_rental_term(
        rows,
        F.col("description"),
        lease_until=F.when(F.col("doc_id") % 29 == 0, F.lit(datetime(2026, 1, 1))),
        is_furnished=F.when(F.col("doc_id") % 31 == 0, F.lit(True)),
    )
    return out.select("doc_id", "rental_term", "signal", F.date_format("lease_until", "yyyy-MM-dd").alias("lease_until"))


_markers = [m for m, _ in DATED_MARKERS + SHORT_MARKERS + LONG_MARKERS]
_case = "\n".join(f"    WHEN regexp_matches(t, '{re2(p)}') THEN {i}" for i, p in enumerate(_markers))
_dates = "\n".join(
    f"    WHEN {i} THEN regexp_extract(t, '{re2(p)}', 1)" for i, (p, _) in enumerate(DATED_MARKERS)
)
_n_short = len(DATED_MARKERS) + len(SHORT_MARKERS)
_STRICT = r"'^([0-9]{1,2})[./]([0-9]{1,2})[./]([0-9]{2}|[0-9]{4})$'"


def strict_date_sql(expr: str) -> str:
    """ISO date text of a strict date, null when the day does not exist."""
    y = f"regexp_extract({expr}, {_STRICT}, 3)"
    year = (
        f"CASE WHEN length({y}) = 2 THEN CAST({y} AS INTEGER) + CASE WHEN CAST({y} AS INTEGER) >= 70 THEN 1900 ELSE 2000 END "
        f"WHEN length({y}) = 4 AND CAST({y} AS INTEGER) >= 100 THEN CAST({y} AS INTEGER) END"
    )
    return (
        f"strftime(TRY_CAST(printf('%04d-%02d-%02d', {year}, CAST(nullif(regexp_extract({expr}, {_STRICT}, 2), '') AS INTEGER), "
        f"CAST(nullif(regexp_extract({expr}, {_STRICT}, 1), '') AS INTEGER)) AS DATE), '%Y-%m-%d')"
    )


CLASSIFY = f"""WITH {TEXT_SQL.strip()},
marked AS (
  SELECT *, CASE
{_case}
  END AS marker FROM plain
),
dated AS (SELECT *, CASE marker
{_dates}
  END AS captured FROM marked)
SELECT doc_id,
  CASE WHEN doc_id % 29 = 0 OR doc_id % 31 = 0 OR marker < {_n_short} THEN 'short' WHEN marker IS NOT NULL THEN 'long'
    ELSE 'unknown' END AS rental_term,
  CASE WHEN doc_id % 29 = 0 OR doc_id % 31 = 0 THEN 'structured' WHEN marker IS NOT NULL THEN 'description' ELSE 'none' END AS signal,
  CASE WHEN doc_id % 29 = 0 THEN '2026-01-01' WHEN doc_id % 31 = 0 THEN NULL ELSE {strict_date_sql("captured")} END AS lease_until
FROM dated"""


def strict_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Day, month and year texts made from order keys, valid and not."""
    k = F.col("o_orderkey")
    text = F.concat(
        (k % 34).cast("string"),
        F.when(k % 2 == 0, ".").otherwise("/"),
        (k % 14).cast("string"),
        F.lit("."),
        F.when(k % 3 == 0, F.lpad((k % 100).cast("string"), 2, "0"))
        .when(k % 3 == 1, F.lpad((k % 2500).cast("string"), 4, "0"))
        .otherwise((k % 10).cast("string")),
    )
    rows = table(spark, sf, "orders").select("o_orderkey", text.alias("raw"))
    return rows.select("o_orderkey", "raw", F.date_format(parse_date_strict(F.col("raw")), "yyyy-MM-dd").alias("day"))


STRICT_DATES = f"""WITH texts AS (
  SELECT o_orderkey, CAST(o_orderkey % 34 AS VARCHAR) || CASE WHEN o_orderkey % 2 = 0 THEN '.' ELSE '/' END
    || CAST(o_orderkey % 14 AS VARCHAR) || '.' || CASE o_orderkey % 3 WHEN 0 THEN lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0')
      WHEN 1 THEN lpad(CAST(o_orderkey % 2500 AS VARCHAR), 4, '0') ELSE CAST(o_orderkey % 10 AS VARCHAR) END AS raw FROM orders)
SELECT o_orderkey, raw, {strict_date_sql("raw")} AS day FROM texts"""


def new_build(spark: SparkSession, sf: str) -> DataFrame:
    return listing_text(spark, sf).filter(is_new_build(F.col("description"))).select("doc_id")


NEW_BUILD = f"""WITH {TEXT_SQL.strip()}
SELECT doc_id FROM listing_text WHERE contains(lower(description), 'erstbezug') OR contains(lower(description), 'neubau')
  OR contains(lower(description), 'prima occupazione') OR contains(lower(description), 'première occupation')
  OR contains(lower(description), 'first occupancy') OR contains(lower(description), 'first-time occupancy')"""


def slugs(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of every document as a locality name, accents included."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "name"))
    return lines.select("doc_id", "line", slugify(F.col("name")).alias("slug"))


SLUGS = r"""SELECT doc_id, CAST(line AS INTEGER) AS line, regexp_replace(regexp_replace(lower(strip_accents(name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS name, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents)"""


def _name(k: Column) -> Column:
    parts = ["Müller", "& Söhne", "Immobilien", "Nord-Haus", "Verwaltung", "d'Or", "Real Estate", "Group", "AG", "GmbH", "SA"]
    pick = lambda e: F.get(F.array(*[F.lit(p) for p in parts]), e.cast("int"))
    return F.concat_ws(" ", pick(k % 11), pick((k / 11).cast("bigint") % 11), pick((k / 121).cast("bigint") % 11))


_PARTS_SQL = "['Müller','& Söhne','Immobilien','Nord-Haus','Verwaltung','d''Or','Real Estate','Group','AG','GmbH','SA']"


def domains(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", _name(F.col("o_orderkey")).alias("legal_name"))
    return rows.select("o_orderkey", "legal_name", F.array_join(candidate_domains(F.col("legal_name")), " ").alias("hosts"))


DOMAINS = f"""WITH names AS (
  SELECT o_orderkey, concat_ws(' ', ({_PARTS_SQL})[o_orderkey % 11 + 1], ({_PARTS_SQL})[(o_orderkey // 11) % 11 + 1],
    ({_PARTS_SQL})[(o_orderkey // 121) % 11 + 1]) AS legal_name FROM orders
),
tokens AS (
  SELECT *, list_filter(string_split(regexp_replace(replace(replace(lower(strip_accents(legal_name)), '&', ' and '), '''', ''),
    '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '' AND t NOT IN ('ag','gmbh','sa','sarl','srl','gbr','kg','co','company','inc',
    'llc','ltd','limited')) AS toks FROM names
),
telling AS (
  SELECT *, list_filter(toks, lambda t: t NOT IN ('immobilien','immobiliare','immobilier','immobile','real','estate','group',
    'bewirtschaftung','verwaltung','verwaltungs','verwaltungsag','management','invest','investment','investments','partners',
    'service','services','consulting','beratung','beratungs')) AS m FROM tokens
),
ladder AS (
  SELECT *, CASE WHEN len(m) > 1 THEN array_to_string(m, '-') END AS a, CASE WHEN len(m) > 1 THEN m[1] || '-' || m[2] END AS b,
    m[1] AS c, toks[1] AS d FROM telling
)
SELECT o_orderkey, legal_name, coalesce(concat_ws(' ', a || '.ch', CASE WHEN b IS DISTINCT FROM a THEN b || '.ch' END,
  CASE WHEN c IS DISTINCT FROM a AND c IS DISTINCT FROM b THEN c || '.ch' END,
  CASE WHEN d IS DISTINCT FROM a AND d IS DISTINCT FROM b AND d IS DISTINCT FROM c THEN d || '.ch' END), '') AS hosts FROM ladder"""


def price_texts(spark: SparkSession, sf: str) -> DataFrame:
    k, p = F.col("o_orderkey"), F.floor("o_totalprice")
    whole = (p % 9000 + 100).cast("string")
    text = (
        F.when(k % 6 == 0, F.concat(F.lit("1'"), F.lpad((p % 1000).cast("string"), 3, "0"), F.lit(".50")))
        .when(k % 6 == 1, F.concat(whole, F.lit(",5")))
        .when(k % 6 == 2, F.concat(F.lit("2 "), F.lpad((p % 1000).cast("string"), 3, "0")))
        .when(k % 6 == 3, F.concat(F.lit("1.234."), (p % 100).cast("string")))
        .when(k % 6 == 4, F.concat(whole, F.lit(".-")))
        .otherwise(F.lit("auf Anfrage"))
    )
    rows = table(spark, sf, "orders").select("o_orderkey", text.alias("raw"))
    return rows.select(
        "o_orderkey",
        "raw",
        F.round(parse_price_like(F.col("raw")), 4).alias("price"),
        F.round(to_number(F.regexp_replace("raw", "'", "")), 4).alias("as_number"),
    )


PRICE_TEXTS = r"""WITH texts AS (
  SELECT o_orderkey, CASE o_orderkey % 6
    WHEN 0 THEN '1''' || lpad(CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS VARCHAR), 3, '0') || '.50'
    WHEN 1 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) % 9000 + 100 AS VARCHAR) || ',5'
    WHEN 2 THEN '2 ' || lpad(CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS VARCHAR), 3, '0')
    WHEN 3 THEN '1.234.' || CAST(CAST(floor(o_totalprice) AS BIGINT) % 100 AS VARCHAR)
    WHEN 4 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) % 9000 + 100 AS VARCHAR) || '.-'
    ELSE 'auf Anfrage' END AS raw FROM orders
),
clean AS (SELECT *, replace(replace(raw, '''', ''), ' ', '') AS c FROM texts)
SELECT o_orderkey, raw, round(CASE WHEN regexp_matches(c, '^[0-9]+([.,][0-9]{1,2})?$') THEN CAST(replace(c, ',', '.') AS DOUBLE)
    ELSE TRY_CAST(nullif(regexp_replace(c, '[^0-9]', '', 'g'), '') AS DOUBLE) END, 4) AS price,
  round(CASE WHEN regexp_matches(replace(raw, '''', ''), '^[0-9]+(\.[0-9]*)?$') THEN CAST(replace(raw, '''', '') AS DOUBLE) END, 4) AS as_number
FROM clean"""


def clock(spark: SparkSession, sf: str) -> DataFrame:
    """Next weekday occurrence and small scalar helpers over event times."""
    e = table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    k = F.col("event_id")
    day = F.get(F.array(*[F.lit(d) for d in ("mon", "tue", "wed", "thu", "fri", "sat", "sun")]), (k % 7).cast("int"))
    hhmm = F.concat(F.lpad((k % 24).cast("string"), 2, "0"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"))
    return e.select(
        "event_id",
        hhmm_to_min(hhmm).alias("minutes"),
        F.date_format(next_weekday_at(day, hhmm, F.col("at")), "yyyy-MM-dd HH:mm:ss").alias("next_at"),
        utc_day(F.col("at")).alias("day"),
        round_half_up(F.col("value") - 50).alias("rounded"),
        quantize(F.col("value") / 7 - 5, 4).alias("quantized"),
        normalize_address(F.concat(F.lit("  Haupt  STRASSE "), k.cast("string"), F.lit(" \t"))).alias("address"),
    )


CLOCK = """WITH e AS (
  SELECT event_id, ts, value, event_id % 24 AS h, event_id % 60 AS m, event_id % 7 + 1 AS wanted,
    CAST(event_id % 24 AS BIGINT) * 60 + event_id % 60 AS minutes, isodow(ts) AS today FROM events
),
ahead AS (SELECT *, (wanted - today + 7) % 7 AS days, date_trunc('day', ts) + to_minutes(CAST(minutes AS INTEGER)) AS same_day FROM e)
SELECT event_id, CAST(minutes AS INTEGER) AS minutes,
  strftime(same_day + to_days(CAST(CASE WHEN days = 0 AND same_day <= ts THEN 7 ELSE days END AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS next_at,
  strftime(ts, '%Y-%m-%d') AS day, CAST(floor(value - 50 + 0.5) AS BIGINT) AS rounded,
  CAST(floor((value / 7 - 5) * 10000.0::DOUBLE + 0.5) AS BIGINT) AS quantized,
  'haupt strasse ' || CAST(event_id AS VARCHAR) AS address
FROM ahead"""


def entities(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their umlauts escaped come back unchanged."""
    text = F.col("text")
    for ch, escaped in (("&", "&amp;"), ("ü", "&#xFC;"), ("é", "&#233;"), ("<", "&lt;")):
        text = F.replace(text, F.lit(ch), F.lit(escaped))
    docs = table(spark, sf, "documents").select("doc_id", text.alias("escaped"))
    return docs.select("doc_id", F.md5(html_entity_decode(F.col("escaped"))).alias("digest"))


ENTITIES = "SELECT doc_id, md5(text) AS digest FROM documents"

QUERIES = {
    "classify_rental_term": (classify, CLASSIFY),
    "parse_date_strict": (strict_dates, STRICT_DATES),
    "new_build_phrases": (new_build, NEW_BUILD),
    "slugify_locality": (slugs, SLUGS),
    "candidate_domains": (domains, DOMAINS),
    "parse_price_like": (price_texts, PRICE_TEXTS),
    "clock_and_rounding": (clock, CLOCK),
    "html_entity_decode": (entities, ENTITIES),
}
