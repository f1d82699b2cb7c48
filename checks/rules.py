"""Filter rules, scoring, normalisers and the rental-term gate."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.views import RAW_SQL, raw_listings, with_sql
from rentweave import schema as S
from rentweave.functions.normalize import Band, Categorical, Linear, Sigmoid, Step
from rentweave.functions.paths import resolve_path
from rentweave.operators.filters import CommuteRule, ExprRule, FieldRule, evaluate_filters
from rentweave.operators.gate import RentalPolicy, Stay, rental_term_gate
from rentweave.operators.scoring import Commute, Dim, above_threshold, score_listing

NOW = datetime(1998, 6, 1)


def commuted(spark: SparkSession, sf: str) -> DataFrame:
    """Raw listings, two thirds of them with a commute cell."""
    rows = raw_listings(spark, sf)
    cell = F.struct(
        (F.col("l_partkey") % 70).cast("int").alias("duration_min"),
        F.lit(1.0).alias("distance_km"),
        F.col("first_seen_at").alias("computed_at"),
    )
    commute = F.when(
        F.col("l_partkey") % 3 != 0,
        F.create_map(F.lit("office"), F.create_map(F.lit("transit"), cell)),
    ).cast(S.COMMUTE_DDL)
    return rows.withColumn("enriched", F.col("enriched").withField("commute", commute))


COMMUTED_SQL = """
commuted AS (SELECT *, CASE WHEN l_partkey % 3 <> 0 THEN l_partkey % 70 END AS minutes FROM raw_listings)"""

RULES = [
    FieldRule("rooms", ">=", 2),
    FieldRule("price.total", "<", 2600),
    FieldRule("location.city", "in", ["City1", "City2", "City3", "City4", "City5", "City6", "City7"]),
    FieldRule("floor", "!=", 2, on_missing="skip"),
    FieldRule("features.pets_allowed", "==", True, on_missing="skip"),
    FieldRule("features.bathrooms", "<=", 6, on_missing="pass"),
    FieldRule("photos", "contains", "https://img.example/7/2", on_missing="fail"),
]
SOFT_RULES = [
    FieldRule("rental_term", "not_in", ["short"]),
    FieldRule("description", "regex", "(?i)wohnung|flat|appart|until"),
    FieldRule("description", "contains", "e"),
    FieldRule("agency", "==", None),
    ExprRule("price.total > 1500 OR contact.phone IS NOT NULL"),
    ExprRule("floor", on_missing="pass"),
    CommuteRule("office", "transit", "<=", 45, on_missing="fail"),
    FieldRule("no.such.field", "==", 1, on_missing="skip"),
]


def _reasons(rules):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return evaluate_filters(commuted(spark, sf), rules).select("url", "reject_reason")

    return query


_NUM = lambda c: (
    f"(CASE WHEN {c} IS NULL THEN 'null' WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) "
    f"ELSE CAST({c} AS VARCHAR) END)"
)
_STR = lambda c: f"(CASE WHEN {c} IS NULL THEN 'null' ELSE '\"' || {c} || '\"' END)"

EVALUATE_FILTERS = with_sql(
    RAW_SQL,
    COMMUTED_SQL,
    select=f"""SELECT url, coalesce(
  CASE WHEN NOT coalesce(rooms >= 2, FALSE) THEN 'rooms >= 2 → got ' || {_NUM("rooms")} END,
  CASE WHEN NOT coalesce(price_total < 2600, FALSE) THEN 'price.total < 2600 → got ' || {_NUM("price_total")} END,
  CASE WHEN NOT coalesce(city IN ('City1','City2','City3','City4','City5','City6','City7'), FALSE)
    THEN 'location.city in ["City1","City2","City3","City4","City5","City6","City7"] → got ' || {_STR("city")} END,
  CASE WHEN floor_no IS NOT DISTINCT FROM 2 THEN 'floor != 2 → got ' || {_NUM("floor_no")} END,
  CASE WHEN l_linenumber % 2 = 0 AND l_suppkey % 2 <> 0 THEN 'features.pets_allowed == true → got false' END,
  CASE WHEN l_suppkey % 3 = 0 AND l_linenumber > 6 THEN 'features.bathrooms <= 6 → got ' || CAST(l_linenumber AS VARCHAR) END,
  CASE WHEN NOT list_contains(photos, 'https://img.example/7/2') THEN 'photos contains "https://img.example/7/2" → got ['
    || array_to_string([('"' || p || '"') FOR p IN photos], ',') || ']' END) AS reject_reason
FROM commuted""",
)
SOFT_FILTERS = with_sql(
    RAW_SQL,
    COMMUTED_SQL,
    select=f"""SELECT url, coalesce(
  CASE WHEN rental_term = 'short' THEN 'rental_term not_in ["short"] → got "short"' END,
  CASE WHEN NOT regexp_matches(description, '(?i)wohnung|flat|appart|until')
    THEN 'description regex "(?i)wohnung|flat|appart|until" → got ' || {_STR("description")} END,
  CASE WHEN NOT contains(description, 'e') THEN 'description contains "e" → got ' || {_STR("description")} END,
  CASE WHEN agency IS NOT NULL THEN 'agency == null → got ' || {_STR("agency")} END,
  CASE WHEN NOT (price_total > 1500 OR phone IS NOT NULL)
    THEN 'expr false: price.total > 1500 OR contact.phone IS NOT NULL' END,
  CASE WHEN floor_no = 0 THEN 'expr false: floor' END,
  CASE WHEN minutes IS NULL THEN 'commute(office,transit) missing'
    WHEN minutes > 45 THEN 'commute(office,transit) ' || CAST(minutes AS VARCHAR) || ' !<= 45' END) AS reject_reason
FROM commuted""",
)


def field_ops(spark: SparkSession, sf: str) -> DataFrame:
    """Each operator's verdict on one row."""
    df = raw_listings(spark, sf)
    from rentweave.operators.filters import compare

    def verdict(field, op, value):
        r = resolve_path(df.schema, field)
        return compare(op, r, value)

    cases = {
        "eq_num": ("rooms", "==", 3),
        "ne_null_leaf": ("area_m2", "!=", 50),
        "gt_null_leaf": ("area_m2", ">", 50),
        "ge_on_text": ("location.city", ">=", 3),
        "lt_num": ("price.total", "<", 2000),
        "in_mixed": ("floor", "in", [1, "1", None]),
        "not_in_text": ("location.region", "not_in", ["ZH", "BE"]),
        "contains_text": ("description", "contains", "Wohnung"),
        "contains_array": ("photos", "contains", "https://img.example/3/1"),
        "regex_text": ("url", "regex", "^https://s[01]"),
        "type_mismatch": ("rooms", "==", "3"),
    }
    return df.select("url", *[verdict(*c).alias(n) for n, c in cases.items()])


FIELD_OPS = with_sql(
    RAW_SQL,
    select="""SELECT url, rooms = 3 AS eq_num, area_m2 IS DISTINCT FROM 50 AS ne_null_leaf,
  coalesce(area_m2 > 50, FALSE) AS gt_null_leaf, FALSE AS ge_on_text, price_total < 2000 AS lt_num,
  (floor_no IS NULL OR floor_no = 1) AS in_mixed, coalesce(region NOT IN ('ZH','BE'), TRUE) AS not_in_text,
  contains(description, 'Wohnung') AS contains_text, list_contains(photos, 'https://img.example/3/1') AS contains_array,
  regexp_matches(url, '^https://s[01]') AS regex_text, FALSE AS type_mismatch
FROM raw_listings""",
)


def resolve_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Missing is not null: map keys, array indexes, null parents."""
    df = raw_listings(spark, sf)
    show = {
        "garage": "features.has_garage",
        "second_photo": "photos.1",
        "lng": "location.coords.lng",
        "lat_area": "area_m2",
        "nowhere": "price.nothing.here",
    }
    out = []
    for name, path in show.items():
        r = resolve_path(df.schema, path)
        value = r.value.cast("string") if not isinstance(r.kind, T.DoubleType) else F.round(r.value, 6)
        out += [value.alias(name), r.missing.alias(name + "_missing")]
    return df.select("url", *out)


RESOLVE_PATHS = with_sql(
    RAW_SQL,
    select="""SELECT url, CAST(NULL AS VARCHAR) AS garage, sid <> 2 AS garage_missing, photos[2] AS second_photo,
  len(photos) < 2 AS second_photo_missing, round(lng, 6) AS lng, lng IS NULL AS lng_missing,
  round(area_m2, 6) AS lat_area, FALSE AS lat_area_missing, CAST(NULL AS VARCHAR) AS nowhere, TRUE AS nowhere_missing
FROM raw_listings""",
)

DIMS = [
    Dim("rent", 3, "price.total", Linear(best=1200, worst=3000, invert=True)),
    Dim("rooms", 2, "rooms", Step([Band(10, gte=4), Band(7, gte=3, lt=4), Band(5, eq=2.5), Band(2, otherwise=True)])),
    Dim("area", 1.5, "area_m2", Sigmoid(midpoint=90, steepness=0.1)),
    Dim("term", 1, "rental_term", Categorical({"long": 10, "short": 2}, default=4)),
    Dim("commute", 2, Commute("office", "transit"), Linear(best=10, worst=60), on_missing="skip_dim"),
    Dim("pets", 0.5, "features.pets_allowed", Categorical({"true": 10, "false": 1}, default=3)),
    Dim("phone", 0.5, "=contact.phone IS NOT NULL", Categorical({"true": 10})),
    Dim("built", 1, "built_year", Categorical({"null": 6}, default=8)),
]
SHARES_SQL = """
shares AS (
  SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (price_total - 3000) / (1200.0::DOUBLE - 3000.0::DOUBLE))) AS s_rent,
    CASE WHEN rooms >= 4 THEN 1.0::DOUBLE WHEN rooms >= 3 AND rooms < 4 THEN 0.7::DOUBLE WHEN rooms = 2.5 THEN 0.5::DOUBLE
      ELSE 0.2::DOUBLE END AS s_rooms,
    coalesce(1.0::DOUBLE / (1.0::DOUBLE + exp(-0.1::DOUBLE * (area_m2 - 90))), 0) AS s_area,
    CASE rental_term WHEN 'long' THEN 1.0::DOUBLE WHEN 'short' THEN 0.2::DOUBLE ELSE 0.4::DOUBLE END AS s_term,
    greatest(0.0::DOUBLE, least(1.0::DOUBLE, (CAST(minutes AS DOUBLE) - 60) / -50.0::DOUBLE)) AS s_commute0,
    CASE WHEN l_linenumber % 2 <> 0 THEN 0.0::DOUBLE WHEN l_suppkey % 2 = 0 THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END AS s_pets,
    CASE WHEN phone IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS s_phone,
    CASE WHEN built_year IS NULL THEN 0.6::DOUBLE ELSE 0.8::DOUBLE END AS s_built
  FROM commuted
),
scored AS (
  SELECT *, CASE WHEN minutes IS NULL THEN NULL ELSE s_commute0 END AS s_commute,
    CAST(floor((s_rent * 3.0::DOUBLE + s_rooms * 2.0::DOUBLE + s_area * 1.5::DOUBLE + s_term * 1.0::DOUBLE
      + CASE WHEN minutes IS NULL THEN 0.0::DOUBLE ELSE s_commute0 * 2.0::DOUBLE END + s_pets * 0.5::DOUBLE
      + s_phone * 0.5::DOUBLE + s_built * 1.0::DOUBLE)
      / (CASE WHEN minutes IS NULL THEN 9.5::DOUBLE ELSE 11.5::DOUBLE END) * 100 + 0.5) AS INTEGER) AS final
  FROM shares
)"""


def score(spark: SparkSession, sf: str) -> DataFrame:
    scored = score_listing(commuted(spark, sf), DIMS)
    shares = [F.round(F.try_element_at("breakdown", F.lit(d.name)), 6).alias("s_" + d.name) for d in DIMS]
    return scored.select("url", "final", *shares)


SCORE = with_sql(
    RAW_SQL,
    COMMUTED_SQL,
    SHARES_SQL,
    select="SELECT url, final, "
    + ", ".join(f"round(s_{d.name}, 6) AS s_{d.name}" for d in DIMS)
    + " FROM scored",
)


def threshold(spark: SparkSession, sf: str) -> DataFrame:
    return above_threshold(score_listing(commuted(spark, sf), DIMS), 70).select("url", "final")


THRESHOLD = with_sql(RAW_SQL, COMMUTED_SQL, SHARES_SQL, select="SELECT url, final FROM scored WHERE final >= 70")


def score_failures(spark: SparkSession, sf: str) -> DataFrame:
    """A ``fail`` dimension turns a missing metric into a failure row."""
    dims = [
        Dim("commute", 1, Commute("office", "transit"), Linear(best=0, worst=80), on_missing="fail"),
        Dim("lng", 1, "location.coords.lng", Linear(best=9, worst=8), on_missing="fail"),
    ]
    scored = score_listing(commuted(spark, sf), dims)
    return scored.filter("final IS NULL").groupBy("score_error").agg(F.count(F.lit(1)).alias("n"))


SCORE_FAILURES = with_sql(
    RAW_SQL,
    COMMUTED_SQL,
    select="""SELECT CASE WHEN minutes IS NULL THEN 'missing metric commute(office,transit) for dim commute'
  ELSE 'missing metric location.coords.lng for dim lng' END AS score_error, count(*) AS n
FROM commuted WHERE minutes IS NULL OR lng IS NULL GROUP BY 1""",
)


def _norms(df: DataFrame) -> DataFrame:
    d = T.DoubleType()
    x = F.col("l_quantity")
    maybe = F.when(F.col("l_linenumber") != 7, x)
    return df.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.round(Linear(5, 45).compile(x, d), 9).alias("falling"),
        F.round(Linear(40, 10).compile(maybe, d), 9).alias("rising"),
        Linear(3, 3).compile(x, d).alias("degenerate"),
        Step([Band(9, eq=13), Band(4, lt=10), Band(6, gte=20, lt=30)]).compile(maybe, d).alias("step"),
        Step([Band(8, eq="R"), Band(1, otherwise=True)]).compile(F.col("l_returnflag"), T.StringType()).alias("step_text"),
        F.round(Sigmoid(25, 0.3, invert=True).compile(x, d), 9).alias("logistic"),
        Categorical({"13": 9, "7": 2, "null": 5}, default=1).compile(maybe, d).alias("lookup"),
    )


def normalisers(spark: SparkSession, sf: str) -> DataFrame:
    from checks.views import table

    return _norms(table(spark, sf, "lineitem"))


NORMALISERS = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (l_quantity - 45) / -40.0::DOUBLE)), 9) AS falling,
  CASE WHEN l_linenumber = 7 THEN 0.0::DOUBLE
    ELSE round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (l_quantity - 10) / 30.0::DOUBLE)), 9) END AS rising,
  0.0::DOUBLE AS degenerate,
  CASE WHEN l_linenumber = 7 THEN 0.0::DOUBLE WHEN l_quantity = 13 THEN 0.9::DOUBLE WHEN l_quantity < 10 THEN 0.4::DOUBLE
    WHEN l_quantity >= 20 AND l_quantity < 30 THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END AS step,
  CASE WHEN l_returnflag = 'R' THEN 0.8::DOUBLE ELSE 0.1::DOUBLE END AS step_text,
  round(1.0::DOUBLE - 1.0::DOUBLE / (1.0::DOUBLE + exp(-0.3::DOUBLE * (l_quantity - 25))), 9) AS logistic,
  CASE WHEN l_linenumber = 7 THEN 0.5::DOUBLE WHEN l_quantity = 13 THEN 0.9::DOUBLE WHEN l_quantity = 7 THEN 0.2::DOUBLE
    ELSE 0.1::DOUBLE END AS lookup
FROM lineitem"""


def _gate(policy: RentalPolicy):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows = raw_listings(spark, sf)
        return rental_term_gate(rows, policy, F.lit(NOW)).select("url", "gate_reason")

    return query


GATE_LONG = with_sql(
    RAW_SQL,
    select="""SELECT url, CASE WHEN lease_until < TIMESTAMP '1998-06-01' THEN 'lease expired'
  WHEN rental_term = 'short' THEN 'rental_term=short'
  WHEN rental_term = 'unknown' THEN 'rental_term=unknown (exclude_unknown=true)' END AS gate_reason FROM raw_listings""",
)
STAY = Stay(start=datetime(1999, 1, 1), end=datetime(1999, 6, 1), min_months=6, max_months=30.5)
GATE_SHORT = with_sql(
    RAW_SQL,
    """
timed AS (SELECT *, CAST(epoch_us(lease_until) - epoch_us(available_from) AS DOUBLE) / (86400e6::DOUBLE * 30.44::DOUBLE) AS months
  FROM raw_listings)""",
    select="""SELECT url, CASE WHEN lease_until < TIMESTAMP '1998-06-01' THEN 'lease expired'
  WHEN rental_term <> 'short' THEN 'rental_term=' || rental_term
  WHEN available_from > TIMESTAMP '1999-01-01' THEN 'available_from after stay.from'
  WHEN lease_until < TIMESTAMP '1999-06-01' THEN 'lease_until before stay.to'
  WHEN months < 6 THEN 'duration ' || printf('%.1f', months) || 'mo < min_months 6'
  WHEN months > 30.5 THEN 'duration ' || printf('%.1f', months) || 'mo > max_months 30.5' END AS gate_reason FROM timed""",
)

ERROR_RULES = [
    ExprRule("price.total / (l_linenumber - 2) > 0", on_missing="pass"),
    ExprRule("CAST(split(url, '-')[4] AS INT) < 9000 AND photos[1] IS NOT NULL", on_missing="skip"),
    ExprRule("element_at(features, 'bathrooms') || 'x'", on_missing="pass"),
    ExprRule("CAST(location.city AS INT) = 1", on_missing="pass"),
    ExprRule("make_date(2000, 1, l_linenumber * 10) >= DATE'2000-01-01'", on_missing="fail"),
    ExprRule("l_linenumber - 3"),
]
ERROR_DIMS = [
    Dim("rate", 1, "=l_partkey / (l_linenumber % 3)", Step([Band(10, gte=20), Band(5, otherwise=True)]), on_missing="skip_dim"),
    Dim("code", 1, "=CAST(substring(location.city, 5) AS INT) / (l_suppkey % 4)", Step([Band(10, gte=2), Band(5, otherwise=True)]), on_missing="fail"),
]


def expr_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Expressions that throw in some rows: rules follow ``on_missing`` there, metrics fail the row alone."""
    rows = evaluate_filters(raw_listings(spark, sf), ERROR_RULES)
    scored = score_listing(rows, ERROR_DIMS)
    return scored.select("url", "reject_reason", "final", "score_error")


EXPR_ERRORS = with_sql(
    RAW_SQL,
    select="""SELECT url, CASE WHEN l_linenumber = 1 THEN 'expr false: price.total / (l_linenumber - 2) > 0'
    WHEN len(photos) < 2 THEN 'expr false: CAST(split(url, ''-'')[4] AS INT) < 9000 AND photos[1] IS NOT NULL'
    WHEN l_linenumber * 10 > 31 THEN 'expr resolved to undefined: make_date(2000, 1, l_linenumber * 10) >= DATE''2000-01-01'''
    WHEN l_linenumber = 3 THEN 'expr false: l_linenumber - 3' END AS reject_reason,
  CASE WHEN city IS NOT NULL AND l_suppkey % 4 <> 0 THEN CAST(floor((CASE WHEN l_linenumber % 3 = 0 THEN code ELSE (rate + code) / 2 END) * 100 + 0.5) AS INTEGER) END AS final,
  CASE WHEN city IS NULL OR l_suppkey % 4 = 0 THEN 'missing metric =CAST(substring(location.city, 5) AS INT) / (l_suppkey % 4) for dim code' END AS score_error
FROM (SELECT *, CASE WHEN l_partkey / nullif(l_linenumber % 3, 0) >= 20 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS rate,
  CASE WHEN CAST(city[5:] AS INT) / nullif(l_suppkey % 4, 0) >= 2 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS code FROM raw_listings)""",
)

QUERIES = {
    "expr_errors": (expr_errors, EXPR_ERRORS),
    "evaluate_filters": (_reasons(RULES), EVALUATE_FILTERS),
    "expr_and_commute_rules": (_reasons(SOFT_RULES), SOFT_FILTERS),
    "field_rule_ops": (field_ops, FIELD_OPS),
    "resolve_path": (resolve_paths, RESOLVE_PATHS),
    "score_listing": (score, SCORE),
    "score_threshold": (threshold, THRESHOLD),
    "score_failures": (score_failures, SCORE_FAILURES),
    "normalisers": (normalisers, NORMALISERS),
    "rental_term_gate_long": (_gate(RentalPolicy("long", exclude_unknown=True)), GATE_LONG),
    "rental_term_gate_short": (_gate(RentalPolicy("short", stay=STAY)), GATE_SHORT),
}
