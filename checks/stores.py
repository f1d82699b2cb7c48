"""Admission, outbox, reports, upsert and collapse."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.merge import FOLD_SQL
from checks.rules import COMMUTED_SQL, DIMS, SHARES_SQL, commuted
from checks.views import ARRIVAL, RANKED_SQL, RAW_SQL, raw_listings, table, with_sql
from rentweave.operators import collapse as K
from rentweave.operators import merge as M
from rentweave.operators import notify as N
from rentweave.operators.scoring import score_listing
from rentweave.operators.upsert import merge_upsert
from rentweave.plans import reports as P
from rentweave.session import cut_lineage

DAY = "yyyy-MM-dd"


def scores(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("listing_id"),
        F.col("o_orderdate").cast("timestamp").alias("scored_at"),
        (F.floor("o_totalprice") % 101).cast("int").alias("final"),
        "o_orderkey",
    )


SCORES_SQL = """
scores AS (SELECT CAST(o_custkey AS VARCHAR) AS listing_id, o_orderdate AS scored_at,
  CAST(CAST(floor(o_totalprice) AS BIGINT) % 101 AS INTEGER) AS final, o_orderkey FROM orders),
latest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY scored_at DESC, final DESC) = 1)"""


def latest_score(spark: SparkSession, sf: str) -> DataFrame:
    out = P.latest_score(scores(spark, sf))
    return out.select("listing_id", "final", F.date_format("scored_at", DAY).alias("scored_at"))


def customers_as_listings(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.cast("string").alias("canonical_key"),
        F.concat(F.lit("agency:schemaorg:n"), F.col("c_nationkey").cast("string")).alias("agency_source"),
        F.when(k % 3 == 0, F.concat(F.lit("agency:schemaorg:n"), F.col("c_nationkey").cast("string"))).otherwise("flatfox").alias("source"),
        F.concat(F.lit("https://l.example/"), k.cast("string")).alias("url"),
        F.timestamp_add("DAY", k % 500, F.lit(datetime(2000, 1, 1))).alias("first_seen_at"),
        F.timestamp_add("DAY", k % 700, F.lit(datetime(2000, 1, 1))).alias("last_seen_at"),
        F.when(k % 4 == 0, "short").when(k % 4 == 1, "long").otherwise("unknown").alias("rental_term"),
        F.when(k % 4 == 0, F.timestamp_add("DAY", k % 90, F.lit(datetime(2001, 1, 1)))).alias("lease_until"),
    )


CUSTOMERS_SQL = """
listings AS (SELECT CAST(c_custkey AS VARCHAR) AS canonical_key,
  CASE WHEN c_custkey % 3 = 0 THEN 'agency:schemaorg:n' || CAST(c_nationkey AS VARCHAR) ELSE 'flatfox' END AS source,
  'https://l.example/' || CAST(c_custkey AS VARCHAR) AS url, TIMESTAMP '2000-01-01' + to_days(CAST(c_custkey % 500 AS INTEGER)) AS first_seen_at,
  TIMESTAMP '2000-01-01' + to_days(CAST(c_custkey % 700 AS INTEGER)) AS last_seen_at, c_custkey % 4 AS r,
  CASE WHEN c_custkey % 4 = 0 THEN TIMESTAMP '2001-01-01' + to_days(CAST(c_custkey % 90 AS INTEGER)) END AS lease_until FROM customer)"""


def list_listings(spark: SparkSession, sf: str) -> DataFrame:
    listed = P.list_listings(
        customers_as_listings(spark, sf), scores(spark, sf), limit=50, source="flatfox", min_score=40, since=F.lit(datetime(2000, 3, 1))
    )
    return P.list_display(listed)


LIST_LISTINGS = with_sql(
    SCORES_SQL,
    CUSTOMERS_SQL,
    select="""SELECT CAST(s.final AS VARCHAR) AS score, CASE r WHEN 0 THEN 'S' WHEN 1 THEN 'L' ELSE '?' END AS term,
  coalesce(strftime(lease_until, '%d.%m.%Y'), '') AS until, source, canonical_key AS id, url,
  strftime(first_seen_at, '%Y-%m-%dT%H:%M:%S.000Z') AS seen
FROM listings l JOIN latest s ON s.listing_id = l.canonical_key
WHERE source = 'flatfox' AND s.final >= 40 AND first_seen_at >= TIMESTAMP '2000-03-01'
ORDER BY first_seen_at DESC, canonical_key LIMIT 50""",
)


def list_unscored(spark: SparkSession, sf: str) -> DataFrame:
    """Without a minimum score, unscored listings stay."""
    few = scores(spark, sf).filter("final > 90")
    listed = P.list_listings(customers_as_listings(spark, sf), few, limit=200)
    return P.list_display(listed).select("id", "score", "term", "seen")


LIST_UNSCORED = with_sql(
    SCORES_SQL,
    """
few AS (SELECT * FROM scores WHERE final > 90 QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY scored_at DESC, final DESC) = 1)""",
    CUSTOMERS_SQL,
    select="""SELECT canonical_key AS id, coalesce(CAST(s.final AS VARCHAR), '-') AS score,
  CASE r WHEN 0 THEN 'S' WHEN 1 THEN 'L' ELSE '?' END AS term, strftime(first_seen_at, '%Y-%m-%dT%H:%M:%S.000Z') AS seen
FROM listings l LEFT JOIN few s ON s.listing_id = l.canonical_key ORDER BY first_seen_at DESC, canonical_key LIMIT 200""",
)


def export_listings(spark: SparkSession, sf: str) -> DataFrame:
    listed = P.list_listings(customers_as_listings(spark, sf), scores(spark, sf), limit=100)
    out = P.export_json(listed.drop("agency_source"))
    pick = lambda p: F.get_json_object("value", p)
    return out.select(
        pick("$.id").alias("id"),
        pick("$.final").cast("int").alias("final"),
        pick("$.listing.rental_term").alias("term"),
        pick("$.listing.canonical_key").alias("inner_key"),
        F.substring(pick("$.listing.lease_until"), 1, 10).alias("lease_until"),
    )


EXPORT_LISTINGS = with_sql(
    SCORES_SQL,
    CUSTOMERS_SQL,
    select="""SELECT canonical_key AS id, s.final, CASE r WHEN 0 THEN 'short' WHEN 1 THEN 'long' ELSE 'unknown' END AS term,
  canonical_key AS inner_key, strftime(lease_until, '%Y-%m-%d') AS lease_until
FROM listings l LEFT JOIN latest s ON s.listing_id = l.canonical_key ORDER BY first_seen_at DESC, canonical_key LIMIT 100""",
)


def agency_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = P.agency_stats(customers_as_listings(spark, sf))
    return out.select("source", "count", F.date_format("last", DAY).alias("last"))


AGENCY_STATS = with_sql(
    CUSTOMERS_SQL,
    select="""SELECT source, count(*) AS count, strftime(max(last_seen_at), '%Y-%m-%d') AS last FROM listings
  WHERE source LIKE 'agency:%' GROUP BY source ORDER BY count DESC""",
)


def table_counts(spark: SparkSession, sf: str) -> DataFrame:
    return P.table_counts({n: table(spark, sf, n) for n in ("orders", "lineitem", "events", "pages")})


TABLE_COUNTS = " UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS n FROM {n}" for n in ("orders", "lineitem", "events", "pages"))

# --- admission ------------------------------------------------------------------------------------------


def first_arrivals(spark: SparkSession, sf: str) -> DataFrame:
    rows = raw_listings(spark, sf).select("canonical_key", "url", "source", *ARRIVAL)
    stored = rows.filter("l_partkey % 4 = 0").select("canonical_key").distinct()
    return N.first_arrivals(rows, "canonical_key", ARRIVAL, stored).select("canonical_key", "url", "source")


FIRST_ARRIVALS = with_sql(
    RAW_SQL,
    RANKED_SQL,
    select="""SELECT canonical_key, url, source FROM ranked WHERE ord = 1
  AND canonical_key NOT IN (SELECT canonical_key FROM raw_listings WHERE l_partkey % 4 = 0)""",
)


def _arrivals(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("at"), "value")


def quota_admission(spark: SparkSession, sf: str) -> DataFrame:
    """All events as candidates, clicks of high value as what the day already sent."""
    sent = table(spark, sf, "events").filter("event_type = 'click' AND value > 99.5").select(F.col("ts").cast("timestamp").alias("sent_at"))
    admitted = N.quota_admission(_arrivals(spark, sf), F.col("at"), ["at", "event_id"], 5, N.quota_used(sent))
    return admitted.select("event_id", "day")


QUOTA_ADMISSION = """WITH used AS (
  SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS used FROM events WHERE event_type = 'click' AND value > 99.5 GROUP BY 1
),
c AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) AS turn
  FROM events)
SELECT event_id, c.day FROM c LEFT JOIN used u ON u.day = c.day WHERE turn <= 5 - coalesce(used, 0)"""


def quota_used(spark: SparkSession, sf: str) -> DataFrame:
    return N.quota_used(_arrivals(spark, sf), "at")


QUOTA_USED = "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS used FROM events GROUP BY 1"


def outbox(spark: SparkSession, sf: str) -> DataFrame:
    admitted = N.quota_admission(_arrivals(spark, sf), F.col("at"), ["at", "event_id"], 5)
    return N.notification_outbox(admitted, ["telegram", "mail"]).select("event_id", "day", "notifier")


OUTBOX = """WITH c AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS day,
  row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) AS turn FROM events)
SELECT event_id, day, notifier FROM c CROSS JOIN (VALUES ('telegram'), ('mail')) n(notifier) WHERE turn <= 5"""


def also_seen(spark: SparkSession, sf: str) -> DataFrame:
    merged = M.merge_listings(raw_listings(spark, sf), ARRIVAL)
    return merged.select(
        "canonical_key", "source", F.array_join(N.also_seen_on(F.col("seen_on_sources"), F.col("source")), ",").alias("also_on")
    )


ALSO_SEEN = with_sql(
    RAW_SQL,
    RANKED_SQL,
    """
winner AS (SELECT canonical_key, source FROM ranked WHERE rec QUALIFY row_number() OVER (PARTITION BY canonical_key ORDER BY seq DESC) = 1),
others AS (SELECT DISTINCT r.canonical_key, r.source FROM ranked r JOIN winner w USING (canonical_key) WHERE r.source <> w.source)""",
    select="""SELECT w.canonical_key, w.source, coalesce(string_agg(o.source, ',' ORDER BY o.source), '') AS also_on
FROM winner w LEFT JOIN others o USING (canonical_key) GROUP BY ALL""",
)
CARD_NOW = datetime(2002, 1, 1)


def cards(spark: SparkSession, sf: str) -> DataFrame:
    scored = score_listing(commuted(spark, sf), DIMS)
    events = scored.withColumn(
        "also_seen_on", F.when(F.col("l_linenumber") == 2, F.array(F.lit("source-homegate"), F.lit("flatfox"))).otherwise(F.array().cast("ARRAY<STRING>"))
    )
    out = N.render_card(events, F.lit(CARD_NOW))
    label = F.array_join(F.transform("buttons", lambda b: F.concat(b["text"], F.lit(" "), b["url"])), " | ")
    return out.select("url", "text", label.alias("buttons"), "disable_preview")


def _num(c):
    return f"coalesce(CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END, '?')"


CARDS = with_sql(
    RAW_SQL,
    COMMUTED_SQL,
    SHARES_SQL,
    select=f"""SELECT url, concat_ws(chr(10),
  '🏠 ' || coalesce(city, 'Unknown') || ' · ' || {_num("rooms")} || 'Zi · CHF ' || {_num("price_total")} || ' · ' || {_num("area_m2")} || 'm²',
  '📍 ' || address,
  CASE WHEN rental_term = 'short' THEN '🗓 short-term' || coalesce(' · until ' || strftime(lease_until, '%d.%m.%Y'), '') END,
  '⭐ Fit ' || CAST(final AS VARCHAR) || '/100',
  coalesce('🏢 ' || agency || ' · ', '') || 'listed ' || CAST(greatest(0, CAST(floor((epoch_ms(TIMESTAMP '2002-01-01') - epoch_ms(first_seen_at)) / 60000.0::DOUBLE + 0.5) AS BIGINT)) AS VARCHAR) || ' min ago',
  CASE WHEN l_linenumber = 2 THEN '🔁 Also on: homegate, flatfox' END) AS text,
  coalesce('📷 Photos ' || photos[1] || ' | ', '') || '🔗 Open listing ' || url AS buttons,
  source = 'source-immoscout24' AS disable_preview FROM scored""",
)

# --- upsert and collapse --------------------------------------------------------------------------------


def upsert(spark: SparkSession, sf: str) -> DataFrame:
    """First two thirds of the arrivals are stored, the rest arrive: equal to one fold over all of them."""
    rows = raw_listings(spark, sf)
    early = F.col("l_orderkey") % 3 != 2
    # Arrival order of both parts: stored rows come first, as they did when they were merged.
    stored = cut_lineage(M.merge_listings(rows.filter(early), ARRIVAL))
    out = merge_upsert(stored, rows.filter(~early), ARRIVAL, F.lit(datetime(2003, 1, 1)))
    return out.select(
        "canonical_key",
        "source",
        "url",
        "source_priority",
        F.col("price.rent_net").alias("rent_net"),
        F.col("price.extras").alias("extras"),
        "floor",
        "agency",
        F.col("contact.phone").alias("phone"),
        "rental_term",
        F.date_format("first_seen_at", DAY).alias("first_seen"),
        F.date_format("last_seen_at", DAY).alias("last_seen"),
        F.array_join("photos", " ").alias("photos"),
        F.array_join("seen_on_sources", " ").alias("seen_on_sources"),
        "is_new",
    )


_LATE_SQL = RAW_SQL.replace("row_number() OVER (ORDER BY ", "row_number() OVER (ORDER BY CASE WHEN l_orderkey % 3 <> 2 THEN 0 ELSE 1 END, ")
_PHOTO_SQL = """
photo_rows AS (
  SELECT canonical_key, unnest(photos) AS photo, unnest(range(0, len(photos))) AS pos, CASE WHEN rec THEN 0 ELSE 1 END AS late,
    CASE WHEN rec THEN -seq ELSE seq END AS turn FROM ranked
),
photo_first AS (SELECT canonical_key, photo, min(row(late, turn, pos)) AS place FROM photo_rows GROUP BY ALL),
photo_lists AS (SELECT canonical_key, string_agg(photo, ' ' ORDER BY place) AS photos FROM photo_first GROUP BY ALL),
seen AS (SELECT canonical_key, string_agg(DISTINCT source, ' ' ORDER BY source) AS seen_on_sources,
  bool_and(l_orderkey % 3 = 2) AS is_new, bool_or(l_orderkey % 3 = 2) AS touched FROM raw_listings GROUP BY ALL)"""
UPSERT = with_sql(
    _LATE_SQL,
    RANKED_SQL,
    FOLD_SQL,
    _PHOTO_SQL,
    recursive=True,
    select="""SELECT f.canonical_key, source, url, source_priority, rent_net, extras, floor_no AS floor, agency, phone, rental_term,
  strftime(first_seen_at, '%Y-%m-%d') AS first_seen,
  CASE WHEN s.touched THEN '2003-01-01' ELSE strftime(last_seen_at, '%Y-%m-%d') END AS last_seen,
  coalesce(p.photos, '') AS photos, s.seen_on_sources, s.is_new
FROM fold f JOIN seen s USING (canonical_key) LEFT JOIN photo_lists p USING (canonical_key) WHERE step = n_rows""",
)


def upsert_again(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that were merged once arrive again: nothing is new, and no fact but a portal id can change."""
    rows = raw_listings(spark, sf)
    stored = cut_lineage(M.merge_listings(rows, ARRIVAL))
    again = rows.filter("l_linenumber <= 2").withColumn("source_priority", F.lit(1))
    out = merge_upsert(stored, again, ARRIVAL, F.lit(datetime(2003, 1, 1)))
    return out.groupBy("is_new", "changed", (F.col("last_seen_at") == F.lit(datetime(2003, 1, 1))).alias("bumped")).agg(
        F.count(F.lit(1)).alias("n")
    )


# Only a portal id can change: the one that arrives last wins.
UPSERT_AGAIN = with_sql(
    RAW_SQL,
    """
ids AS (
  SELECT canonical_key, source, max_by(l_orderkey, seq) AS kept, max_by(l_orderkey, seq) FILTER (WHERE l_linenumber <= 2) AS again
  FROM raw_listings GROUP BY ALL
),
judged AS (SELECT canonical_key, bool_or(again IS NOT NULL) AS bumped, bool_or(again IS NOT NULL AND again <> kept) AS changed
  FROM ids GROUP BY 1)""",
    select="SELECT FALSE AS is_new, changed, bumped, count(*) AS n FROM judged GROUP BY changed, bumped",
)


def collapse(spark: SparkSession, sf: str) -> DataFrame:
    """Rows kept per source, folded by age."""
    out = K.collapse_listings(raw_listings(spark, sf).withColumn("id", F.col("url")))
    return out.select(
        "canonical_key", "source", "url", "source_priority", F.col("price.rent_net").alias("rent_net"), "floor", "agency", "rental_term",
        F.date_format("first_seen_at", DAY).alias("first_seen"), F.size("enriched.external_ids").alias("n_ids"),
    )


COLLAPSE = with_sql(
    RAW_SQL.replace("row_number() OVER (ORDER BY " + ", ".join(ARRIVAL) + ")", "0"),
    """
aged AS (SELECT * EXCLUDE (seq), row_number() OVER (ORDER BY first_seen_at, url) AS seq FROM raw_listings)""",
    FOLD_SQL.replace("FROM raw_listings", "FROM aged"),
    """
ids AS (SELECT canonical_key, CAST(count(DISTINCT source) AS INTEGER) AS n_ids FROM raw_listings GROUP BY 1)""",
    recursive=True,
    select="""SELECT canonical_key, source, url, source_priority, rent_net, floor_no AS floor, agency, rental_term,
  strftime(first_seen_at, '%Y-%m-%d') AS first_seen, n_ids FROM fold JOIN ids USING (canonical_key) WHERE step = n_rows""",
)


def _ids(spark, sf):
    """Customers as legacy ids: five of them share one new id, a quarter are unknown."""
    c = table(spark, sf, "customer").filter("c_custkey % 4 <> 3")
    return c.select(F.col("c_custkey").cast("string").alias("listing_id"), F.concat(F.lit("k"), (F.col("c_custkey") / 5).cast("bigint").cast("string")).alias("new_id"))


_IDS_SQL = """
ids AS (SELECT CAST(c_custkey AS VARCHAR) AS listing_id, 'k' || CAST(c_custkey // 5 AS VARCHAR) AS new_id FROM customer WHERE c_custkey % 4 <> 3)"""


def repoint_scores(spark: SparkSession, sf: str) -> DataFrame:
    out = K.repoint_scores(scores(spark, sf), _ids(spark, sf), ["o_orderkey"])
    return out.select("listing_id", F.date_format("scored_at", DAY).alias("scored_at"), "final")


REPOINT_SCORES = with_sql(
    SCORES_SQL,
    _IDS_SQL,
    select="""SELECT new_id AS listing_id, strftime(scored_at, '%Y-%m-%d') AS scored_at, final FROM scores JOIN ids USING (listing_id)
  QUALIFY row_number() OVER (PARTITION BY new_id, scored_at ORDER BY o_orderkey) = 1""",
)


def repoint_notifications(spark: SparkSession, sf: str) -> DataFrame:
    rows = scores(spark, sf).select("listing_id", "o_orderkey")
    return K.repoint_notifications(rows, _ids(spark, sf)).select("listing_id", "o_orderkey")


def repoint_failures(spark: SparkSession, sf: str) -> DataFrame:
    rows = scores(spark, sf).select("listing_id", "o_orderkey")
    return K.repoint_failures(rows, _ids(spark, sf)).select("listing_id", "o_orderkey")


QUERIES = {
    "latest_score": (latest_score, with_sql(SCORES_SQL, select="SELECT listing_id, final, strftime(scored_at, '%Y-%m-%d') AS scored_at FROM latest")),
    "list_listings": (list_listings, LIST_LISTINGS),
    "list_unscored": (list_unscored, LIST_UNSCORED),
    "export_listings_json": (export_listings, EXPORT_LISTINGS),
    "agency_stats": (agency_stats, AGENCY_STATS),
    "table_counts": (table_counts, TABLE_COUNTS),
    "first_arrivals": (first_arrivals, FIRST_ARRIVALS),
    "quota_admission": (quota_admission, QUOTA_ADMISSION),
    "quota_used": (quota_used, QUOTA_USED),
    "notification_outbox": (outbox, OUTBOX),
    "also_seen_on": (also_seen, ALSO_SEEN),
    "render_card": (cards, CARDS),
    "merge_upsert": (upsert, UPSERT),
    "merge_upsert_unchanged": (upsert_again, UPSERT_AGAIN),
    "collapse_listings": (collapse, COLLAPSE),
    "repoint_scores": (repoint_scores, REPOINT_SCORES),
    "repoint_notifications": (
        repoint_notifications,
        with_sql(SCORES_SQL, _IDS_SQL, select="SELECT new_id AS listing_id, o_orderkey FROM scores JOIN ids USING (listing_id)"),
    ),
    "repoint_failures": (
        repoint_failures,
        with_sql(SCORES_SQL, _IDS_SQL, select="SELECT new_id AS listing_id, o_orderkey FROM scores LEFT JOIN ids USING (listing_id)"),
    ),
}
