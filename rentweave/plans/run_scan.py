"""One scan: arrivals to merged listings, scores and admitted notifications."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentweave.functions.keys import listing_key
from rentweave.operators.enricher import ERRORS, ERRORS_DDL
from rentweave.operators.filters import Rule, evaluate_filters
from rentweave.operators.gate import RentalPolicy, rental_term_gate
from rentweave.operators.merge import KEY, MAP_PARTS, SCALAR_LEAVES, merge_history, nested_columns
from rentweave.operators.notify import notification_outbox, quota_admission
from rentweave.operators.priority import with_priority
from rentweave.operators.scoring import Dim, score_listing
from rentweave.operators.skew import HotKeys, find_hot_keys
from rentweave.operators.upsert import merge_upsert
from rentweave.schema import LISTING_FIELDS, null_of
from rentweave.session import cut_lineage

Enricher = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class ScanConfig:
    policy: RentalPolicy
    rules: Sequence[Rule]
    dims: Sequence[Dim]
    threshold: float = 75
    daily_quota: int = 5
    notifiers: Sequence[str] = ("telegram",)
    # Enrichers see new listings only and may change nothing but ``enriched``.
    enrichers: Sequence[Enricher] = ()
    sources: Sequence[str] | None = None
    dry_run: bool = False


@dataclass(frozen=True)
class ScanResult:
    listings: DataFrame
    scores: DataFrame
    outbox: DataFrame
    failures: DataFrame
    admitted: DataFrame = field(repr=False)


def stamp(raw: DataFrame, now: Column, priorities: DataFrame | None = None) -> DataFrame:
    """Key, priority and dates of arriving rows; the portal's id goes under its source."""
    have = set(raw.columns)
    seen = lambda c: F.coalesce(F.col(c), now) if c in have else now
    ids = F.coalesce("enriched.external_ids", F.create_map().cast("MAP<STRING, STRING>"))
    others = F.map_filter(ids, lambda k, _: k != F.col("source"))
    own = F.when(F.col("id").isNotNull(), F.map_concat(others, F.create_map("source", "id"))).otherwise(ids)
    return with_priority(raw, priorities).withColumns(
        {
            "first_seen_at": seen("first_seen_at").cast("timestamp"),
            "last_seen_at": seen("last_seen_at").cast("timestamp"),
            "seen_on_sources": F.array("source"),
            "enriched": F.col("enriched").withField("external_ids", own),
            KEY: listing_key(),
        }
    )


def arrival_heat(arrivals: DataFrame, order: Sequence[str]) -> HotKeys:
    """Hot keys of a scan, found once and shared by its history and its merge."""
    return find_hot_keys(arrivals, KEY, [F.col(c) for c in order])


def versions(
    arrivals: DataFrame, stored: DataFrame | None, order: Sequence[str], hot: HotKeys | None = None
) -> DataFrame:
    """The merged listing after each arrival, in the listing schema, with ``is_new`` and ``changed``."""
    # A listing's id is its key.
    fields = [n for n, _ in LISTING_FIELDS if n != "id"]
    rows = arrivals.select(*fields, *order, F.lit(1).alias("_turn"))
    if stored is not None:
        touched = arrivals.select(KEY).distinct()
        base = stored.join(touched, KEY, "left_semi").select(
            *fields, *[F.lit(None).cast(arrivals.schema[c].dataType).alias(c) for c in order], F.lit(0).alias("_turn")
        )
        rows = base.unionByName(rows)
    lead = [F.when(F.col("_turn") == 1, F.col(c)) for c in order]
    history = merge_history(rows, ["_turn", *order], hot=hot, lead=lead, collections=True)
    flat = history.filter("_turn = 1").select(
        KEY,
        *order,
        "is_new",
        "changed",
        F.col("v_source").alias("source"),
        F.col("v_url").alias("url"),
        F.col("v_priority").alias("source_priority"),
        F.col("v_first_seen").alias("first_seen_at"),
        "last_seen_at",
        F.col("v_photos").alias("photos"),
        F.col("v_seen_on_sources").alias("seen_on_sources"),
        F.col("enriched.cross_listed_on").alias("cross_listed_on"),
        null_of("MAP<STRING, STRING>").alias("external_ids"),
        *[F.col("v_" + k).alias(k) for k in MAP_PARTS],
        *[F.col("v_" + n).alias(n) for n in SCALAR_LEAVES],
    )
    return flat.select(*nested_columns(flat), *order, "is_new", "changed")


def score_versions(
    arrivals: DataFrame,
    order: Sequence[str],
    cfg: ScanConfig,
    now: Column,
    stored: DataFrame | None = None,
    hot: HotKeys | None = None,
) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Changed versions that pass the gate and the rules, scored (slim rows), the commutes enrichers found, and what enrichers failed on."""
    seen = versions(arrivals, stored, order, hot).filter("changed OR is_new")
    commutes = troubles = None
    if cfg.enrichers:
        fresh, broken = seen.filter("is_new"), []
        for enrich in cfg.enrichers:
            try:
                fresh = enrich(fresh)
            except Exception as problem:  # one that can't even be planned; listings go on without it
                broken.append((getattr(enrich, "__name__", "enricher"), f"{type(problem).__name__}: {problem}"))
        errors = F.col(ERRORS) if ERRORS in fresh.columns else null_of(ERRORS_DDL)
        # Enrichers are asked once; both their finds and their failures come from what they said.
        said = cut_lineage(fresh.select(KEY, F.col("enriched.commute").alias("_commute"), errors.alias(ERRORS)))
        # What the first version got stays with the key.
        commutes = said.select(KEY, "_commute").filter("_commute IS NOT NULL")
        troubles = said.select(F.col(KEY).alias("listing_id"), F.explode(ERRORS).alias("e")).select("e.plugin", "listing_id", "e.message")
        if broken:
            whole = [(plugin, None, message) for plugin, message in broken]
            troubles = troubles.unionByName(said.sparkSession.createDataFrame(whole, "plugin STRING, listing_id STRING, message STRING"))
    known = commutes
    if stored is not None:
        # A listing keeps the commute it was stored with, whether or not an enricher runs now.
        kept = stored.select(KEY, F.col("enriched.commute").alias("_commute")).filter("_commute IS NOT NULL")
        known = kept if commutes is None else commutes.unionByName(kept)
    if known is not None:
        seen = with_commute(seen, known)
    gated = rental_term_gate(seen, cfg.policy, now).filter("gate_reason IS NULL").drop("gate_reason")
    passed = evaluate_filters(gated, cfg.rules).filter("reject_reason IS NULL").drop("reject_reason")
    scored = score_listing(passed, cfg.dims)
    return scored.select(KEY, "url", "is_new", "final", "breakdown", "score_error", *order), commutes, troubles


@dataclass(frozen=True)
class Outcomes:
    scores: DataFrame
    failures: DataFrame
    admitted: DataFrame
    outbox: DataFrame


def decide(
    scored: DataFrame, order: Sequence[str], cfg: ScanConfig, now: Column, outbox_used: DataFrame | None = None
) -> Outcomes:
    """Scores, failures, admissions and notifications of scored versions."""
    scores = scored.filter("final IS NOT NULL").select(
        F.col(KEY).alias("listing_id"), now.cast("timestamp").alias("scored_at"), "final", "breakdown", *order
    )
    failures = scored.filter("final IS NULL").select(
        F.lit("scoring").alias("plugin"),
        F.col(KEY).alias("listing_id"),
        now.cast("timestamp").alias("occurred_at"),
        F.col("score_error").alias("message"),
    )
    candidates = scored.filter(F.col("is_new") & (F.col("final") >= cfg.threshold))
    # The slot is spent on admission, with or without notifiers.
    admitted = quota_admission(candidates, now, order, cfg.daily_quota, outbox_used)
    events = admitted.select(
        F.col(KEY).alias("listing_id"), "day", "final", "url", now.cast("timestamp").alias("sent_at"),
        F.array().cast("ARRAY<STRING>").alias("also_seen_on"),
    )
    outbox = notification_outbox(events, () if cfg.dry_run else cfg.notifiers)
    return Outcomes(scores, failures, admitted, outbox)


def run_scan(
    raw: DataFrame,
    order: Sequence[str],
    cfg: ScanConfig,
    now: Column,
    stored: DataFrame | None = None,
    outbox_used: DataFrame | None = None,
    priorities: DataFrame | None = None,
    rejected: Sequence[DataFrame] = (),
) -> ScanResult:
    """Fold arrivals into the listings and decide what to notify.

    Every changed version passes the gate, the rules and the score in turn; a new key's first version alone can be
    notified. ``outbox_used(day, used)`` counts the slots a day has spent. The failures are those of readers (``rejected``, as `failure_log`
    gives them), of enrichers and of scoring; none of them stops the rest.
    """
    if cfg.sources is not None:
        raw = raw.filter(F.col("plugin").isin(list(cfg.sources)))
    arrivals = stamp(raw, now, priorities)
    hot = arrival_heat(arrivals, order)
    scored, commutes, troubles = score_versions(arrivals, order, cfg, now, stored, hot)
    done = decide(scored, order, cfg, now, outbox_used)
    failures = done.failures
    if troubles is not None:
        failures = failures.unionByName(troubles.withColumn("occurred_at", now.cast("timestamp")))
    for part in rejected:
        failures = failures.unionByName(part)
    listings = merged_listings(arrivals, stored, order, now, hot)
    if commutes is not None:
        listings = with_commute(listings, commutes)
    return ScanResult(listings, done.scores, done.outbox, failures, done.admitted)


def with_commute(df: DataFrame, commutes: DataFrame) -> DataFrame:
    commute = F.coalesce("_commute", "enriched.commute")
    return (
        df.join(commutes, KEY, "left")
        .withColumn("enriched", F.col("enriched").withField("commute", commute))
        .drop("_commute")
    )


def merged_listings(
    arrivals: DataFrame, stored: DataFrame | None, order: Sequence[str], now: Column, hot: HotKeys | None = None
) -> DataFrame:
    """Listings after the scan with ``status``: new in this scan or known."""
    base = stored if stored is not None else arrivals.select(*[n for n, _ in LISTING_FIELDS]).filter(F.lit(False))
    # What of the listings is read is up to the caller.
    out = merge_upsert(base, arrivals, order, now, hot, whole=False)
    return out.withColumn("status", F.when(F.col("is_new"), "new").otherwise("known"))
