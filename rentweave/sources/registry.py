"""Agency registry: defaults, validation and expansion to source settings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentweave.operators.search import Region

# Swiss cantons and site platforms.
CANTONS = "ZH BE LU UR SZ OW NW GL ZG FR SO BS BL SH AR AI SG GR AG TG TI VD VS NE GE JU".split()
PLATFORMS = ["immomig", "casasoft", "schemaorg", "custom"]
# Platform -> adapter that reads it.
ADAPTERS = {"schemaorg": "source-schemaorg", "casasoft": "source-schemaorg"}
REGISTRY_DDL = (
    "id STRING, name STRING, website STRING, canton STRING, platform STRING, feed_url STRING, "
    "detail_url_template STRING, rate_limit_per_min INT, priority INT, enabled BOOLEAN, notes STRING"
)
FIELDS = [part.strip().split(" ")[0] for part in REGISTRY_DDL.split(",")]


def load_registry(rows: DataFrame) -> DataFrame:
    """Defaults filled in and ``violations`` listed; a valid row has none."""
    have = set(rows.columns)
    typed = rows.select(
        *[
            (F.col(n) if n in have else F.lit(None)).cast(t).alias(n)
            for n, t in (p.strip().split(" ") for p in REGISTRY_DDL.split(","))
        ]
    )
    filled = typed.withColumns(
        {
            "rate_limit_per_min": F.coalesce("rate_limit_per_min", F.lit(6)),
            "priority": F.coalesce("priority", F.lit(100)),
            "enabled": F.coalesce("enabled", F.lit(True)),
        }
    )
    is_url = lambda c: F.coalesce(F.col(c).rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:(//)?[^\s/]"), F.lit(False))
    bad = lambda cond: ~F.coalesce(cond, F.lit(False))
    checks = [
        ("id must be kebab-case", bad(F.col("id").rlike(r"^[a-z0-9-]+\z"))),
        ("name is empty", bad(F.length("name") > 0)),
        ("website is not a URL", ~is_url("website")),
        ("unknown canton", bad(F.col("canton").isin(CANTONS))),
        ("unknown platform", bad(F.col("platform").isin(PLATFORMS))),
        ("feed_url is not a URL", F.col("feed_url").isNotNull() & ~is_url("feed_url")),
        ("rate_limit_per_min must be positive", F.col("rate_limit_per_min") <= 0),
        ("priority must be 0-100", ~F.col("priority").between(0, 100)),
    ]
    violations = F.array_compact(F.array(*[F.when(test, F.lit(text)) for text, test in checks]))
    return filled.withColumn("violations", violations)


def validate_registry(rows: DataFrame) -> DataFrame:
    return load_registry(rows).filter(F.size("violations") > 0).select("id", "violations")


def expand_registry(
    registry: DataFrame, region: Region | None = None, adapters: frozenset[str] = frozenset({"source-schemaorg"})
) -> tuple[DataFrame, DataFrame]:
    """Enabled agencies with their adapter and settings, and the skipped ones with a reason."""
    table = F.create_map(*[x for k, v in ADAPTERS.items() for x in (F.lit(k), F.lit(v))])
    judged = registry.filter("enabled").withColumn("adapter", F.try_element_at(table, F.col("platform")))
    judged = judged.withColumn(
        "reason",
        F.when(
            F.col("adapter").isNull(), F.concat(F.lit('platform "'), "platform", F.lit('" has no bundled adapter'))
        ).when(
            ~F.col("adapter").isin(list(adapters)),
            F.concat(F.lit('bundled adapter "'), "adapter", F.lit('" not installed')),
        ),
    )
    settings = judged.filter("reason IS NULL").select(
        F.concat(F.lit("agency:"), "platform", F.lit(":"), "id").alias("name"),
        F.col("adapter").alias("plugin"),
        F.col("id").alias("agency_id"),
        "website",
        "canton",
        "priority",
        "rate_limit_per_min",
        F.nullif("feed_url", F.lit("")).alias("feed_url"),
        F.nullif("detail_url_template", F.lit("")).alias("detail_url_template"),
    )
    if region:
        lists = [("postal_codes", region.postal_codes), ("cities", region.cities), ("cantons", region.cantons)]
        settings = settings.withColumn(
            "region_filter",
            F.struct(*[F.array(*[F.lit(v) for v in vs]).cast("ARRAY<STRING>").alias(n) for n, vs in lists]),
        )
    return settings, judged.filter("reason IS NOT NULL").select("id", "platform", "reason")


def union_registries(user: DataFrame, discovered: DataFrame) -> DataFrame:
    """User rows win over discovered rows with the same id."""
    return user.unionByName(discovered.join(user.select("id"), "id", "left_anti"), allowMissingColumns=True)


def write_discovered(existing: DataFrame, found: DataFrame) -> DataFrame:
    """Existing rows untouched, then new rows on platforms an adapter can or will read."""
    usable = found.filter(F.col("platform").isin("schemaorg", "casasoft", "immomig"))
    fresh = usable.join(existing.select("id"), "id", "left_anti")
    return existing.withColumn("is_added", F.lit(False)).unionByName(
        fresh.withColumn("is_added", F.lit(True)), allowMissingColumns=True
    )
