"""Source priority lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Trust per source plugin, 0-100; anything else gets the default.
SOURCE_PRIORITY = {
    "agency": 100,
    "source-flatfox": 80,
    "source-homegate": 70,
    "source-immoscout24": 70,
    "source-immobilier-ch": 70,
    "source-schemaorg": 70,
    "source-realadvisor": 50,
    "source-engelvoelkers": 30,
    "source-housinganywhere": 30,
}
DEFAULT_PRIORITY = 50


def source_priority(plugin: Column, configured: Column | None = None) -> Column:
    """Configured priority, else the plugin's default, else 50."""
    table = F.create_map(*[x for k, v in SOURCE_PRIORITY.items() for x in (F.lit(k), F.lit(v))])
    own = [configured.cast("int")] if configured is not None else []
    return F.coalesce(*own, F.try_element_at(table, plugin), F.lit(DEFAULT_PRIORITY))


def with_priority(rows: DataFrame, configured: DataFrame | None = None) -> DataFrame:
    """Add ``source_priority``. ``configured(plugin, priority)`` holds one row per configured plugin."""
    if configured is None:
        return rows.withColumn("source_priority", source_priority(F.col("plugin")))
    wanted = configured.select("plugin", F.col("priority").alias("_configured"))
    joined = rows.join(wanted, "plugin", "left")
    return joined.withColumn(
        "source_priority", source_priority(F.col("plugin"), F.col("_configured"))
    ).drop("_configured")
