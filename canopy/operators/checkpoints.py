"""Checkpoints: named snapshots with an expiry, and the references to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.functions import values


def read_checkpoints(properties: DataFrame, under: str = "/checkpoints") -> DataFrame:
    """``name``, ``created_ms`` and ``expires_ms`` of the nodes right below ``under``; null unless a single Long."""
    at = properties.where(F.col("path").startswith(under + "/") & ~F.substring(F.col("path"), len(under) + 2, 1 << 30).contains("/"))
    single = F.when((F.col("property_type") == "Long") & ~F.col("multiple"), F.col("long_value"))
    pick = lambda n: F.max(F.when(F.col("name") == n, single))
    return at.groupBy(F.substring(F.col("path"), len(under) + 2, 1 << 30).alias("name")).agg(pick("created").alias("created_ms"), pick("timestamp").alias("expires_ms"))


def expired(now: int, missing_counts: bool = False) -> Column:
    """Strictly after its expiry; one without expiry is kept, or counts as expired when room is made for a new one."""
    return F.coalesce(F.lit(now) > F.col("expires_ms"), F.lit(missing_counts))


def expiry(created: Column, lifetime: Column) -> Column:
    return values.saturating_sum(created, lifetime)


def unreferenced(checkpoints: DataFrame, references: DataFrame) -> DataFrame:
    """Checkpoints whose name no ``value`` of the references is."""
    return checkpoints.join(references.select(F.col("value").alias("name")).distinct(), "name", "left_anti")


def dangling(references: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """``value`` of references that look like a checkpoint's name but name none.

    References have ``name`` and ``value``; those whose name ends with ``-temp`` are
    history and don't count.
    """
    shaped = references.where(~F.col("name").endswith("-temp") & F.col("value").rlike(values.IDENTIFIER)).select("value").distinct()
    return shaped.join(checkpoints.select(F.col("name").alias("value")), "value", "left_anti")
