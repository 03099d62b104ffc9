"""Version histories without a node, and what else rests on them.

Histories have ``history`` (a name that should be an identifier), ``path``,
``newest`` (seconds of their newest version, null unknown), ``bytes``, ``nodes``
and ``configuration``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.functions import paths, values


def live_identifiers(properties: DataFrame, storage: str) -> DataFrame:
    """``identifier`` of every node outside version storage with a single String ``jcr:uuid`` that is one."""
    own = properties.where((F.col("name") == "jcr:uuid") & (F.col("property_type") == "String") & ~F.col("multiple") & ~paths.within(F.col("path"), storage))
    return own.select(values.identifier(F.col("value")).alias("identifier")).where(F.col("identifier").isNotNull()).distinct()


def orphans(histories: DataFrame, live: DataFrame) -> DataFrame:
    """Histories whose identifier no live node has; malformed names aren't orphans."""
    known = histories.withColumn("identifier", values.identifier(F.col("history"))).where(F.col("identifier").isNotNull())
    return known.join(live, "identifier", "left_anti")


def history_facts(nodes: DataFrame, properties: DataFrame, storage: str, by: str | None = None) -> DataFrame:
    """Histories worked out from content: ``history``, ``path``, ``newest``, ``bytes``, ``nodes``, ``external_references`` and ``configuration``.

    A history is a node of type ``nt:versionHistory`` below ``storage``; a node belongs
    to the nearest one at or above it.  ``newest`` is the latest ``jcr:created`` of
    its versions, ``bytes`` what inline binaries hold, and ``configuration`` whether
    a frozen node was one.

    Rows are folded by path, and from there upwards: at each depth at which there are
    histories, the deepest first, what has none yet is folded by its ancestor there.
    Every fold is combined before a shuffle, so a history with a third of all nodes
    makes no heavy task.  ``by`` names a column of both tables that is the same for all
    that is below one history; tables that are partitioned by it aren't shuffled again.
    """
    kind = lambda name: F.col("primary_type") == name
    keys, inside = [by] if by else [], paths.below(F.col("path"), storage)
    depths = {r.depth for r in nodes.where(inside & kind("nt:versionHistory")).select(paths.depth(F.col("path")).alias("depth")).distinct().collect()}
    held = nodes.where(inside).select(*keys, "path", F.lit(True).alias("node"), kind("nt:versionHistory").alias("history"), kind("nt:version").alias("version"), (F.col("primary_type") > "nt:version").alias("other"))
    first = F.col("position") == 0
    created = F.when((F.col("name") == "jcr:created") & first, values.epoch_seconds(F.col("value")))
    frozen = (F.col("name") == "jcr:frozenPrimaryType") & first & (F.col("value") == "nt:configuration")
    # all other properties add nothing
    tells = ((F.col("name") == "jcr:created") & first) | frozen | F.col("binary_length").isNotNull() | F.col("binary_reference").isNotNull()
    facts = properties.where(inside & tells).select(*keys, "path", created.alias("created"), frozen.alias("configuration"), F.col("binary_length").alias("bytes"), F.col("binary_reference").isNotNull().cast("bigint").alias("external_references"))
    is_version = F.coalesce(F.max("version"), F.lit(False)) & ~F.coalesce(F.max("other"), F.lit(False))  # of several types the greatest
    per_node = held.unionByName(facts, allowMissingColumns=True).groupBy(*keys, "path").agg(
        F.max("node").alias("node"), F.coalesce(F.max("history"), F.lit(False)).alias("history"), F.when(is_version, F.max("created")).alias("newest"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("bytes"),
        F.lit(1).cast("bigint").alias("nodes"), F.coalesce(F.sum("external_references"), F.lit(0)).cast("bigint").alias("external_references"), F.coalesce(F.max("configuration"), F.lit(False)).alias("configuration"),
    ).where("node")
    owned = per_node.withColumn("path", paths.normalize(F.col("path")))
    for depth in sorted(depths, reverse=True):
        up = F.when(F.col("history"), F.col("path")).otherwise(F.substring_index("path", "/", depth + 1))
        owned = owned.withColumn("path", up).groupBy(*keys, "path").agg(
            F.max("history").alias("history"), F.max("newest").alias("newest"), F.sum("bytes").alias("bytes"), F.sum("nodes").alias("nodes"),
            F.sum("external_references").alias("external_references"), F.max("configuration").alias("configuration"),
        )
    return owned.where("history").select("path", paths.name(F.col("path")).alias("history"), "newest", "bytes", "nodes", "external_references", "configuration")


def record_bytes(data_bytes: Column, head_nodes: Column, nodes: Column) -> Column:
    """What so many nodes take of the head's data, in whole numbers; 0 without a head."""
    share = lambda c: F.floor(c * nodes.cast("decimal(19,0)") / head_nodes)
    whole = F.floor(data_bytes / head_nodes).cast("decimal(19,0)") * nodes.cast("decimal(19,0)")
    return F.when(head_nodes > 0, (whole + share((data_bytes % head_nodes).cast("decimal(19,0)"))).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def report(histories: DataFrame, live: DataFrame) -> DataFrame:
    """One row: histories, malformed names, orphans, their nodes and bytes, and those of configurations."""
    marked = histories.withColumn("identifier", values.identifier(F.col("history"))).join(live.withColumn("__live", F.lit(True)), "identifier", "left")
    orphan = F.col("identifier").isNotNull() & F.col("__live").isNull()
    total = lambda c: F.coalesce(F.sum(F.when(orphan, c)), F.lit(0)).cast("bigint")
    return marked.agg(
        F.count(F.lit(1)).alias("histories"), F.count_if(F.col("identifier").isNull()).alias("malformed"), F.count_if(orphan).alias("orphans"),
        total(F.col("nodes")).alias("orphan_nodes"), total(F.col("bytes")).alias("orphan_bytes"), F.count_if(orphan & F.col("configuration")).alias("orphan_configurations"),
    )


def inbound(references: DataFrame, internal: DataFrame) -> DataFrame:
    """``history`` of those that a reference from outside points into.

    ``references`` has ``value``; ``internal`` the ``identifier`` of each node of a
    history.  References are deduplicated before they are joined, so one that a
    third of all nodes hold is one row.
    """
    wanted = references.select(values.identifier(F.col("value")).alias("identifier")).where(F.col("identifier").isNotNull()).distinct()
    return internal.join(wanted, "identifier", "left_semi").select("history").distinct()


def purgeable(candidates: DataFrame, referenced: DataFrame, now: int, age: int) -> DataFrame:
    """Orphans that may go: no configuration, of known age of at least ``age``, and not referenced."""
    old = F.coalesce(F.lit(now) - F.col("newest") >= age, F.lit(False))
    return candidates.where(~F.col("configuration") & old).join(referenced.select("history"), "history", "left_anti")


def under_intermediates(histories: DataFrame, column: str = "histories") -> DataFrame:
    """``path`` of every proper ancestor and how many histories are below it."""
    up = histories.select(F.explode(paths.ancestors(F.col("path"))).alias("path"))
    return up.groupBy("path").agg(F.count(F.lit(1)).alias(column))


def empty_intermediates(histories: DataFrame, selected: DataFrame, storage: str) -> DataFrame:
    """``path`` of nodes below ``storage`` all of whose histories, of which there are some, are selected."""
    every, gone = under_intermediates(histories, "total"), under_intermediates(selected, "gone")
    return every.join(gone, "path").where((F.col("total") == F.col("gone")) & paths.below(F.col("path"), storage)).select("path")


def external_footprint(references: DataFrame, column: str = "binary_reference") -> DataFrame:
    """One row: distinct external binaries, the bytes that their ids state, and those whose ids state none."""
    ids = references.select(column).where(F.col(column).isNotNull()).distinct()
    length = values.blob_length(F.col(column))
    return ids.agg(F.count(F.lit(1)).alias("binaries"), F.coalesce(F.sum(length), F.lit(0)).cast("bigint").alias("measured_bytes"), F.count_if(length.isNull()).alias("unmeasured"))
