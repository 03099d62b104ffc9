"""Typed differences between two revisions of a tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.functions import paths
from canopy.operators.common import cut, row_digest
from canopy.operators.tree import group_values
from canopy.schema import VALUE_COLUMNS


def node_changes(before: DataFrame, after: DataFrame, topmost: bool = True) -> DataFrame:
    """``path`` and ``change`` (``added`` or ``removed``); only the root of what was added or removed with ``topmost``."""
    a = before.select("path", "parent_path", F.lit(True).alias("__old"))
    b = after.select("path", F.col("parent_path").alias("__parent"), F.lit(True).alias("__new"))
    changed = (
        a.join(b, "path", "full_outer")
        .where(F.col("__old").isNull() | F.col("__new").isNull())
        .select("path", F.coalesce("parent_path", "__parent").alias("parent_path"), F.when(F.col("__old").isNull(), "added").otherwise("removed").alias("change"))
    )
    if topmost:
        changed = changed.join(changed.select(F.col("path").alias("parent_path"), "change"), ["parent_path", "change"], "left_anti")
    return changed.select("path", "change")


def changed_rows(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The property rows of both sides without properties whose rows are the same, by digest, on both.

    A prune ahead of the comparison: what is equal is dropped by one narrow
    aggregation over both sides, before any values are collected.
    """
    columns = ["property_type", "multiple", "position", *VALUE_COLUMNS, *(c for c in before.columns if c == "binary_sha256")]
    sign = F.col("double_value").cast("string").alias("double_value")

    def digests(df: DataFrame, side: int) -> DataFrame:
        plain = df.select("path", "name", *(sign if c == "double_value" else F.col(c) for c in columns))
        return plain.select("path", "name", F.lit(side).alias("side"), row_digest(columns, 11).alias("a"), row_digest(columns, 12).alias("b"))

    both = digests(before, 1).unionByName(digests(after, 2)).groupBy("path", "name")
    per = lambda k, side: F.bit_xor(F.when(F.col("side") == side, F.col(k)))
    count = lambda side: F.sum((F.col("side") == side).cast("int"))
    same = (count(1) == count(2)) & per("a", 1).eqNullSafe(per("a", 2)) & per("b", 1).eqNullSafe(per("b", 2))
    open_keys = both.agg(same.alias("same")).where(~F.col("same")).select("path", "name")
    return before.join(open_keys, ["path", "name"], "left_semi"), after.join(open_keys, ["path", "name"], "left_semi")


def property_changes(before: DataFrame, after: DataFrame, before_nodes: DataFrame | None = None, after_nodes: DataFrame | None = None) -> DataFrame:
    """``path``, ``name``, ``change`` (``added``, ``removed`` or ``changed``), the types and the value lists of both sides.

    A property that is single, one that is multiple with one value, and one of
    another type differ; empty multiple properties of different types differ.
    Doubles compare as texts: zeros differ by sign and NaN equals NaN.  Inline
    binaries compare by ``binary_sha256`` if both sides have that column, else
    only by their length.  With the nodes given, only properties of nodes on both
    sides count.
    """
    if "binary_sha256" not in before.columns or "binary_sha256" not in after.columns:
        before, after = before.drop("binary_sha256"), after.drop("binary_sha256")
    old_rows, new_rows = changed_rows(before, after)
    a = group_values(old_rows).select("path", "name", F.struct("property_type", "multiple", "identities").alias("old"), F.col("texts").alias("old_texts"))
    b = group_values(new_rows).select("path", "name", F.struct("property_type", "multiple", "identities").alias("new"), F.col("texts").alias("new_texts"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    out = a.join(b, ["path", "name"], "full_outer").withColumn("change", change).where(F.col("change").isNotNull())
    for nodes in (before_nodes, after_nodes):
        if nodes is not None:
            out = out.join(nodes.select("path"), "path", "left_semi")
    return out.select(
        "path", "name", "change", F.col("old.property_type").alias("old_type"), F.col("new.property_type").alias("new_type"), F.col("old.multiple").alias("old_multiple"), F.col("new.multiple").alias("new_multiple"),
        F.col("old.identities").alias("old_values"), F.col("new.identities").alias("new_values"), "old_texts", "new_texts",
    )


def rendered(nodes: DataFrame, properties: DataFrame) -> DataFrame:
    """``line`` of each difference, with ``path`` and ``name`` to order by; types show where they changed."""
    node_lines = nodes.select("path", F.lit("").alias("name"), F.concat(F.when(F.col("change") == "added", "+ ").otherwise("- "), "path").alias("line"))
    where = F.concat(F.when(F.col("path") == "/", "").otherwise(F.col("path")), F.lit("/"), F.col("name"))
    shown = lambda v: F.array_join(v, ", ", "")
    typed = lambda t, v: F.concat(F.when(F.col("old_type") != F.col("new_type"), F.concat(t, F.lit(" "))).otherwise(""), shown(v))
    line = (
        F.when(F.col("change") == "added", F.concat(F.lit("  + "), where, F.lit(" = "), shown(F.col("new_texts"))))
        .when(F.col("change") == "removed", F.concat(F.lit("  - "), where, F.lit(" = "), shown(F.col("old_texts"))))
        .otherwise(F.concat(F.lit("  ^ "), where, F.lit("\n    - "), typed(F.col("old_type"), F.col("old_texts")), F.lit("\n    + "), typed(F.col("new_type"), F.col("new_texts"))))
    )
    return node_lines.unionByName(properties.select("path", "name", line.alias("line")))


def dirty_ranges(nodes: DataFrame, properties: DataFrame, root: str, depth_limit: int | None = None) -> DataFrame:
    """``path``, ``subtree``, ``reexport`` and ``depth``: what a published export has to replace.

    An added or removed node dirties its subtree; a removed one is only cut out,
    others are exported again, a changed property its node alone.  Ranges that
    start deeper than the export goes are left out.  Ranges of one path fold
    into one: subtree beats node, exporting beats cutting out.
    """
    root = paths.normalize_text(root)
    offset = len([s for s in root.split("/") if s])
    ranges = nodes.select("path", F.lit(True).alias("subtree"), (F.col("change") == "added").alias("reexport"), F.lit(None).cast("int").alias("own_depth"))
    ranges = ranges.unionByName(properties.select("path", F.lit(False).alias("subtree"), F.lit(True).alias("reexport"), F.lit(0).alias("own_depth")).distinct())
    ranges = ranges.where(paths.within(F.col("path"), root)).withColumn("below", paths.depth(F.col("path")) - offset)
    if depth_limit is not None:
        ranges = ranges.where(F.col("below") <= depth_limit).withColumn("own_depth", F.coalesce("own_depth", F.lit(depth_limit) - F.col("below")))
    depth = F.when(F.bool_or(F.col("own_depth").isNull() & F.col("reexport")), F.lit(None)).otherwise(F.max(F.when(F.col("reexport"), F.col("own_depth"))))
    return ranges.groupBy("path").agg(F.bool_or("subtree").alias("subtree"), F.bool_or("reexport").alias("reexport"), depth.alias("depth"))


def dirty_paths(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows in a range: their path is one of its paths, or one of its subtrees holds it.

    Every row meets the ranges through its ancestors, by equality, never by prefix.
    """
    up = rows.select("path").distinct().select("path", F.explode(paths.self_and_ancestors(F.col("path"))).alias("__up"))
    hit = up.join(ranges.select(F.col("path").alias("__up"), "subtree"), "__up").where(F.col("subtree") | (F.col("path") == F.col("__up"))).select("path").distinct()
    return rows.join(hit, "path", "left_semi")


def refresh(published: DataFrame, current: DataFrame, ranges: DataFrame) -> DataFrame:
    """The published rows outside the ranges together with the current rows inside them.

    The ranges are worked out once and kept as a checkpoint: both sides meet them.
    """
    ranges = cut(ranges)
    stale = dirty_paths(published, ranges).select("path").distinct()
    return published.join(stale, "path", "left_anti").unionByName(dirty_paths(current, ranges))
