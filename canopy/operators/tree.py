"""Looking into a content tree: nodes by path, children, properties, subtrees, listings.

Null paths match nothing.  Paths given by the caller are normalized, so empty
segments in them don't count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.functions import paths, values
from canopy.schema import VALUE_COLUMNS

#: Names of the two properties that say what a node is.
PRIMARY_TYPE, MIXIN_TYPES = "jcr:primaryType", "jcr:mixinTypes"


def node_at(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.where(F.col("path") == paths.normalize_text(path))


def child(nodes: DataFrame, parent: str, name: str) -> DataFrame:
    return nodes.where((F.col("parent_path") == paths.normalize_text(parent)) & (F.col("name") == name))


def children(nodes: DataFrame, parent: str) -> DataFrame:
    return nodes.where(F.col("parent_path") == paths.normalize_text(parent))


def child_counts(nodes: DataFrame) -> DataFrame:
    """``path`` and ``children`` of every node, 0 for leaves.

    Children are counted on the map side first, so a parent of a third of all
    nodes makes no heavy task.
    """
    counts = nodes.where(F.col("parent_path").isNotNull()).groupBy(F.col("parent_path").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.select("path").join(counts, "path", "left").select("path", F.coalesce("n", F.lit(0)).alias("children"))


def properties_of(properties: DataFrame, path: str, stored_only: bool = False) -> DataFrame:
    """All properties of a node, or those that aren't part of its type."""
    found = properties.where(F.col("path") == paths.normalize_text(path))
    synthesized = ((F.col("name") == PRIMARY_TYPE) & (F.col("property_type") == "Name") & ~F.col("multiple")) | ((F.col("name") == MIXIN_TYPES) & (F.col("property_type") == "Name") & F.col("multiple"))
    return found.where(~synthesized) if stored_only else found


def property_named(properties: DataFrame, path: str, name: str) -> DataFrame:
    return properties.where((F.col("path") == paths.normalize_text(path)) & (F.col("name") == name))


def subtree(nodes: DataFrame, root: str, depth_limit: int | None = None, without: Sequence[str] = ()) -> DataFrame:
    """Nodes at or below ``root``, at most ``depth_limit`` levels below it, and not in the subtrees ``without``."""
    root = paths.normalize_text(root)
    keep: Column = paths.within(F.col("path"), root)
    if depth_limit is not None:
        keep = keep & (F.col("depth") <= len([s for s in root.split("/") if s]) + depth_limit)
    for other in without:
        keep = keep & ~paths.within(F.col("path"), paths.normalize_text(other))
    return nodes.where(keep)


def as_export(nodes: DataFrame, root: str) -> DataFrame:
    """A subtree as a tree of its own: depths count from its root, which has no parent."""
    root = paths.normalize_text(root)
    offset = len([s for s in root.split("/") if s])
    parent = F.when(F.col("path") != root, F.col("parent_path"))
    return subtree(nodes, root).withColumn("depth", F.col("depth") - offset).withColumn("parent_path", parent)


def guarded(nodes: DataFrame, most_children: int | None = None, most_name_bytes: int | None = None, most_nodes: int | None = None) -> DataFrame:
    """The nodes, unless a budget is exceeded: then BudgetError, with the first budget and the amount."""
    from canopy.schema import BudgetError

    if most_children is not None:
        most = nodes.groupBy("parent_path").count().agg(F.max("count")).first()[0] or 0
        if most > most_children:
            raise BudgetError(f"children of a node: {most}, allowed {most_children}")
    sums = nodes.agg(F.max(F.octet_length("name")), F.count(F.lit(1))).first()
    for what, have, allowed in (("bytes of a name", sums[0] or 0, most_name_bytes), ("nodes", sums[1], most_nodes)):
        if allowed is not None and have > allowed:
            raise BudgetError(f"{what}: {have}, allowed {allowed}")
    return nodes


def listing(nodes: DataFrame, root: str, depth_limit: int) -> DataFrame:
    """``line`` per node, indented by depth, in document order (``place``); names with their types."""
    root = paths.normalize_text(root)
    offset = len([s for s in root.split("/") if s])
    name = F.when(F.col("path") == "/", "/").otherwise(F.col("name"))
    line = F.concat(F.repeat(F.lit("  "), F.col("depth") - offset), name, F.coalesce(F.concat(F.lit(" ["), F.col("primary_type"), F.lit("]")), F.lit("")))
    found = subtree(nodes, root, depth_limit).select("path", line.alias("line"))
    return found.orderBy(paths.document_order(F.col("path")))


def derive_nodes(entities: DataFrame, path: str = "path", primary_type: str = "primary_type", keep: Sequence[str] = ()) -> DataFrame:
    """Node rows of entities that only have a path and a type; columns to ``keep`` go first."""
    p = paths.normalize(F.col(path))
    return entities.select(*keep, p.alias("path"), paths.parent(p).alias("parent_path"), paths.name(p).alias("name"), paths.depth(p).alias("depth"), F.col(primary_type).alias("primary_type"))


def explode_values(entities: DataFrame, name: str, property_type: str, values_column: str, multiple: bool, path: str = "path", keep: Sequence[str] = ()) -> DataFrame:
    """Property rows of one property of all entities; columns to ``keep`` go first.

    A single value has position 0; several have theirs; an empty list leaves a
    marker row without position and value; a null leaves none.  The value goes to
    the column of its type, binaries by their content's length.
    """
    rows = entities.where(F.col(values_column).isNotNull())
    if multiple:
        rows = rows.select(*keep, F.col(path).alias("path"), F.posexplode_outer(values_column).alias("position", "v"))
    else:
        rows = rows.select(*keep, F.col(path).alias("path"), F.lit(0).alias("position"), F.col(values_column).alias("v"))
    column = {"Long": "long_value", "Double": "double_value", "Boolean": "boolean_value", "Binary": "binary_length"}.get(property_type, "value")
    types = dict(zip(VALUE_COLUMNS, ("string", "bigint", "double", "boolean", "bigint", "string"), strict=True))
    v = F.octet_length("v").cast("bigint") if property_type == "Binary" else F.col("v")
    filled = [(v if c == column else F.lit(None)).cast(types[c]).alias(c) for c in VALUE_COLUMNS]
    return rows.select(*keep, "path", F.lit(name).alias("name"), F.lit(property_type).alias("property_type"), F.lit(multiple).alias("multiple"), "position", *filled)


def inventory(nodes: DataFrame) -> DataFrame:
    """``primary_type`` and ``nodes`` that have it."""
    return nodes.groupBy("primary_type").agg(F.count(F.lit(1)).alias("nodes"))


def group_values(properties: DataFrame) -> DataFrame:
    """One row per property: its type, whether it is multiple, and its values' identities and texts in order.

    The values of one property of one node are collected; a marker row gives an
    empty list.
    """
    identity = values.value_identity(*(F.col(c) for c in VALUE_COLUMNS), *(F.col(c) for c in properties.columns if c == "binary_sha256"))
    text = values.canonical_text(*(F.col(c) for c in VALUE_COLUMNS[:4]))
    one = F.when(F.col("position").isNotNull(), F.struct("position", identity.alias("identity"), text.alias("text")))
    grouped = properties.groupBy("path", "name").agg(F.max("property_type").alias("property_type"), F.max("multiple").alias("multiple"), F.array_sort(F.collect_list(one)).alias("v"))
    return grouped.select("path", "name", "property_type", "multiple", F.col("v.identity").alias("identities"), F.col("v.text").alias("texts"))
