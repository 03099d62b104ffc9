"""The interned form of an export: a dictionary of strings, and nodes and properties by ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.operators.common import cut, lookup, with_places
from canopy.schema import FormatError

#: Levels of a tree beyond which parents must run in circles.
MOST_LEVELS = 100_000
#: Types beyond which their table isn't broadcast.
MOST_TYPES = 64


def dictionary(nodes: DataFrame, properties: DataFrame) -> DataFrame:
    """``value`` of every distinct string that the interned form refers to."""
    columns = [nodes.select(F.col(c).alias("value")) for c in ("name", "primary_type")] + [properties.select(F.col(c).alias("value")) for c in ("name", "value", "binary_reference")]
    out = columns[0]
    for c in columns[1:]:
        out = out.unionByName(c)
    return out.where(F.col("value").isNotNull()).distinct()


def with_ids(strings: DataFrame) -> DataFrame:
    """``id`` from 1 in the order of ``value``."""
    return with_places(strings.select("value"), [F.col("value")], "id").select("id", "value")


def expand(properties: DataFrame, strings: DataFrame, types: DataFrame, paths: DataFrame) -> DataFrame:
    """Interned property rows with their texts: ``path``, ``name``, ``property_type``, ``value`` and the rest.

    The types are fixed and few: more than MOST_TYPES raise FormatError.  Names, values and references are looked up
    safely against hot ids; a missing name or node drops the row, a missing value
    is null.
    """
    if types.limit(MOST_TYPES + 1).count() > MOST_TYPES:
        raise FormatError(f"more than {MOST_TYPES} types")
    p = properties.join(F.broadcast(types.select(F.col("id").alias("type_id"), F.col("name").alias("property_type"))), "type_id")
    spread = ["node_id", "position"]
    p = lookup(p, strings, "name_id", "id", "value", "name", spread, count_on=properties)
    p = lookup(p, strings, "value_id", "id", "value", "value", spread, count_on=properties)
    p = lookup(p, strings, "binary_reference_id", "id", "value", "binary_reference", spread, count_on=properties)
    p = lookup(p, paths, "node_id", "id", "path", "path", spread, count_on=properties)
    return p.where(F.col("name").isNotNull() & F.col("path").isNotNull())


def node_paths(nodes: DataFrame, strings: DataFrame) -> DataFrame:
    """``id`` and ``path`` of every node that the root reaches over ``parent_id``.

    Level by level from the root: each level is joined with the children of the
    one above.  Children's names are looked up once.  Parents in circles are
    never reached and raise FormatError with a level bound.
    """
    named = cut(lookup(nodes.select("id", "parent_id", "name_id"), strings, "name_id", "id", "value", "name", ["id"]))
    level = cut(named.where(F.col("parent_id").isNull()).select("id", F.lit("/").alias("path")))
    done = level
    for _ in range(MOST_LEVELS):
        up = level.select(F.col("id").alias("parent_id"), F.when(F.col("path") == "/", "").otherwise(F.col("path")).alias("above"))
        level = cut(named.join(up, "parent_id").select("id", F.concat("above", F.lit("/"), "name").alias("path")))
        if level.isEmpty():
            return done
        done = done.unionByName(level)
    raise FormatError("the tree is deeper than any real one")


NODE_PATHS_SQL = """
WITH RECURSIVE walk(id, path) MAX RECURSION LEVEL {levels} AS (
  SELECT id, '/' FROM {nodes} WHERE parent_id IS NULL
  UNION ALL
  SELECT n.id, concat(CASE WHEN w.path = '/' THEN '' ELSE w.path END, '/', s.value)
  FROM {nodes} n JOIN walk w ON n.parent_id = w.id JOIN {strings} s ON s.id = n.name_id)
SELECT id, path FROM walk"""
