"""Search for nodes over all versions: by property, child and value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.functions import values
from canopy.schema import QueryError


def parse_predicate(text: str) -> tuple[str, str]:
    """``NAME=VALUE``, parted at the first ``=``."""
    name, equals, value = text.partition("=")
    if not equals or not name:
        raise QueryError(f"not NAME=VALUE: {text!r}")
    return name, value


def search(
    nodes: DataFrame,
    properties: DataFrame,
    has_property: Sequence[str] = (),
    has_child: Sequence[str] = (),
    values_equal: Sequence[tuple[str, str]] = (),
    key: Sequence[str] = ("path",),
    limit: int = 10_000,
) -> DataFrame:
    """The ``key`` of each node that has all properties, all children and all values.

    A value counts if any value of the property has that text; binaries never
    do.  ``key`` names the columns that make a node, such as a revision and a
    path; children are looked up within the other key columns.  At most
    ``limit`` in the order of the key (0: all).  No condition is an error.
    All conditions on properties are tested in one pass over the properties,
    combined before the shuffle.
    """
    if not has_property and not has_child and not values_equal:
        raise QueryError("a search needs a condition")
    key = list(key)
    found = nodes.select(*key)
    text = values.canonical_text(F.col("value"), F.col("long_value"), F.col("double_value"), F.col("boolean_value"))
    tests = [F.col("name") == n for n in has_property] + [(F.col("name") == n) & (text == v) for n, v in values_equal]
    if tests:
        names = sorted({*has_property, *(n for n, _ in values_equal)})
        held = properties.where(F.col("name").isin(names)).groupBy(*key).agg(*(F.max(F.coalesce(t, F.lit(False))).alias(f"__t{k}") for k, t in enumerate(tests)))
        for k in range(len(tests)):
            held = held.where(F.col(f"__t{k}"))
        found = found.join(held.select(*key), key, "left_semi")
    if has_child:
        others = [k for k in key if k != "path"]
        names = sorted(set(has_child))
        parents = nodes.where(F.col("name").isin(names) & F.col("parent_path").isNotNull()).groupBy(*others, F.col("parent_path").alias("path"))
        held = parents.agg(*(F.max(F.col("name") == n).alias(f"__c{k}") for k, n in enumerate(names)))
        for k in range(len(names)):
            held = held.where(F.col(f"__c{k}"))
        found = found.join(held.select(*key), key, "left_semi")
    return found.orderBy(*key).limit(limit) if limit else found
