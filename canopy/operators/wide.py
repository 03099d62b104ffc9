"""Entity-attribute-value rows into one row per entity with typed columns.

The grid of entities and attributes is completed, values are joined to it from
the left, each entity's cells are collected as an array in the order of the
attributes, and every column is a fixed index of that array read as its type.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.operators.common import latest_rows, lookup

#: The attributes are columns of the result; more of them are refused.
MOST_ATTRIBUTES = 5_000

#: Fixed forms of the types' texts, blanks around them taken off.
FORMS = {
    "Long": r"\A[+-]?[0-9]+\z",
    "Double": r"\A(?:[+-]?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|NaN|-?Infinity)\z",
    "Decimal": r"\A[+-]?[0-9]+(?:\.[0-9]+)?\z",
    "Boolean": r"\A(?i:true|false)\z",
    "Date": r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3}(?:Z|[+-][0-9]{2}:[0-9]{2})\z",
}
VALUES = ("value_id", "long_value", "double_value", "boolean_value", "binary_length", "binary_reference_id")


@dataclass(frozen=True)
class Attribute:
    """A column of the wide table: its name, the attribute it is filled from and its type."""

    column: str
    name_id: int
    type_name: str


def read_attributes(wide_columns: DataFrame) -> list[Attribute]:
    """The attributes in the order of their ids; they shape the plan, so they are few and come to the driver."""
    rows = wide_columns.select("column_name", "name_id", "type_name").limit(MOST_ATTRIBUTES + 1).collect()
    if len(rows) > MOST_ATTRIBUTES:
        raise ValueError(f"more than {MOST_ATTRIBUTES} attributes")
    return [Attribute(r.column_name, r.name_id, r.type_name) for r in sorted(rows, key=lambda r: (r.name_id, r.column_name))]


def typed(text: Column, type_name: str) -> tuple[Column, Column]:
    """The text as its type (null if it isn't one), and whether it reads as one.

    A Date becomes the instant it names.  A Decimal of more than 28 digits
    before the point or 10 behind it reads, though its column then holds null
    or the rounded number.
    """
    bare = F.trim(text)
    if type_name not in FORMS:
        return text, text.isNotNull()
    shaped = F.when(bare.rlike(FORMS[type_name]), bare)
    if type_name == "Long":
        value = shaped.try_cast("bigint")
    elif type_name == "Double":
        value = shaped.try_cast("double")
    elif type_name == "Decimal":
        return shaped.try_cast("decimal(38,10)"), shaped.isNotNull()
    elif type_name == "Boolean":
        value = F.lower(shaped) == "true"
    else:
        # the date must exist; a zone of up to 18 hours is one, and -00:00 is UTC
        value = F.try_to_timestamp(F.regexp_replace(shaped, r"-00:00\z", "Z"), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSXXX"))
    return value, value.isNotNull()


def to_wide(entities: DataFrame, properties: DataFrame, strings: DataFrame, attributes: list[Attribute]) -> DataFrame:
    """``node_id``, one typed column per attribute, and ``unfilled``: name ids of cells that have rows but can't be filled.

    ``entities`` has the ids of all nodes in ``id``; nodes that only have
    properties get a row too.  Of several rows with the same (node_id, name_id,
    position) the one loaded last counts; equal rows count once.  A cell is
    filled by exactly one valid row that holds one value readable as the
    attribute's type; a marker of an empty multiple property, a row without a
    value (or whose string is missing) and a binary can't be read.  A cell
    without rows is null and not listed.  Null ids are left out.  Columns that
    aren't named here are ignored; a column of the wide table may be called
    anything but ``node_id`` and ``unfilled``.
    """
    ids = sorted({a.name_id for a in attributes})
    wanted = properties.where(F.col("name_id").isin(ids) & F.col("node_id").isNotNull())
    valid = latest_rows(wanted, ["node_id", "name_id", "position"], "loaded_at", VALUES)
    held = sum((F.col(v).isNotNull().cast("int") for v in VALUES), F.lit(0))
    readable = (F.col("position") >= 0) & (held == 1) & F.col("binary_length").isNull() & F.col("binary_reference_id").isNull()
    with_text = lookup(valid, strings, "value_id", "id", "value", "string", ["node_id", "name_id", "position"], count_on=wanted)
    plain = F.coalesce("string", F.col("long_value").cast("string"), F.col("double_value").cast("string"), F.when(F.col("boolean_value") != 0, "true").when(F.col("boolean_value") == 0, "false"))
    cells = with_text.groupBy("node_id", "name_id").agg(F.count(F.lit(1)).alias("rows"), F.max(F.when(readable, plain)).alias("text"))
    cells = cells.select("node_id", "name_id", F.struct(F.lit(True).alias("there"), F.when(F.col("rows") == 1, F.col("text")).alias("text")).alias("cell"))

    nodes = entities.select(F.col("id").alias("node_id")).where(F.col("id").isNotNull()).union(wanted.select("node_id")).distinct()
    grid = nodes.select("node_id", F.explode(F.array(*(F.lit(i).cast("bigint") for i in ids))).alias("name_id"))
    filled = grid.join(cells, ["node_id", "name_id"], "left")
    rows = filled.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("name_id", "cell"))).alias("cells"))
    columns, unfilled = [], []
    for a in attributes:
        cell = F.col("cells")[ids.index(a.name_id)]["cell"]
        value, reads = typed(cell["text"], a.type_name)
        columns.append(value.alias(a.column))
        unfilled.append(F.when(cell["there"] & ~F.coalesce(reads, F.lit(False)), F.lit(a.name_id).cast("bigint")))
    return rows.select("node_id", *columns, F.array_distinct(F.array_compact(F.array(*unfilled))).alias("unfilled"))
