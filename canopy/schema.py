"""Schemas of the content model, the types of property values, and validators that fail closed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ContentError(ValueError):
    """The base of what the library raises about content."""


class FormatError(ContentError):
    """Stored data don't have the form that they must have."""


class QueryError(ContentError):
    """A question that can't be asked."""


class BudgetError(ContentError):
    """A bound that the caller set was exceeded."""


def _schema(text: str) -> T.StructType:
    """Of `name type [not null]` parts; no session is needed, unlike for Spark's own parser."""
    kinds = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
    parts = [p.split() for p in text.split(",")]
    return T.StructType([T.StructField(name, kinds[kind], not rest) for name, kind, *rest in parts])


NODES = _schema("path string not null, parent_path string, name string not null, depth int not null, primary_type string")
PROPERTIES = _schema(
    "path string not null, name string not null, property_type string not null, multiple boolean not null, position int, value string, long_value bigint, double_value double, boolean_value boolean, binary_length bigint, binary_reference string"
)
VALUE_COLUMNS = ["value", "long_value", "double_value", "boolean_value", "binary_length", "binary_reference"]
#: What only a reader of the bytes knows of inline binaries; operators use these columns where they are.
CONTENT_COLUMNS = ["binary_octets", "binary_crc32", "binary_sha256"]
#: The types of properties with their tags.
PROPERTY_TYPES = {
    1: "String", 2: "Binary", 3: "Long", 4: "Double", 5: "Date", 6: "Boolean", 7: "Name", 8: "Path", 9: "Reference", 10: "WeakReference", 11: "URI", 12: "Decimal",
}


def require_schema(df: DataFrame, schema: T.StructType, what: str) -> DataFrame:
    """The columns of ``schema`` in its order; raises if one lacks, has another type or others are there."""
    have = {f.name: f.dataType for f in df.schema.fields}
    want = {f.name: f.dataType for f in schema.fields}
    if have != want:
        raise FormatError(f"{what}: has {sorted(have)}, needs {sorted(want)} with their types")
    return df.select(*want)


def violations(nodes: DataFrame, properties: DataFrame) -> DataFrame:
    """``path`` and ``problem`` of rows that a content tree can't have.

    Missing parents, wrong depths, names that aren't the path's end, nodes and
    property values that stand twice, properties of missing nodes, and rows whose
    filled columns don't suit their type.
    """
    from canopy.functions import paths

    p = F.col("path")
    shape = F.when(F.col("depth") != paths.depth(p), "depth").when(F.col("name") != paths.name(p), "name").when(~F.col("parent_path").eqNullSafe(paths.parent(p)), "parent path")
    node_shape = nodes.select("path", shape.alias("problem")).where(F.col("problem").isNotNull())
    parents = nodes.select(F.col("path").alias("parent_path"))
    orphans = nodes.where(F.col("parent_path").isNotNull()).join(parents, "parent_path", "left_anti").select("path", F.lit("missing parent").alias("problem"))
    twice = nodes.groupBy("path").count().where("count > 1").select("path", F.lit("repeated node").alias("problem"))
    strays = properties.join(nodes.select("path"), "path", "left_anti").select("path", F.lit("property of a missing node").alias("problem")).distinct()
    repeated = properties.groupBy("path", "name", "position").count().where("count > 1").select("path", F.lit("repeated value").alias("problem")).distinct()
    filled = sum((F.col(c).isNotNull().cast("int") for c in VALUE_COLUMNS), F.lit(0))
    unsuited = properties.where(filled != F.when(F.col("position").isNull(), 0).otherwise(1)).select("path", F.lit("unsuitable value").alias("problem")).distinct()
    return node_shape.unionByName(orphans).unionByName(twice).unionByName(strays).unionByName(repeated).unionByName(unsuited)
