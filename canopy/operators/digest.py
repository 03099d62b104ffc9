"""A canonical text of a tree, and the comparison of two.

Each node is a line: its path, then its properties by name, each with a tab in
front, as ``name=Type:value`` or ``name=Type[]:value<US>value``, escaped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.functions import paths, values
from canopy.operators.common import cut
from canopy.schema import VALUE_COLUMNS


def digest_lines(nodes: DataFrame, properties: DataFrame, without: Sequence[str] = ()) -> DataFrame:
    """``path`` and ``line`` of every node outside the subtrees ``without``.

    Lines are ordered by path on output, names in the order of their UTF-8 bytes.
    A binary shows its length, the number of bytes read and their CRC-32, or the
    id of the store that holds it.  Without the columns ``binary_octets`` and
    ``binary_crc32`` (a table that only states lengths) it shows the length
    twice, and other bytes of the same length don't show.
    """
    for other in without:
        keep = ~paths.within(F.col("path"), paths.normalize_text(other))
        nodes, properties = nodes.where(keep), properties.where(keep)
    text = values.canonical_text(*(F.col(c) for c in VALUE_COLUMNS[:4]))
    length = F.col("binary_length").cast("string")
    read = F.concat(F.col("binary_octets").cast("string"), F.lit("@"), F.col("binary_crc32")) if "binary_crc32" in properties.columns else length
    shown = F.coalesce(values.escape_digest(text), F.concat(length, F.lit("/"), read), F.concat(F.lit("external:"), values.escape_digest(F.col("binary_reference"))))
    one = F.when(F.col("position").isNotNull(), F.struct("position", F.coalesce(shown, F.lit("")).alias("shown")))
    per_property = properties.groupBy("path", "name").agg(F.max("property_type").alias("t"), F.max("multiple").alias("m"), F.array_sort(F.collect_list(one)).alias("v"))
    rendered = F.concat(values.escape_digest(F.col("name")), F.lit("="), "t", F.when(F.col("m"), "[]").otherwise(""), F.lit(":"), F.array_join(F.col("v.shown"), "\x1f"))
    per_node = per_property.select("path", F.struct("name", rendered.alias("text")).alias("p")).groupBy("path").agg(F.array_sort(F.collect_list("p")).alias("p"))
    line = F.concat(values.escape_digest(F.col("path")), F.coalesce(F.concat(F.lit("\t"), F.array_join(F.col("p.text"), "\t")), F.lit("")))
    return nodes.select("path").join(per_node, "path", "left").select("path", line.alias("line"))


def digest_summary(nodes: DataFrame, properties: DataFrame) -> DataFrame:
    """Nodes, properties, binaries and their bytes, in one row."""
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    names = properties.groupBy("path", "name").agg(
        F.count(F.coalesce(F.col("binary_length").cast("string"), F.col("binary_reference"))).alias("b"), F.sum("binary_length").alias("y")
    )
    p = names.agg(F.count(F.lit(1)).alias("properties"), F.coalesce(F.sum("b"), F.lit(0)).alias("binaries"), F.coalesce(F.sum("y"), F.lit(0)).alias("binary_bytes"))
    return p.withColumn("nodes", F.lit(0).cast("bigint") + n.scalar()).select("nodes", "properties", "binaries", "binary_bytes")


def compare_digests(before: DataFrame, after: DataFrame) -> DataFrame:
    """``path`` and ``change`` of lines that only one side has, or that differ."""
    a, b = before.select("path", F.col("line").alias("old")), after.select("path", F.col("line").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).where(F.col("change").isNotNull())


def subtree_hashes(nodes: DataFrame, properties: DataFrame) -> DataFrame:
    """``path`` and ``subtree_hash``: equal exactly for subtrees of equal content.

    Content is a node's own line without its path and the names and hashes of its
    children, folded without regard to order (their names differ), so a node
    with very many children gathers nothing.  Levels are folded from the deepest
    up, one aggregation each; a level's result is a checkpoint, so that plans
    don't nest.
    """
    behind_path = F.when(F.locate("\t", F.col("line")) > 0, F.substring(F.col("line"), F.locate("\t", F.col("line")), F.length("line"))).otherwise("")
    own = digest_lines(nodes, properties).select("path", F.sha2(behind_path, 256).alias("own"))
    base = cut(nodes.select("path", "parent_path", "name", "depth").join(own, "path"))
    deepest = base.agg(F.max("depth"), F.min("depth")).first()
    if deepest[0] is None:
        return base.select("path", F.col("own").alias("subtree_hash"))
    done, below = None, None
    for level in range(deepest[0], deepest[1] - 1, -1):
        here = base.where(F.col("depth") == level)
        if below is not None:
            fold = lambda salt: F.bit_xor(F.xxhash64(F.lit(salt), "name", "subtree_hash")).cast("string")
            kids = below.groupBy(F.col("parent_path").alias("path")).agg(F.concat_ws(" ", F.count(F.lit(1)).cast("string"), fold(1), fold(2), fold(3)).alias("kids"))
            here = here.join(kids, "path", "left")
        else:
            here = here.withColumn("kids", F.lit(None).cast("string"))
        text = F.concat("own", F.lit("\1"), F.coalesce("kids", F.lit("")))
        below = cut(here.select("path", "parent_path", "name", F.sha2(text, 256).alias("subtree_hash")))
        done = below if done is None else done.unionByName(below)
    return done.select("path", "subtree_hash")
