"""Plans: no products of rows, filters and columns that reach the scan."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from canopy.functions import paths
from canopy.operators import tree

SMALL = Path(entry.SMALL)
pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="no test tables here")
#: Queries that checkpoint on the way: making them runs them.
EAGER = {"node_paths", "properties_expanded", "subtree_hashes", "interned_ids", "segment_closure", "reclaim_invariant", "document_order", "utf16_order", "recovery_order", "refresh_merge_nodes", "refresh_merge_properties"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n not in EAGER and not n.startswith(("p3", "p6", "p7", "p8"))))
def test_no_products(spark, name):
    text = plan(entry.queries()[name](spark, str(SMALL)))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text  # no row-at-a-time functions


def test_pushdown(spark):
    nodes = spark.read.parquet(str(SMALL / "node_rows.parquet"))
    text = plan(tree.subtree(nodes, "/content/sites", 2).select("path", "depth"))
    assert "StringStartsWith(path,/content/sites/)" in text and re.search(r"ReadSchema: struct<path:string,depth:int>", text)
    text = plan(nodes.where(paths.within(F.col("path"), "/a")).select("path"))
    assert re.search(r"ReadSchema: struct<path:string>", text)


def test_join_of_aggregates(spark):
    """Problem 5: each side is aggregated ahead of the join, and the join is there."""
    text = entry.queries()["p5_found"](spark, str(SMALL))._jdf.queryExecution().optimizedPlan().toString()
    joins = re.findall(r"Join LeftOuter, .*\n((?:.*\n?)*)", text)
    assert text.count("Join LeftOuter") == 2 and joins
    for key in ("parent_id", "name_id"):
        assert re.search(rf"Aggregate \[{key}#\d+L\], \[{key}#\d+L AS key#\d+L, count\(1\)", text)
    assert len(re.findall(r"Aggregate \[id#\d+L\], \[id#\d+L AS __right_key#\d+L, count\(1\)", text)) == 2
    schemas = set(re.findall(r"ReadSchema: (\S+)", plan(entry.queries()["p5_found"](spark, str(SMALL)))))
    assert schemas <= {"struct<parent_id:bigint>", "struct<id:bigint>", "struct<name_id:bigint>", "struct<>"}
