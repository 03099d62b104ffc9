"""The text queries on the smallest tables: those with SQL agree with it."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from canopy.llm import queries

SMALL = Path(entry.SMALL)
pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, str(SMALL))
    rows = df.collect()
    assert name in entry.queries()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "BatchEvalPython" not in plan
    if name in queries.SQL:
        duckdb = pytest.importorskip("duckdb")
        c = duckdb.connect()
        for f in SMALL.glob("*.parquet"):
            c.sql(f"create view {f.stem} as select * from '{f}'")
        found = c.sql(queries.SQL[name])
        order = [found.columns.index(x) for x in df.columns]
        assert sorted(map(repr, (tuple(r) for r in rows))) == sorted(repr(tuple(r[k] for k in order)) for r in found.fetchall())
    if name == "p6_round_trip":
        assert all(r.same for r in rows)
