"""Changes between snapshots against a comparison of dictionaries."""

import datetime as dt
import random

from canopy.operators.snapshots import snapshot_changes

SCHEMA = "snapshot_id int, path string, name string, position int, value string, number double, delivered_at timestamp, rank int, chunk string"
DAY = dt.datetime(2025, 1, 1)


def brute(rows, ids):
    state = {s: {} for s in ids}
    best = {}
    for s, path, name, position, value, number, at, *_ in rows:
        k = (s, path, name, position)
        if k not in best or at > best[k][0]:
            best[k] = (at, (value, repr(number) if number is not None else None))
    for (s, *key), (_, content) in best.items():
        if s in state:
            state[s][tuple(key)] = content
    out = []
    for a, b in zip(ids, ids[1:], strict=False):
        for k in state[a].keys() | state[b].keys():
            old, new = state[a].get(k), state[b].get(k)
            if old != new:
                out.append((b, *k, "added" if old is None else "removed" if new is None else "changed"))
    return sorted(out, key=repr)


def run(spark, rows, ids):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = snapshot_changes(df, spark.createDataFrame([(i,) for i in ids], "snapshot_id int"), ["path", "name", "position"], ["value", "number"], "delivered_at")
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_random(spark):
    rnd = random.Random(5)
    ids, rows = [3, 7, 8, 20], []
    for s in ids:
        for k in range(700):
            if rnd.random() < 0.97:
                value = rnd.choice(["a", None, "", "é", "é"]) if rnd.random() < 0.02 else f"v{k}"
                number = rnd.choice([None, float("nan"), 1.5, float("inf")]) if rnd.random() < 0.02 else float(k)
                row = (s, f"/n{k}", None if k % 50 == 0 else "p", None if k % 9 == 0 else k % 4, value, number, DAY + dt.timedelta(hours=rnd.random()), k, "x")
                rows.append(row)
                if rnd.random() < 0.1:
                    rows.append(row)
                if rnd.random() < 0.1:
                    rows.append((*row[:4], "older", 0.0, DAY - dt.timedelta(days=1), 0, None))
    rows.append((99, "/other", "p", 0, "not listed", None, DAY, 0, None))
    got = run(spark, rows, ids)
    assert got == brute(rows, ids)
    assert len(got) > 50


def test_edges(spark):
    row = (1, "/a", "p", 0, "x", None, DAY, 0, None)
    assert run(spark, [], [1, 2]) == []
    assert run(spark, [row], []) == []
    assert run(spark, [row], [1]) == []
    assert run(spark, [row], [1, 2]) == [(2, "/a", "p", 0, "removed")]
    assert run(spark, [row, row], [0, 1]) == [(1, "/a", "p", 0, "added")]
    nulls = [(s, None, None, None, None, v, DAY, None, None) for s, v in ((1, float("nan")), (2, float("nan")), (3, None))]
    assert run(spark, nulls, [1, 2, 3]) == [(3, None, None, None, "changed")]
    shifted = [(1, "/a", "p", 0, None, 1.0, DAY, 0, None), (2, "/a", "p", 0, "1.0", None, DAY, 0, None)]
    assert run(spark, shifted, [1, 2]) == [(2, "/a", "p", 0, "changed")]
    long = [(s, "/" + "x" * 100_000, "p", 0, "y" * (100_000 + s), None, DAY, 0, None) for s in (1, 2)]
    assert [r[-1] for r in run(spark, long, [1, 2])] == ["changed"]


def test_hot_keys_and_small_batches(spark):
    """A key that is delivered again and again, in batches of a few rows."""
    rnd = random.Random(6)
    ids = [1, 2, 5]
    rows = [(s, f"/n{k}", "p", 0, f"v{k if rnd.random() < 0.9 else s}", None, DAY, 0, None) for s in ids for k in range(200)]
    for s in ids:
        rows += [(s, "/hot", None, None, f"h{s}-{k}", None, DAY + dt.timedelta(minutes=k), 0, None) for k in range(300)]
        rows += [(s, "/same", "p", None, "same", float("nan"), DAY, 0, None)] * 200
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = run(spark, rows, ids)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(rows, ids)
    assert {r[0] for r in got if r[1] == "/hot"} == {2, 5} and not [r for r in got if r[1] == "/same"]


def test_one_shuffle(spark):
    df = spark.createDataFrame([(1, "/a", "p", 0, "x", None, DAY, 0, None)], SCHEMA)
    got = snapshot_changes(df, spark.createDataFrame([(1,), (2,)], "snapshot_id int"), ["path", "name", "position"], ["value", "number"], "delivered_at")
    text = got._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "rangepartitioning" not in text
