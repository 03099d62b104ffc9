import random
from collections import Counter
from decimal import Decimal

from pyspark.sql import functions as F

from canopy.operators.common import latest_rows, lookup
from canopy.operators.eager import eager_join_aggregate, heavy_keys, roll_up
from canopy.plans.training import parent_load


def test_against_a_join(spark):
    rnd = random.Random(1)
    left = [(rnd.choice([None, 1, 1, 1, 1, 2, 3, 9]), rnd.randint(0, 9), 0) for _ in range(500)]
    right = [(rnd.choice([None, 1, 1, 2, 4]), rnd.randint(0, 9), 0) for _ in range(80)]
    a, b = spark.createDataFrame(left, "k int, x int, key int"), spark.createDataFrame(right, "k int, y int, key int")
    for how in ("inner", "left"):
        joined = a.withColumnRenamed("k", "lk").drop("key").join(b.drop("key"), F.col("lk") == F.col("k"), how).groupBy("lk").agg(F.count(F.lit(1)), F.sum("x"), F.sum("y"))
        want = {r[0]: tuple(r)[1:] for r in joined.collect()}
        got = {r.key: (r.joined_rows, r.xs, r.ys) for r in eager_join_aggregate(a, b, "k", "k", {"xs": F.col("x")}, {"ys": F.col("y")}, how).collect()}
        assert got == want
    assert eager_join_aggregate(a.limit(0), b, "k", "k").count() == 0
    assert eager_join_aggregate(a, b.limit(0), "k", "k").count() == 0


def test_heavy(spark):
    rows = [(1,)] * 4 + [(2,)] * 3 + [(None,)] * 50 + [(k,) for k in range(10, 53)]
    df = spark.createDataFrame(rows, "k int")
    per = eager_join_aggregate(df, df, "k", "k", how="left")
    assert [r.key for r in heavy_keys(per, df, Decimal("0.04")).collect()] == [1]
    assert {r.key: r.left_rows for r in per.collect()} == Counter(r[0] for r in rows)


def test_repeated_partners(spark):
    """Rows as delivered count, however many partners a key has."""
    rows = spark.createDataFrame([(1,)] * 4 + [(2,)] * 3 + [(k,) for k in range(10, 103)], "k int")
    partners = spark.createDataFrame([(2,)] * 5 + [(1,)], "k int")
    per = eager_join_aggregate(rows, partners, "k", "k", how="left")
    assert [r.key for r in heavy_keys(per, rows, Decimal("0.04")).collect()] == [1]
    few = spark.createDataFrame([(1,)] * 8 + [(k,) for k in range(10, 223)], "k int")  # 8 of 221 are less than 4 %
    assert heavy_keys(eager_join_aggregate(few, partners, "k", "k", how="left"), few, Decimal("0.04")).count() == 0
    assert heavy_keys(eager_join_aggregate(rows.limit(0), partners, "k", "k", how="left"), rows.limit(0), Decimal("0.04")).count() == 0


def test_large_numbers(spark):
    """Ids beyond 2**53 keep their last digit, sums and products beyond 2**63 their value."""
    big, bigger = 2**53 + 1, 2**62
    nodes = spark.createDataFrame([(1, big, 0), (2, big, 0), (3, bigger, 0), (bigger, None, 0), (1, big, 0)], "id bigint, parent_id bigint, key int")
    properties = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c"), (3, "d"), (3, "e"), (3, "f"), (None, "n")], "node_id bigint, parent_id string")
    got = {r.parent_id: (r["keys"], r.property_rows) for r in parent_load(nodes, properties).collect()}
    assert got == {big: (2, 4), bigger: (1, 4)}
    sums = eager_join_aggregate(nodes, properties, "id", "node_id", {"s": F.col("parent_id")}, left_by=["parent_id"]).where("parent_id = 4611686018427387904").first()
    assert sums.s == 4 * bigger and sums.joined_rows == 4
    rolled = roll_up(eager_join_aggregate(nodes, properties, "id", "node_id", how="left"), [], ["joined_rows"]).first()
    assert (rolled["keys"], rolled.joined_rows) == (4, 4 + 1 + 4 + 1)


def test_latest(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), ("b", None, "n"), (None, 3, None), ("c", 1, "p"), ("c", 1, "q")]
    df = spark.createDataFrame(rows, "k string, v int, x string")
    assert {tuple(r) for r in latest_rows(df, ["k"], "v", ["x"]).collect()} == {("a", "y"), ("b", "n"), (None, None), ("c", "q")}


def test_lookup_of_hot_and_null_keys(spark):
    left = spark.createDataFrame([(k, "hot" if k % 2 else None if k % 3 else f"s{k}") for k in range(8000)], "id int, k string")
    right = spark.createDataFrame([("hot", 1), ("s6", 2), ("unused", 3), (None, 4)], "key string, v int")
    got = {r.id: r.found for r in lookup(left, right, "k", "key", "v", "found", ["id"]).collect()}
    assert len(got) == 8000 and got[1] == 1 and got[6] == 2 and got[4] is None and got[12] is None
