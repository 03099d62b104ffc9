import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from canopy.llm.frequency import count_terms, mark_terms


def brute(rows, longest):
    n, records = Counter(), defaultdict(set)
    for field, terms, record, count in rows:
        terms = [t for t in terms or [] if t is not None]
        for i in range(len(terms)):
            for k in range(1, longest + 1):
                if i + k <= len(terms):
                    key = field, tuple(terms[i : i + k])
                    n[key] += count
                    records[key].add(record)
    return {k: (n[k], len(records[k])) for k in n}


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_random(spark, longest):
    rnd = random.Random(longest)
    words = ["a", "b", "", "é", "A", "a b", "x" * 3000]
    rows = []
    for _ in range(600):
        terms = None if rnd.random() < 0.02 else [None if rnd.random() < 0.05 else rnd.choice(words[: rnd.choice([1, 3, 7])]) for _ in range(rnd.randint(0, 6))]
        rows.append((rnd.choice(["f", "g", None]), terms, rnd.choice([None, "", *map(str, range(60))]), rnd.randint(1, 3)))
    df = spark.createDataFrame(rows, "field string, terms array<string>, record string, n_rows int").withColumn("share", F.lit("clash")).repartition(5)
    got = {(r.field, tuple(r.term)): (r.n_rows, r.n_records) for r in count_terms(df, longest=longest).collect()}
    assert got == brute(rows, longest)


def test_empty_and_marks(spark):
    df = spark.createDataFrame([], "field string, terms array<string>, record string, n_rows int")
    assert count_terms(df).count() == 0
    rows = [("f", ["all"], str(k), 1) for k in range(10)] + [("f", ["two"], str(k % 2), 1) for k in range(9)] + [("f", ["four"], str(k), 1) for k in range(4)]
    counts = count_terms(spark.createDataFrame(rows, df.schema))
    marks = {r.term[0]: r.mark for r in mark_terms(counts, spark.range(10), 3, 0.4).collect()}
    assert marks == {"all": "common", "two": "rare", "four": None}


def test_one_term_of_most_records_is_spread(spark):
    df = spark.range(20_000).select(F.lit("f").alias("field"), F.array(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 50))).alias("terms"), F.col("id").cast("string").alias("record"), F.lit(1).alias("n_rows"))
    got = {r.term[0]: (r.n_rows, r.n_records) for r in count_terms(df).collect()}
    assert got["hot"] == (6667, 6667) and len(got) == 51


def test_shares_by_records(spark, monkeypatch):
    """The same counts with many shares, which follow from the number of records alone."""
    from canopy.llm import frequency

    rnd = random.Random(7)
    rows = [("f", [rnd.choice("aab") for _ in range(4)], str(k % 3000), 1) for k in range(9000)]
    df = spark.createDataFrame(rows, "field string, terms array<string>, record string, n_rows int")
    monkeypatch.setattr(frequency, "RECORDS_OF_A_SHARE", 700)
    got = {(r.field, tuple(r.term)): (r.n_rows, r.n_records) for r in count_terms(df, longest=3).collect()}
    assert got == brute(rows, 3)
