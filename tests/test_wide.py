import datetime as dt

from canopy.operators.wide import Attribute, to_wide

T0, T1 = dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 2)
ATTRIBUTES = [Attribute("when", 1, "Date"), Attribute("count", 2, "Long"), Attribute("ratio", 3, "Double"), Attribute("price", 4, "Decimal"), Attribute("flag", 5, "Boolean"), Attribute("title", 6, "String")]
PROPERTIES = "node_id bigint, name_id bigint, type_id int, multiple int, position int, value_id bigint, long_value bigint, double_value double, boolean_value int, binary_length bigint, binary_reference_id bigint, loaded_at timestamp, string string, id bigint"
TEXTS = {
    1: ["2020-02-29T23:59:59.999Z", "2021-02-29T00:00:00.000Z", "2021-13-01T00:00:00.000Z", "2021-01-01T00:00:00Z", " 2021-01-01T00:00:00.000-00:00 ", "2021-01-01T24:00:00.000Z", "2021-01-01T00:00:00.000+0100", "x", ""],
    2: ["1", "+12", "-0", " 7 ", "9223372036854775807", "9223372036854775808", "1.0", "１２", "\t1", "1_0", "", "1\n"],
    3: ["1", "1.5", "-1e5", "1E+5", "NaN", "Infinity", "-Infinity", "+Infinity", "nan", "0x1F", "1,5", "1d", "1e"],
    4: ["1", "+1.50", "-2", "1e3", "NaN", "1.", "12345678901234567890123456789012345678901234567890"],
    5: ["true", "FALSE", " True", "yes", "1", ""],
    6: ["", " ", "x", "é" * 20_000],
}
READS = {1: {0, 4}, 2: {0, 1, 2, 3, 4}, 3: {0, 1, 2, 3, 4, 5, 6}, 4: {0, 1, 2, 6}, 5: {0, 1, 2}, 6: {0, 1, 2, 3}}


def frames(spark, properties, strings, nodes):
    return spark.createDataFrame([(n, "clash") for n in nodes], "id bigint, unfilled string"), spark.createDataFrame(properties, PROPERTIES), spark.createDataFrame(strings, "id bigint, value string")


def row(node, name, position=0, value_id=None, long=None, double=None, flag=None, length=None, reference=None, at=T0):
    return (node, name, 1, 0, position, value_id, long, double, flag, length, reference, at, "clash", 9)


def unfilled(df):
    return {(r.node_id, n) for r in df.collect() for n in r.unfilled}


def test_readings(spark):
    properties, strings, want, k = [], [], set(), 0
    for name, texts in TEXTS.items():
        for i, text in enumerate(texts):
            k += 1
            strings.append((k, text))
            properties.append(row(k, name, value_id=k))
            if i not in READS[name]:
                want.add((k, name))
    got = to_wide(*frames(spark, properties, strings, []), ATTRIBUTES)
    assert unfilled(got) == want
    assert got.columns == ["node_id", "when", "count", "ratio", "price", "flag", "title", "unfilled"]
    counts = {r["count"] for r in got.collect()}
    assert {1, 12, 0, 7, 2**63 - 1} <= counts


def test_cells(spark):
    properties = [
        row(1, 2, long=5), row(1, 3, long=5), row(1, 4, double=2.5), row(1, 5, flag=1), row(1, 6, flag=0),
        row(2, 2, double=5.0), row(2, 5, long=1), row(2, 6, position=-1), row(2, 3, length=3), row(2, 4, reference=1), row(2, 1),
        row(3, 2, long=1), row(3, 2, position=1, long=2),
        row(4, 2, value_id=1), row(4, 2, long=8, at=T1), row(5, 2, long=8), row(5, 2, value_id=1, at=T1), row(6, 2, long=4), row(6, 2, long=4),
        row(7, 6, value_id=404), row(None, 2, value_id=1), row(8, None, long=1), row(9, 99, long=1), row(10, 6, position=None, long=1),
    ]
    got = to_wide(*frames(spark, properties, [(1, "x")], [1, 2, 11, None]), ATTRIBUTES)
    assert unfilled(got) == {(2, 2), (2, 5), (2, 6), (2, 3), (2, 4), (2, 1), (3, 2), (5, 2), (7, 6), (10, 6)}
    rows = {r.node_id: r for r in got.collect()}
    assert (rows[1]["count"], rows[1].ratio, float(rows[1].price), rows[1].flag, rows[1].title) == (5, 5.0, 2.5, True, "false")
    assert rows[4]["count"] == 8 and rows[6]["count"] == 4 and rows[3]["count"] is None
    assert set(rows) == {1, 2, 3, 4, 5, 6, 7, 10, 11}


def test_empty_and_hot(spark):
    assert to_wide(*frames(spark, [], [], []), ATTRIBUTES).count() == 0
    assert to_wide(*frames(spark, [], [], [1]), ATTRIBUTES).collect()[0].unfilled == []
    many = [row(k, 6, value_id=7) for k in range(5000)] + [row(k, 6, value_id=k) for k in range(5000, 5100)]
    got = to_wide(*frames(spark, many, [(7, "hot")] + [(k, f"s{k}") for k in range(5000, 5100)], []), ATTRIBUTES)
    titles = {r.node_id: r.title for r in got.collect()}
    assert titles[3] == "hot" and titles[5005] == "s5005" and len(titles) == 5100
