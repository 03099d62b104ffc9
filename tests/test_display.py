from pyspark.sql import functions as F

from canopy.functions import display


def test_display(spark):
    rows = [("short",), ("x" * 60,), ("x" * 61,), ("x" * 59 + "🙂y",), ("x" * 58 + "🙂y",), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").coalesce(1).select(display.text_preview(F.col("t"))).collect()]
    assert got == ['"short"', f'"{"x" * 60}"', f'"{"x" * 60}..."', f'"{"x" * 59}..."', f'"{"x" * 58}🙂..."', '""', None]
    df = spark.createDataFrame([("Binary", True, 3, None), ("Long", True, None, "a#7"), ("Long", False, None, "a")], "k string, m boolean, n bigint, r string").coalesce(1)
    assert [tuple(r) for r in df.select(display.type_label(F.col("k"), F.col("m")), display.binary_label(F.col("n"), F.col("r"))).collect()] == [("BINARIES", "{3 bytes}"), ("LONGS", "{7 bytes}"), ("LONG", "{-1 bytes}")]
    assert spark.createDataFrame([("a\x1bb\x85",)], "t string").select(display.printable(F.col("t"))).first()[0] == "a\\u{001b}b\\u{0085}"
