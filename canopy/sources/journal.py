"""Readers of the line files of a store: the head journal and the tolerant form of the collection journal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopy.functions import values

#: Fixed value: the text of a record that isn't there.
NULL_RECORD = "00000000-0000-0000-0000-000000000000:0"


def parse_journal(lines: DataFrame, line: str = "line", number: str = "line_no") -> DataFrame:
    """``line_no``, ``revision`` and ``timestamp_milliseconds`` of the lines that hold a blank.

    What follows the first blank but isn't a time makes it -1.  Lines without
    a blank and nulls are left out.
    """
    parts = F.split(F.col(line), " ", -1)
    time = F.element_at(parts, -1)
    ms = F.when(F.size(parts) > 2, F.element_at(parts, 3)).otherwise(time)
    return lines.where(F.col(line).contains(" ")).select(
        F.col(number).alias("line_no"), parts[0].alias("revision"), F.coalesce(F.when(ms.rlike(r"\A[0-9]+\z"), ms).try_cast("bigint"), F.lit(-1).cast("bigint")).alias("timestamp_milliseconds")
    )


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """The journal file's lines with their numbers, from 0; the newest is the last."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n", -1)).alias("line_no", "line"))
    return parse_journal(text.where("line <> ''"))


def parse_gc_line(line: str = "raw_line"):
    """Columns of a collection journal line as the tolerant reader gives them.

    A line of exactly seven fields has a full generation of its own; in others
    it is that of the generation and surplus fields don't count.  A number that
    can't be read is -1, a missing root the null record.
    """
    f = values.java_fields(F.col(line))
    seven = F.size(f) == 7
    at = lambda k: F.get(f, F.lit(k))
    long = lambda c: values.lenient_number(c, "bigint")
    generation = values.lenient_number(at(3), "int")
    return [
        long(at(0)).alias("repository_size"),
        long(at(1)).alias("reclaimed_size"),
        long(at(2)).alias("timestamp_milliseconds"),
        generation.alias("generation"),
        F.when(seven, values.lenient_number(at(4), "int")).otherwise(generation).alias("full_generation"),
        long(F.when(seven, at(5)).otherwise(at(4))).alias("compacted_nodes"),
        F.coalesce(F.when(seven, at(6)).otherwise(at(5)), F.lit(NULL_RECORD)).alias("root_record_identifier_text"),
    ]


def last_gc_entry(lines: DataFrame, store: str, order: str, line: str = "raw_line") -> DataFrame:
    """The last line of every store, parsed: the state after its last collection."""
    last = lines.where(F.col(line).isNotNull()).groupBy(store).agg(F.max(F.struct(order, line)).alias("m")).select(store, F.col(f"m.{line}").alias(line))
    return last.select(store, *parse_gc_line(line))


def retention_boundary(journal: DataFrame, keep: int, readable: str = "readable") -> DataFrame:
    """Adds ``beyond_retention``: whether ``keep`` newer lines are readable.

    Counted over one ordered list; journals hold one line per commit of a single
    store, so it stays small next to the content.
    """
    newer = Window.orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, -1)
    return journal.withColumn("beyond_retention", F.coalesce(F.sum(F.col(readable).cast("int")).over(newer), F.lit(0)) >= keep)
