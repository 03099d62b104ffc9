"""Streams: journal lines as they come, and exports that follow them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from canopy.operators.sinks import Provenance, Refreshed, refresh_parquet
from canopy.sources.journal import parse_gc_line


def journal_stream(spark: SparkSession, folder: str) -> DataFrame:
    """``revision`` and ``timestamp_milliseconds`` of the lines of journal files that arrive in a folder."""
    parts = F.split("value", " ", -1)
    lines = spark.readStream.schema("value string").text(folder).where(F.col("value").contains(" "))
    return lines.select(parts[0].alias("revision"), F.coalesce(F.element_at(parts, -1).try_cast("bigint"), F.lit(-1).cast("bigint")).alias("timestamp_milliseconds"))


def gc_rates(spark: SparkSession, folder: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Per window of time: collections, and the bytes they reclaimed, of collection journal lines that arrive in a folder.

    Lines more than ``late`` behind the newest are dropped; a window comes out
    once no more lines for it are taken.
    """
    lines = spark.readStream.schema("value string").text(folder).select(*parse_gc_line("value"))
    timed = lines.where("timestamp_milliseconds >= 0").withColumn("at", F.timestamp_millis("timestamp_milliseconds")).withWatermark("at", late)
    sums = timed.groupBy(F.window("at", window)).agg(F.count(F.lit(1)).alias("collections"), F.sum(F.greatest("reclaimed_size", F.lit(0))).alias("reclaimed_bytes"))
    return sums.select(F.col("window.start").alias("start"), "collections", "reclaimed_bytes")


def follow(
    revisions: DataFrame,
    target: str,
    provenance: Callable[[str], Provenance],
    tree_at: Callable[[SparkSession, str], tuple[DataFrame, DataFrame]],
    current: Callable[[], str],
    checkpoint: str,
    report: Callable[[Refreshed], None] = lambda _: None,
) -> StreamingQuery:
    """Refreshes an export with every batch of revisions, to the newest of the batch.

    ``tree_at`` gives the nodes and properties at a revision, ``current`` the
    revision that the export is at; an export that bears another one is left alone.  A batch that is run again finds the export
    current and does nothing.
    """

    def step(batch: DataFrame, _: int) -> None:
        newest = batch.agg(F.max(F.struct("timestamp_milliseconds", "revision")).alias("m")).first().m
        if newest is not None:
            spark = batch.sparkSession
            held = current()
            report(refresh_parquet(spark, target, provenance(newest.revision), tree_at(spark, held), tree_at(spark, newest.revision), resolves=lambda r: r == held))

    return revisions.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()
