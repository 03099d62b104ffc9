"""Building blocks shared by the operators."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that hold at least this share of the rows count as hot.  At most
#: ``1 / HOT_SHARE`` keys can, which bounds everything built from them.
HOT_SHARE = 1 / 500


def latest_rows(df: DataFrame, keys: Sequence[str], version: str, values: Sequence[str]) -> DataFrame:
    """One row per key: the one with the greatest ``version``.

    Null keys are keys of their own.  Repeated rows count once; two different
    rows with the same greatest version are settled by the greater values, so
    the result doesn't depend on the order of rows.  Aggregation is combined
    before the shuffle, so a key that is delivered again and again costs one
    row per map task.  Columns not named are dropped.
    """
    newest = F.max(F.struct(version, *values)).alias("__newest")
    kept = df.groupBy(*keys).agg(newest)
    return kept.select(*keys, *(F.col(f"__newest.{v}").alias(v) for v in values))


def row_digest(columns: Sequence[str], salt: int) -> Column:
    """64-bit hash in which a null differs from every value and from its neighbours.

    Spark's hash skips nulls, so a bitmap of the nulls goes first.  NaN equals
    NaN; strings count byte by byte.
    """
    nulls = F.concat(*(F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns))
    return F.xxhash64(F.lit(salt), nulls, *columns)


def lookup(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, value: str, alias: str, spread: Sequence[str], count_on: DataFrame | None = None
) -> DataFrame:
    """Left join with a table whose ``right_key`` is unique, safe against hot and null keys.

    Keys with at least ``HOT_SHARE`` of the rows are counted first (one pass over
    the key column, combined before the shuffle); their at most ``1 / HOT_SHARE``
    values are broadcast.  All other rows go through an ordinary shuffle join,
    where hot and null keys are spread over the partitions by ``spread``: they
    carry a salt that no row of the right side has.

    ``count_on`` is a cheaper table to count the keys on, if there is one.
    Unmatched and null keys give null.  An empty side gives nulls.
    """
    counted = (count_on if count_on is not None else left).groupBy(F.col(left_key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    rows = counted.agg(F.sum("n")).scalar()
    hot = counted.where(F.col("k").isNotNull() & (F.col("n") >= rows * F.lit(HOT_SHARE)) & (F.col("n") > 1000))
    hot_keys = [r.k for r in hot.select("k").limit(int(1 / HOT_SHARE) + 1).collect()]
    side = right.select(F.col(right_key).alias("__k"), F.col(value).alias(alias))
    out, spread_by = left, F.pmod(F.xxhash64(*spread), F.lit(1 << 20)) + 1
    if not hot_keys:
        salt = F.when(F.col(left_key).isNull(), spread_by).otherwise(F.lit(0).cast("bigint"))
        return (
            out.withColumn("__salt", salt)
            .join(side.withColumn("__zero", F.lit(0).cast("bigint")), (F.col(left_key) == F.col("__k")) & (F.col("__salt") == F.col("__zero")), "left")
            .drop("__salt", "__zero", "__k")
        )
    few = side.where(F.col("__k").isin(hot_keys)).select(F.col("__k").alias("__hot"), F.col(alias).alias("__hot_value"))
    salt = F.when(F.col(left_key).isNull() | F.col(left_key).isin(hot_keys), spread_by).otherwise(F.lit(0).cast("bigint"))
    return (
        out.join(F.broadcast(few), F.col(left_key) == F.col("__hot"), "left")
        .withColumn("__salt", salt)
        .join(side.withColumn("__zero", F.lit(0).cast("bigint")), (F.col(left_key) == F.col("__k")) & (F.col("__salt") == F.col("__zero")), "left")
        .withColumn(alias, F.coalesce(F.col("__hot_value"), F.col(alias)))
        .drop("__salt", "__zero", "__k", "__hot", "__hot_value")
    )


def cut(df: DataFrame) -> DataFrame:
    """The DataFrame without its lineage, in the checkpoint folder that executors share.

    The folder is the one that ``spark.checkpoint.dir`` names.  Where it is unset,
    a local session gets a folder of its own; on a cluster, whose executors
    couldn't read that, RuntimeError.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
            folder = tempfile.mkdtemp(prefix="canopy-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def with_places(df: DataFrame, order: Sequence[Column], place: str, first: int = 1) -> DataFrame:
    """Adds the rows' number in an order, from ``first``, without bringing them together.

    Ranges of the order are sorted apart; the driver sees their sizes, one number
    per partition, and these give each range its offset.  Rows that the order
    doesn't tell apart are numbered in any order.
    """
    keyed = df.select("*", *(c.alias(f"__o{k}") for k, c in enumerate(order)))
    by = [f"__o{k}" for k in range(len(order))]
    ranged = keyed.repartitionByRange(*by).sortWithinPartitions(*by).drop(*by)
    ranged = cut(ranged.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    offsets, total = [], first
    for part, n in sorted(ranged.groupBy("__part").count().collect()):
        offsets.append((part, total))
        total += n
    at = F.broadcast(df.sparkSession.createDataFrame(offsets, "__part int, __offset bigint"))
    return ranged.join(at, "__part").withColumn(place, F.col("__offset") + F.col("__at")).drop("__part", "__at", "__offset")
