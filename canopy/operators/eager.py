"""Aggregates over joins whose keys are badly skewed.

Both inputs are aggregated by the join key first, so what is shuffled and
joined is one compact state per key and side, however many rows a key holds.
Counts of joined rows are products of counts; sums of one side are multiplied
with the other side's count.  A key that holds a third of all rows costs its
task no more than any other: the map side has already folded it.  The joined
states are then rolled up to coarser keys.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Products of counts: two keys of 10**18 rows each still fit.
PRODUCT = "decimal(38,0)"


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    left_sums: Mapping[str, Column] | None = None,
    right_sums: Mapping[str, Column] | None = None,
    how: str = "inner",
    left_by: Sequence[str] = (),
) -> DataFrame:
    """Per key: ``left_rows``, ``right_rows``, ``joined_rows`` and the sums over the joined rows.

    Equal to joining the rows and aggregating by key, without making the rows.
    ``left_by`` are columns of the left side that are kept beside the key: its
    state is then one for each of their combinations.  ``how`` is ``inner`` or
    ``left``; in a left join a key without partners counts its own rows once,
    with null sums of the right side.  A null key joins nothing, so ``inner``
    leaves it out and ``left`` keeps it.  ``joined_rows`` is a decimal without
    fraction, for a product of counts may be beyond 64 bits; sums of integers are
    such decimals too, others stay doubles.  Empty inputs give no rows.  The
    result's columns are named above; other columns of the inputs are not carried.
    """
    left_sums, right_sums = dict(left_sums or {}), dict(right_sums or {})
    a = left.groupBy(F.col(left_key).alias("key"), *left_by).agg(F.count(F.lit(1)).alias("left_rows"), *(_total(left, c).alias(f"__l_{k}") for k, c in left_sums.items()))
    b = right.groupBy(F.col(right_key).alias("__right_key")).agg(F.count(F.lit(1)).alias("__right_rows"), *(_total(right, c).alias(f"__r_{k}") for k, c in right_sums.items()))
    joined = a.join(b, F.col("key") == F.col("__right_key"), how)
    partners = F.coalesce(F.col("__right_rows"), F.lit(1))
    return joined.select(
        "key",
        *left_by,
        "left_rows",
        F.coalesce(F.col("__right_rows"), F.lit(0)).alias("right_rows"),
        _times(F.col("left_rows").cast(PRODUCT), partners).alias("joined_rows"),
        *(_scaled(joined, f"__l_{k}", partners).alias(k) for k in left_sums),
        *(_scaled(joined, f"__r_{k}", F.col("left_rows")).alias(k) for k in right_sums),
    )


def _total(side: DataFrame, column: Column) -> Column:
    """The sum, of integers as a decimal that doesn't overflow."""
    kind = side.select(column.alias("x")).dtypes[0][1]
    return F.sum(column) if kind in ("float", "double") else F.sum(column.cast("decimal(28,0)"))


def _times(a: Column, count: Column) -> Column:
    return (a * count.cast("decimal(19,0)")).cast(PRODUCT)


def _scaled(joined: DataFrame, column: str, count: Column) -> Column:
    return F.col(column) * count if dict(joined.dtypes)[column] == "double" else _times(F.col(column), count)


def roll_up(joined: DataFrame, by: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Joined states folded to coarser keys: ``keys``, the number of states, and the sums of ``sums``."""
    return joined.groupBy(*by).agg(F.count(F.lit(1)).alias("keys"), *(F.sum(c).alias(c) for c in sums))


def heavy_keys(per_key: DataFrame, rows: DataFrame, share: Decimal) -> DataFrame:
    """The keys of joined states that hold at least ``share`` of all ``rows`` of the left side; null is no key.

    A key's joined rows are its rows times its partners, so they are held against
    the share of as many rows times its partners (one for a key without any).
    """
    part = Fraction(share)  # whole numbers on both sides: nothing is rounded
    total = rows.agg(F.count(F.lit(1))).scalar().cast(PRODUCT)
    partners = F.greatest(F.col("right_rows"), F.lit(1))
    enough = _times(F.col("joined_rows"), F.lit(part.denominator)) >= _times(_times(total, F.lit(part.numerator)), partners)
    return per_key.where(F.col("key").isNotNull() & enough)
