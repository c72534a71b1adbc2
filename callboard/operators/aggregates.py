"""Aggregate shapes used by the reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def decimal_ratio(numerator: Column, denominator: Column, scale_in: int, precision: int, scale: int) -> Column:
    """Quotient rounded half-up to ``scale`` digits; NULL on a zero divisor.

    The numerator, with ``scale_in`` decimals, is held to 28 digits so that the division
    keeps at least ten decimals before the final rounding.
    """
    exact = numerator.cast(f"decimal(28,{scale_in})") / denominator
    return F.when(denominator != 0, exact.cast(f"decimal({precision},{scale})"))


def decimal_shape(df: DataFrame, column: str) -> tuple[int, int]:
    """Precision and scale of a column; integers count as decimals without a scale."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.DecimalType):
        return kind.precision, kind.scale
    return (20, 0) if isinstance(kind, T.LongType) else (10, 0)


def average(df: DataFrame, column: str, weight: str | None = None) -> Column:
    """Average in decimals, four digits finer than the input.

    The result does not depend on the order in which rows arrive. With a ``weight`` each
    row counts that many times.
    """
    precision, scale = decimal_shape(df, column)
    value = F.col(column).cast(f"decimal({precision},{scale})")
    if weight is None:
        return F.avg(value)
    rows = F.sum(F.when(value.isNotNull(), F.col(weight)))
    return decimal_ratio(F.sum(value * F.col(weight)), rows, scale, precision + 4, scale + 4)


def count_by(df: DataFrame, *keys: str, name: str = "count") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def value_counts(df: DataFrame, column: str, name: str = "count") -> DataFrame:
    """Rows per value, most frequent first; NULL is not a value."""
    counts = count_by(df.where(F.col(column).isNotNull()), column, name=name)
    return counts.orderBy(F.desc(name), F.asc_nulls_first(column))


def share_of_total(df: DataFrame, key: str, measure: Column | None = None, name: str = "share") -> DataFrame:
    """Each key's amount and its part of the total in percent, two decimals.

    The total is a scalar subquery over the grouped frame, one row per key.
    """
    amount = F.count(F.lit(1)) if measure is None else F.sum(measure)
    grouped = df.groupBy(key).agg(amount.alias("amount"))
    total = grouped.agg(F.sum("amount")).scalar()
    share = decimal_ratio(F.col("amount") * 100, total.cast("decimal(28,4)"), 4, 7, 2)
    return grouped.withColumn(name, share)


def totals(*measures: tuple[DataFrame, Sequence[Column]]) -> DataFrame:
    """One row of measures over several tables, each table read once."""
    (first, columns), *others = measures
    row = first.agg(*columns)
    for df, extra in others:
        one = df.agg(*extra)
        packed = one.select(F.struct(*one.columns).alias("m")).scalar()
        row = row.withColumn("_m", packed)
        row = row.select(*[c for c in row.columns if c != "_m"], *[F.col(f"_m.{c}").alias(c) for c in one.columns])
    return row


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """First n rows in an order that ends in a unique key (``TakeOrderedAndProject``)."""
    return df.orderBy(*order).limit(n)


def sort_rows(df: DataFrame, key: Sequence[str], *order: Column | str) -> DataFrame:
    """Total order of rows that joins or aggregates have produced; ``key`` spreads them.

    A range sort evaluates its input twice, the first time to sample its bounds. With a
    rebalancing exchange in between both passes read finished rows instead of repeating
    the last joins and aggregates, and AQE evens out the partitions that are sorted. A
    plain scan needs no such step and is sorted with ``orderBy``.
    """
    return df.hint("rebalance", *key).orderBy(*order)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key: the first in the given ascending order.

    An aggregate with map-side combine, so a hot key never gathers in one task the way
    it would under ``row_number``.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest]).select(*df.columns)


__all__ = [
    "average",
    "count_by",
    "decimal_ratio",
    "decimal_shape",
    "first_by",
    "share_of_total",
    "sort_rows",
    "top_n",
    "totals",
    "value_counts",
]


# Distinct counts that add up ---------------------------------------------------------


def distinct_sketch(df: DataFrame, keys: Sequence[str], member: str) -> DataFrame:
    """(keys, bucket, bits): which whole numbers of ``member`` occur per key, exactly, as bitmaps.

    A bitmap covers 32,768 neighbouring numbers in 4 KB, so this suits few keys with dense ids;
    ``distinct_words`` suits any. Rows become bits before the shuffle: a hot key sends one bitmap per task and bucket, never its ids. Sketches
    of parts of a table (days, partitions) are stored and united later by ``united_sketches``;
    numbers that occur in several parts count once. Nulls aren't members.
    """
    number = F.col(member).cast("bigint")
    placed = df.where(F.col(member).isNotNull()).select(
        *keys, F.bitmap_bucket_number(number).alias("bucket"), F.bitmap_bit_position(number).alias("_bit")
    )
    return placed.groupBy(*keys, "bucket").agg(F.bitmap_construct_agg("_bit").alias("bits"))


def united_sketches(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sketches over fewer keys: those that agree in ``keys`` become one."""
    return sketches.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def sketched_counts(sketches: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """The number of distinct members per key of sketches with one bitmap per key and bucket."""
    return sketches.groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias(name))


def distinct_words(df: DataFrame, keys: Sequence[str], member: str) -> DataFrame:
    """(keys, word, bits): which whole numbers of ``member`` occur per key, exactly, 64 neighbours in a number.

    Where many keys have few members each, a key holds one small row per member at most, not 4 KB,
    and a hot key with dense ids still sends a row for 64 of them. Words of parts of a table unite
    by ``bit_or`` over equal keys and words. Nulls aren't members.
    """
    number = F.col(member).cast("bigint")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), number.bitwiseAND(63).cast("int"))
    placed = df.where(F.col(member).isNotNull()).select(*keys, F.shiftright(number, 6).alias("word"), bit.alias("_bit"))
    return placed.groupBy(*keys, "word").agg(F.bit_or("_bit").alias("bits"))


def word_counts(words: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """The number of distinct members per key of ``distinct_words`` with one row per key and word."""
    return words.groupBy(*keys).agg(F.sum(F.bit_count("bits")).alias(name))
