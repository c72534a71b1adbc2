"""Join shapes. Catalyst and AQE pick the physical join; no side is hinted.

AQE splits the partition of a hot key only in a join whose two inputs are both fresh
shuffles. The output of an aggregate or an earlier join on the same key is already
partitioned, so the planner saves that shuffle and with it the chance to split. Where
the left rows may be skewed, ``spread=True`` joins on the key's hash as well: the saved
partitioning no longer fits, both sides are shuffled, and AQE can split. It is left off
where both sides hold one row per key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def join_on(
    df: DataFrame, other: DataFrame, on: Mapping[str, str], how: str, columns: Sequence[str] = (), spread: bool = False
) -> DataFrame:
    """Equi-join on ``{left column: right column}`` that adds only ``columns`` of the right.

    The right key columns are renamed for the join and dropped after it, so tables may
    share column names.
    """
    prefix = "_k"
    while any(c.lower().startswith(prefix) for c in [*df.columns, *columns]):
        prefix = f"_{prefix}"
    helpers = [f"{prefix}{i}" for i in range(len(on) + spread)]
    keys = [F.col(r).alias(name) for r, name in zip(on.values(), helpers)]
    match = [F.col(left) == F.col(name) for left, name in zip(on, helpers)]
    if spread:
        left_hash, right_hash = _hashes(df, other, on)
        keys.append(right_hash.alias(helpers[-1]))
        match.append(left_hash == F.col(helpers[-1]))
    joined = df.join(other.select(*keys, *columns), match, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*helpers)


def _hashes(df: DataFrame, other: DataFrame, on: Mapping[str, str]) -> tuple[Column, Column]:
    """Hashes of both keys, equal where the keys are; key types that can't be brought together are an error."""
    sides: tuple[list[Column], list[Column]] = ([], [])
    for left, right in on.items():
        kinds = df.schema[left].dataType, other.schema[right].dataType
        if any(isinstance(k, T.StringType) and k.collation != "UTF8_BINARY" for k in kinds):
            if len({getattr(k, "collation", None) for k in kinds}) > 1:
                raise ValueError(f"a spread join needs keys of one collation, not {left} {kinds[0]} and {right} {kinds[1]}")
            # The hash functions read bytes, and equal keys of a collation may have other bytes. The key
            # itself is dealt out by its collation; a constant beside it is enough to ask for a fresh shuffle.
            shaped = lambda c: F.length(c) * 0
        elif all(isinstance(k, _WHOLE) for k in kinds):
            shaped = lambda c: c.cast("bigint")
        elif all(isinstance(k, (T.FloatType, T.DoubleType)) for k in kinds):
            shaped = lambda c: c.cast("double") + F.lit(0.0)  # noqa: E731  -0.0 and 0.0 are one key
        elif all(isinstance(k, (*_WHOLE, T.DecimalType)) for k in kinds):
            scale = max(getattr(k, "scale", 0) for k in kinds)
            shaped = lambda c, scale=scale: c.cast(f"decimal(38,{scale})")
        elif all(isinstance(k, (*_WHOLE, T.StringType)) for k in kinds) and kinds[0] != kinds[1]:
            shaped = lambda c: c.try_cast("bigint")  # noqa: E731  as the comparison reads the text
        elif kinds[0] == kinds[1]:
            shaped = lambda c: c
        else:
            raise ValueError(f"a spread join needs keys of like types, not {left} {kinds[0]} and {right} {kinds[1]}")
        for side, name in zip(sides, (left, right), strict=True):
            side.append(shaped(F.col(name)))
    return F.xxhash64(*sides[0]), F.xxhash64(*sides[1])


def per_parent(child: DataFrame, key: str | Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """Child rows brought down to one row per parent key.

    Partial aggregation runs before the shuffle, so a parent that owns a third of all
    children sends one row per map task and not its children.
    """
    keys = [key] if isinstance(key, str) else list(key)
    return child.groupBy(*keys).agg(*[agg.alias(name) for name, agg in aggs.items()])


def attach(
    parent: DataFrame,
    child: DataFrame,
    on: Mapping[str, str],
    aggs: Mapping[str, Column],
    defaults: Mapping[str, object] | None = None,
    spread: bool = False,
) -> DataFrame:
    """Left join of a parent to the per-key aggregates of one child table.

    Several children are attached one after the other. Each arrives with one row per
    parent, so children do not multiply each other as they would in a star join of the
    raw tables, and distinct counts come out the same.

    ``on`` maps parent columns to child columns; ``defaults`` fill the measures of
    parents without children.
    """
    small = per_parent(child, list(on.values()), aggs)
    return lookup(parent, small, on, list(aggs), defaults, spread)


def lookup(
    df: DataFrame,
    reference: DataFrame,
    on: Mapping[str, str],
    columns: Sequence[str],
    defaults: Mapping[str, object] | None = None,
    spread: bool = False,
) -> DataFrame:
    """Left join that adds ``columns`` of a reference table holding one row per key."""
    joined = join_on(df, reference, on, "left", columns, spread)
    for name, value in (defaults or {}).items():
        joined = joined.withColumn(name, F.coalesce(F.col(name), F.lit(value).cast(joined.schema[name].dataType)))
    return joined


def details_with_count(
    parent: DataFrame, child: DataFrame, on: Mapping[str, str], columns: Sequence[str], count: str
) -> DataFrame:
    """Left join to child detail rows plus the number of result rows per parent.

    Same rows as a left join with ``count(*) over (partition by parent key)``: a parent
    without children shows one row, NULL details and a count of 1. The count comes from
    a partial aggregate and the details from an inner join, which AQE can split on either
    side; a window would hold all details of a hot parent in one task.
    """
    counted = attach(parent, child, on, {count: F.count(F.lit(1))})
    kinds = {f.name: f.dataType for f in child.schema.fields}
    childless = counted.where(F.col(count).isNull()).select(
        *parent.columns, *[F.lit(None).cast(kinds[c]).alias(c) for c in columns], F.lit(1).cast("bigint").alias(count)
    )
    matched = join_on(counted.where(F.col(count).isNotNull()), child, on, "inner", columns, spread=True)
    return matched.select(*parent.columns, *columns, count).unionByName(childless)


def having_match(df: DataFrame, other: DataFrame, on: Mapping[str, str], spread: bool = False) -> DataFrame:
    """Rows whose key exists in the other table (semi join)."""
    return join_on(df, other, on, "left_semi", spread=spread)


def without_match(df: DataFrame, other: DataFrame, on: Mapping[str, str], spread: bool = False) -> DataFrame:
    """Rows whose key does not exist in the other table (anti join); NULL keys stay."""
    return join_on(df, other, on, "left_anti", spread=spread)
