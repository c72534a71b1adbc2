"""Bulk forms of the scalar lookup functions.

Each takes a frame of keys and adds one column by a single left join to a reference
table or to a per-key aggregate. Unknown keys get the function's default, never NULL.
The same key may come any number of times, so the joins are spread (``operators.joins``).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callboard.functions import scalars as S
from callboard.operators.joins import attach, lookup


def film_profit(keys: DataFrame, film: DataFrame, key: str = "film_id") -> DataFrame:
    """Adds ``profit``; 0 for an unknown film."""
    facts = film.select("film_id", S.profit("boxoffice_collection", "budget").alias("profit"))
    return lookup(keys, facts, {key: "film_id"}, ["profit"], {"profit": 0}, spread=True)


def film_roi(keys: DataFrame, film: DataFrame, key: str = "film_id") -> DataFrame:
    """Adds ``roi_percentage``; 0 for an unknown film or a budget of zero or less."""
    facts = film.select("film_id", S.roi("boxoffice_collection", "budget").alias("roi_percentage"))
    return lookup(keys, facts, {key: "film_id"}, ["roi_percentage"], {"roi_percentage": 0}, spread=True)


def actor_age(keys: DataFrame, actor: DataFrame, as_of: dt.date | str, key: str = "actor_id") -> DataFrame:
    """Adds ``age``; 0 for an unknown actor or an unknown birth date."""
    facts = actor.select("actor_id", S.age_years("dob", as_of).alias("age"))
    return lookup(keys, facts, {key: "actor_id"}, ["age"], {"age": 0}, spread=True)


def child_count(keys: DataFrame, child: DataFrame, on: dict[str, str], name: str) -> DataFrame:
    """Adds the number of child rows per key; 0 without any."""
    return attach(keys, child, on, {name: F.count(F.lit(1))}, {name: 0}, spread=True)


def child_sum(keys: DataFrame, child: DataFrame, on: dict[str, str], column: str, name: str) -> DataFrame:
    """Adds the sum of a child column per key; 0 without any. ``on`` may hold several columns."""
    return attach(keys, child, on, {name: F.sum(column)}, {name: 0}, spread=True)


def child_average(keys: DataFrame, child: DataFrame, on: dict[str, str], column: str, name: str) -> DataFrame:
    """Adds the average of a child column per key, two decimals; 0 without any."""
    return attach(keys, child, on, {name: F.avg(column).cast("decimal(14,2)")}, {name: 0}, spread=True)


def status_or_unknown(
    keys: DataFrame, reference: DataFrame, on: dict[str, str], column: str, name: str = "status"
) -> DataFrame:
    """Adds a reference column's value; 'Unknown' for an unknown key or a NULL value."""
    facts = reference.select(*on.values(), F.col(column).alias(name))
    return lookup(keys, facts, on, [name], {name: "Unknown"}, spread=True)


def account_state(keys: DataFrame, accounts: DataFrame, key: str = "username") -> DataFrame:
    """Adds ``state``: 1 active, -3 inactive, -1 unknown account.

    An account without a role counts as unknown; an unset active flag counts as active,
    as only a FALSE flag locks an account.
    """
    joined = lookup(keys, accounts, {key: "username"}, ["role", "is_active"], spread=True)
    state = F.when(F.col("role").isNull(), -1).when(~F.col("is_active"), -3).otherwise(1)
    return joined.withColumn("state", state).drop("role", "is_active")
