"""Data-quality rules: keys, references, required fields, ranges, domains, lengths.

``check`` marks every row with the rules it breaks in one pass; ``validate`` splits the
marked rows. A rule is broken only where its predicate is TRUE: a comparison with NULL
is unknown and passes.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callboard.functions import scalars as S
from callboard.operators.joins import join_on, without_match
from callboard.sources.model import Table

VIOLATION = "struct<rule_id:string,message:string>"


@dataclass(frozen=True)
class Rule:
    """Row rule: ``broken`` builds the predicate that is TRUE on an offending row."""

    rule_id: str
    message: str
    broken: Callable[[], Column]


@dataclass(frozen=True)
class Unique:
    """Key rule: no two rows share the key. Keys holding a NULL never collide."""

    rule_id: str
    message: str
    key: tuple[str, ...]


@dataclass(frozen=True)
class Reference:
    """Foreign-key rule: the key exists in the parent, or is NULL."""

    rule_id: str
    message: str
    columns: tuple[str, ...]
    table: str
    parent: tuple[str, ...]


AnyRule = Rule | Unique | Reference


# Rule builders ---------------------------------------------------------------------


def not_null(column: str, rule_id: str | None = None) -> Rule:
    return Rule(rule_id or f"{column}_required", f"{column} cannot be null", lambda: F.col(column).isNull())


def at_least(column: str, low, rule_id: str | None = None, message: str | None = None) -> Rule:
    return Rule(
        rule_id or f"{column}_min",
        message or f"{column} cannot be below {low}",
        lambda: F.col(column) < F.lit(low),
    )


def in_range(column: str, low, high, rule_id: str | None = None) -> Rule:
    return Rule(
        rule_id or f"{column}_range",
        f"{column} must lie in {low}..{high}",
        lambda: (F.col(column) < F.lit(low)) | (F.col(column) > F.lit(high)),
    )


def above(column: str, low, rule_id: str | None = None) -> Rule:
    return Rule(rule_id or f"{column}_range", f"{column} must exceed {low}", lambda: F.col(column) <= F.lit(low))


def one_of(column: str, values: Sequence[str], rule_id: str | None = None) -> Rule:
    return Rule(
        rule_id or f"{column}_domain",
        f"{column} must be one of {', '.join(values)}",
        lambda: ~F.col(column).isin(*values),
    )


def max_length(column: str, length: int, rule_id: str | None = None) -> Rule:
    return Rule(
        rule_id or f"{column}_length",
        f"{column} is longer than {length}",
        lambda: F.length(column) > length,
    )


def min_age(column: str, years: int, as_of: dt.date, rule_id: str, message: str) -> Rule:
    return Rule(rule_id, message, lambda: S.age_years(column, as_of) < years)


def ordered_dates(start: str, end: str, rule_id: str, message: str) -> Rule:
    return Rule(rule_id, message, lambda: F.col(end) < F.col(start))


def filled_in(*columns: str, rule_id: str = "required_fields") -> Rule:
    """Every field of a submitted row holds some text."""

    def empty() -> Column:
        test = F.lit(False)
        for c in columns:
            test = test | F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
        return test

    return Rule(rule_id, f"{', '.join(columns)} must be filled in", empty)


def same_value(left: str, right: str, rule_id: str | None = None) -> Rule:
    """Two fields of a submitted row agree."""
    return Rule(
        rule_id or f"{left}_matches_{right}",
        f"{left} and {right} do not match",
        lambda: F.col(left) != F.col(right),
    )


def declared_rules(table: Table) -> list[AnyRule]:
    """The rules that a table's declaration implies: keys, references, columns."""
    rules: list[AnyRule] = [Unique(f"{table.name}_pk", "Duplicate primary key", table.key)]
    for i, key in enumerate(table.unique, 1):
        rules.append(Unique(f"{table.name}_uq{i}", "Duplicate unique key", key))
    for ref in table.refs:
        rules.append(
            Reference(f"{table.name}_{ref.column}_fk", f"No such {ref.table}", (ref.column,), ref.table, (ref.parent,))
        )
    for column in table.columns:
        if column.required:
            rules.append(not_null(column.name))
        if column.domain:
            rules.append(one_of(column.name, column.domain))
        if column.length:
            rules.append(max_length(column.name, column.length))
    return rules + [rule for name, rule in CHECKS if name == table.name]


def business_rules(table: str, as_of: dt.date) -> list[Rule]:
    """Rules on arriving rows with the messages users know."""
    # Limits and message texts.
    minimum = at_least("budget", Decimal(100000), "film_budget_minimum", "Minimum film budget is $100,000")
    by_table = {
        "actor": [min_age("dob", 18, as_of, "actor_min_age", "Actor must be at least 18 years old")],
        "film": [minimum],
        "equipment": [at_least("cost", 0, "equipment_cost", "Equipment cost cannot be negative")],
        "shooting_location": [at_least("cost_per_day", 0, "location_cost", "Location cost per day cannot be negative")],
        "crew": [at_least("experience_years", 0, "crew_experience", "Experience years cannot be negative")],
        "shot_at": [
            ordered_dates(
                "shooting_start", "shooting_end", "shooting_dates", "Shooting end date cannot be before start date"
            )
        ],
        "role": [at_least("salary", 0, "role_salary", "Role salary cannot be negative")],
    }
    return by_table.get(table, [])


# The catalogue's range checks.
CHECKS: list[tuple[str, Rule]] = [
    ("film", in_range("rating", 0, 10)),
    ("film", above("duration", 0)),
    ("film", at_least("budget", 0, "budget_check")),
    ("distributor", in_range("market_share", 0, 100)),
    ("equipment", at_least("cost", 0, "cost_check")),
    ("shooting_location", at_least("cost_per_day", 0, "cost_per_day_check")),
    ("crew", at_least("experience_years", 0, "experience_years_check")),
]


# Operators -------------------------------------------------------------------------


def duplicate_keys(df: DataFrame, key: Sequence[str], name: str = "rows") -> DataFrame:
    """Keys that occur more than once, with their row count; keys holding a NULL are left out."""
    present = df.dropna(subset=list(key))
    return present.groupBy(*key).agg(F.count(F.lit(1)).alias(name)).where(F.col(name) > 1)


def orphans(df: DataFrame, columns: Sequence[str], parent: DataFrame, parent_columns: Sequence[str]) -> DataFrame:
    """Rows whose non-NULL key has no parent row."""
    on = dict(zip(columns, parent_columns, strict=True))
    return without_match(df.dropna(subset=list(columns)), parent, on, spread=True)


def check(df: DataFrame, rules: Sequence[AnyRule], refs: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Adds ``violations``, the array of broken rules, and ``is_valid``.

    Row rules cost one projection. A key rule adds a join to the duplicate keys and a
    reference rule one to the distinct parent keys; both are left joins from the checked
    rows, the side that AQE can split when a key is hot.
    """
    marked, tests = df, []
    for i, rule in enumerate(rules):
        if isinstance(rule, Unique):
            extra, broken = duplicate_keys(df, rule.key).select(*rule.key), True
            columns, parent = rule.key, rule.key
        elif isinstance(rule, Reference):
            columns, parent = rule.columns, rule.parent
            extra, broken = (refs or {})[rule.table].select(*parent).distinct(), False
        else:
            tests.append((rule, rule.broken()))
            continue
        flag = f"_found{i}"
        extra = extra.withColumn(flag, F.lit(True))
        marked = join_on(marked, extra, dict(zip(columns, parent, strict=True)), "left", [flag], spread=True)
        missing = F.col(flag).isNull()
        for c in columns:
            missing = missing & F.col(c).isNotNull()
        tests.append((rule, F.col(flag).isNotNull() if broken else missing))
    found = F.array_compact(
        F.array(
            *[
                F.when(test, F.struct(F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.message).alias("message")))
                for rule, test in tests
            ]
        )
    )
    checked = marked.withColumn("violations", found.cast(f"array<{VIOLATION}>"))
    return checked.select(*df.columns, "violations", (F.size("violations") == 0).alias("is_valid"))


def validate(
    df: DataFrame, rules: Sequence[AnyRule], refs: Mapping[str, DataFrame] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Split into (valid rows, quarantined rows with their violations).

    Both sides come from one plan. To store both, write ``check``'s result once with
    ``sinks.write_split`` instead of running the plan for each side.
    """
    checked = check(df, rules, refs)
    valid = checked.where("is_valid").select(*df.columns)
    return valid, checked.where("NOT is_valid").drop("is_valid")


def violations(
    df: DataFrame, rules: Sequence[AnyRule], key: Sequence[str], refs: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """One row per broken rule: key columns, ``rule_id`` and ``message``."""
    broken = check(df, rules, refs).where("NOT is_valid").select(*key, F.explode("violations").alias("v"))
    return broken.select(*key, "v.rule_id", "v.message")


def broken_rows(df: DataFrame, rule: Rule, key: Sequence[str]) -> DataFrame:
    """Rows that break one row rule, as a plain filter the scan can push down."""
    return df.where(rule.broken()).select(*key, F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.message).alias("message"))


def reconcile(df: DataFrame, key: Sequence[str], expected: Mapping[str, Column]) -> DataFrame:
    """Rows whose stored values differ from what they follow from.

    ``expected`` maps stored columns to expressions over the row. A row that differs in any of them
    gives the key, and per column the stored value, ``expected_*`` and ``*_difference`` (stored
    minus expected). The comparison is exact in the type of the stored column, after rounding
    the expectation to its scale, and NULL-safe: a value on one side only,
    or an expectation that the type can't hold, differs, with no difference to tell.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    wanted = {c: e.try_cast(kinds[c]) for c, e in expected.items()}
    differs = [~F.col(c).eqNullSafe(e) for c, e in wanted.items()]
    shown = []
    for c, e in wanted.items():
        shown += [F.col(c), e.alias(f"expected_{c}"), (F.col(c) - e).alias(f"{c}_difference")]
    return df.where(reduce(Column.__or__, differs)).select(*key, *shown)
