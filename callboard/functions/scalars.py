"""Scalar column expressions shared by reports, rules and row changes.

Everything here is built-in Spark expressions, so it stays inside code generation.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

ROI_TYPE = "decimal(18,2)"


def full_name(first, last) -> Column:
    """First and last name with a blank between; NULL if either is NULL."""
    return F.concat(_col(first), F.lit(" "), _col(last))


def message(template: str, *cols) -> Column:
    """Text with ``{}`` gaps filled from columns; NULL if any of them is NULL."""
    parts = template.split("{}")
    if len(parts) != len(cols) + 1:
        raise ValueError(f"{template!r} has {len(parts) - 1} gaps for {len(cols)} columns")
    pieces: list[Column] = []
    for i, text in enumerate(parts):
        if text:
            pieces.append(F.lit(text))
        if i < len(cols):
            pieces.append(_col(cols[i]).cast("string"))
    return F.concat(*pieces)


def profit(boxoffice, budget) -> Column:
    """Decimal difference, a missing side counting as 0."""
    return F.coalesce(_col(boxoffice), F.lit(0)) - F.coalesce(_col(budget), F.lit(0))


def roi(boxoffice, budget) -> Column:
    """Profit in percent of the budget, two decimals.

    A missing budget counts as 0 in the profit and as 1 in the divisor; a budget of
    zero or less gives 0. The result is wide enough never to overflow.
    """
    divisor = F.coalesce(_col(budget), F.lit(1))
    # The division sits inside the branch: ANSI mode raises on a zero divisor.
    percent = F.when(divisor > 0, F.round(profit(boxoffice, budget) * 100 / divisor, 2)).otherwise(F.lit(0))
    return percent.cast(ROI_TYPE)


def age_years(born, as_of) -> Column:
    """Difference of the calendar years; the birthday itself is not looked at."""
    return F.year(_date(as_of)) - F.year(_col(born))


def age_or_zero(born, as_of) -> Column:
    return F.coalesce(age_years(born, as_of), F.lit(0))


def inclusive_days(start, end) -> Column:
    """Days from start to end with both ends counted."""
    return F.date_diff(_col(end), _col(start)) + 1


def stay_cost(start, end, rate_per_day) -> Column:
    return inclusive_days(start, end) * _col(rate_per_day)


def end_or_default(start, end, days: int) -> Column:
    """The end date, or the start plus ``days`` where none is given."""
    return F.coalesce(_col(end), F.date_add(_col(start), days))


def split_list(text, sep: str = ",", collation: str | None = None) -> Column:
    """Delimited text to an array: parts trimmed, empty ones and repeats dropped.

    With a ``collation`` (for example ``UNICODE_CI_AI``) two spellings of one word count
    as a repeat and the first spelling stays.
    """
    parts = F.filter(F.transform(F.split(_col(text), _literal_pattern(sep)), lambda p: F.trim(p)), lambda p: F.length(p) > 0)
    if collation is None:
        return F.array_distinct(parts)
    as_written = F.array_distinct(F.transform(parts, lambda p: F.collate(p, collation)))
    return F.transform(as_written, lambda p: F.collate(p, "UTF8_BINARY"))


def join_list(values, sep: str = ", ", default: str | None = None) -> Column:
    """Aggregate: the distinct values in order, as one delimited text.

    The text is one value of one row, so a group's distinct values must fit into memory.
    """
    joined = F.array_join(F.sort_array(F.collect_set(_col(values))), sep)
    return joined if default is None else F.when(joined == "", F.lit(default)).otherwise(joined)


def to_minute(ts) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd HH:mm")


def to_second(ts) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd HH:mm:ss")


def try_number(text, kind: str = "double") -> Column:
    """Number in the text, NULL where there is none."""
    return _col(text).try_cast(kind)


def label(code, labels: dict, default: str | None = None) -> Column:
    """Code to label, ``default`` for any other code (NULL included)."""
    chain = None
    for value, text in labels.items():
        test = _col(code) == F.lit(value)
        chain = F.when(test, text) if chain is None else chain.when(test, text)
    return chain.otherwise(F.lit(default))


def money(amount, decimals: int = 0) -> Column:
    """``$1,234`` text. Ties round half-even, as the usual text formatting does."""
    rounded = F.bround(_col(amount), decimals)
    return F.concat(F.lit("$"), F.format_number(rounded, decimals))


def percent(amount, decimals: int = 2) -> Column:
    """``12.34%`` text of a decimal."""
    fixed = F.bround(_col(amount), decimals).cast(f"decimal(28,{decimals})")
    return F.concat(fixed.cast("string"), F.lit("%"))


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _date(value) -> Column:
    if isinstance(value, (dt.date, dt.datetime)):
        return F.lit(value)
    if isinstance(value, str):
        return F.lit(dt.date.fromisoformat(value))
    return value


def _literal_pattern(sep: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in sep)
