"""Column expressions: null rules, ratios, day counts and display text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

DAYS_PER_YEAR = 365


def days_between(start, end) -> Column:
    """Whole days from ``start`` to ``end``, both dates."""
    return F.datediff(_c(end), _c(start))


def whole_months(start, end) -> Column:
    return F.timestamp_diff("MONTH", _c(start).cast("timestamp"), _c(end).cast("timestamp"))


def years(days) -> Column:
    return _c(days) / DAYS_PER_YEAR


def ratio(numerator, denominator) -> Column:
    """Quotient, NULL where the denominator is zero."""
    return F.try_divide(_c(numerator).cast("double"), _c(denominator).cast("double"))


def not_negative(column) -> Column:
    return F.when(_c(column) >= 0, _c(column))


def smallest(*names: str) -> Column:
    """Row-wise minimum that skips NULLs."""
    return F.least(*[_c(n) for n in names])


def count_true(condition: Column) -> Column:
    """Number of true rows, NULL when every row is NULL."""
    return F.sum(condition.cast("int"))


def matches(column, pattern: str, ignore_case: bool = True) -> Column:
    return _c(column).rlike(("(?i)" if ignore_case else "") + pattern)


def equals_text(column, text: str, ignore_case: bool = True) -> Column:
    if ignore_case:
        return F.lower(_c(column)) == text.lower()
    return _c(column) == text


def starts_with(column, prefix: str) -> Column:
    return F.upper(_c(column)).startswith(prefix.upper())


def display_names(column, names: dict[str, str]) -> Column:
    """Replaces the listed values and keeps the others."""
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _c(column)), _c(column))


def money_text(column) -> Column:
    return F.coalesce(F.concat(F.lit("$"), F.format_number(_c(column), 2)), F.lit("-"))


def percent_text(column) -> Column:
    return F.concat(F.replace(F.format_number(100 * _c(column), 2), F.lit(",")), F.lit("%"))


def spaced(column) -> Column:
    return F.replace(_c(column), F.lit("_"), F.lit(" "))


def date_text(column) -> Column:
    return F.date_format(_c(column), "MM/dd/yyyy")


def slash_date(column) -> Column:
    """Date from text such as 2013/12/12."""
    return F.to_date(_c(column), "yyyy/MM/dd")


def hash_number(*parts) -> Column:
    """Repeatable number in [0, 2^32) from the md5 of the joined parts."""
    text = F.concat_ws(":", *[_c(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def draw_number(*parts) -> Column:
    """Repeatable number in [0, 2^60), for draws from classes of any size."""
    text = F.concat_ws(":", *[_c(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _c(column) -> Column:
    return F.col(column) if isinstance(column, str) else column
