"""Casts of raw text: lenient ones give null, strict ones raise (ANSI)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_DATE = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"


def stripped(c: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_padded(c: Column) -> Column:
    return c.isNotNull() & (c != stripped(c))


def without_null_tokens(c: Column, tokens) -> Column:
    return F.when(~c.isin(list(tokens)), c)


def money(c: Column) -> Column:
    """Plain numerals as decimals, rounded to cents; anything else is null. Never by way of a double."""
    c = stripped(c.cast("string"))
    return F.when(c.rlike(_NUMBER), c).try_cast(MONEY)


def has_more_decimals(c: Column) -> Column:
    """Whether `money` rounds this value."""
    return F.coalesce(stripped(c).try_cast("decimal(38,10)") != money(c), F.lit(False))


def strict_money(c: Column) -> Column:
    return c.cast(MONEY)


def date(c: Column) -> Column:
    """year-month-day with a four-digit year; anything else, and days that don't exist, is null."""
    return F.when(c.rlike(_DATE), c).try_cast("date")


def strict_date(c: Column) -> Column:
    return c.cast("date")


def mixed_date(c: Column, formats=("yyyy-MM-dd", "MM/dd/yyyy", "dd.MM.yyyy", "yyyyMMdd")) -> Column:
    """The first of these formats that fits."""
    return F.coalesce(*(F.try_to_timestamp(stripped(c), F.lit(f)).cast("date") for f in formats))


def identifier(c: Column) -> Column:
    """A numeric id for range checks; null if it isn't one."""
    return F.when(c.rlike("^[0-9]{1,18}$"), c).try_cast("bigint")


def as_double(c: Column) -> Column:
    return c.cast("double")


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; null where b is 0 or null."""
    return F.try_divide(as_double(a), as_double(b))
