"""Checks of numbers and dates, as expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakwork.operators import checks


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _digit(d: Column, place: int) -> Column:
    return F.substr(d, F.lit(place), F.lit(1)).try_cast("int")


def _weighted(d: Column, weights: tuple[int, ...]) -> Column:
    return reduce(lambda a, b: a + b, [_digit(d, i) * w for i, w in enumerate(weights, 1)])


def luhn(value: Column) -> Column:
    """Checksum over at least 12 digits."""
    return (F.length(digits(value)) >= 12) & F.call_function("luhn_check", digits(value))


def inn(value: Column) -> Column:
    d = digits(value)
    ten = _weighted(d, checks.INN10) % 11 % 10 == _digit(d, 10)
    twelve = (_weighted(d, checks.INN11) % 11 % 10 == _digit(d, 11)) & (_weighted(d, checks.INN12) % 11 % 10 == _digit(d, 12))
    return F.when(F.length(d) == 10, ten).when(F.length(d) == 12, twelve).otherwise(False)


def snils(value: Column) -> Column:
    d = digits(value)
    total = _weighted(d, tuple(range(9, 0, -1)))
    check = F.when(total <= 99, total).when(total <= 101, 0).when(total % 101 == 100, 0).otherwise(total % 101)
    return F.when(F.length(d) == 11, check == F.substr(d, F.lit(10), F.lit(2)).try_cast("int")).otherwise(False)


def phone(value: Column) -> Column:
    d = digits(value)
    n = F.length(d)
    same = F.replace(d, F.substr(d, F.lit(1), F.lit(1)), F.lit("")) == ""
    national = F.regexp_like(value, F.lit(r"^\s*(?:\+7|8|7)")) & (n == 11)
    return F.when((n < 7) | (n > 15) | same, False).when(national, _digit(d, 2) >= 3).otherwise(True)


def digits_len(value: Column, least: int, most: int) -> Column:
    return F.length(digits(value)).between(least, most)


def date(year: Column, month: Column, day: Column) -> Column:
    """A day of 1800 to 2099 that exists."""
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    last = F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    return year.between(1800, 2099) & month.between(1, 12) & day.between(F.lit(1), last)


def month_number(word: Column) -> Column:
    """The month that a Russian month word or its abbreviation names; null for others."""
    table = F.create_map(*[F.lit(x) for k, v in checks.MONTH_NUMBER.items() for x in (k, v)])
    return F.try_element_at(table, F.regexp_replace(word, r"\.+$", ""))


VALIDATORS = {"luhn": luhn, "inn": inn, "snils": snils, "phone": phone}
