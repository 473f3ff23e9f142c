"""Checksums and date rules for values found in Python; `functions.validators` has them as columns."""

from __future__ import annotations

import re
from calendar import monthrange

# Fixed values.
MONTHS = "января февраля марта апреля мая июня июля августа сентября октября ноября декабря".split()
MONTHS_NOMINATIVE = "январь февраль март апрель май июнь июль август сентябрь октябрь ноябрь декабрь".split()
MONTHS_SHORT = {"янв": 1, "фев": 2, "февр": 2, "мар": 3, "апр": 4, "июн": 6, "июл": 7, "авг": 8, "сен": 9, "сент": 9, "окт": 10, "ноя": 11, "нояб": 11, "дек": 12}
INN10, INN11, INN12 = (2, 4, 10, 3, 5, 9, 4, 6, 8), (7, 2, 4, 10, 3, 5, 9, 4, 6, 8), (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
MONTH_NUMBER = {m: i for names in (MONTHS, MONTHS_NOMINATIVE) for i, m in enumerate(names, 1)} | MONTHS_SHORT


def digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def luhn_sum(d: str) -> int:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))


def luhn(s: str) -> bool:
    d = digits(s)
    return len(d) >= 12 and luhn_sum(d) % 10 == 0


def weighted(d: str, weights: tuple[int, ...]) -> int:
    return sum(int(c) * w for c, w in zip(d, weights, strict=False)) % 11 % 10


def inn(s: str) -> bool:
    d = digits(s)
    if len(d) == 10:
        return weighted(d, INN10) == int(d[9])
    return len(d) == 12 and weighted(d, INN11) == int(d[10]) and weighted(d, INN12) == int(d[11])


def snils(s: str) -> bool:
    d = digits(s)
    if len(d) != 11:
        return False
    total = sum(int(c) * (9 - i) for i, c in enumerate(d[:9]))
    check = total if total <= 99 else total % 101 % 100 if total % 101 == 100 or total < 102 else total % 101
    return (0 if total in (100, 101) else check) == int(d[9:])


def phone(s: str) -> bool:
    d = digits(s)
    if not 7 <= len(d) <= 15 or len(set(d)) == 1:
        return False
    return not (len(d) == 11 and s.lstrip().startswith(("+7", "8", "7"))) or d[1] >= "3"


def valid_date(year: int, month: int, day: int) -> bool:
    return 1800 <= year <= 2099 and 1 <= month <= 12 and 1 <= day <= monthrange(year, month)[1]


def month_number(word: str) -> int | None:
    return MONTH_NUMBER.get(word.rstrip("."))


def validate(kind: str, value: str, length: tuple[int, int] = (0, 0)) -> bool:
    if kind == "none":
        return True
    if kind == "digits_len":
        return length[0] <= len(digits(value)) <= length[1]
    if kind == "date":
        from .dates import is_date

        return is_date(value)
    return {"luhn": luhn, "inn": inn, "snils": snils, "phone": phone}[kind](value)
