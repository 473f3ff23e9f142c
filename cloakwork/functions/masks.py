"""Masks as expressions, for values that stand in a column of their own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import keyed_identity

CLASSES = {"digits": "[0-9]", "letters": r"\p{L}", "alnum": r"[\p{L}\p{N}]", "all": r"[^\s\x{85}\p{Z}]"}


def _or_all(value: Column, mask_chars: str, masked) -> Column:
    """Where a value has no character of the class, all but white space are masked."""
    return F.when(F.regexp_like(value, F.lit(CLASSES[mask_chars])), masked(CLASSES[mask_chars])).otherwise(masked(CLASSES["all"]))


def full(value: Column, fill: str = "*", mask_chars: str = "alnum") -> Column:
    return _or_all(value, mask_chars, lambda c: F.regexp_replace(value, c, fill.replace("\\", r"\\").replace("$", r"\$")))


def partial(value: Column, keep_start: int = 2, keep_end: int = 2, fill: str = "*", mask_chars: str = "alnum") -> Column:
    """Maskable characters but the first and last ones; all of them where too few would be hidden."""

    def masked(c: str) -> Column:
        total = F.regexp_count(value, F.lit(c))
        start = F.when(total <= keep_start + keep_end + 1, 0).otherwise(keep_start)
        end = F.when(total <= keep_start + keep_end + 1, 0).otherwise(keep_end)
        walked = F.aggregate(
            F.split(value, ""),
            F.struct(F.lit(0).alias("seen"), F.lit("").alias("out")),
            lambda acc, x: F.when(
                F.regexp_like(x, F.lit(c)),
                F.struct((acc["seen"] + 1).alias("seen"), F.concat(acc["out"], F.when((acc["seen"] < start) | (acc["seen"] >= total - end), x).otherwise(F.lit(fill))).alias("out")),
            ).otherwise(F.struct(acc["seen"].alias("seen"), F.concat(acc["out"], x).alias("out"))),
        )
        return walked["out"]

    return _or_all(value, mask_chars, masked)


def initials(value: Column, with_dots: bool = True) -> Column:
    words = F.transform(F.split(value, r"[\s\x{85}\p{Z}.]"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    letters = F.transform(F.filter(words, lambda w: w != ""), lambda w: F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.lit("." if with_dots else "")))
    return F.when(F.size(letters) > 0, F.array_join(letters, " ")).otherwise(full(value, "*", "all"))


def token(secret: str, type_id: Column, identity: Column, prefix: str = "tok_", length: int = 12) -> Column:
    return F.concat(F.lit(prefix), F.substr(keyed_identity(secret, type_id, identity), F.lit(1), F.lit(min(max(length, 4), 64))))


def remove(value: Column) -> Column:
    return F.when(value.isNotNull(), "")


def digit_identity(value: Column, is_phone: bool = False) -> Column:
    """The identity of numbers: their digits, a phone's leading 8 as 7."""
    d = F.regexp_replace(value, "[^0-9]", "")
    return F.when((F.length(d) == 11) & F.startswith(d, F.lit("8")), F.concat(F.lit("7"), F.substr(d, F.lit(2)))).otherwise(d) if is_phone else d
