"""Text expressions: folding, words, windows, hashes and similarity. Offsets count code points."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakwork.operators.folding import DASHES, SPACES
from cloakwork.operators.morphology import TRANSLITERATION

WORD = r"[\p{L}\p{N}]+(?:[-'’][\p{L}\p{N}]+)*"


def fold(text: Column) -> Column:
    """Lower case, ё as е, special spaces and dashes as plain ones."""
    return F.lower(F.translate(text, "Ёё" + SPACES + DASHES, "ее" + " " * len(SPACES) + "-" * len(DASHES)))


def fold_entry(text: Column) -> Column:
    """How list entries are folded: trimmed, lower case, ё as е."""
    return F.lower(F.translate(F.trim(text), "Ёё", "ее"))


def transliterate(folded: Column) -> Column:
    """Cyrillic letters by their Latin spelling; other characters stay."""
    table = F.create_map(*[F.lit(x) for k, v in TRANSLITERATION.items() for x in (chr(k), v)])
    return F.array_join(F.transform(F.split(folded, ""), lambda c: F.coalesce(F.element_at(table, c), c)), "")


def words(folded: Column) -> Column:
    return F.regexp_extract_all(folded, F.lit(WORD), F.lit(0))


def token_estimate(text: Column) -> Column:
    """Runs of letters and digits, and every other character but white space."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s\x{85}\p{Z}]")).cast("long")


def window_before(text: Column, start: Column, size: int) -> Column:
    """Up to `size` characters that end at `start`."""
    return F.substr(text, F.greatest(F.lit(1), start - size + 1).cast("int"), F.least(F.lit(size), start).cast("int"))


def window_after(text: Column, end: Column, size: int) -> Column:
    return F.substr(text, (end + 1).cast("int"), F.lit(size))


def byte_offset(text: Column, place: Column) -> Column:
    """UTF-8 bytes before a code point."""
    return F.octet_length(F.substr(text, F.lit(1), place.cast("int")))


def spans(text: Column, pattern: str) -> Column:
    """(start, end, value) of all matches of a pattern, left to right.

    Matches are cut out by regexp_extract_all and what lies between them by split; their running lengths are
    the offsets. The pattern must not match the empty string.
    """
    kind = "array<struct<start:bigint,end:bigint,value:string>>"
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(kind).alias("spans"))
    pairs = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("gap"), found.alias("value"))
    walked = F.aggregate(
        pairs,
        start,
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["gap"]) + F.length(p["value"])).alias("at"),
            F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(p["gap"])).alias("start"), (acc["at"] + F.length(p["gap"]) + F.length(p["value"])).alias("end"), p["value"].alias("value")))).alias("spans"),
        ),
    )
    return F.when(F.size(found) > 0, walked["spans"]).otherwise(F.array().cast(kind))


def hmac_sha256(secret: str, message: Column) -> Column:
    """Keyed hash as lower hex. The pads of the secret stand in the plan; for real secrets use the engine's masks."""
    key = secret.encode()
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in key).hex())) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.to_binary(message, F.lit("utf-8"))), 256))), 256)


def keyed_identity(secret: str, type_id: Column, key: Column) -> Column:
    """The hash that tokens and synthetic values come from."""
    return hmac_sha256(secret, F.concat(type_id, F.lit("\0"), key))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance by the longer length; two empty texts are equal."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def overlap_share(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Common length by the length of both together; 0 where that is empty."""
    common = F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
    hull = F.greatest(a_end, b_end) - F.least(a_start, b_start)
    return F.when(hull == 0, 0.0).otherwise(common / hull)


def request_id() -> Column:
    """16 random hex digits."""
    return F.substr(F.replace(F.uuid(), F.lit("-"), F.lit("")), F.lit(1), F.lit(16))
