"""Pattern types by columns alone: matches, checks, cue words, overlap and masks, all in the JVM.

This is the path for types that a pattern describes (e-mail, phones, cards, numbers of
documents); no row leaves the JVM and nothing is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions import masks, text, validators
from cloakwork.plans.catalog import BOUNDARY, DEFAULT_WINDOW, TYPES, Pattern, Profile, TypeDef

SPANS = "array<struct<start:bigint,end:bigint,value:string>>"
CANDIDATES = "array<struct<type:string,start:bigint,end:bigint,value:string,confidence:float,priority:int,weak:boolean>>"


def java(pattern: str) -> str:
    """A pattern in Java's syntax, with classes over all of Unicode; groups are dropped."""
    p = pattern.replace("{B}", BOUNDARY).replace("(?-u:\\b)", BOUNDARY).replace("(?P<v>", "(?:")
    inside = r"(\[[^\]]*\])"
    out = []
    for piece in re.split(inside, p):
        bracket = piece.startswith("[")
        piece = piece.replace(r"\d", r"\p{Nd}").replace(r"\w", r"\p{L}\p{N}_" if bracket else r"[\p{L}\p{N}_]")
        out.append(piece.replace(r"\s", r"\s\x{85}\p{Z}" if bracket else r"[\s\x{85}\p{Z}]"))
    return "".join(out)


def _any(fragments) -> str | None:
    return java("(?:" + "|".join(fragments) + ")") if fragments else None


def _matches(window: Column, pattern: str | None) -> Column:
    return F.regexp_like(window, F.lit(pattern)) if pattern else F.lit(False)


def _with_group(pattern: str) -> str:
    """The pattern with v as its only group."""
    head, tail = pattern.split("(?P<v>", 1)
    bare = lambda p: re.sub(r"(?<!\\)\((?!\?)", "(?:", p)
    return java(bare(head)) + "(" + java(bare(tail))


def _cut_value(pattern: str):
    """A match cut down to its group v, which ends the match in every pattern."""

    def cut(s: Column) -> Column:
        v = F.regexp_extract(s["value"], _with_group(pattern), 1)
        return F.struct((s["start"] + F.length(s["value"]) - F.length(v)).alias("start"), s["end"].alias("end"), v.alias("value"))

    return cut


def _judge(folded: Column, t: TypeDef, p: Pattern, window: int):
    """A match with its confidence, and whether checks and cue words accept it."""
    size = t.context.window or window
    before, after, suppress = map(_any, (t.context.before, t.context.after, t.context.suppress))
    base = F.lit(p.confidence or t.confidence).cast("float")

    def judged(s: Column) -> Column:
        left, right = text.window_before(folded, s["start"], size), text.window_after(folded, s["end"], size)
        matched = _matches(left, before) | _matches(right, after)
        valid = validators.VALIDATORS[t.validator](s["value"]) if t.validator in validators.VALIDATORS else validators.digits_len(s["value"], *t.length) if t.validator == "digits_len" else F.lit(True)
        boosted = F.least(base + F.lit(t.context.boost).cast("float"), F.lit(1.0).cast("float"))
        lowered = F.greatest(base - F.lit(0.2).cast("float"), F.lit(0.5).cast("float"))
        accepted = ~(_matches(left, suppress) | _matches(right, suppress)) & (valid | (F.lit(t.soft_validator) & matched))
        if p.requires_context or t.context.required:
            accepted &= matched
        fields = {"type": F.lit(t.id), "start": s["start"], "end": s["end"], "value": s["value"], "confidence": F.when(matched & valid, boosted).when(matched, lowered).otherwise(base), "priority": F.lit(t.priority), "weak": F.lit(t.weak) & ~matched, "accepted": accepted}
        return F.struct(*[c.alias(n) for n, c in fields.items()])

    return judged


def _free_of_digits(folded: Column):
    """No digit stands right before or after the value."""

    def free(s: Column) -> Column:
        before = F.substr(folded, s["start"].cast("int"), F.when(s["start"] > 0, 1).otherwise(0))
        return ~before.rlike("[0-9]") & ~F.substr(folded, (s["end"] + 1).cast("int"), F.lit(1)).rlike("[0-9]")

    return free


#: Digits that stand together, but for white space, dashes and brackets, in every match of a type: one look for so many spares most texts its patterns.
RUNS = {"PHONE": 7, "CARD_NUMBER": 13, "INN": 10, "SNILS": 11, "BANK_ACCOUNT": 20, "OMS_POLICY": 16}
_GAP = java(r"[\s\-()]")


def _may_hold(folded: Column, t: TypeDef, p: Pattern) -> Column | None:
    """A cheap test that every text with a match passes, the same for all patterns of a type."""
    if "@" in p.regex:
        return F.contains(folded, F.lit("@"))
    if r"\d" in p.regex:
        return F.regexp_like(folded, F.lit(r"\p{Nd}" + rf"(?:{_GAP}*\p{{Nd}}){{{RUNS.get(t.id, 1) - 1}}}"))
    return None


def _spans_of(folded: Column, t: TypeDef, p: Pattern) -> Column:
    found = text.spans(folded, java(p.regex))
    return F.transform(found, _cut_value(p.regex)) if "(?P<v>" in p.regex else found


def candidates_of(folded: Column, t: TypeDef, window: int = DEFAULT_WINDOW) -> Column:
    """Candidates of one type in a folded text: patterns that are judged alike are judged together, in their order."""
    alike: dict[tuple, list[Pattern]] = {}
    for p in t.patterns:
        alike.setdefault((p.confidence, p.requires_context), []).append(p)
    out = []
    for patterns in alike.values():
        found = F.concat(*[_spans_of(folded, t, p) for p in patterns]).cast(SPANS)
        if t.digit_boundary:
            found = F.filter(found, _free_of_digits(folded))
        kept = F.filter(F.transform(found, _judge(folded, t, patterns[0], window)), lambda c: c["accepted"])
        out.append(F.transform(kept, lambda c: F.struct(*[c[n].alias(n) for n in ("type", "start", "end", "value", "confidence", "priority", "weak")])))
    found, none = F.concat(*out).cast(CANDIDATES), F.array().cast(CANDIDATES)
    tests = [_may_hold(folded, t, p) for p in t.patterns]
    return found if any(x is None for x in tests) else F.when(tests[0], found).otherwise(none)


def disjoint(candidates: Column) -> Column:
    """Greedy choice by confidence, priority, length and place, in order of start.

    A text's candidates are folded over what was chosen: their number is small for patterns; texts with thousands go
    through the engine, which is n log n.
    """
    def order(a, b):
        def cmp(x, y, down=False):
            less, more = (1, -1) if down else (-1, 1)
            return F.when(x < y, less).when(x > y, more)

        return F.coalesce(cmp(a["confidence"], b["confidence"], True), cmp(a["priority"], b["priority"], True), cmp(a["end"] - a["start"], b["end"] - b["start"], True), cmp(a["start"], b["start"]), F.lit(0))

    ranked = F.array_sort(candidates, order)
    chosen = F.aggregate(ranked, F.array().cast(CANDIDATES), lambda acc, c: F.when(F.exists(acc, lambda k: (k["start"] < c["end"]) & (c["start"] < k["end"])), acc).otherwise(F.concat(acc, F.array(c))))
    return F.array_sort(chosen, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))


def _original_places(spans: Column, column: Column) -> tuple[Column, Column]:
    """(places of the extra characters, spans of the folded text as places of the text): İ alone folds to two characters.

    The second of each pair is counted out: before a start, and before an end, which takes a whole pair.
    """
    extra = F.when(F.contains(column, F.lit("İ")), F.transform(text.spans(column, "İ"), lambda s, i: s["start"] + i + 1)).otherwise(F.array().cast("array<bigint>"))

    def moved(s: Column) -> Column:
        start = s["start"] - F.size(F.filter("__extra", lambda d: d <= s["start"]))
        end = s["end"] - F.size(F.filter("__extra", lambda d: d < s["end"]))
        return F.struct(*[{"start": start, "end": end}.get(n, s[n]).alias(n) for n in ("type", "start", "end", "value", "confidence", "priority", "weak")])

    return extra, F.when(F.size("__extra") > 0, F.transform(spans, moved)).otherwise(spans)


def detect(df: DataFrame, types: tuple[str, ...], column: str = "text", min_confidence: float = 0.5) -> DataFrame:
    """df with `spans`: disjoint entities of pattern types, in code points of the text; `value` is the folded value."""
    shown = F.coalesce(column, F.lit(""))
    wanted = [t for t in TYPES if t.id in types and t.patterns]
    extra, placed = _original_places(F.col("__found"), shown)
    df = df.withColumn("__folded", text.fold(shown)).withColumn("__extra", extra)
    found = F.concat(*[candidates_of(F.col("__folded"), t) for t in wanted])
    df = df.withColumn("__found", F.filter(found, lambda c: (c["confidence"] >= min_confidence) & ~c["weak"]))
    return df.withColumn("spans", disjoint(placed)).drop("__folded", "__found", "__extra")


def mask_column(spans: Column, column: Column, profile: Profile, types: tuple[str, ...] | None = None) -> Column:
    """The text with each span masked by the profile's strategy for its type; `types` are those that spans may have."""

    ways: dict = {}
    for type_id in types if types is not None else profile.types:
        ways.setdefault(profile.strategy(type_id), []).append(type_id)
    ways.pop(profile.default, None)

    def by(st, value: Column) -> Column:
        if st.kind == "partial":
            return masks.partial(value, st.keep_start, st.keep_end, st.fill, st.mask_chars)
        return {"full": lambda: masks.full(value, st.fill, st.mask_chars), "initials": lambda: masks.initials(value, st.with_dots), "remove": lambda: masks.remove(value)}[st.kind]()

    def masked(s: Column) -> Column:
        value = F.substr(column, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
        out = by(profile.default, value)
        for st, held in ways.items():
            out = F.when(s["type"].isin(held), by(st, value)).otherwise(out)
        return out

    walked = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substr(column, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), masked(s)).alias("out")),
    )
    return F.concat(walked["out"], F.substr(column, (walked["at"] + 1).cast("int"), F.greatest(F.lit(0), (F.length(column) - walked["at"]).cast("int"))))
