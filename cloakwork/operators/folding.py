"""Texts with a folded copy, and the words in them."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import cached_property
from typing import NamedTuple

import numpy as np

# What folding makes equal.
SPACES, DASHES = "\u00a0\u2007\u202f\t", "\u2010\u2011\u2012\u2013\u2014\u2212"
_TABLE = {ord(c): " " for c in SPACES} | {ord(c): "-" for c in DASHES} | {ord("Ё"): "е", ord("ё"): "е"}
_SPECIAL = re.compile(f"[Ёё{SPACES}{DASHES}]")
_WORD = re.compile(r"[^\W_]+(?:[-'’]+(?=[^\W_])[^\W_]+)*")
_CYRILLIC = re.compile("[а-яёіїєґў]")
_LATIN, _DIGIT = re.compile("[a-z]"), re.compile("[0-9]")
CYRILLIC, LATIN, DIGITS, MIXED = "cyrillic", "latin", "digits", "mixed"


def _kind(t: str) -> str:
    cyrillic, latin, digit = (r.search(t) is not None for r in (_CYRILLIC, _LATIN, _DIGIT))
    return {(True, False, False): CYRILLIC, (False, True, False): LATIN, (False, False, True): DIGITS}.get((cyrillic, latin, digit), MIXED)


class Word(NamedTuple):
    """A word of the folded text with the case it had."""

    start: int
    end: int
    text: str
    kind: str
    capitalized: bool
    all_caps: bool


class Text:
    """A text, its folded copy, and the way between their code points."""

    def __init__(self, original: str):
        self.original = original
        #: Of a piece of a longer text: the kinds of the words next to it.
        self.edges: tuple[str | None, str | None] = (None, None)
        folded = (original.translate(_TABLE) if _SPECIAL.search(original) else original).lower()
        self.starts: list[int] | None = None  # original place of each folded character, where they differ
        if len(folded) != len(original) or "ς" in folded or "İ" in original:
            parts = [c.translate(_TABLE).lower() for c in original]
            folded = "".join(parts)
            if len(folded) != len(original):
                self.starts = [i for i, p in enumerate(parts) for _ in p] + [len(original)]
        self.folded = folded

    def span(self, start: int, end: int) -> tuple[int, int]:
        """Original place of a folded span; an end inside one character's expansion takes all of it."""
        if self.starts is None:
            return start, end
        last = self.starts[end] if end < len(self.folded) else len(self.original)
        if 0 < end < len(self.folded) and self.starts[end - 1] == last:
            last += 1
        return self.starts[start], last

    def folded_at(self, place: int) -> int:
        return place if self.starts is None else bisect_left(self.starts, place)

    @cached_property
    def _bytes(self) -> np.ndarray | None:
        """UTF-8 offset of each original code point; None where they are equal."""
        if self.original.isascii():
            return None
        points = np.frombuffer(self.original.encode("utf-32-le", "surrogatepass"), np.uint32)
        size = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        return np.concatenate([[0], np.cumsum(size)])

    def byte(self, place: int) -> int:
        return place if self._bytes is None else int(self._bytes[place])

    @cached_property
    def words(self) -> list[Word]:
        out, original = [], self.original
        for m in _WORD.finditer(self.folded):
            t, (a, b) = m[0], m.span()
            shown = original[a:b] if self.starts is None else original[slice(*self.span(a, b))]
            if t.isascii() and t.isalpha():
                kind, capital = LATIN, shown[0].isupper()
            else:
                kind = _kind(t)
                capital = next((c.isupper() for c in shown if c.isalpha()), False)
            out.append(Word(a, b, t, kind, capital, capital and shown.isupper() and sum(map(str.isalpha, shown)) >= 2))
        return out

    @cached_property
    def word_starts(self) -> list[int]:
        return [w.start for w in self.words]

    def words_between(self, start: int, end: int) -> list[Word]:
        return self.words[bisect_left(self.word_starts, start) : bisect_right(self.word_starts, end - 1)]
