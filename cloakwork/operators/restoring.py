"""Originals put back into masked texts."""

from __future__ import annotations

from .masking import Entry


def restore_exact(masked: str, entries: list[Entry]) -> str | None:
    """By place; None where the text isn't the masked one."""
    pieces, at = [], 0
    for e in sorted(entries, key=lambda e: e.masked_start):
        if e.masked_start < at or masked[e.masked_start : e.masked_end] != e.mask or e.masked_end > len(masked):
            return None
        pieces += [masked[at : e.masked_start], e.original]
        at = e.masked_end
    return "".join([*pieces, masked[at:]])


def _replaced(text: str, haystack: str, needle: str, originals: list[str], k: int) -> tuple[str, int]:
    """Each needle by the next original, the last one again and again."""
    pieces, at = [], 0
    while (found := haystack.find(needle, at)) >= 0:
        pieces += [text[at:found], originals[min(k, len(originals) - 1)]]
        at, k = found + len(needle), k + 1
    return "".join([*pieces, text[at:]]), k


def restore_rewritten(text: str, entries: list[Entry]) -> str:
    """By mask, in a text that was rewritten: longer masks first, the k-th occurrence gets the k-th original.

    A mask with letters is then looked for in any case. Later masks also see what earlier ones restored.
    """
    originals: dict[str, list[str]] = {}
    for e in entries:
        if e.mask and e.mask != e.original:
            originals.setdefault(e.mask, []).append(e.original)
    for mask in sorted(originals, key=lambda m: (-len(m.encode()), m.encode())):
        text, k = _replaced(text, text, mask, originals[mask], 0)
        if any(c.isalpha() for c in mask):
            lower, needle = text.lower(), mask.lower()
            if len(lower.encode()) == len(text.encode()) and len(needle.encode()) == len(mask.encode()) and len(lower) == len(text):
                text, _ = _replaced(text, lower, needle, originals[mask], k)
    return text


def restore(text: str, entries: list[Entry], exact: bool) -> str:
    if exact and (out := restore_exact(text, entries)) is not None:
        return out
    return restore_rewritten(text, entries)


def masked_again(text: str, entries: list[Entry]) -> str | None:
    """The masked text from the original and its replacements."""
    pieces, at = [], 0
    for e in entries:
        if e.start < at or e.end > len(text):
            return None
        pieces += [text[at : e.start], e.mask]
        at = e.end
    return "".join([*pieces, text[at:]])
