"""Texts that are larger than a row should be: they come as rows and are masked in pieces, with the result of the whole.

A piece ends where nothing reaches over: after a line break with white space and bars behind it, at least one bar, together longer
than any window. No grammar passes a bar, and no value begins or ends in such a run. What does reach over is carried through the text:
the words next to a piece, the surnames that the text names in full, the types that vouch for weak ones, and the
numbers of placeholders. So a text takes three passes over its pieces; between them they lie in a temporary file. A text
without such places is one piece.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterable, Iterator
from itertools import chain
from tempfile import TemporaryFile
from typing import Any

from cloakwork.operators.folding import Text
from cloakwork.operators.masking import Entry, MaskState
from cloakwork.operators.resolver import PUBLIC_WINDOW, Entity

from .catalog import TYPES, Config, System

#: Code points of a piece, at least.
PIECE = 1 << 16
#: The farthest that grammars look back by themselves: for a street before its marker.
LOOK_BACK = 64
#: No grammar of the catalogue passes over these.
BARS = "~|*"


def reach(config: Config, system: System, places: Iterable[str]) -> int | None:
    """How far anything looks in a text; None where that has no bound: own patterns, places without Cyrillic, rules for whole texts."""
    known = {t.id: t.patterns for t in TYPES}
    if any(t.patterns and t.patterns != known.get(t.id) for t in config.types) or any(not r.window for r in system.combination_rules) or any(not re.search("[а-я]", p) for p in places):
        return None
    return max(LOOK_BACK, PUBLIC_WINDOW, config.context_window, *(t.context.window for t in config.types), *(r.window for r in system.combination_rules)) + 1


def pieces(rows: Iterable[str], far: int | None, size: int) -> Iterator[str]:
    """The text that the rows make up, in pieces of `size` code points or more."""
    barrier = re.compile(rf"\n[\s{BARS}]{{{far - 1},}}") if far else None
    held: list[str] = []
    have, wanted = 0, size
    for row in chain(rows, [None]):
        held.append(row or "")
        have += len(held[-1])
        if barrier is None or (have < wanted and row is not None):
            continue
        text, at = "".join(held), 0
        for m in barrier.finditer(text):
            if m.end() - at >= size and any(c in m[0] for c in BARS):
                yield text[at : m.end()]
                at = m.end()
        held, have = [text[at:]], len(text) - at
        wanted = max(size, 2 * have)  # a text without barriers is not searched again and again
    if barrier is None or have:
        yield "".join(held)


def _beside(texts: Iterable[Text]) -> Iterator[Text]:
    """The texts, each knowing the kinds of the words next to it."""
    last, waiting = None, []
    for t in texts:
        if t.words:
            for w in waiting:
                w.edges = w.edges[0], t.words[0].kind
            yield from waiting
            waiting = []
        t.edges = last, None
        waiting.append(t)
        last = t.words[-1].kind if t.words else last
    yield from waiting


def _kept(file: Any) -> Iterator[tuple]:
    file.seek(0)
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def masked_pieces(engine: Any, system: str, rows: Iterable[str], size: int = PIECE) -> Iterator[tuple[str, str, list[Entry], list[Entity]]]:
    """(piece, masked, entries, entities) of the text that the rows make up; offsets are those of the piece."""
    s, allowed, masker = engine.systems[system]
    cut = pieces(rows, engine.reach(system), size)
    first = next(cut, "")
    if (second := next(cut, None)) is None:
        yield first, *engine.mask(first, system)
        return
    with TemporaryFile() as found, TemporaryFile() as accepted:
        known: set[str] = set()
        for t in _beside(map(Text, chain([first, second], cut))):
            candidates, named, lone = engine.detectors.of_piece(t)
            known |= named
            pickle.dump((t.original, candidates, lone), found)
        strong: set[str] = set()
        for piece, candidates, lone in _kept(found):
            taken, public = engine.resolver.accepted(Text(piece), [*candidates, *engine.detectors.person.named_again(known, lone)], s, allowed)
            strong |= engine.resolver.strong(taken)
            pickle.dump((piece, taken, public), accepted)
        state = MaskState()
        for piece, taken, public in _kept(accepted):
            entities = engine.resolver.settled(Text(piece), taken, public, s, strong)
            yield piece, *masker.mask(piece, entities, state), entities


def whole_columns(parts: Iterable[tuple[str, str, list[Entry], list[Entity]]]) -> Iterator[tuple[str, tuple, tuple]]:
    """(masked, columns of its entries, columns of its entities) of each piece, with offsets in the whole text and the whole masked text."""
    at = out = byte = 0
    for piece, masked, entries, entities in parts:
        t = Text(piece)
        yield (
            masked,
            ([e.type for e in entries], [at + e.start for e in entries], [at + e.end for e in entries], [out + e.masked_start for e in entries], [out + e.masked_end for e in entries], [e.mask for e in entries], [e.original for e in entries]),
            ([e.type for e in entities], [at + e.start for e in entities], [at + e.end for e in entities], [byte + t.byte(e.start) for e in entities], [byte + t.byte(e.end) for e in entities], [e.confidence for e in entities], [e.evidence for e in entities]),
        )
        at, out, byte = at + len(piece), out + len(masked), byte + t.byte(len(piece))
