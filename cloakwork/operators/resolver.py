"""From candidates to disjoint entities, under a system's policy."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from dataclasses import dataclass, replace
from itertools import accumulate

from cloakwork.plans.catalog import ADDRESS_PARTS, Config, System
from cloakwork.operators import morphology as M

from . import checks
from .detectors import PUBLIC_ADDRESS, PUBLIC_PERSON, Candidate, ContextRule, f32
from .folding import Text

#: Bytes between a public person and what is then no personal data of theirs.
PUBLIC_WINDOW = 80
OF_A_PERSON = ("BIRTH_DATE", "BIRTH_PLACE", "DATE", "CITIZENSHIP")
#: A date this close after an issuer is the date of issue.
ISSUER_GAP_BYTES, ISSUER_GAP_CHARS = 8, 4


@dataclass(frozen=True)
class Entity:
    """A resolved span in code points."""

    start: int
    end: int
    type: str
    confidence: float
    evidence: str


def address_key(s: str) -> str:
    return "".join(c for c in M.fold_entry(s) if c.isalnum())


def _seven(d: str) -> str:
    return "7" + d[1:] if d.startswith("8") else d


class Places:
    """Spans that are asked about others in logarithmic time."""

    def __init__(self, spans):
        spans = sorted(spans)
        self.starts = [s for s, _ in spans]
        self.farthest = list(accumulate((e for _, e in spans), max))  # end of any span so far
        self.nearest = list(accumulate((e for _, e in reversed(spans)), min))[::-1]  # end of any span from here

    def reach(self, start: int, end: int) -> bool:
        """Some span touches start to end, or lies in it."""
        i = bisect_right(self.starts, end)
        return i > 0 and self.farthest[i - 1] >= start

    def hold(self, start: int, end: int) -> bool:
        """Some span holds start to end."""
        i = bisect_right(self.starts, start)
        return i > 0 and self.farthest[i - 1] >= end

    def inside(self, start: int, end: int) -> bool:
        """Some span lies in start to end."""
        i = bisect_left(self.starts, start)
        return i < len(self.starts) and self.nearest[i] <= end


class Resolver:
    def __init__(self, config: Config):
        self.types = {t.id: t for t in config.types}
        self.context = {t.id: ContextRule(t.context, config.context_window) for t in config.types if t.builtin}
        allow = config.allowlists
        self.phones = {_seven(checks.digits(p)) for p in allow.public_phones}
        self.phone_prefixes = tuple(_seven(p) for p in allow.public_phone_prefixes)
        self.domains = [M.fold_entry(d) for d in allow.corporate_email_domains]
        self.addresses = [k for k in map(address_key, allow.public_addresses) if k]
        self.default_confidence = config.min_confidence

    def is_public(self, value: str, type_id: str) -> bool:
        if type_id == "PHONE":
            d = _seven(checks.digits(value))
            return d in self.phones or (bool(self.phone_prefixes) and d.startswith(self.phone_prefixes))
        if type_id == "EMAIL":
            domain = M.fold_entry(value).rpartition("@")[2]
            return any(domain == d or domain.endswith("." + d) for d in self.domains)
        if type_id == "ADDRESS":
            key = address_key(value)
            return any(p in key or key in p for p in self.addresses)
        return False

    def weigh(self, text: Text, candidates: list[Candidate]) -> tuple[list[Candidate], dict[str, list[tuple[int, int]]]]:
        """Candidates with cue words counted and public ones left out, and the places of public persons and addresses."""
        public: dict[str, list[tuple[int, int]]] = {PUBLIC_PERSON: [], PUBLIC_ADDRESS: []}
        marker = {"FIO": PUBLIC_PERSON, "ADDRESS": PUBLIC_ADDRESS}
        kept: list[Candidate] = []
        for c in candidates:
            rule = None if c.detector == "pattern" or c.type in ADDRESS_PARTS else self.context.get(c.type)
            if rule:
                matched, suppressed = rule.check(text.folded, text.folded_at(c.start), text.folded_at(c.end))
                if suppressed:
                    if c.type in marker:
                        public[marker[c.type]].append((c.start, c.end))
                    continue
                if matched:
                    c = replace(c, confidence=min(f32(f32(c.confidence) + f32(rule.boost)), 1.0), weak=False, evidence=c.evidence + ("+context" if c.weak else ""))
            if c.type == PUBLIC_PERSON:
                public[PUBLIC_PERSON].append((c.start, c.end))
            elif self.is_public(text.original[c.start : c.end], c.type):
                if c.type == "ADDRESS":
                    public[PUBLIC_ADDRESS].append((c.start, c.end))
            else:
                kept.append(c)
        around = Places(public[PUBLIC_ADDRESS])
        return [c for c in kept if not (c.type in ADDRESS_PARTS and around.hold(c.start, c.end))], public

    def resolve(self, text: Text, candidates: list[Candidate], system: System, allowed: frozenset[str]) -> list[Entity]:
        accepted, public = self.accepted(text, candidates, system, allowed)
        return self.settled(text, accepted, public, system, self.strong(accepted))

    def accepted(self, text: Text, candidates: list[Candidate], system: System, allowed: frozenset[str]) -> tuple[list[Candidate], dict[str, list[tuple[int, int]]]]:
        """Candidates that the system's policy takes, before the text as a whole counts, and the places of weigh()."""
        candidates, public = self.weigh(text, candidates)
        least = f32(self.default_confidence if system.min_confidence is None else system.min_confidence)
        accepted = [c for c in candidates if f32(c.confidence) >= least and c.type in allowed]
        return self._addresses(accepted, system.address_mode), public

    @staticmethod
    def strong(accepted: list[Candidate]) -> set[str]:
        return {c.type for c in accepted if not c.weak}

    def settled(self, text: Text, accepted: list[Candidate], public: dict[str, list[tuple[int, int]]], system: System, strong: set[str]) -> list[Entity]:
        """Disjoint entities; strong: the types that vouch for weak ones anywhere in the text."""
        accepted = self._weak(accepted, system.weak_entities, strong)

        def near(c: Candidate, places: Places, within: int) -> bool:
            return places.reach(text.byte(c.start) - within, text.byte(c.end) + within)

        def places(spans) -> Places:
            return Places((text.byte(s), text.byte(e)) for s, e in spans)

        if public[PUBLIC_PERSON]:
            people, clients = places(public[PUBLIC_PERSON]), places((c.start, c.end) for c in accepted if c.type == "FIO")
            accepted = [c for c in accepted if c.type not in OF_A_PERSON or not near(c, people, PUBLIC_WINDOW) or near(c, clients, PUBLIC_WINDOW)]
        for rule in system.combination_rules:
            present = places((c.start, c.end) for c in accepted if c.type in rule.only_if_present)
            accepted = [c for c in accepted if c.type != rule.mask or (near(c, present, rule.window) if rule.window else present.starts)]
        issuers = sorted(c.end for c in accepted if c.type == "PASSPORT_ISSUER")
        accepted = [self._issued(text, c, issuers) for c in accepted]
        return self.disjoint(text, accepted)

    @staticmethod
    def _addresses(accepted: list[Candidate], mode: str) -> list[Candidate]:
        if mode == "whole":
            whole = Places((c.start, c.end) for c in accepted if c.type == "ADDRESS")
            return [c for c in accepted if not (c.type in ADDRESS_PARTS and whole.hold(c.start, c.end))]
        parts = Places((c.start, c.end) for c in accepted if c.type in ADDRESS_PARTS)
        return [c for c in accepted if not (c.type == "ADDRESS" and parts.inside(c.start, c.end))]

    def _weak(self, accepted: list[Candidate], policy: str, strong: set[str]) -> list[Candidate]:
        vouched = {"always": lambda c: True, "never": lambda c: False, "context_only": lambda c: c.type in self.types and bool(strong.intersection(self.types[c.type].companions))}[policy]
        return [c for c in accepted if not c.weak or vouched(c)]

    @staticmethod
    def _issued(text: Text, c: Candidate, issuers: list[int]) -> Candidate:
        i = bisect_right(issuers, c.start) if c.type == "DATE" else 0  # the nearest issuer that ends before it
        if i and c.start - issuers[i - 1] <= ISSUER_GAP_CHARS and text.byte(c.start) - text.byte(issuers[i - 1]) <= ISSUER_GAP_BYTES:
            return replace(c, type="PASSPORT_ISSUE_DATE", confidence=max(c.confidence, f32(0.9)), evidence="date+after_issuer")
        return c

    def disjoint(self, text: Text, accepted: list[Candidate]) -> list[Entity]:
        """Greedy: confidence, priority, length in bytes, then the leftmost."""
        order = sorted(accepted, key=lambda c: (-c.confidence, -(self.types[c.type].priority if c.type in self.types else 0), text.byte(c.start) - text.byte(c.end), c.start))
        taken: list[tuple[int, int]] = []
        out = []
        for c in order:
            i = bisect_left(taken, (c.end, -1))
            if i and taken[i - 1][1] > c.start:
                continue
            insort(taken, (c.start, c.end))
            out.append(Entity(c.start, c.end, c.type, c.confidence, c.evidence))
        return sorted(out, key=lambda e: e.start)


def type_counts(entities: list[Entity]) -> dict[str, int]:
    out: dict[str, int] = {}
    for e in sorted(entities, key=lambda e: e.type):
        out[e.type] = out.get(e.type, 0) + 1
    return out


_SPLIT = re.compile(r"(?:[^\w-]|_)+")


def name_tokens(folded: str) -> list[str]:
    return [t for t in _SPLIT.split(folded) if t]
