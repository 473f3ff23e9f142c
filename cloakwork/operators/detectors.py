"""Detectors: each yields candidate spans over one folded text.

They run inside Arrow batches (`plans.engine`): the composite grammars look back at
earlier matches, which columns can't. `operators.pattern_spans` finds the plain
patterns with columns only.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np

from cloakwork.plans.catalog import BOUNDARY, DEFAULT_WINDOW, Config, Context, TypeDef
from cloakwork.sources.dictionaries import CITY, COUNTRY, REGION, Dictionaries

from . import checks, dates
from . import morphology as M
from .folding import CYRILLIC, DIGITS, LATIN, Text, Word

PUBLIC_PERSON, PUBLIC_ADDRESS = "PUBLIC_PERSON", "PUBLIC_ADDRESS"


def f32(x: float) -> float:
    """Confidences are single precision, since ties decide."""
    return float(np.float32(x))


@dataclass(frozen=True)
class Candidate:
    """A span in code points of the original text."""

    start: int
    end: int
    type: str
    confidence: float
    detector: str
    evidence: str = ""
    weak: bool = False


def any_of(fragments, *, flags=0) -> re.Pattern | None:
    return re.compile("(?:" + "|".join(f.replace("{B}", BOUNDARY) for f in fragments) + ")", flags) if fragments else None


class ContextRule:
    """Cue words before and after a span, and words that forbid it on either side."""

    def __init__(self, spec: Context, default_window: int = DEFAULT_WINDOW):
        self.before, self.after, self.suppress = any_of(spec.before), any_of(spec.after), any_of(spec.suppress)
        self.window, self.required, self.boost = spec.window or default_window, spec.required, spec.boost

    def check(self, folded: str, start: int, end: int) -> tuple[bool, bool]:
        """(matched, suppressed)."""
        before, after = folded[max(0, start - self.window) : start], folded[end : end + self.window]
        suppressed = bool(self.suppress and (self.suppress.search(before) or self.suppress.search(after)))
        return bool((self.before and self.before.search(before)) or (self.after and self.after.search(after))), suppressed


def digit_glued(folded: str, start: int, end: int) -> bool:
    return folded[max(0, start - 1) : start] in tuple("0123456789") or folded[end : end + 1] in tuple("0123456789")


class PatternDetector:
    name = "pattern"

    def __init__(self, config: Config):
        self.rules = []
        for t in config.types:
            if t.enabled and not t.builtin:
                context = ContextRule(t.context, config.context_window)
                for p in t.patterns:
                    try:
                        r = re.compile(p.source)
                    except re.error as e:
                        raise ValueError(f"pattern of {t.id}: {e}") from None
                    self.rules.append((t, p, r, context, "\\d" in p.regex or "0-9" in p.regex))

    def find(self, text: Text, places: list) -> Iterator[Candidate]:
        folded = text.folded
        has_digit, has_at = re.search(r"\d", folded) is not None, "@" in folded
        for t, p, r, context, needs_digit in self.rules:
            if (needs_digit and not has_digit) and t.id != "EMAIL" or (t.id == "EMAIL" and "@" in p.regex and not has_at):
                continue
            for m in r.finditer(folded):
                start, end = m.span()
                if "v" in r.groupindex and (again := r.search(m[0])) is not None and again.start("v") >= 0:
                    start, end = m.start() + again.start("v"), m.start() + again.end("v")
                if start == end or (t.digit_boundary and digit_glued(folded, start, end)):
                    continue
                valid = checks.validate(t.validator, folded[start:end], t.length)
                matched, suppressed = context.check(folded, start, end)
                if suppressed or not (valid or (t.soft_validator and matched)) or ((context.required or p.requires_context) and not matched):
                    continue
                yield self._candidate(text, t, p.confidence or t.confidence, start, end, matched, valid, context.boost)

    @staticmethod
    def _candidate(text: Text, t: TypeDef, base: float, start: int, end: int, matched: bool, valid: bool, boost: float) -> Candidate:
        if matched:
            confidence = min(f32(f32(base) + f32(boost)), 1.0) if valid else max(f32(f32(base) - f32(0.2)), 0.5)
        else:
            confidence = f32(base)
        evidence = "pattern" + ("+validator" if t.validator != "none" and valid else "") + ("+context" if matched else "") + ("(checksum failed)" if not valid else "")
        return Candidate(*text.span(start, end), t.id, confidence, "pattern", evidence, t.weak and not matched)


class DateDetector:
    name = "dates"
    EVIDENCE = {dates.BIRTH: "date+birth_context", dates.ISSUE: "date+issue_context", dates.PLAIN: "date"}

    def __init__(self, config: Config):
        types = {kind: t for kind in self.EVIDENCE if (t := config.type(kind))}
        self.confidence = {kind: f32(t.confidence) for kind, t in types.items() if t.enabled}
        cues = {kind: types[kind].context if kind in types else Context() for kind in (dates.BIRTH, dates.ISSUE)}
        self.cues = dates.Cues(any_of(cues[dates.BIRTH].after), {kind: any_of(c.before) for kind, c in cues.items()}, cues[dates.BIRTH].window or config.context_window)

    def _kind(self, folded: str, bare: bool, start: int, end: int) -> str | None:
        """The type of a date, a plain one where its own is off; none where there is no date to report."""
        if digit_glued(folded, start, end):
            return None
        kind = self.cues.kind(folded, start, end)
        if bare and kind == dates.PLAIN:
            return None
        return next((k for k in (kind, dates.PLAIN) if k in self.confidence), None)

    def find(self, text: Text, places: list) -> Iterator[Candidate]:
        found = ((*text.span(start, end), self._kind(text.folded, bare, start, end)) for bare, start, end in dates.find_dates(text.folded))
        return (Candidate(start, end, kind, self.confidence[kind], "dates", self.EVIDENCE[kind], kind == dates.PLAIN) for start, end, kind in found if kind)


class Gazetteer:
    """Place forms in folded text: leftmost-longest matches that don't overlap, kept if they are whole words."""

    def __init__(self, kinds: dict[str, str]):
        self.kinds = kinds
        try:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for form in kinds:
                self.automaton.add_word(form, form)
            self.automaton.make_automaton() if kinds else None
        except ImportError:
            self.automaton = None
            self.trie: dict = {}
            for form in kinds:
                node = self.trie
                for c in form:
                    node = node.setdefault(c, {})
                node[""] = form

    def _matches(self, folded: str) -> Iterator[tuple[int, str]]:
        if self.automaton is not None:
            for last, form in self.automaton.iter_long(folded):
                yield last + 1 - len(form), form
            return
        at = 0
        while at < len(folded):
            node, found = self.trie, None
            for c in folded[at:]:
                node = node.get(c)
                if node is None:
                    break
                found = node.get("", found)
            if found:
                yield at, found
            at += len(found) if found else 1

    def find(self, folded: str) -> list[tuple[int, int, str]]:
        if not self.kinds:
            return []
        part = lambda c: c.isalnum() or c == "-"
        out = []
        for start, form in self._matches(folded):
            end = start + len(form)
            if not (start and part(folded[start - 1])) and not (end < len(folded) and part(folded[end])):
                out.append((start, end, self.kinds[form]))
        return out


# Words that are no names.
NO_NAMES = frozenset(
    "гражданин гражданка гражданину гражданке господин госпожа товарищ клиент клиентка клиенту заявитель заявительница получатель отправитель плательщик держатель сотрудник сотрудница заемщик заёмщик вкладчик владелец пациент абонент пользователь "
    "покупатель продавец арендатор доверитель представитель директор менеджер руководитель специалист магазин отделение компания банк договор заявление паспорт карта телефон адрес регион район город улица документ номер серия дата место время рублей "
    "копеек гражданство уроженец уроженка рождения выдан выдана кем код подразделения уважаемый уважаемая здравствуйте добрый день утро вечер спасибо пожалуйста композитор писатель поэт художник актер актёр режиссер режиссёр президент министр генерал "
    "профессор академик доктор учитель инженер водитель студент ученик клиентов".split()
)
MONTH_WORDS = frozenset([*checks.MONTHS, *checks.MONTHS_NOMINATIVE, *"январе феврале марте апреле мае июне июле августе сентябре октябре ноябре декабре".split()])
NO_CARD_WORDS = frozenset(
    "visa mastercard maestro mir classic gold platinum black edition online bank card credit debit unionpay american express world elite signature infinite business premium standard electron virtual digital apple google pay samsung sber tinkoff alfa vtb "
    "raiffeisen rosbank otkritie sovcombank gazprombank cvv cvc pin exp valid thru month year id code no number the and for with from llc ltd inc ooo pao ao ip".split()
)
_CYRILLIC_LETTER = re.compile("[а-яёіїєґў]")
LONE_CUE = re.compile(r"(?:г-н|г-жа|господин|госпожа|фамилия|гражданин|гражданка|клиент|заявитель|сотрудник|заемщик|заёмщик)\s*[:\-]?\s*$")


@dataclass(frozen=True)
class Role:
    """What a word may be in a name."""

    first: bool = False
    ambiguous: bool = False
    patronymic: bool = False
    listed: bool = False  # a surname of the dictionary
    shaped: bool = False  # a surname by its ending
    initial: bool = False
    cap: bool = False
    cyrillic: bool = False
    length: int = 0

    @property
    def surname(self) -> bool:
        return self.listed or self.shaped

    @property
    def family(self) -> bool:
        """A surname that is no patronymic."""
        return self.surname and not self.patronymic

    @property
    def family_or_cap(self) -> bool:
        return self.surname or (self.cap and self.cyrillic and not self.first and not self.patronymic and self.length >= 3)

    @property
    def given(self) -> bool:
        return self.first and not self.patronymic


NOBODY = Role()
FULL, LISTED_PAIR, SHAPED_PAIR = {"listed": 0.97, "shaped": 0.93, "cap": 0.88}, 0.85, 0.78


def _by_surname(r: Role) -> float:
    return FULL["listed" if r.listed else "shaped" if r.shaped else "cap"]


def _pair(r: Role) -> float:
    return LISTED_PAIR if r.listed else SHAPED_PAIR


def _sure(name: Role, surname: Role, cued: bool) -> bool:
    """A name that is also a common word needs a capital, a listed surname or a cue."""
    return not name.ambiguous or name.cap or surname.listed or cued


#: Shapes of a name, tried in order: words, evidence, condition, confidence.
NAME_SHAPES = (
    (3, "surname+first+patronymic", lambda a, b, c, cued: a.family_or_cap and not a.patronymic and b.given and c.patronymic, lambda a, b, c: _by_surname(a)),
    (3, "first+patronymic+surname", lambda a, b, c, cued: a.first and b.patronymic and c.family_or_cap and not c.patronymic and not c.first, lambda a, b, c: _by_surname(c)),
    (3, "surname+initials", lambda a, b, c, cued: a.family and b.initial and c.initial, lambda a, b, c: 0.85),
    (3, "initials+surname", lambda a, b, c, cued: a.initial and b.initial and c.family, lambda a, b, c: 0.85),
    (2, "first+patronymic", lambda a, b, c, cued: a.given and b.patronymic, lambda a, b, c: 0.92),
    (2, "surname+first", lambda a, b, c, cued: a.family and not a.initial and b.given and _sure(b, a, cued), lambda a, b, c: _pair(a)),
    (2, "first+surname", lambda a, b, c, cued: a.given and b.family and not b.initial and _sure(a, b, cued), lambda a, b, c: _pair(b)),
    (2, "surname+initial", lambda a, b, c, cued: a.family and b.initial, lambda a, b, c: 0.8),
    (2, "initial+surname", lambda a, b, c, cued: a.initial and b.family, lambda a, b, c: 0.8),
    (1, "first_name", lambda a, b, c, cued: a.given and (not a.ambiguous or a.cap), lambda a, b, c: 0.55 if a.cap else 0.5),
)


class PersonDetector:
    name = "person"

    def __init__(self, config: Config, lists: Dictionaries):
        t = config.type("FIO")
        self.lists, self.scale = lists, f32(t.confidence) if t else f32(0.9)
        self.known: dict[str, tuple[bool, bool, bool, bool]] = {}

    def _alone(self, t: str) -> tuple[bool, bool, bool, bool]:
        """(first name, patronymic, surname of the list, like a surname) of a word by itself, remembered for as many words as a worker may hold."""
        if t not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            parts = [] if t in NO_NAMES else t.split("-")
            self.known[t] = t in self.lists.nominative and t not in NO_NAMES, self.lists.is_patronymic(t), any(self.lists.surname_lemma(p) for p in parts), any(map(M.surname_like, parts))
        return self.known[t]

    def role(self, text: Text, i: int) -> Role:
        words, folded = text.words, text.folded
        w = words[i]
        t = w.text
        if w.kind != CYRILLIC:
            return Role(cap=w.capitalized, length=len(t))
        first, patronymic, family, like = self._alone(t)
        if first and t in MONTH_WORDS:
            before, after = text.edges
            first = DIGITS not in (words[i - 1].kind if i else before, words[i + 1].kind if i + 1 < len(words) else after)
        initial = len(t) == 1 and folded[w.end : w.end + 1] == "."
        return Role(first, first and t in self.lists.ambiguous, patronymic, family, like, initial, w.capitalized and t not in NO_NAMES, True, len(t))

    @staticmethod
    def runs(words: list[Word], roles: list[Role], folded: str) -> Iterator[tuple[int, int]]:
        """Ranges of Cyrillic words with only spaces, or the dot of an initial, between them."""
        i = 0
        while i < len(words):
            j = i + 1
            if roles[i].cyrillic:
                while j < len(words) and roles[j].cyrillic:
                    gap = folded[words[j - 1].end : words[j].start]
                    if len(gap) > 3 or gap.strip(" ." if roles[j - 1].initial else " "):
                        break
                    j += 1
                yield i, j
            i = j

    def match(self, roles: list[Role], i: int, end: int, cued: bool) -> tuple[int, float, str] | None:
        a, b, c, d = (roles[k] if k < end else NOBODY for k in range(i, i + 4))
        for size, evidence, fits, confidence in NAME_SHAPES:
            if i + size <= end and fits(a, b, c, cued):
                if evidence == "surname+first+patronymic" and not a.surname and d.family and not d.first:
                    return None  # the surname follows
                return size, confidence(a, b, c), evidence
        return None

    def is_public(self, words: list[Word], roles: list[Role]) -> bool:
        first = next((w.text for w, r in zip(words, roles, strict=True) if r.given), None)
        for w, r in zip(words, roles, strict=True):
            if r.patronymic or r.first or r.initial:
                continue
            for lemma in M.surname_lemmas(w.text):
                if lemma in self.lists.public:
                    expected = self.lists.public[lemma]
                    if expected is None or first is None or first in M.first_name_forms(expected):
                        return True
        return False

    def names(self, text: Text) -> tuple[list[Candidate], list[Role], list[tuple[int, int]]]:
        """Names by their shape, the words' roles, and the sorted folded spans that no lone surname may touch."""
        out: list[Candidate] = []
        if not _CYRILLIC_LETTER.search(text.folded):
            return out, [], []
        folded, words = text.folded, text.words
        roles = [self.role(text, i) for i in range(len(words))]
        strong: list[tuple[int, int]] = []  # folded spans
        for begin, end in self.runs(words, roles, folded):
            i = begin
            while i < end:
                cued = LONE_CUE.search(folded[max(0, words[i].start - 24) : words[i].start]) is not None
                got = self.match(roles, i, end, cued)
                if got is None:
                    r = roles[i]
                    if r.family and r.cap and cued:
                        strong.append((words[i].start, words[i].end))
                        out.append(Candidate(*text.span(*strong[-1]), "FIO", f32(0.7), "person", "surname+cue"))
                    i += 1
                    continue
                size, confidence, evidence = got
                last = words[i + size - 1].end
                last += roles[i + size - 1].initial and folded[last : last + 1] == "."
                span = text.span(words[i].start, last)
                if size > 1 and self.is_public(words[i : i + size], roles[i : i + size]):
                    out.append(Candidate(*span, PUBLIC_PERSON, 1.0, "person", "public_person"))
                else:
                    if size > 1:
                        strong.append((words[i].start, last))
                    scaled = min(f32(f32(f32(confidence) * self.scale) / f32(0.9)), 1.0)
                    out.append(Candidate(*span, "FIO", scaled, "person", evidence, size == 1))
                i += size
        return out, roles, sorted(strong)

    def surnames(self, text: Text, strong: list[tuple[int, int]]) -> set[str]:
        """Lemmas of the surnames of people that the text names in full."""
        known = set()
        for s, e in strong:
            for t in re.split(r"(?:[^\w-]|_)+", text.folded[s:e]):
                if len(t) >= 3 and t not in self.lists.nominative and not self.lists.is_patronymic(t):
                    known.update([x for x in M.surname_lemmas(t) if x in self.lists.surnames or M.surname_like(x)][:1])
        return known

    def lone(self, text: Text, roles: list[Role], strong: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[str]]]:
        """Places and lemmas of words by themselves that may be such a surname."""
        starts = [s for s, _ in strong]
        for w, r in zip(text.words, roles, strict=False):
            if not r.cyrillic or r.first or r.patronymic or not r.cap or r.length < 3:
                continue
            k = bisect_left(starts, w.end)
            if not (k and strong[k - 1][1] > w.start):
                yield *text.span(w.start, w.end), M.surname_lemmas(w.text)

    @staticmethod
    def named_again(known: set[str], lone) -> Iterator[Candidate]:
        """Lone surnames of people that the text names in full."""
        for start, end, lemmas in lone if known else ():
            if known.intersection(lemmas):
                yield Candidate(start, end, "FIO", f32(0.85), "person", "surname+coreference")

    def find(self, text: Text, places: list) -> Iterator[Candidate]:
        out, roles, strong = self.names(text)
        yield from out
        yield from self.named_again(self.surnames(text, strong), self.lone(text, roles, strong))


class CardHolderDetector:
    name = "card_holder"

    def __init__(self, config: Config, lists: Dictionaries):
        t = config.type("CARD_HOLDER")
        self.lists, self.context = lists, ContextRule(t.context if t else Context(), config.context_window)

    def find(self, text: Text, places: list) -> Iterator[Candidate]:
        words, folded = text.words, text.folded
        usable = [w.kind == LATIN and len(w.text) >= 2 and w.text not in NO_CARD_WORDS for w in words]
        i = 0
        while i < len(words):
            j = i + 1
            while usable[i] and j < len(words) and j - i < 3 and usable[j] and folded[words[j - 1].end : words[j].start] in ("", " ", "  "):
                j += 1
            if j - i >= 2:
                seq = words[i:j]
                named = any(w.text in self.lists.latin_names for w in seq)
                matched, _ = self.context.check(folded, seq[0].start, seq[-1].end)
                if named or matched or all(w.capitalized or w.all_caps for w in seq):
                    confidence = {(True, True): 0.95, (True, False): 0.85, (False, True): 0.8, (False, False): 0.55}[named, matched]
                    yield Candidate(*text.span(seq[0].start, seq[-1].end), "CARD_HOLDER", f32(confidence), "card_holder", "latin_name" if named else "latin_words", not named and not matched)
            i = j


# Grammars of places, issuers and addresses.
_MONTHS = "|".join(checks.MONTHS)
SETTLEMENT = r"(?:г\.|гор\.|город[ае]?|с\.|село|сел[ае]|пос\.|поселк[ае]|поселок|п\.|пгт|дер\.|деревн[яеи]|д\.|ст\.|станиц[ае]|хутор[е]?|аул[е]?|рп|г\b)\s*"
PLACE_STOP = frozenset("в во на и а но году года год семье семьи роддоме больнице период время".split())
BIRTH_DATE_HERE = re.compile(r"(?:\d{1,2}[./\-]\d{1,2}[./\-]\d{2,4}|\d{4}[./\-]\d{1,2}[./\-]\d{1,2}|\d{1,2}(?:-?го)?\s+[а-я]+\s+\d{4}|[а-я]+\s+\d{1,2},?\s+\d{4})\s*(?:г\.|года|г\b)?[\s,]*")
ISSUER = re.compile(r"\b(?:овд|оуфмс|уфмс|офмс|гу\s+мвд|мвд|омвд|умвд|овм|тп\s*№?\s*\d+|гувд|увд|фмс|мфц|паспортн\w+\s+стол\w*|отдел\w*\s+(?:внутренних|полиции|милиции|уфмс|офмс|мвд|по\s+вопросам\s+миграции)|отделени\w+\s+(?:уфмс|офмс|мвд|полиции|милиции|по\s+вопросам\s+миграции))")
ISSUER_STOP = re.compile(
    rf"\d{{2}}[./\-]\d{{2}}[./\-]\d{{2,4}}|\b\d{{1,2}}\s+(?:{_MONTHS})\b|\b(?:{_MONTHS})\s+\d{{1,2}},?\s+\d{{4}}|код\s+подр|к/п|\bкп\s*[:\-]?\s*\d|;|\n|\bпаспорт|\bсерия|\bномер\s+паспорта|\bпрожива|\bзарегистрирован|\bпрописан"
    r"|\bадрес|\bтел\b|\bтелефон|\bинн\b|\bснилс|\bдата\b|\bгражданств|\bместо\s+рождения|\bд\.р\.|\bродил|\bemail|\be-mail|\bпочта|\bкарт[аы]\b"
)
ISSUE_DATE_HERE = re.compile(rf"\s*(?:\d{{2}}[./\-]\d{{2}}[./\-]\d{{2,4}}|\d{{4}}[./\-]\d{{2}}[./\-]\d{{2}}|\d{{1,2}}\s+(?:{_MONTHS})\s+\d{{4}}|(?:{_MONTHS})\s+\d{{1,2}},?\s+\d{{4}})\s*(?:г\.|года|г\b)?[\s,]*")
ABBREVIATIONS = frozenset("г гор р-н ул п пос обл респ с д им св ст т тп отд п-ов м мкр".split())
ISSUER_BYTES = 160
_SETTLEMENT, _NAME_WORD = re.compile(SETTLEMENT), re.compile(r"[а-я][а-я\-]*")


def after_cue(folded: str, at: int) -> int:
    """Past the rest of the cue's word and the separators after it."""
    while at < len(folded) and folded[at].isalpha():
        at += 1
    while at < len(folded) and folded[at] in " :-\t":
        at += 1
    return at


class BirthPlaceDetector:
    name = "birth_place"

    def __init__(self, config: Config):
        t = config.type("BIRTH_PLACE")
        self.cue, self.confidence = any_of(t.context.before) if t and t.enabled else None, t.confidence if t else 0.0

    @staticmethod
    def capitalised(text: Text, at: int) -> int | None:
        """The end of up to three capitalised words."""
        end = None
        for _ in range(3):
            m = _NAME_WORD.match(text.folded, at)
            if m is None or m[0] in PLACE_STOP or not text.original[text.span(at, at)[0] :][:1].isupper():
                break
            end = m.end()
            if text.folded[end : end + 1] != " ":
                break
            at = end + 1
        return end

    def find(self, text: Text, places: list) -> Iterator[Candidate]:
        if self.cue is None:
            return
        folded, at_place = text.folded, {s: (e, kind) for s, e, kind in reversed(places)}
        for m in self.cue.finditer(folded):
            at = after_cue(folded, m.end())
            if (d := BIRTH_DATE_HERE.match(folded, at)) and folded.startswith(("в ", "во "), d.end()):
                at = d.end()
            for preposition in ("во ", "в "):
                at += len(preposition) if folded.startswith(preposition, at) else 0
            start, marker = at, _SETTLEMENT.match(folded, at)
            at = marker.end() if marker else at
            evidence, confidence, end = "cue+marker" if marker else "cue+gazetteer", f32(self.confidence), None
            if at in at_place:
                end = at_place[at][0]
                then = end + len(folded[end:]) - len(folded[end:].lstrip(", "))
                if then - end <= 3 and at_place.get(then, (0, CITY))[1] != CITY:  # its region or country
                    end = at_place[then][0]
            elif marker:
                word = _NAME_WORD.match(folded, at)
                end = self.capitalised(text, at) or (word.end() if word else None)
            else:
                end, evidence, confidence = self.capitalised(text, at), "cue+capitalised", f32(f32(self.confidence) - f32(0.15))
            if end is not None and end > start:
                yield Candidate(*text.span(start, end), "BIRTH_PLACE", confidence, "birth_place", evidence)


class CitizenshipDetector:
    name = "citizenship"

    def __init__(self, config: Config):
        t = config.type("CITIZENSHIP")
        self.cue, self.confidence = any_of(t.context.before) if t and t.enabled else None, t.confidence if t else 0.0

    def find(self, text: Text, places: list) -> Iterator[Candidate]:
        countries = [p for p in places if p[2] == COUNTRY]
        if self.cue is None or not countries:
            return
        for m in self.cue.finditer(text.folded):
            at = after_cue(text.folded, m.end())
            after = next((p for p in countries if at <= p[0] <= at + 1), None)
            before = next((p for p in countries if 0 <= m.start() - p[1] <= 1), None)
            if hit := after or before:
                yield Candidate(*text.span(hit[0], hit[1]), "CITIZENSHIP", f32(self.confidence), "citizenship", "cue+country")


class IssuerDetector:
    name = "issuer"

    def __init__(self, config: Config):
        t = config.type("PASSPORT_ISSUER")
        self.enabled, self.confidence = bool(t and t.enabled), t.confidence if t else 0.0
        self.cue = any_of(t.context.before) if t else None

    @staticmethod
    def phrase_end(text: Text, start: int) -> int:
        folded = text.folded
        limit = start + len(folded[start : start + ISSUER_BYTES].encode()[:ISSUER_BYTES].decode(errors="ignore"))
        if len(folded[start:limit].encode()) < ISSUER_BYTES and limit < len(folded):
            limit += 1  # the character that the limit falls into
        stop = ISSUER_STOP.search(folded[start:limit])
        end = start + stop.start() if stop else limit
        dot = folded.find(". ", start, end)
        while dot >= 0:
            word = re.split(r"(?:[^\w-]|_)", folded[start:dot])[-1]
            rest = folded[dot + 1 :]
            then = dot + 1 + len(rest) - len(rest.lstrip())
            if word not in ABBREVIATIONS and text.original[text.span(then, then)[0] :][:1].isupper():  # a sentence ends
                end = dot
                break
            dot = folded.find(". ", dot + 2, end)
        return start + len(folded[start:end].rstrip(" ,.:;-"))

    def find(self, text: Text, places: list) -> Iterator[Candidate]:
        if not self.enabled:
            return
        folded, starts = text.folded, []
        for m in self.cue.finditer(folded) if self.cue else ():
            at = m.end() + len(folded[m.end() :]) - len(folded[m.end() :].lstrip(" :-"))
            if d := ISSUE_DATE_HERE.match(folded, at):
                at = d.end()
            if folded[at : at + 1].isalpha() or folded[at : at + 1] in ("«", '"'):
                starts.append((at, f32(self.confidence), "cue+phrase"))
        starts += [(m.start(), f32(f32(self.confidence) - f32(0.1)), "anchor+phrase") for m in ISSUER.finditer(folded)]
        for at, confidence, evidence in starts:
            end = self.phrase_end(text, at)
            if end - at >= 3 and any(c.isalpha() for c in folded[at:end]):
                yield Candidate(*text.span(at, end), "PASSPORT_ISSUER", confidence, "issuer", evidence)


# Words that mark parts of an address, and those that may also name a street.
STREET_TYPES = frozenset("набережная проспект площадь бульвар шоссе аллея линия тракт дорога квартал микрорайон проезд переулок".split())
MARKERS = frozenset(
    "г гор город с село пос поселок п пгт дер деревня д дом ст станица рп ул улица пр-т пр просп проспект пер переулок наб набережная б-р бул бульвар ш шоссе пл площадь пр-д проезд аллея туп тупик линия мкр микрорайон кв-л квартал тракт дорога кв квартира "
    "оф офис пом помещение комн каб корп к корпус стр строение лит литера обл область край респ республика р-н район индекс адрес россия рф".split()
)
_NUMBER_TAIL = r"(?:[\s,]*(?:к\.|корп\.|корпус[ае]?|к\b)\s*\d+[а-я]?)?(?:[\s,]*(?:стр\.|строени[ея]|с\b|ст\.)\s*\d+)?"
GRAMMAR = {
    "index": r"\b[1-6]\d{5}\b",
    "index_marked": r"индекс\s*[:\-]?\s*(?P<v>\d{6})\b",
    "region_marker": r"\b(?:обл\.|область|обл\b|края|край|респ\.|республик[аи]|ао\b|автономн\w+\s+округ\w*|р-н|район[ае]?)",
    "settlement": r"\b(?:г\.|гор\.|город[ае]?|с\.|село|сел[ае]|пос\.|поселк[ае]|поселок|п\.|пгт|дер\.|деревн[яеи]|д\.|ст\.|станиц[ае]|рп|хутор[е]?|аул[е]?)\s*",
    "street": r"\b(?:ул\.|улиц[аеы]|ул\b|пр-т|пр\.|просп\.|проспект[ае]?|пер\.|переул\w+|наб\.|набережн\w+|б-р|бул\.|бульвар[ае]?|ш\.|шоссе|пл\.|площад[ьи]|пр-д|проезд[ае]?|алле[яе]|туп\.|тупик[ае]?|мкр\.|мкр\b|микрорайон[ае]?|кв-л|квартал[ае]?|тракт[ае]?|дорог[аеи]|въезд[ае]?|спуск[ае]?)\s*",
    "street_before": r"([а-я][а-я\-]+(?:\s+[а-я][а-я\-]+)?)\s*$",
    "numbered_line": r"\b\d{1,2}-?[яй]\s+лини[яи](?:\s+в\.?\s?о\.?)?",
    "house": rf"\b(?:д\.|дом[ае]?|д\b|№|n)\s*(?P<v>\d+\s?[а-я]?(?:/\d+)?)\b{_NUMBER_TAIL}(?:[\s,]*(?:лит\.|литер[аы]|лит\b)\s*[а-я]\b)?",
    "house_bare": rf"[\s,]*(?P<v>\d{{1,4}}\s?[а-я]?(?:/\d+)?)\b{_NUMBER_TAIL}",
    "apartment": r"\b(?:кв\.|квартир[аеы]|кв\b|оф\.|офис[ае]?|пом\.|помещени[ея]|комн\.|каб\.|ком\.)\s*(?P<v>\d+[а-я]?)\b",
    "word": r"[а-я0-9][а-я0-9\-]*",
}
NOT_A_STREET = tuple([*checks.MONTHS, "года", "лет", "-й", "-я", "-го"])
ADJECTIVE = ("ое", "ая", "ий", "ой", "ые", "ого")
INDEX, STREET, HOUSE, APARTMENT = "index", "street", "house", "apartment"
PART_TYPE = {COUNTRY: "ADDRESS_COUNTRY", INDEX: "ADDRESS_INDEX", REGION: "ADDRESS_REGION", CITY: "ADDRESS_CITY", STREET: "ADDRESS_STREET", HOUSE: "ADDRESS_HOUSE", APARTMENT: "ADDRESS_APARTMENT"}


@dataclass(frozen=True)
class Part:
    """A part of an address in the folded text; marked: found by its marker word."""

    start: int
    end: int
    kind: str
    marked: bool


class AddressDetector:
    name = "address"

    def __init__(self, config: Config):
        t = config.type("ADDRESS")
        self.enabled, self.confidence = bool(t and t.enabled), t.confidence if t else 0.0
        self.context = ContextRule(t.context if t else Context(), config.context_window)
        self.g = {k: re.compile(v) for k, v in GRAMMAR.items()}

    def name_end(self, folded: str, at: int, number_first: bool) -> int | None:
        """The end of up to three words of a name."""
        end = None
        for nth in range(3):
            m = self.g["word"].match(folded, at)
            if m is None:
                break
            if re.fullmatch("[0-9]+", m[0]):
                if nth or not number_first or not folded[m.end() :].lstrip().startswith(NOT_A_STREET):
                    break
            elif m[0] in MARKERS and not (nth == 0 and m[0] in STREET_TYPES):
                break
            end = m.end()
            if folded[end : end + 1] != " ":
                break
            at = end + 1
        return end

    def _region(self, folded: str, start: int, end: int) -> Part | None:
        """A region counts with its marker after or before it."""
        gap = len(folded[end:]) - len(folded[end:].lstrip())
        if m := self.g["region_marker"].match(folded, end + gap):
            return Part(start, m.end(), REGION, True)
        before = folded[max(0, start - 24) : start].rstrip()
        offset = max(0, start - 24)
        marks = list(self.g["region_marker"].finditer(before))
        return Part(offset + marks[-1].start(), end, REGION, True) if marks and marks[-1].end() == len(before) else None

    def _street_before(self, folded: str, m: re.Match) -> Part | None:
        """A name that stands before its marker."""
        offset = max(0, m.start() - 64)
        c = self.g["street_before"].search(folded[offset : m.start()])
        if c is None or any(w in MARKERS and w not in STREET_TYPES for w in (c[1], c[1].split(" ")[0])):
            return None
        return Part(offset + c.start(1), m.start() + len(m[0].rstrip()), STREET, True)

    def parts(self, text: Text, places: list) -> list[Part]:
        folded, g = text.folded, self.g
        found = [Part(*m.span(), INDEX, False) for m in g["index"].finditer(folded) if not digit_glued(folded, *m.span())]
        found += [Part(*m.span("v"), INDEX, True) for m in g["index_marked"].finditer(folded)]
        for start, end, kind in places:
            if kind == CITY or (kind == COUNTRY and not folded[start:end].endswith(ADJECTIVE)):
                found.append(Part(start, end, kind, False))
            elif kind == REGION and (p := self._region(folded, start, end)):
                found.append(p)
        for m in g["settlement"].finditer(folded):
            if m[0].rstrip() in ("д.", "д") and not folded[m.end() : m.end() + 1].isalpha():
                continue  # a house
            if (end := self.name_end(folded, m.end(), False)) is not None:
                found.append(Part(m.start(), end, CITY, True))
        for m in g["street"].finditer(folded):
            end = self.name_end(folded, m.end(), True)
            p = Part(m.start(), end, STREET, True) if end is not None else self._street_before(folded, m)
            found += [p] if p else []
        found += [Part(*m.span(), kind, True) for rule, kind in (("numbered_line", STREET), ("house", HOUSE), ("apartment", APARTMENT)) for m in g[rule].finditer(folded)]
        for street in [p for p in found if p.kind == STREET]:
            if m := g["house_bare"].match(folded, street.end):
                p = Part(m.start("v"), m.end(), HOUSE, True)
                if not any(x.kind == HOUSE and x.start < p.end and p.start < x.end for x in found):
                    found.append(p)
        kept: list[Part] = []
        for p in sorted(found, key=lambda p: (p.start, -p.end)):
            if kept and p.start < kept[-1].end:
                if not (p.marked and not kept[-1].marked and p.end >= kept[-1].end):
                    continue
                kept.pop()
            kept.append(p)
        return kept

    @staticmethod
    def chains(parts: list[Part], folded: str) -> Iterator[list[Part]]:
        chain: list[Part] = []
        for p in parts:
            if chain and not re.fullmatch("[ ,;.]{0,4}", folded[chain[-1].end : p.start]):
                yield chain
                chain = []
            chain.append(p)
        if chain:
            yield chain

    @staticmethod
    def is_address(chain: list[Part]) -> bool:
        kinds, marked = {p.kind for p in chain}, {p.kind for p in chain if p.marked}
        return bool(
            (STREET in kinds and kinds & {HOUSE, CITY, INDEX})
            or (CITY in marked and kinds & {HOUSE, INDEX, REGION})
            or (INDEX in kinds and kinds & {CITY, REGION})
            or {REGION, CITY, HOUSE} <= kinds
        )

    def find(self, text: Text, places: list) -> Iterator[Candidate]:
        if not self.enabled:
            return
        for chain in self.chains(self.parts(text, places), text.folded):
            start, end = chain[0].start, chain[-1].end
            matched, suppressed = self.context.check(text.folded, start, end)
            if suppressed:
                continue
            if self.is_address(chain) or (matched and (len(chain) >= 2 or any(p.kind == STREET and p.marked for p in chain))):
                confidence = min(f32(f32(self.confidence) + f32(0.05)), 1.0) if matched else f32(self.confidence)
                yield Candidate(*text.span(start, end), "ADDRESS", confidence, "address", "components+context" if matched else "components")
                for p in chain:
                    yield Candidate(*text.span(p.start, p.end), PART_TYPE[p.kind], confidence, "address", "component")
            elif len(chain) == 1 and chain[0].marked and chain[0].kind in (CITY, INDEX, STREET):
                yield Candidate(*text.span(start, end), PART_TYPE[chain[0].kind], f32(0.8 if matched else 0.55), "address", "lone_component", not matched)


class Detectors:
    """All detectors of a configuration; more may be given, as objects with `find(text, places)`."""

    def __init__(self, config: Config, lists: Dictionaries, more: tuple = ()):
        self.gazetteer = Gazetteer(lists.place_kinds)
        self.anywhere = [PatternDetector(config), DateDetector(config), CardHolderDetector(config, lists), AddressDetector(config), *more]
        self.person = PersonDetector(config, lists)
        self.cyrillic = [self.person, CitizenshipDetector(config), IssuerDetector(config)]
        self.birth_place = BirthPlaceDetector(config)

    def candidates(self, text: Text) -> list[Candidate]:
        places = self.gazetteer.find(text.folded) if re.search("[а-я]", text.folded) else []
        out: list[Candidate] = []
        for d in [*self.anywhere, *self.cyrillic, self.birth_place]:
            out += d.find(text, places)
        return out

    def of_piece(self, text: Text) -> tuple[list[Candidate], set[str], list[tuple[int, int, list[str]]]]:
        """Candidates of a piece of a longer text, the surnames that it names in full and the lone words that may be one of the text's."""
        places = self.gazetteer.find(text.folded) if re.search("[а-я]", text.folded) else []
        out, roles, strong = self.person.names(text)
        for d in [*self.anywhere, *self.cyrillic, self.birth_place]:
            if d is not self.person:
                out += d.find(text, places)
        return out, self.person.surnames(text, strong), list(self.person.lone(text, roles, strong))


def reweighted(c: Candidate, **changes) -> Candidate:
    return replace(c, **changes)
