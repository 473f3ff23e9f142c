"""Case forms of Russian names and places, from tables of endings."""

from __future__ import annotations

from itertools import product

# Endings by class of word.
_HUSHERS = tuple("кгхшчжщ")
_CONSONANTS = tuple("бвгджзклмнпрстфхцчшщ")
_A_HARD, _A_SOFT = "ы е у ой ою".split(), "и е у ой ою".split()
_MASCULINE = "а у ом е".split()
_FIRST_NAMES = [("ия", "и", "и ю ей ею е"), ("а", "", None), ("я", "", "и е ю ей ею"), ("й", "", "я ю ем е"), ("ь", "", "я ю ем е и ью")]
_PLACES = [
    ("ия", "и", "и ю ей ею"), ("ые", "", "ых ым ыми"), ("ие", "", "их им ими"), ("ий", "", "его ему им ем"), ("ый", "", "ого ому ым ом"), ("ой", "", "ого ому ым ом"),
    ("ая", "", "ой ую ою"), ("яя", "", "ей юю ею"), ("а", "", None), ("я", "", "и е ю ей"), ("ы", "", "ов ам ами ах"), ("ь", "", "и ю ем ью я"), ("й", "", "я ю ем е"),
]
_PATRONYMIC = {"ов": "ич ича ичу ичем иче на ны не ну ной", "ев": "ич ича ичу ичем иче на ны не ну ной", "ич": "на ны не ну ной", "инич": "на ны не ну ной"}
_SHORT_PATRONYMIC = tuple("ильич кузьмич лукич фомич никитич саввич мич".split())
_SURNAME_CASES = {
    "ов": "- а у ым е ой ых ыми", "ев": "- а у ым е ой ых ыми", "ин": "- а у ым е ой ых", "ын": "- а у ым е ой", "ск": "ий ая ого ому им ом ой ую их ими", "цк": "ий ая ого ому им ом ой ую их",
    "": "ых их ко енко ук юк чук як", "ян": "- а у ом е", "дзе": "-", "швили": "-", "ич": "- а у ем е", "ец": "-", "ц": "а у ем", "ер": "- а у ом", "ман": "- а у ом",
}
_LEMMAS = [
    *((f"{s}{e}", (s,)) for s, ends in (("ов", "а у ым е ой ых ыми"), ("ев", "а у ым е ой ых ыми"), ("ин", "а у ым е ой ых ыми"), ("ын", "а у ым е ой ых")) for e in ends.split()),
    *((f"{s}{e}", (f"{s}ий",)) for s, ends in (("ск", "ого ому им ом ая ой ую их ими"), ("цк", "ого ому им ом ая ой ую их")) for e in ends.split()),
    ("ого", ("ой", "ый", "ий")), ("ому", ("ой", "ый", "ий")), ("ая", ("ой", "ый", "ий")), ("ую", ("ой", "ый", "ий")), ("ым", ("ый", "ой")), ("им", ("ий",)), ("ых", ("ых", "ый", "ой")), ("их", ("их", "ий")),
    ("а", ("",)), ("у", ("",)), ("ом", ("",)), ("ем", ("",)), ("е", ("",)), ("я", ("ь", "й")), ("ю", ("ь", "й")), ("и", ("ь", "а", "я")),
]
_PATRONYMIC_BASE = [(s + e, s + base) for s, base, ends in (("ов", "ич", "ича ичу ичем иче"), ("ев", "ич", "ича ичу ичем иче"), ("ов", "на", "ны не ну ной"), ("ев", "на", "ны не ну ной"), ("ич", "на", "ны не ну ной"), ("", "ич", "ича ичу ичем")) for e in ends.split()]
_TRANSLITERATION = dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюя", "a b v g d e zh z i y k l m n o p r s t u f kh ts ch sh shch - y - e yu ya".split(), strict=True)) | {"ъ": "", "ь": ""}

_SURNAME_SUFFIXES = tuple(s + e.replace("-", "") for s, ends in _SURNAME_CASES.items() for e in ends.split())
_PATRONYMIC_SUFFIXES = tuple(s + e for s, ends in _PATRONYMIC.items() for e in ends.split())
TRANSLITERATION = {ord(k): v for k, v in _TRANSLITERATION.items()}


def fold_entry(s: str) -> str:
    """How list entries are folded: trimmed, lower case, ё as е."""
    return "".join(c.lower() for c in s.strip()).replace("ё", "е")


def transliterate(s: str) -> str:
    return s.translate(TRANSLITERATION)


def _decline(word: str, table) -> list[str]:
    for ending, kept, forms in table:
        if word.endswith(ending):
            stem = word[: -len(ending)]
            if forms is None:
                return [stem + e for e in (_A_SOFT if stem.endswith(_HUSHERS) else _A_HARD)]
            return [stem + kept + e for e in forms.split()]
    return []


def first_name_forms(name: str) -> list[str]:
    forms = _decline(name, _FIRST_NAMES)
    if not forms and name.endswith("ел"):  # a fleeting vowel, with the plain forms too
        forms = [name[:-2] + "л" + e for e in _MASCULINE] + [name + e for e in _MASCULINE]
    elif not forms and name.endswith(_CONSONANTS):
        forms = [name + e for e in (*_MASCULINE, "ем")]
    return [name, *forms, *(["льв" + e for e in _MASCULINE] if name == "лев" else [])]


def patronymic_forms(p: str) -> list[str]:
    if p.endswith("ич"):
        return [p, *(p + e for e in ("а", "у", "ем", "е"))]
    if p.endswith("на"):
        return [p, *(p[:-2] + e for e in ("ны", "не", "ну", "ной", "ною"))]
    return [p]


def is_patronymic_like(t: str) -> bool:
    if len(t) < 5:
        return False
    return t.endswith(_PATRONYMIC_SUFFIXES) or (t.startswith(_SHORT_PATRONYMIC) and t.endswith(("ич", "ича", "ичу", "ичем", "иче")))


def patronymic_base(t: str) -> str:
    return next((t[: -len(s)] + base for s, base in _PATRONYMIC_BASE if t.endswith(s)), t)


def surname_lemmas(t: str) -> list[str]:
    """The token, then what it may be a case form of."""
    made = [t[: -len(s)] + r for s, endings in _LEMMAS if t.endswith(s) and len(t) - len(s) >= 2 for r in endings]
    return list(dict.fromkeys([t, *made]))


def surname_like(t: str) -> bool:
    return len(t) >= 4 and any(t.endswith(s) and len(t) > len(s) + 1 for s in _SURNAME_SUFFIXES)


def _place_word_forms(word: str) -> list[str]:
    head, dash, tail = word.rpartition("-")
    if dash and len(tail) > 3 and head != "ростов":
        return [word, *(f"{head}-{f}" for f in _place_word_forms(tail)[1:])]
    if len(word) < 3:
        return [word]
    forms = _decline(word, _PLACES)
    if not forms and word.endswith(_CONSONANTS):
        forms = [word + e for e in _MASCULINE]
    return [word, *forms]


def place_forms(name: str) -> list[str]:
    return [" ".join(x) for x in product(*map(_place_word_forms, name.split(" ")))]
