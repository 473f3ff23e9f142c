"""Types of personal data, masking strategies, profiles and systems.

Patterns run on folded text (lower case, no ё). `{B}` stands for a word boundary
between ASCII characters; the value is the group `v`, or the whole match.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

#: A boundary of an ASCII word, in the syntax that Java and Python share.
BOUNDARY = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
DEFAULT_WINDOW, MIN_CONFIDENCE, BOOST = 48, 0.5, 0.15


class ConfigError(ValueError):
    """A configuration that can't be used."""


@dataclass(frozen=True)
class Pattern:
    regex: str
    requires_context: bool = False
    confidence: float | None = None

    @property
    def source(self) -> str:
        return self.regex.replace("{B}", BOUNDARY).replace("(?-u:\\b)", BOUNDARY)


@dataclass(frozen=True)
class Context:
    before: tuple[str, ...] = ()
    after: tuple[str, ...] = ()
    suppress: tuple[str, ...] = ()
    window: int = 0
    required: bool = False
    boost: float = BOOST


@dataclass(frozen=True)
class TypeDef:
    id: str
    patterns: tuple[Pattern, ...] = ()
    validator: str = "none"
    length: tuple[int, int] = (0, 0)
    context: Context = Context()
    confidence: float = 0.9
    priority: int = 0
    enabled: bool = True
    digit_boundary: bool = True
    weak: bool = False
    soft_validator: bool = False
    companions: tuple[str, ...] = ()
    group: str = ""
    description: str = ""
    builtin: bool = False


def _type(id: str, confidence: float, priority: int, group: str, *patterns, before=(), after=(), suppress=(), window=0, **more) -> TypeDef:
    made = tuple(p if isinstance(p, Pattern) else Pattern(p) for p in patterns)
    return TypeDef(id, made, confidence=confidence, priority=priority, group=group, context=Context(tuple(before), tuple(after), tuple(suppress), window), builtin=not made, **more)


# The grammars, cue words, confidences and priorities that results depend on.
TYPES: tuple[TypeDef, ...] = (
    _type("EMAIL", 0.98, 100, "contact", r"[a-z0-9а-я._%+\-]+@[a-z0-9а-я\-]+(?:\.[a-z0-9а-я\-]+)*\.(?:[a-z]{2,}|рф)", digit_boundary=False),
    _type(
        "PHONE", 0.92, 80, "contact",
        r"(?:\+7|{B}[78])[\s\-]?\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}{B}",
        r"\+\d{1,3}[\s\-]?\(?\d{2,4}\)?[\s\-]?\d{2,3}[\s\-]?\d{2,3}(?:[\s\-]?\d{2,3})?{B}",
        r"\(\d{3,5}\)[\s\-]?\d{2,3}[\s\-]?\d{2}[\s\-]?\d{2}{B}",
        Pattern(r"{B}\d{3}[\s\-]\d{2}[\s\-]\d{2}{B}", True, 0.8),
        validator="phone",
        before=["тел", "телефон", "моб", "сот", "звон", "номер", "phone", "whatsapp", "telegram", "контакт", "связ"],
        suppress=[r"горяч\w+\s+лини", r"служб\w+\s+поддержки", "колл-центр", "call-центр", "контакт-центр", r"справочн\w+\s+служб"],
    ),
    _type("INN", 0.9, 70, "tax", r"{B}\d{12}{B}", Pattern(r"{B}\d{10}{B}", True), validator="inn", soft_validator=True, before=["инн", "налогоплательщик", r"идентификационн\w+\s+номер"]),
    _type(
        "CARD_NUMBER", 0.9, 90, "card",
        r"{B}\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{2,7}{B}", r"{B}\d{4}[ \-]\d{6}[ \-]\d{5}{B}", r"{B}\d{13,19}{B}",
        validator="luhn", soft_validator=True, before=["карт", "card", "номер", "pan", "visa", "mastercard", "мир"],
    ),
    _type("CVV", 0.95, 95, "card", r"(?:cvv2?|cvc2?|cvp2?|cvv[\s\-]?код\w*|cvc[\s\-]?код\w*|код\s+безопасности|код\s+на\s+обороте|три\s+цифры\s+на\s+обороте|защитн\w+\s+код\w*|security\s+code)\s*(?:карты|card)?\s*[:\-=]?\s*(?P<v>\d{3,4}){B}"),
    _type("PIN", 0.95, 95, "card", r"(?:пин[\s\-]?код\w*|пин|pin[\s\-]?code|pin)\s*(?:карты|от\s+карты|card)?\s*[:\-=]?\s*(?P<v>\d{4,6}){B}"),
    _type(
        "CARD_EXPIRY", 0.8, 55, "card",
        r"(?:срок\s+действия|действительна\s+до|годна\s+до|valid\s+thru|exp(?:iry|ires|\.)?)\s*(?:карты)?\s*[:\-]?\s*(?P<v>(?:0[1-9]|1[0-2])\s?/\s?\d{2,4}){B}",
        Pattern(r"{B}(?P<v>(?:0[1-9]|1[0-2])/\d{2}){B}", True),
        before=["карт", "card", "cvv", "cvc"], weak=True, companions=("CARD_NUMBER", "CVV"),
    ),
    _type(
        "PASSPORT", 0.92, 85, "passport",
        r"(?:паспорт\w*|серия|сер\.)\s*(?:рф|гражданина\s+рф|гражданина\s+россии|россии)?\s*[:№#]?\s*(?P<v>\d{2}\s?\d{2}\s*(?:№|номер|n|no\.?|#)?\s*[:\-]?\s*\d{6}){B}",
        Pattern(r"{B}(?P<v>\d{2}\s?\d{2}[\s\-]\d{6}){B}", confidence=0.75), Pattern(r"{B}(?P<v>\d{10}){B}", True),
        before=["паспорт", "серия", r"сер\.", "документ", "удостоверени", r"пасп\."], after=["выдан", r"код\s+подразд"],
    ),
    _type(
        "SUBDIVISION_CODE", 0.95, 86, "passport",
        r"(?:код\s+подразделения|код\s+подр\.?|к/п|кп)\s*[:\-]?\s*(?P<v>\d{3}[\s\-]?\d{3}){B}", Pattern(r"{B}(?P<v>\d{3}-\d{3}){B}", confidence=0.7),
        weak=True, companions=("PASSPORT", "PASSPORT_ISSUER", "PASSPORT_ISSUE_DATE"), before=[r"код\s+подразделения", r"код\s+подр", "к/п", "паспорт", "выдан"],
    ),
    _type(
        "DRIVER_LICENSE", 0.92, 84, "documents",
        r"(?:водительск\w*\s+удостоверени\w*|в/у|ву|вод\.\s*удост\.|права|удостоверени\w+\s+водителя|driver's?\s+licen[cs]e)\s*(?:№|номер|n)?\s*[:\-]?\s*(?P<v>\d{2}\s?(?:\d{2}|[а-я]{2}|[a-z]{2})\s?[№#]?\s?\d{6}){B}",
        Pattern(r"{B}(?P<v>\d{2}\s?[а-я]{2}\s?\d{6}){B}", confidence=0.8),
        before=["водительск", "в/у", "ву", "права", "удостоверени", "driver"],
    ),
    _type("SNILS", 0.92, 88, "documents", r"{B}(?P<v>\d{3}-\d{3}-\d{3}[\s\-]?\d{2}){B}", Pattern(r"{B}(?P<v>\d{11}){B}", True), validator="snils", soft_validator=True, before=["снилс", r"страхов\w+\s+номер", "пенсионн"]),
    _type("FOREIGN_PASSPORT", 0.92, 84, "documents", r"(?:загранпаспорт\w*|заграничн\w+\s+паспорт\w*|загран\.?\s*паспорт\w*|загран\w*)\s*(?:рф)?\s*[:№#]?\s*(?P<v>\d{2}\s?[№#]?\s?\d{7}){B}"),
    _type("MILITARY_ID", 0.92, 84, "documents", r"(?:военн\w+\s+билет\w*|воен\.?\s*билет\w*)\s*[:№#]?\s*(?P<v>[а-я]{2}\s?[№#]?\s?\d{6,7}){B}"),
    _type("BIRTH_CERTIFICATE", 0.92, 84, "documents", r"(?:свидетельств\w+\s+о\s+рождении|св-во\s+о\s+рождении)\s*[:№#]?\s*(?P<v>[ivxlc]+[\s\-]?[а-я]{2}\s*[№#]?\s*\d{6}){B}"),
    _type("RESIDENCE_PERMIT", 0.92, 84, "documents", r"(?:внж|вид\s+на\s+жительство)\s*[:№#]?\s*(?P<v>\d{2}\s?[№#]?\s?\d{7}){B}"),
    _type("OMS_POLICY", 0.9, 83, "documents", r"(?:полис\w*\s*(?:омс)?|омс)\s*[:№#]?\s*(?P<v>\d{16}){B}", validator="digits_len", length=(16, 16)),
    _type("BANK_ACCOUNT", 0.88, 89, "bank", r"{B}(?P<v>4(?:08|23|05|07|09|06|30|26|21)\d{2}\s?\d{3}\s?\d\s?\d{4}\s?\d{7}){B}", before=["счет", "счёт", "р/с", "л/с", "account", "реквизит"]),
    _type(
        "FIO", 0.9, 65, "person",
        before=["клиент", "гражданин", "гражданк", "заявител", "фио", r"ф\.и\.о", "получател", "отправител", "плательщик", "держател", r"на\s+имя", "г-н", "г-жа", "господин", "госпожа", "сотрудник", "заемщик", "заёмщик", "вкладчик", "владелец", "пациент", "абонент", "пользовател", "покупател", "продавец", "арендатор", "доверител", "представител", "зовут", "имя", "фамили", "отчеств", "уважаем"],
        suppress=["поэт", "писател", "композитор", "художник", "учен", "учён", "актер", "актёр", "актрис", "режиссер", "режиссёр", "император", "царь", "царица", "княз", "президент", "генерал", "маршал", "полководец", "философ", "святой", "изобретател", "космонавт", "музыкант", "певец", "певица", "поэтесс", "драматург", "классик", "автор", "лауреат", "академик", "профессор", "основател", "памятник", "имени", r"им\.", "музей", "театр", "библиотек", "улиц", "площад", "проспект", "станци", "метро"],
    ),
    _type("CARD_HOLDER", 0.9, 66, "card", before=["держател", "holder", "cardholder", r"card\s+holder", r"имя\s+на\s+карте", r"на\s+имя", r"владелец\s+карты", "name"]),
    _type(
        "BIRTH_DATE", 0.95, 60, "person",
        before=[r"дата\s+рождения", r"д\.\s?р\.", "д/р", "родил(?:ся|ась|ись)", "рожден", r"день\s+рождения", "birth", "born"],
        after=[r"^\s*(?:г\.?\s?р\.?|года\s+рождения|г\.\s*рождения)"], window=64,
    ),
    _type("PASSPORT_ISSUE_DATE", 0.95, 60, "passport", before=["выдан", r"дата\s+выдачи", "выдач", "issued"], window=64),
    _type("DATE", 0.6, 50, "person", weak=True, companions=("FIO", "PASSPORT", "BIRTH_PLACE", "CITIZENSHIP", "SNILS", "INN", "DRIVER_LICENSE", "PASSPORT_ISSUER", "SUBDIVISION_CODE")),
    _type(
        "BIRTH_PLACE", 0.92, 72, "person",
        before=[
            r"место\s+рождения", r"м\.\s?р\.", r"родил(?:ся|ась|ись)\s+в",
            r"родил(?:ся|ась|ись)\s+(?:\d{1,2}[./\-]\d{1,2}[./\-]\d{2,4}|\d{4}[./\-]\d{1,2}[./\-]\d{1,2}|\d{1,2}(?:-?го)?\s+[а-я]+\s+\d{4})\s*(?:г\.|года|г{B})?\s*в",
            "уроженец", "уроженка", r"родом\s+из", r"place\s+of\s+birth",
        ],
    ),
    _type("CITIZENSHIP", 0.92, 72, "passport", before=["гражданств", "гражданин", "гражданка", "подданств", "подданный", "подданная", "citizenship", "nationality"]),
    _type("PASSPORT_ISSUER", 0.9, 73, "passport", before=["выдан", r"кем\s+выдан", r"орган,?\s+выдавш", r"выдавш\w+\s+орган", r"issued\s+by"]),
    _type(
        "ADDRESS", 0.9, 75, "address",
        before=["адрес", "прожива", "зарегистрирован", "прописан", "регистраци", r"место\s+жительства", "доставк", "проживающ", "зарегистрированн"],
        suppress=["отделени", "офис", "филиал", "банкомат", r"головн\w+\s+офис", r"до\s+№", r"дополнительн\w+\s+офис", "представительств", "магазин", r"пункт\s+выдачи", "терминал"],
    ),
    *(_type(f"ADDRESS_{part}", 0.9, 74, "address", weak=part == "CITY") for part in ("COUNTRY", "INDEX", "REGION", "CITY", "STREET", "HOUSE", "APARTMENT")),
)

ADDRESS_PARTS = tuple(t.id for t in TYPES if t.id.startswith("ADDRESS_"))

# Types whose identity is their digits, and types that show two digits at either end.
NUMERIC = ("PHONE", "CARD_NUMBER", "INN", "PASSPORT", "SNILS", "SUBDIVISION_CODE", "DRIVER_LICENSE", "CVV", "PIN", "ADDRESS_INDEX", "BANK_ACCOUNT", "OMS_POLICY", "FOREIGN_PASSPORT", "RESIDENCE_PERMIT", "MILITARY_ID", "BIRTH_CERTIFICATE", "CARD_EXPIRY")
SHOW_ENDS = ("PASSPORT", "CARD_NUMBER", "PHONE", "INN", "SNILS", "DRIVER_LICENSE", "SUBDIVISION_CODE", "BANK_ACCOUNT", "OMS_POLICY", "FOREIGN_PASSPORT", "RESIDENCE_PERMIT", "MILITARY_ID", "BIRTH_CERTIFICATE")


@dataclass(frozen=True)
class Strategy:
    """kind: initials, partial, full, placeholder, synthetic, token or remove."""

    kind: str = "full"
    with_dots: bool = True
    keep_start: int = 2
    keep_end: int = 2
    fill: str = "*"
    mask_chars: str = "alnum"
    template: str = "<{type}_{n}>"
    prefix: str = "tok_"
    length: int = 12

    KINDS = ("initials", "partial", "full", "placeholder", "synthetic", "token", "remove")

    @classmethod
    def of(cls, spec: Any) -> Strategy:
        """A strategy from a name or {"kind": name, ...}."""
        if isinstance(spec, Strategy):
            return spec
        spec = {"kind": spec} if isinstance(spec, str) else dict(spec)
        kind = spec.pop("kind", None)
        if kind not in cls.KINDS:
            raise ConfigError(f"unknown masking strategy {kind!r}")
        try:
            return cls(kind, **spec)
        except TypeError as e:
            raise ConfigError(f"strategy {kind}: {e}") from None


@dataclass(frozen=True)
class Profile:
    default: Strategy = Strategy()
    types: dict[str, Strategy] = field(default_factory=dict)
    description: str = ""

    def strategy(self, type_id: str) -> Strategy:
        return self.types.get(type_id, self.default)


PROFILES: dict[str, Profile] = {
    "reference": Profile(Strategy(), {**dict.fromkeys(("FIO", "CARD_HOLDER"), Strategy("initials")), **dict.fromkeys(SHOW_ENDS, Strategy("partial", mask_chars="digits"))}, "initials for names, the ends of numbers, stars for the rest"),
    "placeholder": Profile(Strategy("placeholder"), description="numbered placeholders"),
    "synthetic": Profile(Strategy("synthetic"), description="plausible invented values"),
    "token": Profile(Strategy("token"), description="keyed tokens"),
    "full": Profile(Strategy(), description="stars"),
}


@dataclass(frozen=True)
class Combination:
    mask: str
    only_if_present: tuple[str, ...]
    window: int = 0


@dataclass(frozen=True)
class System:
    """Who asks: which types are masked how, and whether they may be restored."""

    id: str
    enabled: bool = True
    api_keys: tuple[str, ...] = ()
    anonymous: bool = False
    pii_types: tuple[str, ...] | str = "all"
    exclude_types: tuple[str, ...] = ()
    demask: bool = True
    profile: str = "reference"
    overrides: dict[str, Any] = field(default_factory=dict)
    combination_rules: tuple[Combination, ...] = ()
    weak_entities: str = "context_only"
    address_mode: str = "whole"
    min_confidence: float | None = None


@dataclass(frozen=True)
class Allowlists:
    public_persons: tuple[str, ...] = ()
    public_addresses: tuple[str, ...] = ()
    public_phones: tuple[str, ...] = ()
    public_phone_prefixes: tuple[str, ...] = ("8800", "7800")
    corporate_email_domains: tuple[str, ...] = ()


@dataclass(frozen=True)
class Config:
    types: tuple[TypeDef, ...] = TYPES
    profiles: dict[str, Profile] = field(default_factory=lambda: dict(PROFILES))
    systems: tuple[System, ...] = (System("default", anonymous=True),)
    allowlists: Allowlists = Allowlists()
    secret: str = ""
    context_window: int = DEFAULT_WINDOW
    min_confidence: float = MIN_CONFIDENCE
    dictionary_dir: str | None = None
    dictionary_extra: tuple[tuple[str, str], ...] = ()

    def __post_init__(self):
        ids = [s.id for s in self.systems]
        if len(set(ids)) < len(ids):
            raise ConfigError("two systems have the same id")
        if sum(s.anonymous and s.enabled for s in self.systems) > 1:
            raise ConfigError("only one system may be anonymous")
        for s in self.systems:
            if s.profile not in self.profiles:
                raise ConfigError(f"unknown profile {s.profile!r} of system {s.id!r}")
            if s.weak_entities not in ("context_only", "always", "never") or s.address_mode not in ("whole", "components"):
                raise ConfigError(f"system {s.id!r}: unknown policy")

    def system(self, id: str) -> System:
        for s in self.systems:
            if s.id == id:
                return s
        raise ConfigError(f"unknown system {id!r}")

    def profile_of(self, system: System) -> Profile:
        base = self.profiles[system.profile]
        return replace(base, types={**base.types, **{k: Strategy.of(v) for k, v in system.overrides.items()}})

    def allowed(self, system: System) -> frozenset[str]:
        every = [t.id for t in self.types if t.enabled]
        wanted = every if isinstance(system.pii_types, str) and system.pii_types.lower() == "all" else system.pii_types
        return frozenset(t for t in every if t in wanted and t not in system.exclude_types)

    def type(self, id: str) -> TypeDef | None:
        return next((t for t in self.types if t.id == id), None)


def with_types(base: tuple[TypeDef, ...], own: list[TypeDef]) -> tuple[TypeDef, ...]:
    """Own definitions replace those of the same id in place; others follow."""
    by_id = {t.id: t for t in own}
    return tuple(by_id.pop(t.id, t) for t in base) + tuple(by_id.values())
