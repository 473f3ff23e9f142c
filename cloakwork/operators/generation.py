"""A labelled corpus of Russian texts with invented personal data, from a seed.

Every record is a function of (seed, category, number), so a corpus of any size is
made where it is used and never collected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cloakwork.plans.catalog import PROFILES
from cloakwork.sources.dictionaries import Dictionaries, dictionaries
from cloakwork.sources.tables import GOLDEN

from . import checks
from .masking import STREETS, Choices, Masker, feminine, patronymic_of, with_inn, with_luhn
from .resolver import Entity

# What records are made of: a category for each kind of value, and words of our own around it.
CATEGORIES = "ADDRESS BANK_ACCOUNT BIRTH_DATE CARD_EXPIRY CARD_NUMBER CITIZENSHIP CVV DRIVER_LICENSE EMAIL FIO INN OMS_POLICY PASSPORT PASSPORT_ISSUER PHONE PIN SNILS SUBDIVISION_CODE".split()
ISSUERS = ("ОВД Октябрьского района г. Калуги", "УМВД России по Томской области", "отделением полиции № 4 г. Вологды", "ГУ МВД России по Иркутской области")
CITIZENSHIPS = ("Республика Армения", "Казахстан", "Российская Федерация", "Республика Узбекистан")
DOMAINS = ("pochta.example", "letters.example.org", "box.example.net", "mail.example.com")
GENERATED_CITIES = ("Калуга", "Вологда", "Томск", "Иркутск", "Псков", "Курск", "Тамбов", "Ижевск")
NEGATIVES = (
    "Композитор Пётр Чайковский жил в Клину с 1892 года.",
    "Музей открыт ежедневно с 10:00 до 18:00, касса закрывается в 17:30.",
    "Справочная служба отвечает круглосуточно, ожидание около 2 минут.",
    "Срок сдачи проекта назначен на 14.03.2027, приёмка через неделю.",
    "Накладная № 804517, вес 12,4 кг, мест 3.",
    "Обновление 7.2.0 ускоряет поиск на 35 процентов.",
    "Температура ночью опустится до 4 градусов, ветер 6 м/с.",
    "Никому не сообщайте пин-код и код CVV, даже сотрудникам службы поддержки.",
    "Лекция переносится на вторник, аудитория 214.",
    "Поезд 017А прибывает на третий путь.",
)

Piece = str | tuple[str, str]


class Values:
    """Invented values of each type."""

    def __init__(self, pick: Choices, lists: Dictionaries):
        self.pick, self.lists = pick, lists

    def _case(self, s: str) -> str:
        return (s, s.lower(), s.upper(), s)[self.pick.below(4)]

    def person(self) -> tuple[str, str, str]:
        female = bool(self.pick.below(2))
        first, father, surname = self.pick.of(self.lists.female if female else self.lists.male), self.pick.of(self.lists.male), self.pick.of(self.lists.synthetic_surnames)
        return tuple(x.capitalize() for x in (feminine(surname) if female else surname, first, patronymic_of(father, female)))

    def fio(self) -> str:
        s, f, p = self.person()
        form = self.pick.below(5)
        if form in (2, 3):
            return (f"{s} {f[0]}.{p[0]}.", f"{f[0]}. {p[0]}. {s}")[form - 2]
        return self._case((f"{s} {f} {p}", f"{f} {p} {s}", "", "", f"{s} {f}")[form])

    def phone(self) -> str:
        d = "9" + self.pick.digits(9)
        a, b, c, e = d[:3], d[3:6], d[6:8], d[8:]
        return (f"+7 {a} {b}-{c}-{e}", f"8 ({a}) {b}-{c}-{e}", f"+7{d}", f"8{d}", f"+7 ({a}) {b}-{c}-{e}", f"8-{a}-{b}-{c}-{e}")[self.pick.below(6)]

    def email(self) -> str:
        return self._case(f"{self.pick.of(('petr', 'olga', 'buyer', 'office'))}.{self.pick.between(10, 999)}@{self.pick.of(DOMAINS)}")

    def inn(self) -> str:
        d = with_inn(str(self.pick.between(1, 9)) + self.pick.digits(11), 12)
        return d if self.pick.below(10) >= 3 else d[:-1] + str((int(d[-1]) + 1) % 10)

    def card(self) -> str:
        d = with_luhn("4" + self.pick.digits(14))
        d = d if self.pick.below(10) >= 3 else d[:-1] + str((int(d[-1]) + 1) % 10)
        return d if self.pick.below(2) else " ".join((d[:4], d[4:8], d[8:12], d[12:]))

    def date(self) -> str:
        d, m, y = self.pick.between(1, 28), self.pick.between(1, 12), self.pick.between(1950, 2005)
        return (f"{d:02}.{m:02}.{y}", f"{y}-{m:02}-{d:02}", f"{d:02}/{m:02}/{y}", f"{d} {checks.MONTHS[m - 1]} {y}", f"{y}.{m:02}.{d:02}", f"{d:02}-{m:02}-{y}", f"{checks.MONTHS[m - 1]} {d}, {y}")[self.pick.below(7)]

    def passport(self) -> str:
        s, n = self.pick.digits(4), self.pick.digits(6)
        return (f"{s} {n}", f"{s[:2]} {s[2:]} {n}", f"{s} № {n}", f"{s[:2]} {s[2:]} № {n}", f"{s} номер {n}", f"{s}{n}")[self.pick.below(6)]

    def address(self) -> str:
        street = self.pick.of(STREETS)
        tail = f"д. {self.pick.between(1, 99)}"
        return (f"г. {self.pick.of(GENERATED_CITIES)}, ул. {street}, {tail}, кв. {self.pick.between(1, 200)}", f"{self.pick.between(101000, 699999)}, г. {self.pick.of(GENERATED_CITIES)}, ул. {street}, {tail}")[self.pick.below(2)]

    def licence(self) -> str:
        return (f"{self.pick.digits(2)} {self.pick.digits(2)} {self.pick.digits(6)}", f"{self.pick.digits(4)} {self.pick.digits(6)}", f"{self.pick.digits(2)} АА {self.pick.digits(6)}")[self.pick.below(3)]

    def snils(self) -> str:
        d = self.pick.digits(9)
        total = sum(int(c) * (9 - i) for i, c in enumerate(d))
        check = total if total < 100 else 0 if total in (100, 101) else total % 101 % 100
        return f"{d[:3]}-{d[3:6]}-{d[6:]} {check:02}"

    def policy(self) -> str:
        """Sixteen digits that are no card number."""
        d = self.pick.digits(16)
        return d[:-1] + str((int(d[-1]) + 1) % 10) if checks.luhn(d) else d

    def subdivision(self) -> str:
        return f"{self.pick.digits(3)}-{self.pick.digits(3)}"


def pieces(category: str, v: Values) -> list[Piece]:
    """A record's text, with labelled values."""
    fio = ("FIO", v.fio())
    made: dict[str, Callable[[], list[Piece]]] = {
        "ADDRESS": lambda: ["Посылку отправьте по адресу ", ("ADDRESS", v.address()), ", до обеда."],
        "BANK_ACCOUNT": lambda: ["Возврат придёт на расчётный счёт ", ("BANK_ACCOUNT", "40817" + v.pick.digits(15)), " завтра"],
        "BIRTH_DATE": lambda: ["В анкете указана дата рождения ", ("BIRTH_DATE", v.date()), ", проверьте"],
        "CARD_EXPIRY": lambda: ["Оплата с карты ", ("CARD_NUMBER", v.card()), " не прошла, срок действия ", ("CARD_EXPIRY", f"{v.pick.between(1, 12):02}/{v.pick.between(25, 32)}")],
        "CARD_NUMBER": lambda: ["Списание с карты ", ("CARD_NUMBER", v.card()), " повторилось, код CVV ", ("CVV", v.pick.digits(3))],
        "CITIZENSHIP": lambda: ["В графе гражданство: ", ("CITIZENSHIP", v.pick.of(CITIZENSHIPS)), "; остальное пусто"],
        "CVV": lambda: ["На обороте карты cvc ", ("CVV", v.pick.digits(3)), ", без него заказ не оплатить"],
        "DRIVER_LICENSE": lambda: ["Для проката нужно водительское удостоверение ", ("DRIVER_LICENSE", v.licence()), "."],
        "EMAIL": lambda: ["Чек пришлите на ", ("EMAIL", v.email()), " сегодня"],
        "FIO": lambda: ["Заявку подал ", fio, ", она на рассмотрении."],
        "INN": lambda: ["Договор подписал ", fio, ", его ИНН ", ("INN", v.inn())],
        "OMS_POLICY": lambda: ["Для записи к врачу возьмите полис ОМС ", ("OMS_POLICY", v.policy())],
        "PASSPORT": lambda: ["На стойке записали: ", fio, "; паспорт ", ("PASSPORT", v.passport())],
        "PASSPORT_ISSUER": lambda: ["Документ выдан ", ("PASSPORT_ISSUER", v.pick.of(ISSUERS)), " ", ("PASSPORT_ISSUE_DATE", f"{v.pick.between(1, 28):02}.{v.pick.between(1, 12):02}.{v.pick.between(2001, 2022)}")],
        "PHONE": lambda: ["Курьер позвонит по номеру телефона ", ("PHONE", v.phone()), " заранее"],
        "PIN": lambda: ["Забыл пин-код, кажется пин ", ("PIN", v.pick.digits(4)), "?"],
        "SNILS": lambda: ["В карточке сотрудника СНИЛС ", ("SNILS", v.snils()), " записан верно"],
        "SUBDIVISION_CODE": lambda: ["Скан страницы: паспорт ", ("PASSPORT", v.passport()), ", код подразделения ", ("SUBDIVISION_CODE", v.subdivision())],
        "NEGATIVE": lambda: [v.pick.of(NEGATIVES)],
    }
    return made[category]()


def assembled(parts: list[Piece]) -> tuple[str, list[Entity]]:
    text, entities = "", []
    for p in parts:
        if isinstance(p, tuple):
            entities.append(Entity(len(text), len(text) + len(p[1]), p[0], 1.0, "label"))
            p = p[1]
        text += p
    return text, entities


def record(seed: int, category: str, number: int, lists: Dictionaries, masker: Masker) -> dict:
    pick = Choices(hashlib.sha256(f"{seed}:{category}:{number}".encode()).hexdigest())
    text, entities = assembled(pieces(category, Values(pick, lists)))
    spans = [{"type": e.type, "start": e.start, "end": e.end} for e in entities]
    return {"id": f"{category.lower()}-{number:04}", "category": category, "text": text, "entities": spans, "masked": masker.mask(text, entities)[0]}


_RECORD = pa.schema([("id", pa.string()), ("category", pa.string()), ("text", pa.string()), ("entities", pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))), ("masked", pa.string())])


def generate(spark: SparkSession, per_category: int = 60, negatives: int = 20, seed: int = 42) -> DataFrame:
    """Labelled records (id, category, text, entities in code points, masked under the reference profile)."""
    wanted = [(c, per_category) for c in CATEGORIES] + [("NEGATIVE", negatives)]
    total = sum(n for _, n in wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = dictionaries()
        masker = Masker(PROFILES["reference"], lists)
        for batch in batches:
            rows = []
            for i in batch.column(0).to_pylist():
                for category, n in wanted:
                    if i < n:
                        rows.append(record(seed, category, i, lists, masker))
                        break
                    i -= n
            yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)

    return spark.range(total).mapInArrow(run, GOLDEN)
