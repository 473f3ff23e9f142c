"""Hand-written cases: texts of our own with what they become under the reference profile. Clean ones stay as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cloakwork.plans.catalog import Allowlists, Config, System

#: What the cases take as public.
ALLOW = Allowlists(public_addresses=("г. Калуга, ул. Рябиновая, д. 14",), corporate_email_domains=("staff.example",))

MASKED = [
    ("На приём записана Соколова Мария Петровна, её паспорт 6104 778301", "На приём записана С. М. П., её паспорт 61** ****01"),
    ("соколова мария петровна просит копию, паспорт 6104 778301", "С. М. П. просит копию, паспорт 61** ****01"),
    ("СОКОЛОВА МАРИЯ ПЕТРОВНА, ПАСПОРТ 6104 778301", "С. М. П., ПАСПОРТ 61** ****01"),
    ("Мария Петровна Соколова оставила телефон 8 (913) 640-27-58", "М. П. С. оставила телефон 8 (9**) ***-**-58"),
    ("Подпись: Орлов Д.С., ИНН 526317984689", "Подпись: О. Д. С., ИНН 52********89"),
    ("За рулём был Д. С. Орлов, второй водитель не указан", "За рулём был Д. С. О., второй водитель не указан"),
    ("Дата рождения в бланке 23.11.1974", "Дата рождения в бланке **.**.****"),
    ("Мальчик родился 4 марта 2009 г. в г. Пскове", "Мальчик родился * ***** **** г. в *. ******"),
    ("родилась третьего июня тысяча девятьсот шестьдесят первого года", "родилась ******** **** ****** ********* ********** ******* года"),
    ("д.р. 1991-02-28, а паспорт выдан 2011-09-07", "д.р. ****-**-**, а паспорт выдан ****-**-**"),
    ("Бланк: паспорт серия 6104 номер 778301", "Бланк: паспорт серия 61** номер ****01"),
    ("новый паспорт: серия 61 04 № 778301, выдан ОВД Октябрьского района г. Калуги 07.09.2011, код подразделения 402-015", "новый паспорт: серия 61 ** № ****01, выдан *** ************ ****** *. ****** **.**.****, код подразделения 40*-*15"),
    ("Указан паспорт 6104778301, к/п 402-015, гражданство Казахстан", "Указан паспорт 61******01, к/п 40*-*15, гражданство *********"),
    ("документ выдан УМВД России по Томской области 19.12.2020", "документ выдан **** ****** ** ******* ******* **.**.****"),
    ("гражданка Республики Армения Орлова Нина Борисовна", "гражданка ********** ******* О. Н. Б."),
    ("Прокат: водительское удостоверение 40 ВВ 305172 выдано 11.08.2016", "Прокат: водительское удостоверение 40 ВВ ****72 выдано **.**.****"),
    ("Доставка: 634050, Россия, г. Томск, ул. Кленовая, д. 31, корп. 3, кв. 8", "Доставка: ******, ******, *. *****, **. ********, *. **, ****. *, **. *"),
    ("Живёт: Калужская обл., г. Обнинск, ул. Парковая, д. 9, кв. 44", "Живёт: ********* ***., *. *******, **. ********, *. *, **. **"),
    ("прописан по адресу г. Самара, Луговая ул., д. 2", "прописан по адресу *. ******, ******* **., *. *"),
    ("Пишите: 191028, Санкт-Петербург, Литейный пр-т, д. 5", "Пишите: ******, *****-*********, ******** **-*, *. *"),
    ("Контакты: Orlova.Nina@Box.RU либо nina_orlova@почта.рф", "Контакты: ******.****@***.** либо ****_******@*****.**"),
    ("Звонить: +7 913 640-27-58, 89136402758, +375 33 604 12 90", "Звонить: +7 9** ***-**-58, 89*******58, +37* ** *** ** 90"),
    ("ИНН 526317984689 у предпринимателя, ИНН 5408130693 у фирмы", "ИНН 52********89 у предпринимателя, ИНН 54******93 у фирмы"),
    ("Оплата картой 5536 9137 0000 0005, запасная 4000056655665556, CVV 907, пин-код 1150, держатель NINA ORLOVA, срок действия 08/29", "Оплата картой 55** **** **** **05, запасная 40************56, CVV ***, пин-код ****, держатель N. O., срок действия **/**"),
    ("СНИЛС 160-722-394 47, загранпаспорт 75 4419063, полис ОМС 7700123456789015", "СНИЛС 16*-***-*** 47, загранпаспорт 75 *****63, полис ОМС 77************15"),
    ("Орлова Нина Борисовна и Соколов Пётр Ильич подписали акт; Соколову перезвонить на +7 913 640-27-58", "О. Н. Б. и С. П. И. подписали акт; С. перезвонить на +7 9** ***-**-58"),
]
CLEAN = [
    "Накладная 5536 9137 0000 0005 закрыта, трек 526317984680",
    "Писатель Антон Чехов родился 29 января 1860 года в Таганроге",
    "Композитор Пётр Чайковский написал музыку к балету",
    "Пункт выдачи по адресу г. Калуга, ул. Рябиновая, д. 14 закрыт на обед",
    "Пишите в поддержку help@staff.example в любое время",
    "Никому не называйте пин-код, код CVV нужен только банку",
    "Итого 2 350 000 руб. за 24 мес. под 11,2%, счёт № 804517 от 03.04.2025",
    "В Самаре достроили мост на улице Гагарина",
    "Поставка придёт 22.12.2026 вечером, время 19:30",
    "Площадь Победы, улица Кирова и станция метро Спортивная",
]


def config() -> Config:
    return Config(systems=(System("default", anonymous=True),), allowlists=ALLOW)


def curated_cases(spark: SparkSession) -> DataFrame:
    """(case, text, expected) of all cases."""
    return spark.createDataFrame([(i, t, m) for i, (t, m) in enumerate([*MASKED, *((t, t) for t in CLEAN)])], "case long, text string, expected string")
