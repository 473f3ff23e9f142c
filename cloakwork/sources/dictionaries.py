"""Word lists: names, places and public persons.

The lists here are short; a directory with the usual files adds to them:
first_names_male.txt, first_names_female.txt, first_names_diminutive.txt,
patronymics.txt, surnames.txt, cities_ru.txt, cities_world.txt, regions_ru.txt,
countries.txt (forms separated by |) and public_persons.txt (surname|first|patronymic).
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.operators import morphology as M

# Common names and places. Longer lists come from a directory.
MALE = "александр алексей анатолий андрей антон аркадий артем борис вадим валентин валерий василий виктор виталий владимир владислав вячеслав геннадий георгий герман григорий даниил денис дмитрий евгений егор иван игорь илья кирилл константин лев леонид максим марк матвей михаил николай никита олег павел петр роман руслан савелий сергей семен станислав степан тимофей федор филипп юрий яков ярослав".split()
FEMALE = "алина алла анастасия ангелина анна антонина валентина валерия варвара вера вероника виктория галина дарья евгения екатерина елена елизавета жанна зинаида зоя инна ирина карина кира клавдия ксения лариса лидия любовь людмила маргарита марина мария надежда наталья нина оксана ольга полина раиса светлана софия тамара татьяна ульяна юлия яна".split()
DIMINUTIVE = "саша маша катя лена ваня петя коля миша даша настя оля таня юля аня дима паша рома юра сеня вика лиза ира женя вася".split()
SURNAMES = "иванов петров сидоров смирнов кузнецов попов соколов лебедев козлов новиков морозов волков зайцев павлов семенов голубев виноградов богданов воробьев федоров михайлов беляев тарасов белов комаров орлов киселев макаров андреев ковалев ильин гусев титов кузьмин кудрявцев баранов куликов алексеев степанов яковлев сорокин сергеев романов захаров борисов королев герасимов пономарев григорьев лазарев медведев ершов никитин соболев рябов поляков цветков данилов жуков фролов журавлев николаев крылов максимов осипов белоусов федотов дорофеев егоров матвеев бобров дмитриев калинин анисимов петухов антонов тимофеев никифоров веселов филиппов марков большаков суханов миронов ширяев александров коновалов шестаков казаков ефимов денисов громов фомин давыдов мельников щербаков блинов колесников карпов афанасьев власов маслов исаков тихонов аксенов гаврилов родионов котов горбунов кудряшов быков зуев третьяков савельев панов рыбаков суворов абрамов воронов мухин архипов трофимов мартынов емельянов горшков чернов овчинников селезнев панфилов копылов михеев галкин назаров лобанов лукин беляков потапов некрасов хохлов жданов наумов шилов воронцов ермаков дроздов игнатьев савин логинов сафонов капустин кириллов моисеев елисеев кошелев костин горбачев орехов ефремов исаев евдокимов калашников кабанов носков юдин кулагин лапин прохоров нестеров харитонов агафонов муравьев ларионов".split()
CITIES = "москва|санкт-петербург|новосибирск|екатеринбург|казань|нижний новгород|челябинск|самара|омск|ростов-на-дону|уфа|красноярск|воронеж|пермь|волгоград|краснодар|саратов|тюмень|тольятти|ижевск|барнаул|ульяновск|иркутск|хабаровск|ярославль|владивосток|махачкала|томск|оренбург|кемерово|новокузнецк|рязань|астрахань|пенза|липецк|киров|чебоксары|тула|калининград|курск|ставрополь|сочи|улан-удэ|тверь|магнитогорск|иваново|брянск|белгород|сургут|владимир|архангельск|чита|смоленск|калуга|курган|орел|вологда|саранск|мурманск|якутск|тамбов|кострома|псков|новгород|петрозаводск|подольск|мытищи|химки|балашиха|королев|люберцы|пятигорск|воткинск|минск|киев|алматы|астана|ереван|ташкент|париж|лондон|берлин".split("|")
REGIONS = "московская ленинградская свердловская новосибирская самарская ростовская нижегородская челябинская тверская рязанская тульская калужская владимирская ярославская воронежская саратовская волгоградская иркутская кемеровская омская томская тюменская оренбургская пензенская псковская смоленская брянская курская липецкая тамбовская ивановская костромская вологодская архангельская мурманская краснодарский ставропольский красноярский алтайский пермский приморский хабаровский татарстан башкортостан дагестан карелия коми удмуртия чувашия якутия".split()
COUNTRIES = ["российская федерация|рф|россия", "республика беларусь|беларусь|белоруссия", "республика казахстан|казахстан", "республика армения|армения", "республика узбекистан|узбекистан", "киргизия|кыргызстан", "таджикистан", "азербайджан", "грузия", "украина", "молдова", "германия", "франция", "италия", "испания", "китай", "турция", "сша", "польша", "израиль", "индия"]
PUBLIC_PERSONS = ["пушкин|александр|сергеевич", "толстой|лев|николаевич", "чайковский|петр|ильич", "лермонтов|михаил|юрьевич", "гагарин|юрий|алексеевич", "менделеев|дмитрий|иванович", "достоевский|федор|михайлович", "чехов|антон|павлович", "гоголь|николай|васильевич", "ленин|владимир|ильич", "путин|владимир|владимирович", "ломоносов|михаил|васильевич", "есенин|сергей|александрович", "маяковский|владимир|владимирович"]
AMBIGUOUS = "август вера любовь надежда роман лев света мила роза лилия слава майя ника лада соня тома поля уля ева дина рита влада кира инна зина тая гена боря вася женя даня марина виктория тема лева заря искра идея свобода воля победа радость весна ася лора лана нона макс ник кир марк мира ольга олег игорь юлия лика лиля агата адам атеист мая аля оля ира юля аня таня маша катя лена даша вика настя лиза ваня коля петя саша дима миша паша рома юра сеня".split()

CITY, REGION, COUNTRY = "city", "region", "country"


def lines(text: str) -> list[str]:
    """Trimmed lines without blanks and # comments."""
    return [x for x in (line.strip() for line in text.splitlines()) if x and not x.startswith("#")]


@dataclass
class Dictionaries:
    """Folded lists and what is derived from them."""

    male: list[str] = field(default_factory=list)
    female: list[str] = field(default_factory=list)
    other_names: list[str] = field(default_factory=list)
    patronymic_list: list[str] = field(default_factory=list)
    surname_list: list[str] = field(default_factory=list)
    places: list[tuple[str, str]] = field(default_factory=list)
    persons: list[str] = field(default_factory=list)

    @cached_property
    def nominative(self) -> dict[str, str]:
        """Case form of a first name -> nominative; the first list wins."""
        out: dict[str, str] = {}
        for name in [*self.male, *self.female, *self.other_names]:
            for form in M.first_name_forms(name):
                out.setdefault(form, name)
        return out

    @cached_property
    def latin_names(self) -> frozenset[str]:
        return frozenset(map(M.transliterate, [*self.male, *self.female, *self.other_names]))

    @cached_property
    def ambiguous(self) -> frozenset[str]:
        return frozenset(f for n in AMBIGUOUS for f in M.first_name_forms(n))

    @cached_property
    def patronymics(self) -> frozenset[str]:
        return frozenset(f for p in self.patronymic_list for f in M.patronymic_forms(p))

    @cached_property
    def surnames(self) -> frozenset[str]:
        return frozenset(self.surname_list)

    @cached_property
    def place_kinds(self) -> dict[str, str]:
        """Case form of a place -> kind; forms of one letter don't count."""
        out: dict[str, str] = {}
        for name, kind in self.places:
            for form in M.place_forms(name):
                if len(form) >= 2:
                    out.setdefault(form, kind)
        return out

    @cached_property
    def public(self) -> dict[str, str | None]:
        """Surname of a public person -> first name, where one is given."""
        out: dict[str, str | None] = {}
        for p in self.persons:
            surname, first, *_ = [*map(M.fold_entry, p.split("|")), "", ""]
            if surname:
                out.setdefault(surname, first or None)
        return out

    @cached_property
    def synthetic_surnames(self) -> list[str]:
        return sorted({s for s in self.surname_list if len(s) >= 5 and s.endswith(("ов", "ев", "ин"))})

    @cached_property
    def synthetic_cities(self) -> list[str]:
        return sorted({n for n, kind in self.places if kind == CITY and " " not in n})

    def is_patronymic(self, t: str) -> bool:
        return t in self.patronymics or M.is_patronymic_like(t)

    def surname_lemma(self, t: str) -> str | None:
        return next((x for x in M.surname_lemmas(t) if x in self.surnames), None)

    def add(self, kind: str, items: Iterable[str]) -> None:
        if kind == "country":
            seen = {n for n, k in self.places if k == COUNTRY}
            for item in items:
                for form in map(M.fold_entry, item.split("|")):
                    if form and form not in seen:
                        seen.add(form)
                        self.places.append((form, COUNTRY))
            return
        if kind == "public_person":
            self.persons += items
            return
        folded = [x for x in map(M.fold_entry, items) if x]
        if kind in (CITY, REGION):
            self.places += [(x, kind) for x in folded]
        else:
            {"male": self.male, "female": self.female, "first_name": self.other_names, "patronymic": self.patronymic_list, "surname": self.surname_list}[kind].extend(folded)


FILES = {
    "first_names_male.txt": "male", "first_names_female.txt": "female", "first_names_diminutive.txt": "first_name", "patronymics.txt": "patronymic", "surnames.txt": "surname",
    "cities_ru.txt": "city", "cities_world.txt": "city", "regions_ru.txt": "region", "countries.txt": "country", "public_persons.txt": "public_person",
}


def dictionaries(directory: str | None = None, extra: Iterable[tuple[str, str]] = (), public_persons: Iterable[str] = ()) -> Dictionaries:
    """The lists here, then those of a directory, then single files (kind, path), then more public persons."""
    d = Dictionaries()
    for kind, items in (("male", MALE), ("female", FEMALE), ("first_name", DIMINUTIVE), ("surname", SURNAMES), ("city", CITIES), ("region", REGIONS), ("country", COUNTRIES), ("public_person", PUBLIC_PERSONS)):
        d.add(kind, items)
    for name, kind in FILES.items():
        if directory and (path := Path(directory) / name).exists():
            d.add(kind, lines(path.read_text("utf-8")))
    for kind, path in extra:
        d.add(kind, lines(Path(path).read_text("utf-8")))
    d.add("public_person", public_persons)
    return d


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """(value): a list file as a table, folded, without blanks and comments."""
    value = F.trim(F.col("value"))
    return spark.read.text(path).select(value.alias("value")).filter("value <> '' AND NOT startswith(value, '#')").select(F.lower(F.translate("value", "Ёё", "ее")).alias("value"))
