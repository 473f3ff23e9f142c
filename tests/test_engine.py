"""Single texts through detection, resolution, masking and restoring."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cloakwork.operators import checks, dates, generation, masking, restoring
from cloakwork.operators import morphology as M
from cloakwork.operators.curated import ALLOW, CLEAN, MASKED
from cloakwork.operators.folding import Text
from cloakwork.plans import long_texts
from cloakwork.plans.catalog import PROFILES, TYPES, Combination, Config, ConfigError, Pattern, Strategy, System, TypeDef
from cloakwork.plans.engine import Compiled, entity_rows, entry_rows
from cloakwork.sources.config import config_of, interpolate
from cloakwork.sources.dictionaries import dictionaries, lines

SYSTEMS = (System("default", anonymous=True), *(System(p, profile=p) for p in PROFILES if p != "reference"), System("parts", address_mode="components"), System("strict", weak_entities="never"), System("loose", weak_entities="always"))


@pytest.fixture(scope="module")
def engine():
    return Compiled(Config(systems=SYSTEMS, allowlists=ALLOW, secret="s"))


@pytest.mark.parametrize(("text", "masked"), MASKED)
def test_masked(engine, text, masked):
    got, entries, _ = engine.mask(text, "default")
    assert got == masked
    assert restoring.restore_exact(got, entries) == text


@pytest.mark.parametrize("text", CLEAN)
def test_clean(engine, text):
    assert engine.detect(text, "default") == []


@pytest.mark.parametrize("system", ["default", *(p for p in PROFILES if p != "reference")])
@pytest.mark.parametrize("text", [t for t, _ in MASKED] + CLEAN + ["", "İİ orlova@box.ru ς"])
def test_restored_under_every_profile(engine, system, text):
    masked, entries, entities = engine.mask(text, system)
    assert restoring.restore(masked, entries, True) == text
    assert restoring.masked_again(text, entries) == masked
    assert all(a.end <= b.start for a, b in zip(entities, entities[1:], strict=False))


_PIECES = st.sampled_from([t for t, _ in MASKED] + CLEAN + ["\n", " ", "😀", "İ", "+1 (618) 555-0147", "a@b.co", "Анна", "д. 5", "12/27", "пин 1234"])


@settings(max_examples=60, deadline=None)
@given(st.lists(_PIECES | st.text(max_size=12), max_size=6))
def test_any_text_comes_back(parts):
    e = Compiled(Config(systems=SYSTEMS, allowlists=ALLOW)) if not hasattr(test_any_text_comes_back, "e") else test_any_text_comes_back.e
    test_any_text_comes_back.e = e
    text = " ".join(parts)
    for system in ("default", "placeholder", "synthetic"):
        masked, entries, entities = e.mask(text, system)
        assert restoring.restore(masked, entries, True) == text
        assert all(0 <= x.start < x.end <= len(text) for x in entities)
        assert all(a.end <= b.start for a, b in zip(entities, entities[1:], strict=False))


def test_checksum_needs_a_cue_when_it_fails(engine):
    types = lambda t: [e.type for e in engine.detect(t, "default")]
    assert types("карта 5536 9137 0000 0006") == ["CARD_NUMBER"] and types("5536 9137 0000 0006") == []
    assert types("ИНН 526317984680") == ["INN"] and types("526317984680") == []
    assert types("СНИЛС 160-722-394 18") == ["SNILS"] and types("160-722-394 18") == []


def test_one_person_has_one_placeholder(engine):
    masked, entries, _ = engine.mask("Договор подписал Орлов Денис Сергеевич. Орлову Денису Сергеевичу писать на +7 913 640-27-58, он же 8 (913) 640-27-58", "placeholder")
    assert masked == "Договор подписал <FIO_1>. <FIO_1> писать на <PHONE_1>, он же <PHONE_1>"
    assert restoring.restore_rewritten("Набираем <phone_1>, спросить <FIO_1>", entries) == "Набираем +7 913 640-27-58, спросить Орлов Денис Сергеевич"


def test_policies(engine):
    address = "Адрес: г. Самара, ул. Луговая, д. 2"
    assert [e.type for e in engine.detect(address, "default")] == ["ADDRESS"]
    assert [e.type for e in engine.detect(address, "parts")] == ["ADDRESS_CITY", "ADDRESS_STREET", "ADDRESS_HOUSE"]
    date = "Орлова Нина Борисовна, 17.10.2008"
    assert [[e.type for e in engine.detect(date, s)] for s in ("default", "strict")] == [["FIO", "DATE"], ["FIO"]]
    assert [e.type for e in engine.detect("встреча 17.10.2008", "loose")] == ["DATE"]
    rule = Compiled(Config(systems=(System("s", anonymous=True, combination_rules=(Combination("PIN", ("CARD_NUMBER",)),)),)))
    assert [e.type for e in rule.detect("пин-код 1150", "s")] == []
    assert [e.type for e in rule.detect("карта 4000056655665556 пин-код 1150", "s")] == ["CARD_NUMBER", "PIN"]


def test_masks():
    assert masking.partial("1234") == "****" and masking.partial("123456") == "12**56" and masking.partial("—") == "*"
    assert masking.full("orlova@box.ru") == "******@***.**"
    assert masking.initials("Орлов Д.С.") == "О. Д. С." and masking.initials("Орлов Денис", False) == "О Д" and masking.initials("--") == "**"


def test_synthetic_values_are_valid(engine):
    m = engine.systems["synthetic"][2]
    mask = lambda kind, v: m.synthetic(kind, v, masking.identity(kind, v, engine.lists))
    for i in range(30):
        card, inn = mask("CARD_NUMBER", f"5536 9137 0000 {1000 + i}"), mask("INN", f"{526317984600 + i}")
        assert checks.luhn(card) and re.fullmatch(r"4\d{3} \d{4} \d{4} \d{4}", card) and checks.inn(inn)
    assert re.fullmatch(r"7 \(9\d\d\) \d{3}-\d\d-\d\d", mask("PHONE", "8 (913) 640-27-58"))
    assert mask("PHONE", "8 913 640 27 58") == mask("PHONE", "8 913 640 27 58") and dates.is_date(mask("BIRTH_DATE", "23.11.1974")) and dates.is_date(mask("BIRTH_DATE", "4 марта 2009"))
    assert len(mask("FIO", "Орлова Нина Борисовна").split()) == 3 and mask("FIO", "Орлова Нина Борисовна").split()[2].endswith("на")


def test_restoring_order():
    e = lambda mask, original: masking.Entry("X", 0, 0, 0, 0, mask, original)
    assert restoring.restore_rewritten("<FIO_1> <FIO_10> <fio_1>", [e("<FIO_1>", "a"), e("<FIO_10>", "b")]) == "a b a"
    assert restoring.restore_rewritten("** ** **", [e("**", "1"), e("**", "2")]) == "1 2 2"


def test_checks():
    assert checks.inn("526317984689") and checks.inn("5408130693") and not checks.inn("5408130694")
    assert checks.snils("160-722-394 47") and not checks.snils("160-722-394 18") and checks.luhn("4000 0566 5566 5556") and not checks.luhn("0")
    assert checks.phone("+7 913 640-27-58") and not checks.phone("+7 213 640-27-58") and not checks.phone("555-55-55") and not checks.phone("12")
    for good in ("23.11.1974", "1974-11-23", "11/23/1974", "4 марта 2009", "марта 4, 2009", "2009 г., 4 марта", "04.03.09", "29.02.2004"):
        assert dates.is_date(good), good
    for bad in ("41.01.2001", "29.02.2003", "15.15.2001", "4 мырта 2009"):
        assert not dates.is_date(bad), bad


def test_folding():
    t = Text("aİb")
    assert t.span(0, 2) == (0, 2) and t.folded == "ai̇b" and t.span(3, 4) == (2, 3) and t.folded_at(2) == 3
    assert Text("Ёж\u00a0–\t").folded == "еж - " and Text("Я😀a").byte(2) == 6
    assert [(w.text, w.kind, w.capitalized) for w in Text("О'Нил ст-12 Ab 7").words] == [("о'нил", "cyrillic", True), ("ст-12", "mixed", False), ("ab", "latin", True), ("7", "digits", False)]


def test_forms():
    assert M.first_name_forms("анна")[1:] == ["анны", "анне", "анну", "анной", "анною"] and "льва" in M.first_name_forms("лев") and "павла" in M.first_name_forms("павел")
    assert M.surname_lemmas("иванову")[:2] == ["иванову", "иванов"] and M.surname_like("петренко") and not M.surname_like("ков")
    assert "нижнего новгорода" in M.place_forms("нижний новгород") and "ростов-на-дону" in M.place_forms("ростов-на-дону")
    assert M.is_patronymic_like("сергеевна") and M.is_patronymic_like("ильича") and M.patronymic_base("петровичу") == "петрович" and M.transliterate("щука") == "shchuka"


def test_config():
    assert interpolate("${A:-x} ${B} ${C:-}", {"B": "b"}) == "x b "
    made = config_of({"pii_types": [{"id": "EMPLOYEE_ID", "patterns": [r"(?:^|[^а-яa-z0-9])(?P<v>тн-?\d{6})(?-u:\b)"], "context": {"before": ["сотрудник"]}, "priority": 60}], "systems": [{"id": "hr", "auth": {"anonymous": True}, "profile": "full", "overrides": {"EMPLOYEE_ID": {"kind": "partial", "keep_start": 3, "keep_end": 0}}}]})
    assert Compiled(made).mask("сотрудник тн-123456", "hr")[0] == "сотрудник тн-1*****"
    for bad in ({"nonsense": 1}, {"systems": [{"id": "a"}, {"id": "a"}]}, {"systems": [{"id": "a", "profile": "x"}]}, {"pii_types": [{"id": "X", "patterns": ["("]}]}, {"profiles": {"p": {"default": "what"}}}):
        with pytest.raises(ConfigError):
            config_of(bad)
    assert Strategy.of("token").length == 12 and lines("# a\n\n b \n") == ["b"]


def test_generated_records():
    lists = dictionaries()
    m = masking.Masker(PROFILES["reference"], lists)
    one = generation.record(1, "PASSPORT", 3, lists, m)
    assert one == generation.record(1, "PASSPORT", 3, lists, m) != generation.record(2, "PASSPORT", 3, lists, m)
    assert [e["type"] for e in one["entities"]] == ["FIO", "PASSPORT"]


#: What a piece of a text can't tell by itself: names and types elsewhere, the words beside it, numbers of placeholders.
ACROSS = ["Клиент Орлов Денис Сергеевич", "Орлов пришел", "Марта", "12 апреля", "17.10.2008", "Поэт Александр Пушкин", "пин-код 1150", "карта 4000 0566 5566 5556", "г. Самара, ул. Луговая, д. 2", "+7 913 640-27-58", "orlova@box.ru", "выдан ОВД г. Самары", "~~~", "0912", ""]


@pytest.mark.parametrize("system", ["default", "full", "placeholder", "synthetic", "parts"])
def test_a_long_text_in_pieces_is_masked_as_the_whole(engine, system):
    r = random.Random(3)
    assert engine.reach(system)
    for _ in range(40):
        rows = [f"\n{'~ ' * 40}\n" * (i > 0) + r.choice(ACROSS) for i in range(r.randrange(1, 30))]
        masked, entries, entities = engine.mask("".join(rows), system)
        got = list(long_texts.whole_columns(long_texts.masked_pieces(engine, system, rows, r.choice([1, 60, 400]))))
        assert "".join(g[0] for g in got) == masked
        assert [x for g in got for x in zip(*g[1], strict=True)] == [tuple(e.values()) for e in entry_rows(entries)]
        assert [x for g in got for x in zip(*g[2], strict=True)] == [tuple(e.values()) for e in entity_rows("".join(rows), entities)]


def test_pieces_end_where_nothing_reaches_over():
    wall = "\n" + "~ " * 40 + "\n"
    assert list(long_texts.pieces(["a", wall + "b", wall[:50], wall[50:] + "c"], 81, 1)) == ["a" + wall, "b" + wall, "c"]
    for weak in (wall[:79], " " * 90 + "\n", wall.replace("\n", " "), wall[:40] + "x" + wall[40:], "\n" + "." * 90):
        assert list(long_texts.pieces(["a" + weak + "b", "c"], 81, 1)) == ["a" + weak + "bc"]
    assert list(long_texts.pieces(["a" + wall + "b"], None, 1)) == ["a" + wall + "b"]
    assert max(map(len, long_texts.pieces(("слово" + wall for _ in range(5000)), 81, 1000))) < 3000


def test_texts_without_a_bound_on_what_reaches_over_stay_whole():
    own = Config(types=(*TYPES, TypeDef("BADGE", (Pattern(r"badge\W+\d+"),))))
    rule = Config(systems=(System("default", anonymous=True, combination_rules=(Combination("PIN", ("CARD_NUMBER",)),)),))
    assert Compiled(own).reach("default") is None and Compiled(rule).reach("default") is None
