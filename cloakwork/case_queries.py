"""Queries over written-out cases: a small table goes in, and the SQL lists what must come out."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.functions import text as texts
from cloakwork.operators import curated, evaluation, forms, generation
from cloakwork.plans.catalog import Combination, Config, System
from cloakwork.plans.engine import Engine
from cloakwork.sources import tables
from cloakwork.sources.dictionaries import read_word_list
from cloakwork.sources.shared import shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _literal(x) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else f"CAST({x} AS {'DOUBLE' if isinstance(x, float) else 'BIGINT'})"


def values_sql(columns: str, rows: list[tuple]) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) AS v({columns})"


def case(columns: str, rows: list[tuple] | None = None, sql: str | None = None):
    """Registers a query with the rows, or the SQL, that it must give."""

    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql or values_sql(columns, rows)
        return f

    return add


def _frame(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, columns)


@case("\"case\", masked", [(i, m) for i, (_, m) in enumerate([*curated.MASKED, *((t, t) for t in curated.CLEAN)])])
def curated_masks(spark, sf):
    """The hand-written cases under the reference profile."""
    return Engine(curated.config()).mask(curated.curated_cases(spark)).select("case", "masked")


@case("\"case\", restored", [(i, t) for i, t in enumerate([*(t for t, _ in curated.MASKED), *curated.CLEAN])])
def curated_restored(spark, sf):
    engine = Engine(curated.config())
    return engine.restore(engine.mask(curated.curated_cases(spark)), "masked").select("case", "restored")


# Policies: (system, text, what is found).

POLICIES = [
    ("parts", "Адрес: г. Самара, ул. Луговая, д. 2", "ADDRESS_CITY=г. Самара|ADDRESS_STREET=ул. Луговая|ADDRESS_HOUSE=д. 2"),
    ("default", "Адрес: г. Самара, ул. Луговая, д. 2", "ADDRESS=г. Самара, ул. Луговая, д. 2"),
    ("parts", "Пункт выдачи по адресу г. Калуга, ул. Рябиновая, д. 14", ""),
    ("default", "Пункт выдачи по адресу г. Калуга, ул. Рябиновая, д. 14", ""),
    ("default", "Орлова Нина Борисовна, 17.10.2008", "FIO=Орлова Нина Борисовна|DATE=17.10.2008"),
    ("strict", "Орлова Нина Борисовна, 17.10.2008", "FIO=Орлова Нина Борисовна"),
    ("loose", "сбор 17.10.2008", "DATE=17.10.2008"),
    ("default", "сбор 17.10.2008", ""),
    ("pinned", "пин-код 1150", ""),
    ("pinned", "карта 4000056655665556 пин-код 1150", "CARD_NUMBER=4000056655665556|PIN=1150"),
    ("default", "пин-код 1150", "PIN=1150"),
    ("default", "выдан ОВД Октябрьского района г. Калуги 07.09.2011", "PASSPORT_ISSUER=ОВД Октябрьского района г. Калуги|PASSPORT_ISSUE_DATE=07.09.2011"),
    ("default", "Орлова Нина Борисовна, отчёт 07.09.2011", "FIO=Орлова Нина Борисовна|DATE=07.09.2011"),
    ("default", "Соколов Пётр Ильич пришёл. Соколову отказали, Соколовым недовольны", "FIO=Соколов Пётр Ильич|FIO=Соколову|FIO=Соколовым"),
    ("default", "Соколову отказали", ""),
    ("default", "Писатель Антон Чехов родился 29 января 1860 года в Таганроге", ""),
    ("default", "Пишите help@staff.example или olga@box.ru", "EMAIL=olga@box.ru"),
    ("default", "Справочная служба 8 800 640-27-58", ""),
]
_SYSTEMS = (System("default", anonymous=True), System("parts", address_mode="components"), System("strict", weak_entities="never"), System("loose", weak_entities="always"), System("pinned", combination_rules=(Combination("PIN", ("CARD_NUMBER",)),)))


def _policies(spark, systems: tuple[str, ...]) -> DataFrame:
    engine, out = Engine(Config(systems=_SYSTEMS, allowlists=curated.ALLOW)), None
    for name in systems:
        rows = _frame(spark, "case long, text string", [(i, t) for i, (s, t, _) in enumerate(POLICIES) if s == name])
        shown = F.transform("entities", lambda e: F.concat(e["type"], F.lit("="), F.substr("text", (e["start"] + 1).cast("int"), (e["end"] - e["start"]).cast("int"))))
        found = engine.detect(rows, name).select("case", F.array_join(shown, "|").alias("found"))
        out = found if out is None else out.unionByName(found)
    return out


def _policy_case(name: str, doc: str, *systems: str):
    def run(spark, sf):
        return _policies(spark, systems)

    run.__name__, run.__doc__ = name, doc
    case("\"case\", found", [(i, f) for i, (s, _, f) in enumerate(POLICIES) if s in systems])(run)


_policy_case("address_parts", "Addresses as their parts; parts of public addresses stay.", "parts")
_policy_case("weak_policies", "Weak entities never, or always.", "strict", "loose")
_policy_case("combination_rules", "A type that is masked only beside another.", "pinned")
_policy_case("resolved_cases", "Co-reference, dates after issuers, public persons, allowlists.", "default")


# Words.

WORDS = {
    "first_name": [("анна", "анны анне анну анной анною"), ("мария", "марии марию марией мариею марие"), ("илья", "ильи илье илью ильей ильею"), ("юрий", "юрия юрию юрием юрие")],
    "surname": [("орлову", "орлов"), ("соколовой", "соколов"), ("достоевским", "достоевский"), ("петренко", "")],
    "place": [("калуга", "калуги калуге калугу калугой калугою"), ("томск", "томска томску томском томске")],
    "patronymic": [("сергеевичу", "сергеевич"), ("борисовной", "борисовна"), ("ильича", "ильич"), ("окно", "")],
    "surname_like": [("орлов", ""), ("петренко", ""), ("дом", "")],
    "identity": [("анне", "анна"), ("сергеевичу", "сергеевич"), ("орлову", "орлов")],
}
_LIKE = {"орлов", "петренко"}


def _form_rows() -> list[tuple]:
    out = []
    for kind, rows in WORDS.items():
        for word, others in rows:
            made = set(others.split())
            if kind in ("first_name", "surname", "place") or (kind == "surname_like" and word in _LIKE):
                made |= {word}
            out += [(kind, word, f) for f in sorted(made)]
    return out


@case("kind, word, form", _form_rows())
def forms_of_words(spark, sf):
    """Case forms of names and places, lemmas, and the identity of name tokens."""
    out = None
    for kind, rows in WORDS.items():
        made = forms.word_forms(_frame(spark, "word string", [(w,) for w, _ in rows]), kind).select(F.lit(kind).alias("kind"), "word", F.explode("forms").alias("form"))
        out = made if out is None else out.unionByName(made)
    return out


SAME = [("a", "Орлов Денис Сергеевич"), ("a", "ОРЛОВУ ДЕНИСУ СЕРГЕЕВИЧУ"), ("a", "Денис Сергеевич Орлов"), ("b", "тел +7 913 640-27-58"), ("b", "тел 8 (913) 640-27-58"), ("c", "Орлова Нина Борисовна"), ("c", "орловой нине борисовне")]


@case("who, texts, identities", [("a", 3, 1), ("b", 2, 1), ("c", 2, 1)])
def identities(spark, sf):
    """Names in other cases and orders, and numbers written another way, have one token."""
    engine = Engine(Config(secret="s", systems=(System("token", anonymous=True, profile="token"),)))
    masked = engine.mask(_frame(spark, "who string, text string", SAME)).select("who", F.regexp_extract("masked", "tok_[0-9a-f]+", 0).alias("t"))
    return masked.groupBy("who").agg(F.count("*").alias("texts"), F.countDistinct("t").alias("identities"))


# Evaluation: spans (id, expected, predicted).

SPANS = "array<struct<type:string,start:bigint,end:bigint>>"
RECORDS = [
    ("a", "FIO", "я" * 50, [("FIO", 0, 10), ("ADDRESS", 20, 30)], [("FIO", 1, 10), ("ADDRESS_CITY", 40, 44)]),
    ("b", "INN", "x" * 9, [("INN", 0, 4)], [("CVV", 1, 3)]),
    ("c", "NEGATIVE", "покой", [], []),
    ("d", "FIO", "y" * 40, [("FIO", 0, 10), ("FIO", 10, 20)], [("FIO", 2, 12), ("FIO", 12, 20)]),
    ("e", "ADDRESS", "z" * 30, [("ADDRESS", 0, 20)], [("ADDRESS_CITY", 0, 12), ("EMAIL", 21, 30)]),
]


def _spans(spark) -> tuple[DataFrame, DataFrame, DataFrame]:
    d = _frame(spark, f"id string, category string, text string, e {SPANS}, entities {SPANS}", RECORDS)
    return d, evaluation.exploded(d, "e"), evaluation.exploded(d, "entities")


@case("type, tp, fp, fn", [("FIO", 3, 0, 0), ("ADDRESS", 1, 1, 1), ("INN", 0, 0, 1), ("EMAIL", 0, 1, 0), ("micro", 4, 2, 2)])
def confusion_cases(spark, sf):
    """Equal types after canonical names, each span once, and nothing false inside an expected span."""
    _, e, p = _spans(spark)
    return evaluation.confusion(evaluation.span_outcomes(e, p)).select("type", "tp", "fp", "fn")


@case("id, leak_chars, expected_bytes", [("a", 11, 40), ("b", 2, 4), ("d", 2, 20), ("e", 8, 20)])
def leak_cases(spark, sf):
    d, e, p = _spans(spark)
    return evaluation.leaks(d, e, p)


@case("records, leak_chars, leaked_records, false_positive_records, negative_records, negative_clean, restored_exactly, similarity", [(5, 23, 4, 2, 1, 1, 4, 0.8)])
def report_cases(spark, sf):
    d, e, p = _spans(spark)
    results = d.withColumn("masked", F.col("text")).withColumn("expected_masked", F.when(F.col("id") == "b", F.lit("")).otherwise(F.col("text"))).withColumn("restored", F.when(F.col("id") == "c", F.lit("иное")).otherwise(F.col("text")))
    totals = evaluation.record_report(results, evaluation.span_outcomes(e, p), evaluation.leaks(d, e, p))
    return totals.select("records", "leak_chars", "leaked_records", "false_positive_records", "negative_records", "negative_clean", "restored_exactly", F.round("mask_similarity", 6).alias("similarity"))


@case("id, kind, detail", [("a", "false_positive", "ADDRESS"), ("a", "missed", "ADDRESS"), ("a", "partial", "FIO"), ("b", "missed", "INN"), ("c", "demask", "restored text differs"), ("d", "partial", "FIO"), ("d", "partial", "FIO"), ("e", "false_positive", "EMAIL"), ("e", "partial", "ADDRESS")])
def failure_cases(spark, sf):
    d, e, p = _spans(spark)
    results = d.withColumn("restored", F.when(F.col("id") == "c", F.lit("иное")).otherwise(F.col("text")))
    return evaluation.failures(evaluation.span_outcomes(e, p), results, evaluation.partly_masked(e, p))


# The generated corpus: what its makers put in, found without a slip.

_PER = 60
_MADE = {"ADDRESS": 1, "BANK_ACCOUNT": 1, "BIRTH_DATE": 1, "CARD_EXPIRY": 1, "CARD_NUMBER": 2, "CITIZENSHIP": 1, "CVV": 2, "DRIVER_LICENSE": 1, "EMAIL": 1, "FIO": 3, "INN": 1, "OMS_POLICY": 1, "PASSPORT": 2, "PASSPORT_ISSUER": 1, "PASSPORT_ISSUE_DATE": 1, "PHONE": 1, "PIN": 1, "SNILS": 1, "SUBDIVISION_CODE": 1}


@case("type, tp, fp, fn, f1", [(t, n * _PER, 0, 0, 1.0) for t, n in _MADE.items()] + [("micro", sum(_MADE.values()) * _PER, 0, 0, 1.0)])
def quality_of_generated(spark, sf):
    _, by_type, _ = evaluation.evaluate(Engine(), generation.generate(spark, _PER, 20))
    return by_type.select("type", "tp", "fp", "fn", "f1")


@case("category, records, spans, marked", [(c, _PER, _PER * (2 if c in ("CARD_EXPIRY", "CARD_NUMBER", "INN", "PASSPORT", "PASSPORT_ISSUER", "SUBDIVISION_CODE") else 1), True) for c in generation.CATEGORIES] + [("NEGATIVE", 20, 0, False)])
def generated_categories(spark, sf):
    """Records and labelled spans by category; every labelled record is masked."""
    d = generation.generate(spark, _PER, 20)
    return d.groupBy("category").agg(F.count("*").alias("records"), F.sum(F.size("entities")).cast("long").alias("spans"), F.bool_and(F.col("masked") != F.col("text")).alias("marked"))


# Files and tables.


@case("id, category, text, n_entities", [("a", "x", "т", 1), ("b", "x", "т", 0)])
def golden_files(spark, sf):
    """Labelled records written as JSON lines and read again, comments and blanks between them."""
    path = shared_path(spark, "golden")
    row = {"id": "a", "category": "x", "text": "т", "entities": [{"type": "FIO", "start": 0, "end": 1}], "masked": "*"}
    spark.createDataFrame([("# note\n\n" + json.dumps(row, ensure_ascii=False) + "\n" + json.dumps(row | {"id": "b", "entities": []}, ensure_ascii=False),)], "value string").coalesce(1).write.text(path)
    again = shared_path(spark, "golden")
    tables.write_golden(tables.read_golden(spark, path), again)
    return tables.read_golden(spark, again).select("id", "category", "text", F.size("entities").cast("long").alias("n_entities"))


@case("status, code, n", [(200, None, 1), (400, "INVALID_REQUEST", 2)])
def request_files(spark, sf):
    path = shared_path(spark, "requests")
    spark.createDataFrame([('{"payload":"x","payload_id":"1"}\n{"payload":"x","payload_id":" "}\n{bad',)], "value string").coalesce(1).write.text(path)
    return tables.read_requests(spark, path).groupBy(F.col("status").cast("long").alias("status"), "code").agg(F.count("*").alias("n"))


@case("value", [("елкин",), ("толстой",)])
def word_list_files(spark, sf):
    path = shared_path(spark, "words")
    spark.createDataFrame([("# list\nЁлкин\n\n Толстой ",)], "value string").coalesce(1).write.text(path)
    return read_word_list(spark, path).select("value")


@case("text", [("a\nb\n",)])
def text_files(spark, sf):
    path = shared_path(spark, "texts")
    spark.createDataFrame([("a\nb",)], "value string").coalesce(1).write.text(path)
    return tables.read_texts(spark, path).select("text")


@case("", sql="SELECT n_nationkey, true AS well_formed FROM nation")
def request_ids(spark, sf):
    return spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey", texts.request_id().rlike("^[0-9a-f]{16}$").alias("well_formed"))


@case("", sql="SELECT conv_id, conv_id % 2 = 0 AS alive FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)")
def mapping_ttl(spark, sf):
    """Mappings end an hour after they were made."""
    made = F.when(F.col("conv_id") % 2 == 0, F.lit("2024-01-01 00:30:00")).otherwise(F.lit("2023-12-31 22:59:59")).cast("timestamp")
    store = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").filter("conv_id IS NOT NULL").distinct().withColumn("created_at", made)
    kept = tables.alive(store, 3600, F.lit("2024-01-01 00:59:59").cast("timestamp")).select("conv_id", F.lit(True).alias("alive"))
    return store.select("conv_id").join(kept, "conv_id", "left").select("conv_id", F.coalesce("alive", F.lit(False)).alias("alive"))


_ROUND = "SELECT conv_id, min(turn) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id"


@case("", sql=f"SELECT conv_id, CASE conv_id % 4 WHEN 3 THEN NULL ELSE 'Пишу на u' || conv_id || '@box.ru, верно u' || conv_id || '@box.ru?' END AS restored, CAST(CASE conv_id % 4 WHEN 3 THEN 502 ELSE 200 END AS BIGINT) AS status, CASE conv_id % 4 WHEN 3 THEN 'UPSTREAM_ERROR' END AS code, 'EMAIL' AS types FROM ({_ROUND})")
def chat_replies(spark, sf):
    """A model's replies to masked conversations, with what was masked put back; a missing reply is an upstream error."""
    rows = spark.read.parquet(f"{sf}/conversations.parquet").filter("conv_id IS NOT NULL").select("conv_id", "turn", F.concat(F.lit("почта u"), F.col("conv_id").cast("string"), F.lit("@box.ru")).alias("text"))
    replies = rows.select("conv_id").distinct().withColumn("reply", F.when(F.col("conv_id") % 4 != 3, F.lit("Пишу на <EMAIL_1>, верно <email_1>?")))
    engine = Engine(Config(systems=(System("chat", anonymous=True, profile="placeholder"),)))
    return engine.chat_round(rows, replies).select("conv_id", "restored", F.col("status").cast("long").alias("status"), "code", "types")


@case("", sql="SELECT doc_id, true AS covered FROM documents")
def folded_places(spark, sf):
    """A dotted capital I before an address moves no offset: the address alone is found."""
    from cloakwork.operators import pattern_spans

    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.concat(F.repeat(F.lit("İ"), (F.col("doc_id") % 5).cast("int")), F.lit(" a"), F.col("doc_id").cast("string"), F.lit("@box.ru İ end")).alias("text"))
    s = F.col("spans")[0]
    found = F.substr("text", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
    return pattern_spans.detect(d, ("EMAIL",)).select("doc_id", (found == F.concat(F.lit("a"), F.col("doc_id").cast("string"), F.lit("@box.ru"))).alias("covered"))


# The catalogue, written out: (id, group, confidence, priority, weak, validator, patterns).

CATALOGUE = [
    ("ADDRESS", "address", 0.9, 75, False, "none", 0),
    ("ADDRESS_APARTMENT", "address", 0.9, 74, False, "none", 0),
    ("ADDRESS_CITY", "address", 0.9, 74, True, "none", 0),
    ("ADDRESS_COUNTRY", "address", 0.9, 74, False, "none", 0),
    ("ADDRESS_HOUSE", "address", 0.9, 74, False, "none", 0),
    ("ADDRESS_INDEX", "address", 0.9, 74, False, "none", 0),
    ("ADDRESS_REGION", "address", 0.9, 74, False, "none", 0),
    ("ADDRESS_STREET", "address", 0.9, 74, False, "none", 0),
    ("BANK_ACCOUNT", "bank", 0.88, 89, False, "none", 1),
    ("BIRTH_CERTIFICATE", "documents", 0.92, 84, False, "none", 1),
    ("BIRTH_DATE", "person", 0.95, 60, False, "none", 0),
    ("BIRTH_PLACE", "person", 0.92, 72, False, "none", 0),
    ("CARD_EXPIRY", "card", 0.8, 55, True, "none", 2),
    ("CARD_HOLDER", "card", 0.9, 66, False, "none", 0),
    ("CARD_NUMBER", "card", 0.9, 90, False, "luhn", 3),
    ("CITIZENSHIP", "passport", 0.92, 72, False, "none", 0),
    ("CVV", "card", 0.95, 95, False, "none", 1),
    ("DATE", "person", 0.6, 50, True, "none", 0),
    ("DRIVER_LICENSE", "documents", 0.92, 84, False, "none", 2),
    ("EMAIL", "contact", 0.98, 100, False, "none", 1),
    ("FIO", "person", 0.9, 65, False, "none", 0),
    ("FOREIGN_PASSPORT", "documents", 0.92, 84, False, "none", 1),
    ("INN", "tax", 0.9, 70, False, "inn", 2),
    ("MILITARY_ID", "documents", 0.92, 84, False, "none", 1),
    ("OMS_POLICY", "documents", 0.9, 83, False, "digits_len", 1),
    ("PASSPORT", "passport", 0.92, 85, False, "none", 3),
    ("PASSPORT_ISSUER", "passport", 0.9, 73, False, "none", 0),
    ("PASSPORT_ISSUE_DATE", "passport", 0.95, 60, False, "none", 0),
    ("PHONE", "contact", 0.92, 80, False, "phone", 4),
    ("PIN", "card", 0.95, 95, False, "none", 1),
    ("RESIDENCE_PERMIT", "documents", 0.92, 84, False, "none", 1),
    ("SNILS", "documents", 0.92, 88, False, "snils", 2),
    ("SUBDIVISION_CODE", "passport", 0.95, 86, True, "none", 2),
]
_SHOWN = "BANK_ACCOUNT BIRTH_CERTIFICATE CARD_NUMBER DRIVER_LICENSE FOREIGN_PASSPORT INN MILITARY_ID OMS_POLICY PASSPORT PHONE RESIDENCE_PERMIT SNILS SUBDIVISION_CODE".split()
_STRATEGIES = [("full", "*", "full"), ("placeholder", "*", "placeholder"), ("synthetic", "*", "synthetic"), ("token", "*", "token"), ("reference", "*", "full"), ("reference", "FIO", "initials"), ("reference", "CARD_HOLDER", "initials"), *(("reference", t, "partial") for t in _SHOWN)]


@case("id, type_group, confidence, priority, weak, validator, n_patterns", CATALOGUE)
def catalog_types(spark, sf):
    return Engine().types(spark).select("id", "type_group", F.round("confidence", 4).alias("confidence"), F.col("priority").cast("long").alias("priority"), "weak", "validator", F.col("n_patterns").cast("long").alias("n_patterns"))


@case("profile, type, strategy", _STRATEGIES)
def catalog_profiles(spark, sf):
    return Engine().profiles(spark)


@case("id, enabled, demask, profile, anonymous, n_types", [("default", True, True, "reference", True, sum(t[0] not in ("PUBLIC_PERSON", "PUBLIC_ADDRESS") for t in CATALOGUE))])
def catalog_systems(spark, sf):
    return Engine().systems(spark).select("id", "enabled", "demask", "profile", "anonymous", F.size("types").cast("long").alias("n_types"))
