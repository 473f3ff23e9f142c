"""Registered queries over the driver's tables, and the SQL that says what they return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.functions import masks, text, validators
from cloakwork.operators import evaluation, metrics, pattern_spans
from cloakwork.operators.checks import MONTHS
from cloakwork.plans.catalog import PROFILES, Config, Strategy, System, Profile
from cloakwork.plans.engine import Engine
from cloakwork.sources.shared import shared_path, spread
from cloakwork.sources.tables import add_mappings, chat_messages, digests, log_rows, mapping_key, seal, unseal

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SECRET = "shared secret of replicas"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


# Text expressions.


@query(r"SELECT doc_id, sha256(lower(translate(text, 'Ёё' || chr(160) || chr(8199) || chr(8239) || chr(9) || chr(8208) || chr(8209) || chr(8210) || chr(8211) || chr(8212) || chr(8722), 'ее    ------'))) AS folded_sha256 FROM documents")
def fold_text(spark, sf):
    return documents(spark, sf).select("doc_id", F.sha2(text.fold(F.col("text")), 256).alias("folded_sha256"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}\s\p{Z}]')) AS tokens FROM documents")
def token_estimate(spark, sf):
    return documents(spark, sf).select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query(r"SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+(?:[-''’][\p{L}\p{N}]+)*')) AS n_words, len(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+(?:[-''’][\p{L}\p{N}]+)*'))) AS n_distinct FROM documents")
def words_of_text(spark, sf):
    w = text.words(text.fold(F.col("text")))
    return documents(spark, sf).select("doc_id", F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"))


@query("SELECT conv_id, turn, 'mk:default:' || sha256(CAST(conv_id AS VARCHAR)) AS key FROM conversations")
def payload_key(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", mapping_key(F.lit("default"), F.col("conv_id").cast("string")).alias("key"))


@query("SELECT c_custkey, levenshtein(c_name, c_mktsegment) AS distance, CAST(1.0 - levenshtein(c_name, c_mktsegment) / CAST(greatest(length(c_name), length(c_mktsegment)) AS DOUBLE) AS DOUBLE) AS similarity FROM customer")
def text_similarity(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.levenshtein("c_name", "c_mktsegment").cast("long").alias("distance"), text.similarity(F.col("c_name"), F.col("c_mktsegment")).alias("similarity"))


@query("SELECT o_orderkey, CASE WHEN greatest(o_orderkey % 50 + 10, o_custkey % 60 + 9) - least(o_orderkey % 50, o_custkey % 60) = 0 THEN 0.0 ELSE CAST(greatest(0, least(o_orderkey % 50 + 10, o_custkey % 60 + 9) - greatest(o_orderkey % 50, o_custkey % 60)) AS DOUBLE) / (greatest(o_orderkey % 50 + 10, o_custkey % 60 + 9) - least(o_orderkey % 50, o_custkey % 60)) END AS share FROM orders")
def span_overlap(spark, sf):
    a, b = F.col("o_orderkey") % 50, F.col("o_custkey") % 60
    return table(spark, sf, "orders").select("o_orderkey", text.overlap_share(a, a + 10, b, b + 9).alias("share"))




@query("SELECT n_nationkey, 'shchuka-ivanova-yuliya-' || lower(n_name) AS latin FROM nation")
def transliteration(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", text.transliterate(F.concat(F.lit("щука-иванова-юлия-"), F.lower("n_name"))).alias("latin"))


# Numbers built from keys: the same digits in both engines.

_D9 = "lpad(CAST(100000000 + (o_orderkey * 7919 + o_custkey * 104729) % 899999999 AS {s}), 9, '0')"


def _digit(d: str, i: int) -> str:
    return f"CAST(substr({d}, {i}, 1) AS INT)"


def _sum(d: str, weights) -> str:
    return "(" + " + ".join(f"{w} * {_digit(d, i)}" for i, w in enumerate(weights, 1)) + ")"


def _numbers(spark: SparkSession, sf: str) -> DataFrame:
    d9 = F.expr(_D9.format(s="STRING"))
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", d9.alias("d9"))


_CHECK = f"CASE WHEN {_sum('d9', range(9, 0, -1))} % 101 = 100 THEN 0 ELSE {_sum('d9', range(9, 0, -1))} % 101 END"
_SNILS_SQL = f"WITH b AS (SELECT o_orderkey, {_D9.format(s='VARCHAR')} AS d9 FROM orders) SELECT o_orderkey, o_orderkey % 5 <> 0 AS valid FROM b"


@query(_SNILS_SQL)
def snils_valid(spark, sf):
    d = _numbers(spark, sf).withColumn("chk", F.expr(_CHECK))
    shown = F.when(F.col("o_orderkey") % 5 == 0, (F.col("chk") + 1) % 100).otherwise(F.col("chk"))
    value = F.concat(F.substring("d9", 1, 3), F.lit("-"), F.substring("d9", 4, 3), F.lit("-"), F.substring("d9", 7, 3), F.lit(" "), F.lpad(shown.cast("string"), 2, "0"))
    return d.select("o_orderkey", validators.snils(value).alias("valid"))


@query(f"WITH b AS (SELECT o_orderkey, {_D9.format(s='VARCHAR')} AS d9 FROM orders) SELECT o_orderkey, {_sum('d9', (2, 4, 10, 3, 5, 9, 4, 6, 8))} % 11 % 10 = o_orderkey % 10 AS valid FROM b")
def inn_valid(spark, sf):
    return _numbers(spark, sf).select("o_orderkey", validators.inn(F.concat("d9", (F.col("o_orderkey") % 10).cast("string"))).alias("valid"))


@query(f"WITH b AS (SELECT o_orderkey, '4000' || {_D9.format(s='VARCHAR')} || '00' || CAST(o_orderkey % 10 AS VARCHAR) AS d FROM orders) SELECT o_orderkey, (" + " + ".join(f"(CASE WHEN {_digit('d', i)} * 2 > 9 THEN {_digit('d', i)} * 2 - 9 ELSE {_digit('d', i)} * 2 END)" if i % 2 else _digit("d", i) for i in range(1, 17)) + ") % 10 = 0 AS valid FROM b")
def luhn_valid(spark, sf):
    return _numbers(spark, sf).select("o_orderkey", validators.luhn(F.concat(F.lit("4000 "), "d9", F.lit("-00"), (F.col("o_orderkey") % 10).cast("string"))).alias("valid"))


@query(f"WITH b AS (SELECT o_orderkey, {_D9.format(s='VARCHAR')} AS d9 FROM orders) SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN false WHEN o_orderkey % 4 = 1 THEN CAST(substr(d9, 1, 1) AS INT) >= 3 ELSE true END AS valid FROM b")
def phone_valid(spark, sf):
    k = F.col("o_orderkey") % 4
    value = F.when(k == 0, F.lit("777-77-77")).when(k == 1, F.concat(F.lit("+7 "), F.substring("d9", 1, 3), F.lit(" "), F.substring("d9", 4, 6), F.lit("-0"))).otherwise(F.concat(F.lit("+375 "), "d9"))
    return _numbers(spark, sf).select("o_orderkey", validators.phone(value).alias("valid"))


@query("SELECT o_orderkey, try_cast(lpad(CAST(o_orderkey % 400 + 1750 AS VARCHAR), 4, '0') || '-' || lpad(CAST(o_custkey % 14 AS VARCHAR), 2, '0') || '-' || lpad(CAST(o_orderkey % 33 AS VARCHAR), 2, '0') AS DATE) IS NOT NULL AND o_orderkey % 400 + 1750 BETWEEN 1800 AND 2099 AS valid FROM orders")
def date_valid(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", validators.date(F.col("o_orderkey") % 400 + 1750, F.col("o_custkey") % 14, F.col("o_orderkey") % 33).alias("valid"))


@query("SELECT o_orderkey, o_orderkey % 12 + 1 AS month FROM orders")
def month_numbers(spark, sf):
    word = F.element_at(F.array(*map(F.lit, MONTHS)), (F.col("o_orderkey") % 12 + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", validators.month_number(word).cast("long").alias("month"))


# Masks as expressions.


@query(r"SELECT c_custkey, regexp_replace(c_name, '[\p{L}\p{N}]', '*', 'g') AS masked FROM customer")
def mask_full(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", masks.full(F.col("c_name")).alias("masked"))


@query(f"WITH b AS (SELECT o_orderkey, {_D9.format(s='VARCHAR')} AS d FROM orders) SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '****' ELSE substr(d, 1, 2) || '*' || '-' || '***' || '-' || '*' || substr(d, 8, 2) END AS masked FROM b")
def mask_partial(spark, sf):
    value = F.when(F.col("o_orderkey") % 3 == 0, F.substring("d9", 1, 4)).otherwise(F.concat(F.substring("d9", 1, 3), F.lit("-"), F.substring("d9", 4, 3), F.lit("-"), F.substring("d9", 7, 3)))
    return _numbers(spark, sf).select("o_orderkey", masks.partial(value, mask_chars="digits").alias("masked"))


@query("SELECT p_partkey, array_to_string(list_transform(list_filter(string_split(p_name, ' '), lambda w: w <> ''), lambda w: upper(substr(w, 1, 1)) || '.'), ' ') AS masked FROM part")
def mask_initials(spark, sf):
    return table(spark, sf, "part").select("p_partkey", masks.initials(F.col("p_name")).alias("masked"))


def _pads(secret: str) -> tuple[str, str]:
    key = secret.encode().ljust(64, b"\0")
    return tuple(bytes(b ^ p for b in key).hex() for p in (0x36, 0x5C))


_IPAD, _OPAD = _pads(SECRET)


@query(f"SELECT c_custkey, 'tok_' || substr(sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || encode('FIO') || unhex('00') || encode(lower(c_name))))), 1, 12) AS masked FROM customer")
def mask_token(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", masks.token(SECRET, F.lit("FIO"), F.lower("c_name")).alias("masked"))


# Pattern types over documents, by columns alone.

_OFFSETS = """{name} AS (SELECT doc_id, {kind} AS kind, unnest(string_split_regex(t, '{re}')) AS gap, unnest(regexp_extract_all(t, '{re}')) AS val, unnest(range(0, len(regexp_extract_all(t, '{re}')) + 1)) AS i FROM f),
{name}_at AS (SELECT doc_id, kind, val, sum(length(gap)) OVER w + coalesce(sum(length(val)) OVER p, 0) AS s FROM {name} WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
_FOLDED = "f AS (SELECT doc_id, lower(translate(text, 'Ёё' || chr(160) || chr(8199) || chr(8239) || chr(9) || chr(8208) || chr(8209) || chr(8210) || chr(8211) || chr(8212) || chr(8722), 'ее    ------')) AS t FROM documents)"
_EMAIL_RE = r"[a-z0-9а-я._%+\-]+@[a-z0-9а-я\-]+(?:\.[a-z0-9а-я\-]+)*\.(?:[a-z]{2,}|рф)"
_PHONE_RE = (
    r"(?:\+7|\b[78])[\s\-]?\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}\b",
    r"\+\d{1,3}[\s\-]?\(?\d{2,4}\)?[\s\-]?\d{2,3}[\s\-]?\d{2,3}(?:[\s\-]?\d{2,3})?\b",
    r"\(\d{3,5}\)[\s\-]?\d{2,3}[\s\-]?\d{2}[\s\-]?\d{2}\b",
)
_CARD_RE = r"\b\d{13,19}\b"


def _spans(found: DataFrame) -> DataFrame:
    # outer: an inner explode tests the array's size first, and so works it out twice
    return found.select("doc_id", F.explode_outer("spans").alias("s")).filter("s IS NOT NULL").select("doc_id", F.col("s.type").alias("type"), F.col("s.start").alias("start"), F.col("s.end").alias("stop"), F.col("s.value").alias("value"))


@query("WITH " + _FOLDED + ", " + _OFFSETS.format(name="e", kind="'EMAIL'", re=_EMAIL_RE) + " SELECT doc_id, kind AS type, CAST(s AS BIGINT) AS start, CAST(s + length(val) AS BIGINT) AS stop, val AS value FROM e_at WHERE val IS NOT NULL")
def email_spans(spark, sf):
    return _spans(pattern_spans.detect(documents(spark, sf), ("EMAIL",)))


_PHONE_VALID = r"length(regexp_replace(val, '[^0-9]', '', 'g')) BETWEEN 7 AND 15 AND replace(regexp_replace(val, '[^0-9]', '', 'g'), substr(regexp_replace(val, '[^0-9]', '', 'g'), 1, 1), '') <> '' AND NOT (length(regexp_replace(val, '[^0-9]', '', 'g')) = 11 AND regexp_matches(val, '^\s*(?:\+7|8|7)') AND substr(regexp_replace(val, '[^0-9]', '', 'g'), 2, 1) < '3')"


@query(
    "WITH " + _FOLDED + ", " + ", ".join(_OFFSETS.format(name=f"p{i}", kind="'PHONE'", re=r) for i, r in enumerate(_PHONE_RE))
    + ", c AS (SELECT DISTINCT doc_id, kind, s, s + length(val) AS e, val, t FROM (" + " UNION ALL ".join(f"SELECT * FROM p{i}_at" for i in range(3)) + f") JOIN f USING (doc_id) WHERE val IS NOT NULL AND {_PHONE_VALID})"
    + ", d AS (SELECT * FROM c WHERE NOT regexp_matches(substr(t, CAST(greatest(s, 1) AS INT), CASE WHEN s > 0 THEN 1 ELSE 0 END), '[0-9]') AND NOT regexp_matches(substr(t, CAST(e + 1 AS INT), 1), '[0-9]'))"
    + " SELECT a.doc_id, a.kind AS type, CAST(a.s AS BIGINT) AS start, CAST(a.e AS BIGINT) AS stop, a.val AS value FROM d a WHERE NOT EXISTS (SELECT 1 FROM d b WHERE b.doc_id = a.doc_id AND b.s < a.e AND a.s < b.e AND (b.e - b.s > a.e - a.s OR (b.e - b.s = a.e - a.s AND b.s < a.s)))"
)
def phone_spans(spark, sf):
    return _spans(pattern_spans.detect(documents(spark, sf), ("PHONE",)))


_LUHN = "list_sum(list_transform(range(1, length(val) + 1), lambda i: CASE WHEN (length(val) - i) % 2 = 1 THEN CASE WHEN CAST(substr(val, CAST(i AS INT), 1) AS INT) * 2 > 9 THEN CAST(substr(val, CAST(i AS INT), 1) AS INT) * 2 - 9 ELSE CAST(substr(val, CAST(i AS INT), 1) AS INT) * 2 END ELSE CAST(substr(val, CAST(i AS INT), 1) AS INT) END))"


@query("WITH " + _FOLDED + ", " + _OFFSETS.format(name="c", kind="'CARD_NUMBER'", re=_CARD_RE) + f" SELECT doc_id, kind AS type, CAST(s AS BIGINT) AS start, CAST(s + length(val) AS BIGINT) AS stop, val AS value FROM c_at JOIN f USING (doc_id) WHERE val IS NOT NULL AND ({_LUHN} % 10 = 0 OR regexp_matches(substr(t, CAST(greatest(1, s - 47) AS INT), CAST(least(48, s) AS INT)), 'карт|card|номер|pan|visa|mastercard|мир'))")
def card_spans(spark, sf):
    return _spans(pattern_spans.detect(documents(spark, sf), ("CARD_NUMBER",)))


PATTERN_TYPES = ("EMAIL", "PHONE", "CARD_NUMBER")
TYPE_BOOST = 0.15


_PHONE_LOCAL = r"\b\d{3}[\s\-]\d{2}[\s\-]\d{2}\b"
_CARDS = (r"\b\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{2,7}\b", r"\b\d{4}[ \-]\d{6}[ \-]\d{5}\b", _CARD_RE)
_CUES = {"PHONE": "тел|телефон|моб|сот|звон|номер|phone|whatsapp|telegram|контакт|связ", "CARD_NUMBER": "карт|card|номер|pan|visa|mastercard|мир"}
_HOTLINE = r"горяч[\p{L}\p{N}_]+\s+лини|служб[\p{L}\p{N}_]+\s+поддержки|колл-центр|call-центр|контакт-центр|справочн[\p{L}\p{N}_]+\s+служб"
_NEAR = "(regexp_matches(substr(t, CAST(greatest(1, s - 47) AS INT), CAST(least(48, s) AS INT)), '{0}') OR regexp_matches(substr(t, CAST(e + 1 AS INT), 48), '{0}'))"
_BEFORE = "regexp_matches(substr(t, CAST(greatest(1, s - 47) AS INT), CAST(least(48, s) AS INT)), '{0}')"
_DIGITS = "length(regexp_replace({0}, '[^0-9]', '', 'g'))"
_MASK_ENDS = f"list_aggregate(list_transform(range(1, length(v) + 1), lambda i: CASE WHEN NOT regexp_matches(substr(v, CAST(i AS INT), 1), '[0-9]') OR ({_DIGITS.format('v')} > 5 AND ({_DIGITS.format('substr(v, 1, CAST(i AS INT))')} <= 2 OR {_DIGITS.format('substr(v, 1, CAST(i AS INT))')} > {_DIGITS.format('v')} - 2)) THEN substr(v, CAST(i AS INT), 1) ELSE '*' END), 'string_agg', '')"


def _mask_documents_sql() -> str:
    """Candidates of the three types with their confidence, chosen greedily one after another, and the text put together again."""
    sources = [("EMAIL", _EMAIL_RE, 0.98, False), *(("PHONE", r, 0.92, False) for r in _PHONE_RE), ("PHONE", _PHONE_LOCAL, 0.8, True), *(("CARD_NUMBER", r, 0.9, False) for r in _CARDS)]
    ctes = [_FOLDED, *(_OFFSETS.format(name=f"x{i}", kind=f"'{k}'", re=r) for i, (k, r, _, _) in enumerate(sources))]
    luhn = _LUHN.replace("val", "d")
    every = " UNION ALL ".join(f"SELECT doc_id, kind, s, s + length(val) AS e, val, {c} AS base, {need} AS need FROM x{i}_at WHERE val IS NOT NULL" for i, (_, _, c, need) in enumerate(sources))
    ctes.append(f"c AS (SELECT *, regexp_replace(val, '[^0-9]', '', 'g') AS d FROM ({every}) JOIN f USING (doc_id))")
    cue = f"CASE kind WHEN 'PHONE' THEN {_BEFORE.format(_CUES['PHONE'])} WHEN 'CARD_NUMBER' THEN {_BEFORE.format(_CUES['CARD_NUMBER'])} ELSE false END"
    valid = f"CASE kind WHEN 'PHONE' THEN {_PHONE_VALID} WHEN 'CARD_NUMBER' THEN length(d) > 1 AND {luhn} % 10 = 0 ELSE true END"
    glued = "kind <> 'EMAIL' AND (regexp_matches(substr(t, CAST(greatest(s, 1) AS INT), CASE WHEN s > 0 THEN 1 ELSE 0 END), '[0-9]') OR regexp_matches(substr(t, CAST(e + 1 AS INT), 1), '[0-9]'))"
    ctes.append(f"j AS (SELECT *, {cue} AS cue, {valid} AS ok, CASE kind WHEN 'EMAIL' THEN 100 WHEN 'CARD_NUMBER' THEN 90 ELSE 80 END AS prio FROM c WHERE NOT ({glued}) AND NOT (kind = 'PHONE' AND {_NEAR.format(_HOTLINE)}))")
    sure = "CASE WHEN cue AND ok THEN least(CAST(base AS FLOAT) + CAST({boost} AS FLOAT), 1) WHEN cue THEN greatest(CAST(base AS FLOAT) - CAST(0.2 AS FLOAT), 0.5) ELSE CAST(base AS FLOAT) END".format(boost=TYPE_BOOST)
    ctes.append(f"k AS (SELECT doc_id, kind, s, e, row_number() OVER (PARTITION BY doc_id ORDER BY {sure} DESC, prio DESC, e - s DESC, s) AS n FROM j WHERE (ok OR (kind = 'CARD_NUMBER' AND cue)) AND (NOT need OR cue))")
    ctes.append("g AS (SELECT doc_id, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(kind VARCHAR, s BIGINT, e BIGINT)[]) AS held FROM documents UNION ALL SELECT g.doc_id, k.n, CASE WHEN len(list_filter(g.held, lambda h: h.s < k.e AND k.s < h.e)) > 0 THEN g.held ELSE list_append(g.held, {'kind': k.kind, 's': CAST(k.s AS BIGINT), 'e': CAST(k.e AS BIGINT)}) END FROM g JOIN k ON k.doc_id = g.doc_id AND k.n = g.n + 1)")
    ctes.append("h AS (SELECT doc_id, unnest(arg_max(held, n)) AS h FROM g GROUP BY doc_id)")
    ctes.append("p AS (SELECT doc_id, h.kind AS kind, h.s AS s, h.e AS e, coalesce(lag(h.e) OVER (PARTITION BY doc_id ORDER BY h.s), 0) AS last FROM h)")
    masked = f"CASE WHEN kind = 'EMAIL' THEN regexp_replace(v, '[\\p{{L}}\\p{{N}}]', '*', 'g') ELSE {_MASK_ENDS} END"
    ctes.append(f"q AS (SELECT doc_id, count(*) AS n, max(e) AS last, string_agg(gap || {masked}, '' ORDER BY s) AS shown FROM (SELECT p.*, substr(text, CAST(last + 1 AS INT), CAST(s - last AS INT)) AS gap, substr(text, CAST(s + 1 AS INT), CAST(e - s AS INT)) AS v FROM p JOIN documents USING (doc_id)) GROUP BY doc_id)")
    return "WITH RECURSIVE " + ", ".join(ctes) + " SELECT doc_id, coalesce(shown, '') || substr(text, CAST(coalesce(last, 0) + 1 AS INT)) AS masked, coalesce(n, 0) AS n_entities FROM documents LEFT JOIN q USING (doc_id)"


@query(_mask_documents_sql())
def mask_documents(spark, sf):
    """Pattern types found and masked in the JVM: the flagship over documents."""
    found = pattern_spans.detect(documents(spark, sf), PATTERN_TYPES)
    return found.select("doc_id", pattern_spans.mask_column(F.col("spans"), F.col("text"), PROFILES["reference"], PATTERN_TYPES).alias("masked"), F.size("spans").cast("long").alias("n_entities"))


@query("WITH " + _FOLDED + ", " + _OFFSETS.format(name="e", kind="'EMAIL'", re=_EMAIL_RE) + " SELECT kind AS type, count(*) AS n FROM e_at WHERE val IS NOT NULL GROUP BY kind")
def type_counts(spark, sf):
    found = pattern_spans.detect(documents(spark, sf), ("EMAIL",))
    return metrics.type_counts(found.withColumnRenamed("spans", "entities"))


# Texts built from keys, whose spans the builder knows. (type or None, before, values, after).

BUILT = [
    ("EMAIL", "Почта: ", ("ivanov.ivan@mail.ru", "a_b@site.example.com", "user@почта.рф"), " указана"),
    ("PHONE", "Телефон ", ("+7 925 123-45-67", "8 (925) 123-45-67", "89251234567"), ", звоните"),
    ("INN", "ИНН ", ("500100732259", "7707083893", "500100732258"), " организации"),
    ("CARD_NUMBER", "Карта ", ("4111 1111 1111 1111", "4111111111111111", "5500 0000 0000 0004"), " открыта"),
    ("CVV", "cvv2: ", ("321", "4321"), "; конец"),
    ("PIN", "пин-код ", ("4321", "123456"), ", конец"),
    ("PASSPORT", "Паспорт ", ("4509 123456", "45 09 № 123456", "4509123456"), ", копия"),
    ("DRIVER_LICENSE", "Водительское удостоверение ", ("77 АА 123456", "7712 123456"), " есть"),
    ("SNILS", "СНИЛС ", ("112-233-445 95", "112-233-445 96"), " указан"),
    ("FOREIGN_PASSPORT", "загранпаспорт ", ("71 1234567", "711234567"), " есть"),
    ("MILITARY_ID", "военный билет ", ("АБ 1234567", "ВГ № 123456"), " сдан"),
    ("BIRTH_CERTIFICATE", "свидетельство о рождении ", ("IV-АБ 123456", "II-МЮ № 654321"), " сдано"),
    ("RESIDENCE_PERMIT", "вид на жительство ", ("82 1234567", "82 № 7654321"), " выдано"),
    ("OMS_POLICY", "полис ОМС ", ("1234567890123456",), " действует"),
    ("BANK_ACCOUNT", "счет ", ("40817810099910004312",), " закрыт"),
    ("FIO", "Клиент ", ("Иванов Иван Иванович", "иванов иван иванович", "ПЕТРОВА АННА СЕРГЕЕВНА", "Смирнов И.И.", "Сергей Петрович Кузнецов"), " пришел"),
    ("BIRTH_DATE", "Дата рождения: ", ("12.05.1987", "1987-05-12", "12 мая 1987", "мая 12, 1987"), " по анкете"),
    ("PASSPORT_ISSUE_DATE", "дата выдачи ", ("15.06.2010", "15 июня 2010"), " верна"),
    ("BIRTH_PLACE", "место рождения: ", ("г. Казань", "Москва", "г. Тверь"), ", верно"),
    ("CITIZENSHIP", "Гражданство: ", ("Российская Федерация", "РФ", "Республика Беларусь"), "; верно"),
    ("PASSPORT_ISSUER", "выдан ", ("ОВД района Хамовники г. Москвы", "УФМС России по Свердловской области"), "; конец"),
    ("ADDRESS", "Адрес: ", ("г. Москва, ул. Тверская, д. 7, корп. 2, кв. 12", "101000, Россия, г. Казань, ул. Садовая, д. 5", "Московская обл., г. Мытищи, ул. Юбилейная, д. 5, кв. 17"), ""),
    ("CARD_HOLDER", "держатель ", ("IVAN IVANOV", "Anna Petrova"), " (карта)"),
    (None, "Заказ 4276 3800 1234 5678 оформлен, трек-номер ", ("123456789012", "123456789013"), ""),
    (None, "Горячая линия ", ("8 800 200-00-00", "8 800 555-35-35"), ", звонок бесплатный"),
    (None, "Отделение банка по адресу ", ("г. Москва, ул. Садовая, д. 27",), " работает до 20:00"),
    (None, "Встреча назначена на ", ("15.10.2026", "01.09.2026"), ""),
    (None, "Поэт ", ("Александр Пушкин",), " родился 6 июня 1799 года в Москве"),
]


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _built_sql(dialect: str) -> str:
    """k, type, before, value, after for each order, in either dialect."""
    n = len(BUILT)
    div = f"CAST(floor(o_orderkey / {n}) AS BIGINT)"
    row, values = f"(o_orderkey % {n})", []
    for i, (_, _, options, _) in enumerate(BUILT):
        pick = " ".join(f"WHEN {div} % {len(options)} = {j} THEN {_literal(v)}" for j, v in enumerate(options))
        values.append(f"WHEN {row} = {i} THEN CASE {pick} END")
    column = lambda k: "CASE " + " ".join(f"WHEN {row} = {i} THEN {_literal(b[k]) if b[k] is not None else 'NULL'}" for i, b in enumerate(BUILT)) + " END"
    return f"SELECT o_orderkey AS k, {column(0)} AS type, {column(1)} AS before, CASE {' '.join(values)} END AS value, {column(3)} AS after FROM orders"


def built(spark: SparkSession, sf: str, dealt: bool = True) -> DataFrame:
    table(spark, sf, "orders").createOrReplaceTempView("__built_orders")
    rows = spark.sql(_built_sql("spark").replace("FROM orders", "FROM __built_orders"))
    if dealt:  # keys are few bytes and the work on their texts is not: spread them beyond the scan's partitions
        rows = rows.repartition(spark.sparkContext.defaultParallelism)
    return rows.select("k", "type", "before", "value", "after", F.concat("before", "value", "after").alias("text"))


_BUILT = "WITH b AS (" + _built_sql("duckdb") + ")"


@query(_BUILT + " SELECT k, type, CAST(length(before) AS BIGINT) AS start, CAST(length(before) + length(value) AS BIGINT) AS stop, value FROM b WHERE type IS NOT NULL")
def detect_built(spark, sf):
    """Every type, one a text, and texts that hold none."""
    found = Engine().detect(built(spark, sf).select("k", "text"))
    e = found.select("k", "text", F.explode("entities").alias("e"))
    return e.select("k", F.col("e.type").alias("type"), F.col("e.start").alias("start"), F.col("e.end").alias("stop"), F.expr("substr(text, CAST(e.start AS INT) + 1, CAST(e.end - e.start AS INT))").alias("value"))


@query(_BUILT + " SELECT k, CAST(strlen(before) AS BIGINT) AS byte_start, CAST(strlen(before) + strlen(value) AS BIGINT) AS byte_stop FROM b WHERE type IS NOT NULL")
def byte_offsets(spark, sf):
    found = Engine().detect(built(spark, sf).select("k", "text"))
    return found.select("k", F.explode("entities").alias("e")).select("k", F.col("e.byte_start").alias("byte_start"), F.col("e.byte_end").alias("byte_stop"))


@query(_BUILT + r" SELECT k, CASE WHEN type IS NULL THEN before || value || after ELSE before || regexp_replace(value, '[\p{L}\p{N}]', '*', 'g') || after END AS masked FROM b")
def mask_built(spark, sf):
    engine = Engine(Config(systems=(System("full", anonymous=True, profile="full"),)))
    return engine.mask(built(spark, sf).select("k", "text")).select("k", "masked")


@query(_BUILT + " SELECT k, CASE WHEN type IS NULL THEN before || value || after ELSE before || '<' || type || '_1>' || after END AS masked FROM b")
def placeholder_built(spark, sf):
    engine = Engine(Config(systems=(System("chat", anonymous=True, profile="placeholder"),)))
    return engine.mask(built(spark, sf).select("k", "text")).select("k", "masked")


@query(_BUILT + " SELECT k, CASE WHEN type IS NULL THEN before || value || after ELSE before || after END AS masked FROM b")
def remove_built(spark, sf):
    engine = Engine(Config(profiles={**PROFILES, "gone": Profile(Strategy("remove"))}, systems=(System("gone", anonymous=True, profile="gone"),)))
    return engine.mask(built(spark, sf).select("k", "text")).select("k", "masked")


#: What stands between the parts of a large text: longer than any window of cue words.
GAP = "\n" + "~ " * 40 + "\n"
LARGE = 8


@query(_BUILT + rf""", p AS (SELECT k, before || regexp_replace(value, '[\p{{L}}\p{{N}}]', '*', 'g') || after AS m FROM b WHERE type IS NOT NULL)
SELECT k % {LARGE} AS part, CAST(count(*) AS BIGINT) AS n_entities, sha256(string_agg(m, '{GAP.replace(chr(10), "' || chr(10) || '")}' ORDER BY k)) AS masked_sha256 FROM p GROUP BY 1""")
def mask_large_texts(spark, sf):
    """A few texts with thousands of entities each: at sf0.1 about 2 MB and 15,000 entities. They grow with the table, so they come as rows."""
    rows = built(spark, sf, dealt=False).filter("type IS NOT NULL").select((F.col("k") % LARGE).alias("part"), "k", "text")
    engine = Engine(Config(systems=(System("full", anonymous=True, profile="full"),)))
    masked = engine.mask_long(rows, key="part", order="k", between=GAP, tasks=LARGE)
    return digests(masked.select("part", "masked", F.size("entities").alias("n_entities")), "part", "masked", "n_entities").withColumnRenamed("sha256", "masked_sha256")


@query(_BUILT + " SELECT type, count(*) AS tp, CAST(0 AS BIGINT) AS fp, CAST(0 AS BIGINT) AS fn FROM b WHERE type IS NOT NULL GROUP BY type UNION ALL SELECT 'micro', count(type), 0, 0 FROM b")
def quality_built(spark, sf):
    """The confusion counts of detection against what the builder put in."""
    rows = built(spark, sf).withColumnRenamed("k", "id")
    span = F.struct("type", F.length("before").cast("long").alias("start"), (F.length("before") + F.length("value")).cast("long").alias("end"))
    expected = evaluation.exploded(rows.select("id", F.when(F.col("type").isNotNull(), F.array(span)).otherwise(F.array().cast("array<struct<type:string,start:bigint,end:bigint>>")).alias("s")), "s")
    predicted = evaluation.exploded(Engine().detect(rows.select("id", "text")), "entities")
    return evaluation.confusion(evaluation.span_outcomes(expected, predicted)).select("type", "tp", "fp", "fn")


@query(_BUILT + " SELECT k, type, true AS changed, true AS valid FROM b WHERE type IN ('CARD_NUMBER', 'INN', 'PHONE', 'EMAIL', 'BANK_ACCOUNT')")
def synthetic_built(spark, sf):
    """Invented values in place of the real ones keep kind and checksum."""
    engine = Engine(Config(secret=SECRET, systems=(System("analytics", anonymous=True, profile="synthetic", demask=False),)))
    done = engine.mask(built(spark, sf).filter("type IN ('CARD_NUMBER', 'INN', 'PHONE', 'EMAIL', 'BANK_ACCOUNT')")).select("k", "type", "value", F.col("entries")[0]["mask"].alias("mask"))
    kind = F.col("type")
    valid = F.when(kind == "CARD_NUMBER", validators.luhn(F.col("mask"))).when(kind == "INN", validators.inn(F.col("mask"))).when(kind == "PHONE", validators.phone(F.col("mask"))).when(kind == "EMAIL", F.col("mask").rlike("^[a-z]+[0-9]{3}@example[.]com$")).otherwise(F.length("mask") == F.length("value"))
    return done.select("k", "type", (F.col("mask") != F.col("value")).alias("changed"), valid.alias("valid"))


@query(_BUILT + " SELECT k, type, CAST(length(before) AS BIGINT) AS start, CAST(length(before) + length(value) AS BIGINT) AS stop FROM b WHERE type IS NOT NULL")
def candidates_built(spark, sf):
    """Before anything is resolved, the true span of each text is among the candidates."""
    rows = built(spark, sf).filter("type IS NOT NULL").withColumn("start", F.length("before").cast("long")).withColumn("stop", (F.length("before") + F.length("value")).cast("long"))
    found = Engine().candidates(rows.select("k", "type", "start", "stop", "text"))
    return found.filter(F.exists("candidates", lambda c: (c["type"] == F.col("type")) & (c["start"] == F.col("start")) & (c["end"] == F.col("stop")))).select("k", "type", "start", "stop")


# Restoring, mappings and the protocol.


@query("SELECT doc_id, true AS same FROM documents")
def roundtrip_documents(spark, sf):
    engine = Engine()
    done = engine.restore(engine.mask(documents(spark, sf)), "masked")
    return done.select("doc_id", (F.col("restored") == F.col("text")).alias("same"))


@query(_BUILT + " SELECT k, before || value || after AS restored FROM b")
def roundtrip_built(spark, sf):
    engine = Engine(Config(systems=(System("chat", anonymous=True, profile="placeholder"),)))
    return engine.restore(engine.mask(built(spark, sf).select("k", "text")), "masked").select("k", "restored")


@query(_BUILT + " SELECT k, CASE WHEN type IS NULL THEN 'Ответ: ' || '; ' ELSE 'Ответ: ' || value || '; ' || value END AS restored FROM b")
def restore_rewritten(spark, sf):
    """An answer that uses a placeholder twice, once in another case."""
    engine = Engine(Config(systems=(System("chat", anonymous=True, profile="placeholder"),)))
    masked = engine.mask(built(spark, sf).select("k", "text"))
    mask = F.coalesce(F.try_element_at("entries", F.lit(1))["mask"], F.lit(""))
    answer = F.concat(F.lit("Ответ: "), mask, F.lit("; "), F.lower(mask))
    return engine.restore(masked.withColumn("answer", answer).withColumn("exact", F.lit(False)), "answer", "entries", "exact").select("k", "restored")


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Four requests an id: a text, the text again, its mask, and the mask inside an answer."""
    ids = table(spark, sf, "conversations").select("conv_id").distinct()
    mail = F.concat(F.lit("user"), F.col("conv_id").cast("string"), F.lit("@mail.ru"))
    hidden = F.regexp_replace(mail, "[a-z0-9]", "*")
    first, masked = F.concat(F.lit("Почта "), mail), F.concat(F.lit("Почта "), hidden)
    made = F.array(*[F.struct(F.lit(i).cast("long").alias("seq"), p.alias("payload")) for i, p in enumerate((first, first, masked, F.concat(F.lit("Ответ на "), hidden)), 1)])
    return ids.select(F.col("conv_id").cast("string").alias("payload_id"), F.explode(made).alias("r")).select("payload_id", "r.seq", "r.payload")


_PROTOCOL = r"""WITH c AS (SELECT DISTINCT conv_id, 'user' || conv_id || '@mail.ru' AS mail FROM conversations), r AS (SELECT conv_id, mail, unnest([1, 2, 3, 4]) AS seq FROM c)
SELECT CAST(conv_id AS VARCHAR) AS payload_id, CAST(seq AS BIGINT) AS seq, CASE seq WHEN 1 THEN 'mask' WHEN 2 THEN 'mask' WHEN 3 THEN 'demask_exact' ELSE 'demask_substitute' END AS direction,
CASE WHEN seq <= 2 THEN 'Почта ' || regexp_replace(mail, '[a-z0-9]', '*', 'g') WHEN seq = 3 THEN 'Почта ' || mail ELSE 'Ответ на ' || mail END AS result FROM r"""


@query(_PROTOCOL)
def process_state_machine(spark, sf):
    return Engine().process(requests(spark, sf)).select("payload_id", "seq", "direction", "result")


@query(_PROTOCOL)
def process_stream(spark, sf):
    """The same protocol as a stream over files, with a state for each id."""
    from cloakwork.streaming.process import process_stream as stream

    source, sink, state = (shared_path(spark, f"process-{n}") for n in ("in", "out", "state"))
    rows = requests(spark, sf)
    rows.write.parquet(source)
    out = stream(spark.readStream.schema(rows.schema).parquet(source), Engine())
    out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(sink).select("payload_id", "seq", "direction", "result")


@query("SELECT DISTINCT 'mk:default:' || sha256(CAST(conv_id AS VARCHAR)) AS key, 'mask ' || CAST(conv_id AS VARCHAR) AS kept FROM conversations")
def create_only_store(spark, sf):
    """A key that the store has is never written again."""
    ids = table(spark, sf, "conversations").select("conv_id").distinct()
    row = lambda note, keep: ids.filter(keep).select(mapping_key(F.lit("default"), F.col("conv_id").cast("string")).alias("key"), F.concat(F.lit(note), F.col("conv_id").cast("string")).alias("kept"), F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    store, new = row("mask ", F.col("conv_id") % 2 == 0), row("later ", F.col("conv_id") % 2 == 0).unionByName(row("mask ", F.col("conv_id") % 2 != 0))
    return store.unionByName(add_mappings(store, new)).select("key", "kept")


@query("SELECT conv_id, turn, text AS opened, true AS sealed FROM conversations")
def sealed_texts(spark, sf):
    rows = table(spark, sf, "conversations").withColumn("box", seal(F.col("text"), SECRET))
    return rows.select("conv_id", "turn", unseal(F.col("box"), SECRET).alias("opened"), (F.length("box") == F.octet_length("text") + 28).alias("sealed"))


@query("SELECT conv_id, 403 AS status, 'DEMASK_FORBIDDEN' AS code, CAST(NULL AS VARCHAR) AS restored FROM (SELECT DISTINCT conv_id FROM conversations)")
def demask_forbidden(spark, sf):
    engine = Engine(Config(systems=(System("analytics", anonymous=True, demask=False),)))
    rows = table(spark, sf, "conversations").select("conv_id").distinct().select("conv_id", F.col("conv_id").cast("string").alias("payload_id"), F.lit("x").alias("text"))
    store = engine.mappings(engine.mask(rows))
    return engine.demask(rows, store).select("conv_id", "status", "code", "restored")


@query("SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 404 ELSE 200 END AS status, CASE WHEN conv_id % 3 = 0 THEN NULL ELSE 'Почта u' || conv_id || '@mail.ru' END AS restored FROM (SELECT DISTINCT conv_id FROM conversations)")
def demask_from_store(spark, sf):
    engine = Engine()
    rows = table(spark, sf, "conversations").select("conv_id").distinct().select("conv_id", F.col("conv_id").cast("string").alias("payload_id"), F.concat(F.lit("Почта u"), F.col("conv_id").cast("string"), F.lit("@mail.ru")).alias("text"))
    masked = engine.mask(rows)
    store = engine.mappings(masked.filter("conv_id % 3 <> 0"))
    return engine.demask(masked.select("conv_id", "payload_id", F.col("masked").alias("text")), store).select("conv_id", "status", "restored")


_CHAT = "SELECT conv_id, turn, 'mail u' || (conv_id + turn) % 3 || '@site.com, then u' || (conv_id + 2 * turn) % 4 || '@site.com' AS text, 'u' || (conv_id + turn) % 3 AS a, 'u' || (conv_id + 2 * turn) % 4 AS b FROM conversations"


@query(
    f"WITH t AS ({_CHAT}), v AS (SELECT conv_id, turn, 1 AS p, a AS v FROM t UNION ALL SELECT conv_id, turn, 2, b FROM t), first AS (SELECT conv_id, v, min(turn * 2 + p) AS f FROM v GROUP BY conv_id, v), n AS (SELECT conv_id, v, row_number() OVER (PARTITION BY conv_id ORDER BY f) AS n FROM first)"
    " SELECT t.conv_id, t.turn, 'mail <EMAIL_' || x.n || '>, then <EMAIL_' || y.n || '>' AS masked FROM t JOIN n x ON x.conv_id = t.conv_id AND x.v = t.a JOIN n y ON y.conv_id = t.conv_id AND y.v = t.b"
)
def conversation_placeholders(spark, sf):
    """One value has one number through a conversation."""
    table(spark, sf, "conversations").createOrReplaceTempView("__chat")
    rows = spark.sql(_CHAT.replace("FROM conversations", "FROM __chat")).select("conv_id", "turn", "text")
    engine = Engine(Config(systems=(System("chat", anonymous=True, profile="placeholder"),)))
    return engine.mask_conversations(rows).select("conv_id", "turn", "masked")


@query("SELECT conv_id, turn, CAST(unnest([0, 1]) AS BIGINT) AS part, unnest(['a ' || turn, 'b']) AS text FROM conversations")
def chat_parts(spark, sf):
    """Chat requests whose content is a list of parts."""
    body = F.to_json(F.struct(F.array(F.struct(F.col("role"), F.array(F.struct(F.concat(F.lit("a "), F.col("turn").cast("string")).alias("text")), F.struct(F.lit("b").alias("text"))).alias("content"))).alias("messages")))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", body.alias("body"))
    return chat_messages(rows).select("conv_id", "turn", F.col("part").cast("long").alias("part"), "text")


@query("SELECT DISTINCT conv_id, substr(sha256(CAST(conv_id AS VARCHAR)), 1, 12) AS payload_id_hash, 'EMAIL:1' AS types, CAST(strlen('Почта u@mail.ru') AS BIGINT) AS text_bytes FROM conversations")
def request_log(spark, sf):
    """What is logged of a request holds no text."""
    rows = table(spark, sf, "conversations").select("conv_id").distinct().select("conv_id", F.col("conv_id").cast("string").alias("payload_id"), F.lit("Почта u@mail.ru").alias("payload"))
    done = Engine().detect(rows, text="payload").select("*", F.lit("default").alias("system"), F.lit("mask").alias("direction"), F.lit(200).alias("status"))
    ids = rows.select("conv_id", F.substring(F.sha2("payload_id", 256), 1, 12).alias("payload_id_hash"))
    return log_rows(done).join(ids, "payload_id_hash").select("conv_id", "payload_id_hash", "types", F.col("text_bytes").cast("long").alias("text_bytes"))


# Request metrics, with events as the log.


def _log(spark, sf):
    return table(spark, sf, "events").select("ts", F.col("event_type").alias("route"), F.col("value"), "user_id")


_ALIGN = "make_timestamp(CAST(floor(epoch(ts) / {s}) * {s} * 1000000 AS BIGINT))"


@query(f"SELECT {_ALIGN.format(s=120)} AS start, event_type AS route, count(*) AS n, count(*) / 120.0::DOUBLE AS rate FROM events GROUP BY 1, 2")
def metrics_rate_2m(spark, sf):
    return metrics.windowed_rate(_log(spark, sf))


@query("SELECT make_timestamp(CAST((floor(epoch(ts) / 60) - o) * 60 * 1000000 AS BIGINT)) AS start, event_type AS route, CAST(sum(user_id) AS BIGINT) AS total FROM events, (SELECT unnest(range(0, 5)) AS o) GROUP BY 1, 2")
def metrics_increase_5m(spark, sf):
    return metrics.windowed_sum(_log(spark, sf), "user_id")


@query("SELECT event_type AS route, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def stage_mean(spark, sf):
    return metrics.mean_by(_log(spark, sf), "value").select("route", F.round("mean", 6).alias("mean"))


@query(f"SELECT {_ALIGN.format(s=120)} AS start, event_type AS route, max(value) AS maximum FROM events GROUP BY 1, 2")
def gauge_max(spark, sf):
    return metrics.maximum_by_window(_log(spark, sf), "value")


@query("SELECT event_type AS route, list_sort(list(value))[CAST(floor((count(*) - 1) * 0.95 + 0.5) AS BIGINT) + 1] AS percentile FROM events GROUP BY 1")
def nearest_rank_p95(spark, sf):
    return metrics.nearest_rank(_log(spark, sf), "value", 0.95)


_EDGES = metrics.BUCKETS


def _quantile_sql(q: float) -> str:
    cases = []
    for i, e in enumerate(_EDGES):
        low, below = (_EDGES[i - 1], f"b{i - 1}") if i else (0.0, "0")
        cases.append(f"WHEN b{i} >= {q} * total THEN {low} + ({e} - {low}) * CASE WHEN b{i} - {below} > 0 THEN ({q} * total - {below}) / CAST(b{i} - {below} AS DOUBLE) ELSE 1.0 END")
    counts = ", ".join(f"count(*) FILTER (value / 100 <= {e}) AS b{i}" for i, e in enumerate(_EDGES))
    return f"WITH b AS (SELECT event_type AS route, count(value) AS total, {counts} FROM events GROUP BY 1) SELECT route, round(CAST(CASE {' '.join(cases)} ELSE {_EDGES[-1]} END AS DOUBLE), 9) AS p95 FROM b"


@query(_quantile_sql(0.95))
def latency_p95(spark, sf):
    log = _log(spark, sf).withColumn("seconds", F.col("value") / 100)
    return metrics.bucket_counts(log, "seconds").select("route", F.round(metrics.bucket_quantile(0.95), 9).alias("p95"))
