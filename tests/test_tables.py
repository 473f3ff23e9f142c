"""Sources, stores, evaluation and the engine's table operators, with odd input."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from cloakwork.functions import masks, text, validators
from cloakwork.operators import evaluation, generation, metrics, pattern_spans
from cloakwork.operators.detectors import Candidate
from cloakwork.operators.folding import Text
from cloakwork.operators.masking import full, initials, partial
from cloakwork.plans import long_texts
from cloakwork.plans.catalog import PROFILES, Config, System
from cloakwork.plans.engine import Engine, compiled
from cloakwork.sources import tables
from cloakwork.sources.config import read_config
from cloakwork.sources.dictionaries import dictionaries, read_word_list
from cloakwork.sources.tables import digests

TEXTS = ["Клиент Иванов Иван Иванович, паспорт 4509 123456", "почта a.b@mail.ru и +7 925 123-45-67", "4111 1111 1111 1111", "", None, "İ x@y.ru ё– 1"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "id long, text string, entities string")


def test_mask_and_restore_keep_rows(texts):
    engine = Engine()
    masked = engine.mask(texts)
    assert masked.columns == ["id", "text", "masked", "entries", "entities"] and masked.count() == len(TEXTS)
    back = {r.id: r.restored for r in engine.restore(masked, "masked").collect()}
    assert back == dict(enumerate(TEXTS))
    assert engine.detect(texts.limit(0)).count() == 0


def test_demask_from_a_store(spark, texts):
    engine = Engine()
    masked = engine.mask(texts.filter("text <> ''").select(F.col("id").alias("payload_id"), "text"))
    store = engine.mappings(masked.filter("payload_id < 2"))
    rows = masked.select("payload_id", F.col("masked").alias("text"))
    got = {r.payload_id: (r.restored, r.status, r.code) for r in engine.demask(rows, store).collect()}
    assert got[0] == (TEXTS[0], 200, None) and got[1] == (TEXTS[1], 200, None) and got[2] == (None, 404, "MAPPING_NOT_FOUND")
    assert tables.alive(store, 3600).count() == 2 and tables.alive(store, 3600, F.lit("2100-01-01").cast("timestamp")).count() == 0
    assert tables.add_mappings(store, store.unionByName(store)).count() == 0


def test_process_rejects_and_forbids(spark):
    rows = spark.createDataFrame([("", 1, "x"), ("a", 1, "почта a@b.ru"), ("a", 2, "почта a@b.ru"), ("a", 3, "иное"), (None, 2, "x")], "payload_id string, seq long, payload string")
    engine = Engine(Config(systems=(System("s", anonymous=True, demask=False),)))
    got = {(r.payload_id, r.seq): (r.direction, r.status, r.code) for r in engine.process(rows).collect()}
    assert got == {("", 1): ("error", 400, "INVALID_REQUEST"), (None, 2): ("error", 400, "INVALID_REQUEST"), ("a", 1): ("mask", 200, None), ("a", 2): ("mask", 200, None), ("a", 3): ("error", 403, "DEMASK_FORBIDDEN")}


def test_keys_name_systems():
    engine = Engine(Config(systems=(System("open", anonymous=True), System("keyed", api_keys=("k1",)), System("off", enabled=False, api_keys=("k2",)))))
    assert engine.system_of_key("k1").id == "keyed" and engine.system_of_key(None).id == "open" and engine.system_of_key(None, "keyed").id == "keyed"
    for key in ("k2", "wrong"):
        with pytest.raises(PermissionError):
            engine.system_of_key(key)
    assert engine.check() == []


def test_golden_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    row = {"id": "a", "category": "x", "text": "т", "entities": [{"type": "FIO", "start": 0, "end": 2}], "masked": "*"}
    (tmp_path / "in/a.jsonl").write_text("# note\n\n" + json.dumps(row, ensure_ascii=False) + "\n" + json.dumps(row | {"id": "b", "entities": []}) + "\n")
    records = tables.read_golden(spark, str(tmp_path / "in"))
    tables.write_golden(records, str(tmp_path / "out"))
    assert sorted(r.id for r in tables.read_golden(spark, str(tmp_path / "out")).collect()) == ["a", "b"]
    (tmp_path / "in/b.jsonl").write_text("{broken\n")
    with pytest.raises(Exception, match=r"malformed record at .*b\.jsonl:1"):
        tables.read_golden(spark, str(tmp_path / "in")).collect()


def test_requests_texts_and_lists(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"payload":"x","payload_id":"1"}\n{"payload":"x","payload_id":" "}\n{bad\n')
    assert sorted(r.status for r in tables.read_requests(spark, str(tmp_path / "r.jsonl")).collect()) == [200, 400, 400]
    (tmp_path / "t.txt").write_text("a\nb")
    assert tables.read_texts(spark, str(tmp_path / "t.txt")).first().text == "a\nb"
    (tmp_path / "surnames.txt").write_text("# list\nЁлкин\n\n Толстой \n")
    assert [r.value for r in read_word_list(spark, str(tmp_path / "surnames.txt")).collect()] == ["елкин", "толстой"]
    assert {"елкин", "толстой"} <= dictionaries(str(tmp_path)).surnames
    (tmp_path / "c.yaml").write_text("masking: {secret: '${S:-d}'}\nsystems:\n  - {id: a, auth: {anonymous: true}, profile: token}\n")
    assert read_config(tmp_path / "c.yaml", {"S": "x"}).secret == "x" and read_config(tmp_path / "c.yaml", {}).secret == "d"


def test_chat_parts(spark):
    body = json.dumps({"messages": [{"role": "user", "content": "hi"}, {"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image"}, {"text": "b"}]}]})
    got = tables.chat_messages(spark.createDataFrame([(1, body), (2, None)], "id long, body string")).collect()
    assert sorted((r.message, r.part, r.text) for r in got) == [(0, 0, "hi"), (1, 0, "a"), (1, 2, "b")]


def test_sealing(spark):
    d = spark.createDataFrame([("тайна",), ("",), (None,)], "t string").withColumn("box", tables.seal(F.col("t"), "k")).cache()
    assert [r[0] for r in d.select(tables.unseal(F.col("box"), "k")).collect()] == ["тайна", "", None]
    assert [r[0] for r in d.select(tables.unseal(F.col("box"), "other")).collect()] == [None, None, None]


def test_columns_equal_the_engine(spark, texts):
    """The JVM path and the Arrow path give the same spans and masks."""
    types = ("EMAIL", "PHONE", "CARD_NUMBER", "PASSPORT", "INN", "SNILS", "CVV")
    plain = spark.createDataFrame([(i, t) for i, t in enumerate(["чек на a.b@box.ru и +7 913 640-27-58", "карта 4000 0566 5566 5556, cvv: 907", "паспорт 6104 778301 ИНН 526317984689", "снилс 160-722-394 47; 8 800 200", "+1 (618) 555-0147 x", "пусто", "код 6104 7783017", "İİİ orlova@box.ru конец", "aİ 8 (913) 640-27-58İ, İorlova@box.ru", "ΣΑΣ orlova@box.ru", "a" * 300 + "İ" + "b@box.ru"])], "id long, text string")
    found = pattern_spans.detect(plain, types)
    masked = found.select("id", F.transform("spans", lambda s: F.struct(s["type"], s["start"], s["end"])).alias("s"), pattern_spans.mask_column(F.col("spans"), F.col("text"), PROFILES["reference"]).alias("m"))
    engine = Engine(Config(systems=(System("s", anonymous=True, pii_types=types),)))
    want = {r.id: ([(e.type, e.start, e.end) for e in r.entities], r.masked) for r in engine.mask(plain).collect()}
    assert {r.id: ([tuple(x) for x in r.s], r.m) for r in masked.collect()} == want
    assert sum(len(x) for x, _ in want.values()) >= 8


def test_mask_columns_equal_the_masker(spark):
    values = ["Орлов Д.С.", "1234", "123456", "a-b", "—", "", "23.11.1974", "orlova@box.ru", "Ёж ёж"]
    d = spark.createDataFrame([(v,) for v in values], "v string").select("v", masks.full(F.col("v")).alias("full"), masks.partial(F.col("v")).alias("partial"), masks.partial(F.col("v"), mask_chars="digits").alias("digits"), masks.initials(F.col("v")).alias("initials"), text.transliterate(F.lower("v")).alias("latin"))
    for r in d.collect():
        assert (r.full, r.partial, r.digits, r.initials) == (full(r.v), partial(r.v), partial(r.v, mask_chars="digits"), initials(r.v))


def test_evaluation_counts(spark):
    span = "array<struct<type:string,start:bigint,end:bigint>>"
    rows = [("a", [("FIO", 0, 10), ("ADDRESS", 20, 30)], [("FIO", 1, 10), ("ADDRESS_CITY", 40, 44)]), ("b", [("INN", 0, 4)], [("CVV", 1, 3)]), ("c", [], [])]
    d = spark.createDataFrame(rows, f"id string, e {span}, p {span}")
    e, p = evaluation.exploded(d, "e"), evaluation.exploded(d, "p")
    outcomes = evaluation.span_outcomes(e, p)
    got = {r.type: (r.tp, r.fp, r.fn) for r in evaluation.confusion(outcomes).collect()}
    assert got == {"FIO": (1, 0, 0), "ADDRESS": (0, 1, 1), "INN": (0, 0, 1), "micro": (1, 1, 2)}
    records = spark.createDataFrame([("a", "я" * 50), ("b", "x" * 9)], "id string, text string")
    assert {r.id: (r.leak_chars, r.expected_bytes) for r in evaluation.leaks(records, e, p).collect()} == {"a": (11, 40), "b": (2, 4)}


def test_quality_of_the_generated_corpus(spark):
    totals, by_type, failures = evaluation.evaluate(Engine(), generation.generate(spark, 8, 10))
    rows, total = [r.asDict() for r in by_type.collect()], totals.first().asDict()
    assert evaluation.passes(rows, 0.95), evaluation.markdown(total, rows, [f.asDict() for f in failures.collect()])
    assert total["restored_exactly"] == total["records"] and total["negative_clean"] == total["negative_records"]


def test_metrics_on_empty_and_tied_values(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 5.0), ("b", None)], "route string, v double")
    assert {r.route: r.percentile for r in metrics.nearest_rank(d.dropna(), "v", 0.5).collect()} == {"a": 1.0}
    assert metrics.nearest_rank(d.limit(0), "v", 0.5).count() == 0
    q = metrics.bucket_counts(d, "v").select("route", metrics.bucket_quantile(0.5).alias("q")).collect()
    assert {r.route: r.q for r in q}["b"] is None


def test_validators_take_odd_values(spark):
    d = spark.createDataFrame([("",), (None,), ("abc",), ("0" * 11,)], "v string")
    for f in (validators.luhn, validators.inn, validators.snils, validators.phone):
        assert d.select(f(F.col("v"))).count() == 4


def test_own_detectors_join_in():
    from cloakwork.operators.detectors import Detectors

    class Ticket:
        def find(self, t, places):
            yield Candidate(0, 2, "TICKET", 1.0, "own")

    found = Detectors(Config(), dictionaries(), (Ticket(),)).candidates(Text("ab"))
    assert [c.type for c in found] == ["TICKET"]


def test_sql_functions(spark):
    Engine().register(spark)
    assert spark.sql("SELECT mask_pii('почта a@b.ru') AS m, size(detect_pii('почта a@b.ru')) AS n").first() == ("почта *@*.**", 1)


def test_reload_keeps_the_last_valid_version(tmp_path):
    from cloakwork.streaming.reload import ReloadingEngine

    path = tmp_path / "c.yaml"
    path.write_text("systems: [{id: a, auth: {anonymous: true}}]")
    held = ReloadingEngine(str(path))
    path.write_text("systems: [{id: bb, auth: {anonymous: true}}]")
    assert held.current().config.systems[0].id == "bb" and held.error is None
    path.write_text("systems: [{id: c, profile: unknown}]")
    assert held.current().config.systems[0].id == "bb" and "unknown" in held.error


def test_rates_of_a_stream_with_late_rows(spark, tmp_path):
    from cloakwork.streaming.process import windowed_rates

    spark.createDataFrame([("2024-01-01 00:00:01", "a"), ("2024-01-01 00:01:59", "a"), ("2024-01-01 00:02:00", "b")], "ts string, route string").select(F.to_timestamp("ts").alias("ts"), "route").write.parquet(str(tmp_path / "in"))
    out = windowed_rates(spark.readStream.schema("ts timestamp, route string").parquet(str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert sorted((r.route, r.n, round(r.rate, 6)) for r in spark.table("rates").collect()) == [("a", 2, round(2 / 120, 6)), ("b", 1, round(1 / 120, 6))]


def test_conversations_without_a_key_stand_alone(spark):
    rows = spark.createDataFrame([(None, 1, "на a@b.ru"), (None, 2, "и c@d.ru"), (7, 2, "и e@f.ru, a@b.ru"), (7, 1, "на a@b.ru"), (8, 1, None)], "conv_id long, turn long, text string")
    engine = Engine(Config(systems=(System("chat", anonymous=True, profile="placeholder"),)))
    got = sorted((r.conv_id or 0, r.turn, r.masked) for r in engine.mask_conversations(rows).collect())
    assert got == [(0, 1, "на <EMAIL_1>"), (0, 2, "и <EMAIL_1>"), (7, 1, "на <EMAIL_1>"), (7, 2, "и <EMAIL_2>, <EMAIL_1>"), (8, 1, None)]
    assert engine.mask_conversations(rows.limit(0)).count() == 0


def test_replies_are_restored_by_conversation(spark):
    turns = spark.createDataFrame([(1, 1, "на a@b.ru"), (2, 1, "пусто")], "conv_id long, turn long, text string")
    replies = spark.createDataFrame([(1, "пишу <EMAIL_1>"), (2, "да"), (3, "кому?"), (1, None)], "conv_id long, reply string")
    engine = lambda demask: Engine(Config(systems=(System("chat", anonymous=True, profile="placeholder", demask=demask),)))
    got = sorted((r.conv_id, r.status, r.restored or "", r.code or "", r.n_entities, r.types) for r in engine(True).chat_round(turns, replies).collect())
    assert got == [(1, 200, "пишу a@b.ru", "", 1, "EMAIL"), (1, 502, "", "UPSTREAM_ERROR", 1, "EMAIL"), (2, 200, "да", "", 0, ""), (3, 404, "", "MAPPING_NOT_FOUND", 0, "")]
    assert {r.restored for r in engine(False).chat_round(turns, replies.limit(1)).collect()} == {"пишу <EMAIL_1>"}


def test_an_expected_span_takes_its_second_choice(spark):
    span = "array<struct<type:string,start:bigint,end:bigint>>"
    d = spark.createDataFrame([("a", [("FIO", 0, 10), ("FIO", 1, 10)], [("FIO", 0, 10), ("FIO", 4, 10)])], f"id string, e {span}, p {span}")
    pairs = evaluation.matched_spans(evaluation.exploded(d, "e"), evaluation.exploded(d, "p")).collect()
    assert sorted((x.e_place, x.p_place) for x in pairs) == [(0, 0), (1, 1)]


def test_equal_numbers_are_taken_by_text(spark):
    rows = spark.createDataFrame([("a", 1, "б a@b.ru"), ("a", 1, "а a@b.ru")], "payload_id string, seq long, payload string")
    got = {r.result: r.direction for r in Engine().process(rows).collect()}
    assert got["а *@*.**"] == "mask" and "demask_substitute" in got.values()


def test_sealed_bytes():
    from cloakwork.operators.sealing import open_bytes, seal_bytes

    for data in (b"", b"x", "тайна".encode() * 50):
        box = seal_bytes("k", data)
        assert open_bytes("k", box) == data and data[:4] not in box[16:] or not data
        for bad, secret in ((box[:-1] + bytes([box[-1] ^ 1]), "k"), (box, "other"), (box[:20], "k")):
            with pytest.raises(ValueError, match="open"):
                open_bytes(secret, bad)


def test_stream_mappings_end_and_are_sealed(spark, tmp_path):
    import time

    from cloakwork.streaming.process import process_stream

    schema, source, out, state = "payload_id string, seq long, payload string", str(tmp_path / "in"), str(tmp_path / "out"), tmp_path / "state"
    engine = Engine(Config(secret="s", systems=(System("s", anonymous=True),)))

    def answer(number, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        for _ in range(60):
            got = {r.payload_id: (r.direction, r.result) for r in spark.read.schema(stream.schema).parquet(out).filter(f"seq = {number}").collect()}
            if len(got) == len(rows):
                return got
            time.sleep(0.5)
        raise AssertionError("no answer")

    spark.createDataFrame([], schema).write.parquet(source)
    stream = process_stream(spark.readStream.schema(schema).parquet(source), engine, ttl_ms=4000)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(state)).trigger(processingTime="500 milliseconds").start()
    try:
        masked = "чек на **********@***.**"
        first = answer(1, [("a", 1, "чек на secretname@box.ru")])
        assert first == {"a": ("mask", masked)}
        assert b"secretname" not in b"".join(f.read_bytes() for f in state.rglob("*") if f.is_file())
        time.sleep(5)
        assert answer(2, [("b", 2, "пусто")])["b"][0] == "mask"  # a's mapping ends in a batch of its own or this one
        time.sleep(2)
        assert answer(3, [("a", 3, masked)]) == {"a": ("mask", masked)}
    finally:
        query.stop()


def test_commands(spark, tmp_path, capsys):
    from cloakwork.__main__ import main

    (tmp_path / "t.txt").write_text("чек на a@b.ru")
    assert main(["mask", str(tmp_path / "t.txt"), str(tmp_path / "out")], spark) == 0
    row = spark.read.json(str(tmp_path / "out")).first()
    assert row.masked == "чек на *@*.**" and row.entities[0]["type"] == "EMAIL"
    assert main(["generate", str(tmp_path / "made"), "--per-category", "3", "--negatives", "2"], spark) == 0
    assert main(["evaluate", str(tmp_path / "made")], spark) == 0
    assert "| micro |" in capsys.readouterr().out
    assert main(["evaluate", str(tmp_path / "made"), "--least-f1", "1.1"], spark) == 1
    (tmp_path / "bad.yaml").write_text("nonsense: 1")
    assert main(["--config", str(tmp_path / "bad.yaml"), "generate", str(tmp_path / "x")], spark) == 2


def test_texts_that_come_as_rows(spark):
    """Texts that grow with the table are held in pieces, and come back in order with the whole's digest and offsets."""
    engine, gap = Engine(), "\n" + "~ " * 40 + "\n"
    texts = {k: [None if i % 50 == 7 else f"Почта user{i}@mail.ru, клиент Орлов Денис" for i in range(n)] for k, n in ((0, 3000), (1, 1), (5, 40), (None, 3))}
    rows = spark.createDataFrame([(k, i, t) for k, v in texts.items() for i, t in enumerate(v)], "key long, order long, text string").repartition(7)
    for tasks in (None, 4):
        pieces = engine.mask_long(rows, between=gap, tasks=tasks)
        size = pieces.agg(F.max(F.length("masked"))).first()[0]
        assert size < 3 * long_texts.PIECE and pieces.filter("key = 0").count() > 3
        whole = compiled(engine.blob)
        for x in digests(pieces.select("key", "masked", F.size("entities").alias("n")), "key", "masked", "n").collect():
            masked, entries, _ = whole.mask(gap.join(t or "" for t in texts[x.key]), "default")
            assert (x.n, x.sha256) == (len(entries), hashlib.sha256(masked.encode()).hexdigest())
        last = max(r.start for r in pieces.filter("key = 0").select(F.explode("entities").alias("e")).select("e.start").collect())
        assert last == max(e.start for e in whole.detect(gap.join(t or "" for t in texts[0]), "default"))
