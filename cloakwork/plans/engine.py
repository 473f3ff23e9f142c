"""The engine: DataFrames of texts in, entities, masked texts and restored texts out.

Columns are mapped in Arrow batches, since names and addresses need a grammar; a worker
compiles a configuration once. Each text is independent, so nothing is shuffled but
what is keyed: conversations and mappings.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from cloakwork.operators.detectors import Candidate, Detectors
from cloakwork.operators.folding import Text
from cloakwork.operators.masking import Entry, Masker, MaskState
from cloakwork.operators.resolver import Entity, Resolver
from cloakwork.operators.restoring import masked_again, restore
from cloakwork.sources.dictionaries import dictionaries
from cloakwork.sources.tables import ENTRY, mapping_key

from . import long_texts
from .catalog import Config, ConfigError, System

ENTITY = "struct<type:string,start:bigint,end:bigint,byte_start:bigint,byte_end:bigint,confidence:float,evidence:string>"
ENTITIES, ENTRIES = f"array<{ENTITY}>", f"array<{ENTRY}>"
CANDIDATE = "struct<type:string,start:bigint,end:bigint,confidence:float,detector:string,evidence:string,weak:boolean>"
_ENTITY = pa.list_(pa.struct([("type", pa.string()), *((n, pa.int64()) for n in ("start", "end", "byte_start", "byte_end")), ("confidence", pa.float32()), ("evidence", pa.string())]))
_ENTRY = pa.list_(pa.struct([("type", pa.string()), *((n, pa.int64()) for n in ("start", "end", "masked_start", "masked_end")), ("mask", pa.string()), ("original", pa.string())]))
_CANDIDATE = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("confidence", pa.float32()), ("detector", pa.string()), ("evidence", pa.string()), ("weak", pa.bool_())]))


class Compiled:
    """A configuration ready to run over single texts."""

    def __init__(self, config: Config):
        self.config = config
        self.lists = dictionaries(config.dictionary_dir, config.dictionary_extra, config.allowlists.public_persons)
        self.detectors = Detectors(config, self.lists)
        self.resolver = Resolver(config)
        self.systems = {s.id: (s, config.allowed(s), Masker(config.profile_of(s), self.lists, config.secret)) for s in config.systems}

    def candidates(self, text: str) -> list[Candidate]:
        return self.detectors.candidates(Text(text))

    def detect(self, text: str, system: str) -> list[Entity]:
        s, allowed, _ = self.systems[system]
        t = Text(text)
        return self.resolver.resolve(t, self.detectors.candidates(t), s, allowed)

    def reach(self, system: str) -> int | None:
        return long_texts.reach(self.config, self.systems[system][0], self.lists.place_kinds)

    def mask(self, text: str, system: str, state: MaskState | None = None) -> tuple[str, list[Entry], list[Entity]]:
        entities = self.detect(text, system)
        return (*self.systems[system][2].mask(text, entities, state), entities)


_compiled: dict[str, Compiled] = {}


def compiled(blob: bytes) -> Compiled:
    key = hashlib.sha256(blob).hexdigest()
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = Compiled(pickle.loads(blob))
    return _compiled[key]


def entity_rows(text: str, entities: list[Entity]) -> list[dict]:
    if not entities:
        return []
    t = Text(text)
    return [{"type": e.type, "start": e.start, "end": e.end, "byte_start": t.byte(e.start), "byte_end": t.byte(e.end), "confidence": e.confidence, "evidence": e.evidence} for e in entities]


def entry_rows(entries: list[Entry]) -> list[dict]:
    return [{k: getattr(e, k) for k in ("type", "start", "end", "masked_start", "masked_end", "mask", "original")} for e in entries]


def one_list(columns: tuple, kind: pa.ListType) -> pa.Array:
    """One list of structs from the columns of their fields."""
    fields = list(kind.value_type)
    structs = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields)
    return pa.ListArray.from_arrays([0, len(structs)], structs).cast(kind)


def entries_of(rows: list[dict] | None) -> list[Entry]:
    return [Entry(**r) for r in rows or ()]


class Engine:
    """Operators over DataFrames for one configuration."""

    def __init__(self, config: Config | None = None):
        self.config = config or Config()
        self.blob = pickle.dumps(self.config)

    def _map(self, df: DataFrame, added: str, types: list[pa.DataType], run: Callable, *inputs: str) -> DataFrame:
        """df with the columns that run(compiled, *values) gives for each row's inputs."""
        new = _parse_datatype_string(added).fields
        base = df.drop(*[f.name for f in new])
        blob, places, names = self.blob, [base.columns.index(c) for c in inputs], [f.name for f in new]

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            engine = compiled(blob)
            for batch in batches:
                made = [run(engine, *values) for values in zip(*(batch.column(i).to_pylist() for i in places), strict=True)]
                columns = [pa.array([m[i] for m in made], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

        return base.mapInArrow(rows, StructType([*base.schema.fields, *new]))

    def _system(self, system: str | None) -> str:
        if system is None:
            return next((s.id for s in self.config.systems if s.anonymous), self.config.systems[0].id)
        return self.config.system(system).id

    def candidates(self, df: DataFrame, text: str = "text") -> DataFrame:
        """df with `candidates`: everything the detectors propose."""
        def run(engine: Compiled, value: str | None):
            return ([{k: getattr(c, k) for k in ("type", "start", "end", "confidence", "detector", "evidence", "weak")} for c in engine.candidates(value or "")],)

        return self._map(df, f"candidates array<{CANDIDATE}>", [_CANDIDATE], run, text)

    def detect(self, df: DataFrame, system: str | None = None, text: str = "text") -> DataFrame:
        """df with `entities`."""
        name = self._system(system)
        return self._map(df, f"entities {ENTITIES}", [_ENTITY], lambda engine, value: (entity_rows(value or "", engine.detect(value or "", name)),), text)

    def mask(self, df: DataFrame, system: str | None = None, text: str = "text") -> DataFrame:
        """df with `masked`, `entries` and `entities`; a null text stays null."""
        name = self._system(system)

        def run(engine: Compiled, value: str | None):
            masked, entries, entities = engine.mask(value or "", name)
            return (None if value is None else masked), entry_rows(entries), entity_rows(value or "", entities)

        return self._map(df, f"masked string, entries {ENTRIES}, entities {ENTITIES}", [pa.string(), _ENTRY, _ENTITY], run, text)

    def mask_long(self, rows: DataFrame, system: str | None = None, key: str = "key", order: str = "order", text: str = "text", between: str = "", tasks: int | None = None) -> DataFrame:
        """(key, piece, masked, entries, entities) of texts too large for a row, with what mask() gives for the whole.

        The rows of a key, by order and then text, with `between` between them, are one text; a null text is empty. Its pieces come numbered and in
        order, one text after another in a partition; offsets count from the start of the whole. A text is one task's work, which
        holds a piece of it at a time; `tasks` deals integer keys out by their remainder, as many to a task as to any other.
        """
        name, blob = self._system(system), self.blob
        field = rows.select(key).schema[0]
        schema = StructType([field, *_parse_datatype_string(f"piece bigint, masked string, entries {ENTRIES}, entities {ENTITIES}").fields])
        source = rows.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(text).alias("t"))
        dealt = source.repartition("k") if tasks is None else source.repartitionById(tasks, F.coalesce(F.pmod("k", F.lit(tasks)), F.lit(0)).cast("int"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            engine, kind = compiled(blob), None

            def stream() -> Iterator[tuple]:
                nonlocal kind
                for batch in batches:
                    kind = batch.schema.field(0).type
                    yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)

            for k, group in groupby(stream(), itemgetter(0)):
                texts = (between * (i > 0) + (t or "") for i, (_, t) in enumerate(group))
                for n, (masked, entries, entities) in enumerate(long_texts.whole_columns(long_texts.masked_pieces(engine, name, texts))):
                    yield pa.RecordBatch.from_arrays([pa.array([k], kind), pa.array([n], pa.int64()), pa.array([masked], pa.string()), one_list(entries, _ENTRY), one_list(entities, _ENTITY)], names=schema.names)

        return dealt.sortWithinPartitions("k", "o", "t").select("k", "t").mapInArrow(run, schema)

    def restore(self, df: DataFrame, text: str = "text", entries: str = "entries", exact: str | None = None) -> DataFrame:
        """df with `restored`, from each row's entries; `exact` names a column that says whether the text is the masked one."""
        def run(engine: Compiled, value: str | None, rows, is_exact: bool | None = True):
            return (None if value is None else restore(value, entries_of(rows), bool(is_exact)),)

        return self._map(df, "restored string", [pa.string()], run, text, entries, *([exact] if exact else []))

    def mask_conversations(self, rows: DataFrame, system: str | None = None, key: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
        """rows with `masked` and `entries`, placeholders numbered through each conversation in turn order.

        Detection runs on rows as they lie, before the shuffle. Then a conversation's turns with their entities come to one
        task together, as a chat request does, to be numbered. A row with a null key is a conversation of its own.
        """
        name, blob = self._system(system), self.blob
        source = rows.drop("masked", "entries")
        schema = StructType([*source.schema.fields, *_parse_datatype_string(f"masked string, entries {ENTRIES}").fields])
        alone = self.mask(source.filter(F.col(key).isNull()), name, text).select(*source.columns, "masked", "entries")

        def run(table: pa.Table) -> pa.Table:
            masker, state = compiled(blob).systems[name][2], MaskState()
            table = table.sort_by([(order, "ascending"), (text, "ascending")])
            found = [[Entity(e["start"], e["end"], e["type"], e["confidence"], e["evidence"]) for e in row] for row in table.column("__found").to_pylist()]
            texts = table.column(text).to_pylist()
            made = [masker.mask(value or "", entities, state) for value, entities in zip(texts, found, strict=True)]
            table = table.drop_columns(["__found"])
            return table.append_column("masked", pa.array([m[0] if t is not None else None for m, t in zip(made, texts, strict=True)], pa.string())).append_column("entries", pa.array([entry_rows(m[1]) for m in made], _ENTRY))

        known = source.filter(F.col(key).isNotNull())
        found = self._map(known, f"__found {ENTITIES}", [_ENTITY], lambda engine, value: (entity_rows(value or "", engine.detect(value or "", name)),), text)
        return found.groupBy(key).applyInArrow(run, schema).unionByName(alone)

    def chat_round(self, turns: DataFrame, replies: DataFrame, system: str | None = None, key: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
        """(key, reply, restored, status, code, n_entities, types) of a model's replies (key, reply) to masked conversations.

        What was masked in a conversation is put back wherever a reply uses its placeholders. A system that may not restore
        gets the reply as it is (status 200, code DEMASK_FORBIDDEN); a reply that is null is an error of the upstream
        model (502), one to no conversation has no mapping (404).
        """
        s = self.config.system(self._system(system))
        masked = self.mask_conversations(turns.select(key, order, text), s.id, key, order, text)
        by_key = masked.filter(F.col(key).isNotNull()).groupBy(key).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(order, text, "entries"))), lambda r: r["entries"])).alias("__entries"))
        joined = replies.select(key, "reply").join(by_key, key, "left").withColumn("__exact", F.lit(False))
        done = self.restore(joined, "reply", "__entries", "__exact")
        code = F.when(F.col("reply").isNull(), "UPSTREAM_ERROR").when(F.col("__entries").isNull(), "MAPPING_NOT_FOUND").when(F.lit(not s.demask), "DEMASK_FORBIDDEN")
        status = F.when(F.col("reply").isNull(), 502).when(F.col("__entries").isNull(), 404).otherwise(200)
        shown = F.when(status == 200, F.col("restored") if s.demask else F.col("reply"))
        types = F.array_sort(F.array_distinct(F.transform("__entries", lambda e: e["type"])))
        return done.select(key, "reply", shown.alias("restored"), status.alias("status"), code.alias("code"), F.coalesce(F.size("__entries"), F.lit(0)).alias("n_entities"), F.coalesce(F.array_join(types, ","), F.lit("")).alias("types"))

    def mappings(self, masked: DataFrame, system: str | None = None, payload_id: str = "payload_id", text: str = "text", created_at: Column | None = None) -> DataFrame:
        """Rows for a mapping store from the result of mask()."""
        name = F.lit(self._system(system))
        return masked.select(mapping_key(name, F.col(payload_id).cast("string")).alias("key"), name.alias("system"), F.sha2(text, 256).alias("original_hash"), F.sha2("masked", 256).alias("masked_hash"), "entries", (F.current_timestamp() if created_at is None else created_at).alias("created_at"))

    def demask(self, df: DataFrame, store: DataFrame, system: str | None = None, payload_id: str = "payload_id", text: str = "text") -> DataFrame:
        """df with `restored`, `status` and `code`, from the store's mapping of each id."""
        s = self.config.system(self._system(system))
        known = store.select(F.col("key").alias("__key"), F.col("masked_hash").alias("__hash"), F.col("entries").alias("__entries"))
        joined = df.join(known, mapping_key(F.lit(s.id), F.col(payload_id).cast("string")) == F.col("__key"), "left")
        joined = joined.withColumn("__exact", F.sha2(text, 256) == F.col("__hash"))
        out = self.restore(joined, text, "__entries", "__exact")
        code = F.lit("DEMASK_FORBIDDEN") if not s.demask else F.when(F.col("__key").isNull(), "MAPPING_NOT_FOUND")
        status = F.lit(403) if not s.demask else F.when(F.col("__key").isNull(), 404).otherwise(200)
        return out.withColumn("status", status).withColumn("code", code).withColumn("restored", F.when(F.col("status") == 200, F.col("restored"))).drop("__key", "__hash", "__entries", "__exact")

    def process(self, requests: DataFrame, system: str | None = None) -> DataFrame:
        """(payload_id, seq, direction, result, status, code) of requests (payload_id, seq, payload).

        The first request of an id, of equal numbers the first by text, is masked and recorded; the same text again gives the same mask; its mask
        gives the original back; any other text is restored by its masks.
        """
        s = self.config.system(self._system(system))
        requests = requests.select("payload_id", "seq", "payload")
        valid = requests.filter("trim(coalesce(payload_id, '')) <> ''")
        first = valid.groupBy("payload_id").agg(F.min(F.struct("seq", "payload")).alias("m")).select("payload_id", F.col("m.payload").alias("text"), F.col("m.seq").alias("first_seq"))
        known = self.mask(first, s.id).select("payload_id", "first_seq", F.sha2("text", 256).alias("original_hash"), F.sha2("masked", 256).alias("masked_hash"), "masked", "entries")
        joined = valid.join(known, "payload_id").withColumn("hash", F.sha2("payload", 256))
        is_mask = F.col("hash") == F.col("original_hash")
        joined = joined.withColumn("direction", F.when(is_mask, "mask").when(F.lit(not s.demask), "error").when(F.col("hash") == F.col("masked_hash"), "demask_exact").otherwise("demask_substitute"))
        done = self.restore(joined.withColumn("exact", F.col("direction") == "demask_exact"), "payload", "entries", "exact")
        result = F.when(F.col("direction") == "mask", F.col("masked")).when(F.col("direction") != "error", F.col("restored"))
        good = done.select("payload_id", "seq", "direction", result.alias("result"), F.when(F.col("direction") == "error", 403).otherwise(200).alias("status"), F.when(F.col("direction") == "error", "DEMASK_FORBIDDEN").alias("code"))
        bad = requests.filter("trim(coalesce(payload_id, '')) = ''").select("payload_id", "seq", F.lit("error").alias("direction"), F.lit(None).cast("string").alias("result"), F.lit(400).alias("status"), F.lit("INVALID_REQUEST").alias("code"))
        return good.unionByName(bad)

    def systems(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(s.id, s.enabled, s.demask, s.profile, s.anonymous, sorted(self.config.allowed(s))) for s in sorted(self.config.systems, key=lambda s: s.id)], "id string, enabled boolean, demask boolean, profile string, anonymous boolean, types array<string>")

    def types(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(t.id, t.group, float(t.confidence), t.priority, t.weak, t.enabled, t.validator, len(t.patterns)) for t in sorted(self.config.types, key=lambda t: t.id)], "id string, type_group string, confidence double, priority int, weak boolean, enabled boolean, validator string, n_patterns int")

    def profiles(self, spark: SparkSession) -> DataFrame:
        rows = [(name, type_id, s.kind) for name, p in sorted(self.config.profiles.items()) for type_id, s in [("*", p.default), *sorted(p.types.items())]]
        return spark.createDataFrame(rows, "profile string, type string, strategy string")

    def system_of_key(self, api_key: str | None, override: str | None = None, allow_anonymous: bool = True) -> System:
        """Who asks: the owner of the key, else the override, else the anonymous system."""
        if api_key:
            digest = hashlib.sha256(api_key.encode()).hexdigest()
            for s in self.config.systems:
                if any((k[7:].lower() if k.startswith("sha256:") else hashlib.sha256(k.encode()).hexdigest()) == digest for k in s.api_keys):
                    return self._enabled(s)
            raise PermissionError("UNAUTHORIZED")
        if override:
            return self._enabled(self.config.system(override))
        anonymous = next((s for s in self.config.systems if s.anonymous and s.enabled), None)
        if anonymous is None or not allow_anonymous:
            raise PermissionError("UNAUTHORIZED")
        return anonymous

    @staticmethod
    def _enabled(s: System) -> System:
        if not s.enabled:
            raise PermissionError("SYSTEM_DISABLED")
        return s

    def check(self) -> list[str]:
        """What is wrong with the configuration, if anything."""
        try:
            Compiled(self.config)
        except (ValueError, OSError, ConfigError) as e:
            return [str(e)]
        return []

    def register(self, spark: SparkSession, system: str | None = None) -> None:
        """SQL functions mask_pii(text) and detect_pii(text)."""
        from pyspark.sql.functions import udf

        blob, name = self.blob, self._system(system)
        spark.udf.register("mask_pii", udf(lambda t: None if t is None else compiled(blob).mask(t, name)[0], "string", useArrow=True))
        spark.udf.register("detect_pii", udf(lambda t: [(e["type"], e["start"], e["end"]) for e in entity_rows(t or "", compiled(blob).detect(t or "", name))], "array<struct<type:string,start:bigint,end:bigint>>", useArrow=True))


def mask_again(text: str, rows: list[dict]) -> str | None:
    return masked_again(text, entries_of(rows))
