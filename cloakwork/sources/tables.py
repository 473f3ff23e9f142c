"""Texts in, masked texts and mappings out."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRY = "struct<type:string,start:bigint,end:bigint,masked_start:bigint,masked_end:bigint,mask:string,original:string>"
MAPPING = f"key string, system string, original_hash string, masked_hash string, entries array<{ENTRY}>, created_at timestamp"
GOLDEN = "id string, category string, text string, entities array<struct<type:string,start:bigint,end:bigint>>, masked string"
REQUEST = "payload string, payload_id string, system string, seq bigint"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): each file as one text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of requests; lines that can't be read have status 400."""
    schema = T.StructType([*T._parse_datatype_string(REQUEST).fields, T.StructField("_bad", T.StringType())])
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_bad").json(path)
    bad = F.col("_bad").isNotNull() | (F.trim(F.coalesce("payload_id", F.lit(""))) == "")
    return rows.withColumn("status", F.when(bad, 400).otherwise(200)).withColumn("code", F.when(bad, "INVALID_REQUEST")).drop("_bad")


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Labelled records from a JSONL file or folder, without blank and # lines; a broken line is an error that says where it is."""
    files = read_texts(spark, path)
    lines = files.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("n", "line")).withColumn("line", F.trim("line")).filter("line <> '' AND NOT startswith(line, '#')")
    record = F.from_json("line", GOLDEN + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    where = F.concat(F.lit("malformed record at "), F.col("path"), F.lit(":"), (F.col("n") + 1).cast("string"))
    checked = F.when(F.col("r._bad").isNull(), F.col("r")).otherwise(F.raise_error(where).cast(f"struct<{', '.join(x.strip().replace(' ', ':', 1) for x in (GOLDEN + ', _bad string').split(', '))}>"))
    rows = lines.withColumn("r", record).select(checked.alias("r")).select("r.*")
    return rows.drop("_bad")


def write_golden(records: DataFrame, path: str) -> None:
    records.select("id", "category", "text", "entities", "masked").write.mode("overwrite").json(path)


def chat_messages(requests: DataFrame, column: str = "body") -> DataFrame:
    """(…, message, part, role, text) of chat requests whose content is a string or a list of parts."""
    message = "struct<role:string,content:string>"
    body = F.from_json(column, f"messages array<{message}>")
    messages = requests.select(*[c for c in requests.columns if c != column], F.posexplode(body["messages"]).alias("message", "m"))
    as_parts = F.from_json(F.col("m.content"), "array<struct<text:string>>")
    is_list = F.startswith(F.ltrim("m.content"), F.lit("[")) & as_parts.isNotNull()
    texts = F.when(is_list, F.transform(as_parts, lambda p: p["text"])).otherwise(F.array("m.content"))
    return messages.select("*", F.posexplode(texts).alias("part", "text")).select("*", "m.role").drop("m").filter("text IS NOT NULL")


def mapping_key(system: Column, payload_id: Column) -> Column:
    return F.concat(F.lit("mk:"), system, F.lit(":"), F.sha2(payload_id, 256))


def seal(value: Column, secret: str) -> Column:
    """AES-256-GCM with a random nonce in front; the key is base64 of 32 bytes, or the hash of a phrase."""
    return F.aes_encrypt(value, _key(secret), F.lit("GCM"))


def unseal(sealed: Column, secret: str) -> Column:
    """What seal() took, or null if it was changed."""
    return F.try_aes_decrypt(sealed, _key(secret), F.lit("GCM")).cast("string")


def _key(secret: str) -> Column:
    import base64
    import binascii
    import hashlib

    try:
        raw = base64.b64decode(secret, validate=True)
    except (binascii.Error, ValueError):
        raw = b""
    return F.unhex(F.lit((raw if len(raw) == 32 else hashlib.sha256(secret.encode()).digest()).hex()))


def add_mappings(store: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of new whose key the store doesn't have, one a key: the store is only ever added to."""
    first = new.groupBy("key").agg(F.min_by(F.struct(*[c for c in new.columns if c != "key"]), "created_at").alias("r")).select("key", "r.*").select(new.columns)
    return first.join(store.select("key").distinct(), "key", "left_anti").select(new.columns)


def alive(store: DataFrame, ttl_seconds: int = 3600, now: Column | None = None) -> DataFrame:
    """Mappings that aren't older than their time to live, counted from creation."""
    now = F.current_timestamp() if now is None else now
    return store.filter(F.col("created_at") + F.make_dt_interval(secs=F.lit(ttl_seconds)) > now)


def log_rows(results: DataFrame) -> DataFrame:
    """What may be logged of results: ids, counts and types, never texts."""
    counts = F.transform(F.array_sort(F.array_distinct("entities.type")), lambda t: F.concat(t, F.lit(":"), F.size(F.filter("entities", lambda e: e["type"] == t)).cast("string")))
    return results.select(F.substring(F.sha2("payload_id", 256), 1, 12).alias("payload_id_hash"), "system", "direction", "status", F.octet_length("payload").alias("text_bytes"), F.size("entities").alias("n_entities"), F.array_join(counts, ",").alias("types"))


def digests(pieces: DataFrame, key: str, text: str, count: str) -> DataFrame:
    """(key, count, sha256) of texts whose pieces lie in order, one text after another in a partition, as mask_long() leaves them; counts are summed."""
    schema = T.StructType([pieces.select(key).schema[0], T.StructField(count, T.LongType()), T.StructField("sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, digest, kind = None, 0, None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([held], kind), pa.array([total], pa.int64()), pa.array([digest.hexdigest()], pa.string())], names=schema.names)
        for batch in batches:
            kind = batch.schema.field(0).type
            for k, n, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if digest is None or k != held:
                    if digest is not None:
                        yield row()
                    held, total, digest = k, 0, hashlib.sha256()
                total += n
                digest.update(t.encode())
        if digest is not None:
            yield row()

    return pieces.select(key, F.col(count).cast("long"), text).mapInArrow(run, schema)
