"""Tables, the shared folder and blocks: what the operators need from the cluster."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text and documents of a block, on average: what one task holds of a co-grouped table at once.
BLOCK_BYTES, BLOCK_DOCS = 1 << 20, 1024
#: Text whose names meet in one bucket, on average.
BUCKET_BYTES = 8 << 20


#: Tables of texts, which take work in proportion to their bytes.
TEXTS = ("documents", "pages", "conversations")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of texts that lies in fewer files than there are cores is dealt to all of them."""
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return table.repartition(cores) if name in TEXTS and 0 < len(table.inputFiles()) < cores else table


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a folder of its own on a local master, the warehouse else."""
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not named:
        local = spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master
        named = os.path.join(tempfile.gettempdir(), "checkpoints") if local else spark.conf.get("spark.sql.warehouse.dir") + "/_shared"
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cloakwork/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def dropped(*tables: DataFrame | None) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for table in tables:
        if table is not None:
            context = table.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(table.written_to)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def layout(docs: DataFrame) -> tuple[int, int]:
    """(blocks, buckets) for a table with a text column: their numbers grow with its bytes and rows, their sizes don't."""
    size = docs.agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    held = size["bytes"] or 0
    return max(8, -(-held // BLOCK_BYTES), -(-size["rows"] // BLOCK_DOCS)), max(partitions(docs.sparkSession), -(-held // BUCKET_BYTES))


def block_of(blocks: int, *columns: str):
    """The block of a row; with the text among the columns, texts that repeat an id are dealt out too."""
    return F.pmod(F.xxhash64(*columns), F.lit(blocks)).cast("int")
