"""Aggregates over a request log (ts, route, seconds)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper edges of the latency buckets, in seconds.
BUCKETS = (0.0005, 0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def windowed_rate(log: DataFrame, every: str = "2 minutes", slide: str | None = None, by: str = "route") -> DataFrame:
    """(start, by, n, rate a second) of each window."""
    counted = log.groupBy(F.window("ts", every, slide).alias("w"), by).agg(F.count("*").alias("n"))
    seconds = F.unix_timestamp(F.col("w.end")) - F.unix_timestamp(F.col("w.start"))
    return counted.select(F.col("w.start").alias("start"), by, "n", (F.col("n") / seconds).alias("rate"))


def windowed_sum(log: DataFrame, value: str, every: str = "5 minutes", slide: str = "1 minute", by: str = "route") -> DataFrame:
    """(start, by, total): the increase of a counter in sliding windows."""
    return log.groupBy(F.window("ts", every, slide).alias("w"), by).agg(F.sum(value).alias("total")).select(F.col("w.start").alias("start"), by, "total")


def mean_by(log: DataFrame, value: str, by: str = "route") -> DataFrame:
    """Sum by count, as a mean of stage times."""
    return log.groupBy(by).agg((F.sum(value) / F.count(value)).alias("mean"))


def maximum_by_window(log: DataFrame, value: str, every: str = "2 minutes", by: str = "route") -> DataFrame:
    return log.groupBy(F.window("ts", every).alias("w"), by).agg(F.max(value).alias("maximum")).select(F.col("w.start").alias("start"), by, "maximum")


def bucket_counts(log: DataFrame, value: str, by: str = "route", edges: tuple[float, ...] = BUCKETS) -> DataFrame:
    """(by, total, b0, b1, …): cumulative counts under each edge."""
    return log.groupBy(by).agg(F.count(value).alias("total"), *[F.count(F.when(F.col(value) <= e, 1)).alias(f"b{i}") for i, e in enumerate(edges)])


def bucket_quantile(q: float, edges: tuple[float, ...] = BUCKETS) -> Column:
    """A quantile read off cumulative buckets, by a straight line inside the bucket; beyond the last edge, that edge."""
    rank = F.lit(q) * F.col("total")
    out = F.lit(float(edges[-1]))
    for i in range(len(edges) - 1, -1, -1):
        low, below = (edges[i - 1], F.col(f"b{i - 1}")) if i else (0.0, F.lit(0))
        inside = F.col(f"b{i}") - below
        line = F.lit(low) + (edges[i] - low) * F.when(inside > 0, (rank - below) / inside).otherwise(1.0)
        out = F.when(F.col(f"b{i}") >= rank, line).otherwise(out)
    return F.when(F.col("total") > 0, out)


def nearest_rank(df: DataFrame, value: str, p: float, by: str = "route") -> DataFrame:
    """(by, percentile): the value at place round((n - 1) p) in order.

    Values are counted before they are ordered, and the place is found by running counts over each key's distinct
    values, so that only distinct values are sorted.
    """
    from pyspark.sql import Window

    counted = df.groupBy(by, value).agg(F.count("*").alias("n"))
    up = Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(by)
    placed = counted.withColumn("upto", F.sum("n").over(up)).withColumn("all", F.sum("n").over(everything))
    place = F.floor((F.col("all") - 1) * p + 0.5)
    return placed.filter(F.col("upto") > place).groupBy(by).agg(F.min(value).alias("percentile"))


def type_counts(entities: DataFrame) -> DataFrame:
    """(type, n) of rows with an `entities` array."""
    return entities.select(F.explode("entities.type").alias("type")).groupBy("type").agg(F.count("*").alias("n"))


def load_report(pairs: DataFrame) -> DataFrame:
    """Totals of mask-and-restore pairs (text, restored, mask_seconds, restore_seconds)."""
    return pairs.agg(F.count("*").alias("pairs"), F.count(F.when(F.col("text") != F.col("restored"), 1)).alias("mismatches"), F.avg("mask_seconds").alias("mean_mask"), F.avg("restore_seconds").alias("mean_restore"))
