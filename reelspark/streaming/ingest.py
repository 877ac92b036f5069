"""Streaming forms: ingest by latest row, suppression of superseded results, and windows over event time.

The windows (with watermarks) are extensions beside the batch operators; each has the same result as
its batch form over the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key (a superseded generation's rows go); aggregated before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*key, *(F.col(f"_row.{c}").alias(c) for c in rest))


def upsert_stream(stream: DataFrame, target: str, key: list[str], order: list[str], checkpoint: str) -> StreamingQuery:
    """Writes each batch's rows beside the earlier ones, in a folder of its own that a repeated batch
    replaces; current() reads the latest row of each key, so a retry changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        latest(batch, key, order).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str, key: list[str], order: list[str]) -> DataFrame:
    return latest(spark.read.parquet(target).drop("batch"), key, order)


def windowed(df: DataFrame, at: str, by: list[str], length: str, late: str | None = None) -> DataFrame:
    """Counts and sums of value in tumbling windows; a stream takes rows up to `late` after the newest."""
    rows = df.withWatermark(at, late) if late and df.isStreaming else df
    g = rows.groupBy(F.window(at, length).alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(df: DataFrame, at: str, by: list[str], gap: str, late: str | None = None) -> DataFrame:
    """Counts by session: rows of a key no further apart than the gap."""
    rows = df.withWatermark(at, late) if late and df.isStreaming else df
    g = rows.groupBy(F.session_window(at, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def recorded_lane(df: DataFrame, by: list[str], at: str, value: str, armed: str) -> DataFrame:
    """Automation recorded while armed: (by, stretch, first, last, value), a stretch for each run of
    armed rows with one value."""
    w = Window.partitionBy(*by).orderBy(at)
    changed = F.coalesce((F.col(value) != F.lag(value).over(w)) | (F.col(armed) != F.lag(armed).over(w)), F.lit(True))
    runs = df.withColumn("_new", changed.cast("int")).withColumn("stretch", F.sum("_new").over(w))
    return runs.where(F.col(armed)).groupBy(*by, "stretch", value).agg(F.min(at).alias("first"), F.max(at).alias("last"))
