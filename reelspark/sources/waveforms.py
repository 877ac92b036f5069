"""Stored waveforms: peak and RMS by track and bucket, as one blob a file and as a table of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Marks of blobs of 16-bit and of 8-bit levels; header of a stored blob; what a small file takes.
MAGIC, OLD_MAGIC = b"LVL3", b"LVL2"
STORED_HEADER, BLOB_HEADER, UNIT = 20, 5, 4096
TOLERANCE = 0.01


def pack(levels: np.ndarray, complete: bool = True) -> bytes:
    """Levels (peak and RMS, tracks, buckets) from 0 to 1 as 16-bit numbers, with whether the whole file was read."""
    whole = np.rint(np.clip(np.asarray(levels, float), 0, 1) * 65535).astype("<u2")
    return MAGIC + bytes((levels.shape[1], complete)) + whole.tobytes()


def unpack(blob: bytes | None) -> np.ndarray | None:
    """The levels of a blob, also of an old one with 8-bit numbers; None for anything else."""
    if blob is None or blob[:4] not in (MAGIC, OLD_MAGIC):
        return None
    kind, head = ("<u2", 6) if blob[:4] == MAGIC else ("u1", 5)
    body, tracks = blob[head:], blob[4] if len(blob) > 4 else 0
    if not tracks or not body or len(body) % (2 * tracks * np.dtype(kind).itemsize):
        return None
    return (np.frombuffer(body, kind) / np.float32(np.iinfo(kind).max)).astype(np.float32).reshape(2, tracks, -1)


def is_complete(blob: bytes) -> bool:
    """Whether the levels are of the whole file and not of a sample of it."""
    return blob[:4] == MAGIC and len(blob) > 6 and blob[5] == 1


def stored_bytes(channels: Column, buckets: Column) -> Column:
    """What a file's waveform takes up: two 16-bit levels for each track and bucket and the headers, in units of 4 KB."""
    raw = F.lit(STORED_HEADER + BLOB_HEADER) + 4 * channels.cast("long") * buckets
    return F.ceil(raw / UNIT).cast("long") * UNIT


def blobs(envelope: DataFrame, buckets: int, complete: bool = True) -> DataFrame:
    """(path, blob) of an envelope (path, channel, bucket, peak, rms), a bounded number of levels for each path."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        levels = np.zeros((2, int(pdf["channel"].max()) + 1, buckets))
        for k, column in enumerate(("peak", "rms")):
            levels[k, pdf["channel"], pdf["bucket"]] = pdf[column]
        return pd.DataFrame({"path": [pdf["path"].iloc[0]], "blob": [pack(levels, complete)]})

    return envelope.select("path", "channel", "bucket", "peak", "rms").groupBy("path").applyInPandas(run, "path string, blob binary")


@F.udf(T.ArrayType(T.ArrayType(T.ArrayType(T.FloatType()))), useArrow=True)
def levels(blob: bytes):
    """The levels of a blob as nested arrays; null for what is none."""
    found = unpack(blob)
    return None if found is None else found.tolist()


def save(waveforms: DataFrame, target: str) -> None:
    """Stores (key, size, mtime, blob) by the first two digits of the key's sha1."""
    waveforms.withColumn("shard", F.substring(F.sha1(F.col("key").cast("binary")), 1, 2)).write.mode("append").partitionBy("shard").parquet(target)


def load(spark: SparkSession, target: str, files: DataFrame) -> DataFrame:
    """The stored waveforms of files (key, size, mtime) that are still as they were; of several the newest."""
    stored = spark.read.parquet(target).drop("shard")
    now = files.select("key", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
    same = stored.join(now, "key").where((F.col("size") == F.col("_size")) & (F.abs(F.col("mtime") - F.col("_mtime")) <= TOLERANCE))
    return same.groupBy("key").agg(F.max_by(F.struct("size", "mtime", "blob"), F.struct(F.expr("substring(blob, 6, 1)"), "mtime")).alias("w")).select("key", "w.size", "w.mtime", "w.blob")
