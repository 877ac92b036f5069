"""What the operators of this subpackage share: reading, words, batches and checkpoints."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.session import checkpoint_dir

#: Words are runs of anything but the space and the characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone (null text: empty), so that further columns can't clash."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))


def word_array(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_words(text: str | None) -> list[bytes]:
    """UTF-8 words of a text with A-Z (and no other letter) lower-cased; bytes.split() splits at exactly the space and the characters 9 to 13."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def remainder(doc_id: int | None, divisor: int) -> int:
    """crc32 of the id as text, modulo divisor; -1 for a null id."""
    return -1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % divisor


def remainder_column(doc_id: Column, divisor: int) -> Column:
    """As remainder, as a column."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % divisor, F.lit(-1)).cast("int")


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut: written to the shared checkpoint folder, so lost executors cost no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(df: DataFrame) -> None:
    """Removes the files of a table from cut() that nothing reads any more."""
    rdd = df._jdf.queryExecution().analyzed().rdd()
    held = rdd.getCheckpointFile()
    if held.isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(held.get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold: tuple[int, int], most: int) -> DataFrame:
    """doc_id, text and y of at most `most` labelled documents outside the held-out fold.

    fold (4, 2) holds out the ids whose crc32 is 2 modulo 4. The documents are those with the smallest
    hashes of their ids, so every size of corpus is sampled alike; the bound on their number makes
    the list of ids small enough to broadcast. Of labels that contradict each other 1 holds; of an id's
    texts that with the smallest hash is learned from, so an id that repeats is one row.
    """
    divisor, held_out = fold
    wanted = labels.select(labels["doc_id"].cast("long").alias("id"), labels[label].cast("int").alias("y"))
    wanted = wanted.where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & (remainder_column(F.col("id"), divisor) != held_out))
    wanted = wanted.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(most)
    found = id_and_text(docs).join(F.broadcast(wanted), F.col("doc_id") == F.col("id"))
    return found.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("y").alias("y"))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30.0, 30.0)))
