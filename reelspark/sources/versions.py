"""A table of rows by key in versions: immutable Parquet files and a log with one entry for each commit.

A commit writes its rows, sorted by ranges of the key, into files of its own and then creates the log entry of
the next version, which names the files with their least and greatest key. The entry is created only if it isn't
there, so of two writers one gets the version and the other a Conflict, and what a lost job left behind is in no entry.
A version's rows are, of each key, those of the last commit up to it; deletions are rows as well. All goes through the file
system that Spark has for the path, so it may be a store that only Spark reads.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(Exception):
    """Another writer has made this version."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _entry(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/log/{version:020d}.json"


def versions(spark: SparkSession, root: str) -> list[int]:
    """The committed versions, from 1 on."""
    fs, folder = _fs(spark, f"{root.rstrip('/')}/log")
    if not fs.exists(folder):
        return []
    return sorted(int(s.getPath().getName()[:20]) for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json"))


def commit(spark: SparkSession, root: str, rows: DataFrame, key: str, deleted: DataFrame | None = None, after: int | None = None, files: int | None = None) -> int:
    """Upserts rows (of each key one) and deletes the keys of deleted, as the version after `after` (the last one), in `files` files (as many as the rows fill); its number.

    A null key can't be looked up and is refused by the count of what was written."""
    last = after if after is not None else max(versions(spark, root), default=0)
    changed = rows.withColumn("_gone", F.lit(False))
    if deleted is not None:
        gone = deleted.select(F.col(key).cast(rows.schema[key].dataType).alias(key)).distinct()
        changed = changed.unionByName(gone.join(rows.select(key), key, "left_anti").withColumn("_gone", F.lit(True)), allowMissingColumns=True)
    data = f"{root.rstrip('/')}/data/{uuid.uuid4().hex}"
    dealt = changed.repartitionByRange(files, key) if files else changed.repartitionByRange(key)
    dealt.sortWithinPartitions(key).write.parquet(data)
    made = spark.read.parquet(data)
    written = made.groupBy(F.input_file_name().alias("file")).agg(F.min(key).cast("string").alias("low"), F.max(key).cast("string").alias("high"), F.count(key).alias("n"), F.count("*").alias("rows"), F.approx_count_distinct(key).alias("keys"))
    listed = [r.asDict() for r in written.collect()]  # a row for each file of one commit
    if any(f["n"] != f["rows"] for f in listed):
        raise ValueError("a key is null")
    if not made.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError("a key has several rows")
    fs, path = _fs(spark, _entry(root, last + 1))
    body = json.dumps({"version": last + 1, "key": key, "schema": made.schema.jsonValue(), "files": [{k: f[k] for k in ("file", "low", "high", "rows")} for f in listed]}, sort_keys=True)
    try:
        out = fs.create(path, False)
    except Exception as e:
        if fs.exists(path):
            raise Conflict(f"version {last + 1} is there") from e
        raise
    out.write(bytearray(body.encode()))
    out.close()
    return last + 1


def snapshot(spark: SparkSession, root: str, version: int | None = None, prefix: str | None = None) -> DataFrame:
    """The rows of a version (the last one), or those whose key begins with prefix: only files whose keys may are opened."""
    wanted = [v for v in versions(spark, root) if version is None or v <= version]
    if not wanted or (version is not None and version not in wanted):
        raise ValueError(f"there is no version {version or ''} in {root}")
    parts, entry = [], {}
    for v in wanted:
        fs, path = _fs(spark, _entry(root, v))
        stream = fs.open(path)
        entry = json.loads(bytes(stream.readAllBytes()).decode())
        stream.close()
        files = [f["file"] for f in entry["files"] if prefix is None or (f["low"] is not None and f["low"][: len(prefix)] <= prefix <= f["high"][: len(prefix)])]
        if files:
            parts.append(spark.read.parquet(*files).withColumn("_version", F.lit(v)))
    key = entry["key"]
    if not parts:
        return spark.createDataFrame([], spark.read.parquet(f"{root.rstrip('/')}/data/*").schema).drop("_gone")
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p, allowMissingColumns=True)
    if prefix is not None:
        both = both.where(F.col(key).startswith(prefix))
    rest = [c for c in both.columns if c not in (key, "_version")]
    last = both.groupBy(key).agg(F.max_by(F.struct(*rest), "_version").alias("_row"))
    return last.where("not _row._gone").select(key, *(F.col(f"_row.{c}").alias(c) for c in rest if c != "_gone"))
