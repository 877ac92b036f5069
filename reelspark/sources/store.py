"""The stored recordings table: snapshots, incremental scans, JSON index, markers and the history log."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.functions.names import folder
from reelspark.functions.paths import ancestors
from reelspark.operators.joins import removed_rows
from reelspark.schema import HEADER
from reelspark.session import checkpoint_dir
from reelspark.sources import wav

LOCAL_TOLERANCE, SHARED_TOLERANCE = 1e-6, 0.01


def unchanged(listing: DataFrame, cached: DataFrame, tolerance: float = LOCAL_TOLERANCE) -> DataFrame:
    """Cached rows whose file is still listed with its size and time."""
    now = listing.select(F.col("path").alias("_path"), F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
    same = (cached["path"] == now["_path"]) & (cached["size"] == now["_size"]) & (F.abs(cached["mtime"] - now["_mtime"]) <= tolerance)
    return cached.join(now, same, "left_semi")


def incremental_scan(spark: SparkSession, root: str, cached: DataFrame | None, tolerance: float = LOCAL_TOLERANCE) -> DataFrame:
    """The library's rows: cached ones whose file is unchanged, and the others read anew on the
    executors; rows of an older parser are read again, those of vanished files go. Whether a file has vanished
    is only known where its folder could be listed: rows at or below a path with an error stay."""
    checkpoint_dir(spark)
    every = wav.listing(spark, root).checkpoint()  # one walk for what is read, kept and dropped
    listing = every.where("error = ''")
    kept = None
    if cached is None:
        hits, missing = None, listing
    else:
        hits = unchanged(listing, cached.where(F.col("parser_version") >= wav.PARSER_VERSION), tolerance)
        missing = removed_rows(listing, hits, "path")
        failed = every.where("error <> ''").select(F.col("path").alias("_above"))
        above = F.explode(F.array_append(ancestors(folder(F.col("path"))), F.col("path"))).alias("_above")
        kept = cached.join(cached.select("path", above).join(failed, "_above").select("path").distinct(), "path", "left_semi")
        kept = removed_rows(kept, listing, "path")
    names = [f.name for f in HEADER.fields]

    def read(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame([wav.read_header(p, s, m) for p, s, m in zip(pdf["path"], pdf["size"], pdf["mtime"])], columns=names)

    fresh = missing.select("path", "size", "mtime").repartition(spark.sparkContext.defaultParallelism * 4, "path").mapInPandas(read, HEADER)
    return fresh if hits is None else hits.select(*names).unionByName(kept.select(*names)).unionByName(fresh)


def save_snapshot(df: DataFrame, path: str) -> None:
    df.withColumn("top", F.split_part(F.regexp_replace("path", "^/", ""), F.lit("/"), F.lit(1))).write.mode("overwrite").partitionBy("top").parquet(path)


def load_under(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """Rows below a folder, in order of path; the test is pushed to the scan."""
    return spark.read.parquet(path).drop("top").where(F.col("path").startswith(prefix.rstrip("/") + "/")).orderBy("path")


def export_index(df: DataFrame, root: str, path: str) -> None:
    """The shared index: rows of [path below root, size, mtime, fields] as gzip JSON lines."""
    key = F.expr(f"substring(path, {len(root.rstrip('/')) + 2})")
    fields = F.to_json(F.struct(*(c for c in df.columns if c not in ("path", "size", "mtime"))))
    df.select(F.lit(1).alias("version"), key.alias("key"), "size", "mtime", fields.alias("fields")).write.mode("overwrite").option("compression", "gzip").json(path)


def import_index(spark: SparkSession, path: str, root: str) -> DataFrame:
    """The rows of an index, with paths below root; rows of another version are left out."""
    raw = spark.read.schema("version int, key string, size long, mtime double, fields string").json(path).where("version = 1")
    rest = [f for f in HEADER.fields if f.name not in ("path", "size", "mtime")]
    parsed = F.from_json("fields", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest))
    return raw.withColumn("f", parsed).select(F.concat(F.lit(root.rstrip("/") + "/"), "key").alias("path"), "size", "mtime", *(F.col(f"f.{f.name}").alias(f.name) for f in rest)).select(*(f.name for f in HEADER.fields))


def moved_markers(markers: DataFrame, mapping: DataFrame) -> DataFrame:
    """markers (path, frame, name) after renames (old, new): a renamed file's markers replace those at its new path."""
    m = mapping.select(F.col("old").alias("path"), F.col("new"))
    kept = markers.join(mapping.select(F.col("new").alias("path")).join(m.select("path"), "path", "left_anti"), "path", "left_anti")
    return kept.join(m, "path", "left").select(F.coalesce("new", "path").alias("path"), "frame", "name")


def log_action(spark: SparkSession, path: str, action: str, **details: object) -> None:
    """Appends one row to the history."""
    row = spark.createDataFrame([(action, json.dumps(details, sort_keys=True))], "action string, details string")
    row.withColumn("time", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")).write.mode("append").json(path)
