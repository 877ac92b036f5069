"""Paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.functions.names import DAY_FOLDER


def parts(path: Column) -> Column:
    """Components without empty ones."""
    return F.filter(F.split(path, "/"), lambda x: x != "")


def ancestors(path: Column) -> Column:
    """All prefixes of a path by component, the path itself last."""
    p = parts(path)
    lead = F.when(path.startswith("/"), "/").otherwise("")
    return F.when(F.size(p) > 0, F.transform(F.sequence(F.lit(1), F.size(p)), lambda k: F.concat(lead, F.array_join(F.slice(p, F.lit(1), k), "/")))).otherwise(F.array().cast("array<string>"))


def folder_project(path: Column, containers: list[str]) -> Column:
    """First folder of the path that is neither a container nor named by a day; ''."""
    folders = F.slice(parts(path), F.lit(1), F.greatest(F.size(parts(path)) - 1, F.lit(0)))
    named = F.filter(folders, lambda x: ~F.lower(x).isin([c.lower() for c in containers]) & ~x.rlike(DAY_FOLDER) if containers else ~x.rlike(DAY_FOLDER))
    return F.coalesce(F.get(named, F.lit(0)), F.lit(""))


def common_folder(df: DataFrame, path: str) -> DataFrame:
    """One row, folder: the deepest folder that holds all paths ('' for none).

    A prefix is common if it counts as often as there are paths; counts are by prefix, so no path
    list is gathered.
    """
    each = df.select(F.explode(ancestors(F.regexp_replace(F.col(path), "/[^/]*$", ""))).alias("folder"))
    counts = each.groupBy("folder").agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    shared = counts.join(F.broadcast(total), F.col("n") == F.col("total"))
    return shared.agg(F.coalesce(F.max_by("folder", F.length("folder")), F.lit("")).alias("folder"))
