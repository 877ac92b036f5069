"""Cards: the files to copy from one, and a complete list of what is on it."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.functions.paths import parts

#: Files that mark folders and mean nothing; the folder of rejected takes; folders of the system.
MARKERS = (".DS_Store", "Thumbs.db", "desktop.ini")
FALSE_TAKES = "FALSETAKES"
SYSTEM = ("system volume information", "$recycle.bin", "lost+found")
MANIFEST = "relative string, size long, mtime_ns long"


def chosen_files(listing: DataFrame, folders: list[str], include_false_takes: bool = False, path: str = "path") -> DataFrame:
    """The files of a card's listing (paths below its root) that are in one of the folders, by path; '' stands
    for the root's own files. Hidden folders and files of the system are left out, rejected takes unless asked for."""
    p = parts(F.col(path))
    top = F.when(F.size(p) > 1, F.get(p, F.lit(0))).otherwise("")
    name = F.get(p, F.size(p) - 1)
    inner = F.slice(p, F.lit(2), F.greatest(F.size(p) - 2, F.lit(0)))
    wanted = [f for f in folders if f != FALSE_TAKES or include_false_takes]
    seen = ~F.exists(inner, lambda x: x.startswith(".")) & ~name.startswith("._") & (name != ".DS_Store") & ~((top == "") & name.startswith("."))
    return listing.where(top.isin(wanted) & seen).orderBy(path)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """relative, size and mtime_ns of every file on a card. A link, or what is neither file nor folder,
    raises OSError, as a copy without it would not be whole."""

    def walk(folder: str, top: bool) -> Iterator[tuple[str, int, int]]:
        with os.scandir(folder) as found:
            entries = sorted(found, key=lambda e: e.name.casefold())
        for e in entries:
            if e.name.startswith("._") or e.name in MARKERS or (top and (e.name.startswith(".") or e.name.lower() in SYSTEM)):
                continue
            if e.is_symlink() or not (e.is_dir() or e.is_file()):
                raise OSError(f"not a file or folder: {e.path}")
            if e.is_file():
                s = e.stat()
                yield os.path.relpath(e.path, root), s.st_size, s.st_mtime_ns
            elif not e.name.startswith("."):
                yield from walk(e.path, False)

    return spark.createDataFrame(list(walk(root, True)), MANIFEST)


def manifest_differences(card: DataFrame, copy: DataFrame) -> DataFrame:
    """relative and what is wrong of each file that a copy lacks, has changed or has beyond the card."""
    c = copy.select("relative", F.col("size").alias("_size"))
    both = card.select("relative", "size").join(c, "relative", "full")
    wrong = F.when(F.col("_size").isNull(), "missing").when(F.col("size").isNull(), "not on the card").when(F.col("size") != F.col("_size"), "differs")
    return both.select("relative", wrong.alias("wrong")).where("wrong is not null")


def working_copy_plan(card: DataFrame, root: str, target: str, free: int) -> DataFrame:
    """path and dst of a disposable copy of a whole card; ValueError where it doesn't fit."""
    need = card.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    if need > free:
        raise ValueError(f"{need} bytes are needed and {free} are free")
    return card.select(F.concat(F.lit(root.rstrip("/") + "/"), "relative").alias("path"), F.concat(F.lit(target.rstrip("/") + "/"), "relative").alias("dst"))
