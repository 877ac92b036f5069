"""Files made from files: split, combined and processed copies, metadata changes; and tables about cards and clips.

Bytes are written on the executors, each to a temporary name that is renamed when it is whole, and
never over an existing file, so a task that runs again finds or repeats its work.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.functions import names, timecode
from reelspark.functions.paths import parts
from reelspark.sources import rewrite, wav

RESULT = "path string, out string, status string"
PROBE = "struct<streams:array<struct<codec_type:string,r_frame_rate:string,tags:map<string,string>>>,format:struct<duration:string,size:string,tags:map<string,string>>>"
VIDEO = r"(?i)\.(mov|mp4|m4v|mxf)$"


def _said(work: Callable[[], str]) -> str:
    try:
        return work()
    except (OSError, wav.NotWav, ValueError, struct.error) as e:
        return f"failed: {e}"


def _each(df: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield work(pdf)

    return df.mapInPandas(run, RESULT)


def split_files(plan: DataFrame) -> DataFrame:
    """Writes the one-track files of a split plan (path, index from 1, out); a file is read once for all its tracks."""
    files = plan.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("index", "out"))).alias("tracks"))

    def work(p: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for path, tracks in zip(p["path"], p["tracks"]):
            pairs = [(int(t["index"]), t["out"]) for t in tracks]
            try:
                said = rewrite.split_file(path, pairs)
            except (OSError, wav.NotWav, ValueError, struct.error) as e:
                said = [f"failed: {e}"] * len(pairs)
            rows += [(path, out, s) for (_, out), s in zip(pairs, said)]
        return pd.DataFrame(rows, columns=["path", "out", "status"])

    return _each(files, work)


def combine_files(plan: DataFrame) -> DataFrame:
    """Writes one file from each row's aligned files (paths, in order of tracks, and out)."""
    return _each(plan.select("paths", "out"), lambda p: pd.DataFrame({"path": [a[0] for a in p["paths"]], "out": p["out"], "status": [_said(lambda a=a, o=o: rewrite.combine_files(list(a), o)) for a, o in zip(p["paths"], p["out"])]}))


def process_files(plan: DataFrame, chain: list[dict]) -> DataFrame:
    """Writes a copy of each file (path, channels touched from 0, out) with an effect chain run on the
    touched channels; all other channels keep their bytes."""
    from reelspark.functions.effects import run_chain

    def made(path: str, touched: list[int], out: str) -> str:
        rate = rewrite.whole(path)["sample_rate"]
        return rewrite.processed_copy(path, out, {int(c): lambda x: run_chain(x, chain, rate) for c in touched})

    return _each(plan.select("path", "touched", "out"), lambda p: pd.DataFrame({"path": p["path"], "out": p["out"], "status": [_said(lambda a=a, t=t, o=o: made(a, list(t), o)) for a, t, o in zip(p["path"], p["touched"], p["out"])]}))


def write_metadata(plan: DataFrame, allow_rewrite: bool = False) -> DataFrame:
    """Writes changes (path, changes map<string,string>, filename or null) into the files; path, out and
    the mode, or why it failed. A task that runs again finds the fields as they should be."""

    def one(path: str, changes: dict, filename: str | None) -> str:
        typed = {k: v.upper() == "TRUE" if k == "circled" else v for k, v in dict(changes).items()}
        return rewrite.update_metadata(path, typed, filename, allow_rewrite)

    return _each(plan.select("path", "changes", "filename"), lambda p: pd.DataFrame({"path": p["path"], "out": p["path"], "status": [_said(lambda a=a, c=c, f=f: one(a, c, f)) for a, c, f in zip(p["path"], p["changes"], p["filename"])]}))


def offload(copies: DataFrame, edits: DataFrame) -> DataFrame:
    """Copies files (path, dst) with a check of what was written, and writes pending edits (path, changes)
    into the copies that are verified; path, out, status and metadata of each."""
    from reelspark.plans.moves import copy_verified

    copied = cut_plan(copy_verified(copies))
    done = copied.where(F.col("status").isin("verified", "there")).join(edits, "path")
    written = write_metadata(done.select(F.col("dst").alias("path"), "changes", F.lit(None).cast("string").alias("filename")), allow_rewrite=True)
    said = written.select(F.col("path").alias("dst"), F.col("status").alias("metadata"))
    return copied.join(said, "dst", "left").select("path", F.col("dst").alias("out"), "status", F.coalesce("metadata", F.lit("")).alias("metadata"))


def cut_plan(df: DataFrame) -> DataFrame:
    """df written to the shared folder, so that what it did isn't done again."""
    from reelspark.session import checkpoint_dir

    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def metadata_plan(df: DataFrame, new_ixml: Column, headroom: int = 4096) -> DataFrame:
    """How new metadata gets into each file: unchanged, in place (it fits the chunk and a filler after it), or by rewriting."""
    chunk = F.get(F.filter("chunks", lambda c: c["id"] == "iXML"), F.lit(0))
    at = F.array_position(F.transform("chunks", lambda c: c["id"]), "iXML").cast("int")
    after = F.get(F.col("chunks"), at)
    room = chunk["size"] + F.when(after["id"].isin("JUNK", "PAD ", "FLLR"), after["size"] + 8).otherwise(0)
    size = F.octet_length(new_ixml)
    mode = F.when(new_ixml.isNull(), "unchanged").when(F.coalesce(size <= room, F.lit(False)), "in place").otherwise("rewrite")
    return df.select("path", mode.alias("mode"), F.when(mode == "rewrite", F.col("size") + size + headroom).otherwise(F.coalesce(size, F.lit(0))).cast("long").alias("bytes"))


def splittable(df: DataFrame) -> Column:
    """Why a recording can't be split, or ''."""
    return F.when(F.col("error") != "", F.col("error")).when(F.col("truncated"), "truncated").when(F.col("channels") < 2, "one track alone").when(F.size("tracks") > F.col("channels"), "more names than tracks").otherwise("")


def removal_path(path: Column, project: Column, removed: str = wav.REMOVED) -> Column:
    """Where a removed file of the library goes: below its project in the folder of removed files."""
    return F.concat_ws("/", F.lit(removed), F.nullif(names.safe_part(project), F.lit("")), path)


def removed_items(listing: DataFrame, path: str, removed: str = wav.REMOVED) -> DataFrame:
    """path, project and original of the files in the folder of removed files."""
    p = parts(F.col(path))
    inside = listing.where(F.get(p, F.lit(0)) == removed)
    return inside.select(path, F.get(p, F.lit(1)).alias("project"), F.array_join(F.slice(p, 3, F.size(p)), "/").alias("original"))


def card_roots(listing: DataFrame, path: str, mount: str) -> DataFrame:
    """Mounts that look like a recorder's card: a SOUNDDEV folder, or audio within three levels."""
    p = parts(F.col(path))
    sign = (F.get(p, F.lit(0)) == "SOUNDDEV") | (F.lower(F.col(path)).rlike(r"\.(wav|bwf)$") & (F.size(p) <= 3))
    return listing.groupBy(mount).agg(F.max(sign).alias("is_card")).where("is_card").select(mount)


def clips(probes: DataFrame, path: str, text: str) -> DataFrame:
    """Start, rate and length of video clips from the prober's JSON; what is missing is the error."""
    d = probes.where(F.col(path).rlike(VIDEO)).withColumn("_p", F.from_json(text, PROBE))
    video = F.get(F.filter("_p.streams", lambda s: s["codec_type"] == "video"), F.lit(0))
    codes = F.array_compact(F.concat(F.transform("_p.streams", lambda s: F.try_element_at(s["tags"], F.lit("timecode"))), F.array(F.try_element_at(F.col("_p.format.tags"), F.lit("timecode")))))
    d = d.withColumn("rate", timecode.parse_rate(video["r_frame_rate"])).withColumn("tc", F.get(codes, F.lit(0))).withColumn("fps", timecode.nominal_fps(F.col("rate")))
    start = timecode.tc_to_frames(F.col("tc"), F.col("fps"), F.coalesce(F.col("tc").contains(";"), F.lit(False)))
    error = F.when(F.col("_p").isNull(), "unreadable").when(F.col("rate").isNull(), "no video").when(F.col("tc").isNull(), "no timecode").otherwise("")
    return d.select(path, "rate", F.when(F.col("rate").isNotNull(), start).alias("start_frame"), F.col("_p.format.duration").try_cast("double").alias("duration"), F.size(F.filter("_p.streams", lambda s: s["codec_type"] == "audio")).alias("audio_streams"), error.alias("error"))


def sync_plan(matches: DataFrame) -> DataFrame:
    """For each clip and take the whole samples that its sound is cut or delayed by, and its length.

    matches: clip, take, c_start, c_len, t_start, t_len in ticks of 1/num seconds, num, sample_rate.
    """
    lead = timecode.div(F.abs(F.col("c_start") - F.col("t_start")) * F.col("sample_rate"), F.col("num"))
    cut = F.col("t_start") < F.col("c_start")
    return matches.select("clip", "take", F.when(cut, lead).otherwise(0).alias("cut_samples"), F.when(cut, 0).otherwise(lead).alias("delay_samples"), timecode.div(F.col("c_len") * F.col("sample_rate"), F.col("num")).alias("samples"))


def undo(actions: DataFrame) -> DataFrame:
    """The moves that take a plan's moves back."""
    return actions.where("kind = 'move'").select("kind", F.col("dst").alias("path"), F.col("path").alias("dst"), F.lit("undo").alias("reason"), "level", "other")


def edit_plan(df: DataFrame, edits: DataFrame, family: list[str]) -> DataFrame:
    """path, column and value of each edit (path, column, value) and of the same edit on the take's other files."""
    # A path of one family meets each of the family's edits once, so that what is made needn't be told apart again.
    members = df.where("path is not null").select("path", *family).distinct()
    members = members.withColumn("_n", F.count("*").over(Window.partitionBy("path")))
    own = edits.select("path", "column", "value").distinct().join(members, "path")
    met = own.select(*family, "column", "value").distinct().join(members, family)
    alone = own.where(reduce(lambda x, y: x | y, (F.col(c).isNull() for c in family)))  # no other file is of a family that isn't known
    every = met.select("path", "column", "value", "_n").unionByName(alone.select("path", "column", "value", "_n"))
    return every.where("_n = 1").drop("_n").unionByName(every.where("_n > 1").drop("_n").distinct())


def to_fix(files: DataFrame, verdicts: DataFrame, key: str = "path") -> DataFrame:
    """Files that weren't measured or fail a measurement."""
    ok = verdicts.groupBy(key).agg(F.min(F.col("ok").cast("int")).alias("_ok"))
    return files.join(ok, key, "left").where(F.coalesce(F.col("_ok"), F.lit(0)) == 0).drop("_ok")
