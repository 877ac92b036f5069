"""Plans of renames, moves, splits and merges as tables of actions; nothing here touches a file but execute()."""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.functions import names
from reelspark.functions.paths import ancestors
from reelspark.operators.dedupe import clusters
from reelspark.operators.prefix import numbered_from, ranged, running
from reelspark.schema import ACTION

#: Fixed value: rows of a preview.
PREVIEW = 5000


def rename_plan(df: DataFrame, path: Column, target: Column, existing: DataFrame | None = None) -> DataFrame:
    """path, target and problem of each row: a bad name, the same target twice, or one that exists and isn't freed by the plan itself."""
    plan = df.select(path.alias("path"), target.alias("target"))
    counts = plan.groupBy("target").agg(F.count("*").alias("_n"))
    plan = plan.join(counts, "target")
    if existing is not None:
        freed = plan.where("path <> target").select(F.col("path").alias("target")).distinct()
        kept = existing.select(F.col("path").alias("target")).distinct().join(freed, "target", "left_anti").withColumn("_there", F.lit(True))
        plan = plan.join(kept, "target", "left")
    else:
        plan = plan.withColumn("_there", F.lit(None).cast("boolean"))
    problem = (
        F.coalesce(names.name_problem(names.basename(F.col("target"))), F.when(F.col("_n") > 1, "duplicate target"), F.when(F.col("_there") & (F.col("path") != F.col("target")), "target exists"), F.when(F.startswith(F.col("target"), F.concat("path", F.lit("/"))), "into itself"), F.lit(""))
    )
    return plan.select("path", "target", problem.alias("problem"))


def numbered(df: DataFrame, wanted: str, order: list[str], existing: DataFrame | None = None) -> DataFrame:
    """df with unique: the wanted name, or the first free `name (n)` from 2 on, against existing names and earlier rows.

    Rows that want one name are counted by ranges of the order, and the k-th takes the k-th free number, which is k and
    the taken ones below it: with the i-th taken number t, t - i are free below it, so it counts for every k above
    t - i. Neither the rows nor the taken numbers of a name are ever in one task. Names with a number of their
    own are looked up among the existing ones alone.
    """
    rows = ranged(df, [wanted, *order])
    d = running(rows, [wanted], F.shiftright("_pos", 16), ["_pos"], _k=("sum", F.lit(1).cast("long"))).drop("_pos")
    ext = F.regexp_extract(F.col(wanted), r"(?<=.)(\.[^./]*)$", 1)
    bare = F.expr(f"substring({wanted}, 1, length({wanted}) - length(regexp_extract({wanted}, '(?<=.)([.][^./]*)$', 1)))")
    name = lambda k: F.when(k == 1, F.col(wanted)).otherwise(F.concat(bare, F.lit(" ("), k.cast("string"), F.lit(")"), ext))
    if existing is None:
        return d.withColumn("unique", name(F.col("_k"))).drop("_k")
    # an existing name is the first of its own, and the n-th of the one without its number
    number = r" \(([1-9][0-9]*)\)(?=(\.[^./]*)?$)"
    there = existing.select(F.col(wanted).alias("_name")).where(F.col("_name").isNotNull()).distinct()
    nth = F.regexp_extract("_name", number, 1).try_cast("long")
    ways = F.array(F.struct(F.col("_name").alias("w"), F.lit(1).cast("long").alias("t")), F.struct(F.regexp_replace("_name", number, "").alias("w"), nth.alias("t")))
    taken = there.select(F.inline(F.filter(ways, lambda x: (x["t"] == 1) & (x["w"] == F.col("_name")) | (x["t"] > 1))))
    taken = taken.select(F.col("w").alias(wanted), "t").join(df.select(wanted).distinct(), wanted, "left_semi")
    taken = running(taken, [wanted], F.shiftright("t", 16), ["t"], i=("sum", F.lit(1).cast("long")))
    free = numbered_from(d, [wanted], "_k", taken.select(wanted, (F.col("t") - F.col("i")).alias("_below")), "_below")
    return free.withColumn("unique", name(F.col("_k") + F.coalesce("passed", F.lit(0)))).drop("_k", "passed")


def nested_plan(df: DataFrame, nested: DataFrame) -> DataFrame:
    """Actions that lift files of a folder into its parent of the same name: move, remove (the same there) or skip.

    df: path, key (of the content); nested: inner, outer.
    """
    inner = _below(df, nested)
    dst = F.concat("outer", F.expr("substring(path, length(inner) + 1)"))
    there = df.select(F.col("path").alias("dst"), F.col("key").alias("d_key"))
    planned = inner.withColumn("dst", dst).join(there, "dst", "left")
    planned = planned.withColumn("_nth", F.row_number().over(Window.partitionBy("dst").orderBy("path")))
    kind = F.when(F.col("d_key").isNull() & (F.col("_nth") == 1), "move").when(F.col("d_key") == F.col("key"), "remove").otherwise("skip")
    return planned.select(kind.alias("kind"), "path", "dst")


def _below(df: DataFrame, nested: DataFrame) -> DataFrame:
    """Files with the nested folder that holds them, by their ancestors."""
    return df.withColumn("inner", F.explode(ancestors(names.folder(F.col("path"))))).join(nested, "inner")


def merge_plan(df: DataFrame, group: str) -> DataFrame:
    """Actions that merge each group's files into its target folder.

    df: group, path, name, key (audio), hash, size, channels, noted, in_target, score (order of
    preference), target (path in the target folder). Best copies come first, and what is decided for
    one bears on the next, but only where they have a recording or a place in common: files of a group that are
    linked by these are planned together, in order, and a group is as many plans as it has such components.
    """
    files = df.withColumn("_place", F.when(F.col("in_target"), F.col("path")).otherwise(F.col("target"))).withColumn("_node", F.concat_ws("\x1f", F.col(group).cast("string"), "path"))

    def links(key: str) -> DataFrame:
        """Each file that shares key with others, and the first of them."""
        first = files.groupBy(group, key).agg(F.min("_node").alias("_first"), F.count("*").alias("_n")).where("_n > 1").select(F.col(group).alias("_g"), F.col(key).alias("_key"), "_first")
        return files.join(first, F.col(group).eqNullSafe(F.col("_g")) & F.col(key).eqNullSafe(F.col("_key"))).where("_node <> _first").select(F.col("_first").alias("a"), F.col("_node").alias("b"))

    parts = clusters(links("key").unionByName(links("_place"))).select(F.col("name").alias("_node"), "cluster")
    parted = files.join(parts, "_node", "left").withColumn("_part", F.coalesce("cluster", "_node"))
    fields = ["path", "name", "key", "hash", "size", "channels", "noted", "in_target", "score", "target"]
    shape = f"{group} {df.schema[group].dataType.simpleString()}, {ACTION}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for pdf in batches for r in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False, name="File"))
        made: list[tuple] = []
        for _, own in groupby(rows, key=lambda r: r.part):
            own = list(own)
            made += [(own[0].grp, kind, path, *rest, "") for path, (kind, *rest) in _plan_files(own).items()]
            if len(made) > 4096:
                yield pd.DataFrame(made, columns=[group, *_ACTION_FIELDS])
                made = []
        yield pd.DataFrame(made, columns=[group, *_ACTION_FIELDS])

    named = parted.select(F.col("_part").alias("part"), F.col(group).alias("grp"), *fields)
    return named.repartition("part").sortWithinPartitions("part", F.col("in_target").desc(), "score", "path").mapInPandas(run, shape)


_ACTION_FIELDS = ["kind", "path", "dst", "reason", "level", "other"]


def _plan_files(files: list) -> dict[str, list]:
    """path: [kind, dst, reason, level] of files that bear on each other, those in the target first, then by score and path."""
    kept: dict = {}
    places: dict[str, object] = {}
    actions: dict[str, list] = {}
    for r in files:
        if r.in_target:
            kept.setdefault(r.key, []).append(r)
            places[r.path] = r
            continue
        same = [k for k in kept.get(r.key, []) if k.name.lower() == r.name.lower()] or [k for k in kept.get(r.key, []) if k.hash == r.hash]
        if same:
            twin = same[0]
            if r.noted and not twin.noted and r.name.lower() == twin.name.lower():
                kept[r.key] = [k for k in kept[r.key] if k is not twin] + [r]
                if twin.path in actions:  # it was to be moved in: this copy goes instead
                    dst = actions[twin.path][1]
                    actions[twin.path] = ["remove", r.path, "a copy with notes is kept", "audio"]
                    actions[r.path] = ["move", dst, "has notes", ""]
                    places[dst] = r
                else:
                    actions[r.path] = ["replace", twin.path, "has notes that the kept copy lacks", "audio"]
            else:
                actions[r.path] = ["remove", twin.path, "the same recording is kept", "identical" if twin.size == r.size else "audio"]
            continue
        other = places.get(r.target)
        if other is None:
            kept.setdefault(r.key, []).append(r)
            places[r.target] = r
            actions[r.path] = ["move", r.target, "", ""]
        elif other.name.lower() == r.name.lower() and other.channels != r.channels:
            if r.channels < other.channels:
                actions[r.path] = ["remove", r.target, "its tracks are all in the other", "subset"]
            elif other.path in actions:
                actions[other.path] = ["remove", r.path, "its tracks are all in the other", "subset"]
                actions[r.path] = ["move", r.target, "has more tracks", ""]
                places[r.target] = r
            else:
                actions[r.path] = ["replace", r.target, "has more tracks", "subset"]
        else:
            actions[r.path] = ["skip", r.target, "another file has this name", ""]
    return actions


def keep_takes_together(actions: DataFrame, folder: Column, take: Column, is_take: Column) -> DataFrame:
    """If one file of a take in a folder stays (skip or differs), its others are skipped too."""
    stays = F.max(F.when(F.col("kind").isin("skip", "differs") & is_take, 1).otherwise(0)).over(Window.partitionBy(folder, take))
    held = (stays == 1) & is_take & F.col("kind").isin("move", "remove", "replace")
    return actions.withColumn("kind", F.when(held, "skip").otherwise(F.col("kind")))


def split_plan(df: DataFrame, path: str, tracks: str) -> DataFrame:
    """One output for each track: path, index, track and out, the name `stem_index_track`; repeated track names are numbered."""
    each = df.select(path, F.posexplode(tracks).alias("index", "track"))
    nth = F.row_number().over(Window.partitionBy(path, F.lower("track")).orderBy("index"))
    several = F.count("*").over(Window.partitionBy(path, F.lower("track"))) > 1
    label = F.when(F.trim("track") == "", F.concat(F.lit("Trk"), (F.col("index") + 1).cast("string"))).otherwise(names.safe_part(F.col("track"), "_"))
    out = F.concat(names.stem(F.col(path)), F.lit("_"), label, F.when(several, F.concat(F.lit("_"), nth.cast("string"))).otherwise(""), F.regexp_extract(path, r"(?<=.)(\.[^./]*)$", 1))
    return each.select(path, (F.col("index") + 1).cast("long").alias("index"), "track", out.alias("out"))


def combine_problem(df: DataFrame, by: list[str]) -> DataFrame:
    """Why files can't be combined, by group: they differ in rate, bits, format, length or start."""
    test = lambda c, say: F.when(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int")) > 1, say)
    tests = [("sample_rate", "sample rates differ"), ("bits", "bit depths differ"), ("float_samples", "formats differ"), ("frames", "lengths differ"), ("time_reference", "starts differ")]
    return df.groupBy(*by).agg(F.coalesce(*(test(c, s) for c, s in tests), F.when(F.count("*") < 2, "nothing to combine"), F.lit("")).alias("problem"))


def empty_folders(listing: DataFrame, path: str, folders: DataFrame, markers: list[str]) -> DataFrame:
    """Topmost folders with nothing but marker files below. listing: files; folders: folder."""
    full = listing.where(~names.basename(F.col(path)).isin(markers)).select(F.explode(ancestors(names.folder(F.col(path)))).alias("folder")).distinct()
    every = folders.select("folder").distinct()
    empty = every.join(full, "folder", "left_anti")
    return empty.withColumn("_up", names.folder(F.col("folder"))).join(empty.select(F.col("folder").alias("_up")), "_up", "left_anti").select("folder")


def guarded(actions: DataFrame, protected: list[str]) -> DataFrame:
    """actions with blocked: true where a path or destination is at or below a protected folder."""
    at = F.lit(False)
    for root in protected:
        for c in ("path", "dst"):
            at = at | (F.col(c) == root) | F.startswith(F.col(c), F.lit(root.rstrip("/") + "/"))
    return actions.withColumn("blocked", F.coalesce(at, F.lit(False)))


def execute(actions: DataFrame, protected: list[str] | None = None) -> DataFrame:
    """Runs move, copy and remove actions where the files are; path, dst and status of each.

    Nothing is overwritten: a destination that exists is a conflict. A copy goes to a temporary name, is
    read back and then renamed. A task that runs again finds its work done and says so, so a lost
    executor costs nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "dst": pdf["dst"], "status": [_act(*r) for r in zip(pdf["kind"], pdf["path"], pdf["dst"], pdf["blocked"])]})

    return guarded(actions, protected or []).select("kind", "path", "dst", "blocked").mapInPandas(run, "path string, dst string, status string")


def _act(kind: str, path: str, dst: str, blocked: bool) -> str:
    if blocked:
        return "blocked"
    try:
        if kind == "remove":
            if os.path.lexists(path):
                os.remove(path)
            return "done"
        if kind == "copy":
            said = _copy(path, dst, True)[0]
            return {"verified": "done", "exists": "conflict", "there": "conflict"}.get(said, said)
        if kind != "move":
            return "left"
        if os.path.lexists(dst):
            return "done" if not os.path.lexists(path) else "conflict"
        os.makedirs(os.path.dirname(dst), exist_ok=True)
        os.rename(path, dst)
        return "done"
    except OSError as e:
        return f"failed: {e.strerror}"


def _digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "md5").hexdigest()


def _copy(path: str, dst: str, verify: bool) -> tuple[str, str]:
    """Status and md5 of one copy."""
    try:
        if os.path.lexists(dst):
            own = _digest(path)
            return ("there" if os.path.getsize(path) == os.path.getsize(dst) and own == _digest(dst) else "exists"), own
        os.makedirs(os.path.dirname(dst) or ".", exist_ok=True)
        temp, read = f"{dst}.{uuid.uuid4().hex}.part", hashlib.md5()
        try:
            with open(path, "rb") as a, open(temp, "xb") as b:
                while part := a.read(1 << 22):
                    read.update(part)
                    b.write(part)
                b.flush()
                os.fsync(b.fileno())
            if os.path.getsize(temp) != os.path.getsize(path):
                return "size differs", ""
            if verify and _digest(temp) != read.hexdigest():
                return "content differs", ""
            shutil.copystat(path, temp)
            os.link(temp, dst)  # fails where another got there first
        finally:
            if os.path.lexists(temp):
                os.remove(temp)
        return "verified" if verify else "copied", read.hexdigest()
    except FileExistsError:
        return "exists", ""
    except OSError as e:
        return f"failed: {e.strerror}", ""


def copy_verified(plan: DataFrame, verify: bool = True) -> DataFrame:
    """Copies path to dst: to a temporary name, with its dates, and renamed once its size and (if verify)
    its md5, read back, are those that were read. path, dst, status and md5; a destination is never
    replaced, and one with the same content is there already."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [_copy(a, b, verify) for a, b in zip(pdf["path"], pdf["dst"])]
            yield pd.DataFrame({"path": pdf["path"], "dst": pdf["dst"], "status": [m[0] for m in made], "md5": [m[1] for m in made]})

    return plan.select("path", "dst").mapInPandas(run, "path string, dst string, status string, md5 string")


def apply_renames(ops: list[tuple[str, str]]) -> list[str]:
    """Renames a batch, all or nothing, and returns the folders it made.

    Every file first gets a temporary name beside it and then its own, so names may be swapped or
    handed on. If anything fails, all is taken back and the folders go. The batch is one transaction
    and so runs in one place; what doesn't hang together is better given in batches of its own.
    """
    ops = [(a, b) for a, b in ops if a != b]
    sources, targets = {a for a, _ in ops}, [b for _, b in ops]
    if len(set(targets)) < len(targets):
        raise FileExistsError("two files get one name")
    for _, b in ops:
        if b not in sources and os.path.lexists(b) and not any(os.path.samefile(b, a) for a, c in ops if c == b):
            raise FileExistsError(b)
    done: list[tuple[str, str]] = []
    made: list[str] = []

    def step(a: str, b: str) -> None:
        if os.path.lexists(b):
            raise FileExistsError(b)
        os.rename(a, b)
        done.append((a, b))

    try:
        temps = [(a, f"{a}.{uuid.uuid4().hex}.moving", b) for a, b in ops]
        for a, t, _ in temps:
            step(a, t)
        for _, t, b in temps:
            folder, missing = os.path.dirname(b), []
            while folder and not os.path.isdir(folder):
                missing.append(folder)
                folder = os.path.dirname(folder)
            for f in reversed(missing):
                os.mkdir(f)
                made.append(f)
            step(t, b)
    except OSError:
        for a, b in reversed(done):
            os.rename(b, a)
        for f in reversed(made):
            os.rmdir(f)
        raise
    return made


def undo_renames(ops: list[tuple[str, str]], made: list[str]) -> None:
    """Takes a batch back, and the folders that it made and left empty."""
    apply_renames([(b, a) for a, b in ops])
    for f in sorted(made, key=len, reverse=True):
        if os.path.isdir(f) and not os.listdir(f):
            os.rmdir(f)


def rechecked(actions: DataFrame, now: DataFrame) -> DataFrame:
    """actions (with the size and mtime they were planned for) against the files as they are: kind is
    'skip' and reason says so where a file, or the copy that stands for it, has changed or gone."""
    at = now.select(F.col("path").alias("_p"), F.col("size").alias("_s"), F.col("mtime").alias("_m"))
    found = actions.join(at, actions["path"] == at["_p"], "left")
    fresh = F.col("_p").isNotNull() & (F.col("size") == F.col("_s")) & (F.abs(F.col("mtime") - F.col("_m")) < 2.1)
    kept = now.select(F.col("path").alias("dst")).distinct().withColumn("_there", F.lit(True))
    found = found.join(kept, "dst", "left")
    reason = F.when(~fresh, "it has changed since").when((F.col("kind") == "remove") & F.col("_there").isNull(), "the copy that stays is gone")
    return found.select(*(F.when(reason.isNotNull(), "skip").otherwise(F.col("kind")).alias("kind") if c == "kind" else F.coalesce(reason, F.col("reason")).alias("reason") if c == "reason" else F.col(c) for c in actions.columns))


def touched_paths(*plans: DataFrame) -> DataFrame:
    """Every path that some plan reads or writes, once."""
    every = [p.select(F.col(c).alias("path")) for p in plans for c in ("path", "dst", "target") if c in p.columns]
    return reduce(DataFrame.unionByName, every).where("path <> ''").distinct()


def preview(plan: DataFrame, *order: str, most: int = PREVIEW) -> DataFrame:
    """The first rows of a plan, as they are shown before it runs."""
    return plan.orderBy(*order).limit(most)
