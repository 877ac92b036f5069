"""Files: WAV files and copies made of the rows of small tables, read back and compared with those rows."""

import os
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.functions.names import basename
from reelspark.operators import catalog
from reelspark.operators import signal as op
from reelspark.plans import files, moves
from reelspark.queries import Tables, query
from reelspark.queries.signal import _TRACK, _track
from reelspark.session import checkpoint_dir
from reelspark.sources import rewrite, store, wav, waveforms

RATE = 8_000


def _folder(t: Tables, name: str) -> str:
    """A new folder in the one that all executors share; these queries read and write files by path."""
    root = checkpoint_dir(t.spark).removeprefix("file://").removeprefix("file:")
    if "://" in root:
        raise ValueError(f"{root} has no path of the file system")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def _library(t: Tables) -> str:
    """A WAV file for each nation, written on the executors: k seconds and one, 1 to 3 tracks, fields from the row."""
    root = _folder(t, "library")

    def write(batches):
        for pdf in batches:
            for k, name in zip(pdf["n_nationkey"].tolist(), pdf["n_name"]):
                tracks = ["Boom", "Lav 1", "Lav 2"][: 1 + k % 3]
                ixml = rewrite.build_ixml(None, {"meta_project": f"P{k % 4}", "scene": f"S{k}", "take": f"{k % 9 + 1:02}", "note": name, "circled": k % 5 == 0}, f"{k:02}T01.wav", tracks)
                x = np.tile((np.arange((k + 1) * RATE) % 100 - 50)[:, None] / 100 * (k + 1) / 25, (1, 1 + k % 3))
                folder = f"{root}/R{k % 3}"
                os.makedirs(folder, exist_ok=True)
                wav.write_wav(f"{folder}/{k:02}T01.wav", x, RATE, 24, ixml=ixml.decode(), bext={"time_reference": RATE * 60 * k, "date": f"2025-01-{k % 28 + 1:02}", "originator": "MixPre"}, cues=[(10 * k, f"mark é {k}")])
            yield pdf[["n_nationkey"]]

    made = t.nation.select("n_nationkey", "n_name").mapInPandas(write, "n_nationkey int").count()
    return root if made else root


_NAME = "lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || 'T01.wav'"
_TRACKS = "['Boom', 'Lav 1', 'Lav 2'][1:1 + n_nationkey % 3]"


@query(f"""
SELECT {_NAME} AS name, 'S' || CAST(n_nationkey AS VARCHAR) AS scene, lpad(CAST(n_nationkey % 9 + 1 AS VARCHAR), 2, '0') AS take, '00:' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || ':00' AS start_tc,
  '0:' || lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') AS length, CAST(1 + n_nationkey % 3 AS VARCHAR) AS channels, array_to_string({_TRACKS}, ', ') AS tracks, CASE WHEN n_nationkey % 5 = 0 THEN '★' ELSE '' END AS circled,
  '2025-01-' || lpad(CAST(n_nationkey % 28 + 1 AS VARCHAR), 2, '0') AS date, 'MixPre' AS recorder, n_name AS note, 'R' || CAST(n_nationkey % 3 AS VARCHAR) AS place FROM nation""")
def q_wav_scan(t: Tables) -> DataFrame:
    d = catalog.grid(wav.scan(t.spark, _library(t)))
    return d.select("name", "scene", "take", "start_tc", "length", "channels", "tracks", "circled", "date", "recorder", "note", basename(F.col("folder")).alias("place"))


@query(f"SELECT {_NAME} AS name, CAST((n_nationkey + 1) * {RATE} AS BIGINT) AS frames FROM nation WHERE n_nationkey % 3 = 1")
def q_wav_under(t: Tables) -> DataFrame:
    """One reel of the library; the others aren't walked."""
    root = _library(t)
    return wav.scan(t.spark, root, under=f"{root}/R1/", since=0.0).select(basename(F.col("path")).alias("name"), "frames")


@query(f"SELECT {_NAME} AS name, CAST(10 * n_nationkey AS BIGINT) AS frame, 'mark é ' || CAST(n_nationkey AS VARCHAR) AS label, CAST((n_nationkey + 1) * {RATE} AS BIGINT) AS frames, CAST(n_nationkey AS BIGINT) * 60 * {RATE} AS time_reference FROM nation")
def q_wav_cues(t: Tables) -> DataFrame:
    d = wav.scan(t.spark, _library(t)).withColumn("name", basename(F.col("path")))
    return d.select("name", "frames", "time_reference", F.explode("cues").alias("c")).select("name", "c.frame", "c.label", "frames", "time_reference")


@query(f"""
SELECT {_NAME} AS name, CAST(c AS INT) AS channel, CAST(ceil((n_nationkey + 1) * {RATE} / 5000.0) AS BIGINT) AS blocks, CAST((n_nationkey + 1) * {RATE} AS BIGINT) AS samples, round(0.5 * (n_nationkey + 1) / 25, 4) AS top
FROM nation, LATERAL unnest(range(0, 1 + n_nationkey % 3)) AS u(c)""")
def q_wav_blocks(t: Tables) -> DataFrame:
    d = wav.blocks(t.spark, _library(t), 5_000, stretch=100_000).withColumn("name", basename(F.col("path")))
    top = F.max(F.array_max(F.transform("samples", lambda x: F.abs(x.cast("double")))))
    return d.groupBy("name", "channel").agg(F.count("*").alias("blocks"), F.sum(F.size("samples")).cast("long").alias("samples"), F.round(top, 4).alias("top"))


@query(f"""
WITH x AS (SELECT n_nationkey, i * 20 // ((n_nationkey + 1) * {RATE}) AS bucket, (i % 100 - 50) / 100.0 * (n_nationkey + 1) / 25 AS v FROM nation, LATERAL unnest(range(0, (n_nationkey + 1) * {RATE})) AS u(i)),
b AS (SELECT n_nationkey, bucket, round(max(abs(v)), 3) AS peak, round(least(sqrt(avg(v * v)), max(abs(v))), 3) AS rms FROM x GROUP BY 1, 2)
SELECT {_NAME} AS name, CAST(c AS INT) AS channel, bucket, peak, rms FROM b JOIN nation USING (n_nationkey), LATERAL unnest(range(0, 1 + n_nationkey % 3)) AS u(c)""")
def q_wav_envelope(t: Tables) -> DataFrame:
    d = wav.envelopes(t.spark, _library(t), 20, stretch=100_000, frames=3_000)
    return d.select(basename(F.col("path")).alias("name"), "channel", "bucket", F.round("peak", 3).alias("peak"), F.round("rms", 3).alias("rms"))


@query(f"""
WITH f AS (SELECT n_nationkey, {_NAME} AS name, {_TRACKS} AS tracks FROM nation)
SELECT replace(name, '.wav', '') || '_' || tracks[k] || '.wav' AS name, tracks[k] AS track, CAST((n_nationkey + 1) * {RATE} AS BIGINT) AS frames, 'done' AS status FROM f, LATERAL unnest(range(1, len(tracks) + 1)) AS u(k) WHERE len(tracks) > 1""")
def q_wav_split(t: Tables) -> DataFrame:
    d = wav.scan(t.spark, _library(t)).where("channels > 1")
    plan = moves.split_plan(d.select("path", "tracks"), "path", "tracks")
    done = files.cut_plan(files.split_files(plan.withColumn("out", F.regexp_replace("out", r"/R(\d)/", "/split/"))))
    root = done.first()["out"].rsplit("/", 1)[0]
    made = wav.scan(t.spark, root).select(F.col("path").alias("out"), F.get("tracks", F.lit(0)).alias("track"), "frames")
    return done.join(made, "out").select(basename(F.col("out")).alias("name"), "track", "frames", "status")


@query(f"SELECT {_NAME} AS name, true AS same, array_to_string({_TRACKS}, '|') AS tracks FROM nation WHERE n_nationkey % 3 > 0")
def q_wav_combine(t: Tables) -> DataFrame:
    """Files taken apart and put together again have the same samples."""
    d = files.cut_plan(wav.scan(t.spark, _library(t)).where("channels > 1").select("path", "channels"))
    parts = d.select("path", F.posexplode(F.sequence(F.lit(1), F.col("channels"))).alias("k", "index")).select("path", F.col("index").cast("long").alias("index"), F.concat("path", F.lit("_"), F.col("index").cast("string"), F.lit(".wav")).alias("out"))
    split = files.cut_plan(files.split_files(parts))
    lists = split.groupBy("path").agg(F.array_sort(F.collect_list("out")).alias("paths")).select("paths", F.concat("path", F.lit("_all.wav")).alias("out"))
    whole = files.cut_plan(files.combine_files(lists)).where("status = 'done'")

    def same(batches):
        for pdf in batches:
            rows = []
            for out in pdf["out"]:
                a, b = out.removesuffix("_all.wav"), out
                x, y = (b"".join(p.tobytes() for p in rewrite.raw_blocks(f, rewrite.whole(f))) for f in (a, b))
                rows.append((os.path.basename(a), x == y, "|".join(rewrite.whole(b)["tracks"])))
            yield pd.DataFrame(rows, columns=["name", "same", "tracks"])

    return whole.select("out").mapInPandas(same, "name string, same boolean, tracks string")


@query(f"SELECT {_NAME} AS name, 'done' AS status, round(0.25 * (n_nationkey + 1) / 25, 3) AS first, CASE WHEN n_nationkey % 3 > 0 THEN round(0.5 * (n_nationkey + 1) / 25, 3) END AS second, n_name AS note FROM nation")
def q_wav_processed(t: Tables) -> DataFrame:
    """The first track at half its level, the others as they were, and the fields kept."""
    d = files.cut_plan(wav.scan(t.spark, _library(t)).select("path"))
    plan = d.select("path", F.array(F.lit(0)).alias("touched"), F.concat("path", F.lit(".half.wav")).alias("out"))
    done = files.cut_plan(files.process_files(plan, [{"type": "gain", "bypass": False, "params": {"gain": float(20 * np.log10(0.5))}}]))
    root = os.path.dirname(os.path.dirname(done.first()["out"]))
    top = F.max(F.array_max(F.transform("samples", lambda x: F.abs(x.cast("double")))))
    levels = wav.blocks(t.spark, root).where(F.col("path").endswith(".half.wav")).groupBy(F.col("path").alias("out"), "channel").agg(F.round(top, 3).alias("top"))
    wide = levels.groupBy("out").agg(F.max(F.when(F.col("channel") == 0, F.col("top"))).alias("first"), F.max(F.when(F.col("channel") == 1, F.col("top"))).alias("second"))
    notes = wav.scan(t.spark, root).select(F.col("path").alias("out"), "note")
    return done.join(wide, "out").join(notes, "out").select(basename(F.col("path")).alias("name"), "status", "first", "second", "note")


@query(f"""SELECT {_NAME} AS name, 'N' || CAST(n_nationkey AS VARCHAR) AS scene, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE n_name || repeat('!', 300) END AS note, CAST((n_nationkey + 1) * {RATE} AS BIGINT) AS frames FROM nation""")
def q_wav_metadata(t: Tables) -> DataFrame:
    """Fields written into the files, where the longer ones need a rewrite, and read back by a scan."""
    root = _library(t)
    d = files.cut_plan(wav.scan(t.spark, root).select("path", "scene", "note"))
    odd = F.regexp_extract("scene", r"(\d+)", 1).cast("int") % 2 == 1
    changes = F.create_map(F.lit("scene"), F.concat(F.lit("N"), F.substring("scene", 2, 5)), F.lit("note"), F.when(odd, F.concat("note", F.lit("!" * 300))).otherwise(F.col("note")))
    files.cut_plan(files.write_metadata(d.select("path", changes.alias("changes"), F.lit(None).cast("string").alias("filename")), allow_rewrite=True))
    return wav.scan(t.spark, root).select(basename(F.col("path")).alias("name"), "scene", "note", "frames")


@query("SELECT r_regionkey, CAST(c AS INT) AS channel, round(20 * log10(0.04 * (r_regionkey + 1) / (c + 1)), 1) AS lufs FROM region, LATERAL unnest([0, 1]) AS u(c)")
def q_wav_loudness(t: Tables) -> DataFrame:
    """Sines of 997 Hz are as loud as their level."""
    root = _folder(t, "tones")

    def write(batches):
        for pdf in batches:
            for k in pdf["r_regionkey"].tolist():
                os.makedirs(root, exist_ok=True)
                x = 0.04 * (k + 1) * np.sqrt(2) * np.sin(2 * np.pi * 997 * np.arange(3 * 48_000) / 48_000)
                wav.write_wav(f"{root}/{k}.wav", np.stack([x, x / 2], axis=1), 48_000, 24)
            yield pdf

    t.region.select("r_regionkey").mapInPandas(write, "r_regionkey int").count()
    blocks = wav.blocks(t.spark, root, 24_000).withColumn("r_regionkey", F.regexp_extract("path", r"(\d+)\.wav$", 1).cast("int"))
    powers = op.block_powers(blocks, ["r_regionkey", "channel"], "block", "samples", 48_000)
    lufs = op.gated_loudness(op.window_powers(powers, ["r_regionkey", "channel"], "q", "power", 4), ["r_regionkey", "channel"])
    return lufs.select("r_regionkey", "channel", F.round("lufs", 1).alias("lufs"))


def _texts(t: Tables) -> tuple[str, DataFrame]:
    """A text file for each supplier's name."""
    root = _folder(t, "texts")

    def write(batches):
        for pdf in batches:
            os.makedirs(f"{root}/card", exist_ok=True)
            for k, name in zip(pdf["s_suppkey"], pdf["s_name"]):
                with open(f"{root}/card/{k}", "w") as f:
                    f.write(name)
            yield pdf[["s_suppkey"]]

    return root, files.cut_plan(t.supplier.select("s_suppkey", "s_name").mapInPandas(write, "s_suppkey long"))


@query("SELECT s_suppkey, 'verified' AS status, md5(s_name) AS md5, 'there' AS again FROM supplier")
def q_verified_copies(t: Tables) -> DataFrame:
    root, keys = _texts(t)
    plan = keys.select(F.concat(F.lit(f"{root}/card/"), F.col("s_suppkey").cast("string")).alias("path"), F.concat(F.lit(f"{root}/copy/"), F.col("s_suppkey").cast("string")).alias("dst"))
    first = files.cut_plan(moves.copy_verified(plan))
    again = files.cut_plan(moves.copy_verified(plan)).select("path", F.col("status").alias("again"))
    return first.join(again, "path").select(basename(F.col("path")).cast("long").alias("s_suppkey"), "status", "md5", "again")


@query("WITH m AS (SELECT max(s_suppkey) AS m FROM supplier) SELECT s_suppkey AS file, (SELECT s_name FROM supplier x WHERE x.s_suppkey = CASE WHEN s.s_suppkey = 0 THEN m ELSE s.s_suppkey - 1 END) AS content FROM supplier s, m")
def q_renames(t: Tables) -> DataFrame:
    """Every file takes the next one's name, and the last the first one's, in one batch."""
    root, keys = _texts(t)
    n = keys.count()  # one transaction: its operations are listed
    moves.apply_renames([(f"{root}/card/{k}", f"{root}/card/{(k + 1) % n}") for k in range(n)])

    def read(batches):
        for pdf in batches:
            yield pd.DataFrame({"file": pdf["s_suppkey"], "content": [open(f"{root}/card/{k}").read() for k in pdf["s_suppkey"]]})

    return keys.mapInPandas(read, "file long, content string")


@query(f"""
WITH {_TRACK}, e AS (SELECT user_id, pos * 16 // total AS bucket, max(abs(value / 400)) AS peak FROM t GROUP BY 1, 2)
SELECT user_id, bucket, round(round(least(1, peak) * 65535) / 65535, 4) AS peak FROM e""")
def q_waveform_store(t: Tables) -> DataFrame:
    """Envelopes as 16-bit blobs, stored and loaded again."""
    e = op.envelope(_track(t).withColumn("value", F.col("value") / 400), ["user_id"], "pos", "total", "value", 16)
    made = waveforms.blobs(e.select(F.col("user_id").cast("string").alias("path"), F.lit(0).alias("channel"), "bucket", F.least("peak", F.lit(1.0)).alias("peak"), F.least("rms", F.lit(1.0)).alias("rms")), 16)
    target = f"{checkpoint_dir(t.spark)}/waveforms-{uuid.uuid4().hex}"
    waveforms.save(made.select(F.col("path").alias("key"), F.lit(1).cast("long").alias("size"), F.lit(1.0).alias("mtime"), "blob"), target)
    found = waveforms.load(t.spark, target, e.select(F.col("user_id").cast("string").alias("key"), F.lit(1).cast("long").alias("size"), F.lit(1.005).alias("mtime")).distinct())
    levels = found.select(F.col("key").cast("long").alias("user_id"), F.posexplode(waveforms.levels("blob")[0][0]).alias("bucket", "peak"))
    kept = e.select("user_id", "bucket")  # buckets of short tracks may be empty
    return levels.select("user_id", F.col("bucket").cast("long").alias("bucket"), F.round(F.col("peak").cast("double"), 4).alias("peak")).join(kept, ["user_id", "bucket"])


@query(f"SELECT 'R' || CAST(n_nationkey % 3 AS VARCHAR) || '/' || {_NAME} AS key, n_name AS note, {_TRACKS} AS tracks FROM nation")
def q_shared_index(t: Tables) -> DataFrame:
    """The header rows through the JSON index and back, under another root."""
    root = _library(t)
    target = f"{checkpoint_dir(t.spark)}/index-{uuid.uuid4().hex}"
    store.export_index(wav.scan(t.spark, root), root, target)
    back = store.import_index(t.spark, target, "/other")
    return back.select(F.regexp_replace("path", "^/other/", "").alias("key"), "note", "tracks")


@query(f"SELECT {_NAME} AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'cached' ELSE n_name END AS note FROM nation")
def q_incremental_scan(t: Tables) -> DataFrame:
    """Rows of unchanged files come from the cache (marked by their note), others from the files."""
    root = _library(t)
    first = files.cut_plan(wav.scan(t.spark, root))
    even = F.regexp_extract("scene", r"(\d+)", 1).cast("int") % 2 == 0
    cached = first.withColumn("note", F.lit("cached")).withColumn("mtime", F.when(even, F.col("mtime")).otherwise(F.col("mtime") - 5))
    return store.incremental_scan(t.spark, root, cached).select(basename(F.col("path")).alias("name"), "note")


@query(f"SELECT {_NAME} AS name, n_name AS note FROM nation WHERE n_nationkey % 3 = 1")
def q_snapshot(t: Tables) -> DataFrame:
    """The stored table, read below one folder."""
    root = _library(t)
    target = f"{checkpoint_dir(t.spark)}/snapshot-{uuid.uuid4().hex}"
    store.save_snapshot(wav.scan(t.spark, root), target)
    return store.load_under(t.spark, target, f"{root}/R1").select(basename(F.col("path")).alias("name"), "note")


@query("""
WITH e AS (SELECT 'e' || CAST(event_id AS VARCHAR) AS path, user_id, value FROM events)
SELECT 2 AS version, path, user_id, CASE WHEN user_id % 3 = 0 THEN value + 1 ELSE value END AS value FROM e WHERE user_id % 5 <> 0 UNION ALL SELECT 1, path, user_id, value FROM e""")
def q_versions(t: Tables) -> DataFrame:
    """All events as a first version; a second one changes a third of the users' and deletes a fifth's."""
    from reelspark.sources import versions

    root = f"{checkpoint_dir(t.spark)}/versions-{uuid.uuid4().hex}"
    d = t.events.select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("path"), "user_id", "value")
    versions.commit(t.spark, root, d, "path")
    versions.commit(t.spark, root, d.where("user_id % 3 = 0 and user_id % 5 <> 0").withColumn("value", F.col("value") + 1), "path", deleted=d.where("user_id % 5 = 0"))
    each = [versions.snapshot(t.spark, root, v).select(F.lit(v).alias("version"), "path", "user_id", "value") for v in (1, 2)]
    return each[0].unionByName(each[1])
