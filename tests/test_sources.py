"""WAV files, the store, reports and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.sources import report, store, versions, wav
from reelspark.streaming import ingest

IXML = """<?xml version="1.0"?><BWFXML><PROJECT>Orchard</PROJECT><SCENE>10</SCENE><TAKE>03</TAKE><CIRCLED>true</CIRCLED><FILE_SET><FAMILY_UID>F1</FAMILY_UID></FILE_SET>
<SPEED><TIMECODE_RATE>24000/1001</TIMECODE_RATE></SPEED><TRACK_LIST><TRACK><INTERLEAVE_INDEX>2</INTERLEAVE_INDEX><NAME>LAV</NAME></TRACK><TRACK><INTERLEAVE_INDEX>1</INTERLEAVE_INDEX><NAME>BOOM</NAME></TRACK></TRACK_LIST></BWFXML>"""


@pytest.fixture
def library(tmp_path):
    rng = np.random.default_rng(1)
    x = rng.uniform(-0.5, 0.5, (4800, 2))
    (tmp_path / "day1").mkdir()
    (tmp_path / ".hidden").mkdir()
    wav.write_wav(str(tmp_path / "day1/10T03_ISO.wav"), x, 48000, 24, ixml=IXML + "\0stale", bext={"time_reference": 48000 * 3600, "date": "2025-10-27", "originator": "SoundDev: 833 WS123"}, cues=[(300, "later"), (100, "first")])
    wav.write_wav(str(tmp_path / "day1/5-T01.WAV"), x[:, :1], 44100, 16, bext={"description": "sSCENE=5\nsTRK1=Boom\n", "time_reference": 7})
    wav.write_wav(str(tmp_path / "float.wav"), x, 48000, 32, is_float=True)
    wav.write_wav(str(tmp_path / ".hidden/x.wav"), x, 48000)
    (tmp_path / "broken.wav").write_bytes(b"RIFF....nothing")
    (tmp_path / "._dot.wav").write_bytes(b"")
    return tmp_path, x


def test_headers(spark, library):
    root, _ = library
    rows = {r["path"].rsplit("/", 1)[1]: r for r in wav.scan(spark, str(root)).collect()}
    assert set(rows) == {"10T03_ISO.wav", "5-T01.WAV", "float.wav", "broken.wav"}
    a, b = rows["10T03_ISO.wav"], rows["5-T01.WAV"]
    assert (a["meta_project"], a["scene"], a["take"], a["circled"], a["family"], a["tracks"], a["frames"], a["time_reference"]) == ("Orchard", "10", "03", True, "F1", ["BOOM", "LAV"], 4800, 48000 * 3600)
    assert [tuple(c) for c in a["cues"]] == [(100, "first"), (300, "later")] and a["date"] == "2025-10-27" and not a["truncated"]
    assert (b["scene"], b["tracks"], b["sample_rate"], b["bits"], b["time_reference"]) == ("5", ["Boom"], 44100, 16, 7)
    assert rows["float.wav"]["float_samples"] and rows["float.wav"]["time_reference"] is None and rows["broken.wav"]["error"]


def test_conditions_reach_the_walk(spark, tmp_path, monkeypatch):
    """Rows are those of the whole walk where the conditions hold; other folders aren't listed, other files not opened."""
    for k in range(12):
        folder = tmp_path / f"R{k % 4}" / "deep"
        folder.mkdir(parents=True, exist_ok=True)
        wav.write_wav(str(folder / f"{k}.wav"), np.zeros((100 * (k + 1), 1)), 48000, 24)
    every = {r["path"]: r for r in wav.listing(spark, str(tmp_path)).collect()}
    sizes = sorted(r["size"] for r in every.values())
    conditions = [F.startswith("path", F.lit(f"{tmp_path}/R1")), F.startswith("path", F.lit(f"{tmp_path}/R1/deep/5")), F.col("path") == f"{tmp_path}/R2/deep/2.wav",
                  F.col("size") > sizes[6], (F.col("mtime") < 0) | (F.col("size") == sizes[3]), F.startswith("path", F.lit("/elsewhere")), (F.col("size") <= sizes[5]) & F.endswith("path", F.lit("4.wav")) & (F.col("mtime") >= 0.0)]
    for condition in conditions:
        want = spark.createDataFrame(list(every.values())).where(condition)
        assert {r["path"] for r in wav.listing(spark, str(tmp_path)).where(condition).collect()} == {r["path"] for r in want.collect()}
        headers = spark.read.format("wav_headers").load(str(tmp_path)).where(condition)
        assert {r["path"] for r in headers.collect()} == {r["path"] for r in want.collect()}

    opened, entered, header, listed = [], [], wav.read_header, wav._listed
    monkeypatch.setattr(wav, "read_header", lambda path, *a: opened.append(path) or header(path, *a))
    monkeypatch.setattr(wav, "_listed", lambda folder: entered.append(folder) or listed(folder))
    for spread in ("1", "256"):
        opened.clear(), entered.clear()
        reader = wav._Headers({"path": str(tmp_path), "folders": spread})
        left = wav.EqualTo(("error",), "")
        asked = [wav.StringStartsWith(("path",), f"{tmp_path}/R1/"), wav.GreaterThanOrEqual(("size",), every[f"{tmp_path}/R1/deep/5.wav"]["size"]), left]
        assert list(reader.pushFilters(asked)) == [left]
        rows = [row for part in reader.partitions() for row in reader.read(part)]
        assert len(rows) == 2 and sorted(opened) == [f"{tmp_path}/R1/deep/5.wav", f"{tmp_path}/R1/deep/9.wav"]
        assert set(entered) == {str(tmp_path), f"{tmp_path}/R1", f"{tmp_path}/R1/deep"}


def test_blocks_with_halo_equal_the_samples(spark, library):
    root, x = library
    wav.register(spark)
    d = spark.read.format("wav_blocks").option("blockFrames", 1000).option("halo", 10).load(str(root)).where(F.col("path").endswith("ISO.wav") & (F.col("channel") == 1)).orderBy("block").collect()
    got = np.concatenate([r["samples"][10:-10] for r in d])
    assert np.abs(got - x[:, 1]).max() < 1e-6 and d[0]["start"] == -10 and d[0]["samples"][:10] == [0.0] * 10


def test_truncated_and_garbage(tmp_path):
    x = np.zeros((100, 1))
    wav.write_wav(str(tmp_path / "a.wav"), x, 48000, 16)
    raw = (tmp_path / "a.wav").read_bytes()
    (tmp_path / "b.wav").write_bytes(raw[:-50])
    (tmp_path / "c.wav").write_bytes(raw + b"\x01garbage")
    assert wav.read_header(str(tmp_path / "b.wav"))["truncated"] and not wav.read_header(str(tmp_path / "c.wav"))["error"]


def test_incremental_scan_reads_only_changes(spark, library):
    root, x = library
    first = store.incremental_scan(spark, str(root), None)
    store.save_snapshot(first, str(root / "snap"))
    cached = spark.read.parquet(str(root / "snap")).drop("top").withColumn("note", F.lit("from the cache"))
    (root / "float.wav").unlink()
    wav.write_wav(str(root / "new.wav"), x, 48000)
    got = {r["path"].rsplit("/", 1)[1]: r["note"] for r in store.incremental_scan(spark, str(root), cached).collect()}
    assert got == {"10T03_ISO.wav": "from the cache", "5-T01.WAV": "from the cache", "broken.wav": "from the cache", "new.wav": ""}
    assert [r["path"] for r in store.load_under(spark, str(root / "snap"), str(root / "day1")).collect()] == sorted(str(root / "day1" / n) for n in ("10T03_ISO.wav", "5-T01.WAV"))


def test_rows_below_a_folder_that_cannot_be_listed_stay(spark, library, monkeypatch):
    root, _ = library
    cached = store.incremental_scan(spark, str(root), None).withColumn("note", F.lit("from the cache")).checkpoint()
    listed = wav.listing(spark, str(root))
    day = str(root / "day1")
    (root / "float.wav").unlink()
    failing = listed.where(~F.col("path").startswith(day) & ~F.col("path").endswith("float.wav")).unionByName(spark.createDataFrame([(day, 0, 0.0, "no permission")], listed.schema))
    monkeypatch.setattr(wav, "listing", lambda *_: failing)
    got = {r["path"]: r["note"] for r in store.incremental_scan(spark, str(root), cached).collect()}
    assert got == {r["path"]: "from the cache" for r in cached.collect() if not r["path"].endswith("float.wav")} and sum(p.startswith(day) for p in got) == 2
    monkeypatch.setattr(wav, "listing", lambda *_: spark.createDataFrame([(str(root), 0, 0.0, "gone")], listed.schema))
    assert store.incremental_scan(spark, str(root), cached).count() == cached.count()


def test_versions(spark, tmp_path):
    root, schema = str(tmp_path / "v"), "path string, size long"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    first = [(f"{a}/{k:03d}", k) for a in "abcdefgh" for k in range(100)]
    assert versions.commit(spark, root, frame(first).repartition(3), "path", files=8) == 1
    assert versions.commit(spark, root, frame([("a/001", -1), ("z", 7)]), "path", deleted=frame([("b/002", 0), ("z", 0), ("nowhere", 0)])) == 2
    rows = lambda v=None, prefix=None: {r["path"]: r["size"] for r in versions.snapshot(spark, root, v, prefix).collect()}
    assert rows(1) == dict(first)
    now = {**dict(first), "a/001": -1, "z": 7}
    del now["b/002"]
    assert rows() == rows(2) == now
    for p in ("a/", "b/00", "z", "h/099", "q", ""):
        assert rows(None, p) == {k: v for k, v in now.items() if k.startswith(p)}
    opened = lambda p: len(versions.snapshot(spark, root, 1, p).inputFiles())
    assert 0 < opened("c/") < opened("") and versions.versions(spark, root) == [1, 2]
    with pytest.raises(versions.Conflict):
        versions.commit(spark, root, frame([("x", 1)]), "path", after=1)
    for bad in ([("x", 1), ("x", 2)], [(None, 1)]):
        with pytest.raises(ValueError):
            versions.commit(spark, root, frame(bad), "path")
    assert rows() == now
    with pytest.raises(ValueError):
        versions.snapshot(spark, root, 9)


def test_index_round_trip(spark, library):
    root, _ = library
    rows = wav.scan(spark, str(root))
    store.export_index(rows, str(root), str(root / "index"))
    back = store.import_index(spark, str(root / "index"), str(root))
    assert sorted(map(repr, back.collect())) == sorted(map(repr, rows.collect()))


def test_markers_follow_renames(spark):
    m = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", 3, "z")], "path string, frame long, name string")
    moved = store.moved_markers(m, spark.createDataFrame([("a", "b")], "old string, new string"))
    assert sorted(map(tuple, moved.collect())) == [("b", 1, "x"), ("c", 3, "z")]


def test_history(spark, tmp_path):
    for k in range(2):
        store.log_action(spark, str(tmp_path / "log"), "renamed", n=k)
    assert sorted(r["details"] for r in spark.read.json(str(tmp_path / "log")).collect()) == ['{"n": 0}', '{"n": 1}']


def test_reports(spark):
    d = spark.createDataFrame([("1T01.wav", True, None), ('a "b", <c>', False, "x")], "name string, circled boolean, note string")
    text = report.report_csv("Orchard", [("Days", "1")], d)
    assert text.startswith("﻿Orchard") and "1T01.wav,yes," in text and '"a ""b"", <c>"' in text
    assert "&lt;c&gt;" in report.report_html("T", [], d, bold="circled") and "<tr class=circled>" in report.report_html("T", [], d, bold="circled")
    items = report.timeline_items(spark.createDataFrame([("v", 0, 50), ("a", 25, 100), ("b", 130, 10)], "name string, start long, duration long"), 25, 1)
    assert [(i["name"], i["at"], i["length"], i["lane"]) for i in items] == [("v", 0, 50, 0), ("a", 25, 100, 1), ("b", 130, 10, 0)]
    assert 'lane="-2"' in report.fcpxml("T", items, 25, 1)


def test_stream_upserts_the_latest_and_repeats_safely(spark, tmp_path):
    schema = "path string, size long, gen long"
    for k, rows in enumerate([[("a", 1, 1), ("b", 1, 1)], [("a", 2, 2)], [("b", 9, 0), ("c", 3, 1)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = ingest.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, files_per_batch=1)
    ingest.upsert_stream(s, str(tmp_path / "out"), ["path"], ["gen"], str(tmp_path / "cp")).awaitTermination()
    got = sorted(map(tuple, ingest.current(spark, str(tmp_path / "out"), ["path"], ["gen"]).collect()))
    assert got == [("a", 2, 2), ("b", 1, 1), ("c", 3, 1)]


def test_stream_windows_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(4).write.parquet(str(tmp_path / "e"))
    s = ingest.windowed(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")), "ts", ["event_type"], "1 hour", "40 days")
    q = s.writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda r: (r["start"], r["event_type"], r["n"], round(r["total"], 6))
    assert sorted(map(key, spark.table("w").collect())) == sorted(map(key, ingest.windowed(events, "ts", ["event_type"], "1 hour").collect()))


def test_recorded_lane(spark):
    d = spark.createDataFrame([(1, k, v, a) for k, (v, a) in enumerate([(0.0, False), (1.0, True), (1.0, True), (2.0, True), (2.0, False), (2.0, True)])], "c long, at long, v double, armed boolean")
    got = sorted((r["first"], r["last"], r["v"]) for r in ingest.recorded_lane(d, ["c"], "at", "v", "armed").collect())
    assert got == [(1, 2, 1.0), (3, 3, 2.0), (5, 5, 2.0)]
