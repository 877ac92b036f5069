"""Effect chains, mixer settings and files made from files."""

import hashlib
import io
import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.functions import effects
from reelspark.operators import mixer
from reelspark.plans import files, moves
from reelspark.sources import cards, rewrite, wav, waveforms


def samples(path):
    h = wav.read_header(path)
    return wav.read_frames(path, next(c for c in h["chunks"] if c[0] == "data")[1], h["frames"], h["channels"], h["bits"], h["float_samples"], 0, h["frames"])


def test_chain_json(spark):
    text = json.dumps([{"type": "gain", "params": {"gain": 99}}, {"type": "odd"}, {"type": "compressor", "bypass": True, "params": {"ratio": 2}}])
    d = spark.createDataFrame([(text,), ("not json",), (effects.preset_json("deliver ebu"),)], "t string").withColumn("c", effects.parse_chain(F.col("t")))
    a, b, c = d.select("c", effects.chain_problem(F.col("c")).alias("p"), effects.describe(F.col("c")).alias("d")).collect()
    assert [e["type"] for e in a["c"]] == ["gain", "compressor"] and a["c"][0]["params"]["gain"] == 36 and a["c"][1]["params"]["ratio"] == 2 and a["c"][1]["params"]["threshold"] == -20
    assert a["d"] == "gain → compressor (off)" and a["p"] == "" and b["p"] == "no effect is active" and c["p"] == "" and c["c"][0]["params"]["target"] == -23


def test_chain_kernels():
    rate, t = 48000, np.arange(48000 * 2) / 48000
    tone = lambda f, a=0.5: a * np.sin(2 * np.pi * f * t)
    db = lambda x: 10 * np.log10((x[24000:-4800] ** 2).mean() * 2)
    run = lambda x, kind, **p: effects.run_chain(x, [{"type": kind, "bypass": False, "params": p}], rate)
    assert db(run(tone(1000), "gain", gain=-6.0)) == pytest.approx(db(tone(1000)) - 6)
    assert db(run(tone(50), "highpass", freq=100.0, slope=24.0)) == pytest.approx(db(tone(50)) - 24.1, abs=0.5)
    out = run(tone(1000), "compressor", threshold=-30.0, ratio=4.0, knee=0.0)
    assert db(out) - db(tone(1000)) == pytest.approx(-15.75, abs=0.1)  # by the power of 10 ms
    out = run(tone(1000), "compressor", threshold=-30.0, ratio=4.0, knee=0.0, detection=0.0)
    assert db(out) - db(tone(1000)) == pytest.approx((-6.02 + 30) * (1 / 4 - 1), abs=0.3)
    assert np.abs(run(tone(1000), "limiter", ceiling=-12.0)).max() <= 10 ** (-12 / 20) + 1e-9
    assert db(run(tone(8000), "deesser", freq=5000.0, threshold=-30.0)) < db(tone(8000)) - 6 and db(run(tone(300), "deesser", freq=5000.0)) == pytest.approx(db(tone(300)), abs=0.2)
    assert db(run(tone(997, 0.01), "expander", threshold=-20.0, ratio=2.0, knee=0.0, range=60.0, detection=0.0)) == pytest.approx(db(tone(997, 0.01)) - 20, abs=0.5)
    assert np.array_equal(effects.run_chain(tone(100), [{"type": "gain", "bypass": True, "params": {}}], rate), tone(100))
    assert db(run(tone(997, 0.1), "loudness", target=-23.0)) == pytest.approx(-23.0 + 3.01, abs=0.2)


def test_mixer(spark):
    text = json.dumps({"master": -6.0, "channels": [{"channel": 1, "gain_db": 0.0, "pan": -1.0, "link": True}, {"channel": 2, "gain_db": -3.0}, {"channel": 3, "gain_db": None, "solo": False}, {"channel": 4, "gain_db": 0.0, "mute": True}], "points": [{"channel": 1, "param": "gain", "frame": 5, "value": None}]})
    d = spark.createDataFrame([("t", text)], "take string, m string")
    rows = mixer.parse_mixer(d, "take", "m")
    m = {r["channel"]: r for r in mixer.matrix(mixer.linked(rows, "take"), "take").collect()}
    g = 10 ** (-6 / 20) / np.sqrt(3)
    assert m[1]["left"] == pytest.approx(g * np.sqrt(2)) and m[2]["right"] == pytest.approx(g * np.sqrt(2)) and m[1]["right"] == pytest.approx(0, abs=1e-9)
    assert m[3]["left"] == 0 and m[4]["left"] == 0
    assert mixer.automation(d, "take", "m").first()["value"] == float("-inf")
    back = mixer.parse_mixer(mixer.to_json(rows, "take"), "take", "mixer")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_split_combine_and_process(spark, tmp_path):
    x = np.random.default_rng(2).uniform(-0.5, 0.5, (2000, 3))
    src = str(tmp_path / "a.wav")
    wav.write_wav(src, x, 48000, 24, bext={"time_reference": 99})
    plan = spark.createDataFrame([(src, k, str(tmp_path / f"s/a_{k}.wav")) for k in (1, 2, 3)], "path string, index long, out string")
    assert {r["status"] for r in files.split_files(plan).collect()} == {"done"} and {r["status"] for r in files.split_files(plan).collect()} == {"exists"}
    again = spark.createDataFrame([([str(tmp_path / f"s/a_{k}.wav") for k in (1, 2, 3)], str(tmp_path / "b.wav"))], "paths array<string>, out string")
    assert files.combine_files(again).first()["status"] == "done"
    assert np.array_equal(samples(str(tmp_path / "b.wav")), samples(src)) and wav.read_header(str(tmp_path / "b.wav"))["time_reference"] == 99
    louder = spark.createDataFrame([(src, [1], str(tmp_path / "c.wav")), (str(tmp_path / "none.wav"), [0], str(tmp_path / "d.wav"))], "path string, touched array<int>, out string")
    got = {r["out"][-5:]: r["status"] for r in files.process_files(louder, [{"type": "gain", "bypass": False, "params": {"gain": -6.0}}]).collect()}
    assert got["c.wav"] == "done" and got["d.wav"].startswith("failed")
    y = samples(str(tmp_path / "c.wav"))
    assert np.array_equal(y[:, 0], samples(src)[:, 0]) and np.allclose(y[:, 1], x[:, 1] * 10 ** (-6 / 20), atol=1e-6)


def test_metadata_and_cards(spark):
    chunk = "array<struct<id:string,offset:bigint,size:bigint,truncated:boolean>>"
    d = spark.createDataFrame([("a", 1000, [("fmt ", 0, 16, False), ("iXML", 30, 100, False), ("JUNK", 140, 50, False)], "x" * 150), ("b", 1000, [("iXML", 30, 100, False)], "x" * 150), ("c", 1000, [], None)], f"path string, size long, chunks {chunk}, ixml string")
    assert {r["path"]: (r["mode"], r["bytes"]) for r in files.metadata_plan(d, F.col("ixml")).collect()} == {"a": ("in place", 150), "b": ("rewrite", 1000 + 150 + 4096), "c": ("unchanged", 0)}
    listing = spark.createDataFrame([("m1", "SOUNDDEV/x.txt"), ("m2", "a/b/c.WAV"), ("m3", "a/b/c/d.wav")], "mount string, path string")
    assert {r[0] for r in files.card_roots(listing, "path", "mount").collect()} == {"m1", "m2"}
    gone = spark.createDataFrame([("_Removed/P/day/x.wav",), ("P/y.wav",)], "path string")
    assert tuple(files.removed_items(gone, "path").first()) == ("_Removed/P/day/x.wav", "P", "day/x.wav")


def test_clips_sync_edits_and_undo(spark):
    probe = json.dumps({"streams": [{"codec_type": "video", "r_frame_rate": "25/1", "tags": {"timecode": "01:00:00:00"}}, {"codec_type": "audio"}], "format": {"duration": "10.5"}})
    c = {r["path"]: r for r in files.clips(spark.createDataFrame([("a.MOV", probe), ("b.mp4", "{}"), ("c.txt", probe)], "path string, json string"), "path", "json").collect()}
    assert set(c) == {"a.MOV", "b.mp4"} and (c["a.MOV"]["start_frame"], c["a.MOV"]["duration"], c["a.MOV"]["audio_streams"], c["a.MOV"]["error"]) == (90000, 10.5, 1, "") and c["b.mp4"]["error"] == "no video"
    m = spark.createDataFrame([("c", "t", 100, 50, 75, 100, 25, 48000), ("c", "u", 100, 50, 150, 100, 25, 48000)], "clip string, take string, c_start long, c_len long, t_start long, t_len long, num long, sample_rate long")
    assert {r["take"]: (r["cut_samples"], r["delay_samples"], r["samples"]) for r in files.sync_plan(m).collect()} == {"t": (48000, 0, 96000), "u": (0, 96000, 96000)}
    d = spark.createDataFrame([("a", "F1", "/x"), ("b", "F1", "/x"), ("c", "F1", "/y")], "path string, family string, folder string")
    e = spark.createDataFrame([("a", "scene", "9")], "path string, column string, value string")
    assert {tuple(r) for r in files.edit_plan(d, e, ["family", "folder"]).collect()} == {("a", "scene", "9"), ("b", "scene", "9")}
    v = spark.createDataFrame([("a", True), ("a", False), ("b", True)], "path string, ok boolean")
    assert {r["path"] for r in files.to_fix(d, v).collect()} == {"a", "c"}


IXML = "<?xml version='1.0'?><BWFXML><PROJECT>Proj</PROJECT><SCENE>10</SCENE><NOTE>old</NOTE><OWN>kept</OWN><TRACK_LIST><TRACK><INTERLEAVE_INDEX>2</INTERLEAVE_INDEX><NAME>LAV</NAME></TRACK><TRACK><INTERLEAVE_INDEX>1</INTERLEAVE_INDEX><NAME>BOOM</NAME></TRACK></TRACK_LIST></BWFXML>"


def data_bytes(path):
    h = wav.read_header(path)
    _, at, size, _ = next(c for c in h["chunks"] if c[0] == "data")
    return open(path, "rb").read()[at : at + size], h


@pytest.mark.parametrize("bits,is_float", [(16, False), (24, False), (32, False), (32, True)])
def test_untouched_channels_keep_their_bytes(tmp_path, bits, is_float):
    src, rng = str(tmp_path / "a.wav"), np.random.default_rng(bits)
    wav.write_wav(src, rng.uniform(-1, 1, (3001, 3)), 48000, bits, is_float, ixml=IXML, bext={"time_reference": 7, "description": "sSCENE=10"}, cues=[(5, "ümlaut")])
    if bits == 32 and not is_float:  # all 32 bits of a sample
        raw, h = data_bytes(src)
        whole = open(src, "rb").read()
        open(src, "wb").write(whole.replace(raw, rng.integers(0, 256, len(raw), np.uint8).tobytes()))
    raw, h = data_bytes(src)
    assert rewrite.processed_copy(src, str(tmp_path / "b.wav"), {1: lambda x: x * 0.5}) == "done"
    new, g = data_bytes(str(tmp_path / "b.wav"))
    a, b = (np.frombuffer(x, np.uint8).reshape(-1, 3, bits // 8) for x in (raw, new))
    assert (a[:, [0, 2]] == b[:, [0, 2]]).all() and (a[:, 1] != b[:, 1]).any()
    assert (g["scene"], g["time_reference"], g["cues"], g["tracks"], g["frames"]) == (h["scene"], 7, [(5, "ümlaut")], ["BOOM", "LAV"], 3001)
    outs = [(k, str(tmp_path / f"t{k}.wav")) for k in (1, 2, 3)]
    assert rewrite.split_file(src, outs) == ["done"] * 3 and rewrite.combine_files([o for _, o in outs], str(tmp_path / "c.wav")) == "done"
    assert data_bytes(str(tmp_path / "c.wav"))[0] == raw and wav.read_header(outs[0][1])["tracks"] == ["BOOM"]
    assert not [x for x in os.listdir(tmp_path) if "part" in x]


def test_headers_of_long_files():
    short, long_ = rewrite.header([(b"fmt ", rewrite.fmt(2, 48000, 24, False))], 1000), rewrite.header([(b"fmt ", rewrite.fmt(2, 48000, 24, False))], 5 << 30)
    assert short[:4] == b"RIFF" and long_[:4] == b"RF64"
    f = io.BytesIO(long_)
    found = wav.chunks_of(f, len(long_) + (5 << 30))
    assert next(c for c in found if c[0] == "data")[2:] == (5 << 30, False)


@pytest.mark.parametrize("filler,room,want", [(0, False, "needs a rewrite"), (0, True, "rewrite"), (3000, False, "in place")])
def test_metadata_is_written_back(tmp_path, filler, room, want):
    path, x = str(tmp_path / "a.wav"), np.random.default_rng(1).uniform(-1, 1, (100, 2))
    wav.write_wav(path, x, 48000, 24, ixml=IXML, bext={"time_reference": 5, "description": "zNOTE=old\r\nsSCENE=10"})
    if filler:
        h = wav.read_header(path)
        _, at, size, _ = next(c for c in h["chunks"] if c[0] == "iXML")
        raw, end = open(path, "rb").read(), at + size + size % 2
        raw = raw[:end] + b"JUNK" + struct.pack("<I", filler) + bytes(filler) + raw[end:]
        open(path, "wb").write(raw[:4] + struct.pack("<I", len(raw) - 8) + raw[8:])
    before, _ = data_bytes(path)
    assert rewrite.update_metadata(path, {"scene": "10"}) == "unchanged"
    first = rewrite.update_metadata(path, {"note": "ny"}, allow_rewrite=room)  # a shorter document may fit as it is
    got = rewrite.update_metadata(path, {"note": "née " * 60, "circled": True}, "new.wav", allow_rewrite=room)
    assert want in (first, got) and {first, got} <= {"in place", want}
    if want != "needs a rewrite":
        after, h = data_bytes(path)
        assert after == before and h["note"] == ("née " * 60).strip() or h["note"] == "née " * 60
        assert h["circled"] and h["time_reference"] == 5 and b"<OWN>kept</OWN>" in open(path, "rb").read() and h["original_filename"] == "new.wav"
        assert rewrite.update_metadata(path, {"scene": "11"}, allow_rewrite=room) == "in place"  # there is room now


def test_descriptions_stay_within_their_field():
    old = b"sSCENE=1\r\nzNOTE=abc\r\nother"
    assert rewrite.build_description(old, {"note": "x\ny", "tape": "T"}).rstrip(b"\0") == b"sSCENE=1\r\nzNOTE=x y\r\nother"
    full = rewrite.build_description(old, {"note": "n" * 400})
    assert len(full) == 256 and full.startswith(b"sSCENE=1\r\nzNOTE=nnn") and full.endswith(b"\r\nother")
    with pytest.raises(ValueError):
        rewrite.build_description(b"sSCENE=1", {"scene": "s" * 300})


def test_documents_keep_what_they_dont_know():
    root = wav.ixml_root(rewrite.build_ixml(IXML.encode(), {"take": "3"}, "b.wav", ["A", "B&C"]))
    assert root.findtext("OWN") == "kept" and root.findtext("TAKE") == "3" and root.findtext("HISTORY/ORIGINAL_FILENAME") == "b.wav" and [t.findtext("NAME") for t in root.iterfind("TRACK_LIST/TRACK")] == ["A", "B&C"]
    again = wav.ixml_root(rewrite.build_ixml(rewrite.build_ixml(IXML.encode(), {}, "b.wav"), {}, "c.wav"))
    assert again.findtext("HISTORY/ORIGINAL_FILENAME") == "b.wav" and again.findtext("HISTORY/CURRENT_FILENAME") == "c.wav"
    with pytest.raises(wav.NotWav):
        rewrite.build_ixml(b"not xml", {"scene": "5"})
    assert wav.ixml_root(rewrite.build_ixml(b"\0\0", {"scene": "5"})).findtext("SCENE") == "5"


def test_verified_copies(spark, tmp_path):
    p = lambda x: str(tmp_path / x)
    for n, text in (("a", "one"), ("b", "two"), ("there/b", "two"), ("c", "new"), ("there/c", "old")):
        os.makedirs(os.path.dirname(p(n)), exist_ok=True)
        open(p(n), "w").write(text)
    os.utime(p("a"), (1000, 1000))
    plan = spark.createDataFrame([(p(n), p(f"there/{n}")) for n in ("a", "b", "c", "none")], "path string, dst string")
    got = {r["path"][-1]: (r["status"], r["md5"]) for r in moves.copy_verified(plan).collect()}
    assert got["a"] == ("verified", hashlib.md5(b"one").hexdigest()) and got["b"][0] == "there" and got["c"][0] == "exists" and got["e"][0].startswith("failed")
    assert open(p("there/c")).read() == "old" and os.stat(p("there/a")).st_mtime == 1000 and sorted(os.listdir(p("there"))) == ["a", "b", "c"]


def test_renames_are_all_or_nothing(tmp_path):
    p = lambda x: str(tmp_path / x)
    for n in "abc":
        open(p(n), "w").write(n)
    swap = [(p("a"), p("b")), (p("b"), p("a")), (p("c"), p("new/deep/c"))]
    made = moves.apply_renames(swap)
    assert [open(p(n)).read() for n in ("a", "b", "new/deep/c")] == ["b", "a", "c"] and made == [p("new"), p("new/deep")]
    moves.undo_renames(swap, made)
    assert [open(p(n)).read() for n in "abc"] == ["a", "b", "c"] and not os.path.exists(p("new"))
    for bad in ([(p("a"), p("x")), (p("gone"), p("y"))], [(p("a"), p("c"))], [(p("a"), p("x")), (p("b"), p("x"))], [(p("a"), p("made/x")), (p("gone"), p("made/y"))]):
        with pytest.raises(OSError):
            moves.apply_renames(bad)
        assert sorted(os.listdir(tmp_path)) == ["a", "b", "c"]


def test_rechecks_previews_and_touched_paths(spark):
    plan = spark.createDataFrame([("remove", "a", "k", "", 10, 1.0), ("remove", "b", "gone", "", 10, 1.0), ("move", "c", "d", "", 11, 1.0), ("move", "k", "m", "", 5, 2.0)], "kind string, path string, dst string, reason string, size long, mtime double")
    now = spark.createDataFrame([("a", 10, 1.5), ("b", 10, 1.0), ("c", 10, 1.0), ("k", 5, 2.0)], "path string, size long, mtime double")
    assert {r["path"]: r["kind"] for r in moves.rechecked(plan, now).collect()} == {"a": "remove", "b": "skip", "c": "skip", "k": "move"}
    retag = spark.createDataFrame([("z",), ("a",)], "path string")
    assert {r["path"] for r in moves.touched_paths(plan, retag).collect()} == {"a", "b", "c", "d", "k", "m", "gone", "z"}
    assert [r["path"] for r in moves.preview(plan, "path", most=2).collect()] == ["a", "b"]


CHAIN = [{"type": t, "bypass": False, "params": p} for t, p in (("highpass", {"freq": 100.0}), ("gate", {"threshold": -30.0, "hold": 20.0}), ("deesser", {"threshold": -40.0}), ("compressor", {"threshold": -30.0}), ("limiter", {"ceiling": -6.0, "lookahead": 2.0}))]


def test_chains_are_the_same_at_any_block_size():
    x = np.random.default_rng(3).normal(0, 0.2, 20_011) * np.repeat([1, 0.01, 1, 0.1], 5003)[:20_011]
    want = effects.run_chain(x, CHAIN, 48000, 1 << 20)
    assert len(want) == len(x) and np.abs(want).max() > 0.01
    for block in (1, 7, 32, 1000, 4096):
        part = x[:3000] if block < 32 else x
        assert np.allclose(effects.run_chain(part, CHAIN, 48000, block), effects.run_chain(part, CHAIN, 48000, 1 << 20), atol=1e-9)


def test_effects_of_their_own():
    rate, t = 48000, np.arange(48000) / 48000
    one = lambda kind, x, **p: effects.run_chain(x, [{"type": kind, "bypass": False, "params": p}], rate)
    sine = 0.7 * np.sin(2 * np.pi * 12000 * t + np.pi / 4)  # its peaks lie between the samples
    peak = lambda y: effects.Peaks(rate)(y)[4800:-4800].max()
    assert peak(one("limiter", sine, ceiling=-6.0)) <= 10 ** (-6 / 20) * 1.005 < peak(one("limiter", sine, ceiling=-6.0, true_peak=0.0))
    assert np.allclose(one("gain", sine, invert=1.0, delay=1.0)[48:], -sine[:-48], atol=1e-12)
    quiet = np.concatenate([np.full(24000, 0.5), np.full(24000, 1e-4)])
    assert np.abs(one("gate", quiet, threshold=-40.0, range=60.0, release=20.0)[-2000:]).max() < 1e-6
    hiss = 0.5 * np.sin(2 * np.pi * 8000 * t) + 0.1 * np.sin(2 * np.pi * 300 * t)
    low = lambda y: abs(np.fft.rfft(y[12000:36000])[150])
    assert low(one("deesser", hiss, mode=1.0)) < 0.6 * low(hiss) and low(one("deesser", hiss)) == pytest.approx(low(hiss), rel=0.02)
    assert np.abs(one("bandpass", hiss, freq=300.0, q=5.0)).max() < 0.2 and np.abs(one("notch", 0.5 * np.sin(2 * np.pi * 50 * t), freq=50.0, q=1.0)[24000:]).max() < 0.02
    level = effects.Level(rate, True)(0.5 * np.sin(2 * np.pi * 1000 * t[:9600]))
    assert level[100:] == pytest.approx(np.full(len(level) - 100, 20 * np.log10(0.5) - 3.01), abs=0.1)


def test_presets(spark, tmp_path):
    effects.save_preset(str(tmp_path), "My: own", CHAIN)
    open(tmp_path / "bad.json", "w").write("{")
    names = {r["name"]: r for r in effects.list_presets(spark, str(tmp_path)).collect()}
    assert not names["My- own"]["built_in"] and json.loads(names["My- own"]["chain"]) == CHAIN and "bad" not in names and len(names) == len(effects.PRESETS) + 1


def test_waveforms(spark, tmp_path):
    levels = np.random.default_rng(5).uniform(0, 1, (2, 3, 50)).astype(np.float32)
    blob = waveforms.pack(levels)
    assert np.allclose(waveforms.unpack(blob), levels, atol=1 / 65535) and waveforms.is_complete(blob) and not waveforms.is_complete(waveforms.pack(levels, False))
    old = waveforms.OLD_MAGIC + bytes([3]) + (levels * 255).astype(np.uint8).tobytes()
    assert np.allclose(waveforms.unpack(old), levels, atol=1 / 200) and not waveforms.is_complete(old)
    assert all(waveforms.unpack(x) is None for x in (None, b"", b"LVL3", b"nope" + bytes(20), blob[:-1]))
    rows = [("a", c, b, float(levels[0, c, b]), float(levels[1, c, b])) for c in range(3) for b in range(50)]
    made = waveforms.blobs(spark.createDataFrame(rows, "path string, channel int, bucket int, peak double, rms double"), 50)
    assert made.first()["blob"] == blob and np.allclose(made.select(waveforms.levels("blob").alias("l")).first()["l"], levels, atol=1 / 65535)
    store = spark.createDataFrame([("a", 10, 1.0, waveforms.pack(levels, False)), ("a", 10, 1.0, blob), ("b", 5, 2.0, blob)], "key string, size long, mtime double, blob binary")
    waveforms.save(store, str(tmp_path / "w"))
    got = waveforms.load(spark, str(tmp_path / "w"), spark.createDataFrame([("a", 10, 1.001), ("b", 6, 2.0), ("c", 1, 1.0)], "key string, size long, mtime double")).collect()
    assert [(r["key"], bytes(r["blob"])) for r in got] == [("a", blob)]
    assert spark.range(1).select(waveforms.stored_bytes(F.lit(6), F.lit(4096)).alias("n")).first()["n"] == -(-(25 + 4 * 6 * 4096) // 4096) * 4096


def test_cards(spark, tmp_path):
    for n in ("P/day/a.wav", "P/.x/b.wav", "P/._a.wav", "FALSETAKES/f.wav", "top.wav", "P/day/notes.txt"):
        os.makedirs((tmp_path / n).parent, exist_ok=True)
        (tmp_path / n).write_text(n)
    listing = spark.createDataFrame([(n,) for n in ("P/day/a.wav", "P/.x/b.wav", "P/._a.wav", "FALSETAKES/f.wav", "top.wav", ".hid", "Q/z.wav", "P/day/notes.txt")], "path string")
    assert [r[0] for r in cards.chosen_files(listing, ["", "P", "FALSETAKES"]).collect()] == ["P/day/a.wav", "P/day/notes.txt", "top.wav"]
    assert [r[0] for r in cards.chosen_files(listing, ["FALSETAKES"], True).collect()] == ["FALSETAKES/f.wav"]
    m = cards.manifest(spark, str(tmp_path))
    assert [r["relative"] for r in m.orderBy("relative").collect()] == ["FALSETAKES/f.wav", "P/day/a.wav", "P/day/notes.txt", "top.wav"]
    copy = m.where("relative <> 'top.wav'").withColumn("size", F.when(F.col("relative").endswith("a.wav"), 1).otherwise(F.col("size")))
    assert {tuple(r) for r in cards.manifest_differences(m, copy).collect()} == {("top.wav", "missing"), ("P/day/a.wav", "differs")}
    assert cards.working_copy_plan(m, "/c", "/w", 1000).where("dst = '/w/top.wav'").first()["path"] == "/c/top.wav"
    with pytest.raises(ValueError):
        cards.working_copy_plan(m, "/c", "/w", 3)
    os.symlink(tmp_path / "top.wav", tmp_path / "link")
    with pytest.raises(OSError):
        cards.manifest(spark, str(tmp_path))


def test_offload(spark, tmp_path):
    src = str(tmp_path / "card/a.wav")
    os.makedirs(os.path.dirname(src))
    wav.write_wav(src, np.zeros((10, 1)), 48000, 16, ixml=IXML)
    copies = spark.createDataFrame([(src, str(tmp_path / "lib/a.wav")), (str(tmp_path / "no"), str(tmp_path / "lib/no"))], "path string, dst string")
    edits = spark.createDataFrame([(src, {"scene": "77"})], "path string, changes map<string,string>")
    got = {r["path"]: (r["status"], r["metadata"]) for r in files.offload(copies, edits).collect()}
    assert got[src][0] == "verified" and got[src][1] in ("in place", "rewrite") and got[str(tmp_path / "no")][0].startswith("failed")
    assert wav.read_header(str(tmp_path / "lib/a.wav"))["scene"] == "77" and wav.read_header(src)["scene"] == "10"


def test_broken_files_are_rows(spark, tmp_path):
    """Old tails, odd encodings and numbers that are none; one bad file never ends a scan."""
    for name, ixml in (("stale", IXML + "\0" + "x" * 40 + "</BWFXML>"), ("odd", "<?xml version='1.0' encoding='klingon'?><BWFXML/>"), ("high", "<BWFXML><SPEED><TIMESTAMP_SAMPLES_SINCE_MIDNIGHT_HI>x</TIMESTAMP_SAMPLES_SINCE_MIDNIGHT_HI><TIMESTAMP_SAMPLES_SINCE_MIDNIGHT_LO>5</TIMESTAMP_SAMPLES_SINCE_MIDNIGHT_LO></SPEED></BWFXML>"), ("tail", IXML + "garbage")):
        wav.write_wav(str(tmp_path / f"{name}.wav"), np.zeros((10, 2)), 48000, 16, ixml=ixml)
    (tmp_path / "none.wav").write_bytes(b"RIFF")
    os.symlink(tmp_path / "nowhere", tmp_path / "gone.wav")
    rows = {os.path.basename(r["path"]): r for r in wav.scan(spark, str(tmp_path)).collect()}
    assert rows["stale.wav"]["scene"] == rows["tail.wav"]["scene"] == "10" and rows["stale.wav"]["tracks"] == ["BOOM", "LAV"]
    assert rows["odd.wav"]["error"] == "" and rows["high.wav"]["time_reference"] is None and rows["none.wav"]["error"] and "gone.wav" not in rows


def test_folders_are_walked_where_the_work_is(spark, tmp_path):
    for k in range(12):
        os.makedirs(tmp_path / f"d{k}" / "deep")
        wav.write_wav(str(tmp_path / f"d{k}/deep/{k}.wav"), np.full((250, 2), k / 20), 8000, 16)
    reader = wav._Blocks({"path": str(tmp_path), "folders": "4", "blockFrames": "100"})
    assert [len(p.folders) for p in reader.partitions()] == [1] * 12 and not any(p.files for p in reader.partitions())
    by_source = spark.read.format("wav_blocks").option("folders", 4).option("blockFrames", 100).option("halo", 5).load(str(tmp_path)) if wav.register(spark) is None else None
    for stretch in (1 << 26, 400, 150):
        spread = wav.blocks(spark, str(tmp_path), 100, 5, stretch)
        assert sorted(map(repr, spread.collect())) == sorted(map(repr, by_source.collect())) and spread.count() == 12 * 2 * 3


def _with_chunks(path, *parts, tail=b""):
    """A WAV file of these chunks in order."""
    body = b"".join(rewrite._padded(n, b) for n, b in parts)
    path.write_bytes(b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body + tail)
    return str(path)


def test_a_document_that_cannot_be_read_is_not_changed(tmp_path):
    broken = b"<BWFXML><PROJECT>Dear</PROJECT><NOTE>kept & lost"
    path = _with_chunks(tmp_path / "x.wav", (b"fmt ", rewrite.fmt(1, 48000, 16, False)), (b"iXML", broken), (b"JUNK", bytes(4000)), (b"data", bytes(20)))
    before = open(path, "rb").read()
    for room in (False, True):
        with pytest.raises(wav.NotWav):
            rewrite.update_metadata(path, {"scene": "7"}, allow_rewrite=room)
    assert open(path, "rb").read() == before


@pytest.mark.parametrize("document", [IXML.encode(), None])
def test_a_rewrite_keeps_every_other_byte_in_its_place(tmp_path, document):
    ixml = [(b"iXML", document)] if document else []
    parts = [(b"JUNK", b"filler that means something"), (b"fmt ", rewrite.fmt(1, 48000, 16, False)), *ixml, (b"vend", b"odd"), (b"data", bytes(range(20))), (b"LIST", b"INFOISFT\x02\0\0\0me")]
    path = _with_chunks(tmp_path / "x.wav", *parts, tail=b"\x01\x02vendor's own tail, of an odd length")
    before = open(path, "rb").read()
    assert rewrite.update_metadata(path, {"note": "n" * 900}, allow_rewrite=True) == "rewrite"
    after, h = open(path, "rb").read(), wav.read_header(path)
    assert h["note"] == "n" * 900 and struct.unpack("<I", after[4:8])[0] - struct.unpack("<I", before[4:8])[0] == len(after) - len(before)
    names = [c[0] for c in h["chunks"]]
    kept = [n for k, n in enumerate(names) if n != "iXML" and not (n == "JUNK" and names[k - 1] == "iXML")]
    assert kept == [n.decode() for n, _ in parts if n != b"iXML"]
    new = [c for c in h["chunks"] if c[0] == "iXML"][0]
    end = new[1] + new[2] + new[2] % 2 + 8 + rewrite.HEADROOM
    old = before.index(b"iXML") if document else before.index(b"data")
    gone = old + 8 + len(document) + len(document) % 2 if document else old
    assert after[8 : new[1] - 8] == before[8:old] and after[end:] == before[gone:]
