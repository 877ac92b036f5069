"""Functions on literals: exact values of timecode, names and levels."""

import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reelspark.functions import audio, names, paths, timecode


def one(spark, column, **values):
    kinds = {str: "string", int: "long", float: "double", bool: "boolean", list: "array<string>"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()) or "x long"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("frames,fps,drop,text", [(0, 24, False, "00:00:00:00"), (1799, 30, True, "00:00:59;29"), (1800, 30, True, "00:01:00;02"), (17982, 30, True, "00:10:00;00"), (86400 * 25, 25, False, "00:00:00:00"), (3600 * 60, 60, True, "01:00:03;36"), (100, 24, True, "00:00:04:04")])
def test_timecode(spark, frames, fps, drop, text):
    assert one(spark, timecode.frames_to_tc(F.col("f"), fps, drop), f=frames) == text
    if frames < 86400 * fps:
        assert one(spark, timecode.tc_to_frames(F.col("t"), fps, drop), t=text) == frames


def test_samples_to_timecode(spark):
    r = timecode.rate(24000, 1001)
    assert one(spark, timecode.samples_to_tc(F.col("s"), 48000, r), s=3090111025) == "17:51:53:00"
    assert one(spark, timecode.samples_to_tc(F.col("s"), 48000, F.lit(None).cast("struct<num:bigint,den:bigint>")), s=48000 * 3661) == "01:01:01"
    assert one(spark, timecode.samples_to_tc(F.lit(None).cast("long"), 48000, r)) == ""


def test_drop_numbers_are_all_different(spark):
    d = spark.range(0, 20000).select(timecode.frames_to_tc(F.col("id"), 30, True).alias("t"), "id")
    assert d.select("t").distinct().count() == 20000
    assert d.where(timecode.tc_to_frames(F.col("t"), 30, True) != F.col("id")).count() == 0


@pytest.mark.parametrize("text,want", [("DF", True), ("29.97DF", True), ("029.970-DF", True), ("29.97NDF", False), ("29.97-ND", False), ("", False)])
def test_drop_flag(spark, text, want):
    assert one(spark, timecode.parse_drop_frame(F.col("t")), t=text) is want


@pytest.mark.parametrize("seconds,short,clock", [(0.0, "0:00", "00:00:00"), (59.5, "1:00", "00:00:59"), (3661.0, "1:01:01", "01:01:01"), (90000.0, "25:00:00", "01:00:00")])
def test_clocks(spark, seconds, short, clock):
    assert one(spark, timecode.format_duration(F.col("s")), s=seconds) == short
    assert one(spark, timecode.seconds_to_clock(F.col("s")), s=seconds) == clock


def test_natural_order(spark):
    want = ["1T2", "1T10", "2", "10", "a1", "A2", "a10", "b"]
    d = spark.createDataFrame([(x,) for x in reversed(want)], "t string")
    assert [r["t"] for r in d.orderBy(names.natural_key(F.col("t"))).collect()] == want


@pytest.mark.parametrize("text,want", [("a/b:c", "a-b-c"), (" x. ", "x"), ("..", ""), ("ok", "ok")])
def test_safe_part(spark, text, want):
    assert one(spark, names.safe_part(F.col("t")), t=text) == want


@pytest.mark.parametrize("name,want", [("", "blank"), ("..", "dots"), ("a/b", "slash"), ("x" * 256, "too long"), ("con.wav", "reserved"), ("a.", "dot or blank at the end"), ("ok.wav", None)])
def test_name_problem(spark, name, want):
    assert one(spark, names.name_problem(F.col("n")), n=name) == want


def test_patterns_and_replacing(spark):
    values = {"scene": F.col("s"), "take": F.col("t")}
    assert one(spark, names.expand("{scene}/T{take}_{n:3}_{odd}", values, {"scene": "none"}), s="", t="1/2") == "none/T1-2_001_{odd}"
    assert one(spark, names.find_replace(F.col("t"), "a.c", "x"), t="abc a.c") == "abc x"
    assert one(spark, names.find_replace(F.col("t"), r"(\d+)-(\d+)", r"\2-\1", regex=True), t="12-34") == "34-12"
    assert one(spark, names.find_replace(F.col("t"), "ABC", "$1", case_sensitive=False), t="abc") == "$1"
    with pytest.raises(ValueError):
        names.find_replace(F.lit("x"), "(", "", regex=True)


def test_take_names(spark):
    p = one(spark, names.take_parts(F.col("n")), n="10A-T03_ISO.wav")
    assert tuple(p) == ("10A", "03", "_ISO", ".wav")
    assert one(spark, names.renamed_take(F.col("n"), F.lit("11"), F.lit("7")), n="10A-T03_ISO.wav") == "11-T07_ISO.wav"
    assert one(spark, names.take_stem(F.col("n")), n="10T03_LR.wav") == "10t03"


def test_recorder_units_and_escapes(spark):
    assert one(spark, names.recorder_label(F.col("r")), r="SoundDev: 833 WS123") == "Sound Devices 833"
    assert one(spark, names.human_size(F.col("s")), s=3_400_000) == "3.4 MB"
    assert one(spark, names.human_time(F.col("s")), s=7500.0) == "2 h 05 min"
    assert one(spark, names.html_escaped(F.col("t")), t="<a & 'b'>") == "&lt;a &amp; &#x27;b&#x27;&gt;"
    assert one(spark, names.url_quoted(F.col("t")), t="/a b/ü:~") == "/a%20b/%C3%BC:~"
    assert one(spark, names.description_map(F.col("t")), t="sSCENE=1\r\nsTAKE=2\nsSCENE=9\nrest") == {"SCENE": "1", "TAKE": "2"}
    assert one(spark, names.nfc(F.col("t")), t="é") == "é"


def test_paths(spark):
    assert one(spark, paths.ancestors(F.col("p")), p="/a/b/c") == ["/a", "/a/b", "/a/b/c"]
    assert one(spark, paths.folder_project(F.col("p"), ["SD_1"]), p="sd_1/25Y10M27/Harbor/x.wav") == "Harbor"
    d = spark.createDataFrame([("/l/a/x/1",), ("/l/a/y/2",)], "p string")
    assert paths.common_folder(d, "p").first()["folder"] == "/l/a"


def test_levels_and_gains(spark):
    assert one(spark, audio.db_to_gain(F.col("d")), d=-70.0) == 0.0
    assert one(spark, audio.level(F.col("v")), v=1.0) == 1.0 and one(spark, audio.level(F.col("v")), v=0.0) == 0.0
    left, right = audio.pan_gains(F.col("p"))
    assert one(spark, left, p=0.0) == pytest.approx(1.0) and one(spark, right, p=1.0) == pytest.approx(math.sqrt(2))
    assert one(spark, audio.compressor_gain(F.col("x"), -30.0, 4.0, 0.0), x=-10.0) == pytest.approx(-15.0)
    assert one(spark, audio.expander_gain(F.col("x"), -40.0, 2.0, 0.0, 12.0), x=-60.0) == -12.0


@settings(max_examples=40, deadline=None)
@given(st.sampled_from([8, 16, 24, 32]), st.lists(st.floats(-1, 1, width=32), min_size=2, max_size=40))
def test_pcm_round_trip(bits, values):
    x = np.array(values[: len(values) // 2 * 2], np.float32).reshape(-1, 2)
    back = audio.decode_pcm(audio.encode_pcm(x, bits) + b"\0", bits, 2)
    assert back.shape == x.shape and np.abs(back - x).max() <= 1.01 / 2 ** (bits - 1) + 1e-6


def test_float_pcm_and_dither():
    x = np.array([[0.5], [np.nan], [np.inf], [-np.inf]], np.float32)
    assert audio.decode_pcm(audio.encode_pcm(x, 32, True), 32, 1, True).ravel().tolist() == [0.5, 0.0, 1.0, -1.0]
    a, b = (audio.encode_pcm(np.zeros((100, 1)), 16, dither=np.random.default_rng(0)) for _ in range(2))
    assert a == b and set(np.frombuffer(a, "<i2")) <= {-1, 0, 1}


def test_filters():
    hp = [audio.rbj_biquad("highpass", 100, 48000, q=q) for q in audio.butterworth_qs(4)]
    low, at, high = audio.response_db(hp, np.array([50, 100, 1000]), 48000)
    assert low == pytest.approx(-24.1, abs=0.1) and at == pytest.approx(-3.01, abs=0.02) and high == pytest.approx(0, abs=0.01)
    assert audio.response_db(audio.k_weighting(48000), np.array([997.0]), 48000)[0] == pytest.approx(0.691, abs=0.02)
    x = np.sin(2 * np.pi * np.arange(4800) / 4 + np.pi / 4)
    assert 20 * np.log10(audio.true_peak(x, 48000)) == pytest.approx(0.0, abs=0.1)


def test_natural_text_sorts_like_the_key(spark):
    texts = ["a10", "a2", "A2b", "a02", "b", "10", "9", "", "a", "ab", "a2b10", "a2b9", "é1", "x" + "9" * 50, "x" + "1" * 51, "a 1", "a1"]
    d = spark.createDataFrame([(t,) for t in texts if len(t) < 40], "t string")
    by_key = [r["t"] for r in d.orderBy(names.natural_key(F.col("t")), "t").collect()]
    assert [r["t"] for r in d.orderBy(names.natural_text(F.col("t")), "t").collect()] == by_key
    long_ = spark.createDataFrame([(t,) for t in texts if len(t) > 40], "t string")
    assert [len(r["t"]) for r in long_.orderBy(names.natural_text(F.col("t"))).collect()] == [51, 52]


def test_few_texts_at_a_time_are_normalized():
    texts = pa.array(["a\u0308" * 5000] * 2000 + [None])
    tracemalloc.start()
    try:
        made = names.nfc.func(texts)
        held = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert made.to_pylist() == ["\u00e4" * 5000] * 2000 + [None] and held < 20_000_000  # all texts as Python's are 40 MB
