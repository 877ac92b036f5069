"""Operators on small tables of their own, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.operators import catalog, dedupe, joins, signal
from reelspark.plans import moves


def test_interval_join_equals_all_pairs(spark):
    rng = random.Random(2)
    a = [(i, s := rng.randrange(1000), s + rng.randrange(0, 120)) for i in range(150)]
    b = [(i, s := rng.randrange(1000), s + rng.randrange(0, 120)) for i in range(150)]
    left, right = spark.createDataFrame(a, "x long, a0 long, a1 long"), spark.createDataFrame(b, "y long, b0 long, b1 long")
    want = {(i, j) for i, s, e in a for j, t, f in b if s < f and t < e and e > s and f > t}
    got = [(r["x"], r["y"]) for r in joins.interval_join(left, right, ("a0", "b0"), ("a1", "b1")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_intervals_of_any_length_meet_by_few_nodes(spark):
    """From one tick to a thousand million, before and after zero; an interval is filed under two nodes a level at most."""
    rng = random.Random(8)
    make = lambda n: [(i, s := rng.randrange(-10**9, 10**9), s + int(10 ** rng.uniform(0, 9))) for i in range(n)] + [(n, -(2**61), 2**61), (n + 1, 5, 5), (n + 2, 7, 3)]
    a, b = make(250), make(250)
    left, right = spark.createDataFrame(a, "x long, a0 long, a1 long"), spark.createDataFrame(b, "y long, b0 long, b1 long")
    want = {(i, j) for i, s, e in a for j, t, f in b if s < f and t < e and e > s and f > t}
    got = [(r["x"], r["y"]) for r in joins.interval_join(left, right, ("a0", "b0"), ("a1", "b1")).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    filed = {}
    for r in joins.nodes(left, "a0", "a1").collect():
        filed.setdefault(r["x"], []).append((r["_place"] << r["_level"], r["_place"] + 1 << r["_level"]))
    for i, s, e in a:
        own = sorted(filed.get(i, []))
        assert len(own) <= max(1, 2 * (max(e - s, 1)).bit_length())
        if e > s:  # the nodes make up the interval, without gaps
            assert own[0][0] == s and own[-1][1] == e and all(p[1] == q[0] for p, q in zip(own, own[1:]))


def test_a_name_that_most_rows_want(spark):
    rng = random.Random(6)
    wants = ["hot.wav"] * 3000 + ["b"] * 40 + ["c (2).wav"] * 5 + [".x"] * 3 + ["d.e/f"] * 4
    rng.shuffle(wants)
    there = ["hot.wav", "hot (2).wav", "hot (07).wav", "hot (9999).wav", "b (1)", "b (3)", "b (3) (2)", "c (2) (2).wav", ".x (2)", "d.e/f", "hot (99999999999999999999).wav"] + [f"hot ({rng.randrange(2, 4000)}).wav" for _ in range(900)]
    used, want = set(there), {}
    numbers = {}
    for k, w in enumerate(wants):
        stem, dot, ext = w.rpartition(".")
        stem, ext = (stem, dot + ext) if stem and "/" not in ext else (w, "")
        n = numbers.get(w, 0) + 1
        while (w if n == 1 else f"{stem} ({n}){ext}") in used:
            n += 1
        numbers[w], want[k] = n, w if n == 1 else f"{stem} ({n}){ext}"
    d = spark.createDataFrame(list(enumerate(wants)), "id long, want string").repartition(5)
    got = {r["id"]: r["unique"] for r in moves.numbered(d, "want", ["id"], spark.createDataFrame([(x,) for x in there], "want string")).collect()}
    assert got == want
    plain = {r["id"]: r["unique"] for r in moves.numbered(d, "want", ["id"]).collect()}
    assert len(set(plain.values())) == len(wants) and plain[min(plain)] == wants[0]


def test_a_merge_is_planned_by_components(spark):
    """As one plan of each whole group, over random files that share recordings and places."""
    rng = random.Random(9)
    schema = "grp string, path string, name string, key string, hash string, size long, channels long, noted boolean, in_target boolean, score long, target string"
    rows = []
    for k in range(900):
        g, name = rng.choice(["g", "h", None]), f"{rng.randrange(260)}.{rng.choice(['wav', 'WAV'])}"
        inside = rng.random() < 0.2
        rows.append((g, f"{'t' if inside else 's'}/{k}/{name}" if not inside else f"t/{name}#{k}" if rng.random() < 0.3 else f"t/{name.lower()}", name, rng.choice([None, *map(str, range(400))]), str(rng.randrange(300)), rng.randrange(3), rng.choice([2, 2, 8]), rng.random() < 0.3, inside, rng.randrange(4), f"t/{name.lower()}"))
    rows = list({(r[0], r[1]): r for r in rows}.values())
    df = spark.createDataFrame(rows, schema).repartition(4)
    want, found = set(), df.collect()
    for g in ("g", "h", None):
        own = sorted((r for r in found if r["grp"] == g), key=lambda r: (not r["in_target"], r["score"], r["path"]))
        want |= {(g, a[0], path, *a[1:], "") for path, a in moves._plan_files(own).items()}
    assert {tuple(r) for r in moves.merge_plan(df, "grp").collect()} == want and len({w[1] for w in want}) == 4


@pytest.mark.parametrize("strict,width", [(False, None), (True, None), (False, 7), (True, 7)])
def test_asof_equals_search(spark, strict, width):
    rng = random.Random(5)
    e = [(k % 3, rng.randrange(60), i) for i, k in enumerate(range(80))]
    p = [(k % 3, t, 100 * (k % 3) + t) for k in range(3) for t in rng.sample(range(60), 20)]
    got = joins.asof(spark.createDataFrame(e, "g long, t long, i long"), spark.createDataFrame(p, "g long, t long, v long"), ["g"], "t", ["v"], strict=strict, width=width)
    for r in got.collect():
        before = [t for g, t, _ in p if g == r["g"] and (t < r["t"] if strict else t <= r["t"])]
        after = [t for g, t, _ in p if g == r["g"] and t > r["t"]]
        assert r["prev_v"] == (100 * r["g"] + max(before) if before else None)
        assert r["next_v"] == (100 * r["g"] + min(after) if after else None)
    assert got.count() == 80


def test_lane_values(spark):
    d = spark.createDataFrame([(50, 0, 0.0, 100, -10.0), (150, 100, -10.0, None, None), (-5, None, None, 0, 0.5), (50, 0, float("-inf"), 100, 0.0)], "f long, a long, v double, b long, w double")
    c = F.col
    assert [r[0] for r in d.select(joins.lane_value(c("f"), c("a"), c("v"), c("b"), c("w"))).collect()] == [-5.0, -10.0, 0.5, float("-inf")]
    assert d.select(joins.lane_value(c("f"), c("a"), c("v"), c("b"), c("w"), step=True)).first()[0] == 0.0


def test_clip_over_midnight(spark):
    day = 86400
    takes = spark.createDataFrame([(1, day - 5, 20, 2, 1, None), (2, 3, 10, 8, 2, None), (3, 40000, 5, 2, 3, None)], "take long, t_start long, t_len long, t_channels long, t_seq long, t_date date")
    clips = spark.createDataFrame([(7, 2, 6, day, None)], "clip long, c_start long, c_len long, c_day long, c_date date")
    got = {r["take"]: (r["overlap"], r["chosen"]) for r in joins.match_clips(takes, clips).collect()}
    assert got == {1: (6, True), 2: (5, False)}


def test_similar_names_and_clusters(spark):
    from difflib import SequenceMatcher

    base = ["SUNRISE", "SUNRYSE", "Sunrise", "Orchard", "ORCHARD INC", "CHAPTER 2", "CHAPTER 4", "AB", "ABC", "Night Shift", "NIGHTSHIFT", "Nite Shift", "Harbor", "Harbour", "Harbor 2"]
    d = spark.createDataFrame([(x,) for x in base], "n string")
    norm = lambda x: "".join(c for c in x.lower() if c.isalnum())
    digits = lambda x: "".join(c if c.isdigit() else " " for c in x).split()

    def alike(a, b):
        a, b = sorted((a, b), key=lambda x: (x.lower(), x))
        s, t = sorted((norm(a), norm(b)), key=len)
        if digits(a) != digits(b) or len(s) < 3:
            return False
        return (t.startswith(s) and not any(c.isdigit() for c in t[len(s) :])) or (len(s) >= 5 and SequenceMatcher(None, norm(a), norm(b)).ratio() >= 0.85)

    want = {frozenset((a, b)) for a in base for b in base if a != b and alike(a, b)}
    got = dedupe.similar_pairs(d, "n")
    assert {frozenset((r["a"], r["b"])) for r in got.collect()} == want
    c = {r["name"]: r["cluster"] for r in dedupe.clusters(got).collect()}
    assert c["SUNRISE"] == c["SUNRYSE"] == c["Sunrise"] and c["Orchard"] == c["ORCHARD INC"] and "CHAPTER 2" not in c


def test_long_cluster_chain(spark):
    chain = [(f"n{k:03d}", f"n{k + 1:03d}") for k in range(70)]
    random.Random(1).shuffle(chain)
    got = dedupe.clusters(spark.createDataFrame(chain, "a string, b string")).collect()
    assert {r["cluster"] for r in got} == {"n000"} and len(got) == 71


def test_duplicate_groups_fingerprint_only_where_names_differ(spark):
    rows = [("p1", "k", "a", "x"), ("p2", "k", "a", "y"), ("p3", "k", "b", "x"), ("p4", "m", "c", "z"), ("p5", "m", "c", "w"), ("p6", "q", "d", "v")]
    d = spark.createDataFrame(rows, "path string, key string, name string, body string")
    got = {r["path"]: r["content"] for r in dedupe.duplicate_groups(d, ["key"], "name", F.md5(F.col("body").cast("binary"))).collect()}
    assert set(got) == {"p1", "p2", "p3", "p4", "p5"} and got["p1"] == got["p2"] == got["p3"] and got["p4"] == got["p5"] == ""


def test_collision_numbers_fill_gaps(spark):
    d = spark.createDataFrame([(k, "a.wav") for k in range(4)] + [(9, "b.wav")], "id long, want string")
    there = spark.createDataFrame([("a.wav",), ("a (3).wav",)], "want string")
    got = {r["id"]: r["unique"] for r in moves.numbered(d, "want", ["id"], there).collect()}
    assert got == {0: "a (2).wav", 1: "a (4).wav", 2: "a (5).wav", 3: "a (6).wav", 9: "b.wav"}


def test_rename_plan_problems(spark):
    d = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "z"), ("y", "z"), ("q", "taken"), ("m", "m/n"), ("g", "..")], "p string, t string")
    there = spark.createDataFrame([(x,) for x in ("a", "b", "x", "y", "q", "m", "g", "taken")], "path string")
    got = {r["path"]: r["problem"] for r in moves.rename_plan(d, F.col("p"), F.col("t"), there).collect()}
    assert got == {"a": "", "b": "", "x": "duplicate target", "y": "duplicate target", "q": "target exists", "m": "into itself", "g": "dots"}


def test_merge_plan(spark):
    schema = "grp string, path string, name string, key string, hash string, size long, channels long, noted boolean, in_target boolean, score long, target string"
    rows = [
        ("g", "t/1.wav", "1.wav", "k1", "h1", 10, 2, False, True, 0, "t/1.wav"), ("g", "s/1.wav", "1.wav", "k1", "h1", 10, 2, False, False, 1, "t/1.wav"),
        ("g", "s/2.wav", "2.wav", "k2", "h2", 10, 2, False, False, 1, "t/2.wav"), ("g", "r/2.wav", "2.wav", "k2", "h2", 10, 2, True, False, 2, "t/2.wav"),
        ("g", "s/3.wav", "3.wav", "k3", "h3", 10, 8, False, False, 1, "t/3.wav"), ("g", "r/3.wav", "3.wav", "k4", "h4", 10, 2, False, False, 2, "t/3.wav"),
        ("g", "r/1b.wav", "1.WAV", "k9", "h9", 10, 2, False, False, 5, "t/1.wav"),
    ]
    got = {r["path"]: (r["kind"], r["dst"], r["level"]) for r in moves.merge_plan(spark.createDataFrame(rows, schema), "grp").collect()}
    assert got["s/1.wav"] == ("remove", "t/1.wav", "identical") and got["s/2.wav"] == ("remove", "r/2.wav", "audio") and got["r/2.wav"] == ("move", "t/2.wav", "")
    assert got["s/3.wav"][0] == "move" and got["r/3.wav"] == ("remove", "t/3.wav", "subset") and got["r/1b.wav"][0] == "skip"


def test_execute_moves_copies_and_repeats(spark, tmp_path):
    for n in "abc":
        (tmp_path / f"{n}.txt").write_text(n)
    p = lambda x: str(tmp_path / x)
    rows = [("move", p("a.txt"), p("new/a.txt"), "", "", ""), ("copy", p("b.txt"), p("new/b.txt"), "", "", ""), ("remove", p("c.txt"), "", "", "", ""), ("move", p("b.txt"), p("safe/b.txt"), "", "", "")]
    plan = spark.createDataFrame(rows, "kind string, path string, dst string, reason string, level string, other string")
    first = sorted(r["status"] for r in moves.execute(plan, protected=[p("safe")]).collect())
    assert first == ["blocked", "done", "done", "done"]
    assert (tmp_path / "new/a.txt").read_text() == "a" and (tmp_path / "b.txt").exists() and not (tmp_path / "c.txt").exists()
    again = {r["path"].rsplit("/", 1)[1] + r["dst"][-9:]: r["status"] for r in moves.execute(plan, protected=[p("safe")]).collect()}
    assert again["a.txtnew/a.txt"] == "done" and again["b.txtnew/b.txt"] == "conflict"


def test_empty_folders(spark):
    files = spark.createDataFrame([("l/a/x.wav",), ("l/b/.mark",), ("l/b/c/.mark",)], "path string")
    folders = spark.createDataFrame([(x,) for x in ("l", "l/a", "l/b", "l/b/c", "l/d", "l/d/e")], "folder string")
    assert {r[0] for r in moves.empty_folders(files, "path", folders, [".mark"]).collect()} == {"l/b", "l/d"}


def test_loudness_of_a_tone_and_gain(spark):
    rate = 8000
    t = np.arange(rate * 4) / rate
    x = 0.1 * np.sqrt(2) * np.sin(2 * np.pi * 997 * t)
    rows = [("f", k, x[k * 2000 : (k + 1) * 2000].tolist()) for k in range(16)]
    blocks = spark.createDataFrame(rows, "track string, block long, samples array<double>")
    powers = signal.block_powers(blocks, ["track"], "block", "samples", rate)
    lufs = signal.gated_loudness(signal.window_powers(powers, ["track"], "q", "power", 4), ["track"]).first()["lufs"]
    assert lufs == pytest.approx(-20.0, abs=0.1)
    assert signal.gain_to_target(powers, ["track"], "q", "power", -23.0).first()["gain_db"] == pytest.approx(-23 - lufs, abs=0.01)


def test_noise_reduction_and_limiter():
    rng = np.random.default_rng(3)
    rate, noise = 16000, rng.normal(0, 0.01, 32000)
    voice = 0.3 * np.sin(2 * np.pi * 440 * np.arange(32000) / rate) * (np.arange(32000) > 16000)
    w = np.hanning(1025)[:-1]
    frames = np.stack([noise[k : k + 1024] * w for k in range(0, 15000, 256)])
    profile = (np.abs(np.fft.rfft(frames, axis=1)) ** 2).mean(axis=0)
    out = signal.spectral_reduction(noise + voice, profile)
    quiet, loud = slice(2000, 14000), slice(18000, 30000)
    assert 10 * np.log10((noise[quiet] ** 2).mean() / (out[quiet] ** 2).mean()) > 8
    assert abs(10 * np.log10((out[loud] ** 2).mean() / (voice[loud] ** 2).mean())) < 0.5
    y = signal.limiter(voice * 5, -6.0, rate)
    assert np.abs(y).max() <= 10 ** (-6 / 20) + 1e-9


def test_process_tracks_and_blocks_agree(spark):
    x = np.arange(100.0)
    rows = [("a", k, x[k * 10 : (k + 1) * 10].tolist()) for k in range(10)]
    blocks = spark.createDataFrame(rows, "track string, block long, samples array<double>").repartition(5)
    got = signal.process_tracks(blocks, ["track"], "block", "samples", np.cumsum).orderBy("block").collect()
    assert np.allclose(np.concatenate([r["samples"] for r in got]), np.cumsum(x))
    half = signal.register_processor("half", lambda a: a / 2)
    assert np.allclose(blocks.select(half(F.col("samples").cast("array<float>")).alias("s"), "block").orderBy("block").first()["s"], x[:10] / 2)


def test_grid_columns(spark):
    from reelspark.schema import RECORDING

    row = {f.name: "" if f.dataType.simpleString() == "string" else False if f.dataType.simpleString() == "boolean" else [] if "array" in f.dataType.simpleString() else 0 for f in RECORDING.fields}
    good = row | {"path": "/l/P/1T01.wav", "sample_rate": 48000, "frames": 48000 * 90, "time_reference": 48000 * 3600, "tc_rate": "25", "bits": 24, "channels": 2, "tracks": ["Boom", "Lav"], "circled": True, "mtime": 1.0}
    bad = row | {"path": "/l/P/x.wav", "error": "not a WAV file", "time_reference": None, "mtime": 1.0}
    got = {r["name"] or r["note"]: r for r in catalog.grid(spark.createDataFrame([tuple(r[f.name] for f in RECORDING.fields) for r in (good, bad)], RECORDING)).collect()}
    g = got["1T01.wav"]
    assert (g["start_tc"], g["end_tc"], g["length"], g["rate"], g["tracks"], g["circled"], g["folder"]) == ("01:00:00:00", "01:01:30:00", "1:30", "25", "Boom, Lav", "★", "/l/P")
    assert got["not a WAV file"]["length"] == ""


def test_positions(spark):
    rows = [(k * 7919 % 997, k) for k in range(997)]
    d = spark.createDataFrame(rows, "x long, k long").repartition(7)
    got = {r["x"]: r["position"] for r in catalog.positions(d, F.col("x")).collect()}
    assert got == {x: x + 1 for x in range(997)}


def test_size_estimate_and_status(spark):
    d = spark.range(0, 5000).select("id", F.lit(7).cast("long").alias("size"))
    r = catalog.size_estimate(d, "size", "id").first()
    assert r["estimate"] == pytest.approx(35000, rel=0.02) and 380 <= r["sampled"] <= 440


def test_every_length_of_day_is_matched(spark):
    """More lengths of day than any list of rates has: no clip is lost."""
    takes = spark.createDataFrame([("t", 0, 10_000, 2, 1, None)], "take string, t_start long, t_len long, t_channels int, t_seq int, t_date date")
    clips = spark.createDataFrame([(f"c{k}", 100 + k, 50, 1_000_000 + k, None) for k in range(1500)], "clip string, c_start long, c_len long, c_day long, c_date date")
    assert joins.match_clips(takes, clips).where("chosen").count() == 1500
