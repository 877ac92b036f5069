"""Long groups in many segments, beside one pass over each group."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from reelspark.operators import prefix, signal

LENGTHS = [3, 7, 64, 1000, 65_536]


@pytest.fixture(scope="module")
def track(spark):
    """One track with most rows, some short ones and a null one."""
    r = random.Random(1)
    rows = [(1, k, r.choice([0.0, -3.0, -9.0, -30.0]) if k % 50 < 40 else -12.0) for k in range(1500)]
    rows += [(t, k, r.uniform(-40, 0)) for t in (2, 3, None) for k in range(r.randint(1, 90))]
    pdf = pd.DataFrame(rows, columns=["track", "at", "x"])
    return pdf, spark.createDataFrame(rows, "track long, at long, x double").repartition(6).cache()


def by_track(pdf, f):
    out = {}
    for t, own in pdf.groupby("track", dropna=False):
        for at, v in zip(own["at"], f(own.sort_values("at")["x"].to_numpy())):
            out[None if pd.isna(t) else int(t), int(at)] = v
    return out


def got(df, *columns):
    return {(r["track"], r["at"]): tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


@pytest.mark.parametrize("length", LENGTHS)
def test_windows_reach_over_segments(track, length):
    pdf, d = track
    made = prefix.neighbours(d, ["track"], "at", 2, 4, length, low=signal.running_min("x", 5), smooth=signal.box("x", 2))
    want_low = by_track(pdf, lambda x: [x[k : k + 5].min() for k in range(len(x))])
    want_smooth = by_track(pdf, lambda x: [x[max(0, k - 2) : k + 3].mean() for k in range(len(x))])
    for key, (low, smooth) in got(made, "low", "smooth").items():
        assert low == want_low.pop(key) and smooth == pytest.approx(want_smooth[key])
    assert not want_low
    powers = signal.window_powers(d.withColumn("p", F.col("x") * F.col("x")), ["track"], "at", "p", 9, length)
    want = by_track(pdf, lambda x: [(x[k - 8 : k + 1] ** 2).mean() if k >= 8 else None for k in range(len(x))])
    found = got(powers, "mean_power")
    assert set(found) == {k for k, v in want.items() if v is not None} and all(v == pytest.approx(want[k]) for k, v in found.items())


@pytest.mark.parametrize("length", LENGTHS)
@pytest.mark.parametrize("coefs", [(0.3, 0.9, True), (0.999, 0.5, False), (0.0, 0.9999, True)])
def test_one_pole(track, length, coefs):
    pdf, d = track
    attack, release, below = coefs

    def one(x):
        g, out = 0.0, []
        for t in x:
            g = t + (g - t) * (attack if (t < g) == below and t != g else release)
            out.append(g)
        return out

    want, found = by_track(pdf, one), got(signal.smoothed_gain(d, ["track"], "at", "x", attack, release, below, length), "gain_db")
    assert set(want) == set(found) and all(found[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())


@pytest.mark.parametrize("length", LENGTHS)
@pytest.mark.parametrize("hold", [0, 2, 40])
def test_gate(track, length, hold):
    pdf, d = track

    def one(x):
        is_open, left, out = False, 0, []
        for v in x:
            if v >= -3.0:
                is_open, left = True, hold
            elif is_open and v < -9.0:
                is_open, left = left > 0, max(left - 1, 0)
            out.append(int(is_open))
        return out

    assert got(signal.gated(d, ["track"], "at", "x", -3.0, 6.0, hold, length), "open") == by_track(pdf, one)


def test_running_values(track):
    pdf, d = track
    made = prefix.running(d, ["track"], F.floor(F.col("at") / 10), ["at"], s=("sum", F.col("at")), m=("max", F.col("x")), b=("max_before", F.col("x")), last=("last", F.when(F.col("at") % 17 == 0, F.col("at"))), n=("total", F.lit(1)))
    found = got(made, "s", "m", "b", "last", "n")
    assert len(found) == len(pdf)
    for t, own in pdf.groupby("track", dropna=False):
        x = own.sort_values("at")["x"].to_numpy()
        for k in range(len(x)):
            assert found[None if pd.isna(t) else int(t), k] == (k * (k + 1) // 2, x[: k + 1].max(), x[:k].max() if k else None, k // 17 * 17, len(x))


def test_positions_of_rows_with_ties(spark):
    r = random.Random(2)
    rows = [(0, r.randint(0, 50), k) for k in range(600)] + [(1, 5, 0)]
    made = prefix.positions(spark.createDataFrame(rows, "g long, ts long, id long").repartition(5), ["g"], F.floor(F.col("ts") / 7), ["ts", "id"]).collect()
    want = {k: n for n, (_, _, k) in enumerate(sorted(x for x in rows if x[0] == 0))}
    assert {r["id"]: r["pos"] for r in made if r["g"] == 0} == want and {r["total"] for r in made if r["g"] == 0} == {600}


@pytest.mark.parametrize("width", [5, 100, 10**6])
def test_lanes_are_cut_where_nothing_is_open(spark, monkeypatch, width):
    monkeypatch.setattr(signal, "TOGETHER", 2)
    r = random.Random(3)
    rows, at = [], 0
    for k in range(700):
        at += r.choice([0, 1, 2, 3, 40])
        rows.append((k % 2 if k < 500 else 0, k, at, at + r.choice([0, 1, 5, 20, 60])))
    want = {}
    for g in (0, 1):
        ends = []
        for _, k, a, b in sorted((x for x in rows if x[0] == g), key=lambda x: (x[2], x[1])):
            lane = next((i for i, e in enumerate(ends) if e <= a), len(ends))
            ends[lane : lane + 1] = [b]
            want[k] = lane
    d = spark.createDataFrame(rows, "g long, id long, a long, b long").repartition(4)
    assert {r["id"]: r["lane"] for r in signal.lanes(d, ["g"], "a", "b", "id", width).collect()} == want


def test_bends_of_a_segment_stay_few():
    """A segment of 50,000 targets that never settle is a line with few bends."""
    rng = np.random.default_rng(4)
    made = signal._pole(rng.uniform(-60, 0, 50_000), -60.0, 0.0, 0.9, 0.99, True)
    assert len(made) < 400


def test_a_long_track_is_as_many_tasks_as_segments(spark):
    spread = lambda df: df.groupBy(F.spark_partition_id().alias("p")).count().collect()
    d = spark.range(200_000).select(F.lit(1).alias("track"), F.col("id").alias("at"), F.sin("id").alias("x"))
    made = prefix.neighbours(d.repartition(8, "track"), ["track"], "at", 3, 0, 2000, m=lambda w: F.max("x").over(w.rowsBetween(-3, 0)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = spread(made)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["count"] for r in parts) == 200_000 and len(parts) == 8 and max(r["count"] for r in parts) < 60_000


@pytest.mark.parametrize("gathered", [0, 50, 10**6])
def test_percentiles_of_any_group(track, gathered):
    pdf, d = track
    got = {r["track"]: (r["n"], list(r["p"])) for r in signal.percentiles(d, ["track"], "x", [0.0, 0.1, 0.5, 0.95, 1.0], gathered).collect()}
    for t, own in pdf.groupby("track", dropna=False):
        n, p = got.pop(None if pd.isna(t) else int(t))
        assert n == len(own) and p == pytest.approx(np.percentile(own["x"], [0, 10, 50, 95, 100]))
    assert not got
