"""Queries on rows that the small tables lack, beside their SQL."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from reelspark.operators import dedupe, joins
from reelspark.plans import files
from tests.test_oracle import rows_of


@pytest.fixture
def beside_sql(spark, tmp_path):
    def run(name, **tables):
        con = duckdb.connect()
        for table, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
            con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
        df = entry.queries()[name](spark, str(tmp_path))
        found = con.execute(entry.oracle_sql()[name])
        got, want = rows_of(df.columns, df.collect()), rows_of([d[0] for d in found.description], found.fetchall())
        assert got == want
        return got[1]

    return run


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event(k, at, user=1, kind="view", value=1.0):
    return (k, dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=at), user, kind, value, "{}")


def test_silence_has_a_level(beside_sql):
    rows = [event(k, k, value=v) for k, v in enumerate([100.0, 0.0, 300.0, 0.0, 0.0, 5.0, 200.0])]
    assert all(g is not None for g, _, _ in beside_sql("q_dynamics", events=(rows, EVENTS)))


PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


def test_numbers_of_five_digits_have_four_places(beside_sql):
    rows = [(k, "red ring", "Brand#1", "LARGE", 1, 1.0) for k in range(10_050)]
    assert len(beside_sql("q_names", part=(rows, PART))) == 10_050


def test_frames_behind_midnight_of_the_timecode(beside_sql):
    """A day of 29.97 drop frame ends 86 ms before the clock's."""
    rows = [event(k, 86_400_000_000 - after) for k, after in enumerate([1, 40_000, 80_000, 86_000, 90_000, 86_400_000_000])]
    assert [r[0] for r in sorted(beside_sql("q_tc_roundtrip", events=(rows, EVENTS)), key=lambda r: r[1])] == [2589410, 2589409, 2589408, 2589408, 2589407, 0]


def test_pairs_are_chosen_without_a_shuffle_of_pairs(spark, beside_sql):
    rows = [event(k, 1_000_000 * (k % 7), user=k % 3, kind="view" if k < 40 else "error", value=float(k % 11)) for k in range(120)]
    assert sum(r[0] for r in beside_sql("q_interval_match", events=(rows, EVENTS))) == 40
    takes = [(k, 10 * k, 2**52 if k == 2 else 500, k % 2, k % 5, None if k % 3 else dt.date(2024, 1, 1)) for k in range(60)]
    takes = spark.createDataFrame(takes, "take long, t_start long, t_len long, t_channels long, t_seq long, t_date date")
    clips = spark.createDataFrame([(7, 30 * (k // 2), 300, 86_400, dt.date(2024, 1, 2) if k % 4 else None) for k in range(20)], "clip long, c_start long, c_len long, c_day long, c_date date")
    found = joins.match_clips(takes, clips)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Union") < plan.index("Window")  # the window lies below the pairs
    assert found.where("chosen").count() == 1  # rows that repeat a clip are one group
    best = max(found.collect(), key=lambda r: (r["overlap"], r["t_channels"], -r["t_seq"]))
    (own,) = found.where("chosen").collect()
    assert (own["overlap"], own["t_channels"], own["t_seq"]) == (best["overlap"], best["t_channels"], best["t_seq"])


def test_edits_of_one_family_are_told_apart_before_they_meet_its_files(spark):
    d = spark.createDataFrame([("a", "F"), ("b", "F"), ("c", "F"), ("c", "G"), ("d", "G"), ("e", None), ("e", None), (None, "F")], "path string, family string")
    e = spark.createDataFrame([("a", "scene", "1"), ("b", "scene", "1"), ("c", "scene", "1"), ("d", "take", "2"), ("e", "take", "3"), ("x", "take", "4")], "path string, column string, value string")
    made = files.edit_plan(d, e, ["family"])
    want = [("a", "scene", "1"), ("b", "scene", "1"), ("c", "scene", "1"), ("c", "take", "2"), ("d", "scene", "1"), ("d", "take", "2"), ("e", "take", "3")]
    assert sorted(tuple(r) for r in made.collect()) == want
    assert made._jdf.queryExecution().optimizedPlan().toString().splitlines()[0].strip().startswith("Union")  # what is made is not aggregated


def test_pairs_of_copies_are_the_work_of_many_tasks(spark, beside_sql, tmp_path):
    rows = [(k, ("red ring", "Red ring", "old hat")[k % 3], f"Brand#{k % 4}", "LARGE", k % 2, 1.0) for k in range(240)] + [(1000, None, "Brand#1", "LARGE", 1, 1.0), (1001, "red ring", None, "LARGE", 1, 1.0)]
    assert len(beside_sql("q_better_copies", part=(rows, PART))) == 12 * 20 * 19
    made = entry.queries()["q_better_copies"](spark, str(tmp_path))
    assert made.select(F.spark_partition_id()).distinct().count() > 1  # a small file was one task for all its pairs


def test_large_groups_of_copies_meet_in_blocks(spark):
    """Notes, circles, other fields, formats and tracks: beside the tests said in Python, whatever the block."""
    c, kinds = F.col, {"name": ("x", "x", "X", None), "note": ("", " ", "n", None), "circled": (False, True, None), "scene": ("s", "t", "", None), "frames": (1, 2, None), "channels": (1, 2), "error": ("", "", "bad", None)}
    rows = [(k, k // 75 if k < 150 else None, *(v[(k * 7919 // 3**j) % len(v)] for j, v in enumerate(kinds.values()))) for k in range(160)]
    d = spark.createDataFrame(rows, "key long, folder long, name string, note string, circled boolean, scene string, frames long, channels int, error string")
    fields = {n: c(n) for n in kinds} | {"take": F.lit("1"), "tape": F.lit(None).cast("string"), "date": F.lit("")} | {n: F.lit(1) for n in ("sample_rate", "bits", "float_samples", "time_reference")}

    def noted(r):
        return (r[3] or "").strip() != "" or bool(r[4])

    want = sorted(
        (a[0], b[0], noted(a) and not noted(b) and a[5] == b[5], a[8] == b[8] == "" and None not in (a[6], b[6]) and a[6] == b[6] and a[7] != b[7])
        for a in rows for b in rows if a[0] != b[0] and None not in (a[1], a[2], b[1], b[2]) and a[1:3] == b[1:3]
    )
    assert sum(r[2] for r in want) > 20 and sum(r[3] for r in want) > 20
    for block in (5, 8_192):
        made = dedupe.better_copies(d, "key", ["folder", "name"], fields, block)
        assert sorted(map(tuple, made.collect())) == want
