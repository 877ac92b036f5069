"""Keyed state in a stream that stops and goes on."""

import time

import pytest

from reelspark.streaming import ingest, state

SCHEMA = "path string, gen long, at long, v string"
TURNS = [[("a", 1, 5, "x"), ("b", 1, 1, "y"), (None, 1, 1, "no key")], [("a", 1, 3, "late"), ("a", 1, 4, "late too"), ("b", 1, 1, "again")], [("b", 0, 99, "an older generation"), ("a", 2, 0, "new"), ("a", 2, 1, "newer")]]


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.PROVIDER)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def turn(spark, folder, rows, quiet_ms=None):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    s = ingest.file_stream(spark, f"{folder}/in", spark.createDataFrame([], SCHEMA).schema, 1)
    q = state.write_results(state.latest_results(s, ["path"], ["gen", "at"], quiet_ms), f"{folder}/out", f"{folder}/cp", "100 milliseconds" if quiet_ms else None)
    if quiet_ms:
        try:
            end = time.time() + 40
            while time.time() < end and not any(p["numInputRows"] for p in q.recentProgress):
                time.sleep(0.2)
            time.sleep(3)  # batches without rows let timers run
        finally:
            q.stop()
    else:
        q.awaitTermination()
    return sorted((tuple(r) for r in spark.read.parquet(f"{folder}/out").collect()), key=repr)


def test_superseded_results_stay_out_over_a_restart(spark, rocks, tmp_path):
    first = sorted(TURNS[0], key=repr)
    assert turn(spark, tmp_path, TURNS[0]) == first
    assert turn(spark, tmp_path, TURNS[1]) == first  # known to be late by state alone
    assert turn(spark, tmp_path, TURNS[2]) == sorted([*first, ("a", 2, 1, "newer")], key=repr)
    now = sorted(map(tuple, state.current_results(spark, str(tmp_path / "out"), ["path"], ["gen", "at"]).collect()), key=repr)
    assert now == sorted([("a", 2, 1, "newer"), ("b", 1, 1, "y"), (None, 1, 1, "no key")], key=repr)


def test_quiet_keys_are_forgotten(spark, rocks, tmp_path):
    turn(spark, tmp_path, [("a", 9, 9, "x")], quiet_ms=1)
    assert ("a", 1, 1, "as if new") in turn(spark, tmp_path, [("a", 1, 1, "as if new")], quiet_ms=1)


def test_results_are_kept_without_python_and_a_batch_written_again_adds_nothing(spark, rocks, tmp_path):
    s = ingest.file_stream(spark, str(tmp_path), spark.createDataFrame([], SCHEMA).schema, 1)
    assert "TransformWithState" not in state.latest_results(s, ["path"], ["gen", "at"])._jdf.queryExecution().analyzed().toString()
    keys = [(f"k{k}", 1, k, "x") for k in range(500)]
    first = turn(spark, tmp_path, keys)
    assert first == sorted(keys, key=repr)
    (commit,) = (tmp_path / "cp" / "commits").glob("0")
    part = next(f for f in (tmp_path / "out").glob("batch0-*") if spark.read.parquet(str(f)).count())
    for f in (commit, commit.with_name(".0.crc"), part, part.with_name(f".{part.name}.crc")):  # as if it had stopped midway
        f.unlink(missing_ok=True)
    again = turn(spark, tmp_path, [("k0", 1, 0, "as good"), ("k1", 2, 0, "new"), ("k2", 1, 1, "late")])
    assert again == sorted([*keys, ("k1", 2, 0, "new")], key=repr)
