"""Envelopes, loudness, mixes, gates and streams over events and embeddings."""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.functions import audio
from reelspark.operators import signal as op
from reelspark.operators.prefix import neighbours, positions
from reelspark.queries import Tables, query
from reelspark.streaming import ingest, state


def _track(t: Tables) -> DataFrame:
    d = positions(t.events.select("user_id", "ts", "event_id", "value"), ["user_id"], F.date_trunc("hour", "ts"), ["ts", "event_id"])
    return d.select("user_id", "pos", "total", "value")


_TRACK = "t AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS total, value FROM events)"


@query(f"WITH {_TRACK} SELECT user_id, pos * 16 // total AS bucket, round(max(abs(value)), 6) AS peak, round(least(sqrt(avg(value * value)), max(abs(value))), 6) AS rms FROM t GROUP BY 1, 2")
def q_envelope(t: Tables) -> DataFrame:
    e = op.envelope(_track(t), ["user_id"], "pos", "total", "value", 16)
    return e.select("user_id", "bucket", F.round("peak", 6).alias("peak"), F.round("rms", 6).alias("rms"))


@query(f"WITH {_TRACK}, e AS (SELECT user_id, pos * 16 // total AS bucket, max(abs(value)) AS peak FROM t GROUP BY 1, 2) SELECT user_id, bucket * 5 // 16 AS column, max(peak) AS peak FROM e GROUP BY 1, 2")
def q_column_levels(t: Tables) -> DataFrame:
    return op.column_levels(op.envelope(_track(t), ["user_id"], "pos", "total", "value", 16), ["user_id"], "bucket", "peak", 16, 5)


def _windows(t: Tables, width: int) -> DataFrame:
    d = _track(t).select("user_id", "pos", (F.col("value") * F.col("value") / 1e6).alias("power"))
    return op.window_powers(d, ["user_id"], "pos", "power", width)


def _windows_sql(width: int) -> str:
    return f"{_TRACK}, w AS (SELECT user_id, pos, avg(value * value / 1e6) OVER x AS p, count(*) OVER x AS n FROM t WINDOW x AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW)), v AS (SELECT user_id, pos, p, -0.691 + 10 * log10(p) AS l FROM w WHERE n = {width})"


@query(f"WITH {_windows_sql(4)} SELECT user_id, pos, round(p, 9) AS mean_power FROM v")
def q_loud_windows(t: Tables) -> DataFrame:
    return _windows(t, 4).select("user_id", "pos", F.round("mean_power", 9).alias("mean_power"))


_GATED = f"""{_windows_sql(4)}, k AS (SELECT * FROM v WHERE l > -70), g AS (SELECT user_id, -0.691 + 10 * log10(avg(p)) - 10 AS rel FROM k GROUP BY 1),
gated AS (SELECT user_id, -0.691 + 10 * log10(avg(p)) AS lufs FROM k JOIN g USING (user_id) WHERE l > rel GROUP BY 1)"""


@query(f"WITH {_GATED} SELECT user_id, round(lufs, 6) AS lufs FROM gated")
def q_loud_gated(t: Tables) -> DataFrame:
    return op.gated_loudness(_windows(t, 4), ["user_id"]).select("user_id", F.round("lufs", 6).alias("lufs"))


@query(f"""WITH {_windows_sql(8)}, k AS (SELECT * FROM v WHERE l > -70), g AS (SELECT user_id, -0.691 + 10 * log10(avg(p)) - 20 AS rel FROM k GROUP BY 1)
SELECT user_id, CASE WHEN count(*) > 1 THEN round(quantile_cont(l, 0.95) - quantile_cont(l, 0.1), 6) END AS lra FROM k JOIN g USING (user_id) WHERE l > rel GROUP BY 1""")
def q_lra(t: Tables) -> DataFrame:
    return op.loudness_range(_windows(t, 8), ["user_id"]).select("user_id", F.round("lra", 6).alias("lra"))


_RANGE = f"""{_windows_sql(8)}, rk AS (SELECT * FROM v WHERE l > -70), rg AS (SELECT user_id, -0.691 + 10 * log10(avg(p)) - 20 AS rel FROM rk GROUP BY 1)
SELECT user_id, CASE WHEN count(*) > 1 THEN quantile_cont(l, 0.95) - quantile_cont(l, 0.1) END AS lra FROM rk JOIN rg USING (user_id) WHERE l > rel GROUP BY 1"""


@query(f"""WITH {_GATED}, r AS (WITH {_RANGE}), pk AS (SELECT user_id, 20 * log10(max(value) / 400) AS peak FROM events GROUP BY 1),
x(platform, target, tolerance, top) AS (VALUES ('netflix', -27.0, 2.0, -2.0), ('amazon', -24.0, 2.0, -2.0), ('appletv', -24.0, 2.0, -1.0), ('youtube', -14.0, NULL, -1.0), ('spotify', -14.0, NULL, -1.0), ('applepodcasts', -16.0, 1.0, -1.0), ('ebu', -23.0, 0.5, -1.0), ('atsc', -24.0, 2.0, -2.0))
SELECT user_id, platform, coalesce((tolerance IS NULL OR abs(lufs - target) <= tolerance + 1e-9) AND coalesce(peak <= top + 1e-9, true) AND coalesce(lra <= 9.0, true), false) AS ok,
  CAST((lufs IS NULL) AS INT) + CAST(coalesce(tolerance IS NOT NULL AND abs(lufs - target) > tolerance + 1e-9, false) AS INT) + CAST(coalesce(tolerance IS NULL AND abs(lufs - target) > 1, false) AS INT) + CAST(coalesce(peak > top + 1e-9, false) AS INT) + CAST(coalesce(lra > 9.0, false) AS INT) AS findings
FROM (SELECT user_id, lufs, lra, peak FROM pk LEFT JOIN gated USING (user_id) LEFT JOIN r USING (user_id)) CROSS JOIN x""")
def q_verdict(t: Tables) -> DataFrame:
    measured = t.events.groupBy("user_id").agg(audio.gain_to_db(F.max("value") / 400).alias("peak"))
    measured = measured.join(op.gated_loudness(_windows(t, 4), ["user_id"]), "user_id", "left").join(op.loudness_range(_windows(t, 8), ["user_id"]), "user_id", "left")
    each = measured.withColumn("x", F.explode(F.array(*(F.struct(F.lit(p).alias("platform"), F.lit(l).alias("lufs"), F.lit(o).cast("double").alias("tolerance"), F.lit(k).alias("peak")) for p, l, o, k in audio.TARGETS))))
    args = (F.col("lufs"), F.col("peak"), F.col("x.lufs"), F.col("x.tolerance"), F.col("x.peak"), F.col("lra"), F.lit(9.0))
    return each.select("user_id", "x.platform", audio.verdict_ok(*args).alias("ok"), F.size(audio.verdict_messages(*args)).alias("findings"))


def _gain_sql(steps: int) -> str:
    """The gain's steps written out."""
    level = lambda k, gain: f"""k{k} AS (SELECT v.user_id, p * {gain} AS p FROM v {'' if k == 0 else f'JOIN g{k - 1} USING (user_id)'}), l{k} AS (SELECT user_id, p, -0.691 + 10 * log10(p) AS l FROM k{k} WHERE p > 0 AND -0.691 + 10 * log10(p) > -70),
r{k} AS (SELECT user_id, -0.691 + 10 * log10(avg(p)) - 10 AS rel FROM l{k} GROUP BY 1), i{k} AS (SELECT l{k}.user_id, -0.691 + 10 * log10(avg(p)) AS lufs FROM l{k} JOIN r{k} USING (user_id) WHERE l > rel GROUP BY 1)"""  # noqa: E731
    parts = [_windows_sql(4), level(0, "1"), "g0 AS (SELECT DISTINCT t.user_id, -23.0 - lufs AS gain, false AS done FROM t LEFT JOIN i0 USING (user_id))"]
    for k in range(1, steps + 1):
        parts.append(level(k, "coalesce(power(10, gain / 10), 1)"))
        parts.append(f"g{k} AS (SELECT g.user_id, CASE WHEN done OR lufs IS NULL OR abs(-23.0 - lufs) <= 0.001 THEN gain ELSE gain - 23.0 - lufs END AS gain, done OR lufs IS NULL OR abs(-23.0 - lufs) <= 0.001 AS done FROM g{k - 1} g LEFT JOIN i{k} USING (user_id))")
    return f"WITH {', '.join(parts)} SELECT user_id, round(gain, 4) AS gain_db FROM g{steps}"


@query(_gain_sql(6))
def q_gain_to_target(t: Tables) -> DataFrame:
    d = _track(t).select("user_id", "pos", (F.col("value") * F.col("value") / 1e6).alias("power"))
    return op.gain_to_target(d, ["user_id"], "pos", "power", -23.0).withColumn("gain_db", F.round("gain_db", 4))


@query("""
WITH e AS (SELECT vec_id, label, embedding, row_number() OVER (PARTITION BY label ORDER BY round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE) * (1 + vec_id % 17))), 9), vec_id) AS k FROM embeddings)
SELECT label, bin, round(avg(power), 6) AS power FROM (SELECT label, CAST(unnest(range(0, 64)) AS INTEGER) AS bin, unnest(embedding) AS power FROM e WHERE k <= 5) GROUP BY 1, 2""")
def q_noise_profile(t: Tables) -> DataFrame:
    energy = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double") * (1 + F.col("vec_id") % 17))
    d = t.embeddings.withColumn("energy", F.round(energy, 9))
    return op.noise_profile(d, ["label"], "vec_id", "energy", "embedding", 5).select("label", "bin", F.round("power", 6).alias("power"))


_POWERS = f"{_TRACK}, p AS (SELECT user_id, pos, value * value / 1e6 AS power FROM t)"


@query(f"""WITH {_POWERS}, w AS (SELECT user_id, avg(power) OVER a AS m, count(*) OVER a AS n, avg(power) OVER b AS s, count(*) OVER b AS k FROM p WINDOW a AS (PARTITION BY user_id ORDER BY pos ROWS 3 PRECEDING), b AS (PARTITION BY user_id ORDER BY pos ROWS 29 PRECEDING))
SELECT user_id, round(-0.691 + 10 * log10(max(m)), 6) AS max_momentary, round(-0.691 + 10 * log10(max(s) FILTER (WHERE k = 30)), 6) AS max_short_term FROM w WHERE n = 4 GROUP BY 1""")
def q_maxima(t: Tables) -> DataFrame:
    d = _track(t).select("user_id", "pos", (F.col("value") * F.col("value") / 1e6).alias("power"))
    m = op.maxima(d, ["user_id"], "pos", "power")
    return m.select("user_id", F.round("max_momentary", 6).alias("max_momentary"), F.round("max_short_term", 6).alias("max_short_term"))


@query(f"""WITH {_POWERS}, s AS (SELECT user_id % 10 AS programme, pos, sum(power) AS power FROM p GROUP BY 1, 2), w AS (SELECT programme, avg(power) OVER a AS m, count(*) OVER a AS n FROM s WINDOW a AS (PARTITION BY programme ORDER BY pos ROWS 3 PRECEDING)),
l AS (SELECT programme, m, -0.691 + 10 * log10(m) AS l FROM w WHERE n = 4 AND -0.691 + 10 * log10(m) > -70), r AS (SELECT programme, -0.691 + 10 * log10(avg(m)) - 10 AS rel FROM l GROUP BY 1)
SELECT l.programme, round(-0.691 + 10 * log10(avg(m)), 6) AS lufs FROM l JOIN r USING (programme) WHERE l > rel GROUP BY 1""")
def q_programme(t: Tables) -> DataFrame:
    d = _track(t).select((F.col("user_id") % 10).alias("programme"), "pos", (F.col("value") * F.col("value") / 1e6).alias("power"))
    w = op.window_powers(op.programme(d, ["programme"], "pos", "power"), ["programme"], "pos", "power", 4)
    return op.gated_loudness(w, ["programme"]).withColumn("lufs", F.round("lufs", 6))


@query(f"""WITH {_TRACK}, x AS (SELECT user_id, pos, avg(value * value) OVER (PARTITION BY user_id ORDER BY pos ROWS 14 PRECEDING) AS m, count(*) OVER (PARTITION BY user_id ORDER BY pos ROWS 14 PRECEDING) AS n, abs(value) AS v FROM t)
SELECT user_id, pos, round(20 * log10(greatest(v, 1e-10)), 6) AS peak_db, round(CASE WHEN n = 15 THEN 10 * log10(greatest(m, 1e-20)) END, 6) AS power_db FROM x""")
def q_level_detector(t: Tables) -> DataFrame:
    d = op.level_db(_track(t), ["user_id"], "pos", "value", 15)
    return d.select("user_id", "pos", F.round("peak_db", 6).alias("peak_db"), F.round("power_db", 6).alias("power_db"))


@query(f"""WITH {_TRACK} SELECT user_id, pos, min(value) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS low,
  round(avg(value) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM t""")
def q_running(t: Tables) -> DataFrame:
    d = neighbours(_track(t), ["user_id"], "pos", 2, 4, low=op.running_min("value", 5), smooth=op.box("value", 2))
    return d.select("user_id", "pos", "low", F.round("smooth", 6).alias("smooth"))


@query("""
WITH x AS (SELECT l_orderkey, l_discount - 0.05 AS v, CASE WHEN l_tax > 0.07 THEN 0.0 ELSE power(10.0, -l_quantity / 20) END AS g, (l_linenumber / 8.0 - 0.5 + 1) * pi() / 4 AS a, l_tax > 0.07 AS m FROM lineitem)
SELECT l_orderkey, round(greatest(-1, least(1, sum(v * g * cos(a) * sqrt(2)) / sqrt(greatest(count(*) FILTER (WHERE NOT m), 1)))), 6) AS "left",
  round(greatest(-1, least(1, sum(v * g * sin(a) * sqrt(2)) / sqrt(greatest(count(*) FILTER (WHERE NOT m), 1)))), 6) AS "right", count(*) FILTER (WHERE NOT m) AS sounding FROM x GROUP BY 1""")
def q_mixdown(t: Tables) -> DataFrame:
    d = op.mixdown(t.lineitem, ["l_orderkey"], F.col("l_discount") - 0.05, -F.col("l_quantity"), F.col("l_linenumber") / 8.0 - 0.5, F.col("l_tax") > 0.07)
    return d.select("l_orderkey", F.round("left", 6).alias("left"), F.round("right", 6).alias("right"), "sounding")


@query("SELECT event_id, round(CASE WHEN o <= -3 THEN 0.0 WHEN o < 3 THEN -0.75 * (o + 3) * (o + 3) / 12 ELSE -0.75 * o END, 6) AS gain_db FROM (SELECT event_id, 20 * log10(greatest(value, 1e-9) / 400) + 30 AS o FROM events)")
def q_compressor(t: Tables) -> DataFrame:
    level = 20 * F.log10(F.greatest("value", F.lit(1e-9)) / 400)
    return t.events.select("event_id", F.round(audio.compressor_gain(level, -30.0, 4.0, 6.0), 6).alias("gain_db"))


_STEP = "CASE WHEN {t} < {g} THEN 0.3 ELSE 0.9 END"
_BENT = "CASE WHEN o <= -3 THEN 0.0 WHEN o < 3 THEN -0.75 * (o + 3) * (o + 3) / 12 ELSE -0.75 * o END"


@query(f"""WITH RECURSIVE {_TRACK}, x AS (SELECT user_id, pos, {_BENT} AS c FROM (SELECT user_id, pos, 20 * log10(value / 400) + 30 AS o FROM t)),
r AS (SELECT user_id, pos, c + (0.0 - c) * {_STEP.format(t="c", g="0.0")} AS g FROM x WHERE pos = 0 UNION ALL SELECT x.user_id, x.pos, c + (g - c) * {_STEP.format(t="c", g="g")} FROM r JOIN x ON x.user_id = r.user_id AND x.pos = r.pos + 1)
SELECT user_id, pos, round(g, 6) AS gain_db FROM r""")
def q_dynamics(t: Tables) -> DataFrame:
    d = _track(t).withColumn("target", audio.compressor_gain(audio.gain_to_db(F.col("value") / 400), -30.0, 4.0, 6.0))
    return op.smoothed_gain(d, ["user_id"], "pos", "target", 0.3, 0.9).select("user_id", "pos", F.round("gain_db", 6).alias("gain_db"))


@query(f"""WITH RECURSIVE {_TRACK}, r AS (SELECT user_id, pos, value >= 50 AS up, CASE WHEN value >= 50 THEN 2 ELSE 0 END AS held FROM t WHERE pos = 0
UNION ALL SELECT t.user_id, t.pos, CASE WHEN t.value >= 50 THEN true WHEN up AND t.value < 30 THEN held > 0 ELSE up END, CASE WHEN t.value >= 50 THEN 2 WHEN up AND t.value < 30 THEN greatest(held - 1, 0) ELSE held END FROM r JOIN t ON t.user_id = r.user_id AND t.pos = r.pos + 1)
SELECT user_id, pos, CAST(up AS BIGINT) AS open FROM r""")
def q_gate(t: Tables) -> DataFrame:
    return op.gated(_track(t), ["user_id"], "pos", "value", 50.0, 20.0, 2).select("user_id", "pos", "open")


@query("""
WITH RECURSIVE e AS (SELECT event_type, event_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS start, CAST(epoch_us(ts) // 1000000 AS BIGINT) + 60 + CAST(floor(value) AS BIGINT) AS stop, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000000, event_id) AS k FROM events),
r AS (SELECT event_type, event_id, start, stop, k, CAST(0 AS BIGINT) AS lane, [stop] AS ends FROM e WHERE k = 1
UNION ALL SELECT event_type, event_id, start, stop, k, lane, list_concat(list_concat(ends[1:lane], [stop]), ends[lane + 2:]) FROM (
  SELECT e.event_type, e.event_id, e.start, e.stop, e.k, r.ends, CAST(coalesce(nullif(list_position(list_transform(r.ends, lambda x: x <= e.start), true), 0), len(r.ends) + 1) - 1 AS BIGINT) AS lane FROM r JOIN e ON e.event_type = r.event_type AND e.k = r.k + 1))
SELECT event_type, event_id, start, stop AS "end", lane FROM r""")
def q_lanes(t: Tables) -> DataFrame:
    d = t.events.select("event_type", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("start"), (F.unix_seconds(F.col("ts").cast("timestamp")) + 60 + F.floor("value")).alias("end"))
    return op.lanes(d, ["event_type"], "start", "end", "event_id")


@query("SELECT event_id, round(least(1, greatest(0, (20 * log10(greatest(value / 400, 1e-9)) + 60) / 60)), 6) AS level, round(CASE WHEN -value < -60.05 THEN 0 ELSE power(10, -value / 20) END, 9) AS gain FROM events")
def q_levels(t: Tables) -> DataFrame:
    v = F.col("value")
    return t.events.select("event_id", F.round(audio.level(v / 400), 6).alias("level"), F.round(audio.db_to_gain(-v), 9).alias("gain"))


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def q_latest(t: Tables) -> DataFrame:
    return ingest.latest(t.events.select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("SELECT event_type, epoch_us(ts) // 3600000000 AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def q_stream_windows(t: Tables) -> DataFrame:
    w = ingest.windowed(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "1 hour")
    return w.select("event_type", F.floor(F.unix_seconds("start") / 3600).cast("long").alias("hour"), "n", F.round("total", 4).alias("total"))


@query("""
WITH e AS (SELECT user_id, epoch_us(ts) AS pos FROM events), b AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY user_id ORDER BY pos) < 3600000000 THEN 0 ELSE 1 END AS fresh FROM e),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY pos) AS k FROM b)
SELECT user_id, min(pos) AS start_us, count(*) AS n FROM s GROUP BY user_id, k""")
def q_stream_sessions(t: Tables) -> DataFrame:
    s = ingest.sessions(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["user_id"], "1 hour")
    return s.select("user_id", F.unix_micros("start").alias("start_us"), "n")


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def q_stream_ingest(t: Tables) -> DataFrame:
    from reelspark.session import checkpoint_dir

    schema = t.events.schema
    out = f"{checkpoint_dir(t.spark)}/ingest-{uuid.uuid4().hex}"
    stream = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t._dir)
    ingest.upsert_stream(stream, f"{out}/rows", ["user_id", "event_type"], ["ts", "event_id"], f"{out}/checkpoint").awaitTermination()
    return ingest.current(t.spark, f"{out}/rows", ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("SELECT user_id, event_type, event_id, generation, value FROM (SELECT *, CAST(floor(value / 50) AS BIGINT) AS generation, row_number() OVER (PARTITION BY user_id, event_type ORDER BY floor(value / 50) DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def q_stream_results(t: Tables) -> DataFrame:
    """All events as results of generations, in files that come in two turns; the stream is begun again for the second one."""
    from reelspark.session import checkpoint_dir

    out = f"{checkpoint_dir(t.spark)}/results-{uuid.uuid4().hex}"
    d = t.events.select("user_id", "event_type", "event_id", F.floor(F.col("value") / 50).cast("long").alias("generation"), "value")
    before = t.spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.PROVIDER)
    try:
        for turn in (0, 1):
            d.where(F.col("event_id") % 2 == turn).write.mode("append").parquet(f"{out}/in")
            stream = ingest.file_stream(t.spark, f"{out}/in", d.schema, 4)
            state.write_results(state.latest_results(stream, ["user_id", "event_type"], ["generation", "event_id"]), f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    finally:
        t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return state.current_results(t.spark, f"{out}/rows", ["user_id", "event_type"], ["generation", "event_id"]).select("user_id", "event_type", "event_id", "generation", "value")


@query("""
WITH x AS (SELECT l_orderkey AS take, l_linenumber AS channel, CASE WHEN -l_quantity < -60.05 THEN 0 ELSE power(10.0, -l_quantity / 20) END AS g, (l_linenumber / 8.0 - 0.5 + 1) * pi() / 4 AS a, l_tax > 0.07 AS mute, l_discount > 0.09 AS solo FROM lineitem),
y AS (SELECT *, NOT mute AND (NOT bool_or(solo) OVER (PARTITION BY take) OR solo) AS sounds FROM x),
z AS (SELECT *, CASE WHEN sounds THEN g ELSE 0 END / sqrt(greatest(count(*) FILTER (WHERE sounds) OVER (PARTITION BY take), 1)) AS v FROM y)
SELECT take, channel, round(v * cos(a) * sqrt(2), 6) AS "left", round(v * sin(a) * sqrt(2), 6) AS "right" FROM z""")
def q_mixer_matrix(t: Tables) -> DataFrame:
    from reelspark.operators import mixer

    d = t.lineitem.select(F.col("l_orderkey").alias("take"), F.lit(0.0).alias("master"), F.col("l_linenumber").alias("channel"), (-F.col("l_quantity")).alias("gain_db"), (F.col("l_linenumber") / 8.0 - 0.5).alias("pan"), (F.col("l_tax") > 0.07).alias("mute"), (F.col("l_discount") > 0.09).alias("solo"), F.lit(False).alias("link"))
    return mixer.matrix(d, "take").select("take", "channel", F.round("left", 6).alias("left"), F.round("right", 6).alias("right"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_and(l_tax <= 0.07))")
def q_to_fix(t: Tables) -> DataFrame:
    from reelspark.plans import files

    verdicts = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_tax") <= 0.07).alias("ok"))
    return files.to_fix(t.orders.select("o_orderkey"), verdicts, "o_orderkey")
