"""Joins: semi, anti, interval, as-of, tolerance, prefix and plans of copies."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.operators import catalog, dedupe
from reelspark.operators import joins as op
from reelspark.queries import Tables, query
from reelspark.queries.rows import _URL, _url_path


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')")
def q_in_library(t: Tables) -> DataFrame:
    library = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return dedupe.in_library(t.orders.select("o_orderkey", "o_custkey"), library, ["o_orderkey"])


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def q_stale(t: Tables) -> DataFrame:
    return op.removed_rows(t.orders.select("o_orderkey", "o_custkey"), t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("""
SELECT a.l_orderkey, CAST(a.l_linenumber * 1000000 + a.l_partkey AS BIGINT) AS line, CAST(b.l_linenumber * 1000000 + b.l_partkey AS BIGINT) AS member
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber * 1000000 + a.l_partkey <> b.l_linenumber * 1000000 + b.l_partkey""")
def q_family(t: Tables) -> DataFrame:
    d = t.lineitem.select("l_orderkey", (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).cast("long").alias("line"))
    return catalog.family_members(d, "line", ["l_orderkey"])


_DAYS = "CAST(epoch_us(date_trunc('day', ts)) // 1000000 AS BIGINT)"
_MATCH = f"""
WITH e AS (SELECT event_id, user_id, event_type, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS s, CAST(1 + floor(value) AS BIGINT) AS n FROM events),
m AS (SELECT c.event_id AS clip, o.event_id AS take, o.user_id AS channels, least(c.s + c.n, o.s + o.n) - greatest(c.s, o.s) AS overlap
  FROM e c JOIN e o ON c.event_type = 'view' AND o.event_type <> 'view' AND c.s < o.s + o.n AND o.s < c.s + c.n)
SELECT clip, take, overlap, row_number() OVER (PARTITION BY clip ORDER BY overlap DESC, channels DESC, take) = 1 AS chosen FROM m"""


@query(_MATCH)
def q_interval_match(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "user_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"), (F.floor("value") + 1).cast("long").alias("n"))
    clips = e.where("event_type = 'view'").select(F.col("event_id").alias("clip"), F.col("s").alias("c_s"), (F.col("s") + F.col("n")).alias("c_e"))
    takes = e.where("event_type <> 'view'").select(F.col("event_id").alias("take"), F.col("user_id").alias("channels"), F.col("s").alias("t_s"), (F.col("s") + F.col("n")).alias("t_e"))
    meet = lambda c, t: op.interval_join(c, t, ("c_s", "t_s"), ("c_e", "t_e")).withColumn("overlap", F.least("c_e", "t_e") - F.greatest("c_s", "t_s"))
    return op.with_chosen(clips, takes, meet, ["clip"], [F.col("channels").desc(), F.col("take")], F.col("t_e") - F.col("t_s")).select("clip", "take", "overlap", "chosen")


@query(f"SELECT clip, take, overlap FROM ({_MATCH}) WHERE chosen")
def q_best_take(t: Tables) -> DataFrame:
    return q_interval_match(t).where("chosen").drop("chosen")


@query("""
WITH e AS (SELECT event_id, event_type, CAST(epoch_us(ts) // 1000000 % 86400 AS BIGINT) AS s, CAST(1 + floor(value) AS BIGINT) AS n, CAST(ts AS DATE) AS d, user_id FROM events),
x AS (SELECT c.event_id AS clip, o.event_id AS take, o.user_id, c.s AS cs, c.n AS cn, o.n AS tn,
    CASE WHEN abs(o.s - 86400 - c.s) <= abs(o.s - c.s) AND abs(o.s - 86400 - c.s) <= abs(o.s + 86400 - c.s) THEN o.s - 86400 WHEN abs(o.s - c.s) <= abs(o.s + 86400 - c.s) THEN o.s ELSE o.s + 86400 END AS ts
  FROM e c JOIN e o ON c.event_type = 'view' AND o.event_type = 'error' AND abs(date_diff('day', c.d, o.d)) <= 1),
y AS (SELECT *, least(cs + cn, ts + tn) - greatest(cs, ts) AS overlap FROM x)
SELECT clip, take, overlap, row_number() OVER (PARTITION BY clip ORDER BY overlap DESC, user_id DESC, take) = 1 AS chosen FROM y WHERE overlap > 0""")
def q_clip_match_days(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "user_id", "event_type", (F.unix_seconds(F.col("ts").cast("timestamp")) % 86400).alias("s"), (F.floor("value") + 1).cast("long").alias("n"), F.to_date("ts").alias("d"))
    clips = e.where("event_type = 'view'").select(F.col("event_id").alias("clip"), F.col("s").alias("c_start"), F.col("n").alias("c_len"), F.lit(86400).cast("long").alias("c_day"), F.col("d").alias("c_date"))
    takes = e.where("event_type = 'error'").select(F.col("event_id").alias("take"), F.col("s").alias("t_start"), F.col("n").alias("t_len"), F.col("user_id").alias("t_channels"), F.col("event_id").alias("t_seq"), F.col("d").alias("t_date"))
    return op.match_clips(takes, clips).select("clip", "take", "overlap", "chosen")


_ASOF = """
WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT event_id AS view_id, user_id, ts, value FROM events WHERE event_type = 'view')
SELECT p.event_id, p.ts, (SELECT max_by(view_id, v.ts) FROM v WHERE v.user_id = p.user_id AND v.ts <= p.ts) AS prev_id, (SELECT min_by(view_id, v.ts) FROM v WHERE v.user_id = p.user_id AND v.ts > p.ts) AS next_id,
  (SELECT max(v.ts) FROM v WHERE v.user_id = p.user_id AND v.ts <= p.ts) AS t0, (SELECT min(v.ts) FROM v WHERE v.user_id = p.user_id AND v.ts > p.ts) AS t1,
  (SELECT max_by(value, v.ts) FROM v WHERE v.user_id = p.user_id AND v.ts <= p.ts) AS v0, (SELECT min_by(value, v.ts) FROM v WHERE v.user_id = p.user_id AND v.ts > p.ts) AS v1
FROM p"""


def _asof(t: Tables) -> DataFrame:
    e = t.events.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    views = e.where("event_type = 'view'").select("user_id", "at", F.col("event_id").alias("id"), F.col("at").alias("time"), "value")
    return op.asof(e.where("event_type = 'purchase'").select("user_id", "at", "event_id"), views, ["user_id"], "at", ["id", "time", "value"], width=86_400_000_000)


@query(f"SELECT event_id, prev_id, next_id FROM ({_ASOF})")
def q_asof_marker(t: Tables) -> DataFrame:
    return _asof(t).select("event_id", "prev_id", "next_id")


@query(f"""
SELECT event_id, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * CAST(epoch_us(ts) - epoch_us(t0) AS DOUBLE) / CAST(epoch_us(t1) - epoch_us(t0) AS DOUBLE) END, 4) AS value FROM ({_ASOF})""")
def q_automation(t: Tables) -> DataFrame:
    c = F.col
    return _asof(t).select("event_id", F.round(op.lane_value(c("at"), c("prev_time"), c("prev_value"), c("next_time"), c("next_value")), 4).alias("value"))


@query("""
WITH s AS (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1)
SELECT o_orderkey, o_totalprice, total FROM orders JOIN s ON o_orderkey = l_orderkey AND abs(o_totalprice - total) <= 5000.0""")
def q_tolerance_join(t: Tables) -> DataFrame:
    sums = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_extendedprice"), 2).alias("total"))
    return op.tolerance_join(t.orders.select("o_orderkey", "o_totalprice"), sums, ["o_orderkey"], "o_totalprice", "total", 5000.0)


@query("""
WITH s AS (SELECT doc_id AS seq, lang || '/' || CAST(doc_id % 700 AS VARCHAR) AS dst, n_chars AS size, CAST(doc_id AS DOUBLE) AS mtime FROM documents),
x AS (SELECT lang || '/' || CAST(doc_id AS VARCHAR) AS dst, CASE WHEN doc_id % 5 = 0 THEN n_chars + 1 ELSE n_chars END AS e_size, CAST(doc_id AS DOUBLE) + CASE WHEN doc_id % 3 = 0 THEN 2.5 ELSE 1.0 END AS e_mtime FROM documents WHERE n_chars > 400)
SELECT seq, dst, CASE WHEN row_number() OVER (PARTITION BY dst ORDER BY seq) > 1 THEN 'conflict' WHEN e_size IS NULL THEN 'new' WHEN size = e_size AND abs(mtime - e_mtime) < 2.1 THEN 'same' ELSE 'conflict' END AS status
FROM s LEFT JOIN x USING (dst)""")
def q_copy_plan(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "lang", "n_chars")
    name = lambda k: F.concat_ws("/", "lang", k.cast("string"))
    source = d.select(F.col("doc_id").alias("seq"), name(F.col("doc_id") % 700).alias("dst"), F.col("n_chars").alias("size"), F.col("doc_id").cast("double").alias("mtime"))
    there = d.where("n_chars > 400").select(name(F.col("doc_id")).alias("dst"), (F.col("n_chars") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).alias("e_size"), (F.col("doc_id") + F.when(F.col("doc_id") % 3 == 0, 2.5).otherwise(1.0)).alias("e_mtime"))
    return op.copy_plan(source, there).select("seq", "dst", "status")


@query(f"""
WITH p AS (SELECT page_id, string_split(regexp_replace({_URL}, '/$', ''), '/') AS parts FROM pages)
SELECT folder, count(*) AS files FROM (SELECT page_id, array_to_string(parts[1:k], '/') AS folder FROM p, LATERAL unnest(range(1, len(parts) + 1)) AS u(k)) GROUP BY folder HAVING count(*) > 1""")
def q_ancestors(t: Tables) -> DataFrame:
    from reelspark.functions.paths import ancestors

    p = t.pages.select("page_id", F.regexp_replace(_url_path(F.col("url")), "/$", "").alias("path"))
    return p.select("page_id", F.explode(ancestors(F.col("path"))).alias("folder")).groupBy("folder").agg(F.count("*").alias("files")).where("files > 1")


@query(f"""
WITH p AS (SELECT DISTINCT regexp_replace({_URL}, '/$', '') AS path FROM pages)
SELECT path, CASE WHEN starts_with(path, 'www.') AND contains(path, '/en/') THEN 'moved/' || substr(path, strpos(path, '/en/') + 4) ELSE path END AS translated FROM p""")
def q_translate(t: Tables) -> DataFrame:
    p = t.pages.select(F.regexp_replace(_url_path(F.col("url")), "/$", "").alias("path")).distinct()
    mapping = p.where(F.startswith(F.col("path"), F.lit("www.")) & F.col("path").contains("/en/")).select(F.regexp_extract("path", "^([^/]*/en)/", 1).alias("old"), F.lit("moved").alias("new")).distinct().withColumn("seq", F.lit(1))
    return op.translate_paths(p, mapping)


@query("""
WITH c AS (SELECT doc_id AS file, lang, source, n_chars, md5(text) AS digest FROM documents),
k AS (SELECT c.file, c.digest, d.file AS dst, d.digest AS c_digest FROM c LEFT JOIN c d ON d.lang = c.lang AND d.n_chars = c.n_chars AND d.file <> c.file),
r AS (SELECT *, coalesce(digest = c_digest, false) AS eq, row_number() OVER (PARTITION BY file ORDER BY coalesce(digest = c_digest, false) DESC, dst) AS n FROM k)
SELECT file, CASE WHEN eq THEN CAST(dst AS VARCHAR) END AS dst, CASE WHEN eq THEN 'verified' WHEN c_digest IS NOT NULL THEN 'different' ELSE 'new' END AS status FROM r WHERE n = 1""")
def q_backup_verify(t: Tables) -> DataFrame:
    d = t.documents.select(F.col("doc_id").alias("file"), "lang", "n_chars", F.md5(F.col("text").cast("binary")).alias("digest"))
    there = d.select(F.col("file").alias("priority"), "lang", "n_chars", F.col("file").cast("string").alias("dst"), F.col("digest").alias("c_digest"))
    near = d.select("file", "lang", "n_chars").join(there, ["lang", "n_chars"]).where("file <> priority").select("file", "priority", "dst", "c_digest")
    return op.verified_backup(d.select("file", "digest"), near)
