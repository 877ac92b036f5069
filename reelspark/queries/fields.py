"""Flags, names, codes, choices and plans over the rows of the driver's tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.functions import audio, effects, names, timecode
from reelspark.operators import catalog, dedupe, mixer
from reelspark.plans import files, moves
from reelspark.queries import Tables, query
from reelspark.sources import cards, report, store, waveforms
from reelspark.streaming import ingest


def _one_of(key, *values: str):
    """One of the values, by the key."""
    return F.get(F.array(*(F.lit(v) for v in values)), (key % len(values)).cast("int"))


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_SPEEDS = ("29.97DF", "29.97D", "29.97-ND", "29.97NDF", "df", "DF", "25", "030.00-DF", "24 D", "DFX", "d", "", "23.976-nd")


@query(f"""
WITH t AS (SELECT p_partkey, {_list(_SPEEDS)}[p_partkey % {len(_SPEEDS)} + 1] AS speed FROM part), r AS (SELECT *, regexp_extract_all(upper(speed), '[A-Z]+|[^A-Z]+') AS runs FROM t)
SELECT p_partkey, speed, len(list_filter(runs, lambda r, i: ends_with(r, 'DF') AND NOT ends_with(r, 'NDF') AND (i = len(runs) OR NOT regexp_matches(runs[i + 1], '^[0-9_]')))) > 0
  OR coalesce(len(runs) > 1 AND runs[-1] = 'D' AND right(runs[-2], 1) IN ('0', '1', '2', '3', '4', '5', '6', '7', '8', '9', '.', '-', ' '), false) AS drops FROM r""")
def q_drop_flags(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", _one_of(F.col("p_partkey"), *_SPEEDS).alias("speed")).withColumn("drops", timecode.parse_drop_frame(F.col("speed")))


_CODES = ("01:02:03:04", "1:02:03:04", "01:2:03:04", "01:02:03:004", "23;59;59;29", "10.20.30,11", "10,20:30:11", " 00:10:00:00 ", "00:01:00;02", "abc", "")


@query(f"""
WITH t AS (SELECT p_partkey, {_list(_CODES)}[p_partkey % {len(_CODES)} + 1] AS code FROM part),
m AS (SELECT *, string_split(translate(trim(code), ';.', '::'), ':') AS c FROM t),
f AS (SELECT p_partkey, code, CASE WHEN len(string_split(c[-1], ',')) = 2 THEN list_concat(c[:-2], string_split(c[-1], ',')) ELSE c END AS c FROM m),
x AS (SELECT p_partkey, code, CASE WHEN len(c) = 4 AND length(c[1]) IN (1, 2) AND length(c[2]) = 2 AND length(c[3]) = 2 AND length(c[4]) = 2 THEN list_transform(c, lambda p: try_cast(p AS BIGINT)) END AS c FROM f),
n AS (SELECT p_partkey, code, c[1] * 60 + c[2] AS minutes, c[3] AS s, c[4] AS f FROM x)
SELECT p_partkey, code, (minutes * 60 + s) * 25 + f AS plain, (minutes * 60 + s) * 30 + f - 2 * (minutes - minutes // 10) AS dropped FROM n""")
def q_tc_strict(t: Tables) -> DataFrame:
    d = t.part.select("p_partkey", _one_of(F.col("p_partkey"), *_CODES).alias("code"))
    return d.select("*", timecode.tc_to_frames(F.col("code"), 25).alias("plain"), timecode.tc_to_frames(F.col("code"), 30, True).alias("dropped"))


@query("""
WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN '' ELSE NULL END AS date, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS tape FROM part)
SELECT p_partkey, CASE WHEN coalesce(date, '') <> '' THEN date WHEN tape <> '' THEN tape ELSE '' END AS day FROM t""")
def q_day_of(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    date = F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, "")
    return t.part.select("p_partkey", timecode.day_of(date, F.when(k % 2 == 0, F.col("p_brand")).otherwise("")).alias("day"))


_NAMES = ("ok.wav", " ", ".", "..", "a/b", "a:b", "end.", "end ", "con.wav", "LPT9", "what?", "fine name.wav", "x" * 256, "tab\tname", "nul")


@query(f"""
WITH t AS (SELECT p_partkey, {_list(_NAMES)}[p_partkey % {len(_NAMES)} + 1] AS name FROM part)
SELECT p_partkey, CASE WHEN trim(name) = '' THEN 'blank' WHEN name IN ('.', '..') THEN 'dots' WHEN contains(name, '/') THEN 'slash' WHEN strlen(name) > 255 THEN 'too long'
  WHEN regexp_matches(name, '[\\\\:*?"<>|\\x01-\\x1f]') THEN 'unsafe character' WHEN regexp_matches(name, '[. ]$') THEN 'dot or blank at the end'
  WHEN regexp_matches(regexp_replace(upper(name), '[.][^.]*$', ''), '^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$') THEN 'reserved' END AS problem FROM t""")
def q_name_problems(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", names.name_problem(_one_of(F.col("p_partkey"), *_NAMES)).alias("problem"))


_TAKES = """SELECT p_partkey, p_size AS n, p_name || CASE WHEN p_partkey % 2 = 0 THEN '-T' ELSE 'T' END || lpad(CAST(p_size AS VARCHAR), 2, '0') || ['_ISO', '', '_LR'][p_partkey % 3 + 1] || '.wav' AS name, p_name FROM part"""


def _takes(t: Tables) -> DataFrame:
    name = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, "-T").otherwise("T"), F.lpad(F.col("p_size").cast("string"), 2, "0"), _one_of(F.col("p_partkey"), "_ISO", "", "_LR"), F.lit(".wav"))
    return t.part.select("p_partkey", name.alias("name"))


@query(f"""
SELECT p_partkey, name, p_name AS scene, lpad(CAST(n AS VARCHAR), 2, '0') AS take, ['_ISO', '', '_LR'][p_partkey % 3 + 1] AS ending, p_partkey % 3 <> 1 AS is_take_file,
  '9A' || CASE WHEN p_partkey % 2 = 0 THEN '-T' ELSE 'T' END || '07' || ['_ISO', '', '_LR'][p_partkey % 3 + 1] || '.wav' AS renamed FROM ({_TAKES})""")
def q_take_names(t: Tables) -> DataFrame:
    p = names.take_parts(F.col("name"))
    return _takes(t).select("p_partkey", "name", p["scene"].alias("scene"), p["take"].alias("take"), p["ending"].alias("ending"), names.is_take_file(F.col("name")).alias("is_take_file"), names.renamed_take(F.col("name"), F.lit("9A"), F.lit("7")).alias("renamed"))


_RECORDERS = ("SoundDev: 833 WS123", "SoundDev 888", "Zoom F8", "", "MixPre")


@query(f"""
WITH t AS (SELECT p_partkey, {_list(_RECORDERS)}[p_partkey % 5 + 1] AS r FROM part)
SELECT p_partkey, CASE WHEN starts_with(r, 'SoundDev') THEN 'Sound Devices ' || string_split(regexp_replace(r, '^SoundDev:?\\s*', ''), ' ')[1] WHEN r = '' THEN 'Unknown recorder' ELSE r END AS label FROM t""")
def q_recorder_labels(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", names.recorder_label(_one_of(F.col("p_partkey"), *_RECORDERS)).alias("label"))


@query("""
WITH t AS (SELECT p_partkey, (p_partkey % 161 - 80) / 10.0 * 8 AS db, CAST(p_partkey % 41 - 20 AS INT) AS share FROM part)
SELECT p_partkey, CASE WHEN db <= -60.05 THEN '-inf' WHEN abs(db) < 0.05 THEN '0.0 dB' ELSE printf('%+.1f dB', db) END AS level,
  CASE WHEN share = 0 THEN 'C' WHEN share < 0 THEN 'L' || CAST(-share * 5 AS VARCHAR) ELSE 'R' || CAST(share * 5 AS VARCHAR) END AS pan FROM t""")
def q_level_labels(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    return t.part.select("p_partkey", names.format_db((k % 161 - 80) / 10.0 * 8).alias("level"), names.format_pan((k % 41 - 20) / 20.0).alias("pan"))


@query("""
WITH t AS (SELECT page_id, html AS h, regexp_replace(url, '[?#].*$', '') || ' ä+~*' AS u FROM pages)
SELECT page_id, replace(replace(replace(replace(replace(h, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped,
  replace(replace(replace(url_encode(u), '%2F', '/'), '%3A', ':'), '*', '%2A') AS quoted FROM t""")
def q_escapes(t: Tables) -> DataFrame:
    url = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit(" ä+~*"))
    return t.pages.select("page_id", names.html_escaped(F.col("html")).alias("escaped"), names.url_quoted(url).alias("quoted"))


@query("SELECT doc_id, nfc_normalize(replace(text, 'a', 'a' || chr(776))) AS text FROM documents")
def q_unicode(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", names.nfc(F.replace("text", F.lit("a"), F.lit("ä"))).alias("text"))


@query("SELECT p_partkey, replace(p_brand || '\\' || p_type || '/' || p_name, '\\', '/') AS path FROM part")
def q_forward_paths(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", names.forward(F.concat("p_brand", F.lit("\\"), "p_type", F.lit("/"), "p_name")).alias("path"))


@query("""
SELECT c_custkey, c_name AS scene, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'first' END AS note, CAST(2 + c_custkey % 2 AS INT) AS keys FROM customer""")
def q_descriptions(t: Tables) -> DataFrame:
    text = F.concat(F.lit("free text\r\nsSCENE="), "c_name", F.lit("\r\nzNOTE="), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(F.concat(F.lit("first\r\nzNOTE="), "c_mktsegment", F.lit("\nsSPEED=25"))), F.lit("\nBAD=x"))
    m = t.customer.select("c_custkey", names.description_map(text).alias("m"))
    return m.select("c_custkey", F.col("m")["SCENE"].alias("scene"), F.col("m")["NOTE"].alias("note"), F.size("m").alias("keys"))


@query("""
WITH t AS (SELECT conv_id, list(CASE WHEN turn % 2 = 0 THEN 'Mix L' ELSE 'mix r' END ORDER BY turn, role) AS tracks FROM conversations GROUP BY 1)
SELECT conv_id, len(tracks) = 2 AND (conv_id % 3 = 0 OR (lower(tracks[1]) = 'mix l' AND lower(tracks[2]) = 'mix r')) AS stereo FROM t""")
def q_stereo(t: Tables) -> DataFrame:
    tracks = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.when(x["turn"] % 2 == 0, "Mix L").otherwise("mix r"))
    d = t.conversations.groupBy("conv_id").agg(tracks.alias("tracks"))
    return d.select("conv_id", names.looks_stereo(F.col("tracks"), F.when(F.col("conv_id") % 3 == 0, "x_LR.wav").otherwise("x.wav")).alias("stereo"))


@query("""
WITH p AS (SELECT *, p_partkey % 3 = 0 OR p_partkey % 5 = 0 AS noted FROM part)
SELECT a.p_partkey AS a, b.p_partkey AS b, a.noted AND NOT b.noted AS adds, a.p_partkey % 2 <> b.p_partkey % 2 AND a.p_size = b.p_size AND a.p_partkey % 7 > 0 AND b.p_partkey % 7 > 0 AS more
FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_name = b.p_name AND a.p_partkey <> b.p_partkey""")
def q_better_copies(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    d = {"name": F.col("p_name"), "note": F.when(k % 3 == 0, "n").otherwise(""), "circled": k % 5 == 0, "scene": F.col("p_brand"), "take": F.lit("1"), "tape": F.lit(""), "project": F.col("p_type"), "date": F.lit("")}
    d |= {"frames": F.col("p_size"), "sample_rate": F.lit(1), "bits": F.lit(24), "float_samples": F.lit(False), "time_reference": F.when(k % 7 > 0, F.lit(0)), "channels": k % 2, "error": F.lit("")}
    return dedupe.better_copies(t.part, "p_partkey", ["p_brand", "p_name"], d)


@query("""
WITH f AS (SELECT lang, CASE WHEN doc_id % 3 = 0 THEN 'dump/' || source WHEN doc_id % 3 = 1 THEN source ELSE 'lib/deep/' || source END AS folder FROM documents), c AS (SELECT lang, folder, count(*) AS files FROM f GROUP BY 1, 2)
SELECT lang, folder, files, row_number() OVER (PARTITION BY lang ORDER BY starts_with(folder, 'dump/'), files DESC, length(folder) - length(replace(folder, '/', '')), folder) AS rank FROM c""")
def q_keep_folder(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    folder = F.when(k % 3 == 0, F.concat(F.lit("dump/"), "source")).when(k % 3 == 1, F.col("source")).otherwise(F.concat(F.lit("lib/deep/"), "source"))
    return dedupe.keep_folders(t.documents.select("lang", folder.alias("folder")), ["lang"], "folder", ["Dump"])


@query("""
WITH f AS (SELECT p_type, p_name, count(*) AS n FROM part GROUP BY 1, 2),
d AS (SELECT DISTINCT p_type, upper(p_name) AS folder FROM part WHERE p_brand = 'Brand#1')
SELECT p_type, name FROM (SELECT f.p_type, f.p_name AS name, row_number() OVER (PARTITION BY f.p_type ORDER BY n DESC, (d.folder IS NOT NULL) DESC, length(p_name) - length(replace(p_name, ' ', '')) DESC, p_name DESC) AS k
  FROM f LEFT JOIN d ON d.p_type = f.p_type AND lower(d.folder) = lower(f.p_name)) WHERE k = 1""")
def q_project_name(t: Tables) -> DataFrame:
    folder = F.when(F.col("p_brand") == "Brand#1", F.concat(F.lit("lib/"), F.upper("p_name"), F.lit("/"))).otherwise("lib/other/")
    return dedupe.project_name(t.part.select("p_type", "p_name", folder.alias("folder")), ["p_type"], "p_name", "folder")


@query("SELECT page_id, row_number() OVER (ORDER BY lower(url), page_id) AS position FROM pages")
def q_clip_order(t: Tables) -> DataFrame:
    return catalog.positions(t.pages.select("page_id", "url"), names.clip_order(F.col("url")), F.col("page_id")).select("page_id", "position")


@query("SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS path FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 5000")
def q_preview(t: Tables) -> DataFrame:
    return moves.preview(t.orders.select("o_orderkey", F.col("o_orderkey").cast("string").alias("path"), "o_totalprice"), "o_totalprice", "o_orderkey").drop("o_totalprice")


@query("""
SELECT DISTINCT path FROM (SELECT source || '/' || CAST(doc_id % 50 AS VARCHAR) AS path FROM documents UNION ALL SELECT lang || '/' || CAST(n_chars % 90 AS VARCHAR) FROM documents UNION ALL SELECT source FROM documents)""")
def q_touched_paths(t: Tables) -> DataFrame:
    d = t.documents
    plan = d.select(F.concat("source", F.lit("/"), (F.col("doc_id") % 50).cast("string")).alias("path"), F.concat("lang", F.lit("/"), (F.col("n_chars") % 90).cast("string")).alias("dst"))
    return moves.touched_paths(plan, d.select(F.col("source").alias("path"), F.lit("").alias("target")))


@query("SELECT p_partkey, CAST(ceil((25 + 4 * p_size * p_partkey) / 4096.0) AS BIGINT) * 4096 AS bytes FROM part")
def q_stored_size(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", waveforms.stored_bytes(F.col("p_size"), F.col("p_partkey")).alias("bytes"))


@query("""
WITH x AS (SELECT l_orderkey AS take, CAST(l_linenumber AS INT) AS channel, -l_quantity AS gain_db, l_discount * 10 - 0.5 AS pan, l_tax > 0.05 AS mute, l_returnflag = 'R' AS solo, l_linestatus = 'F' AS link FROM lineitem),
y AS (SELECT *, lag(gain_db) OVER w AS g, lag(pan) OVER w AS p, lag(mute) OVER w AS m, lag(solo) OVER w AS s, coalesce(lag(link) OVER w, false) AS follows FROM (SELECT DISTINCT ON (take, channel) * FROM x ORDER BY take, channel, gain_db, pan, mute, solo, link) WINDOW w AS (PARTITION BY take ORDER BY channel))
SELECT take, channel, CASE WHEN follows THEN g ELSE gain_db END AS gain_db, round(CASE WHEN follows THEN -p ELSE pan END, 6) AS pan, CASE WHEN follows THEN m ELSE mute END AS mute, CASE WHEN follows THEN s ELSE solo END AS solo FROM y""")
def q_mixer_links(t: Tables) -> DataFrame:
    c = F.col
    d = t.lineitem.select(c("l_orderkey").alias("take"), F.lit(0.0).alias("master"), F.struct(c("l_linenumber").cast("int").alias("channel"), (-c("l_quantity")).alias("gain_db"), (c("l_discount") * 10 - 0.5).alias("pan"), (c("l_tax") > 0.05).alias("mute"), (c("l_returnflag") == "R").alias("solo"), (c("l_linestatus") == "F").alias("link")).alias("s"))
    d = d.groupBy("take", "master", "s.channel").agg(F.min("s").alias("s")).select("take", "master", "s.*")
    again = mixer.parse_mixer(mixer.to_json(d, "take"), "take", "mixer")  # through the settings' JSON and back
    return mixer.linked(again, "take").select("take", "channel", "gain_db", F.round("pan", 6).alias("pan"), "mute", "solo")


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'compressor' ELSE 'gain' END AS type, p_partkey % 4 = 0 AS bypass,
  CASE WHEN p_partkey % 3 = 0 THEN greatest(-60.0, least(0.0, -p_size * 2.0)) ELSE greatest(-60.0, least(36.0, p_size * 1.0)) END AS value,
  CASE WHEN p_partkey % 4 = 0 THEN 'no effect is active' ELSE '' END AS problem FROM part""")
def q_effect_chain(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    kind = F.when(k % 3 == 0, "compressor").otherwise("gain")
    value = F.when(k % 3 == 0, F.concat(F.lit('"threshold": '), (-2 * F.col("p_size")).cast("string"))).otherwise(F.concat(F.lit('"gain": '), F.col("p_size").cast("string")))
    text = F.concat(F.lit('[{"type": "unheard of"}, {"type": "'), kind, F.lit('", "bypass": '), F.when(k % 4 == 0, "true").otherwise("false"), F.lit(', "params": {'), value, F.lit("}}]"))
    chain = effects.parse_chain(text)
    d = t.part.select("p_partkey", chain.alias("c")).withColumn("e", F.get("c", F.lit(0)))
    shown = F.when(F.col("e.type") == "gain", F.col("e.params")["gain"]).otherwise(F.col("e.params")["threshold"])
    return d.select("p_partkey", F.col("e.type").alias("type"), F.col("e.bypass").alias("bypass"), shown.alias("value"), effects.chain_problem(F.col("c")).alias("problem"))


@query("""
WITH x AS (SELECT doc_id, lang || '/' || source || '/' || CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 2 = 0 THEN source || '/x' ELSE lang END AS dst FROM documents)
SELECT doc_id, path = 'en/src1' OR starts_with(path, 'en/src1/') OR dst = 'en/src1' OR path = 'src2' OR starts_with(path, 'src2/') OR dst = 'src2' OR starts_with(dst, 'src2/') AS blocked FROM x""")
def q_guarded(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("path"), F.when(F.col("doc_id") % 2 == 0, F.concat("source", F.lit("/x"))).otherwise(F.col("lang")).alias("dst"))
    return moves.guarded(d, ["en/src1", "src2"]).select("doc_id", "blocked")


@query("""
SELECT conv_id, CASE WHEN conv_id % 7 = 0 THEN 'bad' WHEN conv_id % 5 = 0 THEN 'truncated' WHEN conv_id % 4 < 2 THEN 'one track alone' WHEN n > conv_id % 4 THEN 'more names than tracks' ELSE '' END AS problem
FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)""")
def q_splittable(t: Tables) -> DataFrame:
    k = F.col("conv_id")
    d = t.conversations.groupBy("conv_id").agg(F.collect_list("role").alias("tracks"))
    d = d.select("conv_id", "tracks", F.when(k % 7 == 0, "bad").otherwise("").alias("error"), (k % 5 == 0).alias("truncated"), (k % 4).alias("channels"))
    return d.select("conv_id", files.splittable(d).alias("problem"))


@query("""
WITH x AS (SELECT CASE WHEN doc_id % 3 = 0 THEN '_Removed/' || lang || '/' || source || '/' ELSE lang || '/' END || CAST(doc_id AS VARCHAR) || '.wav' AS path, lang, source, doc_id FROM documents)
SELECT path, lang AS project, source || '/' || CAST(doc_id AS VARCHAR) || '.wav' AS original FROM x WHERE doc_id % 3 = 0""")
def q_removed_items(t: Tables) -> DataFrame:
    head = F.when(F.col("doc_id") % 3 == 0, F.concat(files.removal_path(F.col("source"), F.col("lang")), F.lit("/"))).otherwise(F.concat("lang", F.lit("/")))
    return files.removed_items(t.documents.select(F.concat(head, F.col("doc_id").cast("string"), F.lit(".wav")).alias("path")), "path")


@query("""
WITH f AS (SELECT DISTINCT source || '/' || lang || '/' || CAST(doc_id % 40 AS VARCHAR) AS folder, source, lang FROM documents), filled AS (SELECT DISTINCT source || '/' || lang || '/' || CAST(doc_id % 40 AS VARCHAR) AS folder, source, lang FROM documents WHERE n_chars % 4 > 0),
every AS (SELECT folder FROM f UNION SELECT source || '/' || lang FROM f UNION SELECT source FROM f), used AS (SELECT folder FROM filled UNION SELECT source || '/' || lang FROM filled UNION SELECT source FROM filled),
empty AS (SELECT folder FROM every EXCEPT SELECT folder FROM used)
SELECT folder FROM empty WHERE regexp_replace(folder, '/?[^/]*$', '') NOT IN (SELECT folder FROM empty)""")
def q_empty_folders(t: Tables) -> DataFrame:
    from reelspark.functions.paths import ancestors

    folder = F.concat_ws("/", "source", "lang", (F.col("doc_id") % 40).cast("string"))
    d = t.documents.select(folder.alias("folder"), F.concat(folder, F.when(F.col("n_chars") % 4 > 0, F.lit("/a.wav")).otherwise(F.lit("/.DS_Store"))).alias("path"))
    return moves.empty_folders(d, "path", d.select(F.explode(ancestors(F.col("folder"))).alias("folder")), [".DS_Store"])


@query("""
SELECT DISTINCT mount FROM (SELECT lang AS mount, CASE WHEN source = 'src1' AND lang = 'en' THEN 'SOUNDDEV/x' WHEN lang = 'fr' THEN 'a/b.WAV' ELSE 'a/b/c/d.wav' END AS path FROM documents)
WHERE starts_with(path, 'SOUNDDEV/') OR path = 'a/b.WAV'""")
def q_card_roots(t: Tables) -> DataFrame:
    path = F.when((F.col("source") == "src1") & (F.col("lang") == "en"), "SOUNDDEV/x").when(F.col("lang") == "fr", "a/b.WAV").otherwise("a/b/c/d.wav")
    return files.card_roots(t.documents.select(F.col("lang").alias("mount"), path.alias("path")), "path", "mount")


@query("""
WITH x AS (SELECT CASE doc_id % 5 WHEN 0 THEN 'FALSETAKES/' || CAST(doc_id AS VARCHAR) WHEN 1 THEN source || '/.hid/x' || CAST(doc_id AS VARCHAR) WHEN 2 THEN CAST(doc_id AS VARCHAR) ELSE source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) END AS path, source, doc_id FROM documents)
SELECT path FROM x WHERE doc_id % 5 = 2 OR (doc_id % 5 > 2 AND source IN ('src1', 'src3'))""")
def q_card_files(t: Tables) -> DataFrame:
    k = F.col("doc_id").cast("string")
    kind = F.col("doc_id") % 5
    path = F.when(kind == 0, F.concat(F.lit("FALSETAKES/"), k)).when(kind == 1, F.concat("source", F.lit("/.hid/x"), k)).when(kind == 2, k).otherwise(F.concat_ws("/", "source", "lang", k))
    return cards.chosen_files(t.documents.select(path.alias("path")), ["", "src1", "src3", "FALSETAKES"])


@query("""
WITH a AS (SELECT doc_id, n_chars FROM documents WHERE source <> 'src3'), b AS (SELECT doc_id, n_chars + CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END AS m FROM documents WHERE lang <> 'fr')
SELECT CAST(coalesce(a.doc_id, b.doc_id) AS VARCHAR) AS relative, CASE WHEN b.doc_id IS NULL THEN 'missing' WHEN a.doc_id IS NULL THEN 'not on the card' ELSE 'differs' END AS wrong
FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR n_chars <> m""")
def q_manifest(t: Tables) -> DataFrame:
    d = t.documents.select(F.col("doc_id").alias("k"), F.col("doc_id").cast("string").alias("relative"), F.col("n_chars").alias("size"), "source", "lang")
    return cards.manifest_differences(d.where("source <> 'src3'"), d.where("lang <> 'fr'").withColumn("size", F.col("size") + F.when(F.col("k") % 9 == 0, 1).otherwise(0)))


@query("""
WITH c AS (SELECT doc_id, n_chars FROM documents WHERE source <> 'src3'), l AS (SELECT doc_id, n_chars, CAST(doc_id AS DOUBLE) + CASE WHEN doc_id % 6 = 1 THEN 0.5 ELSE 0.001 END AS m FROM documents WHERE lang <> 'fr')
SELECT c.doc_id FROM c JOIN l USING (doc_id) WHERE c.n_chars = l.n_chars AND abs(m - c.doc_id) <= 0.01""")
def q_unchanged(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    d = t.documents.select("doc_id", k.cast("string").alias("path"), F.col("n_chars").alias("size"), k.cast("double").alias("mtime"), "source", "lang")
    now = d.where("lang <> 'fr'").withColumn("mtime", F.col("mtime") + F.when(k % 6 == 1, 0.5).otherwise(0.001))
    return store.unchanged(now, d.where("source <> 'src3'"), store.SHARED_TOLERANCE).select("doc_id")


@query("""
WITH m AS (SELECT CAST(user_id AS VARCHAR) AS path, event_id AS frame, event_type AS name, user_id FROM events)
SELECT CASE WHEN user_id % 3 = 0 THEN CAST(user_id + 1000000 AS VARCHAR) ELSE path END AS path, frame, name FROM m""")
def q_moved_markers(t: Tables) -> DataFrame:
    m = t.events.select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("frame"), F.col("event_type").alias("name"))
    mapping = t.events.select("user_id").distinct().where("user_id % 3 = 0").select(F.col("user_id").cast("string").alias("old"), (F.col("user_id") + 1_000_000).cast("string").alias("new"))
    return store.moved_markers(m, mapping)


@query("""
WITH e AS (SELECT user_id, event_id, event_type, value > 30 AS armed FROM events), w AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER x OR armed IS DISTINCT FROM lag(armed) OVER x THEN 1 ELSE 0 END AS fresh FROM e WINDOW x AS (PARTITION BY user_id ORDER BY event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM w)
SELECT user_id, event_type, min(event_id) AS first, max(event_id) AS last FROM s WHERE armed GROUP BY user_id, event_type, k""")
def q_recorded_lane(t: Tables) -> DataFrame:
    d = t.events.select("user_id", "event_id", "event_type", (F.col("value") > 30).alias("armed"))
    return ingest.recorded_lane(d, ["user_id"], "event_id", "event_type", "armed").drop("stretch")


@query("""
WITH x AS (SELECT event_id, event_id * 7919 % 1000 AS c, 25 + event_id % 50 AS n, event_id * 104729 % 1000 AS s FROM events)
SELECT event_id AS clip, event_id + 1 AS take, CASE WHEN s < c THEN (c - s) * 48000 // 25 ELSE 0 END AS cut_samples, CASE WHEN s < c THEN 0 ELSE (s - c) * 48000 // 25 END AS delay_samples, n * 48000 // 25 AS samples FROM x""")
def q_sync_plan(t: Tables) -> DataFrame:
    k = F.col("event_id")
    d = t.events.select(k.alias("clip"), (k + 1).alias("take"), (k * 7919 % 1000).alias("c_start"), (25 + k % 50).alias("c_len"), (k * 104729 % 1000).alias("t_start"), F.lit(10).alias("t_len"), F.lit(25).alias("num"), F.lit(48000).alias("sample_rate"))
    return files.sync_plan(d)


@query("""
WITH x AS (SELECT doc_id, 'r' || ['25/1', '24000/1001', 'x'][doc_id % 3 + 1] AS r, doc_id % 60 AS s, CAST(doc_id % 4 AS INT) AS audio FROM documents)
SELECT CAST(doc_id AS VARCHAR) || '.MOV' AS path, CASE WHEN doc_id % 3 = 2 THEN NULL WHEN doc_id % 5 = 0 THEN NULL ELSE (3600 + s) * [25, 24, 0][doc_id % 3 + 1] END AS start_frame, CAST(s + 0.5 AS DOUBLE) AS duration, audio AS audio_streams,
  CASE WHEN doc_id % 3 = 2 THEN 'no video' WHEN doc_id % 5 = 0 THEN 'no timecode' ELSE '' END AS error FROM x""")
def q_clips(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    second = F.lpad((k % 60).cast("string"), 2, "0")
    tags = F.when(k % 5 == 0, F.lit("{}")).otherwise(F.concat(F.lit('{"timecode": "01:00:'), second, F.lit(':00"}')))
    sound = F.when(k % 4 == 0, "").otherwise(F.repeat(F.lit(', {"codec_type": "audio"}'), (k % 4).cast("int")))
    text = F.concat(F.lit('{"streams": [{"codec_type": "video", "r_frame_rate": "'), _one_of(k, "25/1", "24000/1001", "x"), F.lit('", "tags": '), tags, F.lit("}"), sound, F.lit('], "format": {"duration": "'), (k % 60).cast("string"), F.lit('.5"}}'))
    d = t.documents.select(F.concat(k.cast("string"), F.lit(".MOV")).alias("path"), text.alias("json"))
    return files.clips(d, "path", "json").drop("rate")


@query("""
WITH e AS (SELECT doc_id, lang, n_chars % 100 AS take FROM documents), own AS (SELECT e.* FROM e JOIN documents d USING (doc_id) WHERE d.source = 'src1')
SELECT DISTINCT CAST(e.doc_id AS VARCHAR) AS path, 'scene' AS "column", 'S' || CAST(own.doc_id AS VARCHAR) AS value FROM own JOIN e ON e.lang = own.lang AND e.take = own.take""")
def q_edit_plan(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.col("doc_id").cast("string").alias("path"), "lang", (F.col("n_chars") % 100).alias("take"), "source")
    edits = d.where("source = 'src1'").select("path", F.lit("scene").alias("column"), F.concat(F.lit("S"), "path").alias("value"))
    return files.edit_plan(d, edits, ["lang", "take"])


@query("""
WITH x AS (SELECT doc_id, n_chars % 300 AS room, CASE WHEN doc_id % 3 = 0 THEN n_chars % 100 END AS filler, CASE WHEN doc_id % 8 = 0 THEN NULL ELSE n_chars % 350 END AS need FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN need IS NULL THEN 'unchanged' WHEN need <= room + coalesce(filler + 8, 0) THEN 'in place' ELSE 'rewrite' END AS mode,
  CASE WHEN need IS NULL THEN 0 WHEN need <= room + coalesce(filler + 8, 0) THEN need ELSE 5000 + need + 4096 END AS bytes FROM x""")
def q_metadata_plan(t: Tables) -> DataFrame:
    k, n = F.col("doc_id"), F.col("n_chars")
    chunk = lambda name, size: F.struct(F.lit(name).alias("id"), F.lit(0).cast("long").alias("offset"), size.cast("long").alias("size"), F.lit(False).alias("truncated"))
    chunks = F.when(k % 3 == 0, F.array(chunk("iXML", n % 300), chunk("JUNK", n % 100))).otherwise(F.array(chunk("iXML", n % 300), chunk("data", n)))
    d = t.documents.select(k.cast("string").alias("path"), F.lit(5000).cast("long").alias("size"), chunks.alias("chunks"), F.when(k % 8 > 0, F.repeat(F.lit("x"), (n % 350).cast("int"))).alias("ixml"))
    return files.metadata_plan(d, F.col("ixml"))


@query("SELECT sum(n_chars) AS estimate, count(*) AS sampled FROM (SELECT n_chars * greatest(1, (SELECT count(*) // 400 FROM documents)) AS n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents) WHERE k % greatest(1, (SELECT count(*) // 400 FROM documents)) = 0")
def q_size_estimate(t: Tables) -> DataFrame:
    return catalog.size_estimate(t.documents, "n_chars", "doc_id")


@query("""
SELECT chr(65279) || 'Sales' || chr(13) || chr(10) || 'days,all' || chr(13) || chr(10) || chr(13) || chr(10) || 'n_nationkey,n_name,even' || chr(13) || chr(10) ||
  string_agg(CAST(n_nationkey AS VARCHAR) || ',' || n_name || ',' || CASE WHEN n_nationkey % 2 = 0 THEN 'yes' ELSE '' END, chr(13) || chr(10) ORDER BY n_nationkey) || chr(13) || chr(10) AS text FROM nation""")
def q_csv_report(t: Tables) -> DataFrame:
    d = t.nation.select("n_nationkey", "n_name", (F.col("n_nationkey") % 2 == 0).alias("even")).orderBy("n_nationkey")
    return t.spark.createDataFrame([(report.report_csv("Sales", [("days", "all")], d),)], "text string")


_RESPONSE = "1 / ((1 - o * o) * (1 - o * o) + o * o / (q * q))"


@query(f"""
WITH x AS (SELECT event_id, 100 + event_id % 400 * 20.0 AS f, 0.5 + event_id % 7 / 2.0 AS q FROM events), y AS (SELECT *, tan(pi() * f / 48000) / tan(pi() * 1000 / 48000.0) AS o FROM x)
SELECT event_id, round(10 * log10({_RESPONSE}), 4) AS low_db, round(10 * log10(o * o * o * o * {_RESPONSE}), 4) AS high_db, round(10 * log10(o * o / (q * q) * {_RESPONSE}), 4) AS band_db FROM y""")
def q_filter_response(t: Tables) -> DataFrame:
    import numpy as np
    import pandas as pd

    def run(batches):
        for pdf in batches:
            out = {"event_id": pdf["event_id"]}
            for kind, name in (("lowpass", "low_db"), ("highpass", "high_db"), ("bandpass", "band_db")):
                out[name] = [round(float(audio.response_db([audio.rbj_biquad(kind, 1000.0, 48_000.0, q=q)], np.array([f]), 48_000.0)[0]), 4) for f, q in zip(pdf["f"], pdf["q"])]
            yield pd.DataFrame(out)

    k = F.col("event_id")
    d = t.events.select("event_id", (100 + k % 400 * 20.0).alias("f"), (0.5 + k % 7 / 2.0).alias("q"))
    return d.mapInPandas(run, "event_id long, low_db double, high_db double, band_db double")


@query("""
WITH p AS (SELECT l_orderkey, max(l_quantity) AS loud, min(l_quantity) AS soft FROM lineitem GROUP BY 1)
SELECT l_orderkey, round(10 * log10(a / b), 6) AS reduction_db FROM (SELECT l_orderkey, avg(l_quantity * l_quantity) AS a, avg(l_discount * l_discount) AS b FROM lineitem GROUP BY 1) WHERE a > 0 AND b > 0
UNION ALL SELECT l_orderkey, 0.0 FROM (SELECT l_orderkey, avg(l_discount * l_discount) AS b FROM lineitem GROUP BY 1) WHERE b = 0""")
def q_reduction(t: Tables) -> DataFrame:
    from reelspark.operators import signal

    return signal.reduction_db(t.lineitem, ["l_orderkey"], "l_quantity", "l_discount").withColumn("reduction_db", F.round("reduction_db", 6))


@query("""
WITH d AS (SELECT CAST(o_custkey % 400 AS VARCHAR) AS k, min(strftime(o_orderdate, '%Y-%m-%d')) AS a, max(strftime(o_orderdate, '%Y-%m-%d')) AS b FROM orders GROUP BY 1)
SELECT k, CASE WHEN k = '7' THEN 'Sound' ELSE 'P-' || k END || ' Sound Report ' || CASE WHEN a = b THEN a ELSE a || ' to ' || b END AS report FROM d""")
def q_report_names(t: Tables) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    d = t.orders.groupBy((F.col("o_custkey") % 400).cast("string").alias("k")).agg(F.min(day).alias("a"), F.max(day).alias("b"))
    return d.select("k", names.report_name(F.when(F.col("k") != "7", F.concat(F.lit("P/"), "k")), F.col("a"), F.col("b")).alias("report"))


_PLATFORMS = ("Netflix", "Apple TV+ (US)", "EBU R128", "ATSC A/85")


@query(f"SELECT p_partkey, '_' || regexp_replace(string_split({_list(_PLATFORMS)}[p_partkey % 4 + 1], ' (')[1], '[^A-Za-z0-9]', '', 'g') AS ending FROM part")
def q_copy_endings(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", names.copy_ending(_one_of(F.col("p_partkey"), *_PLATFORMS)).alias("ending"))


@query("""
WITH x AS (SELECT p_partkey AS k, p_brand AS s, CAST(p_size AS VARCHAR) AS t FROM part), y AS (SELECT *, CASE k % 4 WHEN 0 THEN s || '-T' || t WHEN 1 THEN replace(s, '#', '#') || 'T' || t WHEN 2 THEN 'other' ELSE '' END AS base FROM x)
SELECT k AS p_partkey, CASE WHEN base = '' THEN 'BOOM+LAV.wav' WHEN k % 5 = 0 THEN base || '_BOOM+LAV.wav' ELSE base || '.wav' END AS name FROM y""")
def q_combined_names(t: Tables) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    with_take = k % 4 < 2
    original = F.when(k % 4 == 0, F.concat("p_brand", F.lit("-T"), size, F.lit("_ISO.wav"))).when(k % 4 == 1, "x.wav").when(k % 4 == 2, "other.wav")
    base = F.when(k % 4 == 0, F.concat("p_brand", F.lit("-T"), size)).when(k % 4 == 1, F.concat("p_brand", F.lit("T"), size)).otherwise("other")
    taken = F.when(k % 5 == 0, F.array(F.concat(base, F.lit(".wav")))).otherwise(F.array().cast("array<string>"))
    name = names.combined_name(F.when(with_take, F.col("p_brand")).otherwise(""), F.when(with_take, size).otherwise(""), original, F.array(F.lit("BOOM"), F.lit("LAV")), F.lit(".wav"), taken)
    return t.part.select("p_partkey", name.alias("name"))


@query("""
WITH x AS (SELECT l_orderkey AS take, CAST(l_linenumber AS INT) AS channel, bool_or(l_returnflag = 'R') AS solo, bool_or(l_shipdate > TIMESTAMP '1998-06-01') AS edited, bool_or(l_quantity > 25) AS wanted FROM lineitem GROUP BY 1, 2)
SELECT take, channel, CASE WHEN edited THEN wanted WHEN bool_or(edited AND wanted) OVER (PARTITION BY take) THEN false ELSE solo END AS solo FROM x""")
def q_exclusive_solo(t: Tables) -> DataFrame:
    from reelspark.operators import mixer

    d = t.lineitem.groupBy(F.col("l_orderkey").alias("take"), F.col("l_linenumber").cast("int").alias("channel")).agg(F.max(F.col("l_returnflag") == "R").alias("solo"), F.max(F.col("l_shipdate") > F.lit("1998-06-01").cast("timestamp")).alias("edited"), F.max(F.col("l_quantity") > 25).alias("on"))
    return mixer.soloed(d.select("take", "channel", "solo"), d.where("edited").select("take", "channel", "on"), "take", exclusive=True)
