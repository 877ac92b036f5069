"""Duplicates, keepers, similar names, project places and merge plans."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.functions import names
from reelspark.operators import dedupe
from reelspark.plans import moves
from reelspark.queries import Tables, query
from reelspark.queries.rows import _URL, _url_path


@query("""
WITH f AS (SELECT doc_id, lang, n_chars, md5(lang || CAST(n_chars AS VARCHAR) || array_to_string(list_transform(list_sort(list_distinct([0, greatest(n_chars // 2 - 128, 0), greatest(n_chars - 256, 0)])), lambda a: substr(text, CAST(a + 1 AS INTEGER), 256)), '')) AS fingerprint FROM documents)
SELECT doc_id, fingerprint, count(*) OVER (PARTITION BY lang, n_chars, fingerprint) AS copies FROM f""")
def q_dup_exact(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    d = t.documents.select("doc_id", "lang", "n_chars", dedupe.text_fingerprint(F.col("lang"), F.col("text"), F.col("n_chars"), 256).alias("fingerprint"))
    return d.select("doc_id", "fingerprint", F.count("*").over(Window.partitionBy("lang", "n_chars", "fingerprint")).alias("copies"))


def _groups(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "lang", "source", "n_chars", "text", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"))
    name = F.concat(F.col("source"), (F.col("doc_id") % 2).cast("string"))
    return dedupe.duplicate_groups(d.withColumn("name", name), ["lang", "n_chars"], "name", F.md5(F.col("text").cast("binary")))


_GROUPS = """
k AS (SELECT doc_id, lang, source, n_chars, text, source || '/' || CAST(doc_id AS VARCHAR) AS path, source || CAST(doc_id % 2 AS VARCHAR) AS name, count(*) OVER (PARTITION BY lang, n_chars) AS n FROM documents),
m AS (SELECT *, first_value(md5(text)) OVER (PARTITION BY lang, n_chars, name ORDER BY path) AS h, (SELECT count(DISTINCT source || CAST(doc_id % 2 AS VARCHAR)) FROM documents d WHERE d.lang = k.lang AND d.n_chars = k.n_chars) AS names FROM k WHERE n > 1),
g AS (SELECT *, CASE WHEN names > 1 THEN h ELSE '' END AS content FROM m),
r AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY lang, n_chars, content) AS again FROM g) WHERE again > 1)"""


@query(f"WITH {_GROUPS} SELECT doc_id, lang, n_chars, content FROM r")
def q_dup_groups(t: Tables) -> DataFrame:
    return _groups(t).select("doc_id", "lang", "n_chars", "content")


def _keepers(t: Tables) -> DataFrame:
    score = dedupe.keeper_score(F.col("path"), F.col("lang"), F.col("doc_id") % 3 == 0, ["src1", "src2"])
    return dedupe.ranked(_groups(t).withColumn("score", score), ["lang", "n_chars", "content"], F.col("score"), F.col("path"))


_KEEP = f"""{_GROUPS}, s AS (SELECT *, (CASE WHEN source IN ('src1', 'src2') THEN 100 ELSE 0 END) - (CASE WHEN source = lang THEN 10 ELSE 0 END) - (CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END) AS score FROM r),
rk AS (SELECT *, row_number() OVER (PARTITION BY lang, n_chars, content ORDER BY score, path) AS rank FROM s)"""


@query(f"WITH {_KEEP} SELECT doc_id, score, rank FROM rk")
def q_keeper(t: Tables) -> DataFrame:
    return _keepers(t).select("doc_id", "score", "rank")


@query(f"""WITH {_KEEP}, d AS (SELECT lang, n_chars, content, source, min(rank) AS f FROM rk GROUP BY ALL)
SELECT lang, n_chars, content, CASE WHEN count(*) > 1 THEN string_agg(source, ' | ' ORDER BY f) END AS source FROM d GROUP BY 1, 2, 3""")
def q_meta_diff(t: Tables) -> DataFrame:
    return dedupe.metadata_differences(_keepers(t), ["lang", "n_chars", "content"], ["source"])


@query(f"WITH {_KEEP} SELECT lang, n_chars, content, count(*) AS copies, CAST(coalesce(sum(n_chars) FILTER (WHERE rank > 1), 0) AS BIGINT) AS wasted FROM rk GROUP BY 1, 2, 3")
def q_wasted(t: Tables) -> DataFrame:
    return dedupe.wasted(_keepers(t).withColumn("size", F.col("n_chars")), ["lang", "n_chars", "content"], "size")


@query("""
WITH r AS (SELECT conv_id, role, CAST(turn % 3 AS VARCHAR) AS folder, min(turn) AS s FROM conversations GROUP BY 1, 2, 3),
n AS (SELECT conv_id, count(DISTINCT role) AS n FROM r GROUP BY 1 HAVING count(DISTINCT role) > 1),
h AS (SELECT r.conv_id, folder, count(DISTINCT role) AS has, min(s) AS best FROM r GROUP BY 1, 2)
SELECT conv_id, folder, n AS groups FROM (SELECT h.conv_id, folder, n, row_number() OVER (PARTITION BY h.conv_id ORDER BY best, folder) AS k FROM h JOIN n USING (conv_id) WHERE has = n) WHERE k = 1""")
def q_take_align(t: Tables) -> DataFrame:
    d = t.conversations.select("conv_id", "role", "turn", (F.col("turn") % 3).cast("string").alias("folder"))
    return dedupe.take_aligned(d, "conv_id", "role", "folder", F.col("turn"))


@query()
def q_similar_names(t: Tables) -> DataFrame:
    return dedupe.similar_pairs(t.part.select(F.concat_ws(" ", "p_name", "p_type").alias("name")), "name")


@query("""
WITH x AS (SELECT DISTINCT p_brand AS folder FROM part), y AS (SELECT CASE WHEN CAST(substr(p_brand, 7) AS INT) % 3 = 0 THEN p_brand WHEN CAST(substr(p_brand, 7) AS INT) % 3 = 1 THEN upper(replace(p_brand, '#', ' ')) ELSE 'other ' || p_brand END AS project, count(*) AS files FROM part GROUP BY 1)
SELECT folder, project, CAST(CASE WHEN folder = project THEN 0 ELSE 1 END AS INTEGER) AS rank, files FROM x JOIN y ON regexp_replace(lower(folder), '[^0-9a-z]', '', 'g') = regexp_replace(lower(project), '[^0-9a-z]', '', 'g')""")
def q_project_match(t: Tables) -> DataFrame:
    """Brands are told apart by their numbers, so none is like another but those of one spelling."""
    number = F.substring("p_brand", 7, 9).cast("int") % 3
    project = F.when(number == 0, F.col("p_brand")).when(number == 1, F.upper(F.replace("p_brand", F.lit("#"), F.lit(" ")))).otherwise(F.concat(F.lit("other "), "p_brand"))
    library = t.part.groupBy(project.alias("project")).agg(F.count("*").alias("files"))
    return dedupe.project_matches(t.part.select(F.col("p_brand").alias("folder"), F.col("p_brand").alias("name")).distinct(), library)


@query()
def q_name_clusters(t: Tables) -> DataFrame:
    return dedupe.clusters(dedupe.similar_pairs(t.part.select(F.concat_ws(" ", "p_name", "p_type").alias("name")), "name"))


@query("""
WITH v AS (SELECT l_partkey, 'supplier' || CAST(l_suppkey AS VARCHAR) AS folder, count(*) AS votes FROM lineitem GROUP BY 1, 2)
SELECT CAST(l_partkey AS VARCHAR) AS project, folder, votes FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY votes DESC, length(folder), folder DESC) AS k FROM v) WHERE k = 1""")
def q_project_vote(t: Tables) -> DataFrame:
    d = t.lineitem.select(F.col("l_partkey").cast("string").alias("project"), F.concat(F.lit("dump/supplier"), F.col("l_suppkey").cast("string"), F.lit("/x.wav")).alias("path"))
    return dedupe.project_votes(d, "project", "path", ["dump"]).withColumn("folder", F.regexp_replace("folder", "^dump/", ""))


@query(f"""
WITH p AS (SELECT regexp_extract({_URL}, '/([a-z]+)/', 1) AS project, regexp_replace({_URL}, '/.*$', '') AS host FROM pages)
SELECT DISTINCT project, host || '/' || project AS folder FROM p WHERE project <> ''""")
def q_project_locations(t: Tables) -> DataFrame:
    path = F.regexp_replace(_url_path(F.col("url")), "/$", "")
    d = t.pages.select(path.alias("path"), F.regexp_extract(_url_path(F.col("url")), "/([a-z]+)/", 1).alias("project"))
    return dedupe.project_locations(d, "project", "path", [])


@query("""
WITH p AS (SELECT 'lib/' || lang || '/' || source || '/' || upper(source) || '/' || CAST(doc_id AS VARCHAR) AS path, lang, source FROM documents)
SELECT 'lib/' || lang || '/' || source || '/' || upper(source) AS inner, 'lib/' || lang || '/' || source AS outer, count(*) AS files FROM p GROUP BY 1, 2""")
def q_nested(t: Tables) -> DataFrame:
    d = t.documents.select(F.concat_ws("/", F.lit("lib"), "lang", "source", F.upper("source"), F.col("doc_id").cast("string")).alias("path"))
    return dedupe.nested_folders(d, "path")


def _tree(t: Tables) -> DataFrame:
    inner = F.when(F.col("doc_id") % 2 == 0, F.concat(F.col("source"), F.lit("/"))).otherwise("")
    name = (F.col("doc_id") / 2).cast("long") % 400
    return t.documents.select(F.concat(F.lit("lib/"), F.col("source"), F.lit("/"), inner, name.cast("string")).alias("path"), F.col("lang").alias("key"), "doc_id").groupBy("path").agg(F.min_by("key", "doc_id").alias("key"))


@query("""
WITH d AS (SELECT 'lib/' || source || '/' || CASE WHEN doc_id % 2 = 0 THEN source || '/' ELSE '' END || CAST(doc_id // 2 % 400 AS VARCHAR) AS path, lang, doc_id, source FROM documents),
u AS (SELECT path, min_by(lang, doc_id) AS key, min(source) AS source FROM d GROUP BY path),
i AS (SELECT path, key, 'lib/' || source || '/' || regexp_extract(path, '[^/]*$') AS dst FROM u WHERE path LIKE 'lib/' || source || '/' || source || '/%')
SELECT CASE WHEN u.key IS NULL THEN 'move' WHEN u.key = i.key THEN 'remove' ELSE 'skip' END AS kind, i.path, i.dst FROM i LEFT JOIN u ON u.path = i.dst""")
def q_nested_plan(t: Tables) -> DataFrame:
    d = _tree(t)
    return moves.nested_plan(d, dedupe.nested_folders(d, "path").select("inner", "outer"))


@query("""
WITH a AS (SELECT doc_id, lang, source, CASE WHEN n_chars % 7 = 0 THEN 'skip' WHEN n_chars % 2 = 0 THEN 'move' ELSE 'remove' END AS kind, n_chars % 3 <> 0 AS is_take, n_chars // 50 AS take FROM documents),
b AS (SELECT *, max(CASE WHEN kind = 'skip' AND is_take THEN 1 ELSE 0 END) OVER (PARTITION BY source, take) AS stays FROM a)
SELECT doc_id, CASE WHEN stays = 1 AND is_take AND kind <> 'skip' THEN 'skip' ELSE kind END AS kind FROM b""")
def q_keep_takes(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "source", "n_chars", F.when(F.col("n_chars") % 7 == 0, "skip").when(F.col("n_chars") % 2 == 0, "move").otherwise("remove").alias("kind"))
    return moves.keep_takes_together(d, F.col("source"), F.floor(F.col("n_chars") / 50), F.col("n_chars") % 3 != 0).select("doc_id", "kind")


@query()
def q_merge_plan(t: Tables) -> DataFrame:
    d = t.documents.select(
        F.col("lang").alias("grp"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.concat(F.lit("n"), (F.col("n_chars") % 500).cast("string")).alias("name"), F.col("n_chars").cast("string").alias("key"), F.md5(F.col("text").cast("binary")).alias("hash"),
        F.col("n_chars").alias("size"), (F.col("doc_id") % 4).alias("channels"), (F.col("doc_id") % 5 == 0).alias("noted"), (F.col("source") == "src0").alias("in_target"), (F.col("doc_id") % 11).alias("score"), F.concat(F.lit("src0/n"), (F.col("n_chars") % 500).cast("string")).alias("target"),
    )
    return moves.merge_plan(d, "grp").select("grp", "kind", "path", "dst", "level")


@query("""
WITH d AS (SELECT lang || '/' || source || '/' || CAST(n_chars AS VARCHAR) || CASE WHEN doc_id % 4 = 0 THEN '_ReviewForDeletion' ELSE '' END || '.wav' AS path, lang, n_chars, lang || '/' || source AS folder FROM documents), u AS (SELECT DISTINCT * FROM d),
r AS (SELECT * FROM u WHERE path LIKE '%!_ReviewForDeletion.wav' ESCAPE '!'), p AS (SELECT * FROM u WHERE path NOT LIKE '%!_ReviewForDeletion.wav' ESCAPE '!'),
w AS (SELECT r.path, replace(r.path, '_ReviewForDeletion', '') AS wanted, r.lang, r.n_chars, r.folder FROM r),
c AS (SELECT w.path, p.path AS copy, row_number() OVER (PARTITION BY w.path ORDER BY p.folder <> w.folder, p.path) AS k FROM w JOIN p ON p.lang = w.lang AND p.n_chars = w.n_chars)
SELECT w.path, CASE WHEN s.path IS NOT NULL THEN w.wanted ELSE c.copy END AS copy, CASE WHEN s.path IS NOT NULL THEN 'same name' WHEN c.copy IS NOT NULL THEN 'same recording' ELSE '' END AS how
FROM w LEFT JOIN p s ON s.path = w.wanted LEFT JOIN c ON c.path = w.path AND c.k = 1""")
def q_review_pairs(t: Tables) -> DataFrame:
    tag = F.when(F.col("doc_id") % 4 == 0, dedupe.REVIEW_TAG).otherwise("")
    d = t.documents.select(F.concat(F.col("lang"), F.lit("/"), F.col("source"), F.lit("/"), F.col("n_chars").cast("string"), tag, F.lit(".wav")).alias("path"), "lang", "n_chars").distinct()
    return dedupe.review_pairs(d, ["lang", "n_chars"])


@query("""
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(x * 20) AS INTEGER)) AS v FROM embeddings)
SELECT vec_id, len(list_filter(v[3:7], lambda x: NOT list_contains(v[20:64], x))) = 0 AS contained FROM e""")
def q_channel_contained(t: Tables) -> DataFrame:
    d = t.embeddings.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 20).cast("int")).alias("v"))
    return d.select("vec_id", dedupe.channels_contained(F.slice("v", 3, 5), F.slice("v", 20, 45)).alias("contained"))


@query(f"""
WITH p AS (SELECT 'lib/web/' || {_URL} AS path FROM pages), f AS (SELECT regexp_replace(path, '/[^/]*$', '') AS folder FROM p), s AS (SELECT string_split(folder, '/') AS x FROM f),
c AS (SELECT array_to_string(x[1:k], '/') AS folder, count(*) AS n FROM s, LATERAL unnest(range(1, len(x) + 1)) AS u(k) GROUP BY 1)
SELECT coalesce(max_by(folder, length(folder)), '') AS folder FROM c WHERE n = (SELECT count(*) FROM s)""")
def q_common_folder(t: Tables) -> DataFrame:
    from reelspark.functions.paths import common_folder

    return common_folder(t.pages.select(F.concat(F.lit("lib/web/"), _url_path(F.col("url"))).alias("path")), "path")


@query("SELECT doc_id, regexp_replace(lower(source), '[^0-9a-z]', '', 'g') AS plain, regexp_extract_all(source, '([0-9]+)', 1) AS runs FROM documents")
def q_name_keys(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", names.normalized(F.col("source")).alias("plain"), names.digit_runs(F.col("source")).alias("runs"))
