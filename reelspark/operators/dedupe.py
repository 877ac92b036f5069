"""Duplicates: keys and fingerprints of recordings, keepers, similar names and project places."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.functions import names, paths
from reelspark.operators.similar import similar_pairs

#: Fields compared between copies, folders of leftovers, the mark of review copies, block of a fingerprint.
META_FIELDS = ["project", "scene", "take", "tape", "note", "circled", "date"]
LEFTOVERS = ["falsetakes", "recovered", "trash"]
REVIEW_TAG = "_ReviewForDeletion"
BLOCK = 64 * 1024


def audio_key(frames: Column, *kind: Column) -> Column:
    """What copies of a recording share; null (which never matches) without frames or with an error."""
    return F.when(frames > 0, F.struct(frames.alias("frames"), *(k.alias(f"k{i}") for i, k in enumerate(kind))))


def sample_starts(size: Column, block: int = BLOCK) -> Column:
    """Where a fingerprint reads: start, middle and end, each once, in order."""
    mid, end = F.greatest(F.floor(size / 2).cast("long") - block // 2, F.lit(0)), F.greatest(size - block, F.lit(0))
    return F.array_sort(F.array_distinct(F.array(F.lit(0).cast("long"), mid, end)))


def text_fingerprint(head: Column, text: Column, size: Column, block: int = BLOCK) -> Column:
    """md5 of the head, the size and up to three blocks of the text."""
    blocks = F.transform(sample_starts(size, block), lambda a: F.substr(text, (a + 1).cast("int"), F.lit(block)))
    return F.md5(F.concat(head, size.cast("string"), F.array_join(blocks, "")).cast("binary"))


def duplicate_groups(df: DataFrame, key: list[str], name: str, fingerprint: Column) -> DataFrame:
    """df's rows in groups of two or more, with content: rows of one key whose names or fingerprints agree.

    A key with one name needs no fingerprint. Otherwise each name's first row (by path, which is
    unique) is fingerprinted for all of them, so the costly expression runs once for a name. Counts
    are summed before they are shuffled and rows meet their group by joins, so a key may hold any
    number of rows.
    """
    each = df.groupBy(*key, name).agg(F.count("*").alias("_n"), F.min("path").alias("_first"))
    keys = each.groupBy(*key).agg(F.sum("_n").alias("_rows"), F.count("*").alias("_names")).where("_rows > 1")
    each = each.join(keys, key)
    first = each.where("_names > 1").select(F.col("_first").alias("path"))
    hashed = df.join(first, "path", "left_semi").select(*key, name, fingerprint.alias("_hash"))
    named = each.join(hashed, [*key, name], "left").withColumn("content", F.coalesce("_hash", F.lit("")))
    groups = named.groupBy(*key, "content").agg(F.sum("_n").alias("_copies")).where("_copies > 1").drop("_copies")
    return df.join(named.join(groups, [*key, "content"]).select(*key, name, "content"), [*key, name])


def keeper_score(path: Column, project: Column, noted: Column, containers: list[str], removed: str = "_Removed") -> Column:
    """Lower is kept: not removed, not in a container, in its project's folder, with a note."""
    folders = F.slice(paths.parts(path), F.lit(1), F.greatest(F.size(paths.parts(path)) - 1, F.lit(0)))
    lower = F.transform(folders, F.lower)
    contained = reduce(lambda a, b: a | b, (F.array_contains(lower, c.lower()) for c in containers), F.lit(False))
    own = (project != "") & F.array_contains(lower, F.lower(project))
    points = ((F.array_contains(folders, removed), 1000), (contained, 100), (own, -10), (noted, -1))
    return reduce(lambda a, b: a + b, (F.when(test, n).otherwise(0) for test, n in points))


def ranked(df: DataFrame, group: list[str], *order: Column) -> DataFrame:
    """df with rank in its group; rank 1 is the keeper."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long"))


def metadata_differences(df: DataFrame, group: list[str], fields: list[str], rank: str = "rank") -> DataFrame:
    """group, and for each field its distinct values in rank order, null where there is one alone.

    Each value is counted once for its group, at its least rank, before the values are gathered."""
    each = df.select(*group, F.col(rank).alias("_rank"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))).alias("_v"))
    kinds = each.groupBy(*group, F.col("_v.field").alias("_field"), F.col("_v.value").alias("_value")).agg(F.min("_rank").alias("_rank"))
    lists = kinds.groupBy(*group, "_field").agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "_value"))), lambda x: x["_value"]).alias("_values"))
    shown = F.when(F.size("_values") > 1, F.array_join("_values", " | ", ""))
    return lists.groupBy(*group).agg(*(F.max(F.when(F.col("_field") == f, shown)).alias(f) for f in fields))


def wasted(df: DataFrame, group: list[str], size: str, rank: str = "rank") -> DataFrame:
    return df.groupBy(*group).agg(F.count("*").alias("copies"), F.coalesce(F.sum(F.when(F.col(rank) > 1, F.col(size))), F.lit(0)).alias("wasted"))


def take_aligned(df: DataFrame, take: str, group: str, folder: str, score: Column) -> DataFrame:
    """For each take with two groups or more, the folder that has a copy from all of them (best score first)."""
    groups = df.groupBy(take).agg(F.countDistinct(group).alias("n")).where("n > 1")
    here = df.withColumn("_score", score).groupBy(take, folder).agg(F.countDistinct(group).alias("has"), F.min("_score").alias("best"))
    whole = here.join(groups, take).where("has = n")
    return whole.groupBy(take).agg(F.min_by(folder, F.struct("best", folder)).alias(folder), F.max("n").alias("groups"))


def clusters(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(name, cluster): the smallest name reachable, by iterated minimum of the neighbours'."""
    from reelspark.session import checkpoint_dir

    checkpoint_dir(pairs.sparkSession)
    edges = pairs.select(F.col(a).alias("u"), F.col(b).alias("v"))
    edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct().checkpoint()
    now = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("c")).checkpoint()
    while True:  # each round lowers some name's cluster, or is the last
        near = edges.join(now.select(F.col("u").alias("v"), F.col("c")), "v").groupBy("u").agg(F.min("c").alias("m"))
        step = now.join(near, "u").select("u", F.least("c", "m").alias("c"), (F.col("m") < F.col("c")).alias("moved"))
        # A name's cluster may itself have moved on: follow it once.
        hop = step.select(F.col("u").alias("c"), F.col("c").alias("c2"), F.col("moved").alias("moved2"))
        after = step.join(hop, "c", "left").select("u", F.least("c", F.coalesce("c2", "c")).alias("c"), (F.col("moved") | F.coalesce(F.col("c2") < F.col("c"), F.lit(False))).alias("moved")).checkpoint()
        done = after.where("moved").isEmpty()
        now = after.select("u", "c")
        if done:
            return now.select(F.col("u").alias("name"), F.col("c").alias("cluster"))


def project_votes(df: DataFrame, project: str, path: str, containers: list[str]) -> DataFrame:
    """The folder that most of a project's files vote for (then the shortest): up to the component
    named like the project, else up to the first one that is no container."""
    folders = F.slice(paths.parts(F.col(path)), F.lit(1), F.greatest(F.size(paths.parts(F.col(path))) - 1, F.lit(0)))
    at = F.transform(folders, lambda x, k: F.struct(F.when(F.lower(x) == F.lower(F.col(project)), 0).when(F.lower(x).isin([c.lower() for c in containers]), 2).otherwise(1).alias("kind"), k.alias("k")))
    best = F.array_min(F.filter(at, lambda x: x["kind"] < 2))
    vote = F.array_join(F.slice(folders, F.lit(1), best["k"] + 1), "/")
    counts = df.withColumn("folder", vote).where("folder is not null and folder <> ''").groupBy(project, "folder").agg(F.count("*").alias("votes"))
    return counts.groupBy(project).agg(F.max_by(F.struct("folder", "votes"), F.struct(F.col("votes"), -F.length("folder"), F.col("folder"))).alias("b")).select(project, "b.folder", "b.votes")


def project_locations(df: DataFrame, project: str, path: str, containers: list[str]) -> DataFrame:
    """Folders of each project, one for each top-level place (a container's sub-folders are places of their own)."""
    p = paths.parts(F.col(path))
    kept = df.where((F.col(project) != "") & ~F.exists(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), lambda x: F.lower(x).isin(LEFTOVERS)))
    top = F.when(F.size(p) < 2, "").when(F.lower(F.get(p, F.lit(0))).isin([c.lower() for c in containers]) & (F.size(p) > 2), F.concat_ws("/", F.get(p, F.lit(0)), F.get(p, F.lit(1)))).otherwise(F.get(p, F.lit(0)))
    placed = kept.withColumn("_place", F.to_json(F.struct(F.col(project).alias("p"), top.alias("t")))).withColumn("_project", F.col(project))
    folders = F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0)))
    at = F.transform(folders, lambda x, k: F.struct(F.when(F.lower(x) == F.lower(F.col("_project")), 0).when(F.lower(x).isin([c.lower() for c in containers]), 2).otherwise(1).alias("kind"), k.alias("k")))
    best = F.array_min(F.filter(at, lambda x: x["kind"] < 2))
    votes = placed.withColumn("folder", F.array_join(F.slice(folders, F.lit(1), best["k"] + 1), "/")).where("folder <> ''").groupBy("_place", "_project", "folder").agg(F.count("*").alias("n"))
    won = votes.groupBy("_place", "_project").agg(F.max_by("folder", F.struct(F.col("n"), -F.length("folder"), F.col("folder"))).alias("folder"))
    return won.select(F.col("_project").alias(project), "folder").distinct()


def nested_folders(df: DataFrame, path: str) -> DataFrame:
    """Folders named like their parent (the deepest of a chain), with the files in each."""
    each = df.select(F.col(path).alias("path")).select("path", F.explode(paths.ancestors(names.folder(F.col("path")))).alias("inner"))
    same = each.withColumn("outer", names.folder(F.col("inner"))).where((names.normalized(names.basename(F.col("inner"))) == names.normalized(names.basename(F.col("outer")))) & (F.col("outer") != "") & (names.normalized(names.basename(F.col("inner"))) != ""))
    pairs = same.groupBy("inner", "outer").agg(F.count("*").alias("files"))
    above = pairs.select(F.col("outer").alias("inner"))
    return pairs.join(above, "inner", "left_anti")


def review_pairs(df: DataFrame, key: list[str]) -> DataFrame:
    """Each review copy's path with its closest untagged file and how that was found."""
    tagged = names.stem(names.basename(F.col("path"))).rlike(rf"{REVIEW_TAG}(\s*\(\d+\))?$")
    original = F.concat(F.regexp_replace(F.substring_index(names.basename(F.col("path")), REVIEW_TAG, 1), r"\s*\(\d+\)$", ""), F.regexp_extract(F.col("path"), r"(\.[^./]*)$", 1))
    marked = df.where(tagged).select("path", *key, names.folder(F.col("path")).alias("folder"), original.alias("original")).withColumn("wanted", F.concat_ws("/", F.nullif(F.col("folder"), F.lit("")), F.col("original")))
    plain = df.where(~tagged)
    by_name = plain.select(F.col("path").alias("wanted"), F.lit("same name").alias("by_name"))
    other = plain.select(F.col("path").alias("copy"), *key)
    order = F.struct((F.lower(names.basename(F.col("copy"))) != F.lower(F.col("original"))).alias("a"), (names.folder(F.col("copy")) != F.col("folder")).alias("b"), F.col("copy"))
    by_key = marked.join(other, key).groupBy("path").agg(F.min_by("copy", order).alias("copy"))
    out = marked.join(by_name, "wanted", "left").join(by_key, "path", "left")
    return out.select("path", F.when(F.col("by_name").isNotNull(), F.col("wanted")).otherwise(F.col("copy")).alias("copy"), F.coalesce("by_name", F.when(F.col("copy").isNotNull(), "same recording"), F.lit("")).alias("how"))


def channels_contained(small: Column, big: Column) -> Column:
    """Every channel of small equals some channel of big."""
    return F.forall(small, lambda s: F.exists(big, lambda b: b == s))


def in_library(card: DataFrame, library: DataFrame, on: list[str]) -> DataFrame:
    """Card rows whose key is in the library; null keys never match."""
    return card.join(library.select(*on).distinct(), on, "left_semi")


def project_matches(card: DataFrame, library: DataFrame) -> DataFrame:
    """Card folders with library projects of the same, the same spelled or a similar name; of each pair the best rank.

    card: folder, name (its own or a project's); library: project, files.
    """
    c = card.withColumn("_n", names.normalized(F.col("name")))
    lib = library.withColumn("_n", names.normalized(F.col("project")))
    same = c.join(lib, (c["name"] == lib["project"])).select("folder", "project", "files", F.lit(0).alias("rank"))
    spelled = c.join(lib, c["_n"] == lib["_n"]).where(c["_n"] != "").select("folder", "project", "files", F.lit(1).alias("rank"))
    pairs = similar_pairs(c.select("name").unionByName(lib.select(F.col("project").alias("name"))), "name")
    pairs = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    alike = c.join(pairs, c["name"] == pairs["a"]).join(lib, F.col("b") == lib["project"]).select("folder", "project", "files", F.lit(2).alias("rank"))
    every = same.unionByName(spelled).unionByName(alike)
    return every.groupBy("folder", "project").agg(F.min("rank").alias("rank"), F.max("files").alias("files"))


def has_notes(note: Column, circled: Column) -> Column:
    return (F.trim(F.coalesce(note, F.lit(""))) != "") | F.coalesce(circled, F.lit(False))


#: What of a file its copies are compared by: fields that a better note leaves alike, and its format.
NOTED_ALIKE = [f for f in META_FIELDS if f not in ("note", "circled", "project")]
FORMAT = ["frames", "sample_rate", "bits", "float_samples", "time_reference"]


def compared(f: dict[str, Column]) -> dict[str, Column]:
    """What adds_notes and may_have_more_tracks compare of a file, made once for each file and not for each pair."""
    own = {"named": F.lower(f["name"]), "noted": has_notes(f["note"], f["circled"]), "good": F.coalesce(f["error"] == "", F.lit(False)), "channels": f["channels"]}
    return own | {"alike": F.to_json(F.struct(*(f[n].alias(n) for n in NOTED_ALIKE)))} | {n: f[n] for n in FORMAT}


def adds_notes(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """The file a is b with a note or a circle that b lacks: same name, and no other field differs."""
    return a["noted"] & ~b["noted"] & (a["named"] == b["named"]) & (a["alike"] == b["alike"])


def may_have_more_tracks(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Same name, format, length and start and another number of tracks: one may be a reduced copy of the other."""
    good = (a["channels"] != b["channels"]) & a["good"] & b["good"] & (a["named"] == b["named"])
    return F.coalesce(reduce(lambda x, y: x & y, [a[n] == b[n] for n in FORMAT], good), F.lit(False))


def better_copies(files: DataFrame, key: str, group: list[str], fields: dict[str, Column], block: int = 8_192) -> DataFrame:
    """(a, b, adds, more): every two files of one group, by key, with adds_notes and may_have_more_tracks. The name is
    among the group's columns, so it isn't compared again.

    The pairs grow with the square of a group. A group of more rows than block is cut into blocks by key, and each
    two blocks meet on their own, so a task holds one block, and a large group is the work of many tasks. Both sides
    are dealt to a fixed number of tasks, as their few bytes would be put together for the work of their pairs."""
    spark = files.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    own = {n: c for n, c in compared(fields).items() if n != "named"}
    rows = files.select(*group, F.col(key).alias("_key"), *(c.alias(f"_{n}") for n, c in own.items()))
    large = rows.groupBy(*group).agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks")).where("_blocks > 1")  # few: one at most for a block of rows
    blocks = F.coalesce("_blocks", F.lit(1))
    rows = rows.join(F.broadcast(large), group, "left").withColumn("_own", F.pmod(F.xxhash64("_key"), blocks).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("_blocks")

    def side(letter: str, first: str, second: str) -> DataFrame:
        d = rows.select(*group, F.col(first).alias("_i"), F.col(second).alias("_j"), *(F.col(f"_{n}").alias(f"{letter}_{n}") for n in ("key", *own)))
        return d.repartition(tasks, *group, "_i", "_j")

    both = side("a", "_own", "_other").join(side("b", "_other", "_own").hint("merge"), [*group, "_i", "_j"]).where("a_key <> b_key")
    a, b = ({n: F.col(f"{letter}_{n}") for n in own} | {"named": F.lit("")} for letter in "ab")
    return both.select(F.col("a_key").alias("a"), F.col("b_key").alias("b"), adds_notes(a, b).alias("adds"), may_have_more_tracks(a, b).alias("more"))


def keep_folders(files: DataFrame, group: list[str], folder: str, containers: list[str]) -> DataFrame:
    """Each group's folders, best first (rank 1): outside containers, with most files, least deep, by name."""
    counts = files.groupBy(*group, folder).agg(F.count("*").alias("files"))
    inside = F.exists(paths.parts(F.col(folder)), lambda x: F.lower(x).isin([c.lower() for c in containers])) if containers else F.lit(False)
    depth = F.length(folder) - F.length(F.replace(F.col(folder), F.lit("/"), F.lit("")))
    order = [inside, F.col("files").desc(), depth, F.col(folder)]
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long"))


def project_name(files: DataFrame, group: list[str], name: str, folder: str) -> DataFrame:
    """The name that a group's project keeps: that of most files, then one that a folder has, then the one
    with most spaces, then the last by alphabet."""
    each = files.groupBy(*group, F.col(name).alias("name")).agg(F.count("*").alias("files"))
    named = files.select(*group, F.lower(names.basename(F.regexp_replace(folder, "/+$", ""))).alias("_folder")).distinct().withColumn("_named", F.lit(1))
    both = each.withColumn("_folder", F.lower("name")).join(named, [*group, "_folder"], "left")
    spaces = F.length("name") - F.length(F.replace("name", F.lit(" "), F.lit("")))
    return both.groupBy(*group).agg(F.max_by("name", F.struct("files", F.coalesce("_named", F.lit(0)).alias("named"), spaces.alias("spaces"), "name")).alias("name"))
