"""SimHash fingerprints of documents and near-duplicate groups among them.

Candidates come from a segment-popcount embedding: a fingerprint maps to the bit counts of its
thirty-two 2-bit segments, and the Manhattan distance of two such vectors never exceeds the Hamming
distance of the fingerprints. Two vectors within distance 2 have a vector within 1 of both, so
each fingerprint is put into its own grid cell and the (about 48) cells beside it, and fingerprints
that share a cell are candidates. They are verified exactly in their cell: the two members of a cell
at once, those of a cell of up to FEW by their bits, pair by pair. Only members of a fuller cell (a
family of near copies, as strangers share a cell with a probability of 2e-11) are verified by the
variants that differ from them in one bit: two fingerprints differ in at most 2 bits exactly if they
share one, and all of a variant's members are linked to the smallest, so a family of any size costs a
bounded number of rows for each member.

Defined results: a null text counts as empty; a text without words has fingerprint zero and links
like any other; a null doc_id gets the smallest non-null id reachable, or null; repeated rows stay;
an empty table gives none; further columns, whatever their names, don't matter. A text's shingles are
hashed in chunks, so a very long one needs no more memory than its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import cut, id_and_text, lower_words, release

SHINGLE = 3
SEED = 42
#: Shingles hashed at a time, so that a very long text needs no more memory for its bits.
CHUNK = 1 << 15
#: Members of a cell that are compared pair by pair, and rows of a table that may be broadcast.
FEW = 16
SMALL = 500_000
#: Links for which the rounds of the components take another task.
PER_TASK = 200_000


def shingles(words: list[bytes], size: int = SHINGLE) -> Iterator[bytes]:
    if not words:
        return iter(())
    if len(words) < size:
        return iter((b" ".join(words),))
    return map(b" ".join, zip(*(islice(words, k, None) for k in range(size))))


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    return np.unpackbits(hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)


def _majority(ones: np.ndarray, total: int) -> int:
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprint(text: str | None) -> int:
    """Majority bits of the shingles' XXH64, as a signed 64-bit number."""
    words = lower_words(text)
    total, ones = 0, np.zeros(64, np.int64)
    it = shingles(words)
    digest = xxhash.xxh64_intdigest
    while chunk := [digest(s, SEED) for s in islice(it, CHUNK)]:
        ones += _ones(np.array(chunk, "<u8"))
        total += len(chunk)
    return _majority(ones, total)


def set_fingerprint(hashes: np.ndarray) -> int:
    """As fingerprint, of a set of shingles' hashes, each counted once."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), CHUNK):
        ones += _ones(hashes[k : k + CHUNK])
    return _majority(ones, len(hashes))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: The low bit of each segment.
LOW = 0x5555555555555555


def popcounts(fp: Column) -> Column:
    """Bit counts (0 to 2) of the thirty-two 2-bit segments, each in its own two bits of a long."""
    low, high = fp.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW))
    return F.call_function("shiftleft", low.bitwiseAND(high), F.lit(1)).bitwiseOR(low.bitwiseXOR(high))


def cells(fp: Column) -> Column:
    """The embedding's own grid cell and those at Manhattan distance 1."""
    own = popcounts(fp)
    beside = []
    for k in range(32):
        count = own.bitwiseAND(F.lit(_signed(3 << (2 * k))))
        # 0 and 1 differ in the low bit of a count, 1 and 2 in both.
        beside += [F.when(count != _signed(2 << (2 * k)), own.bitwiseXOR(F.lit(_signed(1 << (2 * k))))), F.when(count != 0, own.bitwiseXOR(F.lit(_signed(3 << (2 * k)))))]
    return F.array_compact(F.array(own, *beside))


def variants(fp: Column) -> Column:
    """The fingerprint and all that differ from it in one bit."""
    return F.array(fp, *(fp.bitwiseXOR(F.lit(_signed(1 << k))) for k in range(64)))


def stars(fps: DataFrame, keys: Column) -> DataFrame:
    """(u, v): each fingerprint with the smallest one that shares a key with it. Groups are summed
    before the shuffle and members meet their group's smallest by a join, which the engine may split;
    no group is gathered in a task."""
    rows = fps.select("fp", F.explode(keys).alias("key"))
    groups = rows.groupBy("key").agg(F.min("fp").alias("v"), F.max("fp").alias("most")).where("v < most").select("key", "v")
    return rows.join(groups, "key").where("fp <> v").select(F.col("fp").alias("u"), "v")


def small_enough(df: DataFrame, rows: int = SMALL) -> bool:
    """Whether a written table has few enough rows to be broadcast."""
    return df.limit(rows + 1).count() <= rows


def links(unique: DataFrame, few: int = FEW) -> DataFrame:
    """(u, v), v < u: links among distinct fingerprints (fp) whose closure is that of all pairs within 2 bits."""
    rows = unique.select("fp", F.explode(cells(F.col("fp"))).alias("key"))
    groups = rows.groupBy("key").agg(F.min("fp").alias("least"), F.max("fp").alias("most"), F.count("*").alias("n"))
    # Where strangers meet by chance they are two, and are told apart here.
    groups = cut(groups.where("n > 2 or (n = 2 and bit_count(least ^ most) <= 2)"))
    pairs = groups.where("n = 2").select(F.col("most").alias("u"), F.col("least").alias("v"))
    full = groups.where("n > 2").select("key", "n")
    if full.isEmpty():
        return pairs
    members = rows.join(F.broadcast(full) if small_enough(full) else full, "key")
    held = members.where(F.col("n") <= few).groupBy("key").agg(F.collect_list("fp").alias("fps"))  # at most `few` members
    near = held.select("fps", F.explode("fps").alias("u")).select("u", F.explode(F.filter("fps", lambda x: (x < F.col("u")) & (F.bit_count(x.bitwiseXOR(F.col("u"))) <= 2))).alias("v"))
    many = cut(members.where(F.col("n") > few).select("fp").distinct())
    if many.isEmpty():
        return pairs.unionByName(near)
    return pairs.unionByName(near).unionByName(stars(_spread(many), variants(F.col("fp"))))


def _spread(df: DataFrame) -> DataFrame:
    """df dealt to the session's number of partitions: few bytes now and many rows after explode."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.columns[0])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges(u, v), root being the smallest node reachable.

    Alternating large-star and small-star steps; each round is written to the shared checkpoint
    folder, and the one before it removed. Links stay distributed: only a count and a checksum reach the driver.
    """

    def checksum(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    held = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = checksum(held)
    # Links that are few are held together, so that rounds don't write a file for each partition and shuffle.
    width = 1 + int(before[0]) // PER_TASK
    done = not before[0]
    now = held.coalesce(width)
    while not done:  # each round lowers some node's neighbour, or is the last
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(width)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(width).distinct().coalesce(width)
        smallest = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(width)
        small = large.join(smallest, "u").coalesce(width)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        after_df = cut(small.where("u <> v").coalesce(width).distinct().coalesce(width))
        release(held)  # the round before
        after = checksum(after_df)
        now, held, done, before = after_df, after_df, after == before, after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id of every row."""
    rows = cut(fingerprints(docs))
    unique = cut(_spread(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))))
    roots = components(links(unique.select("fp")))
    rooted = unique.join(roots, unique["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return rows.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _first() -> Column:
    """The first row of a group: smallest doc_id (null last), then by the hash of its text."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first")


def _repeated(rows: DataFrame) -> bool:
    """Whether some rows repeat both id and text."""
    return not rows.groupBy("doc_id", "th").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def _only_first(docs: DataFrame, nodes: DataFrame, roots: DataFrame, repeated: bool) -> DataFrame:
    """docs with the first row of each group; nodes: node and first. Of rows that repeat both id and
    text, that with the smallest hash of its columns stays."""
    rooted = nodes.join(roots, "node", "left")
    kept = cut(rooted.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("id"), F.col("first.th").alias("th")))
    plain = [docs[f.name] for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    own = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.xxhash64(*plain).alias("tie"), docs["doc_id"].cast("long").alias("own_id"), F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))).alias("own_th"))
    here = F.broadcast(kept) if small_enough(kept) else kept
    found = own.join(here, own["own_id"].eqNullSafe(here["id"]) & (own["own_th"] == here["th"]))
    if repeated:
        found = found.groupBy("own_id", "own_th").agg(F.min_by("row", "tie").alias("row"))
    return found.select("row.*")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of fingerprints: that with the smallest doc_id (null last).

    Rows that share an id but neither text nor fingerprint are documents of their own and stay."""
    made = F.pandas_udf(lambda texts: texts.map(fingerprint), "long")
    rows = cut(id_and_text(docs).select("doc_id", F.xxhash64("text").alias("th"), made("text").alias("fp")))
    nodes = cut(_spread(rows.groupBy(F.col("fp").alias("node")).agg(_first())))
    return _only_first(docs, nodes, components(links(nodes.select(F.col("node").alias("fp")))).select("node", "root"), _repeated(rows))


# Near copies by the likeness of word shingles: two texts are near copies if the Jaccard likeness of
# their sets of five-word shingles is at least 0.8. Candidates are the members of a SimHash group: sets whose
# fingerprints are linked through the cells of the popcount embedding, as op4's are. A fingerprint of 64 bits
# can't select all copies alone (a pair of likeness 0.8 differs in 9.7 bits on average, and any radius that holds
# nearly all of them holds too many strangers), so further candidates share one of BANDS MinHash keys of WIDE
# values each (a pair of likeness 0.8 shares none with a probability below 1e-4). All are verified on the whole
# sets of shingles' hashes; a SimHash group is a key like any other.
# In a key's group members are first compared with one hub, that with the most neighbours, which is the
# same for a family's keys, so a family costs a few pairs for each member. Groups in which more than one
# component is left get another hub, the member with the fewest shingles of its own; last of all their
# outsiders are compared with the members of other components that they may be like at all: of the hub's
# shingles two members share those that both have, and beyond these at most what no other set lacks. That
# bound is exact and leaves out nearly all of a loose family. So every pair that shares a key is compared,
# already linked, or too unlike by the bound.
#: Words of a shingle and least likeness of near copies.
NEAR_SHINGLE, NEAR = 5, 0.8
BANDS, WIDE = 24, 5
_RNG = np.random.default_rng(SEED)
_MASKS = _RNG.integers(0, 1 << 64, BANDS * WIDE, np.uint64)[:, None]
_FACTORS = (_RNG.integers(0, 1 << 64, BANDS * WIDE, np.uint64) | np.uint64(1))[:, None]


def shingle_set(text: str | None, size: int = NEAR_SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 of the text's shingles."""
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, SEED) for s in shingles(lower_words(text), size)), np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys, each of WIDE MinHash values; a set without members has keys of its own."""
    least = np.full(BANDS * WIDE, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 2048):
        mixed = (hashes[None, k : k + 2048] ^ _MASKS) * _FACTORS
        mixed ^= mixed >> np.uint64(32)
        np.minimum(least, mixed.min(axis=1), out=least)
    rows = least.reshape(BANDS, WIDE)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], np.uint64).view(np.int64)


def keyed_rows(docs: DataFrame, size: int = NEAR_SHINGLE) -> DataFrame:
    """doc_id, th (hash of the text), h (of the set of shingles), fp (its fingerprint) and MinHash keys of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, fps, keys = [], [], []
            for t in batch.column(1):
                found = shingle_set(t.as_py(), size)
                fps.append(set_fingerprint(found))
                hs.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                keys.append(band_keys(found))
            flat = pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.array(hs, np.uint64).view(np.int64)), pa.array(fps, pa.int64()), lists], ["doc_id", "th", "h", "fp", "keys"])

    return id_and_text(docs).withColumn("th", F.xxhash64("text")).mapInArrow(run, "doc_id long, th long, h long, fp long, keys array<long>")


def simhash_keys(nodes: DataFrame) -> DataFrame:
    """h and key of each node (h, fp): one key for all nodes whose fingerprints are linked within 2 bits, written."""
    unique = cut(_spread(nodes.select("fp").distinct()))
    roots = components(links(unique))
    found = nodes.select("h", "fp").join(F.broadcast(roots) if small_enough(roots) else roots, F.col("fp") == F.col("node"), "left")
    return cut(found.select("h", F.xxhash64(F.lit("simhash"), F.coalesce("root", "fp")).alias("key")))


def sets_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, size: int, repeated: bool) -> DataFrame:
    """h and hashes, the written sets of shingles, of the wanted nodes (h)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t.as_py(), size).tobytes() for t in batch.column(1)], pa.binary())], ["h", "hashes"])

    found = cut(wanted.join(nodes, "h").select("h", F.col("first.doc_id").alias("id"), F.col("first.th").alias("wanted_th")))
    texts = id_and_text(docs).withColumn("th", F.xxhash64("text"))
    here = F.broadcast(found) if small_enough(found) else found
    texts = texts.join(here, texts["doc_id"].eqNullSafe(here["id"]) & (texts["th"] == here["wanted_th"]))
    made = texts.select("h", "text").mapInArrow(run, "h long, hashes binary")
    return cut(made.groupBy("h").agg(F.min("hashes").alias("hashes")) if repeated else made)


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs (u, v) of nodes those whose whole sets of shingles have the likeness, written."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for a, b in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= similarity * max(len(x), len(y)) else 0
                near.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(near, pa.bool_()))

    left = sets.select(F.col("h").alias("u"), F.col("hashes").alias("a"))
    right = sets.select(F.col("h").alias("v"), F.col("hashes").alias("b"))
    return cut(pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(verify, "u long, v long"))


def lone_counts(sets: DataFrame) -> DataFrame:
    """h, n (members of the set) and lone (those that no other of the sets has)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(x.as_py(), np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), [len(x) for x in found])), pa.array(np.concatenate(found) if found else np.empty(0, np.int64))], ["h", "shingle"])

    each = sets.mapInArrow(run, "h long, shingle long")
    lone = each.groupBy("shingle").agg(F.min("h").alias("h"), F.count("*").alias("k")).where("k = 1").groupBy("h").agg(F.count("*").alias("lone"))
    sizes = sets.select("h", (F.octet_length("hashes") / 8).cast("long").alias("n"))
    return sizes.join(lone, "h", "left").select("h", "n", F.coalesce("lone", F.lit(0)).alias("lone"))


def hub_masks(members: DataFrame, sets: DataFrame) -> DataFrame:
    """h, hub, mask (which of the hub's sorted shingles the member has, 64 to a long) and inside (how many), of each pair of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, inside = [], []
            for a, b in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                has = np.zeros(-(-len(y) // 64) * 64, bool)
                has[np.intersect1d(x, y, assume_unique=True, return_indices=True)[2]] = True
                inside.append(int(has.sum()))
                masks.append(np.packbits(has, bitorder="little").view(np.int64))
            ends = np.cumsum([0, *map(len, masks)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(masks) if masks else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, pa.array(inside, pa.int64())], ["h", "hub", "mask", "inside"])

    pairs = members.select("h", "hub").distinct()
    left = sets.select("h", F.col("hashes").alias("a"))
    right = sets.select(F.col("h").alias("hub"), F.col("hashes").alias("b"))
    return pairs.join(left, "h").join(right, "hub").select("h", "hub", "a", "b").mapInArrow(run, "h long, hub long, mask array<long>, inside long")


def _may_link(similarity: float) -> Column:
    """Whether a member and an outsider of a group can have the likeness: of the hub's shingles they share
    those that both have, and of others at most what is not lone in either."""
    both = F.aggregate(F.zip_with("mask", "o.mask", lambda x, y: F.bit_count(x.bitwiseAND(y)).cast("long")), F.lit(0).cast("long"), lambda t, x: t + x)
    outside = lambda p: F.col(f"{p}n") - F.col(f"{p}lone") - F.col(f"{p}inside")
    shared = both + F.greatest(F.lit(0), F.least(outside(""), outside("o.")))
    return shared >= F.lit(similarity) * (F.col("n") + F.col("o.n") - shared)


def _open(live: DataFrame, roots: DataFrame) -> DataFrame:
    """key, h and c (component) of the groups in which more than one component is left."""
    labelled = live.select("key", "h").join(roots, F.col("h") == F.col("node"), "left").select("key", "h", F.coalesce("root", "h").alias("c"))
    more = labelled.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key")
    return cut(labelled.join(more, "key"))


def near_roots(docs: DataFrame, nodes: DataFrame, size: int = NEAR_SHINGLE, similarity: float = NEAR, repeated: bool = True) -> DataFrame:
    """(node, root) of nodes (h, fp, keys, first) that have near copies."""
    ordered = lambda df, a, b: df.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()
    rows = nodes.select("h", F.explode("keys").alias("key")).unionByName(simhash_keys(nodes))
    groups = cut(rows.groupBy("key").agg(F.min("h").alias("u"), F.max("h").alias("v"), F.count("*").alias("members")).where("members > 1"))
    full = groups.where("members > 2").select("key", "members")
    live = cut(rows.join(F.broadcast(full) if small_enough(full) else full, "key"))
    popular = live.groupBy("h").agg(F.sum("members").alias("met"))
    hubs = live.join(popular, "h").groupBy("key").agg(F.max_by("h", F.struct("met", "h")).alias("hub"))
    tested = cut(groups.where("members = 2").select("u", "v").unionByName(ordered(live.join(hubs, "key").where("h <> hub"), "h", "hub")).distinct())
    needed = tested.select(F.col("u").alias("h")).unionByName(tested.select(F.col("v").alias("h"))).distinct()
    sets = sets_of(docs, nodes, needed, size, repeated)
    found = verified(tested, sets, similarity)
    roots = components(found)
    live = _open(live, roots)
    if live.isEmpty():
        return roots
    # Another hub for the groups that are open: the member with the fewest shingles of its own.
    lone = cut(lone_counts(sets.join(live.select("h").distinct(), "h", "left_semi")))
    member = live.join(lone, "h").where(F.col("n") - F.col("lone") >= F.lit(similarity) * F.col("n"))
    hubs = member.groupBy("key").agg(F.min_by(F.struct("h", "c"), F.struct(F.col("lone") / F.col("n"), "h")).alias("b")).select("key", F.col("b.h").alias("hub"), F.col("b.c").alias("hub_c"))
    member = cut(member.join(hubs, "key"))
    pairs = cut(ordered(member.where("c <> hub_c"), "h", "hub").join(tested, ["u", "v"], "left_anti"))
    more = verified(pairs, sets, similarity)
    tested, found = tested.unionByName(pairs), found.unionByName(more)
    roots = components(found)
    # Outsiders of what is open still: those that a member may be like, by what both have of the hub.
    live = _open(member, roots)
    if live.isEmpty():
        return roots
    counts = live.groupBy("key", "c").agg(F.count("*").alias("members"))
    main = counts.groupBy("key").agg(F.max_by("c", F.struct("members", "c")).alias("main"))
    member = member.select("key", "h", "hub").join(live, ["key", "h"]).join(main, "key")
    member = cut(member.join(lone, "h").join(cut(hub_masks(member, sets)), ["h", "hub"]))
    outside = member.where("c <> main").select("key", F.struct("h", "c", "n", "lone", "mask", "inside").alias("o"))
    pairs = member.join(outside, "key").where((F.col("c") != F.col("o.c")) & (F.least("n", "o.n") >= F.lit(similarity) * F.greatest("n", "o.n")) & _may_link(similarity))
    pairs = cut(ordered(pairs, F.col("h"), F.col("o.h")).join(tested, ["u", "v"], "left_anti"))
    if pairs.isEmpty():
        return roots
    more = verified(pairs, sets, similarity)
    return roots if more.isEmpty() else components(found.unionByName(more))


def drop_near_copies(docs: DataFrame, size: int = NEAR_SHINGLE, similarity: float = NEAR) -> DataFrame:
    """docs with one row of each group of near copies: that with the smallest doc_id (a null one
    last), by the hash of its text among equal ids. Of rows that repeat both id and text one stays;
    rows that share an id alone are told apart by their texts. Null and empty texts are one group."""
    rows = cut(keyed_rows(docs, size))
    nodes = cut(_spread(rows.groupBy("h").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys"), _first())))
    repeated = _repeated(rows)
    roots = near_roots(docs, nodes, size, similarity, repeated)
    return _only_first(docs, nodes.select(F.col("h").alias("node"), "first"), roots, repeated)
