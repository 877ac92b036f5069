import random

import corpus_pipeline
import xxhash
from pyspark.sql import functions as F

from reelspark.llm import simhash as S


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints_and_components_equal_brute_force(docs):
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    fps = [brute_fingerprint(r["text"]) for r in rows]
    roots = brute_components(fps)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in S.simhash_groups(docs).collect()}
    assert len(got) == len(rows)
    for r, fp, root in zip(rows, fps, roots):
        assert got[r["doc_id"]] == (f"{fp:016x}", rows[root]["doc_id"])


def test_chains_and_large_groups(spark):
    """Fingerprints one or two bits apart in a chain, and a dense group: one component each, none lost."""
    rng = random.Random(4)
    chain = [0]
    for k in range(40):
        chain.append(chain[-1] ^ (1 << k) ^ (1 << (63 - k)) if k < 30 else chain[-1] ^ (1 << (63 - k // 2)))
    middle = rng.getrandbits(64)
    dense = [middle ^ (1 << a) for a in range(64)] + [middle]
    lone = [rng.getrandbits(64) for _ in range(300)]
    fps = list(dict.fromkeys(chain + dense + lone))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    d = spark.createDataFrame([(f,) for f in signed], "fp long")
    near = S.links(d)
    found = {r["node"]: r["root"] for r in S.components(near).collect()}
    groups = {}
    for k, r in enumerate(brute_components(fps)):
        groups.setdefault(r, []).append(signed[k])
    for members in groups.values():
        assert {found.get(m, m) for m in members} == {min(members)}


def test_cell_distance_is_a_lower_bound(spark):
    rng = random.Random(1)
    pairs = []
    for _ in range(50):
        a = rng.getrandbits(64)
        pairs.append((a, a ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))))
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    d = spark.createDataFrame([(sign(a), sign(b)) for a, b in pairs], "a long, b long")
    assert d.where(~F.arrays_overlap(S.cells(F.col("a")), S.cells(F.col("b")))).count() == 0


def test_odd_rows(odd_docs, no_docs):
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in S.simhash_groups(odd_docs).collect()]
    assert len(got) == odd_docs.count()
    by = {g[0]: g for g in got}
    assert {by[k][1] for k in (1, 2, 6)} == {"0" * 16} and {by[k][2] for k in (1, 2, 6)} == {1}
    assert by[4][2] == 3 and by[None][2] is None and [g[0] for g in got].count(5) == 2
    kept = S.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=lambda x: (x is None, x)) == [1, 3, 5, 7, 8, 9, 10, 11, 12, None]
    assert S.simhash_groups(no_docs).count() == 0 and S.drop_near_duplicates(no_docs).count() == 0


def brute_near(texts, size=5):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))})
    return [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]


def test_near_copies_of_the_stage_equal_brute_force(spark):
    """Copies with changed words (more than 2 bits apart), a chain of them, and texts just below the bound."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=6))
    texts = []
    for _ in range(60):
        base = [word() for _ in range(150)]
        texts.append(" ".join(base))
        for changes in (1, 2, 3, 5, 12):
            other = list(base)
            for at in rng.sample(range(150), changes):
                other[at] = word()
            texts.append(" ".join(other))
    base = [word() for _ in range(200)]
    for k in range(0, 30, 3):
        base[k * 6] = word()
        texts.append(" ".join(base))
    rng.shuffle(texts)
    roots = list(range(len(texts)))
    pairs = brute_near(texts)
    for _ in range(20):
        for i, j in pairs:
            roots[i] = roots[j] = min(roots[i], roots[j])
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, d, "").collect()}
    assert kept == {i for i, r in enumerate(roots) if i == r}
    assert len(kept) < S.drop_near_duplicates(d).count()


def test_null_and_repeated_ids_keep_their_texts(spark):
    rows = [(1, "alpha beta gamma delta epsilon"), (1, "one two three four five six"), (1, "one two three four five six"), (None, "red green blue"), (None, "red green blue"), (None, "RED green blue"), (None, "black"), (2, None), (3, "")]
    got = S.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    seen = sorted(((r["doc_id"], (r["text"] or "").lower()) for r in got), key=str)
    assert seen == sorted([(1, rows[0][1]), (1, rows[1][1]), (None, "red green blue"), (None, "black"), (2, "")], key=str)


def test_cells_of_every_fullness_find_the_same_links(spark):
    """Families of 1 to 200 fingerprints: all cells compared in pairs, or all but the smallest by variants."""
    rng = random.Random(9)
    fps = set()
    for size in (1, 2, 3, 10, 40, 200):
        middle = rng.getrandbits(64)
        fps |= {middle} | {middle ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(size)}
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    roots = brute_components([f % (1 << 64) for f in fps])
    want = {}
    for f, r in zip(fps, roots):
        want.setdefault(r, []).append(f)
    d = spark.createDataFrame([(f,) for f in fps], "fp long")
    for few in (2, 16, 10_000):
        found = {r["node"]: r["root"] for r in S.components(S.links(d, few)).collect()}
        for members in want.values():
            assert {found.get(m, m) for m in members} == {min(members)}


def test_strangers_share_no_cell(spark):
    """Of 300,000 random fingerprints no cell holds three, and none that differ in more bits are linked."""
    d = spark.range(300_000).select(F.xxhash64("id").alias("fp"))
    full = d.select(F.explode(S.cells(F.col("fp"))).alias("key")).groupBy("key").count().where("count > 2")
    assert full.count() == 0 and S.links(d).count() == 0


def test_unlike_texts_of_one_id_stay(spark):
    rows = [(1, "aa bb cc dd ee"), (1, "zz yy xx ww vv"), (2, "aa bb cc dd ee"), (None, "aa bb cc dd ee")]
    for drop in (S.drop_near_duplicates, S.drop_near_copies):
        kept = sorted((r["doc_id"], r["text"]) for r in drop(spark.createDataFrame(rows, "doc_id long, text string")).collect())
        assert kept == [(1, "aa bb cc dd ee"), (1, "zz yy xx ww vv")]


def test_groups_that_one_hub_leaves_open_lose_no_link(spark):
    """A family in which few members are alike enough to any one of them, beside strangers that share its passages."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=6))
    base, texts = [word() for _ in range(120)], []
    for _ in range(120):
        other = list(base)
        for at in rng.sample(range(120), rng.choice([1, 2, 3, 4])):
            other[at] = word()
        texts.append(" ".join(other))
    for _ in range(60):
        texts.append(" ".join(base[: rng.randrange(60, 110)] + [word() for _ in range(rng.randrange(10, 40))]))
    rng.shuffle(texts)
    roots = list(range(len(texts)))
    pairs = brute_near(texts)
    for _ in range(40):
        for i, j in pairs:
            roots[i] = roots[j] = min(roots[i], roots[j])
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r["doc_id"] for r in S.drop_near_copies(d).collect()} == {i for i, r in enumerate(roots) if i == r}


def test_near_copies_meet_by_their_fingerprints(spark):
    """With MinHash keys that no two sets share, near copies within 2 bits are still found and strangers aren't."""
    rng = random.Random(13)
    words = [["".join(rng.choices("abcdefghijkl", k=6)) for _ in range(900)] for _ in range(12)]
    texts = [" ".join(w) for w in words] + [" ".join([*w[:-1], "other"]) for w in words]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    nodes = S.cut(S.keyed_rows(d).groupBy("h").agg(F.first("fp").alias("fp"), S._first()).withColumn("keys", F.array("h")))
    fps = [S.set_fingerprint(S.shingle_set(t)) for t in texts]
    close = {k for k in range(12) if (fps[k] ^ fps[k + 12]).bit_count() <= 2}
    of = {r["h"]: r["first"]["doc_id"] for r in nodes.collect()}
    found = {}
    for r in S.near_roots(d, nodes).collect():
        found.setdefault(r["root"], {of[r["root"]] % 12}).add(of[r["node"]] % 12)
    assert len(close) >= 6 and sorted(map(sorted, found.values())) == sorted([k] for k in close)
