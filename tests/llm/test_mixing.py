from collections import Counter

import numpy as np
import pytest

from reelspark.llm import mixing as M


def test_targets():
    assert M.targets([100, 100, 100], [5, 2, 1]) == pytest.approx([200.0, 250 * 2 / 3, 250 / 3])
    assert M.targets([0, 10], [5, 2]) == [0.0, 15.0] and M.targets([], []) == []
    sizes, weights = [7, 300, 20, 1000, 5], [5, 2, 1, 5, 2]
    got = M.targets(sizes, weights)
    assert sum(got) == pytest.approx(1.5 * sum(sizes)) and all(t <= 2 * s + 1e-9 for t, s in zip(got, sizes))
    free = [t / w for t, s, w in zip(got, sizes, weights) if t < 2 * s - 1e-9]
    assert max(free) - min(free) < 1e-9


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000, 4097])
def test_permutation(n):
    assert sorted(M.permuted(np.arange(n), n, 12345).tolist()) == list(range(n))


def test_shards_share_out_the_slots(monkeypatch):
    monkeypatch.setattr(M, "SLOTS_PER_SHARD", 100)
    p = M.plan({"=b": 64 * 300, "=a": 64 * 40, "": 64 * 90, "=é": 64 * 8})
    assert p.keys == ["=a", "=b", "=é", ""]
    firsts, counts = zip(*(M.shard_counts(k, p) for k in range(p.shards)))
    assert np.array_equal(sum(counts), p.slots) and all(c.sum() == 100 for c in counts[:-1])
    assert all(np.array_equal(f, sum(counts[:k], np.zeros(4, np.int64))) for k, f in enumerate(firsts))


def check(frame):
    rows = [r.asDict() for r in M.taken(frame).collect()]
    want = Counter((r["doc_id"], len((r["text"] or "").encode().split())) for r in frame.collect())
    assert Counter((r["doc_id"], r["size"]) for r in rows) == want
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    return rows


def test_taken_words_come_near_the_targets(docs):
    rows = check(docs)
    assert rows == check(docs)  # reruns agree, row by row or not at all
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    by = Counter()
    for r in rows:
        by[source[r["doc_id"]]] += r["taken"]
    aim = {source[r["doc_id"]]: r["target"] for r in rows}
    assert all(abs(by[s] - aim[s]) <= max(M.BLOCK, 0.02 * aim[s]) for s in aim)


def test_mixed_documents_hold_the_taken_words(docs, odd_docs):
    for frame in (docs, odd_docs):
        out = M.mix_documents(frame)
        assert out.columns == frame.columns
        got = Counter()
        for r in out.collect():
            got[r["doc_id"]] += len(r["text"].encode().split())
            assert r["n_chars"] == len(r["text"])
        want = Counter()
        for r in M.taken(frame).collect():
            want[r["doc_id"]] += r["taken"]
        assert +got == +want


def test_blocks_and_slots_join_whole(docs):
    m = M.mixed_blocks(docs).selectExpr("sum(end - begin) as n").first()["n"]
    assert m == M.taken(docs).agg({"taken": "sum"}).first()[0]


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs)
    assert M.taken(no_docs).count() == 0 and M.mix_documents(no_docs).count() == 0


def test_many_rows_without_id_and_repeated_ids(spark):
    """10,000 null ids, of which a third have one text, 3,000 rows of one id, and a source of its own for each tenth."""
    rows = [(None, "one two three" if k % 3 == 0 else f"w{k} of {k % 7} " * (k % 9), f"s{k % 10}") for k in range(10_000)] + [(5, f"t {k} " * (k % 5), "s1") for k in range(3_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = check(frame)
    assert sorted(map(str, got)) == sorted(map(str, check(frame.repartition(3))))
    out = M.mix_documents(frame)
    taken = sum(r["taken"] for r in got)
    assert sum(len(r["text"].split()) for r in out.collect()) == taken
    assert "collect_list(doc" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_starts_fill_each_stream_without_gap_or_overlap(docs, odd_docs):
    for frame in (docs, odd_docs.unionByName(odd_docs)):
        sizes = M.measured(frame)
        rows = sorted((r["source_at"], r["start"], r["size"]) for r in M.placed(sizes, M.plan_of(sizes)).collect() if r["size"])
        ends = {}
        for source, start, size in rows:
            assert start == ends.get(source, 0)
            ends[source] = start + size


def test_slots_are_replayed_to_words(spark, monkeypatch):
    """Brute force: every slot's block is looked up in the streams word by word."""
    monkeypatch.setattr(M, "BLOCK", 4)
    frame = spark.createDataFrame([(k, "w " * (k % 23), ["a", "b", None][k % 3]) for k in range(150)], "doc_id long, text string, source string")
    sizes = M.measured(frame)
    p = M.plan_of(sizes)
    streams = {}
    for r in sorted(M.placed(sizes, p).collect(), key=lambda r: r["start"]):
        streams.setdefault(r["source_at"], []).extend([r["doc_id"]] * r["size"])
    want, seen = Counter(), Counter()
    for shard in range(p.shards):
        first, counts = M.shard_counts(shard, p)
        for i, (f, c) in enumerate(zip(first, counts)):
            for number in range(f, f + c):
                turn, at = divmod(number, int(p.blocks[i]))
                block = int(M.permuted(np.array([at]), int(p.blocks[i]), (M.SEED * 1_000_003 + i) * 7 + turn)[0])
                seen[i, block] += 1
                want.update(streams[i][block * 4 : block * 4 + 4])
    assert max(seen.values()) <= 2 and sum(seen.values()) == p.total
    assert +want == +Counter({r["doc_id"]: r["taken"] for r in M.taken(frame).collect()})


@pytest.mark.parametrize("good,bad,take", [(5, 7, 4), (40, 60, 50), (3, 500, 100), (1000, 10, 700)])
def test_drawn_law_equals_the_formula(good, bad, take):
    from math import comb

    rng = np.random.default_rng(1)
    got = Counter(M.hypergeometric(good, bad, take, rng) for _ in range(20_000))
    for k in range(max(0, take - bad), min(good, take) + 1):
        p = comb(good, k) * comb(bad, take - k) / comb(good + bad, take)
        assert abs(got[k] / 20_000 - p) < 5 * (p * (1 - p) / 20_000) ** 0.5 + 2e-4


def test_draws_of_any_size_are_draws():
    """On both sides of numpy's bound the spread over seeds is that of the law."""
    for scale, most in ((1_000_000, M.NUMPY_MOST), (1_000_000, 0), (10**12, M.NUMPY_MOST)):
        counts = np.array([5 * scale, 2 * scale, scale])
        drawn = np.array([M._draw(counts, 4 * scale, np.random.default_rng(k), most) for k in range(300)])
        assert (drawn.sum(axis=1) == 4 * scale).all()
        share = counts / counts.sum()
        spread = np.sqrt(4 * scale * share * (1 - share) * 4 * scale / (8 * scale - 1))
        assert (abs(drawn.mean(axis=0) - counts / 2) < 5 * spread / np.sqrt(300)).all()
        assert (abs(drawn.std(axis=0) / spread - 1) < 0.25).all()
