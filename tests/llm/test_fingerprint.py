import hashlib

import pytest

from reelspark.llm import fingerprint as P
from reelspark.llm.fingerprint import MultisetHash


def test_multiset_laws():
    a, b = [b"one", b"two", b"three"], [b"four"]
    whole = MultisetHash().insert(a + b)
    assert whole == MultisetHash().insert(b + a[::-1]) == MultisetHash().insert(a) + MultisetHash().insert(b)
    assert MultisetHash().insert(a + b).delete(b) == MultisetHash().insert(a)
    assert whole != MultisetHash().insert(a + b + b) and MultisetHash.from_hex(whole.hex()) == whole
    assert whole.likeness(whole) == 1.0 and MultisetHash().likeness(whole) == 0.0 and MultisetHash().likeness(MultisetHash()) == 1.0


def test_likeness_follows_the_share_in_common():
    items = [f"paragraph {k}".encode() for k in range(100)]
    whole = MultisetHash().insert(items)
    for share in (0.9, 0.5, 0.1):
        n = int(100 * share)
        other = MultisetHash().insert(items[:n] + [f"other {k}".encode() for k in range(100 - n)])
        assert whole.likeness(other) == pytest.approx(share, abs=0.3)


def brute(rows):
    out = []
    for k, (i, t) in enumerate(rows):
        text, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        new = text[: len(text) - len(text) // 2] + nxt[: len(text) // 2]
        a, e, b = MultisetHash.of(text), MultisetHash.of(new), MultisetHash.of(nxt)
        out.append((i, len(text), hashlib.sha256(new.encode()).hexdigest(), a.hex(), e.hex(), a.likeness(e), a.likeness(b)))
    return out


def ordered(frame):
    from pyspark.sql import functions as F

    rows = frame.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")).collect()
    return [(r["doc_id"], r["text"]) for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["th"]))]


@pytest.mark.parametrize("per", [2000, 7])
def test_equals_brute_force(docs, odd_docs, monkeypatch, per):
    monkeypatch.setattr(P, "ROWS_PER_BUCKET", per)
    for frame in (docs, odd_docs, docs.limit(1)):
        got = sorted(map(tuple, P.edit_likeness(frame).collect()), key=repr)
        assert got == sorted(brute(ordered(frame)), key=repr)


def test_no_rows(no_docs):
    assert P.edit_likeness(no_docs).count() == 0 and P.fingerprints(no_docs).count() == 0


@pytest.mark.parametrize("n", [32_767, 32_768, 40_000, 70_000])
def test_likeness_of_repeated_paragraphs(n):
    """A multiset of one paragraph is like any other of it, however often it is there."""
    line = b"the same line"
    whole, half = MultisetHash().insert([line] * n), MultisetHash().insert([line] * (n // 2))
    assert whole.likeness(half) == pytest.approx(1.0) and whole != half
    assert MultisetHash.from_hex(whole.hex()) == whole


def test_likeness_equals_the_cosine_of_plain_sums(docs):
    """Brute force with a dictionary of paragraphs and unbounded numbers."""
    from collections import Counter

    texts = [r["text"] for r in docs.orderBy("doc_id").limit(40).collect()]

    def lanes(text):
        total = [0] * P.LANES
        for item, times in Counter(P.paragraphs(text or "")).items():
            raw = hashlib.blake2b(item, digest_size=P.LANES // 8 + 8 * P.WIDE).digest()
            for k in range(P.LANES):
                total[k] += times * (1 if raw[k // 8] >> (7 - k % 8) & 1 else -1)
        return total

    for a, b in zip(texts, texts[1:]):
        x, y = lanes(a), lanes(b)
        norm = (sum(v * v for v in x) * sum(v * v for v in y)) ** 0.5
        want = 1.0 if a == b else max(0.0, sum(v * w for v, w in zip(x, y)) / norm) if norm else 0.0
        assert MultisetHash.of(a).likeness(MultisetHash.of(b)) == pytest.approx(want)


def test_hot_ids_are_split(spark, monkeypatch):
    """A third of the rows without id, a third with one id: ranges cut them by text, and each row has its next."""
    monkeypatch.setattr(P, "ROWS_PER_BUCKET", 50)
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, f"text {k % 400}. more {k % 11}.") for k in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(map(tuple, P.edit_likeness(frame).collect()), key=repr)
    assert got == sorted(brute(ordered(frame)), key=repr)
    sizes = [r["count"] for r in P.beside_next(frame).where("last = 0").groupBy("bucket").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) < 300


def test_rows_alike_are_dealt_to_many_tasks(spark, monkeypatch):
    """Most rows without id and of one text, as many of one id and text: each is its copy's next, and no bucket holds them all."""
    monkeypatch.setattr(P, "ROWS_PER_BUCKET", 50)
    rows = [(None, "the same. text.")] * 4000 + [(5, "another one. of many.")] * 1500 + [(k, f"text {k}.") for k in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sorted(map(tuple, P.edit_likeness(frame).collect()), key=repr)
    assert got == sorted(brute(ordered(frame)), key=repr)
    each = P.beside_next(frame).groupBy("bucket", "last").count().collect()
    assert sum(r["count"] for r in each if r["last"] != 1) == len(rows) and max(r["count"] for r in each) < 300
    assert all(r["count"] <= 6 for r in each if r["last"] == 1)
