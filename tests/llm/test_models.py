"""Toxicity and quality: held-out accuracy, gradients, and odd tables."""

import numpy as np
import pytest

from reelspark.llm import quality_model as Q
from reelspark.llm import toxicity as T
from reelspark.llm.common import remainder

LARGER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def larger(spark):
    return spark.read.parquet(f"{LARGER}/documents.parquet"), spark.read.parquet(f"{LARGER}/labels.parquet")


def auc(score, y):
    values, which = np.unique(score, return_inverse=True)
    rank = np.array([np.flatnonzero(np.sort(score) == v).mean() for v in values])[which]  # ties share a rank
    return (rank[y == 1].mean() - rank[y == 0].mean()) / len(y) + 0.5


@pytest.mark.parametrize("op,label,least", [(T.toxicity, "toxic", 0.97), (Q.quality, "quality", 0.99)])
def test_held_out_accuracy(larger, op, label, least):
    docs, labels = larger
    got = op(docs, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert (got.held_out == [remainder(i, 4) == 2 for i in got.doc_id]).all() and got.score.between(0, 1).all()
    assert auc(held.score.to_numpy(), held[label].to_numpy()) > least


@pytest.mark.parametrize("op", [T.toxicity, Q.quality])
def test_odd_rows(spark, odd_docs, no_docs, op):
    labels = spark.createDataFrame([(3, 1, 1), (3, 1, 1), (4, 0, 0), (5, None, None), (None, 1, 1), (99, 1, 0), (12, 0, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    got = op(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert not next(r for r in got if r["doc_id"] is None)["held_out"]
    assert {r["score"] for r in op(odd_docs, labels.limit(0)).collect()} == {0.5}
    assert op(no_docs, labels).count() == 0


def test_scores_ignore_other_columns(odd_docs, spark):
    from pyspark.sql import functions as F

    labels = spark.createDataFrame([(3, 1, 1), (7, 0, 0), (12, 1, 1)], "doc_id long, quality int, toxic int")
    a = T.toxicity(odd_docs, labels).collect()
    b = T.toxicity(odd_docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("q")), labels).collect()
    assert sorted(map(repr, a)) == sorted(map(repr, b))


def test_factorization_machine_learns_a_pair():
    """Label 1 only where two terms meet: weights alone can't say that, interactions can."""
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (1200, 2))
    y = (x[:, 0] & x[:, 1]).astype(float)
    rows = [np.array(sorted([t for t, on in zip((5, 9), r) if on] + [100 + k % 7])) for k, r in enumerate(x)]
    m = T.train(rows, y, epochs=200)
    s = np.array([m.score(r) for r in rows])
    assert auc(s, y) > 0.99
    linear = T.FactorizationMachine(m.bias, m.slots, m.weights, np.zeros_like(m.factors))
    gap = lambda f: f.score(np.array([5, 9])) - max(f.score(np.array([5])), f.score(np.array([9])))
    assert gap(m) > 0.3 and gap(m) >= gap(linear) - 0.5


def test_machine_equals_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    m = T.FactorizationMachine(0.3, np.arange(6), rng.normal(size=6), rng.normal(size=(6, T.FACTORS)))
    z = 0.3 + m.weights[[1, 4, 5]].sum() + sum(m.factors[i] @ m.factors[j] for i, j in ((1, 4), (1, 5), (4, 5)))
    assert m.score(np.array([1, 4, 5, 77])) == pytest.approx(1 / (1 + np.exp(-z)))


def test_attention_gradient():
    rng = np.random.default_rng(2)
    rows = [rng.normal(size=(n, Q.FEATURES)) for n in (1, 3, 5)]
    m = Q.train(rows, np.array([1.0, 0.0, 1.0]), epochs=1)
    which, y, x = np.repeat(np.arange(3), [1, 3, 5]), np.array([1.0, 0.0, 1.0]), np.concatenate(rows)
    loss = lambda: float(np.mean(np.log1p(np.exp((1 - 2 * y) * m.forward(x, which, 3)["z"]))))
    g = m.gradient(m.forward(x, which, 3), which, y)
    for n, p in m.p.items():
        at = tuple(rng.integers(0, s) for s in p.shape)
        p[at] += 1e-5
        a = loss()
        p[at] -= 2e-5
        b = loss()
        p[at] += 1e-5
        assert (a - b) / 2e-5 == pytest.approx(g[n][at], abs=1e-6)


def test_attention_sums_to_one():
    rows = [Q.passages("word " * n) for n in (1, 200, 1000)]
    m = Q.train(rows, np.array([1.0, 0.0, 1.0]), epochs=1)
    which = np.repeat(np.arange(3), [len(r) for r in rows])
    assert np.bincount(which, m.forward(np.concatenate(rows), which, 3)["att"]) == pytest.approx([1, 1, 1])


def test_interactions_learn_what_weights_cannot():
    """Label 1 where exactly one of two terms is there: the linear part is blind to it."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, (1600, 2))
    y = (x[:, 0] ^ x[:, 1]).astype(float)
    # Each term also stands for its absence, so that pairs can say both cases.
    rows = [np.array(sorted([5 + 20 * a, 9 + 20 * b])) for a, b in x]
    m = T.train(rows, y, epochs=300)
    linear = T.FactorizationMachine(m.bias, m.slots, m.weights, np.zeros_like(m.factors))
    assert auc(np.array([m.score(r) for r in rows]), y) > 0.95 and abs(auc(np.array([linear.score(r) for r in rows]), y) - 0.5) < 0.1


@pytest.mark.parametrize("rare", [2, 12])
def test_a_pair_without_effects_of_its_own_is_learned_from_texts(spark, rare):
    """Label 1 where exactly one of two words is there, among others that say nothing: neither says anything alone."""
    rng = np.random.default_rng(5)
    rows, marks = [], []
    for k in range(4000):
        a, b = (rng.random(2) < 0.5) if rare == 2 else (rng.random(2) < [0.5, 1 / rare])
        words = [f"filler{j}" for j in rng.integers(0, 300, 25)] + ["apple"] * bool(a) + ["pear"] * bool(b)
        rows.append((k, " ".join(rng.permutation(words))))
        # in the second case the rare word turns the frequent one's meaning round, and the label is even among rows without it
        marks.append((k, 0, int(a != b) if rare == 2 or b else int(rng.random() < 0.5), bool(b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([m[:3] for m in marks], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in T.toxicity(docs, labels).collect()}
    held = [m for m in marks if got[m[0]]["held_out"] and (rare == 2 or m[3])]
    assert auc(np.array([got[m[0]]["score"] for m in held]), np.array([m[2] for m in held])) > 0.9


def test_pair_statistics_equal_counting():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 2, (200, 2)).astype(bool)
    y = (rng.random(200) < np.where(x[:, 0] ^ x[:, 1], 0.8, 0.3)).astype(float)

    def plain(u, y):
        total = 0.0
        for i in (False, True):
            for j in (0, 1):
                n = ((u == i) & (y == j)).sum()
                total += 2 * n * np.log(n * len(y) / ((u == i).sum() * (y == j).sum())) if n else 0.0
        return total

    t, u = x[:, 0], x[:, 1]
    a, b, m1, m0 = (u & t & (y == 1)).sum(), (u & t & (y == 0)).sum(), (t & (y == 1)).sum(), (t & (y == 0)).sum()
    assert T._dependence(a, b, m1, m0) == pytest.approx(plain(u[t], y[t]))


def test_interactions_change_real_scores(larger):
    docs, labels = larger
    m = T.fit(docs, labels)
    linear = T.FactorizationMachine(m.bias, m.slots, m.weights, np.zeros_like(m.factors))
    terms = T.Terms()
    rows = [terms(r["text"]) for r in docs.join(labels, "doc_id").select("text").limit(400).collect()]
    assert max(abs(m.score(r) - linear.score(r)) for r in rows) > 0.05


@pytest.mark.parametrize("op,fit", [(T, T.fit), (Q, Q.fit)])
def test_repeated_ids_are_one_row(spark, op, fit, monkeypatch):
    """Many rows of a labelled id, and labels that contradict each other: one row of it is learned from."""
    seen = {}
    monkeypatch.setattr(op, "train", lambda rows, y: seen.update(n=len(rows), y=sorted(y.tolist())))
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(500)] + [(3, "other words")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    fit(docs, labels)
    wanted = [y for i, y in ((1, 1.0), (3, 0.0)) if remainder(i, 4) != 2]
    assert seen == {"n": len(wanted), "y": sorted(wanted)}
