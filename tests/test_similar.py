"""The similarity join of names beside all pairs."""

import math
import random
from difflib import SequenceMatcher

import pytest

from reelspark.operators import similar


def made_names(n, seed=1):
    """Names of one to three words, of which some are mistyped, longer or numbered."""
    r = random.Random(seed)
    words = ["".join(r.choice("bcdfglmnprstv") + r.choice("aeiou") for _ in range(r.randint(2, 4))) for _ in range(max(40, n // 8))]
    out = []
    while len(out) < n:
        x = " ".join(r.choice(words) for _ in range(r.choice([1, 1, 2, 2, 3])))
        out.append(x)
        if r.random() < 0.3:
            y = list(x)
            for _ in range(r.randint(1, 4)):
                k, op = r.randrange(len(y)), r.random()
                if op < 0.4:
                    y[k] = r.choice("abcdefgh")
                elif op < 0.7 and len(y) > 3:
                    del y[k]
                else:
                    y.insert(k, r.choice("xyzaei"))
            out.append("".join(y))
        if r.random() < 0.05:
            out.append(x.upper() + r.choice([" INC", " 2", "", " copy 3"]))
    return out[:n]


def plain(x):
    return "".join(c for c in x.lower() if c in "0123456789abcdefghijklmnopqrstuvwxyz")


def runs(x):
    return tuple("".join(c if c in "0123456789" else " " for c in x).split())


def all_pairs(xs, least=0.85):
    """Every pair of distinct names, with the library's own upper bounds before its ratio."""
    xs = sorted({x for x in xs if x is not None}, key=lambda x: (x.lower(), x))
    by_runs = {}
    for x in xs:
        if len(plain(x)) >= 3:
            by_runs.setdefault(runs(x), []).append((x, plain(x)))
    found = set()
    for own in by_runs.values():
        for j, (y, q) in enumerate(own):
            m = SequenceMatcher(None)
            m.set_seq2(q)
            bag = {c: q.count(c) for c in set(q)}
            for x, p in own[:j]:
                s, t = sorted((p, q), key=len)
                if t.startswith(s) and not any(c.isdigit() for c in t[len(s) :]):
                    found.add((x, y))
                elif len(s) >= 5 and 2 * len(s) >= least * (len(s) + len(t)) and 2 * sum(min(p.count(c), k) for c, k in bag.items()) >= least * (len(s) + len(t)):
                    m.set_seq1(p)
                    if m.ratio() >= least:
                        found.add((x, y))
    return found


def pairs(spark, xs, **more):
    d = spark.createDataFrame([(x,) for x in xs], "n string").repartition(4)
    return {(r["a"], r["b"]) for r in similar.similar_pairs(d, "n", **more).collect()}


@pytest.mark.parametrize("common", [0, 3, 64])
def test_equals_all_pairs(spark, monkeypatch, common):
    monkeypatch.setattr(similar.candidates, "__defaults__", (similar.LEAST, common))  # all grams common, few, as shipped
    xs = made_names(1200, seed=common)
    assert pairs(spark, xs) == all_pairs(xs)


def test_equals_all_pairs_on_5000_names(spark):
    xs = made_names(5000, seed=9)
    want = all_pairs(xs)
    assert pairs(spark, xs) == want and len(want) > 1500


def test_odd_names(spark):
    r = random.Random(3)
    close = ["".join(r.choice("ab") for _ in range(n)) for n in range(3, 16) for _ in range(12)]  # every gram repeats
    odd = [None, "", " ", "!!", "é", "ab", "abc", "ABC", "a-b-c", "12", "12 12", "1212", "aaaaaa", "aaaaaaaa", "x" * 250, "x" * 249 + "y", "abcab" * 30, "abcab" * 29 + "abdab"]
    for xs in (odd, close, []):
        assert pairs(spark, xs) == all_pairs(xs)


def test_other_likenesses(spark):
    xs = made_names(500, seed=5)
    for least in (0.9, 1.0):
        assert pairs(spark, xs, least=least) == all_pairs(xs, least)
    for least in (0.8, 0.5, 1.1):
        with pytest.raises(ValueError):
            similar.short_total(least)


def test_bounds_hold_for_every_total():
    for least in (0.85, 0.88, 0.9, 0.95):
        short = similar.short_total(least)
        assert all(similar.shared(t, least) >= 2 for t in range(max(short + 1, 2 * similar.SHORTEST), 3000))
        assert all(similar.matched(t, least) == math.ceil(round(least * t / 2, 9)) for t in range(10, 200))


def test_candidates_of_a_name_stay_few(spark):
    """Five times the names, and the words in proportion: a name has as many candidates."""
    each = []
    for n in (2_000, 10_000):
        d = spark.createDataFrame([(x,) for x in made_names(n)], "n string").repartition(8)
        each.append(similar.candidates(similar._kinds(d, "n")[1]).count() / n)
    assert each[1] < 1.5 * each[0] and each[1] < 40
