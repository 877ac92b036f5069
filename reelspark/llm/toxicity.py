"""Toxicity: a factorization machine over hashed terms.

Terms are a text's distinct words and the beginnings of its words, each with how often it starts a
distinct word (up to three). Linear weights and pairwise interactions, through vectors of a few
factors, are learned from a bounded sample of labelled documents, with a proximal penalty that sets
the weights of uninformative terms to zero; scores read whole texts. Learned are the terms that bear on the
label alone or with another term, so a group word that is harmless by itself is among them.

Defined results: a null or empty text has no terms and scores by the bias alone; without labels of
both kinds every text scores the share of label 1 (0.5 without labels); repeated rows stay, and a
null doc_id is not held out; an empty table gives no rows; further columns, whatever their names, don't
matter. A very long text needs the memory of its distinct words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from reelspark.llm.common import id_and_text, labelled_sample, remainder, sigmoid

BITS = 20
FACTORS = 4
#: At most so many labelled documents are learned from.
SAMPLE = 12_000
#: So many of the most frequent terms are tested with each other.
PAIRED = 1024
PREFIX = 5
EPOCHS = 60
BATCH = 128
THRESHOLD = 0.3
_STRIP = ".,;:!?\"'()[]{}|#$%&*<>-"
#: Words whose slots a task remembers.
_REMEMBERED = 200_000


def slot(term: str) -> int:
    return xxhash.xxh3_64_intdigest(term.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


class Terms:
    """Slots of a text's terms, with a bounded memory of words already hashed."""

    def __init__(self) -> None:
        self.words: dict[str, tuple[int, str]] = {}
        self.starts: dict[tuple[str, int], int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        known, starts = self.words, self.starts
        if len(known) > _REMEMBERED:
            known.clear()
        if len(starts) > _REMEMBERED:
            starts.clear()
        out: set[int] = set()
        begun: Counter[str] = Counter()
        for word in set((text or "").lower().split()):
            found = known.get(word)
            if found is None:
                bare = word.strip(_STRIP)
                found = known[word] = (slot("w" + bare) if bare else -1, bare[:PREFIX] if len(bare) > PREFIX else "")
            if found[0] >= 0 and found[0] not in out:
                out.add(found[0])
                if found[1]:
                    begun[found[1]] += 1
        for start, n in begun.items():
            key = (start, min(n, 3))
            at = starts.get(key)
            if at is None:
                at = starts[key] = slot(f"p{key[1]}{start}")
            out.add(at)
        return np.sort(np.fromiter(out, np.int64, len(out)))


@dataclass
class FactorizationMachine:
    """score = sigmoid(bias + sum of w + half the sum, over factors, of (sum of v) squared less the sum of v squared)."""

    bias: float
    slots: np.ndarray  # sorted slots that have weights
    weights: np.ndarray
    factors: np.ndarray

    def score(self, slots: np.ndarray) -> float:
        at = np.searchsorted(self.slots, slots)
        inside = at < len(self.slots)
        at = at[inside][self.slots[at[inside]] == slots[inside]]
        if not len(at):
            return float(sigmoid(np.array(self.bias)))
        v = self.factors[at]
        pairs = 0.5 * float((v.sum(axis=0) ** 2 - (v * v).sum(axis=0)).sum())
        return float(sigmoid(np.array(self.bias + float(self.weights[at].sum()) + pairs)))


def _dependence(a, b, n1, n0):
    """Likelihood ratio of a label and a term that a rows of label 1 and b of label 0 have, of n1 and n0 in all; any shapes that go together."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    c, d, n = n1 - a, n0 - b, np.maximum(n1 + n0, 1e-12)
    ratio = 0.0
    for cell, row, column in ((a, a + b, n1), (b, a + b, n0), (c, c + d, n1), (d, c + d, n0)):
        ratio = ratio + 2 * cell * np.log(np.maximum(cell, 1e-12) * n / np.maximum(row * column, 1e-12))
    return ratio


def informative(rows: list[np.ndarray], y: np.ndarray, least: int = 3, bound: float = 6.0, pair_bound: float = 45.0, paired: int = PAIRED) -> np.ndarray:
    """Slots in at least `least` rows that bear on the label: alone (likelihood ratio over bound), or with another
    term (over pair_bound, where the label is compared among rows with the other term and among those without).

    The others are all terms that bear on it alone, and the `paired` most frequent ones, which are tested with each
    other; so a term without any effect of its own is found by the term that it matters with.
    """
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    both = np.bincount(np.concatenate(rows), minlength=1 << BITS)
    slots = np.flatnonzero(both >= least)
    where = np.full(1 << BITS, -1, np.int64)
    where[slots] = np.arange(len(slots))
    inner = [x[x >= 0] for x in (where[r] for r in rows)]
    size = len(slots)
    flat, label = np.concatenate(inner), np.repeat(y.astype(bool), [len(r) for r in inner])
    ones, zeros = np.bincount(flat[label], minlength=size), np.bincount(flat[~label], minlength=size)
    kept = _dependence(ones, zeros, n1, n0) > bound

    frequent = np.argsort(-(ones + zeros), kind="stable")[:paired]
    column = np.full(size, -1, np.int64)
    column[frequent] = np.arange(len(frequent))
    has = np.zeros((len(inner), len(frequent)), np.float32)
    for k, r in enumerate(inner):
        has[k, (c := column[r])[c >= 0]] = 1
    a, b = has[y == 1].T @ has[y == 1], has[y != 1].T @ has[y != 1]  # rows with both terms, by label; at most paired x paired
    f1, f0 = np.diag(a)[:, None], np.diag(b)[:, None]
    found = _dependence(a, b, f1, f0) + _dependence(f1.T - a, f0.T - b, n1 - f1, n0 - f0) > pair_bound
    np.fill_diagonal(found, False)
    # a term that bears on the label alone does so among the rows with another too: that alone says nothing of the other
    matters = found & ~kept[frequent][None, :]
    also = np.zeros(size, bool)
    also[frequent[matters.any(axis=0) | matters.any(axis=1)]] = True

    order = np.argsort(flat, kind="stable")
    of_row = np.repeat(np.arange(len(inner)), [len(r) for r in inner])[order]
    begins = np.searchsorted(flat[order], np.arange(size + 1))
    for t in np.flatnonzero(kept):  # with each term that bears on it alone, every other
        own = [inner[k] for k in of_row[begins[t] : begins[t + 1]]]
        mine, mark = np.concatenate(own), np.repeat(y[of_row[begins[t] : begins[t + 1]]].astype(bool), [len(r) for r in own])
        a, b = np.bincount(mine[mark], minlength=size), np.bincount(mine[~mark], minlength=size)
        some = np.flatnonzero((a + b > 0) & ~kept)
        a, b, m1, m0 = a[some], b[some], float(ones[t]), float(zeros[t])
        also[some[_dependence(a, b, m1, m0) + _dependence(ones[some] - a, zeros[some] - b, n1 - m1, n0 - m0) > pair_bound]] = True
    return slots[kept | also]


def train(rows: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, seed: int = 7, l1: float = 2e-4, l2: float = 1e-3) -> FactorizationMachine:
    """AdaGrad with a proximal step on the linear weights, over the informative terms."""
    share = float(y.mean()) if len(y) else 0.5
    empty = np.empty(0, np.int64)
    if not len(y) or share in (0.0, 1.0):
        p = min(max(share, 1e-6), 1 - 1e-6)
        return FactorizationMachine(float(np.log(p / (1 - p))), empty, np.empty(0), np.empty((0, FACTORS)))
    slots = informative(rows, y)
    where = np.full(1 << BITS, -1, np.int64)
    where[slots] = np.arange(len(slots))
    rows = [x[x >= 0] for x in (where[r] for r in rows)]
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(slots)), rng.normal(0, 0.02, (len(slots), FACTORS))
    bias, gw, gv, gb, rate = float(np.log(share / (1 - share))), np.full(len(slots), 1e-2), np.full(v.shape, 1e-2), 1e-2, 0.1
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), BATCH):
            part = order[k : k + BATCH]
            sizes = np.array([len(rows[i]) for i in part])
            flat = np.concatenate([rows[i] for i in part])
            which = np.repeat(np.arange(len(part)), sizes)
            used, at = np.unique(flat, return_inverse=True)
            vf = v[used][at]
            sums = np.zeros((len(part), FACTORS))
            for f in range(FACTORS):
                sums[:, f] = np.bincount(which, vf[:, f], len(part))
            squares = np.bincount(which, (vf * vf).sum(axis=1), len(part))
            z = bias + np.bincount(which, w[used][at], len(part)) + 0.5 * ((sums * sums).sum(axis=1) - squares)
            error = (sigmoid(z) - y[part]) / len(part)
            each = error[which]
            g = np.bincount(at, each, len(used))
            gw[used] += g * g
            step = rate / np.sqrt(gw[used])
            moved = w[used] - step * g
            w[used] = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0)
            for f in range(FACTORS):
                d = np.bincount(at, each * (sums[which, f] - vf[:, f]), len(used)) + l2 * v[used, f]
                gv[used, f] += d * d
                v[used, f] -= 0.5 * rate / np.sqrt(gv[used, f]) * d
            e = float(error.sum())
            gb += e * e
            bias -= rate / np.sqrt(gb) * e
    return FactorizationMachine(bias, slots, w, v)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", fold: tuple[int, int] = (4, 2), sample: int = SAMPLE) -> FactorizationMachine:
    """Learns from at most `sample` labelled documents outside the held-out fold; terms are hashed on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            made = [terms(t.as_py()).astype(np.int32).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(made, pa.binary())], ["doc_id", "y", "terms"])

    got = labelled_sample(docs, labels, label, fold, sample).mapInArrow(run, "doc_id long, y int, terms binary").toArrow()
    order = np.argsort(got["doc_id"].to_numpy(), kind="stable")
    terms, y = got["terms"].to_pylist(), got["y"].to_numpy()
    return train([np.frombuffer(terms[i], np.int32).astype(np.int64) for i in order], y[order].astype(float))


def score(docs: DataFrame, model: FactorizationMachine, fold: tuple[int, int] = (4, 2), threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2**BITS slots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, fm = Terms(), shared.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            scores = np.array([fm.score(terms(t.as_py())) for t in batch.column(1)], float)
            held = [remainder(i, fold[0]) == fold[1] for i in ids]
            cols = [batch.column(0), pa.array(held, pa.bool_()), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "score", "predicted"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
