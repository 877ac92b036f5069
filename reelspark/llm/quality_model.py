"""Quality classifier: attention-based multiple-instance learning over passages.

A text is cut into passages of 64 words. Each is encoded from its words (hashed to signed dimensions),
the mix of its characters (by class), its word lengths and how many of its words are new; gated attention weighs the passages, and the
weighted sum of their encodings is scored. The weights of encoder, attention and score are learned
together from document labels alone, on a bounded sample; scores read every passage of a text.

Defined results: a null or empty text has one empty passage; without labels of both kinds every
text scores the share of label 1 (0.5 without labels); repeated rows stay, and a null doc_id is not
held out; an empty table gives no rows; further columns, whatever their names, don't matter. A very
long text is as many passages as it has, and a row of numbers for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from reelspark.llm.common import id_and_text, labelled_sample, remainder, sigmoid

PASSAGE = 64
HIDDEN = 16
ATTENTION = 8
#: At most so many labelled documents are learned from.
SAMPLE = 6_000
EPOCHS = 12
BATCH = 64
THRESHOLD = 0.7
#: Character classes of UTF-8 bytes; each further listed byte is a class of its own.
_CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\r\x0b\x0c", ".", ",", "!", "?", "#", "$", "%", "&", "*", "|", "<>", "\"'`", "()[]{}", "-_/\\", "=+~^", ":;@"]
CLASSES = len(_CLASSES) + 2
#: Signed dimensions that words are hashed to, and words whose hashes a task remembers.
WORD_DIMS, REMEMBERED = 32, 200_000
FEATURES = CLASSES + 5 + WORD_DIMS


def _class_table() -> np.ndarray:
    table = np.full(256, CLASSES - 2, np.int64)  # control bytes and the rest of ASCII
    table[128:] = CLASSES - 1
    for k, chars in enumerate(_CLASSES):
        table[[ord(c) for c in chars]] = k
    return table


_TABLE = _class_table()


_hashed: dict[bytes, int] = {}


def _word_hashes(words: list[bytes]) -> np.ndarray:
    """Of each word, lower-cased, its dimension and, above it, its sign."""
    if len(_hashed) > REMEMBERED:
        _hashed.clear()
    out = []
    for w in words:
        h = _hashed.get(w)
        if h is None:
            h = _hashed[w] = xxhash.xxh3_64_intdigest(w.lower()) % (2 * WORD_DIMS)
        out.append(h)
    return np.array(out, np.int64)


def passages(text: str | None) -> np.ndarray:
    """A row of FEATURES for each passage of the text."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    parts = [words[k : k + PASSAGE] for k in range(0, len(words), PASSAGE)] or [[]]
    raw = [b" ".join(p) for p in parts]
    sizes = np.array([len(r) for r in raw])
    which = np.repeat(np.arange(len(raw)), sizes)
    chars = np.bincount(which * CLASSES + _TABLE[np.frombuffer(b"".join(raw), np.uint8)], minlength=len(raw) * CLASSES).reshape(-1, CLASSES)
    out = np.empty((len(raw), FEATURES))
    out[:, :CLASSES] = np.sqrt(chars / np.maximum(sizes, 1)[:, None])
    hashes, at = _word_hashes(words), np.arange(len(words)) // PASSAGE
    signed = np.bincount(at * WORD_DIMS + hashes % WORD_DIMS, 1.0 - 2.0 * (hashes // WORD_DIMS), len(raw) * WORD_DIMS).reshape(-1, WORD_DIMS)
    out[:, CLASSES + 5 :] = signed / np.sqrt(np.maximum([len(p) for p in parts], 1))[:, None]
    seen: set[bytes] = set()
    for k, p in enumerate(parts):
        n, kinds = max(len(p), 1), set(p)
        fresh = kinds - seen
        out[k, CLASSES : CLASSES + 5] = len(kinds) / n, len(fresh) / n, min(sizes[k] / n / 10, 3.0), min(max(map(len, p), default=0) / 30, 3.0), len(p) / PASSAGE
        seen |= fresh
    return out


@dataclass
class AttentionMil:
    """Encoder, gated attention and score; mean and scale standardise the features."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, which: np.ndarray, n: int) -> dict[str, np.ndarray]:
        """x: passages of n texts, in order of which (every text has one or more)."""
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["tv"]), sigmoid(h @ p["gv"])
        e = (t * g) @ p["a"]
        starts = np.searchsorted(which, np.arange(n))
        top = np.maximum.reduceat(e, starts)
        ex = np.exp(e - top[which])
        att = ex / np.add.reduceat(ex, starts)[which]
        doc = np.add.reduceat(att[:, None] * h, starts, axis=0)
        return {"x": x, "h": h, "t": t, "g": g, "att": att, "doc": doc, "z": doc @ p["o"] + p["c"][0]}

    def gradient(self, f: dict[str, np.ndarray], which: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(y)
        dz = (sigmoid(f["z"]) - y) / n
        ddoc = dz[:, None] * p["o"]
        dh = f["att"][:, None] * ddoc[which]
        datt = (ddoc[which] * f["h"]).sum(axis=1)
        mean = np.bincount(which, datt * f["att"], n)
        de = f["att"] * (datt - mean[which])
        dt, dg = de[:, None] * p["a"] * f["g"], de[:, None] * p["a"] * f["t"]
        dt, dg = dt * (1 - f["t"] ** 2), dg * f["g"] * (1 - f["g"])
        dh += dt @ p["tv"].T + dg @ p["gv"].T
        dx = dh * (1 - f["h"] ** 2)
        return {"o": f["doc"].T @ dz, "c": np.array([dz.sum()]), "a": (f["t"] * f["g"]).T @ de, "tv": f["h"].T @ dt, "gv": f["h"].T @ dg, "w": f["x"].T @ dx, "b": dx.sum(axis=0)}

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        which = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        return sigmoid(self.forward(np.concatenate(texts), which, len(texts))["z"])


def train(rows: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, seed: int = 11, decay: float = 1e-4) -> AttentionMil:
    """Adam on the log loss of documents."""
    share = float(y.mean()) if len(y) else 0.5
    rng = np.random.default_rng(seed)
    p = {
        "w": rng.normal(0, 0.3, (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN), "tv": rng.normal(0, 0.3, (HIDDEN, ATTENTION)), "gv": rng.normal(0, 0.3, (HIDDEN, ATTENTION)),
        "a": rng.normal(0, 0.3, ATTENTION), "o": rng.normal(0, 0.3, HIDDEN), "c": np.zeros(1),
    }
    if not len(y) or share in (0.0, 1.0):
        p["o"] *= 0
        odds = min(max(share, 1e-6), 1 - 1e-6)
        p["c"][0] = np.log(odds / (1 - odds))
        return AttentionMil(np.zeros(FEATURES), np.ones(FEATURES), p)
    every = np.concatenate(rows)
    model = AttentionMil(every.mean(axis=0), np.maximum(every.std(axis=0), 0.02), p)
    first, second, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), BATCH):
            part = order[k : k + BATCH]
            which = np.repeat(np.arange(len(part)), [len(rows[i]) for i in part])
            f = model.forward(np.concatenate([rows[i] for i in part]), which, len(part))
            step += 1
            for name, g in model.gradient(f, which, y[part]).items():
                g = g + decay * p[name]
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                p[name] -= 0.01 * 0.8**epoch * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", fold: tuple[int, int] = (4, 2), sample: int = SAMPLE) -> AttentionMil:
    """Learns from at most `sample` labelled documents outside the held-out fold; passages are encoded on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [passages(t.as_py()).astype(np.float32).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(made, pa.binary())], ["doc_id", "y", "x"])

    got = labelled_sample(docs, labels, label, fold, sample).mapInArrow(run, "doc_id long, y int, x binary").toArrow()
    order = np.argsort(got["doc_id"].to_numpy(), kind="stable")
    x, y = got["x"].to_pylist(), got["y"].to_numpy()
    return train([np.frombuffer(x[i], np.float32).reshape(-1, FEATURES).astype(float) for i in order], y[order].astype(float))


def score(docs: DataFrame, model: AttentionMil, fold: tuple[int, int] = (4, 2), threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mil = shared.value
        for batch in batches:
            scores = np.empty(batch.num_rows)
            held, begun, size = [], 0, 0
            for k, t in enumerate(batch.column(1)):
                held.append(passages(t.as_py()))
                size += len(held[-1])
                if size >= 1 << 14 or k == batch.num_rows - 1:
                    scores[begun : k + 1] = mil.score(held)
                    held, begun, size = [], k + 1, 0
            out = [remainder(i, fold[0]) == fold[1] for i in batch.column(0).to_pylist()]
            cols = [batch.column(0), pa.array(out, pa.bool_()), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "score", "predicted"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
