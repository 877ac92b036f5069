import random
import re

import numpy as np
import pytest

from reelspark.llm import pii as P

SHAPES = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute(text):
    out = []
    for kind, shape in enumerate(SHAPES):
        for m in re.finditer(shape, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == 0 or (kind == 1 and all(int(x) <= 255 for x in m[0].split("."))) or (kind == 2 and 12 <= len(d) <= 19 and P.luhn(d)) or (kind == 3 and 9 <= len(d) <= 15):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_equal_the_plain_expressions(docs):
    rng = random.Random(3)
    for _ in range(5000):
        text = "".join(rng.choice("01a@.+-( )%4é\n") for _ in range(rng.randint(0, 40)))
        assert P.base_spans(text) == brute(text), text
    for r in docs.collect():
        assert P.base_spans(r["text"]) == brute(r["text"])


def test_gradient():
    m, rng = P.Tagger.new(1), np.random.default_rng(0)
    x, y, mask = rng.integers(0, P.CLASSES, (3, 7)), rng.integers(0, P.TAGS, (3, 7)), np.ones((3, 7))
    mask[1, 5:] = 0
    _, g = m.loss_gradient(x, mask, y)
    for n in m.p:
        at = tuple(rng.integers(0, s) for s in m.p[n].shape)
        at = (x[0, 2], *at[1:]) if n[0] == "x" else at
        m.p[n][at] += 1e-5
        a = m.loss_gradient(x, mask, y)[0]
        m.p[n][at] -= 2e-5
        b = m.loss_gradient(x, mask, y)[0]
        m.p[n][at] += 1e-5
        assert (a - b) / 2e-5 == pytest.approx(g[n][at], abs=1e-6)


@pytest.fixture(scope="module")
def model(docs):
    parts = [r["text"][a:b] for r in docs.collect() for a, b in P.stretches(r["text"])]
    return P.train(parts)


def test_tagger_adds_written_variants_and_keeps_the_base(model):
    texts = ["please call me at (555) 123-4567 today", "mail bob(at)example.com now please", "released on 2024-01-02 at 10:30, version 1.2.3", "plain words"]
    found = P.all_spans(texts, model)
    assert [[P.KINDS[k] for _, k, _ in a] for _, a in found[2:]] == [[], []]
    assert sum(bool(a) for _, a in found[:2]) >= 1


def test_held_out_spans_are_tagged(model):
    """On contexts of its own making with new data, the tagger marks most characters right."""
    rng = np.random.default_rng(99)
    texts, spans = [], []
    for k in range(200):
        v = P._variant(k % 4, rng)
        texts.append(f"some words come first {v} and more words follow")
        spans.append((22, k % 4, 22 + len(v)))
    right = sum(bool((tags[a] == 1 + 2 * k) and (tags[a + 1 : b] == 2 + 2 * k).all()) for tags, (a, k, b) in zip(model.tag(texts), spans))
    assert right >= 150


def test_added_spans_of_planted_data(spark, docs, model):
    """Through find: each form of personal data is found again, and numbers of other kinds are left alone."""
    rng, texts = np.random.default_rng(77), [r["text"] for r in docs.collect() if r["text"]]
    makes = {("phone", 3, shape): lambda shape=shape: P.filled(shape, rng) for shape in P.PHONES}
    makes |= {("email", 0, sign): lambda sign=sign: P.address(sign, rng) for sign in P.ADDRESS_SIGNS}
    makes |= {(name, None, shape): lambda shape=shape: P.lookalike(shape, rng) for name, shapes in P.LOOKALIKES.items() for shape in shapes}
    rows, put = [], []
    for form, make in makes.items():
        for _ in range(40):
            text, new = texts[int(rng.integers(0, len(texts)))][:600], make()
            cut = int(rng.integers(0, len(text) + 1))
            rows.append((len(rows), f"{text[:cut]} {new} {text[cut:]}"))
            put.append((form, cut + 1, cut + 1 + len(new)))
    found = {r["doc_id"]: r for r in P.find(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    hits = {}
    for k, ((group, kind, _), a, e) in enumerate(put):
        spans = [x.split(":") for x in found[k]["spans"].split(",") if x]
        near = [(P.KINDS.index(n), int(x), int(y)) for n, x, y in spans if int(x) < e and a < int(y)]
        hits.setdefault(group, []).append(bool(near) if kind is None else any(n == kind and x <= a and y >= e for n, x, y in near))
    assert sum(r["n_added"] for r in found.values()) > 300
    for group, some in hits.items():
        assert np.mean(some) >= 0.9 if group in P.KINDS else np.mean(some) < 0.05, (group, np.mean(some))


def test_runs_of_digits_are_classes_of_their_own():
    digits = P.encoded("1 22 a333 " + "4" * 20)
    assert digits[[0, 2, 3, 6, 7, 8]].tolist() == [0, 1, 1, 2, 2, 2] and set(digits[10:].tolist()) == {P.LONGEST - 1}
    assert P.encoded("").size == 0 and not set(P.encoded("ab é").tolist()) & set(range(P.LONGEST))


def test_rows(docs, odd_docs, no_docs, model):
    for frame in (docs, odd_docs):
        got = P.find(frame, model).collect()
        assert len(got) == frame.count()
        texts = {r["doc_id"]: r["text"] for r in frame.collect()}
        for r in got:
            base = brute(texts[r["doc_id"]])
            assert [r[f"n_{k}"] for k in P.KINDS] == [sum(x[1] == i for x in base) for i in range(4)]
            assert set(P.spans_text(base).split(",")) <= set(r["spans"].split(",")) | {""}
    assert P.find(no_docs, model).count() == 0 and P.redact(no_docs, model).count() == 0


def test_redaction(odd_docs, model):
    out = {r["doc_id"]: r for r in P.redact(odd_docs, model).collect()}
    assert out[7]["text"].startswith("Mail <EMAIL> or <PHONE>.\nIP <IP>, card <CARD>.") and out[7]["n_chars"] == len(out[7]["text"])
    assert out[1]["text"] is None and P.redact(odd_docs, model).columns == odd_docs.columns


def test_windows_reconcile(model):
    """A span across many windows is one span, and padding around a text changes nothing far from it."""
    text = "x " * 200 + "card 4111 1111 1111 1111 " + "y " * 200
    (base, added), = P.all_spans([text], model)
    assert len(base) == 1 and not any(a < base[0][2] and base[0][0] < b for a, _, b in added)


def test_path_is_the_best_of_all(model, monkeypatch):
    """Enumeration of every path of short stretches, and pieces of any length settle on the same path."""
    from itertools import product

    rng, moves = np.random.default_rng(4), model.p["t"]
    for n in (1, 2, 4):
        e = rng.normal(0, 2, (n, P.TAGS))
        value = lambda p: sum(e[k, t] for k, t in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:]))
        assert value(model.viterbi(e).tolist()) == pytest.approx(max(map(value, product(range(P.TAGS), repeat=n))))
    e = rng.normal(0, 3, (500, P.TAGS))
    want = model.viterbi(e)
    monkeypatch.setattr(P, "CHUNK", 16)
    path = P.Path(moves)
    parts = [path.add(e[k : k + 7]) for k in range(0, 500, 7)]
    assert sum(map(len, parts)) > 300 and np.array_equal(np.concatenate([*parts, path.end()]), want)


def test_long_stretches_are_tagged_by_chunks(model, monkeypatch):
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("0123456789 .-+()@ab"), n)) for n in (1, 31, 32, 63, 64, 65, 96, 97, 300, 1000)]
    want = model.tag(texts)
    assert [len(t) for t in want] == [len(t) for t in texts]
    for chunk in (32, 64, 160):
        monkeypatch.setattr(P, "CHUNK", chunk)
        assert all(np.array_equal(a, b) for a, b in zip(model.tag(texts), want))


def test_written_out_signs_are_seen():
    for text in ("write to bob (AT) example.com", "bob( at )example.com", "bob at example dot com now"):
        assert P.stretches(text)
    long_name = "x" * 90 + "(at)example.com"
    assert P.stretches(long_name)[0][0] == 0 and not P.stretches("look at the page")


def test_every_piece_of_a_sampled_document_may_be_learned_from(spark, monkeypatch):
    """Data far inside a text counts as that at its head does."""
    text = " ".join(f"page {k} word" if k % 9 else "mail bob@example.com" for k in range(3000))
    seen = []
    monkeypatch.setattr(P, "train", lambda parts, most: seen.extend(parts))
    P.fit(spark.createDataFrame([(1, text), (2, "9" * 5000)], "doc_id long, text string"))
    assert sum(map(len, seen)) >= 0.9 * (len(text) + 5000) and max(map(len, seen)) <= P.PIECE
