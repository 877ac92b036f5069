import math
from collections import Counter

import numpy as np
import pytest

from reelspark.llm import lm as L
from reelspark.llm.common import lower_words, remainder


def base(frame):
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    counts = Counter()
    for i, t in rows:
        if remainder(i, 7) != 2:
            counts.update([*lower_words(t), b""])
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        words = [*lower_words(t), b""]
        out.append((i, remainder(i, 7) == 2, len(words), sum(counts[w] > 0 for w in words), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), 6)))
    return Counter(out)


@pytest.mark.parametrize("common", [L.COMMON, 20, 1])
def test_base_scores_equal_brute_force(docs, odd_docs, monkeypatch, common):
    monkeypatch.setattr(L, "COMMON", common)
    for frame in (docs, odd_docs):
        got = L.language_scores(frame).collect()
        assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == base(frame)
        assert all(r["score"] < 0 for r in got)


def test_no_rows(no_docs, spark):
    assert L.language_scores(no_docs).count() == 0
    alone = [i for i in range(100) if remainder(i, 7) == 2][0]
    got = L.language_scores(spark.createDataFrame([(alone, "no training text")], "doc_id long, text string")).first()
    assert got["held_out"] and got["train_tokens"] == 0 and got["n_known"] == 0 and got["score"] == pytest.approx(-math.log10(2) * 8 * len("no training text  "))  # each word and the end of the text are ended


TEXTS = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "the cat sat on the log and the dog sat on the mat"] * 9


def counted(texts, common, tree, layout):
    """The contexts' table by one loop."""
    table, coder = np.zeros((layout.total, L.NODES, 2)), L.Coder(common)
    t = L.prepared(*coder([lower_words(x) for x in texts]), layout, coder.other)
    for i, leaf in enumerate(t.leaves):
        for node, bit in zip(tree.nodes[leaf], tree.bits[leaf]):
            if node != L.NONE:
                for k in range(L.CONTEXTS):
                    table[t.rows[k, i], node, int(bit)] += 1
    return L.log_odds(table[:, :, 0], table[:, :, 1])


@pytest.fixture(scope="module")
def model():
    counts = Counter(w for t in TEXTS for w in (*lower_words(t), b""))
    words = sorted((w for w in counts if w != b"mat"), key=lambda w: (-counts[w], w))
    common = L.Common(words, np.array([counts[w] for w in words]), sum(counts.values()), len(counts), 1, 0)
    tree, layout = L.Tree.of(common), L.Layout(4, 16)
    rng = np.random.default_rng(3)
    return common, L.Mixer(tree, layout, counted(TEXTS, common, tree, layout), L.START + rng.normal(0, 0.2, L.START.shape))


def coded(model, texts):
    coder = L.Coder(model[0])
    return L.prepared(*coder([lower_words(t) for t in texts]), model[1].layout, coder.other)


def slow_bits(model, text):
    """The mixer as a loop over tokens and bits with plain dictionaries."""
    common, m = model
    leaf = {w: k for k, w in enumerate(common.words)}
    leaves = [leaf.get(w, len(common.words)) for w in (*lower_words(text), b"")]
    total, own, seen, last_pair, trust = 0.0, np.zeros(L.INPUTS), [], {}, 0
    low, size, step, bent = 0, L.FIRST_BLOCK, np.zeros(L.INPUTS), np.zeros(L.INPUTS)
    rows = coded(model, [text]).rows
    for i, at in enumerate(leaves):
        if i == low + size:
            own = np.clip(own + 0.5 * step / (0.25 * bent + 20), -0.75, 0.75)
            low, size, step, bent = i, min(2 * size, L.MOST_BLOCK), np.zeros(L.INPUTS), np.zeros(L.INPUTS)
        guess = last_pair.get(tuple(seen[-2:]), -1) if i >= 2 else -1
        known = i > 0 and leaves[i - 1] < m.layout.rows
        same = True
        for depth in range(L.DEPTH):
            node, bit = int(m.tree.nodes[at, depth]), int(m.tree.bits[at, depth])
            if node == L.NONE:
                break
            x = np.zeros(L.INPUTS)
            x[0], x[-1] = m.tree.odds[node], 1
            for k in range(L.CONTEXTS):
                x[1 + k] = m.table[rows[k, i], node]
            if guess >= 0 and same and m.tree.nodes[guess, depth] == node:
                x[1 + L.CONTEXTS] = 2 * int(m.tree.bits[guess, depth]) - 1
            z = float(np.clip((m.weights[(trust * 2 + known) * L.DEPTH + depth] + own) @ x, -12, 12))
            total += math.log2(1 + math.exp(-z if bit else z))
            step += (bit - 1 / (1 + math.exp(-z))) * x
            bent += x * x
        total += float(m.tree.tail[at])
        trust = 0 if guess < 0 else 2 if guess == at else 1
        if i >= 2:
            last_pair[tuple(seen[-2:])] = at
        seen.append(at)
    return total


def test_bits_equal_a_slow_mixer(model):
    texts = [*TEXTS[:4], "", "zebra mat mat", "the cat sat on the mat " * 30, "dog log dog log a a a " * 11]
    assert model[1].bits(coded(model, texts)) == pytest.approx([slow_bits(model, t) for t in texts], rel=1e-4)


def test_context_rows(model):
    """The last very common word, the word before, and no look across texts."""
    a, b = coded(model, ["the cat sat", "mat dog"]), coded(model, ["mat dog"])
    assert (a.rows[:, 4:] == b.rows).all() and (a.guess == -1).all()
    top, rows = a.rows[0], a.rows[1] - (L.TOP + 1)
    leaf = {w: k for k, w in enumerate(model[0].words)}
    assert top[0] == L.TOP and top[1] == leaf[b"the"] and rows[0] == model[1].layout.rows + 1
    assert rows[5] == model[1].layout.rows and top[5] in (L.TOP, len(model[0].words))


def test_the_next_tokens_probabilities_sum_to_one(model):
    """After any beginning all leaves share all the probability, also once a text's weights are refined."""
    _, m = model
    for start in (["the"], ["the", "cat", "sat", "on"] * 9):
        code = L.Coder(model[0])
        head, _ = code([[w.encode() for w in start]])
        leaves = [np.append(head[:-1], k) for k in range(len(model[0].words) + 1)]
        flat = np.concatenate(leaves)
        starts = np.arange(len(leaves)) * len(leaves[0])
        before = m.bits(L.prepared(head[:-1], np.array([0]), m.layout, code.other))[0]
        assert float((2.0 ** (before - m.bits(L.prepared(flat, starts, m.layout, code.other)))).sum()) == pytest.approx(1.0, rel=1e-3)


def test_spelling_shares_out_all_probability():
    counts = np.zeros((L.SPELL_ROWS, 256))
    ahead, rows, _ = L.letters([b"oning", b"tion", b"ing"])
    for context in rows:
        np.add.at(counts, (context, ahead), 1)
    speller = L.Speller.of(counts)
    nexts = [b"on" + bytes([k]) for k in range(256)]
    cost = lambda words: speller.bits(words) - np.array([speller.bits([w])[0] - spelled(speller, w) for w in words])

    def spelled(s, w):  # without the end
        return sum(slow_byte(s, w, i) for i in range(len(w)))

    def slow_byte(s, w, i):
        padded, total = b"\n\n\n" + w + b"\n", 0.0
        _, own, _ = L.letters([w])
        for level in range(8):
            node = (padded[i + 3] | 256) >> (8 - level)
            x = s.odds[own[:, i], node]
            longest = 2 if x[2] else 1 if x[1] else 0
            z = float(np.clip(s.weights[longest] @ x, -12, 12))
            total += math.log2(1 + math.exp(-z if padded[i + 3] >> (7 - level) & 1 else z))
        return total

    assert [speller.bits([w])[0] for w in (b"oning", b"zz", b"")] == pytest.approx([spelled(speller, w) + slow_byte(speller, w, len(w)) for w in (b"oning", b"zz", b"")], rel=1e-4)
    given = np.array([slow_byte(speller, w, 2) for w in nexts])
    assert float((2.0**-given).sum()) == pytest.approx(1.0, rel=1e-3) and len(cost(nexts)) == 256
    assert speller.bits([b"toning"])[0] < speller.bits([b"xqzvkw"])[0]


def test_batches_do_not_matter_and_repeats_are_cheaper(model):
    texts = ["the cat sat on the log", "log mat a", "", "a dog and the mat " * 500]
    m = model[1]
    assert m.bits(coded(model, texts)) == pytest.approx([m.bits(coded(model, [t]))[0] for t in texts], rel=1e-5)
    once, often = m.bits(coded(model, ["cat dog mat log on sat", "cat dog mat log on sat " * 40]))
    assert often < 0.8 * 40 * once


def test_table_and_weights_of_tasks_equal_one_loop(spark, monkeypatch):
    frame = spark.createDataFrame(list(enumerate(TEXTS * 30)), "doc_id long, text string").repartition(5)
    words = L.cut(L.word_counts(frame))
    common = L.common_words(words)
    tree, layout = L.Tree.of(common), L.Layout.of(common)
    inside = [t for i, t in enumerate(TEXTS * 30) if remainder(i, 7) != 2 and remainder(i, 61) != 5]
    assert np.allclose(L.context_table(frame, common, tree, layout), counted(inside, common, tree, layout), atol=1e-5)
    m = L.Mixer(tree, layout, L.context_table(frame, common, tree, layout))
    m.weights = L.learned(frame, common, m)
    shared = [t for i, t in enumerate(TEXTS * 30) if remainder(i, 7) != 2 and remainder(i, 61) == 5]
    plain = L.Mixer(tree, layout, m.table)
    assert m.bits(coded((common, m), shared)).sum() < plain.bits(coded((common, plain), shared)).sum()


@pytest.mark.parametrize("common", [L.COMMON, 50])
def test_scores_equal_one_loop(docs, monkeypatch, common):
    """Common words by the mixer, known others by count or spelling, unknown ones spelled."""
    monkeypatch.setattr(L, "COMMON", common)
    words = L.cut(L.word_counts(docs))
    model = L.fit(docs, words)
    counts = {r["word"].encode(): r["n"] for r in words.collect()}
    c, texts = model.common, {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in L.scores(docs, model, words).collect():
        own = [*lower_words(texts[r["doc_id"]]), b""]
        bits = float(model.mixer.bits(coded((c, model.mixer), [texts[r["doc_id"]]]))[0])
        for w in own:
            if w not in c.words[: len(c.words)] if common == 50 else w not in set_of(c):
                p = c.spelled * 2.0 ** -float(model.speller.bits([w])[0])
                if w in counts:
                    p += (1 - c.spelled) * counts[w] / c.rare
                bits -= math.log2(p) if p else -(float(model.speller.bits([w])[0]) - math.log2(c.spelled))
        assert r["score"] == pytest.approx(-bits * math.log10(2), rel=1e-5)


def set_of(c, known={}):  # noqa: B006
    return known.setdefault(id(c), set(c.words))


def test_tables_grow_with_the_corpus():
    sizes = []
    for scale in (1, 10, 100, 1000, 10**6):
        counts = np.array(sorted((int(1e5 * scale / k) for k in range(1, 5000)), reverse=True))
        sizes.append(L.Layout.of(L.Common([b""] * len(counts), counts, int(counts.sum()), len(counts), 0, 0)))
    assert all(a.rows <= b.rows and a.pairs < b.pairs for a, b in zip(sizes, sizes[1:])) and sizes[0].rows < sizes[1].rows


def test_held_out_texts_are_likelier_than_by_the_base(spark):
    got = L.language_scores(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("held_out").toPandas()
    assert got.score.sum() > got.base_score.sum() and (got.score > got.base_score).mean() > 0.7
