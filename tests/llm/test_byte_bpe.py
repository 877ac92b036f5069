import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from reelspark.llm import byte_bpe as B
from reelspark.llm import queries


@pytest.fixture(scope="module")
def coder():
    return B.ByteBpe.load()


@pytest.fixture(scope="module")
def library(coder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


_BOTH = []
ODD = st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r'  \x1c\x85sstmdrevl09²Ⅳé漢́!.-A"), st.characters(blacklist_categories=("Cs",))), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD, min_size=1, max_size=5))
def test_equals_the_library(texts):
    if not _BOTH:
        c = B.ByteBpe.load()
        _BOTH.extend([c, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})])
    c, library = _BOTH
    for t, (ids, starts, slices) in zip(texts, c.encode_batch(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(t)
        assert c.decode(ids.tolist()) == t.encode()
        assert len(starts) == len(slices)


def test_long_slices_and_texts(coder, library):
    for t in ["x" * 30_000, " " * 20_000 + "a", "ab" * 9_000, "I'll" * 500, "it's 'round we've''s " * 2_000, "\n" * 3000, "é" * 70 + "!" * 90]:
        assert coder.encode(t) == library.encode_ordinary(t)


def test_scan_does_not_depend_on_the_blocks():
    rng = np.random.default_rng(3)
    classes = np.append(rng.integers(0, B.END + 1, 5000), B.END).astype(np.uint8)
    want = B.Automaton.built().starts(classes, 8192).tolist()
    for block in (1, 2, 7, 64, 4096):
        assert B.Automaton.built().starts(classes, block).tolist() == want
    state, marks = B.START, set()
    for k, c in enumerate(classes.tolist()):
        state, begins = B._step(state, c)
        marks |= ({k} if begins & B.HERE else set()) | ({k - 1} if begins & B.EARLIER else set())
    assert sorted(marks) == want


def test_side_by_side_equals_one_by_one(coder):
    rng = np.random.default_rng(5)
    slices = [bytes(rng.choice(list(b" abcethinrsou\xc3\xa9"), rng.integers(1, 30))) for _ in range(2000)]
    assert [np.frombuffer(x, np.int32).tolist() for x in coder._side_by_side(slices)] == [coder.merged(s) for s in slices]


def test_spans_decode_alone(coder):
    text = "Déjà vu:  we're 漢字 here,\n\n  isn't it \U0001f600?"
    (ids, starts, slices), = coder.encode_batch([text])
    firsts = B.firsts_of(slices)
    for a in range(len(text) + 1):
        for b in range(a, len(text) + 1):
            assert coder.decode_span(ids, starts, firsts, a, b) == text[a:b]


def test_query_on_whole_texts(spark, docs, library):
    got = {r["doc_id"]: r for r in queries.op11_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    for r in docs.collect():
        ids = library.encode_ordinary(r["text"])
        row = got[r["doc_id"]]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()
    assert len(got) == docs.count()


def test_odd_rows(spark, odd_docs, no_docs, library):
    want = sorted(((r["doc_id"], library.encode_ordinary(r["text"] or "")) for r in odd_docs.collect()), key=repr)
    made = B.encoded(odd_docs).collect()
    assert sorted(((r["doc_id"], r["ids"]) for r in made), key=repr) == want
    assert all(r["n_tokens"] == len(r["ids"]) and len(r["starts"]) == len(r["firsts"]) for r in made)
    back = sorted(((r["doc_id"], r["text"]) for r in B.decoded(B.encoded(odd_docs)).collect()), key=repr)
    assert back == sorted(((r["doc_id"], r["text"] or "") for r in odd_docs.collect()), key=repr)
    assert B.digests(odd_docs).count() == len(want)
    assert B.digests(no_docs).count() == 0 and B.encoded(no_docs).columns == ["doc_id", "n_tokens", "ids", "starts", "firsts"]
