import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from reelspark.llm import fill_middle as M
from reelspark.llm import queries


def brute(doc_id, text):
    """As the contract says it, with the re module."""
    text = text or ""
    words = re.findall(M.TOKEN, text)
    n = len(words)
    d = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(words[:a]), "".join(words[a:b]), "".join(words[b:])
    spm = h[3] % 100 < 80
    return n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**12), st.text(alphabet=st.one_of(st.sampled_from(" \n\t\x0b\x1c\x85ab<PSM>"), st.characters(blacklist_categories=("Cs",))), max_size=40))
def test_equals_brute_force_and_comes_back(doc_id, text):
    rule = M.FillMiddle()
    c = rule.cut(M._splitter(), doc_id, text)
    out = rule.output(text, c)
    assert (c.n, c.form, c.low, None if c.low is None else c.high - c.low, out) == brute(doc_id, text)
    assert rule.restored(out, c.form) == text


def test_odd_rows(odd_docs, no_docs):
    got = sorted(map(tuple, M.fill_middle(odd_docs).collect()), key=repr)
    assert got == sorted(((r["doc_id"], *brute(r["doc_id"], r["text"])) for r in odd_docs.collect()), key=repr)
    back = sorted(map(tuple, M.restore(M.fill_middle(odd_docs)).collect()), key=repr)
    assert back == sorted(((r["doc_id"], r["text"] or "") for r in odd_docs.collect()), key=repr)
    assert M.fill_middle(no_docs).count() == 0


def test_query(spark, docs):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = sorted(map(tuple, queries.op13_fill_middle(spark, "/root/testdata/sf0.001").collect()))
    want = [(r["doc_id"], *brute(r["doc_id"], r["text"]), r["text"]) for r in docs.collect()]
    assert got == sorted((*w[:-2], sha(w[-2]), sha(w[-1])) for w in want)
    assert {g[2] for g in got} == {"plain", "spm", "psm"}


def test_rates_are_parameters(docs):
    forms = {r["form"] for r in M.fill_middle(docs, M.FillMiddle(rate=100, suffix_first=0)).collect()}
    assert forms == {"psm"}
