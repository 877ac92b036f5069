from collections import Counter

from reelspark.llm import quality_rules as Q


def brute(text):
    words = (text or "").encode().split()
    grams = Counter(zip(words, words[1:], words[2:]))
    inside = set()
    for k, g in enumerate(zip(words, words[1:], words[2:])):
        if grams[g] > 1:
            inside |= {k, k + 1, k + 2}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(words), sum(len(w.decode()) for w in words), sum(c in Q.SYMBOLS for c in text or ""), len(lines) - len(set(lines)), len(inside)


def check(frame):
    want = Counter((r["doc_id"], *brute(r["text"])) for r in frame.collect())
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = Q.quality_verdicts(frame).collect()
    assert Counter(tuple(r[n] for n in names) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_measures_equal_brute_force(docs):
    check(docs)


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs)
    assert Q.quality_verdicts(no_docs).count() == 0 and Q.drop_rejected(no_docs).count() == 0


def test_stage_keeps_columns_and_only_passing_rows(docs):
    kept = Q.drop_rejected(docs)
    assert kept.columns == docs.columns
    want = {r["doc_id"] for r in Q.quality_verdicts(docs).where("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == want


def test_ledger_serves_policies_and_ablation(docs):
    led = Q.ledger(docs).cache()
    rows = led.collect()
    for name, rules in Q.POLICIES.items():
        assert led.where(Q.apply_policy(led, name)).count() == sum(r["failed"] & Q.mask_of(rules) == 0 for r in rows)
    mask = Q.mask_of("v1")
    for a in Q.ablation(led).collect():
        bit = Q.mask_of([a["rule"]])
        assert a["rejects_alone"] == sum(r["failed"] & mask == bit for r in rows)
        assert a["policy_rejects"] == sum(r["failed"] & mask != 0 for r in rows)


def test_main_path_has_no_python(docs):
    plan = Q.quality_verdicts(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
