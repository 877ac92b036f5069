import corpus_pipeline as C
from reelspark.llm import mixing, pii, quality_rules

SMALL = "/root/testdata/sf0.001"


def first_of_near_copies(rows, size=5, least=0.8):
    """The smallest id of each group of texts whose sets of five-word shingles are alike by brute force."""
    sets = {}
    for r in rows:
        w = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"]] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))}
    root, changed = {i: i for i in sets}, True
    pairs = [(i, j) for i in sets for j in sets if j < i and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in pairs:
            low = min(root[i], root[j])
            changed |= (root[i], root[j]) != (low, low)
            root[i] = root[j] = low
    return set(root.values())


def test_stages_take_effect_one_after_another(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in C.STAGES] == ["quality_rules", "simhash_near_dedup", "pii", "mixing", "sentencepiece"]
    seen = [docs]
    for name, stage in C.STAGES:
        out = stage(spark, seen[-1], SMALL)
        if name != C.STAGES[-1][0]:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
    good, one, clean, mixed, ids = seen[1:]
    assert {r["doc_id"] for r in good.collect()} == {r["doc_id"] for r in quality_rules.quality_verdicts(docs).where("kept").collect()}
    assert {r["doc_id"] for r in one.collect()} == first_of_near_copies(good.collect())
    assert not any(pii.base_spans(r["text"]) for r in clean.collect()) and clean.count() == one.count()
    taken = {r["doc_id"]: r["taken"] for r in mixing.taken(clean).collect()}
    words = {}
    for r in mixed.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].encode().split())
    assert words == {k: n for k, n in taken.items() if n}
    assert ids.count() == mixed.count() and ids.where("not round_trip").count() == 0


def test_run_registers(spark):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is C.run
    assert {f"op{k}" for k in range(1, 14)} == {n.split("_")[0] for n in entry.queries() if n.startswith("op")}
