import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from reelspark.llm import conversations as C

SCHEMA = "text string, n long, turn long, pos long, role string, conv_id long, seg long, id long"


def brute(turns):
    """Cheapest edits of (role, text, fault) by trying all of them, with up to two inserted turns anywhere."""
    found = []
    for edits in itertools.product("DKR", repeat=len(turns)):
        if any(e != "D" and f in (C.BLANK, C.DUPLICATE) for e, (_, _, f) in zip(edits, turns)):
            continue
        for inserts in itertools.product(range(3), repeat=len(turns) + 1):
            slots, cost, audit = [], 0, ""
            for k in range(len(turns) + 1):
                slots += ["?"] * inserts[k]
                cost += 2 * inserts[k]
                audit += "I" * inserts[k]
                if k < len(turns):
                    e, (role, _, f) = edits[k], turns[k]
                    audit += e
                    cost += {"D": 3, "K": 0, "R": 2}[e] + (e != "D" and f == C.TRUNCATED)
                    slots += [] if e == "D" else ["?"] if e == "R" else [role[:1] or "-"]
            if found and (cost, audit) > min(found):
                continue
            for given in itertools.product("ua", repeat=slots.count("?")):
                it = iter(given)
                if re.fullmatch("(s?(ua)+)?", "".join(next(it) if s == "?" else s for s in slots)):
                    found.append((cost, audit))
                    break
    return min(found)


def reference(rows):
    """Result rows of (conv_id, turn, role, text), in plain Python."""
    out = {}
    for conv_id, turn, role, text in rows:
        own = out.setdefault(conv_id, [])
        name = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        code, role, text = zlib.crc32(name.encode()) % 20, " " if role is None else role, " " if text is None else text
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        own += [(turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    made = []
    for conv_id, own in out.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in own:
            bare = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            faults.append(C.BLANK if not bare else C.DUPLICATE if (role, text) in seen else C.GOOD if bare[-1] in ".!?" else C.TRUNCATED)
            seen.add((role, text))
        numbers = {t for t, _, _ in own if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[1][:1] + "-" + b[1][:1] not in ("s-u", "u-a", "a-u") for a, b in zip(own, own[1:]))
        cost, audit = C.search((r[1][:1], f) for r, f in zip(own, faults))
        roles, rest, texts = "", iter(own), []
        for e in audit:
            turn = next(rest) if e != "I" else (None, "", "")
            if e == "D":
                continue
            role = turn[1] if e == "K" else "assistant" if roles.endswith("u") else "user"
            roles += role[:1]
            texts.append(f"{role}:{turn[2]}")
        assert re.fullmatch("(s?(ua)+)?", roles)
        made.append((conv_id, gaps, *(faults.count(f) for f in (C.BLANK, C.DUPLICATE, C.TRUNCATED)), illegal, cost, audit, hashlib.sha256("\n".join(texts).encode()).hexdigest()))
    return sorted(made, key=repr)


def test_search_equals_trying_everything():
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 3, 3, 4, 4):
        for _ in range(40 if n < 4 else 12):
            turns = [(rng.choice(["user", "assistant", "system", "tool", ""]), "t", rng.choice([C.GOOD, C.GOOD, C.BLANK, C.DUPLICATE, C.TRUNCATED])) for _ in range(n)]
            assert C.search((r[:1], f) for r, _, f in turns) == brute(turns), turns


def test_tables_compose():
    rng = random.Random(4)
    for _ in range(60):
        turns = [(rng.choice("uuaas-"), rng.choice([C.GOOD, C.GOOD, C.BLANK, C.DUPLICATE, C.TRUNCATED])) for _ in range(rng.randint(1, 14))]
        rows, k, seg = [], 0, 0
        while k < len(turns):
            part = [(*t, 1) for t in turns[k : k + rng.randint(1, 4)]]
            k, seg = k + len(part), seg + 1
            rows += [(0, seg, part[0][0], part[-1][0], 0, i, j, *b) for i, layer in enumerate(C.transitions(part)) for j, b in enumerate(layer) if b]
        cost, _, parts = C._folded(rows)
        assert (cost, "".join(p for _, p in parts)) == C.search(turns)


def test_a_run_is_its_rows():
    for fault in (C.GOOD, C.TRUNCATED, C.BLANK, C.DUPLICATE):
        for initial in "uas-":
            layer = [(0, ""), (1, "K"), (3, "KK"), (2, "KKK")]
            rest = C.DUPLICATE if fault != C.BLANK else C.BLANK
            one_by_one = C.consumed(C.consumed(C.consumed(layer, initial, fault), initial, rest), initial, rest)
            assert C.closed(C.consumed(layer, initial, fault, 3)) == C.closed(one_by_one)  # an insert among deletions is the greater audit


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(7)
    texts = [None, "", " \n", "Yes.", "No!", "Why? ", "cut off", "cut off", "Über é", "word " * 3000 + "."]
    rows = [(c, rng.choice([None, *range(6)]), rng.choice(["user", "assistant", "system", "tool", None, ""]), rng.choice(texts)) for c in [None, *range(40)] for _ in range(rng.randint(1, 9))]
    rows += [(77, t // 3, ("user", "assistant")[t % 2], rng.choice(texts)) for t in range(700)] + [(78, 5, "user", "the same.")] * 400 + [(79, t, "user", "again.") for t in range(300)] + [(78, 5, "assistant", "")] * 30
    return rows, spark.createDataFrame([(text, 0, turn, 0, role, conv_id, 0, 0) for conv_id, turn, role, text in rows], SCHEMA).repartition(5)


def results(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_damage_and_repair_of_odd_rows(odd):
    rows, df = odd
    assert results(C.repaired(df)) == reference(rows)


@pytest.mark.parametrize("segment", [4, 64])
def test_long_conversations_go_by_segments(odd, monkeypatch, segment):
    rows, df = odd
    monkeypatch.setattr(C, "LONG", 5)
    monkeypatch.setattr(C, "SEGMENT", segment)
    assert results(C.repaired(df)) == reference(rows)


def test_long_texts_go_by_segments_and_lists_of_names_by_a_shuffle(odd, monkeypatch):
    rows, df = odd
    monkeypatch.setattr(C, "BYTES", 100)
    monkeypatch.setattr(C, "SMALL", 0)
    assert results(C.repaired(df)) == reference(rows)


def test_no_rows(spark, odd):
    assert C.repaired(odd[1].limit(0)).count() == 0
    only = spark.createDataFrame([(1, t, "user", "x.") for t in range(200)], "conv_id long, turn long, role string, text string")
    gone = only.where(F.crc32(F.concat_ws(":", "conv_id", "turn").cast("binary")) % 20 == 0).limit(1)
    assert results(C.repaired(gone)) == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
