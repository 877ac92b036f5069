"""Conversation structure repair: the cheapest edits that give a conversation the roles (s?(ua)+)?.

Turns in order are the layers of a forward Viterbi search over four states of the grammar: nothing yet, a
system turn, a user turn, an assistant turn. A state carries its minimum (cost, audit string). A turn is
kept, given another role or deleted; each layer is closed by up to two inserted turns. Of equal costs the
least audit wins. In one layer no audit of a state's candidates begins another of the same cost (what follows
could only be inserted turns, which cost), so the minimum stays the minimum when the same edits follow.

Conversations of up to LONG rows and BYTES bytes are searched where they are sorted, one after another. A
longer one, which may hold most rows of the table, is never one group: its equal rows are counted before
they are shuffled, the counts are dealt by ranges of (conversation, turn, role, text), and every SEGMENT of them is a
4 x 4 table of (cost, audit) from state to state. Such tables compose; a conversation's tables are folded in
order, each segment's part of the audit follows, and the repaired text streams through the SHA-256 in
order. (The audit is one string, and SHA-256 has no parts, so these two steps read a conversation in sequence.)

Defined results: null roles and texts are one space; a null conversation is one of its own; turns that are
null come first, and rows of one turn follow role and text; an empty role or text is a string like any other
(an empty text is blank), and very long texts are read whole; repeated rows are duplicates; an empty table
gives no rows; further columns, whatever their names, don't matter. A conversation without turns is repaired
to the empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import cut

#: A conversation with more rows or bytes goes by segments of so many counted rows (a power of two).
LONG, BYTES, SEGMENT = 4096, 16 << 20, 4096
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
#: States of the grammar, and the costs of the edits.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
REROLE, DELETE, INSERT, CUT_SHORT = 2, 3, 2, 1
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: The state that a turn of this role initial leads to, and that an inserted or given role leads to.
KEPT = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
NEXT = [USER, USER, ASSISTANT, USER]
GOOD, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Role initials that may follow each other.
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
#: So many names of long conversations are broadcast at most.
SMALL = 500_000
Layer = list["tuple[int, str] | None"]


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after the damage that crc32 of `conv_id:turn` modulo 20 stands for:
    0 drops a row, 1 empties its text, 2 takes its marks of sentence ends, 3 repeats it, 4 makes it the user's.
    Of a dropped row its conversation stays, with null role and text (which no other row has)."""
    d = rows.select(rows["conv_id"].cast("long").alias("conv_id"), rows["turn"].cast("long").alias("turn"), *(F.coalesce(rows[c].cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    d = d.withColumn("code", F.crc32(name.cast("binary")) % 20)
    role = F.when(F.col("code") == 4, "user").when(F.col("code") != 0, F.col("role"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).when(F.col("code") != 0, F.col("text"))
    copies = F.when(F.col("code") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return d.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies)).drop("col")


def fault_of(text: Column) -> Column:
    """BLANK, TRUNCATED or GOOD."""
    bare = F.rtrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", BLANK).when(F.substring(bare, -1, 1).isin(*".!?"), GOOD).otherwise(TRUNCATED)


def closed(layer: Layer) -> Layer:
    """The layer after inserted turns; two lead from any state to any that they reach."""
    out = list(layer)
    for _ in range(2):
        for state, best in enumerate(list(out)):
            if best is not None:
                made, to = (best[0] + INSERT, best[1] + "I"), NEXT[state]
                if out[to] is None or made < out[to]:
                    out[to] = made
    return out


def consumed(layer: Layer, initial: str, fault: int, times: int = 1) -> Layer:
    """The layer after a turn whose role begins with initial and that comes `times` times (the others are duplicates)."""
    out: Layer = [None] * 4

    def offer(to: int, cost: int, audit: str) -> None:
        if out[to] is None or (cost, audit) < out[to]:
            out[to] = cost, audit

    spare, gone = DELETE * (times - 1), "D" * (times - 1)
    extra = spare + (CUT_SHORT if fault == TRUNCATED else 0)
    for state, best in enumerate(closed(layer)):
        if best is None:
            continue
        cost, audit = best
        offer(state, cost + spare + DELETE, audit + "D" + gone)
        if fault in (BLANK, DUPLICATE):
            continue
        if initial in KEPT[state]:
            offer(KEPT[state][initial], cost + extra, audit + "K" + gone)
        offer(NEXT[state], cost + REROLE + extra, audit + "R" + gone)
    return out


def finished(layer: Layer) -> tuple[int, str]:
    """The cheapest whole conversation: an empty one, or one that ends with the assistant."""
    end = closed(layer)
    return min(x for x in (end[NOTHING], end[ASSISTANT]) if x is not None)


def search(turns: Iterable[tuple[str, int]]) -> tuple[int, str]:
    """(cost, audit) of a conversation's (role initial, fault) in order."""
    layer: Layer = [(0, ""), None, None, None]
    for initial, fault in turns:
        layer = consumed(layer, initial, fault)
    return finished(layer)


def transitions(turns: list[tuple[str, int, int]]) -> list[Layer]:
    """By state before a segment of (role initial, fault, times): the layer after it."""
    out = []
    for state in range(4):
        layer: Layer = [None] * 4
        layer[state] = 0, ""
        for initial, fault, times in turns:
            layer = consumed(layer, initial, fault, times)
        out.append(layer)
    return out


class Repair:
    """Writes repaired turns into a SHA-256, as their audit is read."""

    def __init__(self) -> None:
        self.sha, self.state, self.empty = hashlib.sha256(), NOTHING, True

    def put(self, role: str, text: str) -> None:
        self.sha.update((b"" if self.empty else b"\n") + role.encode() + b":" + text.encode())
        self.empty = False

    def inserted(self) -> None:
        self.state = NEXT[self.state]
        self.put(ROLES[self.state], "")

    def turn(self, edit: str, role: str, text: str) -> None:
        if edit == "K":
            self.state = KEPT[self.state][role[:1]]
            self.put(role, text)
        elif edit == "R":
            self.state = NEXT[self.state]
            self.put(ROLES[self.state], text)

    def follow(self, audit: str, turns: Iterable[tuple[str, str]]) -> None:
        rest = iter(turns)
        for edit in audit:
            if edit == "I":
                self.inserted()
            else:
                self.turn(edit, *next(rest))


def _fault(text: str) -> int:
    bare = text.rstrip(" \t\n\x0b\x0c\r")
    return BLANK if not bare else GOOD if bare[-1] in ".!?" else TRUNCATED


def _repaired(conv_id: int | None, turns: list[tuple[int | None, str, str]]) -> tuple:
    seen: set[tuple[str, str]] = set()
    faults, steps = [0] * 4, []
    for _, role, text in turns:
        fault = _fault(text)
        if fault != BLANK and (role, text) in seen:
            fault = DUPLICATE
        seen.add((role, text))
        faults[fault] += 1
        steps.append((role[:1], fault))
    numbers = {t for t, _, _ in turns if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    illegal = sum((a, b) not in LEGAL for (a, _), (b, _) in zip(steps, steps[1:]))
    cost, audit = search(steps)
    made = Repair()
    made.follow(audit, ((role, text) for _, role, text in turns))
    return conv_id, gaps, faults[BLANK], faults[DUPLICATE], faults[TRUNCATED], illegal, cost, audit, made.sha.hexdigest()


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    kind = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind[t]) for k, t in enumerate(kinds)], list(names))


def _short(turns: DataFrame) -> DataFrame:
    """Results of conversations, each sorted and searched within its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = []
        for conv_id, own in groupby(_tuples(batches), key=lambda r: r[0]):
            made.append(_repaired(conv_id, [r[1:] for r in own if r[2] is not None]))
            if len(made) == 1024:
                yield _table(made, RESULT)
                made = []
        yield _table(made, RESULT)

    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, RESULT)


def _segment(pdf: pd.DataFrame) -> pd.DataFrame:
    """A segment's table, with what its neighbours need to know."""
    pdf = pdf.sort_values("pos")
    rows = [(a, int(f), int(m)) for a, f, m in zip(pdf["initial"], pdf["fault"], pdf["times"])]
    illegal = sum((a[0], b[0]) not in LEGAL for a, b in zip(rows, rows[1:])) + sum(m - 1 for _, _, m in rows)
    conv_id = pdf["conv_id"].iloc[0]
    head = (None if pd.isna(conv_id) else int(conv_id), int(pdf["seg"].iloc[0]), rows[0][0], rows[-1][0], illegal)
    made = [(*head, i, j, *best) for i, layer in enumerate(transitions(rows)) for j, best in enumerate(layer) if best is not None]
    return pd.DataFrame(made, columns=["conv_id", "seg", "head", "tail", "illegal", "i", "j", "cost", "audit"]).astype({"conv_id": "Int64"})


def _folded(rows: Iterable[tuple]) -> tuple[int, int, list[tuple[int, str]]]:
    """(cost, illegal, [(segment, part of the audit)]) of a conversation's tables in order.

    The four paths are chains of parts that share what they have in common. Two of them never are
    beginnings of each other, as they end in a turn and not in inserted ones, so their order is settled
    once and for all and kept as a rank; a part is only compared with those that follow the same path.
    """
    layer: dict[int, tuple[int, int, tuple | None]] = {NOTHING: (0, 0, None)}
    illegal, tail, seg = 0, None, 0
    for seg, own in groupby(rows, key=lambda r: r[1]):
        best: dict[int, tuple] = {}
        for k, (_, _, head, end, inside, i, j, cost, audit) in enumerate(own):
            if not k:
                illegal += inside + (tail is not None and (tail, head) not in LEGAL)
                tail = end
            if i in layer:
                offered = (layer[i][0] + cost, layer[i][1], audit, i)
                if j not in best or offered < best[j]:
                    best[j] = offered
        order = sorted(best, key=lambda j: best[j][1:3])
        layer = {j: (best[j][0], order.index(j), (layer[best[j][3]][2], seg, best[j][2])) for j in best}
    ends = []
    for state, (cost, rank, path) in layer.items():
        alone: Layer = [None] * 4
        alone[state] = cost, ""
        end = closed(alone)
        ends += [(*x, rank, path) for x in (end[NOTHING], end[ASSISTANT]) if x is not None]
    cost, last, _, path = min(ends, key=lambda x: (x[0], x[2], x[1]))
    parts = [(seg + 1, last)]
    while path is not None:
        path, at, audit = path
        parts.append((at, audit))
    return cost, illegal, parts[::-1]


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    return (r for batch in batches for k in range(0, batch.num_rows, 256) for r in zip(*(c.to_pylist() for c in batch.slice(k, 256).columns)))


def _long(turns: DataFrame) -> DataFrame:
    """The same results of conversations of any length, by segments."""
    by = ["conv_id", "turn", "role", "text"]
    runs = turns.where(F.col("text").isNotNull()).groupBy(*by).agg(F.count("*").alias("times"))
    runs = cut(runs.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("pos", F.monotonically_increasing_id()))
    seg = F.shiftright("pos", SEGMENT.bit_length() - 1)
    light = runs.select("conv_id", "turn", "pos", "times", "role", F.sha2("text", 256).alias("h"), F.substring("role", 1, 1).alias("initial"), fault_of(F.col("text")).alias("fault"), seg.alias("seg"))
    first = light.groupBy("conv_id", "role", "h").agg(F.min("pos").alias("first"))
    same = F.col("l.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("l.role") == F.col("f.role")) & (F.col("l.h") == F.col("f.h"))
    fault = F.when((F.col("fault") != BLANK) & (F.col("pos") != F.col("first")), DUPLICATE).otherwise(F.col("fault"))
    steps = cut(light.alias("l").join(first.alias("f"), same).select("l.conv_id", "turn", "pos", "times", "initial", fault.alias("fault"), "seg"))

    is_ = lambda f, then: F.sum(F.when(F.col("fault") == f, then).otherwise(0))
    again = is_(GOOD, F.col("times") - 1) + is_(TRUNCATED, F.col("times") - 1) + is_(DUPLICATE, F.col("times"))
    counts = steps.groupBy("conv_id", "turn").agg(is_(BLANK, F.col("times")).alias("blank"), again.alias("duplicate"), is_(TRUNCATED, F.lit(1)).alias("truncated"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    counts = counts.groupBy("conv_id").agg(gaps.alias("gaps"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))
    counts = counts.withColumnRenamed("conv_id", "id")

    tables = steps.groupBy("conv_id", "seg").applyInPandas(_segment, "conv_id long, seg long, head string, tail string, illegal long, i int, j int, cost long, audit string")
    in_parts = "conv_id long, seg long, part string, cost long, illegal long"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv_id, own in groupby(_tuples(batches), key=lambda r: r[0]):
            cost, illegal, parts = _folded(own)
            for k in range(0, len(parts), 256):
                yield _table([(conv_id, at, part, cost, illegal) for at, part in parts[k : k + 256]], in_parts)

    parts = cut(tables.repartition("conv_id").sortWithinPartitions("conv_id", "seg", "i", "j").mapInArrow(fold, in_parts))
    none = F.lit(None)
    stream = parts.select("conv_id", "seg", F.lit(-1).cast("long").alias("pos"), "part", none.cast("string").alias("role"), none.cast("string").alias("text"), none.cast("long").alias("times"), "cost", "illegal")
    stream = stream.unionByName(runs.select("conv_id", seg.alias("seg"), "pos", none.cast("string").alias("part"), "role", "text", "times", none.cast("long").alias("cost"), none.cast("long").alias("illegal")))
    in_made = "conv_id long, cost long, illegal long, audit string, repaired_sha256 string"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv_id, own in groupby(_tuples(batches), key=lambda r: r[0]):
            made, audit, part, at, totals = Repair(), [], "", 0, (0, 0)
            for _, _, _, fresh, role, text, times, cost, illegal in own:
                if fresh is not None:
                    audit.append(fresh)
                    part, at, totals = fresh, 0, (cost, illegal)
                while part[at : at + 1] == "I":
                    made.inserted()
                    at += 1
                if fresh is None:
                    made.turn(part[at], role, text)
                    at += times
            yield _table([(conv_id, *totals, "".join(audit), made.sha.hexdigest())], in_made)

    made = stream.repartition("conv_id").sortWithinPartitions("conv_id", "seg", "pos").mapInArrow(write, in_made)
    return made.join(counts, made["conv_id"].eqNullSafe(counts["id"])).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repair_conversations(turns: DataFrame) -> DataFrame:
    """The edits that repair each conversation of conv_id, turn, role and text (rows without role and text
    only name their conversation), its faults, and the SHA-256 of what they give."""
    sizes = turns.groupBy("conv_id").agg(F.count("text").alias("n"), F.sum(F.octet_length("text")).alias("size"))
    long = cut(sizes.where((F.col("n") > LONG) | (F.col("size") > BYTES)).select(F.col("conv_id").alias("id")))
    n = long.count()
    if not n:
        return _short(turns)
    side = F.broadcast(long) if n <= SMALL else long
    same = turns["conv_id"].eqNullSafe(side["id"])
    return _short(turns.join(side, same, "left_anti")).unionByName(_long(turns.join(side, same, "left_semi")))


def repaired(rows: DataFrame) -> DataFrame:
    """As repair_conversations, of rows that are damaged first."""
    return repair_conversations(damaged(rows))
