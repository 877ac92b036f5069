"""Language-model scores by logistic context mixing.

A text is its tokens: its lower-cased words and an end. A token is coded bit by bit down a Huffman
tree of the corpus's common words, which has one leaf for all other words. For the first DEPTH bits
the predictions of several contexts are combined in the logistic domain: the tree's own counts, and
counts of the node's bit in rows of a table that the context is hashed to (the last very common word,
the word before, the two words before), and the word that followed the same two words earlier in the
text. The weights are selected by a gate (how far the last prediction held, whether the word before
has a row, how deep the node is); they are learned online on the training texts of one share, whose
size is in proportion to the corpus, apart on each task and averaged, against counts without that share.
In each text they are refined from its first tokens on, in blocks that double from 16 tokens, so that a
block is scored by what came before. The bits below DEPTH cost what the tree's counts say.

Any other word is a known one with the probability of its count in the words of that kind, or is
spelled; the share of spelled ones is Good and Turing's. The counts of all words are a written table
that grows with the corpus and is joined to the texts' uncommon words; spelling mixes hashed contexts
of the last 1 to 3 letters, counted over all uncommon words. All bits summed are the text's cost, and
the rows of the contexts' table grow with the corpus as well, by its logarithm (ROWS, PAIRS).

Beside it stands the add-one unigram score of words.

Defined results: a null text is empty and has the end alone; repeated rows stay; a null doc_id
learns and is not held out; without training documents every bit is even and every count 0; an empty
table gives none; further columns, whatever their names, don't matter. A very long text is scored in
blocks of at most MOST_BLOCK tokens, beside its words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import cut, id_and_text, lower_words, remainder, remainder_column

FOLD = (7, 2)
#: The share of the training documents on which weights are learned, by crc32 of the id.
SHARE = (61, 5)
#: Counts of so many of the commonest words are broadcast at most; a task adds up so many words at a time.
COMMON, GATHERED = 1 << 17, 400_000
#: Bits of a token that are mixed, and nodes of the tree above that depth; the last number stands for none.
DEPTH = 8
NODES = 1 << DEPTH
NONE = NODES - 1
#: Rows of contexts: of the last word among the TOP commonest; of the word before, which has a row of its
#: own if it occurs PER_ROW times and is among the commonest; of pairs of words. For each doubling of the
#: corpus beyond 2**GROWS tokens there are ROWS more of words and PAIRS more of pairs, so that a table of
#: any corpus fits in memory (at 2**50 tokens 40 million counts); what is joined grows in proportion.
TOP, PER_ROW, GROWS, ROWS, PAIRS = 256, 64, 10, 256, 512
CONTEXTS = 3
INPUTS = CONTEXTS + 3  # the tree, the contexts, the text's own prediction, a bias
GATES = 3 * 2 * DEPTH
START = np.tile(np.array([0.4, 0.3, 0.3, 0.2, 1.0, 0.0]), (GATES, 1))
#: Tokens of a text's first block, and of its largest; texts scored together.
FIRST_BLOCK, MOST_BLOCK, TOGETHER = 16, 1024, 256
#: Tokens counted at a time; tokens and words for which a task sends a table of contexts, and of letters.
COUNTED = 1 << 18
PER_TABLE, PER_LETTERS = 1 << 21, 1 << 17
#: Rows of a table that one message of a task holds (a place in it has 16 bits), and parts in which the
#: messages of a block are summed first.
MESSAGE, SALTS = 128, 8


def _message(block: int, part: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    """A block's cells that aren't zero: their places, their counts up to 255, and those beyond whole."""
    at = np.flatnonzero(part)
    n = part[at]
    return block, at.astype(np.uint16).tobytes(), np.minimum(n, 255).astype(np.uint8).tobytes(), n[n >= 255].astype(np.int64).tobytes()


def _read(at: bytes, n: bytes, large: bytes) -> tuple[np.ndarray, np.ndarray]:
    counts = np.frombuffer(n, np.uint8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(large, np.int64)
    return np.frombuffer(at, np.uint16).astype(np.int64), counts


def _batch(rows: list[tuple[int, bytes, bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["block", "at", "n", "large"])


def messages(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The table's rows that aren't zero, in blocks."""
    for k in range(0, len(table), MESSAGE):
        part = table[k : k + MESSAGE].reshape(-1)
        if part.any():
            yield _batch([_message(k // MESSAGE, part)])


def summed(sent: DataFrame, rows: int, width: int) -> np.ndarray:
    """The sum of the tasks' tables (rows by width), whose size is fixed: first in SALTS parts, then whole,
    so that no task reads from all others or holds more than the table."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, *message in zip(*(c.to_pylist() for c in batch.columns)):
                at, n = _read(*message)
                sums.setdefault(block, np.zeros(MESSAGE * width, np.int64))[at] += n
        for block, part in sums.items():
            yield _batch([_message(block, part)])

    parts = int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = sent.withColumn("salt", F.spark_partition_id() % SALTS)
    some = salted.repartition(parts, "block", "salt").drop("salt").mapInArrow(add, MESSAGES)
    table = np.zeros(-(-rows // MESSAGE) * MESSAGE * width, np.float32)
    for row in some.repartition(parts, "block").mapInArrow(add, MESSAGES).toLocalIterator():
        at, n = _read(row["at"], row["n"], row["large"])
        table[row["block"] * MESSAGE * width + at] += n
    return table[: rows * width].reshape(rows, width)


MESSAGES = "block int, at binary, n binary, large binary"


# --- words


def word_counts(docs: DataFrame, fold: tuple[int, int] = FOLD) -> DataFrame:
    """word and n over the training documents; the empty word is the end of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "surrogatepass") for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if remainder(doc_id, fold[0]) != fold[1]:
                    seen.update(lower_words(text.as_py()))
                    seen[b""] += 1
                    if len(seen) > GATHERED:
                        yield out()
                        seen.clear()
        yield out()

    return id_and_text(docs).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def size_class():
    """Words of one class have counts that differ by less than a tenth."""
    return F.floor(F.log2("n") * 8)


@dataclass
class Common:
    """The common words by falling count, the totals, and the least size class of a common word."""

    words: list[bytes]
    counts: np.ndarray
    tokens: int  # of all words
    kinds: int
    once: int  # other words that occur once
    least_class: int

    @property
    def rare(self) -> int:
        return self.tokens - int(self.counts.sum())

    @property
    def spelled(self) -> float:
        """Share of the uncommon words that were never met, by those met once."""
        return max(self.once, 1) / (self.rare + 1) if self.rare else 1.0


def common_words(words: DataFrame, most: int | None = None) -> Common:
    """Words are common from the size class on above which there are no more than `most` of them."""
    most = COMMON if most is None else most
    least, above, once, tokens, kinds = 1 << 20, 0, 0, 0, 0
    found = words.groupBy(size_class().alias("c")).agg(F.count("*").alias("k"), F.sum("n").alias("n")).collect()  # a row for each class
    for row in sorted(found, key=lambda r: -r["c"]):
        above += row["k"]
        tokens, kinds = tokens + row["n"], kinds + row["k"]
        if above <= most:
            least = row["c"]
        if row["c"] == 0 and least > 0:
            once = row["k"]
    top = words.where(size_class() >= least).toArrow()
    pairs = sorted(zip((w.encode("utf-8", "surrogatepass") for w in top["word"].to_pylist()), top["n"].to_pylist()), key=lambda x: (-x[1], x[0]))
    return Common([w for w, _ in pairs], np.array([n for _, n in pairs], np.int64), tokens, kinds, once, least)


@dataclass
class Tree:
    """Of each common word, and of all others as the last leaf: the nodes above DEPTH on its path (NONE
    below its leaf), the bits there and the cost of the rest; of each node the log odds of bit 1.

    The words lie in alphabetical order and are split where both sides weigh about the same, so that
    the first bits tell how a word begins, which contexts know best; the order costs nothing, as the
    bits' own odds are in the mix."""

    nodes: np.ndarray
    bits: np.ndarray
    tail: np.ndarray
    odds: np.ndarray

    @classmethod
    def of(cls, common: Common) -> Tree:
        n = len(common.words) + 1
        order = np.array([*sorted(range(n - 1), key=common.words.__getitem__), n - 1])
        weight = np.append(common.counts, common.rare + 1)[order].astype(float)
        before = np.concatenate([[0], np.cumsum(weight)])
        nodes, bits = np.full((n, DEPTH), NONE, np.int64), np.zeros((n, DEPTH), np.float32)
        tail, odds = np.zeros(n, np.float32), np.zeros(NODES, np.float32)
        todo, number = [(0, n, 0)], 0
        while todo:
            low, high, depth = todo.pop()
            if high - low == 1 or depth == DEPTH:
                tail[order[low:high]] = np.log2((before[high] - before[low]) / weight[low:high])
                continue
            half = (before[low] + before[high]) / 2
            cut_ = int(np.clip(np.searchsorted(before, half), low + 1, high - 1))
            if cut_ - 1 > low and half - before[cut_ - 1] < before[cut_] - half:
                cut_ -= 1
            nodes[order[low:high], depth] = number
            bits[order[cut_:high], depth] = 1
            odds[number] = np.log((before[high] - before[cut_]) / (before[cut_] - before[low]))
            todo += [(cut_, high, depth + 1), (low, cut_, depth + 1)]
            number += 1
        return cls(nodes, bits, tail, odds)


# --- the mixer


@dataclass
class Layout:
    """How many rows the contexts have: of words before, and of pairs."""

    rows: int
    pairs: int

    @classmethod
    def of(cls, common: Common) -> Layout:
        doublings = max(1, (common.tokens >> GROWS).bit_length())
        often = int(np.searchsorted(-common.counts, -PER_ROW, side="right"))
        return cls(min(often, ROWS * doublings), PAIRS * doublings)

    @property
    def total(self) -> int:
        return TOP + 1 + self.rows + 2 + self.pairs


@dataclass
class Tokens:
    """Texts one after another: leaves of the tokens, where texts begin, rows of the contexts, the leaf
    that the text's own past predicts (-1: none) and whether its last prediction was right (2), wrong (1) or none (0)."""

    leaves: np.ndarray
    starts: np.ndarray
    rows: np.ndarray
    guess: np.ndarray
    trust: np.ndarray


def prepared(leaves: np.ndarray, starts: np.ndarray, layout: Layout, other: int, guessed: bool = True) -> Tokens:
    """other: the leaf of all uncommon words; the texts' own predictions may be left out."""
    n = len(leaves)
    at = np.arange(n)
    begun = np.repeat(starts, np.diff(np.append(starts, n)))
    one = np.where(at > begun, leaves[at - 1], -1)
    two = np.where(at > begun + 1, leaves[np.maximum(at - 2, 0)], -1)
    last = np.maximum.accumulate(np.where(leaves < TOP, at, -1)) if n else at
    last = np.concatenate([[-1], last[:-1]]) if n else last
    top = np.where(last >= begun, leaves[last], TOP)
    top[(top == other) & (top < TOP)] = TOP
    before = np.where(one < 0, layout.rows + 1, np.where(one < layout.rows, one, layout.rows))
    mixed = ((one + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ ((two + 1).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    pair = (mixed >> np.uint64(40)).astype(np.int64) % layout.pairs
    rows = np.stack([top, TOP + 1 + before, TOP + 1 + layout.rows + 2 + pair])
    if not guessed:
        return Tokens(leaves, starts, rows, leaves[:0], leaves[:0])
    # The token that followed the same two tokens the last time in the text.
    key = (mixed >> np.uint64(24)) ^ (begun.astype(np.uint64) << np.uint64(40))
    order = np.argsort(key, kind="stable")
    same = np.zeros(n, bool)
    same[1:] = (key[order[1:]] == key[order[:-1]]) & (begun[order[1:]] == begun[order[:-1]]) & (two[order[1:]] >= 0)
    guess = np.full(n, -1, leaves.dtype)
    guess[order[same]] = leaves[order[np.flatnonzero(same) - 1]]
    held = np.where(guess < 0, 0, np.where(guess == leaves, 2, 1))
    trust = np.where(at > begun, held[at - 1], 0)
    return Tokens(leaves, starts, rows, guess, trust)


@dataclass
class Mixer:
    """The tree, the contexts' log odds (rows by nodes) and the gates' weights."""

    tree: Tree
    layout: Layout
    table: np.ndarray
    weights: np.ndarray = field(default_factory=START.copy)

    def inputs(self, t: Tokens, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the tokens at `at`, for each of DEPTH bits: the inputs, which are 0 where there is no bit, the
        bit, and whether there is one; and of each token the group of its gates."""
        leaves = t.leaves[at]
        node, bit = self.tree.nodes.take(leaves, 0), self.tree.bits.take(leaves, 0)
        real = node != NONE
        flat = self.table.reshape(-1)
        x = np.empty((INPUTS, *node.shape), np.float32)
        self.tree.odds.take(node, out=x[0], mode="clip")
        for k in range(CONTEXTS):
            flat.take(t.rows[k].take(at)[:, None] * NODES + node, out=x[1 + k], mode="clip")
        x[1 + CONTEXTS] = 0
        guess = t.guess.take(at)
        known = np.flatnonzero(guess >= 0)
        if len(known):
            guess = guess[known]
            x[1 + CONTEXTS, known] = np.where((self.tree.nodes[guess] == node[known]) & real[known], 2 * self.tree.bits[guess] - 1, 0)
        x[-1] = real
        group = t.trust.take(at) * 2 + (t.rows[1].take(at) - (TOP + 1) < self.layout.rows)
        return x, group, bit, real

    def bits(self, t: Tokens) -> np.ndarray:
        """Cost in bits of the tokens of each text, uncommon ones as such. All texts' first blocks are scored
        together, then the second ones, and so on; after each the text's own weights are refined."""
        ends = np.append(t.starts[1:], len(t.leaves))
        total = np.add.reduceat(self.tree.tail.take(t.leaves), t.starts, dtype=np.float64) if len(t.starts) else np.zeros(0)
        own = np.zeros((len(t.starts), INPUTS), np.float32)
        live, low, size = np.arange(len(t.starts)), 0, FIRST_BLOCK
        weights = np.ascontiguousarray(self.weights.astype(np.float32).reshape(-1, DEPTH, INPUTS).transpose(2, 0, 1))
        while len(live):
            begun = t.starts[live] + low
            counts = np.minimum(ends[live] - begun, size)
            firsts = np.cumsum(counts) - counts
            at = np.repeat(begun - firsts, counts) + np.arange(int(counts.sum()))
            x, group, bit, real = self.inputs(t, at)
            z = np.zeros(bit.shape, np.float32)
            for k in range(INPUTS):
                w = weights[k].take(group, 0)
                if low:
                    w += np.repeat(own[live, k], counts)[:, None]
                w *= x[k]
                z += w
            np.clip(z, -12, 12, out=z)
            cost = 1 - 2 * bit
            cost *= z
            np.exp(cost, out=cost)
            cost += 1
            np.log2(cost, out=cost)
            cost *= real
            total[live] += np.add.reduceat(cost.sum(axis=1), firsts, dtype=np.float64)
            more = ends[live] > begun + size
            if more.any():
                error = bit - 1 / (1 + np.exp(-z))
                for k in range(INPUTS):
                    step = np.add.reduceat(np.einsum("td,td->t", error, x[k]), firsts)
                    bent = np.add.reduceat(np.einsum("td,td->t", x[k], x[k]), firsts)
                    own[live, k] += 0.5 * step / (0.25 * bent + 20)
                np.clip(own, -0.75, 0.75, out=own)
            live, low, size = live[more], low + size, min(2 * size, MOST_BLOCK)
        return total

    def learn(self, t: Tokens, bent: np.ndarray) -> np.ndarray:
        """Online steps on the gates' weights, block by block, scaled by the curvature met so far (bent); how often each gate was met."""
        met = np.zeros(GATES)
        for low in range(0, len(t.leaves), 256):
            x, group, bit, real = self.inputs(t, np.arange(low, min(low + 256, len(t.leaves))))
            here, gate = real.reshape(-1), group[:, None] * DEPTH + np.arange(DEPTH)
            xs, g, y = x.reshape(INPUTS, -1)[:, here].astype(np.float64), gate.reshape(-1)[here], bit.reshape(-1)[here]
            z = np.clip((self.weights[g].T * xs).sum(axis=0), -12, 12)
            p = 1 / (1 + np.exp(-z))
            error, curve = y - p, p * (1 - p)
            for k in range(INPUTS):
                bent[:, k] += np.bincount(g, xs[k] ** 2 * curve, GATES)
                self.weights[:, k] += np.bincount(g, xs[k] * error, GATES) / np.sqrt(bent[:, k] * (bent[:, k] + 400))
            met += np.bincount(g, minlength=GATES)
        return met


def log_odds(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Drawn to 0 where little was seen; exactly 0 where nothing was."""
    return np.log((one + 0.4) / (zero + 0.4)).astype(np.float32)


_ENDED = (b"",)


class Coder:
    """Leaves of texts' words; other words get the last leaf."""

    def __init__(self, common: Common) -> None:
        self.leaf = {w: k for k, w in enumerate(common.words)}
        self.other = len(common.words)

    def __call__(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Leaves of all texts' words, each text ended, and where the texts begin."""
        sizes = np.array([len(w) + 1 for w in texts], np.int64)
        words = chain.from_iterable(chain(w, _ENDED) for w in texts)
        leaves = np.fromiter(map(self.leaf.get, words, repeat(self.other)), np.int64, int(sizes.sum()))
        return leaves, np.cumsum(sizes) - sizes


def _grouped(rows: Iterator[tuple[int | None, str]], most: int = COUNTED) -> Iterator[list[list[bytes]]]:
    """Words of texts, in groups of about `most` tokens."""
    held, size = [], 0
    for _, text in rows:
        held.append(lower_words(text))
        size += len(held[-1]) + 1
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def context_table(docs: DataFrame, common: Common, tree: Tree, layout: Layout, fold: tuple[int, int] = FOLD) -> np.ndarray:
    """Log odds of bit 1 by context row and node, over all training documents but the share that weights are learned on."""
    shared = docs.sparkSession.sparkContext.broadcast((common, tree))  # COMMON words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, t = shared.value
        coder, table = Coder(words), np.zeros(layout.total * NODES * 2, np.int32)
        wanted = ((i, s) for b in batches for i, s in zip(b.column(0).to_pylist(), (x.as_py() for x in b.column(1))) if remainder(i, fold[0]) != fold[1] and remainder(i, SHARE[0]) != SHARE[1])
        for texts in _grouped(wanted):
            seen = prepared(*coder(texts), layout, coder.other, guessed=False)
            spot = (2 * t.nodes.take(seen.leaves, 0) + t.bits.take(seen.leaves, 0).astype(np.int64)).reshape(-1)
            for k in range(CONTEXTS):
                at = np.repeat(seen.rows[k] * (2 * NODES), DEPTH)
                at += spot
                low, high = 2 * NODES * int(seen.rows[k].min()), 2 * NODES * (int(seen.rows[k].max()) + 1)
                at -= low
                table[low:high] += np.bincount(at, minlength=high - low).astype(np.int32)
        table.reshape(-1, NODES, 2)[:, NONE] = 0
        yield from messages(table.reshape(layout.total, 2 * NODES))

    # Each task sends a table, so partitions are put together until each has tokens enough to fill one.
    width = max(2 * docs.sparkSession.sparkContext.defaultParallelism, common.tokens // PER_TABLE)
    counts = summed(id_and_text(docs).coalesce(width).mapInArrow(run, MESSAGES), layout.total, 2 * NODES).reshape(layout.total, NODES, 2)
    return log_odds(counts[:, :, 0], counts[:, :, 1])


def learned(docs: DataFrame, common: Common, model: Mixer, fold: tuple[int, int] = FOLD) -> np.ndarray:
    """The gates' weights: each task learns on its part of the share, and they are averaged by how often a gate was met."""
    shared = docs.sparkSession.sparkContext.broadcast((common, model))  # COMMON words and a bounded table
    d = id_and_text(docs)
    d = d.where((remainder_column(F.col("doc_id"), SHARE[0]) == SHARE[1]) & (remainder_column(F.col("doc_id"), fold[0]) != fold[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, m = shared.value
        coder, bent, met = Coder(words), np.full((GATES, INPUTS), 20.0), np.zeros(GATES)
        mine = Mixer(m.tree, m.layout, m.table)
        for texts in _grouped((None, x.as_py()) for b in batches for x in b.column(1)):
            met += mine.learn(prepared(*coder(texts), m.layout, coder.other), bent)
        gate, k = (x.ravel() for x in np.indices((GATES, INPUTS)))
        yield pa.RecordBatch.from_arrays([pa.array(gate), pa.array(k), pa.array((mine.weights * met[:, None]).ravel()), pa.array(np.repeat(met, INPUTS))], ["gate", "k", "w", "met"])

    sums = d.mapInArrow(run, "gate long, k long, w double, met double").groupBy("gate", "k").agg(F.sum("w").alias("w"), F.sum("met").alias("met"))
    out = START.copy()
    for row in sums.where("met > 0").collect():  # GATES by INPUTS
        out[row["gate"], row["k"]] = row["w"] / row["met"]
    return out


# --- spelling

END = 10  # a byte that no word has
LETTERS = 3
#: Bits of the hashed contexts of the last 1, 2 and 3 bytes.
SPELL_BITS = (8, 12, 14)
SPELL_FIRST = np.cumsum([0] + [1 << b for b in SPELL_BITS[:-1]])
SPELL_ROWS = sum(1 << b for b in SPELL_BITS)


def letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the words, each ended, their rows by context (from the word's own beginning), and where words end."""
    pad = bytes([END]) * LETTERS
    s = np.frombuffer(b"".join([pad + w + b"\n" for w in words]), np.uint8)
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    ends = np.cumsum(sizes)
    own = np.arange(int(ends[-1]) if len(words) else 0) + np.repeat(LETTERS * (np.arange(len(words)) + 1), sizes)
    back = [s[own - k].astype(np.uint32) for k in range(1, LETTERS + 1)]
    two = back[0] | (back[1] << np.uint32(8))
    three = two | (back[2] << np.uint32(16))
    hashed = back[0], (two * np.uint32(0x9E3779B1)) >> np.uint32(20), (three * np.uint32(0x9E3779B1)) >> np.uint32(18)
    return s[own].astype(np.int64), np.stack([h.astype(np.int64) + f for h, f in zip(hashed, SPELL_FIRST)]), ends


@dataclass
class Speller:
    """Bit by bit of each byte, from the highest: the contexts' log odds by row and node of the byte's own tree, weighed by the longest context that was seen."""

    odds: np.ndarray  # (rows, 256): node 1 is the first bit's, node 2 n + bit follows node n
    weights: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> Speller:
        """counts: (rows, 256) of the next byte."""
        odds = np.zeros((len(counts), 256), np.float32)
        for level in range(8):
            by_prefix = counts.reshape(len(counts), 1 << level, 2, -1).sum(axis=3)
            odds[:, 1 << level : 2 << level] = log_odds(by_prefix[:, :, 0], by_prefix[:, :, 1])
        return cls(odds, SPELL_WEIGHTS)

    def bits(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        ahead, rows, ends = letters(words)
        # Few of the letters differ in themselves and their contexts; each kind is worked out once.
        kind = np.unique(((rows[0] << 12 | (rows[1] - SPELL_FIRST[1])) << 14 | (rows[2] - SPELL_FIRST[2])) << 8 | ahead, return_index=True, return_inverse=True)
        cost = self._costs(ahead[kind[1]], rows[:, kind[1]])[kind[2]]
        return np.add.reduceat(cost, ends - np.diff(np.append(0, ends)))

    def _costs(self, ahead: np.ndarray, rows: np.ndarray) -> np.ndarray:
        cost = np.zeros(len(ahead))
        flat = self.odds.reshape(-1)
        for level in range(8):
            node = (ahead | 256) >> (8 - level)
            x = flat[rows * 256 + node]
            longest = np.where(x[2] != 0, 2, np.where(x[1] != 0, 1, 0))
            z = np.clip((self.weights[longest].T * x).sum(axis=0), -12, 12)
            cost += np.log2(1 + np.exp((1 - 2.0 * (ahead >> (7 - level) & 1)) * z))
        return cost


#: Weights of the contexts of 1, 2 and 3 letters, by the longest that was seen.
SPELL_WEIGHTS = np.array([[1.0, 0.0, 0.0], [0.2, 0.85, 0.0], [0.0, 0.3, 0.75]], np.float32)


def speller(words: DataFrame, least_class: int, kinds: int) -> Speller:
    """Counts over the uncommon words, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((SPELL_ROWS, 256), np.int32)
        for batch in batches:
            found = [w.encode("utf-8", "surrogatepass") for w in batch.column(0).to_pylist()]
            for k in range(0, len(found), 1 << 15):
                ahead, rows, _ = letters(found[k : k + (1 << 15)])
                for context in rows:
                    at, n = np.unique(context << 8 | ahead, return_counts=True)
                    table.reshape(-1)[at] += n.astype(np.int32)
        yield from messages(table)

    width = max(2 * words.sparkSession.sparkContext.defaultParallelism, kinds // PER_LETTERS)
    return Speller.of(summed(words.where(size_class() < least_class).select("word").coalesce(width).mapInArrow(run, MESSAGES), SPELL_ROWS, 256))


# --- scores


@dataclass
class Model:
    common: Common
    mixer: Mixer
    speller: Speller


def fit(docs: DataFrame, words: DataFrame, fold: tuple[int, int] = FOLD) -> Model:
    common = common_words(words)
    tree, layout = Tree.of(common), Layout.of(common)
    mixer = Mixer(tree, layout, context_table(docs, common, tree, layout, fold))
    mixer.weights = learned(docs, common, mixer, fold)
    return Model(common, mixer, speller(words, common.least_class, common.kinds))


def scores(docs: DataFrame, model: Model, words: DataFrame, fold: tuple[int, int] = FOLD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every row."""
    spark = docs.sparkSession
    common = model.common
    shared = spark.sparkContext.broadcast(model)  # COMMON words and bounded tables
    schema = "doc_id long, held_out boolean, n_tokens long, known long, logs double, bits double, n_bytes long, rare array<struct<word:string,k:long,spelled:double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        coder = Coder(m.common)
        logs = np.append(np.log10(m.common.counts + 1.0), 0.0)
        unmet = -np.log2(m.common.spelled)
        for batch in batches:
            for k in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(k, TOGETHER)
                texts = [lower_words(t) for t in part.column(1).to_pylist()]
                leaves, starts = coder(texts)
                bits = m.mixer.bits(prepared(leaves, starts, m.mixer.layout, coder.other))
                known = np.add.reduceat((leaves != coder.other).astype(np.int64), starts)
                log_sum = np.add.reduceat(logs[leaves], starts)
                spots = np.flatnonzero(leaves == coder.other)
                owner = np.searchsorted(starts, spots, side="right") - 1
                found = pa.array([texts[i][j] if j < len(texts[i]) else b"" for i, j in zip(owner.tolist(), (spots - starts[owner]).tolist())], pa.binary()).dictionary_encode()
                kinds = found.dictionary.to_pylist()
                cells, times = np.unique(owner * max(len(kinds), 1) + found.indices.to_numpy(), return_counts=True)
                at, which = np.divmod(cells, max(len(kinds), 1))
                spelled = m.speller.bits(kinds)[which]
                bits += np.bincount(at, times * (spelled + unmet), len(texts))
                ends = np.append(0, np.cumsum(np.bincount(at, minlength=len(texts))))
                struct = pa.StructArray.from_arrays([found.dictionary.take(pa.array(which)).cast(pa.string()), pa.array(times, pa.int64()), pa.array(spelled, pa.float64())], ["word", "k", "spelled"])
                sizes = np.diff(np.append(starts, len(leaves)))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([remainder(i, fold[0]) == fold[1] for i in part.column(0).to_pylist()], pa.bool_()), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(log_sum, pa.float64()), pa.array(bits, pa.float64()),
                        pa.array([sum(map(len, w)) + len(w) + 1 for w in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct),
                    ],
                    ["doc_id", "held_out", "n_tokens", "known", "logs", "bits", "n_bytes", "rare"],
                )

    made = cut(id_and_text(docs).mapInArrow(run, schema).withColumn("rid", F.monotonically_increasing_id()))
    rare = made.select("rid", F.explode("rare").alias("r")).select("rid", "r.word", "r.k", "r.spelled")
    uncommon = words.where(size_class() < common.least_class)
    share, spelled = (1 - common.spelled) / max(common.rare, 1), common.spelled
    # A word met in training costs less than the spelling that its row counts so far.
    either = F.lit(share) * F.col("n") + F.lit(spelled) * F.pow(F.lit(2.0), -F.col("spelled"))
    less = F.col("k") * (F.log2(either) + F.col("spelled") - F.lit(float(np.log2(spelled))))
    found = rare.join(uncommon, "word").groupBy("rid").agg(F.sum("k").alias("more"), F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("more_logs"), F.sum(less).alias("less"))
    both = made.drop("rare").join(found, "rid", "left")
    least = float(np.log10(common.tokens + common.kinds + 1))
    bits = F.col("bits") - F.coalesce("less", F.lit(0.0))
    return both.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(common.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(least)).alias("base_score"),
        (bits * F.lit(-float(np.log10(2)))).alias("score"),
        (bits / F.col("n_bytes")).alias("bits_per_byte"),
    )


def language_scores(docs: DataFrame) -> DataFrame:
    words = cut(word_counts(docs))
    return scores(docs, fit(docs, words), words)
