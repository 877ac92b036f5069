"""Byte-level BPE: pre-tokens found by a scan of transition functions, merged by ranks, and decoded again.

The boundaries of the pre-tokens of PATTERN follow from a small automaton over classes of code points. A
class is a function from states to states; functions compose associatively, so a batch of texts is cut
into blocks, every block composes its functions side by side with the others, the blocks' functions
are scanned by doubling, and each position's state is its prefix applied to the state its block begins
in. No regular expression runs over a text. The slices between boundaries are merged by ranks (least
rank first, leftmost of equals) with a bounded memory of slices already merged. Where each slice
begins, in the text and among the ids, is kept, so that any span of the text can be decoded alone.

Defined results: a null or empty text has no ids and decodes to nothing; texts of any length are encoded
whole (a text needs some 40 bytes a code point of memory while it is encoded, other texts share a batch
only up to TOGETHER code points); repeated rows, ties and null ids stay rows of their own; an empty
table gives no rows; further columns, whatever their names, don't matter.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from reelspark.llm.common import id_and_text

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Code points scanned together, texts taken from a batch at once, positions of a block.
TOGETHER, TEXTS, BLOCK = 1_000_000, 512, 256
#: Slices a task remembers, and the longest of them in code points.
REMEMBERED, SHORT = 600_000, 48
#: Slices of so many bytes are merged side by side, so many at once, longer ones by a heap; no rank is as large as NONE.
FEW, SIDE_BY_SIDE, NONE = 48, 4096, 1 << 31
#: Stands between texts; no text that Spark holds has it.
END_MARK = "\ud800"

# Classes of code points: space, other white space, letters (those of contractions apart), numbers, others, apostrophe, end.
SPACE, WHITE, LETTER, ALONE, R_OR_V, E, L, NUMBER, OTHER, QUOTE, END = range(11)
LETTERS = (LETTER, ALONE, R_OR_V, E, L)
# States: at a start, in letters, in numbers, in others, after an apostrophe that begins a slice, after its r or v, after its l,
# after a whole contraction, after one space, after more that end in a space, and both for other white space.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, QUOTED, NEEDS_E, NEEDS_L, CONTRACTED, ONE_SPACE, SPACES, ONE_WHITE, WHITES = range(12)
#: A slice begins here; a slice begins one position earlier.
HERE, EARLIER = 1, 2


def _step(state: int, cls: int) -> tuple[int, int]:
    """Next state and where slices begin."""
    blank = state in (ONE_SPACE, SPACES, ONE_WHITE, WHITES)
    pending = EARLIER if state in (NEEDS_E, NEEDS_L) else 0  # the letter after the apostrophe wasn't a contraction's
    if cls == END:
        return START, HERE | pending
    if cls in (SPACE, WHITE):
        if blank:
            return (SPACES if cls == SPACE else WHITES), 0
        return (ONE_SPACE if cls == SPACE else ONE_WHITE), HERE | pending
    if state == QUOTED and cls in (ALONE, R_OR_V, L):
        return {ALONE: CONTRACTED, R_OR_V: NEEDS_E, L: NEEDS_L}[cls], 0
    if (state, cls) in ((NEEDS_E, E), (NEEDS_L, L)):
        return CONTRACTED, 0
    if pending and cls in LETTERS:
        return IN_LETTERS, EARLIER
    kind = IN_LETTERS if cls in LETTERS else IN_NUMBERS if cls == NUMBER else IN_OTHERS
    if state == kind or (kind == IN_OTHERS and state == QUOTED):
        return kind, 0
    # the last of the white space goes with what follows if it is a space, else it is a slice of its own
    begins = {ONE_SPACE: 0, SPACES: EARLIER, ONE_WHITE: HERE, WHITES: EARLIER | HERE}.get(state, HERE | pending)
    if cls == QUOTE:
        return (QUOTED if begins & HERE else IN_OTHERS), begins
    return kind, begins


@dataclass(frozen=True)
class Automaton:
    """Tables of the automaton and of the functions that its classes generate."""

    functions: np.ndarray  # (functions, states): the state each leads to
    then: np.ndarray  # (functions, classes): the function, and then that of the class
    begins: np.ndarray  # (states, classes): HERE and EARLIER

    @classmethod
    @lru_cache(maxsize=1)
    def built(cls) -> Automaton:
        table = [[_step(s, c) for c in range(END + 1)] for s in range(WHITES + 1)]
        number = {tuple(range(WHITES + 1)): 0}
        order, then = list(number), []
        for f in order:  # grows while new compositions are found
            row = []
            for c in range(END + 1):
                g = tuple(table[s][c][0] for s in f)
                if g not in number:
                    number[g] = len(order)
                    order.append(g)
                row.append(number[g])
            then.append(row)
        return cls(np.array(order, np.uint8), np.array(then, np.uint16), np.array([[b for _, b in row] for row in table], np.uint8))

    def starts(self, classes: np.ndarray, block: int = BLOCK) -> np.ndarray:
        """Where slices begin, in a sequence of classes whose last is END."""
        n = len(classes)
        blocks = -(-n // block)
        sent = np.full(blocks * block, END, np.uint8)
        sent[:n] = classes
        sent = np.ascontiguousarray(sent.reshape(blocks, block).T)
        prefix = np.empty((block, blocks), np.uint16)  # what has been composed before each position of its block
        now = np.zeros(blocks, np.uint16)
        for k in range(block):
            prefix[k] = now
            now = self.then[now, sent[k]]
        whole, d = self.functions[now], 1
        while d < blocks:  # inclusive scan over the blocks
            whole = np.concatenate([whole[:d], np.take_along_axis(whole[d:], whole[:-d], axis=1)])
            d *= 2
        first = np.concatenate([np.full(1, START, np.uint8), whole[:-1, START]])
        begins = self.begins[self.functions[prefix, first], sent].T.reshape(-1)[:n]
        here = (begins & HERE) != 0
        here[:-1] |= (begins[1:] & EARLIER) != 0
        return np.flatnonzero(here)


def _members(pattern: str) -> np.ndarray:
    """Code points that a class of the library's expressions holds, by asking it, so that its version of Unicode counts."""
    coder = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    text = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    return np.frombuffer(coder.decode(coder.encode_ordinary(text)).encode("utf-32-le"), np.uint32)


def code_point_classes() -> np.ndarray:
    """Class of each code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for pattern, cls in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", WHITE)):
        table[_members(pattern)] = cls
    for some, cls in (("stmd", ALONE), ("rv", R_OR_V), ("e", E), ("l", L), ("'", QUOTE), (" ", SPACE), (END_MARK, END)):
        table[[ord(c) for c in some]] = cls
    return table


@dataclass
class ByteBpe:
    """Ranks and classes, with a bounded memory of slices already merged."""

    ranks: dict[bytes, int]
    classes: np.ndarray
    remembered: dict[str, bytes] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str = RANKS) -> ByteBpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}, code_point_classes())

    def __getstate__(self) -> dict:
        self._pairs()
        return self.__dict__ | {"remembered": {}}

    @property
    def tokens(self) -> dict[int, bytes]:
        if "_tokens" not in self.__dict__:
            self.__dict__["_tokens"] = {rank: token for token, rank in self.ranks.items()}
        return self.__dict__["_tokens"]

    def merged(self, slice_: bytes) -> list[int]:
        """Ids of one slice of any length, in n log n steps: the pair of least rank is merged, the leftmost of equals, until none has a rank."""
        if slice_ in self.ranks:
            return [self.ranks[slice_]]
        ranks, n = self.ranks, len(slice_)
        after, before, ends = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(slice_[k : k + 2])) is not None]
        heapify(heap)
        while heap:
            _, a, end = heappop(heap)
            b = after[a] if ends[a] else n
            if b >= n or ends[b] != end:  # one of the two has been merged since
                continue
            ends[a], ends[b], after[a] = end, 0, after[b]
            if after[a] < n:
                before[after[a]] = a
            for x in (before[a], a):
                y = after[x] if x >= 0 else n
                if y < n and (r := ranks.get(slice_[x : ends[y]])) is not None:
                    heappush(heap, (r, x, ends[y]))
        out, k = [], 0
        while k < n:
            out.append(ranks[slice_[k : ends[k]]])
            k = after[k]
        return out

    def _pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys of the pairs of ids that merge, the id that each becomes, and the ids of single bytes."""
        if "_known_pairs" not in self.__dict__:
            rank = self.ranks.get
            found = [(a << 32 | b, r) for token, r in self.ranks.items() for k in range(1, len(token)) if (a := rank(token[:k])) is not None and (b := rank(token[k:])) is not None]
            keys, ids = (np.array(x, np.int64) for x in zip(*sorted(found)))
            self.__dict__["_known_pairs"] = keys, ids, np.array([self.ranks[bytes([b])] for b in range(256)])
        return self.__dict__["_known_pairs"]

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the pairs (a, b), NONE where they don't merge or either is no id (negative)."""
        keys, ids, _ = self._pairs()
        key = np.where((a < 0) | (b < 0), -1, a << 32 | b)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, ids[at], NONE)

    def _side_by_side(self, slices: list[bytes]) -> list[bytes]:
        """Ids (int32) of short slices, each merging one pair a round."""
        width = max(map(len, slices))
        sent = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in slices), np.uint8).reshape(-1, width)
        sizes = np.array(list(map(len, slices)))
        ids = np.where(np.arange(width) < sizes[:, None], self._pairs()[2][sent], -1)
        ids = np.concatenate([ids, np.full((len(ids), 1), -1)], axis=1)
        pairs = np.concatenate([self._rank_of(ids[:, :-1], ids[:, 1:]), np.full((len(ids), 1), NONE)], axis=1)
        column, active = np.arange(width), np.arange(len(ids))
        now, ranks = ids, pairs
        while len(active):
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(at)), at]
            more = least < NONE
            if not more.all():
                ids[active[~more]] = now[~more]
                active, now, ranks, at, least = active[more], now[more], ranks[more], at[more], least[more]
            row = np.arange(len(at))
            later = column > at[:, None]
            now[:, :-1] = np.where(later, now[:, 1:], now[:, :-1])
            ranks[:, :-1] = np.where(later, ranks[:, 1:], ranks[:, :-1])
            now[row, at] = least
            ranks[row, at] = self._rank_of(least, now[row, at + 1])
            before = np.flatnonzero(at)
            ranks[before, at[before] - 1] = self._rank_of(now[before, at[before] - 1], least[before])
        ids = ids.astype(np.int32)
        return [x[:n].tobytes() for x, n in zip(ids, (ids >= 0).sum(axis=1).tolist())]

    def _learn(self, new: list[str]) -> None:
        """Remembers the ids of slices; those of like length go side by side."""
        raw = sorted(((s.encode(), s) for s in new), key=lambda x: len(x[0]))
        few = sum(len(b) <= FEW for b, _ in raw)
        for k in range(0, few, SIDE_BY_SIDE):
            part = raw[k : min(k + SIDE_BY_SIDE, few)]
            self.remembered.update(zip((s for _, s in part), self._side_by_side([b for b, _ in part])))
        for b, s in raw[few:]:
            self.remembered[s] = array("i", self.merged(b)).tobytes()

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
        """Of each text its ids, the code point at which each slice begins, and the ids (int32) of each slice."""
        if len(self.remembered) > REMEMBERED:
            self.remembered.clear()
        joined = END_MARK.join([*texts, ""])
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(points):
            return
        classes = self.classes[points]
        starts = Automaton.built().starts(classes)
        cut = starts.tolist()
        of_end = np.flatnonzero(classes[starts] == END).tolist()
        slices = [joined[a:b] for a, b in zip(cut, cut[1:])]
        self._learn(list(set(slices).difference(self.remembered, (END_MARK,))))
        low = 0
        for high in of_end:
            ids = list(map(self.remembered.__getitem__, slices[low:high]))
            own = starts[low:high]
            yield np.frombuffer(b"".join(ids), np.int32), (own - own[0] if len(own) else own).astype(np.int32), ids
            low = high + 1
        for k in np.flatnonzero(np.diff(starts) > SHORT).tolist():
            self.remembered.pop(slices[k], None)

    def encode(self, text: str | None) -> list[int]:
        return next(self.encode_batch([text or ""]))[0].tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decode_span(self, ids, starts, firsts, low: int, high: int) -> str:
        """The text's code points from low to high, from the ids of the slices that touch them alone."""
        if low >= high or not len(starts):
            return ""
        a, b = int(np.searchsorted(starts, low, "right")) - 1, int(np.searchsorted(starts, high, "left"))
        end = firsts[b] if b < len(firsts) else len(ids)
        return self.decode(ids[firsts[a] : end]).decode()[low - starts[a] : high - starts[a]]


def texts_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """ids and texts of at most TEXTS rows and about TOGETHER code points."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            part = batch.slice(at, TEXTS)
            texts = part.column(1).to_pylist()
            low, size = 0, 0
            for k, t in enumerate(texts):
                if size and size + len(t) > TOGETHER:
                    yield part.column(0).slice(low, k - low), texts[low:k]
                    low, size = k, 0
                size += len(t) + 1
            yield part.column(0).slice(low), texts[low:]


def firsts_of(ids: list[bytes]) -> np.ndarray:
    """Place of each slice's first id among a text's ids."""
    return (np.cumsum([0, *map(len, ids)])[:-1] // 4).astype(np.int32)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.int32)
    return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(flat, pa.int32())).cast(pa.list_(pa.int32()))


def encoded(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """doc_id, n_tokens, ids, starts (the code point at which each pre-token begins) and firsts (its first id's place) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(ByteBpe.load(path))  # a vocabulary file's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        for doc_ids, texts in texts_of(batches):
            got = list(coder.encode_batch(texts))
            firsts = [firsts_of(x[2]) for x in got]
            cols = [doc_ids, pa.array([len(x[0]) for x in got], pa.int64()), _lists([x[0] for x in got]), _lists([x[1] for x in got]), _lists(firsts)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids", "starts", "firsts"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, starts array<int>, firsts array<int>")


def decoded(rows: DataFrame, path: str = RANKS) -> DataFrame:
    """doc_id and text (bytes that aren't UTF-8 replaced) of rows with doc_id and ids; null ids are none."""
    shared = rows.sparkSession.sparkContext.broadcast(ByteBpe.load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS):
                part = batch.slice(k, TEXTS)
                texts = [coder.decode(x or ()).decode("utf-8", "replace") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(rows["doc_id"].cast("long").alias("doc_id"), rows["ids"]).mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 of the decimal ids and decoded_sha256 of the bytes that the ids decode to."""
    shared = docs.sparkSession.sparkContext.broadcast(ByteBpe.load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        decimal = {rank: b"%d" % rank for rank in coder.tokens}
        for doc_ids, texts in texts_of(batches):
            n, of_ids, of_bytes = [], [], []
            for ids, _, _ in coder.encode_batch(texts):
                listed = ids.tolist()
                n.append(len(listed))
                of_ids.append(hashlib.sha256(b" ".join(map(decimal.__getitem__, listed))).hexdigest())
                of_bytes.append(hashlib.sha256(coder.decode(listed)).hexdigest())
            cols = [doc_ids, pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
