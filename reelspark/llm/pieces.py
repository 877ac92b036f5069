"""SentencePiece encoding and decoding by a unigram lattice over a vocabulary of pieces.

Spaces become whitespace markers (with one before the text), and the best path through all pieces
that match, by the sum of their log scores, is found by Viterbi over a double-array trie of the
pieces' bytes. A character without a piece of its own falls back to its bytes. Decoding joins
pieces and bytes and turns markers back to spaces, so every text comes back exactly; a marker
character in a text is kept apart from a space by its bytes.

No piece has a marker or a line break behind another character, so the best path of a text is that
of its words one after another; words are encoded once for a task and remembered, within a bound.

Defined results: a null or empty text has no ids; repeated rows and rows without id stay; an empty table
gives none; further columns, whatever their names, don't matter. A very long text is cut into words, and
a single very long word costs time and memory in proportion to its bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from reelspark.llm.common import id_and_text

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: A character without a piece scores so much less than the least piece.
UNKNOWN_PENALTY = 10.0
#: Words that a task remembers, and the length up to which words are searched side by side.
REMEMBERED = 400_000
SIDE_BY_SIDE = 96


@dataclass
class Vocabulary:
    """pieces: UTF-8 bytes by id (None for control pieces); byte_ids: the ids of the 256 bytes."""

    pieces: list[bytes | None]
    scores: np.ndarray
    byte_ids: np.ndarray


def read_vocabulary(path: str = MODEL, scores: str = "rank") -> Vocabulary:
    """The pieces of a SentencePiece model file.

    scores "rank": the log of a Zipf law over the pieces' ranks, for a model whose own scores are
    merge ranks; "file": the file's own scores.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces: list[bytes | None] = [None] * n
    byte_ids, plain = np.full(256, -1, np.int64), []
    for k in range(n):
        if model.is_byte(k):
            byte_ids[int(model.id_to_piece(k)[3:-1], 16)] = k
        elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
            pieces[k] = model.id_to_piece(k).encode()
            plain.append(k)
    if (byte_ids < 0).any():
        raise ValueError("the vocabulary has no byte fallback")
    out = np.full(n, -np.inf)
    if scores == "file":
        out[plain] = [model.get_score(k) for k in plain]
    else:
        ranks = np.arange(1, len(plain) + 1, dtype=float)
        out[plain] = -np.log(ranks) - np.log((1 / ranks).sum())
    return Vocabulary(pieces, out, byte_ids)


@dataclass
class DoubleArray:
    """A trie in two arrays: the child of state s by byte c is t = base[s] + c if check[t] == s; value[t] is a piece's id or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @classmethod
    def build(cls, keys: dict[bytes, int]) -> DoubleArray:
        tree: list[dict[int, int]] = [{}]
        ids = [-1]
        for key, k in keys.items():
            at = 0
            for c in key:
                if c not in tree[at]:
                    tree[at][c] = len(tree)
                    tree.append({})
                    ids.append(-1)
                at = tree[at][c]
            ids[at] = k
        size = 2 * len(tree) + 1024
        base, check, value = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        used = bytearray(size)
        used[0] = 1
        place, free, roomy = {0: 0}, 512, 512  # so that every base is positive
        check[0] = -2
        for node, kids in enumerate(tree):  # parents come before their children
            at = place[node]
            value[at] = ids[node]
            if not kids:
                base[at] = size  # beyond the end: no child
                continue
            codes = sorted(kids)
            while used[free]:
                free += 1
            b = begun = (free if len(codes) == 1 else roomy) - codes[0]
            while True:
                if b + 512 > len(used):
                    used.extend(bytes(len(used)))
                if not any(used[b + c] for c in codes):
                    break
                b += 1
            if b - begun > 100:  # the region before is nearly full; only single children still go there
                roomy = b
            if len(used) > len(check):
                grown = len(used) - len(check)
                base, check, value = (np.concatenate([x, np.full(grown, f, np.int64)]) for x, f in ((base, 0), (check, -1), (value, -1)))
            base[at] = b
            for c in codes:
                used[b + c] = 1
                check[b + c] = at
                place[kids[c]] = b + c
        ends = len(check)
        base[(check != -1) & (base == size)] = ends
        pad = np.zeros(256, np.int64)
        return cls(np.concatenate([base, pad]), np.concatenate([check, pad - 1]), np.concatenate([value, pad - 1]))


@dataclass
class UnigramTokenizer:
    """Pickles without its memory of words."""

    vocabulary: Vocabulary
    trie: DoubleArray
    least: float
    deepest: int
    remembered: tuple[dict[str, bytes], dict[str, bytes]] = field(default_factory=lambda: ({}, {}))

    @classmethod
    def load(cls, path: str = MODEL, scores: str = "rank") -> UnigramTokenizer:
        return cls.of(read_vocabulary(path, scores))

    @classmethod
    def of(cls, v: Vocabulary) -> UnigramTokenizer:
        keys = {p: k for k, p in enumerate(v.pieces) if p is not None}
        mark = MARK.encode()
        if any(b"\n" in p or mark in _unmarked(p, mark) for p in keys):
            raise ValueError("a piece has a marker or a line break behind another character")
        return cls(v, DoubleArray.build(keys), float(v.scores[np.isfinite(v.scores)].min()) - UNKNOWN_PENALTY, max(map(len, keys)))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"remembered": ({}, {})}

    def _unit(self, word: str, marks: int) -> bytes:
        """Bytes of a word in the lattice: its leading spaces as markers, a marker character of the text as byte 0xFF."""
        mark = MARK.encode()
        return mark * marks + word.encode("utf-8", "surrogatepass").replace(mark, b"\xff").replace(b" ", mark)

    def best_path(self, unit: bytes) -> list[int]:
        """Viterbi over one unit, byte by byte."""
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.vocabulary.scores
        n = len(unit)
        best, back = [-np.inf] * (n + 1), [(-1, -1)] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            if best[i] == -np.inf:
                continue
            step = _char_bytes(unit[i])
            state, single = 0, False
            for j in range(i, min(n, i + self.deepest)):
                to = base[state] + unit[j]
                if check[to] != state:
                    break
                state = to
                k = value[state]
                if k >= 0:
                    single = single or j + 1 == i + step
                    if best[i] + scores[k] > best[j + 1]:
                        best[j + 1], back[j + 1] = best[i] + scores[k], (i, k)
            end = min(n, i + step)
            if not single and best[i] + self.least > best[end]:
                best[end], back[end] = best[i] + self.least, (i, -1)
        return self._spelled(unit, n, lambda at: back[at])

    def _spelled(self, unit: bytes, at: int, back) -> list[int]:
        out: list[int] = []
        while at > 0:
            begun, k = back(at)
            if k >= 0:
                out.append(int(k))
            else:
                raw = unit[begun:at] if unit[begun] != 255 else MARK.encode()
                out += [int(self.vocabulary.byte_ids[c]) for c in reversed(raw)]
            at = begun
        return out[::-1]

    def best_paths(self, units: list[bytes]) -> list[list[int]]:
        """As best_path, for many short units side by side."""
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.vocabulary.scores
        sizes = np.array([len(u) for u in units])
        width = int(sizes.max())
        text = np.zeros((len(units), width), np.int64)
        flat = np.frombuffer(b"".join(units), np.uint8)
        text[np.repeat(np.arange(len(units)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        steps = _STEPS[text]
        best = np.full((len(units), width + 1), -np.inf)
        best[:, 0] = 0.0
        begun, kind = np.zeros((len(units), width + 1), np.int64), np.full((len(units), width + 1), -1, np.int64)
        for i in range(width):
            rows = np.flatnonzero((sizes > i) & (best[:, i] > -np.inf))
            here, single = best[:, i], np.zeros(len(units), bool)
            live, state = rows, np.zeros(len(rows), np.int64)
            for j in range(i, min(width, i + self.deepest)):
                inside = sizes[live] > j
                live, state = live[inside], state[inside]
                to = base[state] + text[live, j]
                inside = check[to] == state
                live, state = live[inside], to[inside]
                if not len(live):
                    break
                k = value[state]
                hit = k >= 0
                if hit.any():
                    r, ks = live[hit], k[hit]
                    single[r[steps[r, i] == j + 1 - i]] = True
                    total = here[r] + scores[ks]
                    better = total > best[r, j + 1]
                    r = r[better]
                    best[r, j + 1], begun[r, j + 1], kind[r, j + 1] = total[better], i, ks[better]
            r = rows[~single[rows]]
            if len(r):
                end = np.minimum(sizes[r], i + steps[r, i])
                total = here[r] + self.least
                better = total > best[r, end]
                r, end = r[better], end[better]
                best[r, end], begun[r, end], kind[r, end] = total[better], i, -1
        return [self._spelled(u, len(u), lambda at, b=b, k=k: (b[at], k[at])) for u, b, k in zip(units, begun.tolist(), kind.tolist())]

    def _learn(self, words: set[str], marks: int) -> None:
        memory = self.remembered[marks]
        todo = sorted(words, key=len)
        units = [self._unit(w, marks) for w in todo]
        short = [k for k, u in enumerate(units) if 0 < len(u) <= SIDE_BY_SIDE]
        short.sort(key=lambda k: len(units[k]))
        for k in range(0, len(short), 4096):
            part = short[k : k + 4096]
            for at, ids in zip(part, self.best_paths([units[i] for i in part])):
                memory[todo[at]] = np.array(ids, np.int32).tobytes()
        for w, u in zip(todo, units):
            if w not in memory:
                memory[w] = np.array(self.best_path(u), np.int32).tobytes()

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids (int32) of each text."""
        for memory in self.remembered:
            if len(memory) > REMEMBERED:
                memory.clear()
        out: list[np.ndarray] = []
        marked, bare = self.remembered[1], self.remembered[0]
        cuts = [_cut(t) if t else [] for t in texts]
        new: tuple[set[str], set[str]] = (set(), set())
        for lines in cuts:
            for first, words in lines:
                if first is not None and first not in bare:
                    new[0].add(first)
                new[1].update(w for w in words if w not in marked)
        for marks, words in enumerate(new):
            if words:
                self._learn(words, marks)
        newline = np.array([self.vocabulary.byte_ids[10]], np.int32).tobytes()
        for t, lines in zip(texts, cuts):
            made: list[bytes] = []
            for k, (first, words) in enumerate(lines):
                if k:
                    made.append(newline)
                if first:
                    made.append(bare[first])
                made += map(marked.__getitem__, words)
            out.append(np.frombuffer(b"".join(made), np.int32) if t else np.empty(0, np.int32))
        return out

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode(self, ids) -> str:
        """The text of the ids: whitespace markers become spaces and the first of them goes."""
        raw = b"".join(map(self._table().__getitem__, ids))
        return raw.removeprefix(b" ").decode("utf-8", "surrogatepass")

    def _table(self) -> list[bytes]:
        if "_plain" not in self.__dict__:
            mark = MARK.encode()
            table = [b"" if p is None else p.replace(mark, b" ") for p in self.vocabulary.pieces]
            for c, k in enumerate(self.vocabulary.byte_ids):
                table[k] = bytes([c])
            self.__dict__["_plain"] = table
        return self.__dict__["_plain"]


def _unmarked(piece: bytes, mark: bytes) -> bytes:
    while piece.startswith(mark):
        piece = piece[len(mark) :]
    return piece


def _char_bytes(first: int) -> int:
    return 1 if first < 0xC0 or first == 255 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


_STEPS = np.array([_char_bytes(c) for c in range(256)])
_RUNS = re.compile(" +[^ ]*|[^ ]+")


def _cut(text: str) -> list[tuple[str | None, list[str]]]:
    """By line: the start that no space precedes, and the words after one. Of several spaces all but
    the first stay at the head of the word, as markers (see _word)."""
    out: list[tuple[str | None, list[str]]] = []
    for k, line in enumerate((" " + text).split("\n")):
        if "  " in line:
            runs = _RUNS.findall(line)
            first = runs.pop(0) if runs and runs[0][0] != " " else None
            out.append((first, [r[1:] for r in runs]))
        else:
            first, *words = line.split(" ")
            out.append((first or None, words))
    return out


def tokens(docs: DataFrame, path: str = MODEL, scores: str = "rank") -> DataFrame:
    """doc_id, n_tokens, n_byte_tokens, round_trip (decoding gives the text) and ids of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(UnigramTokenizer.load(path, scores))  # a vocabulary file's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = shared.value
        byte_like = np.zeros(len(tok.vocabulary.pieces), bool)
        byte_like[tok.vocabulary.byte_ids] = True
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                texts = part.column(1).to_pylist()
                ids = tok.encode_batch(texts)
                ends = np.cumsum([0] + [len(x) for x in ids])
                flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
                same = [tok.decode(x.tolist()) == (t or "") for x, t in zip(ids, texts)]
                sizes = np.diff(ends)
                fell = [int(byte_like[x].sum()) for x in ids]
                lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(flat, pa.int32())).cast(pa.list_(pa.int32()))
                cols = [part.column(0), pa.array(sizes, pa.int64()), pa.array(fell, pa.int64()), pa.array(same, pa.bool_()), lists]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "n_byte_tokens", "round_trip", "ids"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, n_byte_tokens long, round_trip boolean, ids array<int>")
