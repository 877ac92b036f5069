"""Homomorphic multiset fingerprints of documents.

A text is the multiset of its paragraphs (lines, cut after sentence ends). Each is hashed to a wide
vector, and a fingerprint is the sum of these: 128 lanes of +1 or -1 modulo 2**32 and four uniform
lanes modulo 2**64. The order of paragraphs doesn't matter; inserting or deleting some adds or
subtracts their vectors. The uniform lanes decide equality; the cosine of the signed lanes
estimates what share of the paragraphs two texts have in common (standard error about 0.09). A
signed lane would wrap at 2**31 paragraphs, more than the bytes of any text that a row can hold.

Defined results: a null text is empty; an empty text has no paragraphs and the zero fingerprint;
two empty texts have likeness 1, an empty and another one 0. Documents are in ascending order of
doc_id (null first), those with equal ids in the order of their texts' hashes; the first follows the
last. Repeated rows stay, each followed by the next; an empty table gives none; further columns,
whatever their names, don't matter. A text's paragraphs are hashed in chunks; a task holds the texts
of TOGETHER rows at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import id_and_text

LANES = 128
WIDE = 4
CHUNK = 1 << 15
#: Rows whose texts a task holds as Python strings.
TOGETHER = 256
_SENTENCE = re.compile(r"[^.!?]*[.!?]+|[^.!?]+")
#: Rows of a range, each of which is a task of its own beyond the session's partitions. The bounds of at
#: most MAX_BUCKETS ranges (131 million rows) reach the driver; of a larger table the ranges grow instead.
ROWS_PER_BUCKET = 2000
MAX_BUCKETS = 1 << 16


def paragraphs(text: str) -> list[bytes]:
    if not text:
        return []
    out: list[str] = []
    for line in text.split("\n"):
        out += _SENTENCE.findall(line) or [""]
    return [x.encode("utf-8", "surrogatepass") for x in out]


class MultisetHash:
    """A sum of paragraph vectors; insert and delete are inverse, and + joins two multisets."""

    __slots__ = ("signed", "wide")

    def __init__(self) -> None:
        self.signed = np.zeros(LANES, np.uint32)
        self.wide = np.zeros(WIDE, np.uint64)

    @classmethod
    def of(cls, text: str | None) -> MultisetHash:
        return cls().insert(paragraphs(text or ""))

    def _sums(self, items: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        items = list(items)
        size = LANES // 8 + 8 * WIDE
        for k in range(0, len(items), CHUNK):
            part = items[k : k + CHUNK]
            digests = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=size).digest() for x in part), np.uint8).reshape(-1, size)
            bits = np.unpackbits(digests[:, : LANES // 8], axis=1).sum(axis=0, dtype=np.int64)
            wide = np.ascontiguousarray(digests[:, LANES // 8 :]).view("<u8").sum(axis=0, dtype=np.uint64)
            yield (2 * bits - len(part)).astype(np.uint32), wide

    def insert(self, items: Iterable[bytes]) -> MultisetHash:
        for signed, wide in self._sums(items):
            self.signed += signed
            self.wide += wide
        return self

    def delete(self, items: Iterable[bytes]) -> MultisetHash:
        for signed, wide in self._sums(items):
            self.signed -= signed
            self.wide -= wide
        return self

    def __add__(self, other: MultisetHash) -> MultisetHash:
        out = MultisetHash()
        out.signed, out.wide = self.signed + other.signed, self.wide + other.wide
        return out

    def __eq__(self, other: object) -> bool:
        return isinstance(other, MultisetHash) and bool((self.signed == other.signed).all() and (self.wide == other.wide).all())

    __hash__ = None  # type: ignore[assignment]

    def hex(self) -> str:
        return (self.signed.astype("<u4").tobytes() + self.wide.astype("<u8").tobytes()).hex()

    @classmethod
    def from_hex(cls, text: str) -> MultisetHash:
        raw, out = bytes.fromhex(text), cls()
        out.signed, out.wide = np.frombuffer(raw[: 4 * LANES], "<u4").copy(), np.frombuffer(raw[4 * LANES :], "<u8").copy()
        return out

    def likeness(self, other: MultisetHash) -> float:
        if self == other:
            return 1.0
        a, b = self.signed.view(np.int32).astype(np.float64), other.signed.view(np.int32).astype(np.float64)
        norm = float(np.sqrt((a @ a) * (b @ b)))
        return float(min(1.0, max(0.0, (a @ b) / norm))) if norm else 0.0


def edited(text: str, following: str) -> str:
    """text with its last floor(n / 2) code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([MultisetHash.of(t.as_py()).hex() for t in batch.column(1)], pa.string())], ["doc_id", "fingerprint"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, fingerprint string")


class Ranges:
    """Ranges of (key, hash): cut at the bounds of keys; a key that bounds repeat is cut by hash as well."""

    def __init__(self, bounds: list[int]) -> None:
        self.bounds, times = np.unique(np.array(bounds, np.int64), return_counts=True)
        self.times = np.concatenate([times, [1]])  # ranges that begin at or below each bound
        self.first = np.cumsum(self.times) - self.times

    def repeated(self, keys: np.ndarray) -> np.ndarray:
        """Which keys have more rows than a range."""
        return np.isin(keys, self.bounds[self.times[:-1] > 1])

    def of(self, keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.bounds, keys, side="left")
        # The last range below a bound's key holds smaller keys too; the key itself spreads over all of them.
        hot = np.zeros(len(keys), bool)
        inside = at < len(self.bounds)
        hot[inside] = (self.bounds[at[inside]] == keys[inside]) & (self.times[at[inside]] > 1)
        part = np.zeros(len(keys), np.int64)
        share = ((hashes >> np.int64(32)) + (1 << 31)) * (self.times[at] - 1) >> np.int64(32)
        part[hot] = 1 + share[hot]
        return self.first[at] + part


def beside_next(docs: DataFrame) -> DataFrame:
    """Rows (bucket, last, key, th, doc_id, text) in which each row is followed by the next document; a row
    that is marked 2 is followed by a copy of itself, which isn't there.

    Ids are cut into ranges by approximate quantiles, and an id with more rows than a range by the hash
    of the text as well; each range is gathered and sorted on its own, and the first document of a range
    is also sent, marked last, to the range before it (that of the first range to the last one), once by each
    task that has it. Rows alike in id and text, of which there are more than a range, are each other's next: each
    task sends one of them to its range, and the others, marked 2, are dealt to as many tasks as there are ranges. So
    texts are shuffled once and no task sees more than its ranges, whose number grows with the rows.
    """
    d = id_and_text(docs).withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("th", F.xxhash64("text"))
    n = docs.count()
    cuts = max(1, min(MAX_BUCKETS, -(-n // ROWS_PER_BUCKET)))
    found: list[int] = []
    if cuts > 1:
        found = d.select(F.percentile_approx("key", [k / cuts for k in range(1, cuts)], 10 * cuts).alias("q")).first()["q"]
    ranges = Ranges(found)
    alike: set[tuple[int, int]] = set()
    if (ranges.times > 1).any():  # an id with more rows than a range
        several = d.where(F.pandas_udf(lambda keys: pd.Series(ranges.repeated(keys.to_numpy())), "boolean")("key")).groupBy("key", "th").agg(F.count("*").alias("n"))
        alike = {(r["key"], r["th"]) for r in several.where(F.col("n") > max(ROWS_PER_BUCKET, n // MAX_BUCKETS)).collect()}  # MAX_BUCKETS at most
    bucket = F.pandas_udf(lambda keys, hashes: pd.Series(ranges.of(keys.to_numpy(), hashes.to_numpy())), "long")
    lowest = d.select("key", "th").withColumn("bucket", bucket("key", "th")).groupBy("bucket").agg(F.min(F.struct("key", "th")).alias("m"))
    firsts = sorted((r["bucket"], tuple(r["m"])) for r in lowest.collect())  # a row for each range
    before = {first: firsts[k - 1][0] for k, (_, first) in enumerate(firsts)}
    beyond = int(ranges.times.sum())

    @F.pandas_udf("array<long>")
    def places(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        """Four times the bucket and the mark, of each row."""
        here: set[tuple[int, int]] = set()
        turn = TaskContext.get().partitionId()
        for keys, hashes in parts:
            out = []
            for b, k in zip(ranges.of(keys.to_numpy(), hashes.to_numpy()).tolist(), zip(keys.tolist(), hashes.tolist())):
                if k in here and k in alike:
                    turn += 1
                    out.append([4 * (beyond + turn % cuts) + 2])
                    continue
                out.append([4 * b, 4 * before[k] + 1] if k in before and k not in here else [4 * b])
                if k in before or k in alike:
                    here.add(k)
            yield pd.Series(out)

    placed = d.withColumn("place", F.explode(places("key", "th")))
    placed = placed.select(F.shiftright("place", 2).alias("bucket"), (F.col("place") % 4).alias("last"), "key", "th", "doc_id", "text")
    width = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(firsts))
    return placed.repartition(width, "bucket").sortWithinPartitions("bucket", "last", "key", "th", "text")


def edit_likeness(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        held, twin = None, ("", None)
        for batch in (part.slice(k, TOGETHER) for part in batches for k in range(0, part.num_rows, TOGETHER)):
            rows = []
            for bucket, last, doc_id, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 4, 5))):
                if held and held[0] != bucket:
                    held = None
                if last == 2:
                    if twin[1] is None or twin[0] != text:
                        own, changed = MultisetHash.of(text), edited(text, text)
                        new = MultisetHash.of(changed)
                        twin = text, (len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own.hex(), new.hex(), own.likeness(new), own.likeness(own))
                    rows.append((doc_id, *twin[1]))
                    continue
                if last and not held:
                    continue
                own = MultisetHash.of(text)
                if held:
                    _, old_id, old_text, old = held
                    changed = edited(old_text, text)
                    new = MultisetHash.of(changed)
                    rows.append((old_id, len(old_text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), old.hex(), new.hex(), old.likeness(new), old.likeness(own)))
                held = None if last else (bucket, doc_id, text, own)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * len(names), kinds)], names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return beside_next(docs).mapInArrow(run, schema)
