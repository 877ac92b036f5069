"""Mixing sources to target weights, by blocks of packed words.

The words of each source, in a fixed pseudorandom order of its documents, form one stream that is
packed into blocks of a fixed length. A source's target gives how many block slots it gets. Output
shards of a fixed number of slots draw their counts by source: multinomial draws conditioned on the
totals, found for any shard by halving the range of shards, so that shards agree without a plan of
them all on the driver. A source's slots are numbered through all shards; slot j takes the block
that a keyed permutation of the source's blocks gives for j, with a new key on each pass. A source
never gets over twice its blocks, so no block is taken more than twice. Slots and blocks then join
by source and block number, which are spread evenly whatever a source's size.

Defined results: null texts have size 0; null is a source of its own, the last; documents of size 0
are taken 0 times; repeated rows are documents of their own, and so are rows without id; an empty
table gives none; further columns, whatever their names, stay. The order of the stream depends on ids
and texts alone, so reruns agree. A very long text is as many blocks as it fills, which lie on
different tasks; only the list of its taken blocks is held with it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelspark.llm.common import cut, word_array, word_count

BLOCK = 64
SLOTS_PER_SHARD = 1 << 16
SHARE = 1.5
MOST = 2
WEIGHTS = (5, 2, 1)
SEED = 20_260
#: The sources' sizes are planned on the driver; more sources than this are refused.
MAX_SOURCES = 100_000
#: Least number of parts of a source's stream, whose sizes are summed apart before the stream is
#: numbered; there are more where a source has more than PER_PART rows for each.
PARTS, PER_PART = 1024, 4096


@dataclass(frozen=True)
class Plan:
    """By source, in order: key ('' is the null source), words, target, blocks and slots."""

    keys: list[str]
    sizes: np.ndarray
    targets: np.ndarray
    blocks: np.ndarray
    slots: np.ndarray
    parts: int = PARTS

    @property
    def total(self) -> int:
        return int(self.slots.sum())

    @property
    def shards(self) -> int:
        return -(-self.total // SLOTS_PER_SHARD)


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """share times all sizes, dealt by weight; none above most times its size, the excess dealt again."""
    out, left, free = [0.0] * len(sizes), share * sum(sizes), set(range(len(sizes)))
    while free:
        unit = left / sum(weights[i] for i in free)
        full = {i for i in free if unit * weights[i] > most * sizes[i]}
        if not full:
            for i in free:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in sorted(full))
        free -= full
    return out


def plan(sizes: dict[str, int], most_rows: int = 0) -> Plan:
    """sizes by source key; keys are '=' and the source, or '' for null; most_rows: rows of the source with the most."""
    keys = sorted((k for k in sizes if k), key=lambda k: [ord(c) for c in k]) + [k for k in sizes if not k]
    n = [int(sizes[k]) for k in keys]
    wanted = targets(n, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(keys))])
    size = np.array(n, np.int64)
    blocks = -(-size // BLOCK)
    slots = np.array([min(MOST * int(b), round(t * int(b) / s)) if s else 0 for t, b, s in zip(wanted, blocks, n)], np.int64)
    return Plan(keys, size, np.array(wanted), blocks, slots, max(PARTS, 1 << (most_rows // PER_PART).bit_length()))


def _log_binomial(k: int, n: int, p: float) -> float:
    """log of the binomial probability, exact for any size: by the deviance from the mean instead of large log factorials."""

    def rest(m: int) -> float:  # log m! less Stirling's formula
        return math.lgamma(m + 1) - (m + 0.5) * math.log(m) + m - 0.5 * math.log(2 * math.pi) if m < 16 else 1 / (12 * m) - 1 / (360 * m**3) + 1 / (1260 * m**5)

    def deviance(x: int, mean: float) -> float:  # x log(x / mean) + mean - x
        d = (x - mean) / (x + mean)
        if abs(d) >= 0.1:
            return x * math.log(x / mean) + mean - x
        total, term, j = (x - mean) * d, 2 * x * d, 1
        while True:
            term *= d * d
            after = total + term / (2 * j + 1)
            if after == total:
                return after
            total, j = after, j + 1

    if k < 0 or k > n or (p == 0 and k) or (p == 1 and k < n):
        return -math.inf
    if p in (0, 1):
        return 0.0
    if k == 0:
        return n * math.log1p(-p)
    if k == n:
        return n * math.log(p)
    return rest(n) - rest(k) - rest(n - k) - deviance(k, n * p) - deviance(n - k, n * (1 - p)) + 0.5 * math.log(n / (2 * math.pi * k * (n - k)))


def hypergeometric(good: int, bad: int, take: int, rng: np.random.Generator) -> int:
    """How many of `take` drawn are good, for populations of any size: the rejection method for
    log-concave laws, from the mode, with a flat middle and exponential tails."""
    low, high = max(0, take - bad), min(good, take)
    if low == high:
        return low
    p = take / (good + bad)
    log = lambda k: _log_binomial(k, good, p) + _log_binomial(take - k, bad, p)
    mode = min(high, max(low, (take + 1) * (good + 1) // (good + bad + 2)))
    at_mode = log(mode)
    top = math.exp(at_mode - _log_binomial(take, good + bad, p))
    w = 1 + top / 2
    while True:
        u, v, s = rng.random(), rng.random(), rng.random()
        y = rng.random() * w / top if u <= w / (1 + w) else (w + rng.standard_exponential()) / top
        x = mode + (1 if s < 0.5 else -1) * round(y)
        if low <= x <= high and math.log(v or 1e-300) + min(0.0, w - top * y) <= log(x) - at_mode:
            return x


#: numpy draws from populations below this; beyond it the same law is drawn source by source.
NUMPY_MOST = 900_000_000


def _draw(counts: np.ndarray, take: int, rng: np.random.Generator, most: int = NUMPY_MOST) -> np.ndarray:
    """Multinomial counts of `take` slots, conditioned on the counts that there are."""
    left = int(counts.sum())
    if left < most:
        return rng.multivariate_hypergeometric(counts, take, method="marginals")
    out = np.zeros_like(counts)
    for i, n in enumerate(counts.tolist()):
        left -= n
        out[i] = hypergeometric(n, left, take, rng)
        take -= int(out[i])
    return out


def shard_counts(shard: int, p: Plan, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The first slot number and the number of slots of each source in a shard."""
    low, high, counts, first = 0, p.shards, p.slots.copy(), np.zeros(len(p.slots), np.int64)
    while high - low > 1:
        mid = (low + high) // 2
        left = _draw(counts, (mid - low) * SLOTS_PER_SHARD, np.random.default_rng([seed, low, high]))
        if shard < mid:
            counts, high = left, mid
        else:
            first, counts, low = first + left, counts - left, mid
    return first, counts


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    x = (x ^ np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permuted(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at x: four Feistel rounds, walked on until inside."""
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    out, todo = x.astype(np.uint64), np.arange(len(x))
    while len(todo):
        a, b = out[todo] >> half, out[todo] & mask
        for r in range(4):
            a, b = b, a ^ (_mixed(b, key * 4 + r + 1) & mask)
        out[todo] = (a << half) | b
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def slots(spark: SparkSession, p: Plan, seed: int = SEED) -> DataFrame:
    """The mix: shard, slot (its place in the shard), source_at, pass, block of every slot."""
    schema = "shard long, slot long, source_at int, pass int, block long"
    if not p.total:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                first, counts = shard_counts(shard, p, seed)
                source = np.repeat(np.arange(len(counts)), counts)
                block, turn, begun = np.empty(len(source), np.int64), np.empty(len(source), np.int64), 0
                for i in np.flatnonzero(counts):  # a source's slots lie side by side, and so do those of a pass
                    number = np.arange(first[i], first[i] + counts[i])
                    passes = number // p.blocks[i]
                    for t in range(int(passes[0]), int(passes[-1]) + 1):
                        some = number[np.searchsorted(passes, t) : np.searchsorted(passes, t, "right")]
                        end = begun + len(some)
                        turn[begun:end] = t
                        block[begun:end] = permuted(some % p.blocks[i], int(p.blocks[i]), (seed * 1_000_003 + int(i)) * 7 + t)
                        begun = end
                place = np.random.default_rng([seed, 1, shard]).permutation(len(source))
                cols = [np.full(len(source), shard), place, source.astype(np.int32), turn.astype(np.int32), block]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["shard", "slot", "source_at", "pass", "block"])

    width = max(1, min(p.shards, spark.sparkContext.defaultParallelism * 4 if p.shards < 1 << 12 else p.shards // 16))
    return spark.range(0, p.shards, 1, width).mapInArrow(run, schema)


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _numbered(docs: DataFrame, *more: Column) -> DataFrame:
    """rid (a number of the row's own), doc_id, key (of the source), h (of the text) and size of every row, written once."""
    text = docs["text"]
    return cut(docs.select(F.monotonically_increasing_id().alias("rid"), docs["doc_id"].cast("long").alias("doc_id"), _key(docs["source"]).alias("key"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("h"), word_count(text).alias("size"), *more))


def measured(docs: DataFrame) -> DataFrame:
    return _numbered(docs)


def plan_of(sizes: DataFrame) -> Plan:
    rows = sizes.groupBy("key").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources")
    return plan({r["key"]: r["n"] for r in rows}, max((r["rows"] for r in rows), default=0))


def placed(sizes: DataFrame, p: Plan) -> DataFrame:
    """sizes with source_at, source_size, target and start, the place of a row's first word in its source's stream.

    Rows are in the order of part (by the hash of id and text), id and text's hash. Rows alike in these
    are counted for each partition that wrote them before they are shuffled, and laid side by side, so
    that any number of null ids or repeated rows gathers nowhere.
    """
    spark = sizes.sparkSession
    rows = [(k, i, int(s), float(t)) for i, (k, s, t) in enumerate(zip(p.keys, p.sizes, p.targets))]
    sources = spark.createDataFrame(rows, "key string, source_at int, source_size long, target double")
    each = sizes.join(F.broadcast(sources), "key").drop("key")  # at most MAX_SOURCES
    each = each.withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("written", F.shiftright("rid", 33))
    each = each.withColumn("part", F.pmod(F.xxhash64("id", "h", F.lit(SEED)), F.lit(p.parts)).cast("int"))
    alike = ["source_at", "part", "id", "h", "size", "written"]
    kinds = each.groupBy(*alike).agg(F.count("*").alias("n"))
    words = F.col("n") * F.col("size")
    before = lambda by, order, n: F.coalesce(F.sum(n).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = kinds.groupBy("source_at", "part").agg(F.sum(words).alias("words"))
    bases = parts.select("source_at", "part", before(["source_at"], ["part"], F.col("words")).alias("base"))
    spots = kinds.select(*alike, before(["source_at", "part"], ["id", "h", "size", "written"], words).alias("within"))
    spots = spots.join(bases, ["source_at", "part"]).select(*alike, (F.col("base") + F.col("within")).alias("begun"))
    nth = F.row_number().over(Window.partitionBy(*alike).orderBy("rid")) - 1
    return each.join(spots, alike).withColumn("start", F.col("begun") + nth * F.col("size")).select("rid", "doc_id", "source_at", "source_size", "target", "size", "start")


def pieces(rows: DataFrame) -> DataFrame:
    """rows with size > 0, once for each block they reach into: block, and the words begin to end (exclusive) of the row in it."""
    first, last = F.expr(f"start div {BLOCK}"), F.expr(f"(start + size - 1) div {BLOCK}")
    each = rows.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    return each.withColumn("begin", F.greatest(F.lit(0).cast("long"), F.col("block") * BLOCK - F.col("start"))).withColumn("end", F.least(F.col("size"), (F.col("block") + 1) * BLOCK - F.col("start")))


def taken_pieces(rows: DataFrame, mix: DataFrame) -> DataFrame:
    """pieces with n, the times that the mix takes their block (null: never)."""
    times = mix.groupBy("source_at", "block").agg(F.count("*").alias("n"))
    # The plan can't know how many slots a shard makes, and would broadcast them.
    return pieces(rows).join(times.hint("merge"), ["source_at", "block"], "left")


def mixed_blocks(docs: DataFrame) -> DataFrame:
    """The mix with its words: shard, slot, source_at, pass, block, doc_id, begin, end; a block that several documents share has several rows."""
    sizes = measured(docs)
    p = plan_of(sizes)
    return slots(docs.sparkSession, p).hint("merge").join(pieces(placed(sizes, p)), ["source_at", "block"]).select("shard", "slot", "source_at", "pass", "block", "doc_id", "start", "begin", "end")


def taken(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of every row."""
    sizes = measured(docs)
    p = plan_of(sizes)
    rows = placed(sizes, p)
    got = taken_pieces(rows, slots(docs.sparkSession, p))
    names = ["doc_id", "size", "source_size", "target"]
    some = got.groupBy("rid", *names).agg(F.sum((F.col("end") - F.col("begin")) * F.coalesce("n", F.lit(0))).alias("taken"))
    none = rows.where("size = 0").select(*names, F.lit(0).cast("long").alias("taken"))
    return some.select(*names, "taken").unionByName(none)


def mix_documents(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them: a row for the words taken, and another for those taken twice.

    A document taken whole keeps its text; of others the taken words are joined by single spaces.
    Documents of which nothing is taken go. n_chars, if there, follows the text. Rows meet their
    pieces by a number of their own, so nothing is gathered but a row's own pieces, and columns of
    any name stay as they are.
    """
    whole = _numbered(docs, F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    sizes = cut(whole.drop("row"))
    p = plan_of(sizes)
    got = taken_pieces(placed(sizes, p), slots(docs.sparkSession, p)).where("n > 0")
    lists = got.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("begin", "end", "n"))).alias("got"))
    both = whole.select("rid", "row", "size").join(lists, "rid").withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    both = both.withColumn("ranges", F.filter("got", lambda g: g["n"] >= F.col("copy"))).where(F.size("ranges") > 0)
    words = F.aggregate("ranges", F.lit(0).cast("long"), lambda a, g: a + g["end"] - g["begin"])
    # The words go in as a lambda's own variable, so that a text is split once and not for each range.
    part = lambda w: F.array_join(F.flatten(F.transform("ranges", lambda g: F.slice(w, (g["begin"] + 1).cast("int"), (g["end"] - g["begin"]).cast("int")))), " ")
    text = F.when(words == F.col("size"), F.col("row.text")).otherwise(F.get(F.transform(F.array(word_array(F.col("row.text"))), part), F.lit(0)))
    both = both.select("row", F.explode(F.array(text)).alias("text"))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return both.select(*(changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
