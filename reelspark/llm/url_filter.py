"""Judging urls by a list of hosts and paths: a blocked Bloom filter, then an exact hash join.

The listed canonical urls (host followed by path) set four bits in one block of a Bloom filter. A
url asks for the suffixes of its host and the prefixes of its path that have a listed length. The
filter is asked where the row lies; rows without a possible hit go straight on, and only the others
are shuffled, to meet the list in an exact hash join, which removes the false positives. The filter
has a bounded number of blocks (8 MB; beyond the bound more candidates pass, and the join still
decides), so it is the only thing that is broadcast.

Defined results: a null url, or one without "://", has empty host and path and fits no rule; a url
that fits no rule gets the default verdict; repeated rows and rows without id stay; an empty table
gives none, an empty list the default; further columns, whatever their names, don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.llm.common import LOWER, UPPER, cut

#: The rules of the query (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
BITS_PER_KEY = 16
WORDS = 4
MAX_BLOCKS = 1 << 18
#: More distinct pairs of host and path length than this are refused, as each url asks for all of them.
MAX_SHAPES = 1 << 14
SALTS = 8
DEFAULT = "allow"


def rule_list(spark: SparkSession, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    return spark.createDataFrame(RULES if rules is None else rules, "host string, path string, verdict string")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) and the path; empty for null and without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _place(key: bytes, blocks: int) -> tuple[int, list[int]]:
    """A key's block and its bit in each of the block's words."""
    h = xxhash.xxh3_128_intdigest(key)
    return (h >> 64) % blocks, [h >> (6 * k) & 63 for k in range(WORDS)]


class BlockedBloom:
    """A filter of `blocks` blocks of WORDS 64-bit words."""

    def __init__(self, blocks: int) -> None:
        self.words = np.zeros((blocks, WORDS), np.uint64)

    def add(self, key: bytes) -> None:
        block, bits = _place(key, len(self.words))
        self.words[block] |= np.array([1 << b for b in bits], np.uint64)

    def __contains__(self, key: bytes) -> bool:
        block, bits = _place(key, len(self.words))
        return all(int(w) >> b & 1 for w, b in zip(self.words[block], bits))


def bloom(listed: DataFrame, blocks: int) -> BlockedBloom:
    """The filter of the list: tasks set bits, and blocks are joined before they are collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = BlockedBloom(blocks)
        for batch in batches:
            for host, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part.add((host + path).encode("utf-8", "surrogatepass"))
        used = np.flatnonzero(part.words.any(axis=1))
        cols = [pa.array(used), *(pa.array(part.words[used, k].view(np.int64)) for k in range(WORDS))]
        yield pa.RecordBatch.from_arrays(cols, ["block", *(f"w{k}" for k in range(WORDS))])

    schema = "block long, " + ", ".join(f"w{k} long" for k in range(WORDS))
    sums = listed.select("host", "path").mapInArrow(run, schema).groupBy("block").agg(*(F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)))
    out, made = BlockedBloom(blocks), sums.toArrow()  # at most `blocks` rows
    for k in range(WORDS):
        out.words[made["block"].to_numpy(), k] = made[f"w{k}"].to_numpy().view(np.uint64)
    return out


def rule_shapes(listed: DataFrame) -> dict[int, list[int]]:
    """The path lengths that are listed with each host length."""
    rows = listed.select(F.length("host"), F.length("path")).distinct().limit(MAX_SHAPES + 1).collect()
    if len(rows) > MAX_SHAPES:
        raise ValueError(f"the list has over {MAX_SHAPES} pairs of host and path length")
    shapes: dict[int, list[int]] = {}
    for h, p in sorted(map(tuple, rows)):
        shapes.setdefault(h, []).append(p)
    return shapes


def candidates(host: str, path: str, shapes: dict[int, list[int]]) -> Iterator[tuple[str, str]]:
    """What a url asks for: its host and the suffixes behind each dot, with the prefixes of its path, where a length is listed."""
    at = 0
    while at >= 0:
        for p in shapes.get(len(host) - at, ()):
            if p <= len(path):
                yield host[at:], path[:p]
        at = host.find(".", at) + 1 or -1


def probed(judged: DataFrame, filter_: BlockedBloom, shapes: dict[int, list[int]]) -> DataFrame:
    """page_id, host and path with hits, the candidates that the filter passes."""
    shared = judged.sparkSession.sparkContext.broadcast((filter_, shapes))  # a bounded filter

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom_, lengths = shared.value
        kind = pa.list_(pa.struct([("r_host", pa.string()), ("r_path", pa.string())]))
        for batch in batches:
            hits = [[{"r_host": h, "r_path": p} for h, p in candidates(host, path, lengths) if (h + p).encode("utf-8", "surrogatepass") in bloom_] for host, path in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, kind)], ["page_id", "host", "path", "hits"])

    return judged.mapInArrow(run, "page_id long, host string, path string, hits array<struct<r_host:string,r_path:string>>")


def judge_urls(pages: DataFrame, listed: DataFrame, default: str = DEFAULT, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages.

    listed: host, path, verdict. A rule fits its host and all subdomains if the url's path starts
    with the rule's; of the rules that fit, the longest wins (of equal length, that with the longer host).
    """
    listed = listed.select(F.col("host"), F.col("path"), F.col("verdict")).where("host is not null and path is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    shapes = rule_shapes(listed)
    host, path = host_and_path(pages["url"].cast("string"))
    judged = pages.select(pages["page_id"].cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    unfit = (F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    if not shapes:
        return judged.select("*", *unfit)
    blocks = max(1, min(max_blocks, -(-listed.count() * BITS_PER_KEY // (64 * WORDS))))
    rows = cut(probed(judged, bloom(listed, blocks), shapes))
    clear = rows.where(F.size("hits") == 0).select("page_id", "host", "path", *unfit)
    hit = rows.where(F.size("hits") > 0)
    # Urls that occur often are asked for once; a rule that fits many urls meets them in SALTS parts.
    urls = hit.groupBy("host", "path").agg(F.first("hits").alias("hits")).select("host", "path", F.explode("hits").alias("r")).select("host", "path", "r.r_host", "r.r_path", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).alias("salt"))
    rules = listed.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), "verdict", F.explode(F.array(*(F.lit(k).cast("long") for k in range(SALTS)))).alias("salt"))
    exact = urls.join(rules, ["r_host", "r_path", "salt"])
    length = F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"))
    best = exact.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), "verdict"), length).alias("best"))
    fits = hit.drop("hits").join(best, ["host", "path"], "left")
    return clear.unionByName(fits.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")))
