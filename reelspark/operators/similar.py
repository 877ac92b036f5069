"""Names that look alike: a similarity join over filters that lose no pair.

The likeness of two names is that of their matching blocks, 2 M / T for M matched of T characters in all.
At a likeness of r they have M(T) = ceil(r T / 2) matched characters at least, so at most U = T - 2 M(T)
unmatched ones, and between two blocks lies an unmatched one, so at most U + 1 blocks. From that follow the
two ways by which names meet:

* Short pairs (T up to `short_total(r)`): both lose what exceeds M(T) and are then equal, so names meet by
  their variants with up to three characters less.
* Longer pairs share at least M - 2 (U + 1) = 5 M - 2 T - 2 >= 2 runs of three characters (numbered where one
  repeats). Grams are ordered by how many names have them; of a name's n grams the first n - shared + 2
  hold two of the shared ones, in both names. One of the two is rare, and the names meet by it, or both
  are common and the names meet by the pair. So no list of names under a common gram is ever joined.
  A matched character moves by no more than the characters that the longer name has unmatched, which
  bounds how far apart a gram may stand in the two (where it doesn't repeat).

A name has at most some hundred keys (pairs of common grams; names are file and folder names, of 255
characters at most). What meets is tested by length and edit distance before its blocks are matched.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.functions import names
from reelspark.session import checkpoint_dir

#: A gram that more names (with the same digits) have is common.
COMMON = 64
LEAST = 0.85
#: Names of fewer characters are only compared as prefixes.
SHORTEST = 5
_SEP = "\x1f"


def matched(total: int, least: float) -> int:
    return math.ceil(round(least * total / 2, 9))


def shared(total: int, least: float) -> int:
    """Grams of three that names of so many characters in all have in common at least."""
    return 5 * matched(total, least) - 2 * total - 2


def short_total(least: float) -> int:
    """The largest total of characters whose shared grams may be fewer than two."""
    slope = 2.5 * least - 2
    if slope <= 0 or least > 1:
        raise ValueError("a likeness above 0.8 and up to 1 is asked for")
    found = max((t for t in range(2 * SHORTEST, math.ceil(4 / slope) + 1) if shared(t, least) < 2), default=0)
    if found > 24:
        raise ValueError("so low a likeness would need too many variants")
    return found


def _removals(least: float) -> dict[int, list[int]]:
    """By length of a name: how many characters it may have to lose to equal a partner in a short pair."""
    out: dict[int, set[int]] = {}
    for total in range(2 * SHORTEST, short_total(least) + 1):
        m = matched(total, least)
        for n in range(max(m, SHORTEST), total - max(m, SHORTEST) + 1):
            out.setdefault(n, set()).add(n - m)
    return {n: sorted(d) for n, d in out.items()}


def _pieces(kinds: DataFrame, least: float) -> DataFrame:
    """(runs, n, size, key, at): variants of names in short pairs, marked by =, and numbered grams of names in longer ones."""
    removals, short = _removals(least), short_total(least)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = []
            for runs, n in zip(pdf["runs"], pdf["n"]):
                size, wanted = len(n), removals.get(len(n), [])
                left = {n}
                for d in range(max(wanted, default=-1) + 1):
                    if d:
                        left = {v[:k] + v[k + 1 :] for v in left for k in range(len(v))}
                    if d in wanted:
                        made += [(runs, n, size, "=" + v, None) for v in left]
                if size + math.floor(round(size * (2 - least) / least, 9)) > short:
                    grams = [n[k : k + 3] for k in range(size - 2)]
                    often, seen = Counter(grams), Counter()
                    for k, g in enumerate(grams):
                        seen[g] += 1
                        made.append((runs, n, size, f"{g}.{seen[g]}", k if often[g] == 1 else None))
            yield pd.DataFrame(made, columns=["runs", "n", "size", "key", "at"]).astype({"at": "Int32"})

    return kinds.where(F.col("size") >= SHORTEST).select("runs", "n").mapInPandas(run, "runs string, n string, size int, key string, at int")


def _matched(total: Column, least: float) -> Column:
    return F.ceil(F.round(total * (least / 2), 9))


def _kinds(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(x, n, runs): names, what is compared of them and their digit runs; and the distinct (n, runs, size)."""
    named = df.select(F.col(name).alias("x")).where(F.col("x").isNotNull()).distinct()
    named = named.select("x", names.normalized(F.col("x")).alias("n"), F.array_join(names.digit_runs(F.col("x")), ",").alias("runs")).where(F.length("n") >= 3)
    return named, named.select("n", "runs").distinct().withColumn("size", F.length("n"))


def keys(kinds: DataFrame, least: float = LEAST, common: int = COMMON) -> DataFrame:
    """(runs, key, n, size, at, at2): what names of SHORTEST characters or more meet by; at and at2 are where
    the key's grams stand, null where that doesn't matter."""
    short, pieces = short_total(least), _pieces(kinds, least)
    variant = F.startswith("key", F.lit("="))
    by_variant = pieces.where(variant).select("runs", "key", "n", "size", "at", F.col("at").alias("at2"))
    tokens = pieces.where(~variant)
    heat = tokens.groupBy("runs", "key").agg(F.count("*").alias("df"))
    ordered = tokens.join(heat, ["runs", "key"]).groupBy("runs", "n", "size").agg(F.sort_array(F.collect_list(F.struct("df", F.col("key").alias("gram"), "at"))).alias("_t"))
    smallest = F.greatest(F.lit(short + 1), F.col("size") + F.ceil(F.round(F.col("size") * (least / (2 - least)), 9)))
    overlap = F.greatest(F.lit(2), F.ceil(F.round(smallest * (2.5 * least - 2) - 2, 9)))
    first = F.slice("_t", F.lit(1), F.greatest(F.lit(1), (F.size("_t") - overlap + 2).cast("int")))
    each = ordered.select("runs", "n", "size", first.alias("_f")).select("runs", "n", "size", "_f", F.posexplode("_f").alias("_k", "t"))
    alone, later = F.slice("_f", F.lit(1), F.lit(1)), F.slice("_f", F.col("_k") + 2, F.size("_f"))  # they are ordered, so what follows a common gram is common
    each = each.select("runs", "n", "size", "t", F.explode(F.when(F.col("t.df") <= common, alone).otherwise(later)).alias("o"))
    rare = F.col("t.df") <= common
    by_gram = each.select("runs", F.when(rare, F.col("t.gram")).otherwise(F.concat("t.gram", F.lit(_SEP), "o.gram")).alias("key"), "n", "size", F.col("t.at").alias("at"), F.when(rare, F.col("t.at")).otherwise(F.col("o.at")).alias("at2"))
    return by_variant.unionByName(by_gram)


def candidates(kinds: DataFrame, least: float = LEAST, common: int = COMMON) -> DataFrame:
    """(runs, a, b): pairs a < b that share a key and fit in length and place; each once."""
    checkpoint_dir(kinds.sparkSession)
    k = keys(kinds, least, common).checkpoint()  # the order of grams and what names are filed under are written once
    total = F.col("a.size") + F.col("b.size")
    least_matched = _matched(total, least)
    near = lambda c: F.coalesce(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) <= F.greatest("a.size", "b.size") - least_matched, F.lit(True))
    variant = F.startswith(F.col("a.key"), F.lit("="))
    fits = F.when(variant, (total <= short_total(least)) & (F.length("a.key") - 1 == least_matched)).otherwise((total > short_total(least)) & near("at") & near("at2"))
    met = k.alias("a").join(k.alias("b"), (F.col("a.runs") == F.col("b.runs")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.n") < F.col("b.n")) & (F.least("a.size", "b.size") >= least_matched) & fits)
    return met.select(F.col("a.runs").alias("runs"), F.col("a.n").alias("a"), F.col("b.n").alias("b")).distinct()


def similar_pairs(df: DataFrame, name: str, least: float = LEAST) -> DataFrame:
    """(a, b): names that look alike, a before b in lower case.

    Names must have the same digit runs. The shorter, of three characters or more, is a prefix whose
    remainder has no digit, or both have five or more and a likeness of `least`. A name meets its prefixes
    by equality, so names with a common beginning don't meet each other. Null names are no names, and a name
    that comes several times is one.
    """
    named, kinds = _kinds(df, name)
    longer = kinds.select("runs", F.col("n").alias("q"), F.explode(F.sequence(F.lit(3), F.col("size"))).alias("k"))
    longer = longer.where(~F.substring("q", F.col("k") + 1, F.length("q")).rlike("[0-9]")).select("runs", "q", F.substring("q", F.lit(1), F.col("k")).alias("p"))
    by_prefix = kinds.select("runs", F.col("n").alias("p")).join(longer, ["runs", "p"]).select("runs", "p", "q")

    is_prefix = lambda p, q: F.startswith(q, p) & ~F.substring(q, F.length(p) + 1, F.length(q)).rlike("[0-9]")
    a, b = F.col("a"), F.col("b")
    some = candidates(kinds, least).where(~is_prefix(a, b) & ~is_prefix(b, a))
    most = F.length("a") + F.length("b") - 2 * _matched(F.length("a") + F.length("b"), least)
    by_blocks = some.where(F.levenshtein(a, b) <= most).select("runs", F.col("a").alias("p"), F.col("b").alias("q"))
    # of names that are spelled differently the blocks may depend on which comes first, so these are matched as named
    both = by_prefix.withColumn("sure", F.lit(True)).unionByName(by_blocks.withColumn("sure", F.lit(False)))
    one, two = named.select("runs", F.col("n").alias("p"), F.col("x").alias("px")), named.select("runs", F.col("n").alias("q"), F.col("x").alias("qx"))
    met = both.join(one, ["runs", "p"]).join(two, ["runs", "q"])
    before = (F.lower("px") < F.lower("qx")) | ((F.lower("px") == F.lower("qx")) & (F.col("px") < F.col("qx")))
    met = met.where((F.col("p") != F.col("q")) | before)
    turned = lambda x, y: F.when(before, F.col(x)).otherwise(F.col(y))
    met = met.select(turned("px", "qx").alias("a"), turned("qx", "px").alias("b"), turned("p", "q").alias("_p"), turned("q", "p").alias("_q"), "sure")
    sure, open_ = met.where("sure").select("a", "b"), met.where("not sure")
    return sure.unionByName(open_.where(names.sequence_ratio("_p", "_q") >= least).select("a", "b"))
