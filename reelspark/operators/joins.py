"""Joins that need more than equal keys, each as an equi join with a remainder.

Where ranges are compared, they are filed under the nodes of a binary tree and meet by node, so the engine can
hash or sort them, and a pair meets once.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.functions.timecode import div
from reelspark.operators.prefix import ranged
from reelspark.session import checkpoint_dir


def _nodes(a: Column, b: Column) -> Column:
    """The least nodes (level, place) of the binary tree over longs that make up [a, b): at most two on a level.

    On level k what is left runs from lo to hi in units of 2^k; an odd end takes one node. Nothing is left once
    the units are longer than the interval was."""
    none = F.array().cast("array<struct<level:int,place:bigint>>")
    node = lambda k, place: F.array(F.struct(k.cast("int").alias("level"), place.alias("place")))
    begin = F.struct(a.cast("long").alias("lo"), b.cast("long").alias("hi"), none.alias("made"))

    def step(left: Column, k: Column) -> Column:
        lo, hi = left["lo"], left["hi"]
        odd = lambda x: (lo < hi) & (x.bitwiseAND(F.lit(1)) == 1)
        taken = F.concat(left["made"], F.when(odd(lo), node(k, lo)).otherwise(none), F.when(odd(hi), node(k, hi - 1)).otherwise(none))
        return F.struct(F.shiftright(F.when(odd(lo), lo + 1).otherwise(lo), 1).alias("lo"), F.shiftright(F.when(odd(hi), hi - 1).otherwise(hi), 1).alias("hi"), taken.alias("made"))

    levels = F.sequence(F.lit(0), F.least(F.lit(63), F.ceil(F.log2((b - a).cast("double"))).cast("int") + 1))
    return F.aggregate(levels, begin, step, lambda x: x["made"])


def nodes(df: DataFrame, start: str, end: str) -> DataFrame:
    """df's rows of a positive length with level and place: the nodes that make up each interval, at most 2 log2 of its length."""
    return df.where(F.col(end) > F.col(start)).withColumn("_node", F.explode(_nodes(F.col(start), F.col(end)))).select(*df.columns, F.col("_node.level").alias("_level"), F.col("_node.place").alias("_place"))


def interval_join(left: DataFrame, right: DataFrame, start: tuple[str, str], end: tuple[str, str], on: list[str] | None = None) -> DataFrame:
    """Rows whose intervals [start, end) of longs overlap. Column names of both sides must differ, but for `on`.

    Of two intervals that overlap one holds the other's start. An interval is filed under the nodes of a binary tree
    that make it up, and a point asks for the nodes above it, so that a pair meets once, by equality: where the right
    start lies in the left interval, or the left start in the right interval and not at its start. The nodes asked for
    are those of levels that some interval has. A year costs an interval as few rows as an hour, two for each level.
    """
    on = on or []

    def met(held: DataFrame, points: DataFrame, a: str, b: str, at: str, other_end: str) -> DataFrame:
        filed = nodes(held, a, b)
        levels = filed.agg(F.sort_array(F.collect_set("_level")))  # 64 at most
        asks = points.where(F.col(other_end) > F.col(at)).withColumn("_levels", levels.scalar()).withColumn("_level", F.explode("_levels"))
        asks = asks.withColumn("_place", F.expr(f"shiftright(`{at}`, _level)")).drop("_levels")
        return filed.join(asks, [*on, "_level", "_place"]).drop("_level", "_place")

    one = met(left, right, start[0], end[0], start[1], end[1])
    two = met(right, left, start[1], end[1], start[0], end[0]).where(F.col(start[0]) > F.col(start[1]))
    return one.unionByName(two)


def nearest_day_start(start: Column, day: Column, target: Column) -> Column:
    """start moved by a day either way, whichever is nearest to target (of equals the earlier)."""
    options = F.array(*(F.struct(F.abs(start + k * day - target).alias("far"), F.lit(k).alias("k"), (start + k * day).alias("at")) for k in (-1, 0, 1)))
    return F.array_min(options)["at"]


def match_clips(takes: DataFrame, clips: DataFrame, slack_days: int = 1) -> DataFrame:
    """Take and clip pairs that run at the same time of day, and the best take of each clip.

    takes: take, t_start, t_len, t_channels, t_seq, t_date; clips: clip, c_start, c_len, c_day,
    c_date; times in ticks since midnight, dates null where unknown. A take is offered to clips on
    its own place and a day either way, by interval join; the nearest place alone counts. Dates are part of the
    join's key: a take has those within the slack, and one more key for the clips or takes without a date.
    """
    clip_undated, take_undated = F.lit(-(1 << 31)), F.lit((1 << 31) - 1)

    def meet(c: DataFrame, t: DataFrame) -> DataFrame:
        undated = lambda df, date: F.coalesce(df.agg(F.max(F.col(date).isNull())).scalar(), F.lit(False))
        also = lambda there, key: F.when(there, F.array(key)).otherwise(F.array().cast("array<int>"))
        within = F.sequence(F.unix_date("t_date") - slack_days, F.unix_date("t_date") + slack_days)
        t_days = F.when(F.col("t_date").isNull(), F.array(take_undated)).otherwise(F.concat(within, also(undated(c, "c_date"), clip_undated)))
        c_days = F.concat(F.array(F.coalesce(F.unix_date("c_date"), clip_undated)), also(undated(t, "t_date"), take_undated))
        ends = t.withColumn("t_end", F.col("t_start") + F.col("t_len"))
        low, high = ends.agg(F.min("t_start")).scalar(), ends.agg(F.max("t_end")).scalar()
        # A take as it is meets clips; moved by a day either way it meets clips that are moved back, whatever their day's length.
        moved = c.withColumn("c_end", F.col("c_start") + F.col("c_len")).withColumn("_shift", F.explode(F.array(*(F.lit(k) for k in (-1, 0, 1)))))
        moved = moved.withColumn("m_start", F.col("c_start") - F.col("_shift") * F.col("c_day")).withColumn("m_end", F.col("c_end") - F.col("_shift") * F.col("c_day"))
        moved = moved.where((F.col("m_start") < high) & (F.col("m_end") > low))
        both = interval_join(ends.withColumn("_day", F.explode(t_days)), moved.withColumn("_day", F.explode(c_days)), ("t_start", "m_start"), ("t_end", "m_end"), ["_day"]).drop("_day")
        both = both.withColumn("s_start", F.col("t_start") + F.col("_shift") * F.col("c_day")).withColumn("s_end", F.col("s_start") + F.col("t_len"))
        near = both.where(F.col("s_start") == nearest_day_start(F.col("t_start"), F.col("c_day"), F.col("c_start")))
        return near.withColumn("overlap", F.least("s_end", "c_end") - F.greatest("s_start", "c_start"))

    return with_chosen(clips, takes, meet, ["clip"], [F.col("t_channels").desc(), F.col("t_seq")], F.col("t_len"))


def with_chosen(left: DataFrame, right: DataFrame, meet: Callable[[DataFrame, DataFrame], DataFrame], by: list[str], order: list[Column], longest: Column) -> DataFrame:
    """meet(left, right) with chosen, true for one pair of each group of the left: that of the longest overlap, then the
    first by order (columns of the right). meet gives pairs with a positive overlap, at most the right's `longest`, and
    passes further columns on.

    Pairs may be far more than rows, so they are neither shuffled nor sorted: the right is ranked, a row's best pair is a
    number that is aggregated where the pairs are made, and the pairs are made again beside it."""
    checkpoint_dir(left.sparkSession)
    rows = left.withColumn("_row", F.monotonically_increasing_id()).checkpoint()
    ranks = ranged(right, order).withColumnRenamed("_pos", "_rank")
    most, last = ranks.agg(F.max(longest), F.max("_rank")).first()
    bits = int(last or 0).bit_length()
    if int(most or 0).bit_length() + bits < 63:
        value = F.col("overlap") * F.lit(1 << bits) - F.col("_rank")
    else:
        value = F.col("overlap").cast("decimal(19,0)") * F.lit(Decimal(1 << 63)) - F.col("_rank").cast("decimal(19,0)")
    best = meet(rows, ranks).groupBy("_row").agg(F.max(value).alias("_best")).join(rows.select("_row", *by), "_row")
    first = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("_best").desc(), "_row"))
    best = best.withColumn("_n", first).where("_n = 1").select("_row", "_best")
    pairs = meet(rows.join(best, "_row", "left"), ranks)
    return pairs.withColumn("chosen", F.coalesce(value == F.col("_best"), F.lit(False))).drop("_row", "_rank", "_best")


def asof(events: DataFrame, points: DataFrame, by: list[str], at: str, values: list[str], strict: bool = False, width: int | None = None) -> DataFrame:
    """events with prev_ and next_ of each of the points' values: those of the last point at or before
    the event (before it, if strict) and of the first one after it.

    Both tables are laid into one order and the neighbours carried over, which costs one sort by
    `by` and time. With a width, time is cut into stretches that are sorted apart, and what lies
    beyond a stretch comes from one row for each stretch, so a hot key is many groups.
    """
    cols = [c for c in events.columns if c not in by and c != at]
    kept = F.struct(F.lit(1).alias("_here"), *cols)
    point = F.struct(*values)
    stretch = F.floor(F.col("_at") / width).cast("long") if width else F.lit(0).cast("long")
    e = events.select(*by, F.col(at).alias("_at"), F.lit(0 if strict else 1).alias("_kind"), kept.alias("_event"))
    p = points.select(*by, F.col(at).alias("_at"), F.lit(1 if strict else 0).alias("_kind"), point.alias("_point"))
    both = e.unionByName(p, allowMissingColumns=True).withColumn("_stretch", stretch)
    group = [*by, "_stretch"]
    # What lies ahead is what lies back in falling order; a point at an event's own time is never ahead of it.
    kind = F.col("_kind") if strict else F.col("_kind").desc()
    back = Window.partitionBy(*group).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*group).orderBy(F.col("_at").desc(), kind).rowsBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("_prev", F.last("_point", ignorenulls=True).over(back)).withColumn("_next", F.last("_point", ignorenulls=True).over(ahead)).where("_event is not null")
    if width:
        ends = both.groupBy(*group).agg(F.max_by("_point", F.when(F.col("_point").isNotNull(), F.col("_at"))).alias("_last"), F.min_by("_point", F.when(F.col("_point").isNotNull(), F.col("_at"))).alias("_first"))
        w = Window.partitionBy(*by)
        before = F.last("_last", ignorenulls=True).over(w.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1))
        after = F.last("_first", ignorenulls=True).over(w.orderBy(F.col("_stretch").desc()).rowsBetween(Window.unboundedPreceding, -1))
        near = near.join(ends.select(*group, before.alias("_before"), after.alias("_after")), group)
        near = near.withColumn("_prev", F.coalesce("_prev", "_before")).withColumn("_next", F.coalesce("_next", "_after"))
    return near.select(*by, F.col("_at").alias(at), *(F.col(f"_event.{c}").alias(c) for c in cols), *(F.col(f"_prev.{v}").alias(f"prev_{v}") for v in values), *(F.col(f"_next.{v}").alias(f"next_{v}") for v in values))


def lane_value(frame: Column, at0: Column, v0: Column, at1: Column, v1: Column, step: bool = False) -> Column:
    """An automation lane between two breakpoints: held at its ends (and if step), else a straight line."""
    line = v0 + (v1 - v0) * (frame - at0).cast("double") / (at1 - at0).cast("double")
    off = (v0 == F.lit(float("-inf"))) | (v1 == F.lit(float("-inf")))
    held = F.when(at0.isNull(), v1).when(at1.isNull() | F.lit(step) | off | (frame == at0), v0)
    return F.coalesce(held, line)


def tolerance_join(left: DataFrame, right: DataFrame, on: list[str], a: str, b: str, tolerance: float, how: str = "inner") -> DataFrame:
    """Equal keys, and a of the left within the tolerance of b of the right."""
    r = right.select(*(F.col(c).alias(f"_{c}") for c in on), *(c for c in right.columns if c not in on))
    test = F.abs(left[a] - r[b]) <= F.lit(tolerance)
    for c in on:
        test = (left[c] == r[f"_{c}"]) & test
    return left.join(r, test, how).drop(*(f"_{c}" for c in on))


def translate_paths(paths: DataFrame, mapping: DataFrame, path: str = "path") -> DataFrame:
    """paths with translated: of renamed files and folders (old, new, seq) the first that holds the path is applied."""
    from reelspark.functions.paths import ancestors

    each = paths.select(path).distinct().withColumn("old", F.explode(ancestors(F.col(path))))
    hit = each.join(mapping, "old").groupBy(path).agg(F.min_by(F.struct("old", "new"), "seq").alias("m"))
    moved = F.concat(F.col("m.new"), F.expr(f"substring({path}, length(m.old) + 1)"))
    return paths.join(hit, path, "left").withColumn("translated", F.coalesce(moved, F.col(path))).drop("m")


def files_below(files: DataFrame, folders: DataFrame, path: str = "path", folder: str = "folder") -> DataFrame:
    """(folder, path) for every file at or below each folder, by its ancestors."""
    from reelspark.functions.paths import ancestors

    return files.select(path, F.explode(ancestors(F.col(path))).alias(folder)).join(folders.select(folder).distinct(), folder)


def copy_plan(sources: DataFrame, existing: DataFrame, tolerance: float = 2.1) -> DataFrame:
    """Status of each copy: new, same (size and time agree) or conflict (also a destination asked for before).

    sources: seq, dst, size, mtime; existing: dst, e_size, e_mtime.
    """
    found = sources.join(existing, "dst", "left").withColumn("_nth", F.row_number().over(Window.partitionBy("dst").orderBy("seq")))
    same = (F.col("size") == F.col("e_size")) & (F.abs(F.col("mtime") - F.col("e_mtime")) < tolerance)
    status = F.when(F.col("_nth") > 1, "conflict").when(F.col("e_size").isNull(), "new").when(same, "same").otherwise("conflict")
    return found.withColumn("status", status).drop("_nth")


def verified_backup(card: DataFrame, candidates: DataFrame) -> DataFrame:
    """Of each card file the first candidate with the same content: verified, different or new.

    card: file, digest; candidates: file, priority, dst, c_digest (null: missing).
    """
    best = F.row_number().over(Window.partitionBy("file").orderBy(F.col("equal").desc(), "priority", "dst"))
    both = card.join(candidates, "file", "left").withColumn("equal", F.coalesce(F.col("digest") == F.col("c_digest"), F.lit(False)))
    first = both.withColumn("_n", best).where("_n = 1")
    status = F.when(F.col("digest").isNull(), "could not verify").when(F.col("equal"), "verified").when(F.col("c_digest").isNotNull(), "different").otherwise("new")
    return first.select("file", F.when(F.col("equal"), F.col("dst")).alias("dst"), status.alias("status"))


def removed_rows(cached: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Cached rows that a complete scan didn't see."""
    return cached.join(seen.select(key).distinct(), key, "left_anti")


def differs(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables with the same columns hold different rows."""
    return not (a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty())


def bucket_of(x: Column, width: int) -> Column:
    return div(x, width)
