"""The recordings table: filters, search, projections, orders, trees and report fields.

Functions take and give DataFrames; columns are those of reelspark.schema unless named.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.functions import names, timecode
from reelspark.session import checkpoint_dir


def search_text(*cols: Column) -> Column:
    """Lower-case text of the columns (arrays by element), joined by spaces."""
    return F.lower(F.concat_ws(" ", *cols))


def all_words(text: Column, query: str) -> Column:
    """Every word of the query is somewhere in the text."""
    return reduce(lambda a, b: a & b, (text.contains(w) for w in query.lower().split()), F.lit(True))


def in_period(date: Column, period: str | None) -> Column:
    """None: any; '': no date; else a prefix of the date such as 2026 or 2026-09."""
    if period is None:
        return F.lit(True)
    return F.coalesce(date, F.lit("")) == "" if period == "" else date.startswith(period)


def grid_filter(df: DataFrame, text: Column | None = None, query: str = "", equal: dict[str, object] | None = None, period: tuple[Column, str | None] | None = None, flags: list[Column] | None = None, allowed: DataFrame | None = None, key: str = "path") -> DataFrame:
    """The conjunction of scope, period, flags and words; allowed is a table of keys (semi join). Cheap tests come first."""
    for column, value in (equal or {}).items():
        df = df.where(F.col(column) == F.lit(value))
    if period is not None:
        df = df.where(in_period(*period))
    for flag in flags or []:
        df = df.where(flag)
    if allowed is not None:
        df = df.join(allowed.select(key).distinct(), key, "left_semi")
    return df.where(all_words(text, query)) if text is not None and query.split() else df


def overlay(df: DataFrame, edits: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """df with pending edits applied; a null edit leaves the value."""
    e = edits.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_new_{c}") for c in columns))
    joined = df.join(e, df[key] == e["_key"], "left")
    return joined.select(*(F.coalesce(f"_new_{c}", df[c]).alias(c) if c in columns else df[c] for c in df.columns))


def compare_rows(a: DataFrame, b: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """Label, both values as text and whether they differ, a row for each column of each pair."""
    pair = a.select(F.col(on), *(F.col(c).cast("string").alias(f"a_{c}") for c in columns)).join(b.select(F.col(on), *(F.col(c).cast("string").alias(f"b_{c}") for c in columns)), on)
    rows = F.array(*(F.struct(F.lit(c).alias("label"), F.col(f"a_{c}").alias("a"), F.col(f"b_{c}").alias("b")) for c in columns))
    return pair.select(on, F.explode(rows).alias("r")).select(on, "r.label", "r.a", "r.b", (~F.col("r.a").eqNullSafe(F.col("r.b"))).alias("differs"))


def family_members(df: DataFrame, key: str, family: list[str]) -> DataFrame:
    """Each row's key with the keys of its family's other rows."""
    a = df.select(*family, F.col(key)).where(reduce(lambda x, y: x & y, (F.col(f).isNotNull() for f in family)))
    b = a.select(*family, F.col(key).alias("member"))
    return a.join(b, family).where(F.col(key) != F.col("member"))


def positions(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """df with each row's place (from 1) in the whole order.

    Rows are dealt to ranges and sorted there; a range's first place is the sum of the counts before
    it, so only the counts of ranges are ordered in one task. The dealt rows are written once, as a
    second run might cut the ranges elsewhere.
    """
    checkpoint_dir(df.sparkSession)
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    rows = dealt.withColumn("_part", F.shiftright("_at", 33))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    base = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(before, F.lit(0)).alias("_base"))
    placed = rows.join(F.broadcast(base), "_part")  # a row for each range
    return placed.withColumn(name, F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at", "_part", "_base")


def natural_order(df: DataFrame, column: str, tie: str) -> DataFrame:
    """df with position, its place in natural order."""
    return positions(df, names.natural_text(F.col(column)), F.col(tie))


def report_order(df: DataFrame) -> list[Column]:
    return [df["date"], F.coalesce(df["time_reference"], F.lit(-1)), df["path"]]


def tree(df: DataFrame, levels: list[str], distinct: str) -> DataFrame:
    """Counts of rows and of distinct values at every node of the hierarchy; level is a node's depth."""
    out = df.rollup(*levels).agg(F.count("*").alias("files"), F.countDistinct(distinct).alias("projects"), F.grouping_id().alias("gid"))
    depth = reduce(lambda a, b: a + b, (F.when(F.col("gid").bitwiseAND(F.lit(1 << k)) == 0, 1).otherwise(0) for k in range(len(levels))))
    return out.withColumn("level", depth.cast("long")).drop("gid")


def status(df: DataFrame, project: str, shown: Column, selected: Column) -> DataFrame:
    return df.agg(F.count("*").alias("files"), F.countDistinct(project).alias("projects"), F.count_if(shown).alias("shown"), F.count_if(selected).alias("selected"))


def most_common(df: DataFrame, value: str, by: list[str], first: str) -> DataFrame:
    """by, and the distinct values by falling count (then first seen), joined with ' / '."""
    counts = df.where(F.coalesce(F.col(value), F.lit("")) != "").groupBy(*by, value).agg(F.count("*").alias("n"), F.min(first).alias("seen"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col("seen"), F.col(value).alias("v"))))
    return counts.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda x: x["v"]), " / ").alias("detected"))


def date_span(date: Column) -> Column:
    """One day, or first to last."""
    return F.when(F.min(date) == F.max(date), F.min(date)).otherwise(F.concat(F.min(date), F.lit(" - "), F.max(date)))


def track_columns(df: DataFrame, tracks: str, width: int) -> DataFrame:
    """The array's first `width` elements as columns Trk1, Trk2, …; '' beyond its end."""
    return df.select(*(c for c in df.columns if c != tracks), *(F.coalesce(F.get(F.col(tracks), F.lit(k)), F.lit("")).alias(f"Trk{k + 1}") for k in range(width)))


def max_tracks(df: DataFrame, tracks: str) -> int:
    return int(df.agg(F.coalesce(F.max(F.size(tracks)), F.lit(0)).alias("n")).first()["n"])


def report_groups(df: DataFrame, project: str, date: str, key: str, error: str | None = None) -> DataFrame:
    """One report for each project: rows without errors, each key once; a single day is named in the title."""
    rows = df if error is None else df.where(F.col(error) == "")
    g = rows.dropDuplicates([key]).groupBy(project).agg(F.count("*").alias("files"), F.min(date).alias("first_day"), F.max(date).alias("last_day"))
    return g.withColumn("title", F.when(F.col("first_day") == F.col("last_day"), F.concat_ws(" ", F.col(project), F.col("first_day"))).otherwise(F.col(project)))


def summary(df: DataFrame, date: str) -> DataFrame:
    return df.agg(F.count("*").alias("files"), date_span(F.col(date)).alias("days"))


def size_estimate(df: DataFrame, size: str, order: str, about: int = 400) -> DataFrame:
    """Size of all rows, estimated from every n-th of them in order (about `about` rows)."""
    step = max(1, df.count() // about)
    taken = positions(df, F.col(order), name="_place").where((F.col("_place") - 1) % step == 0)
    return taken.agg((F.sum(size) * step).alias("estimate"), F.count("*").alias("sampled"))


def grid(df: DataFrame) -> DataFrame:
    """The display columns of a recordings table; rows with an error show the error as their note."""
    ok = F.coalesce(F.col("error"), F.lit("")) == ""
    # Step by step, as each is read several times by the next.
    df = df.withColumn("_rate", timecode.parse_rate(F.col("tc_rate")))
    r, start = F.col("_rate"), F.col("time_reference")
    df = df.withColumn("_fps", timecode.nominal_fps(r)).withColumn("_start", timecode.samples_to_frames(start, F.col("sample_rate"), r)).withColumn("_end", timecode.samples_to_frames(start + F.col("frames"), F.col("sample_rate"), r))

    def tc(samples: Column, frames: str) -> Column:
        clock = timecode.seconds_to_clock(samples.cast("double") / F.col("sample_rate"))
        return F.when(start.isNull(), "").when(r.isNull(), clock).otherwise(timecode.frames_to_tc(F.col(frames), F.col("_fps"), F.col("drop_frame")))

    shown = {
        "name": names.basename(F.col("path")), "scene": F.col("scene"), "take": F.col("take"), "length": timecode.format_duration(F.col("frames") / F.col("sample_rate")),
        "start_tc": tc(start, "_start"), "end_tc": tc(start + F.col("frames"), "_end"),
        "rate": timecode.rate_label(r, F.col("drop_frame")), "channels": F.col("channels").cast("string"), "format": F.concat((F.col("sample_rate") / 1000).cast("string"), F.lit(" kHz / "), F.col("bits").cast("string"), F.when(F.col("float_samples"), F.lit(" float")).otherwise(F.lit(" bit"))),
        "tracks": F.array_join("tracks", ", "), "circled": F.when(F.col("circled"), "★").otherwise(""), "date": F.col("date"), "tape": F.col("tape"), "recorder": names.recorder_label(F.col("recorder")),
    }
    cells = [F.when(ok, c).otherwise("").alias(k) for k, c in shown.items()]
    return df.select("path", *cells, F.when(ok, F.col("note")).otherwise(F.col("error")).alias("note"), names.folder(F.col("path")).alias("folder"), F.col("project"))
