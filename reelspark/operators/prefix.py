"""Running values over long groups: a group is many segments, and what a segment needs from those before it is a row.

`running` lays one carry row at the head of each segment, with the totals of the segments before it, so that
rows are shuffled once, by (group, segment), and a group that holds most rows is as many tasks as it has
segments. `scanned` does the same for kernels whose state isn't a sum: each segment is first made a function of
the state that comes in, the functions are followed in order, and each segment then runs from its own state.
`neighbours` gives each segment the rows around it that its windows reach.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from reelspark.functions.timecode import div
from reelspark.session import checkpoint_dir

#: Rows of a segment where rows are numbered.
LENGTH = 65_536


def running(df: DataFrame, by: list[str], segment: Column, order: list[str], **values: tuple[str, Column]) -> DataFrame:
    """df with running values by name: ("sum" | "max" | "last", column) of the rows up to each row of its group, in order,
    ("max_before", column) of those before it alone, or ("total", column): the sum over its whole group. segment must not fall as the rows rise in order. Null values are passed over."""
    d = df.select("*", segment.alias("_seg"), *(v.alias(f"_v_{n}") for n, (_, v) in values.items()))
    last = lambda n: F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.struct(*order)))
    of_segment = {"sum": lambda n: F.sum(f"_v_{n}"), "total": lambda n: F.sum(f"_v_{n}"), "max": lambda n: F.max(f"_v_{n}"), "max_before": lambda n: F.max(f"_v_{n}"), "last": last}
    totals = d.groupBy(*by, "_seg").agg(*(of_segment[kind](n).alias(f"_v_{n}") for n, (kind, _) in values.items()))
    over = Window.partitionBy(*by).orderBy("_seg")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    take: dict[str, Callable[[str, WindowSpec], Column]] = {"sum": lambda n, w: F.sum(n).over(w), "max": lambda n, w: F.max(n).over(w), "max_before": lambda n, w: F.max(n).over(w), "last": lambda n, w: F.last(n, ignorenulls=True).over(w)}
    whole = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = [(F.sum(f"_v_{n}").over(whole) if kind == "total" else take[kind](f"_v_{n}", before)).alias(f"_v_{n}") for n, (kind, _) in values.items()]
    d = d.select("*", *(F.lit(None).cast(d.schema[f"_v_{n}"].dataType).alias(f"_w_{n}") for n, (kind, _) in values.items() if kind == "total"))
    carry = totals.select(*by, "_seg", *carried).select(*by, "_seg", *((F.lit(None) if kind == "total" else F.col(f"_v_{n}")).alias(f"_v_{n}") for n, (kind, _) in values.items()), *(F.col(f"_v_{n}").alias(f"_w_{n}") for n, (kind, _) in values.items() if kind == "total"))
    # dealt anew whatever the rows came by, as one task by group would do for the windows too
    both = d.withColumn("_own", F.lit(1)).unionByName(carry.withColumn("_own", F.lit(0)), allowMissingColumns=True).repartition(*by, "_seg")
    ordered = Window.partitionBy(*by, "_seg").orderBy("_own", *order)
    here = lambda kind: ordered.rowsBetween(Window.unboundedPreceding, -1 if kind == "max_before" else 0)
    made = [(F.max(f"_w_{n}").over(here(kind)) if kind == "total" else take[kind](f"_v_{n}", here(kind))).alias(n) for n, (kind, _) in values.items()]
    return both.select(*df.columns, "_own", *made).where("_own = 1").drop("_own")


def ranged(df: DataFrame, keys: list[str] | list[Column]) -> DataFrame:
    """df with _pos, which rises with the keys: rows are dealt by ranges of them, so equal first keys may be many tasks. Written once."""
    checkpoint_dir(df.sparkSession)
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_pos", F.monotonically_increasing_id()).checkpoint()


def positions(df: DataFrame, by: list[str], segment: Column, order: list[str]) -> DataFrame:
    """df with pos, each row's place in its group from 0 on, and total, the group's rows."""
    return running(df, by, segment, order, pos=("sum", F.lit(1).cast("long")), total=("total", F.lit(1).cast("long"))).withColumn("pos", F.col("pos") - 1)


def neighbours(df: DataFrame, by: list[str], at: str, before: int, after: int, length: int = LENGTH, **columns: Callable[[WindowSpec], Column]) -> DataFrame:
    """df with columns over windows that reach up to `before` rows back and `after` rows on; at numbers the rows of a
    group without gaps. Rows near the end of a segment are sent to the next ones too, so that a group is many tasks."""
    here = F.floor(F.col(at) / length)
    first, last = F.floor((F.col(at) - after) / length), F.floor((F.col(at) + before) / length)
    d = df.withColumn("_seg", F.explode(F.when(first == last, F.array(here)).otherwise(F.sequence(first, last)))).repartition(*by, "_seg")
    spec = Window.partitionBy(*by, "_seg").orderBy(at)
    return d.select("*", *(make(spec).alias(name) for name, make in columns.items())).where(F.col("_seg") == here).drop("_seg")


def in_order(df: DataFrame, by: list[str], order: list[str], fresh: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Runs a kernel along each group: rows are sorted where they lie and stream by, and the kernel, made
    anew for each group, carries what it needs from one batch to the next, so no group is held whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, kernel = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            keys = pdf[by]
            moved = (keys.ne(keys.shift()) & ~(keys.isna() & keys.shift().isna())).any(axis=1).to_numpy()
            moved[0] = True
            starts = np.flatnonzero(moved)
            made = []
            for low, high in zip(starts, [*starts[1:], len(pdf)]):
                own = tuple(None if pd.isna(x) else x for x in keys.iloc[low])
                if kernel is None or own != key:
                    key, kernel = own, fresh()
                made.append(kernel(pdf.iloc[low:high]))
            yield pd.concat(made) if len(made) > 1 else made[0]

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, schema)


State = list[float]


def scanned(df: DataFrame, by: list[str], at: str, column: str, kind: str, begin: State, function: Callable[[pd.DataFrame, dict[str, float]], State], follow: Callable[[State, State], State], run: Callable[[pd.DataFrame, State], tuple[np.ndarray, State]], bounds: dict[str, Column] | None = None, length: int = LENGTH) -> DataFrame:
    """df with column, made by a kernel that carries state along each group; at numbers a group's rows.

    function(rows of a segment, bounds of its group) gives the segment as a function of the state that comes in, in
    numbers; follow(state, function) gives the state after it; run(rows, state) gives the column's values and the
    state after them. Functions are made of segments alone that others follow, so short groups cost nothing more.
    """
    checkpoint_dir(df.sparkSession)
    d = df.withColumn("_seg", F.floor(F.col(at) / length)).checkpoint()  # read three times
    names, bounds = df.columns, bounds or {}
    limited = list(bounds)
    shape = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)
    whole = Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = d.groupBy(*by, "_seg").agg(F.count("*").alias("_n"), *(c.alias(f"_b_{n}") for n, c in bounds.items()))
    ends = ends.select(*by, "_seg", *((F.min if n.startswith("low") else F.max)(f"_b_{n}").over(whole).alias(f"_b_{n}") for n in bounds), F.max("_seg").over(whole).alias("_top"))
    ends = ends.where("_seg < _top").drop("_top").checkpoint()
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields) + f", {column} {kind}"

    def running_on() -> Callable[[pd.DataFrame], pd.DataFrame]:
        now = [begin]

        def step(pdf: pd.DataFrame) -> pd.DataFrame:
            if pdf["_own"].iloc[0] == 0:
                now[0] = list(pdf["_state"].iloc[0])
                pdf = pdf.iloc[1:]
            made, now[0] = run(pdf, now[0])
            return pdf[names].assign(**{column: made})

        return step

    if ends.isEmpty():
        return in_order(d.withColumn("_own", F.lit(1)), [*by, "_seg"], [at], running_on, out)
    match = [F.col(f"d.{c}").eqNullSafe(F.col(f"e.{c}")) for c in (*by, "_seg")]
    followed = d.alias("d").join(ends.alias("e"), match).select("d.*", *(f"e._b_{n}" for n in bounds))

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        limits = {n: float(pdf[f"_b_{n}"].iloc[0]) for n in limited}
        made = function(pdf.sort_values(at, kind="stable"), limits)
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in (*by, "_seg")}, "_state": [made]})

    def folding() -> Callable[[pd.DataFrame], pd.DataFrame]:
        now = [begin]

        def step(pdf: pd.DataFrame) -> pd.DataFrame:
            after = []
            for f in pdf["_state"]:
                now[0] = follow(now[0], list(f))
                after.append(now[0])
            return pdf.assign(_seg=pdf["_seg"] + 1, _state=after)

        return step

    table = f"{shape}, _seg long, _state array<double>"
    functions = followed.groupBy(*by, "_seg").applyInPandas(summarise, table)
    carry = in_order(functions, by, ["_seg"], folding, table).withColumn("_own", F.lit(0))

    both = d.withColumn("_own", F.lit(1)).unionByName(carry, allowMissingColumns=True)
    return in_order(both, [*by, "_seg"], ["_own", at], running_on, out)


def numbered_from(df: DataFrame, by: list[str], at: str, points: DataFrame, point: str, length: int = LENGTH) -> DataFrame:
    """df with passed: how many of the points of its group lie below each row's number at. points: by, point."""
    rows = df.withColumn("_at", F.col(at)).withColumn("_row", F.lit(True))
    marks = points.select(*by, F.col(point).alias("_at")).withColumn("_row", F.lit(False))
    both = rows.unionByName(marks, allowMissingColumns=True).withColumn("_late", F.col("_row").cast("int") * -1)  # a point at a row's number comes after it
    made = running(both, by, div(F.col("_at"), length), ["_at", "_late"], passed=("sum", F.when(F.col("_row"), 0).otherwise(1).cast("long")))
    return made.where("_row").drop("_at", "_row", "_late")
