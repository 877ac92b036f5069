"""Results that a newer generation supersedes, in a stream with keyed state.

Each key's state holds the generation and order of its last result, so a row that comes late is known to be
superseded without reading what was written before, and a timer lets go of keys that have been quiet.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: The state of a stream is kept by this provider.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Latest(StatefulProcessor):
    """Lets a row by if its order is above all of its key before; the batch's best row of a key alone."""

    def __init__(self, columns: list[str], order: list[str], kinds: str, quiet_ms: int | None) -> None:
        self.columns, self.order, self.kinds, self.quiet_ms = columns, order, kinds, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", self.kinds)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 (names of the interface)
        now = tuple(self.seen.get()) if self.seen.exists() else None
        best, at = None, now
        for pdf in rows:
            for k, order in enumerate(zip(*(pdf[c].tolist() for c in self.order))):
                if at is None or order > at:
                    best, at = pdf.iloc[k : k + 1], order
        if best is None:
            return
        self.seen.update(at)
        if self.quiet_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)
        yield best[self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def latest_results(stream: DataFrame, key: list[str], order: list[str], quiet_ms: int | None = None) -> DataFrame:
    """The rows of a stream that supersede what their key had before, the best of a key in each batch. order: columns
    of whole numbers without nulls, compared one after the other (a generation first). A key that was quiet for
    quiet_ms is forgotten, for which Python is called for each key; None keeps all, by an aggregate alone, whose
    state is a key's best row with its batch's time: a key whose best row is of an earlier batch had nothing new."""
    if quiet_ms is None:
        rest = [c for c in stream.columns if c not in key]
        at = F.unix_micros(F.current_timestamp())
        best = F.max_by(F.struct(*rest, "_at"), F.struct(*order, (-F.col("_at")).alias("_at")))  # of equal orders the first batch's stays
        new = stream.withColumn("_at", at).groupBy(*key).agg(best.alias("_row")).where(F.col("_row._at") == at)
        return new.select(*(F.col(c if c in key else f"_row.{c}").alias(c) for c in stream.columns))
    kinds = T.StructType([stream.schema[c] for c in order])
    processor = _Latest(stream.columns, order, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds.fields), quiet_ms)
    return stream.groupBy(*key).transformWithStateInPandas(processor, stream.schema, "Update", "ProcessingTime")


def write_results(results: DataFrame, target: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Appends a stream's results as Parquet: all that is there now, or, with an interval such as "10 seconds", until it is
    stopped. Begun again with the same checkpoint it goes on where it stopped. Timers run with an interval alone.

    A batch's files bear its number. The first batch after a start may have been written before, in whole or in part;
    of it only the rows that aren't there are written."""
    spark, schema, begun = results.sparkSession, results.schema, []
    spark.createDataFrame([], schema).write.mode("ignore").parquet(target)

    def write(batch: DataFrame, number: int) -> None:
        name = f"batch{number}"
        if not begun:
            there = spark.read.schema(schema).option("pathGlobFilter", f"{name}-*").parquet(target)
            if not there.isEmpty():
                batch = batch.exceptAll(there)
        batch.write.mode("append").option("mapreduce.output.basename", name).parquet(target)
        begun.append(number)

    writer = results.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def current_results(spark: SparkSession, target: str, key: list[str], order: list[str]) -> DataFrame:
    """The last result of each key of what was written."""
    df = spark.read.parquet(target)
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*key, *(F.col(f"_row.{c}").alias(c) for c in rest))
