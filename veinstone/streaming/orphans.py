"""Orphan references over streams: file sources feed the keyed state of veinstone.operators.orphans.

An extension; the batch operator stays the one source of the semantics. Each micro-batch is one step whose
new state is written beside the old one, and a pointer file names the batch it belongs to, so a batch that is
repeated after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from veinstone.operators import orphans

EVENTS = "kind string, src_table string, src_field string, key string, at timestamp"


class StreamState:
    """The state after the last finished micro-batch, as Parquet folders under root."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def last(self) -> int:
        folder = self._path(self.root)
        if not self._fs.exists(folder):
            return -1
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n[6:]) for n in names if n.startswith("batch=") and self._fs.exists(self._path(f"{self.root}/{n}/_SUCCESS"))), default=-1)

    def read(self) -> DataFrame:
        last = self.last()
        return orphans.empty_state(self.spark) if last < 0 else self.spark.read.schema(orphans.STATE_SCHEMA).parquet(f"{self.root}/batch={last}")

    def advance(self, batch: DataFrame, number: int) -> None:
        if number <= self.last():
            return
        refs = batch.filter("kind = 'reference'")
        references = [orphans.Reference(refs, F.col("src_table"), F.col("src_field"), F.col("key"), F.col("at"))]
        state = orphans.step(
            self.read(), references, parents=(batch.filter("kind = 'parent'"), F.col("key"), F.col("at")), deletions=(batch.filter("kind = 'deletion'"), F.col("key"), F.col("at"))
        )
        state.write.mode("overwrite").parquet(f"{self.root}/batch={number}")
        for old in range(max(0, number - 3), number - 1):
            self._fs.delete(self._path(f"{self.root}/batch={old}"), True)


def track(spark: SparkSession, events: DataFrame, state_root: str, checkpoint: str, on_counts: Callable[[DataFrame, int], None] | None = None, once: bool = True) -> StreamingQuery:
    """Starts the query over a stream with the columns of EVENTS; on_counts gets the counts after each batch."""
    state = StreamState(spark, state_root)

    def each(batch: DataFrame, number: int) -> None:
        state.advance(batch.persist(), number)
        batch.unpersist()
        if on_counts is not None:
            on_counts(orphans.counts(state.read()), number)

    writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if once else writer).start()


def activity(events: DataFrame, at: str, late: str = "2 hours", width: str = "1 day") -> DataFrame:
    """Rows per window of a stream, with a watermark for late ones."""
    return events.withWatermark(at, late).groupBy(F.window(at, width)).agg(F.count("*").alias("n"))
