"""Running streams under control: pause and cooldown between batches, progress rows, and one consistent cut of several streams."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from contextlib import contextmanager, suppress

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: What a control row says to hold a run.
HOLDS = ("paused", "cooling", "stopped", "cancelled")
CONTROL_SCHEMA = "batch bigint, status string, not_before timestamp"
PROGRESS_SCHEMA = "query string, batch bigint, input_rows bigint, observed string"

Control = Callable[[int], str | None]


@contextmanager
def state_in_rocksdb(spark: SparkSession):
    """Queries started inside keep their state on disk, as transformWithState asks."""
    name, provider = ROCKSDB
    before = spark.conf.get(name)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Held(RuntimeError):
    """A control stopped the stream before a batch."""


def control_table(spark: SparkSession, at: str) -> Control:
    """The control rows below `at` are read before each batch.

    Of the rows that hold from a batch number not above the next batch, the last
    one appended for the largest number counts; a status of HOLDS or a not_before
    that lies ahead holds the run.  No rows: go on.
    """

    def ask(batch: int) -> str | None:
        rows = spark.read.schema(CONTROL_SCHEMA).json(at).filter(F.coalesce("batch", F.lit(0)) <= batch)
        ordered = F.struct(F.coalesce("batch", F.lit(0)), F.col("_metadata.file_modification_time"), F.monotonically_increasing_id())
        last = rows.select("status", (F.col("not_before") > F.current_timestamp()).alias("ahead"), ordered.alias("at")).agg(F.max_by(F.struct("status", "ahead"), "at").alias("c")).first().c
        return None if last is None else last.status if last.status in HOLDS else "cooling" if last.ahead else None

    return ask


def run_controlled(stream: DataFrame, at: str, control: Control | None = None, mode: str = "append", progress: str | None = None) -> str:
    """Run a stream to the end of its input or until control holds it; returns done or the status that held it.

    control is asked before a batch writes anything.  A held batch stays planned
    in the checkpoint and is the first one of the next run, with the same rows;
    committed ones are not run again.  progress is where the rows of T17 go.
    """
    spark = stream.sparkSession
    held: list[str] = []

    def put(batch: DataFrame, number: int) -> None:
        status = control(number) if control else None
        if status:
            held.append(status)
            raise Held(status)
        batch.write.mode("overwrite").parquet(f"{at}/rows/batch={number}")

    listener = ProgressRows(spark, progress) if progress else None
    if listener:
        spark.streams.addListener(listener)
    try:
        with state_in_rocksdb(spark):
            query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
        try:
            query.awaitTermination()
        except StreamingQueryException:
            if not held:
                raise
    finally:
        if listener:
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
            spark.streams.removeListener(listener)
    return held[0] if held else "done"


def sink_rows(spark: SparkSession, at: str, schema: T.StructType, last: int | None = None) -> DataFrame:
    """Rows of the committed batches of a run, up to `last`; a batch that was written but not committed isn't there."""
    end = committed_batch(spark, at) if last is None else last
    rows = T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])
    if end < 0:
        return spark.createDataFrame([], rows)
    return spark.read.schema(rows).parquet(f"{at}/rows").filter(F.col("batch") <= end)


def committed_batch(spark: SparkSession, at: str) -> int:
    """The last batch up to which all are committed; -1 if none is."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/checkpoint/commits")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = {f.getPath().getName() for f in fs.listStatus(folder)} if fs.exists(folder) else set()
    numbers = sorted(int(n) for n in names if n.isdigit())
    return numbers[-1] if numbers else -1


def consistent_cut(spark: SparkSession, runs: Sequence[str]) -> int:
    """The largest batch that all runs have committed."""
    return min(committed_batch(spark, at) for at in runs)


def finalized(spark: SparkSession, runs: Sequence[tuple[str, T.StructType]]) -> tuple[list[DataFrame], dict]:
    """The rows of each run up to the cut that all share, and what is left out.

    Rows of batches beyond the cut, committed or not, are in no result, so a run
    that is ahead, or one that stopped within a batch, changes nothing.
    """
    cut = consistent_cut(spark, [at for at, _ in runs])
    ahead = {at: committed_batch(spark, at) - cut for at, _ in runs}
    return [sink_rows(spark, at, schema, cut) for at, schema in runs], {"cut": cut, "status": "partial" if any(ahead.values()) or cut < 0 else "complete", "ahead": list(ahead.values())}


class ProgressRows(StreamingQueryListener):
    """One row appended for each batch: its number, its input rows and what the stream observed.

    A row that can't be written is dropped: progress never stops a run.
    """

    def __init__(self, spark: SparkSession, at: str) -> None:
        self.spark, self.at = spark, at

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if p.numInputRows == 0 and not p.observedMetrics:
            return
        row = (str(p.id), p.batchId, p.numInputRows, json.dumps({k: v.asDict() for k, v in p.observedMetrics.items()}, default=str, sort_keys=True))
        with suppress(Exception):
            self.spark.createDataFrame([row], PROGRESS_SCHEMA).coalesce(1).write.mode("append").json(self.at)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass
