"""Structured Streaming operators: idempotent application, keyed tree state, late data, deduplication, pairing.

Event order is data: state keeps the largest sequence or time seen, so replays
and late rows change nothing.  Queries run to the end of their input with
`available_now`; a checkpoint makes a rerun continue where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofmill.folders import shared_folder
from proofmill.streaming.control import run_controlled
from proofmill.streaming.trees import tree_state  # noqa: F401  kept here for callers


def available_now(stream: DataFrame, mode: str = "append", at: str | None = None) -> DataFrame:
    """Run a stream to the end of its input and return all rows of its sink.

    Each micro-batch is written to a folder of its own number, so a batch that
    is repeated after a failure replaces itself (T01, K10).
    """
    spark = stream.sparkSession
    at = at or shared_folder(spark)
    run_controlled(stream, at, mode=mode)
    return spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{at}/rows")


def latest_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last state that an update stream wrote for each key."""
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col("batch")).alias("_v")).select(*keys, "_v.*")


def newest(stream: DataFrame, key: str, time: str, arrival: str, value: str) -> DataFrame:
    """For each key the value with the latest (time, arrival); a late row never overwrites it."""
    return stream.groupBy(key).agg(F.max_by(F.struct(F.col(time), F.col(arrival), F.col(value)), F.struct(time, arrival)).alias("_v")).select(key, "_v.*")


def unique_events(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def paired(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, delay: str, apart: str) -> DataFrame:
    """Rows of two streams with equal keys at most `apart` from each other; unmatched ones leave state by watermark."""
    a, b = left.withWatermark(left_time, delay), right.withWatermark(right_time, delay)
    near = F.expr(f"{right_time} BETWEEN {left_time} - INTERVAL {apart} AND {left_time} + INTERVAL {apart}")
    same = near
    for k in keys:
        same = same & (a[k] == b[k])
    return a.join(b, same).drop(*[b[k] for k in keys])


def back_off_ms(failures, base_ms: int = 10_000, most: int = 3):
    """Wait before the next try after so many failures in a row; NULL after the last allowed one."""
    return F.when((failures >= 1) & (failures < most), base_ms * F.pow(F.lit(2), failures - 1)).cast("bigint")


def replay_committed(journal: DataFrame, key: list[str], order: list[str], ok: str) -> tuple[DataFrame, DataFrame]:
    """Rows to apply again, from committed pages only, in order; failed ones stay as evidence."""
    return journal.filter(F.col(ok)).repartition(*key).sortWithinPartitions(*key, *order), journal.filter(~F.col(ok))
