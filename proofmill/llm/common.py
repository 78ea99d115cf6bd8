"""Small helpers the operators share: Arrow mapping, identifiers, folds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.folders import shared_folder, written  # noqa: F401  the operators take them from here
from proofmill.llm import textgrid as tg


#: Bytes of whole texts that one Arrow batch holds; one longer text is a batch of its own.
BATCH_BYTES = "4m"
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Keep batches of texts small on both sides of the Arrow transfer, unless the session says how large they are.

    By default a batch holds 10,000 rows: tens of megabytes of texts, several
    times over in an executor and its Python workers.
    """
    if spark.conf.get(_BATCH_SETTING, None) is None:
        spark.conf.set(_BATCH_SETTING, BATCH_BYTES)


def map_slices(
    df: DataFrame,
    text: str,
    keep: list[str],
    fn: Callable[[tg.Slice, pa.RecordBatch], list[pa.Array] | None],
    schema: str,
) -> DataFrame:
    """Run fn on bounded slices of whole texts; fn returns the arrays of schema.

    fn gets the slice and the kept columns of the same rows.  It runs once for
    each slice, so its memory follows the slice and not the table.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others = pa.RecordBatch.from_arrays([batch.column(i + 1) for i in range(len(keep))], names=keep) if keep else None
            for part in tg.text_slices(batch.column(0)):
                rows = others.slice(part.lo, part.rows) if keep else None
                got = fn(part, rows)
                if got is not None:
                    yield pa.RecordBatch.from_arrays(got, names=names)

    return df.select(F.col(text).alias("_text"), *[F.col(c) for c in keep]).mapInArrow(run, schema)


def whole_row(df: DataFrame) -> Column:
    """All columns of df as one struct: beside it an operator's own names clash with none of them."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def longs(a: np.ndarray) -> pa.Array:
    return pa.array(a.astype(np.int64, copy=False))


def signed(a: np.ndarray) -> pa.Array:
    """A 64-bit hash as Spark's long, bit for bit."""
    return pa.array(a.view(np.int64))


def fold_of(id_column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % folds
