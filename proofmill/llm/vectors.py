"""What the three vector operators share: which vectors take part, their integers, rounds written in turn."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.folders import shared_folder

#: Largest size of an integer component: below it, every sum of squares that the operators take is exact in 53 bits.
LARGEST = 1 << 22
SCALE = 256.0


def usable(vector: Column, dims: int) -> Column:
    """A vector of dims components, none null or non-finite; null and other vectors give false."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce((F.size(vector) == dims) & fine, F.lit(False))


def integers(vector: Column) -> Column:
    """floor(256 * x) of each component; one beyond LARGEST is an error, since distances would no longer be exact."""
    up = lambda x: F.floor(F.lit(SCALE) * x.cast("double"))
    bad = F.raise_error(F.lit(f"a component of 256 * vector is beyond {LARGEST}"))
    return F.transform(vector, lambda x: F.when(F.abs(up(x)) <= LARGEST, up(x)).otherwise(bad).cast("int"))


def matrix(column: pa.Array, width: int, kind: type = np.float64) -> np.ndarray:
    """A column of lists of one length as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(kind, copy=False).reshape(-1, width)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The rows of a matrix as a column of lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel(), kind))


class Rounds:
    """A state table written anew each round: the round before goes once its successor is whole.

    The rows of a round lie in the shared folder, so a lost executor costs the
    tasks that it ran and no earlier round.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.at = spark, None

    def put(self, df: DataFrame) -> DataFrame:
        at, before = shared_folder(self.spark), self.at
        df.write.parquet(at)
        self.at = at
        if before:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        return self.spark.read.schema(df.schema).parquet(at)
