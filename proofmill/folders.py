"""The shared folder: where results are written when lineage must end."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir; where that is unset, below a temporary one, in a local session only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not found.isDefined() and not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = found.get() if found.isDefined() else "file://" + tempfile.mkdtemp(prefix="proofmill-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/proofmill/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: lineage ends, nothing is computed twice."""
    spark = df.sparkSession
    at = shared_folder(spark)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)
