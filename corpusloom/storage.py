"""Lineage cuts that survive lost executors.

Both helpers write to the folder that the cluster names in ``spark.checkpoint.dir``.
Only where that setting is absent (local tests) a temporary folder of the driver is used.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints; set once for sessions that name none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
    if not local:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def checkpoint(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint for narrow results; the cleaner may drop it with the frame."""
    shared = shared_dir(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Unlike a checkpoint, later readers can prune columns. The folder's retention
    rule removes the files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
