"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir. Where none is set, a local session takes a temporary one; on a cluster that is an error."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named is None and context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return named or context._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """The rows, written to the shared folder as Parquet and read back. Unlike a checkpoint's, the new plan's size is the files';
    in a loop of joins an estimate would multiply at every round.

    instead_of: what stored() gave in the round before. Its files are deleted once the new ones stand, so a loop keeps one round on disk."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if instead_of is not None:
        deleted(spark, instead_of.__dict__.get("stored_at"))
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["stored_at"] = path
    return out


def deleted(spark: SparkSession, path: str | None) -> None:
    """Deletes a folder, in whatever store it lies."""
    if path:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
