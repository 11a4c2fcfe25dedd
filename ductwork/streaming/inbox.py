"""The job inbox: files that arrive in a folder become jobs, are checked, and their states are appended to a table.

A job is QUEUED when its file is seen, then FAILED with its diagnostics or DONE. The stream's checkpoint makes a restart go on
where it stopped; the latest state of a job is its status.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

STORED_ERRORS = 1000


def start(spark: SparkSession, folder: str, table_path: str, checkpoint: str, check) -> StreamingQuery:
    """Watches folder. check(spark, path) gives a DataFrame of diagnostics (feature_id, field, problem) of one file."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder).select("path", "modificationTime")

    def states(batch: DataFrame, epoch: int) -> None:
        for row in batch.collect():  # file names of one trigger; the files themselves are read by Spark
            found = check(batch.sparkSession, row.path).limit(STORED_ERRORS).select(F.to_json(F.struct("feature_id", "field", "problem")).alias("e")).collect()
            last = "FAILED" if found else "DONE"
            rows = [(row.path, s, 2 * epoch + i, [r.e for r in found] if s == "FAILED" else []) for i, s in enumerate(("QUEUED", last))]
            batch.sparkSession.createDataFrame(rows, "job string, status string, seq long, errors array<string>").withColumn("at", F.current_timestamp()).write.mode("append").parquet(table_path)

    return files.writeStream.foreachBatch(states).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(jobs: DataFrame) -> DataFrame:
    """The latest state of each job."""
    return jobs.groupBy("job").agg(F.max_by(F.struct("status", "errors", "at"), "seq").alias("s")).select("job", "s.status", "s.errors", "s.at")


def fail_orphans(jobs: DataFrame) -> DataFrame:
    """Rows that fail the jobs a crash left QUEUED or RUNNING, to be appended after a restart."""
    open_ = jobs.groupBy("job").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq")).where("status in ('QUEUED', 'RUNNING')")
    return open_.select("job", F.lit("FAILED").alias("status"), (F.col("seq") + 1).alias("seq"), F.array(F.lit("interrupted")).alias("errors"), F.current_timestamp().alias("at"))
