"""What the corpus operators share: table access, word patterns, checkpoints, distributed ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ductwork.operators.ranks import ranked  # noqa: F401  (shared with the core)
from ductwork.storage import durable, shared_folder  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word up to white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
#: What stands between words of letters, digits and anything beyond ASCII (after lower-casing).
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(col: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(col, UPPER, UPPER.lower())


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Keep Arrow batches of whole texts small: Spark counts rows, and texts may be long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def fingerprint(text: Column) -> Column:
    """Two independent 64-bit hashes of a text and its length: what stands for the text where a verdict is carried back to it."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("second"), text).alias("b"), F.length(text).alias("n"))


#: Keys that are broadcast, 8 to 50 bytes each.
MOST_BROADCAST = 500_000


def sized(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """A broadcast hint where the rows, counted, are at most so many; else the rows as they are, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def without(df: DataFrame, drop: DataFrame, key: str) -> DataFrame:
    """The rows whose key isn't in drop (durable, distinct keys); texts are shuffled only if drop is too large to broadcast."""
    return df.join(sized(drop), key, "left_anti").select(*df.columns)
