"""Ranks over all rows or within groups without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ductwork.storage import durable


def ranked(df: DataFrame, order: list[Column], partitions: int | None = None) -> DataFrame:
    """Adds __rank, the row's place (from 0) in the global order.

    A range exchange sorts the rows; each partition numbers its own; the partitions' sizes, one number each, are summed up.
    The sorted rows are kept in the checkpoint folder, as range bounds come from a sample and mustn't be drawn twice."""
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = durable(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", F.coalesce(F.expr("sum(__n) over (order by __part rows between unbounded preceding and 1 preceding)"), F.lit(0)).alias("__before"))
    return rows.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn("__rank", F.col("__before") + place).drop("__part", "__at", "__before")


def ranked_within(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """Adds __place (from 0) within the group and __n, the group's size. A group may be larger than a task."""
    rows = ranked(df, [F.col(group), *order])
    own = rows.groupBy(group).agg(F.min("__rank").alias("__first"), F.count(F.lit(1)).alias("__n"))
    return rows.join(own, group).withColumn("__place", F.col("__rank") - F.col("__first")).drop("__rank", "__first")
