"""Features kept by place: Parquet with the box of each feature, sorted along a Z curve, so that a reader of an extent skips row groups.

The two passes of a plan's input: the extent of points and pipes first (one aggregate), then only the obstacles within it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOX = ("x_min", "y_min", "x_max", "y_max")
#: Steps of the Z curve on each axis: 16 bits, so a key has 32.
STEPS = 1 << 16


def boxed(features: DataFrame) -> DataFrame:
    """Adds the box of parts (array of arrays of struct(x, y)); null without points."""
    xs, ys = F.transform(F.flatten("parts"), lambda p: p["x"]), F.transform(F.flatten("parts"), lambda p: p["y"])
    return features.withColumns(dict(zip(BOX, (F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)), strict=True)))


def spread_bits(v: Column) -> Column:
    """The 16 bits of a whole number, each followed by an empty one."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def extent(rows: DataFrame) -> tuple[float, float, float, float] | None:
    """The box of all boxes, or None without any."""
    found = rows.agg(F.min("x_min"), F.min("y_min"), F.max("x_max"), F.max("y_max")).first()
    return None if found[0] is None else tuple(map(float, found))


def keep(rows: DataFrame, path: str, row_group_bytes: int = 8 << 20) -> None:
    """Writes rows that have boxes, near ones together: ranges of the Z key of the boxes' middles, sorted within each file.

    Rows without a box are kept too, in front. A file's row groups then cover small areas, and their ranges of x_min … y_max, which
    Parquet keeps, prune them. A hot place costs nothing: many rows with one key fill as many row groups as they need, in one task's sort that spills."""
    whole = extent(rows) or (0.0, 0.0, 1.0, 1.0)
    step = max(whole[2] - whole[0], whole[3] - whole[1], 1e-9) / (STEPS - 1)
    axis = lambda low, high, start: spread_bits(F.floor(((F.col(low) + F.col(high)) / 2 - start) / step).cast("long"))
    key = axis("x_min", "x_max", whole[0]).bitwiseOR(F.shiftleft(axis("y_min", "y_max", whole[1]), 1))
    placed = rows.withColumn("__z", key).repartitionByRange("__z", *BOX).sortWithinPartitions("__z").drop("__z")
    placed.write.option("parquet.block.size", row_group_bytes).parquet(path)


def within(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None, grow: float = 0.0) -> DataFrame:
    """The kept rows whose box meets the given one, grown on all sides; none without a box. The four comparisons reach the scan."""
    rows = spark.read.parquet(path)
    if box is None:
        return rows.where(F.lit(False))
    return rows.where((F.col("x_max") >= box[0] - grow) & (F.col("y_max") >= box[1] - grow) & (F.col("x_min") <= box[2] + grow) & (F.col("y_min") <= box[3] + grow))
