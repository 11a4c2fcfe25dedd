"""Zones as walls with a reach: which of them touch, and which points their union shuts in.

walls: id (long), zone, x1, y1, x2, y2, reach: everything within reach of the segment is closed. A zone has one row per edge;
a closed wall is convex, which is what the test of enclosure rests on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ductwork.functions import geometry
from ductwork.operators import ranks, spatial, trees
from ductwork.storage import stored

ENDS = ("x1", "y1", "x2", "y2")


def foot(px: Column, py: Column, s: tuple[Column, ...], whole: Column) -> tuple[Column, Column]:
    """The point of a segment that is nearest to a point."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - s[0]) * (s[2] - s[0]) + (py - s[1]) * (s[3] - s[1])) / whole))
    return s[0] + t * (s[2] - s[0]), s[1] + t * (s[3] - s[1])


def touching(walls: DataFrame, cell: float = 100.0) -> DataFrame:
    """Pairs of walls that have a point in common: a, b (ids, a < b), x, y (such a point)."""
    reach = walls.agg(F.max("reach")).first()[0]
    if reach is None:
        return walls.select(F.col("id").alias("a"), F.col("id").alias("b"), F.col("x1").alias("x"), F.col("y1").alias("y"))
    rows = walls.select(F.struct("id", "reach").alias("id"), *ENDS)
    near = spatial.segments_near(rows, rows, 2.0 * reach, cell).where("left_id.id < right_id.id and d2 <= pow(left_id.reach + right_id.reach, 2)")
    one, two = tuple(map(F.col, ENDS)), tuple(F.col(f"r_{c}") for c in ENDS)
    near = near.withColumn("whole", geometry.span_square(*one)).withColumn("r_whole", geometry.span_square(*two))
    share = F.coalesce(F.try_divide(F.col("left_id.reach"), F.col("left_id.reach") + F.col("right_id.reach")), F.lit(0.0))

    def between(p: tuple[Column, Column], q: tuple[Column, Column]) -> Column:  # p on the left wall, q on the right one
        return F.struct(geometry.square_distance(*p, *q).alias("d2"), (p[0] + share * (q[0] - p[0])).alias("x"), (p[1] + share * (q[1] - p[1])).alias("y"))

    ways = [between(one[k : k + 2], foot(*one[k : k + 2], two, F.col("r_whole"))) for k in (0, 2)] + [between(foot(*two[k : k + 2], one, F.col("whole")), two[k : k + 2]) for k in (0, 2)]
    ux, uy, vx, vy = one[2] - one[0], one[3] - one[1], two[2] - two[0], two[3] - two[1]
    t = F.try_divide((two[0] - one[0]) * vy - (two[1] - one[1]) * vx, ux * vy - uy * vx)
    met = F.struct(F.lit(0.0).alias("d2"), (one[0] + t * ux).alias("x"), (one[1] + t * uy).alias("y"))
    at = F.when(geometry.segments_cross(one, two) & t.isNotNull(), met).otherwise(F.array_min(F.array(*ways)))
    pairs = near.withColumn("at", at).select(F.col("left_id.id").alias("a"), F.col("right_id.id").alias("b"), "at.x", "at.y")
    return pairs.dropDuplicates(["a", "b"]) if walls.groupBy("id").count().where("count > 1").limit(1).count() else pairs  # else each pair stands once


def unions(walls: DataFrame, cell: float = 100.0) -> DataFrame:
    """The connected parts of the union of all walls: id of each wall and part (the smallest id in it)."""
    found = trees.components(touching(walls, cell).select("a", "b"))
    return walls.select("id").join(found.withColumnRenamed("node", "id").hint("merge"), "id", "left").select("id", F.coalesce("comp", "id").alias("part"))


def odd(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """1 if the ray from a point towards growing x crosses a segment, else 0."""
    side = geometry.cross(x1, y1, x2, y2, px, py)
    return (((y1 > py) != (y2 > py)) & (F.when(y2 > y1, side).otherwise(-side) > 0)).cast("long")


def enclosed(points: DataFrame, walls: DataFrame, within: float = 2000.0, cell: float = 100.0) -> DataFrame:
    """Points that the union of the walls within `within` metres shuts in: id, n_zones (zones in the enclosing parts), first_zone.

    points: id, x, y. A point inside a wall's reach is not judged: it lies in a zone, which is another fault. Nulls in a place take
    no part, rows that repeat count once, and without points or walls nothing is enclosed.

    A closed union keeps a point from infinity exactly if a closed path in it crosses a ray from the point an odd number of times.
    Walls are convex and don't hold the point, so between two fixed places of a wall every path crosses equally often: a path is
    the walls it visits. Each wall stands twice, for even and odd; two that touch are linked even to even or even to odd by what the
    way from one to the other crosses; an odd closed path exists where both copies of a wall are connected. Only parts whose box
    (of the walls near enough) holds the point are looked at."""
    walls = stored(walls.where(" and ".join(f"{c} is not null" for c in ("id", "reach", *ENDS))).dropDuplicates(["id"]))
    points = points.where("id is not null and x is not null and y is not null").dropDuplicates(["id"])
    links = stored(touching(walls, cell))
    parts = trees.components(links.select("a", "b")).select(F.col("node").alias("id"), F.col("comp").alias("part"))
    held = walls.join(parts, "id")  # a wall that touches no other shuts nothing in
    dots = points.select("id", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    deepest = walls.agg(F.max("reach")).first()[0] or 0.0
    covered = spatial.segments_near(dots, walls.select(F.struct("id", "reach").alias("id"), *ENDS), deepest, cell, dots=True)
    covered = covered.where("d2 <= pow(right_id.reach, 2)").select(F.col("left_id").alias("id")).distinct()
    free = dots.join(covered, "id", "left_anti")
    near = spatial.segments_near(free, held.select(F.struct("id", "part", "reach").alias("id"), *ENDS), within, max(cell, within / 4), dots=True)
    near = stored(near.select(F.col("left_id").alias("point"), F.col("x1").alias("px"), F.col("y1").alias("py"), "right_id.part", F.col("right_id.id").alias("wall"), "right_id.reach", *[F.col(f"r_{c}").alias(c) for c in ENDS]))
    low = lambda c: F.min(F.least(f"{c}1", f"{c}2") - F.col("reach"))
    high = lambda c: F.max(F.greatest(f"{c}1", f"{c}2") + F.col("reach"))
    around = near.groupBy("point", "part").agg(*[(low(c) < F.first(f"p{c}")).alias(f"{c}_low") for c in "xy"], *[(high(c) > F.first(f"p{c}")).alias(f"{c}_high") for c in "xy"])
    near = near.join(around.where("x_low and x_high and y_low and y_high").select("point", "part"), ["point", "part"])
    # a number for each wall at each point; twice that and one more are its even and odd copies
    near = stored(ranks.ranked(near.select("point", "px", "py", "wall", F.col("x1").alias("x"), F.col("y1").alias("y")), [F.col("point"), F.col("wall")]))
    a, b = near.select("point", "px", "py", F.col("wall").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("__rank").alias("m")), near.select("point", F.col("wall").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("__rank").alias("n"))
    ways = a.join(links, "a").join(b, ["point", "b"])
    here = (F.col("px"), F.col("py"))
    ways = ways.select("m", "n", (odd(*here, F.col("ax"), F.col("ay"), F.col("x"), F.col("y")) + odd(*here, F.col("x"), F.col("y"), F.col("bx"), F.col("by"))).bitwiseAND(F.lit(1)).alias("change"))
    copies = ways.select(F.explode(F.array(*[F.struct((2 * F.col("m") + s).alias("a"), (2 * F.col("n") + F.col("change").bitwiseXOR(F.lit(s))).alias("b")) for s in (0, 1)])).alias("e")).select("e.a", "e.b")
    joined = trees.components(copies).groupBy(F.shiftright("node", 1).alias("__rank")).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n"))
    shut = near.join(joined.where("n = 2 and lo = hi"), "__rank").select(F.col("point").alias("id"), F.col("wall"))
    return shut.join(walls.select(F.col("id").alias("wall"), "zone"), "wall").groupBy("id").agg(F.countDistinct("zone").alias("n_zones"), F.min("zone").alias("first_zone"))
