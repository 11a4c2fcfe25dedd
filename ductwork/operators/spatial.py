"""Spatial joins as equi-joins on grid cells; no pair is compared unless it shares a cell."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ductwork.functions import geometry
from ductwork.operators.ranks import ranked
from ductwork.storage import durable


def cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


def cells_of_box(x1: Column, y1: Column, x2: Column, y2: Column, size: float) -> Column:
    """All cells that a box meets, as an array of struct(cx, cy)."""
    across, up = F.sequence(cell(x1, size), cell(x2, size)), F.sequence(cell(y1, size), cell(y2, size))
    return F.flatten(F.transform(across, lambda cx: F.transform(up, lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))


def around(df: DataFrame, x: str, y: str, radius: float, size: float) -> DataFrame:
    """The rows once per cell within radius of their point."""
    box = cells_of_box(F.col(x) - radius, F.col(y) - radius, F.col(x) + radius, F.col(y) + radius, size)
    return df.withColumn("__cell", F.explode(box))


def shares(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that share a cell. Both sides are dealt out by cell, however small they seem: a plan's guess doesn't know how many cells a row meets, so
    a side that it takes for small may not fit the driver, and few rows may make many pairs."""
    parts = shares(left)
    return left.repartition(parts, *keys).join(right.repartition(parts, *keys).hint("merge"), keys)


def within_distance(left: DataFrame, right: DataFrame, radius: float, names: tuple[str, str] = ("x", "y"), ids: tuple[str, str] = ("id", "id")) -> DataFrame:
    """Pairs (left_id, right_id, d2) of points at most radius apart. left: id, x, y; right likewise."""
    x, y = names
    a = around(left.select(F.col(ids[0]).alias("left_id"), F.col(x).alias("__x"), F.col(y).alias("__y")), "__x", "__y", radius, radius).select("left_id", "__x", "__y", "__cell.cx", "__cell.cy")
    b = right.select(F.col(ids[1]).alias("right_id"), F.col(x).alias("__u"), F.col(y).alias("__v")).withColumns({"cx": cell(F.col("__u"), radius), "cy": cell(F.col("__v"), radius)})
    d2 = geometry.square_distance(F.col("__x"), F.col("__y"), F.col("__u"), F.col("__v"))
    return joined(a, b, ["cx", "cy"]).withColumn("d2", d2).where(F.col("d2") <= radius * radius).select("left_id", "right_id", "d2")


def pairs_within(points: DataFrame, radius: float, id_column: str = "id") -> DataFrame:
    """Unordered pairs (left_id < right_id) of one point set at most radius apart."""
    return within_distance(points, points, radius, ids=(id_column, id_column)).where("left_id < right_id")


def links_within(points: DataFrame, radius: float) -> DataFrame:
    """Links (a, b) with the same connected parts, and the same nodes, as all pairs of points (id, x, y) at most radius apart, but far fewer.

    Points of a square whose diagonal is below radius hang on the square's smallest id; two squares are linked once if any of their points are near enough."""
    side = radius / 1.5
    rows = points.where("id is not null").select("id", "x", "y", cell(F.col("x"), side).alias("sx"), cell(F.col("y"), side).alias("sy")).where("sx is not null and sy is not null")
    named = rows.join(rows.groupBy("sx", "sy").agg(F.min("id").alias("first")).hint("merge"), ["sx", "sy"])
    across = within_distance(named, named, radius, ids=("first", "first")).where("left_id < right_id").select(F.col("left_id").alias("a"), F.col("right_id").alias("b")).distinct()
    return named.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).union(across)


def close_radius(rows: DataFrame, x: Column, y: Column, first_radius: float, most: int) -> float:
    """first_radius, made smaller until no square of that side holds more than `most` places: all rows are counted, wherever they crowd."""
    places, radius = rows.select(x.alias("x"), y.alias("y")).distinct(), float(first_radius)
    for _ in range(30):
        full = places.groupBy(cell(F.col("x"), radius), cell(F.col("y"), radius)).count().agg(F.max("count")).first()[0] or 0
        if full <= most:
            break
        radius /= max(2, 2 ** int(math.log2((full / most) ** 0.5)))
    return radius


def nearest(left: DataFrame, right: DataFrame, k: int, first_radius: float, rings: int = 30) -> DataFrame:
    """The k nearest right points of each left point: left_id, right_id, d2, rank; ties to the smaller right_id.

    The search starts at first_radius, or nearer where the right points crowd. Of right points in one place only the k smallest ids can be among the nearest."""
    a, b = left.select("id", "x", "y"), right.select("id", "x", "y")
    b = b.withColumn("__r", F.row_number().over(Window.partitionBy("x", "y").orderBy("id"))).where(F.col("__r") <= k).drop("__r")
    d2 = geometry.square_distance(F.col("x"), F.col("y"), F.col("__u"), F.col("__v"))
    far = lambda rest: spread_pairs(rest, b.select(F.col("id").alias("right_id"), F.col("x").alias("__u"), F.col("y").alias("__v"))).select(F.col("id").alias("left_id"), "right_id", d2.alias("d2"))
    return growing(a, lambda rest, radius: within_distance(rest, b, radius), far, b.select("x", "y"), k, close_radius(b, F.col("x"), F.col("y"), first_radius, 4 * k + 4), rings)


def nearest_segments(points: DataFrame, segments: DataFrame, k: int, first_radius: float, rings: int = 30) -> DataFrame:
    """The k nearest segments (id, x1, y1, x2, y2) of each point (id, x, y), at any distance: left_id, right_id, d2, rank, piece (x1, y1, x2, y2).

    A right id with several pieces counts once, by its nearest piece. The search starts at first_radius, or nearer where the segments are dense."""
    a, b = points.select("id", "x", "y"), segments.select("id", "x1", "y1", "x2", "y2")
    piece = F.struct(*[F.col(f"r_{c}").alias(c) for c in ("x1", "y1", "x2", "y2")]).alias("piece")
    once = lambda pairs: pairs.groupBy("left_id", "right_id").agg(F.min(F.struct("d2", "piece")).alias("m")).select("left_id", "right_id", "m.d2", "m.piece")
    size, start = crossing_cells(b, first_radius, 4 * k + 4)

    def near(rest: DataFrame, radius: float) -> DataFrame:
        dots = rest.select("id", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"))
        return once(segments_near(dots, b, radius, max(radius, size), dots=True).select("left_id", "right_id", "d2", piece))

    def far(rest: DataFrame) -> DataFrame:
        all_ = spread_pairs(rest, b.select(F.col("id").alias("right_id"), *[F.col(c).alias(f"r_{c}") for c in ("x1", "y1", "x2", "y2")]))
        d2 = geometry.point_segment_square(F.col("x"), F.col("y"), F.col("r_x1"), F.col("r_y1"), F.col("r_x2"), F.col("r_y2"))
        return once(all_.select(F.col("id").alias("left_id"), "right_id", d2.alias("d2"), piece))

    ends = b.select(F.col("x1").alias("x"), F.col("y1").alias("y")).union(b.select("x2", "y2"))
    return growing(a, near, far, ends, k, start, rings)


def crossing_cells(segments: DataFrame, first_radius: float, most: int) -> tuple[float, float]:
    """Side of cells and first radius for a search of nearest segments: (first_radius, first_radius) unless segments are dense.

    The side is halved until a cell that segments meet is met, on average, by at most 64 times `most`;
    the radius then shrinks with the segments a cell of its side is met by in the densest cell."""
    ends = tuple(map(F.col, ("x1", "y1", "x2", "y2")))
    rows = segments.where("x1 is not null and y1 is not null and x2 is not null and y2 is not null").select("x1", "y1", "x2", "y2").repartition(shares(segments), "x1", "y1", "x2", "y2")
    size = float(first_radius)
    for _ in range(30):
        met = rows.select(F.explode(cells_of_line(*ends, 1e-6, size)).alias("c")).groupBy("c.cx", "c.cy").count().agg(F.max("count"), F.avg("count")).first()
        if not met[0] or met[1] <= 64 * most:
            break
        size /= 2
    # a line that meets a cell of some side meets one of half that side with half the chance
    return size, min(float(first_radius), size * min(1.0, most / met[0]) if met[0] and met[0] > most else size)


def growing(left: DataFrame, near, far, right_points: DataFrame, k: int, first_radius: float, rings: int) -> DataFrame:
    """k nearest by growing rings: near(rest, radius) gives the pairs within a radius, far(rest) all pairs.

    The radius quadruples until every left row has k neighbours within it; rows that have them leave the search, so only
    stragglers see wide rings. Once a ring spans both sets, the stragglers meet all of the right side, shared out over tasks."""
    extent = left.select("x", "y").union(right_points).agg(F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    farthest = ((extent[0] or 0) ** 2 + (extent[1] or 0) ** 2) ** 0.5 + 1
    order = Window.partitionBy("left_id").orderBy("d2", "right_id")
    top = lambda pairs: pairs.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
    found, radius, rest = [], float(first_radius), left
    for _ in range(rings):
        if radius >= farthest / 2:
            break
        ring = durable(top(near(rest, radius)))
        full = ring.groupBy("left_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("left_id")
        found.append(ring.join(full.hint("merge"), "left_id", "left_semi"))
        rest = durable(rest.join(full.withColumnRenamed("left_id", "id").hint("merge"), "id", "left_anti"))
        if rest.limit(1).count() == 0:
            return reduce(DataFrame.unionByName, found)
        radius *= 4
    return reduce(DataFrame.unionByName, [*found, durable(top(far(rest)))])


def groups_by_distance(points: DataFrame, segments: DataFrame, first_radius: float) -> DataFrame:
    """Groups of points in the order of their least distance from a network: group_id, d2, place (from 0; ties to the smaller group).

    points: id, x, y, group_id; a group whose points have no place, or any group where there are no segments, isn't listed."""
    near = nearest_segments(points.where("x is not null and y is not null"), segments, 1, first_radius)
    least = near.join(points.select(F.col("id").alias("left_id"), "group_id"), "left_id").groupBy("group_id").agg(F.min("d2").alias("d2"))
    return ranked(least, [F.col("d2"), F.col("group_id")]).select("group_id", "d2", F.col("__rank").alias("place"))


def spread_pairs(few: DataFrame, many: DataFrame, most: int = 64) -> DataFrame:
    """Every row of few with every row of many (right_id, …): many is dealt out by hash, few stands at every share."""
    n = min(most, shares(few))
    dealt = many.withColumn("__share", F.pmod(F.xxhash64("right_id"), F.lit(n)))
    return few.withColumn("__share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).join(dealt, "__share").drop("__share")


def points_in_boxes(points: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """Pairs (point_id, box_id): points id, x, y; boxes id, x1, y1, x2, y2, bounds included."""
    a = points.select(F.col("id").alias("point_id"), "x", "y", cell(F.col("x"), size).alias("cx"), cell(F.col("y"), size).alias("cy"))
    b = boxes.select(F.col("id").alias("box_id"), "x1", "y1", "x2", "y2").withColumn("__cell", F.explode(cells_of_box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), size)))
    return joined(a, b.select("box_id", "x1", "y1", "x2", "y2", "__cell.cx", "__cell.cy"), ["cx", "cy"]).where("x between x1 and x2 and y between y1 and y2").select("point_id", "box_id")


def points_in_polygons(points: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """Pairs (point_id, polygon_id): polygons id and ring (array of struct(x, y), closed) or rings (array of those: holes and further polygons count by parity); the boundary counts as inside.

    Triangles and quadrangles go as plain columns, whose test compiles; only other shapes carry their rings."""
    if "rings" not in polygons.columns:
        polygons = polygons.select("id", F.array("ring").alias("rings"))
    xs, ys = F.transform(F.flatten("rings"), lambda p: p["x"]), F.transform(F.flatten("rings"), lambda p: p["y"])
    one = F.get("rings", F.lit(0))
    few = F.coalesce((F.size("rings") == 1) & F.size(one).isin(4, 5) & F.forall(one, lambda p: p["x"].isNotNull() & p["y"].isNotNull()), F.lit(False))
    corner = lambda i: F.coalesce(F.get(one, F.lit(i)), F.element_at(one, -1)) if i > 3 else F.get(one, F.lit(i))
    boxed = polygons.select(F.col("id").alias("polygon_id"), "rings", few.alias("__few"), F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))
    placed = points.where("x is not null and y is not null").select(F.col("id").alias("point_id"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in "xy"])
    a = placed.withColumns({"cx": cell(F.col("x"), size), "cy": cell(F.col("y"), size)})

    def held(some: DataFrame, inside: Column) -> DataFrame:
        b = some.withColumn("__cell", F.explode(cells_of_box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), size))).withColumns({"cx": F.col("__cell.cx"), "cy": F.col("__cell.cy")}).drop("__cell")
        near = joined(a, b, ["cx", "cy"]).where("x between x1 and x2 and y between y1 and y2")
        return near.select("point_id", "polygon_id", F.explode(F.array(inside)).alias("__in")).where("__in").select("point_id", "polygon_id")

    plain = boxed.where("__few").select("polygon_id", "x1", "y1", "x2", "y2", *[F.coalesce(corner(i)[c].cast("double"), F.lit(0.0)).alias(f"{c}_{i}") for i in range(5) for c in "xy"])
    at = [(F.col(f"x_{i}"), F.col(f"y_{i}")) for i in range(5)]
    plain = plain.select("*", *[geometry.span_square(*at[i], *at[i + 1]).alias(f"whole_{i}") for i in range(4)])
    simple = held(plain, geometry.in_corners(F.col("x"), F.col("y"), at, [F.col(f"whole_{i}") for i in range(4)]))
    return simple.union(held(boxed.where("not __few").drop("__few"), geometry.in_rings(F.col("x"), F.col("y"), F.col("rings"))))


def cells_of_line(x1: Column, y1: Column, x2: Column, y2: Column, grow: float, size: float) -> Column:
    """The cells that a line, as wide as grow on every side, can meet: column by column, the rows between its heights there."""
    low, high = F.least(x1, x2), F.greatest(x1, x2)
    height = lambda x: F.when(x1 == x2, y1).otherwise(y1 + (y2 - y1) * (x - x1) / (x2 - x1))

    def column(cx: Column) -> Column:
        a = height(F.greatest(low, F.least(high, cx * size - grow)))
        b = F.when(x1 == x2, y2).otherwise(height(F.least(high, F.greatest(low, (cx + 1) * size + grow))))
        return F.transform(F.sequence(cell(F.least(a, b) - grow, size), cell(F.greatest(a, b) + grow, size)), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))

    return F.flatten(F.transform(F.sequence(cell(low - grow, size), cell(high + grow, size)), column))


def segments_near(left: DataFrame, right: DataFrame, radius: float, size: float, dots: bool = False, same: tuple[str, ...] = (), deal: bool = True) -> DataFrame:
    """Pairs (left_id, right_id, d2) of segments at most radius apart: id, x1, y1, x2, y2 on both sides. dots: the left ones are points (x1, y1 repeated);
    same: fields of both ids that must be equal; deal: segments are shared out before their cells are worked out, as a few long ones, which
    may lie in one task, meet many cells (not needed for many short ones).

    Both go to the cells that they meet, the left one widened by radius, so a long slanting line costs its length and not its
    box. Pairs in a cell are first judged by their boxes, in the join; the distance follows in a step of its own, which keeps the
    optimizer from copying it into the join's condition: as one, they outgrow the methods that the JVM compiles. A pair that shares
    several cells is given in one only, that of the right segment's point next to the left one, so pairs are neither sorted nor sent anywhere.
    Rows that repeat in all of id and place count once."""
    ends = ("x1", "y1", "x2", "y2")
    keys = ["cx", "cy", *(f"__s{i}" for i in range(len(same)))]

    def spread(df: DataFrame, name: str, prefix: str, grow: float) -> DataFrame:
        rows = df.where(" and ".join(f"{c} is not null" for c in ends)).select(F.col("id").alias(name), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(prefix + c) for c in ends])
        here = tuple(F.col(prefix + c) for c in ends)
        rows = rows.repartition(shares(df), *here) if deal else rows
        rows = rows.withColumn("__cells", cells_of_line(*here, grow, size)).withColumn(f"{prefix}__alone", F.size("__cells") == 1)
        rows = rows.select("*", F.explode("__cells").alias("__cell")).select(name, *[prefix + c for c in ends], f"{prefix}__alone", "__cell.cx", "__cell.cy", *[F.col(f"{name}.{f}").alias(f"__s{i}") for i, f in enumerate(same)])
        rows = rows.repartition(shares(df), *keys).dropDuplicates([name, *[prefix + c for c in ends], *keys])  # rows that repeat meet in a cell
        return rows.withColumn(f"{prefix}__whole", geometry.span_square(*here))

    a, b = tuple(map(F.col, ends)), tuple(F.col(f"r_{c}") for c in ends)
    pairs = spread(left, "left_id", "", radius + 1e-6).join(spread(right, "right_id", "r_", 1e-6).hint("merge"), keys).where(geometry.boxes_within(a, b, radius))
    square = geometry.point_reach_square(a[0], a[1], *b, F.col("r___whole")) if dots else geometry.segment_reach_square(a, b, F.col("__whole"), F.col("r___whole"))
    both = ("left_id", *ends, "right_id", *[f"r_{c}" for c in ends])
    near = pairs.select("*", F.explode(F.array(square)).alias("d2")).where(F.col("d2") <= radius * radius)
    alone = F.col("__alone") | F.col("r___alone")
    share = geometry.foot_share(a[0], a[1], *b, F.col("r___whole")) if dots else geometry.nearest_share(a, b, F.col("__whole"), F.col("r___whole"), F.col("d2"))
    at = near.select(*both, "d2", "cx", "cy", alone.alias("__once"), F.explode(F.array(F.when(alone, F.lit(0.0)).otherwise(share))).alias("__t"))
    here = (cell(b[0] + F.col("__t") * (b[2] - b[0]), size) == F.col("cx")) & (cell(b[1] + F.col("__t") * (b[3] - b[1]), size) == F.col("cy"))
    return at.where(F.col("__once") | here).select(*both, "d2")


def coincident(points: DataFrame, step: float = 0.01) -> DataFrame:
    """Groups of points that round to the same multiple of step (metres): kx, ky, n, ids (sorted). A step under a metre counts as a whole number
    of steps a metre, and places are scaled once, so that halves stay halves."""
    scaled = lambda c: F.col(c) * float(round(1 / step)) if step < 1 else F.col(c) / float(step)
    key = lambda c: F.floor(scaled(c) + 0.5).cast("long")
    return points.groupBy(key("x").alias("kx"), key("y").alias("ky")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("id")).alias("ids")).where("n > 1")
