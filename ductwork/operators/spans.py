"""Interval operators along a line: merging, sweeping, covered length, overlap, turns and stations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ductwork.functions import geometry
from ductwork.storage import stored


def merge_spans(spans: DataFrame, keys: list[str], start: str, end: str, weight: str, gap: float = 1e-6) -> DataFrame:
    """Overlapping spans of a key become one (gaps up to gap close), with the largest weight: keys, start, end, weight, n_spans."""
    order = Window.partitionBy(*keys).orderBy(start, end, weight)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.where(F.col(end) >= F.col(start)).withColumn("__new", F.when(F.col(start) <= reach + gap, 0).otherwise(1))
    island = marked.withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.max(weight).alias(weight), F.count(F.lit(1)).alias("n_spans")).drop("__island")


def dyadic_cover(first: Column, last: Column) -> Column:
    """The whole numbers first to last - 1 as blocks (level, block): block b of level l holds b * 2^l and the 2^l - 1 numbers after it. At most two blocks a level."""
    begin = lambda l: F.ceil(first / F.pow(F.lit(2.0), l)).cast("long")
    end = lambda l: F.floor(last / F.pow(F.lit(2.0), l)).cast("long")
    block = lambda l, at: F.struct(l.alias("level"), at.alias("block"))
    levels = F.sequence(F.lit(0), F.ceil(F.log2(last.cast("double") + 1)).cast("int"))
    both = F.transform(levels, lambda l: F.array(F.when((begin(l) < end(l)) & (begin(l) % 2 == 1), block(l, begin(l))), F.when((begin(l) < end(l)) & (end(l) % 2 == 1), block(l, end(l) - 1))))
    return F.filter(F.flatten(both), lambda x: x.isNotNull())


def sweep(spans: DataFrame, keys: list[str], start: str, end: str, weight: str) -> DataFrame:
    """A line is cut at every span bound; each covered piece has the number of spans over it and their largest weight.

    A span is laid on a binary tree over the key's pieces, as at most two blocks a level, and a piece looks up the one block of
    each level that holds it: n spans cost n log n rows, however much they overlap."""
    bounds = spans.select(*keys, F.col(start).alias("at")).union(spans.select(*keys, F.col(end).alias("at"))).distinct()
    order = Window.partitionBy(*keys).orderBy("at")
    numbered = bounds.withColumn("until", F.lead("at").over(order)).withColumn("__no", (F.row_number().over(order) - 1).cast("long"))
    first = numbered.select(*keys, F.col("at").alias(start), F.col("__no").alias("__from"))
    last = numbered.select(*keys, F.col("at").alias(end), F.col("__no").alias("__to"))
    laid = spans.where(F.col(end) > F.col(start)).join(first, [*keys, start]).join(last, [*keys, end])
    laid = laid.select(*keys, weight, F.explode(dyadic_cover(F.col("__from"), F.col("__to"))).alias("__b"))
    laid = laid.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("n_active"), F.max(weight).alias(weight))
    most = numbered.groupBy(*keys).agg(F.ceil(F.log2(F.max("__no").cast("double") + 1)).cast("int").alias("__levels"))
    level = F.explode(F.transform(F.sequence(F.lit(0), F.col("__levels")), lambda l: F.struct(l.alias("level"), F.floor(F.col("__no") / F.pow(F.lit(2.0), l)).cast("long").alias("block"))))
    looked = numbered.where("until is not null").join(most, keys).select(*keys, "at", "until", level.alias("__b"))
    return looked.join(laid, [*keys, "__b"]).groupBy(*keys, "at", "until").agg(F.sum("n_active").alias("n_active"), F.max(weight).alias(weight))


def covered_length(spans: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Length of the union of a key's spans: keys, covered."""
    merged = merge_spans(spans.withColumn("__w", F.lit(0)), keys, start, end, "__w", gap=0)
    return merged.groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).alias("covered"))


def overlap_share(left: DataFrame, right: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """How much of the shorter of two span sets the other covers: keys, common, share. Both sets are merged first."""
    merge = lambda df: merge_spans(df.withColumn("__w", F.lit(0)), keys, start, end, "__w", gap=0).drop("__w", "n_spans")
    a, b = merge(left), merge(right)
    size = lambda df, name: df.groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).alias(name))
    # both sets are disjoint within themselves: two spans over a piece means one of each
    both = sweep(a.union(b).withColumn("__w", F.lit(0)), keys, start, end, "__w").where("n_active = 2").groupBy(*keys).agg(F.sum(F.col("until") - F.col("at")).alias("common"))
    sizes = size(a, "__a").join(size(b, "__b"), keys)
    return sizes.join(both, keys, "left").select(*keys, F.coalesce("common", F.lit(0)).alias("common"), F.try_divide(F.coalesce("common", F.lit(0)), F.least("__a", "__b")).alias("share"))


def vertex_turns(points: DataFrame, keys: list[str], order_by: str, x: str, y: str) -> DataFrame:
    """The turn at each inner vertex of a polyline, in degrees, with the vertex: keys, order_by, turn. Repeated points are passed over."""
    order = Window.partitionBy(*keys).orderBy(order_by)
    moved = points.withColumn("__dx", F.col(x) - F.lag(x).over(order)).withColumn("__dy", F.col(y) - F.lag(y).over(order))
    moved = moved.where("__dx is null or __dx <> 0 or __dy <> 0")
    turn = geometry.deflection(F.col("__dx"), F.col("__dy"), F.lead("__dx").over(order), F.lead("__dy").over(order))
    return moved.withColumn("turn", turn).where("turn is not null").select(*keys, order_by, "turn")


def count_turns(turns: DataFrame, keys: list[str], least: float = 3.0) -> DataFrame:
    """Turns of at least so many degrees and the sharpest turn: keys, n_turns, max_turn."""
    return turns.groupBy(*keys).agg(F.count_if(F.col("turn") >= least).alias("n_turns"), F.max("turn").alias("max_turn"))


def stations(points: DataFrame, keys: list[str], order_by: str, x: str, y: str) -> DataFrame:
    """Distance along a polyline up to each vertex: adds station."""
    order = Window.partitionBy(*keys).orderBy(order_by)
    step = F.sqrt(geometry.square_distance(F.col(x), F.col(y), F.lag(x).over(order), F.lag(y).over(order)))
    return points.withColumn("__step", F.coalesce(step, F.lit(0.0))).withColumn("station", F.sum("__step").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__step")


def cut(lines: DataFrame, spans: DataFrame, keys: list[str], start: str, end: str, weight: str, snap: float = 0.08, sliver: float = 0.2) -> DataFrame:
    """Lines (keys, length) cut where covered spans begin and end: keys, at, until, weight (null where nothing covers), n.

    Bounds within snap of a line's end move to it; uncovered pieces of at most sliver between covered ones take the greater weight
    beside them; neighbours of equal weight become one piece. n numbers the pieces along the line from 1."""
    inside = spans.join(lines.select(*keys, "length"), keys)
    to_end = lambda c: F.when(c <= snap, F.lit(0.0)).when(c >= F.col("length") - snap, F.col("length")).otherwise(c)
    snapped = inside.select(*keys, to_end(F.greatest(F.lit(0.0), F.col(start))).alias(start), to_end(F.least(F.col("length"), F.col(end))).alias(end), weight).where(F.col(end) > F.col(start))
    covered = sweep(snapped, keys, start, end, weight).select(*keys, "at", "until", weight)
    order = Window.partitionBy(*keys).orderBy("at")
    bounds = covered.select(*keys, "at", "until").union(lines.select(*keys, F.lit(0.0).alias("at"), F.lit(0.0).alias("until"))).union(lines.select(*keys, F.col("length").alias("at"), F.col("length").alias("until")))
    reach = F.max("until").over(Window.partitionBy(*keys).orderBy("at", "until").rowsBetween(Window.unboundedPreceding, -1))
    gaps = bounds.withColumn("__to", F.col("at")).withColumn("__from", reach).where("__to > __from").select(*keys, F.col("__from").alias("at"), F.col("__to").alias("until"), F.lit(None).cast(dict(covered.dtypes)[weight]).alias(weight))
    pieces = covered.unionByName(gaps)
    thin = F.col(weight).isNull() & (F.col("until") - F.col("at") <= sliver)
    beside = F.when(F.lag(weight).over(order).isNotNull() & F.lead(weight).over(order).isNotNull(), F.greatest(F.lag(weight).over(order), F.lead(weight).over(order)))
    pieces = pieces.withColumn("__w", F.when(thin, beside).otherwise(F.col(weight)))
    fresh = F.when(F.col("__w").eqNullSafe(F.lag("__w").over(order)) & (F.row_number().over(order) > 1), 0).otherwise(1)
    marked = pieces.withColumn("__fresh", fresh).withColumn("n", F.sum("__fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "n").agg(F.min("at").alias("at"), F.max("until").alias("until"), F.max("__w").alias(weight))


def spill(spans: DataFrame, edges: DataFrame, margin: float, rounds: int = 64) -> DataFrame:
    """Spans (edge, lo, hi, weight) grown by margin at both ends along the network: what runs past an edge's end goes on into every edge at that node.

    edges: edge, a, b, length (a at station 0, b at length). Returns edge, lo, hi, weight, cut to each edge."""
    grown = spans.join(edges, "edge").select("edge", "a", "b", "length", (F.col("lo") - margin).alias("lo"), (F.col("hi") + margin).alias("hi"), "weight")
    own = lambda df: df.select("edge", F.greatest(F.lit(0.0), F.col("lo")).alias("lo"), F.least("length", F.col("hi")).alias("hi"), "weight")
    found = stored(own(grown))
    past = lambda df: df.where("lo < 0").select("edge", F.col("a").alias("node"), (-F.col("lo")).alias("left"), "weight").union(df.where("hi > length").select("edge", F.col("b"), F.col("hi") - F.col("length"), "weight"))
    front = stored(past(grown).groupBy("edge", "node", "weight").agg(F.max("left").alias("left")))
    at = edges.select("edge", F.col("a").alias("node"), "a", "b", "length", F.lit(True).alias("at_a")).union(edges.select("edge", F.col("b"), "a", "b", "length", F.lit(False)))
    for _ in range(rounds):
        if not front.limit(1).count():
            return found
        into = at.join(front.withColumnRenamed("edge", "from_edge"), "node").where("edge <> from_edge")
        into = into.select("edge", "a", "b", "length", F.when(F.col("at_a"), 0.0).otherwise(F.col("length") - F.col("left")).alias("lo"), F.when(F.col("at_a"), F.col("left")).otherwise(F.col("length")).alias("hi"), "weight")
        into = stored(into)
        found = stored(found.unionByName(own(into)))
        front = stored(past(into).groupBy("edge", "node", "weight").agg(F.max("left").alias("left")))
    raise RuntimeError(f"a margin of {margin} m passes over more than {rounds} edges")
