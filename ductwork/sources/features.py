"""Feature collections: scan, typed tables, diagnostics, and the writer.

A collection is read line by line (one feature a line) or, if it is one document, by exploding its features array; every check
is a filter or an anti-join whose rows are diagnostics (feature_id, field, problem). Missing attributes and JSON nulls are the
same. Positions become metres (UTM) at once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ductwork.functions import geometry
from ductwork.operators import spatial, trees
from ductwork.operators.ranks import ranked
from ductwork.rules import Rules, half_up
from ductwork.storage import durable, stored

#: Object types and the geometries each may have.
GEOMETRIES = {
    "source": ("Point",),
    "heat_network": ("LineString", "MultiLineString"),
    "heat_chamber": ("Point",),
    "oks_future": ("Polygon", "MultiPolygon"),
    "oks_connection_point": ("Point",),
    "oks_existing": ("Polygon", "MultiPolygon"),
    "restriction": ("Point", "LineString", "MultiLineString", "Polygon", "MultiPolygon"),
}
JOINT, WALL = 0.5, 0.01


def scan(spark: SparkSession, path: str) -> DataFrame:
    """ord, raw: each feature's JSON text. Lines that hold one feature are split without parsing; a single document is exploded."""
    lines = spark.read.text(path).where(F.trim("value").rlike(r'^\{.*"type"\s*:\s*"Feature"'))
    by_line = lines.select(F.regexp_replace(F.trim("value"), r",\s*$", "").alias("raw"))
    whole = by_line.where(F.col("raw").rlike(r'"type"\s*:\s*"FeatureCollection"') | F.from_json("raw", "type string").isNull()).limit(1).count() or not by_line.limit(1).count()
    if whole:
        text = spark.read.text(path, wholetext=True)
        raw = text.select(F.posexplode(F.from_json(F.get_json_object("value", "$.features"), "array<string>")).alias("ord", "raw"))
        return raw.select(F.col("ord").cast("long").alias("ord"), "raw")
    # a line's ordinal: the lines of earlier blocks, one count a block, and its place in its own
    blocks = lines.select(F.regexp_replace(F.trim("value"), r",\s*$", "").alias("raw"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"))
    sizes = blocks.groupBy("__file", "__block").agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("__first"))
    before = sizes.select("__file", "__block", "__first", F.expr("coalesce(sum(n) over (order by __file, __block rows between unbounded preceding and 1 preceding), 0)").alias("__before"))
    return blocks.join(F.broadcast(before), ["__file", "__block"]).select((F.col("__before") + F.col("__at") - F.col("__first")).alias("ord"), "raw")


@dataclass
class Dataset:
    """Typed tables of one collection and what is wrong with it."""

    features: DataFrame
    sources: DataFrame
    segments: DataFrame
    chambers: DataFrame
    consumers: DataFrame
    connection_points: DataFrame
    restrictions: DataFrame
    diagnostics: DataFrame
    warnings: DataFrame


def rings(kind: Column, coordinates: Column) -> Column:
    """Coordinates of any geometry as an array of parts, each an array of struct(x, y) in metres. Points have one part of one."""
    pair = lambda p: F.struct(*[c.alias(n) for n, c in zip(("x", "y"), geometry.to_utm(F.get(p, F.lit(0)), F.get(p, F.lit(1))), strict=True)])
    line = lambda l: F.transform(l, pair)
    point = F.array(F.array(pair(F.from_json(coordinates, "array<double>"))))
    one = F.array(line(F.from_json(coordinates, "array<array<double>>")))
    many = F.transform(F.from_json(coordinates, "array<array<array<double>>>"), line)
    nested = F.transform(F.flatten(F.from_json(coordinates, "array<array<array<array<double>>>>")), line)
    return F.when(kind == "Point", point).when(kind == "LineString", one).when(kind.isin("MultiLineString", "Polygon"), many).when(kind == "MultiPolygon", nested)


def parse(raw: DataFrame) -> DataFrame:
    """ord, id, id_is_number, object_type, geom_type, parts, props."""
    f = F.from_json("raw", "struct<type:string,geometry:struct<type:string,coordinates:string>,properties:map<string,string>>")
    top = F.coalesce(F.get_json_object("raw", "$.properties.id"), F.get_json_object("raw", "$.id"))
    quoted = F.from_json("raw", "struct<id:string,properties:struct<id:string>>", {"allowNumericLeadingZeros": "false"})
    own = F.from_json("raw", "struct<id:variant,properties:struct<id:variant>>")
    typed = F.schema_of_variant(F.coalesce(own["properties"]["id"], own["id"]))
    number = F.coalesce(typed.rlike("^(BIGINT|INT|DOUBLE|DECIMAL)"), F.lit(False)) & F.coalesce(quoted["properties"]["id"], quoted["id"]).isNotNull()
    out = raw.select("ord", "raw", f.alias("f"), top.alias("id"), number.alias("id_is_number"))
    prop = lambda k: F.get_json_object("raw", f"$.properties.{k}")
    known = ("diameter", "flow_tph", "heat_load", "upstream_object_id", "oks_id", "restriction_type")
    out = out.select("ord", F.coalesce("id", F.concat(F.lit("#"), F.col("ord") + 1)).alias("feature_id"), "id", "id_is_number", F.coalesce(prop("object_type"), F.get_json_object("raw", "$.object_type")).alias("object_type"), F.col("f.geometry.type").alias("geom_type"), F.col("f.geometry.coordinates").alias("coordinates"), *[prop(k).alias(k) for k in known])
    return out.withColumn("parts", rings(F.col("geom_type"), F.col("coordinates"))).drop("coordinates")


def merged_line(parts: Column) -> Column:
    """Parts of a line joined end to end, turned where that is needed: struct(line, rest), rest holding the parts that touch neither end."""
    same = lambda p, q: (p["x"] == q["x"]) & (p["y"] == q["y"])
    head, tail = lambda l: F.get(l, F.lit(0)), lambda l: F.element_at(l, -1)
    after = lambda l: F.slice(l, F.lit(2), F.size(l))

    def join(acc: Column, _: Column) -> Column:
        line, rest = acc["line"], acc["rest"]
        how = F.transform(rest, lambda p: F.when(same(tail(line), head(p)), 1).when(same(tail(line), tail(p)), 2).when(same(head(line), tail(p)), 3).when(same(head(line), head(p)), 4).otherwise(0))
        at = F.array_position(F.transform(how, lambda h: h > 0), True).cast("int")
        part, fits = F.get(rest, at - 1), F.get(how, at - 1)
        longer = F.when(fits == 1, F.concat(line, after(part))).when(fits == 2, F.concat(line, after(F.reverse(part)))).when(fits == 3, F.concat(part, after(line))).when(fits == 4, F.concat(F.reverse(part), after(line))).otherwise(line)
        fewer = F.when(at > 0, F.concat(F.slice(rest, F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice(rest, at + 1, F.size(rest)))).otherwise(rest)
        return F.struct(longer.alias("line"), fewer.alias("rest"))

    start = F.struct(head(parts).alias("line"), after(parts).alias("rest"))
    return F.when(F.size(parts) > 0, F.aggregate(parts, start, join))


def edges_of(rows: DataFrame, keep: list[str]) -> DataFrame:
    """One row per straight edge of all parts: kept columns, ring, i, x1, y1, x2, y2."""
    ring = rows.select(*keep, F.posexplode("parts").alias("ring", "r")).where(F.size("r") > 1)
    each = ring.select(*keep, "ring", "r", F.explode(F.sequence(F.lit(0), F.size("r") - 2)).alias("i"))
    a, b = F.get("r", F.col("i")), F.get("r", F.col("i") + 1)
    return each.select(*keep, "ring", "i", a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))


def self_crossing(polygons: DataFrame, cell: float = 100.0) -> DataFrame:
    """feature_id of polygons of which a ring crosses itself; edges meet only within their ring and cell."""
    ends = ("x1", "y1", "x2", "y2")
    e = edges_of(polygons, ["feature_id"]).withColumn("__cell", F.explode(spatial.cells_of_line(*map(F.col, ends), 1e-6, cell)))
    other = e.select("feature_id", "ring", "__cell", F.col("i").alias("j"), *[F.col(c).alias(f"r_{c}") for c in ends])
    crossing = geometry.segments_cross(tuple(map(F.col, ends)), tuple(F.col(f"r_{c}") for c in ends))
    return e.join(other, ["feature_id", "ring", "__cell"]).where("i < j").where(crossing).select("feature_id").distinct()


def geometry_problem(parts: Column, geom_type: Column) -> Column:
    """Why a geometry can't be used, or null: no coordinates, too few points, an open ring, a line of no length."""
    polygon, line = geom_type.isin("Polygon", "MultiPolygon"), geom_type.isin("LineString", "MultiLineString")
    empty = parts.isNull() | (F.size(parts) == 0) | F.exists(parts, lambda p: F.exists(p, lambda q: q["x"].isNull() | q["y"].isNull()))
    short = F.exists(parts, lambda p: F.size(p) < F.when(polygon, 4).when(line, 2).otherwise(1))
    open_ = F.exists(parts, lambda p: (F.get(p, F.lit(0))["x"] != F.element_at(p, -1)["x"]) | (F.get(p, F.lit(0))["y"] != F.element_at(p, -1)["y"]))
    flat = F.exists(parts, lambda p: geometry.line_length(p) == 0)
    return F.when(empty, "no usable coordinates").when(short, "too few points").when(polygon & open_, "ring is not closed").when(line & flat, "line has no length")


def read(spark: SparkSession, path: str, rules: Rules | None = None) -> Dataset:
    """The typed tables and all diagnostics of one collection; with any diagnostic, nothing should be planned on it."""
    rules = rules or Rules()
    f = durable(parse(scan(spark, path)))  # parsed once for all tables and checks
    known = f.where(F.col("object_type").isin(*GEOMETRIES))
    says = lambda df, field, problem: df.select("feature_id", F.lit(field).alias("field"), (F.lit(problem) if isinstance(problem, str) else problem).alias("problem"))
    allowed = F.coalesce(*[F.when(F.col("object_type") == k, F.col("geom_type").isin(*v)) for k, v in GEOMETRIES.items()])
    dn, flow = F.col("diameter").try_cast("double"), F.col("flow_tph").try_cast("double")
    faults = [
        says(f.where("object_type is null"), "object_type", "missing"),
        says(known.where("id is null"), "id", "missing"),
        says(known.where(~F.coalesce(allowed, F.lit(False))), "geometry", "wrong geometry type"),
        says(known.where(F.coalesce(allowed, F.lit(False))).withColumn("why", geometry_problem(F.col("parts"), F.col("geom_type"))).where("why is not null"), "geometry", F.col("why")),
        says(known.where("object_type = 'heat_network'").where(dn.isNull() | (dn <= 0) | (dn != F.floor(dn))), "diameter", "not a positive whole number"),
        says(known.where("object_type = 'oks_future'").where(flow.isNull() | (flow < 0)), "flow_tph", "not a number of at least 0"),
        says(known.where("object_type = 'oks_connection_point' and oks_id is null").where(flow.isNull() | (flow < 0)), "flow_tph", "not a number of at least 0"),
        says(known.where("object_type = 'restriction' and restriction_type is null"), "restriction_type", "missing"),
    ]
    shapes = known.where(F.coalesce(allowed, F.lit(False)))
    faults.append(says(self_crossing(shapes.where("geom_type in ('Polygon', 'MultiPolygon')")), "geometry", "a ring crosses itself"))
    faults.append(says(shapes.where("object_type = 'heat_network' and size(parts) > 1").where(F.size(merged_line(F.col("parts"))["rest"]) > 0), "geometry", "parts do not join to one line"))
    ids = f.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    faults.append(says(ids.withColumnRenamed("id", "feature_id"), "id", "stands twice"))
    named = lambda kinds: f.where(F.col("object_type").isin(*kinds)).select(F.col("id").alias("ref")).distinct()
    points = known.where("object_type = 'oks_connection_point'")
    faults.append(says(points.where("oks_id is not null").join(named(("oks_future",)), F.col("oks_id") == F.col("ref"), "left_anti"), "oks_id", "names no building"))
    upward = known.where("object_type in ('heat_network', 'heat_chamber') and upstream_object_id is not null")
    faults.append(says(upward.join(named(("heat_network", "heat_chamber", "source")), F.col("upstream_object_id") == F.col("ref"), "left_anti"), "upstream_object_id", "names no upstream object"))
    pointers = upward.where("upstream_object_id is not null and id is not null").groupBy(F.col("id").alias("node")).agg(F.min("upstream_object_id").alias("parent"))
    faults.append(says(trees.cycle_nodes(pointers).select(F.col("cycle").alias("feature_id")).distinct(), "upstream_object_id", "upstream objects form a cycle"))
    warned = [
        f.where("object_type is not null").where(~F.col("object_type").isin(*GEOMETRIES)).groupBy("object_type").agg(F.count(F.lit(1)).alias("n")).select(F.concat_ws(" ", F.lit("unknown object type"), "object_type", F.col("n").cast("string")).alias("warning")),
        known.where("object_type = 'restriction'").where(~F.col("restriction_type").isin(*[k for k in rules.restrictions if k != "_fallback"])).groupBy("restriction_type").agg(F.count(F.lit(1)).alias("n")).select(F.concat_ws(" ", F.lit("unknown restriction type"), "restriction_type", F.col("n").cast("string")).alias("warning")),
    ]
    at = F.get(F.get("parts", F.lit(0)), F.lit(0))
    point = lambda kind: known.where(F.col("object_type") == kind).withColumns({"x": at["x"], "y": at["y"]})
    segments = known.where("object_type = 'heat_network'").select("id", merged_line(F.col("parts"))["line"].alias("pts"), rules.snap_up(dn).alias("dn"), flow.alias("flow_tph"), F.col("upstream_object_id").alias("upstream_id"))
    chambers = point("heat_chamber").select("id", "x", "y", rules.snap_up(dn).alias("dn"), F.col("upstream_object_id").alias("upstream_id"))
    buildings = known.where("object_type = 'oks_future'").select(F.col("id").alias("oks_id"), "ord", F.col("parts").alias("rings"), flow.alias("flow_tph"), F.col("heat_load").try_cast("double").alias("heat_load"))
    cps = point("oks_connection_point").select(F.col("id").alias("cp_id"), "x", "y", "oks_id", flow.alias("own_flow"))
    return Dataset(
        f, point("source").select("id", "x", "y"), segments, inferred_chambers(chambers, segments), buildings, assign_buildings(cps, buildings),
        known.where("object_type in ('restriction', 'oks_existing')").select("id", F.coalesce("restriction_type", F.lit("oks_existing")).alias("restriction_type"), "geom_type", "parts"),
        reduce(DataFrame.union, faults), reduce(DataFrame.union, warned),
    )


def pieces(segments: DataFrame) -> DataFrame:
    """One row per straight piece: id, dn, i, x1, y1, x2, y2."""
    each = segments.where(F.size("pts") > 1).select("id", "dn", "pts", F.explode(F.sequence(F.lit(0), F.size("pts") - 2)).alias("i"))
    a, b = F.get("pts", F.col("i")), F.get("pts", F.col("i") + 1)
    return each.select("id", "dn", "i", a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))


def inferred_chambers(chambers: DataFrame, segments: DataFrame) -> DataFrame:
    """Chambers without a diameter take the largest of the pipes within JOINT; those that none touches go."""
    dots = chambers.where("dn is null").select("id", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    lines = pieces(segments).select(F.struct("id", "dn").alias("id"), "x1", "y1", "x2", "y2")
    most = spatial.segments_near(dots, lines, JOINT, 50.0, dots=True).groupBy(F.col("left_id").alias("id")).agg(F.max("right_id.dn").alias("near_dn"))
    return chambers.join(most, "id", "left").select("id", "x", "y", F.coalesce("dn", "near_dn").alias("dn"), "upstream_id").where("dn is not null")


def assign_buildings(points: DataFrame, buildings: DataFrame) -> DataFrame:
    """Connection points with their building: the one named, else the first that contains the point, else the nearest wall within WALL; and the flow to serve."""
    loose = points.where("oks_id is null").select(F.col("cp_id").alias("id"), "x", "y")
    inside = spatial.points_in_polygons(loose, buildings.select(F.struct("ord", "oks_id").alias("id"), "rings"), 50.0).groupBy(F.col("point_id").alias("cp_id")).agg(F.min("polygon_id").alias("b")).select("cp_id", F.col("b.oks_id").alias("found"))
    dots = loose.join(inside.select(F.col("cp_id").alias("id")), "id", "left_anti").select("id", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    walls = edges_of(buildings.select("ord", "oks_id", F.col("rings").alias("parts")), ["ord", "oks_id"]).select(F.struct("ord", "oks_id").alias("id"), "x1", "y1", "x2", "y2")
    at_wall = spatial.segments_near(dots, walls, WALL, 50.0, dots=True).groupBy(F.col("left_id").alias("cp_id")).agg(F.min(F.struct("d2", "right_id")).alias("m")).select("cp_id", F.col("m.right_id.oks_id").alias("found"))
    named = points.join(inside.unionByName(at_wall), "cp_id", "left").withColumn("oks_id", F.coalesce("oks_id", "found")).drop("found")
    return named.join(buildings.select("oks_id", "flow_tph"), "oks_id", "left").select("cp_id", "x", "y", "oks_id", F.coalesce("own_flow", "flow_tph").alias("flow_tph"))


def orient(sources: DataFrame, segments: DataFrame, chambers: DataFrame | None = None, rounds: int = 100_000) -> DataFrame:
    """Upstream of each pipe, found from the sources on over ends within JOINT: id, upstream, step. Unreached pipes are left out.

    Upstream is the chamber at the joint, if there is one, else the pipe before. Where ends lead no further, tees do: an end on the
    middle of another pipe, whichever of the two is reached; so does a source on a pipe's middle."""
    ends = segments.select("id", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.get("pts", F.lit(0)).alias("p")), F.struct(F.lit(1).alias("end"), F.element_at("pts", -1).alias("p")))).alias("e"))
    ends = durable(ends.select(F.struct("id", "e.end").alias("id"), F.col("e.p.x").alias("x"), F.col("e.p.y").alias("y")))
    joints = spatial.within_distance(ends, ends, JOINT).where("left_id.id <> right_id.id").select(F.col("left_id").alias("at"), F.col("right_id.id").alias("b"))
    if chambers is not None:
        own = spatial.within_distance(ends, chambers.select("id", "x", "y"), JOINT).groupBy(F.col("left_id").alias("at")).agg(F.min(F.struct("d2", F.col("right_id").alias("chamber"))).alias("c")).select("at", "c.chamber")
        joints = joints.join(own, "at", "left")
    else:
        joints = joints.withColumn("chamber", F.lit(None).cast("string"))
    by_end = durable(joints.groupBy(F.col("at.id").alias("a"), "b").agg(F.min("chamber").alias("chamber")))
    dots = lambda p: p.select("id", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    lines = pieces(segments).select("id", "x1", "y1", "x2", "y2")
    touch = spatial.segments_near(dots(ends), lines, JOINT, 50.0, dots=True).where("left_id.id <> right_id").select(F.col("left_id.id").alias("a"), F.col("right_id").alias("b")).distinct()
    touch = touch.union(touch.select("b", "a")).distinct().join(by_end, ["a", "b"], "left_anti").withColumn("chamber", F.lit(None).cast("string"))
    by_tee = durable(touch)
    first = spatial.within_distance(sources, ends, JOINT).select(F.col("right_id.id").alias("id"), F.col("left_id").alias("upstream"))
    middle = spatial.segments_near(dots(sources), lines, JOINT, 50.0, dots=True).select(F.col("right_id").alias("id"), F.col("left_id").alias("upstream"))
    start = first.union(middle).groupBy("id").agg(F.min("upstream").alias("upstream"))
    reached = stored(start.withColumn("step", F.lit(0)))
    front, tees = reached, False
    for step in range(1, rounds):
        found = (by_tee if tees else by_end).join((reached if tees else front).select(F.col("id").alias("a")), "a").select(F.col("b").alias("id"), F.coalesce("chamber", "a").alias("upstream")).join(reached, "id", "left_anti")
        front = stored(found.groupBy("id").agg(F.min("upstream").alias("upstream")).withColumn("step", F.lit(step)))
        if front.limit(1).count():
            reached, tees = stored(reached.unionByName(front)), False
        elif tees:
            return reached
        else:
            tees = True
    raise RuntimeError(f"the network is deeper than {rounds} pipes")


def to_features(segments: DataFrame, variant: Column | None = None) -> DataFrame:
    """Output features as JSON text in order: coordinates to 9 digits, money and length to 2, flow to 3."""
    lon, lat = lambda p: geometry.to_wgs84(p["x"], p["y"])[0], lambda p: geometry.to_wgs84(p["x"], p["y"])[1]
    line = F.transform("pts", lambda p: F.array(lon(p).cast("decimal(12,9)"), lat(p).cast("decimal(12,9)")))
    props = F.struct("id", F.lit("heat_network").alias("object_type"), "variant_id", "start_node_id", "end_node_id", F.col("flow_tph").cast("decimal(12,3)").alias("flow_tph"), F.col("dn").alias("diameter"), half_up(F.col("length"), 2).cast("decimal(12,2)").alias("length"), "laying_method", F.col("cost").cast("decimal(18,2)").alias("cost"))
    return segments.select("variant_id", "id", F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), line.alias("coordinates")).alias("geometry"), props.alias("properties"))).alias("value"))


def node_features(nodes: DataFrame) -> DataFrame:
    """Chambers and technical nodes as output features: variant_id, id, kind (heat_chamber or technical_node), x, y, dn, cost, reason."""
    lon, lat = geometry.to_wgs84(F.col("x"), F.col("y"))
    point = F.struct(F.lit("Point").alias("type"), F.array(lon.cast("decimal(12,9)"), lat.cast("decimal(12,9)")).alias("coordinates"))
    props = F.struct("id", F.col("kind").alias("object_type"), "variant_id", F.col("dn").alias("diameter"), F.col("cost").cast("decimal(18,2)").alias("cost"), "reason")
    return nodes.select("variant_id", "id", F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), props.alias("properties"))).alias("value"))


def summary_features(summary: DataFrame) -> DataFrame:
    """One variant_summary feature, without geometry, per variant: money and length to 2 digits, score to 4."""
    scale = {"score": "decimal(12,4)", "rank": "int", "existing_chamber_tie_in_count": "int"}
    named = [F.col(c).cast(scale.get(c, "decimal(18,2)")).alias(c) for c in ("rank", "construction_cost", "chamber_construction_cost", "existing_chamber_tie_in_count", "existing_chamber_tie_in_cost", "unconnected_penalty", "calculated_cost", "new_network_length", "score") if c in summary.columns]
    lists = [F.col("unconnected_oks_ids")] if "unconnected_oks_ids" in summary.columns else []
    props = F.struct(F.lit("variant_summary").alias("object_type"), "variant_id", *named, *lists)
    value = F.concat(F.lit('{"type":"Feature","geometry":null,"properties":'), F.to_json(props), F.lit("}"))
    return summary.select("variant_id", F.lit("").alias("id"), value.alias("value"))


def criteria_json(criteria: DataFrame, key: str = "variant") -> DataFrame:
    """One JSON document a variant of its criteria; nulls are written as nulls."""
    rest = [c for c in criteria.columns if c != key]
    return criteria.select(key, F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("value"))


def write(features: DataFrame, path: str) -> None:
    """One feature a line, ordered by variant and id, as text parts that together are a collection's features; large results stay spread over files."""
    features.repartitionByRange("variant_id", "id").sortWithinPartitions("variant_id", "id").select("value").write.mode("overwrite").text(path)


def write_collection(parts: list[DataFrame], path: str) -> None:
    """One valid FeatureCollection as a single text file in the folder path: summaries, pipes, chambers and technical nodes, by variant, part and id.

    Rows stream through one task, in order, which one file asks for; the folder appears by the committer's rename, or not at all."""
    rows = reduce(DataFrame.unionByName, [p.withColumn("__part", F.lit(i)) for i, p in enumerate(parts)])
    numbered = ranked(rows, [F.col("variant_id"), F.col("__part"), F.col("id")])
    last = numbered.count() - 1
    at = F.col("__rank")
    line = F.concat(F.when(at == 0, '{"type":"FeatureCollection","features":[\n').otherwise(""), "value", F.when(at == last, "\n]}").otherwise(","))
    if last < 0:
        rows.sparkSession.createDataFrame([('{"type":"FeatureCollection","features":[]}',)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return
    numbered.select("__rank", line.alias("value")).repartition(1).sortWithinPartitions("__rank").select("value").write.mode("overwrite").text(path)
