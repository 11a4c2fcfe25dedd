"""What the reviewer's fourth round found, each in small."""

import random

from pyspark.sql import functions as F

from ductwork.functions import geometry
from ductwork.operators import assembly, spatial, trees, validate, zones
from ductwork.rules import Rules

R = Rules()


def rows(df):
    return sorted((r.code, r.id) for r in df.collect())


def test_f19_halves_of_a_step_round_up(spark):
    pts = spark.createDataFrame([(i, 2.0 * i, 0.0) for i in range(5000)], "id long, x double, y double")
    want = {k: [i for i in range(5000) if (2 * i + 100) // 200 == k] for k in range(51)}
    assert {r.kx: list(r.ids) for r in spatial.coincident(pts, 200.0).collect()} == {k: v for k, v in want.items() if len(v) > 1}


def test_f20_segments_without_a_diameter_do_not_count_at_nodes(spark):
    segments = [("v", "a", "hub", "t", None, "base", 1.0), ("v", "b", "hub", "x", 100, "base", 1.0), ("v", "c", "hub", "y", 100, "base", 1.0), ("v", "d", "t", "w", None, "base", 1.0), ("v", "e", "u", "x", 100, "base", 1.0), ("v", "f", "u", "w", None, "base", 1.0), ("v", "g", "lone", "w", None, "base", 1.0)]
    nodes = [("v", "hub", "chamber"), ("v", "t", "technical"), ("v", "u", "technical"), ("v", "w", "consumer"), ("v", "lone", "chamber"), ("v", "bare", "chamber")]
    s = spark.createDataFrame(segments, "variant_id string, id string, start_node string, end_node string, dn int, laying string, k double")
    n = spark.createDataFrame(nodes, "variant_id string, id string, kind string")
    assert rows(validate.technical_nodes(s, n)) == [("D1", "u")]
    assert rows(validate.branching(s, n, Rules(chamber_segments=2))) == []
    assert rows(validate.degrees(s, n, R)) == [("D10", "bare"), ("D6", "hub")]


def test_f21_a_missing_diameter_is_not_one_off_the_table(spark):
    s = spark.createDataFrame([("a", None, 1.0), ("b", 55, 1.0), ("c", 50, 1.0), ("d", None, 1e9), ("e", 50, 1e9)], "id string, dn int, flow double")
    assert rows(validate.diameters(s, R)) == [("C0", "b"), ("C2", "e")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_f16_pairs_that_share_cells_are_given_once_without_a_further_exchange(spark):
    rng = random.Random(16)
    line = lambda i, reach: (i, x := rng.uniform(-300, 300), y := rng.uniform(-300, 300), x + rng.choice([0.0, rng.uniform(-reach, reach)]), y + rng.choice([0.0, rng.uniform(-reach, reach)]))
    schema = "id long, x1 double, y1 double, x2 double, y2 double"
    a, b = [line(i, 500) for i in range(60)], [line(i, 120) for i in range(90)]
    left, right = spark.createDataFrame([*a, *a[:9]], schema), spark.createDataFrame([*b, *b[:9]], schema)
    ends = ("x1", "y1", "x2", "y2")
    every = spark.createDataFrame(a, schema).crossJoin(spark.createDataFrame(b, schema).toDF("right_id", *[f"r_{c}" for c in ends]))
    d2 = geometry.segment_segment_square(tuple(map(F.col, ends)), tuple(F.col(f"r_{c}") for c in ends))
    for radius, size in ((0.0, 40.0), (25.0, 40.0), (25.0, 7.0), (60.0, 300.0)):
        near = spatial.segments_near(left, right, radius, size)
        want = sorted((r.id, r.right_id) for r in every.where(d2 <= radius * radius).select("id", "right_id").collect())
        assert sorted((r.left_id, r.right_id) for r in near.select("left_id", "right_id").collect()) == want and want
    text = plan(near)
    assert "BroadcastHashJoin" not in text and "Exchange" not in text.split("SortMergeJoin")[0]


def test_f3_f17_no_side_of_a_join_by_cells_is_sent_to_the_driver(spark):
    pts = spark.range(50).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"))
    corner = lambda i, j: F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y"))
    triangles = pts.select("id", F.array(corner(0, 0), corner(2, 0), corner(2, 2), corner(0, 0)).alias("ring"))
    pentagons = pts.select("id", F.array(corner(0, 0), corner(1, 0), corner(2, 0), corner(2, 1), corner(2, 2), corner(0, 0)).alias("ring"))
    found = [spatial.points_in_polygons(pts, p, 2.0) for p in (triangles, pentagons, triangles.union(pentagons))]
    one, two, both = (sorted(map(tuple, f.collect())) for f in found)
    assert one == two and both == sorted(one + two)
    place = {i: (i % 7, i % 5) for i in range(50)}
    assert one == sorted((p, t) for p in place for t in place if 0 <= place[p][1] - place[t][1] <= place[p][0] - place[t][0] <= 2)
    for df in (*found, spatial.pairs_within(pts, 3.0), spatial.points_in_boxes(pts, pts.select("id", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + 1).alias("x2"), (F.col("y") + 1).alias("y2")), 2.0)):
        assert "BroadcastHashJoin" not in plan(df)


def test_f9_few_links_join_what_all_near_pairs_join(spark, monkeypatch):
    rng = random.Random(9)
    pts = spark.createDataFrame([(i, rng.choice([0.0, 40.0, rng.uniform(0, 900)]), rng.choice([0.0, rng.uniform(0, 900)])) for i in range(300)], "id long, x double, y double")
    links = spatial.links_within(pts, 30.0)
    assert links.count() < spatial.pairs_within(pts, 30.0).count() / 4
    all_ = trees.components(spatial.pairs_within(pts, 30.0).select(F.col("left_id").alias("a"), F.col("right_id").alias("b")))
    want = sorted(map(tuple, all_.collect()))
    assert sorted(map(tuple, trees.components(links).collect())) == want
    monkeypatch.setattr(trees, "ONE_TASK", 3)  # edges become stars a few at a time
    assert sorted(map(tuple, trees.components(links, one_task=1 << 20).collect())) == want


def beyond_the_join(df):
    return "Exchange" in plan(df).split("SortMergeJoin")[0]


def test_f6_walls_that_touch_are_not_sorted_again_unless_ids_repeat(spark):
    walls = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 0.0, 1.0), (2, 1, 10.0, 1.5, 20.0, 1.5, 1.0), (3, 2, 50.0, 0.0, 60.0, 0.0, 1.0)], "id long, zone long, x1 double, y1 double, x2 double, y2 double, reach double")
    near = zones.touching(walls)
    assert [(r.a, r.b) for r in near.collect()] == [(1, 2)] and not beyond_the_join(near)
    again = zones.touching(walls.union(walls.where("id = 2").withColumn("x2", F.col("x2") + 1)))
    assert [(r.a, r.b) for r in again.collect()] == [(1, 2)]
    assert {(r.id, r.part) for r in zones.unions(walls).collect()} == {(1, 1), (2, 1), (3, 3)}


PIPE = "id string, variant_id string, start_node string, end_node string, dn int, pts array<struct<x:double,y:double>>"
WALL = "id long, restriction_type string, x1 double, y1 double, x2 double, y2 double"


def test_f12_pairs_of_straight_pipes_and_single_edges_are_not_sorted_for_repeats(spark):
    pipes = [("a", "v", "1", "2", 100, [(0.0, 0.0), (100.0, 0.0)]), ("b", "v", "3", "4", 100, [(0.0, 50.0), (100.0, 50.0)])]
    edges = [(1, "oks_existing", 50.0, 2.0, 60.0, 2.0), (2, "metro", 50.0, 55.0, 60.0, 55.0), (3, "metro", 50.0, 80.0, 60.0, 80.0)]
    found = validate.clearance(spark.createDataFrame(pipes, PIPE), spark.createDataFrame(edges, WALL), R, 50.0)
    assert rows(found) == [("B3", "a"), ("B7", "b")] and not beyond_the_join(found)
    bent = [("a", "v", "1", "2", 100, [(0.0, 0.0), (55.0, 0.0), (100.0, 0.0)])]  # both pieces are near: one row
    assert rows(validate.clearance(spark.createDataFrame(bent, PIPE), spark.createDataFrame(edges, WALL), R, 50.0)) == [("B3", "a")]
    two = [*edges, (1, "oks_existing", 60.0, 2.0, 60.0, 9.0)]  # an object of two edges: one row
    assert rows(validate.clearance(spark.createDataFrame(pipes[:1], PIPE), spark.createDataFrame(two, WALL), R, 50.0)) == [("B3", "a")]


def test_f13_crossings_of_straight_pipes_are_joined_by_variant_and_given_once(spark):
    cross = lambda v: [(f"{v}1", v, f"{v}a", f"{v}b", 100, [(0.0, 0.0), (100.0, 100.0)]), (f"{v}2", v, f"{v}c", f"{v}d", 100, [(0.0, 100.0), (100.0, 0.0)])]
    found = validate.self_crossings(spark.createDataFrame([*cross("u"), *cross("v")], PIPE), 20.0)
    assert rows(found) == [("B15", "u1"), ("B15", "v1")]
    assert "__s0" in plan(found)  # the variant is a key of the join, not a condition after it
    bent = [("u3", "u", "x", "y", 100, [(20.0, 0.0), (20.0, 50.0), (20.0, 100.0)]), *cross("u")[:1], ("u4", "u", "z", "w", 100, [(0.0, 20.0), (30.0, 20.0), (60.0, 90.0), (0.0, 30.0)])]
    assert len(rows(validate.self_crossings(spark.createDataFrame(bent, PIPE), 20.0))) == len(set(map(tuple, validate.self_crossings(spark.createDataFrame(bent, PIPE), 20.0).collect())))


def test_f18_conflicts_of_trees_of_one_line_are_not_sorted_for_repeats(spark):
    line = "tree long, x1 double, y1 double, x2 double, y2 double"
    one = [(1, 0.0, 0.0, 100.0, 100.0), (2, 0.0, 100.0, 100.0, 0.0), (3, 300.0, 0.0, 400.0, 0.0)]
    found = assembly.tree_conflicts(spark.createDataFrame(one, line), cell=20.0)
    assert [(r.a, r.b) for r in found.collect()] == [(1, 2)] and not beyond_the_join(found)
    more = assembly.tree_conflicts(spark.createDataFrame([*one, (2, 0.0, 60.0, 100.0, 60.0)], line), cell=20.0)
    assert [(r.a, r.b) for r in more.collect()] == [(1, 2)]
