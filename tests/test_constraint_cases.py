"""Drawn violations, and their lawful neighbours, of constraints whose registered queries sow none: B11, D5, G8."""

from ductwork.operators import depth, spatial, validate
from ductwork.rules import Rules

R = Rules()
EDGE = "id long, restriction_type string, x1 double, y1 double, x2 double, y2 double"


def rows(df):
    return sorted((r.code, r.id, r.detail) for r in df.collect())


def test_b11_near_an_existing_network_but_for_the_circle_of_a_crossing(spark):
    line = lambda y: [(0.0, y), (50.0, y), (100.0, y)]
    pipes = spark.createDataFrame([("beside", "base", 100, line(0.0)), ("over", "special", 100, line(50.0)), ("clear", "base", 100, line(100.0))], "id string, laying string, dn int, pts array<struct<x:double,y:double>>")
    edges = [(1, "heat_network", 40.0, 0.8, 60.0, 0.8), (2, "heat_network", 49.5, 40.0, 49.5, 60.0), (3, "heat_network", 0.0, 103.0, 100.0, 103.0), (4, "power_cable", 40.0, 1.2, 60.0, 1.2), (5, "road", 40.0, 0.5, 60.0, 0.5)]
    assert rows(validate.line_clearance(pipes, spark.createDataFrame(edges, EDGE), R)) == [("B10", "beside", "4"), ("B11", "beside", "1")]
    assert rows(validate.line_clearance(pipes, spark.createDataFrame([], EDGE), R)) == []


def test_d5_the_default_number_of_segments_at_a_chamber(spark):
    segments = [(v, f"{v}{k}", f"{v}{k}x", "hub") for v, n in (("four", 4), ("five", 5)) for k in range(n)]
    nodes = [(v, i, k) for v in ("four", "five") for i, k in (("hub", "chamber"),)] + [("five", "five0x", "consumer")]
    found = validate.branching(spark.createDataFrame(segments, "variant_id string, id string, start_node string, end_node string"), spark.createDataFrame(nodes, "variant_id string, id string, kind string"), R)
    assert rows(found) == [("D5", "hub", "5")]


def test_g8_cover_under_roads_and_tracks(spark):
    pipe = lambda name, y, one, two: (name, "special", 100, [(0.0, y), (100.0, y)], one, two, 100.0)
    pipes = [pipe("shallow", 0.0, 0.8, 0.8), pipe("between", 50.0, 1.1, 1.1), pipe("deep", 100.0, 1.3, 1.3), pipe("falling", 150.0, 0.7, 1.9)]  # falling: 0.94 at the road, 1.66 at the tracks
    edges = [(1, "road", 20.0, -10.0, 20.0, 160.0), (2, "tram_tracks", 80.0, -10.0, 80.0, 160.0), (3, "gas_pipeline", 50.0, 400.0, 50.0, 500.0)]
    schema = "id string, laying string, dn int, pts array<struct<x:double,y:double>>, depth_start double, depth_end double, length double"
    found = validate.crossing_depths(spark.createDataFrame(pipes, schema), spark.createDataFrame(edges, EDGE), R)
    assert rows(found) == [("G8", "between", "2"), ("G8", "falling", "1"), ("G8", "shallow", "1"), ("G8", "shallow", "2")]


def test_bends_and_districts(spark):
    profile = [(1, 0, 3.0), (1, 10, 3.0), (1, 20, 4.0), (1, 30, 5.0), (1, 40, 5.0), (1, 40, 4.5), (2, 0, 3.0), (3, 5, None), (3, None, 1.0)]
    assert {tuple(r) for r in depth.bends(spark.createDataFrame(profile, "chain_id long, at long, depth double")).collect()} == {(1, 2), (2, 0)}
    points = [(1, 0.0, 5.0, "b"), (2, 0.0, 900.0, "b"), (3, 5.0, 5.0, "a"), (4, 5.0, 2.0, "c"), (5, None, 1.0, "d"), (6, 9000.0, 0.0, "e")]
    pipe = [(7, 0.0, 0.0, 10.0, 0.0)]
    place = lambda rows: [tuple(r) for r in spatial.groups_by_distance(spark.createDataFrame(points, "id long, x double, y double, group_id string"), spark.createDataFrame(rows, "id long, x1 double, y1 double, x2 double, y2 double"), 100.0).orderBy("place").collect()]
    assert place(pipe) == [("c", 4.0, 0), ("a", 25.0, 1), ("b", 25.0, 2), ("e", 8990.0**2, 3)]
    assert place([]) == []
