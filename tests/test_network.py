"""The network engine: literal goldens, naive twins, and constraints on planned results."""

import itertools
import json
import math
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ductwork.functions import geometry
from ductwork.operators import costing, depth, planning, routing, spans, spatial, trees, validate
from ductwork.rules import Rules, half_up
from ductwork.sources import features
from ductwork.streaming import inbox

R = Rules()


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_money_goldens(spark):
    cost = lambda length, dn, k: R.segment_cost(F.lit(length), F.lit(dn), F.lit(k))
    got = one(spark, cost(100.004, 65, 1.0), cost(120.5, 50, 1.6), cost(33.333, 200, 1.05), R.score(F.lit(136384734.40), F.lit(220.5)), *[R.chamber_price(F.lit(d)) for d in (50, 200, 250, 500, 600, 1000, 1200, 1400)], half_up(F.lit(-0.5), 0))
    assert list(got) == [7863100.00, 14271634.40, 4209204.04, 4.4803, 3e6, 3e6, 5e6, 5e6, 8e6, 8e6, 12e6, 12e6, 0.0]


def test_step_lookups(spark):
    got = one(spark, R.diameter_for_flow(F.lit(25.0)), R.diameter_for_flow(F.lit(3.5)), R.diameter_for_flow(F.lit(1e6)), R.snap_up(F.lit(350)), R.snap_up(F.lit(5000)), R.next_diameter(F.lit(1400)), R.clearance(F.lit("oks_existing"), F.lit(500)), R.clearance(F.lit("unheard_of"), F.lit(50)), R.restriction(F.lit("road"), "k_special"))
    assert list(got) == [125, 50, None, 400, 1400, None, 7.0, 1.0, 1.6]


def test_rules_from_json():
    text = json.dumps({"tie_in_cost": 7, "restrictions": {"pond": {"rule": "forbid", "clearance_m": 3}, "_fallback": {"rule": "forbid", "clearance_m": 1}}, "score": {"w_cost": 0.5}})
    rules = Rules.from_json(text)
    assert rules.tie_in_cost == 7 and rules.w_cost == 0.5 and rules.restrictions["pond"][1] == ((1400, 3.0),) and rules.diameters == R.diameters
    with pytest.raises(ValueError):
        Rules.from_json(json.dumps({"restrictions": {"pond": {"rule": "maybe", "clearance_m": 3}}}))


def test_utm(spark):
    """Round trip; and on the central meridian, north is the scaled length of the meridian, integrated here."""
    x, y = geometry.to_utm(F.lit(37.6173), F.lit(55.7558))
    lon, lat = geometry.to_wgs84(x, y)
    got = one(spark, lon, lat, *geometry.to_utm(F.lit(39.0), F.lit(55.7558)))
    assert got[0] == pytest.approx(37.6173, abs=1e-9) and got[1] == pytest.approx(55.7558, abs=1e-9)
    f, a, n = 1 / 298.257223563, 6378137.0, 20000
    e2, top = f * (2 - f), math.radians(55.7558)
    arc = sum(a * (1 - e2) / (1 - e2 * math.sin(top * (i + 0.5) / n) ** 2) ** 1.5 for i in range(n)) * top / n
    assert got[2] == pytest.approx(500000.0, abs=1e-6) and got[3] == pytest.approx(0.9996 * arc, abs=1e-2)


def test_geometry(spark):
    lit = lambda *v: tuple(map(F.lit, v))
    ring = F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))])
    got = one(
        spark, geometry.segment_segment_square(lit(0.0, 0.0, 2.0, 2.0), lit(0.0, 2.0, 2.0, 0.0)), geometry.segment_segment_square(lit(0.0, 0.0, 1.0, 0.0), lit(3.0, 1.0, 3.0, 5.0)),
        geometry.in_ring(F.lit(2.0), F.lit(2.0), ring), geometry.in_ring(F.lit(4.0), F.lit(1.0), ring), geometry.in_ring(F.lit(4.1), F.lit(1.0), ring), geometry.acute_angle(*lit(1.0, 0.0, -1.0, 1.0)), geometry.deflection(*lit(1.0, 0.0, 0.0, 1.0)),
    )
    assert got[0] == 0 and got[1] == 5 and list(got)[2:5] == [True, True, False] and got[5] == pytest.approx(45) and got[6] == pytest.approx(90)


def test_flow_golden(spark):
    edges = spark.createDataFrame([("c1", "tie", 0.0), ("o1", "c1", 1.2), ("c2", "c1", 0.0), ("o2", "c2", 2.3), ("o3", "c2", 0.5), ("tie", None, 0.0)], "node string, parent string, value double")
    got = {r.node: round(r.total, 6) for r in trees.subtree_sums(edges).collect()}
    assert got == {"c1": 4.0, "o1": 1.2, "c2": 2.8, "o2": 2.3, "o3": 0.5, "tie": 4.0}
    with pytest.raises(ValueError):
        trees.subtree_sums(spark.createDataFrame([(1, 2, 1), (2, 1, 1)], "node int, parent int, value int"), rounds=8)


def test_spans_against_naive(spark):
    r = random.Random(3)
    rows = [(r.randrange(4), a, a + r.randrange(6), r.randrange(5)) for a in (r.randrange(60) for _ in range(80))]
    df = spark.createDataFrame(rows, "u int, lo int, hi int, w int")
    merged = {(x.u, x.lo, x.hi, x.w) for x in spans.merge_spans(df, ["u"], "lo", "hi", "w", gap=0).collect()}
    naive = set()
    for u in range(4):
        cur = None
        for _, lo, hi, w in sorted(x for x in rows if x[0] == u):
            if cur and lo <= cur[1]:
                cur = [cur[0], max(cur[1], hi), max(cur[2], w)]
            else:
                if cur:
                    naive.add((u, *cur))
                cur = [lo, hi, w]
        naive.add((u, *cur))
    assert merged == naive
    covered = {x.u: x.covered for x in spans.covered_length(df, ["u"], "lo", "hi").collect()}
    assert covered == {u: len({p for x in rows if x[0] == u for p in range(x[1], x[2])}) for u in range(4)}
    for x in spans.sweep(df, ["u"], "lo", "hi", "w").collect():
        over = [s for s in rows if s[0] == x.u and s[1] <= x["at"] and s[2] >= x.until and s[2] > s[1]]
        assert (x.n_active, x.w) == (len(over), max(s[3] for s in over))


def test_spatial_against_naive(spark):
    r = random.Random(4)
    pts = [(i, r.uniform(0, 300), r.uniform(0, 300)) for i in range(120)]
    df = spark.createDataFrame(pts, "id int, x double, y double")
    d2 = lambda a, b: (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2
    assert {(x.left_id, x.right_id) for x in spatial.pairs_within(df, 25.0).collect()} == {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and d2(a, b) <= 625}
    near = {}
    for x in spatial.nearest(df.where("id < 40"), df.where("id >= 40"), 3, 10.0).collect():
        near.setdefault(x.left_id, []).append((x["rank"], x.right_id))
    for a in pts[:40]:
        assert [i for _, i in sorted(near[a[0]])] == [b[0] for b in sorted(pts[40:], key=lambda b: (d2(a, b), b[0]))[:3]]


def test_turns_and_totals(spark):
    path = spark.createDataFrame([("p", i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (10, 0), (10, 0), (10, 10), (20, 10), (30, 11)])], "k string, i int, x double, y double")
    got = spans.count_turns(spans.vertex_turns(path, ["k"], "i", "x", "y"), ["k"]).first()
    assert got.n_turns == 3 and got.max_turn == pytest.approx(90)
    seg = spark.createDataFrame([("v", 14271634.4, 120.5), ("v", 7863100.0, 100.0)], "variant string, cost double, length double")
    total = costing.variant_totals(seg, R, spark.createDataFrame([("v", 100)], "variant string, dn int"), spark.createDataFrame([("v",), ("v",)], "variant string"), spark.createDataFrame([("v", 2.5)], "variant string, flow double")).first()
    assert (total.construction_cost, total.calculated_cost, total.new_length, total.score) == (35134734.40, 136384734.40, 220.5, 4.4803)
    ranks = costing.rank_variants(spark.createDataFrame([("a", 2.0, 10.0), ("b", 1.0, 50.0), ("c", 1.0, 30.0)], "variant string, score double, calculated_cost double")).collect()
    assert {x.variant: x["rank"] for x in ranks} == {"c": 1, "b": 2, "a": 3}


def segment(id_, a, b, pts, flow, dn, k=1.0, laying="base"):
    length = sum(math.dist(p, q) for p, q in zip(pts, pts[1:]))
    price = {d[0]: d[3] for d in R.diameters}[dn]
    return (id_, "v", [{"x": float(x), "y": float(y)} for x, y in pts], a, b, flow, dn, round(length, 2), laying, k, round(round(length, 2) * price * k, 2), 3.0, 3.0)


SEGMENT = "id string, variant_id string, pts array<struct<x:double,y:double>>, start_node string, end_node string, flow double, dn int, length double, laying string, k double, cost double, depth_start double, depth_end double"
NODE = "id string, variant_id string, kind string, x double, y double, dn int, cost double, demand double"


def test_constraints(spark):
    nodes = [("t", "v", "existing", 0.0, 0.0, 200, None, None), ("c", "v", "chamber", 100.0, 0.0, 65, 3e6, None), ("o1", "v", "consumer", 100.0, 50.0, None, None, 3.0), ("o2", "v", "consumer", 150.0, 0.0, None, None, 3.0)]
    good = [segment("s1", "t", "c", [(0, 0), (100, 0)], 6.0, 65), segment("s2", "c", "o1", [(100, 0), (100, 50)], 3.0, 50), segment("s3", "c", "o2", [(100, 0), (150, 0)], 3.0, 50)]
    n = spark.createDataFrame(nodes, NODE)
    clean = validate.check(spark.createDataFrame(good, SEGMENT), n, R, depth=True).collect()
    assert clean == []
    bad = [segment("s1", "t", "c", [(0, 0), (40, 5), (100, 0)], 5.0, 50, laying="special"), segment("s2", "c", "o1", [(100, 0), (100, 50)], 3.0, 65), (*segment("s3", "c", "gone", [(100, 0), (150, 0)], 3.0, 50)[:10], 1.0, 0.5, 9.0)]
    codes = {r.code for r in validate.check(spark.createDataFrame(bad, SEGMENT), n, R, depth=True).collect()}
    assert {"A2", "B2", "C1", "C2", "C4", "E1", "G2", "G3"} <= codes
    walls = spark.createDataFrame([("w", "park", 50.0, 1.0, 60.0, 1.0), ("x", "oks_existing", 120.0, 4.0, 130.0, 4.0), ("far", "park", 50.0, 30.0, 60.0, 30.0)], "id string, restriction_type string, x1 double, y1 double, x2 double, y2 double")
    assert {(r.code, r.id, r.detail) for r in validate.clearance(spark.createDataFrame(good, SEGMENT), walls, R).collect()} == {("B7", "s1", "w"), ("B3", "s3", "x")}


ZONE = "id int, ring array<struct<x:double,y:double>>, rule string, clearance double, k double, margin double, min_angle double"


def box_ring(x1, y1, x2, y2):
    return [(float(x), float(y)) for x, y in ((x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1))]


def crosses_box(line, box):
    """Whether a segment comes into an axis-parallel box, by clipping its parameter."""
    (x1, y1, x2, y2), lo, hi = line, 0.0, 1.0
    for p, d, a, b in ((x1, x2 - x1, box[0], box[2]), (y1, y2 - y1, box[1], box[3])):
        if abs(d) < 1e-12:
            if not a <= p <= b:
                return False
            continue
        t = sorted(((a - p) / d, (b - p) / d))
        lo, hi = max(lo, t[0]), min(hi, t[1])
    return lo < hi


def test_planned_tree_is_legal(spark):
    points = spark.createDataFrame([(i, float(x), float(y), 2.0) for i, (x, y) in enumerate([(100, 60), (140, 60), (300, 40), (320, 90)])], "id int, x double, y double, flow double")
    pipes = spark.createDataFrame([("p", 200, 0.0, 0.0, 400.0, 0.0)], "id string, dn int, x1 double, y1 double, x2 double, y2 double")
    chambers = spark.createDataFrame([("c", 10.0, 0.0, 200)], "id string, x double, y double, dn int")
    cand = planning.tie_candidates(points, pipes, chambers, R)
    best = {r.point_id: (r.object_id, r.x, r.y) for r in cand.where("rank = 1").collect()}
    assert best[0] == ("p", 100.0, 0.0)
    zones = spark.createDataFrame([(1, box_ring(118, 10, 122, 80), "forbid", 1.0, None, None, None), (2, box_ring(200, 20, 240, 60), "special", 1.0, 1.6, 3.0, 30.0), (3, box_ring(318, 88, 325, 95), "forbid", 1.0, None, None, None)], ZONE)
    edges, left = planning.plan_trees(points, cand, zones, planning.groups(points), R)
    rows = edges.collect()
    assert [(r.id, r.reason) for r in left.collect()] == [(3, "inside_forbidden_zone")]
    ends = {r.to_id for r in rows}
    assert {"c:0", "c:1", "c:2"} <= ends and len(ends) == len(rows)
    for r in rows:
        for a, b in itertools.pairwise(r.pts):
            assert not crosses_box((a.x, a.y, b.x, b.y), (117.05, 9.05, 122.95, 80.95))
    sized = planning.sized_segments(edges, points.select(F.concat(F.lit("c:"), "id").alias("to_id"), "flow"), R).collect()
    assert all(s.dn >= 50 and s.flow >= 2.0 and s.weight >= s.length - 1e-6 for s in sized)
    assert sum(s.flow for s in sized if s.from_id.startswith("t:")) == 6.0


def test_groups_are_split_alike_in_tasks_and_by_levels(spark):
    r = random.Random(6)
    points = spark.createDataFrame([(i, r.uniform(0, 2000), float(r.randrange(0, 500, 50))) for i in range(300)] + [(1000, 9000.0, 0.0)], "id long, x double, y double")
    whole = lambda **k: {x.point_id: x.group_id for x in planning.groups(points, **k).collect()}
    one = whole()
    assert one == whole(one_task=1) and len(one) == 301
    sizes = pd.Series(one).value_counts()
    assert sizes.max() <= 16 and sizes.min() >= 1


def test_everyone_is_served_or_told_why(spark):
    """Many consumers among zones: the plan keeps the constraints, and each consumer is in it or has a reason."""
    r = random.Random(8)
    spots = [(i, r.uniform(0, 900), r.uniform(0, 900), r.choice([1.0, 2.5, 6.0])) for i in range(70)] + [(70, 300.0, 300.0, 1e9), (71, 5000.0, 5000.0, 1.0), (72, None, 3.0, 1.0), (73, 450.5, 450.5, 1.0)]
    spots += [(74, spots[0][1], spots[0][2], 1.0)]
    points = spark.createDataFrame(spots, "id int, x double, y double, flow double")
    pipes = spark.createDataFrame([("p", 300, 0.0, -40.0, 900.0, -40.0), ("q", 300, 0.0, 940.0, 900.0, 940.0)], "id string, dn int, x1 double, y1 double, x2 double, y2 double")
    chambers = spark.createDataFrame([("c", 450.0, -40.0, 300)], "id string, x double, y double, dn int")
    boxes = [(i, x, y, x + r.uniform(10, 60), y + r.uniform(10, 60), "forbid" if i % 2 else "special") for i, x, y in ((i, r.uniform(0, 850), r.uniform(0, 850)) for i in range(25))] + [(99, 448.0, 448.0, 453.0, 453.0, "forbid")]
    zones = spark.createDataFrame([(i, box_ring(*b), kind, 1.0, *((None,) * 3 if kind == "forbid" else (1.6, 3.0, 30.0))) for i, *b, kind in boxes], ZONE)
    placed = points.where("x is not null")
    cand = planning.tie_candidates(placed, pipes, chambers, R)
    edges, left = planning.plan_trees(points, cand, zones, planning.groups(placed), R)
    rows, out = edges.collect(), {x.id: x.reason for x in left.collect()}
    served = {int(e.to_id[2:]) for e in rows if e.to_id.startswith("c:")}
    assert served | set(out) == set(range(75)) and not served & set(out)
    assert out[70] == "flow_exceeds_capacity" and out[72] == "no_connection_point" and out[73] == "inside_forbidden_zone" and out[71] in ("no_route", "enclosed") and len(served) > 40
    sized = planning.sized_segments(edges, points.select(F.concat(F.lit("c:"), "id").alias("to_id"), "flow"), R)
    key = lambda c: F.concat("group_id", F.lit("/"), c)
    segments = sized.select(
        key("to_id").alias("id"), F.lit("v").alias("variant_id"), "pts", key("from_id").alias("start_node"), key("to_id").alias("end_node"), "flow", "dn", "length", F.lit("channel").alias("laying"), "k", "cost",
        F.lit(1.0).alias("depth_start"), F.lit(1.0).alias("depth_end"),
    ).withColumn("length", half_up(F.col("length"), 2))
    point = lambda at: F.element_at("pts", at)
    ends = segments.select(F.col("start_node").alias("id"), point(1).alias("p")).union(segments.select("end_node", point(-1))).dropDuplicates(["id"])
    kind = F.when(F.col("id").contains("/t:"), "existing").when(F.col("id").contains("/c:"), "consumer").otherwise("chamber")
    demand = points.select(F.concat(F.lit("c:"), "id").alias("c"), F.col("flow").alias("demand"))
    nodes = ends.select("id", F.lit("v").alias("variant_id"), kind.alias("kind"), F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.substring_index("id", "/", -1).alias("c")).join(demand, "c", "left").drop("c")
    walls = routing.zone_edges(zones.where("rule = 'forbid'"))
    near = spatial.segments_near(segments.select("id", F.posexplode("pts").alias("i", "a"), "pts").withColumn("b", F.get("pts", F.col("i") + 1)).where("b is not null").select("id", F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), F.col("b.x").alias("x2"), F.col("b.y").alias("y2")), walls, 0.985, 50.0)
    assert near.count() == 0
    checks = [validate.node_references(segments, nodes), validate.ends_at_nodes(segments, nodes), validate.diameters(segments, R), validate.flows(segments, nodes), validate.runs(segments, R), validate.connected(segments, nodes), validate.least_diameters(segments, R)]
    found = [x for c in checks for x in c.collect()]
    assert found == []
    assert [x for x in validate.turns(segments).collect() if x.code == "B1"] == []
    assert [x for x in validate.degrees(segments, nodes, R).collect() if x.code == "D4"] == []


def test_depth_profile():
    zone = lambda no, lo, hi, ranges: {"zone_no": no, "lo": lo, "hi": hi, "price": 100.0, "ranges": ranges}
    over = depth.allowed_ranges(0.7, [(2.8, 0.4, 0.2)], 0.14)
    assert over == [(0.7, pytest.approx(2.46)), (pytest.approx(3.4), 10.0)]
    plan = depth.solve_chain(pd.DataFrame([zone(0, 0.0, 5.0, [(0.7, 10.0)]), zone(1, 40.0, 44.0, over), zone(2, 80.0, 85.0, [(0.7, 10.0)])]))
    assert plan.depth.round(3).tolist() == [3.0, 3.4, 3.0]
    steep = depth.solve_chain(pd.DataFrame([zone(0, 0.0, 5.0, [(3.0, 3.0)]), zone(1, 6.0, 8.0, [(5.0, 5.0)])]))
    assert steep.depth.isna().all()


def feature(kind, geom, coordinates, **props):
    return {"type": "Feature", "geometry": {"type": geom, "coordinates": coordinates}, "properties": {"object_type": kind, **props}}


@pytest.mark.parametrize("style", ["lines", "document"])
def test_feature_reader(spark, tmp_path, style):
    rows = [
        feature("source", "Point", [37.6, 55.7], id=1),
        feature("heat_network", "LineString", [[37.6, 55.7], [37.61, 55.7]], id="n1", diameter=350, flow_tph=9, upstream_object_id="1"),
        feature("heat_chamber", "Point", [37.61, 55.7], id="c1"),
        feature("oks_future", "Polygon", [[[37.62, 55.7], [37.63, 55.7], [37.63, 55.71], [37.62, 55.71], [37.62, 55.7]]], id="b1", flow_tph=5),
        feature("oks_connection_point", "Point", [37.625, 55.705], id="p1", flow_tph=4),
        feature("restriction", "LineString", [[37.6, 55.71], [37.61, 55.71]], id="r1", restriction_type="road"),
    ]
    wrong = [feature("heat_network", "LineString", [[37.6, 55.7], [37.61, 55.7]], id="n1", diameter="x"), feature("oks_connection_point", "Point", [37.6, 55.7], id="p2", oks_id="none"), feature("oks_future", "Polygon", [[[37.6, 55.7], [37.61, 55.7], [37.6, 55.71]]], id="b2", flow_tph=-1), feature("moon", "Point", [0, 0], id="m")]

    def save(name, fs):
        path = tmp_path / name
        path.write_text("\n".join(json.dumps(f) for f in fs) if style == "lines" else json.dumps({"type": "FeatureCollection", "features": fs}))
        return str(path)

    data = features.read(spark, save("good.json", rows))
    assert data.diagnostics.collect() == [] and data.warnings.collect() == []
    assert data.segments.first().dn == 400 and data.chambers.first().dn == 400
    assert data.connection_points.first().oks_id == "b1" and data.connection_points.first().flow_tph == 4.0
    assert [r.id for r in features.orient(data.sources, data.segments).collect()] == ["n1"]
    bad = features.read(spark, save("bad.json", rows + wrong))
    found = {(r.feature_id, r.field) for r in bad.diagnostics.collect()}
    assert {("n1", "id"), ("n1", "diameter"), ("p2", "oks_id"), ("b2", "geometry"), ("b2", "flow_tph")} <= found
    assert any("moon" in r.warning for r in bad.warnings.collect())


def test_job_inbox(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps(feature("source", "Point", [37.6, 55.7], id="s")))
    (folder / "b.json").write_text(json.dumps(feature("source", "LineString", [[37.6, 55.7], [37.7, 55.7]], id="s")))
    q = inbox.start(spark, str(folder), str(tmp_path / "jobs"), str(tmp_path / "check"), lambda s, path: features.read(s, path).diagnostics)
    q.awaitTermination()
    states = {r.job.rsplit("/", 1)[1]: r.status for r in inbox.latest(spark.read.parquet(str(tmp_path / "jobs"))).collect()}
    assert states == {"a.json": "DONE", "b.json": "FAILED"}
    assert inbox.fail_orphans(spark.read.parquet(str(tmp_path / "jobs"))).collect() == []


def test_writer(spark, tmp_path):
    seg = spark.createDataFrame([("v1", "s1", [{"x": 413237.6, "y": 6179889.0}, {"x": 413337.6, "y": 6179889.0}], "a", "b", 2.5, 65, 100.0, "base", 7863100.0)], "variant_id string, id string, pts array<struct<x:double,y:double>>, start_node_id string, end_node_id string, flow_tph double, dn int, length double, laying_method string, cost double")
    features.write(features.to_features(seg), str(tmp_path / "out"))
    row = json.loads(spark.read.text(str(tmp_path / "out")).first().value)
    assert row["properties"]["diameter"] == 65 and row["properties"]["cost"] == 7863100.0 and row["geometry"]["coordinates"][0][0] == pytest.approx(37.617, abs=1e-2)


def test_components_against_naive(spark):
    r = random.Random(8)
    path = list(range(3000))
    r.shuffle(path)
    links = list(zip(path, path[1:])) + [(3000 + r.randrange(300), 3000 + r.randrange(300)) for _ in range(140)] + [(4000, 4000 + k) for k in range(1, 400)]
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(links, "a long, b long").repartition(7)
    got = {x.node: x.comp for x in trees.components(df).collect()}
    assert got == {a: find(a) for link in links for a in link if link[0] != link[1]}
    assert trees.components(df.where("a < 0")).collect() == []
    words = spark.createDataFrame([("b", "a"), ("c", "b"), ("z", "y"), (None, "a")], "a string, b string")
    assert {(x.node, x.comp) for x in trees.components(words).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("y", "y"), ("z", "y")}


def test_reader_parts_walls_and_cycles(spark, tmp_path):
    far = lambda *p: [[37.6 + a / 1000, 55.7 + b / 1000] for a, b in p]
    square = lambda a, b, c: far((a, b), (a + c, b), (a + c, b + c), (a, b + c), (a, b))
    rows = [
        feature("source", "Point", [37.6, 55.7], id=1),
        feature("heat_network", "MultiLineString", [far((2, 0), (1, 0)), far((0, 0), (1, 0)), far((2, 0), (3, 1))], id="m", diameter=100, flow_tph=1),
        feature("heat_network", "LineString", far((3, 1), (3, 4)), id="n", diameter=100, flow_tph=1),
        feature("heat_network", "LineString", far((3, 2), (5, 2)), id="tee", diameter=100, flow_tph=1),
        feature("heat_network", "LineString", far((50, 50), (51, 50)), id="away", diameter=100, flow_tph=1),
        feature("heat_chamber", "Point", far((3, 1))[0], id="c"),
        feature("oks_future", "MultiPolygon", [[square(10, 10, 2)], [square(20, 20, 4), square(21, 21, 1)]], id="b", flow_tph=5),
        feature("oks_connection_point", "Point", far((23, 23))[0], id="in2", flow_tph=1),
        feature("oks_connection_point", "Point", far((21.5, 21.5))[0], id="hole", flow_tph=1),
        feature("oks_connection_point", "Point", [37.6 + 0.024 + 1e-8, 55.7 + 0.022], id="wall", flow_tph=1),
    ]
    path = tmp_path / "a.json"
    path.write_text("\n".join(json.dumps(f) for f in rows))
    data = features.read(spark, str(path))
    assert data.diagnostics.collect() == []
    line = {r.id: r.pts for r in data.segments.collect()}["m"]
    assert len(line) == 4
    assert {r.cp_id: r.oks_id for r in data.connection_points.collect()} == {"in2": "b", "hole": None, "wall": "b"}
    assert {r.id: r.upstream for r in features.orient(data.sources, data.segments, data.chambers).collect()} == {"m": "1", "n": "c", "tee": "n"}
    assert {r.id: r.id_is_number for r in data.features.collect() if r.id in ("1", "m")} == {"1": True, "m": False}
    wrong = [
        feature("heat_network", "MultiLineString", [far((0, 0), (1, 0)), far((5, 0), (6, 0))], id="gap", diameter=100),
        feature("oks_future", "Polygon", [far((0, 0), (2, 2), (2, 0), (0, 2), (0, 0))], id="bow", flow_tph=1),
        *[feature("heat_network", "LineString", far((i, 9), (i, 8)), id=f"k{i}", diameter=50, upstream_object_id=f"k{(i + 1) % 3}") for i in range(3)],
        feature("heat_network", "LineString", far((7, 9), (7, 8)), id="k7", diameter=50, upstream_object_id="k0"),
        {**feature("source", "Point", [0, 0]), "properties": {"object_type": "source", "other": {"id": "x"}}},
    ]
    path.write_text("\n".join(json.dumps(f) for f in wrong))
    found = {(r.feature_id, r.problem) for r in features.read(spark, str(path)).diagnostics.collect()}
    assert found == {("gap", "parts do not join to one line"), ("bow", "a ring crosses itself"), ("k0", "upstream objects form a cycle"), ("#7", "missing")}


def test_collection_writer(spark, tmp_path):
    seg = spark.createDataFrame([("v1", "s1", [{"x": 413237.6, "y": 6179889.0}, {"x": 413337.6, "y": 6179889.0}], "a", "b", 2.5, 65, 100.0, "base", 7863100.0)], "variant_id string, id string, pts array<struct<x:double,y:double>>, start_node_id string, end_node_id string, flow_tph double, dn int, length double, laying_method string, cost double")
    nodes = spark.createDataFrame([("v1", "c1", "heat_chamber", 413237.6, 6179889.0, 200, 3e6, None), ("v1", "t1", "technical_node", 413337.6, 6179889.0, None, None, "bend")], "variant_id string, id string, kind string, x double, y double, dn int, cost double, reason string")
    summary = spark.createDataFrame([("v1", 1, 10863100.0, 0.43712, ["o1"])], "variant_id string, rank int, calculated_cost double, score double, unconnected_oks_ids array<string>")
    parts = [features.summary_features(summary), features.to_features(seg), features.node_features(nodes)]
    features.write_collection(parts, str(tmp_path / "out"))
    got = json.loads("\n".join(r.value for r in spark.read.text(str(tmp_path / "out")).collect()))
    assert [f["properties"]["object_type"] for f in got["features"]] == ["variant_summary", "heat_network", "heat_chamber", "technical_node"]
    assert got["features"][0]["properties"]["score"] == 0.4371 and got["features"][0]["geometry"] is None
    features.write_collection([p.where("false") for p in parts], str(tmp_path / "none"))
    assert json.loads(spark.read.text(str(tmp_path / "none")).first().value)["features"] == []
    doc = features.criteria_json(spark.createDataFrame([("v1", 2, None)], "variant string, n_turns int, cost_per_tph double")).first()
    assert json.loads(doc.value) == {"n_turns": 2, "cost_per_tph": None}


def test_locate_and_centroid(spark):
    line = F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ((0, 0), (10, 0), (10, 10))])
    ring = F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ((0, 0), (6, 0), (6, 2), (0, 2), (0, 0))])
    got = one(spark, *[geometry.locate(line, F.lit(s)) for s in (-1.0, 4.0, 15.0, 99.0)], geometry.centroid(ring))
    assert [tuple(p) for p in got] == [(0.0, 0.0), (4.0, 0.0), (10.0, 5.0), (10.0, 10.0), (3.0, 1.0)]


def naive_diameters(edges):
    """Leaves to root, step by step: (node, parent, flow, length) -> dn."""
    table = [(d[0], d[1], d[2]) for d in R.diameters]
    at = {n: next(i for i, d in enumerate(table) if f <= d[1]) for n, _, f, _ in edges}
    kids = {}
    for n, p, _, _ in edges:
        kids.setdefault(p, []).append(n)
    flow, length = {n: f for n, _, f, _ in edges}, {n: l for n, _, _, l in edges}

    def run(n):
        return length[n] + max((run(k) for k in kids.get(n, []) if at[k] == at[n]), default=0.0)

    def order(n):
        for k in kids.get(n, []):
            yield from order(k)
        yield n

    roots = [n for n, p, _, _ in edges if p not in flow]
    while True:
        before = dict(at)
        for root in roots:
            for n in order(root):
                at[n] = max([at[n], *(at[k] for k in kids.get(n, []))])
                while run(n) > table[at[n]][2] + 1e-9:
                    at[n] += 1
        for n, p, f, _ in edges:
            if p in flow and len(kids[p]) == 1 and abs(f - flow[p]) <= 1e-3:
                at[n] = max(at[n], at[p])
        if at == before:
            return {n: table[i][0] for n, i in at.items()}


def test_diameter_plan_against_naive(spark):
    r = random.Random(5)
    edges = []
    for i in range(60):
        edges.append([f"n{i}", f"n{(i - 1) // 2}" if r.random() < 0.5 and i > 1 else (f"n{i - 1}" if i else "tie"), 0.0, round(r.uniform(20, 160), 2)])
    demand = {e[0]: r.choice([0.0, 0.0, 1.0, 3.0, 9.0]) for e in edges}
    for e in edges:
        n = e[0]
        while n != "tie":
            next(x for x in edges if x[0] == n)[2] += demand[e[0]]
            n = next(x for x in edges if x[0] == n)[1]
    edges = [tuple(e) for e in edges]
    got = {x.node: x.dn for x in planning.plan_diameters(spark.createDataFrame(edges, "node string, parent string, flow double, length double"), R).collect()}
    assert got == naive_diameters(edges)
    large = planning.plan_diameters(spark.createDataFrame(edges, "node string, parent string, flow double, length double"), R, most=10)
    assert {x.node: x.dn for x in large.collect()} == got


def test_diameters_of_a_long_chain():
    """10,000 pipes of one chain, the flow falling along it: every run within its diameter's limit, in one pass or two."""
    n, table = 10_000, [(d[0], d[1], float(d[2])) for d in R.diameters]
    began = time.time()
    at = planning.tree_diameters(list(range(n)), [k - 1 for k in range(n)], [3.0 + (n - k) * 1e-2 for k in range(n)], [7.0] * n, table)
    assert time.time() - began < 10 and at == sorted(at, reverse=True)
    run = {}
    for k in reversed(at):
        run[k] = run.get(k, 0.0) + 7.0
    assert all(k == len(table) or length <= table[k][2] + 1e-9 for k, length in run.items())


def test_more_constraints(spark):
    nodes = [("t", "v", "existing", 0.0, 0.0, 200, None, None), ("c", "v", "chamber", 100.0, 0.0, 65, 3e6, None), ("o1", "v", "consumer", 100.0, 50.0, None, None, 3.0), ("o2", "v", "consumer", 150.0, 0.0, None, None, 3.0), ("x", "v", "chamber", 9.0, 9.0, 65, 3e6, None)]
    n = spark.createDataFrame(nodes, NODE)
    good = spark.createDataFrame([segment("s1", "t", "c", [(0, 0), (100, 0)], 6.0, 65), segment("s2", "c", "o1", [(100, 0), (100, 50)], 3.0, 50), segment("s3", "c", "o2", [(100, 0), (150, 0)], 3.0, 50)], SEGMENT)
    loop = spark.createDataFrame([segment("l1", "p", "q", [(0, 0), (9, 9)], 1.0, 80), segment("l2", "q", "p", [(9, 9), (0, 0)], 1.0, 65)], SEGMENT)
    assert {(r.code, r.id) for r in validate.connected(good.union(loop), n).collect()} == {("C9", "l1"), ("C9", "l2")}
    assert {(r.code, r.id) for r in validate.degrees(good, n, R).collect()} == {("D10", "x")}
    assert {(r.code, r.id) for r in validate.chain_diameters(loop, n).collect()} == {("C7", "l1"), ("C7", "l2")}
    assert validate.least_diameters(good, R).collect() == [] and {r.id for r in validate.least_diameters(good.withColumn("dn", F.when(F.col("id") == "s2", 80).otherwise(F.col("dn"))), R).collect()} == {"s2"}
    road = spark.createDataFrame([("r", "road", 120.0, -5.0, 121.0, 5.0), ("g", "gas_pipeline", 30.0, -5.0, 90.0, 4.0), ("w", "sewer", 98.0, 20.0, 102.0, 21.0)], "id string, restriction_type string, x1 double, y1 double, x2 double, y2 double")
    found = {(r.code, r.id, r.detail) for r in validate.special_crossings(good, road, R).collect()}
    assert found == {("B13", "s1", "g"), ("B13", "s3", "r"), ("B13", "s2", "w")}
    near = spark.createDataFrame([("p", "power_cable", 20.0, 1.0, 60.0, 1.0)], road.schema)
    assert validate.line_clearance(good.where("id = 's1'").withColumn("pts", F.expr("array(named_struct('x', 0D, 'y', 0D), named_struct('x', 40D, 'y', 0D), named_struct('x', 100D, 'y', 0D))")), near, R).first().code == "B10"
    deep = {(r.code, r.id, r.detail) for r in validate.crossing_depths(good, road, R).collect()}
    assert ("G6", "s1", "g") in deep and not any(c == "G8" for c, _, _ in deep)
    summary = spark.createDataFrame([("v", 1, 1.0, 2.0, 200.0, 1.0, ["gone"])], "variant_id string, rank int, construction_cost double, calculated_cost double, new_length double, score double, unconnected_oks_ids array<string>")
    consumers = spark.createDataFrame([("v", "o1", 3.0), ("v", "gone", 1.0), ("v", "lost", 1.0)], "variant_id string, id string, flow double")
    assert {(r.code, r.id) for r in validate.totals(good, n, summary, consumers, R).collect()} == {("E5", "v"), ("E9", "lost")}
    park = spark.createDataFrame([("park", "park", [[{"x": -900.0, "y": -900.0}, {"x": 900.0, "y": -900.0}, {"x": 900.0, "y": 900.0}, {"x": -900.0, "y": 900.0}, {"x": -900.0, "y": -900.0}]])], "id string, restriction_type string, rings array<array<struct<x:double,y:double>>>")
    assert {(r.code, r.id) for r in validate.clearance(good, road.where("false"), R, areas=park).collect()} == {("B7", "s1"), ("B7", "s2"), ("B7", "s3")}
