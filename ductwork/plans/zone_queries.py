"""Zones on the driver's tables: what their union shuts in, and which parts it has.

Walls are the edges of a box beside every part, 2 to 100 m a side; every third box lacks one edge. Their reach, 1.25 m, keeps whole
numbers clear of ties.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ductwork.operators import depth, spatial, zones
from ductwork.plans.network_queries import BOX, CUST, SEG, SUPP, _ps, chain, part_boxes, points, px, py, query
from ductwork.sources import extent
from ductwork.sources.tables import table
from ductwork.storage import shared_folder

WALLS = """zb as (select p_partkey as zone, x - h as x1, y - h as y1, x + h as x2, y + h as y2 from (select p_partkey, ((p_partkey * 7919) % 10007 + 31)::DOUBLE as x, ((p_partkey * 104729) % 10009 + 17)::DOUBLE as y, p_size::DOUBLE as h from part)),
wall as (select zone * 4 as id, zone, x1, y1, x2, y1 as y2 from zb where zone % 3 <> 0 union all select zone * 4 + 1, zone, x2, y1, x2, y2 from zb union all select zone * 4 + 2, zone, x1, y2, x2, y2 from zb union all select zone * 4 + 3, zone, x1, y1, x1, y2 from zb)"""
TOUCH = """touch as (select a.id as a, b.id as b, a.x1 as ax, a.y1 as ay, b.x1 as bx, b.y1 as "by", (greatest(a.x1, b.x1) + least(a.x2, b.x2)) / 2 as mx, (greatest(a.y1, b.y1) + least(a.y2, b.y2)) / 2 as my
  from wall a join wall b on a.id <> b.id and b.x1 <= a.x2 + 3 and a.x1 <= b.x2 + 3 and b.y1 <= a.y2 + 3 and a.y1 <= b.y2 + 3
  where greatest(b.x1 - a.x2, a.x1 - b.x2, 0) ** 2 + greatest(b.y1 - a.y2, a.y1 - b.y2, 0) ** 2 <= 6.25)"""


def walls(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("zone"), (px(F.col("p_partkey")) + 31).alias("x"), (py(F.col("p_partkey")) + 17).alias("y"), F.col("p_size").cast("double").alias("h"))
    at = lambda k, i, j, u, v: F.struct(F.lit(k).alias("k"), *[(F.col(c) + s * F.col("h")).alias(n) for n, c, s in (("x1", "x", i), ("y1", "y", j), ("x2", "x", u), ("y2", "y", v))])
    edges = p.select("zone", F.explode(F.array(at(0, -1, -1, 1, -1), at(1, 1, -1, 1, 1), at(2, -1, 1, 1, 1), at(3, -1, -1, -1, 1))).alias("e")).select("zone", "e.*")
    return edges.where("k > 0 or zone % 3 <> 0").select((F.col("zone") * 4 + F.col("k")).alias("id"), "zone", "x1", "y1", "x2", "y2", F.lit(1.25).alias("reach"))


def _odd(x1, y1, x2, y2):
    return f"(case when ({y1} > f.py) <> ({y2} > f.py) and {x1} + (f.py - {y1}) * ({x2} - {x1}) / ({y2} - {y1}) > f.px then 1 else 0 end)"


@query(f"""with recursive {CUST}, {WALLS}, {TOUCH},
near as (select cu.id as p, cu.x as px, cu.y as py, w.id as w, w.zone, greatest(w.x1 - x, x - w.x2, 0) ** 2 + greatest(w.y1 - y, y - w.y2, 0) ** 2 as d2 from cu join wall w on w.x1 <= x + 201 and w.x2 >= x - 201 and w.y1 <= y + 201 and w.y2 >= y - 201),
free as (select * from near where d2 <= 40200.25 and p not in (select p from near where d2 <= 1.5625)),
way as materialized (select f.p, a, b, xor({_odd('ax', 'ay', 'mx', 'my')}, {_odd('mx', 'my', 'bx', '"by"')}) as change from free f join touch on touch.a = f.w join free g on g.p = f.p and g.w = touch.b),
reach(p, origin, w, s) as (select p, w, w, 0 from free union select r.p, r.origin, v.b, xor(r.s, v.change) from reach r join way v on v.p = r.p and v.a = r.w)
select p as id, count(distinct zone)::BIGINT as n_zones, min(zone) as first_zone from reach join (select distinct id as wid, zone from wall) x on x.wid = reach.origin where origin = w and s = 1 group by p""")
def enclosed_points(spark, sf_dir):
    """Customers shut in by the walls within 200.5 m."""
    return zones.enclosed(points(spark, sf_dir, "customer", "c_custkey"), walls(spark, sf_dir), 200.5)


@query(f"""with recursive {WALLS}, {TOUCH}, t as materialized (select a, b from touch), reach(id, part) as (select id, id from wall union select r.id, t.b from reach r join t on t.a = r.part),
own as (select id, min(part) as part from reach group by id) select part, count(*)::BIGINT as n_walls, count(distinct zone)::BIGINT as n_zones, min(x1) as x1, min(y1) as y1, max(x2) as x2, max(y2) as y2 from own join wall using (id) group by part""")
def zone_unions(spark, sf_dir):
    """The connected parts of all walls, with their boxes."""
    w = walls(spark, sf_dir)
    side = lambda f, c: f(c).alias(c)
    return zones.unions(w).join(w.hint("merge"), "id").groupBy("part").agg(F.count(F.lit(1)).alias("n_walls"), F.countDistinct("zone").alias("n_zones"), side(F.min, "x1"), side(F.min, "y1"), side(F.max, "x2"), side(F.max, "y2"))


@query(f"""with {SUPP}, {BOX}, e as (select min(x) as x1, min(y) as y1, max(x) as x2, max(y) as y2 from su where id in (select s_suppkey from supplier where s_nationkey = 3))
select box.id, box.x1 as x_min, box.y1 as y_min, box.x2 as x_max, box.y2 as y_max from box, e where box.x2 >= e.x1 - 50 and box.y2 >= e.y1 - 50 and box.x1 <= e.x2 + 50 and box.y1 <= e.y2 + 50""")
def extent_scan(spark, sf_dir):
    """Part boxes, kept by place, within 50 m of the extent of one nation's suppliers: the scan skips row groups."""
    own = table(spark, sf_dir, "supplier").where("s_nationkey = 3").select(px(F.col("s_suppkey")).alias("x"), py(F.col("s_suppkey")).alias("y"))
    box = extent.extent(own.select(F.col("x").alias("x_min"), F.col("y").alias("y_min"), F.col("x").alias("x_max"), F.col("y").alias("y_max")))
    path = f"{shared_folder(spark)}/extent-{uuid.uuid4().hex}"
    extent.keep(part_boxes(spark, sf_dir).toDF("id", *extent.BOX), path)
    return extent.within(spark, path, box, 50.0)


@query(f"""with {CUST}, {SUPP}, {SEG.format('su')}, d as (select c_nationkey as group_id, min({_ps('cu.x', 'cu.y', 's')}) as d2 from cu join customer on c_custkey = cu.id join seg s on true group by 1)
select group_id, floor(d2 * 100 + 0.5) / 100.0::DOUBLE as d2, (row_number() over (order by d2, group_id) - 1)::BIGINT as place from d""")
def districts_by_distance(spark, sf_dir):
    """Nations as districts, nearest to the network first."""
    nation = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("group_id"))
    found = spatial.groups_by_distance(points(spark, sf_dir, "customer", "c_custkey").join(nation, "id"), chain(points(spark, sf_dir, "supplier", "s_suppkey")), 200.0)
    return found.withColumn("d2", F.floor(F.col("d2") * 100 + 0.5) / 100.0)


@query("""with p as (select l_orderkey, l_linenumber * 10 as st, max(l_quantity::BIGINT % 5) as depth from lineitem group by 1, 2), s as (select l_orderkey, st, depth, st - lag(st) over w as run, depth - lag(depth) over w as fall from p window w as (partition by l_orderkey order by st)),
b as (select *, lag(run) over w as run0, lag(fall) over w as fall0 from s window w as (partition by l_orderkey order by st)) select l_orderkey as chain_id, coalesce(sum(case when fall * run0 <> fall0 * run then 1 else 0 end), 0)::BIGINT as n_bends from b group by 1""")
def depth_bends(spark, sf_dir):
    """Orders as depth profiles, a station a line: changes of slope."""
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chain_id"), (F.col("l_linenumber") * 10).alias("at"), (F.col("l_quantity").cast("long") % 5).alias("depth"))
    return depth.bends(p)
