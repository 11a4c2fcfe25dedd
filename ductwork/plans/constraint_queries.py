"""The integrity constraints on the driver's tables, one query per family, with faults sown by key and a DuckDB twin each.

The drafted network is the heap of orders: node key, its parent (key - 1) div 2, places from integer keys in a square of 100 m,
demand at every consumer, flow, diameter, price and depths as the rules ask, except where a fault is sown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ductwork.operators import planning, spatial, trees, validate
from ductwork.plans.network_queries import BOX, DIM, POINT, ROUND2, RULES, SEG, SEGDIST, SUPP, _cr, _ps, chain, part_boxes, part_segments, points, px, py, query
from ductwork.rules import Rules, half_up
from ductwork.sources.tables import table
from ductwork.storage import stored

TIGHT = Rules(chamber_segments=2)
CHAMBER_PRICE = "case when dn between 50 and 200 then 3000000 when dn between 250 and 500 then 5000000 when dn between 600 and 1000 then 8000000 when dn between 1200 and 1400 then 12000000 end"
KIND = "case when key = 0 or key % 50 = 10 then 'existing' when key % 5 in (0, 1) then 'chamber' when key % 5 = 2 then 'technical' else 'consumer' end"
NET = f"""{DIM}, nd as (
  select o_orderkey as key, case when o_orderkey > 0 then (o_orderkey - 1) // 2 end as parent, ((o_orderkey * 7919) % 10007) / 100.0::DOUBLE as x, ((o_orderkey * 104729) % 10009) / 100.0::DOUBLE as y from orders
), node as (select *, {KIND} as kind, case when ({KIND}) = 'consumer' then key % 4 * 0.0625::DOUBLE else 0.0::DOUBLE end as demand from nd
), up(key, anc) as (select key, key from nd union all select u.key, t.parent from up u join nd t on t.key = u.anc where t.parent is not null
), sums as (select anc as key, sum(demand) as total from up join node on node.key = up.key group by anc
), raw as (
  select c.key, c.parent, p.x as x1, p.y as y1, c.x as x2, c.y as y2, (p.x + c.x) / 2 + (c.key % 7 - 3) as mx, (p.y + c.y) / 2 as my, case c.key % 6 when 0 then 4 when 3 then 3 else 2 end as n_pts, total,
    total + case when c.key % 101 = 5 then 1.0 else 0.0 end as flow, case when c.key % 53 = 7 then 50 when c.key % 211 = 3 then 55 else (select min(dn) from dim where cap >= total) end::INT as dn,
    case when c.key % 4 = 0 then 'special' else 'base' end as laying, case when c.key % 4 = 0 then 1.25 else 1.0 end::DOUBLE as k,
    2 + p.key % 16 * 0.1::DOUBLE + case when c.key % 83 = 4 then 0.5 else 0.0 end as depth_start, case when c.key % 89 = 6 then null when c.key % 97 = 8 then 0.5 else 2 + c.key % 16 * 0.1::DOUBLE end as depth_end
  from node c join node p on p.key = c.parent join sums on sums.key = c.key
), true_length as (select *, case n_pts when 2 then sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) when 3 then sqrt((mx - x1) * (mx - x1) + (my - y1) * (my - y1)) + sqrt((x2 - mx) * (x2 - mx) + (y2 - my) * (y2 - my))
    else sqrt((mx - x1) * (mx - x1) + (my - y1) * (my - y1)) + 0.5 + sqrt((x2 - mx - 0.5) * (x2 - mx - 0.5) + (y2 - my) * (y2 - my)) end as line from raw
), lengths as (select *, {ROUND2.format('line')} + case when key % 67 = 1 then 1.0 else 0.0 end as length from true_length
), seg as (select l.*, {ROUND2.format(ROUND2.format('length') + ' * d.rub * k')} + case when key % 71 = 2 then 100000 else 0 end as cost, d.rub, d.run as longest from lengths l left join dim d on d.dn = l.dn)"""


def network(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Segments and nodes of the drafted network, as the constraints take them."""
    key = F.col("key")
    nd = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.expr("case when o_orderkey > 0 then (o_orderkey - 1) div 2 end").alias("parent"), (px(F.col("o_orderkey")) / 100.0).alias("x"), (py(F.col("o_orderkey")) / 100.0).alias("y"))
    nd = nd.withColumn("kind", F.expr(KIND)).withColumn("demand", F.when(F.col("kind") == "consumer", key % 4 * 0.0625).otherwise(0.0))
    sums = trees.subtree_sums(nd.select(key.alias("node"), "parent", F.col("demand").alias("value"))).select(F.col("node").alias("key"), "total")
    up = nd.select(key.alias("parent"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    s = nd.withColumnRenamed("x", "x2").withColumnRenamed("y", "y2").join(up, "parent").join(sums, "key")
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    a, b = at(F.col("x1"), F.col("y1")), at(F.col("x2"), F.col("y2"))
    mx, my = (F.col("x1") + F.col("x2")) / 2 + (key % 7 - 3), (F.col("y1") + F.col("y2")) / 2
    pts = F.when(key % 6 == 0, F.array(a, at(mx, my), at(mx + 0.5, my), b)).when(key % 6 == 3, F.array(a, at(mx, my), b)).otherwise(F.array(a, b))
    depth = lambda c: 2 + c % 16 * 0.1
    s = s.select(
        key, F.concat(F.lit("s"), key).alias("id"), F.lit("v").alias("variant_id"), pts.alias("pts"), F.concat(F.lit("n"), "parent").alias("start_node"), F.concat(F.lit("n"), key).alias("end_node"),
        (F.col("total") + F.when(key % 101 == 5, 1.0).otherwise(0.0)).alias("flow"), F.when(key % 53 == 7, 50).when(key % 211 == 3, 55).otherwise(RULES.diameter_for_flow(F.col("total"))).cast("int").alias("dn"),
        F.when(key % 4 == 0, "special").otherwise("base").alias("laying"), F.when(key % 4 == 0, 1.25).otherwise(1.0).alias("k"),
        (depth(F.col("parent")) + F.when(key % 83 == 4, 0.5).otherwise(0.0)).alias("depth_start"), F.when(key % 89 == 6, None).when(key % 97 == 8, 0.5).otherwise(depth(key)).alias("depth_end"),
    )
    s = s.withColumn("length", half_up(validate.geometry.line_length(F.col("pts")), 2) + F.when(key % 67 == 1, 1.0).otherwise(0.0))
    s = s.withColumn("cost", RULES.segment_cost(F.col("length"), F.col("dn"), F.col("k")) + F.when(key % 71 == 2, 100000).otherwise(0))
    nodes = nd.select(key, F.concat(F.lit("n"), key).alias("id"), F.lit("v").alias("variant_id"), "kind", "x", "y", "demand")
    return stored(s), nodes


def codes(found: DataFrame) -> DataFrame:
    return found.select("code", "id")


OUT_TYPES = ("heat_network", "heat_chamber", "technical_node", "variant_summary")


@query(f"""with f as (select 'f' || (o_orderkey % 14000) as id, case o_orderkey % 9 when 0 then 'moon' when 8 then null else ['heat_network', 'heat_chamber', 'technical_node', 'variant_summary'][o_orderkey % 4 + 1] end as object_type from orders)
select 'A0' as code, id from f group by id having count(*) > 1 union all select 'A1', id from f where coalesce(object_type, '') not in {OUT_TYPES}""")
def constraint_ids(spark, sf_dir):
    """A0, A1."""
    key = F.col("o_orderkey")
    kind = F.when(key % 9 == 0, "moon").when(key % 9 == 8, None).otherwise(F.get(F.array(*map(F.lit, OUT_TYPES)), (key % 4).cast("int")))
    f = table(spark, sf_dir, "orders").select(F.concat(F.lit("f"), key % 14000).alias("id"), kind.alias("object_type"))
    return codes(validate.duplicate_ids(f).union(validate.object_types(f)))


@query(f"""with recursive {NET}, there as (select *, x + case when key % 307 = 12 then 1.0 else 0.0 end as nx from node where key % 301 <> 11), e as (select key, parent as node, x1 as x, y1 as y from raw union all select key, key, x2, y2 from raw)
select 'A2' as code, 's' || key as id from e where node not in (select key from there) union all select 'A3', 's' || e.key from e join there on there.key = e.node where (e.x - nx) ** 2 + (e.y - there.y) ** 2 > 0.0025""")
def constraint_ends(spark, sf_dir):
    """A2, A3."""
    s, nodes = network(spark, sf_dir)
    there = nodes.where("key % 301 <> 11").withColumn("x", F.col("x") + F.when(F.col("key") % 307 == 12, 1.0).otherwise(0.0))
    return codes(validate.node_references(s, there).union(validate.ends_at_nodes(s, there)))


def _turn(a, b, c):
    ux, uy, vx, vy = f"({b[0]} - {a[0]})", f"({b[1]} - {a[1]})", f"({c[0]} - {b[0]})", f"({c[1]} - {b[1]})"
    return f"degrees(atan2(abs({ux} * {vy} - {uy} * {vx}), {ux} * {vx} + {uy} * {vy}))"


P1, M, M2, P2 = ("x1", "y1"), ("mx", "my"), ("(mx + 0.5)", "my"), ("x2", "y2")


@query(f"""with recursive {NET}, t as (select key, {_turn(P1, M, P2)} as turn from raw where n_pts = 3 union all select key, {_turn(P1, M, M2)} from raw where n_pts = 4 union all select key, {_turn(M, M2, P2)} from raw where n_pts = 4)
select 'B1' as code, 's' || key as id from t where turn > 90.5 union all select 'B5', 's' || key from t where turn < 1 union all select 'B6', 's' || key from raw where n_pts = 4 union all select 'B2', 's' || key from raw where laying = 'special' and n_pts <> 2""")
def constraint_turns(spark, sf_dir):
    """B1, B2, B5, B6."""
    s, _ = network(spark, sf_dir)
    return codes(validate.turns(s).union(validate.special_is_straight(s)))


LINE_KIND = "case t.id % 3 when 0 then 'road' when 1 then 'gas_pipeline' else 'park' end"
SMALL = "tseg as (select p_partkey as id, x as x1, y as y1, x + p_size * 3.0 as x2, y + p_size * 2.0 as y2 from (select p_partkey, p_size, " + POINT.format("p_partkey") + " from part))"


def lines(spark, sf_dir) -> DataFrame:
    """Supplier segments as pipes of one piece."""
    c, key = chain(points(spark, sf_dir, "supplier", "s_suppkey")), F.col("id")
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return c.select(
        key, F.lit("v").alias("variant_id"), F.array(at("x1", "y1"), at("x2", "y2")).alias("pts"), RULES.snap_up(50 + key * 13 % 1300).alias("dn"), F.when(key % 2 == 0, "special").otherwise("base").alias("laying"),
        key.cast("string").alias("start_node"), (key + 1).cast("string").alias("end_node"), (2 + key % 5 * 0.3).alias("depth_start"), (2 + (key + 1) % 5 * 0.3).alias("depth_end"), F.lit(1.0).alias("length"),
    )


def objects(spark, sf_dir, kinds: tuple[str, ...]) -> DataFrame:
    return part_segments(spark, sf_dir).withColumn("restriction_type", F.get(F.array(*map(F.lit, kinds)), (F.col("id") % len(kinds)).cast("int")))


@query(f"""with {DIM}, {SUPP}, {SEG.format('su')}, {SMALL}, {BOX}, ln as (select *, (select min(dn) from dim where dn >= 50 + id * 13 % 1300)::INT as dn from seg), w as (select ln.*, width from ln join dim using (dn)),
d as (select s.id, t.id as other, case when t.id % 2 = 0 then 'metro' else 'oks_existing' end as kind, {SEGDIST} as d2, case when t.id % 2 = 0 then 10.0 else case when dn <= 400 then 5.0 when dn <= 800 then 7.0 else 9.0 end end + width / 2 as need from w s join tseg t on true),
bad as (select id, kind, other from d where sqrt(d2) < need - 0.01 union select s.id, 'park', box.id from seg s join box on box.id % 11 = 0 and s.x1 between box.x1 and box.x2 and s.y1 between box.y1 and box.y2)
select case when kind = 'oks_existing' then 'B3' else 'B7' end as code, id::VARCHAR as id from bad""")
def constraint_clearance(spark, sf_dir):
    """Pipes too near to buildings and forbidden objects, or inside areas."""
    corner = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    ring = F.array(corner("x1", "y1"), corner("x2", "y1"), corner("x2", "y2"), corner("x1", "y2"), corner("x1", "y1"))
    areas = part_boxes(spark, sf_dir).where("id % 11 = 0").select("id", F.lit("park").alias("restriction_type"), F.array(ring).alias("rings"))
    return codes(validate.clearance(lines(spark, sf_dir), objects(spark, sf_dir, ("metro", "oks_existing")), RULES, 250.0, areas))


MET = f"""met as (select s.*, t.id as other, {LINE_KIND} as kind, ((t.x1 - s.x1) * (t.y2 - t.y1) - (t.y1 - s.y1) * (t.x2 - t.x1)) / ((s.x2 - s.x1) * (t.y2 - t.y1) - (s.y2 - s.y1) * (t.x2 - t.x1)) as t, sqrt((s.x2 - s.x1) ** 2 + (s.y2 - s.y1) ** 2) as len,
  degrees(atan2(abs((s.x2 - s.x1) * (t.y2 - t.y1) - (s.y2 - s.y1) * (t.x2 - t.x1)), abs((s.x2 - s.x1) * (t.x2 - t.x1) + (s.y2 - s.y1) * (t.y2 - t.y1)))) as angle
  from seg s join tseg t on {_cr('s', 't.x1', 't.y1')} * {_cr('s', 't.x2', 't.y2')} < 0 and {_cr('t', 's.x1', 's.y1')} * {_cr('t', 's.x2', 's.y2')} < 0)"""


@query(f"""with {SUPP}, {SEG.format('su')}, {SMALL}, {MET}, x as (
select 'B9' as code, id, other from met where kind = 'road' and angle < 45 union select 'B12', id, other from met where kind in ('road', 'gas_pipeline') and id % 2 = 0 and least(t, 1 - t) * len < case kind when 'road' then 3.0 else 2.0 end - 0.1
union select 'B13', id, other from met where kind in ('road', 'gas_pipeline') and id % 2 = 1) select code, id::VARCHAR as id from x""")
def constraint_crossings(spark, sf_dir):
    """How pipes cross special objects."""
    return codes(validate.special_crossings(lines(spark, sf_dir), objects(spark, sf_dir, ("road", "gas_pipeline", "park")), RULES, 250.0))


@query(f"""with {SUPP}, {SEG.format('su')}, near as (select s.*, t.id as other, t.x1 as u1, t.y1 as v1, t.x2 as u2, t.y2 as v2, sqrt((s.x2 - s.x1) ** 2 + (s.y2 - s.y1) ** 2) as len from seg s join seg t on s.id // 2 % 3 = t.id // 2 % 3 and s.id::VARCHAR < t.id::VARCHAR where {SEGDIST} < 0.000001),
cut as (select id, other, case when other = id - 1 then x1 + (x2 - x1) * 0.15 / len else x1 end as x1, case when other = id - 1 then y1 + (y2 - y1) * 0.15 / len else y1 end as y1, case when other = id + 1 then x2 - (x2 - x1) * 0.15 / len else x2 end as x2, case when other = id + 1 then y2 - (y2 - y1) * 0.15 / len else y2 end as y2 from near where len > 0.15),
side as (select id, other, u1 as x1, v1 as y1, u2 as x2, v2 as y2 from near), x as (select distinct s.id, s.other from cut s join side t on t.id = s.id and t.other = s.other where {SEGDIST} < 0.000001) select 'B15' as code, id::VARCHAR as id from x""")
def constraint_self_crossings(spark, sf_dir):
    """Pipes of one variant meet only at common nodes; neighbours on the chain have one."""
    s = lines(spark, sf_dir).withColumn("variant_id", F.expr("id div 2 % 3")).withColumn("id", F.col("id").cast("string"))
    return codes(validate.self_crossings(s, 250.0))


@query(f"""with recursive {NET} select 'C0' as code, 's' || key as id from seg where dn not in (select dn from dim) union all select 'C2', 's' || key from seg where dn < coalesce((select min(dn) from dim where cap >= flow), 1 << 30)
union all select 'C1', 's' || key from seg where abs(flow - total) > 0.01 union all select 'C4', 's' || c.key from seg c join seg p on p.key = c.parent where p.dn < c.dn""")
def constraint_flows(spark, sf_dir):
    """C0, C1, C2, C4."""
    s, nodes = network(spark, sf_dir)
    return codes(validate.diameters(s, RULES).union(validate.flows(s, nodes)))


@query(f"""with recursive {NET}, walk(key, spot, run, dn) as (select key, key, length, dn from seg union all select w.key, p.key, w.run + p.length, w.dn from walk w join seg c on c.key = w.spot join seg p on p.key = c.parent where p.dn = w.dn),
runs as (select key, max(run) as run from walk group by key), sole as (select parent from seg group by parent having count(*) = 1), same as (select c.key, c.parent from seg c join seg p on p.key = c.parent where abs(c.flow - p.flow) <= 0.001 and c.dn <> p.dn)
select 'C5' as code, 's' || key as id from runs join seg using (key) where runs.run > longest + 1e-6 union all select 'C3', 's' || same.key from same join node on node.key = same.parent where kind = 'technical' union all select 'C7', 's' || same.key from same join sole using (parent)""")
def constraint_runs(spark, sf_dir):
    """C3, C5, C7."""
    s, nodes = network(spark, sf_dir)
    return codes(validate.runs(s, RULES).union(validate.chain_diameters(s, nodes)))


@query(f"""with recursive {NET}, cut as (select key, case when key % 997 = 13 then -key else parent end as parent from raw), reach(key) as (select key from cut join (select key as a from node where kind = 'existing') on a = cut.parent union select c.key from cut c join reach r on c.parent = r.key)
select 'C9' as code, 's' || key as id from cut where key not in (select key from reach)""")
def constraint_connected(spark, sf_dir):
    """Whatever hangs on no node of the existing network."""
    s, nodes = network(spark, sf_dir)
    cut = s.withColumn("start_node", F.when(F.col("key") % 997 == 13, F.concat(F.lit("lost"), "key")).otherwise(F.col("start_node")))
    return codes(validate.connected(cut, nodes))


def least_diameters(spark, sf_dir):
    """Diameters above what flow, children, runs and chains ask for. The fixpoint has no SQL form; a test compares it with a plain one."""
    return codes(validate.least_diameters(network(spark, sf_dir)[0], RULES))


@query(f"""with recursive {NET}, e as (select parent as key, dn, laying, k from seg union all select key, dn, laying, k from seg), deg as (select node.key, kind, count(e.dn) as n, count(distinct (e.dn, laying, k)) filter (e.dn is not null) as kinds from node left join e using (key) group by 1, 2)
select 'D1' as code, 'n' || key as id from deg where kind = 'technical' and n <> 2 and n > 0 union all select 'D2', 'n' || key from deg where kind = 'technical' and n = 2 and kinds = 1 union all select 'D3', 'n' || key from deg where n > 2 and kind not in ('chamber', 'existing')
union all select 'D5', 'n' || key from deg where n > 2 and kind = 'chamber' union all select 'D4', 'n' || key from deg where kind = 'consumer' and n > 1 union all select 'D6', 'n' || key from deg where kind = 'chamber' and n between 1 and 2
union all select 'D10', 'z' || key from node where key % 499 = 2""")
def constraint_degrees(spark, sf_dir):
    """D1-D6, D10; chambers are held to two segments here, so that D5 has rows."""
    s, nodes = network(spark, sf_dir)
    bare = nodes.where("key % 499 = 2").withColumn("id", F.concat(F.lit("z"), "key")).withColumn("kind", F.lit("chamber"))
    return codes(validate.technical_nodes(s, nodes).union(validate.branching(s, nodes, TIGHT)).union(validate.degrees(s, nodes.unionByName(bare), RULES)))


@query(f"""with recursive {NET}, e as (select parent as key, dn from seg union all select key, dn from seg), most as (select key, max(dn) as most from e group by key),
ch as (select node.*, most, case when key % 61 = 1 then 50 else coalesce((select min(dn) from dim where dn >= most), 1400) end as dn from node join most using (key) where kind = 'chamber'), priced as (select *, {CHAMBER_PRICE} as price from ch)
select 'D7' as code, 'n' || key as id from priced where dn < most union all select 'D8', 'n' || key from priced where key % 59 = 3
union all select 'D9', 'n' || c.key from priced c join node o on o.kind = 'existing' and (c.x - o.x) ** 2 + (c.y - o.y) ** 2 < (10.0 - 0.01) ** 2""")
def constraint_chambers(spark, sf_dir):
    """D7, D8, D9."""
    s, nodes = network(spark, sf_dir)
    most = s.select("dn", F.explode(F.array("start_node", "end_node")).alias("id")).groupBy("id").agg(F.max("dn").alias("most"))
    own = nodes.join(most, "id").withColumn("dn", F.when(F.col("key") % 61 == 1, 50).otherwise(RULES.snap_up(F.col("most")))).drop("most")
    own = own.withColumn("cost", RULES.chamber_price(F.col("dn")) + F.when(F.col("key") % 59 == 3, 1).otherwise(0))
    return codes(validate.chambers(s, own, RULES))


@query(f"""with recursive {NET}, want as (select *, {ROUND2.format(ROUND2.format('length') + ' * rub * k')} as price from seg) select 'E0' as code, 's' || key as id from want where abs(length - line) > 0.05 union all select 'E1', 's' || key from want where abs(cost - price) > greatest(1.0, 0.01 * rub * k)""")
def constraint_prices(spark, sf_dir):
    """E0, E1."""
    return codes(validate.lengths_and_costs(network(spark, sf_dir)[0], RULES))


@query(f"""with s as (select l_returnflag as v, sum({ROUND2.format('l_extendedprice / 1000')}::DECIMAL(18,2))::DOUBLE as length, sum(l_quantity::DECIMAL(18,2))::DOUBLE as cost from lineitem group by 1),
g as (select v, length, cost, length + case when v = 'R' then 1 else 0 end as new_length, row_number() over (order by v) as rank from s), z as (select *, floor((0.7 * cost / 25000000 + 0.3 * new_length / 100) * 10000 + 0.5) / 10000.0::DOUBLE + case when v = 'N' then 0.01 else 0 end as score from g)
select 'E6' as code, v as id from z where abs(new_length - length) > 0.05 union all select 'E7', v from z where v = 'N' union all select 'E8', a.v from z a join z b on b.rank = a.rank + 1 where (a.score, a.cost) > (b.score, b.cost)""")
def constraint_summaries(spark, sf_dir):
    """E6, E7, E8."""
    s = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("variant_id"), half_up(F.col("l_extendedprice") / 1000, 2).alias("length"), F.col("l_quantity").alias("cost"))
    z = s.groupBy("variant_id").agg(F.sum(F.col("length").cast("decimal(18,2)")).cast("double").alias("new_length"), F.sum(F.col("cost").cast("decimal(18,2)")).cast("double").alias("calculated_cost"))
    z = z.withColumn("new_length", F.col("new_length") + F.when(F.col("variant_id") == "R", 1).otherwise(0)).withColumn("rank", F.expr("row_number() over (order by variant_id)"))  # one row a variant
    z = z.withColumn("score", RULES.score(F.col("calculated_cost"), F.col("new_length")) + F.when(F.col("variant_id") == "N", 0.01).otherwise(0))
    return codes(validate.summaries(s, z, RULES))


@query("""with s as (select c_nationkey as v, c_custkey as id, count(*) as n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE as cost from customer join orders on o_custkey = c_custkey where o_orderkey % 3 = 0 group by 1, 2),
a as (select v, sum(cost::DECIMAL(18,2))::DOUBLE as a from s group by v), lost as (select c_nationkey as v, c_custkey as id, 100000000 + 500000 * (c_custkey % 8) as fine from customer where c_custkey % 7 = 0), d as (select v, sum(fine)::DOUBLE as d from lost group by v)
select 'E2' as code, v::VARCHAR as id from a where v % 6 = 2 union all select 'E5', v::VARCHAR from a where v % 5 = 1 union all select 'E9', c_custkey::VARCHAR from customer where c_custkey not in (select id from s) and c_custkey not in (select id from lost)""")
def constraint_totals(spark, sf_dir):
    """Nations are variants, customers their consumers."""
    cu = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("variant_id"), F.col("c_custkey").alias("id"), (F.col("c_custkey") % 8).cast("double").alias("flow"))
    o = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("cost"))
    s = o.join(cu, "id").select("variant_id", F.lit(None).cast("long").alias("start_node"), F.col("id").alias("end_node"), "cost")
    lost = cu.where("id % 7 = 0").groupBy("variant_id").agg(F.collect_list("id").alias("unconnected_oks_ids"), F.sum(RULES.penalty(F.col("flow")).cast("decimal(18,2)")).cast("double").alias("d"))
    sums = s.groupBy("variant_id").agg(F.sum(F.col("cost").cast("decimal(18,2)")).cast("double").alias("a")).join(lost, "variant_id", "left")
    z = sums.select("variant_id", (F.col("a") + F.when(F.col("variant_id") % 5 == 1, 100).otherwise(0)).alias("construction_cost"), (F.col("a") + F.coalesce("d", F.lit(0.0)) + F.when(F.col("variant_id") % 5 == 1, 100).otherwise(0)).alias("calculated_cost"), F.lit(1).alias("rank"), F.lit(1.0).alias("new_length"), F.when(F.col("variant_id") % 6 == 2, None).otherwise(1.0).alias("score"), "unconnected_oks_ids")
    nodes = cu.where("false").select("variant_id", "id", F.lit("chamber").alias("kind"), F.lit(0.0).alias("cost"))
    return codes(validate.totals(s, nodes, z, cu, RULES))


@query(f"""with recursive {NET}, e as (select parent as key, depth_start as d from seg union all select key, depth_end from seg), sp as (select key, max(d) - min(d) as gap from e group by key)
select 'G1' as code, 's' || key as id from seg where depth_start is null or depth_end is null union all select 'G2', 's' || key from seg where least(depth_start, depth_end) < 0.7 - 0.0015 union all select 'G3', 's' || key from seg where abs(depth_start - depth_end) > 0.1 * length + 0.0015
union all select 'G4', 's' || key from seg where (depth_start - 3.0) * (depth_end - 3.0) < -1e-6 union all select 'G5', 'n' || key from sp where gap > 0.0015""")
def constraint_depths(spark, sf_dir):
    """G1-G5."""
    s, _ = network(spark, sf_dir)
    none = s.limit(0).select(F.col("id"), F.lit("road").alias("restriction_type"), *[F.lit(0.0).alias(c) for c in ("x1", "y1", "x2", "y2")])
    return codes(validate.depths(s).union(validate.crossing_depths(s, none, RULES)))


HEIGHTS = ", ".join(f"({d[0]}, {d[6]})" for d in RULES.diameters)


@query(f"""with hd(dn, height) as (values {HEIGHTS}), {SUPP}, {SEG.format('su')}, {SMALL}, {MET}, deep as (select met.*, (2 + id % 5 * 0.3) + t * ((2 + (id + 1) % 5 * 0.3) - (2 + id % 5 * 0.3)) as top, (select height from hd where hd.dn >= 50 + met.id * 13 % 1300 order by hd.dn limit 1) as height from met),
x as (select distinct 'G6' as code, id, other from deep where kind = 'gas_pipeline' and not (top + height <= 2.8 - 0.2 + 0.0015 or top >= 2.8 + 0.4 + 0.2 - 0.0015) union all select distinct 'G4', id, null from seg where (2 + id % 5 * 0.3 - 3.0) * (2 + (id + 1) % 5 * 0.3 - 3.0) < -1e-6) select code, id::VARCHAR as id from x""")
def constraint_crossing_depths(spark, sf_dir):
    """Pipes over or under what they cross."""
    found = validate.crossing_depths(lines(spark, sf_dir), objects(spark, sf_dir, ("road", "gas_pipeline", "park")), RULES, 250.0)
    return codes(found.where("code in ('G4', 'G6')"))
