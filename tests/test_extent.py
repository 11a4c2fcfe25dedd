"""Features kept by place: the same rows as a plain filter, from fewer row groups."""

import random
import uuid

from pyspark.sql import functions as F

from ductwork.sources import extent

SCHEMA = "id long, parts array<array<struct<x:double,y:double>>>"


def path(spark):
    return f"{spark.sparkContext.getConf().get('spark.checkpoint.dir')}/extent-{uuid.uuid4().hex}"


def test_a_window_reads_few_row_groups_and_all_its_rows(spark):
    rows = spark.range(200_000).select("id", (F.rand(1) * 50_000).alias("x_min"), (F.rand(2) * 50_000 - 20_000).alias("y_min"), F.rand(3).alias("w"))
    rows = rows.select("id", "x_min", "y_min", (F.col("x_min") + 30 * F.col("w")).alias("x_max"), (F.col("y_min") + 40 * F.col("w")).alias("y_max"))
    kept = path(spark)
    extent.keep(rows, kept, row_group_bytes=64 << 10)
    window = (20_000.0, -3_000.0, 24_000.0, 1_000.0)
    got = extent.within(spark, kept, window, 25.0)
    found = {r.id for r in got.collect()}
    want = {r.id for r in rows.where("x_max >= 19975 and y_max >= -3025 and x_min <= 24025 and y_min <= 1025").collect()}
    assert found == want and 1000 < len(found) < 3000
    scan = got._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().get("numOutputRows").get().value() < 100_000  # rows of the row groups that were not skipped
    assert "GreaterThanOrEqual(x_max" in got._jdf.queryExecution().executedPlan().toString()
    assert spark.read.parquet(kept).count() == 200_000


def test_boxes_and_odd_rows(spark):
    r = random.Random(5)
    line = [[(r.uniform(0, 9), r.uniform(0, 9)) for _ in range(3)] for _ in range(2)]
    flat = [p for part in line for p in part]
    rows = extent.boxed(spark.createDataFrame([(1, line), (2, []), (3, None), (4, [[(500.0, 500.0)]]), (4, [[(500.0, 500.0)]])], SCHEMA))
    box = rows.where("id = 1").first()
    assert (box.x_min, box.y_min, box.x_max, box.y_max) == (min(p[0] for p in flat), min(p[1] for p in flat), max(p[0] for p in flat), max(p[1] for p in flat))
    assert extent.extent(rows)[2:] == (500.0, 500.0) and extent.extent(rows.where("id in (2, 3)")) is None
    kept, empty = path(spark), path(spark)
    extent.keep(rows, kept)
    assert sorted(x.id for x in spark.read.parquet(kept).collect()) == [1, 2, 3, 4, 4]
    assert [x.id for x in extent.within(spark, kept, (400.0, 400.0, 450.0, 450.0), 50.0).collect()] == [4, 4]
    assert extent.within(spark, kept, None).count() == 0
    extent.keep(rows.where("id > 9"), empty)
    assert extent.within(spark, empty, (0.0, 0.0, 1.0, 1.0)).count() == 0
