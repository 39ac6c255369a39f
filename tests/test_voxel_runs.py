"""Columns as runs hold the voxels that rows hold, through every pass."""

import random

import pytest
from pyspark.sql import functions as F

from orograph.operators import voxel
from orograph.plans.registry import QUERIES


@pytest.fixture(scope="module")
def columns(spark):
    r = random.Random(5)
    rows = [(k, r.choice([-2, 0, 1, 2, 5, 17, 18, 19, 20, 25, 40]), r.choice([True, False, None]), r.choice([True, False, None]), r.choice([True, False]), r.choice([True, False]), r.randrange(1 << 16)) for k in range(150)]
    return spark.createDataFrame(rows, "n int, surface_y int, ocean boolean, freezes boolean, ice boolean, steep boolean, soft int")


def rows_of(df):
    return sorted((r["n"], r["y"], r["block"] or "", r["fluid"] or "") for r in df.collect())


def test_passes_over_runs_are_those_over_rows(columns):
    top = F.col("surface_y")
    rows = voxel.fill_columns(columns, 20, ocean=F.col("ocean"), freezes=F.col("freezes"))
    held = columns.withColumn("runs", voxel.filled_runs(top, 20, F.col("ocean"), F.col("freezes")))
    assert rows_of(voxel.expanded(held)) == rows_of(rows)
    # soft blocks at places of a column's own
    soil = F.expr("shiftright(soft, pmod(surface_y - y, 16))") % 2 == 1
    rows = rows.withColumn("block", F.when(soil & (F.col("y") <= top), "gravel").otherwise(F.col("block")))
    one = held.select("n", "surface_y", "soft", "ice", "steep", F.explode("runs").alias("r")).select("*", F.explode(F.sequence("r.low", "r.high")).alias("y"))
    one = one.withColumn("block", F.when(soil & (F.col("y") <= top), "gravel").otherwise(F.col("r.block")))
    single = F.struct(F.col("y").alias("low"), "block", F.col("r.fluid").alias("fluid"), F.col("y").alias("high"))
    held = one.groupBy("n", "surface_y", "soft", "ice", "steep").agg(F.array_sort(F.collect_list(single)).alias("s"))
    runs = F.transform("s", lambda r: F.struct(r["block"].alias("block"), r["fluid"].alias("fluid"), r["low"].alias("low"), r["high"].alias("high"))).cast(voxel.RUNS)
    held = held.withColumn("runs", voxel.merged_runs(runs))
    assert held.agg(F.sum(F.size("runs"))).first()[0] < rows.count() / 1.3
    assert rows_of(voxel.expanded(held)) == rows_of(rows)
    want = voxel.surfaced(rows, F.col("ice"), F.col("steep"), ["n"])
    got = held.withColumn("runs", voxel.glacier_runs(F.col("runs"), F.col("ice"), top)).withColumn("runs", voxel.scoured_runs(F.col("runs"), F.col("steep"), top))
    assert rows_of(voxel.expanded(got)) == rows_of(want)
    assert rows_of(voxel.expanded(got.withColumn("runs", voxel.merged_runs(F.col("runs"))))) == rows_of(want)


def test_voxels_where_they_are_asked_for(spark):
    """Those that a join with all voxels finds, with columns that share a place, lack a surface or aren't there."""
    r = random.Random(8)
    rows = [(r.randrange(12), r.randrange(3), r.choice([None, -2, 0, 1, 18, 19, 20, 25]), r.choice([True, False, None]), r.choice([True, False, None])) for _ in range(60)]
    columns = spark.createDataFrame([*rows, (None, 1, 5, True, True)], "i long, j long, surface_y int, ocean boolean, freezes boolean")
    places = [(i, j, y) for i in (*range(14), None) for j in range(3) for y in (-3, 0, 1, 17, 18, 19, 20, 25, 26, None)]
    asked = spark.createDataFrame(places, "i long, j long, y int")
    every = voxel.fill_columns(columns, 20, ocean=F.col("ocean"), freezes=F.col("freezes")).select("i", "j", "y", "block", "fluid")
    want = asked.join(every, ["i", "j", "y"], "left")
    got = voxel.voxels_at(asked, columns, 20, ocean=F.col("ocean"), freezes=F.col("freezes"))
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_a_report_of_columns_sends_no_voxels_to_all_tasks(spark):
    report = QUERIES["report_column"](spark, "/root/testdata/sf0.01")
    for _ in range(2):
        assert "Broadcast" not in report._jdf.queryExecution().executedPlan().toString()
        report.collect()  # the plan may change as it runs


def test_scoured_runs_that_end_at_the_lowest_height(spark):
    """Soft runs longer than what may be scoured, across the surface and down to the ground."""
    r = random.Random(9)
    rows = []
    for k in range(80):
        ends = sorted(r.sample(range(0, 18), r.choice([1, 2, 4, 7])))
        runs = [(r.choice(["soil", "sand", "rock", None]), None, a + 1, b) for a, b in zip([-1, *ends], [*ends, 18], strict=True)]
        rows.append((k, r.choice([-1, 0, 3, 9, 14, 18, 25]), r.choice([True, True, False, None]), runs))
    held = spark.createDataFrame(rows, f"n int, surface_y int, steep boolean, runs {voxel.RUNS}")
    for most in (1, 3, 12, 30):
        want = voxel.scour(voxel.expanded(held), F.col("steep"), ["n"], most=most)
        got = voxel.expanded(held.withColumn("runs", voxel.scoured_runs(F.col("runs"), F.col("steep"), F.col("surface_y"), most)))
        assert rows_of(got) == rows_of(want)


def test_runs_are_worked_out_once(spark):
    """Neither a filter that Spark puts before the voxels nor a lambda works the passes over runs out anew."""
    for name in ("run_scour", "run_glacier"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
        lines = plan.toString().split("\n")
        assert not [x for x in lines if "Filter" in x and "lambda" in x]
        assert sum(x.count("lambdafunction(") for x in lines) < 40
