"""State over streams that stop and go on, chunks that are written again, and small operators against loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from orograph.operators import grid, noise, search, tileframes, voxel
from orograph.sources import chunks
from orograph.streaming import recent


def test_last_keys_survive_a_restart(spark, tmp_path):
    r = random.Random(1)
    start = dt.datetime(2024, 1, 1)
    rows = [(k, start + dt.timedelta(seconds=k // 3), r.choice([1, 1, 1, 2, 3]), r.choice("abc")) for k in range(900)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string")
    want = {x["event_id"]: x["repeats"] for x in search.repeats_in_last(df, "event_type", ["ts", "event_id"], partition="user_id").collect()}

    def arrive(low: int, high: int) -> None:
        df.where(F.col("event_id").between(low, high - 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run() -> None:
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        recent.run_to_end(recent.repeats_in_last(stream, "event_type", ["ts", "event_id"], "user_id", "event_id"), str(tmp_path / "out"), str(tmp_path / "state"))

    arrive(0, 150)
    arrive(150, 400)
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 400
    arrive(400, 900)
    run()
    run()  # nothing new
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 900 and {x["event_id"]: x["repeats"] for x in got} == want


def test_chunks_replace_only_themselves(spark, tmp_path):
    path = str(tmp_path / "chunks")
    cells = spark.range(64).selectExpr("id div 8 as i", "id % 8 as j", "id as v").withColumns({"ci": F.floor(F.col("i") / 4).cast("int"), "cj": F.floor(F.col("j") / 4).cast("int")})
    chunks.write_chunks(cells, path, ["ci", "cj"], ["i", "j"])
    before = {x["f"] for x in chunks.read_chunks(spark, path, "ci = 0").select(F.input_file_name().alias("f")).collect()}
    again = cells.where("ci = 1 and cj = 1").withColumn("v", -F.col("v"))
    for _ in range(2):
        chunks.write_chunks(again, path, ["ci", "cj"], ["i", "j"])
    held = chunks.read_chunks(spark, path)
    want = {(x["i"], x["j"]): x["v"] * (-1 if x["ci"] == x["cj"] == 1 else 1) for x in cells.collect()}
    assert {(x["i"], x["j"]): x["v"] for x in held.collect()} == want and held.count() == 64
    assert {x["f"] for x in chunks.read_chunks(spark, path, "ci = 0").select(F.input_file_name().alias("f")).collect()} == before
    plan = chunks.read_chunks(spark, path, "ci = 1 and cj = 0")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ci" in plan and "PushedFilters: []" in plan
    rows = chunks.read_chunks(spark, path, "ci = 1 and cj = 0").collect()
    assert [(x["i"], x["j"]) for x in rows] == sorted((x["i"], x["j"]) for x in rows)


@pytest.mark.parametrize("box", [(-5, 3, 20, 9), (2, 2, 3, 3), (-9, -9, 4, 4), (8, 5, 6, 1), (0, 0, 1, 1)])
def test_clamped_crop_against_a_loop(spark, box):
    i0, j0, height, width = box
    cells = spark.range(48).selectExpr("id div 6 as i", "id % 6 as j", "id as v").repartition(3)
    got = {(r["i"], r["j"]): r["v"] for r in grid.clamped_crop(cells, i0, j0, height, width, 8, 6).collect()}
    assert got == {(r, c): min(max(i0 + r, 0), 7) * 6 + min(max(j0 + c, 0), 5) for r in range(height) for c in range(width)}


def test_codes_and_guards(spark):
    given = [" Hot\t", "ICY", "icy ", "", "  ", None, "hot cold", "cool"]
    df = spark.createDataFrame(list(enumerate(given)), "n int, c string")
    assert [r["p"] for r in df.orderBy("n").select(search.parsed_code(F.col("c")).alias("p")).collect()] == ["hot", "icy", "icy", None, None, None, None, "cool"]
    levels = spark.createDataFrame([(y,) for y in (-1, 0, 1, 254, 255, 256, None)], "y int")
    assert [r["y"] for r in levels.where(voxel.buildable(F.col("y"), 256)).collect()] == [1, 254]


def test_noise_at_places_is_that_of_a_patch(spark):
    places = spark.createDataFrame([(i, j) for i in (-70, -1, 0, 63, 64) for j in (-3, 5, 200)] + [(None, 1)], "i long, j long")
    got = {(r["i"], r["j"]): r["noise"] for r in noise.with_gaussian(places, 5).collect()}
    patch = {(r["i"], r["j"]): r["noise"] for r in noise.gaussian_patch(spark, 5, -70, 65, -3, 201).collect()}
    assert got.pop((None, 1)) is None
    assert got == {k: patch[k] for k in got} and len(got) == 15


def test_unpacked_tiles_are_their_cells(spark):
    cells = spark.range(300).selectExpr("id div 20 - 4 as i", "id % 20 - 7 as j", "id * 1.5D as v", "-id * 1.0D as w").where("(i + j) % 5 <> 0")
    frame = tileframes.to_tiles(cells, ["v", "w"], 6)
    rows = lambda df: sorted(map(tuple, df.select("i", "j", "v", "w").collect()))
    assert rows(tileframes.unpacked(frame)) == rows(frame.cells()) == rows(cells)
