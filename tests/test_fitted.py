"""What is fitted and applied in one plan, and lookups that don't depend on the order of rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orograph.functions import mapping
from orograph.operators import composers, search, stages, tiles


def test_quantile_rows_against_numpy(spark):
    r = random.Random(1)
    rows = [(c, r.choice([float(r.randrange(9)), r.gauss(0, 3)])) for c in "ab" for _ in range(400)] + [("c", 1.5), ("a", None), (None, 2.0)]
    df = spark.createDataFrame(rows, "c string, v double").repartition(5)
    fractions = [0.0, 0.001, 0.25, 0.5, 0.999, 1.0]
    for bins in (None, 3, 40):
        got = {(x["c"], x["place"]): x["v"] for x in search.quantile_rows(df, "v", ["c"], fractions, bins).where("c is not null").collect()}
        for c in "abc":
            want = np.quantile([v for k, v in rows if k == c and v is not None], fractions)
            assert np.allclose([got[c, k] for k in range(len(fractions))], want)


def test_repaired_tables_are_the_arrays_repaired(spark):
    tables = {"a": [1.0, 1.0, 1.0, 2.0, 2.0, 5.0], "b": [3.0, 3.0], "c": [1.0]}
    rows = spark.createDataFrame([(c, k, v) for c, t in tables.items() for k, v in enumerate(t)], "c string, place int, value double").repartition(4)
    got = {(r["c"], r["place"]): r["value"] for r in stages.repaired(rows, ["c"]).collect()}
    whole = spark.createDataFrame(list(tables.items()), "c string, t array<double>").select("c", stages.strictly_increasing(F.col("t")).alias("t")).collect()
    assert got == {(r["c"], k): v for r in whole for k, v in enumerate(r["t"])}


def test_heights_with_a_measured_gain(spark):
    heights = mapping.HeightMap()
    df = spark.createDataFrame([(float(e),) for e in range(-3000, 9000, 37)], "e double")
    for peak in (300.0, 2000.0, 9500.0, 60_000.0):
        own = mapping.HeightMap(peak_m=peak)
        gain = F.lit(own.blocks_per_metre)
        assert df.where(own.block_y(F.col("e")) != heights.block_y(F.col("e"), gain)).count() == 0


@pytest.fixture(scope="module")
def shuffled(spark):
    """Repeated points in an order that no two runs need share, and one without a place."""
    r = random.Random(3)
    points = [(k, r.choice([r.uniform(-2, 12), float(r.randrange(10))]), r.uniform(-2, 9)) for k in range(60)]
    points += [(100 + k, 4.25, 3.5) for k in range(40)] + [(200, None, 1.0)]
    return points, spark.createDataFrame(points, "n long, y double, x double").repartition(7, F.rand()).distinct()


def test_bilinear_points_of_shuffled_rows(spark, shuffled):
    points, df = shuffled
    field = np.random.default_rng(1).normal(size=(10, 7))
    cells = spark.createDataFrame([(i, j, float(field[i, j])) for i in range(10) for j in range(7)], "i long, j long, v double")
    got = {r["n"]: r["v"] for r in composers.bilinear_points(df, cells, ["v"], 10, 7, "y", "x").collect()}
    assert len(got) == len(points)
    for n, y, x in points:
        if y is None:
            assert got[n] is None
            continue
        y, x = min(max(y, 0), 9), min(max(x, 0), 6)
        i, j = int(y), int(x)
        i1, j1 = min(i + 1, 9), min(j + 1, 6)
        a = field[i, j] * (1 - (x - j)) + field[i, j1] * (x - j)
        b = field[i1, j] * (1 - (x - j)) + field[i1, j1] * (x - j)
        assert got[n] == pytest.approx(a * (1 - (y - i)) + b * (y - i))


def test_map_at_of_shuffled_rows(spark, shuffled):
    points, df = shuffled
    value = lambda i, j: (40 + i) << 16 | (90 + j) << 8 | (i * j) % 200
    blocks = spark.createDataFrame([(4 * i, 4 * j, value(i, j)) for i in range(-4, 12) for j in range(-4, 12)], "block_x int, block_z int, value int")
    maps = tiles.region_map(blocks, 16, 4, F.col("value"))
    got = {r["n"]: (r["high"], r["middle"], r["low"]) for r in tiles.map_at(df.withColumnsRenamed({"y": "block_x", "x": "block_z"}), maps, 16, 4).collect()}
    assert len(got) == len(points)
    for n, x, z in points:
        if x is None:
            assert got[n] == (None, None, None)
            continue
        ax, az = x / 4, z / 4
        i, j = int(np.floor(ax)), int(np.floor(az))
        taps = [((1 - ax + i if a == 0 else ax - i) * (1 - az + j if b == 0 else az - j), value(i + a, j + b)) for a in (0, 1) for b in (0, 1)]
        assert got[n] == tuple(int(np.floor(sum(w * (v >> s & 255) for w, v in taps) + 1e-9)) for s in (16, 8, 0))


def test_quantiles_of_many_fractions_cost_no_aggregate_each(spark):
    r = random.Random(2)
    rows = [(c, r.choice([1.0, 2.0, 2.0, r.gauss(0, 5)])) for c in "abc" for _ in range({"a": 1, "b": 50, "c": 700}[c])]
    df = spark.createDataFrame(rows, "c string, v double").repartition(3)
    fractions = [r.random() for _ in range(60)] + [1.0, 0.0, 0.5, 0.5]
    found = search.quantile_rows(df, "v", ["c"], fractions, 5)
    got = {(x["c"], x["place"]): x["v"] for x in found.collect()}
    assert len(got) == 3 * len(fractions)
    for c in "abc":
        assert np.allclose([got[c, k] for k in range(len(fractions))], np.quantile([v for k, v in rows if k == c], fractions))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("max(") < 20


def test_channels_stay_together_under_their_tables(spark):
    tables = {"a": ([0.0, 1.0, 3.0], [5.0, -5.0, 10.0]), "b": ([2.0], [7.0])}
    rows = spark.createDataFrame([(c, k, x, y) for c, (xs, ys) in tables.items() for k, (x, y) in enumerate(zip(xs, ys, strict=True))], "channel string, place int, x double, y double")
    values = [(k, k / 10 - 1.5 if k % 7 else None, float(k % 4), 1.0) for k in range(60)]
    noise = spark.createDataFrame(values, "n int, a double, b double, c double")
    out = stages.distributed_as(noise, rows.repartition(3), ["a", "b", "c"], 3)
    got = {r["n"]: r for r in out.collect()}
    for n, a, b, _ in values:
        assert got[n]["a"] == (None if a is None else pytest.approx(np.interp(a, *tables["a"]))) and got[n]["b"] == 7.0 and got[n]["c"] is None
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
