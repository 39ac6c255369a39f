"""Every registered query against its SQL, and generators against plain versions."""

import math
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from orograph.functions import climate
from orograph.operators import diffusion, grid, noise, raster
from orograph.plans import registry

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    plain = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 5) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, str(DATA)).toPandas()
    want = duck.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, str(DATA)).count() > 0


def test_erfc(spark):
    from pyspark.sql import functions as F

    x = spark.range(101).select(((F.col("id") - 50) / 10).alias("x"))
    for r in x.select("x", climate.erfc(F.col("x")).alias("y")).collect():
        assert r["y"] == pytest.approx(math.erfc(r["x"]), abs=2e-7)


def one_by_one(seed: int, n: int) -> list[float]:
    state, out, mask = seed, [], (1 << 64) - 1

    def step():
        nonlocal state
        state = (state * noise.MULTIPLIER + noise.INCREMENT) & mask
        x, rot = (((state >> 18) ^ state) >> 27) & 0xFFFFFFFF, state >> 59
        return ((x >> rot) | (x << ((32 - rot) & 31))) & 0xFFFFFFFF

    while len(out) < n:
        a, b = (2.0 * (step() + 1.0) / 2**32 - 1.0 for _ in range(2))
        s = a * a + b * b
        if 0 < s < 1:
            f = math.sqrt(-2 * math.log(s) / s)
            out += [a * f, b * f]
    return out[:n]


def test_normals_follow_the_sequence():
    seed = noise.tile_seed(1234, -2, 3)
    assert np.allclose(noise.normals(seed, 501), one_by_one(seed, 501), atol=1e-6)


def test_noise_patch_doesnt_depend_on_the_range(spark):
    small = noise.gaussian_patch(spark, 9, 10, 40, -20, 20, tile=16).toPandas().set_index(["i", "j"]).sort_index()
    large = noise.gaussian_patch(spark, 9, -40, 80, -64, 64, tile=16).toPandas().set_index(["i", "j"]).loc[small.index]
    assert (small.noise == large.noise).all() and len(small) == 30 * 40


def test_blur_against_numpy(spark):
    field = np.random.default_rng(1).normal(size=(9, 7))
    cells = spark.createDataFrame([(i, j, float(field[i, j])) for i in range(9) for j in range(7)], "i long, j long, v double")
    kernel = np.array(raster.gaussian_kernel(2.0))
    p = len(kernel) // 2
    across = sum(w * np.pad(field, ((0, 0), (p, p)), "edge")[:, k : k + 7] for k, w in enumerate(kernel))
    want = sum(w * np.pad(across, ((p, p), (0, 0)), "edge")[k : k + 9] for k, w in enumerate(kernel))
    got = raster.gaussian_blur(cells, "v", 9, 7, 2.0).toPandas()
    assert len(got) == 63
    assert np.allclose([want[r.i, r.j] for r in got.itertuples()], got.v)


@pytest.mark.parametrize("size,stride,offset", [(8, 6, 0), (4, 4, -1), (3, 5, 2), (7, 2, -3)])
def test_window_numbers(spark, size, stride, offset):
    w = grid.Windows(size, stride, offset)
    got = grid.to_windows(spark.range(-20, 20).selectExpr("id i", "0L j"), grid.Windows(size, stride, offset)).select("i", "wi").distinct().collect()
    want = {(i, k) for i in range(-20, 20) for k in range(-60, 60) if k * stride + offset <= i < k * stride + offset + size}
    assert {(r["i"], r["wi"]) for r in got} == (want if any(k * w.stride + w.offset <= 0 < k * w.stride + w.offset + w.size for k in range(-60, 60)) else set())


def test_overlap_add_of_a_field_returns_it(spark):
    from pyspark.sql import functions as F

    cells = spark.range(40).selectExpr("id div 8 i", "id % 8 j", "id * 1.5D v")
    windowed = grid.to_windows(cells, grid.Windows(8, 6))
    out = grid.overlap_add(windowed, "v", grid.tent(F.col("li"), 8) * grid.tent(F.col("lj"), 8)).join(cells.withColumnRenamed("v", "want"), ["i", "j"])
    assert out.where("abs(v - want) > 1e-9").count() == 0 and out.count() == 40


def test_solver_against_a_loop(spark):
    """Midpoint steps over given predictions, one number after the other."""
    steps = 7
    noises, outputs = np.random.default_rng(4).normal(size=(5, 3)), np.random.default_rng(5).normal(size=(5, steps, 3))
    df = spark.createDataFrame([(k, noises[k].tolist(), outputs[k].tolist()) for k in range(5)], "k long, x array<double>, p array<array<double>>")
    got = {r["k"]: r["y"] for r in df.select("k", diffusion.solved(df["x"], df["p"], steps).alias("y")).collect()}
    s = [(80.0 ** (1 / 7) + n / (steps - 1) * (0.002 ** (1 / 7) - 80.0 ** (1 / 7))) ** 7 for n in range(steps)] + [0.0]
    for k in range(5):
        x, before = noises[k] * s[0], None
        for n in range(steps):
            clean = 0.25 / (s[n] ** 2 + 0.25) * x + s[n] * 0.5 / math.sqrt(s[n] ** 2 + 0.25) * outputs[k][n]
            used = clean
            if 0 < n < steps - 1:
                used = clean + (clean - before) * math.log(s[n] / s[n + 1]) / math.log(s[n - 1] / s[n]) / 2
            x, before = s[n + 1] / s[n] * x - (s[n + 1] / s[n] - 1) * used, clean
        assert np.allclose(got[k], x)
