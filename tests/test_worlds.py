"""Sources, stages, tiles, surveys and rankings against plain versions."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orograph.operators import composers, noise, raster, search, stages, survey, tiles
from orograph.sources import model

CONFIG = {"coarse_means": [0.0] * 6, "coarse_stds": [1.0] * 6, "cond_snr": [0.3] * 5, "frequency_mult": [1.0] * 5, "coarse_pooling": 4, "latent_compression": 8, "native_resolution": 30.0}


def test_model_configurations(spark, tmp_path):
    bad = CONFIG | {"cond_snr": [1.0], "coarse_pooling": 0, "histogram_raw": [1.0]}
    for name, held in (("good", CONFIG), ("bad", bad), ("empty", {})):
        (tmp_path / f"{name}.json").write_text(json.dumps(held, indent=1))
    assert model.model_configs(spark, str(tmp_path / "good.json")).first()["problems"] == []
    assert model.model_configs(spark, str(tmp_path / "bad.json")).first()["problems"] == ["cond_snr must hold 5 values", "histogram_raw must hold 5 values", "coarse_pooling must be positive"]
    assert len(model.model_configs(spark, str(tmp_path / "empty.json")).first()["problems"]) == 7
    assert model.model_configs(spark, str(tmp_path / "*.json")).count() == 3
    assert json.loads(model.config_text(bad | {"other": 1})) == bad


def test_quantile_tables(spark, tmp_path):
    held = {"n_quantiles": 3, "data_quantile_tables": [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]], "a_temp_std": -8.0, "b_temp_std": 3.0, "temp_std_p1": 1.0, "temp_std_p99": 9.0}
    (tmp_path / "t.json").write_text(json.dumps(held))
    rows = model.quantile_tables(spark, str(tmp_path / "t.json")).collect()
    assert sorted((r["channel"], r["place"], r["value"]) for r in rows) == [(c, k, 1.0 + 3 * c + k) for c in range(2) for k in range(3)]
    (tmp_path / "u.json").write_text(json.dumps(held | {"n_quantiles": 4}))
    with pytest.raises(Exception, match="another length"):
        model.quantile_tables(spark, str(tmp_path / "u.json")).collect()


def test_calibration_store(spark, tmp_path):
    path = str(tmp_path / "calibration")
    assert model.calibration(spark, path) is None
    model.save_calibration(spark.createDataFrame([(812.5, 40, 8)], "peak_m double, land_cells int, half int"), path)
    assert model.calibration(spark, path) == 812.5
    model.save_calibration(spark.createDataFrame([(0.5, 40, 8)], "peak_m double, land_cells int, half int"), path)
    assert model.calibration(spark, path) is None


@pytest.mark.parametrize("n", [1, 2, 7, 500])
def test_quantiles_and_ranks(spark, n):
    r = random.Random(n)
    values = [r.choice([0.5, 0.25, r.random(), r.random() * 1e6]) for _ in range(n)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(n, None)], "i long, v double")
    fractions = [0.0, 0.1, 0.5, 0.77, 1.0]
    assert np.allclose(search.quantiles(df, "v", fractions).first()[0], np.quantile(values, fractions))
    for q in (0.5, 0.9, 0.995, 1.0):
        want = sorted(values, reverse=True)[min(int(n * (1 - q)), n - 1)]
        assert search.tail_order_statistic(df, "v", q).first()[0] == want
    order = sorted(range(n), key=lambda i: (-values[i], i))
    pool = max(1, int(n * 0.25))
    got = {x["probe"]: x["i"] for x in search.probes(df.where("v is not null"), "v", ["i"], 4).collect()}
    assert got == {p: order[p * pool // 4] for p in range(4)}
    assert search.quantiles(df.limit(0), "v", fractions).first()[0] == [None] * 5


def test_no_task_ranks_all_rows(spark):
    df = spark.range(1000).selectExpr("id i", "0L j", "id * 1.0D v", "id * 0.5D t")
    for out in (search.probes(df, "v", ["i"], 4), search.quantiles(df, "v", [0.5]), search.tail_order_statistic(df, "v", 0.9)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        for part in plan.split("Exchange SinglePartition")[1:]:
            # only partial aggregates and the totals of bins meet in one partition
            assert "HashAggregate" in part.split("\n")[1] + part.split("\n")[2]


def test_stencils_against_numpy(spark):
    r = np.random.default_rng(3)
    h = r.normal(size=(9, 8)) * 50
    cells = spark.createDataFrame([(i, j, float(h[i, j])) for i in range(9) for j in range(8)], "i long, j long, v double")
    got = {(x["i"], x["j"]): x["slope"] for x in raster.sobel_slope(cells, "v", 10.0).collect()}
    kx = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]) / 8
    for i in range(1, 8):
        for j in range(1, 7):
            w = h[i - 1 : i + 2, j - 1 : j + 2]
            assert got[i, j] == pytest.approx(math.hypot((w * kx).sum(), (w * kx.T).sum()) / 10)
    assert len(got) == 7 * 6
    land = {(x["i"], x["j"]) for x in raster.land_erosion(cells, "v").collect()}
    assert land == {(i, j) for i in range(1, 8) for j in range(1, 7) if (h[i - 1 : i + 2, j - 1 : j + 2] > 0).all()}


def test_strictly_increasing(spark):
    def plain(q):
        steps = [b - a for a, b in zip(q, q[1:], strict=False) if b > a]
        out = list(q)
        for k in range(1, len(q)):
            if out[k] <= out[k - 1]:
                out[k] = out[k - 1] + (min(steps) if steps else 1e-10) * 0.1
        return out

    tables = [[1.0, 1.0, 1.0, 2.0, 2.0, 5.0], [3.0], [], [2.0, 2.0], [0.0, 1.0, 1.0, 1.05]]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(tables)], "k int, t array<double>").select("k", stages.strictly_increasing(F.col("t")).alias("t")).collect()
    for x in got:
        assert x["t"] == pytest.approx(plain(tables[x["k"]]), abs=1e-15)


def test_concat_scales_keep_unit_magnitude():
    for sizes, shares in (([6, 5], None), ([16, 4, 1], [1.0, 2.0, 0.5])):
        scales = stages.concat_scales(sizes, shares)
        assert sum(n * s * s for n, s in zip(sizes, scales, strict=True)) == pytest.approx(sum(sizes))


def test_lookup_against_numpy(spark):
    xs, ys = [0.0, 1.0, 3.0], [5.0, -5.0, 10.0]
    df = spark.range(60).select((F.col("id") / 10 - 1.5).alias("x"))
    for r in df.select("x", stages.lookup(F.col("x"), F.array(*map(F.lit, xs)), F.array(*map(F.lit, ys))).alias("y")).collect():
        assert r["y"] == pytest.approx(np.interp(r["x"], xs, ys))


def test_points_and_regions(spark, tmp_path):
    field = np.arange(12.0).reshape(3, 4) ** 1.5
    cells = spark.createDataFrame([(i, j, float(field[i, j])) for i in range(3) for j in range(4)], "i long, j long, v double")
    points = spark.createDataFrame([(0, -5.0, -5.0), (1, 1.25, 2.5), (2, 9.0, 9.0), (3, 2.0, 0.5), (3, 2.0, 0.5)], "k int, gy double, gx double")
    got = sorted((r["k"], r["v"]) for r in composers.bilinear_points(points, cells, ["v"], 3, 4).collect())
    mid = 0.75 * (field[1, 2] + field[1, 3]) / 2 + 0.25 * (field[2, 2] + field[2, 3]) / 2
    edge = (field[2, 0] + field[2, 1]) / 2
    assert [k for k, _ in got] == [0, 1, 2, 3, 3]
    assert [v for _, v in got] == pytest.approx([field[0, 0], mid, field[2, 3], edge, edge])
    blocks = spark.range(-16, 33).selectExpr("id block_x", "0L block_z", "cast(id + 16 as int) * 65536 value")
    maps = tiles.region_map(blocks, 16, 4, F.col("value"))
    tiles.write_region_maps(maps, str(tmp_path / "maps"))
    held = spark.read.parquet(str(tmp_path / "maps"))
    assert sorted(map(tuple, held.select("region_x", "region_z", "x", "z", "value").collect())) == sorted(map(tuple, maps.collect()))
    # the first place of a region is also the last of the one before it
    assert {(r["region_x"], r["x"]) for r in held.where("value = 16 * 65536").collect()} == {(0, 0), (-1, 4)}
    asked = spark.createDataFrame([(0, -2.0, 0.0), (1, 15.0, 0.0), (2, 900.0, 0.0)], "k int, block_x double, block_z double")
    assert sorted((r["k"], r["high"]) for r in tiles.map_at(asked, held, 16, 4).collect()) == [(0, 14), (1, 31), (2, None)]


def test_calibration_without_land(spark):
    sea = spark.range(100).selectExpr("id div 10 i", "id % 10 j", "-1.0D elev_m")
    assert survey.calibration(sea, sea, (5, 5), 2).count() == 0
    hill = sea.withColumn("elev_m", F.when(F.col("i") == 9, 700.0).otherwise(-1.0))
    row = survey.fitted(survey.calibration(hill, hill.limit(0), (5, 5), 2), 143).first()
    assert (row["half"], row["land_cells"], row["peak_m"]) == (128, 10, 700.0 * 1.6)


def test_noise_patch_is_the_written_sequence(spark):
    """The patch, tile by tile, from the generator's own formulas, one number after another."""
    seed, size, mask = 77, 4, (1 << 64) - 1

    def tile(ty: int, tx: int) -> list[float]:
        state = ((seed * 0x9E3779B9 + (ty & 0xFFFFFFFF)) * 0x9E3779B9 + (tx & 0xFFFFFFFF)) & mask
        out: list[float] = []
        while len(out) < size * size:
            pair = []
            for _ in range(2):
                state = (state * 6364136223846793005 + 1442695040888963407) & mask
                x, rot = (((state >> 18) ^ state) >> 27) & 0xFFFFFFFF, state >> 59
                pair.append(2.0 * ((((x >> rot) | (x << ((32 - rot) & 31))) & 0xFFFFFFFF) + 1.0) / 2**32 - 1.0)
            s = pair[0] ** 2 + pair[1] ** 2
            if 0 < s < 1:
                out += [v * math.sqrt(-2 * math.log(s) / s) for v in pair]
        return out

    got = {(r["i"], r["j"]): r["noise"] for r in noise.gaussian_patch(spark, seed, -6, 7, -5, 6, tile=size).collect()}
    assert len(got) == 13 * 11
    for (i, j), v in got.items():
        assert v == pytest.approx(tile(i // size, j // size)[i % size * size + j % size], abs=1e-5)
