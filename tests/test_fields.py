"""Edges, noise fields and settings against plain versions."""

import math

import duckdb
import numpy as np
import pytest

from orograph.operators import fields
from orograph.plans import registry
from orograph.sources import settings

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["extrapolated_resize", "border_taper"])
def test_edges_against_sql(spark, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM '{SF}/part.parquet'")
    want = db.execute(registry.ORACLE_SQL[name]).df()
    got = registry.QUERIES[name](spark, SF).toPandas()
    keys = [c for c in want.columns if c in ("i", "j", "cx", "cz", "x", "z")]
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want) > 0
    both = got.merge(want, on=keys)
    assert len(both) == len(want)
    for c in set(want.columns) - set(keys):
        assert np.allclose(both[f"{c}_x"], both[f"{c}_y"], atol=2e-4)


def test_noise_fields():
    x, y = (a.reshape(-1) for a in np.meshgrid(np.linspace(-9, 9, 91), np.linspace(-7, 7, 57)))
    for f in (fields.value, lambda s, a, b: fields.perlin3(s, a, b, a * 0.3 + 0.1)):
        v = f(5, x, y)
        assert np.abs(v).max() <= 1 and v.std() > 0.1 and (v == f(5, x, y)).all() and (v != f(6, x, y)).any()
        assert np.abs(f(5, x + 1e-6, y) - v).max() < 1e-4
    # the nearest point of all cells around, one by one
    from orograph.operators.noise import _hash

    a, b = (t.reshape(-1) for t in np.meshgrid(np.arange(-13, 14), np.arange(-13, 14)))
    px, py = a + _hash(5, a, b) / 2**32, b + _hash(6, a, b) / 2**32
    d = np.sort(np.hypot(x[:, None] - px, y[:, None] - py), axis=1)
    assert np.allclose(fields.cellular(5, x, y), d[:, 0]) and np.allclose(fields.cellular(5, x, y, returns="second"), d[:, 1])
    assert np.allclose(fields.cellular(5, x, y, returns="sum"), d[:, 0] + d[:, 1]) and np.allclose(fields.cellular(5, x, y, returns="product"), d[:, 0] * d[:, 1])
    assert np.allclose(fields.cellular(5, x, y, returns="ratio"), d[:, 0] / d[:, 1])
    for fold in ("none", "ridged", "ping_pong"):
        v = fields.fractal(fields.perlin, 5, x, y, 0.3, 3, fold)
        assert np.abs(v).max() <= 1 + 1e-9
    wx, wy = fields.warped(5, x, y, 0.3, 2.0, octaves=2)
    assert 0 < np.abs(wx - x).max() <= 3 and 0 < np.abs(wy - y).max() <= 3


def test_settings(spark, tmp_path):
    plain = settings.settings()
    assert plain["TerrainTileSizeBlocks"] == 256 and plain["HeightMode"] == "isotropic"
    odd = settings.settings({"TerrainTileSizeBlocks": 100, "PeakQuantile": math.nan, "HeightMode": " AUTO ", "RainfallBasis": "?", "MinAutoExaggeration": 50, "GlacierIce": "no", "ScaleOverride": 99, "CalibrationProbes": -1})
    assert (odd["TerrainTileSizeBlocks"], odd["PeakQuantile"], odd["HeightMode"], odd["RainfallBasis"]) == (96, 0.995, "auto", "moisture")
    assert (odd["MaxAutoExaggeration"], odd["GlacierIce"], odd["ScaleOverride"], odd["CalibrationProbes"]) == (50.0, True, 16, 0)
    path = str(tmp_path / "settings.json")
    assert settings.load(spark, path) == plain
    settings.save(spark, path, odd)
    assert settings.load(spark, path) == odd
    rows = spark.createDataFrame([(" 2.5 ",), ("",), (None,), ("x",)], "v string")
    assert [r[0] for r in rows.select(settings.typed(rows.v, "double", 1.0)).collect()] == [2.5, 1.0, 1.0, 1.0]
