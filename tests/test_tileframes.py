"""Stencils over tiles give what those over cells give."""

import numpy as np
import pytest

from orograph.operators import raster, tileframes


def held(df, *names):
    return {(r["i"], r["j"]): tuple(r[n] for n in names) for r in df.collect()}


def close(got, want):
    assert got.keys() == want.keys()
    assert np.allclose([got[k] for k in want], [want[k] for k in want], rtol=1e-9, atol=1e-9)


@pytest.fixture(scope="module")
def field(spark):
    r = np.random.default_rng(2)
    rows = [(i, j, float(r.normal() * 300 + 40 * i), float(r.normal() + 20 - j / 5)) for i in range(45) for j in range(38)]
    return spark.createDataFrame(rows, "i long, j long, elev double, temp double").repartition(6)


@pytest.fixture(scope="module")
def torn(field):
    """Cells missing, negative places, a null."""
    return field.where("(i * 7 + j * 3) % 41 > 0").selectExpr("i - 20 as i", "j - 9 as j", "case when i = 30 and j = 20 then null else elev end as elev", "temp")


@pytest.mark.parametrize("size", [7, 16, 64])
def test_tiles_come_back_as_cells(torn, size):
    got = held(tileframes.to_tiles(torn, ["temp", "elev"], size).cells().select("i", "j", "temp"), "temp")
    assert got == held(torn, "temp")


@pytest.mark.parametrize("size", [7, 16, 64])
def test_stencils_are_those_of_cells(field, torn, size):
    for cells in (field, torn):
        there = cells.where("elev is not null")
        tiles = tileframes.to_tiles(cells, ["elev"], size)
        close(held(tileframes.sobel_slope(tiles, 15.0).cells(), "slope"), held(raster.sobel_slope(there, "elev", 15.0), "slope"))
        assert held(tileframes.land_erosion(tiles).cells()).keys() == held(raster.land_erosion(there, "elev")).keys()
        both = tileframes.to_tiles(there, ["temp", "elev"], size)
        close(held(tileframes.local_lapse(both, 5).cells(), "base", "beta"), held(raster.local_lapse(there, "temp", "elev", 5), "base", "beta"))
    blurred = tileframes.gaussian_blur(tileframes.to_tiles(field, ["elev"], size), 45, 38)
    close(held(blurred.cells(), "elev"), held(raster.gaussian_blur(field, "elev", 45, 38), "elev"))
    # a stencil on a stencil
    twice = tileframes.sobel_slope(blurred, 15.0)
    close(held(twice.cells(), "slope"), held(raster.sobel_slope(raster.gaussian_blur(field, "elev", 45, 38), "elev", 15.0), "slope"))


def test_window_sums():
    x = np.random.default_rng(3).normal(size=(9, 8))
    got = tileframes.window_sums(x, 3)
    assert got.shape == (7, 6) and np.allclose(got, [[x[a : a + 3, b : b + 3].sum() for b in range(6)] for a in range(7)])


def written(spark, df):
    """Bytes of shuffle that a run of df writes."""
    sc = spark.sparkContext
    store, none = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, 0)

    def stages() -> dict[int, int]:
        found = store.stageList(None, False, False, none, None)
        return {found.apply(k).stageId(): found.apply(k).shuffleWriteBytes() for k in range(found.size())}

    seen = set(stages())
    df.write.format("noop").mode("overwrite").save()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(n for k, n in stages().items() if k not in seen)


def test_a_stencil_moves_little_more_than_its_tiles(spark):
    """An exchange of cells, then eight bytes a cell and the rims; less than a fifth of what cells move."""
    at = spark.range(256 * 256)
    cells = at.selectExpr("id div 256 as i", "id % 256 as j", "rand(3) * 100 as elev", "rand(4) as temp")
    plan = tileframes.sobel_slope(tileframes.to_tiles(cells, ["elev"]), 15.0).rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan
    tiles = tileframes.to_tiles(cells, ["temp", "elev"])
    stored = tiles.rows.cache()
    stored.count()
    moved = written(spark, tileframes.local_lapse(tileframes.TileFrame(stored, tiles.names)).rows)
    assert 0 < moved < 0.2 * written(spark, raster.local_lapse(cells, "temp", "elev"))
    stored.unpersist()


def test_a_stencil_reaches_a_tile_at_most(field):
    with pytest.raises(ValueError, match="tile"):
        tileframes.gaussian_blur(tileframes.to_tiles(field, ["elev"], 4), 45, 38)


def test_nothing(field):
    empty = tileframes.to_tiles(field.limit(0), ["elev"], 8)
    assert tileframes.sobel_slope(empty, 15.0).cells().count() == 0
