"""Stages over windows against plain numpy and plain loops."""

import numpy as np
import pytest

from orograph.operators import chains, grid


@pytest.fixture
def lattice(spark):
    x = np.arange(36 * 32).reshape(36, 32) * 37 % 101 / 7.0
    rows = [(i - 8, j - 8, float(x[i, j])) for i in range(36) for j in range(32)]
    return x, spark.createDataFrame(rows, "i long, j long, v double")


@pytest.fixture
def around():
    def around(wi, wj, given):
        x = given["v"]
        assert 1 <= len(wi) == len(wj) == len(x) <= 3
        n = x.shape[1] - 4
        return {"mean": sum(x[:, a : a + n, b : b + n] for a in range(5) for b in range(5)) / 25, "number": np.repeat(wi * 100 + wj, n * n)}

    return around


def test_stage_with_halo(spark, lattice, around):
    x, cells = lattice
    stage = chains.Stage("mean", grid.Windows(6, 4), grid.Windows(10, 4, -2))
    requested = spark.createDataFrame([(0, 9, 0, 5), (4, 12, 3, 13)], "i0 long, i1 long, j0 long, j1 long")
    wanted = chains.demand(requested, [stage])["mean"]
    out = chains.run_stage(cells, stage, wanted, around, ["v"], ["mean", "number"], batch=3).collect()
    places = {(r["wi"], r["wj"]) for r in wanted.collect()}
    assert len(out) == 36 * len(places) and {(r["wi"], r["wj"]) for r in out} == places
    for r in out:
        i, j = r["i"] + 8, r["j"] + 8
        assert r["mean"] == pytest.approx(x[i - 2 : i + 3, j - 2 : j + 3].mean()) and r["number"] == r["wi"] * 100 + r["wj"]
    # every requested place is made by each window over it
    made = {(r["i"], r["j"]) for r in out}
    assert {(i, j) for i in range(9) for j in range(5)} | {(i, j) for i in range(4, 12) for j in range(3, 13)} <= made


def test_window_that_is_not_whole(spark, lattice, around):
    _, cells = lattice
    stage = chains.Stage("mean", grid.Windows(6, 4), grid.Windows(10, 4, -2))
    wanted = spark.createDataFrame([(40, 0), (6, 0)], "wi long, wj long")
    with pytest.raises(Exception, match="window 6, 0 holds 60 cells, not 100"):
        chains.run_stage(cells, stage, wanted, around, ["v"], ["mean"]).collect()


def test_demand_by_loops(spark):
    stages = [chains.Stage("a", grid.Windows(4, 2, -1)), chains.Stage("b", grid.Windows(6, 4), grid.Windows(3, 2, -1)), chains.Stage("c", grid.Windows(16, 12), grid.Windows(8, 6, -2))]
    asked = [(0, 17, -9, 3), (100, 101, 40, 41)]

    def meets(w, lo, hi):
        return [n for n in range(-99, 99) if n * w.stride + w.offset < hi and n * w.stride + w.offset + w.size > lo]

    want, ranges = {}, asked
    for s in reversed(stages):
        want[s.name] = {(a, b) for i0, i1, j0, j1 in ranges for a in meets(s.made, i0, i1) for b in meets(s.made, j0, j1)}
        if s.name == "b":
            want["b"] -= {(0, 0)}
        if s.needs:
            start = lambda n, w=s.needs: n * w.stride + w.offset
            ranges = [(start(a), start(a) + s.needs.size, start(b), start(b) + s.needs.size) for a, b in want[s.name]]
    requested = spark.createDataFrame(asked, "i0 long, i1 long, j0 long, j1 long")
    found = chains.demand(requested, stages, {"b": spark.createDataFrame([(0, 0)], "wi long, wj long")})
    assert {k: {(r["wi"], r["wj"]) for r in v.collect()} for k, v in found.items()} == want


def test_empty(spark, lattice, around):
    _, cells = lattice
    stage = chains.Stage("mean", grid.Windows(6, 4), grid.Windows(10, 4, -2))
    none = spark.createDataFrame([], "i0 long, i1 long, j0 long, j1 long")
    wanted = chains.demand(none, [stage])["mean"]
    assert wanted.count() == 0 and chains.run_stage(cells, stage, wanted, around, ["v"], ["mean", "number"]).count() == 0
