"""Tiles of the lattice as rows of arrays: neighbours exchange their rims only, stencils run over whole tiles.

A frame holds (ti, tj, planes): the values of a tile's cells by rows, one plane after the other, NaN
where a cell is missing. A stencil of some reach groups each tile with what its eight neighbours
have within that reach: one exchange of eight bytes a cell and the rims, whatever the stencil does,
where stencils over cells move a row for each neighbour. Windows are summed by tables of prefix
sums: four look-ups a cell, whatever the window's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orograph.operators.grid import tile_of
from orograph.operators.raster import gaussian_kernel

#: Cells of a tile by side.
SIZE = 64
#: (planes with rims, ti, tj) -> planes: arrays (plane, row, column).
Stencil = Callable[[np.ndarray, int, int], np.ndarray]
#: Where a neighbour lies.
SIDES = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]


def _lists(flat: np.ndarray, size: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, size, dtype=np.int32)), pa.array(flat)) if len(flat) else pa.array([], pa.list_(pa.float64()))


def _parts(lists: pa.Array) -> list[np.ndarray]:
    """The lists as arrays of doubles, nulls as NaN."""
    at = np.asarray(lists.offsets).tolist()
    flat = lists.values.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(at, at[1:], strict=False)]


def _gather(planes: int, size: int):
    @F.arrow_udf("array<double>")
    def gather(cells: pa.Array) -> pa.Array:
        at = np.asarray(cells.offsets)
        held = cells.values
        owner = np.repeat(np.arange(len(cells)), np.diff(at))
        place = np.asarray(held.field(0))[at[0] : at[-1]]
        out = np.full((len(cells), planes, size * size), np.nan)
        for k in range(planes):
            out[owner, k, place] = held.field(k + 1).to_numpy(zero_copy_only=False)[at[0] : at[-1]]
        return _lists(out.reshape(-1), planes * size * size)

    return gather


def _strip(reach: int, size: int, a: int, b: int) -> tuple[slice, slice]:
    """What the neighbour at (a, b) needs of a tile."""
    one = {-1: slice(0, reach), 0: slice(0, size), 1: slice(size - reach, size)}
    return one[a], one[b]


def _sent(planes: int, size: int, reach: int):
    @F.arrow_udf("array<array<double>>")
    def sent(tiles: pa.Array) -> pa.Array:
        strips = []
        for tile in _parts(tiles):
            x = tile.reshape(planes, size, size)
            strips += [x[(slice(None), *_strip(reach, size, a, b))].reshape(-1) for a, b in SIDES] + [tile]
        ends = np.cumsum([0, *map(len, strips)]).astype(np.int32)
        inner = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(strips) if strips else np.zeros(0)))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(strips) + 1, len(SIDES) + 1, dtype=np.int32)), inner)

    return sent


def _applied(stencil: Stencil, planes: int, size: int, reach: int):
    @F.arrow_udf("array<double>")
    def applied(ti: pa.Array, tj: pa.Array, held: pa.Array) -> pa.Array:
        wide = size + 2 * reach
        out = []
        ends = {-1: slice(0, reach), 0: slice(reach, reach + size), 1: slice(reach + size, wide)}
        at = np.asarray(held.offsets).tolist()
        sides, strips = np.asarray(held.values.field(0)), _parts(held.values.field(1))
        for k, (i, j) in enumerate(zip(ti.to_pylist(), tj.to_pylist(), strict=True)):
            x = np.full((planes, wide, wide), np.nan)
            for side, strip in zip(sides[at[k] : at[k + 1]].tolist(), strips[at[k] : at[k + 1]], strict=True):
                # a strip comes from the neighbour that has this tile at the opposite side; the last is the tile itself
                rows, cols = (ends[-c] for c in SIDES[side]) if side < len(SIDES) else (ends[0], ends[0])
                x[:, rows, cols] = strip.reshape(planes, *x[0, rows, cols].shape)
            out.append(np.asarray(stencil(x, i, j), float).reshape(-1))
        return _lists(np.concatenate(out) if out else np.zeros(0), len(out[0]) if out else 1)

    return applied


@dataclass(frozen=True)
class TileFrame:
    """rows: (ti, tj, planes), one row a tile; names: of the planes."""

    rows: DataFrame
    names: tuple[str, ...]
    size: int = SIZE

    def stencil(self, run: Stencil, reach: int, *names: str) -> TileFrame:
        """The frame with the planes that run makes of each tile and its rims; rims beyond the lattice are NaN."""
        if not 0 < reach <= self.size:
            raise ValueError("a stencil reaches one cell at least and one tile at most")
        n = len(self.names)
        shift = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in [*SIDES, (0, 0)]])
        sent = self.rows.select("ti", "tj", F.posexplode(_sent(n, self.size, reach)("planes")).alias("side", "strip"))
        to = F.get(shift, F.col("side"))
        sent = sent.select((F.col("ti") + to["a"]).alias("ti"), (F.col("tj") + to["b"]).alias("tj"), F.struct("side", "strip").alias("part"))
        held = sent.groupBy("ti", "tj").agg(F.collect_list("part").alias("parts"))
        # rims of tiles that don't exist go
        held = held.where(F.exists("parts", lambda p: p["side"] == len(SIDES)))
        return TileFrame(held.select("ti", "tj", _applied(run, n, self.size, reach)("ti", "tj", "parts").alias("planes")), names, self.size)

    def cells(self) -> DataFrame:
        """(i, j, names) of the cells whose first plane isn't NaN."""
        n = self.size * self.size
        parts = F.arrays_zip(*[F.slice("planes", k * n + 1, n).alias(name) for k, name in enumerate(self.names)])
        rows = self.rows.select("ti", "tj", F.posexplode(parts).alias("at", "v"))
        rows = rows.select((F.col("ti") * self.size + F.floor(F.col("at") / self.size)).alias("i"), (F.col("tj") * self.size + F.col("at") % self.size).alias("j"), *[F.col("v").getField(name).alias(name) for name in self.names])
        return rows.where(~F.isnan(self.names[0]))


def to_tiles(cells: DataFrame, values: list[str], size: int = SIZE) -> TileFrame:
    """Cells (i, j, values) as tiles: the one step that shuffles cells. Null values are NaN; of repeated cells one stays."""
    (ti, li), (tj, lj) = tile_of(F.col("i"), size), tile_of(F.col("j"), size)
    cell = F.struct((li * size + lj).alias("at"), *[F.col(v).cast("double").alias(v) for v in values])
    placed = cells.select(ti.alias("ti"), tj.alias("tj"), cell.alias("cell"))
    held = placed.groupBy("ti", "tj").agg(F.collect_list("cell").alias("cells"))
    return TileFrame(held.select("ti", "tj", _gather(len(values), size)("cells").alias("planes")), tuple(values), size)


def unpacked(frame: TileFrame) -> DataFrame:
    """(i, j, names) like TileFrame.cells(), by a table function over Arrow batches of one partition for each tile."""
    size, names = frame.size, frame.names

    @F.arrow_udtf(returnType=f"i long, j long, {', '.join(f'{n} double' for n in names)}")
    class Cells:
        def eval(self, tiles: pa.RecordBatch) -> Iterator[pa.Table]:
            for ti, tj, tile in zip(tiles.column("ti").to_pylist(), tiles.column("tj").to_pylist(), _parts(tiles.column("planes")), strict=True):
                x = tile.reshape(len(names), -1)
                at = np.flatnonzero(~np.isnan(x[0]))
                yield pa.table([pa.array(ti * size + at // size), pa.array(tj * size + at % size), *[pa.array(v[at]) for v in x]], ["i", "j", *names])

    return Cells(frame.rows.select("ti", "tj", "planes").asTable().partitionBy("ti", "tj"))


def sobel_slope(frame: TileFrame, pixel_m: float) -> TileFrame:
    """(slope) of the cells all of whose eight neighbours exist, of the first plane."""

    def run(x: np.ndarray, ti: int, tj: int) -> np.ndarray:
        v = x[0]
        across, down = v[:, :-2] + 2 * v[:, 1:-1] + v[:, 2:], v[:-2] + 2 * v[1:-1] + v[2:]
        dy, dx = across[2:] - across[:-2], down[:, 2:] - down[:, :-2]
        return np.where(np.isnan(v[1:-1, 1:-1]), np.nan, np.hypot(dx / 8, dy / 8) / pixel_m)[None]

    return frame.stencil(run, 1, "slope")


def land_erosion(frame: TileFrame) -> TileFrame:
    """(land), 1 for cells that with all eight neighbours are above 0 in the first plane."""

    def run(x: np.ndarray, ti: int, tj: int) -> np.ndarray:
        land = x[0] > 0
        rows = land[:-2] & land[1:-1] & land[2:]
        return np.where(rows[:, :-2] & rows[:, 1:-1] & rows[:, 2:], 1.0, np.nan)[None]

    return frame.stencil(run, 1, "land")


def gaussian_blur(frame: TileFrame, rows: int, cols: int, sigma: float = 5.0) -> TileFrame:
    """The first plane blurred over a whole lattice of rows x cols, its edges replicated."""
    kernel = gaussian_kernel(sigma)
    reach, size = len(kernel) // 2, frame.size

    def run(x: np.ndarray, ti: int, tj: int) -> np.ndarray:
        i, j = (np.clip(np.arange(t * size - reach, (t + 1) * size + reach), 0, n - 1) - (t * size - reach) for t, n in ((ti, rows), (tj, cols)))
        wide = len(i)
        v = x[0][np.clip(i, 0, wide - 1)][:, np.clip(j, 0, wide - 1)]
        across = sum(w * v[:, k : k + size] for k, w in enumerate(kernel))
        out = sum(w * across[k : k + size] for k, w in enumerate(kernel))
        return np.where(np.isnan(x[0][reach:-reach, reach:-reach]), np.nan, out)[None]

    return frame.stencil(run, reach, frame.names[0])


def window_sums(x: np.ndarray, win: int) -> np.ndarray:
    """Sums over every whole window of win x win, by a table of prefix sums."""
    total = np.zeros((x.shape[0] + 1, x.shape[1] + 1))
    np.cumsum(np.cumsum(x, axis=0), axis=1, out=total[1:, 1:])
    return total[win:, win:] - total[:-win, win:] - total[win:, :-win] + total[:-win, :-win]


def local_lapse(frame: TileFrame, win: int = 15, least_land: float = 0.02) -> TileFrame:
    """(base, beta) of planes (temperature, elevation): see raster.local_lapse(), of which these are the numbers."""
    n, pad = win * win, (win - 1) // 2

    def run(x: np.ndarray, ti: int, tj: int) -> np.ndarray:
        there = ~np.isnan(x).any(axis=0)
        t, e = np.where(there, x, 0.0)
        land = there & (e > 0)
        # about the tile's own mean, so that differences of prefix sums keep their digits
        mt, me = (float(v[land].mean()) if land.any() else 0.0 for v in (t, e))
        t0, e0 = np.where(land, t - mt, 0.0), np.where(land, e - me, 0.0)
        w, st, se, see, set_ = (window_sums(v, win) for v in (land.astype(float), t0, e0, e0 * e0, e0 * t0))
        den = w + 1e-6
        # back to the sums that the means are taken of
        see, set_ = see + 2 * me * se + me * me * w, set_ + me * st + mt * se + me * mt * w
        st, se = st + mt * w, se + me * w
        var, cov = see / den - (se / den) ** 2, set_ / den - se / den * (st / den)
        with np.errstate(divide="ignore", invalid="ignore"):
            beta = np.where((var < 1) | (w < least_land * n), -0.0065, cov / (var + 1e-6))
        beta = np.clip(beta, -0.012, 0.0)
        whole = window_sums(there.astype(float), win) > n - 0.5
        own_t, own_e = x[:, pad : x.shape[1] - pad, pad : x.shape[2] - pad]
        return np.where(whole, [own_t - beta * own_e, beta], np.nan)

    return frame.stencil(run, pad, "base", "beta")
