"""Deterministic random numbers and gradient noise, vectorised over cells in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the generator.
GOLDEN, MULTIPLIER, INCREMENT = 0x9E3779B9, 6364136223846793005, 1442695040888963407
MASK = (1 << 64) - 1


def tile_seed(base: int, ty: int, tx: int) -> int:
    """64-bit seed of a tile."""
    h = (base * GOLDEN + (ty & 0xFFFFFFFF)) & MASK
    return (h * GOLDEN + (tx & 0xFFFFFFFF)) & MASK


def outputs(seed: int, n: int) -> np.ndarray:
    """The first n 32-bit outputs; states are reached all at once by powers of the multiplier."""
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(n, MULTIPLIER, np.uint64))
        sums = np.cumsum(np.concatenate([[np.uint64(1)], powers[:-1]]).astype(np.uint64))
        state = np.uint64(seed) * powers + np.uint64(INCREMENT) * sums
        x = (((state >> np.uint64(18)) ^ state) >> np.uint64(27)).astype(np.uint32)
        rot = (state >> np.uint64(59)).astype(np.uint32)
        return (x >> rot) | (x << ((np.uint32(32) - rot) & np.uint32(31)))


def normals(seed: int, n: int) -> np.ndarray:
    """n standard normals by the polar method, in the order of the sequence."""
    made, size = np.zeros(0), 2 * n + 64
    while len(made) < n:
        u = 2.0 * (outputs(seed, size).astype(np.float64) + 1.0) / 2**32 - 1.0
        a, b = u[0::2], u[1::2]
        s = a * a + b * b
        ok = (s > 0) & (s < 1)
        f = np.sqrt(-2 * np.log(s[ok]) / s[ok])
        made = np.stack([a[ok] * f, b[ok] * f], axis=1).reshape(-1)
        size *= 2
    return made[:n].astype(np.float32)


def gaussian_patch(spark: SparkSession, seed: int, i0: int, i1: int, j0: int, j1: int, tile: int = 64) -> DataFrame:
    """(i, j, noise) of the half-open range: each tile of the lattice is seeded on its own, so that any range sees the same field."""
    ti = F.sequence(F.lit(i0 // tile), F.lit((i1 - 1) // tile))
    tj = F.sequence(F.lit(j0 // tile), F.lit((j1 - 1) // tile))
    tiles = spark.range(1).select(F.explode(ti).alias("ti"), tj.alias("c")).select("ti", F.explode("c").alias("tj"))
    tiles = tiles.repartition(F.col("ti"), F.col("tj"))

    cells = _patches(tiles, seed, tile)
    return cells.where(F.col("i").between(i0, i1 - 1) & F.col("j").between(j0, j1 - 1))


def _patches(tiles: DataFrame, seed: int, tile: int) -> DataFrame:
    """(i, j, noise) of whole tiles (ti, tj)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                i, j = np.meshgrid(np.arange(tile) + a * tile, np.arange(tile) + b * tile, indexing="ij")
                yield pa.RecordBatch.from_arrays([pa.array(i.reshape(-1)), pa.array(j.reshape(-1)), pa.array(normals(tile_seed(seed, a, b), tile * tile))], ["i", "j", "noise"])

    return tiles.mapInArrow(run, "i long, j long, noise float")


def with_gaussian(cells: DataFrame, seed: int, tile: int = 64) -> DataFrame:
    """cells (i, j) with the noise of the field of gaussian_patch() there; each tile that cells lie in is made once."""
    places = [F.floor(F.col(c) / float(tile)).cast("long").alias(f"t{c}") for c in ("i", "j")]
    tiles = cells.select(*places).where("ti is not null and tj is not null").distinct()
    return cells.join(_patches(tiles, seed, tile), ["i", "j"], "left")


def _hash(seed: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (x.astype(np.uint32) * np.uint32(0x85EBCA6B)) ^ (y.astype(np.uint32) * np.uint32(0xC2B2AE35)) ^ np.uint32(seed & 0xFFFFFFFF)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        h = (h ^ (h >> np.uint32(12))) * np.uint32(0x297A2D39)
        return h ^ (h >> np.uint32(15))


#: Fixed values of the lattice noise: the axes' primes, the factor of the hash, the scale of gradient noise.
PRIMES, HASH_FACTOR, PERLIN_SCALE = (501125321, 1136930381, 1720413743), 0x27D4EB2D, 1.4247691104677813


def lattice_hash(seed: int, *place: np.ndarray) -> np.ndarray:
    """32-bit hashes of whole places, of two or three coordinates."""
    with np.errstate(over="ignore"):
        h = np.full(len(place[0]), seed & 0xFFFFFFFF, np.uint32)
        for c, prime in zip(place, PRIMES, strict=False):
            h = h ^ (c.astype(np.uint32) * np.uint32(prime))
        return h * np.uint32(HASH_FACTOR)


def direction(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The unit vector of a hash: 128 of them, five rounds in steps of 15 degrees and one of 45."""
    k = ((h ^ (h >> np.uint32(15))) >> np.uint32(1)) & np.uint32(127)
    k = k.astype(np.int64)
    angle = np.radians(np.where(k < 120, 7.5 + 15 * (k % 24), 22.5 + 45 * (k - 120)))
    return np.sin(angle), np.cos(angle)


def perlin(seed: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Gradient noise with a quintic fade, in [-1, 1], in double precision."""
    xi, yi = np.floor(x).astype(np.int64), np.floor(y).astype(np.int64)
    xf, yf = x - xi, y - yi
    u, v = (t * t * t * (t * (t * 6 - 15) + 10) for t in (xf, yf))

    def corner(a: int, b: int) -> np.ndarray:
        gx, gy = direction(lattice_hash(seed, xi + a, yi + b))
        return gx * (xf - a) + gy * (yf - b)

    low = corner(0, 0) + u * (corner(1, 0) - corner(0, 0))
    high = corner(0, 1) + u * (corner(1, 1) - corner(0, 1))
    return (low + v * (high - low)) * PERLIN_SCALE


def fbm(seed: int, x: np.ndarray, y: np.ndarray, frequency: float, octaves: int, lacunarity: float = 2.0, gain: float = 0.5) -> np.ndarray:
    """Octaves of gradient noise, each with a seed of its own, scaled to [-1, 1]."""
    total, amplitude, bound = np.zeros(len(x)), 1.0, 0.0
    for k in range(octaves):
        total += amplitude * perlin(seed + k, x * frequency, y * frequency)
        bound += amplitude
        frequency, amplitude = frequency * lacunarity, amplitude * gain
    return total / bound


def fbm_column(seed: int, frequency: float, octaves: int, lacunarity: float = 2.0, gain: float = 0.5):
    """A column function (x, y) -> noise."""

    @F.pandas_udf("double")
    def noise(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(fbm(seed, x.to_numpy(float), y.to_numpy(float), frequency, octaves, lacunarity, gain))

    return noise


#: Channels of the synthetic map in their order, with the octaves of each (fixed values).
BANK = {"elev": 4, "temp": 2, "temp_std": 4, "precip": 4, "precip_std": 4}
BANK_FREQUENCY = 0.05


def bank_columns(world_seed: int, multipliers: list[float], stride: int = 1, i: str = "i", j: str = "j") -> dict[str, Column]:
    """The noise of each channel of the synthetic map at every stride-th place, each with its own seed and frequency."""
    named = {}
    for k, ((name, octaves), m) in enumerate(zip(BANK.items(), multipliers, strict=True)):
        named[name] = fbm_column((world_seed + k + 1) & 0x7FFFFFFF, BANK_FREQUENCY * m * stride, octaves)(i, j)
    return named


def noise_bank(cells: DataFrame, world_seed: int, multipliers: list[float]) -> DataFrame:
    """cells (i, j) with one noise column for each channel of the synthetic map."""
    return cells.withColumns(bank_columns(world_seed, multipliers))
