"""More noise fields beside gradient noise: value, simplex, cellular and three-dimensional noise, folded fractals, warped domains.

All are pure functions of a seed and arrays of places, evaluated over Arrow batches. The cellular
field's points have this library's own hash, and so has the order of seeds in a warp; all others
are those of the gradient noise's lattice.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from orograph.operators.noise import _hash, direction, lattice_hash, perlin

Field = Callable[[int, np.ndarray, np.ndarray], np.ndarray]


def _fade(t: np.ndarray) -> np.ndarray:
    return t * t * t * (t * (t * 6 - 15) + 10)


def _unit(h: np.ndarray) -> np.ndarray:
    """Hashes as numbers in [0, 1)."""
    return h.astype(np.float64) / 2**32


def _number(seed: int, *place: np.ndarray) -> np.ndarray:
    """A hashed number in [-1, 1) at each whole place."""
    h = lattice_hash(seed, *place)
    h = h * h
    h = h ^ (h << np.uint32(19))
    return h.astype(np.int32) / 2.0**31


def value(seed: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A hashed number at each lattice point, blended smoothly between them, in [-1, 1]."""
    xi, yi = np.floor(x).astype(np.int64), np.floor(y).astype(np.int64)
    u, v = (t * t * (3 - 2 * t) for t in (x - xi, y - yi))
    at = lambda a, b: _number(seed, xi + a, yi + b)
    low, high = (at(0, b) + u * (at(1, b) - at(0, b)) for b in (0, 1))
    return low + v * (high - low)


def value_cubic(seed: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hashed numbers of the 4 x 4 lattice points around, blended by cubics that pass through them, in [-1, 1]."""
    xi, yi = np.floor(x).astype(np.int64), np.floor(y).astype(np.int64)
    weights = []
    for t in (x - xi, y - yi):
        # weights of the four numbers, so that rows and columns are sums of products
        weights.append((-(t**3) + 2 * t**2 - t, t**3 - 2 * t**2 + 1, -(t**3) + t**2 + t, t**3 - t**2))
    rows = (weights[1][b] * sum(weights[0][a] * _number(seed, xi + a - 1, yi + b - 1) for a in range(4)) for b in range(4))
    return sum(rows) / 2.25


#: Fixed values of simplex noise: how a kernel reaches (squared), the scale, and which lattice points can lie in reach.
SIMPLEX = {"sharp": (0.5, 99.83685446303647, range(2)), "smooth": (2 / 3, 18.24196194486065, range(-1, 3))}
#: Between the square lattice and the triangular one.
_SKEW, _UNSKEW = (np.sqrt(3) - 1) / 2, (3 - np.sqrt(3)) / 6


def simplex(seed: int, x: np.ndarray, y: np.ndarray, kind: str = "sharp") -> np.ndarray:
    """Gradients on a triangular lattice, each fading to nothing at its reach, in [-1, 1]."""
    reach, scale, around = SIMPLEX[kind]
    shift = (x + y) * _SKEW
    xs, ys = x + shift, y + shift
    xi, yi = np.floor(xs).astype(np.int64), np.floor(ys).astype(np.int64)
    total = np.zeros(len(x))
    for a in around:
        for b in around:
            dx, dy = xs - xi - a, ys - yi - b
            back = (dx + dy) * _UNSKEW
            dx, dy = dx - back, dy - back
            gx, gy = direction(lattice_hash(seed, xi + a, yi + b))
            total += np.maximum(0, reach - dx * dx - dy * dy) ** 4 * (gx * dx + gy * dy)
    return total * scale


#: How far two places are.
DISTANCES = {
    "euclidean": lambda a, b: np.sqrt(a * a + b * b),
    "squared": lambda a, b: a * a + b * b,
    "manhattan": lambda a, b: np.abs(a) + np.abs(b),
    "hybrid": lambda a, b: np.abs(a) + np.abs(b) + a * a + b * b,
}


def cellular(seed: int, x: np.ndarray, y: np.ndarray, distance: str = "euclidean", returns: str = "nearest", jitter: float = 1.0) -> np.ndarray:
    """From one point in each lattice cell: the distance to the nearest or second, their difference, sum, product or ratio (nearest / second), or the nearest's number.

    jitter, 0 to 1, is the share of its cell in which a point lies. Two cells each way are
    looked through, which holds the two nearest points.
    """
    xi, yi = np.floor(x).astype(np.int64), np.floor(y).astype(np.int64)
    first, second, owner = np.full(len(x), np.inf), np.full(len(x), np.inf), np.zeros(len(x))
    for a in range(-2, 3):
        for b in range(-2, 3):
            px = xi + a + 0.5 + jitter * (_unit(_hash(seed, xi + a, yi + b)) - 0.5)
            py = yi + b + 0.5 + jitter * (_unit(_hash(seed + 1, xi + a, yi + b)) - 0.5)
            d = DISTANCES[distance](px - x, py - y)
            nearer = d < first
            second = np.where(nearer, first, np.minimum(second, d))
            owner = np.where(nearer, 2 * _unit(_hash(seed + 2, xi + a, yi + b)) - 1, owner)
            first = np.where(nearer, d, first)
    return {"nearest": first, "second": second, "difference": second - first, "sum": first + second, "product": first * second, "ratio": first / second, "cell": owner}[returns]


#: Fixed values of the three-dimensional noise: the middles of a cube's edges, five rounds and four more, and the scale.
_EDGES = [(0, 1, 1), (0, -1, 1), (0, 1, -1), (0, -1, -1), (1, 0, 1), (-1, 0, 1), (1, 0, -1), (-1, 0, -1), (1, 1, 0), (-1, 1, 0), (1, -1, 0), (-1, -1, 0)]
_EDGES = np.array(_EDGES * 5 + [(1, 1, 0), (0, -1, 1), (-1, 1, 0), (0, -1, -1)], float)
PERLIN3_SCALE = 0.964921414852142333984375


def perlin3(seed: int, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Gradient noise over three dimensions, in [-1, 1]."""
    base = [np.floor(t).astype(np.int64) for t in (x, y, z)]
    at = np.stack([t - b for t, b in zip((x, y, z), base, strict=True)], axis=1)
    fades = _fade(at)
    total = np.zeros(len(x))
    for corner in np.ndindex(2, 2, 2):
        h = lattice_hash(seed, *[b + c for b, c in zip(base, corner, strict=True)])
        g = _EDGES[((h ^ (h >> np.uint32(15))) >> np.uint32(2)) & np.uint32(63)]
        weight = np.prod(np.where(corner, fades, 1 - fades), axis=1)
        total += weight * (g * (at - corner)).sum(axis=1)
    return total * PERLIN3_SCALE


def fractal(field: Field, seed: int, x: np.ndarray, y: np.ndarray, frequency: float, octaves: int, fold: str = "none", lacunarity: float = 2.0, gain: float = 0.5, strength: float = 2.0, weighted: float = 0.0) -> np.ndarray:
    """Octaves of any field, in [-1, 1]; "ridged" turns zeros to crests, "ping_pong" reflects the field scaled by strength.

    weighted, 0 to 1, is how far low values of an octave take weight from the next ones.
    """
    total, amplitude, bound, share = np.zeros(len(x)), np.ones(len(x)), 0.0, 1.0
    for k in range(octaves):
        n = field(seed + k, x * frequency, y * frequency)
        if fold == "ridged":
            kept = 1 - np.abs(n)
            n = 1 - 2 * np.abs(n)
        elif fold == "ping_pong":
            t = (n + 1) * strength % 2
            kept = np.where(t < 1, t, 2 - t)
            n = 2 * kept - 1
        else:
            kept = np.minimum(n + 1, 2) / 2
        total, bound = total + amplitude * n, bound + share
        amplitude, share = amplitude * (1 + weighted * (kept - 1)) * gain, share * gain
        frequency *= lacunarity
    return total / bound


def warped(seed: int, x: np.ndarray, y: np.ndarray, frequency: float, amplitude: float, octaves: int = 1, progressive: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The places moved by two gradient fields; each octave moves what the last left, or the first places."""
    wx, wy = x, y
    for k in range(octaves):
        fx, fy = (wx, wy) if progressive else (x, y)
        dx = perlin(seed + 2 * k, fx * frequency, fy * frequency)
        dy = perlin(seed + 2 * k + 1, fx * frequency, fy * frequency)
        wx, wy = wx + amplitude * dx, wy + amplitude * dy
        frequency, amplitude = frequency * 2, amplitude / 2
    return wx, wy


FIELDS: dict[str, Field] = {"gradient": perlin, "value": value, "value_cubic": value_cubic, "simplex": simplex, "simplex_smooth": partial(simplex, kind="smooth"), "cellular": cellular}


def field_column(kind: str, seed: int, frequency: float, octaves: int = 1, fold: str = "none", warp: float = 0.0, weighted: float = 0.0):
    """A column function (x, y) -> noise; warp is the amplitude by which places move first."""
    field = FIELDS[kind]

    @F.pandas_udf("double")
    def noise(x: pd.Series, y: pd.Series) -> pd.Series:
        px, py = x.to_numpy(float), y.to_numpy(float)
        if warp:
            px, py = warped(seed + 7919, px, py, frequency, warp)
        return pd.Series(fractal(field, seed, px, py, frequency, octaves, fold, weighted=weighted))

    return noise
