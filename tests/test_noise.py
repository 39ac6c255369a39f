"""Lattice noise against versions that work one place at a time, in 32-bit whole numbers."""

import math

import numpy as np
import pytest

from orograph.operators import fields, noise

PLACES = [(0.25, 0.75), (-3.4, 7.9), (12.0, -5.5), (-0.001, -118.33), (407.2, 0.5)]


def wrapped(n: int) -> int:
    n &= 0xFFFFFFFF
    return n - (1 << 32) if n >> 31 else n


def hashed(seed: int, *place: int) -> int:
    h = seed
    for c, prime in zip(place, (501125321, 1136930381, 1720413743), strict=False):
        h = wrapped(h ^ wrapped(c * prime))
    return wrapped(h * 0x27D4EB2D)


def gradient(seed: int, i: int, j: int) -> tuple[float, float]:
    h = hashed(seed, i, j)
    k = ((h ^ (h >> 15)) & 254) // 2
    degrees = 22.5 + 45 * (k - 120) if k >= 120 else 7.5 + 15 * (k % 24)
    return math.sin(math.radians(degrees)), math.cos(math.radians(degrees))


def number(seed: int, i: int, j: int) -> float:
    h = hashed(seed, i, j)
    h = wrapped(h * h)
    return wrapped(h ^ (h << 19)) / 2**31


def perlin_at(seed: int, x: float, y: float) -> float:
    i, j = math.floor(x), math.floor(y)
    u, v = (6 * t**5 - 15 * t**4 + 10 * t**3 for t in (x - i, y - j))
    total = 0.0
    for a, b, w in ((0, 0, (1 - u) * (1 - v)), (1, 0, u * (1 - v)), (0, 1, (1 - u) * v), (1, 1, u * v)):
        gx, gy = gradient(seed, i + a, j + b)
        total += w * (gx * (x - i - a) + gy * (y - j - b))
    return 1.4247691104677813 * total


def cubic(a, b, c, d, t):
    p = (d - c) - (a - b)
    return ((p * t + (a - b - p)) * t + (c - a)) * t + b


def cubic_at(seed: int, x: float, y: float) -> float:
    i, j = math.floor(x), math.floor(y)
    rows = [cubic(*[number(seed, i + a, j + b) for a in (-1, 0, 1, 2)], x - i) for b in (-1, 0, 1, 2)]
    return cubic(*rows, y - j) / 2.25


def simplex_at(seed: int, x: float, y: float, reach: float, scale: float) -> float:
    """All lattice points around, not only those that can be in reach."""
    skew = (x + y) * (math.sqrt(3) - 1) / 2
    i, j = math.floor(x + skew), math.floor(y + skew)
    total = 0.0
    for a in range(i - 4, i + 6):
        for b in range(j - 4, j + 6):
            back = (a + b) * (3 - math.sqrt(3)) / 6
            dx, dy = x - (a - back), y - (b - back)
            gx, gy = gradient(seed, a, b)
            total += max(0.0, reach - dx * dx - dy * dy) ** 4 * (gx * dx + gy * dy)
    return total * scale


def test_fields_one_place_at_a_time():
    x, y = np.array(PLACES).T
    for seed in (0, 5, 99999, 2**31 - 1):
        assert np.allclose(noise.perlin(seed, x, y), [perlin_at(seed, *p) for p in PLACES], atol=1e-12)
        assert np.allclose(fields.value_cubic(seed, x, y), [cubic_at(seed, *p) for p in PLACES], atol=1e-12)
        assert np.allclose(fields.simplex(seed, x, y), [simplex_at(seed, *p, 0.5, 99.83685446303647) for p in PLACES], atol=1e-9)
        assert np.allclose(fields.simplex(seed, x, y, "smooth"), [simplex_at(seed, *p, 2 / 3, 18.24196194486065) for p in PLACES], atol=1e-9)
        assert np.allclose(fields.value(seed, np.floor(x), np.floor(y)), [number(seed, math.floor(a), math.floor(b)) for a, b in PLACES])


def test_fields_stay_in_range():
    x, y = (a.reshape(-1) for a in np.meshgrid(np.linspace(-40, 40, 601), np.linspace(-40, 40, 601)))
    for name in ("gradient", "value", "value_cubic", "simplex", "simplex_smooth"):
        v = fields.FIELDS[name](17, x, y)
        assert 0.5 < np.abs(v).max() <= 1 + 1e-6, name
        assert abs(v.mean()) < 0.05
    assert np.abs(fields.perlin3(17, x, y, 0.4 * x - 0.7 * y)).max() <= 1


@pytest.mark.parametrize("fold", ["none", "ridged", "ping_pong"])
def test_weighted_octaves(fold):
    x, y = np.array(PLACES).T
    got = fields.fractal(noise.perlin, 3, x, y, 0.31, 4, fold, gain=0.6, strength=1.7, weighted=0.4)
    want = []
    for a, b in PLACES:
        total, amplitude, f = 0.0, 1 / sum(0.6**k for k in range(4)), 0.31
        for k in range(4):
            n = perlin_at(3 + k, a * f, b * f)
            if fold == "none":
                shown, kept = n, min(n + 1, 2) / 2
            elif fold == "ridged":
                shown, kept = 1 - 2 * abs(n), 1 - abs(n)
            else:
                t = math.fmod((n + 1) * 1.7, 2)
                kept = t if t < 1 else 2 - t
                shown = 2 * kept - 1
            total += shown * amplitude
            amplitude *= (1 + 0.4 * (kept - 1)) * 0.6
            f *= 2
        want.append(total)
    assert np.allclose(got, want, atol=1e-12)
