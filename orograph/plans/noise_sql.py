"""SQL of the noises over cells."""

from __future__ import annotations

from orograph.operators import fields, noise

FADES = {"gradient": "{0} * {0} * {0} * ({0} * ({0} * 6 - 15) + 10)", "value": "{0} * {0} * (3 - 2 * {0})"}
#: Weights of a cubic through four numbers, by the place of each.
CUBIC = "CASE {1} WHEN -1 THEN -pow({0}, 3) + 2 * pow({0}, 2) - {0} WHEN 0 THEN pow({0}, 3) - 2 * pow({0}, 2) + 1 WHEN 1 THEN -pow({0}, 3) + pow({0}, 2) + {0} ELSE pow({0}, 3) - pow({0}, 2) END"
NUMBER = "(CASE WHEN n31 >= 2147483648 THEN n31 - 4294967296 ELSE n31 END) / 2147483648.0"


def noise_sql(kind: str, seed: int, frequency: float, octaves: int, gain: float = 0.5, fold: str = "n", source: str = "cells", at: tuple[str, str] = ("i", "j")) -> str:
    """A subquery (i, j, noise) over the places at (expressions) of a source: octaves of a field, each folded by an expression in n."""
    bound = sum(gain**k for k in range(octaves))
    around = {"simplex_smooth": range(-1, 3), "value_cubic": range(-1, 3)}.get(kind, range(2))
    shift = f"({at[0]} + {at[1]}) * {(3**0.5 - 1) / 2!r}" if kind.startswith("simplex") else "0"
    place = f"({{0}} + {shift}) * {frequency!r} * pow(2, k)"
    if kind.startswith("simplex"):
        reach, scale, _ = fields.SIMPLEX["smooth" if kind == "simplex_smooth" else "sharp"]
        back = f"((x - floor(x) - a) + (y - floor(y) - b)) * {(3 - 3**0.5) / 6!r}"
        term = f"pow(greatest(0, {reach!r} - (x - floor(x) - a - {back}) ** 2 - (y - floor(y) - b - {back}) ** 2), 4) * (sin(r) * (x - floor(x) - a - {back}) + cos(r) * (y - floor(y) - b - {back}))"
    elif kind == "value_cubic":
        term, scale = " * ".join(f"({CUBIC.format(f'({c} - floor({c}))', n)})" for c, n in ("xa", "yb")) + f" * {NUMBER}", 1 / 2.25
    else:
        u, v = (FADES[kind].format(f"({c} - floor({c}))") for c in "xy")
        share = f"(CASE a WHEN 1 THEN {u} ELSE 1 - {u} END) * (CASE b WHEN 1 THEN {v} ELSE 1 - {v} END)"
        term, scale = (f"{share} * (sin(r) * (x - floor(x) - a) + cos(r) * (y - floor(y) - b))", noise.PERLIN_SCALE) if kind == "gradient" else (f"{share} * {NUMBER}", 1.0)
    px, py = noise.PRIMES[:2]
    corners = ", ".join(f"(SELECT unnest(range({around.start}, {around.stop})) AS {n})" for n in "ab")
    return f"""(SELECT i, j, sum(({fold}) * pow({gain!r}, k)) / {bound!r} AS noise FROM (SELECT i, j, k, sum({term}) * {scale!r} AS n FROM (
    SELECT *, CASE WHEN q < 120 THEN 7.5 + 15 * (q % 24) ELSE 22.5 + 45 * (q - 120) END * pi() / 180 AS r, xor(hh, (hh << 19) & 4294967295) AS n31 FROM (
    SELECT *, (xor(h, h >> 15) >> 1) & 127 AS q, CAST((CAST(h AS HUGEINT) * h) % 4294967296 AS BIGINT) AS hh FROM (
    SELECT *, (xor(xor({seed} + k, ((CAST(floor(x) AS BIGINT) + a) * {px}) & 4294967295), ((CAST(floor(y) AS BIGINT) + b) * {py}) & 4294967295) * {noise.HASH_FACTOR}) & 4294967295 AS h FROM (
    SELECT i, j, k, a, b, {place.format(at[0])} AS x, {place.format(at[1])} AS y FROM {source}, (SELECT unnest(range({octaves})) AS k), {corners})))) GROUP BY i, j, k) GROUP BY i, j)"""


def _times(x: str, factor: int) -> str:
    return f"CAST((CAST(({x}) AS HUGEINT) * {factor}) % 4294967296 AS BIGINT)"


def _hashed(source: str, seed: str, name: str) -> str:
    """source with the hash (see noise._hash) of its whole places ci, cj in [0, 1) as a column."""
    one = f"(SELECT *, xor(xor({_times('ci & 4294967295', 0x85EBCA6B)}, {_times('cj & 4294967295', 0xC2B2AE35)}), {seed}) AS h0 FROM {source})"
    two = f"(SELECT *, {_times('xor(h0, h0 >> 15)', 0x2C1B3C6D)} AS h1 FROM {one})"
    three = f"(SELECT *, {_times('xor(h1, h1 >> 12)', 0x297A2D39)} AS h2 FROM {two})"
    return f"(SELECT * EXCLUDE (h0, h1, h2), xor(h2, h2 >> 15) / 4294967296.0 AS {name} FROM {three})"


def cellular_sql(seed: int, frequency: float) -> str:
    """A subquery (i, j, noise) over cells: how far the nearest of the points is that lie one in each lattice cell."""
    near = f"(SELECT i, j, i * {frequency!r} AS x, j * {frequency!r} AS y, CAST(floor(i * {frequency!r}) AS BIGINT) + a AS ci, CAST(floor(j * {frequency!r}) AS BIGINT) + b AS cj FROM cells, (SELECT unnest(range(-2, 3)) AS a), (SELECT unnest(range(-2, 3)) AS b))"
    both = _hashed(_hashed(near, str(seed), "u"), str(seed + 1), "v")
    return f"(SELECT i, j, min(sqrt((ci + u - x) ** 2 + (cj + v - y) ** 2)) AS noise FROM {both} GROUP BY i, j)"


def weighted_sql(kind: str, seed: int, frequency: float, weighted: float) -> str:
    """A subquery (i, j, noise) over cells: two octaves, of which low values of the first take weight from the second."""
    a, b = (noise_sql(kind, seed + k, frequency * 2**k, 1) for k in (0, 1))
    return f"(SELECT i, j, (a.noise + 0.5 * (1 + {weighted!r} * (least(a.noise + 1, 2) / 2 - 1)) * b.noise) / 1.5 AS noise FROM {a} AS a JOIN {b} AS b USING (i, j))"


def warped_sql(seed: int, frequency: float, octaves: int, warp: float) -> str:
    """A subquery (i, j, noise) over cells: gradient noise at places that two other gradient noises have moved."""
    a, b = (noise_sql("gradient", seed + 7919 + k, frequency, 1) for k in (0, 1))
    moved = f"(SELECT i, j, i + {warp!r} * a.noise AS wi, j + {warp!r} * b.noise AS wj FROM {a} AS a JOIN {b} AS b USING (i, j))"
    return noise_sql("gradient", seed, frequency, octaves, source=moved, at=("wi", "wj"))
