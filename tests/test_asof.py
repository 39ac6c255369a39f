"""As-of joins and lookups in tables against loops."""

import random
from collections import Counter

import numpy as np
import pytest

from orograph.operators import asof


@pytest.fixture(scope="module")
def tables():
    r = random.Random(1)
    table = [(c, x / 2, r.random()) for c in "ab" for x in (r.randrange(40) for _ in range(50))] + [("c", 3.0, 7.0), ("a", None, 1.0), (None, 1.0, 1.0)]
    values = [(k, r.choice("abcd"), r.choice([r.randrange(-4, 44) / 2, r.uniform(-2, 22)])) for k in range(400)] + [(400 + k, "a", 5.0) for k in range(300)] + [(900, "a", None), (901, None, 1.0)]
    return table, values


@pytest.mark.parametrize("ranges", [1, 2, 7, 60])
def test_asof_against_a_loop(spark, tables, ranges):
    table, values = tables
    df = spark.createDataFrame(values, "n long, c string, v double").repartition(3)
    got = asof.asof(df, spark.createDataFrame(table, "c string, x double, y double"), "v", "x", ["c"], ["y"], ranges).collect()
    want = Counter()
    for n, c, v in values:
        own = sorted((x, y) for d, x, y in table if d == c and c is not None and x is not None)
        before = max((p for p in own if v is not None and p[0] <= v), default=None)
        after = min((p for p in own if v is not None and p[0] > v), default=None)
        want[n, c, v, before, after] += 1
    assert Counter((r["n"], r["c"], r["v"], r["before"] and tuple(r["before"]), r["after"] and tuple(r["after"])) for r in got) == want


def test_lookup_against_numpy(spark):
    r = random.Random(2)
    xs, ys = sorted(r.sample(range(1000), 300)), [r.random() for _ in range(300)]
    values = [(k, r.uniform(-50, 1050)) for k in range(500)] + [(500 + k, float(xs[k])) for k in range(300)]
    df = spark.createDataFrame(values, "n long, v double")
    table = spark.createDataFrame([(float(x), y) for x, y in zip(xs, ys, strict=True)], "x double, y double").repartition(4)
    for ranges in (1, 9):
        got = {r["n"]: r["mapped"] for r in asof.interpolated(df, table, "v", ranges=ranges).collect()}
        assert np.allclose([got[n] for n, _ in values], np.interp([v for _, v in values], xs, ys))
    assert {r["mapped"] for r in asof.interpolated(df, table.limit(0), "v").collect()} == {None}


def test_stored_tables_by_channel(spark, tmp_path):
    """Quantile tables as a file holds them, joined as rows: each channel with its own, of 50 and of 50 places."""
    import json

    from pyspark.sql import functions as F

    from orograph.sources import model

    r = np.random.default_rng(4)
    held = [np.sort(r.normal(size=50)).tolist(), np.sort(r.uniform(-5, 5, 50)).tolist()]
    (tmp_path / "tables.json").write_text(json.dumps({"n_quantiles": 50, "data_quantile_tables": held, "a_temp_std": 1.0, "b_temp_std": 2.0, "temp_std_p1": 3.0, "temp_std_p99": 4.0}))
    tables = model.quantile_tables(spark, str(tmp_path / "tables.json")).select("channel", (F.col("place") / 49.0).alias("x"), F.col("value").alias("y"))
    values = [(k, k % 2, float(v)) for k, v in enumerate(r.uniform(-0.2, 1.2, 200))]
    got = {x["n"]: x["mapped"] for x in asof.interpolated(spark.createDataFrame(values, "n int, channel int, v double"), tables, "v", by=["channel"]).collect()}
    assert np.allclose([got[n] for n, _, _ in values], [np.interp(v, np.arange(50) / 49.0, held[c]) for _, c, v in values])
