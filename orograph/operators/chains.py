"""Stages over windows: demand through a chain, gathering with a halo, functions of whole windows one by one or in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orograph.operators.grid import Windows, needed, to_windows

#: (wi, wj, arrays of shape (windows, rows, columns) by column name) -> arrays of one shape by output name.
WindowFunction = Callable[[np.ndarray, np.ndarray, dict[str, np.ndarray]], dict[str, np.ndarray]]


@dataclass(frozen=True)
class Stage:
    """A stage makes windows; its window (wi, wj) is worked out from what the same window of `needs` covers of the stage before."""

    name: str
    made: Windows
    needs: Windows | None = None


def ranges(windows: DataFrame, w: Windows) -> DataFrame:
    """What windows (wi, wj) cover: (i0, i1, j0, j1)."""
    i0, j0 = w.start(F.col("wi")), w.start(F.col("wj"))
    return windows.select(i0.alias("i0"), (i0 + w.size).alias("i1"), j0.alias("j0"), (j0 + w.size).alias("j1"))


def demand(requested: DataFrame, stages: list[Stage], cached: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The windows (wi, wj) that each stage has to make for the ranges asked of the last one, by name.

    Goes from the last stage to the first; windows that are held already ask for nothing.
    """
    found = {}
    for stage in reversed(stages):
        windows = needed(requested, stage.made)
        if cached and stage.name in cached:
            windows = windows.join(cached[stage.name].select("wi", "wj"), ["wi", "wj"], "left_anti")
        found[stage.name] = windows
        if stage.needs:
            requested = ranges(windows, stage.needs)
    return found


def gathered(cells: DataFrame, needs: Windows, wanted: DataFrame) -> DataFrame:
    """The cells (i, j) of wanted windows with their halo: each once for every window that needs it, at li, lj there."""
    return to_windows(cells, needs).join(wanted.select("wi", "wj"), ["wi", "wj"], "left_semi")


def packed(windowed: DataFrame, size: int, columns: list[str]) -> DataFrame:
    """One row (wi, wj, an array for each column) a window, row by row; a window that isn't size x size is an error."""
    held = windowed.groupBy("wi", "wj").agg(F.array_sort(F.collect_list(F.struct("li", "lj", *columns))).alias("held"))
    message = F.concat(F.lit("window "), F.col("wi"), F.lit(", "), F.col("wj"), F.lit(" holds "), F.size("held"), F.lit(f" cells, not {size * size}"))
    whole = F.when(F.size("held") == size * size, F.col("held")).otherwise(F.raise_error(message))
    held = held.select("wi", "wj", whole.alias("held"))
    return held.select("wi", "wj", *[F.col("held").getField(n).cast("array<double>").alias(n) for n in columns])


def batched(windows: DataFrame, function: WindowFunction, size: int, columns: list[str], outputs: list[str], batch: int = 4) -> DataFrame:
    """(wi, wj, an array for each output): the function of packed windows, at most `batch` of them a call."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in range(0, len(frame), batch):
                part = frame.iloc[k : k + batch]
                given = {c: np.stack(part[c].to_list()).reshape(len(part), size, size) for c in columns}
                made = function(part["wi"].to_numpy(), part["wj"].to_numpy(), given)
                yield pd.DataFrame({"wi": part["wi"], "wj": part["wj"], **{c: list(np.asarray(made[c], float).reshape(len(part), -1)) for c in outputs}})

    schema = ", ".join(["wi long", "wj long", *[f"`{c}` array<double>" for c in outputs]])
    return windows.select("wi", "wj", *columns).mapInPandas(run, schema)


def unpacked(windows: DataFrame, made: Windows, columns: list[str]) -> DataFrame:
    """The cells (wi, wj, i, j, columns) of windows; where windows overlap a cell comes once for each."""
    rows = windows.select("wi", "wj", F.posexplode(F.arrays_zip(*columns)).alias("k", "c"))
    i, j = made.start(F.col("wi")) + F.floor(F.col("k") / made.size), made.start(F.col("wj")) + F.col("k") % made.size
    return rows.select("wi", "wj", i.alias("i"), j.alias("j"), *[F.col(f"c.{n}").alias(n) for n in columns])


def run_stage(cells: DataFrame, stage: Stage, wanted: DataFrame, function: WindowFunction, columns: list[str], outputs: list[str], batch: int = 4) -> DataFrame:
    """The cells that a stage makes for its wanted windows from cells of the stage before."""
    windows = packed(gathered(cells, stage.needs, wanted), stage.needs.size, columns)
    return unpacked(batched(windows, function, stage.needs.size, columns, outputs, batch), stage.made, outputs)
