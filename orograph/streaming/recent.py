"""A stream's last keys of each partition as state: how often each row's key was among them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def repeats_in_last(stream: DataFrame, key: str, order: list[str], partition: str, row_id: str, last: int = 32) -> DataFrame:
    """(row_id, repeats) of a stream's rows: see search.repeats_in_last(), of which these are the numbers.

    The state of a partition is its last - 1 keys. Rows of one micro-batch are taken by the columns
    of order; a batch must not hold rows from before an earlier one. A partition's rows of one batch
    meet in one task, so that the batch size (maxFilesPerTrigger, maxBytesPerTrigger) bounds them.
    """
    kinds = dict(stream.dtypes)

    def run(_: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        held = list(state.get[0]) if state.exists else []
        keys = rows[key].tolist()
        seen = held + keys
        repeats = [seen[max(0, n - last + 1) : n + 1].count(k) for n, k in enumerate(keys, len(held))]
        state.update((seen[max(0, len(seen) - last + 1) :],))
        yield pd.DataFrame({row_id: rows[row_id].to_numpy(), "repeats": pd.array(repeats, dtype="int32")})

    kept = stream.select(partition, key, row_id, *[c for c in order if c not in (partition, key, row_id)])
    return kept.groupBy(partition).applyInPandasWithState(run, f"{row_id} {kinds[row_id]}, repeats int", f"seen array<{kinds[key]}>", "append", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    """All that the sources hold by now, appended to Parquet; a later call goes on where this one ended, a failed one begins its last batch again."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
