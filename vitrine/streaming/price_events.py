"""Continuous change events from a stream of price observations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "key string, at timestamp, before double, value double"


def price_events(observations: DataFrame, *, tolerance: float = 0.01) -> DataFrame:
    """``(key, at, before, value)``: an event whenever a key's value differs from the one emitted before.

    ``observations``: streaming ``key string, at timestamp, value double``.
    State is one number per key. Within a micro-batch the rows of a key are
    taken by time; null values give no event.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).dropna(subset=["value"]).sort_values("at")
        out = []
        for at, value in zip(rows["at"], rows["value"], strict=True):
            if last is None or round(abs(value - last), 9) >= tolerance:
                out.append((key[0], at, last, value))
                last = value
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["key", "at", "before", "value"]).astype({"before": "float64", "value": "float64"})

    return observations.groupBy("key").applyInPandasWithState(step, SCHEMA, "value double", "append", GroupStateTimeout.NoTimeout)


def upserting(stored: Callable[[], DataFrame], save: Callable[[DataFrame, int], None], merge: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: merges every micro-batch into the stored table; ``save`` gets the batch id, so a repeat overwrites."""

    def run(batch: DataFrame, batch_id: int) -> None:
        save(merge(stored(), batch), batch_id)

    return run
