"""Keyed state in a stream: the last value of each key, for as long as it lives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def last_values(ops: DataFrame, hours: int = 6) -> DataFrame:
    """k, v and op of each key that a batch changes, from a stream of ops with an event time ``ts``.

    An entry ends ``hours`` after its last put: then the key is given out with op EXPIRED.
    """

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"k": [key[0]], "v": [None], "op": ["EXPIRED"]})
            return
        position, value, op = state.get if state.exists else (-1, None, "DELETE")
        end = 0
        for part in parts:
            i = part["position"].idxmax()
            if part["position"][i] > position:
                position, op = int(part["position"][i]), part["op"][i]
                value = int(part["v"][i]) if op == "PUT" else None
            end = max(end, int(part["ts"].max().timestamp() * 1000))
        state.update((position, value, op))
        if op == "PUT":
            state.setTimeoutTimestamp(max(end + hours * 3_600_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"k": [key[0]], "v": [value], "op": [op]})

    return ops.withWatermark("ts", "1 minute").groupBy("k").applyInPandasWithState(update, "k long, v long, op string", "position long, v long, op string", "update", GroupStateTimeout.EventTimeTimeout)
