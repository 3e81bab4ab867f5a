"""Job state that expires: the last event of each job, forgotten a time after it.

Time to live is event time.  A processing-time one would keep a run over
available data from ending, as Spark then waits for timeouts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def last_status(events: DataFrame, ttl_ms: int = 86_400_000, late: str = "1 hour") -> DataFrame:
    """(job_id, event_type, n) after each batch of a job; n counts since its state was last forgotten."""

    def fold(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"], kind="stable")
        n = (state.get[0] if state.exists else 0) + len(rows)
        state.update((n,))
        last = int(rows["ts"].iloc[-1].value // 1_000_000)
        state.setTimeoutTimestamp(max(last + ttl_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"job_id": [key[0]], "event_type": [rows["event_type"].iloc[-1]], "n": [n]})

    return (
        events.withWatermark("ts", late)
        .groupBy("job_id")
        .applyInPandasWithState(fold, "job_id string, event_type string, n long", "n long", "update", GroupStateTimeout.EventTimeTimeout)
    )
