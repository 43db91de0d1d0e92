"""The fixed-window limiter and daily counts over streams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def limit_stream(requests: DataFrame, window_s: int = 60, most: int = 60) -> DataFrame:
    """``event_id, user_id, in_window, limited`` of a stream of requests; state is one count and end of window per user, dropped when it has ended."""

    def update(key: tuple[Any, ...], batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, reset = state.get if state.exists else (0, None)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        counts, flags = [], []
        for t in rows["ts"]:
            ms = int(t.timestamp() * 1000)
            if reset is None or not reset > ms:
                count, reset = 0, ms + window_s * 1000
            count += 1
            counts.append(count)
            flags.append(count > most)
        state.update((count, reset))
        if reset > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(reset)
        yield pd.DataFrame({"event_id": rows["event_id"], "user_id": key[0], "in_window": counts, "limited": flags})

    return (
        requests.withWatermark("ts", "1 hour")
        .groupBy("user_id")
        .applyInPandasWithState(update, "event_id bigint, user_id bigint, in_window bigint, limited boolean", "count bigint, reset bigint", "append", GroupStateTimeout.EventTimeTimeout)
    )


def daily_counts(requests: DataFrame, slot_hour: int = 21) -> DataFrame:
    """Requests per edition day of a stream: a day opens at the slot hour of the day before."""
    w = F.window("ts", "1 day", "1 day", f"{slot_hour} hours")
    return requests.withWatermark("ts", "2 hours").groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("opens"), "event_type", "n")
