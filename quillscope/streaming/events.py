"""The event log as a stream: windowed counts, reuse by content, current job
states and admission in a sliding window."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def window_counts(events: DataFrame, time: str, late: str, width: str, *by: str) -> DataFrame:
    """Counts per tumbling window; late events beyond the watermark are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))


def first_by_content(events: DataFrame, time: str, expiry: str, key: str = "content_hash") -> DataFrame:
    """Events whose content wasn't seen within the expiry before."""
    return events.withWatermark(time, expiry).dropDuplicatesWithinWatermark([key])


def job_states(events: DataFrame) -> DataFrame:
    """Latest state of each job, for the update or complete mode."""
    return events.groupBy("job_id").agg(F.max_by("status", F.struct("occurred_at", "event_id")).alias("status"), F.count("*").alias("n_events"))


def admit(requests: DataFrame, limit: int, seconds: int, late: str = "10 minutes") -> DataFrame:
    """(key, request_id, us, admitted) of a stream (key, request_id, at): the
    batch operator of the same rule, with the admitted times as state. State
    holds at most ``limit`` times per key and is dropped once a window passes."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["us", "request_id"])
        ok = []
        for t in rows["us"]:
            held = [x for x in held if x > t - seconds * 1_000_000]
            ok.append(len(held) < limit)
            if ok[-1]:
                held.append(int(t))
        state.update((held,))
        state.setTimeoutTimestamp(max(int(rows["us"].max()) // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield rows.assign(admitted=ok)[["key", "request_id", "us", "admitted"]]

    rows = requests.withWatermark("at", late).select("key", "request_id", F.unix_micros(F.col("at").cast("timestamp")).alias("us"), "at")
    return rows.groupBy("key").applyInPandasWithState(run, "key long, request_id long, us long, admitted boolean", "held array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
