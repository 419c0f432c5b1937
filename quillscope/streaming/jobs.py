"""Jobs as a stream: permitted transitions, jobs that hang, and a throttle, with
state that is kept no longer than it is needed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Which status may follow which, and minutes after which a job that
#: hasn't ended is taken to hang.
TRANSITIONS = {"": ("pending",), "pending": ("running", "failed"), "running": ("running", "complete", "failed"), "complete": ("expired",), "failed": (), "expired": ()}
FINAL = ("failed", "expired")
STUCK_MINUTES = 10
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATUS = "job_id long, event_id long, at timestamp, status string, accepted boolean, state string"


class _Lifecycle(StatefulProcessor):
    """Value state: the status of a job and when it was reached; a timer fails a
    job that hangs, another lets go of one that has ended."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", StructType([StructField("status", StringType()), StructField("at", LongType())]))

    def _timer(self, at: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        self.handle.registerTimer(at)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        now, since = (held[0], held[1]) if held else ("", 0)
        events = pd.concat(list(rows)).sort_values(["at", "event_id"], kind="stable")
        accepted, states = [], []
        for at, status in zip(events["at"], events["status"], strict=True):
            ok = status in TRANSITIONS[now]
            if ok:
                now, since = status, int(at.timestamp() * 1000)
            accepted.append(ok)
            states.append(now)
        self.state.update((now, since))
        if since:
            self._timer(since + STUCK_MINUTES * 60_000)
        yield events.assign(accepted=accepted, state=states)[["job_id", "event_id", "at", "status", "accepted", "state"]]

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, _ = self.state.get()
        if now in ("pending", "running"):
            due = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
            self.state.update(("failed", int(due.timestamp() * 1000)))
            yield pd.DataFrame({"job_id": [key[0]], "event_id": [None], "at": [due], "status": ["failed"], "accepted": [True], "state": ["failed"]}).astype({"event_id": "Int64"})
        elif now in FINAL:
            self.state.clear()
        else:
            yield pd.DataFrame()

    def close(self) -> None:
        pass


def job_transitions(events: DataFrame, late: str = "1 minute") -> DataFrame:
    """Every event of a stream (job_id, event_id, at, status) with whether the
    job's state permits it, and the state after it; refused ones change nothing. A
    job without an event for ten minutes fails, which is a row without event_id."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    rows = events.select("job_id", "event_id", "at", "status").withWatermark("at", late)
    return rows.groupBy("job_id").transformWithStateInPandas(_Lifecycle(), _STATUS, "Append", "EventTime")


def permitted(events: DataFrame) -> DataFrame:
    """The same rule over a table: a fold of each job's events in order."""
    ordered = F.array_sort(F.collect_list(F.struct("at", "event_id", "status")))
    step = F.create_map(*(F.lit(x) for k, v in TRANSITIONS.items() for x in (k, "," + ",".join(v) + ",")))
    start = F.struct(F.lit("").alias("state"), F.array().cast("array<struct<at:timestamp,event_id:bigint,status:string,accepted:boolean,state:string>>").alias("rows"))

    def move(acc, e):
        ok = F.coalesce(F.contains(step[acc["state"]], F.concat(F.lit(","), e["status"], F.lit(","))), F.lit(False))
        state = F.when(ok, e["status"]).otherwise(acc["state"])
        row = F.struct(e["at"].alias("at"), e["event_id"].alias("event_id"), e["status"].alias("status"), ok.alias("accepted"), state.alias("state"))
        return F.struct(state.alias("state"), F.concat(acc["rows"], F.array(row)).alias("rows"))

    folded = events.groupBy("job_id").agg(F.aggregate(ordered, start, move, lambda acc: acc["rows"]).alias("rows"))
    return folded.select("job_id", F.inline("rows")).select("job_id", "event_id", "at", "status", "accepted", "state")
