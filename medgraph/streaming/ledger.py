"""The ledger of runs as keyed state: one small record a job, which a timer removes some hours after the job's end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

ACTIVE = ("queued", "running")
HOURS = 24
#: Times are microseconds since 1970. ``change`` numbers what is told of a job.
STATE = "status string, created_at long, updated_at long, seq long, change long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class JobState(StatefulProcessor):
    """The latest state of a job. Its state store holds running jobs, and those that ended within ``hours``."""

    def __init__(self, hours: int = HOURS):
        self.hours = hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", STATE)

    def _told(self, key: tuple, state: tuple, gone: bool) -> pd.DataFrame:
        status, created_at, updated_at, _, change = state
        return pd.DataFrame({"job": [key[0]], "status": [status], "created_at": pd.to_datetime([created_at], unit="us"), "updated_at": pd.to_datetime([updated_at], unit="us"), "change": [change], "gone": [gone]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = tuple(self.job.get()) if self.job.exists() else None
        parts = pd.concat(list(rows))
        last = parts.sort_values(["us", "seq"]).iloc[-1]
        new = (last["status"], int(parts["us"].min()), int(last["us"]), int(last["seq"]), 0)
        if old is not None:
            late = (old[2], old[3]) > (new[2], new[3])
            new = ((old if late else new)[0], min(old[1], new[1]), *(old if late else new)[2:4], old[4] + 1)
        self.job.update(new)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if new[0] not in ACTIVE:
            # the first millisecond after the job's time is over
            self.handle.registerTimer((new[2] + self.hours * 3_600_000_000) // 1000 + 1)
        yield self._told(key, new, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.job.exists():
            *state, change = self.job.get()
            self.job.clear()
            yield self._told(key, (*state, change + 1), True)

    def close(self) -> None:
        pass


def ledger_changes(events: DataFrame, hours: int = HOURS, delay: str = "0 seconds") -> DataFrame:
    """A stream of events(job, ts, seq, status) as what becomes of each job: (job, status, created_at, updated_at,
    change, gone). Events older than the watermark, which runs ``delay`` behind the newest, are dropped."""
    kind = events.schema["job"].dataType.simpleString()
    timed = events.select("job", "ts", F.unix_micros("ts").alias("us"), F.col("seq").cast("long").alias("seq"), "status").withWatermark("ts", delay)
    out = f"job {kind}, status string, created_at timestamp, updated_at timestamp, change long, gone boolean"
    return timed.groupBy("job").transformWithStateInPandas(JobState(hours), out, "Update", "EventTime")


def stream_ledger(events: DataFrame, folder: str, checkpoint: str, hours: int = HOURS, delay: str = "0 seconds") -> StreamingQuery:
    """Write the changes of a stream under ``folder``, a micro-batch under its number, so that one which is tried again
    replaces itself."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    conf = events.sparkSession.conf
    before = conf.get(_PROVIDER, None)
    conf.set(_PROVIDER, _ROCKS)  # keyed state with timers needs it; the query takes it when it starts
    try:
        return ledger_changes(events, hours, delay).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        if before is None:
            conf.unset(_PROVIDER)
        else:
            conf.set(_PROVIDER, before)


def ledger(changes: DataFrame) -> DataFrame:
    """The jobs that are there after these changes: (job, status, created_at, updated_at)."""
    last = changes.groupBy("job").agg(F.max_by(F.struct("status", "created_at", "updated_at", "gone"), "change").alias("x"))
    return last.filter("NOT x.gone").select("job", "x.status", "x.created_at", "x.updated_at")
