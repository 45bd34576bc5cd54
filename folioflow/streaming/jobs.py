"""The job queue as a stateful stream: steps that a job's state allows, time limits by timers.

Events (jobid, at, status, and a number ``seq`` among equal times) are folded for each job in order of time within a batch. A job
begins with PENDING; every other step must be one of ``feeds.TRANSITIONS``. Steps that are not allowed come out as refused and change nothing. A job
that runs longer than a limit fails when the watermark has passed its end. State lives in the state store, so a restarted query goes on
where it was. Jobs are dealt to buckets by a hash of their ids, and the state of a bucket's jobs is read and written at once: a state for each job
costs several calls between Python and the JVM for each job of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .feeds import TRANSITIONS

#: The state store that timers need.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Buckets of jobs. Part of the state, so it can't change while a checkpoint is in use.
BUCKETS = 1 << 11
_STATE = "jobs array<string>, status array<string>, since array<long>"
STEP = T.StructType([
    T.StructField("jobid", T.StringType()), T.StructField("us", T.LongType()), T.StructField("before", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("accepted", T.BooleanType()), T.StructField("expired", T.BooleanType()), T.StructField("seconds", T.LongType()),
])
SECOND = 1_000_000


def step(before: str | None, since: int | None, wanted: str, at: int) -> tuple[bool, int | None]:
    """Whether a job may take a step, and the seconds that it ran if this ends its run: one at least. Times are in microseconds."""
    accepted = wanted == "PENDING" if before is None else wanted in TRANSITIONS.get(before, ())
    ran = accepted and before == "RUNNING" and wanted in ("DONE", "ERROR")
    return accepted, max(1, at // SECOND - since // SECOND) if ran else None


def _steps(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=STEP.fieldNames(), dtype=object)


class JobProcessor(StatefulProcessor):
    """Folds the events of a bucket's jobs; ``limit`` is the seconds that a job may run, or None."""

    def __init__(self, limit: float | None):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getValueState("jobs", _STATE)

    def _known(self) -> dict[str, tuple[str, int]]:
        held = self.jobs.get()
        return {} if held is None else {job: (status, since) for job, status, since in zip(*held)}

    def _keep(self, known: dict[str, tuple[str, int]]) -> None:
        self.jobs.update((list(known), [status for status, _ in known.values()], [since for _, since in known.values()]))

    def _end(self, since: int) -> int:
        """The millisecond at which a job fails that has run since then."""
        return int(since / 1000 + self.limit * 1000)

    def _ends(self, known: dict[str, tuple[str, int]]) -> set[int]:
        return set() if self.limit is None else {self._end(since) for status, since in known.values() if status == "RUNNING"}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self._known()
        timers, changed = self._ends(known), False
        events = pd.concat(list(rows), ignore_index=True)
        order = np.lexsort((events["seq"], events["us"], pd.factorize(events["jobid"])[0]))
        out = []
        for job, at, wanted in zip(*(events[c].take(order).tolist() for c in ("jobid", "us", "status"))):
            before, since = known.get(job, (None, None))
            accepted, seconds = step(before, since, wanted, at)
            out.append((job, at, before, wanted, accepted, False, seconds))
            if accepted:
                known[job], changed = (wanted, at), True
        if changed:
            self._keep(known)
            ends = self._ends(known)
            for timer in timers - ends:
                self.handle.deleteTimer(timer)
            for timer in ends - timers:
                self.handle.registerTimer(timer)
        yield _steps(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known, out = self._known(), []
        expiry = expiredTimerInfo.getExpiryTimeInMs()
        at = expiry * 1000
        for job, (before, since) in known.items():
            if before == "RUNNING" and self._end(since) == expiry:
                out.append((job, at, before, "ERROR", True, True, step(before, since, "ERROR", at)[1]))
        if out:
            self._keep(known | {row[0]: ("ERROR", at) for row in out})
            yield _steps(out)

    def close(self) -> None:
        pass


def job_steps(events: DataFrame, limit: float | None = None, delay: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """Every step of a stream of events (jobid, at, status, seq): accepted or refused, and ends by the time limit. The session needs ``PROVIDER``."""
    job = F.col("jobid").cast("string")
    rows = events.select(F.pmod(F.xxhash64(job), F.lit(buckets)).cast("int").alias("bucket"), job.alias("jobid"), F.col("at").cast("timestamp").alias("at"), F.unix_micros(F.col("at").cast("timestamp")).alias("us"), F.col("status").cast("string").alias("status"), F.coalesce(F.col("seq").cast("long"), F.lit(-(1 << 63))).alias("seq"))
    rows = rows.where("jobid is not null and at is not null and status is not null").withWatermark("at", delay)
    if limit is None:
        rows = rows.drop("at")  # only time limits look at the watermark
    out = rows.groupBy("bucket").transformWithStateInPandas(statefulProcessor=JobProcessor(limit), outputStructType=STEP, outputMode="append", timeMode="none" if limit is None else "eventTime")
    return out.select("jobid", F.timestamp_micros("us").alias("at"), "before", "status", "accepted", "expired", "seconds")


def job_table(steps: DataFrame) -> DataFrame:
    """Of the steps so far: jobid, its last accepted status, the numbers of accepted and refused steps, and the seconds that it ran in all."""
    last = F.max_by(F.when(F.col("accepted"), F.col("status")), F.when(F.col("accepted"), F.struct("at", "_n")))
    out = steps.withColumn("_n", F.monotonically_increasing_id()).groupBy("jobid")
    return out.agg(last.alias("status"), F.count_if("accepted").alias("n_accepted"), F.count_if(~F.col("accepted")).alias("n_refused"), F.coalesce(F.sum("seconds"), F.lit(0)).alias("seconds"))
