"""The job queue as a stream against a plain fold, over many batches and restarts."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from folioflow.streaming import feeds, jobs

START = datetime.datetime(2024, 1, 1)


@pytest.fixture()
def session(spark):
    own = spark.newSession()
    own.conf.set(*jobs.PROVIDER)
    own.conf.set("spark.sql.shuffle.partitions", "2")
    own.conf.set("spark.sql.session.timeZone", "UTC")
    return own


def run(session, folder, tmp_path, **more):
    stream = feeds.file_stream(session, str(folder), "jobid string, at timestamp, status string, seq long", 1)
    out = str(tmp_path / "out")
    q = jobs.job_steps(stream, **more).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    return session.read.parquet(out)


def fold(events):
    state, out = {}, []
    for job, at, status, _ in sorted(events, key=lambda e: (e[1], e[3])):
        before, since = state.get(job, (None, None))
        ok = status == "PENDING" if before is None else status in feeds.TRANSITIONS[before]
        seconds = max(1, int((at - since).total_seconds())) if ok and before == "RUNNING" and status in ("DONE", "ERROR") else None
        out.append((job, at, before, status, ok, False, seconds))
        if ok:
            state[job] = (status, at)
    return sorted(out, key=str), {j: s for j, (s, _) in state.items()}


def test_stream_equals_a_fold(session, tmp_path):
    r = random.Random(1)
    events, folder = [], tmp_path / "in"
    for batch in range(3):
        rows = [(f"j{r.randrange(6)}", START + datetime.timedelta(seconds=batch * 1000 + r.randrange(900)), r.choice([*feeds.TRANSITIONS, "PENDING", "RUNNING"]), batch * 100 + k) for k in range(40)]
        session.createDataFrame(rows, "jobid string, at timestamp, status string, seq long").coalesce(1).write.mode("append").parquet(str(folder))
        events += rows
        got = run(session, folder, tmp_path)  # a run of its own, which goes on from the state of the last one
    want, states = fold(events)
    assert sorted((tuple(x) for x in got.collect()), key=str) == want
    table = {x["jobid"]: x for x in jobs.job_table(got).collect()}
    assert {j: x["status"] for j, x in table.items() if x["status"]} == states
    assert sum(x["n_refused"] for x in table.values()) == sum(not x[4] for x in want) > 0


def test_time_limit(session, tmp_path):
    at = lambda s: START + datetime.timedelta(seconds=s)
    folder = tmp_path / "in"
    parts = ([("a", at(0), "PENDING", 0), ("a", at(1), "RUNNING", 1), ("b", at(0), "PENDING", 2), ("b", at(1), "RUNNING", 3), ("b", at(20), "DONE", 4)], [("c", at(10_000), "PENDING", 5)], [("c", at(10_001), "RUNNING", 6)])
    for part in parts:
        session.createDataFrame(part, "jobid string, at timestamp, status string, seq long").coalesce(1).write.mode("append").parquet(str(folder))
        got = run(session, folder, tmp_path, limit=60, delay="10 seconds")
    expired = got.where("expired").collect()
    assert [(x["jobid"], x["before"], x["status"], x["seconds"]) for x in expired] == [("a", "RUNNING", "ERROR", 60)]
    assert {x["jobid"]: x["status"] for x in jobs.job_table(got).collect()} == {"a": "ERROR", "b": "DONE", "c": "RUNNING"}
    assert got.where(F.col("jobid") == "b").agg(F.sum("seconds")).first()[0] == 19
