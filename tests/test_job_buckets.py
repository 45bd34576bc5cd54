"""The state of many jobs is read and written at once, with results as for a state for each job."""

import datetime
import random

import pandas as pd

from folioflow.streaming import feeds, jobs
from tests.test_jobs import START, fold, run, session  # noqa: F401

SCHEMA = "jobid string, at timestamp, status string, seq long"


class Handle:
    """A state of one bucket that counts its calls."""

    def __init__(self):
        self.value, self.calls, self.timers = None, [], set()

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls.append("get")
        return self.value

    def exists(self):
        self.calls.append("exists")
        return self.value is not None

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def test_calls_do_not_grow_with_jobs():
    handle, processor = Handle(), jobs.JobProcessor(60)
    processor.init(handle)
    rows = pd.DataFrame([(0, f"j{k}", k * jobs.SECOND + s, status, s) for k in range(500) for s, status in enumerate(("PENDING", "RUNNING"))], columns=["bucket", "jobid", "us", "status", "seq"])
    got = pd.concat(processor.handleInputRows((0,), iter([rows[:700], rows[700:]]), None))
    assert len(got) == 1000 and got["accepted"].all() and handle.calls == ["get", "update"]
    assert handle.timers == {k * 1000 + 60_000 for k in range(500)}  # microseconds below one are cut off
    done = pd.DataFrame([(0, "j7", 20 * jobs.SECOND, "DONE", 0), (0, "j8", 9 * jobs.SECOND, "PENDING", 1)], columns=rows.columns)
    out = pd.concat(processor.handleInputRows((0,), iter([done]), None))
    assert out["seconds"].tolist() == [13, None] and out["accepted"].tolist() == [True, False]
    assert len(handle.timers) == 499 and 67_000 not in handle.timers and 68_000 in handle.timers


def test_one_bucket_equals_a_fold(session, tmp_path):  # noqa: F811
    r = random.Random(2)
    events, folder = [], tmp_path / "in"
    for batch in range(2):
        rows = [(f"j{r.randrange(30)}", START + datetime.timedelta(seconds=batch * 1000 + r.randrange(900)), r.choice([*feeds.TRANSITIONS, "PENDING", "RUNNING"]), batch * 300 + k) for k in range(300)]
        session.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        events += rows
        got = run(session, folder, tmp_path, buckets=1)
    want, states = fold(events)
    assert sorted((tuple(x) for x in got.collect()), key=str) == want
    assert {x["jobid"]: x["status"] for x in jobs.job_table(got).collect() if x["status"]} == states


def test_jobs_of_a_bucket_have_their_own_time_limits(session, tmp_path):  # noqa: F811
    at = lambda s: START + datetime.timedelta(seconds=s)
    first = [(j, at(0), "PENDING", None) for j in "abcd"] + [("a", at(1), "RUNNING", 1), ("b", at(1), "RUNNING", 1), ("c", at(5), "RUNNING", 1), ("d", at(5), "RUNNING", 1), ("d", at(20), "DONE", 2)]
    for part in (first, [("e", at(10_000), "PENDING", 5)], [("e", at(10_001), "RUNNING", 6)]):
        session.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = run(session, tmp_path / "in", tmp_path, limit=60, delay="10 seconds", buckets=1)
    expired = sorted((x["jobid"], x["at"], x["seconds"]) for x in got.where("expired").collect())
    assert expired == [("a", at(61), 60), ("b", at(61), 60), ("c", at(65), 60)]
    assert {x["jobid"]: x["status"] for x in jobs.job_table(got).collect()} == {"a": "ERROR", "b": "ERROR", "c": "ERROR", "d": "DONE", "e": "RUNNING"}
