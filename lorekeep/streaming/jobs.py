"""Job states folded from a stream of job events, one state per session."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import shipping

#: Seconds of a lease, attempts at most, seconds to wait after the first and later failures.
LEASE, ATTEMPTS, WAIT = 30.0, 3, (5.0, 30.0)


class Job(NamedTuple):
    generation: int
    status: str
    attempts: int
    available: float
    lease: float


def step(job: Job | None, generation: int, event: str, at: float) -> Job | None:
    """The state after an event (submit, claim, heartbeat, done, fail, cancel) at a time in seconds.

    A newer generation supersedes whatever is there; events of other generations change
    nothing.  An expired lease can be claimed again; without attempts left the job fails.
    """
    if event == "submit":
        newer = job is None or generation > job.generation
        return Job(generation, "PENDING", 0, at, at) if newer else job
    if job is None or generation != job.generation or job.status not in ("PENDING", "RUNNING"):
        return job
    running = job.status == "RUNNING"
    if event == "claim":
        if at < (job.lease if running else job.available):
            return job
        if job.attempts >= ATTEMPTS:
            return job._replace(status="FAILED")
        return job._replace(status="RUNNING", attempts=job.attempts + 1, lease=at + LEASE)
    if event == "cancel":
        return job._replace(status="CANCELLED")
    if not running:
        return job
    if event == "heartbeat":
        return job._replace(lease=at + LEASE)
    if event == "done":
        return job._replace(status="DONE")
    if event == "fail":
        if job.attempts >= ATTEMPTS:
            return job._replace(status="FAILED")
        return job._replace(status="PENDING", available=at + WAIT[min(job.attempts, len(WAIT)) - 1])
    return job


def job_states(events: DataFrame) -> DataFrame:
    """(session_id, generation, status, attempts) of the sessions that a micro-batch of
    events(session_id, generation long, event, at double) touches; a session's events of one
    batch are applied in order of time."""
    shipping.ship(events.sparkSession)

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        job = Job(*state.get) if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["at", "generation", "event"], kind="stable")
        for g, e, at in zip(rows["generation"], rows["event"], rows["at"], strict=True):
            job = step(job, int(g), e, float(at))
        if job is not None:
            state.update(tuple(job))
            yield pd.DataFrame([(key[0], *job[:3])], columns=["session_id", "generation", "status", "attempts"])

    kept = "generation long, status string, attempts int, available double, lease double"
    whole = events.filter("session_id is not null and generation is not null and at is not null")
    return whole.groupBy("session_id").applyInPandasWithState(fold, "session_id string, generation long, status string, attempts int", kept, "update", GroupStateTimeout.NoTimeout)
