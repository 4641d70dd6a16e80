"""Leases of jobs as a stream: state for each job, and timers that end its lease.

Events (job_id, at, seq, kind, owner) become transitions (job_id, at, kind, owner,
attempt).  Kinds: enqueue, claim, heartbeat, finish, fail, cancel.  A claim takes a
waiting job; a heartbeat, finish or failure counts only while its owner holds the lease,
else it is ``late``.  A lease ends ``lease_ms`` after its claim or last heartbeat: the job
``expired`` and waits again, or is ``exhausted`` after ``attempts`` claims.  A job that
shall be cancelled is never claimed; one that runs is cancelled at its next heartbeat.

Time is the events' own: a lease that ended before an event is ended first, whichever
batch the event came in, and the watermark's timer ends it where no event does.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TRANSITIONS = "job_id long, at timestamp, kind string, owner string, attempt int"
ENDED = ("finished", "failed", "canceled", "exhausted")


@dataclass
class Lease:
    """One job; times in milliseconds."""

    status: str = "none"
    owner: str | None = None
    until: int = 0
    attempt: int = 0
    cancel: bool = False

    def expire(self, now: int, attempts: int) -> list[tuple[int, str, str | None, int]]:
        """Ends a lease that ended before ``now``."""
        if self.status != "running" or self.until >= now:
            return []
        self.status = "exhausted" if self.attempt >= attempts else "waiting"
        return [(self.until, "expired" if self.status == "waiting" else "exhausted", self.owner, self.attempt)]

    def take(self, at: int, kind: str, owner: str | None, lease_ms: int, attempts: int) -> list[tuple[int, str, str | None, int]]:
        """The transitions of one event."""
        out = self.expire(at, attempts)
        mine = self.status == "running" and self.owner == owner
        said = None
        if kind == "enqueue" and self.status == "none":
            self.status, said = "waiting", "enqueued"
        elif kind == "cancel" and self.status not in ENDED:
            self.cancel = True
            said = "cancel requested"
            if self.status == "waiting":
                self.status, said = "canceled", "canceled"
        elif kind == "claim" and self.status == "waiting" and not self.cancel:
            self.status, self.owner, self.until, self.attempt, said = "running", owner, at + lease_ms, self.attempt + 1, "claimed"
        elif kind == "heartbeat" and mine:
            self.until, said = at + lease_ms, "renewed"
            if self.cancel:
                self.status, said = "canceled", "canceled"
        elif kind in ("finish", "fail") and mine:
            self.status = said = "finished" if kind == "finish" else "failed"
        elif kind in ("heartbeat", "finish", "fail"):
            said = "late"
        return [*out, (at, said, owner, self.attempt)] if said else out


def lease_transitions(events: DataFrame, lease_ms: int = 300_000, attempts: int = 3, delay: str = "1 minute") -> DataFrame:
    """TRANSITIONS of a stream of events; ``at`` is watermarked with ``delay``.  An ended
    job's state goes when the watermark has passed its end by one lease."""
    columns = ["job_id", "at", "kind", "owner", "attempt"]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        job = Lease(**json.loads(state.get[0])) if state.exists else Lease()
        if state.hasTimedOut:
            out = job.expire(state.getCurrentWatermarkMs() + 1, attempts)
            if job.status in ENDED:
                state.remove()
            else:
                state.update((json.dumps(asdict(job)),))
        else:
            out, came = [], pd.concat(list(frames)).sort_values(["at", "seq"], kind="stable")
            times = came["at"].astype("datetime64[ms]").astype("int64")
            for at, kind, owner in zip(times, came["kind"], came["owner"]):
                out += job.take(int(at), kind, owner if isinstance(owner, str) else None, lease_ms, attempts)
            state.update((json.dumps(asdict(job)),))
            if job.status == "running" or job.status in ENDED:
                least = state.getCurrentWatermarkMs() + 1
                state.setTimeoutTimestamp(max(least, job.until if job.status == "running" else int(times.max()) + lease_ms))
        rows = pd.DataFrame([(key[0], pd.Timestamp(t, unit="ms"), kind, owner, n) for t, kind, owner, n in out], columns=columns)
        rows["at"] = rows["at"].astype("datetime64[ns]")
        yield rows

    watched = events.withWatermark("at", delay)
    return watched.groupBy("job_id").applyInPandasWithState(step, TRANSITIONS, "job string", "append", GroupStateTimeout.EventTimeTimeout)
