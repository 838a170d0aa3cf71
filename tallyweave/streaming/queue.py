"""The queues of jobs as a stream with state and timers: who claims gets the next job, and jobs that wait too long say so by themselves."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime, timedelta
from itertools import batched

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tallyweave.functions import rules
from tallyweave.streaming.jobs import step

COMMANDS = "queue string, seq long, ts timestamp, command string, job_id string"
OUTPUT = "queue string, ts long, seq long, command string, job_id string, status string, changed boolean"
_COLUMNS = [x.split()[0] for x in OUTPUT.split(", ")]
#: A row of the state's operator holds up to `TOLD` answers of a queue, a column an array: rows one by one would take most of its time.
PACKED, TOLD = ", ".join(x if x.startswith("queue ") else "{} array<{}>".format(*x.split()) for x in OUTPUT.split(", ")), 10_000
#: The state store that Spark needs for state of several variables.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WAITING = ("pending", "processing")
#: Milliseconds of a command without a time: before any alarm.
NO_TIME = -(2**63)
_EPOCH, _MILLISECOND = datetime(1970, 1, 1, tzinfo=UTC), timedelta(milliseconds=1)


class Jobs:
    """One queue's jobs, in the order in which they came, and what a command or the clock does to them. Times are milliseconds."""

    def __init__(self, jobs: dict[str, tuple[int, str, int, bool]], ttl: int, timeout: int):
        self.jobs, self.ttl, self.timeout = jobs, ttl, timeout
        self.next = max((ord_ for ord_, *_ in jobs.values()), default=-1) + 1
        self.touched: set[str] = set()
        self.pending, self.clock = [], []
        for job, (ord_, status, created, late) in jobs.items():
            self._place(job, ord_, status, created, late)

    def _place(self, job: str, ord_: int, status: str, created: int, late: bool) -> None:
        if status == "pending":
            heapq.heappush(self.pending, (ord_, job))
        if status in WAITING and not late:
            heapq.heappush(self.clock, (created + self.timeout + 1, job, "timeout"))
        heapq.heappush(self.clock, (created + self.ttl + 1, job, "expired"))

    def _put(self, job: str, ord_: int, status: str, created: int, late: bool) -> None:
        self.jobs[job] = ord_, status, created, late
        self.touched.add(job)

    def _holds(self, due: int, job: str, kind: str) -> bool:
        """Whether an alarm still stands: its job may have gone, moved on, or begun anew."""
        if job not in self.jobs:
            return False
        _, status, created, late = self.jobs[job]
        if kind == "expired":
            return due == created + self.ttl + 1
        return status in WAITING and not late and due == created + self.timeout + 1

    def due(self) -> int | None:
        """When the next alarm is."""
        while self.clock and not self._holds(*self.clock[0]):
            heapq.heappop(self.clock)
        return self.clock[0][0] if self.clock else None

    def alarms(self, now: int) -> Iterator[tuple]:
        """What the clock says up to `now`: a job that waits too long stays, one past its time to live is gone."""
        while (due := self.due()) is not None and due <= now:
            _, job, kind = heapq.heappop(self.clock)
            ord_, status, created, _ = self.jobs[job]
            self.touched.add(job)
            if kind == "expired":
                del self.jobs[job]
            else:
                self.jobs[job] = ord_, status, created, True
            yield due, None, "timer", job, kind, kind == "expired"

    def take(self, now: int, seq: int, command: str, job: str | None) -> Iterator[tuple]:
        """What the clock says up to a command, and what the command does. A claim names no job: it gets the first pending one."""
        yield from self.alarms(now)
        if command == "claim" and job is None:
            while self.pending and self.jobs.get(self.pending[0][1], (None, ""))[:2] != (self.pending[0][0], "pending"):
                heapq.heappop(self.pending)
            if not self.pending:
                yield now, seq, command, None, "none", False
                return
            job = self.pending[0][1]
        ord_, before, since, late = self.jobs.get(job, (self.next, None, 0, False))
        status, created, told, changed = step(before, since, command, now, self.ttl, self.timeout)
        if status is None and job in self.jobs:
            del self.jobs[job]
            self.touched.add(job)
        elif status is not None and (status, created) != (before, since):
            self.next += before is None
            late = late and created == since
            self._put(job, ord_, status, created, late)
            self._place(job, ord_, status, created, late)
        yield now, seq, command, job, told, changed


class Queue(StatefulProcessor):
    """State by queue: its jobs. A queue has one timer, the next alarm of its jobs."""

    def __init__(self, ttl: float, timeout: float):
        self.ttl, self.timeout = round(ttl * 1000), round(timeout * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getMapState("jobs", "job_id string", "ord long, status string, created long, late boolean")

    def _open(self) -> Jobs:
        jobs = Jobs({key[0]: tuple(value) for key, value in self.state.iterator()}, self.ttl, self.timeout)
        self.stored, self.timer = set(jobs.jobs), jobs.due()
        return jobs

    def _close(self, jobs: Jobs) -> None:
        """Each call of the store is a way to the JVM and back, so that a job that came and went in one batch makes none."""
        for job in jobs.touched:
            if job in jobs.jobs:
                self.state.updateValue((job,), jobs.jobs[job])
            elif job in self.stored:
                self.state.removeKey((job,))
        due = jobs.due()
        if self.timer is not None and self.timer != due:
            self.handle.deleteTimer(self.timer)
        if due is not None:
            self.handle.registerTimer(due)

    def _told(self, queue: str | None, out: Iterable[tuple]) -> Iterator[Row]:
        for part in batched(out, TOLD):
            yield Row(*_COLUMNS)(queue, *zip(*part, strict=True))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        jobs = self._open()
        commands = sorted((x[-4:] for x in rows), key=lambda x: (x[0] is None, x[0] or _EPOCH, x[1] is None, x[1] or 0))
        at = lambda ts: NO_TIME if ts is None else (ts - _EPOCH) // _MILLISECOND
        yield from self._told(key[0], (told for ts, *command in commands for told in jobs.take(at(ts), *command)))
        self._close(jobs)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        jobs = self._open()
        self.timer = None  # Spark takes the one that rang away
        yield from self._told(key[0], jobs.alarms(timerValues.getCurrentWatermarkInMs()))
        self._close(jobs)

    def close(self) -> None:
        pass


def queues(commands: DataFrame, ttl: float = rules.JOB_TTL, timeout: float = rules.JOB_TIMEOUT, late: str = "10 minutes") -> DataFrame:
    """What each command of a stream (queue, seq, ts, command, job_id) does, and what the clock says without any: (queue, ts in ms, seq, command, job_id, status, changed).

    A claim without a job gets the first one of its queue that waits, in the order of uploads, and no other claim gets it
    again. A job that waits longer than `timeout` seconds gives a row of command "timer" once, and one older than `ttl`
    gives one and is gone. The clock is that of the commands: alarms before a command's time come first, and the others
    once all commands up to their time are in, `late` behind the latest. A queue's commands of one batch are taken by ts, then by
    seq; its state is the jobs of one time to live. Commands without a queue form one of their own.
    """
    timed = commands.withWatermark("ts", late).select("queue", "ts", "seq", "command", "job_id")
    told = timed.groupBy("queue").transformWithState(Queue(ttl, timeout), PACKED, "append", "EventTime")
    return told.select("queue", F.inline(F.arrays_zip(*_COLUMNS[1:])))


class several_states:
    """Within this block, streams that start use the state store for state of several variables; what was set before comes back."""

    KEY = "spark.sql.streaming.stateStore.providerClass"

    def __init__(self, spark: SparkSession):
        self.conf = spark.conf

    def __enter__(self) -> None:
        self.before = self.conf.get(self.KEY, None)
        self.conf.set(self.KEY, STORE)

    def __exit__(self, *_) -> None:
        if self.before is None:
            self.conf.unset(self.KEY)
        else:
            self.conf.set(self.KEY, self.before)
