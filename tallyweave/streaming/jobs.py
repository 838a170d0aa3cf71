"""The job queue as a stateful stream of commands, and streaming counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyweave.functions import rules

#: command -> (states it applies to, or None for any; the state it leads to). Status polls of a finished job lead to a
#: review, from which a submission removes it.
MOVES = {
    "start": (("held",), "pending"),
    "claim": (("pending",), "processing"),
    "result": (None, "done"),
    "error": (None, "failed"),
    "review": (("done",), "need_review"),
    "finish": (("done",), "removed"),
    "submit": (None, "removed"),
}
OUTPUT = "job_id string, ts double, command string, status string, changed boolean"


def step(status: str | None, created: float, command: str, ts: float, ttl: float = rules.JOB_TTL, timeout: float = rules.JOB_TIMEOUT) -> tuple[str | None, float, str, bool]:
    """(state, created, status told, changed) after a command. A job older than `ttl` is gone; one that waits longer than `timeout` tells so and stays."""
    if command == "upload":
        return "held", ts, "held", True
    if status is not None and ts - created > ttl:
        status = None
    if status is None:
        return None, created, "unknown", False
    if command == "status":
        late = status in ("pending", "processing") and ts - created > timeout
        return status, created, "timeout" if late else status, False
    states, to = MOVES.get(command, ((), status))
    if states is not None and status not in states:
        return status, created, status, False
    created = ts if command == "start" else created
    return (None if to == "removed" else to), created, to, True


def job_states(commands: DataFrame) -> DataFrame:
    """What each command (job_id, ts seconds, command) does, in the order of its job's commands; state is kept by job and lapses after its time to live.

    A claim names its job, which `queue_heads` picks. Commands of one job in one batch are taken by time.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        status, created = state.get if state.exists else (None, 0.0)
        status, out = status or None, []
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        for ts, command in zip(rows.ts, rows.command, strict=True):
            status, created, told, changed = step(status, created, command, float(ts))
            out.append((key[0], float(ts), command, told, changed))
        if status is None:
            state.remove()
        else:
            state.update((status, created))
            state.setTimeoutDuration(rules.JOB_TTL * 1000)
        yield pd.DataFrame(out, columns=["job_id", "ts", "command", "status", "changed"])

    return commands.select("job_id", "ts", "command").groupBy("job_id").applyInPandasWithState(run, OUTPUT, "status string, created double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def queue_heads(jobs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The first pending job of each queue (job_id, status, enqueue_ord)."""
    keys = keys or []
    pending = jobs.where("status = 'pending'")
    if not keys:
        return pending.orderBy("enqueue_ord").limit(1)
    return pending.withColumn("__k", F.row_number().over(W.partitionBy(*keys).orderBy("enqueue_ord"))).where("__k = 1").drop("__k")


def activity(events: DataFrame, user: str = "user_id", ts: str = "ts", gap: int = rules.ACTIVE_WINDOW) -> DataFrame:
    """Spans of activity: events less than `gap` seconds apart belong together."""
    order = W.partitionBy(user).orderBy(ts)
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    rows = events.select(user, ts).withColumn("__s", seconds)
    rows = rows.withColumn("__new", (F.lag("__s").over(order).isNull() | (F.col("__s") - F.lag("__s").over(order) >= gap)).cast("int"))
    rows = rows.withColumn("session", F.sum("__new").over(order))
    return rows.groupBy(user, "session").agg(F.min(ts).alias("began"), F.max(ts).alias("ended"), F.count("*").alias("n_events"))


def title_totals(observations: DataFrame, seen: str | None = None, keep: str = "30 days") -> DataFrame:
    """Running statistics by title of a stream of (batch_id, title, total, in_af), for update mode; a batch seen again counts once.

    With `seen`, a column of times, batches are remembered for `keep` behind the latest time, which bounds the state; without it for ever.
    """
    if seen is None:
        once = observations.dropDuplicates(["batch_id", "title"])
    else:
        once = observations.withWatermark(seen, keep).dropDuplicatesWithinWatermark(["batch_id", "title"])
    return once.groupBy("title").agg(F.sum("total").alias("total"), F.sum("in_af").alias("in_af"), F.count("*").alias("files"))


def event_counts(events: DataFrame, key: str = "event_type") -> DataFrame:
    """Running counts by key."""
    return events.groupBy(key).agg(F.count("*").alias("n"))
