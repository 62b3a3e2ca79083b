"""Operations of an event stream, by event time: late and repeated events, timers, bounded history.

The rules of ``progress`` hold, with a clock that depends on the events alone. An event counts once,
however often it is sent within the delay; one that comes after the watermark has passed it is left out.
Events wait until the watermark has passed them and are taken in the order of their times, so the order in
which they arrive does not matter. An operation still open ``minutes`` after its start is closed as
interrupted at that moment, by a timer; what comes later finds no open operation.

Documents are dealt to groups by hash. A group's state is the open operations and the waiting events of its documents, so a
call of Python serves all that a micro-batch has of them. Closed operations leave the state at once.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sealgrade import vocab as V
from sealgrade.session import remove_path
from sealgrade.streaming.progress import history

#: How long events may be late, or come again.
DELAY = "10 minutes"
#: Groups of documents; a stream keeps the number that it began with.
GROUPS = 2048
_FIRST = -(1 << 63)
_CLOSED = "document_id {key}, started_us long, status string, completed_us long, error string, step_count long, last_message string"
_STATE = ("open array<{key}>, started array<long>, steps array<long>, last array<string>, "
          "document_id array<{key}>, at array<long>, seq array<long>, kind array<string>, message array<string>")
_EVENT = ("document_id", "at", "seq", "kind", "message")


def _transition(limit: int):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        clock = state.getCurrentWatermarkMs()
        now = clock * 1000
        docs, starts, counts, lasts, *waiting = state.get if state.exists else [()] * 9
        active = {d: [*op] for d, *op in zip(docs, starts, counts, lasts, strict=True)}
        events = list(zip(*waiting, strict=True))
        for f in frames:
            events += zip(*(f[c].tolist() for c in _EVENT), strict=True)
        events.sort(key=itemgetter(1, 2))
        closed, ended = [], {}

        def close(doc, status: str, at: int, error: str | None) -> None:
            started, steps, last = active.pop(doc)
            # of operations with the same start, the first to close counts
            if ended.get(doc) != started:
                closed.append((doc, started, status, at, error, steps, last))
            ended[doc] = started

        due = bisect_left(events, now, key=itemgetter(1))
        for doc, at, _, kind, message in events[:due]:
            op = active.get(doc)
            if op is not None and at > op[0] + limit:
                close(doc, "error", op[0] + limit, V.STALE_ERROR)
                op = None
            if kind == "start":
                active[doc] = [at, 0, None]
            elif op is not None and kind == "progress":
                op[1:] = op[1] + 1, message
            elif op is not None:
                close(doc, "completed" if kind == "complete" else "error", at, message if kind == "error" else None)
        for doc, started in [(d, op[0]) for d, op in active.items() if now > op[0] + limit]:
            close(doc, "error", started + limit, V.STALE_ERROR)
        rest = events[due:]
        if not active and not rest:
            state.remove()
        else:
            opened = list(active.values())
            state.update((list(active), *([op[i] for op in opened] for i in range(3)), *([e[i] for e in rest] for i in range(5))))
            wake = [e[1] for e in rest[:1]] + [op[0] + limit for op in opened]
            state.setTimeoutTimestamp(max(min(wake) // 1000, clock, 1))
        if closed:
            yield pd.DataFrame(closed, columns=["document_id", "started_us", "status", "completed_us", "error", "step_count", "last_message"])

    return step


def closed_operations(
    events: DataFrame, delay: str = DELAY, minutes: int = V.STALE_MINUTES, groups: int = GROUPS,
) -> DataFrame:
    """Operations as they close, from a stream of ``document_id, event_ts, seq, kind, message``.

    ``document_id`` and ``seq`` tell whether an event is the same one again. Events without a document or time are
    left out. A row appears once, when the watermark, ``delay`` behind the latest event, has passed its end.
    """
    key = events.schema["document_id"].dataType.simpleString()
    once = (
        events.where("document_id is not null and event_ts is not null and kind in ('start', 'progress', 'complete', 'error')")
        .select("document_id", "event_ts", F.col("seq").cast("long").alias("seq"), "kind", F.col("message").cast("string").alias("message"))
        .withWatermark("event_ts", delay).dropDuplicatesWithinWatermark(["document_id", "seq"])
        .withColumns({
            "at": F.unix_micros("event_ts"), "seq": F.coalesce("seq", F.lit(_FIRST)),
            "part": F.pmod(F.xxhash64("document_id"), F.lit(groups)).cast("int")})
    )
    closed = once.groupBy("part").applyInPandasWithState(
        _transition(minutes * 60_000_000), _CLOSED.format(key=key), _STATE.format(key=key), "append", GroupStateTimeout.EventTimeTimeout)
    return closed.select(
        "document_id", F.timestamp_micros("started_us").alias("started_at"), "status",
        F.timestamp_micros("completed_us").alias("completed_at"), "error", "step_count", "last_message")


def run_operations(
    events: DataFrame, path: str, checkpoint: str, delay: str = DELAY, minutes: int = V.STALE_MINUTES,
    length: int = V.HISTORY_LENGTH, trigger: dict | None = None, groups: int = GROUPS,
) -> StreamingQuery:
    """Write closed operations to ``<path>/closed`` and keep the ``length`` latest in ``<path>/latest``.

    A micro-batch writes what it closed and folds it into the latest ones of the batch before, so it costs its own
    size whatever went before. Both are overwritten when a batch is repeated: results are exactly once.
    ``trigger`` is that of the query, all that is there now by default.
    """
    spark = events.sparkSession

    def fold(batch: DataFrame, n: int) -> None:
        mine = f"{path}/closed/batch={n}"
        batch.write.mode("overwrite").parquet(mine)
        latest = spark.read.schema(batch.schema).parquet(mine)
        if n > 0:
            latest = latest.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/latest/batch={n - 1}"))
        history(latest, length).write.mode("overwrite").parquet(f"{path}/latest/batch={n}")
        if n > 1:
            # a repeated batch needs the one before it only
            remove_path(spark, f"{path}/latest/batch={n - 2}")

    return (
        closed_operations(events, delay, minutes, groups).writeStream.foreachBatch(fold).outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def read_closed(spark: SparkSession, path: str) -> DataFrame:
    """All operations closed so far."""
    return spark.read.parquet(f"{path}/closed").drop("batch")


def read_latest(spark: SparkSession, path: str) -> DataFrame | None:
    """The latest closed operations, newest first; None before the first batch."""
    try:
        kept = spark.read.parquet(f"{path}/latest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    last = kept.agg(F.max("batch")).first()[0]
    return history(kept.where(F.col("batch") == last).drop("batch"), V.HISTORY_LENGTH)
