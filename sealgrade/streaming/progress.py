"""Progress events folded into operations, in batch and as a stream.

An operation is identified by (document, start). A start replaces an open
operation of the same document, which then leaves no trace; progress belongs to
the open operation; the first complete or error closes it; events without an open
operation are ignored. An operation still open five minutes after its start is an
interrupted one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from sealgrade import vocab as V
from sealgrade.operators.running import running_sums
from sealgrade.session import stage

def _numbered(events: DataFrame) -> DataFrame:
    """Events with ``op``, the number of the operation of their document they fall
    into, and ``ended``, how often the document's operations were told to end up
    to and including this event. Events before the first start are left out. A
    document with very many events is split."""
    def one(*kinds: str) -> Column:
        return F.when(F.col("kind").isin(*kinds), F.lit(1)).otherwise(F.lit(0)).cast("bigint")

    return running_sums(
        events, ["document_id"], ["event_ts", "seq"],
        {"op": one("start"), "ended": one("complete", "error")},
    ).where(F.col("op") > 0)


def fold(events: DataFrame) -> DataFrame:
    """All operations of ``document_id, event_ts, seq, kind, message`` events, one
    row each with ``status`` active, completed or error.

    ``events`` may carry ``steps_before``: steps a start event already has.
    """
    if "steps_before" not in events.columns:
        events = events.withColumn("steps_before", F.lit(0).cast("bigint"))
    place = F.struct("event_ts", "seq")
    kind = F.col("kind")
    # the start and all steps before the end share the operation's lowest ``ended``
    parts = _numbered(events).groupBy("document_id", "op", "ended").agg(
        F.min(F.when(kind == "start", place)).alias("start"),
        F.min(F.when(kind.isin("complete", "error"), F.struct("event_ts", "seq", "kind", "message")))
        .alias("end"),
        F.count_if(kind == "progress").alias("steps"),
        F.max_by("message", F.when(kind == "progress", place)).alias("last_message"),
        F.sum("steps_before").alias("carried"),
    )
    ops = parts.groupBy("document_id", "op").agg(
        F.min("start").alias("start"), F.min("end").alias("end"),
        F.min_by(F.struct("steps", "last_message"), "ended").alias("open"),
        F.sum("carried").alias("carried"),
    )
    last = ops.groupBy("document_id").agg(F.max("op").alias("last_op"))
    kept = ops.join(last, "document_id").where(
        F.col("end").isNotNull() | (F.col("op") == F.col("last_op")))
    status = F.when(F.col("end").isNull(), F.lit("active")).when(
        F.col("end.kind") == "error", F.lit("error")).otherwise(F.lit("completed"))
    rows = kept.select(
        "document_id", "op", status.alias("status"), F.col("start.event_ts").alias("started_at"),
        F.col("start.seq").alias("start_seq"), F.col("end.event_ts").alias("completed_at"),
        F.when(status == "error", F.col("end.message")).alias("error"),
        (F.col("open.steps") + F.col("carried")).alias("step_count"),
        F.col("open.last_message").alias("last_message"),
    )
    # one entry per (document, start); the first to close wins, open ones come last
    return rows.groupBy("document_id", "started_at").agg(
        F.min_by(
            F.struct("status", "completed_at", "error", "step_count", "last_message", "start_seq"),
            F.struct(F.col("status") == "active", F.col("op")),
        ).alias("r")
    ).select("document_id", "started_at", "r.*")


def steps_table(events: DataFrame) -> DataFrame:
    """The steps of operations, one row each; kept as rows since one operation may
    have very many."""
    numbered = _numbered(events)
    first = numbered.where(F.col("kind") == "start").select(
        "document_id", "op", F.col("ended").alias("before"))
    return numbered.where(F.col("kind") == "progress").join(
        first, ["document_id", "op"]
    ).where(F.col("ended") == F.col("before")).select(
        "document_id", "op", "event_ts", "seq", "message", step_tag(F.col("message")).alias("tag"))


def expire(operations: DataFrame, now: Column, minutes: int = V.STALE_MINUTES) -> DataFrame:
    """Open operations older than ``minutes`` become errors at ``now``."""
    stale = (F.col("status") == "active") & (
        now > F.col("started_at") + F.expr(f"interval {minutes} minutes"))
    return operations.withColumns({
        "status": F.when(stale, F.lit("error")).otherwise(F.col("status")),
        "completed_at": F.when(stale, now).otherwise(F.col("completed_at")),
        "error": F.when(stale, F.lit(V.STALE_ERROR)).otherwise(F.col("error")),
    })


def operations(events: DataFrame, minutes: int = V.STALE_MINUTES) -> DataFrame:
    """Operations with stale ones expired; the clock is the latest event."""
    now = events.agg(F.max("event_ts")).scalar()
    return expire(fold(events), now, minutes)


def history(ops: DataFrame, n: int = V.HISTORY_LENGTH) -> DataFrame:
    """The ``n`` most recently finished operations, newest first."""
    return ops.where(F.col("status") != "active").orderBy(
        F.col("completed_at").desc(), F.col("started_at").desc(), "document_id"
    ).limit(n)


def step_tag(message: Column) -> Column:
    low = F.lower(message)
    return (
        F.when(message.contains("⚠") | low.contains("warning"), F.lit("warning"))
        .when(message.contains("✓") | low.contains("complete"), F.lit("success"))
        .otherwise(F.lit("info"))
    )


# --- stream -----------------------------------------------------------------

def stream_operations(
    events: DataFrame, path: str, checkpoint: str, expire_each_batch: bool = False,
    minutes: int = V.STALE_MINUTES, trigger: dict | None = None,
) -> StreamingQuery:
    """Keep operations up to date from an event stream.

    Each micro-batch folds its events together with the operations left open by
    the one before, by the batch operator, so a document with most of the events
    is split there too. ``<path>/closed/batch=<n>`` holds what batch ``n`` closed
    and ``<path>/open/batch=<n>`` what it left open, with the clock. Both are
    overwritten when a batch is repeated, so results are exactly once. Events
    are expected in order across batches; within one they may come in any order.

    Open operations are carried on, at most one per document, and shown as
    interrupted when read late (``streamed_operations``). ``expire_each_batch``
    closes stale ones for good after each batch, which bounds what is carried by
    the documents active within ``minutes``.
    """
    spark = events.sparkSession

    def step(batch: DataFrame, n: int) -> None:
        batch = batch.select("document_id", "event_ts", "seq", "kind", "message").withColumn(
            "steps_before", F.lit(0).cast("bigint"))
        clock = batch.agg(F.max("event_ts").alias("t"))
        if n > 0:
            carried = spark.read.parquet(f"{path}/open/batch={n - 1}")
            batch = batch.unionByName(carried.where(F.col("document_id").isNotNull()).select(
                "document_id", F.col("started_at").alias("event_ts"), F.col("start_seq").alias("seq"),
                F.lit("start").alias("kind"), F.col("last_message").alias("message"),
                F.col("step_count").alias("steps_before")))
            clock = clock.unionByName(carried.select(F.col("clock").alias("t"))).agg(F.max("t").alias("t"))
        ops = fold(batch)
        if expire_each_batch:
            ops = expire(ops, clock.scalar(), minutes)
        ops = stage(ops)  # both writes below read it
        ops.where(F.col("status") != "active").write.mode("overwrite").parquet(
            f"{path}/closed/batch={n}")
        # a row without document keeps the clock when nothing is open
        left = ops.where(F.col("status") == "active").withColumn("clock", clock.scalar())
        empty = clock.select(
            *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns[:-1]],
            F.col("t").alias("clock"))
        left.unionByName(empty).write.mode("overwrite").parquet(f"{path}/open/batch={n}")

    return (
        events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def streamed_operations(
    spark: SparkSession, path: str, minutes: int = V.STALE_MINUTES
) -> DataFrame:
    """Closed operations of all batches and those open after the last; the stale
    ones among these are shown as interrupted."""
    names = ["document_id", "started_at", "status", "completed_at", "error", "step_count"]
    closed = spark.read.parquet(f"{path}/closed").select(*names)
    opened = spark.read.parquet(f"{path}/open")
    last = opened.agg(F.max("batch")).scalar()
    still = opened.where((F.col("batch") == last) & F.col("document_id").isNotNull())
    return closed.unionByName(expire(still, F.col("clock"), minutes).select(*names))
