"""Streaming queries, each run over the given tables until all input is read, and
their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sealgrade.catalog.common import LEARNING
from sealgrade.session import scratch_dir, stage
from sealgrade.sources import adapters as A
from sealgrade.sources.tables import SnapshotTable, export_json
from sealgrade.streaming import operations as OP, progress as PR, reviews as RV

_MICROS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _text_times(df: DataFrame) -> DataFrame:
    return df.select(
        "document_id", "status", F.date_format("started_at", _MICROS).alias("started_at"),
        F.date_format("completed_at", _MICROS).alias("completed_at"), "error", "step_count")


def _operations(spark, sf) -> DataFrame:
    return PR.operations(A.progress_events(spark, sf))


def _stream_of(spark, df: DataFrame):
    """``df`` as a file stream."""
    path = scratch_dir(spark)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def _streamed(spark, sf) -> DataFrame:
    """Events arriving in three portions; the stream is run after each and goes on
    from its checkpoint."""
    events = A.progress_events(spark, sf)
    seconds = events.select(F.unix_timestamp("event_ts").alias("t"))
    low, high = seconds.approxQuantile("t", [0.33, 0.66], 0.01)
    portion = F.when(F.unix_timestamp("event_ts") < low, 0).when(
        F.unix_timestamp("event_ts") < high, 1).otherwise(2)
    source, path, mark = (scratch_dir(spark) for _ in range(3))
    for n in range(3):
        events.where(portion == n).write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        PR.stream_operations(stream, path, mark).awaitTermination()
    return PR.streamed_operations(spark, path)


#: Time runs this much faster than in the given events, so that operations end within minutes; and its beginning.
_FASTER, _ZERO = 200, 1_704_067_200_000_000


def _event_time_stream(spark, sf) -> str:
    """Events in three portions, some of them again in the next one and some far too late; the path written."""
    events = A.progress_events(spark, sf).withColumn(
        "event_ts", F.timestamp_micros(F.lit(_ZERO) + F.floor((F.unix_micros("event_ts") - _ZERO) / _FASTER).cast("long")))
    events = stage(events)
    low, high = events.select(F.unix_micros("event_ts").alias("t")).approxQuantile("t", [0.33, 0.66], 0.01)
    us = F.unix_micros("event_ts")
    first, second, third = events.where(us < low), events.where((us >= low) & (us < high)), events.where(us >= high)
    again = first.where(us > low - 300_000_000)
    late = first.where((us < low - 1_300_000_000) & (F.col("seq") % 3 == 0)).withColumns({
        "seq": F.col("seq") + 1_000_000_000, "kind": F.lit("complete")})
    source, path, mark = (scratch_dir(spark) for _ in range(3))
    for portion in (first, second.unionByName(again).unionByName(again), third.unionByName(late)):
        portion.write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        OP.run_operations(stream, path, mark).awaitTermination()
    return path


def _closed(spark, sf) -> DataFrame:
    return _text_times(OP.read_closed(spark, _event_time_stream(spark, sf)))


def _latest(spark, sf) -> DataFrame:
    return _text_times(OP.read_latest(spark, _event_time_stream(spark, sf)))


def _quarantined(spark, sf) -> DataFrame:
    """Verdict records as files, every seventh cut off: those the stream puts aside."""
    source, out = scratch_dir(spark), scratch_dir(spark)
    record = F.concat(F.lit('{"document_id":"'), F.col("document_id"), F.lit('","classification":"'), F.col("classification"), F.lit('"}'))
    cut = F.when(F.col("document_id") % 7 == 0, F.substring(record, F.lit(1), F.length(record) - 5)).otherwise(record)
    A.classifications(spark, sf).select(cut.alias("value")).write.text(source)
    RV.quarantine_verdicts(spark, source, out, scratch_dir(spark), one_per_file=False, glob="*.txt").awaitTermination()
    return spark.read.parquet(out).select("content")


def _daily_stream(spark, sf) -> DataFrame:
    reviews = A.learning_feedback(spark, sf).select(
        "document_id", "original_classification", "approved",
        F.col("review_date").cast("timestamp").alias("event_ts"))
    out, mark = scratch_dir(spark), scratch_dir(spark)
    stream = RV.daily_accuracy(_stream_of(spark, reviews))
    query = stream.writeStream.foreachBatch(
        lambda batch, n: batch.write.mode("overwrite").parquet(out)
    ).outputMode("complete").option("checkpointLocation", mark).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out).withColumn("accuracy", F.round("accuracy", 6))


def _ingested(spark, sf) -> DataFrame:
    """Verdict records as files, taken in by the stream."""
    source, bronze = scratch_dir(spark), scratch_dir(spark)
    A.verdicts(spark, sf).select(
        F.col("document_id").cast("string").alias("document_id"), "filename", "classification",
        "confidence", "safety_check").write.json(source)
    RV.ingest_verdicts(spark, source, bronze, scratch_dir(spark), one_per_file=False).awaitTermination()
    return spark.read.parquet(bronze).select("document_id", "filename", "classification", "confidence")


def _reviewed(merge: bool):
    """Reviews logged by the stream; half of them merged into the tables or all
    applied when read."""
    def run(spark, sf) -> DataFrame:
        columns = ["document_id", "seq", "reviewer_id", "approved", "corrected_classification",
                   "original_classification", "timestamp"]
        reviews = A.learning_feedback(spark, sf).select(*columns)
        verdicts = SnapshotTable(spark, scratch_dir(spark))
        verdicts.overwrite(A.classifications(spark, sf).select(
            "document_id", "classification", "requires_review"))
        path = scratch_dir(spark)
        RV.log_reviews(_stream_of(spark, reviews), path, scratch_dir(spark)).awaitTermination()
        log = spark.read.schema(reviews.schema).parquet(path)
        if merge:
            learning = SnapshotTable(spark, scratch_dir(spark))
            learning.overwrite(reviews.limit(0))
            middle = log.approxQuantile("seq", [0.5], 0.01)[0]
            RV.merge_reviews(learning, verdicts, log.where(F.col("seq") <= middle))
        return RV.reviewed_verdicts(verdicts, log).select(
            "document_id", "classification", "requires_review", "human_reviewed", "reviewed_by")
    return run


_REVIEWED = f"""WITH {LEARNING} SELECT k.document_id,
  coalesce(l.corrected_classification, k.classification) AS classification,
  CASE WHEN l.document_id IS NULL THEN k.requires_review ELSE false END AS requires_review,
  l.document_id IS NOT NULL AS human_reviewed, l.reviewer_id AS reviewed_by
  FROM K k LEFT JOIN L l USING (document_id)"""


def _exported(spark, sf) -> DataFrame:
    path = scratch_dir(spark)
    export_json(_text_times(_operations(spark, sf)), path)
    return spark.read.schema(
        "document_id bigint, status string, started_at string, completed_at string, error string, "
        "step_count bigint").json(path)


_NUMBERED = """E AS (SELECT user_id AS document_id, ts, event_id AS seq, event_type AS message,
    CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'error'
    ELSE 'progress' END AS kind FROM events),
N AS (SELECT *, sum(CASE WHEN kind = 'start' THEN 1 ELSE 0 END) OVER (PARTITION BY document_id
    ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS op FROM E),
P AS (SELECT *, sum(CASE WHEN kind IN ('complete', 'error') THEN 1 ELSE 0 END) OVER (PARTITION BY document_id, op
    ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS ended FROM N WHERE op > 0)"""

_OPERATIONS = f"""{_NUMBERED},
G AS (SELECT document_id, op, min(ts) FILTER (WHERE kind = 'start') AS started_at,
    min(ts) FILTER (WHERE ended = 1 AND kind IN ('complete', 'error')) AS ended_at,
    min(kind) FILTER (WHERE ended = 1 AND kind IN ('complete', 'error')) AS how,
    min(message) FILTER (WHERE ended = 1 AND kind IN ('complete', 'error')) AS what,
    count(*) FILTER (WHERE kind = 'progress' AND ended = 0) AS step_count,
    max(op) OVER (PARTITION BY document_id) AS last_op FROM P GROUP BY document_id, op),
O AS (SELECT * FROM G WHERE ended_at IS NOT NULL OR op = last_op),
C AS (SELECT max(ts) AS now FROM E),
R AS (SELECT document_id, CASE WHEN how = 'error' THEN 'error' WHEN how = 'complete' THEN 'completed'
    WHEN now > started_at + INTERVAL 5 MINUTE THEN 'error' ELSE 'active' END AS status, started_at,
  CASE WHEN ended_at IS NULL AND now > started_at + INTERVAL 5 MINUTE THEN now ELSE ended_at END AS completed_at,
  CASE WHEN how = 'error' THEN what WHEN ended_at IS NULL AND now > started_at + INTERVAL 5 MINUTE
    THEN 'Operation interrupted (page refresh)' END AS error, step_count FROM O, C)"""
_TIMES = """SELECT document_id, status, strftime(started_at, '%Y-%m-%d %H:%M:%S.%f') AS started_at,
  strftime(completed_at, '%Y-%m-%d %H:%M:%S.%f') AS completed_at, error, step_count FROM R"""

_TIMED = f"""E AS (SELECT user_id AS document_id, {_ZERO} + (epoch_us(ts) - {_ZERO}) // {_FASTER} AS us, event_id AS seq,
    event_type AS message, CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'complete'
    WHEN 'error' THEN 'error' ELSE 'progress' END AS kind FROM events),
C AS (SELECT (max(us) // 1000 - 600000) * 1000 AS clock FROM E),
N AS (SELECT E.*, sum(CASE WHEN kind = 'start' THEN 1 ELSE 0 END) OVER (PARTITION BY document_id
    ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS op,
    row_number() OVER (PARTITION BY document_id ORDER BY us, seq) AS place FROM E, C WHERE us < clock),
S AS (SELECT document_id, op, us AS started, lead(us) OVER (PARTITION BY document_id ORDER BY us, seq) AS next
    FROM N WHERE kind = 'start'),
T AS (SELECT N.*, S.started, S.next, min(CASE WHEN N.kind IN ('complete', 'error') THEN N.place END)
    OVER (PARTITION BY N.document_id, N.op) AS last
    FROM N JOIN S ON S.document_id = N.document_id AND S.op = N.op WHERE N.us <= S.started + 300000000),
G AS (SELECT document_id, op, started, next, count(*) FILTER (WHERE kind = 'progress'
      AND (last IS NULL OR place < last)) AS step_count,
    max(us) FILTER (WHERE place = last) AS ended,
    max(kind) FILTER (WHERE place = last) AS how,
    max(message) FILTER (WHERE place = last) AS what FROM T GROUP BY document_id, op, started, next),
R AS (SELECT document_id, CASE WHEN how = 'complete' THEN 'completed' ELSE 'error' END AS status,
    make_timestamp(started) AS started_at, make_timestamp(coalesce(ended, started + 300000000)) AS completed_at,
    CASE WHEN ended IS NULL THEN 'Operation interrupted (page refresh)' WHEN how = 'error' THEN what END AS error, step_count
  FROM G, C WHERE ended IS NOT NULL OR coalesce(next, clock) > started + 300000000
  QUALIFY row_number() OVER (PARTITION BY document_id, started ORDER BY op) = 1)"""

QUERIES = {
    "w01_w02_closed_operations_stream": (_closed, f"WITH {_TIMED} {_TIMES}"),
    "w03_history_stream": (
        _latest,
        f"WITH {_TIMED}, R1 AS (SELECT * FROM R ORDER BY completed_at DESC, started_at DESC, document_id LIMIT 50) "
        f"{_TIMES.replace('FROM R', 'FROM R1')}"),
    "w05_quarantined_verdicts": (
        _quarantined,
        f"""WITH {LEARNING}, J AS (SELECT document_id, concat('{{"document_id":"', CAST(document_id AS VARCHAR),
          '","classification":"', classification, '"}}') AS r FROM K)
        SELECT substring(r, 1, length(r) - 5) AS content FROM J WHERE document_id % 7 = 0"""),
    "w01_w02_operations": (lambda s, sf: _text_times(_operations(s, sf)), f"WITH {_OPERATIONS} {_TIMES}"),
    "w01_w02_operations_stream": (
        lambda s, sf: _text_times(_streamed(s, sf)), f"WITH {_OPERATIONS} {_TIMES}"),
    "w01_steps": (
        lambda s, sf: PR.steps_table(A.progress_events(s, sf)).select("document_id", "op", "seq", "message"),
        f"""WITH {_NUMBERED} SELECT document_id, CAST(op AS BIGINT) AS op, seq, message FROM P
        WHERE kind = 'progress' AND ended = 0"""),
    "w03_history": (
        lambda s, sf: _text_times(PR.history(_operations(s, sf))),
        f"WITH {_OPERATIONS}, R1 AS (SELECT * FROM R WHERE status <> 'active' ORDER BY completed_at DESC, "
        f"R.started_at DESC, document_id LIMIT 50) {_TIMES.replace('FROM R', 'FROM R1')}"),
    "s22_history_export": (_exported, f"WITH {_OPERATIONS} {_TIMES}"),
    "w04_daily_accuracy_stream": (
        _daily_stream,
        f"""WITH {LEARNING} SELECT original_classification AS classification, review_date AS date,
        round(avg(CASE WHEN approved THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
        count(*) AS total_reviews FROM L GROUP BY ALL"""),
    "w05_ingested_verdicts": (
        _ingested,
        f"""WITH {LEARNING} SELECT CAST(document_id AS VARCHAR) AS document_id, filename, classification,
        confidence FROM K"""),
    "w06_reviewed_verdicts": (_reviewed(merge=False), _REVIEWED),
    "w06_merged_reviews": (_reviewed(merge=True), _REVIEWED),
    "w07_step_tags": (
        lambda s, sf: A.table(s, sf, "events").select(
            "event_id", PR.step_tag(F.concat(
                F.when(F.col("event_type") == "error", "⚠ ").otherwise(""),
                F.when(F.col("event_type") == "purchase", "Complete: ").otherwise(""),
                F.col("event_type"))).alias("tag")),
        """SELECT event_id, CASE event_type WHEN 'error' THEN 'warning' WHEN 'purchase' THEN 'success'
        ELSE 'info' END AS tag FROM events"""),
}
