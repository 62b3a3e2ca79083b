"""Streams of verdict files and of review feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from sealgrade import schemas as S
from sealgrade.operators.feedback import apply_feedback, upsert_learning
from sealgrade.sources.files import _CORRUPT
from sealgrade.sources.tables import SnapshotTable


def daily_accuracy(
    reviews: DataFrame, watermark: str = "1 day", classification: str = "original_classification"
) -> DataFrame:
    """Accuracy per class in tumbling one-day windows of ``event_ts``."""
    return (
        reviews.withWatermark("event_ts", watermark)
        .groupBy(F.window("event_ts", "1 day").alias("w"), F.col(classification).alias("classification"))
        .agg(
            F.avg(F.when(F.col("approved"), 1.0).otherwise(0.0)).alias("accuracy"),
            F.count(F.lit(1)).alias("total_reviews"),
        )
        .select(
            "classification", F.col("w.start").cast("date").alias("date"), "accuracy", "total_reviews")
    )


def ingest_verdicts(
    spark: SparkSession, source: str, bronze: str, checkpoint: str, one_per_file: bool = True,
    trigger: dict | None = None, glob: str = "*.json", once_within: str | None = None,
) -> StreamingQuery:
    """Append new verdict files below ``source`` to a bronze table, each once.

    Unreadable records are left to ``quarantine_verdicts``. ``trigger`` is that of the query, all that is
    there now by default. With ``once_within`` a record that comes again in another file within that time of
    the first one's file is left out.
    """
    files = _verdict_stream(spark, source, one_per_file, glob).where(F.col(_CORRUPT).isNull()).drop(_CORRUPT)
    if once_within:
        same = F.sha2(F.to_json(F.struct(*[c for c in files.columns if c != "source_file"])), 256)
        files = (
            files.withColumns({"_at": F.col("_metadata.file_modification_time"), "_same": same})
            .withWatermark("_at", once_within).dropDuplicatesWithinWatermark(["_same"]).drop("_at", "_same")
        )
    return _append(files, bronze, checkpoint, trigger)


def quarantine_verdicts(
    spark: SparkSession, source: str, path: str, checkpoint: str, one_per_file: bool = True,
    trigger: dict | None = None, glob: str = "*.json",
) -> StreamingQuery:
    """Append the records that ``ingest_verdicts`` cannot read, as ``source_file, content``, each once."""
    files = _verdict_stream(spark, source, one_per_file, glob)
    # Spark reads the broken text only together with another column
    is_broken = F.col(_CORRUPT).isNotNull() & (F.coalesce("document_id", F.lit("")) >= "")
    broken = files.where(is_broken).select("source_file", F.col(_CORRUPT).alias("content"))
    return _append(broken, path, checkpoint, trigger)


def _verdict_stream(spark: SparkSession, source: str, one_per_file: bool, glob: str) -> DataFrame:
    schema = StructType([*S.VERDICT.fields, StructField(_CORRUPT, StringType())])
    return (
        spark.readStream.schema(schema).option("multiLine", one_per_file).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _CORRUPT).option("pathGlobFilter", glob).json(source)
        .withColumn("source_file", F.col("_metadata.file_path"))
        .where(~F.col("source_file").endswith("/learning_database.json"))
    )


def _append(rows: DataFrame, path: str, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    return (
        rows.writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).outputMode("append")
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def log_reviews(feedback: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append incoming reviews to a log, each once. ``seq`` must increase over the
    whole stream. A micro-batch costs its own size, however large the verdict
    table is: reviews meet verdicts when read (``reviewed_verdicts``) and are
    folded into the tables now and then (``merge_reviews``)."""
    return _append(feedback, path, checkpoint, trigger)


def _merged_through(verdicts: SnapshotTable) -> int:
    merges = verdicts.history().where(F.col("operation").startswith("MERGE "))
    last = merges.agg(F.max(F.substring("operation", 7, 20).cast("bigint"))).first()[0]
    return -1 if last is None else last


def reviewed_verdicts(verdicts: SnapshotTable, log: DataFrame) -> DataFrame:
    """Verdicts with all logged reviews applied."""
    return apply_feedback(verdicts.read(), log.where(F.col("seq") > _merged_through(verdicts)))


def merge_reviews(learning: SnapshotTable, verdicts: SnapshotTable, log: DataFrame) -> None:
    """Fold logged reviews into both tables.

    The verdict table's history records how far it has come, and the learning
    table is written first and by upsert, so a merge that failed half-way can be
    repeated, and one that is repeated changes nothing.
    """
    done = _merged_through(verdicts)
    through = log.agg(F.max("seq")).first()[0]
    if through is None or through <= done:
        return
    fresh = log.where((F.col("seq") > done) & (F.col("seq") <= through))
    learning.overwrite(upsert_learning(learning.read(), fresh), f"MERGE {through}")
    verdicts.overwrite(apply_feedback(verdicts.read(), fresh), f"MERGE {through}")
