"""Dashboard aggregates over verdicts, feedback and segments.

Verdict tables need ``classification``, ``confidence``, ``requires_review`` and
``is_safe`` (flat). Aggregates group on small sets and combine before the
shuffle; results are ordered where they are read, not where they are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sealgrade import vocab as V
from sealgrade.operators.running import running_sums


def _count_if(condition: Column) -> Column:
    """Rows where ``condition`` holds; 0 (not null) without rows."""
    return F.count_if(F.coalesce(condition, F.lit(False)))


def flat(verdicts: DataFrame) -> DataFrame:
    """Verdicts with ``is_safe`` lifted out of the safety record."""
    return verdicts.withColumn("is_safe", F.col("safety_check.is_safe"))


REVIEW = "requires_review"


def class_distribution(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("classification").agg(
        F.count(F.lit(1)).alias("total_documents"),
        F.round(F.avg("confidence"), 4).alias("avg_confidence"),
        _count_if(F.col(REVIEW)).alias("review_needed"),
        _count_if(~F.col("is_safe")).alias("unsafe_count"),
    )


def confidence_level(confidence: Column) -> Column:
    level = None
    for bound, name in V.CONFIDENCE_LEVELS:
        test = confidence >= bound
        level = F.when(test, F.lit(name)) if level is None else level.when(test, F.lit(name))
    return level.otherwise(F.lit(V.LOWEST_LEVEL))


def confidence_levels(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy(
        "classification", confidence_level(F.col("confidence")).alias("confidence_level")
    ).agg(F.count(F.lit(1)).alias("count"))


def correction_matrix(learning: DataFrame, corrections_only: bool = False) -> DataFrame:
    """Original by corrected class. Approvals count too, with a null target,
    unless ``corrections_only``."""
    rows = learning.where(F.col("corrected_classification").isNotNull()) if corrections_only else learning
    return rows.groupBy("original_classification", "corrected_classification").agg(
        F.count(F.lit(1)).alias("correction_count")
    )


def class_summary(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("classification").agg(
        F.count(F.lit(1)).alias("total_docs"),
        F.round(F.avg("confidence"), 3).alias("avg_confidence"),
    )


def high_confidence(verdicts: DataFrame, at_least: float = 0.98) -> DataFrame:
    return verdicts.where(F.col("confidence") >= at_least).groupBy("classification").agg(
        F.count(F.lit(1)).alias("high_confidence_count")
    )


def safety_summary(verdicts: DataFrame) -> DataFrame:
    unsafe = _count_if(~F.col("is_safe"))
    return verdicts.groupBy("classification").agg(
        F.count(F.lit(1)).alias("total"), unsafe.alias("unsafe_count"),
        F.round(unsafe * 100.0 / F.count(F.lit(1)), 2).cast("double").alias("unsafe_percentage"),
    )


def kpis(verdicts: DataFrame) -> DataFrame:
    """Four figures in long form from one pass, with the time of the run."""
    total = F.count(F.lit(1))
    one = verdicts.agg(
        total.cast("double").alias("total_documents"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"),
        F.when(total > 0, _count_if(F.col("confidence") >= 0.98) / total)
        .otherwise(F.lit(0.0)).alias("high_confidence_rate"),
        F.when(total > 0, _count_if(F.col(REVIEW)) / total).otherwise(F.lit(0.0))
        .alias("review_rate"),
    )
    return one.unpivot([], one.columns, "metric", "value").withColumn(
        "timestamp", F.current_timestamp()
    )


def estimated_accuracy(verdicts: DataFrame, learning: DataFrame) -> DataFrame:
    corrections = learning.agg(_count_if(~F.col("approved"))).scalar()
    docs = verdicts.agg(F.count(F.lit(1)).alias("total_documents"))
    return docs.withColumn("corrections", corrections).withColumn(
        "estimated_accuracy",
        F.when(F.col("total_documents") > 0,
               (F.col("total_documents") - F.col("corrections")) / F.col("total_documents") * 100),
    )


def class_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("classification").agg(F.count(F.lit(1)).alias("count"))


def confidence_histogram(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy(
        (F.floor(F.col("confidence") * 10) / 10).alias("confidence_bucket")
    ).agg(F.count(F.lit(1)).alias("count"))


def panel(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(
        F.count(F.lit(1)).alias("total_documents"), F.avg("confidence").alias("avg_confidence"),
        F.avg("processing_time").alias("avg_processing_time"),
        _count_if(F.col(REVIEW)).alias("needs_review"),
        _count_if(~F.col("is_safe")).alias("unsafe_count"),
        F.coalesce(F.sum("page_count"), F.lit(0)).alias("total_pages"),
        F.coalesce(F.sum("image_count"), F.lit(0)).alias("total_images"),
    )


def bar_chart(verdicts: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` documents by id."""
    return verdicts.select("document_id", "filename", "confidence").orderBy("document_id").limit(n)


def segment_statistics(segments: DataFrame, level: str = "All") -> DataFrame:
    """Totals per class over all segments, and how many the level filter shows."""
    kind = F.col("classification")
    shown = F.lit(True) if level == "All" else kind == level
    return segments.agg(
        F.count(F.lit(1)).alias("total"),
        _count_if(kind == "Public").alias("public"),
        _count_if(kind == "Confidential").alias("confidential"),
        _count_if(kind == "Highly Sensitive").alias("highly_sensitive"),
        _count_if(kind == "Unsafe").alias("unsafe"),
        _count_if(shown).alias("shown"),
    )


def segments_at_level(segments: DataFrame, level: str = "All") -> DataFrame:
    return segments if level == "All" else segments.where(F.col("classification") == level)


def review_statistics(verdicts: DataFrame, feedback: DataFrame) -> DataFrame:
    reviews = feedback.agg(F.count(F.lit(1))).scalar()
    base = verdicts.agg(
        F.count(F.lit(1)).alias("total_classifications"),
        _count_if(F.col(REVIEW)).alias("pending_reviews"),
    ).withColumn("total_reviews", reviews)
    total = F.col("total_classifications")

    def rate(name):
        return F.when(total > 0, F.col(name) / total).otherwise(F.lit(0.0))

    return base.withColumns({
        "review_rate": rate("total_reviews"), "pending_rate": rate("pending_reviews"),
    })


def _is_corrected() -> Column:
    return F.length(F.coalesce("corrected_classification", F.lit(""))) > 0


def feedback_statistics(feedback: DataFrame) -> DataFrame:
    total = F.count(F.lit(1))
    approved, corrected = _count_if(F.col("approved")), _count_if(_is_corrected())

    def rate(n):
        return F.when(total > 0, n / total).otherwise(F.lit(0.0))

    return feedback.agg(
        total.alias("total_reviews"), approved.alias("approved"), corrected.alias("corrected"),
        rate(approved).alias("approval_rate"), rate(corrected).alias("correction_rate"),
    )


def correction_patterns(feedback: DataFrame) -> DataFrame:
    """Counts per ``original -> corrected`` pair."""
    pair = F.concat(
        F.coalesce("original_classification", F.lit("Unknown")), F.lit(" -> "),
        F.col("corrected_classification"),
    )
    return feedback.where(_is_corrected()).groupBy(pair.alias("pattern")).agg(
        F.count(F.lit(1)).alias("count")
    )


def learning_statistics(learning: DataFrame) -> DataFrame:
    """Entries, corrections, approvals. A missing mark counts as approval."""
    corrections = _count_if(~F.coalesce("approved", F.lit(True)))
    return learning.agg(
        F.count(F.lit(1)).alias("total_entries"), corrections.alias("corrections_count"),
        (F.count(F.lit(1)) - corrections).alias("approvals_count"),
    )


def corrected_distribution(learning: DataFrame) -> DataFrame:
    """Entries per corrected class; approvals count under null."""
    return learning.groupBy("corrected_classification").agg(F.count(F.lit(1)).alias("count"))


def daily_accuracy(learning: DataFrame, day: Column, classification: str = "original_classification") -> DataFrame:
    return learning.groupBy(F.col(classification).alias("classification"), day.alias("date")).agg(
        F.avg(F.when(F.col("approved"), 1.0).otherwise(0.0)).alias("accuracy"),
        F.count(F.lit(1)).alias("total_reviews"),
    )


def review_queue(verdicts: DataFrame, order: str = "unsafe_first") -> DataFrame:
    """Documents waiting for review: unsafe ones first, then by lowest confidence.

    ``order="reference"`` sorts safe ones first. Ties go by id.
    """
    safe = F.coalesce("is_safe", F.lit(True))
    first = safe.asc() if order == "unsafe_first" else safe.desc()
    columns = [c for c in (
        "document_id", "filename", "classification", "confidence", "review_reason", "is_safe",
        "submitted_at") if c in verdicts.columns]
    return verdicts.where(F.coalesce(REVIEW, F.lit(False))).select(*columns).orderBy(
        first, "confidence", "document_id"
    )


def review_queue_counts(verdicts: DataFrame) -> DataFrame:
    queued = F.coalesce(REVIEW, F.lit(False))
    return verdicts.agg(
        F.count_if(queued).alias("count"),
        F.count_if(queued & ~F.coalesce("is_safe", F.lit(True))).alias("unsafe_count"),
    )


def class_quality(learning: DataFrame) -> DataFrame:
    """Precision and recall per class from reviews: the human class is the
    corrected one, or the original when approved."""
    human = F.coalesce("corrected_classification", F.when(F.col("approved"), F.col("original_classification")))
    pairs = learning.select(F.col("original_classification").alias("p"), human.alias("h")).where(
        F.col("h").isNotNull()
    ).groupBy("p", "h").agg(F.count(F.lit(1)).alias("n"))
    # the matrix has few cells; each feeds its predicted and its true class
    hit = F.when(F.col("p") == F.col("h"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("bigint")
    sides = pairs.select(F.inline(F.array(
        F.struct(F.col("p").alias("classification"), F.col("n").alias("predicted"),
                 zero.alias("actual"), hit.alias("correct")),
        F.struct(F.col("h").alias("classification"), zero.alias("predicted"),
                 F.col("n").alias("actual"), zero.alias("correct")),
    )))
    total = sides.groupBy("classification").agg(
        F.sum("predicted").alias("predicted"), F.sum("actual").alias("actual"),
        F.sum("correct").alias("correct"))
    return total.withColumns({
        "precision": F.when(F.col("predicted") > 0, F.col("correct") / F.col("predicted")),
        "recall": F.when(F.col("actual") > 0, F.col("correct") / F.col("actual")),
    })


def confidence_drift(reviews: DataFrame, day: Column, at_least: float = 0.98) -> DataFrame:
    """Per day: share of high-confidence verdicts that reviewers rejected, and the
    change against the calendar day before. ``reviews`` carries ``confidence``.

    The day before is an equi-join on the daily rows; a window over all days
    would run in one task.
    """
    daily = reviews.where(F.col("confidence") >= at_least).groupBy(day.alias("date")).agg(
        F.count(F.lit(1)).alias("reviews"), _count_if(~F.col("approved")).alias("errors")
    ).withColumn("error_rate", F.col("errors") / F.col("reviews"))
    before = daily.select(
        F.date_add("date", 1).alias("date"), F.col("error_rate").alias("_before")
    )
    return daily.join(before, "date", "left").select(
        "date", "reviews", "errors", "error_rate",
        (F.col("error_rate") - F.col("_before")).alias("change"),
    )


def running_accuracy(
    reviews: DataFrame, order: str = "seq", classification: str = "original_classification"
) -> DataFrame:
    """Accuracy per class after each review, in recorded order."""
    ok = F.when(F.col("approved"), F.lit(1)).otherwise(F.lit(0))
    totals = running_sums(
        reviews.select(F.col(classification).alias("classification"), F.col(order).alias("seq"),
                       "approved"),
        ["classification"], ["seq"],
        {"reviews": F.lit(1).cast("bigint"), "correct": ok.cast("bigint")},
    )
    return totals.withColumn("accuracy", F.col("correct") / F.col("reviews"))


def confidence_trend(verdicts: DataFrame, day: Column) -> DataFrame:
    return verdicts.groupBy(day.alias("date")).agg(
        F.avg("confidence").alias("avg_confidence"), F.count(F.lit(1)).alias("documents")
    )


def evidence_by_page(evidence: DataFrame) -> DataFrame:
    """Pieces of evidence per page and the highest sensitivity among them."""
    rank = F.array_position(
        F.array(*[F.lit(c) for c in V.CLASSES]), F.coalesce("sensitivity_level", F.lit("")))
    return evidence.groupBy("document_id", "page").agg(
        F.count(F.lit(1)).alias("evidence_count"), F.max(rank).alias("_top")
    ).select(
        "document_id", "page", "evidence_count",
        F.try_element_at(F.array(*[F.lit(c) for c in V.CLASSES]), F.nullif(F.col("_top"), F.lit(0)).cast("int"))
        .alias("highest_sensitivity"),
    )
