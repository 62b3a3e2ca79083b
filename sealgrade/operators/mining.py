"""Error mining: features, correction join, k-means, cluster reports, terms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from sealgrade import vocab as V
from sealgrade.functions.text import words
from sealgrade.session import stage

CLUSTER_COLUMNS = (
    "confidence", "segment_count", "evidence_count", "has_additional_labels", "is_unsafe",
    "requires_review_int",
)


def _size(name: str):
    return F.when(F.col(name).isNotNull(), F.size(name)).otherwise(F.lit(0))


def error_features(verdicts: DataFrame) -> DataFrame:
    """Numeric features of verdicts; missing numbers become 0."""
    return verdicts.select(
        "document_id", "classification", F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("requires_review", F.lit(False)).alias("requires_review"),
        _size("text_segments").alias("segment_count"),
        _size("evidence").alias("evidence_count"),
        F.when(_size("additional_labels") > 0, 1).otherwise(0).alias("has_additional_labels"),
        F.when(F.col("safety_check.is_safe") == F.lit(False), 1).otherwise(0).alias("is_unsafe"),
    )


def count_features(verdicts: DataFrame) -> DataFrame:
    """The shorter feature vector: confidence and keyword, segment, page counts."""
    return verdicts.select(
        "document_id", "classification", F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        _size("all_keywords").alias("keyword_count"), _size("text_segments").alias("segment_count"),
        F.coalesce("page_count", F.lit(0)).alias("page_count"),
    )


def corrected(learning: DataFrame) -> DataFrame:
    """Corrections (``approved`` false; a missing mark is left out)."""
    return learning.where(F.col("approved") == F.lit(False)).select(
        "document_id", "original_classification", "corrected_classification",
        F.coalesce("feedback_notes", F.lit("No notes")).alias("feedback_notes"),
    )


def join_corrections(features: DataFrame, corrections: DataFrame, only_corrected: bool = True) -> DataFrame:
    """Features of corrected documents; with ``only_corrected`` off all documents
    stay, for when there are no corrections yet."""
    return features.join(corrections, "document_id", "inner" if only_corrected else "left")


def potential_errors(
    features: DataFrame, below: float = V.POTENTIAL_ERROR_CONFIDENCE,
    segments: int = V.POTENTIAL_ERROR_SEGMENTS,
) -> DataFrame:
    return features.where((F.col("confidence") < below) & (F.col("segment_count") >= segments))


def with_review_flag(features: DataFrame) -> DataFrame:
    return features.withColumn(
        "requires_review_int", F.when(F.col("requires_review"), 1).otherwise(0)
    )


def cluster_pipeline(
    columns: Sequence[str] = CLUSTER_COLUMNS, k: int = V.CLUSTERS, seed: int = V.CLUSTER_SEED,
    mean: bool = True, std: bool = True,
) -> Pipeline:
    """Assemble (rows with missing values are skipped), standardise, k-means."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(columns), outputCol="features_raw", handleInvalid="skip"),
        StandardScaler(
            inputCol="features_raw", outputCol="features", withMean=mean, withStd=std
        ),
        KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster"),
    ])


def scaled_features(features: DataFrame, columns: Sequence[str] = CLUSTER_COLUMNS) -> DataFrame:
    """What k-means sees: rows without missing values, each column less its mean and over its deviation.

    The columns are written first: fitting and scaling both read them."""
    features = stage(features.select("document_id", *columns))
    steps = cluster_pipeline(columns).getStages()[:2]
    scaled = Pipeline(stages=steps).fit(features).transform(features)
    values = vector_to_array("features")
    return scaled.select("document_id", *[values[i].alias(c) for i, c in enumerate(columns)])


def cluster(
    features: DataFrame, columns: Sequence[str] = CLUSTER_COLUMNS, k: int = V.CLUSTERS, **options
) -> tuple[PipelineModel | None, DataFrame]:
    """Fit and assign. ``features`` is read once per iteration: pass a stored
    table or the output of ``stage``.

    k-means cannot place more centres than there are different points, so ``k``
    is lowered to their number; with fewer than two, all rows are cluster 0 and
    there is no model.
    """
    different = features.select(*columns).na.drop().distinct().limit(k).count()
    if different < 2:
        return None, features.na.drop(subset=list(columns)).withColumn("cluster", F.lit(0))
    model = cluster_pipeline(columns, min(k, different), **options).fit(features)
    return model, model.transform(features)


def cluster_summary(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("doc_count"),
        F.round(F.avg("confidence"), 4).alias("avg_confidence"),
        F.round(F.avg("segment_count"), 2).alias("avg_segments"),
        F.sum(F.when(F.col("is_unsafe") == 1, 1).otherwise(0)).alias("unsafe_count"),
    )


def class_patterns(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy("classification", "cluster").agg(
        F.count(F.lit(1)).alias("count"), F.round(F.avg("confidence"), 4).alias("avg_confidence")
    )


def top_patterns(patterns: DataFrame, n: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """A counted table by size, or its ``n`` largest groups; ties go by ``order``."""
    ordered = patterns.orderBy(F.col("count").desc(), *order)
    return ordered if n is None else ordered.limit(n)


def representatives(clustered: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` documents of each cluster by id. The ranking is limited on
    each partition before the shuffle, so a huge cluster sends few rows."""
    w = Window.partitionBy("cluster").orderBy("document_id")
    return (
        clustered.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
        .select("cluster", "rank", "document_id", "classification", "confidence", "segment_count")
    )


def training_examples(clustered: DataFrame) -> DataFrame:
    """One row per example with its cluster's size.

    A list per cluster would put a cluster into one value; rows carry the same
    content at any size. The join side has one row per cluster.
    """
    sizes = clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("count"))
    return clustered.select(
        "cluster", "document_id", "classification", "confidence", "segment_count"
    ).join(F.broadcast(sizes), "cluster")


def class_terms(
    df: DataFrame, classification: str = "classification", text: str = "text",
    longer_than: int = 3, n: int | None = 20,
) -> DataFrame:
    """Term weights per class: occurrences times ``ln((N + 1) / (df + 1))``.

    One pass over the text emits each word once per occurrence and once per
    document; both counts are combined before the shuffle, so only distinct
    (class, word) pairs travel. ``n`` limits the report per class.
    """
    tokens = df.select(
        F.col(classification).alias("classification"),
        words(F.col(text), longer_than).alias("_words"),
    )
    every = F.transform("_words", lambda w: F.struct(w.alias("term"), F.lit(1).alias("t"), F.lit(0).alias("d")))
    once = F.transform(F.array_distinct("_words"), lambda w: F.struct(
        w.alias("term"), F.lit(0).alias("t"), F.lit(1).alias("d")))
    counts = tokens.select("classification", F.inline(F.concat(every, once))).groupBy(
        "classification", "term"
    ).agg(F.sum("t").alias("tf"), F.sum("d").alias("class_df"))
    total = df.agg(F.count(F.lit(1))).scalar()
    spread = counts.groupBy("term").agg(F.sum("class_df").alias("df"))
    weighted = counts.join(spread, "term").withColumn(
        "weight", F.col("tf") * F.log((total + 1) / (F.col("df") + 1))
    ).select("classification", "term", "tf", "df", "weight")
    if n is None:
        return weighted
    w = Window.partitionBy("classification").orderBy(F.col("weight").desc(), "term")
    return weighted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
