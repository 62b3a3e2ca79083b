"""What reviewers' corrections teach: rates, accuracy, misclassifications,
keyword and context patterns. Input is the output of ``normalize_feedback``.

Each result is an aggregate combined before its shuffle, so one class, word or
pair holding most of the feedback costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from sealgrade.functions.text import words

PAIR = ["original_classification", "human_classification"]


def _is_correction():
    return ~F.col(PAIR[0]).eqNullSafe(F.col(PAIR[1]))


def corrections(normalized: DataFrame) -> DataFrame:
    return normalized.where(_is_correction())


def correction_rate(normalized: DataFrame) -> DataFrame:
    wrong = F.coalesce(F.sum(_is_correction().cast("bigint")), F.lit(0).cast("bigint"))
    total = F.count(F.lit(1))
    return normalized.agg(
        total.alias("total_feedback_count"), wrong.alias("corrections"),
        F.when(total > 0, wrong / total).otherwise(F.lit(0.0)).alias("correction_rate"),
    )


def accuracy_by_class(normalized: DataFrame) -> DataFrame:
    wrong = F.sum(_is_correction().cast("bigint"))
    return normalized.groupBy(F.col(PAIR[0]).alias("classification")).agg(
        F.count(F.lit(1)).alias("total_reviews"),
        (F.count(F.lit(1)) - wrong).alias("correct"),
        wrong.alias("corrections"),
        ((F.count(F.lit(1)) - wrong) / F.count(F.lit(1)) * 100).alias("accuracy"),
    )


def misclassifications(normalized: DataFrame) -> DataFrame:
    """Corrected pairs with their share of all feedback."""
    total = normalized.agg(F.count(F.lit(1))).scalar()
    return (
        corrections(normalized).groupBy(*PAIR)
        .agg(F.count(F.lit(1)).alias("count"), F.min("seq").alias("first_seq"))
        .withColumn("percentage", F.col("count") / total * 100)
    )


def frequent_misclassifications(normalized: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most frequent pairs; equal counts keep first-seen order."""
    return misclassifications(normalized).orderBy(F.col("count").desc(), "first_seq").limit(n)


def keyword_patterns(normalized: DataFrame) -> DataFrame:
    """Words of corrected documents' file names with at least two hits.

    A word longer than three characters counts at each occurrence. The multiplier
    falls by 0.1 per hit down to 0.5. ``first_seq, first_pos`` is where the word
    was first seen.
    """
    hits = corrections(normalized).select(
        *PAIR, "seq",
        F.posexplode(words(F.col("filename"))).alias("pos", "keyword"),
    ).where(F.length("keyword") > 3)
    first = F.min(F.struct("seq", "pos"))
    pairs = hits.groupBy("keyword", *PAIR).agg(
        F.count(F.lit(1)).alias("n"), first.alias("first")
    )
    # max_by on (count, earliest first): negated positions turn min into max
    rank = F.struct(F.col("n"), -F.col("first.seq"), -F.col("first.pos"))
    total = F.sum("n")
    return (
        pairs.groupBy("keyword").agg(
            total.alias("correction_count"),
            F.greatest(F.lit(0.5), F.lit(1.0) - total * 0.1).alias("confidence_multiplier"),
            F.max_by(F.struct(*PAIR, "n"), rank).alias("common"),
            F.min("first").alias("first"),
        )
        .where(F.col("correction_count") >= 2)
        .select(
            "keyword", "correction_count", "confidence_multiplier",
            F.col(f"common.{PAIR[0]}").alias("common_from"),
            F.col(f"common.{PAIR[1]}").alias("common_to"),
            F.col("common.n").alias("common_count"),
            F.col("first.seq").alias("first_seq"), F.col("first.pos").alias("first_pos"),
        )
    )


def common_words(normalized: DataFrame, top: int | None = None, at_least: int = 2) -> DataFrame:
    """Per corrected pair: the reasoning words longer than four characters with
    ``at_least`` hits, ranked; of the ``top`` most frequent where given."""
    hits = corrections(normalized).select(
        *PAIR, "seq", F.posexplode(words(F.col("reasoning"))).alias("pos", "word"),
    ).where(F.length("word") > 4)
    counted = hits.groupBy(*PAIR, "word").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("seq", "pos")).alias("first")
    )
    w = Window.partitionBy(*PAIR).orderBy(F.col("n").desc(), F.col("first"))
    ranked = counted.withColumn("rank", F.row_number().over(w))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.where(F.col("n") >= at_least).select(*PAIR, "rank", "word", "n")


def context_patterns(
    normalized: DataFrame, at_least: int = 2, top: int | None = None, indicators: int | None = None
) -> DataFrame:
    """Corrected pairs seen at least twice with their common words and a rule;
    ``top`` and ``indicators`` bound the words ranked and kept where given."""
    pairs = (
        corrections(normalized).groupBy(*PAIR)
        .agg(F.count(F.lit(1)).alias("frequency"), F.min("seq").alias("first_seq"))
        .where(F.col("frequency") >= at_least)
    )
    # words seen once are left out before they meet
    common = common_words(normalized, top).groupBy(*PAIR).agg(
        F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("ranked")
    )
    on = [F.col(f"p.{c}").eqNullSafe(F.col(f"w.{c}")) for c in PAIR]
    found = F.coalesce(
        F.transform("w.ranked", lambda r: r["word"]), F.array().cast("array<string>")
    )
    names = [F.coalesce(F.col(f"p.{c}"), F.lit("None")) for c in PAIR]
    return pairs.alias("p").join(common.alias("w"), on, "left").select(
        *[F.col(f"p.{c}").alias(c) for c in PAIR], "p.frequency", "p.first_seq",
        (found if indicators is None else F.slice(found, 1, indicators)).alias("common_indicators"),
        F.concat(
            F.lit("Documents with '"), F.array_join(F.slice(found, 1, 3), ", "),
            F.lit("' are often "), names[1], F.lit(", not "), names[0],
        ).alias("rule"),
    )


def learning_summary(normalized: DataFrame, examples_per_class: int = 3) -> DataFrame:
    """One row: totals, rate as text, numbers of patterns, keywords, examples."""
    def count_of(df):
        return df.agg(F.count(F.lit(1))).scalar()

    examples = normalized.groupBy("human_classification").agg(
        F.least(F.count(F.lit(1)), F.lit(examples_per_class)).alias("n")
    ).agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    return correction_rate(normalized).select(
        F.col("total_feedback_count").alias("total_feedback"),
        F.format_string("%.1f%%", F.col("correction_rate") * 100).alias("correction_rate"),
        count_of(_frequent_pairs(normalized)).alias("patterns_learned"),
        count_of(keyword_patterns(normalized)).alias("keywords_tracked"),
        examples.alias("examples_available"),
    )


def _frequent_pairs(normalized: DataFrame) -> DataFrame:
    return corrections(normalized).groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
