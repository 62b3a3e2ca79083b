"""Gold figures kept up from changes.

A state is a small table of sums: rows, known confidences and their total, reviews, unsafe verdicts, by class,
confidence level and whether the confidence is high. Sums of two states add up, and a row that goes counts
negative, so a state follows a table by the rows that changed and equals what a full pass would give.
Confidences are added as decimals, which leaves nothing behind when they are taken off again.
Averages and rates are taken from the sums when they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sealgrade.operators.dashboard import REVIEW, confidence_level
from sealgrade.session import stage
from sealgrade.sources.tables import SnapshotTable

SIGN = "_sign"
_HIGH = 0.98
_VERDICT_KEYS = ("classification", "confidence_level", "high")
_CORRECTION_KEYS = ("original_classification", "corrected_classification")


def verdict_cells(verdicts: DataFrame) -> DataFrame:
    """The state of flat verdicts; rows with ``_sign`` -1 are taken off."""
    sign = F.col(SIGN) if SIGN in verdicts.columns else F.lit(1)
    known = F.col("confidence").cast("decimal(38,18)")

    def count(test: Column) -> Column:
        return F.sum(F.when(test, sign).otherwise(0)).cast("bigint")

    return verdicts.groupBy(
        "classification", confidence_level(F.col("confidence")).alias("confidence_level"),
        F.coalesce(F.col("confidence") >= _HIGH, F.lit(False)).alias("high"),
    ).agg(
        F.sum(sign).cast("bigint").alias("n"), count(known.isNotNull()).alias("known"),
        F.sum(F.when(sign < 0, -known).otherwise(known)).alias("confidence"),
        count(F.col(REVIEW)).alias("review"), count(~F.col("is_safe")).alias("unsafe"),
    ).withColumn("confidence", F.coalesce("confidence", F.lit(0).cast("decimal(38,18)")))


def correction_cells(learning: DataFrame) -> DataFrame:
    """The state of reviews: how many, by original and corrected class."""
    sign = F.col(SIGN) if SIGN in learning.columns else F.lit(1)
    return learning.groupBy(*_CORRECTION_KEYS).agg(F.sum(sign).cast("bigint").alias("n"))


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """The state of both; cells without rows are left out."""
    keys = [c for c in a.columns if c in (*_VERDICT_KEYS, *_CORRECTION_KEYS)]
    sums = [F.sum(c).cast(a.schema[c].dataType).alias(c) for c in a.columns if c not in keys]
    return a.unionByName(b).groupBy(*keys).agg(*sums).where(F.col("n") != 0)


def signed_changes(table: SnapshotTable, old: int, new: int) -> DataFrame:
    """Rows of ``old`` with ``_sign`` -1 and of ``new`` with 1, of buckets that differ; others cancel out unread."""
    some = table.differing(old, new)
    before, after = (table.rows_of(v, some) for v in (old, new))
    return before.withColumn(SIGN, F.lit(-1)).unionByName(after.withColumn(SIGN, F.lit(1)), allowMissingColumns=True)


def follow(state: SnapshotTable, source: SnapshotTable, cells) -> DataFrame:
    """Bring ``state`` up to the latest version of ``source`` and return it.

    ``cells`` makes a state of rows. The state's history tells through which version it went, so a
    call that is repeated changes nothing.
    """
    marks = state.history().where(F.col("operation").startswith("MERGE "))
    done = marks.agg(F.max(F.substring("operation", 7, 20).cast("bigint"))).first()[0]
    last = source.latest()
    if last is None or done == last:
        return state.read()
    if done is None:
        now = cells(source.read())
    else:
        now = merged(state.read(), cells(signed_changes(source, done, last)))
    # few rows: a cell a class and level
    state.overwrite(stage(now).coalesce(1), f"MERGE {last}")
    return state.read()


# --- figures ------------------------------------------------------------------

def class_distribution(cells: DataFrame) -> DataFrame:
    return cells.groupBy("classification").agg(
        F.sum("n").alias("total_documents"),
        F.round((F.sum("confidence") / F.sum("known")).cast("double"), 4).alias("avg_confidence"),
        F.sum("review").alias("review_needed"), F.sum("unsafe").alias("unsafe_count"),
    )


def confidence_levels(cells: DataFrame) -> DataFrame:
    return cells.groupBy("classification", "confidence_level").agg(F.sum("n").alias("count"))


def correction_matrix(cells: DataFrame) -> DataFrame:
    return cells.select(*_CORRECTION_KEYS, F.col("n").alias("correction_count"))


def kpis(cells: DataFrame) -> DataFrame:
    """The four figures in long form, with the time of the run."""
    total = F.coalesce(F.sum("n"), F.lit(0))

    def rate(n: Column) -> Column:
        return F.when(total > 0, n / total).otherwise(F.lit(0.0))

    one = cells.agg(
        total.cast("double").alias("total_documents"),
        F.coalesce((F.sum("confidence") / F.sum("known")).cast("double"), F.lit(0.0)).alias("avg_confidence"),
        rate(F.sum(F.when(F.col("high"), F.col("n")).otherwise(0))).alias("high_confidence_rate"),
        rate(F.sum("review")).alias("review_rate"),
    )
    return one.unpivot([], one.columns, "metric", "value").withColumn("timestamp", F.current_timestamp())
