"""Bronze, silver and gold tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from sealgrade.operators import dashboard as D, feedback as FB, mining as K, patterns as P, rollup as RU, verdicts as M
from sealgrade.session import stage
from sealgrade.sources import files
from sealgrade.sources.tables import SnapshotTable


GOLD = ("classification_distribution", "confidence_analysis", "learning_effectiveness", "kpis", "misclassifications")


@dataclass(frozen=True)
class Lakehouse:
    """``buckets`` keeps the rows of bronze tables apart by a hash of their document, so that ``refresh_gold`` reads
    only what changed."""

    spark: SparkSession
    root: str
    buckets: int | None = None

    def table(self, layer: str, name: str) -> SnapshotTable:
        buckets = self.buckets if layer == "bronze" else None
        return SnapshotTable(self.spark, f"{self.root}/{layer}/{name}", buckets=buckets)

    def bronze(self, verdicts: DataFrame | None = None, learning: DataFrame | None = None) -> None:
        """Write the tables that are given."""
        for name, df in (("classifications", verdicts), ("learning_database", learning)):
            if df is not None:
                self.table("bronze", name).overwrite(df)

    def ingest(self, results: str, sample: bool = False) -> None:
        """Bronze tables from a folder of verdict files and its learning database."""
        self.bronze(
            files.or_sample(files.read_verdicts(self.spark, results), sample),
            files.read_learning(self.spark, f"{results}/{files.LEARNING_FILE}"),
        )

    def silver(self, tables: Sequence[str] = ("segments", "evidence", "learning_feedback")) -> None:
        """Child tables of segments and evidence, and time stamps as times; all or those named.

        Two tables, since exploding both arrays at once would give their product.
        """
        make = {
            "segments": lambda: M.segment_rows(self.table("bronze", "classifications").read()),
            "evidence": lambda: M.evidence_rows(self.table("bronze", "classifications").read()),
            "learning_feedback": lambda: self.table("bronze", "learning_database").read().withColumn(
                "reviewed_at", F.to_timestamp("timestamp")),
        }
        for name in tables:
            self.table("silver", name).overwrite(make[name]())

    def mine(self, only_corrected: bool = True, **options) -> DataFrame:
        """k-means over corrected documents; writes assignments and examples."""
        verdicts = self.table("bronze", "classifications").read()
        learning = self.table("bronze", "learning_database").read()
        features = K.with_review_flag(K.join_corrections(
            K.error_features(verdicts), K.corrected(learning), only_corrected))
        _, clustered = K.cluster(stage(features), **options)
        assigned = clustered.select(
            "document_id", "classification", "confidence", "segment_count", "is_unsafe", "cluster")
        self.table("silver", "cluster_assignments").overwrite(assigned)
        stored = self.table("silver", "cluster_assignments").read()
        self.table("silver", "training_examples").overwrite(K.training_examples(stored))
        self.table("gold", "top_patterns").overwrite(
            K.top_patterns(K.class_patterns(stored), order=("classification", "cluster")))
        return stored

    def gold(self, tables: Sequence[str] = GOLD) -> None:
        """The gold tables, all or those named, from a full pass over bronze."""
        verdicts = D.flat(self.table("bronze", "classifications").read())
        learning = self.table("bronze", "learning_database").read()
        make = {
            "classification_distribution": lambda: D.class_distribution(verdicts),
            "confidence_analysis": lambda: D.confidence_levels(verdicts),
            "learning_effectiveness": lambda: D.correction_matrix(learning),
            "kpis": lambda: D.kpis(verdicts),
            "misclassifications": lambda: P.misclassifications(stage(FB.normalize_feedback(learning))),
        }
        for name in tables:
            self.table("gold", name).overwrite(make[name]())

    def refresh_gold(self, tables: Sequence[str] = GOLD[:4]) -> None:
        """Bring the gold tables that are sums, all or those named, up to date from the changes since the last time.

        Their states are tables of a cell a class and level (``operators.rollup``). A call that is repeated, or that
        failed half-way and is made again, gives the same tables.
        """
        sources = {
            "verdicts": ("classifications", lambda v: RU.verdict_cells(D.flat(v))), "reviews": ("learning_database", RU.correction_cells),
        }
        make = {
            "classification_distribution": ("verdicts", RU.class_distribution), "confidence_analysis": ("verdicts", RU.confidence_levels),
            "learning_effectiveness": ("reviews", RU.correction_matrix), "kpis": ("verdicts", RU.kpis),
        }
        states = {}
        for name in tables:
            of, figures = make[name]
            if of not in states:
                bronze, cells = sources[of]
                states[of] = RU.follow(self.table("state", of), self.table("bronze", bronze), cells)
            self.table("gold", name).overwrite(figures(states[of]))
