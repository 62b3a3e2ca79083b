"""Plans: no Python workers, no products, no window or group over everything."""

import re

import pytest
from pyspark.sql import functions as F

from sealgrade.catalog import REGISTRY
from sealgrade.operators import patterns as P

BATCH = [n for n in REGISTRY if not n.startswith(("s", "w0", "a03", "a04", "a05", "k01", "r01", "c08"))]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_batch_plans(spark, sf_dir, name):
    plan = plan_of(REGISTRY[name][0](spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    # a window without partition key gathers all rows in one task
    for line in plan.splitlines():
        if re.search(r"\bWindow \[", line):
            assert not re.search(r"windowspecdefinition\((\w+#\d+ (ASC|DESC))", line), line


@pytest.mark.parametrize("name", ["r02_learned_examples", "j02_union_feedback", "j04_apply_feedback"])
def test_rankings_are_limited_before_the_shuffle(spark, sf_dir, name):
    assert "WindowGroupLimit" in plan_of(REGISTRY[name][0](spark, sf_dir))


def test_a_bounded_ranking_of_words_is_limited_before_the_shuffle(rows):
    n = rows([("Public", "Unsafe", 1, "word")], "original_classification string, human_classification string, seq bigint, reasoning string")
    assert "WindowGroupLimit" in plan_of(P.common_words(n, top=10))


def test_scans_read_only_what_is_used(spark, sf_dir):
    plan = plan_of(REGISTRY["a16_panel"][0](spark, sf_dir))
    scan = next(l for l in plan.splitlines() if "FileScan parquet" in l and "documents" in l)
    assert "lang" not in scan.split("ReadSchema:")[1]
    assert "PushedFilters" in scan


def test_fetch_pushes_its_filter(spark, sf_dir):
    plan = plan_of(REGISTRY["s18_fetch_verdict"][0](spark, sf_dir))
    assert "EqualTo(doc_id,7)" in plan


def test_recent_is_a_top_k(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan_of(REGISTRY["r04_recent_learning"][0](spark, sf_dir))


def test_one_document_with_most_rows(spark, rows):
    """A hot key: thousands of reviews of one document leave one row per document."""
    from sealgrade.operators import feedback as FB
    hot = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "d1").otherwise(F.concat(F.lit("x"), F.col("id"))).alias("document_id"),
        F.col("id").alias("seq"), F.lit("r").alias("reviewer_id"), F.lit(False).alias("approved"),
        F.lit("Unsafe").alias("corrected_classification"), F.lit("t").alias("timestamp"))
    verdicts = rows([("d1", "Public", True)], "document_id string, classification string, requires_review boolean")
    out = FB.apply_feedback(verdicts, hot)
    assert out.count() == 1 and out.first()["original_classification"] == "Unsafe"
    assert FB.latest_per_document(hot).where("document_id = 'd1'").first()["seq"] == 4998


@pytest.mark.parametrize("name", ["a01_error_features", "t05_sheet_pages", "preset_enhanced"])
def test_entry_queries_run(spark, sf_dir, name):
    import __spark_entry__ as entry
    assert entry.queries()[name](spark, sf_dir).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() > 0
