"""Feature rules with the built-in vocabulary."""

import pytest
from pyspark.sql import functions as F

from sealgrade import vocab as V
from sealgrade.functions import detect as D
from sealgrade.operators import features as FT

DEFENSE = "classified stealth fighter blueprint specification"
MARKETING = "promote the product launch"


def run(rows, name, preview, images=0):
    return FT.detect_features(
        rows([(name, preview, images)], "filename string, preview string, image_count int")).first()


def test_form_with_personal_data(rows):
    r = run(rows, "Application.pdf", "mail me: a.b@example.org")
    assert r["has_pii_indicators"] and r["sensitivity_score"] == 30.0
    assert r["document_type"] == "form_with_pii"
    assert r["analysis_plan"][2:4] == ["pii_detection", "pii_sensitivity_assessment"]


def test_filename_hint_alone_has_no_score(rows):
    r = run(rows, "personal.txt", None)
    assert r["has_pii_indicators"] and r["sensitivity_score"] == 0.0
    assert not r["potential_multi_label"] and r["document_type"] == "unknown"
    assert len(r["analysis_plan"]) == 7


def test_technical_defense_with_marketing(rows):
    r = run(rows, "x.pdf", f"{DEFENSE} {MARKETING}", images=6)
    assert r["defense_count"] == 5 and r["marketing_count"] == 3 and r["technical_count"] == 2
    assert r["sensitivity_score"] == 40 - 10 + 25
    assert r["potential_multi_label"] and r["document_type"] == "marketing"
    assert "visual_content_analysis" in r["analysis_plan"]
    assert r["analysis_plan"][-2:] == ["multi_label_detection", "confidence_assessment"]
    assert r["insight"]["recommended_review"]
    assert r["insight"]["detected_features"] == [
        "has_defense_keywords", "has_marketing_indicators", "has_technical_content",
        "potential_multi_label"]


def test_government_and_memo(rows):
    assert run(rows, "a.pdf", "The Federal office")["document_type"] == "government"
    assert run(rows, "Internal note.pdf", "hello")["document_type"] == "internal_memo"


@pytest.mark.parametrize("name, text, hit", [
    ("ssn", "id 123-45-6789.", True), ("ssn", "123456789", True), ("ssn", "12-34", False),
    ("phone", "555-123-4567", True), ("phone", "(999) 555-0010", False),
    ("email", "x a.b@c.org y", True), ("credit_card", "4111 1111 1111 1111", True),
    ("date_of_birth", "12/31/1999", True), ("date_of_birth", "13/13/1999", False),
    ("account_number", "acct: 123456", True), ("passport", "us1234567", True),
    ("license", "d12345", True), ("license", "nothing", False),
])
def test_pii_patterns(spark, rows, name, text, hit):
    df = rows([(text,)], "t string")
    assert df.select(D.pii_flags(F.col("t"))[name]).first()[0] is hit


def test_guards_change_nothing(spark, sf_dir):
    """The cheap test in front of a pattern never loses a match."""
    t = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    for name, rx in V.PII_PATTERNS.items():
        plain = t.where(F.col("text").rlike(f"(?i){rx}")).count()
        assert t.where(D.pii_test(F.col("text"), name, rx)).count() == plain


def test_fixed_phone_pattern(spark, rows):
    df = rows([("call (999) 555-0010",)], "t string")
    fixed = D.pii_test(F.col("t"), "phone", V.PHONE_FIXED)
    assert df.select(fixed).first()[0]


def test_scaled_features_are_computed_once(spark):
    from sealgrade.operators import mining as M
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def costly(i):
        seen.add(1)
        return float(i)

    df = spark.range(20).select(F.col("id").alias("document_id"), *[costly(F.col("id") * (n + 1)).alias(c) for n, c in enumerate(M.CLUSTER_COLUMNS)])
    got = M.scaled_features(df).collect()
    assert seen.value == 20 * len(M.CLUSTER_COLUMNS)
    assert all(abs(sum(r[c] for r in got)) < 1e-9 for c in M.CLUSTER_COLUMNS)
