"""Verdicts checked against expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def check_expectations(verdicts: DataFrame, expectations: DataFrame, key: str = "document_id") -> DataFrame:
    """One row per expectation with ``status, checks, failures, warnings``.

    Expectations carry ``test_id, expected_classes, is_safe, min_confidence,
    need_evidence, need_pages, terms`` (any must occur in the quotes),
    ``need_flags``. Class, safety and evidence fail; the rest warns. Expectations
    without a verdict are skipped.
    """
    e = expectations.select(key, *[
        F.col(c).alias(f"e_{c}") for c in (
            "test_id", "expected_classes", "is_safe", "min_confidence", "need_evidence",
            "need_pages", "terms", "need_flags")])
    v = verdicts.select(
        key, "classification", "confidence", F.col("safety_check.is_safe").alias("safe"),
        F.size("safety_check.flags").alias("flags"), F.size("evidence").alias("n_evidence"),
        F.exists("evidence", lambda x: F.coalesce(x["page"], F.lit(0)) > 0).alias("cites"),
        F.lower(F.array_join(F.transform("evidence", lambda x: x["quote"]), " ")).alias("quotes"),
        "page_count", F.lit(True).alias("found"))
    df = e.join(v, key, "left")

    def when(asked: Column, ok: Column, level: str, good: Column, bad: Column) -> Column:
        return F.when(asked, F.when(ok, F.struct(F.lit("check").alias("level"), good.alias("text")))
                      .otherwise(F.struct(F.lit(level).alias("level"), bad.alias("text"))))

    always = F.lit(True)
    classes = F.array_join("e_expected_classes", ", ")
    evidence = F.coalesce("e_need_evidence", F.lit(False))
    terms = F.coalesce(F.col("e_terms"), F.array().cast("array<string>"))
    wanted_safe = F.coalesce("e_is_safe", F.lit(True))
    floor = F.coalesce("e_min_confidence", F.lit(0.7))
    results = F.array_compact(F.array(
        when(always, F.array_contains("e_expected_classes", F.col("classification")), "failure",
             F.concat(F.lit("Classification matches: "), "classification"),
             F.concat(F.lit("Classification '"), "classification", F.lit("' not in expected "), classes)),
        when(always, F.col("confidence") >= floor, "warning",
             F.format_string("Confidence %.2f meets threshold", "confidence"),
             F.format_string("Confidence %.2f below threshold %s", F.col("confidence"), floor.cast("string"))),
        when(always, F.col("safe") == wanted_safe, "failure",
             F.concat(F.lit("Safety check: "), F.when(wanted_safe, "Safe").otherwise("Unsafe")),
             F.concat(F.lit("Expected is_safe="), wanted_safe.cast("string"), F.lit(", got "),
                      F.col("safe").cast("string"))),
        when(evidence, F.col("n_evidence") > 0, "failure",
             F.format_string("Evidence provided: %d items", "n_evidence"), F.lit("No evidence provided")),
        when(evidence & F.coalesce("e_need_pages", F.lit(False)), F.col("cites"), "warning",
             F.lit("Evidence includes page citations"),
             F.lit("Evidence does not cite specific pages")),
        when(F.size(terms) > 0, F.exists(terms, lambda t: F.col("quotes").contains(t)), "warning",
             F.lit("Evidence mentions expected terms"),
             F.lit("Evidence does not mention expected terms")),
        when(F.coalesce("e_need_flags", F.lit(False)), F.col("flags") > 1, "warning",
             F.lit("Multiple safety flags"), F.format_string("Only %d safety flag(s)", "flags")),
        F.when(F.col("page_count") == 0, F.struct(
            F.lit("warning").alias("level"),
            F.lit("Page count is 0 - document may not have been processed correctly").alias("text"))),
    ))
    checked = df.withColumn("_r", F.when(F.col("found"), results))

    def texts(level: str) -> Column:
        return F.coalesce(
            F.transform(F.filter("_r", lambda r: r["level"] == level), lambda r: r["text"]),
            F.array().cast("array<string>"))

    out = checked.select(
        F.col("e_test_id").alias("test_id"), key, "found", texts("check").alias("checks"),
        texts("failure").alias("failures"), texts("warning").alias("warnings"))
    return out.withColumn(
        "status", F.when(F.col("found").isNull(), "SKIP").when(F.size("failures") == 0, "PASS")
        .otherwise("FAIL")).drop("found")


def summary(checked: DataFrame) -> DataFrame:
    """Totals per status and the share that passed."""
    def n(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    return checked.agg(
        F.count(F.lit(1)).alias("total"), n("PASS").alias("passed"), n("FAIL").alias("failed"),
        n("SKIP").alias("skipped"),
        F.format_string("%.1f%%", n("PASS") / F.count(F.lit(1)) * 100).alias("success_rate"))
