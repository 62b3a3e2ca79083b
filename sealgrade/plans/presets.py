"""From model answers to verdicts: the two ways documents are classified.

``documents`` needs ``document_id, filename, pages, full_text, page_count,
image_count``; ``responses`` is the answer table of ``operators.verdicts``. Both
presets are one lazy plan with one shuffle of the answers by document and one
join; all else is projection, apart from learned rules beyond the checked size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from sealgrade import vocab as V
from sealgrade.functions import repair as R
from sealgrade.operators import feedback as FB, learned as L, patterns as P, verdicts as M
from sealgrade.session import stage


@dataclass(frozen=True)
class Learned:
    """What feedback taught; build once per run with ``learn``."""

    feedback: DataFrame
    accuracy: DataFrame
    keyword_rules: DataFrame
    patterns: DataFrame


def learn(feedback: DataFrame) -> Learned:
    """Patterns of all feedback, which is stored once: four aggregates read it."""
    normalized = stage(FB.normalize_feedback(feedback))
    return Learned(
        feedback, P.accuracy_by_class(normalized), P.keyword_patterns(normalized),
        P.context_patterns(normalized),
    )


def basic(
    documents: DataFrame, responses: DataFrame, learned: Learned | None = None,
    dual: bool = False, auto_approve_at: float | None = V.AUTO_APPROVE_AT,
) -> DataFrame:
    """The batch route: learned confidence adjustment, optional second opinion,
    labels with unsafe override, review need, auto-approval."""
    roles = ("primary", "secondary") if dual else ("primary",)
    answers = M.responses_by_role(responses, roles, images=False)
    joined = documents.join(answers, "document_id", "left")
    read = M.read_verdicts(joined, "primary", "primary_verdict", "primary_status")
    v = F.col("primary_verdict")
    df = read.withColumns({
        "classification": v["classification"], "confidence": v["confidence"],
        "summary": v["summary"], "reasoning": v["reasoning"], "evidence": v["evidence"],
        "safety_check": v["safety_assessment"], "is_safe": v["safety_assessment"]["is_safe"],
        "safety_confidence": v["safety_assessment"]["confidence"],
        "additional_labels": v["additional_labels"],
        "learned_review": F.lit(False), "learned_reason": F.lit(None).cast("string"),
    })
    if learned is not None:
        df = L.adjust_confidence(
            df, learned.accuracy, learned.keyword_rules, learned.patterns, preview="full_text"
        ).withColumn("confidence", F.col("adjusted_confidence")).drop("adjusted_confidence")
    if dual:
        df = M.read_verdicts(df, "secondary", "secondary_verdict", "secondary_status")
        df = df.withColumn("secondary_classification", F.col("secondary_verdict.classification")).withColumn(
            "secondary_confidence", F.col("secondary_verdict.confidence")
        ).withColumn("consensus", F.col("classification") == F.col("secondary_classification"))
    else:
        none = F.lit(None)
        df = df.withColumns({
            "secondary_classification": none.cast("string"),
            "secondary_confidence": none.cast("double"), "consensus": none.cast("boolean")})
    df = df.withColumn("_reason", R.review_basic(
        F.col("classification"), F.col("confidence"), F.col("is_safe"),
        F.col("secondary_classification"), F.col("consensus")))
    # a learned reason is appended to the own one
    df = df.withColumn("requires_review", F.col("_reason").isNotNull() | F.col("learned_review"))
    df = df.withColumn("review_reason", F.when(
        F.col("learned_review"), F.concat_ws("; ", "_reason", "learned_reason")
    ).otherwise(F.col("_reason")))
    df = M.label_verdicts(df)
    if auto_approve_at is not None:
        df = M.auto_approve(df, auto_approve_at)
    return df.select(
        "document_id", "filename", "classification", "secondary_labels", "additional_labels",
        "label_confidence", "confidence", "summary", "reasoning", "evidence", "safety_check",
        "page_count", "image_count", "secondary_classification", "secondary_confidence",
        "consensus", "requires_review", "review_reason", "primary_status",
    )


def enhanced(
    documents: DataFrame, responses: DataFrame, learned: Learned | None = None,
    unsafe_override: bool = True,
) -> DataFrame:
    """The single-document route: pre-scan, segments, images, context, keywords,
    verification, learned override, review need.

    ``unsafe_override`` makes unsafe verdicts class Unsafe here too; without it
    only the pre-scan does.
    """
    df = documents.join(M.responses_by_role(responses), "document_id", "left")
    df = M.with_quick_safety(df)
    common = [
        "document_id", "filename", "classification", "additional_labels", "confidence", "summary",
        "reasoning", "evidence", "safety_check", "page_count", "image_count", "full_text",
        "requires_review", "review_reason",
    ]
    early = M.quick_exit_verdict(df, text_chars=None, quote_chars=None).select(*common)
    df = df.where(F.col("quick").isNull())
    df = M.with_keyword_relevance(M.with_context(M.with_images(M.with_segments(df))))
    df = M.read_verdicts(df, "primary", "primary_verdict", "primary_status")
    df = M.read_verdicts(df, "secondary", "secondary_verdict", "secondary_status")
    df = M.route_verification(df)
    v = F.col("primary_verdict")
    df = df.withColumns({
        "evidence": v["evidence"], "summary": v["summary"], "reasoning": v["reasoning"],
        "additional_labels": v["additional_labels"], "safety_check": v["safety_assessment"],
        "classification": F.col("final_classification"), "confidence": F.col("final_confidence"),
    })
    df = M.with_all_keywords(df)
    safe = F.col("safety_check.is_safe")
    df = df.withColumn("review_reason", R.review_enhanced(
        v["classification"], v["confidence"], safe, F.col("secondary_classification"),
        F.col("consensus"), F.col("text_segments"), F.col("image_analyses"),
    )).withColumn("requires_review", F.col("review_reason").isNotNull())
    columns = [
        *common, "text_segments", "image_analyses", "all_keywords", "secondary_classification",
        "secondary_confidence", "consensus", "verification_notes", "document_context",
        "keyword_relevances", "primary_status",
    ]
    if learned is not None:
        # rules of more than a round write the rows, so answers and pages that are not read again stay behind
        df = L.apply_override(df.select(*columns), learned.feedback, preview="full_text")
        note = F.concat(F.lit("🎓 LEARNED RULE APPLIED: "), F.col("override_reason"))
        df = df.withColumns({
            "classification": F.col("learned_classification"),
            "confidence": F.col("learned_confidence"),
            "verification_notes": F.when(
                F.col("was_overridden"), F.concat_ws("\n\n", "verification_notes", note)
            ).otherwise(F.col("verification_notes")),
        })
    if unsafe_override:
        df = df.withColumn(
            "additional_labels",
            R.unsafe_labels(F.col("additional_labels"), F.col("classification"), safe),
        ).withColumn(
            "confidence",
            F.when(safe, F.col("confidence")).otherwise(F.col("safety_check.confidence")),
        ).withColumn("classification", F.when(safe, F.col("classification")).otherwise(F.lit("Unsafe")))
    full = df.select(*columns)
    return full.unionByName(early, allowMissingColumns=True)
