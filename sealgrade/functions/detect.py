"""Feature detection: keyword counts, personal-data patterns, flags, score."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, functions as F

from sealgrade import vocab as V


def keyword_count(lowered: Column, keywords: Iterable[str]) -> Column:
    """How many of ``keywords`` occur in already lower-cased text, each once."""
    return reduce(lambda a, b: a + b, [lowered.contains(k).cast("int") for k in keywords])


def any_keyword(lowered: Column, keywords: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [lowered.contains(k) for k in keywords])


def pii_test(text: Column, name: str, pattern: str) -> Column:
    """Does ``pattern`` match? For the built-in patterns a cheap test that every
    match passes goes first, so most texts never meet the full expression."""
    full = text.rlike(f"(?i){pattern}")
    if V.PII_PATTERNS.get(name) != pattern:
        return full
    if name == "email":
        return text.contains(V.EMAIL_GUARD) & full
    return text.rlike(V.DIGIT_GUARD) & full


def pii_flags(text: Column, patterns: Mapping[str, str] = V.PII_PATTERNS) -> dict[str, Column]:
    return {name: pii_test(text, name, rx) for name, rx in patterns.items()}


def has_pii(text: Column, patterns: Mapping[str, str] = V.PII_PATTERNS) -> Column:
    """Any pattern; the generated OR stops at the first hit."""
    return reduce(lambda a, b: a | b, pii_flags(text, patterns).values())


def pii_matches(text: Column, name: str, pattern: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(f"(?i){pattern}"), F.lit(0))
    return F.when(pii_test(text, name, pattern), found).otherwise(F.array().cast("array<string>"))


def analysis_plan(
    pii: Column, defense: Column, government: Column, marketing: Column, technical: Column,
    multi_label: Column, image_count: Column,
) -> Column:
    """Ordered analysis steps a scorer is asked to run."""

    def when(flag: Column, step: str) -> Column:
        return F.when(flag, F.lit(step))

    return F.array_compact(F.array(
        F.lit("pre_classification_analysis"),
        F.lit("quick_safety_check"),
        when(pii, "pii_detection"),
        when(pii, "pii_sensitivity_assessment"),
        when(defense, "proprietary_detection"),
        when(defense, "keyword_relevance_scoring"),
        when(defense & technical, "technical_specification_analysis"),
        when(government, "document_context_classification"),
        when(government, "government_source_verification"),
        when(marketing, "marketing_content_analysis"),
        when(image_count > V.MANY_IMAGES, "visual_content_analysis"),
        F.lit("classification_decision"),
        F.lit("evidence_extraction"),
        when(multi_label, "multi_label_detection"),
        F.lit("confidence_assessment"),
    ))


def insight(flags: Mapping[str, Column], document_type: Column, score: Column) -> Column:
    """Names of the true flags, the score, and whether review is advised."""
    return F.struct(
        document_type.alias("document_type"),
        F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()]))
        .alias("detected_features"),
        score.alias("sensitivity_score"),
        (score >= V.RECOMMEND_REVIEW_AT).alias("recommended_review"),
    )
