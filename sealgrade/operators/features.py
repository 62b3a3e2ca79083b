"""Document features: personal data, keyword families, score, type, plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from sealgrade import vocab as V
from sealgrade.functions import detect as D


@dataclass(frozen=True)
class Vocabulary:
    """Word lists and patterns; every list can be replaced."""

    filename_pii: Sequence[str] = V.FILENAME_PII_HINTS
    filename_memo: Sequence[str] = V.FILENAME_MEMO_HINTS
    form: Sequence[str] = V.FORM_INDICATORS
    defense: Sequence[str] = V.DEFENSE_KEYWORDS
    government: Sequence[str] = V.GOVERNMENT_MARKERS
    marketing: Sequence[str] = V.MARKETING_TERMS
    technical: Sequence[str] = V.TECHNICAL_TERMS
    pii_patterns: Mapping[str, str] = field(default_factory=lambda: dict(V.PII_PATTERNS))


def detect_features(
    df: DataFrame, filename: str = "filename", preview: str = "preview",
    image_count: str = "image_count", vocabulary: Vocabulary = Vocabulary(),
) -> DataFrame:
    """Add counts, flags, ``sensitivity_score``, ``document_type``,
    ``analysis_plan`` and ``insight``.

    Without a preview only the file name speaks. Everything is one chain of
    projections over the row: no shuffle.
    """
    v = vocabulary
    name, low, body = F.col("_name"), F.col("_low"), F.col(preview)
    seen = F.length(F.coalesce(body, F.lit(""))) > 0
    counted = (
        df.withColumn("_name", F.lower(filename))
        .withColumn("_low", F.lower(F.coalesce(body, F.lit(""))))
        .withColumns({
            "filename_pii": D.any_keyword(name, v.filename_pii),
            "pii_data": F.coalesce(D.has_pii(body, v.pii_patterns), F.lit(False)),
            "form_count": D.keyword_count(low, v.form),
            "defense_count": D.keyword_count(low, v.defense),
            "government_count": D.keyword_count(low, v.government),
            "marketing_count": D.keyword_count(low, v.marketing),
            "technical_count": D.keyword_count(low, v.technical),
        })
    )
    content_pii = F.col("pii_data") | (F.col("form_count") >= V.MIN_FORM)
    flagged = counted.withColumns({
        "_content_pii": content_pii,
        "has_pii_indicators": F.col("filename_pii") | content_pii,
        "has_defense_keywords": F.col("defense_count") >= V.MIN_DEFENSE,
        "has_government_markers": F.col("government_count") >= V.MIN_GOVERNMENT,
        "has_marketing_indicators": F.col("marketing_count") >= V.MIN_MARKETING,
        "has_technical_content": F.col("technical_count") >= V.MIN_TECHNICAL,
    })
    pii, defense = F.col("has_pii_indicators"), F.col("has_defense_keywords")
    government, marketing = F.col("has_government_markers"), F.col("has_marketing_indicators")
    technical = F.col("has_technical_content")

    def weight(flag, points):
        return F.when(flag, F.lit(points)).otherwise(F.lit(0.0))

    scored = flagged.withColumns({
        "potential_multi_label": seen & ((defense & marketing) | (pii & (defense | government))),
        "sensitivity_score": weight(F.col("_content_pii"), V.WEIGHT_PII)
        + weight(defense, V.WEIGHT_DEFENSE) + weight(government, V.WEIGHT_GOVERNMENT)
        + weight(marketing, V.WEIGHT_MARKETING) + weight(technical, V.WEIGHT_TECHNICAL),
        "document_type": F.when(marketing & ~pii, F.lit("marketing"))
        .when(pii & name.contains("application"), F.lit("form_with_pii"))
        .when(defense & technical, F.lit("technical_defense"))
        .when(government, F.lit("government"))
        .when(D.any_keyword(name, v.filename_memo), F.lit("internal_memo"))
        .otherwise(F.lit("unknown")),
    })
    multi = F.col("potential_multi_label")
    flags = {
        "has_pii_indicators": pii, "has_defense_keywords": defense,
        "has_government_markers": government, "has_marketing_indicators": marketing,
        "has_technical_content": technical, "potential_multi_label": multi,
    }
    return scored.withColumns({
        "analysis_plan": D.analysis_plan(
            pii, defense, government, marketing, technical, multi, F.col(image_count)
        ),
        "insight": D.insight(flags, F.col("document_type"), F.col("sensitivity_score")),
    }).drop("_name", "_low", "_content_pii")


def pii_report(
    df: DataFrame, keys: Sequence[str] = ("document_id",), text: str = "text",
    patterns: Mapping[str, str] = V.PII_PATTERNS,
) -> DataFrame:
    """One boolean per pattern and ``has_pii``, over the whole text."""
    flags = D.pii_flags(F.col(text), patterns)
    report = df.select(*keys, *[c.alias(n) for n, c in flags.items()])
    any_hit = F.greatest(*[F.col(n) for n in flags]) if len(flags) > 1 else F.col(next(iter(flags)))
    return report.withColumn("has_pii", any_hit)


def pii_values(
    df: DataFrame, keys: Sequence[str] = ("document_id",), text: str = "text",
    patterns: Mapping[str, str] = V.PII_PATTERNS,
) -> DataFrame:
    """One row per matched value, with the pattern's name."""
    def named(pattern: str):
        return lambda m: F.struct(F.lit(pattern).alias("pattern"), m.alias("value"))

    found = F.flatten(F.array(*[
        F.transform(D.pii_matches(F.col(text), n, rx), named(n)) for n, rx in patterns.items()
    ]))
    return df.select(*keys, F.inline(found))
