"""Verdict parsing, repair, routing, review needs, batch status.

Model answers arrive as ``responses(document_id, role, item, response_text)``;
no operator here calls a model. Parsed values are added as columns step by step,
so that each answer is parsed once however often its fields are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, StructType

from sealgrade import schemas as S, vocab as V
from sealgrade.functions import repair as R, text as T

ROLES = (
    "primary", "secondary", "verification", "quick_safety", "segments", "context",
    "keyword_relevance",
)


def responses_by_role(responses: DataFrame, roles: Sequence[str] = ROLES, images: bool = True) -> DataFrame:
    """One row per document with a column per role and ``images``, its image answers with their items.

    Plain conditional aggregation: one shuffle, combined before it. Only a document's own
    image answers are gathered, one an item, in the order of the items; a missing one takes no place.
    """
    columns = [F.max(F.when(F.col("role") == r, F.col("response_text"))).alias(r) for r in roles]
    if images:
        own = F.when((F.col("role") == "images") & (F.col("item") >= 0), F.struct("item", "response_text"))
        columns.append(F.collect_list(own).alias("_images"))
    out = responses.groupBy("document_id").agg(*columns)
    if not images:
        return out
    # an item that was answered twice keeps the last of its texts
    answers = out.withColumn("_images", F.array_sort("_images"))
    later = F.col("_images")
    last = F.filter(later, lambda x, i: (i + 1 == F.size(later)) | (F.get(later, i + 1)["item"] != x["item"]))
    return answers.withColumn("images", last).drop("_images")


def read_verdicts(
    df: DataFrame, response: str = "response_text", into: str = "verdict",
    status: str = "parse_status", fixed_flags: bool = False,
) -> DataFrame:
    """Add the repaired verdict of a raw answer and how its parsing went.

    An answer that cannot be read becomes the fallback verdict, never null.
    """
    raw, flags = F.col("_raw"), F.col("_raw.safety_assessment.flags")
    parsed = (
        df.withColumn("_json", R.json_object_text(F.col(response)))
        .withColumn("_raw", R.parse_object(F.col("_json"), S.MODEL_VERDICT))
        .withColumn(status, R.parse_status(F.col("_json"), raw))
        .withColumn("_flags", F.when(flags.isNotNull(), R.normalize_flags(flags, fixed_flags)))
    )
    reason = F.concat(
        F.lit("Failed to parse classification response: "), F.col(status),
        F.lit("\nResponse: "), F.coalesce(F.col(response), F.lit("")),
    )
    return parsed.withColumn(
        into,
        F.when(F.col(status) == "ok", R.repaired_verdict(raw, F.col("_flags")))
        .otherwise(R.fallback_verdict(reason)),
    ).drop("_json", "_raw", "_flags")


def route_verification(
    df: DataFrame, primary: str = "primary_verdict", secondary: str = "secondary_verdict",
    verification: str = "verification", skip_above: float = V.SKIP_VERIFICATION_ABOVE,
) -> DataFrame:
    """Decide between primary, secondary and verifier.

    Very confident primaries skip verification. Agreement keeps the primary. On
    disagreement the verifier decides; without an answer from it the primary
    stands, and an unreadable one gives the most sensitive class at the lower
    confidence.
    """
    p_class, p_conf = F.col(f"{primary}.classification"), F.col(f"{primary}.confidence")
    s_class, s_conf = F.col(f"{secondary}.classification"), F.col(f"{secondary}.confidence")
    answer = F.col("_answer")
    usable = answer["final_classification"].isNotNull() & answer["final_confidence"].isNotNull()
    skip = p_conf > skip_above
    agree = p_class == s_class
    blocked = F.col(verification).isNull()

    def choose(skipped, agreed, no_answer, answered, conservative):
        return (
            F.when(skip, skipped).when(agree, agreed).when(blocked, no_answer)
            .when(usable, answered).otherwise(conservative)
        )

    none = F.lit(None).cast("string")
    return (
        df.withColumn(
            "_answer",
            R.parse_object(R.json_object_text(F.col(verification)), S.VERIFICATION),
        )
        .withColumns({
            "skipped_verification": skip,
            "secondary_classification": F.when(~skip, s_class),
            "secondary_confidence": F.when(~skip, s_conf),
            "consensus": F.when(~skip, agree),
            "final_classification": choose(
                p_class, p_class, p_class, answer["final_classification"],
                R.most_sensitive(p_class, s_class),
            ),
            "final_confidence": choose(
                p_conf, p_conf, p_conf, answer["final_confidence"], F.least(p_conf, s_conf)
            ),
            "verification_notes": choose(
                F.format_string(
                    "Skipped verification due to very high primary confidence (%.0f%%)", p_conf * 100
                ),
                none,
                F.lit("Verification agent blocked by safety filter, using primary classification"),
                answer["notes"],
                F.lit("Used conservative approach due to disagreement"),
            ),
        })
        .drop("_answer")
    )


def needs_verification(df: DataFrame, verdict: str = "primary_verdict") -> DataFrame:
    """The documents a second opinion has to be asked for."""
    return df.where(F.col(f"{verdict}.confidence") <= V.SKIP_VERIFICATION_ABOVE)


def with_quick_safety(df: DataFrame, response: str = "quick_safety") -> DataFrame:
    """Add ``quick``: the pre-scan's unsafe finding, or null."""
    return df.withColumn("quick", R.quick_unsafe(F.col(response)))


def quick_exit_verdict(
    df: DataFrame, quick: str = "quick", full_text: str = "full_text",
    text_chars: int | None = None, quote_chars: int | None = None,
) -> DataFrame:
    """Verdict columns of documents the pre-scan found unsafe. ``text_chars`` and
    ``quote_chars`` bound the text and the quote where a caller wants that."""
    q = F.col(quick)

    def head(text, chars: int | None):
        return text if chars is None else F.substring(text, 1, chars)

    flag = F.coalesce(q["quick_flag"], F.lit("None"))

    def either(name: str, default: str):
        return F.coalesce(q[name], F.lit(default))

    return df.where(q.isNotNull()).withColumns({
        "classification": F.lit("Unsafe"),
        "additional_labels": F.array(F.lit("Safety Violation")),
        "confidence": F.lit(V.QUICK_UNSAFE_CONFIDENCE),
        "summary": F.concat(
            F.lit("Document flagged as unsafe: "), either("quick_flag", "Safety violation")
        ),
        "reasoning": F.concat(
            F.lit("Quick safety scan detected: "), either("evidence", "Unsafe content"),
            F.lit(". Severity: "), either("severity", "High"),
        ),
        "evidence": F.array(F.struct(
            F.lit(None).cast("int").alias("page"),
            F.lit("Quick scan (first 2000 chars)").alias("region"),
            head(either("evidence", "Unsafe content detected"), quote_chars).alias("quote"),
            F.concat(F.lit("Flagged by quick safety check as "), flag).alias("reasoning"),
            F.lit(None).cast("int").alias("image_index"),
            F.lit(None).cast("string").alias("sensitivity_level"),
            F.array().cast("array<string>").alias("keywords"),
            F.lit(None).cast("int").alias("start_char"),
            F.lit(None).cast("int").alias("end_char"),
        )),
        "safety_check": F.struct(
            F.lit(False).alias("is_safe"),
            R.normalize_flags(F.array(either("quick_flag", "Violence"))).alias("flags"),
            F.concat(
                F.lit("Quick preliminary scan detected "), either("quick_flag", "unsafe content"),
                F.lit(". "), either("evidence", ""),
            ).alias("details"),
            F.lit(V.QUICK_UNSAFE_CONFIDENCE).alias("confidence"),
        ),
        full_text: head(F.col(full_text), text_chars),
        "requires_review": F.lit(True),
        "review_reason": F.concat(F.lit("Quick safety check flagged: "), flag),
    })


def with_segments(df: DataFrame, response: str = "segments", full_text: str = "full_text") -> DataFrame:
    """Add ``text_segments`` parsed and located, and their ``segment_rollup``."""
    located = T.locate_segments(F.col(full_text), F.col("_raw_segments"))
    return (
        df.withColumn("_raw_segments", R.parse_array(R.json_array_text(F.col(response)), S.RAW_SEGMENT))
        .withColumn("_located", located)
        .withColumn("text_segments", R.usable_segments(F.col("_located")))
        .withColumn("segment_rollup", R.segment_rollup(F.col("text_segments")))
        .drop("_raw_segments", "_located")
    )


def with_images(df: DataFrame, responses: str = "images") -> DataFrame:
    """Add ``image_analyses`` from texts in the order of the images, or from ``item, response_text`` as
    ``responses_by_role`` gives them."""
    numbered = isinstance(df.schema[responses].dataType.elementType, StructType)
    return df.withColumn("image_analyses", R.parse_images(F.col(responses), numbered=numbered))


def with_context(df: DataFrame, response: str = "context") -> DataFrame:
    return (
        df.withColumn("_json", R.json_object_text(F.col(response)))
        .withColumn("_raw", R.parse_object(F.col("_json"), S.CONTEXT))
        .withColumn("document_context", R.parse_context(F.col("_json"), F.col("_raw")))
        .drop("_json", "_raw")
    )


def with_keyword_relevance(df: DataFrame, response: str = "keyword_relevance") -> DataFrame:
    parsed = R.parse_array(R.json_array_text(F.col(response)), S.KEYWORD_RELEVANCE)
    return (
        df.withColumn("_raw", parsed)
        .withColumn("keyword_relevances", R.keyword_relevance(F.col("_raw")))
        .drop("_raw")
    )


def with_all_keywords(
    df: DataFrame, segments: str = "text_segments", images: str = "image_analyses",
    evidence: str = "evidence",
) -> DataFrame:
    def keywords(name):
        return F.transform(F.col(name), lambda x: x["keywords"])

    return df.withColumn(
        "all_keywords",
        T.keyword_union(keywords(segments), keywords(images), keywords(evidence)),
    )


def label_verdicts(
    df: DataFrame, classification: str = "classification", confidence: str = "confidence",
    is_safe: str = "is_safe", safety_confidence: str = "safety_confidence",
    additional: str = "additional_labels",
) -> DataFrame:
    """Vocabulary labels, unsafe override and the label-confidence map.

    Unsafe documents become class Unsafe with the safety confidence and keep
    their content class as a label.
    """
    safe = F.col(is_safe)
    return (
        df.withColumn("_primary", F.col(confidence))
        .withColumn(
            "secondary_labels",
            R.with_safety_label(R.secondary_labels(F.col(additional)), safe),
        )
        .withColumn(additional, R.unsafe_labels(F.col(additional), F.col(classification), safe))
        .withColumn("_class", F.when(safe, F.col(classification)).otherwise(F.lit("Unsafe")))
        .withColumn(confidence, F.when(safe, F.col(confidence)).otherwise(F.col(safety_confidence)))
        .withColumn(classification, F.col("_class"))
        .withColumn(
            "label_confidence",
            R.label_confidence(
                F.col(classification), F.col(confidence), F.col("secondary_labels"),
                F.col("_primary"), F.col(safety_confidence),
            ),
        )
        .drop("_primary", "_class")
    )


def auto_approve(
    df: DataFrame, threshold: float = V.AUTO_APPROVE_AT, is_safe: str = "is_safe"
) -> DataFrame:
    """Confident and safe verdicts need no review. The reason stays for the record."""
    clear = (F.col("confidence") >= threshold) & F.col(is_safe)
    return df.withColumn(
        "requires_review", F.when(clear, F.lit(False)).otherwise(F.col("requires_review"))
    )


def batch_status(requested: DataFrame, results: DataFrame, key: str = "document_id") -> DataFrame:
    """Totals of a batch: each requested id counts, with or without a result."""
    have = results.select(F.col(key).alias("_k")).distinct()
    joined = requested.select(key).join(have, F.col(key) == F.col("_k"), "left")
    return joined.agg(
        F.count(F.lit(1)).alias("total_documents"),
        F.count("_k").alias("processed"),
        F.lit(0).cast("bigint").alias("in_progress"),
        (F.count(F.lit(1)) - F.count("_k")).alias("failed"),
        F.lit(True).alias("completed"),
    )


def lead_in(
    df: DataFrame, filename: str = "filename", page_count: str = "page_count",
    image_count: str = "image_count", rollup: str | None = None, examples: str | None = None,
) -> DataFrame:
    """Add ``lead_in``: what a scorer is told about the document beforehand.

    Needs the columns of ``detect_features``. ``rollup`` adds the alert about
    sensitive segments, ``examples`` (array of structs, five used) what reviewers
    decided on similar documents.
    """
    def line(flag: str, text: str):
        return F.when(F.col(flag), F.lit(text))

    steps = F.transform(
        F.col("analysis_plan"),
        lambda s, i: F.concat(
            F.lit("**Step "), (i + 1).cast("string"), F.lit(": "),
            F.initcap(F.replace(s, F.lit("_"), F.lit(" "))), F.lit("**"),
        ),
    )
    parts = F.array_compact(F.concat(
        F.array(
            F.lit("**DOCUMENT ANALYSIS REQUEST**"),
            F.concat(F.lit("Filename: "), F.col(filename)),
            F.concat(F.lit("Pages: "), F.col(page_count).cast("string")),
            F.concat(F.lit("Images: "), F.col(image_count).cast("string")),
            F.lit(""),
            F.lit("**DETECTED FEATURES:**"),
            line("has_pii_indicators", "- Contains PII indicators (forms, personal data)"),
            line("has_defense_keywords", "- Contains defense/military keywords"),
            line("has_government_markers", "- Contains government content markers"),
            line("has_technical_content", "- Contains technical specifications"),
            F.concat(F.lit("- Document type: "), F.col("document_type")),
            F.concat(F.lit("- Sensitivity score: "), F.col("sensitivity_score").cast("string")),
            F.lit(""),
            F.lit("**ANALYSIS PIPELINE:**"),
            F.lit("Execute the following analysis steps in order:"),
            F.lit(""),
        ),
        steps,
    ))
    text = F.array_join(parts, "\n")
    if rollup:
        r = F.col(rollup)
        text = F.concat(text, F.when(
            r["suggests_sensitive"],
            F.format_string(
                "\n\n**CRITICAL SEGMENT ANALYSIS ALERT**\n"
                "The document contains segments classified as sensitive:\n"
                "- %d segments classified as Confidential\n"
                "- %d segments classified as Highly Sensitive\n"
                "- Highest segment classification: %s (%.0f%% confidence)",
                r["confidential_count"], r["highly_sensitive_count"],
                F.coalesce(r["top_confidence_class"], F.lit("Unknown")), r["top_confidence"] * 100,
            ),
        ).otherwise(F.lit("")))
    if examples:
        shown = F.slice(F.col(examples), 1, 5)
        blocks = F.transform(shown, lambda e, i: F.concat(
            F.lit("**Example "), (i + 1).cast("string"), F.lit(":**\n- Document: "),
            F.coalesce(e["filename"], F.lit("N/A")),
            F.lit("\n- Original Classification: "),
            F.coalesce(e["original_classification"], F.lit("N/A")),
            F.lit("\n- Human Corrected To: "),
            F.coalesce(e["corrected_classification"], F.lit("N/A")),
            F.lit("\n- Feedback: "), F.coalesce(e["feedback_notes"], F.lit("N/A")),
            F.lit("\n- Key Insight: "),
            F.substring(F.coalesce(e["content_preview"], F.lit("N/A")), 1, 200), F.lit("..."),
        ))
        text = F.concat(text, F.when(
            F.size(shown) > 0,
            F.concat(
                F.lit("\n\n**LEARNED EXAMPLES FROM HUMAN FEEDBACK**\n"), F.array_join(blocks, "\n\n")
            ),
        ).otherwise(F.lit("")))
    return df.withColumn("lead_in", text)


def score(requests: DataFrame, fn, schema) -> DataFrame:
    """Hook for users who own a model: ``fn`` maps iterators of pandas batches."""
    return requests.mapInPandas(fn, schema)


def evidence_rows(df: DataFrame, evidence: str = "evidence") -> DataFrame:
    """One row per evidence item."""
    empty = F.array().cast(ArrayType(S.EVIDENCE))
    return df.select(
        "document_id", F.posexplode(F.coalesce(F.col(evidence), empty)).alias("pos", "e")
    ).select("document_id", "pos", "e.*")


def segment_rows(df: DataFrame, segments: str = "text_segments") -> DataFrame:
    """One row per text segment."""
    empty = F.array().cast(ArrayType(S.SEGMENT))
    return df.select(
        "document_id", F.posexplode(F.coalesce(F.col(segments), empty)).alias("pos", "s")
    ).select("document_id", "pos", "s.*")
