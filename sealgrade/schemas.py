"""Explicit read schemas. Nothing is inferred: a nested record with mixed value
types cannot be inferred safely, and reviewed records gain keys later."""

from pyspark.sql.types import (
    ArrayType, BooleanType, DoubleType, IntegerType, LongType, MapType, StringType,
    StructField, StructType, TimestampType,
)

_S, _D, _I, _B = StringType(), DoubleType(), IntegerType(), BooleanType()


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields.items()])


EVIDENCE = _struct(
    page=_I, region=_S, quote=_S, reasoning=_S, image_index=_I, sensitivity_level=_S,
    keywords=ArrayType(_S), start_char=_I, end_char=_I,
)
SAFETY = _struct(is_safe=_B, flags=ArrayType(_S), details=_S, confidence=_D)
SEGMENT = _struct(
    text=_S, classification=_S, confidence=_D, page=_I, start_char=_I, end_char=_I,
    keywords=ArrayType(_S), reasoning=_S,
)
IMAGE = _struct(
    image_index=_I, page=_I, ocr_text=_S, classification=_S, confidence=_D,
    contains_sensitive_visual=_B, visual_elements=ArrayType(_S), reasoning=_S,
    keywords=ArrayType(_S),
)
CONTEXT = _struct(
    context_type=_S, intended_audience=_S, content_purpose=_S, is_proprietary=_B,
    confidence=_D, reasoning=_S,
)
KEYWORD_RELEVANCE = _struct(
    keyword=_S, relevance_score=_D, context_window=_S, relationship_type=_S, page=_I,
    reasoning=_S,
)

VERDICT = _struct(
    document_id=_S, filename=_S, classification=_S,
    secondary_labels=ArrayType(_S), additional_labels=ArrayType(_S),
    label_confidence=MapType(_S, _D), confidence=_D, summary=_S, reasoning=_S,
    evidence=ArrayType(EVIDENCE), safety_check=SAFETY,
    page_count=_I, image_count=_I, processing_time=_D,
    text_segments=ArrayType(SEGMENT), image_analyses=ArrayType(IMAGE),
    full_text=_S, all_keywords=ArrayType(_S),
    secondary_classification=_S, secondary_confidence=_D, consensus=_B, verification_notes=_S,
    document_context=CONTEXT, keyword_relevances=ArrayType(KEYWORD_RELEVANCE),
    progress_steps=ArrayType(_S), requires_review=_B, review_reason=_S,
    human_reviewed=_B, reviewed_by=_S, reviewed_at=_S, human_corrected=_B,
    feedback_approved=_B, original_classification=_S,
)

DOCUMENT_CONTEXT = _struct(
    filename=_S, page_count=_I, image_count=_I, summary=_S, original_classification=_S,
    confidence=_D,
    key_evidence=ArrayType(_struct(quote=_S, reasoning=_S)),
    text_segments_summary=_struct(total=_I, classifications=MapType(_S, _I)),
    keywords=ArrayType(_S),
)
FEEDBACK = _struct(
    document_id=_S, reviewer_id=_S, approved=_B, corrected_classification=_S,
    original_classification=_S, feedback_notes=_S, timestamp=_S,
    document_context=DOCUMENT_CONTEXT, reasoning_for_correction=_S,
    key_indicators=ArrayType(_S), similar_document_patterns=ArrayType(_S),
    learning_instruction=_S,
)
LEARNING_DATABASE = _struct(
    version=_S, created_at=_S, total_feedback_count=LongType(),
    learning_entries=ArrayType(FEEDBACK), last_updated=_S,
)

METADATA = _struct(
    filename=_S, file_size=LongType(), page_count=_I, image_count=_I, is_legible=_B,
    legibility_score=_D, format=_S, warnings=ArrayType(_S),
)
SIDECAR = _struct(original_filename=_S, document_id=_S)

PROGRESS_EVENT = _struct(
    document_id=_S, filename=_S, kind=_S, message=_S, event_ts=TimestampType(), seq=LongType(),
)

# what a model answers; ``government_content_detected`` is read as text because
# any truthy value counts
MODEL_VERDICT = _struct(
    classification=_S, confidence=_D, summary=_S, reasoning=_S,
    evidence=ArrayType(EVIDENCE), safety_assessment=SAFETY,
    additional_labels=ArrayType(_S), government_content_detected=_S,
)
QUICK_SAFETY = _struct(is_unsafe=_B, quick_flag=_S, evidence=_S, severity=_S)
VERIFICATION = _struct(final_classification=_S, final_confidence=_D, notes=_S)
RAW_SEGMENT = _struct(
    text=_S, classification=_S, confidence=_D, keywords=ArrayType(_S), reasoning=_S,
)
RAW_IMAGE = _struct(
    ocr_text=_S, classification=_S, confidence=_D, contains_sensitive_visual=_B,
    visual_elements=ArrayType(_S), reasoning=_S, keywords=ArrayType(_S),
)
