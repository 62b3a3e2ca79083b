"""Review feedback: normalising, merging, applying, searching, exporting.

Feedback tables carry ``seq``, the order in which entries were recorded; all
first-seen and last-wins rules go by it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sealgrade import schemas as S, vocab as V


def _has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def _col(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if _has(df, name) else F.lit(None).cast(kind)


def normalize_feedback(df: DataFrame, raw_keys_only: bool = False) -> DataFrame:
    """Feedback in one shape: ``document_id, seq, original_classification,
    human_classification, filename, reasoning, timestamp, approved``.

    The human class is the stated one, else the correction, else the original
    when approved. ``raw_keys_only`` takes the literal keys ``human_classification``,
    ``filename`` and ``reasoning`` alone, as the online learner reads them.
    """
    original = _col(df, "original_classification")
    human = _col(df, "human_classification")
    filename, reasoning = _col(df, "filename"), _col(df, "reasoning")
    if not raw_keys_only:
        approved = F.coalesce(_col(df, "approved", "boolean"), F.lit(False))
        human = F.coalesce(human, _col(df, "corrected_classification"), F.when(approved, original))
        inner = F.col("document_context.filename") if _has(df, "document_context") else F.lit(None)
        filename = F.coalesce(filename, inner)
        reasoning = F.coalesce(
            reasoning, _col(df, "reasoning_for_correction"), _col(df, "feedback_notes")
        )
    return df.select(
        "document_id", "seq", original.alias("original_classification"),
        human.alias("human_classification"),
        F.coalesce(filename, F.lit("unknown")).alias("filename"),
        F.coalesce(reasoning, F.lit("")).alias("reasoning"),
        _col(df, "timestamp").alias("timestamp"),
        _col(df, "approved", "boolean").alias("approved"),
    )


def _per_document(df: DataFrame, order: Column, columns: Sequence[str]) -> DataFrame:
    """One row per document: the first by ``order``. The ranking is limited
    before the shuffle, so copies of one document do not travel."""
    w = Window.partitionBy("document_id").orderBy(order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").select(*columns)


def latest_per_document(df: DataFrame) -> DataFrame:
    return _per_document(df, F.col("seq").desc(), df.columns)


def union_feedback(learning: DataFrame, archive: DataFrame) -> DataFrame:
    """All learning rows, then archive rows of documents not among them, the
    first archive row of a document winning. ``seq`` continues after learning's."""
    first = _per_document(archive, F.col("seq").asc(), archive.columns)
    known = learning.select(F.col("document_id").alias("_known")).distinct()
    extra = first.join(known, F.col("document_id").eqNullSafe(F.col("_known")), "left_anti")
    after = learning.agg(F.coalesce(F.max("seq"), F.lit(-1))).scalar() + 1
    return learning.unionByName(
        extra.withColumn("seq", F.col("seq") + after), allowMissingColumns=True
    )


def upsert_learning(learning: DataFrame, incoming: DataFrame) -> DataFrame:
    """Replace the entry of the same document, else append.

    An entry keeps the position of the one it replaces. Applying the same rows
    again changes nothing.
    """
    columns = learning.columns
    rows = learning.withColumn("_new", F.lit(0)).unionByName(
        incoming.select(*columns).withColumn("_new", F.lit(1))
    )
    after = learning.agg(F.coalesce(F.max("seq"), F.lit(-1))).scalar() + 1
    # existing positions first, new documents behind them in arrival order
    place = F.when(F.col("_new") == 0, F.col("seq")).otherwise(F.col("seq") + after)
    best = rows.groupBy("document_id").agg(
        F.min(place).alias("_place"),
        F.max_by(
            F.struct(*[c for c in columns if c not in ("document_id", "seq")]),
            F.struct("_new", "seq"),
        ).alias("_row"),
    )
    return best.select(
        "document_id", F.col("_place").alias("seq"), "_row.*"
    ).select(*columns)


def apply_feedback(verdicts: DataFrame, feedback: DataFrame) -> DataFrame:
    """Verdicts after all reviews: review cleared, reviewer stamped, corrected
    classes taken over. With several corrections ``original_classification`` is
    the class before the last one.

    Feedback is reduced to one row per document first, so the join cannot fan
    out or skew on a document reviewed many times.
    """
    corrected = F.length(F.coalesce("corrected_classification", F.lit(""))) > 0
    last = feedback.groupBy("document_id").agg(
        F.max_by(F.struct("reviewer_id", "timestamp", "approved"), "seq").alias("_last")
    )
    w = Window.partitionBy("document_id").orderBy(F.col("seq").desc())
    recent = (
        feedback.where(corrected)
        .select("document_id", "seq", "corrected_classification")
        .withColumn("_rank", F.row_number().over(w)).where("_rank <= 2")
        .groupBy("document_id").agg(
            F.max(F.when(F.col("_rank") == 1, F.col("corrected_classification"))).alias("_now"),
            F.max(F.when(F.col("_rank") == 2, F.col("corrected_classification"))).alias("_before"),
        )
    )
    reviews = last.join(recent, "document_id", "left")
    drop = [c for c in (
        "human_reviewed", "reviewed_by", "reviewed_at", "feedback_approved",
        "human_corrected", "original_classification",
    ) if c in verdicts.columns]
    keep = {c: F.col(c) for c in drop}
    joined = verdicts.join(reviews, "document_id", "left")
    seen, fixed = F.col("_last").isNotNull(), F.col("_now").isNotNull()
    none = F.lit(None)
    return joined.withColumns({
        "requires_review": F.when(seen, F.lit(False)).otherwise(F.col("requires_review")),
        "human_reviewed": seen | F.coalesce(keep.get("human_reviewed", none), F.lit(False)),
        "reviewed_by": F.when(seen, F.col("_last.reviewer_id")).otherwise(
            keep.get("reviewed_by", none.cast("string"))),
        "reviewed_at": F.when(seen, F.col("_last.timestamp")).otherwise(
            keep.get("reviewed_at", none.cast("string"))),
        "feedback_approved": F.when(seen, F.col("_last.approved")).otherwise(
            keep.get("feedback_approved", none.cast("boolean"))),
        "human_corrected": fixed | F.coalesce(keep.get("human_corrected", none), F.lit(False)),
        "original_classification": F.when(
            fixed, F.coalesce(F.col("_before"), F.col("classification"))
        ).otherwise(keep.get("original_classification", none.cast("string"))),
        "classification": F.when(fixed, F.col("_now")).otherwise(F.col("classification")),
    }).drop("_last", "_now", "_before")


def approval(ids: DataFrame, reviewer_id: str = "system") -> DataFrame:
    """Quick approvals for a table of document ids."""
    return _review(
        ids, reviewer_id, True, F.lit(None).cast("string"),
        F.lit("Quick approval - classification correct"),
    )


def rejection(ids: DataFrame, reviewer_id: str = "system", notes: str = "notes") -> DataFrame:
    """Quick corrections: ids with ``corrected_classification`` and optional notes."""
    given = F.nullif(_col(ids, notes), F.lit(""))
    default = F.concat(F.lit("Reclassified to "), F.col("corrected_classification"))
    return _review(
        ids, reviewer_id, False, F.col("corrected_classification"), F.coalesce(given, default)
    )


def _review(ids: DataFrame, reviewer: str, approved: bool, corrected: Column, notes: Column) -> DataFrame:
    empty = F.array().cast("array<string>")
    stamp = F.col("timestamp") if _has(ids, "timestamp") else F.date_format(
        F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return ids.select(
        "document_id", F.lit(reviewer).alias("reviewer_id"), F.lit(approved).alias("approved"),
        corrected.alias("corrected_classification"),
        F.lit(None).cast("string").alias("original_classification"),
        notes.alias("feedback_notes"), stamp.alias("timestamp"),
        F.lit(None).cast(S.DOCUMENT_CONTEXT).alias("document_context"),
        F.lit(None).cast("string").alias("reasoning_for_correction"),
        empty.alias("key_indicators"), empty.alias("similar_document_patterns"),
        F.lit(None).cast("string").alias("learning_instruction"),
        *(["seq"] if _has(ids, "seq") else []),
    )


def _class_counts(segments: Column) -> Column:
    classes = F.array_distinct(
        F.transform(segments, lambda s: F.coalesce(s["classification"], F.lit("Unknown")))
    )
    return F.map_from_arrays(classes, F.transform(classes, lambda k: F.size(F.filter(
        segments, lambda s: F.coalesce(s["classification"], F.lit("Unknown")) == k))))


def _first(values: Column, n: int | None) -> Column:
    return values if n is None else F.slice(values, 1, n)


def document_context(
    prefix: str = "", pieces: int | None = None, quote_chars: int | None = None, keywords: int | None = None
) -> Column:
    """What a review remembers of a verdict: evidence, segment counts per class,
    keywords; all of them unless a number is given."""
    def c(name):
        return F.col(f"{prefix}{name}")

    def quote(e: Column) -> Column:
        text = F.coalesce(e["quote"], F.lit(""))
        return text if quote_chars is None else F.substring(text, 1, quote_chars)

    evidence = F.transform(_first(c("evidence"), pieces), lambda e: F.struct(
        quote(e).alias("quote"),
        F.coalesce(e["reasoning"], F.lit("")).alias("reasoning"),
    ))
    return F.struct(
        c("filename").alias("filename"), c("page_count").cast("int").alias("page_count"),
        c("image_count").cast("int").alias("image_count"), c("summary").alias("summary"),
        c("classification").alias("original_classification"),
        c("confidence").alias("confidence"), evidence.alias("key_evidence"),
        F.struct(
            F.size(c("text_segments")).alias("total"),
            _class_counts(c("text_segments")).alias("classifications"),
        ).alias("text_segments_summary"),
        _first(c("all_keywords"), keywords).alias("keywords"),
    ).cast(S.DOCUMENT_CONTEXT)


def key_indicators(prefix: str = "", keywords: int | None = None, limit: int | None = None) -> Column:
    """Keywords and those of Confidential segments, distinct, in first-seen order;
    the first ``keywords`` and ``limit`` in all where a number is given."""
    segments = F.col(f"{prefix}text_segments")
    confidential = F.flatten(F.transform(
        F.filter(segments, lambda s: s["classification"] == "Confidential"),
        lambda s: F.coalesce(s["keywords"], F.array().cast("array<string>")),
    ))
    return _first(F.array_distinct(
        F.concat(_first(F.col(f"{prefix}all_keywords"), keywords), confidential)
    ), limit)


def learning_instruction(
    original: Column, corrected: Column, notes: Column, prefix: str = ""
) -> Column:
    """The instruction text a correction leaves behind, with four optional hints."""
    segments = F.col(f"{prefix}text_segments")
    filename = F.coalesce(F.col(f"{prefix}filename"), F.lit("document"))
    confidential = F.size(F.filter(segments, lambda s: s["classification"] == "Confidential"))
    count = confidential.cast("string")
    registration = F.exists(
        F.col(f"{prefix}all_keywords"), lambda k: k.contains("N1234") | k.contains("N5678")
    )
    company = F.exists(
        segments, lambda s: F.lower(F.coalesce(s["text"], F.lit(""))).contains("company")
    )
    manual = F.lower(filename).contains("manual") | F.lower(filename).contains("operations")

    def hint(flag: Column, *parts: Column) -> Column:
        return F.when(flag, F.concat(*parts)).otherwise(F.lit(""))

    return F.concat(
        F.lit("LEARNING INSTRUCTION:\nWhen you see documents similar to '"), filename,
        F.lit("':\n\nORIGINAL MISTAKE: Classified as '"), original,
        F.lit("' but should be '"), corrected,
        F.lit("'\n\nKEY LESSON: "), notes,
        F.lit("\n\nWHAT TO LOOK FOR:\n"),
        hint(registration, F.lit(
            "\n- Aircraft registration numbers (N-numbers) indicate internal aviation "
            "documents → Confidential")),
        hint(company, F.lit(
            "\n- Company/organization names in document headers → Likely Confidential "
            "internal docs")),
        hint(confidential >= 2, F.lit("\n- Multiple segments classified as Confidential ("),
             count, F.lit(" found) → Overall doc is Confidential")),
        hint(manual, F.lit(
            "\n- Operations manuals, flight manuals, procedures → Usually Confidential "
            "unless public FAA docs")),
        F.lit("\n\nCORRECT CLASSIFICATION RULE:\nDocuments like this with "), count,
        F.lit(" confidential segments containing \ninternal company information, procedures, "
              "or registration numbers should be classified as '"), corrected,
        F.lit("', \nnot '"), original,
        F.lit("'.\n\nAPPLY THIS: When you see similar patterns (company docs, N-numbers, "
              "internal procedures), \nclassify as '"), corrected,
        F.lit("' with high confidence."),
    )


def intake(
    feedback: DataFrame, verdicts: DataFrame, context: Column | None = None, indicators: Column | None = None
) -> DataFrame:
    """Complete incoming feedback from the verdicts it speaks about.

    ``context`` and ``indicators`` stand for ``document_context("v.")`` and
    ``key_indicators("v.")`` where a caller wants those bounded.

    Context and original class are filled when absent; instruction and key
    indicators too, but only for corrections. Feedback on unknown documents is
    dropped (see ``unknown_feedback``).
    """
    needed = (
        "filename", "page_count", "image_count", "summary", "classification", "confidence",
        "evidence", "text_segments", "all_keywords",
    )
    known = verdicts.select("document_id", F.struct(*needed).alias("v"))
    joined = feedback.join(known, "document_id")
    corrected = F.col("corrected_classification")
    is_correction = F.length(F.coalesce(corrected, F.lit(""))) > 0
    original = F.coalesce(
        F.nullif("original_classification", F.lit("")), F.col("v.classification")
    )
    instruction = F.when(is_correction, learning_instruction(
        F.coalesce(F.col("original_classification"), F.lit("Unknown")), corrected,
        F.coalesce("feedback_notes", F.lit("")), "v."))
    context = document_context("v.") if context is None else context
    indicators = F.when(is_correction, key_indicators("v.") if indicators is None else indicators)
    empty = F.size(F.coalesce("key_indicators", F.array().cast("array<string>"))) == 0
    return (
        joined.withColumn("original_classification", original)
        .withColumn("document_context", F.coalesce("document_context", context))
        .withColumn("learning_instruction",
                    F.coalesce(F.nullif("learning_instruction", F.lit("")), instruction))
        .withColumn("key_indicators",
                    F.when(empty, F.coalesce(indicators, F.col("key_indicators")))
                    .otherwise(F.col("key_indicators")))
        .drop("v").select(*feedback.columns)
    )


def unknown_feedback(feedback: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Feedback on documents that have no verdict."""
    return feedback.join(verdicts.select("document_id"), "document_id", "left_anti")


def feedback_history(feedback: DataFrame, document_id) -> DataFrame:
    return feedback.where(F.col("document_id") == document_id)


def by_corrected_class(learning: DataFrame, classification: str) -> DataFrame:
    return learning.where(F.col("corrected_classification") == classification)


def recent(learning: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` newest entries; entries without time stamp come last."""
    return learning.orderBy(
        F.col("timestamp").desc_nulls_last(), F.col("seq").asc()
    ).limit(n)


def search(learning: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """Entries whose JSON text contains any of ``keywords``, in any casing."""
    text = F.lower(F.to_json(F.struct(*learning.columns)))
    kept = learning.withColumn("_text", text).where(
        F.exists(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: F.col("_text").contains(k))
    )
    return kept.drop("_text")


def training_export(learning: DataFrame) -> DataFrame:
    """Corrections only, six fields with defaults."""
    context = (
        F.col("document_context.summary") if _has(learning, "document_context") else F.lit(None)
    )
    return learning.where(~F.coalesce("approved", F.lit(True))).select(
        F.coalesce(context, F.lit("")).alias("document_summary"),
        F.coalesce(_col(learning, "key_indicators", "array<string>"), F.array().cast("array<string>"))
        .alias("keywords"),
        "original_classification",
        F.col("corrected_classification").alias("correct_classification"),
        F.coalesce(_col(learning, "learning_instruction"), F.lit("")).alias("learning_instruction"),
        F.coalesce(_col(learning, "reasoning_for_correction"), F.lit("")).alias("reasoning"),
    )


def learned_examples(normalized: DataFrame, per_class: int = 3) -> DataFrame:
    """First ``per_class`` examples per human class, in recorded order.

    The ranking is limited on each partition before the shuffle, so a class with
    most of the rows sends only its candidates.
    """
    w = Window.partitionBy("human_classification").orderBy("seq")
    same = F.col("original_classification").eqNullSafe(F.col("human_classification"))
    return (
        normalized.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_class)
        .select(
            F.col("human_classification").alias("classification"), "rank", "document_id",
            "filename", "reasoning", "timestamp",
            F.when(same, F.lit("high")).otherwise(F.lit("corrected")).alias("confidence"),
        )
    )


def few_shot(examples: DataFrame, classification: str | Sequence[str], limit: int = 3) -> DataFrame:
    """Examples of one class or of several, ``limit`` each."""
    wanted = [classification] if isinstance(classification, str) else list(classification)
    return examples.where(F.col("classification").isin(wanted) & (F.col("rank") <= limit))


def few_shot_all(examples: DataFrame, limit: int = 2) -> DataFrame:
    return few_shot(examples, V.CLASSES, limit)
