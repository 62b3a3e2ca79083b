"""The given test tables seen as documents, verdicts, feedback, progress events
and model answers. Only columns a query uses are computed: each is a projection
that column pruning drops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sealgrade import vocab as V
from sealgrade.functions.detect import has_pii, pii_test


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``document_id, filename, text, lang, source, file_size, image_count``."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("document_id"), _filename().alias("filename"), "text", "lang",
        "source", F.col("n_chars").alias("file_size"),
        (F.col("doc_id") % 9).cast("int").alias("image_count"),
    )


def _filename() -> Column:
    return F.concat(
        F.col("source"), F.lit("_"), F.col("lang"), F.lit("_"), F.col("doc_id").cast("string"),
        F.lit(".txt"),
    )


def distinct_words(text: Column) -> Column:
    """Distinct words of five letters or more, in order."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]{5,}"), F.lit(0)))


def classifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flat verdict per document, by rules over its text and labels."""
    l = table(spark, sf_dir, "labels")
    d = table(spark, sf_dir, "documents").join(l, "doc_id", "left")
    text, doc = F.col("text"), F.col("doc_id")
    sensitive = has_pii(text, {n: V.PII_PATTERNS[n] for n in ("credit_card", "email")})
    score = (doc * 37) % 40
    return d.select(
        doc.alias("document_id"), _filename().alias("filename"),
        F.when(F.col("toxic") == 1, "Unsafe").when(sensitive, "Highly Sensitive")
        .when((F.col("quality") == 0) | F.lower(text).contains("license"), "Confidential")
        .otherwise("Public").alias("classification"),
        ((score + 60).cast("double") / 100).alias("confidence"),
        F.when(doc % 11 == 0, F.lit(None)).otherwise(score < 15).alias("requires_review"),
        (F.coalesce("toxic", F.lit(0)) == 0).alias("is_safe"),
        F.ceil(F.length(text) / 2000.0).cast("int").alias("segment_count"),
        F.greatest(F.ceil(F.length(text) / 2000.0).cast("int"), F.lit(1)).alias("page_count"),
        (doc % 9).cast("int").alias("image_count"),
        ((doc % 50).cast("double") / 4 + 1).alias("processing_time"),
        F.date_add(F.lit("2024-01-01").cast("date"), (doc % 30).cast("int")).alias("classified_on"),
        F.substring(text, 1, 200).alias("summary"),
        text.alias("full_text"),
    )


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested verdicts: page-sized segments, a piece of evidence a page, images,
    keywords of the whole text and a safety record."""
    c = classifications(spark, sf_dir)
    doc = F.col("document_id")
    pages = F.regexp_extract_all(F.col("full_text"), F.lit(r"(?s).{1,2000}"), F.lit(0))

    def head(text: Column, n: int) -> Column:
        return F.slice(distinct_words(text), 1, n)

    def segment(page: Column, i: Column) -> Column:
        low = F.lower(page)
        return F.struct(
            page.alias("text"),
            F.when(low.contains("license"), F.lit("Confidential"))
            .when(pii_test(page, "email", V.PII_PATTERNS["email"]), F.lit("Highly Sensitive"))
            .when((doc + i) % 5 == 0, F.lit("Confidential"))
            .otherwise(F.lit("Public")).alias("classification"),
            (((doc * 7 + i * 13) % 50 + 50).cast("double") / 100).alias("confidence"),
            (i + 1).alias("page"), (i * 2000).alias("start_char"),
            (i * 2000 + F.length(page)).alias("end_char"),
            head(page, 3).alias("keywords"), F.lit("page rule").alias("reasoning"),
        )

    def evidence(page: Column, i: Column) -> Column:
        return F.struct(
            (i + 1).alias("page"), F.lit("page").alias("region"),
            page.alias("quote"), F.lit("opening words").alias("reasoning"),
            F.lit(None).cast("int").alias("image_index"),
            F.when((doc + i) % 3 == 0, F.lit("Confidential")).otherwise(F.lit("Public"))
            .alias("sensitivity_level"),
            head(page, 2).alias("keywords"), (i * 2000).alias("start_char"),
            (i * 2000 + F.length(page)).alias("end_char"),
        )

    def image(i: Column) -> Column:
        return F.struct(
            i.alias("image_index"), (i + 1).alias("page"), F.lit(None).cast("string").alias("ocr_text"),
            F.lit("Public").alias("classification"), F.lit(0.5).alias("confidence"),
            ((doc + i) % 17 == 0).alias("contains_sensitive_visual"),
            F.array().cast("array<string>").alias("visual_elements"), F.lit("").alias("reasoning"),
            F.array(F.concat(F.lit("image"), i.cast("string"))).alias("keywords"),
        )

    staged = c.withColumn("_pages", pages)
    images = F.when(
        F.col("image_count") > 0, F.transform(F.sequence(F.lit(0), F.col("image_count") - 1), image)
    ).otherwise(F.array())
    safe = F.col("is_safe")
    return staged.withColumns({
        "text_segments": F.transform("_pages", segment),
        "evidence": F.transform("_pages", evidence),
        "image_analyses": images,
        "all_keywords": distinct_words(F.col("full_text")),
        "additional_labels": F.when(doc % 4 == 0, F.array(F.lit("Proprietary")))
        .otherwise(F.array().cast("array<string>")),
        "safety_check": F.struct(
            safe.alias("is_safe"),
            F.when(safe, F.array(F.lit("Safe"))).otherwise(F.array(F.lit("Threats"), F.lit("Profanity")))
            .alias("flags"),
            F.lit("by label").alias("details"), F.lit(0.9).alias("confidence"),
        ),
        "reasoning": F.lit("by rule"),
    }).drop("_pages")


def learning_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One review per labelled document, its text as notes and its words as
    indicators."""
    k = classifications(spark, sf_dir)
    l = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "document_id")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("document_id") % 30).cast("int"))
    approved = F.col("quality") == 1
    notes = F.col("full_text")
    return l.join(k, "document_id").select(
        "document_id", F.col("document_id").alias("seq"), "filename",
        F.col("classification").alias("original_classification"),
        approved.alias("approved"),
        F.when(approved, F.lit(None))
        .when(F.col("classification") == "Public", "Confidential")
        .otherwise("Highly Sensitive").alias("corrected_classification"),
        day.alias("review_date"), day.cast("string").alias("timestamp"),
        F.concat(F.lit("reviewer"), (F.col("document_id") % 7).cast("string")).alias("reviewer_id"),
        notes.alias("feedback_notes"), "confidence",
        distinct_words(notes).alias("key_indicators"),
    )


def progress_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_progress(table(spark, sf_dir, "events"))


def as_progress(events: DataFrame) -> DataFrame:
    """``document_id, event_ts, seq, kind, message`` from the event table."""
    kind = (
        F.when(F.col("event_type") == "signup", "start")
        .when(F.col("event_type") == "purchase", "complete")
        .when(F.col("event_type") == "error", "error").otherwise("progress")
    )
    return events.select(
        F.col("user_id").alias("document_id"), F.col("ts").cast("timestamp").alias("event_ts"),
        F.col("event_id").alias("seq"), kind.alias("kind"), F.col("event_type").alias("message"),
    )


def model_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the roles primary, secondary and verification, as free text
    around a JSON object, with the defects a reader must cope with."""
    c = classifications(spark, sf_dir)
    doc = F.col("document_id")

    def shifted(test: Column) -> Column:
        return F.when(test & (F.col("classification") == "Public"), F.lit("Confidential")).when(
            test, F.lit("Public")).otherwise(F.col("classification"))

    def answer(kind: Column) -> Column:
        flags = F.when(F.col("is_safe"), '["none"]').otherwise('["Threats|profane"]')
        safety = F.when(doc % 13 == 0, F.lit("")).otherwise(F.concat(
            F.lit(',"safety_assessment":{"is_safe":'), F.col("is_safe").cast("string"),
            F.lit(',"flags":'), flags,
            F.when(doc % 19 == 0, F.lit(',"details":"mentions SSN","confidence":0.9}'))
            .otherwise(F.lit(',"details":"Checked","confidence":0.9}')),
        ))
        return F.concat(
            F.lit('Here is the result: {"classification":"'), kind, F.lit('","confidence":'),
            F.format_string("%.2f", F.col("confidence")),
            F.lit(',"summary":"s","reasoning":"r","evidence":[{"page":1,"quote":"q",'
                  '"reasoning":"e","keywords":["alpha","beta"]}]'),
            F.when(doc % 3 == 0, F.lit(',"additional_labels":["Proprietary","legal document"],'
                                       '"government_content_detected":true')).otherwise(F.lit("")),
            safety,
            F.when(doc % 29 == 0, F.lit("} Done. {")).otherwise(F.lit("} Done.")),
        )

    verifier = F.when(doc % 28 == 0, F.lit(None)).when(doc % 42 == 0, F.lit("no object")).otherwise(
        F.concat(F.lit('{"final_classification":"'), F.col("classification"),
                 F.lit('","final_confidence":0.8,"notes":"checked"}')))
    roles = F.array(
        F.struct(F.lit("primary").alias("role"), answer(F.col("classification")).alias("response_text")),
        F.struct(F.lit("secondary").alias("role"), answer(shifted(doc % 7 == 0)).alias("response_text")),
        F.struct(F.lit("verification").alias("role"), verifier.alias("response_text")),
    )
    return c.select(doc, F.inline(roles)).withColumn("item", F.lit(0))
