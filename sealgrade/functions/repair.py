"""Expressions that read, repair and grade model verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, StructType

from sealgrade import schemas as S, vocab as V
from sealgrade.functions.text import strip

# strict JSON: single quotes and friends are errors, as for any JSON reader
_JSON = {
    "allowSingleQuotes": "false",
    "allowUnquotedFieldNames": "false",
    "mode": "PERMISSIVE",
}


def _strings(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def json_object_text(text: Column) -> Column:
    """From the first ``{`` to the last ``}``; null when there is none."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def json_array_text(text: Column) -> Column:
    """From the first ``[`` to the last ``]``; null when there is none."""
    return F.nullif(F.regexp_extract(text, r"(?s)\[.*\]", 0), F.lit(""))


def parse_object(json: Column, schema: StructType) -> Column:
    """One JSON object, or null when malformed or followed by more text.

    Parsing it as the only element of an array makes trailing text an error.
    """
    many = F.from_json(F.concat(F.lit("["), json, F.lit("]")), ArrayType(schema), _JSON)
    return F.when(F.size(many) == 1, many[0])


def parse_array(json: Column, schema: StructType) -> Column:
    return F.from_json(json, ArrayType(schema), _JSON)


def missing_key(json: Column) -> Column:
    """The first required key that is absent; a null value counts as present."""
    keys = F.json_object_keys(json)
    absent = F.filter(_strings(*V.REQUIRED_KEYS), lambda k: ~F.array_contains(keys, k))
    return F.when(F.size(absent) > 0, F.element_at(absent, 1))


def with_government_label(labels: Column, detected: Column) -> Column:
    """Default to no labels; a truthy detection adds its label once."""
    base = F.coalesce(labels, _strings())
    truthy = F.coalesce(~F.lower(detected).isin("", "false", "0", "0.0", "[]", "{}"), F.lit(False))
    label = F.lit("Government Content")
    return F.when(truthy & ~F.array_contains(base, label), F.array_append(base, label)).otherwise(base)


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def normalize_flags(flags: Column, fixed: bool = False) -> Column:
    """Map free-form safety flags onto the official ones.

    ``A|B`` counts as two flags. A flag matches exactly, then lower-cased, then
    lower-cased without blanks, hyphens and underscores; anything else is
    ``Safe``. ``fixed`` also accepts official names in any casing.
    """
    table = {f: f for f in V.SAFETY_FLAGS} | V.SAFETY_FLAG_VARIANTS
    if fixed:
        table = {f.lower(): f for f in V.SAFETY_FLAGS} | table
    known = _literal_map(table)

    def one(flag: Column) -> Column:
        low = F.lower(flag)
        return F.coalesce(
            F.try_element_at(known, flag),
            F.try_element_at(known, low),
            F.try_element_at(known, F.regexp_replace(low, "[ _-]", "")),
            F.lit("Safe"),
        )

    parts = F.flatten(F.transform(
        flags,
        lambda f: F.when(f.contains("|"), F.transform(F.split(f, r"\|"), strip)).otherwise(F.array(f)),
    ))
    mapped = F.array_distinct(F.transform(parts, one))
    return F.when(F.size(mapped) > 0, mapped).otherwise(_strings("Safe"))


def repair_safety(is_safe: Column, flags: Column, details: Column, confidence: Column) -> Column:
    """Make a safety record agree with itself.

    Personal-data wording in the details is a sensitivity matter, so the record
    becomes safe. Safe records carry exactly ``[Safe]``; unsafe ones drop
    ``Safe``, and one whose only flag is ``Safe`` becomes safe.
    """
    details = F.lower(F.coalesce(details, F.lit("")))
    about_pii = reduce(lambda a, b: a | b, [details.contains(w) for w in V.PII_DETAIL_WORDS])
    flags = F.coalesce(flags, _strings("Safe"))
    only_safe = (F.size(flags) == 1) & F.array_contains(flags, "Safe")
    safe = about_pii | F.coalesce(is_safe, F.lit(True)) | only_safe
    return F.struct(
        safe.alias("is_safe"),
        F.when(safe, _strings("Safe")).otherwise(F.array_remove(flags, "Safe")).alias("flags"),
        F.when(about_pii, F.lit(V.CLEAN_DETAILS)).otherwise(details).alias("details"),
        F.coalesce(confidence, F.lit(0.95)).alias("confidence"),
    )


def fallback_verdict(reason: Column) -> Column:
    """What a failed classification becomes: Confidential, confidence 0."""
    return F.struct(
        F.lit("Confidential").alias("classification"),
        F.lit(0.0).alias("confidence"),
        F.lit("Classification failed - manual review required").alias("summary"),
        F.concat(F.lit("Error during classification: "), reason).alias("reasoning"),
        F.array(F.struct(
            F.lit(None).cast("int").alias("page"),
            F.lit("N/A").alias("region"),
            F.lit("Classification error").alias("quote"),
            F.lit("Automated classification failed, defaulting to Confidential for safety")
            .alias("reasoning"),
            F.lit(None).cast("int").alias("image_index"),
            F.lit(None).cast("string").alias("sensitivity_level"),
            _strings().alias("keywords"),
            F.lit(None).cast("int").alias("start_char"),
            F.lit(None).cast("int").alias("end_char"),
        )).alias("evidence"),
        F.struct(
            F.lit(True).alias("is_safe"),
            _strings("Safe").alias("flags"),
            F.lit("Could not complete safety assessment due to error - defaulting to safe")
            .alias("details"),
            F.lit(0.5).alias("confidence"),
        ).alias("safety_assessment"),
        _strings().alias("additional_labels"),
    )


def parse_status(json: Column, raw: Column) -> Column:
    absent = missing_key(json)
    return (
        F.when(json.isNull(), F.lit("No JSON found in response"))
        .when(raw.isNull(), F.lit("Invalid JSON"))
        .when(absent.isNotNull(), F.concat(F.lit("Missing required field: "), absent))
        .when(~F.coalesce(raw["classification"].isin(*V.CLASSES), F.lit(False)), F.lit("Invalid classification"))
        .when(~F.coalesce(raw["confidence"].between(0.0, 1.0), F.lit(False)), F.lit("Invalid confidence"))
        .when(raw["safety_assessment"].isNull(), F.lit("Invalid safety assessment"))
        .otherwise(F.lit("ok"))
    )


def repaired_verdict(raw: Column, flags: Column) -> Column:
    """A parsed answer with defaults, normalised ``flags`` and a repaired safety record."""
    safety = raw["safety_assessment"]
    return F.struct(
        raw["classification"].alias("classification"),
        raw["confidence"].alias("confidence"),
        raw["summary"].alias("summary"),
        raw["reasoning"].alias("reasoning"),
        F.coalesce(raw["evidence"], F.array().cast(ArrayType(S.EVIDENCE))).alias("evidence"),
        repair_safety(safety["is_safe"], flags, safety["details"], safety["confidence"])
        .alias("safety_assessment"),
        with_government_label(raw["additional_labels"], raw["government_content_detected"])
        .alias("additional_labels"),
    )


def secondary_labels(labels: Column) -> Column:
    """Labels of the 15-value vocabulary, by value or by lower-cased name."""
    by_value = _literal_map({value: value for value, _ in V.SECONDARY_LABELS})
    by_name = _literal_map({name: value for value, name in V.SECONDARY_LABELS})
    return F.array_compact(F.transform(
        F.coalesce(labels, _strings()),
        lambda x: F.coalesce(F.try_element_at(by_value, x), F.try_element_at(by_name, F.lower(x))),
    ))


def with_safety_label(labels: Column, is_safe: Column) -> Column:
    label = F.when(is_safe, F.lit("Safe")).otherwise(F.lit("Unsafe"))
    return F.when(F.array_contains(labels, label), labels).otherwise(F.array_append(labels, label))


def unsafe_labels(labels: Column, classification: Column, is_safe: Column) -> Column:
    """When unsafe, keep the content class as a ``Content Type: X`` label."""
    keep = ~is_safe & ~F.array_contains(labels, classification)
    return F.when(
        keep, F.array_append(labels, F.concat(F.lit("Content Type: "), classification))
    ).otherwise(labels)


def label_confidence(
    classification: Column, confidence: Column, labels: Column,
    primary_confidence: Column, safety_confidence: Column,
) -> Column:
    """Confidence per label: safety labels take the safety confidence, the others
    ``max(0.7, 0.9 * primary_confidence)``."""
    keys = F.array_distinct(F.concat(F.array(classification), labels))
    return F.map_from_arrays(
        keys,
        F.transform(
            keys,
            lambda k: F.when(~F.array_contains(labels, k), confidence)
            .when(k.isin("Safe", "Unsafe"), safety_confidence)
            .otherwise(F.greatest(F.lit(0.7), primary_confidence * 0.9)),
        ),
    )



def review_basic(
    classification: Column, confidence: Column, is_safe: Column,
    secondary: Column, consensus: Column,
) -> Column:
    """Reason for a human review, or null; first rule that applies."""
    return (
        F.when(~is_safe, F.lit("Unsafe content detected - mandatory review"))
        .when(
            F.coalesce(confidence, F.lit(0.0)) < V.BASIC_MIN_CONFIDENCE,
            F.format_string("Low confidence score: %.2f", F.coalesce(confidence, F.lit(0.0))),
        )
        .when(_disagree(secondary, consensus), _disagreement(classification, secondary))
        .when(
            (classification == "Highly Sensitive") & (confidence < V.BASIC_MIN_HIGHLY_SENSITIVE),
            F.lit("Highly Sensitive classification requires high confidence"),
        )
    )


def review_enhanced(
    classification: Column, confidence: Column, is_safe: Column,
    secondary: Column, consensus: Column, segments: Column, images: Column,
) -> Column:
    """As ``review_basic`` with image and segment rules and higher thresholds."""
    visuals = F.size(F.filter(images, lambda i: F.coalesce(i["contains_sensitive_visual"], F.lit(False))))
    classes = F.size(F.array_distinct(F.transform(segments, lambda s: s["classification"])))
    return (
        F.when(~is_safe, F.lit("Unsafe content detected - mandatory review"))
        .when(
            visuals > 0,
            F.format_string(
                "Detected %d images with sensitive visual elements (seals, stamps, etc.)", visuals
            ),
        )
        .when(
            classes >= 3,
            F.lit("High variation in segment classifications - manual review recommended"),
        )
        .when(
            confidence < V.ENHANCED_MIN_CONFIDENCE,
            F.format_string("Low confidence score: %.2f", F.coalesce(confidence, F.lit(0.0))),
        )
        .when(_disagree(secondary, consensus), _disagreement(classification, secondary))
        .when(
            (classification == "Highly Sensitive") & (confidence < V.ENHANCED_MIN_HIGHLY_SENSITIVE),
            F.lit("Highly Sensitive classification requires very high confidence"),
        )
    )


def _disagree(secondary: Column, consensus: Column) -> Column:
    return secondary.isNotNull() & ~F.coalesce(consensus, F.lit(False))


def _disagreement(classification: Column, secondary: Column) -> Column:
    return F.format_string("LLM disagreement: Primary=%s, Secondary=%s", classification, secondary)


def segment_rollup(segments: Column) -> Column:
    """Counts per class, the class of the most confident segment (first on ties;
    named for what it is), and whether the segments suggest sensitive content."""

    def count(name: str) -> Column:
        return F.size(F.filter(segments, lambda s: s["classification"] == name))

    ranked = F.transform(
        F.filter(
            F.transform(
                segments,
                lambda s, i: F.struct(
                    s["confidence"].alias("c"), (-i).alias("o"), s["classification"].alias("k")
                ),
            ),
            lambda r: r["c"] > 0,
        ),
        lambda r: r,
    )
    best = F.array_max(ranked)
    classes = F.array_distinct(F.transform(segments, lambda s: s["classification"]))
    confidential, highly = count("Confidential"), count("Highly Sensitive")
    return F.struct(
        F.map_from_arrays(
            classes,
            F.transform(
                classes, lambda k: F.size(F.filter(segments, lambda s: s["classification"] == k))
            ),
        ).alias("classification_counts"),
        best["k"].alias("top_confidence_class"),
        F.coalesce(best["c"], F.lit(0.0)).alias("top_confidence"),
        confidential.alias("confidential_count"),
        highly.alias("highly_sensitive_count"),
        ((confidential >= 2) | (highly >= 1)).alias("suggests_sensitive"),
    )


def most_sensitive(*classes: Column) -> Column:
    """The most sensitive of the given classes; the first when none is known."""
    found = F.filter(_strings(*V.PRIORITY), lambda p: F.array_contains(F.array_compact(F.array(*classes)), p))
    return F.coalesce(F.try_element_at(found, F.lit(1)), classes[0])


def usable_segments(located: Column) -> Column:
    """The located segments, or none when any has an unknown class or an
    impossible confidence, or when the answer was unreadable."""
    valid = F.forall(
        located,
        lambda s: s["classification"].isin(*V.CLASSES) & s["confidence"].between(0.0, 1.0),
    )
    return F.when(valid, located).otherwise(F.array().cast(ArrayType(S.SEGMENT)))


def parse_images(responses: Column, limit: int | None = None, numbered: bool = False) -> Column:
    """Image analyses from one response per image, of the first ``limit`` images if given. Where responses are
    ``numbered``, they are structs of ``item`` and ``response_text``, else an image's number is its place.

    A null response (call failed) or one without an object gives nothing; an
    unreadable object gives the fallback: Public, 0.5.
    """

    def read(response: Column, i: Column) -> Column:
        json = json_object_text(response["response_text"] if numbered else response)
        return F.struct(
            (response["item"].cast("int") if numbered else i).alias("i"), json.isNotNull().alias("any"), parse_object(json, S.RAW_IMAGE).alias("raw")
        )

    def fill(item: Column) -> Column:
        i, raw = item["i"], item["raw"]
        kind = F.coalesce(raw["classification"], F.lit("Public"))
        conf = F.coalesce(raw["confidence"], F.lit(0.5))
        good = raw.isNotNull() & kind.isin(*V.CLASSES) & conf.between(0.0, 1.0)
        return F.struct(
            i.alias("image_index"),
            (i + 1).alias("page"),
            F.when(good, raw["ocr_text"]).alias("ocr_text"),
            F.when(good, kind).otherwise(F.lit("Public")).alias("classification"),
            F.when(good, conf).otherwise(F.lit(0.5)).alias("confidence"),
            F.coalesce(F.when(good, raw["contains_sensitive_visual"]), F.lit(False))
            .alias("contains_sensitive_visual"),
            F.coalesce(F.when(good, raw["visual_elements"]), _strings()).alias("visual_elements"),
            F.when(good, F.coalesce(raw["reasoning"], F.lit("")))
            .otherwise(F.lit("Image analysis failed")).alias("reasoning"),
            F.coalesce(F.when(good, raw["keywords"]), _strings()).alias("keywords"),
        )

    answered = F.filter(F.transform(responses if limit is None else F.slice(responses, 1, limit), read), lambda x: x["any"])
    return F.transform(answered, fill)


def parse_context(json: Column, raw: Column) -> Column:
    """Document context with defaults; unreadable JSON gives the 0.3 default, a
    missing response or one without an object gives null."""

    def pick(name: str, default) -> Column:
        return F.coalesce(raw[name], F.lit(default))

    good = raw.isNotNull() & pick("confidence", 0.5).between(0.0, 1.0)
    return F.when(json.isNotNull(), F.struct(
        F.when(good, pick("context_type", "PUBLIC_DISCUSSION"))
        .otherwise(F.lit("PUBLIC_DISCUSSION")).alias("context_type"),
        F.when(good, pick("intended_audience", "Unknown")).otherwise(F.lit("Unknown"))
        .alias("intended_audience"),
        F.when(good, pick("content_purpose", "educational")).otherwise(F.lit("educational"))
        .alias("content_purpose"),
        F.when(good, pick("is_proprietary", False)).otherwise(F.lit(False)).alias("is_proprietary"),
        F.when(good, pick("confidence", 0.5)).otherwise(F.lit(0.3)).alias("confidence"),
        F.when(good, pick("reasoning", ""))
        .otherwise(F.lit("Context analysis failed, defaulting to public discussion"))
        .alias("reasoning"),
    ))


def keyword_relevance(raw: Column, limit: int | None = None) -> Column:
    """Keyword scores with defaults, the first ``limit`` of them if given; none if one is impossible."""
    scored = F.transform(raw if limit is None else F.slice(raw, 1, limit), lambda k: F.struct(
        F.coalesce(k["keyword"], F.lit("")).alias("keyword"),
        F.coalesce(k["relevance_score"], F.lit(0.0)).alias("relevance_score"),
        F.coalesce(k["context_window"], F.lit("")).alias("context_window"),
        F.coalesce(k["relationship_type"], F.lit("MENTIONS")).alias("relationship_type"),
        F.coalesce(k["page"], F.lit(1)).alias("page"),
        F.coalesce(k["reasoning"], F.lit("")).alias("reasoning"),
    ))
    valid = F.forall(scored, lambda k: k["relevance_score"].between(0.0, 1.0))
    return F.when(valid, scored).otherwise(F.array().cast(ArrayType(S.KEYWORD_RELEVANCE)))


def quick_unsafe(response: Column) -> Column:
    """The pre-scan's finding when it reports unsafe content, else null."""
    raw = parse_object(json_object_text(response), S.QUICK_SAFETY)
    return F.when(F.coalesce(raw["is_unsafe"], F.lit(False)), raw)
