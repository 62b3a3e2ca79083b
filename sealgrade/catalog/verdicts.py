"""Verdict parsing, repair, routing and preset queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sealgrade import vocab as V
from sealgrade.catalog.common import K, SEGMENTS, values
from sealgrade.functions import repair as R
from sealgrade.operators import quality, verdicts as M
from sealgrade.plans import presets
from sealgrade.sources import adapters as A

# the answers as text, by role; the same rules as in the adapter
RESPONSES = f"""{K},
B AS (SELECT *, CASE WHEN document_id % 7 = 0 THEN CASE WHEN classification = 'Public'
    THEN 'Confidential' ELSE 'Public' END ELSE classification END AS second FROM K),
A0 AS (SELECT document_id, 'primary' AS role, classification AS kind, confidence, is_safe FROM B
  UNION ALL SELECT document_id, 'secondary', second, confidence, is_safe FROM B),
RESP AS (SELECT document_id, role, concat('Here is the result: {{"classification":"', kind,
    '","confidence":', printf('%.2f', confidence),
    ',"summary":"s","reasoning":"r","evidence":[{{"page":1,"quote":"q","reasoning":"e","keywords":["alpha","beta"]}}]',
    CASE WHEN document_id % 3 = 0 THEN ',"additional_labels":["Proprietary","legal document"],"government_content_detected":true' ELSE '' END,
    CASE WHEN document_id % 13 = 0 THEN '' ELSE concat(',"safety_assessment":{{"is_safe":', is_safe,
      ',"flags":', CASE WHEN is_safe THEN '["none"]' ELSE '["Threats|profane"]' END,
      CASE WHEN document_id % 19 = 0 THEN ',"details":"mentions SSN","confidence":0.9}}'
      ELSE ',"details":"Checked","confidence":0.9}}' END) END,
    CASE WHEN document_id % 29 = 0 THEN '}} Done. {{' ELSE '}} Done.' END) AS response_text FROM A0
  UNION ALL SELECT document_id, 'verification', CASE WHEN document_id % 28 = 0 THEN NULL
    WHEN document_id % 42 = 0 THEN 'no object' ELSE concat('{{"final_classification":"',
    classification, '","final_confidence":0.8,"notes":"checked"}}') END FROM K)"""

# parsed and repaired: what read_verdicts makes of the answers
_REQUIRED = values(*V.REQUIRED_KEYS)
READ = f"""{RESPONSES},
J AS (SELECT *, nullif(regexp_extract(response_text, '(?s)\\{{.*\\}}'), '') AS json FROM RESP),
S0 AS (SELECT *, CASE WHEN json IS NULL THEN 'No JSON found in response'
    WHEN NOT json_valid(json) THEN 'Invalid JSON'
    WHEN len(list_filter({_REQUIRED}, lambda k: NOT list_contains(json_keys(json), k))) > 0
      THEN 'Missing required field: ' || list_filter({_REQUIRED},
        lambda k: NOT list_contains(json_keys(json), k))[1]
    ELSE 'ok' END AS status FROM J),
S1 AS (SELECT *, lower(json_extract_string(json, '$.safety_assessment.details')) AS det,
    json_extract_string(json, '$.safety_assessment.is_safe') = 'true' AS stated,
    CASE WHEN contains(json, '["none"]') THEN ['Safe'] ELSE ['Threats', 'Profanity'] END AS mapped
  FROM S0),
S2 AS (SELECT *, det LIKE '%ssn%' OR stated OR (len(mapped) = 1 AND mapped[1] = 'Safe') AS safe FROM S1),
V AS (SELECT document_id, role, json, status AS parse_status,
    CASE WHEN status = 'ok' THEN json_extract_string(json, '$.classification') ELSE 'Confidential' END AS classification,
    CASE WHEN status = 'ok' THEN CAST(json_extract_string(json, '$.confidence') AS DOUBLE) ELSE 0.0 END AS confidence,
    CASE WHEN status = 'ok' THEN safe ELSE true END AS is_safe,
    CASE WHEN status <> 'ok' OR safe THEN 'Safe' ELSE 'Threats,Profanity' END AS flags,
    CASE WHEN status <> 'ok' THEN 'Could not complete safety assessment due to error - defaulting to safe'
      WHEN det LIKE '%ssn%' THEN 'No harmful content detected' ELSE det END AS details,
    CASE WHEN status = 'ok' THEN 0.9 ELSE 0.5 END AS safety_confidence,
    CASE WHEN status = 'ok' AND document_id % 3 = 0 THEN ['Proprietary', 'legal document', 'Government Content']
      ELSE [] END AS labels FROM S2)"""


def _read(spark, sf, role="primary") -> DataFrame:
    return M.read_verdicts(A.model_responses(spark, sf).where(F.col("role") == role))


def _flat(df: DataFrame, verdict: str = "verdict") -> DataFrame:
    v = F.col(verdict)
    return df.withColumns({
        "classification": v["classification"], "confidence": v["confidence"],
        "is_safe": v["safety_assessment"]["is_safe"], "safety_confidence": v["safety_assessment"]["confidence"],
        "additional_labels": v["additional_labels"],
    })


def _json(spark, sf):
    r = A.model_responses(spark, sf)
    return r.withColumn("json", R.json_object_text(F.col("response_text"))).select(
        "document_id", "role", F.md5("json").alias("digest"))


def _status(spark, sf):
    r = A.model_responses(spark, sf).where(F.col("role") != "verification")
    return M.read_verdicts(r).select("document_id", "role", "parse_status")


def _labelled(spark, sf):
    out = M.label_verdicts(_flat(_read(spark, sf)))
    pairs = F.array_sort(F.transform(
        F.map_entries("label_confidence"),
        lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.3f", e["value"]))))
    return out.select(
        "document_id", "classification", F.round("confidence", 6).alias("confidence"),
        F.array_join("secondary_labels", ",").alias("secondary_labels"),
        F.array_join("additional_labels", ",").alias("additional_labels"),
        F.array_join(pairs, ",").alias("label_confidence"))


_LABELLED = f"""WITH {READ},
P AS (SELECT * FROM V WHERE role = 'primary'),
T AS (SELECT *, list_concat(CASE WHEN len(labels) > 0 THEN ['Proprietary', 'Legal Document', 'Government Content']
    ELSE [] END, [CASE WHEN is_safe THEN 'Safe' ELSE 'Unsafe' END]) AS sec,
  CASE WHEN is_safe THEN labels ELSE list_append(labels, 'Content Type: ' || classification) END AS addl,
  CASE WHEN is_safe THEN classification ELSE 'Unsafe' END AS cls,
  CASE WHEN is_safe THEN confidence ELSE safety_confidence END AS conf FROM P),
U AS (SELECT *, list_concat(CASE WHEN list_contains(sec, cls) THEN [] ELSE [cls || '=' || printf('%.3f', conf)] END,
  list_transform(sec, lambda s: s || '=' || printf('%.3f', CASE WHEN s IN ('Safe', 'Unsafe')
    THEN safety_confidence ELSE greatest(0.7, confidence * 0.9) END))) AS pairs FROM T)
SELECT document_id, cls AS classification, round(conf, 6) AS confidence,
  array_to_string(sec, ',') AS secondary_labels, coalesce(array_to_string(addl, ','), '') AS additional_labels,
  array_to_string(list_sort(pairs), ',') AS label_confidence FROM U"""


def _routed(spark, sf) -> DataFrame:
    wide = M.responses_by_role(
        A.model_responses(spark, sf), ("primary", "secondary", "verification"), images=False)
    wide = M.read_verdicts(wide, "primary", "primary_verdict", "primary_status")
    wide = M.read_verdicts(wide, "secondary", "secondary_verdict", "secondary_status")
    return M.route_verification(wide)


_ROUTE_COLUMNS = (
    "document_id", "final_classification", "final_confidence", "secondary_classification",
    "secondary_confidence", "consensus", "verification_notes",
)
ROUTED = f"""{READ},
W AS (SELECT p.document_id, p.classification AS pc, p.confidence AS pf, p.is_safe, p.labels,
    s.classification AS sc, s.confidence AS sf, r.response_text AS ver
  FROM V p JOIN V s ON s.document_id = p.document_id AND s.role = 'secondary'
  JOIN RESP r ON r.document_id = p.document_id AND r.role = 'verification' WHERE p.role = 'primary'),
Y AS (SELECT *, CASE WHEN pf > 0.98 THEN 'skip' WHEN pc = sc THEN 'agree' WHEN ver IS NULL THEN 'blocked'
    WHEN ver = 'no object' THEN 'tie' ELSE 'answer' END AS way,
  list_filter(['Unsafe', 'Highly Sensitive', 'Confidential', 'Public'],
    lambda c: c = pc OR c = sc)[1] AS worst FROM W),
Z AS (SELECT document_id, pc, pf, is_safe,
  CASE way WHEN 'tie' THEN worst WHEN 'answer' THEN json_extract_string(ver, '$.final_classification')
    ELSE pc END AS final_classification,
  CASE way WHEN 'tie' THEN least(pf, sf) WHEN 'answer' THEN 0.8 ELSE pf END AS final_confidence,
  CASE WHEN way <> 'skip' THEN sc END AS secondary_classification,
  CASE WHEN way <> 'skip' THEN sf END AS secondary_confidence,
  CASE WHEN way <> 'skip' THEN pc = sc END AS consensus,
  CASE way WHEN 'skip' THEN 'Skipped verification due to very high primary confidence ('
      || CAST(round(pf * 100) AS INTEGER) || '%)'
    WHEN 'blocked' THEN 'Verification agent blocked by safety filter, using primary classification'
    WHEN 'answer' THEN 'checked' WHEN 'tie' THEN 'Used conservative approach due to disagreement'
    END AS verification_notes FROM Y)"""


def _review_basic(spark, sf):
    r = _routed(spark, sf)
    v = F.col("primary_verdict")
    reason = R.review_basic(
        v["classification"], v["confidence"], v["safety_assessment"]["is_safe"],
        F.col("secondary_classification"), F.col("consensus"))
    return r.select("document_id", reason.alias("review_reason"))


_REVIEW_BASIC = f"""WITH {ROUTED} SELECT document_id,
  CASE WHEN NOT is_safe THEN 'Unsafe content detected - mandatory review'
    WHEN pf < 0.7 THEN 'Low confidence score: ' || printf('%.2f', pf)
    WHEN NOT consensus THEN 'LLM disagreement: Primary=' || pc || ', Secondary=' || secondary_classification
    WHEN pc = 'Highly Sensitive' AND pf < 0.85 THEN 'Highly Sensitive classification requires high confidence'
  END AS review_reason FROM Z"""


def _review_enhanced(spark, sf):
    v = A.verdicts(spark, sf)
    none = F.lit(None)
    reason = R.review_enhanced(
        F.col("classification"), F.col("confidence"), F.col("is_safe"), none.cast("string"),
        none.cast("boolean"), F.col("text_segments"), F.col("image_analyses"))
    return v.select("document_id", reason.alias("review_reason"))


_REVIEW_ENHANCED = f"""WITH {SEGMENTS},
G AS (SELECT document_id, count(DISTINCT classification) AS n FROM SEG GROUP BY ALL),
I AS (SELECT document_id, count(*) AS v FROM K, unnest(range(0, image_count)) AS u(i)
      WHERE (document_id + i) % 17 = 0 GROUP BY ALL)
SELECT k.document_id, CASE WHEN NOT is_safe THEN 'Unsafe content detected - mandatory review'
  WHEN v > 0 THEN 'Detected ' || v || ' images with sensitive visual elements (seals, stamps, etc.)'
  WHEN n >= 3 THEN 'High variation in segment classifications - manual review recommended'
  WHEN confidence < 0.75 THEN 'Low confidence score: ' || printf('%.2f', confidence)
  WHEN classification = 'Highly Sensitive' AND confidence < 0.9
    THEN 'Highly Sensitive classification requires very high confidence' END AS review_reason
FROM K k LEFT JOIN G USING (document_id) LEFT JOIN I USING (document_id)"""


def _rollup(spark, sf):
    v = A.verdicts(spark, sf).withColumn("r", R.segment_rollup(F.col("text_segments")))
    counts = F.array_sort(F.transform(
        F.map_entries("r.classification_counts"),
        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    return v.select(
        "document_id", F.array_join(counts, ",").alias("counts"), "r.top_confidence_class",
        "r.top_confidence", "r.confidential_count", "r.highly_sensitive_count", "r.suggests_sensitive")


_ROLLUP = f"""WITH {SEGMENTS},
C AS (SELECT document_id, classification || '=' || count(*) AS c FROM SEG GROUP BY document_id, classification),
D AS (SELECT document_id, string_agg(c, ',' ORDER BY c) AS counts FROM C GROUP BY ALL),
T AS (SELECT document_id, classification, confidence FROM SEG
      QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY confidence DESC, i) = 1),
N AS (SELECT document_id, count(*) FILTER (WHERE classification = 'Confidential') AS c,
        count(*) FILTER (WHERE classification = 'Highly Sensitive') AS h FROM SEG GROUP BY ALL)
SELECT k.document_id, coalesce(counts, '') AS counts, T.classification AS top_confidence_class,
  coalesce(T.confidence, 0.0) AS top_confidence, coalesce(c, 0) AS confidential_count,
  coalesce(h, 0) AS highly_sensitive_count, coalesce(c >= 2 OR h >= 1, false) AS suggests_sensitive
FROM K k LEFT JOIN D USING (document_id) LEFT JOIN T USING (document_id) LEFT JOIN N USING (document_id)"""


def _quick(spark, sf):
    """The pre-scan reports unsafe documents, with a flag to normalise."""
    c = A.classifications(spark, sf)
    found = F.concat(
        F.lit('Scan: {"is_unsafe": '), (~F.col("is_safe")).cast("string"),
        F.when(F.col("document_id") % 2 == 0, ', "quick_flag": "hacking|crime"').otherwise(""),
        F.lit(', "evidence": "line 1", "severity": "Low"}'))
    out = M.quick_exit_verdict(M.with_quick_safety(c.withColumn("quick_safety", found)))
    return out.select(
        "document_id", "classification", "confidence", "summary", "reasoning", "review_reason",
        F.array_join("safety_check.flags", ",").alias("flags"), F.col("safety_check.details").alias("details"),
        F.length("full_text").alias("kept"))


_QUICK = f"""WITH {K} SELECT document_id, 'Unsafe' AS classification, 0.95::DOUBLE AS confidence,
  'Document flagged as unsafe: ' || CASE WHEN document_id % 2 = 0 THEN 'hacking|crime' ELSE 'Safety violation' END AS summary,
  'Quick safety scan detected: line 1. Severity: Low' AS reasoning,
  'Quick safety check flagged: ' || CASE WHEN document_id % 2 = 0 THEN 'hacking|crime' ELSE 'None' END AS review_reason,
  CASE WHEN document_id % 2 = 0 THEN 'Cyber Threat,Criminal Activity' ELSE 'Violence' END AS flags,
  'Quick preliminary scan detected ' || CASE WHEN document_id % 2 = 0 THEN 'hacking|crime' ELSE 'unsafe content' END
    || '. line 1' AS details, length(full_text) AS kept FROM K WHERE NOT is_safe"""


def _parsed_children(spark, sf):
    """Segment, image, context and keyword answers built from each document."""
    c = A.classifications(spark, sf)
    doc, text = F.col("document_id"), F.col("full_text")
    piece = F.regexp_replace(text, r"[^A-Za-z ]", "")
    built = c.select(
        "document_id", "full_text",
        F.concat(
            F.lit('Segments: [{"text": "'), piece, F.lit('", "classification": "'),
            F.when(doc % 10 == 0, "Secret").otherwise("Confidential"),
            F.lit('", "confidence": 0.8, "keywords": ["k"]}, {"text": "qqqq qqqq"}] end')).alias("segments"),
        F.array(
            F.lit('{"classification": "Confidential", "confidence": 0.9, "contains_sensitive_visual": true}'),
            F.when(doc % 2 == 0, F.lit("{broken}")).otherwise(F.lit(None)),
            F.lit("no object")).alias("images"),
        F.when(doc % 3 == 0, '{"context_type": "INTERNAL", "confidence": 0.7}')
        .when(doc % 3 == 1, "{oops}").alias("context"),
        F.concat(F.lit('[{"keyword": "'), piece, F.lit('", "relevance_score": 0.5}]')).alias("keyword_relevance"))
    df = M.with_keyword_relevance(M.with_context(M.with_images(M.with_segments(built))))
    s, i = F.col("text_segments"), F.col("image_analyses")
    return df.select(
        "document_id", F.size(s).alias("n_segments"),
        F.try_element_at(s, F.lit(2))["start_char"].alias("second_start"),
        F.size(i).alias("n_images"), F.try_element_at(i, F.lit(2))["reasoning"].alias("second_image"),
        F.col("document_context.context_type").alias("context_type"),
        F.col("document_context.confidence").alias("context_confidence"),
        F.try_element_at("keyword_relevances", F.lit(1))["relationship_type"].alias("relationship"))


_CHILDREN = f"""WITH {K} SELECT document_id, CASE WHEN document_id % 10 = 0 THEN 0 ELSE 2 END AS n_segments,
  CASE WHEN document_id % 10 <> 0 THEN 100 END AS second_start,
  CASE WHEN document_id % 2 = 0 THEN 2 ELSE 1 END AS n_images,
  CASE WHEN document_id % 2 = 0 THEN 'Image analysis failed' END AS second_image,
  CASE document_id % 3 WHEN 0 THEN 'INTERNAL' WHEN 1 THEN 'PUBLIC_DISCUSSION' END AS context_type,
  CASE document_id % 3 WHEN 0 THEN 0.7 WHEN 1 THEN 0.3 END AS context_confidence,
  'MENTIONS' AS relationship FROM K"""


def _auto_approved(spark, sf):
    c = A.classifications(spark, sf).withColumn("requires_review", F.coalesce("requires_review", F.lit(True)))
    return M.auto_approve(c).select("document_id", "requires_review")


def _batch(spark, sf):
    """All documents are requested; labelled ones have results."""
    results = A.table(spark, sf, "labels").select(F.col("doc_id").alias("document_id"))
    return M.batch_status(A.documents(spark, sf), results)


def _documents(spark, sf):
    c = A.classifications(spark, sf)
    return c.select(
        "document_id", "filename", "full_text", "page_count", "image_count",
        F.regexp_extract_all("full_text", F.lit(r"(?s).{1,2000}"), F.lit(0)).alias("pages"))


def _basic(spark, sf):
    out = presets.basic(_documents(spark, sf), A.model_responses(spark, sf), dual=True)
    return out.select("document_id", "classification", F.round("confidence", 6).alias("confidence"),
                      "consensus", "requires_review", "review_reason")


_BASIC = f"""WITH {READ},
W AS (SELECT p.*, s.classification AS sc FROM V p JOIN V s ON s.document_id = p.document_id
      AND s.role = 'secondary' WHERE p.role = 'primary'),
R AS (SELECT *, CASE WHEN NOT is_safe THEN 'Unsafe content detected - mandatory review'
    WHEN confidence < 0.7 THEN 'Low confidence score: ' || printf('%.2f', confidence)
    WHEN classification <> sc THEN 'LLM disagreement: Primary=' || classification || ', Secondary=' || sc
    WHEN classification = 'Highly Sensitive' AND confidence < 0.85
      THEN 'Highly Sensitive classification requires high confidence' END AS reason FROM W)
SELECT document_id, CASE WHEN is_safe THEN classification ELSE 'Unsafe' END AS classification,
  CASE WHEN is_safe THEN confidence ELSE safety_confidence END AS confidence, classification = sc AS consensus,
  reason IS NOT NULL AND NOT (is_safe AND confidence >= 0.9) AS requires_review, reason AS review_reason FROM R"""


def _enhanced(spark, sf):
    learned = presets.learn(A.learning_feedback(spark, sf))
    out = presets.enhanced(_documents(spark, sf), A.model_responses(spark, sf), learned)
    return out.select(
        "document_id", "classification", F.round("confidence", 6).alias("confidence"),
        "secondary_classification", "consensus", "requires_review", "review_reason",
        F.array_join("all_keywords", ",").alias("all_keywords"))


def _enhanced_plain(spark, sf):
    out = presets.enhanced(_documents(spark, sf), A.model_responses(spark, sf))
    return out.select(
        "document_id", "classification", F.round("confidence", 6).alias("confidence"),
        "secondary_classification", "consensus", "requires_review", "review_reason", "verification_notes",
        F.array_join("all_keywords", ",").alias("all_keywords"))


_ENHANCED = f"""WITH {ROUTED}, Q AS (SELECT Z.*, v.parse_status, v.safety_confidence FROM Z JOIN V v
  ON v.document_id = Z.document_id AND v.role = 'primary'),
R AS (SELECT *, CASE WHEN NOT is_safe THEN 'Unsafe content detected - mandatory review'
    WHEN pf < 0.75 THEN 'Low confidence score: ' || printf('%.2f', pf)
    WHEN NOT consensus THEN 'LLM disagreement: Primary=' || pc || ', Secondary=' || secondary_classification
    WHEN pc = 'Highly Sensitive' AND pf < 0.9
      THEN 'Highly Sensitive classification requires very high confidence' END AS review_reason FROM Q)
SELECT document_id, CASE WHEN is_safe THEN final_classification ELSE 'Unsafe' END AS classification,
  round(CASE WHEN is_safe THEN final_confidence ELSE safety_confidence END, 6) AS confidence,
  secondary_classification, consensus, review_reason IS NOT NULL AS requires_review, review_reason,
  verification_notes, CASE WHEN parse_status = 'ok' THEN 'alpha,beta' ELSE '' END AS all_keywords FROM R"""


def _expectations(spark, sf):
    """Labels as expectations: what reviewers' quality marks lead one to expect."""
    l = A.table(spark, sf, "labels")
    return l.select(
        F.col("doc_id").alias("document_id"), F.concat(F.lit("T"), F.col("doc_id")).alias("test_id"),
        F.when(F.col("quality") == 1, F.array(F.lit("Public"), F.lit("Highly Sensitive")))
        .otherwise(F.array(F.lit("Confidential"))).alias("expected_classes"),
        (F.col("toxic") == 0).alias("is_safe"), F.lit(0.7).alias("min_confidence"),
        F.lit(True).alias("need_evidence"), (F.col("doc_id") % 2 == 0).alias("need_pages"),
        F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("the"), F.lit("die"))).alias("terms"),
        (F.col("toxic") == 1).alias("need_flags"))


def _checked(spark, sf):
    return quality.check_expectations(A.verdicts(spark, sf), _expectations(spark, sf))


_CHECKED = f"""{K},
Q AS (SELECT k.*, l.quality, l.toxic, segment_count AS n_ev,
    lower(array_to_string(list_transform(range(0, segment_count),
      lambda i: substring(full_text, i * 2000 + 1, 2000)), ' ')) AS quotes
  FROM K k JOIN labels l ON l.doc_id = k.document_id),
E AS (SELECT *, CASE WHEN quality = 1 THEN classification IN ('Public', 'Highly Sensitive')
      ELSE classification = 'Confidential' END AS cls_ok, is_safe = (toxic = 0) AS safe_ok,
    n_ev > 0 AS ev_ok, confidence >= 0.7 AS conf_ok,
    document_id % 5 <> 0 OR contains(quotes, 'the') OR contains(quotes, 'die') AS terms_ok FROM Q)"""

QUERIES = {
    "m01_json_extraction": (
        _json,
        f"""WITH {RESPONSES} SELECT document_id, role, md5(nullif(regexp_extract(response_text,
        '(?s)\\{{.*\\}}'), '')) AS digest FROM RESP"""),
    "m02_parse_status": (
        _status, f"WITH {READ} SELECT document_id, role, parse_status FROM V WHERE role <> 'verification'"),
    "m03_additional_labels": (
        lambda s, sf: _flat(_read(s, sf)).select(
            "document_id", F.array_join("additional_labels", ",").alias("labels")),
        f"""WITH {READ} SELECT document_id, coalesce(array_to_string(labels, ','), '') AS labels
        FROM V WHERE role = 'primary'"""),
    "m04_m06_repaired_verdicts": (
        lambda s, sf: _flat(_read(s, sf)).select(
            "document_id", "classification", "confidence", "is_safe", "safety_confidence",
            F.array_join("verdict.safety_assessment.flags", ",").alias("flags"),
            F.col("verdict.safety_assessment.details").alias("details")),
        f"""WITH {READ} SELECT document_id, classification, confidence, is_safe, safety_confidence,
        flags, details FROM V WHERE role = 'primary'"""),
    "m07_m09_labelled_verdicts": (_labelled, _LABELLED),
    "m10_review_basic": (_review_basic, _REVIEW_BASIC),
    "m11_review_enhanced": (_review_enhanced, _REVIEW_ENHANCED),
    "m12_segment_rollup": (_rollup, _ROLLUP),
    "m13_m14_j07_verification_routing": (
        lambda s, sf: _routed(s, sf).select(*_ROUTE_COLUMNS),
        f"WITH {ROUTED} SELECT {', '.join(_ROUTE_COLUMNS)} FROM Z"),
    "m13_needs_verification": (
        lambda s, sf: M.needs_verification(_read(s, sf), "verdict").select("document_id"),
        f"WITH {READ} SELECT document_id FROM V WHERE role = 'primary' AND confidence <= 0.98"),
    "m15_quick_exit": (_quick, _QUICK),
    "m16_parsed_children": (_parsed_children, _CHILDREN),
    "m17_auto_approved": (
        _auto_approved,
        f"""WITH {K} SELECT document_id, coalesce(requires_review, true)
        AND NOT (confidence >= 0.9 AND is_safe) AS requires_review FROM K"""),
    "m18_batch_status": (
        _batch,
        """SELECT count(*) AS total_documents, count(l.doc_id) AS processed, 0 AS in_progress,
        count(*) - count(l.doc_id) AS failed, true AS completed
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""),
    "preset_basic": (_basic, _BASIC),
    "preset_enhanced": (_enhanced_plain, _ENHANCED),
    "preset_enhanced_learned": (_enhanced, None),
    "a31_expectation_checks": (
        lambda s, sf: _checked(s, sf).select(
            "test_id", "status", F.size("failures").alias("failures"), F.size("warnings").alias("warnings")),
        f"""WITH {_CHECKED} SELECT 'T' || document_id AS test_id,
        CASE WHEN cls_ok AND safe_ok AND ev_ok THEN 'PASS' ELSE 'FAIL' END AS status,
        CAST(NOT cls_ok AS INTEGER) + CAST(NOT safe_ok AS INTEGER) + CAST(NOT ev_ok AS INTEGER) AS failures,
        CAST(NOT conf_ok AS INTEGER) + CAST(NOT ev_ok AND document_id % 2 = 0 AS INTEGER)
          + CAST(NOT terms_ok AS INTEGER) AS warnings FROM E"""),
    "a31_expectation_summary": (
        lambda s, sf: quality.summary(_checked(s, sf)),
        f"""WITH {_CHECKED}, S AS (SELECT count(*) AS total,
        count(*) FILTER (WHERE cls_ok AND safe_ok AND ev_ok) AS passed FROM E)
        SELECT total, passed, total - passed AS failed, 0 AS skipped,
        printf('%.1f%%', passed / total * 100) AS success_rate FROM S"""),
}
