"""Shared pieces: the adapters as SQL, and views over the given tables."""

from __future__ import annotations

from sealgrade import vocab as V


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def values(*items: str) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


# verdicts, one per document
K = f"""K AS (
  SELECT d.doc_id AS document_id,
    concat(d.source, '_', d.lang, '_', CAST(d.doc_id AS VARCHAR), '.txt') AS filename,
    CASE WHEN l.toxic = 1 THEN 'Unsafe'
         WHEN regexp_matches(d.text, {q(V.PII_PATTERNS['credit_card'])}, 'i')
           OR regexp_matches(d.text, {q(V.PII_PATTERNS['email'])}, 'i') THEN 'Highly Sensitive'
         WHEN l.quality = 0 OR contains(lower(d.text), 'license') THEN 'Confidential'
         ELSE 'Public' END AS classification,
    CAST(60 + (d.doc_id * 37) % 40 AS DOUBLE) / 100 AS confidence,
    CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE (d.doc_id * 37) % 40 < 15 END AS requires_review,
    coalesce(l.toxic, 0) = 0 AS is_safe,
    CAST(ceil(length(d.text) / 2000.0) AS BIGINT) AS segment_count,
    greatest(CAST(ceil(length(d.text) / 2000.0) AS BIGINT), 1) AS page_count,
    d.doc_id % 9 AS image_count,
    CAST(d.doc_id % 50 AS DOUBLE) / 4 + 1 AS processing_time,
    DATE '2024-01-01' + CAST(d.doc_id % 30 AS INTEGER) AS classified_on,
    substring(d.text, 1, 200) AS summary, d.text AS full_text, d.lang, d.n_chars
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

# reviews, one per labelled document
LEARNING = f"""{K},
L AS (
  SELECT k.document_id, k.document_id AS seq, k.filename,
    k.classification AS original_classification, l.quality = 1 AS approved,
    CASE WHEN l.quality = 1 THEN NULL WHEN k.classification = 'Public' THEN 'Confidential'
         ELSE 'Highly Sensitive' END AS corrected_classification,
    DATE '2024-01-01' + CAST(k.document_id % 30 AS INTEGER) AS review_date,
    concat('reviewer', CAST(k.document_id % 7 AS VARCHAR)) AS reviewer_id,
    k.full_text AS feedback_notes, k.confidence, k.full_text
  FROM labels l JOIN K k ON l.doc_id = k.document_id)"""

# reviews in the shape the pattern operators read
NORMALIZED = f"""{LEARNING},
N AS (
  SELECT document_id, seq, original_classification,
    coalesce(corrected_classification, CASE WHEN approved THEN original_classification END)
      AS human_classification,
    filename, coalesce(feedback_notes, '') AS reasoning, CAST(review_date AS VARCHAR) AS ts
  FROM L),
X AS (SELECT * FROM N WHERE original_classification IS DISTINCT FROM human_classification)"""

# text segments of verdicts, one per 2000 characters
SEGMENTS = f"""{K},
SEG AS (
  SELECT document_id, i, text, n,
    CASE WHEN contains(lower(text), 'license') THEN 'Confidential'
         WHEN regexp_matches(text, {q(V.PII_PATTERNS['email'])}, 'i') THEN 'Highly Sensitive'
         WHEN (document_id + i) % 5 = 0 THEN 'Confidential' ELSE 'Public' END AS classification,
    CAST((document_id * 7 + i * 13) % 50 + 50 AS DOUBLE) / 100 AS confidence
  FROM (SELECT document_id, i, substring(full_text, i * 2000 + 1, 2000) AS text, segment_count AS n
        FROM K, unnest(range(0, segment_count)) AS u(i)))"""


def all_words(text: str) -> str:
    """The distinct words of five letters or more, in order."""
    return f"""coalesce((SELECT list(w ORDER BY p) FROM (SELECT w, min(p) AS p FROM (
      SELECT unnest(x) AS w, generate_subscripts(x, 1) AS p FROM (
        SELECT regexp_extract_all(lower({text}), '[a-z]{{5,}}') AS x)) GROUP BY w)), [])"""


def first_words(text: str, n: int) -> str:
    """The first ``n`` distinct words of five letters or more, in order."""
    found = f"regexp_extract_all(lower({text}), '[a-z]{{5,}}')"
    return f"list_slice(list_filter({found}, lambda w, p: list_position({found}, w) = p), 1, {n})"
