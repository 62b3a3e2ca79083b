"""Feedback, learned patterns and learned scoring queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sealgrade.catalog.common import LEARNING, NORMALIZED, SEGMENTS, all_words, first_words
from sealgrade.operators import feedback as FB, learned as LN, patterns as P
from sealgrade.session import stage
from sealgrade.sources import adapters as A

PAIR = "original_classification, human_classification"
WORD = r"[\p{L}\p{N}_]+"


def _learning(fn):
    return lambda spark, sf: fn(A.learning_feedback(spark, sf))


def _normalized(fn):
    """Feedback is derived from texts here, so it is stored before several
    aggregates read it."""
    return lambda spark, sf: fn(stage(FB.normalize_feedback(A.learning_feedback(spark, sf))))


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def _archive(df: DataFrame) -> DataFrame:
    """Every other review, twice, as an archive that partly overlaps."""
    doc = F.col("document_id")
    old = df.where(doc % 2 == 0)
    return old.unionByName(old.withColumn("seq", F.col("seq") + 1_000_000).withColumn(
        "reviewer_id", F.lit("again")))


def _union(l: DataFrame) -> DataFrame:
    return FB.union_feedback(l.where(F.col("document_id") % 3 != 0), _archive(l)).select(
        "document_id", "reviewer_id", "approved")


def _upsert(l: DataFrame) -> DataFrame:
    known = l.where(F.col("document_id") % 3 != 0)
    incoming = _archive(l).withColumn("approved", F.lit(True))
    return FB.upsert_learning(known, incoming).select("document_id", "reviewer_id", "approved")


def _verdicts(spark, sf):
    return A.classifications(spark, sf).select(
        "document_id", "filename", "classification", "confidence", "requires_review")


def _two_reviews(l: DataFrame) -> DataFrame:
    """Each review, and for every fourth document a second one that corrects."""
    second = l.where(F.col("document_id") % 4 == 0).withColumns({
        "seq": F.col("seq") + 1_000_000, "reviewer_id": F.lit("second"),
        "approved": F.lit(False), "corrected_classification": F.lit("Public"),
    })
    return l.unionByName(second)


def _apply(spark, sf):
    reviews = _two_reviews(A.learning_feedback(spark, sf))
    return FB.apply_feedback(_verdicts(spark, sf), reviews)


_APPLIED = f"""WITH {LEARNING},
R AS (SELECT document_id, seq, reviewer_id, CAST(review_date AS VARCHAR) AS ts, approved,
        corrected_classification FROM L
      UNION ALL SELECT document_id, seq + 1000000, 'second', CAST(review_date AS VARCHAR), false,
        'Public' FROM L WHERE document_id % 4 = 0),
LAST AS (SELECT * FROM R QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY seq DESC) = 1),
FIX AS (SELECT document_id, corrected_classification AS c,
          row_number() OVER (PARTITION BY document_id ORDER BY seq DESC) AS n
        FROM R WHERE corrected_classification IS NOT NULL)
SELECT k.document_id, k.filename, coalesce(a.c, k.classification) AS classification, k.confidence,
  CASE WHEN l.document_id IS NOT NULL THEN false ELSE k.requires_review END AS requires_review,
  l.document_id IS NOT NULL AS human_reviewed, l.reviewer_id AS reviewed_by, l.ts AS reviewed_at,
  l.approved AS feedback_approved, a.c IS NOT NULL AS human_corrected,
  CASE WHEN a.c IS NOT NULL THEN coalesce(b.c, k.classification) END AS original_classification
FROM K k LEFT JOIN LAST l USING (document_id)
LEFT JOIN FIX a ON a.document_id = k.document_id AND a.n = 1
LEFT JOIN FIX b ON b.document_id = k.document_id AND b.n = 2"""


def _docs(spark, sf) -> DataFrame:
    """Documents as scoring sees them, with their text and its distinct words."""
    return A.classifications(spark, sf).select(
        "document_id", "filename", "classification", "confidence", F.col("full_text").alias("preview"),
        A.distinct_words(F.col("full_text")).alias("all_keywords"),
    )


def _rules_input(l: DataFrame) -> DataFrame:
    """Feedback whose file names share words, as real file names do: the stored
    name's source and language as words, and the note's first word."""
    return l.withColumn("filename", F.concat(
        F.regexp_replace("filename", "[_.]", " "), F.lit(" "),
        F.coalesce(F.try_element_at("key_indicators", F.lit(1)), F.lit(""))))


def _adjust(spark, sf):
    n = stage(FB.normalize_feedback(_rules_input(A.learning_feedback(spark, sf))))
    out = LN.adjust_confidence(
        _docs(spark, sf).drop("all_keywords"), P.accuracy_by_class(n), P.keyword_patterns(n), P.context_patterns(n))
    # rounded as SQL does it, by the product: a decimal tie of a double is none in binary
    return out.withColumn("adjusted_confidence", F.rint(F.col("adjusted_confidence") * 1e6) / 1e6).select(
        "document_id", "classification", "adjusted_confidence", "learned_review", "learned_reason")


_ACCURACY = f"""SELECT original_classification AS classification, count(*) AS total_reviews,
  count(*) FILTER (WHERE original_classification IS NOT DISTINCT FROM human_classification) AS correct,
  count(*) FILTER (WHERE original_classification IS DISTINCT FROM human_classification) AS corrections,
  count(*) FILTER (WHERE original_classification IS NOT DISTINCT FROM human_classification)
    / count(*) * 100 AS accuracy FROM N GROUP BY ALL"""

# occurrences of file-name words in corrected documents
_KEYWORDS = f"""H AS (
  SELECT {PAIR}, seq, p - 1 AS pos, w[p] AS keyword FROM (
    SELECT {PAIR}, seq, w, unnest(range(1, len(w) + 1)) AS p FROM (
      SELECT *, regexp_extract_all(lower(filename), '{WORD}') AS w FROM X)) WHERE length(w[p]) > 3),
KW AS (
  SELECT keyword, count(*) AS correction_count,
    greatest(0.5, 1.0::DOUBLE - count(*) * 0.1::DOUBLE) AS confidence_multiplier,
    min((seq, pos)) AS first FROM H GROUP BY keyword HAVING count(*) >= 2),
KP AS (
  SELECT keyword, {PAIR}, count(*) AS n, min((seq, pos)) AS f FROM H GROUP BY ALL),
KC AS (
  SELECT * FROM KP QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY n DESC, f) = 1)"""

_WORDS = f"""WH AS (
  SELECT {PAIR}, seq, p - 1 AS pos, w[p] AS word FROM (
    SELECT {PAIR}, seq, w, unnest(range(1, len(w) + 1)) AS p FROM (
      SELECT *, regexp_extract_all(lower(reasoning), '{WORD}') AS w FROM X)) WHERE length(w[p]) > 4),
WC AS (SELECT {PAIR}, word, count(*) AS n, min((seq, pos)) AS f FROM WH GROUP BY ALL),
WR AS (SELECT {PAIR}, word, n, row_number() OVER (PARTITION BY {PAIR} ORDER BY n DESC, f) AS rank
       FROM WC),
WT AS (SELECT * FROM WR WHERE n >= 2)"""

_CONTEXT = f"""{_WORDS},
PT AS (
  SELECT p.{PAIR.replace(', ', ', p.')}, p.frequency, p.first_seq,
    coalesce((SELECT list(word ORDER BY rank) FROM WT t WHERE t.original_classification
      IS NOT DISTINCT FROM p.original_classification AND t.human_classification
      IS NOT DISTINCT FROM p.human_classification), []) AS found
  FROM (SELECT {PAIR}, count(*) AS frequency, min(seq) AS first_seq FROM X GROUP BY ALL
        HAVING count(*) >= 2) p)"""

_DOCS = f"""DOCS AS (
  SELECT document_id, filename, classification, confidence, full_text AS preview,
    {all_words('full_text')} AS kw,
    lower(concat(filename, chr(1), full_text)) AS hay FROM K)"""

# feedback with several words in its file names, as in _rules_input
_RULE_NORMALIZED = NORMALIZED.replace(
    "    filename, coalesce(feedback_notes, '') AS reasoning",
    "    concat(regexp_replace(filename, '[_.]', ' ', 'g'), ' ', coalesce("
    + all_words("full_text")
    + "[1], '')) AS filename, coalesce(feedback_notes, '') AS reasoning")

_ADJUSTED = f"""WITH {_RULE_NORMALIZED}, {_KEYWORDS}, {_CONTEXT}, {_DOCS}, ACC AS ({_ACCURACY}),
HITS AS (
  SELECT d.document_id, count(*) FILTER (WHERE r.correction_count = 2) AS c2,
    count(*) FILTER (WHERE r.correction_count = 3) AS c3,
    count(*) FILTER (WHERE r.correction_count = 4) AS c4,
    count(*) FILTER (WHERE r.correction_count >= 5) AS c5,
    arg_max(r.keyword, r.first) FILTER (WHERE r.correction_count >= 3) AS k,
    arg_max(r.correction_count, r.first) FILTER (WHERE r.correction_count >= 3) AS n
  FROM DOCS d JOIN KW r ON contains(d.hay, r.keyword) GROUP BY ALL),
SIM AS (
  SELECT d.document_id, count(*) AS s, arg_max(p.human_classification, p.first_seq) AS t
  FROM DOCS d JOIN PT p ON p.original_classification = d.classification
    AND len(list_filter(p.found, lambda w: contains(lower(d.preview), w))) >= 2
  GROUP BY ALL)
SELECT d.document_id, d.classification,
  round(greatest(0.1, least(1.0, d.confidence * CASE WHEN a.accuracy < 70 THEN 0.85 ELSE 1 END
    * pow(0.8, coalesce(c2, 0)) * pow(0.7, coalesce(c3, 0)) * pow(0.6, coalesce(c4, 0))
    * pow(0.5, coalesce(c5, 0)) * pow(0.75, coalesce(s, 0)))), 6) AS adjusted_confidence,
  (s.document_id IS NOT NULL OR k IS NOT NULL OR coalesce(a.accuracy < 70, false)) AS learned_review,
  coalesce('Similar documents have been reclassified as ' || t,
    'Documents with ''' || k || ''' have been corrected ' || n || ' times',
    CASE WHEN a.accuracy < 70 THEN 'AI has ' || printf('%.1f', a.accuracy) || '% accuracy for '
      || d.classification || ' (below threshold)' END) AS learned_reason
FROM DOCS d LEFT JOIN ACC a USING (classification) LEFT JOIN HITS h USING (document_id)
LEFT JOIN SIM s USING (document_id)"""


def _override(spark, sf):
    out = LN.apply_override(_docs(spark, sf), A.learning_feedback(spark, sf))
    return _rounded(out, "learned_confidence").select(
        "document_id", "learned_classification", "learned_confidence", "was_overridden",
        "override_reason")


_OVERRIDDEN = f"""WITH {LEARNING}, {_DOCS},
R AS (SELECT seq, original_classification AS rule_from, corrected_classification AS rule_to,
        {all_words('feedback_notes')} AS ind, feedback_notes AS notes FROM L WHERE NOT approved),
M AS (SELECT d.document_id, r.seq, r.rule_to, len(r.ind) AS n, r.notes,
        len(list_filter(r.ind, lambda i: contains(d.hay, i) OR list_contains(d.kw, i))) AS hits
      FROM DOCS d JOIN R r ON r.rule_from = d.classification),
B AS (SELECT * FROM M WHERE hits >= greatest(3, n * 0.5)
      QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY seq) = 1)
SELECT d.document_id, coalesce(b.rule_to, d.classification) AS learned_classification,
  round(CASE WHEN b.seq IS NULL THEN d.confidence ELSE least(0.98, d.confidence + 0.10) END, 6)
    AS learned_confidence, b.seq IS NOT NULL AS was_overridden,
  'Learned rule applied: ''' || d.classification || ''' → ''' || b.rule_to || '''. Matched '
    || b.hits || '/' || b.n || ' indicators. Human feedback: ' || substring(b.notes, 1, 100)
    AS override_reason
FROM DOCS d LEFT JOIN B b USING (document_id)"""


def _keyword_hits(spark, sf):
    """How many keyword rules of each strength a document has, as their factor, and the last strong one."""
    n = stage(FB.normalize_feedback(_rules_input(A.learning_feedback(spark, sf))))
    out = LN.match_keyword_rules(_docs(spark, sf).drop("all_keywords"), P.keyword_patterns(n))
    return _rounded(out, "keyword_factor").select("document_id", "keyword_factor", "keyword_reason")


_HITS = f"""WITH {_RULE_NORMALIZED}, {_KEYWORDS}, {_DOCS},
H2 AS (SELECT d.document_id, r.keyword, r.correction_count AS n, r.first
       FROM DOCS d JOIN KW r ON contains(d.hay, r.keyword)),
H3 AS (SELECT document_id, arg_max(keyword, first) FILTER (WHERE n >= 3) AS k,
         arg_max(n, first) FILTER (WHERE n >= 3) AS c,
         pow(0.8, count(*) FILTER (WHERE n = 2)) * pow(0.7, count(*) FILTER (WHERE n = 3))
         * pow(0.6, count(*) FILTER (WHERE n = 4)) * pow(0.5, count(*) FILTER (WHERE n >= 5)) AS factor
       FROM H2 GROUP BY document_id)
SELECT d.document_id, round(coalesce(factor, 1.0), 6) AS keyword_factor,
  'Documents with ''' || k || ''' have been corrected ' || c || ' times' AS keyword_reason
FROM DOCS d LEFT JOIN H3 USING (document_id)"""


def _rules(spark, sf):
    """Corrections as rules: the classes, how many indicators, and how many a document must hold."""
    rules = LN.override_rules(A.learning_feedback(spark, sf))
    return rules.select("seq", "rule_from", "rule_to", F.size("indicators").alias("n"),
                        F.md5(F.array_join("indicators", " ")).alias("digest"))


_RULES = f"""WITH {LEARNING}, I AS (SELECT *, {all_words('feedback_notes')} AS ind FROM L WHERE NOT approved)
SELECT seq, original_classification AS rule_from, corrected_classification AS rule_to, len(ind) AS n,
  md5(array_to_string(ind, ' ')) AS digest FROM I WHERE len(ind) >= 3"""


def _nested(spark, sf):
    """Corrections completed from nested verdicts."""
    feedback = A.learning_feedback(spark, sf).where(~F.col("approved"))
    bare = FB.rejection(
        feedback.select("document_id", "corrected_classification", F.lit("").alias("notes"),
                        "timestamp"), "reviewer")
    return FB.intake(bare, A.verdicts(spark, sf))


def _context(df: DataFrame) -> DataFrame:
    c = F.col("document_context")
    counts = F.array_sort(F.transform(
        F.map_entries(c["text_segments_summary"]["classifications"]),
        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    return df.select(
        "document_id", c["filename"].alias("filename"), c["page_count"].alias("page_count"),
        c["original_classification"].alias("original_classification"),
        F.array_join(F.transform(c["key_evidence"], lambda e: e["quote"]), "|").alias("quotes"),
        c["text_segments_summary"]["total"].alias("segments"),
        F.array_join(counts, ",").alias("segment_counts"),
        F.array_join(c["keywords"], ",").alias("keywords"),
    )

_SEG_LEARNING = LEARNING + SEGMENTS[SEGMENTS.index(",\nSEG AS"):]
_KEYS = all_words("k.full_text")

_CONTEXT_SQL = f"""WITH {_SEG_LEARNING},
C AS (SELECT document_id, classification, count(*) AS n FROM SEG GROUP BY ALL),
G AS (SELECT document_id, string_agg(classification || '=' || n, ',' ORDER BY classification || '=' || n)
        AS segment_counts, sum(n) AS segments FROM C GROUP BY ALL),
E AS (SELECT document_id, string_agg(text, '|' ORDER BY i) AS quotes FROM SEG GROUP BY ALL)
SELECT k.document_id, k.filename, k.page_count, k.classification AS original_classification,
  coalesce(quotes, '') AS quotes, CAST(coalesce(segments, 0) AS BIGINT) AS segments,
  coalesce(segment_counts, '') AS segment_counts,
  array_to_string({_KEYS}, ',') AS keywords
FROM L JOIN K k USING (document_id) LEFT JOIN G USING (document_id) LEFT JOIN E USING (document_id)
WHERE NOT L.approved"""


def _indicators(df: DataFrame) -> DataFrame:
    return df.select("document_id", F.array_join("key_indicators", ",").alias("key_indicators"))


_SEGWORDS = first_words("text", 3)
_INDICATORS = f"""WITH {_SEG_LEARNING},
S AS (SELECT document_id, flatten(list({_SEGWORDS} ORDER BY i)) AS w FROM SEG
      WHERE classification = 'Confidential' GROUP BY ALL),
T AS (SELECT k.document_id, list_concat({_KEYS}, coalesce(S.w, [])) AS w
      FROM L JOIN K k USING (document_id) LEFT JOIN S USING (document_id) WHERE NOT L.approved)
SELECT document_id, array_to_string(list_filter(w, lambda x, p: list_position(w, x) = p), ',') AS key_indicators FROM T"""

_INSTRUCTIONS = f"""WITH {_SEG_LEARNING},
S AS (SELECT document_id, count(*) FILTER (WHERE classification = 'Confidential') AS n,
        bool_or(contains(lower(text), 'company')) AS company FROM SEG GROUP BY ALL)
SELECT k.document_id, md5(concat(
  'LEARNING INSTRUCTION:', chr(10), 'When you see documents similar to ''', k.filename, ''':', chr(10), chr(10),
  'ORIGINAL MISTAKE: Classified as ''', k.classification, ''' but should be ''', L.corrected_classification,
  '''', chr(10), chr(10), 'KEY LESSON: Reclassified to ', L.corrected_classification, chr(10), chr(10),
  'WHAT TO LOOK FOR:', chr(10),
  CASE WHEN company THEN chr(10) || '- Company/organization names in document headers → Likely Confidential internal docs' ELSE '' END,
  CASE WHEN n >= 2 THEN chr(10) || '- Multiple segments classified as Confidential (' || n || ' found) → Overall doc is Confidential' ELSE '' END,
  chr(10), chr(10), 'CORRECT CLASSIFICATION RULE:', chr(10), 'Documents like this with ', n,
  ' confidential segments containing ', chr(10),
  'internal company information, procedures, or registration numbers should be classified as ''',
  L.corrected_classification, ''', ', chr(10), 'not ''', k.classification, '''.', chr(10), chr(10),
  'APPLY THIS: When you see similar patterns (company docs, N-numbers, internal procedures), ', chr(10),
  'classify as ''', L.corrected_classification, ''' with high confidence.')) AS instruction
FROM L JOIN K k USING (document_id) JOIN S USING (document_id) WHERE NOT L.approved"""


def _enhancements(n: DataFrame) -> DataFrame:
    return LN.prompt_enhancements(P.frequent_misclassifications(n), P.context_patterns(n))


def _lead_in(n: DataFrame) -> DataFrame:
    return LN.learned_lead_in(_enhancements(n), P.accuracy_by_class(n), FB.learned_examples(n))


_EXAMPLES = f"""SELECT human_classification AS classification,
  row_number() OVER (PARTITION BY human_classification ORDER BY seq) AS rank, document_id, filename,
  reasoning, CASE WHEN original_classification IS NOT DISTINCT FROM human_classification
  THEN 'high' ELSE 'corrected' END AS confidence FROM N"""


def _keyword_patterns(s, sf):
    return _rounded(P.keyword_patterns(FB.normalize_feedback(
        _rules_input(A.learning_feedback(s, sf)))), "confidence_multiplier")


_KEYWORD_PATTERNS = f"""WITH {_RULE_NORMALIZED}, {_KEYWORDS}
        SELECT keyword, correction_count, round(confidence_multiplier, 6) AS confidence_multiplier,
        KC.original_classification AS common_from, KC.human_classification AS common_to,
        KC.n AS common_count, first[1] AS first_seq, first[2] AS first_pos
        FROM KW JOIN KC USING (keyword)"""


def _patterns(n: DataFrame, **limits) -> DataFrame:
    return P.context_patterns(n, **limits).withColumn("common_indicators", F.array_join("common_indicators", ","))


_PATTERNS = f"""WITH {NORMALIZED}, {_CONTEXT}
        SELECT {PAIR}, frequency, first_seq,
        array_to_string(found, ',') AS common_indicators,
        'Documents with ''' || array_to_string(list_slice(found, 1, 3), ', ') || ''' are often '
        || coalesce(human_classification, 'None') || ', not '
        || coalesce(original_classification, 'None') AS rule FROM PT"""

_COMMON = f"WITH {NORMALIZED}, {_WORDS} SELECT {PAIR}, rank, word, n FROM WT"


def _examples(n: DataFrame) -> DataFrame:
    return FB.learned_examples(n).drop("timestamp")


_FIRST_EXAMPLES = f"WITH {NORMALIZED}, E AS ({_EXAMPLES}) SELECT * FROM E WHERE rank <= 3"


def _search(l: DataFrame) -> DataFrame:
    return FB.search(l.drop("key_indicators"), ["LICENSE", "reviewer3"]).select("document_id")


_FOUND = f"""WITH {LEARNING} SELECT document_id FROM L WHERE contains(lower(feedback_notes), 'license')
        OR reviewer_id = 'reviewer3'"""


def _export(l: DataFrame) -> DataFrame:
    return FB.training_export(l).withColumn("keywords", F.array_join("keywords", ","))


_EXPORTED = f"""WITH {LEARNING} SELECT '' AS document_summary,
        array_to_string({all_words('feedback_notes')}, ',') AS keywords, original_classification,
        corrected_classification AS correct_classification, '' AS learning_instruction,
        '' AS reasoning FROM L WHERE NOT approved"""

QUERIES = {
    "j02_union_feedback": (
        _learning(_union),
        f"""WITH {LEARNING} SELECT document_id, reviewer_id, approved FROM L WHERE document_id % 3 <> 0
        UNION ALL SELECT document_id, reviewer_id, approved FROM L
        WHERE document_id % 2 = 0 AND document_id % 3 = 0"""),
    "j03_upsert_learning": (
        _learning(_upsert),
        f"""WITH {LEARNING} SELECT document_id, CASE WHEN document_id % 2 = 0 THEN 'again'
        ELSE reviewer_id END AS reviewer_id, document_id % 2 = 0 OR approved AS approved FROM L
        WHERE document_id % 3 <> 0 OR document_id % 2 = 0"""),
    "j04_apply_feedback": (_apply, _APPLIED),
    "j05_keyword_rules": (_adjust, _ADJUSTED),
    "j05_keyword_factors": (_keyword_hits, _HITS),
    "l01_adjusted_confidence": (_adjust, _ADJUSTED),
    "j06_correction_rules": (_override, _OVERRIDDEN),
    "j06_rule_indicators": (_rules, _RULES),
    "l02_learned_override": (_override, _OVERRIDDEN),
    "a21_correction_rate": (
        _normalized(lambda n: _rounded(P.correction_rate(n), "correction_rate")),
        f"""WITH {NORMALIZED} SELECT count(*) AS total_feedback_count,
        (SELECT count(*) FROM X) AS corrections,
        round((SELECT count(*) FROM X) / count(*), 6) AS correction_rate FROM N"""),
    "a22_accuracy_by_class": (
        _normalized(lambda n: _rounded(P.accuracy_by_class(n), "accuracy")),
        f"""WITH {NORMALIZED}, ACC AS ({_ACCURACY})
        SELECT * REPLACE (round(accuracy, 6) AS accuracy) FROM ACC"""),
    "a23_frequent_misclassifications": (
        _normalized(lambda n: _rounded(P.frequent_misclassifications(n), "percentage")),
        f"""WITH {NORMALIZED} SELECT {PAIR}, count(*) AS count, min(seq) AS first_seq,
        round(count(*) / (SELECT count(*) FROM N) * 100, 6) AS percentage FROM X GROUP BY ALL
        ORDER BY count DESC, first_seq LIMIT 10"""),
    "a24_keyword_patterns": (_keyword_patterns, _KEYWORD_PATTERNS),
    "a25_context_patterns": (_normalized(_patterns), _PATTERNS),
    "a26_common_words": (_normalized(P.common_words), _COMMON),
    "a27_learning_summary": (
        _normalized(P.learning_summary),
        f"""WITH {NORMALIZED}, {_KEYWORDS}
        SELECT count(*) AS total_feedback,
        printf('%.1f%%', (SELECT count(*) FROM X) / count(*) * 100) AS correction_rate,
        (SELECT count(*) FROM (SELECT {PAIR} FROM X GROUP BY ALL HAVING count(*) >= 2)) AS patterns_learned,
        (SELECT count(*) FROM KW) AS keywords_tracked,
        (SELECT CAST(sum(n) AS BIGINT) FROM (SELECT least(count(*), 3) AS n FROM N
          GROUP BY human_classification)) AS examples_available FROM N"""),
    "a28_feedback_context": (lambda s, sf: _context(_nested(s, sf)), _CONTEXT_SQL),
    "a29_key_indicators": (lambda s, sf: _indicators(_nested(s, sf)), _INDICATORS),
    "l05_learning_instructions": (
        lambda s, sf: _nested(s, sf).select(
            "document_id", F.md5("learning_instruction").alias("instruction")), _INSTRUCTIONS),
    "l03_prompt_enhancements": (
        _normalized(lambda n: _enhancements(n).select("key", "text")),
        f"""WITH {NORMALIZED}, {_CONTEXT},
        FM AS (SELECT {PAIR}, count(*) AS n, min(seq) AS f,
          count(*) / (SELECT count(*) FROM N) * 100 AS pct FROM X GROUP BY ALL
          ORDER BY n DESC, f LIMIT 3),
        FW AS (SELECT * FROM FM QUALIFY row_number() OVER (PARTITION BY original_classification
          ORDER BY n, f DESC) = 1)
        SELECT 'warning_' || original_classification AS key,
        '⚠️ LEARNED PATTERN: Documents initially classified as ''' || original_classification
        || ''' have been corrected to ''' || human_classification || ''' ' || n || ' times ('
        || printf('%.1f', pct) || '% of feedback). Carefully verify this classification.' AS text FROM FW
        UNION ALL SELECT 'rule_' || original_classification || '_to_' || human_classification,
        'Documents with ''' || array_to_string(list_slice(found, 1, 3), ', ') || ''' are often '
        || human_classification || ', not ' || original_classification
        FROM (SELECT * FROM PT ORDER BY first_seq LIMIT 3)"""),
    "l04_learned_lead_in": (_normalized(_lead_in), None),
    "l06_quick_reviews": (
        _learning(lambda l: FB.approval(l.where("approved")).unionByName(
            FB.rejection(l.where("not approved").withColumn("notes", F.lit(""))))
            .select("document_id", "approved", "corrected_classification", "feedback_notes")),
        f"""WITH {LEARNING} SELECT document_id, approved, corrected_classification,
        CASE WHEN approved THEN 'Quick approval - classification correct'
        ELSE 'Reclassified to ' || corrected_classification END AS feedback_notes FROM L"""),
    "l07_feedback_intake": (
        lambda s, sf: _nested(s, sf).select(
            "document_id", "original_classification", "corrected_classification", "feedback_notes",
            F.col("learning_instruction").isNotNull().alias("has_instruction")),
        f"""WITH {LEARNING} SELECT document_id, original_classification, corrected_classification,
        'Reclassified to ' || corrected_classification AS feedback_notes,
        true AS has_instruction FROM L WHERE NOT approved"""),
    "r02_learned_examples": (_normalized(_examples), _FIRST_EXAMPLES),
    "r03_few_shot": (
        _normalized(lambda n: FB.few_shot(FB.learned_examples(n), "Confidential", 2).select(
            "document_id", "filename", "confidence")),
        f"""WITH {NORMALIZED}, E AS ({_EXAMPLES}) SELECT document_id, filename, confidence FROM E
        WHERE classification = 'Confidential' AND rank <= 2"""),
    "u01_few_shot_all_classes": (
        _normalized(lambda n: FB.few_shot_all(FB.learned_examples(n)).select(
            "classification", "rank", "document_id")),
        f"""WITH {NORMALIZED}, E AS ({_EXAMPLES}) SELECT classification, rank, document_id FROM E
        WHERE rank <= 2 AND classification IN ('Public', 'Confidential', 'Highly Sensitive', 'Unsafe')"""),
    "r04_recent_learning": (
        _learning(lambda l: FB.recent(l).select("document_id", "timestamp")),
        f"""WITH {LEARNING} SELECT document_id, CAST(review_date AS VARCHAR) AS timestamp FROM L
        ORDER BY timestamp DESC, seq LIMIT 10"""),
    "u02_by_corrected_class": (
        _learning(lambda l: FB.by_corrected_class(l, "Highly Sensitive").select(
            "document_id", "original_classification")),
        f"""WITH {LEARNING} SELECT document_id, original_classification FROM L
        WHERE corrected_classification = 'Highly Sensitive'"""),
    "u03_keyword_search": (_learning(_search), _FOUND),
    "u04_training_export": (_learning(_export), _EXPORTED),
    "u05_feedback_history": (
        _learning(lambda l: FB.feedback_history(_two_reviews(l), 4).select(
            "document_id", "reviewer_id", "approved")),
        f"""WITH {LEARNING}, R AS (SELECT document_id, reviewer_id, approved FROM L UNION ALL
        SELECT document_id, 'second', false FROM L WHERE document_id % 4 = 0)
        SELECT * FROM R WHERE document_id = 4"""),
}
