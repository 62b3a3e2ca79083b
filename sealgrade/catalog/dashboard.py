"""Dashboard, error mining and quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sealgrade.catalog.common import K, LEARNING, SEGMENTS, all_words
from sealgrade.operators import dashboard as D, mining as M, verdicts as VD
from sealgrade.session import stage
from sealgrade.sources import adapters as A


def _verdicts(fn):
    return lambda spark, sf: fn(A.classifications(spark, sf))


def _learning(fn):
    return lambda spark, sf: fn(A.learning_feedback(spark, sf))


def _both(fn):
    return lambda spark, sf: fn(A.classifications(spark, sf), A.learning_feedback(spark, sf))


def _features(spark, sf):
    return M.error_features(A.verdicts(spark, sf))


def _clustered(spark, sf):
    """k-means over corrected documents; the features are stored once, since each
    iteration reads them."""
    features = M.with_review_flag(
        M.join_corrections(_features(spark, sf), M.corrected(A.learning_feedback(spark, sf)))
    )
    return M.cluster(stage(features))[1]


def _given(spark, sf):
    """All documents in clusters known beforehand, so that the cluster reports can
    be checked; every second one is in cluster 0."""
    doc = F.col("document_id")
    return _features(spark, sf).withColumn(
        "cluster", F.when(doc % 2 == 0, 0).otherwise((doc % 9).cast("int")))


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


_A01 = f"""{K},
A01 AS (
  SELECT document_id, classification, confidence, coalesce(requires_review, false) AS requires_review,
    segment_count, segment_count AS evidence_count,
    CAST(document_id % 4 = 0 AS INTEGER) AS has_additional_labels,
    CAST(NOT is_safe AS INTEGER) AS is_unsafe
  FROM K)"""

_GIVEN = f"""{_A01},
G AS (SELECT *, CASE WHEN document_id % 2 = 0 THEN 0 ELSE document_id % 9 END AS cluster FROM A01)"""

_EVIDENCE = f"""WITH {K} SELECT document_id, i + 1 AS page, count(*) AS evidence_count,
        CASE WHEN max(CAST((document_id + i) % 3 = 0 AS INTEGER)) = 1 THEN 'Confidential'
        ELSE 'Public' END AS highest_sensitivity
        FROM K, unnest(range(0, segment_count)) AS u(i) GROUP BY ALL"""

QUERIES = {
    "a03_cluster_summary_given_clusters": (
        lambda s, sf: M.cluster_summary(_given(s, sf)),
        f"""WITH {_GIVEN} SELECT cluster, count(*) AS doc_count,
        round(avg(confidence), 4) AS avg_confidence, round(avg(segment_count), 2) AS avg_segments,
        CAST(sum(is_unsafe) AS BIGINT) AS unsafe_count FROM G GROUP BY cluster"""),
    "a04_class_patterns_given_clusters": (
        lambda s, sf: M.class_patterns(_given(s, sf)),
        f"""WITH {_GIVEN} SELECT classification, cluster, count(*) AS count,
        round(avg(confidence), 4) AS avg_confidence FROM G GROUP BY classification, cluster"""),
    "c08_top_patterns_given_clusters": (
        lambda s, sf: M.top_patterns(
            M.class_patterns(_given(s, sf)), 5, order=("classification", "cluster")),
        f"""WITH {_GIVEN} SELECT classification, cluster, count(*) AS count,
        round(avg(confidence), 4) AS avg_confidence FROM G GROUP BY classification, cluster
        ORDER BY count DESC, classification, cluster LIMIT 5"""),
    "a05_training_examples_given_clusters": (
        lambda s, sf: M.training_examples(_given(s, sf)),
        f"""WITH {_GIVEN} SELECT cluster, document_id, classification, confidence, segment_count,
        count(*) OVER (PARTITION BY cluster) AS count FROM G"""),
    "r01_representatives_given_clusters": (
        lambda s, sf: M.representatives(_given(s, sf)),
        f"""WITH {_GIVEN} SELECT cluster, row_number() OVER (PARTITION BY cluster ORDER BY document_id)
        AS rank, document_id, classification, confidence, segment_count FROM G QUALIFY rank <= 3"""),
    "a01_error_features": (_features, f"WITH {_A01} SELECT * FROM A01"),
    "a02_corrections": (
        _learning(M.corrected),
        f"""WITH {LEARNING} SELECT document_id, original_classification, corrected_classification,
        coalesce(feedback_notes, 'No notes') AS feedback_notes FROM L WHERE approved = false"""),
    "a03_cluster_summary": (lambda s, sf: M.cluster_summary(_clustered(s, sf)), None),
    "a04_class_patterns": (lambda s, sf: M.class_patterns(_clustered(s, sf)), None),
    "a05_training_examples": (lambda s, sf: M.training_examples(_clustered(s, sf)), None),
    "a06_class_distribution": (
        _verdicts(D.class_distribution),
        f"""WITH {K} SELECT classification, count(*) AS total_documents,
        round(avg(confidence), 4) AS avg_confidence,
        count(*) FILTER (WHERE requires_review) AS review_needed,
        count(*) FILTER (WHERE NOT is_safe) AS unsafe_count FROM K GROUP BY classification"""),
    "a07_confidence_levels": (
        _verdicts(D.confidence_levels),
        f"""WITH {K} SELECT classification, CASE WHEN confidence >= 0.98 THEN 'Very High'
        WHEN confidence >= 0.90 THEN 'High' WHEN confidence >= 0.80 THEN 'Medium'
        ELSE 'Low' END AS confidence_level, count(*) AS count FROM K GROUP BY ALL"""),
    "a08_correction_matrix": (
        _learning(D.correction_matrix),
        f"""WITH {LEARNING} SELECT original_classification, corrected_classification,
        count(*) AS correction_count FROM L GROUP BY ALL"""),
    "a08_correction_matrix_corrections_only": (
        _learning(lambda l: D.correction_matrix(l, corrections_only=True)),
        f"""WITH {LEARNING} SELECT original_classification, corrected_classification,
        count(*) AS correction_count FROM L WHERE corrected_classification IS NOT NULL GROUP BY ALL"""),
    "a09_class_summary": (
        _verdicts(D.class_summary),
        f"""WITH {K} SELECT classification, count(*) AS total_docs,
        round(avg(confidence), 3) AS avg_confidence FROM K GROUP BY classification"""),
    "a10_high_confidence": (
        _verdicts(D.high_confidence),
        f"""WITH {K} SELECT classification, count(*) AS high_confidence_count FROM K
        WHERE confidence >= 0.98 GROUP BY classification"""),
    "a11_safety_summary": (
        _verdicts(D.safety_summary),
        f"""WITH {K} SELECT classification, count(*) AS total,
        count(*) FILTER (WHERE NOT is_safe) AS unsafe_count,
        round(count(*) FILTER (WHERE NOT is_safe) * 100.0 / count(*), 2) AS unsafe_percentage
        FROM K GROUP BY classification"""),
    "a12_kpis": (
        _verdicts(lambda v: _rounded(D.kpis(v).drop("timestamp"), "value")),
        f"""WITH {K}, T AS (SELECT CAST(count(*) AS DOUBLE) AS total_documents,
        avg(confidence) AS avg_confidence,
        count(*) FILTER (WHERE confidence >= 0.98) / count(*) AS high_confidence_rate,
        count(*) FILTER (WHERE requires_review) / count(*) AS review_rate FROM K)
        SELECT metric, round(value, 6) AS value FROM (UNPIVOT T ON COLUMNS(*)
        INTO NAME metric VALUE value)"""),
    "a13_estimated_accuracy": (
        _both(lambda v, l: _rounded(D.estimated_accuracy(v, l), "estimated_accuracy")),
        f"""WITH {LEARNING}, T AS (SELECT (SELECT count(*) FROM K) AS total_documents,
        (SELECT count(*) FROM L WHERE NOT approved) AS corrections)
        SELECT *, round((total_documents - corrections) / total_documents * 100, 6)
        AS estimated_accuracy FROM T"""),
    "a14_class_counts": (
        _verdicts(D.class_counts),
        f"WITH {K} SELECT classification, count(*) AS count FROM K GROUP BY ALL"),
    "a15_confidence_histogram": (
        _verdicts(D.confidence_histogram),
        f"""WITH {K} SELECT floor(confidence * 10) / 10 AS confidence_bucket, count(*) AS count
        FROM K GROUP BY ALL"""),
    "a16_panel": (
        _verdicts(lambda v: _rounded(D.panel(v), "avg_confidence", "avg_processing_time")),
        f"""WITH {K} SELECT count(*) AS total_documents, round(avg(confidence), 6) AS avg_confidence,
        round(avg(processing_time), 6) AS avg_processing_time,
        count(*) FILTER (WHERE requires_review) AS needs_review,
        count(*) FILTER (WHERE NOT is_safe) AS unsafe_count,
        CAST(sum(page_count) AS BIGINT) AS total_pages,
        CAST(sum(image_count) AS BIGINT) AS total_images FROM K"""),
    "a17_segment_statistics": (
        lambda s, sf: D.segment_statistics(VD.segment_rows(A.verdicts(s, sf)), "Confidential"),
        f"""WITH {SEGMENTS} SELECT count(*) AS total,
        count(*) FILTER (WHERE classification = 'Public') AS public,
        count(*) FILTER (WHERE classification = 'Confidential') AS confidential,
        count(*) FILTER (WHERE classification = 'Highly Sensitive') AS highly_sensitive,
        count(*) FILTER (WHERE classification = 'Unsafe') AS unsafe,
        count(*) FILTER (WHERE classification = 'Confidential') AS shown FROM SEG"""),
    "a17_segments_at_level": (
        lambda s, sf: D.segments_at_level(VD.segment_rows(A.verdicts(s, sf)), "Highly Sensitive")
        .select("document_id", "page", "confidence"),
        f"""WITH {SEGMENTS} SELECT document_id, i + 1 AS page, confidence FROM SEG
        WHERE classification = 'Highly Sensitive'"""),
    "a18_review_statistics": (
        _both(lambda v, l: _rounded(D.review_statistics(v, l), "review_rate", "pending_rate")),
        f"""WITH {LEARNING} SELECT count(*) AS total_classifications,
        count(*) FILTER (WHERE requires_review) AS pending_reviews,
        (SELECT count(*) FROM L) AS total_reviews,
        round((SELECT count(*) FROM L) / count(*), 6) AS review_rate,
        round(count(*) FILTER (WHERE requires_review) / count(*), 6) AS pending_rate FROM K"""),
    "a19_feedback_statistics": (
        _learning(lambda l: _rounded(D.feedback_statistics(l), "approval_rate", "correction_rate")),
        f"""WITH {LEARNING} SELECT count(*) AS total_reviews,
        count(*) FILTER (WHERE approved) AS approved,
        count(corrected_classification) AS corrected,
        round(count(*) FILTER (WHERE approved) / count(*), 6) AS approval_rate,
        round(count(corrected_classification) / count(*), 6) AS correction_rate FROM L"""),
    "a19_correction_patterns": (
        _learning(D.correction_patterns),
        f"""WITH {LEARNING} SELECT concat(original_classification, ' -> ', corrected_classification)
        AS pattern, count(*) AS count FROM L WHERE corrected_classification IS NOT NULL GROUP BY ALL"""),
    "a20_learning_statistics": (
        _learning(D.learning_statistics),
        f"""WITH {LEARNING} SELECT count(*) AS total_entries,
        count(*) FILTER (WHERE NOT approved) AS corrections_count,
        count(*) FILTER (WHERE approved) AS approvals_count FROM L"""),
    "a20_corrected_distribution": (
        _learning(D.corrected_distribution),
        f"WITH {LEARNING} SELECT corrected_classification, count(*) AS count FROM L GROUP BY ALL"),
    "a30_daily_accuracy": (
        _learning(lambda l: _rounded(D.daily_accuracy(l, F.col("review_date")), "accuracy")),
        f"""WITH {LEARNING} SELECT original_classification AS classification, review_date AS date,
        round(avg(CASE WHEN approved THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
        count(*) AS total_reviews FROM L GROUP BY ALL"""),
    "a32_count_features": (
        lambda s, sf: M.count_features(A.verdicts(s, sf)),
        f"""WITH {K} SELECT document_id, classification, confidence, len({all_words('full_text')}) AS keyword_count,
        segment_count, page_count FROM K"""),
    "j01_misclassified_features": (
        lambda s, sf: M.join_corrections(
            _features(s, sf), M.corrected(A.learning_feedback(s, sf))),
        f"""WITH {_A01.replace(K, LEARNING)} SELECT A01.*, L.original_classification,
        L.corrected_classification, coalesce(L.feedback_notes, 'No notes') AS feedback_notes FROM A01 JOIN L USING (document_id) WHERE NOT approved"""),
    "j01_all_features": (
        lambda s, sf: M.join_corrections(
            _features(s, sf), M.corrected(A.learning_feedback(s, sf)), only_corrected=False
        ),
        f"""WITH {_A01.replace(K, LEARNING)} SELECT A01.*, x.original_classification, x.corrected_classification,
        x.feedback_notes
        FROM A01 LEFT JOIN (SELECT * FROM L WHERE NOT approved) x USING (document_id)"""),
    "k01_k02_scaled_features": (
        lambda s, sf: _rounded(M.scaled_features(M.with_review_flag(_features(s, sf))), *M.CLUSTER_COLUMNS),
        f"""WITH {_A01}, F AS (SELECT document_id, confidence::DOUBLE AS confidence, segment_count::DOUBLE AS segment_count,
          evidence_count::DOUBLE AS evidence_count, has_additional_labels::DOUBLE AS has_additional_labels,
          is_unsafe::DOUBLE AS is_unsafe, CASE WHEN requires_review THEN 1.0 ELSE 0.0 END::DOUBLE AS requires_review_int FROM A01
          WHERE confidence IS NOT NULL)
        SELECT document_id, """ + ", ".join(
            f"round(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER (), 6) AS {c}" for c in M.CLUSTER_COLUMNS) + " FROM F"),
    "k01_cluster_assignments": (
        lambda s, sf: _clustered(s, sf).select(
            "document_id", "classification", "confidence", "segment_count", "cluster"), None),
    "k04_potential_errors": (
        lambda s, sf: M.potential_errors(A.classifications(s, sf)).select(
            "document_id", "classification", "confidence", "segment_count"),
        f"""WITH {K} SELECT document_id, classification, confidence, segment_count FROM K
        WHERE confidence < 0.90 AND segment_count >= 2"""),
    "r01_representatives": (lambda s, sf: M.representatives(_clustered(s, sf)), None),
    "r05_review_queue": (
        _verdicts(D.review_queue),
        f"""WITH {K} SELECT document_id, filename, classification, confidence, is_safe FROM K
        WHERE coalesce(requires_review, false)"""),
    "r05_review_queue_counts": (
        _verdicts(D.review_queue_counts),
        f"""WITH {K} SELECT count(*) FILTER (WHERE requires_review) AS count,
        count(*) FILTER (WHERE requires_review AND NOT is_safe) AS unsafe_count FROM K"""),
    "r07_bar_chart": (
        _verdicts(D.bar_chart),
        f"WITH {K} SELECT document_id, filename, confidence FROM K ORDER BY document_id LIMIT 10"),
    "r08_ordered_matrix": (
        _learning(lambda l: D.correction_matrix(l).orderBy(F.desc("correction_count"))),
        f"""WITH {LEARNING} SELECT original_classification, corrected_classification,
        count(*) AS correction_count FROM L GROUP BY ALL ORDER BY correction_count DESC"""),
    "c01_class_quality": (
        _learning(lambda l: _rounded(D.class_quality(l), "precision", "recall")),
        f"""WITH {LEARNING}, P AS (SELECT original_classification AS p, coalesce(
        corrected_classification, CASE WHEN approved THEN original_classification END) AS h FROM L),
        C AS (SELECT DISTINCT c FROM (SELECT p AS c FROM P WHERE h IS NOT NULL UNION ALL
              SELECT h FROM P WHERE h IS NOT NULL)),
        T AS (SELECT c AS classification,
          (SELECT count(*) FROM P WHERE p = c AND h IS NOT NULL) AS predicted,
          (SELECT count(*) FROM P WHERE h = c) AS actual,
          (SELECT count(*) FROM P WHERE h = c AND p = c) AS correct FROM C)
        SELECT *, CASE WHEN predicted > 0 THEN round(correct / predicted, 6) END AS precision,
        CASE WHEN actual > 0 THEN round(correct / actual, 6) END AS recall FROM T"""),
    "c02_confidence_drift": (
        _learning(lambda l: _rounded(
            D.confidence_drift(l, F.col("review_date"), 0.9), "error_rate", "change")),
        f"""WITH {LEARNING}, D AS (SELECT review_date AS date, count(*) AS reviews,
        count(*) FILTER (WHERE NOT approved) AS errors FROM L WHERE confidence >= 0.9 GROUP BY ALL)
        SELECT a.date, a.reviews, a.errors, round(a.errors / a.reviews, 6) AS error_rate,
        round(a.errors / a.reviews - b.errors / b.reviews, 6) AS change
        FROM D a LEFT JOIN D b ON a.date = b.date + 1"""),
    "c03_running_accuracy": (
        _learning(lambda l: _rounded(D.running_accuracy(l).drop("approved"), "accuracy")),
        f"""WITH {LEARNING}, R AS (SELECT original_classification AS classification, seq,
        count(*) OVER w AS reviews,
        CAST(sum(CASE WHEN approved THEN 1 ELSE 0 END) OVER w AS BIGINT) AS correct FROM L
        WINDOW w AS (PARTITION BY original_classification ORDER BY seq ROWS UNBOUNDED PRECEDING))
        SELECT *, round(correct / reviews, 6) AS accuracy FROM R"""),
    "c04_class_terms": (
        lambda s, sf: _rounded(M.class_terms(A.classifications(s, sf), text="full_text"), "weight"),
        rf"""WITH {K}, W AS (SELECT document_id, classification, unnest(regexp_extract_all(
          lower(full_text), '[\p{{L}}\p{{N}}_]+')) AS term FROM K),
        T AS (SELECT classification, term, count(*) AS tf FROM W WHERE length(term) > 3 GROUP BY ALL),
        D AS (SELECT term, count(DISTINCT document_id) AS df FROM W WHERE length(term) > 3 GROUP BY ALL),
        S AS (SELECT classification, term, tf, df,
          tf * ln(((SELECT count(*) FROM K) + 1) / (df + 1)) AS weight FROM T JOIN D USING (term)),
        R AS (SELECT *, row_number() OVER (PARTITION BY classification ORDER BY weight DESC, term) AS rank
              FROM S)
        SELECT classification, term, tf, df, round(weight, 6) AS weight, rank FROM R WHERE rank <= 20"""),
    "c08_top_patterns": (
        lambda s, sf: M.top_patterns(
            M.class_patterns(_clustered(s, sf)), 50, order=("classification", "cluster")), None),
    "c09_confidence_trend": (
        _verdicts(lambda v: _rounded(D.confidence_trend(v, F.col("classified_on")), "avg_confidence")),
        f"""WITH {K} SELECT classified_on AS date, round(avg(confidence), 6) AS avg_confidence,
        count(*) AS documents FROM K GROUP BY ALL"""),
    "c10_evidence_by_page": (
        lambda s, sf: D.evidence_by_page(VD.evidence_rows(A.verdicts(s, sf))), _EVIDENCE),
}
