"""Source, sink and table queries. Tables are written to the shared scratch
folder, whole, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sealgrade import schemas as S
from sealgrade.catalog.common import K, LEARNING, NORMALIZED, SEGMENTS, all_words
from sealgrade.operators import verdicts as M
from sealgrade.plans.medallion import Lakehouse
from sealgrade.session import scratch_dir, stage
from sealgrade.sources import adapters as A, files, tables
from sealgrade.sources.tables import SnapshotTable

FLAT = ("document_id", "filename", "classification", "confidence", "requires_review", "is_safe")


def _flat(spark, sf) -> DataFrame:
    return A.classifications(spark, sf).select(*FLAT)


def _new(spark) -> SnapshotTable:
    return SnapshotTable(spark, scratch_dir(spark))


def _json_round_trip(spark, sf):
    path = scratch_dir(spark)
    A.verdicts(spark, sf).drop("full_text").withColumn(
        "document_id", F.col("document_id").cast("string")).write.json(path)
    back = files.read_verdicts(spark, path, one_per_file=False)
    return back.select(
        "document_id", "classification", "confidence", F.col("safety_check.is_safe").alias("is_safe"),
        F.size("text_segments").alias("segments"), F.size("evidence").alias("evidence"))


def _archive(spark, sf):
    path = scratch_dir(spark)
    A.learning_feedback(spark, sf).select(
        F.col("document_id").cast("string").alias("document_id"), "reviewer_id", "approved",
        "corrected_classification", "original_classification", "timestamp", "key_indicators",
    ).write.json(path)
    return files.read_feedback_archive(spark, path, one_per_file=False).select(
        "document_id", "reviewer_id", "approved", "corrected_classification", "timestamp")


def _learning_lines(spark, sf):
    path = scratch_dir(spark)
    entries = A.learning_feedback(spark, sf).withColumn("document_id", F.col("document_id").cast("string"))
    files.write_learning(entries.select("seq", *[c for c in S.FEEDBACK.names if c in entries.columns]), path)
    return files.read_learning(spark, path, one_per_file=False).select(
        "document_id", "seq", "approved", "corrected_classification", "feedback_notes", F.size("key_indicators").alias("n"))


def _sampled(spark, sf):
    """Verdicts of a source without any, with its stand-in."""
    none = A.classifications(spark, sf).where("document_id < 0").select("document_id", "filename", "classification", "confidence")
    none = none.withColumn("document_id", F.col("document_id").cast("string"))
    return files.or_sample(none, enabled=True).select("document_id", "filename", "classification", "confidence")


def _manifest(spark, sf):
    """Documents of each source in files of a folder; the manifest's sizes by folder."""
    path = scratch_dir(spark)
    A.table(spark, sf, "documents").select("source", F.coalesce("text", F.lit("")).alias("value")).write.partitionBy("source").text(path)
    listed = files.upload_manifest(spark, path).withColumn("source", F.regexp_extract("path", "source=([^/]+)/", 1))
    return listed.groupBy("source").agg(F.sum("file_size").alias("bytes"), F.max(F.col("filename").endswith(".txt")).alias("named"))


def _valid(spark, sf):
    """Every third summary is blank and every seventh missing."""
    d = F.col("document_id")
    v = _flat(spark, sf).withColumn(
        "summary", F.when(d % 7 == 0, F.lit(None)).when(d % 3 == 0, F.lit("")).otherwise(F.lit("s")))
    return files.valid_verdicts(v).select("document_id", "classification")


def _time_travel(spark, sf):
    t = _new(spark)
    v = _flat(spark, sf)
    t.overwrite(v)
    t.overwrite(v.where("is_safe").drop("is_safe"))
    return t.as_of(0)


def _history(spark, sf):
    t = _new(spark)
    v = _flat(spark, sf)
    t.overwrite(v)
    t.delete(v.where("not is_safe"))
    t.compact()
    return t.history().drop("timestamp")


def _deleted(spark, sf):
    t = _new(spark)
    v = _flat(spark, sf)
    t.overwrite(v)
    t.delete(v.where("not is_safe"))
    return t.read()


def _cleared(spark, sf):
    t = _new(spark)
    t.overwrite(_flat(spark, sf))
    uploads = A.table(spark, sf, "documents").where(F.col("doc_id") % 2 == 0)
    return t.clear(uploads, A.learning_feedback(spark, sf)).withColumn("left", F.lit(t.read().count()))


def _counted(spark, sf):
    """All verdicts' number beside their table, from its history."""
    t = _new(spark)
    t.overwrite(_flat(spark, sf))
    t.delete(_flat(spark, sf).where("not is_safe"))
    return t.read().agg(F.count("*").alias("rows"), F.min("document_id").alias("first")).withColumn("count", F.lit(t.count()))


def _compacted(spark, sf):
    t = _new(spark)
    t.overwrite(_flat(spark, sf).repartition(16))
    t.compact()
    return t.read()


def _changes(spark, sf):
    t = SnapshotTable(spark, scratch_dir(spark), buckets=16)
    v = _flat(spark, sf)
    doc = F.col("document_id")
    t.overwrite(v.where(doc % 5 != 0))
    t.overwrite(v.where(doc % 7 != 0).withColumn(
        "confidence", F.when(doc % 11 == 0, F.lit(0.0)).otherwise(F.col("confidence"))))
    return t.changes(0, 1)


def _found(spark, sf):
    t = SnapshotTable(spark, scratch_dir(spark), buckets=16)
    t.overwrite(_flat(spark, sf))
    return t.find(7, 8, 123)


def _few_changes(spark, sf):
    """Between a table and the same with some rows deleted and its small files joined."""
    t = SnapshotTable(spark, scratch_dir(spark), buckets=64)
    v = _flat(spark, sf)
    t.overwrite(v)
    t.delete(v.where(F.col("document_id") % 101 == 0))
    t.compact()
    return t.changes(0, 2)


def _merged(spark, sf):
    """Two versions with different columns in one table."""
    t = _new(spark)
    v = _flat(spark, sf)
    t.overwrite(v.select("document_id", "classification"))
    t.overwrite(v.select("document_id", "confidence"))
    return t.all_versions().select("v", "document_id", "classification", "confidence")


def _report(spark, sf):
    return tables.load_report({
        "classifications": _flat(spark, sf), "learning": A.learning_feedback(spark, sf),
    }, by="document_id").select(
        "table", "rows", F.get_json_object("sample", "$.document_id").alias("id"), F.get_json_object("sample", "$.filename").alias("name"))


def _lakehouse(spark, sf) -> Lakehouse:
    house = Lakehouse(spark, scratch_dir(spark))
    house.bronze(A.verdicts(spark, sf).drop("full_text"), A.learning_feedback(spark, sf))
    return house


def _silver(spark, sf, table):
    house = Lakehouse(spark, scratch_dir(spark))
    house.bronze(A.verdicts(spark, sf).drop("full_text"))
    house.silver([table])
    return house.table("silver", table).read()


def _followed(spark, sf, table):
    """A gold table brought up to date after documents came, went and were corrected."""
    house = Lakehouse(spark, scratch_dir(spark), buckets=4)
    doc = F.col("document_id")
    if table == "learning_effectiveness":
        l = stage(A.learning_feedback(spark, sf).select("document_id", "original_classification", "corrected_classification"))
        for batch in (l.where(doc % 3 > 0), l, l.where(doc % 4 != 0)):
            house.bronze(learning=batch)
            house.refresh_gold([table])
        return house.table("gold", table).read()
    v = stage(A.classifications(spark, sf).select(
        "document_id", "classification", "confidence", "requires_review", F.struct("is_safe").alias("safety_check")))
    house.bronze(v.where(doc % 5 != 4))
    house.refresh_gold([table])
    house.table("bronze", "classifications").delete(v.where(doc % 13 == 0))
    house.refresh_gold([table])
    house.bronze(v.where(doc % 13 != 0).withColumns({
        "classification": F.when(doc % 10 == 0, "Unsafe").otherwise(F.col("classification")),
        "confidence": F.when(doc % 17 == 0, 0.985).when(doc % 19 == 0, F.lit(None)).otherwise(F.col("confidence"))}))
    house.refresh_gold([table])
    return house.table("gold", table).read()


_FINAL = f"""{LEARNING}, V AS (SELECT document_id, requires_review, is_safe,
    CASE WHEN document_id % 10 = 0 THEN 'Unsafe' ELSE classification END AS classification,
    CASE WHEN document_id % 17 = 0 THEN 0.985 WHEN document_id % 19 = 0 THEN NULL ELSE confidence END AS confidence
  FROM K WHERE document_id % 13 <> 0)"""


def _gold(spark, sf, table):
    house = _lakehouse(spark, sf)
    house.gold([table])
    return house.table("gold", table).read()


def _mined(spark, sf):
    house = _lakehouse(spark, sf)
    house.mine()
    return house.table("silver", "training_examples").read()


def _sql(spark, sf):
    tables.register_views({"sealgrade_classifications": _flat(spark, sf)})
    return spark.sql(
        "SELECT classification, count(*) AS total_docs, round(avg(confidence), 3) AS avg_confidence "
        "FROM sealgrade_classifications GROUP BY classification ORDER BY total_docs DESC")


_SUFFIXES = ("txt", "PDF", "exe", "docx", "zip", "Jpeg")


def _uploads(spark, sf):
    d = A.documents(spark, sf)
    kinds = F.array(*[F.lit(s) for s in _SUFFIXES])
    stem = F.regexp_replace("filename", "txt$", "")
    named = d.select(
        "document_id", F.concat(stem, F.get(kinds, (F.col("document_id") % 6).cast("int"))).alias("filename"),
        (F.col("file_size") * 10_000).alias("file_size"))
    return files.validate_uploads(named)


_HEADS = ("89504E470D0A1A0A", "FFD8FFE0", "474946383961", "52494646AABBCCDD57454250", "424D", "49492A00",
          "4D4D002A", "00", "52494646AABBCCDD57415645")


def _images(spark, sf):
    """Documents' texts as file contents behind known leading bytes."""
    d = A.documents(spark, sf)
    heads = F.array(*[F.lit(h) for h in _HEADS])
    head = F.unhex(F.get(heads, (F.col("document_id") % len(_HEADS)).cast("int")))
    content = F.concat(head, F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    return d.select("document_id", files.image_type(content).alias("mime"))


def _named(spark, sf):
    d = A.documents(spark, sf)
    side = d.where(F.col("document_id") % 2 == 0).select(
        "document_id", F.concat(F.lit("original "), "filename").alias("original_filename"))
    return files.with_original_names(d.select("document_id", "filename"), side)


_FLAT_SQL = "SELECT document_id, filename, classification, confidence, requires_review, is_safe FROM K"

_EVIDENCE = f"""WITH {SEGMENTS} SELECT document_id, i AS pos, i + 1 AS page,
        CASE WHEN (document_id + i) % 3 = 0 THEN 'Confidential' ELSE 'Public' END AS sensitivity_level
        FROM SEG"""

_LEVEL = """CASE WHEN confidence >= 0.98 THEN 'Very High' WHEN confidence >= 0.90 THEN 'High'
        WHEN confidence >= 0.80 THEN 'Medium' ELSE 'Low' END"""

_KPIS = """, O AS (SELECT CAST(count(*) AS DOUBLE) AS total_documents, avg(confidence) AS avg_confidence,
    count(*) FILTER (WHERE confidence >= 0.98) / count(*) AS high_confidence_rate,
    count(*) FILTER (WHERE requires_review) / count(*) AS review_rate FROM V)
SELECT 'total_documents' AS metric, total_documents AS value FROM O
UNION ALL SELECT 'avg_confidence', round(avg_confidence, 6) FROM O
UNION ALL SELECT 'high_confidence_rate', round(high_confidence_rate, 6) FROM O
UNION ALL SELECT 'review_rate', round(review_rate, 6) FROM O"""

QUERIES = {
    "s01_verdict_files": (
        _json_round_trip,
        f"""WITH {K} SELECT CAST(document_id AS VARCHAR) AS document_id, classification, confidence,
        is_safe, segment_count AS segments, segment_count AS evidence FROM K"""),
    "s02_learning_entries": (
        _learning_lines,
        f"""WITH {LEARNING} SELECT CAST(document_id AS VARCHAR) AS document_id, seq, approved, corrected_classification,
        feedback_notes, len({all_words('feedback_notes')}) AS n FROM L"""),
    "s06_sample_of_an_empty_source": (
        _sampled,
        """SELECT 'sample_001' AS document_id, 'sample_document.pdf' AS filename, 'Public' AS classification, 0.95::DOUBLE AS confidence
        WHERE NOT EXISTS (SELECT 1 FROM documents WHERE doc_id < 0)"""),
    "s15_upload_manifest": (
        _manifest,
        """SELECT source, CAST(sum(octet_length(encode(coalesce(text, ''))) + 1) AS BIGINT) AS bytes, true AS named
        FROM documents GROUP BY source"""),
    "s03_feedback_archive": (
        _archive,
        f"""WITH {LEARNING} SELECT CAST(document_id AS VARCHAR) AS document_id, reviewer_id, approved,
        corrected_classification, CAST(review_date AS VARCHAR) AS timestamp FROM L"""),
    "s04_valid_verdicts": (
        _valid,
        f"""WITH {K} SELECT document_id, classification FROM K
        WHERE document_id % 7 <> 0 AND document_id % 3 <> 0"""),
    "s05_s10_time_travel": (_time_travel, f"WITH {K} {_FLAT_SQL}"),
    "s07_load_report": (
        _report,
        f"""WITH {LEARNING} SELECT 'classifications' AS "table", count(*) AS rows,
        CAST(min(document_id) AS VARCHAR) AS id, arg_min(filename, document_id) AS name FROM K
        UNION ALL SELECT 'learning', count(*), CAST(min(document_id) AS VARCHAR), arg_min(filename, document_id) FROM L"""),
    "s08_compacted": (_compacted, f"WITH {K} {_FLAT_SQL}"),
    "s09_history": (
        _history,
        f"""WITH {K} SELECT 0 AS version, 'WRITE' AS operation, count(*) AS num_rows FROM K
        UNION ALL SELECT 1, 'DELETE', count(*) FROM K WHERE is_safe
        UNION ALL SELECT 2, 'OPTIMIZE', count(*) FROM K WHERE is_safe"""),
    "s11_silver_segments": (
        lambda s, sf: _silver(s, sf, "segments").select(
            "document_id", "pos", "classification", "confidence", "page"),
        f"""WITH {SEGMENTS} SELECT document_id, i AS pos, classification, confidence, i + 1 AS page
        FROM SEG"""),
    "s11_silver_evidence": (
        lambda s, sf: _silver(s, sf, "evidence").select("document_id", "pos", "page", "sensitivity_level"),
        _EVIDENCE),
    "s12_silver_training_examples": (_mined, None),
    "s13_gold_distribution": (
        lambda s, sf: _gold(s, sf, "classification_distribution"),
        f"""WITH {K} SELECT classification, count(*) AS total_documents,
        round(avg(confidence), 4) AS avg_confidence,
        count(*) FILTER (WHERE requires_review) AS review_needed,
        count(*) FILTER (WHERE NOT is_safe) AS unsafe_count FROM K GROUP BY classification"""),
    "s13_gold_levels": (
        lambda s, sf: _gold(s, sf, "confidence_analysis"),
        f"""WITH {K} SELECT classification, {_LEVEL} AS confidence_level, count(*) AS count FROM K GROUP BY ALL"""),
    "s13_gold_corrections": (
        lambda s, sf: _gold(s, sf, "learning_effectiveness"),
        f"""WITH {LEARNING} SELECT original_classification, corrected_classification, count(*) AS correction_count
        FROM L GROUP BY ALL"""),
    "s13_gold_kpis": (
        lambda s, sf: _gold(s, sf, "kpis").select("metric", F.round("value", 6).alias("value")),
        f"WITH {K}, V AS (SELECT * FROM K) {_KPIS}"),
    "c08_gold_misclassifications": (
        lambda s, sf: _gold(s, sf, "misclassifications").select("original_classification", "human_classification", "count"),
        f"""WITH {NORMALIZED} SELECT original_classification, human_classification, count(*) AS count FROM X GROUP BY ALL"""),
    "s13_gold_from_changes": (
        lambda s, sf: _followed(s, sf, "classification_distribution"),
        f"""WITH {_FINAL} SELECT classification, count(*) AS total_documents, round(avg(confidence), 4) AS avg_confidence,
        count(*) FILTER (WHERE requires_review) AS review_needed,
        count(*) FILTER (WHERE NOT is_safe) AS unsafe_count FROM V GROUP BY classification"""),
    "a08_corrections_from_changes": (
        lambda s, sf: _followed(s, sf, "learning_effectiveness"),
        f"""WITH {_FINAL} SELECT original_classification, corrected_classification, count(*) AS correction_count
        FROM L WHERE document_id % 4 <> 0 GROUP BY ALL"""),
    "a12_kpis_from_changes": (
        lambda s, sf: _followed(s, sf, "kpis").select("metric", F.round("value", 6).alias("value")), f"WITH {_FINAL} {_KPIS}"),
    "s14_sql_views": (
        _sql,
        f"""WITH {K} SELECT classification, count(*) AS total_docs,
        round(avg(confidence), 3) AS avg_confidence FROM K GROUP BY classification"""),
    "s16_validated_uploads": (
        _uploads,
        f"""WITH U AS (SELECT doc_id, concat(source, '_', lang, '_', CAST(doc_id AS VARCHAR), '.') AS stem,
          [{', '.join(f"'{s}'" for s in _SUFFIXES)}][doc_id % 6 + 1] AS sfx, n_chars * 10000 AS size FROM documents),
        T AS (SELECT *, lower(sfx) NOT IN ('exe', 'zip') AS known, size <= 52428800 AS small FROM U)
        SELECT CASE WHEN known AND small THEN CAST(doc_id AS VARCHAR) ELSE '' END AS document_id,
        stem || sfx AS filename, CASE WHEN known THEN size ELSE 0 END AS file_size,
        CASE WHEN known AND small THEN 'success' ELSE 'error' END AS status,
        CASE WHEN NOT known THEN 'Unsupported file format: .' || lower(sfx)
          WHEN NOT small THEN 'File too large: ' || size || ' bytes (max 52428800)'
          ELSE 'File uploaded successfully' END AS message FROM T"""),
    "s17_image_types": (
        _images,
        """SELECT doc_id AS document_id, CASE
        WHEN octet_length(encode(coalesce(text, '')))
          + [8, 4, 6, 12, 2, 4, 4, 1, 12][doc_id % 9 + 1] < 12 THEN 'image/png'
        ELSE ['image/png', 'image/jpeg', 'image/gif', 'image/webp', 'image/bmp', 'image/tiff', 'image/tiff',
          'image/png', 'image/png'][doc_id % 9 + 1] END AS mime FROM documents"""),
    "s18_fetch_verdict": (
        lambda s, sf: files.fetch(_flat(s, sf), 7), f"WITH {K} {_FLAT_SQL} WHERE document_id = 7"),
    "s18_verdict_by_id": (_found, f"WITH {K} {_FLAT_SQL} WHERE document_id IN (7, 8, 123)"),
    "s19_all_verdicts": (_flat, f"WITH {K} {_FLAT_SQL}"),
    "s20_deleted": (_deleted, f"WITH {K} {_FLAT_SQL} WHERE is_safe"),
    "s21_cleared": (
        _cleared,
        """SELECT count(*) AS deleted_results, count(*) FILTER (WHERE doc_id % 2 = 0) AS deleted_uploads,
        (SELECT count(*) FROM labels l JOIN documents d ON l.doc_id = d.doc_id) AS feedback_preserved, 0 AS "left" FROM documents"""),
    "s19_verdict_count": (
        _counted,
        f"""WITH {K} SELECT count(*) AS rows, min(document_id) AS first, count(*) AS count FROM K WHERE is_safe"""),
    "c06_changes_after_deletes": (_few_changes, f"WITH {K} SELECT document_id, 'delete' AS change FROM K WHERE document_id % 101 = 0"),
    "c06_changes": (
        _changes,
        f"""WITH {K}, O AS (SELECT document_id, confidence FROM K WHERE document_id % 5 <> 0),
        N AS (SELECT document_id, CASE WHEN document_id % 11 = 0 THEN 0.0 ELSE confidence END AS confidence
              FROM K WHERE document_id % 7 <> 0)
        SELECT coalesce(o.document_id, n.document_id) AS document_id,
        CASE WHEN o.document_id IS NULL THEN 'insert' WHEN n.document_id IS NULL THEN 'delete'
        ELSE 'update' END AS change FROM O o FULL JOIN N n USING (document_id)
        WHERE o.document_id IS NULL OR n.document_id IS NULL OR o.confidence <> n.confidence"""),
    "c06_merged_schema": (
        _merged,
        f"""WITH {K} SELECT 0 AS v, document_id, classification, NULL AS confidence FROM K
        UNION ALL SELECT 1, document_id, NULL, confidence FROM K"""),
    "j08_original_names": (
        _named,
        """SELECT doc_id AS document_id, CASE WHEN doc_id % 2 = 0 THEN 'original ' ELSE '' END
        || concat(source, '_', lang, '_', CAST(doc_id AS VARCHAR), '.txt') AS filename FROM documents"""),
}
