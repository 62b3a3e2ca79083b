"""File sources: verdict files, learning database, feedback archive, uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sealgrade import schemas as S, vocab as V

_CORRUPT = "_corrupt_record"
LEARNING_FILE = "learning_database.json"
FEEDBACK_FOLDER = "feedback"


def _read_json(
    spark: SparkSession, path: str, schema: StructType, one_per_file: bool = True
) -> DataFrame:
    wide = StructType(schema.fields + [StructField(_CORRUPT, StringType(), True)])
    return (
        spark.read.schema(wide).option("multiLine", one_per_file).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _CORRUPT).option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json").json(path)
        .withColumn("source_file", F.col("_metadata.file_path"))
        .withColumn("submitted_at", F.col("_metadata.file_modification_time"))
    )


def _readable() -> Column:
    """Records without a parse error. A query on the error column alone is refused,
    so the test reads a field as well; the comparison holds for every value."""
    return F.col(_CORRUPT).isNull() & (F.coalesce("document_id", F.lit("")) >= "")


def _is_verdict_file() -> Column:
    path = F.col("source_file")
    return ~path.endswith("/" + LEARNING_FILE) & ~path.contains(f"/{FEEDBACK_FOLDER}/")


def read_verdicts(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Verdict files below ``path``, without the learning database and the
    feedback folder. Unreadable records are left out (see ``quarantine``).

    ``one_per_file=False`` reads JSON lines, the form to keep large sets in.
    """
    df = _read_json(spark, path, S.VERDICT, one_per_file)
    return df.where(_is_verdict_file() & _readable()).drop(_CORRUPT)


def quarantine(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """The unreadable verdict records, with their text."""
    df = _read_json(spark, path, S.VERDICT, one_per_file)
    broken = F.col(_CORRUPT).isNotNull() & (F.coalesce("document_id", F.lit("")) >= "")
    return df.where(_is_verdict_file() & broken).select("source_file", F.col(_CORRUPT).alias("content"))


def valid_verdicts(verdicts: DataFrame) -> DataFrame:
    """Rows whose id, class, file name and summary are all filled."""
    keep = F.lit(True)
    for name in ("document_id", "classification", "filename", "summary"):
        keep = keep & (F.length(F.coalesce(F.col(name).cast("string"), F.lit(""))) > 0)
    return verdicts.where(keep)


def sample_verdict(spark: SparkSession) -> DataFrame:
    """The one-row stand-in for an empty source."""
    row = {name: None for name in S.VERDICT.names}
    row.update(
        document_id="sample_001", filename="sample_document.pdf", classification="Public",
        confidence=0.95, additional_labels=["General Content"], requires_review=False,
        safety_check=(True, None, None, None),
    )
    return spark.createDataFrame([tuple(row[n] for n in S.VERDICT.names)], S.VERDICT)


def or_sample(df: DataFrame, enabled: bool = False) -> DataFrame:
    """Typed empty table by default; the sample only when asked for and empty."""
    if enabled and df.isEmpty():
        sample = sample_verdict(df.sparkSession)
        return df.unionByName(sample, allowMissingColumns=True)
    return df


def read_learning(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Entries of a learning database with ``seq``, their place in it.

    The database in one file is one record, read by one task; ``one_per_file=False`` reads a folder of JSON
    lines, an entry each with its ``seq``, the form to keep many entries in (``write_learning``).
    """
    if not one_per_file:
        schema = StructType([StructField("seq", LongType()), *S.FEEDBACK.fields])
        return spark.read.schema(schema).json(path)
    df = spark.read.schema(S.LEARNING_DATABASE).option("multiLine", True).json(path)
    return df.select(F.posexplode("learning_entries").alias("seq", "e")).select(
        F.col("seq").cast("bigint").alias("seq"), "e.*"
    )


def write_learning(entries: DataFrame, path: str) -> None:
    """Entries as JSON lines; nulls stand there too, so that every entry has all its fields."""
    entries.write.option("ignoreNullFields", False).json(path)


def learning_info(spark: SparkSession, path: str) -> DataFrame:
    """The database's own fields, without its entries."""
    df = spark.read.schema(S.LEARNING_DATABASE).option("multiLine", True).json(path)
    return df.select(
        "version", "created_at", "total_feedback_count", "last_updated",
        F.size("learning_entries").alias("entries"),
    )


def read_feedback_archive(
    spark: SparkSession, path: str, document_id: str | None = None, one_per_file: bool = True
) -> DataFrame:
    """One row per archived review, optionally of one document; ``seq`` orders by
    the time stamp in the file name."""
    df = _read_json(spark, path, S.FEEDBACK, one_per_file).where(_readable()).drop(_CORRUPT)
    stamp = F.regexp_extract("source_file", r"_(\d{8})_(\d{6})\.json$", 1)
    clock = F.regexp_extract("source_file", r"_(\d{8})_(\d{6})\.json$", 2)
    df = df.withColumn("seq", F.coalesce(F.concat(stamp, clock).try_cast("bigint"), F.lit(0)))
    return df if document_id is None else df.where(F.col("document_id") == document_id)


def fetch(table: DataFrame, document_id) -> DataFrame:
    return table.where(F.col("document_id") == document_id)


# --- uploads ----------------------------------------------------------------

def upload_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded files with id, name, size, time; contents are not read."""
    files = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select(
        F.regexp_replace(name, r"\.[^.]*$", "").alias("document_id"), name.alias("filename"),
        F.col("length").alias("file_size"), F.col("modificationTime").alias("uploaded_at"), "path",
    )


def suffix(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"\.([^./]*)$", 1))


def validate_uploads(manifest: DataFrame, filename: str = "filename", size: str = "file_size") -> DataFrame:
    """Status and message per file; a bad file is a row, never a failure.

    Unsupported files get no id and size 0; too large ones no id but their size.
    """
    ext = suffix(F.col(filename))
    supported = ext.isin(*V.SUPPORTED_SUFFIXES)
    small = F.col(size) <= V.MAX_FILE_BYTES
    dotted = F.when(ext != "", F.concat(F.lit("."), ext)).otherwise(F.lit(""))
    ok = supported & small
    message = (
        F.when(~supported, F.concat(F.lit("Unsupported file format: "), dotted))
        .when(~small, F.format_string(
            f"File too large: %d bytes (max {V.MAX_FILE_BYTES})", F.col(size)))
        .otherwise(F.lit("File uploaded successfully"))
    )
    return manifest.withColumns({
        "status": F.when(ok, F.lit("success")).otherwise(F.lit("error")),
        "message": message,
        "document_id": F.when(ok, F.col("document_id").cast("string")).otherwise(F.lit("")),
        size: F.when(supported, F.col(size)).otherwise(F.lit(0)),
    })


def image_type(content: Column) -> Column:
    """MIME type from the leading bytes; short or unknown content is PNG."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(F.length(content) < 12, F.lit("image/png"))
        .when(head.startswith("89504E47"), F.lit("image/png"))
        .when(head.startswith("FFD8FF"), F.lit("image/jpeg"))
        .when(head.startswith("474946"), F.lit("image/gif"))
        .when(head.startswith("52494646") & head.endswith("57454250"), F.lit("image/webp"))
        .when(head.startswith("424D"), F.lit("image/bmp"))
        .when(head.startswith("4949") | head.startswith("4D4D"), F.lit("image/tiff"))
        .otherwise(F.lit("image/png"))
    )


def with_original_names(manifest: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Original file names from the side-car records, else the stored name."""
    names = sidecars.select("document_id", "original_filename").dropDuplicates(["document_id"])
    return manifest.join(names, "document_id", "left").withColumn(
        "filename", F.coalesce("original_filename", "filename")
    ).drop("original_filename")


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.SIDECAR).option("multiLine", True).json(path)
