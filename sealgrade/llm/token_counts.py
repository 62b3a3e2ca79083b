"""Token totals kept up by signed changes.

A ledger is a folder with a sub-folder for each committed batch. A batch brings rows to insert, delete or
revise; joined with what the ledger knows of these documents they become signed differences, summed by
source, language and tokenizer version before they are written. Totals are sums over the batches, so
no batch rewrites what others wrote. A batch is committed when its totals are whole; a batch id that is
committed already changes nothing, and one that broke off is written anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sealgrade.llm.common import Scratch, small_batches, table
from sealgrade.session import scratch_dir

KEYS = ["source", "lang", "tokenizer"]
FACTS = "doc_id long, tokenizer string, source string, lang string, n_tokens long, gone boolean, place long"
DELTAS = "source string, lang string, tokenizer string, docs long, tokens long"

#: Tokenizer versions that SQL can count, as patterns.
PATTERNS = {
    "space-1": r"[^\x20\x09-\x0D]+",
    "punct-2": r"[A-Za-z0-9\x{80}-\x{10FFFF}]+|[!-/:-@\[-`{-~]",
}


class Ledger:
    """Totals of documents and tokens by source, language and tokenizer version under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _done(self, folder: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def batches(self) -> list[str]:
        """Ids of committed batches in the order of their commits."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/deltas")
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []
        found = sorted((int(n.split("-", 1)[0]), n.split("-", 1)[1], n) for n in names if self._done(f"{self.path}/deltas/{n}"))
        return [n for _, _, n in found]

    def _read(self, kind: str, names: list[str], schema: str) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{kind}/{n}" for n in names])

    def known(self) -> DataFrame:
        """The last state of each document and tokenizer version."""
        facts = self._read("facts", self.batches(), FACTS)
        last = F.max(F.struct("place", "gone", "n_tokens", "source", "lang")).alias("last")
        return facts.groupBy("doc_id", "tokenizer").agg(last).select("doc_id", "tokenizer", "last.*").where("not gone").drop("gone", "place")

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply ``changes(op, doc_id, source, lang, tokenizer, n_tokens)``; false if the batch was committed before.

        ``insert`` and ``revise`` set a document's count (an insert of a known document revises it, a revision of an unknown
        one inserts it), ``delete`` takes it away (of an unknown one: nothing). Where a batch changes a document
        twice, a deletion wins, then the largest values. Null sources and languages are groups of their own; a null
        count is 0; rows with a null id, tokenizer or another ``op`` are not applied. An empty batch commits.
        """
        names = self.batches()
        if batch_id in [n.split("-", 1)[1] for n in names]:
            return False
        place = max((int(n.split("-", 1)[0]) for n in names), default=0) + 1
        name = f"{place:06d}-{batch_id}"
        new = (
            changes.where(F.col("op").isin("insert", "delete", "revise") & F.col("doc_id").isNotNull() & F.col("tokenizer").isNotNull())
            .groupBy(F.col("doc_id").cast("long").alias("doc_id"), F.col("tokenizer").cast("string").alias("tokenizer"))
            .agg(F.max(F.struct(
                (F.col("op") == "delete").alias("gone"), F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens"),
                F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
            )).alias("c")).select("doc_id", "tokenizer", "c.source", "c.lang", "c.n_tokens", "c.gone")
            .withColumn("place", F.lit(place).cast("long"))
        )
        # facts first: they count only once the batch's differences are whole
        new.write.mode("overwrite").parquet(f"{self.path}/facts/{name}")
        facts = self._read("facts", [name], FACTS)
        old = self.known().withColumnsRenamed({"source": "old_source", "lang": "old_lang", "n_tokens": "old_tokens"}).withColumn("had", F.lit(True))
        both = facts.join(old.hint("merge"), ["doc_id", "tokenizer"], "left")
        minus = F.when(F.col("had"), F.struct(F.col("old_source").alias("source"), F.col("old_lang").alias("lang"), "tokenizer",
                                              F.lit(-1).cast("long").alias("docs"), (-F.col("old_tokens")).alias("tokens")))
        plus = F.when(~F.col("gone"), F.struct("source", "lang", "tokenizer", F.lit(1).cast("long").alias("docs"), F.col("n_tokens").alias("tokens")))
        signed = both.select(F.explode(F.array(minus, plus)).alias("x")).where("x is not null").select("x.*")
        signed.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.mode("overwrite").parquet(
            f"{self.path}/deltas/{name}")
        return True

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, n_docs, n_tokens`` of groups that still have documents."""
        return self._read("deltas", self.batches(), DELTAS).groupBy(*KEYS).agg(
            F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens")).where("n_docs <> 0")


def count_by_pattern(version: str) -> Column:
    return F.coalesce(F.regexp_count(F.col("text"), F.lit(PATTERNS[version])), F.lit(0)).cast("long")


def count_by_library(documents: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, n_tokens`` by a vocabulary file of the tokenizers library; a null text has none."""
    from sealgrade.llm.token_files import _encoder

    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = _encoder(vocabulary).encode(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64())], names=["doc_id", "n_tokens"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long")


def op2_token_counts(spark, sf_dir):
    """Four batches: estimates, their revision, a second version, and the deletion of whole copies; two are sent again."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    rows = scratch.keep(docs.select(
        "doc_id", "source", "lang", "n_chars", F.xxhash64("text").alias("t1"), F.md5("text").alias("t2"),
        *(count_by_pattern(v).alias(v) for v in PATTERNS)))
    def changes(op, version, count):
        return rows.select(F.lit(op).alias("op"), "doc_id", "source", "lang", F.lit(version).alias("tokenizer"), count.alias("n_tokens"))
    first = scratch.keep(rows.groupBy("t1", "t2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    copies = scratch.keep(rows.join(first.hint("merge"), ["t1", "t2"]).where("doc_id > first").select("doc_id", "source", "lang"))
    gone = copies.select(F.lit("delete").alias("op"), "doc_id", "source", "lang", F.explode(F.array(*map(F.lit, PATTERNS))).alias("tokenizer"),
                         F.lit(0).cast("long").alias("n_tokens"))
    ledger = Ledger(spark, scratch_dir(spark))
    batches = {
        "load": changes("insert", "space-1", F.floor(F.col("n_chars") / 6)),
        "recount": changes("revise", "space-1", F.col("space-1")),
        "upgrade": changes("insert", "punct-2", F.col("punct-2")),
        "copies": gone,
    }
    for name in ("load", "recount", "recount", "upgrade", "copies", "load"):
        ledger.commit(name, batches[name])
    return ledger.totals()


OP2_SQL = r"""
WITH d AS (
  SELECT *, min(doc_id) OVER (PARTITION BY text) AS first FROM documents
), k AS (SELECT * FROM d WHERE text IS NULL OR doc_id = first)
SELECT source, lang, 'space-1' AS tokenizer, count(*)::BIGINT AS n_docs,
  sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::BIGINT AS n_tokens FROM k GROUP BY source, lang
UNION ALL
SELECT source, lang, 'punct-2', count(*)::BIGINT,
  sum(len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9\x{80}-\x{10FFFF}]+|[!-/:-@\[-`{-~]')))::BIGINT FROM k GROUP BY source, lang
"""
