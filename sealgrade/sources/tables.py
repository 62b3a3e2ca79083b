"""Versioned tables on plain Parquet.

A version names the files that it consists of and the delete lists that apply to them, so deleting writes
keys instead of rows and compacting rewrites only files that are small or hold deleted rows. Layout::

    <path>/data/<n>/         files written by version n, below _bucket=<b>/ if the table has buckets
    <path>/_files/v=<n>/     a row per file or folder that version n consists of
    <path>/_deletes/v=<n>/   keys that version n deleted
    <path>/_digests/v=<n>/   rows and a digest for each bucket of version n
    <path>/_history/         a row per version

The history row is written last, so a version counts only once its data are complete, and a failed
write leaves nothing behind that a reader would see. One writer per table at a time.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, functions as F

_HISTORY = ("version bigint, timestamp timestamp, operation string, num_rows bigint, schema string, "
            "files_of bigint, deletes array<bigint>, buckets int")
_BUCKET = "_bucket"


def _union(frames: Sequence[DataFrame], **options) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, **options), frames)


@dataclass(frozen=True)
class SnapshotTable:
    """``key`` is what ``delete`` and ``changes`` go by. With ``buckets`` rows are kept apart by a hash of the key, with
    a digest of each bucket, so that ``changes`` reads only buckets that differ."""

    spark: SparkSession
    path: str
    key: str = "document_id"
    buckets: int | None = None

    # --- history ------------------------------------------------------------
    def _log(self) -> DataFrame:
        try:
            return self.spark.read.schema(_HISTORY).parquet(f"{self.path}/_history")
        except AnalysisException as e:
            # only a missing table has no history; any other trouble is one
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _HISTORY)

    def history(self) -> DataFrame:
        """``version, timestamp, operation, num_rows`` of each write."""
        return self._log().select("version", "timestamp", "operation", "num_rows")

    def latest(self) -> int | None:
        return self._log().agg(F.max("version")).first()[0]

    def count(self) -> int:
        """How many rows the latest version has, from the history."""
        version = self.latest()
        return 0 if version is None else self._entry(version)["num_rows"]

    def _entry(self, version: int) -> Row:
        row = self._log().where(F.col("version") == version).first()
        if row is None:
            raise ValueError(f"no version {version} in {self.path}")
        return row

    # --- reading ------------------------------------------------------------
    def read(self) -> DataFrame:
        version = self.latest()
        if version is None:
            raise ValueError(f"no version in {self.path}")
        return self.as_of(version)

    def as_of(self, version: int) -> DataFrame:
        """The table as written by ``version``."""
        return self._rows(self._entry(version)).drop(_BUCKET)

    def rows_of(self, version: int, buckets: Sequence[int] | None = None) -> DataFrame:
        """Rows of a version, of some buckets only if these are given."""
        return self._rows(self._entry(version), buckets).drop(_BUCKET)

    def find(self, *ids) -> DataFrame:
        """Rows of the latest version whose key is one of ``ids``.

        With buckets only their folders are read. There rows lie in the order of the key and files carry a Bloom filter
        of it, so that row groups without the key are passed over.
        """
        version = self.latest()
        if version is None:
            raise ValueError(f"no version in {self.path}")
        entry = self._entry(version)
        rows = self._rows(entry)
        if entry["buckets"] and _BUCKET in rows.columns:
            rows = rows.where(F.col(_BUCKET).isin(*[self._bucket(F.lit(i), entry["buckets"]) for i in ids]))
        return rows.where(F.col(self.key).isin(*ids)).drop(_BUCKET)

    def all_versions(self) -> DataFrame:
        """All committed versions in one table with merged schemas and their version ``v``."""
        versions = [r["version"] for r in self._log().select("version").distinct().collect()]
        if not versions:
            raise ValueError(f"no version in {self.path}")
        return _union([self.as_of(v).withColumn("v", F.lit(v)) for v in sorted(versions)], allowMissingColumns=True)

    def _rows(self, entry: Row, buckets: Sequence[int] | None = None) -> DataFrame:
        """Rows of a version, of some buckets only; their file's path is ``_metadata.file_path`` of each part."""
        parts = self._parts(self._files(entry["files_of"]), entry["schema"])
        if buckets is not None:
            parts = [p.where(F.col(_BUCKET).isin(list(buckets))) if _BUCKET in p.columns else p for p in parts]
        return self._without(_union(parts), entry["deletes"])

    def _parts(self, files: Sequence[str], schema: str) -> list[DataFrame]:
        """A frame for each data folder that ``files`` lie in."""
        folders: dict[str, list[str]] = {}
        for f in files:
            folder = f"{self.path}/data/" + f.rsplit("/data/", 1)[1].split("/")[0]
            folders.setdefault(folder, []).append(f)
        reader = self.spark.read.schema(schema)
        return [reader.option("basePath", folder).parquet(*sorted(own)) for folder, own in sorted(folders.items())]

    def _without(self, rows: DataFrame, deletes: Sequence[int]) -> DataFrame:
        return rows.join(self._deleted(deletes), self.key, "left_anti") if deletes else rows

    def _deleted(self, versions: Sequence[int]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/_deletes/v={v}" for v in versions]).select(self.key)

    def _files(self, version: int) -> list[str]:
        return [r["file"] for r in self.spark.read.schema("file string").parquet(f"{self.path}/_files/v={version}").collect()]

    # --- writing ------------------------------------------------------------
    def overwrite(self, df: DataFrame, operation: str = "WRITE", partition_by: list[str] | None = None) -> int:
        """Write ``df`` as the next version; its schema may differ from before. Rows are counted while they are written."""
        version = self._next()
        rows = self._write(df, version, partition_by)
        self._name_files(version, [self._data(version)])
        self._commit(version, operation, rows, df.schema, version, [])
        return version

    def delete(self, ids: DataFrame, key: str | None = None) -> int:
        """Drop the rows whose key is in ``ids``: only the keys are read and written."""
        last = self.latest()
        if last is None:
            raise ValueError(f"no version in {self.path}")
        entry, version = self._entry(last), last + 1
        listed = ids.select(F.col(key or self.key).alias(self.key)).where(f"`{self.key}` is not null").distinct()
        gone = self._rows(entry).select(self.key).join(listed, self.key, "left_semi")
        count = Observation()
        gone.observe(count, F.count(F.lit(1)).alias("n")).distinct().write.mode("overwrite").parquet(f"{self.path}/_deletes/v={version}")
        self._commit(version, "DELETE", entry["num_rows"] - _observed(count), entry["schema"], entry["files_of"],
                     [*entry["deletes"], version], entry["buckets"])
        return version

    def clear(self, uploads: DataFrame | None = None, feedback: DataFrame | None = None) -> DataFrame:
        """Drop all rows; one row tells how many there were.

        ``uploads`` are the rows of an upload table to be dropped with them, ``feedback`` those that are kept; both
        are only counted.
        """
        rows = self.count()
        last = self.latest()
        if last is not None:
            entry = self._entry(last)
            self.overwrite(self.spark.createDataFrame([], entry["schema"]), "CLEAR")
        report = self.spark.createDataFrame([(rows,)], "deleted_results bigint")
        for name, df in (("deleted_uploads", uploads), ("feedback_preserved", feedback)):
            if df is not None:
                report = report.withColumn(name, df.agg(F.count(F.lit(1))).scalar())
        return report

    def compact(self, target_bytes: int = 256 << 20) -> int:
        """Bring files to about ``target_bytes``: small ones and those with deleted rows are rewritten, others stay."""
        last = self.latest()
        if last is None:
            raise ValueError(f"no version in {self.path}")
        entry, version = self._entry(last), last + 1
        named = self._files(entry["files_of"])
        listed = (
            self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
            .load(named).select("path", "length", F.col("_metadata.file_path").alias("file")).collect()
        )
        sizes, path_of = {r["path"]: r["length"] for r in listed}, {r["file"]: r["path"] for r in listed}
        small = {f for f, n in sizes.items() if n < target_bytes / 2}
        if entry["deletes"]:
            held = [
                p.select(self.key, F.col("_metadata.file_path").alias("file")).join(self._deleted(entry["deletes"]), self.key, "left_semi")
                .select("file").distinct() for p in self._parts(named, entry["schema"])
            ]
            small |= {path_of[r["file"]] for r in _union(held).collect()}
        # without any file, as a table without rows may be, the folders stay named
        keep = [f for f in sizes if f not in small] if sizes else named
        if small:
            rows = self._without(_union(self._parts(sorted(small), entry["schema"])), entry["deletes"]).drop(_BUCKET)
            files = max(1, math.ceil(sum(sizes[f] for f in small) / target_bytes))
            self._write(rows if self.buckets else rows.repartition(files), version, None)
            keep.append(self._data(version))
        self._name_files(version, keep)
        self._commit(version, "OPTIMIZE", entry["num_rows"], entry["schema"], version, [], entry["buckets"])
        return version

    def _next(self) -> int:
        last = self.latest()
        return 0 if last is None else last + 1

    def _data(self, version: int) -> str:
        return f"{self.path}/data/{version}"

    def _write(self, df: DataFrame, version: int, partition_by: list[str] | None) -> int:
        count = Observation()
        if self.buckets:
            df = df.withColumn(_BUCKET, self._bucket(F.col(self.key), self.buckets)).hint("rebalance", _BUCKET)
            df = df.sortWithinPartitions(_BUCKET, self.key)
            partition_by = [_BUCKET]
        writer = df.observe(count, F.count(F.lit(1)).alias("n")).write.mode("overwrite")
        if self.buckets:
            writer = writer.option(f"parquet.bloom.filter.enabled#{self.key}", "true")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self._data(version))
        return _observed(count)

    def _name_files(self, version: int, files: list[str]) -> None:
        self.spark.createDataFrame([(f,) for f in files], "file string").coalesce(1).write.mode("overwrite").parquet(
            f"{self.path}/_files/v={version}")

    def _commit(self, version: int, operation: str, rows: int, schema, files_of: int, deletes: list[int], buckets: int | None = None) -> None:
        ddl = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        buckets = buckets or self.buckets
        if buckets and files_of == version:
            self._digest(ddl, version, deletes, buckets)
        entry = self.spark.createDataFrame(
            [(version, None, operation, rows, ddl, files_of, deletes, buckets)], _HISTORY
        ).withColumn("timestamp", F.current_timestamp())
        entry.coalesce(1).write.mode("append").parquet(f"{self.path}/_history")

    # --- changes ------------------------------------------------------------
    @staticmethod
    def _bucket(key: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")

    def _digest(self, schema: str, version: int, deletes: list[int], buckets: int) -> None:
        """Per bucket: how many rows, and the sum of their hashes, which does not depend on their order."""
        rows = self._without(_union(self._parts(self._files(version), schema)), deletes)
        if _BUCKET not in rows.columns:  # no rows, so no folders
            rows = rows.withColumn(_BUCKET, F.lit(None).cast("int"))
        columns = sorted(c for c in rows.columns if c != _BUCKET)
        own = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"}))
        rows.groupBy(_BUCKET).agg(F.count(F.lit(1)).alias("n"), F.sum(own.cast("decimal(38,0)")).alias("digest")).coalesce(1).write.mode(
            "overwrite").parquet(f"{self.path}/_digests/v={version}")

    def differing(self, old: int, new: int) -> list[int] | None:
        """Buckets that may differ between two versions; None if all may, for want of digests."""
        a, b = self._entry(old), self._entry(new)
        if not a["buckets"] or a["buckets"] != b["buckets"] or a["schema"] != b["schema"]:
            return None
        out: set[int] = set()
        if a["files_of"] != b["files_of"]:
            x, y = (self.spark.read.parquet(f"{self.path}/_digests/v={e['files_of']}") for e in (a, b))
            same = x.join(y, [_BUCKET, "n", "digest"]).select(_BUCKET)
            out |= {r[0] for r in x.select(_BUCKET).unionByName(y.select(_BUCKET)).distinct().exceptAll(same).collect()}
        listed = sorted(set(a["deletes"]) ^ set(b["deletes"])) if a["files_of"] == b["files_of"] else sorted({*a["deletes"], *b["deletes"]})
        if listed:
            touched = self._deleted(listed).select(self._bucket(F.col(self.key), a["buckets"]).alias("b")).distinct()
            out |= {r["b"] for r in touched.collect()}  # a table has a fixed number of buckets
        return sorted(out)

    def changes(self, old: int, new: int, key: str | None = None) -> DataFrame:
        """Rows that differ between two versions: inserted, deleted or updated. Buckets that agree are not read."""
        some = self.differing(old, new)
        before, after = (self.rows_of(v, some) for v in (old, new))
        return diff(before, after, key or self.key)


def _observed(count: Observation) -> int:
    return count.get["n"]


def diff(old: DataFrame, new: DataFrame, key: str = "document_id") -> DataFrame:
    """``key, change`` of rows that were inserted, deleted or updated.

    Rows are compared by a hash of their shared columns, so one narrow full join
    on the key decides; the rows themselves are not shuffled.
    """
    shared = [c for c in old.columns if c in new.columns and c != key]

    def digest(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, F.sha2(F.to_json(
            F.struct(*[F.col(c) for c in shared]), {"ignoreNullFields": "false"}), 256).alias(name))

    joined = digest(old, "_old").join(digest(new, "_new"), key, "full")
    return joined.select(
        key,
        F.when(F.col("_old").isNull(), F.lit("insert"))
        .when(F.col("_new").isNull(), F.lit("delete"))
        .when(F.col("_old") != F.col("_new"), F.lit("update")).alias("change"),
    ).where(F.col("change").isNotNull())


def load_report(tables: dict[str, DataFrame], by: str | None = None) -> DataFrame:
    """Row count and one sample row (as JSON) per table; an empty table has no sample.

    Counting reads no columns, and the sample reads one row: any, or the first one ``by`` a column.
    """
    parts = []
    for name, df in tables.items():
        count = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        sample = (df.orderBy(by) if by else df).limit(1).select(F.lit(name).alias("table"), F.to_json(F.struct(*df.columns)).alias("sample"))
        parts.append(count.join(sample, "table", "left"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def register_views(tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
