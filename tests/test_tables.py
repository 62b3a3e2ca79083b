"""Versions as lists of files and deletes: what is written, what is read."""

import os
import random

import pytest
from pyspark.sql import functions as F

from sealgrade.sources.tables import SnapshotTable

DDL = "document_id int, x string, m map<string,int>"


def data(n, seed=1):
    r = random.Random(seed)
    return [(i, "".join(r.choice("abcdefgh") for _ in range(50)), {"k": i}) for i in range(n)]


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


@pytest.mark.parametrize("buckets", [None, 8])
def test_deleting_writes_keys_only(spark, rows, tmp_path, buckets):
    t = SnapshotTable(spark, str(tmp_path / "t"), buckets=buckets)
    t.overwrite(rows(data(200), DDL))
    before = files(tmp_path / "t" / "data")
    t.delete(rows([(i,) for i in (3, 5, 5, 999, None)], "document_id int"))
    t.delete(rows([(5, 1), (7, 1)], "other int, n int").withColumnRenamed("other", "k"), key="k")
    assert files(tmp_path / "t" / "data") == before
    left = {r["document_id"] for r in t.read().collect()}
    assert left == set(range(200)) - {3, 5, 7} and t.count() == 197
    assert t.as_of(1).count() == 198 and t.as_of(0).count() == 200
    assert [r["num_rows"] for r in t.history().orderBy("version").collect()] == [200, 198, 197]
    assert t.read().columns == ["document_id", "x", "m"]
    # rows without a key stay
    t.overwrite(rows([(None, "a", None), (1, "b", None)], DDL))
    t.delete(rows([(1,), (None,)], "document_id int"))
    assert [r["x"] for r in t.read().collect()] == ["a"]


@pytest.mark.parametrize("buckets", [None, 4])
def test_compacting_leaves_large_files_alone(spark, rows, tmp_path, buckets):
    t = SnapshotTable(spark, str(tmp_path / "t"), buckets=buckets)
    big = rows(data(4000), DDL).repartition(1)
    t.overwrite(big)
    target = max(os.path.getsize(f) for f in files(tmp_path / "t" / "data"))
    assert t.compact(target_bytes=target) == 1
    assert not os.path.exists(tmp_path / "t" / "data" / "1") or buckets
    kept = files(tmp_path / "t" / "data")
    t.delete(big.where("document_id = 17"))
    assert t.compact(target_bytes=target) == 3
    # only the file that holds the row is written anew
    assert t.read().where("document_id = 17").count() == 0 and t.read().count() == t.count() == 3999
    assert set(kept) <= set(files(tmp_path / "t" / "data"))
    if buckets:
        assert len(set(files(tmp_path / "t" / "data" / "3"))) <= len(kept)
    assert t.as_of(0).count() == 4000


def test_small_files_become_few(spark, rows, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"))
    t.overwrite(rows(data(300), DDL).repartition(10))
    t.compact()
    assert len(files(tmp_path / "t" / "data" / "1")) == 1
    assert sorted(r["document_id"] for r in t.read().collect()) == list(range(300))


def test_changes_read_only_buckets_that_differ(spark, rows, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"), buckets=16)
    old, new = data(500), data(500)
    new[40] = (40, "other", None)
    t.overwrite(rows(old, DDL))
    t.overwrite(rows([*new[:490], (1000, "new", None)], DDL))
    changed = {40, 1000, *range(490, 500)}
    buckets = {r[0] for r in rows([(i,) for i in changed], "i int").select(t._bucket(F.col("i"), 16)).collect()}
    assert t.differing(0, 1) == sorted(buckets) and len(buckets) < 12
    got = {r["document_id"]: r["change"] for r in t.changes(0, 1).collect()}
    assert got == {40: "update", 1000: "insert"} | dict.fromkeys(range(490, 500), "delete")
    # the other buckets' folders are not in the plan's files
    used = {f.split("_bucket=")[1].split("/")[0] for part in (0, 1) for f in t._rows(t._entry(part), t.differing(0, 1)).select("_metadata.file_path").distinct().toPandas()["file_path"]}
    assert {int(b) for b in used} <= buckets
    t.delete(rows([(2,), (77_777,)], "document_id int"))
    assert len(t.differing(1, 2)) == 1
    assert [tuple(r) for r in t.changes(1, 2).collect()] == [(2, "delete")]
    assert t.differing(0, 0) == [] and t.changes(1, 1).collect() == []
    t.compact()
    assert [tuple(r) for r in t.changes(1, 3).collect()] == [(2, "delete")]


@pytest.mark.parametrize("buckets", [None, 16])
def test_a_look_up_reads_its_bucket(spark, rows, tmp_path, buckets):
    t = SnapshotTable(spark, str(tmp_path / "t"), buckets=buckets)
    t.overwrite(rows([*data(600), data(600)[7]], DDL).repartition(4))
    assert [r["x"] for r in t.find(7).collect()] == [data(600)[7][1]] * 2
    assert sorted(r["document_id"] for r in t.find(3, 500, 9999).collect()) == [3, 500]
    t.delete(rows([(3,)], "document_id int"))
    assert [r["document_id"] for r in t.find(3, 500).collect()] == [500]
    if buckets:
        plan = t.find(500)._jdf.queryExecution().executedPlan().toString()
        scan = next(line for line in plan.splitlines() if "PartitionFilters" in line)
        assert "_bucket" in scan.split("PartitionFilters:")[1].split("]")[0] and "EqualTo(document_id,500)" in scan
        for f in files(tmp_path / "t" / "data"):
            ids = [r["document_id"] for r in spark.read.parquet(f).collect()]
            assert ids == sorted(ids)


def test_empty_versions_and_other_schemas(spark, rows, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"), buckets=4)
    assert t.count() == 0
    t.overwrite(rows([], DDL))
    t.overwrite(rows(data(5), DDL))
    assert t.as_of(0).collect() == [] and len(t.changes(0, 1).collect()) == 5
    t.overwrite(rows([(1, 2.0)], "document_id int, y double"))
    assert t.differing(1, 2) is None
    assert {r["change"] for r in t.changes(1, 2).collect()} == {"delete"}
    report = t.clear(rows([(1,), (2,)], "u int"), rows([(1,)], "f int")).first()
    assert report.asDict() == {"deleted_results": 1, "deleted_uploads": 2, "feedback_preserved": 1}
    assert t.read().collect() == [] and t.compact() == 4
    with pytest.raises(ValueError):
        SnapshotTable(spark, str(tmp_path / "none")).delete(rows([(1,)], "document_id int"))
