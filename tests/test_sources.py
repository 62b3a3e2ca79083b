"""File sources, the two real learning entries, versioned tables, layers."""

import json

import pytest
from pyspark.sql import functions as F

from sealgrade.functions import repair  # noqa: F401
from sealgrade.operators import dashboard as D, feedback as FB, learned as LN
from sealgrade.plans.medallion import Lakehouse
from sealgrade.sources import files
from sealgrade.sources.tables import SnapshotTable, diff, load_report

# fixed values: the two recorded reviews, shortened to the fields rules read
ENTRIES = [
    {
        "document_id": "834e773d-c927-4823-ba1e-1cfd0f079907", "reviewer_id": "user", "approved": False,
        "corrected_classification": "Highly Sensitive", "original_classification": "Confidential",
        "feedback_notes": "Any document with PII is highly sensitive by default.",
        "timestamp": "2025-11-09T09:37:25.559703",
        "document_context": {"filename": "application.pdf", "page_count": 4, "summary": "A filled-in form.",
                             "text_segments_summary": {"total": 8, "classifications": {
                                 "Public": 1, "Confidential": 6, "Highly Sensitive": 1}}},
        "key_indicators": ["personal name", "personal phone", "personal email", "personal statement",
                           "personal address", "employment history", "criminal history", "salary",
                           "equal opportunity", "employment"],
    },
    {
        "document_id": "249e7f0d-7dbc-48f8-a10a-089511b83544", "reviewer_id": "user", "approved": True,
        "corrected_classification": None, "original_classification": "Unsafe",
        "feedback_notes": "Quick approval - classification correct",
        "timestamp": "2025-11-09T10:27:05.364809", "key_indicators": [],
    },
]


def verdict(doc, kind="Public", **more):
    return {
        "document_id": doc, "filename": f"{doc}.pdf", "classification": kind, "confidence": 0.8,
        "summary": "s", "requires_review": True,
        "safety_check": {"is_safe": kind != "Unsafe", "flags": ["Safe"], "details": "d", "confidence": 0.9},
        "text_segments": [{"text": "a", "classification": "Public", "confidence": 0.5}], "evidence": [],
        "page_count": 2, "image_count": 0, "processing_time": 1.5,
    } | more


@pytest.fixture(scope="module")
def results(tmp_path_factory):
    root = tmp_path_factory.mktemp("results")
    for doc in ("a", "b"):
        (root / f"{doc}.json").write_text(json.dumps(verdict(doc), indent=2))
    (root / "c.json").write_text(json.dumps(verdict("c", "Unsafe", summary=None), indent=2))
    (root / "bad.json").write_text('{"document_id": "bad", ')
    database = {"version": "1.0", "total_feedback_count": 2, "learning_entries": ENTRIES}
    (root / "learning_database.json").write_text(json.dumps(database, indent=2))
    (root / "feedback").mkdir()
    for e, stamp in zip(ENTRIES, ("20251109_093725", "20251109_102705")):
        (root / "feedback" / f"{e['document_id']}_{stamp}.json").write_text(json.dumps(e, indent=2))
    return str(root)


def test_verdict_files(spark, results):
    got = files.read_verdicts(spark, results)
    assert sorted(r["document_id"] for r in got.collect()) == ["a", "b", "c"]
    assert sorted(r["document_id"] for r in files.valid_verdicts(got).collect()) == ["a", "b"]
    bad = files.quarantine(spark, results).collect()
    assert len(bad) == 1 and bad[0]["source_file"].endswith("bad.json")
    assert files.fetch(got, "b").count() == 1


def test_empty_folder_gives_a_typed_table(spark, tmp_path):
    (tmp_path / "feedback").mkdir()
    (tmp_path / "feedback" / "x_20250101_000000.json").write_text("{}")
    empty = files.read_verdicts(spark, str(tmp_path))
    assert files.or_sample(empty).count() == 0
    assert files.or_sample(empty, enabled=True).first()["document_id"] == "sample_001"


def test_recorded_reviews(spark, results):
    learning = files.read_learning(spark, f"{results}/learning_database.json")
    stats = D.learning_statistics(learning).first()
    assert (stats["total_entries"], stats["corrections_count"], stats["approvals_count"]) == (2, 1, 1)
    spread = {r["corrected_classification"]: r["count"] for r in D.corrected_distribution(learning).collect()}
    assert spread == {"Highly Sensitive": 1, None: 1}
    assert FB.recent(learning, 1).first()["document_id"].startswith("249e7f0d")
    assert [r["document_summary"] for r in FB.training_export(learning).collect()] == ["A filled-in form."]
    assert FB.search(learning, ["CRIMINAL"]).count() == 1
    archive = files.read_feedback_archive(spark, f"{results}/feedback")
    assert archive.count() == 2
    assert FB.union_feedback(learning, archive.drop("source_file", "submitted_at")).count() == 2
    assert FB.feedback_history(archive, ENTRIES[0]["document_id"]).count() == 1
    n = FB.normalize_feedback(learning)
    assert {r["filename"] for r in n.collect()} == {"application.pdf", "unknown"}


@pytest.mark.parametrize("hits, applied", [(4, False), (5, True)])
def test_recorded_correction_needs_five_indicators(spark, results, rows, hits, applied):
    learning = files.read_learning(spark, f"{results}/learning_database.json")
    preview = ", ".join(ENTRIES[0]["key_indicators"][:hits])
    docs = rows([("x", "Confidential", 0.9, "x.pdf", preview, [])],
                "document_id string, classification string, confidence double, filename string, "
                "preview string, all_keywords array<string>")
    r = LN.apply_override(docs, learning).first()
    assert r["was_overridden"] is applied
    if applied:
        assert r["learned_classification"] == "Highly Sensitive" and r["learned_confidence"] == 0.98
        assert "Matched 5/10 indicators" in r["override_reason"]


def test_uploads(spark, rows, tmp_path):
    for name, size in (("1.PDF", 3), ("2.exe", 2)):
        (tmp_path / name).write_bytes(b"x" * size)
    manifest = files.upload_manifest(spark, str(tmp_path))
    got = {r["filename"]: r for r in files.validate_uploads(manifest).collect()}
    assert (got["1.PDF"]["document_id"], got["1.PDF"]["file_size"], got["1.PDF"]["status"]) == ("1", 3, "success")
    assert (got["2.exe"]["document_id"], got["2.exe"]["file_size"]) == ("", 0)
    assert got["2.exe"]["message"] == "Unsupported file format: .exe"
    sizes = rows([("1", "a.txt", 50 * 1024 * 1024), ("2", "a.txt", 50 * 1024 * 1024 + 1), ("3", "noext", 1)],
                 "document_id string, filename string, file_size bigint")
    assert [r["status"] for r in files.validate_uploads(sizes).orderBy("file_size").collect()] == [
        "error", "success", "error"]


@pytest.mark.parametrize("head, mime", [
    ("89504E470D0A1A0A", "png"), ("FFD8FFE0", "jpeg"), ("474946383961", "gif"),
    ("5249464600000000574542500000", "webp"), ("5249464600000000415649200000", "png"),
    ("424D", "bmp"), ("49492A00", "tiff"), ("4D4D002A", "tiff"), ("0011", "png"),
])
def test_image_types(rows, head, mime):
    long = bytes.fromhex(head).ljust(14, b"\0")
    df = rows([(long,), (long[:11],)], "content binary")
    got = [r[0] for r in df.select(files.image_type(F.col("content"))).collect()]
    assert got == [f"image/{mime}", "image/png"]


def test_snapshots(spark, rows, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"))
    assert t.latest() is None and t.history().count() == 0
    with pytest.raises(ValueError):
        t.read()
    assert t.overwrite(rows([(1, "a"), (2, "b")], "document_id int, x string")) == 0
    assert t.delete(rows([(1,)], "document_id int")) == 1
    assert t.overwrite(rows([(2, "z", 1.0), (3, "c", 2.0)], "document_id int, x string, y double")) == 2
    assert t.compact(target_bytes=1 << 30) == 3
    assert [r["x"] for r in t.as_of(0).orderBy("document_id").collect()] == ["a", "b"]
    assert t.as_of(0).columns == ["document_id", "x"] and "y" in t.read().columns
    changes = {r["document_id"]: r["change"] for r in t.changes(0, 3).collect()}
    assert changes == {1: "delete", 2: "update", 3: "insert"}
    assert t.clear().first()["deleted_results"] == 2 and t.read().count() == 0
    ops = [(r["version"], r["operation"], r["num_rows"]) for r in t.history().orderBy("version").collect()]
    assert ops == [(0, "WRITE", 2), (1, "DELETE", 1), (2, "WRITE", 2), (3, "OPTIMIZE", 2), (4, "CLEAR", 0)]
    with pytest.raises(ValueError):
        t.as_of(9)


def test_diff_sees_a_value_become_null(rows):
    old = rows([(1, "a", None), (2, None, "a")], "document_id int, x string, y string")
    new = rows([(1, None, "a"), (2, None, "a")], "document_id int, x string, y string")
    assert [r["document_id"] for r in diff(old, new).collect()] == [1]


def test_layers(spark, results, tmp_path):
    house = Lakehouse(spark, str(tmp_path / "house"))
    house.ingest(results)
    house.silver()
    house.gold()
    house.mine(only_corrected=False)
    gold = house.table("gold", "classification_distribution").read()
    assert {r["classification"]: r["total_documents"] for r in gold.collect()} == {"Public": 2, "Unsafe": 1}
    assert house.table("silver", "segments").read().count() == 3
    assert house.table("silver", "evidence").read().count() == 0
    assert house.table("gold", "kpis").read().count() == 4
    assert house.table("silver", "training_examples").read().count() == 3
    assert house.table("silver", "learning_feedback").read().where("reviewed_at is not null").count() == 2
    report = {r["table"]: r["rows"] for r in load_report({"g": gold}).collect()}
    assert report == {"g": 2}


def test_all_versions_are_the_committed_ones(spark, rows, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"))
    t.overwrite(rows([("a",)], "document_id string"))
    rows([("x",), ("y",)], "document_id string").write.parquet(str(tmp_path / "t/v=1"))
    assert [(r.document_id, r.v) for r in t.all_versions().collect()] == [("a", 0)]


def test_load_report_of_full_and_empty_tables(spark, rows):
    full = rows([("a", 1), ("b", 2)], "document_id string, n int")
    got = {r.table: (r.rows, r.sample) for r in load_report({"full": full, "none": full.limit(0)}).collect()}
    assert got["none"] == (0, None)
    assert got["full"][0] == 2 and got["full"][1] in ('{"document_id":"a","n":1}', '{"document_id":"b","n":2}')
