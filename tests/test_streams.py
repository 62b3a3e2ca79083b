"""Progress folding, its stream, and the review streams."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sealgrade.operators.running import running_sums
from sealgrade.sources.tables import SnapshotTable
from sealgrade.streaming import progress as PR, reviews as RV

EVENT = "document_id string, event_ts timestamp, seq bigint, kind string, message string"
T0 = datetime(2024, 1, 1)


def python_fold(events):
    """The state machine, event by event."""
    active, done = {}, {}
    for doc, ts, _, kind, message in sorted(events, key=lambda e: (e[1], e[2])):
        if kind == "start":
            active[doc] = [ts, 0]
        elif doc in active and kind == "progress":
            active[doc][1] += 1
        elif doc in active:
            start, steps = active.pop(doc)
            done.setdefault((doc, start), (
                "completed" if kind == "complete" else "error", ts,
                message if kind == "error" else None, steps))
    for doc, (start, steps) in active.items():
        done.setdefault((doc, start), ("active", None, None, steps))
    return done


def random_events(seed, n=400):
    rng = random.Random(seed)
    # one document holds about half of the events; some events share a time
    return [
        (rng.choice(["hot"] * 5 + list("abcde")), T0 + timedelta(seconds=rng.randint(0, n // 2)), i,
         rng.choice(["start", "progress", "progress", "complete", "error"]), f"m{i}")
        for i in range(n)
    ]


def as_dict(df):
    return {(r["document_id"], r["started_at"]): (r["status"], r["completed_at"], r["error"], r["step_count"])
            for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fold_matches_the_state_machine(spark, rows, seed):
    events = random_events(seed)
    assert as_dict(PR.fold(rows(events, EVENT))) == python_fold(events)


def test_stale_operations(rows):
    df = rows([
        ("old", T0, 0, "start", "s"), ("young", T0 + timedelta(minutes=6), 1, "start", "s"),
        ("edge", T0 + timedelta(minutes=5), 2, "start", "s"),
        ("x", T0 + timedelta(minutes=10), 3, "complete", "late"),
    ], EVENT)
    got = as_dict(PR.operations(df))
    assert {k[0]: v[0] for k, v in got.items()} == {"old": "error", "young": "active", "edge": "active"}
    assert got[("old", T0)][1:3] == (T0 + timedelta(minutes=10), "Operation interrupted (page refresh)")
    hist = PR.history(PR.operations(df)).collect()
    assert [r["document_id"] for r in hist] == ["old"]


def test_history_length_and_tags(rows):
    df = rows([(str(i), T0 + timedelta(seconds=i), 2 * i, "start", "") for i in range(60)]
              + [(str(i), T0 + timedelta(seconds=100 + i), 2 * i + 1, "complete", "") for i in range(60)], EVENT)
    hist = PR.history(PR.operations(df)).collect()
    assert [r["document_id"] for r in hist] == [str(i) for i in range(59, 9, -1)]
    tags = rows([("⚠ x",), ("WARNING",), ("✓",), ("Completed",), ("y",)], "m string")
    assert [r[0] for r in tags.select(PR.step_tag(F.col("m"))).collect()] == [
        "warning", "warning", "success", "success", "info"]


@pytest.mark.parametrize("portions", [1, 4])
def test_stream_equals_batch(spark, rows, tmp_path, portions):
    events = sorted(random_events(5, 120), key=lambda e: (e[1], e[2]))
    cuts = [events[i * len(events) // portions:(i + 1) * len(events) // portions] for i in range(portions)]
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    for part in cuts:
        rows(part, EVENT).write.mode("append").parquet(src)
        stream = spark.readStream.schema(rows([], EVENT).schema).parquet(src)
        PR.stream_operations(stream, out, mark).awaitTermination()
    got = as_dict(PR.streamed_operations(spark, out, minutes=10_000))
    want = as_dict(PR.operations(rows(events, EVENT), minutes=10_000))
    assert got == want


def test_expiring_each_batch_closes_for_good(spark, rows, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    for part in ([("a", T0, 0, "start", ""), ("b", T0 + timedelta(minutes=9), 1, "start", "")],
                 [("a", T0 + timedelta(minutes=10), 2, "complete", "")]):
        rows(part, EVENT).write.mode("append").parquet(src)
        stream = spark.readStream.schema(rows([], EVENT).schema).parquet(src)
        PR.stream_operations(stream, out, mark, expire_each_batch=True).awaitTermination()
    got = {k[0]: v[0] for k, v in as_dict(PR.streamed_operations(spark, out)).items()}
    assert got == {"a": "error", "b": "active"}


def test_running_sums_of_one_large_key(rows):
    data = [("k" if i % 10 else f"s{i}", i, i % 7) for i in range(500)] + [(None, i, 1) for i in range(20)]
    random.Random(0).shuffle(data)
    df = rows(data, "k string, o int, v int")
    got = {(r["k"], r["o"]): r["total"] for r in running_sums(df, ["k"], ["o"], {"total": F.col("v")}, 8).collect()}
    want, sums = {}, {}
    for k, o, v in sorted(data, key=lambda r: r[1]):
        sums[k] = sums.get(k, 0) + v
        want[(k, o)] = sums[k]
    assert got == want


def test_daily_accuracy_window(spark, rows, tmp_path):
    data = [(T0 + timedelta(hours=h), h % 3 == 0, "Public") for h in range(60)]
    df = rows(data, "event_ts timestamp, approved boolean, original_classification string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    RV.daily_accuracy(stream).writeStream.foreachBatch(
        lambda b, n: b.write.mode("overwrite").parquet(out)
    ).outputMode("complete").option("checkpointLocation", str(tmp_path / "m")).trigger(availableNow=True).start().awaitTermination()
    got = {r["date"].day: (r["accuracy"], r["total_reviews"]) for r in spark.read.parquet(out).collect()}
    assert got == {1: (8 / 24, 24), 2: (8 / 24, 24), 3: (4 / 12, 12)}


def test_reviews_are_logged_merged_and_repeatable(spark, rows, tmp_path):
    ddl = ("document_id string, seq bigint, reviewer_id string, approved boolean, "
           "corrected_classification string, original_classification string, timestamp string")
    learning = SnapshotTable(spark, str(tmp_path / "l"))
    verdicts = SnapshotTable(spark, str(tmp_path / "v"))
    learning.overwrite(rows([("a", 0, "r0", True, None, "Public", "t")], ddl))
    verdicts.overwrite(rows([("a", "Public", True), ("b", "Public", True)],
                            "document_id string, classification string, requires_review boolean"))
    log, mark = str(tmp_path / "log"), str(tmp_path / "m")

    def state():
        got = {r["document_id"]: (r["classification"], r["original_classification"], r["requires_review"])
               for r in RV.reviewed_verdicts(verdicts, spark.read.schema(ddl).parquet(log)).collect()}
        return got

    for n, to in ((1, "Unsafe"), (2, "Confidential")):
        rows([("a", n, f"r{n}", False, to, "Public", "t")], ddl).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows([], ddl).schema).parquet(str(tmp_path / "in"))
        RV.log_reviews(stream, log, mark).awaitTermination()
        before = state()
        for _ in range(2):
            RV.merge_reviews(learning, verdicts, spark.read.schema(ddl).parquet(log))
            assert state() == before
        assert [(r["document_id"], r["reviewer_id"]) for r in learning.read().collect()] == [("a", f"r{n}")]
    assert before == {"a": ("Confidential", "Unsafe", False), "b": ("Public", None, True)}
    # the second call of each round found nothing to merge
    assert verdicts.latest() == 2


def test_ingest_takes_each_file_once(spark, tmp_path):
    src, out, mark = (tmp_path / n for n in ("src", "bronze", "mark"))
    src.mkdir()
    for n in range(2):
        (src / f"{n}.json").write_text(f'{{\n"document_id": "{n}", "classification": "Public"\n}}')
        RV.ingest_verdicts(spark, str(src), str(out), str(mark)).awaitTermination()
    assert sorted(r["document_id"] for r in spark.read.parquet(str(out)).collect()) == ["0", "1"]


def test_broken_records_go_to_quarantine(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.json").write_text('{"document_id": "1", "classification": "Public"}\n{"document_id": "2", "classif\n')
    for name, start in (("good", RV.ingest_verdicts), ("bad", RV.quarantine_verdicts)):
        start(spark, str(src), str(tmp_path / name), str(tmp_path / f"{name}-mark"), one_per_file=False).awaitTermination()
    assert [r["document_id"] for r in spark.read.parquet(str(tmp_path / "good")).collect()] == ["1"]
    assert [r["content"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == ['{"document_id": "2", "classif']


def test_a_record_that_comes_again_is_taken_once(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    for n, text in enumerate(['{"document_id": "1", "classification": "Public"}', '{"document_id": "1", "classification": "Public"}',
                              '{"document_id": "1", "classification": "Unsafe"}']):
        (src / f"{n}.json").write_text(text)
        RV.ingest_verdicts(spark, str(src), str(tmp_path / "out"), str(tmp_path / "mark"), once_within="1 day").awaitTermination()
    assert sorted(r["classification"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["Public", "Unsafe"]
