"""Operations by event time: late and repeated events, timers, and the latest ones kept."""

import random
from datetime import datetime, timedelta

import pytest

from sealgrade.streaming import operations as OP

EVENT = "document_id string, event_ts timestamp, seq bigint, kind string, message string"
T0 = datetime(2024, 1, 1)
STALE = "Operation interrupted (page refresh)"


def event(doc, seconds, seq, kind):
    return (doc, T0 + timedelta(seconds=seconds), seq, kind, f"m{seq}")


def machine(events, delay=timedelta(minutes=10), limit=timedelta(minutes=5)):
    """Event by event, up to the last watermark."""
    clock = max(e[1] for e in events)
    clock = clock.replace(microsecond=clock.microsecond // 1000 * 1000) - delay
    active, done = {}, {}

    def expire(doc, now):
        if doc in active and now > active[doc][0] + limit:
            start, steps = active.pop(doc)
            done.setdefault((doc, start), ("error", start + limit, STALE, steps))

    for doc, ts, _, kind, message in sorted(events, key=lambda e: (e[1], e[2])):
        if ts >= clock:
            break
        expire(doc, ts)
        if kind == "start":
            active[doc] = [ts, 0]
        elif doc in active and kind == "progress":
            active[doc][1] += 1
        elif doc in active:
            start, steps = active.pop(doc)
            done.setdefault((doc, start), ("completed" if kind == "complete" else "error", ts, message if kind == "error" else None, steps))
    for doc in list(active):
        expire(doc, clock)
    return done


def feed(spark, rows, tmp_path, portions):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    for part in portions:
        rows(part, EVENT).write.mode("append").parquet(src)
        stream = spark.readStream.schema(rows([], EVENT).schema).parquet(src)
        OP.run_operations(stream, out, mark).awaitTermination()
    return out


def as_dict(df):
    got = [((r["document_id"], r["started_at"]), (r["status"], r["completed_at"], r["error"], r["step_count"])) for r in df.collect()]
    assert len(dict(got)) == len(got)
    return dict(got)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_within_the_delay(spark, rows, tmp_path, seed):
    """Three portions that overlap in time by less than the delay, and events of one again in the next."""
    r = random.Random(seed)
    events = [event(r.choice(["hot"] * 4 + list("abcd")), r.randint(0, 5000), i, r.choice(["start", "progress", "progress", "complete", "error"]))
              for i in range(400)]
    portions = [[], [], []]
    for e in events:
        at = (e[1] - T0).total_seconds()
        portions[min(2, int((at + r.randint(0, 500)) // 2000))].append(e)
    portions[1] += [e for e in portions[0] if (e[1] - T0).total_seconds() > 1800]
    portions[1] += portions[1][:40]
    portions[2] += [e for e in portions[1] if (e[1] - T0).total_seconds() > 3800]
    out = feed(spark, rows, tmp_path, portions)
    want = machine(events)
    assert as_dict(OP.read_closed(spark, out)) == want and len({v[0] for v in want.values()}) == 2
    assert any(v[2] == STALE for v in want.values())
    latest = [(r["document_id"], r["started_at"]) for r in OP.read_latest(spark, out).collect()]
    order = sorted(want, key=lambda k: (want[k][1], k[1]), reverse=True)
    assert len(latest) == min(50, len(want)) and {want[k][1] for k in latest[:10]} == {want[k][1] for k in order[:10]}


def test_late_events_and_expiry(spark, rows, tmp_path):
    out = feed(spark, rows, tmp_path, [
        [event("a", 0, 1, "start"), event("b", 10, 2, "start"), event("z", 1200, 3, "progress")],
        # the watermark is at 600: "a" has expired by now, and its end is too late to count
        [event("a", 20, 4, "complete"), event("b", 590, 5, "complete"), event("c", 700, 6, "start"), event("c", 1000, 7, "complete"),
         event("z", 1800, 8, "progress")],
        [event("d", 1500, 9, "start"), event("d", 1801, 10, "complete"), event("z", 2500, 11, "progress")],
    ])
    minute = timedelta(minutes=1)
    assert as_dict(OP.read_closed(spark, out)) == {
        ("a", T0): ("error", T0 + 5 * minute, STALE, 0),
        ("b", T0 + timedelta(seconds=10)): ("error", T0 + 5 * minute + timedelta(seconds=10), STALE, 0),
        ("c", T0 + timedelta(seconds=700)): ("completed", T0 + timedelta(seconds=1000), None, 0),
        ("d", T0 + timedelta(seconds=1500)): ("error", T0 + timedelta(seconds=1800), STALE, 0),
    }


def test_latest_are_folded_in_bounded_state(spark, rows, tmp_path):
    portions = [[e for i in range(40) for e in (event(f"{p}-{i}", 3000 * p + i, 100 * p + 2 * i, "start"), event(f"{p}-{i}", 3000 * p + 60 + i, 100 * p + 2 * i + 1, "complete"))]
                + [event("end", 3000 * p + 2000, 90_000 + p, "progress")] for p in range(3)]
    out = feed(spark, rows, tmp_path, portions)
    assert OP.read_closed(spark, out).count() == 120
    latest = [r["document_id"] for r in OP.read_latest(spark, out).collect()]
    assert latest == [f"2-{i}" for i in range(39, -1, -1)] + [f"1-{i}" for i in range(39, 29, -1)]
    assert len(list((tmp_path / "out" / "latest").glob("batch=*"))) == 2
    assert OP.read_latest(spark, str(tmp_path / "none")) is None


def test_a_group_of_documents_has_one_state(spark, rows, tmp_path):
    """A call of Python, and a value of the state, serve many documents."""
    r = random.Random(4)
    events = [event(f"d{r.randrange(60)}", r.randint(0, 3000), i, r.choice(["start", "progress", "complete", "error"])) for i in range(600)]
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    schema = rows([], EVENT).schema
    for lo, hi in ((0, 1500), (1500, 3001)):
        rows([e for e in events if lo <= (e[1] - T0).total_seconds() < hi], EVENT).write.mode("append").parquet(src)
        query = OP.run_operations(spark.readStream.schema(schema).parquet(src), out, mark, groups=3)
        query.awaitTermination()
        held = [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"] if s["operatorName"] == "applyInPandasWithState"
                or s["operatorName"] == "flatMapGroupsWithState"]
        assert held and max(held) <= 3
    assert as_dict(OP.read_closed(spark, out)) == machine(events)
