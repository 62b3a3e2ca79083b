"""Gold tables from changes against a full recomputation."""

import random

import pytest
from pyspark.sql import functions as F

from sealgrade.operators import dashboard as D, rollup as RU
from sealgrade.plans.medallion import Lakehouse

VERDICT = "document_id int, classification string, confidence double, requires_review boolean, safety_check struct<is_safe:boolean>"
REVIEW = "document_id int, seq bigint, original_classification string, corrected_classification string"


def verdict(r, i):
    return (i, r.choice(["Public", "Unsafe", "Confidential", None]), r.choice([0.98, 0.9, 0.1, 0.333, None]), r.choice([True, False, None]),
            r.choice([(True,), (False,), None]))


def review(r, i):
    return (i, i, r.choice(["Public", "Unsafe"]), r.choice(["Confidential", None]))


def figures(house):
    out = {}
    for name in ("classification_distribution", "confidence_analysis", "learning_effectiveness", "kpis"):
        df = house.table("gold", name).read()
        df = df.drop("timestamp")
        out[name] = sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in row) for row in df.select(*sorted(df.columns)).collect()), key=repr)
    return out


@pytest.mark.parametrize("buckets", [None, 8])
def test_three_batches_equal_a_full_pass(spark, rows, tmp_path, buckets):
    r = random.Random(6)
    house = Lakehouse(spark, str(tmp_path / "house"), buckets=buckets)
    verdicts = {i: verdict(r, i) for i in range(120)}
    reviews = {i: review(r, i) for i in range(60)}
    for batch in range(4):
        for i in r.sample(sorted(verdicts), 15):
            del verdicts[i]
        for i in range(200 + 20 * batch, 220 + 20 * batch):
            verdicts[i] = verdict(r, i)
        for i in r.sample(sorted(verdicts), 10):
            verdicts[i] = verdict(r, i)
        reviews[100 + batch] = review(r, 100 + batch)
        reviews.pop(batch)
        house.bronze(rows(list(verdicts.values()), VERDICT), rows(list(reviews.values()), REVIEW))
        if batch == 2:
            gone = sorted(verdicts)[:7]
            house.table("bronze", "classifications").delete(rows([(i,) for i in gone], "document_id int"))
            for i in gone:
                del verdicts[i]
        for _ in range(2):  # the second time there is nothing to do
            house.refresh_gold()
        whole = Lakehouse(spark, str(tmp_path / f"whole-{batch}"))
        whole.bronze(rows(list(verdicts.values()), VERDICT), rows(list(reviews.values()), REVIEW))
        whole.refresh_gold()
        assert figures(house) == figures(whole)
        plain = D.flat(whole.table("bronze", "classifications").read())
        assert sorted(map(tuple, D.class_distribution(plain).collect()), key=repr) == sorted(
            map(tuple, house.table("gold", "classification_distribution").read().collect()), key=repr)
    merges = [x["operation"] for x in house.table("state", "verdicts").history().collect()]
    assert len(merges) == len(set(merges)) == 4


def test_decimal_sums_leave_nothing_behind(rows):
    data = [(i, "Public", 0.1 + 0.2 * (i % 3), True, (True,)) for i in range(30)]
    v = D.flat(rows(data, VERDICT))
    state = RU.verdict_cells(v)
    gone = RU.verdict_cells(v.withColumn(RU.SIGN, F.lit(-1)))
    assert RU.merged(state, gone).collect() == []
    left = RU.merged(state, RU.verdict_cells(v.where("document_id > 0").withColumn(RU.SIGN, F.lit(-1)))).collect()
    assert len(left) == 1 and (left[0]["n"], float(left[0]["confidence"])) == (1, 0.1)


def test_no_rows(rows):
    empty = RU.verdict_cells(D.flat(rows([], VERDICT)))
    assert {r["metric"]: r["value"] for r in RU.kpis(empty).collect()} == dict.fromkeys(
        ("total_documents", "avg_confidence", "high_confidence_rate", "review_rate"), 0.0)
    assert RU.class_distribution(empty).collect() == []
