"""Nothing of a text is left out: results against plain Python over whole texts."""

import re

import pytest
from pyspark.sql import functions as F

from sealgrade.catalog import REGISTRY
from sealgrade.session import stage
from sealgrade.sources import adapters as A


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in A.table(spark, sf_dir, "documents").select("doc_id", "text").collect()}


def words(text):
    return list(dict.fromkeys(re.findall("[a-z]{5,}", text.lower())))


def test_evidence_of_every_page(spark, sf_dir, texts):
    assert max(len(t) for t in texts.values()) > 6000
    want = {(d, i // 2000 + 1) for d, t in texts.items() for i in range(0, len(t), 2000)}
    got = REGISTRY["c10_evidence_by_page"][0](spark, sf_dir).collect()
    assert {(r["document_id"], r["page"]) for r in got} == want
    for r in A.verdicts(spark, sf_dir).select("document_id", "evidence.quote", "all_keywords").collect():
        assert "".join(r["quote"]) == texts[r["document_id"]]
        assert r["all_keywords"] == words(texts[r["document_id"]])


def test_reviews_hold_whole_texts(spark, sf_dir, texts):
    got = A.learning_feedback(spark, sf_dir).select("document_id", "feedback_notes", "key_indicators").collect()
    assert any(len(r["feedback_notes"]) > 200 and len(r["key_indicators"]) > 6 for r in got)
    for r in got:
        assert r["feedback_notes"] == texts[r["document_id"]]
        assert r["key_indicators"] == words(texts[r["document_id"]])


def test_scoring_sees_whole_texts(spark, sf_dir, texts):
    from sealgrade.catalog import learning
    for r in learning._docs(spark, sf_dir).collect():
        assert r["preview"] == texts[r["document_id"]] and r["all_keywords"] == words(r["preview"])


def test_overrides_by_whole_texts(spark, sf_dir, texts):
    docs = A.classifications(spark, sf_dir).select("document_id", "filename", "classification").collect()
    rules = A.learning_feedback(spark, sf_dir).where("not approved").orderBy("seq").collect()
    want = {}
    for d in docs:
        hay = (d["filename"] + "\0" + texts[d["document_id"]]).lower()
        for r in rules:
            n = len(r["key_indicators"])
            hits = sum(i in hay for i in r["key_indicators"])
            if r["original_classification"] == d["classification"] and hits >= max(3, n / 2):
                want[d["document_id"]] = (r["corrected_classification"], hits, n)
                break
    got = REGISTRY["l02_learned_override"][0](spark, sf_dir).where("was_overridden").collect()
    assert {r["document_id"]: r["learned_classification"] for r in got} == {k: v[0] for k, v in want.items()}
    assert all("Matched %d/%d" % want[r["document_id"]][1:] in r["override_reason"] for r in got) and got


def test_features_of_whole_texts(spark, sf_dir, texts):
    from sealgrade.catalog.text import TEST_WORDS
    got = REGISTRY["f03_f07_keyword_counts"][0](spark, sf_dir).collect()
    assert any(r["document_id"] % 10 == 0 and r["technical_count"] for r in got)
    for r in got:
        low = texts[r["document_id"]].lower()
        for name in ("form", "defense", "government", "marketing", "technical"):
            assert r[f"{name}_count"] == sum(w in low for w in getattr(TEST_WORDS, name)), name


def test_features_without_a_text(rows):
    from sealgrade.operators import features as FT
    r = FT.detect_features(rows(
        [("plain.txt", None, 0)], "filename string, preview string, image_count int")).first()
    assert not r["pii_data"] and r["form_count"] == 0 and not r["potential_multi_label"]


def test_preview_of_all_blocks(rows):
    from sealgrade.operators import pagination as P
    df = rows([(1, ["a" * 1500, "b"], 0)], "document_id int, pages array<string>, image_count int")
    assert P.with_preview(df).first()["preview"].endswith("Page 2:\nb")
    assert len(P.with_preview(df, max_blocks=5, chars=1000).first()["preview"]) == 1000


def test_learned_words_late_in_a_text(rows):
    """A rule's word after character 1000 lowers the confidence of the basic route."""
    from sealgrade.plans import presets
    feedback = rows(
        [(str(i), i, "r", False, "Unsafe", "Public", "", "t", "zeppelin") for i in range(3)],
        "document_id string, seq bigint, reviewer_id string, approved boolean, corrected_classification string, "
        "original_classification string, feedback_notes string, timestamp string, filename string")
    text = "x" * 3000 + " zeppelin"
    docs = rows([("d", "d.txt", [text], text, 1, 0)], "document_id string, filename string, pages array<string>, "
                "full_text string, page_count int, image_count int")
    answer = ('{"classification":"Confidential","confidence":0.95,"summary":"s","reasoning":"r","evidence":[],'
              '"safety_assessment":{"is_safe":true,"flags":["none"],"details":"d","confidence":0.9}}')
    responses = rows([("d", "primary", 0, answer)], "document_id string, role string, item int, response_text string")
    r = presets.basic(docs, responses, presets.learn(feedback), auto_approve_at=None).first()
    assert r["requires_review"] and "zeppelin" in r["review_reason"]
    assert r["confidence"] == pytest.approx(0.95 * 0.7)


def test_unsafe_documents_keep_their_text(rows):
    from sealgrade.operators import verdicts as M
    from sealgrade.plans import presets
    text, seen = "t" * 5000 + "end", "e" * 300
    docs = rows([("d", "d.txt", [text], text, 1, 0)], "document_id string, filename string, pages array<string>, "
                "full_text string, page_count int, image_count int")
    found = '{"is_unsafe": true, "quick_flag": "violent", "evidence": "%s"}' % seen
    responses = rows([("d", "quick_safety", 0, found)],
                     "document_id string, role string, item int, response_text string")
    r = presets.enhanced(docs, responses).first()
    assert r["classification"] == "Unsafe" and r["full_text"] == text and r["evidence"][0]["quote"] == seen
    cut = M.quick_exit_verdict(
        M.with_quick_safety(docs.withColumn("quick_safety", F.lit(found))), text_chars=10, quote_chars=5).first()
    assert cut["full_text"] == text[:10] and cut["evidence"][0]["quote"] == "eeeee"


def test_reviews_remember_everything(spark, sf_dir, texts):
    """Stored reviews hold all evidence, keywords and indicators of a long verdict."""
    from sealgrade.operators import feedback as FB
    v = stage(A.verdicts(spark, sf_dir).orderBy(F.length("full_text").desc()).limit(1))
    said = v.select("document_id", F.lit("Unsafe").alias("corrected_classification"), F.lit("").alias("notes"),
                    F.lit("t").alias("timestamp"))
    r = FB.intake(FB.rejection(said, "reviewer"), v).first()
    text = texts[r["document_id"]]
    assert "".join(e["quote"] for e in r["document_context"]["key_evidence"]) == text
    assert r["document_context"]["keywords"] == words(text) and len(words(text)) > 20
    assert set(words(text)) <= set(r["key_indicators"])
    few = FB.intake(FB.rejection(said, "reviewer"), v, FB.document_context("v.", 3, 200, 20),
                    FB.key_indicators("v.", 15, 20)).first()
    assert len(few["document_context"]["key_evidence"]) == 3 and len(few["key_indicators"]) <= 20


def test_all_common_words_and_patterns_are_kept(spark, rows):
    from sealgrade.operators import mining, patterns as P
    notes = " ".join(f"common{i}" for i in range(30))
    n = rows([("Public", "Unsafe", i, notes) for i in range(2)],
             "original_classification string, human_classification string, seq bigint, reasoning string")
    assert P.common_words(n).count() == 30 and P.common_words(n, top=10).count() == 10
    assert len(P.context_patterns(n).first()["common_indicators"]) == 30
    assert len(P.context_patterns(n, top=10, indicators=5).first()["common_indicators"]) == 5
    assert mining.top_patterns(spark.range(60).withColumnRenamed("id", "count")).count() == 60


def test_gold_holds_misclassifications(spark, sf_dir, tmp_path):
    from sealgrade.plans.medallion import Lakehouse
    house = Lakehouse(spark, str(tmp_path))
    learning = A.learning_feedback(spark, sf_dir)
    house.bronze(A.verdicts(spark, sf_dir).drop("full_text"), learning)
    house.gold()
    pairs = learning.where("original_classification <> corrected_classification").select(
        "original_classification", "corrected_classification").distinct().count()
    assert pairs and house.table("gold", "misclassifications").read().count() == pairs
