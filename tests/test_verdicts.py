"""Parsing, repair, routing and review rules, case by case."""

import json

import pytest
from pyspark.sql import functions as F

from sealgrade.functions import repair as R, text as T
from sealgrade.operators import quality, verdicts as M
from sealgrade.plans import presets

GOOD = {
    "classification": "Public", "confidence": 0.9, "summary": "s", "reasoning": "r",
    "evidence": [{"page": 1, "quote": "q", "reasoning": "e"}],
    "safety_assessment": {"is_safe": True, "flags": ["Safe"], "details": "Fine", "confidence": 0.8},
}


def answer(**changes):
    return json.dumps({k: v for k, v in (GOOD | changes).items() if v != "drop"})


def read(rows, text, **options):
    df = M.read_verdicts(rows([(text,)], "response_text string"), **options)
    r = df.first()
    return r["parse_status"], r["verdict"]


@pytest.mark.parametrize("text, status", [
    (answer(), "ok"),
    ("Sure: " + answer() + " bye", "ok"),
    ("no object at all", "No JSON found in response"),
    (None, "No JSON found in response"),
    ("} {", "No JSON found in response"),
    ("{not json}", "Invalid JSON"),
    (answer().replace('"', "'"), "Invalid JSON"),
    (answer() + " and " + answer(), "Invalid JSON"),
    (answer(summary="drop"), "Missing required field: summary"),
    (answer(safety_assessment="drop", evidence="drop"), "Missing required field: evidence"),
    (answer(summary=None), "ok"),
])
def test_parse_status(rows, text, status):
    got, verdict = read(rows, text)
    assert got == status
    if status != "ok":
        assert (verdict["classification"], verdict["confidence"]) == ("Confidential", 0.0)
        assert verdict["safety_assessment"]["confidence"] == 0.5
        assert status in verdict["reasoning"]


def test_labels(rows):
    assert read(rows, answer())[1]["additional_labels"] == []
    tagged = answer(government_content_detected=True, additional_labels=["A"])
    assert read(rows, tagged)[1]["additional_labels"] == ["A", "Government Content"]
    twice = answer(government_content_detected="yes", additional_labels=["Government Content"])
    assert read(rows, twice)[1]["additional_labels"] == ["Government Content"]
    assert read(rows, answer(government_content_detected=False))[1]["additional_labels"] == []


@pytest.mark.parametrize("flags, want", [
    ([], ["Safe"]), (["Violence"], ["Violence"]), (["Threats| Profane "], ["Threats", "Profanity"]),
    (["HACKING", "cyber-threat"], ["Cyber Threat", "Safe"]), (["unheard of"], ["Safe"]),
    (["child safety violation"], ["Safe"]), (["Potential_Criminal Content"], ["Criminal Activity"]),
    (["hate", "hateful", "threat"], ["Hate Speech", "Threats"]),
])
def test_flags(rows, flags, want):
    df = rows([(flags,)], "f array<string>")
    assert df.select(R.normalize_flags(F.col("f"))).first()[0] == want
    again = df.select(R.normalize_flags(R.normalize_flags(F.col("f")))).first()[0]
    assert again == want


def test_fixed_flags_take_official_names_in_any_casing(rows):
    df = rows([(["child safety violation"],)], "f array<string>")
    assert df.select(R.normalize_flags(F.col("f"), fixed=True)).first()[0] == ["Child Safety Violation"]


@pytest.mark.parametrize("safe, flags, details, want", [
    (True, ["Threats"], "Ok", (True, ["Safe"], "ok")),
    (False, ["Safe", "Threats"], "Bad", (False, ["Threats"], "bad")),
    (False, ["Safe"], "Bad", (True, ["Safe"], "bad")),
    (False, None, "Bad", (True, ["Safe"], "bad")),
    (False, ["Threats"], "Leaks an SSN", (True, ["Safe"], "No harmful content detected")),
    (None, None, None, (True, ["Safe"], "")),
])
def test_safety_repair(rows, safe, flags, details, want):
    df = rows([(safe, flags, details, None)], "s boolean, f array<string>, d string, c double")
    fixed = R.repair_safety(F.col("s"), F.col("f"), F.col("d"), F.col("c"))
    r = df.select(fixed.alias("r")).first()["r"]
    assert (r["is_safe"], r["flags"], r["details"], r["confidence"]) == (*want, 0.95)
    again = df.select(fixed.alias("r")).select(
        R.repair_safety(F.col("r.is_safe"), F.col("r.flags"), F.col("r.details"), F.col("r.confidence"))
        .alias("r")).first()["r"]
    # details are lower-cased again, all else is stable
    assert again["details"] == r["details"].lower()
    assert (again["is_safe"], again["flags"], again["confidence"]) == (r["is_safe"], r["flags"], r["confidence"])


def test_secondary_labels_and_confidence(rows):
    df = rows([("Public", 0.9, False, 0.6, ["legal document", "Custom", "Proprietary"])],
              "classification string, confidence double, is_safe boolean, safety_confidence double, "
              "additional_labels array<string>")
    r = M.label_verdicts(df).first()
    assert r["classification"] == "Unsafe" and r["confidence"] == 0.6
    assert r["secondary_labels"] == ["Legal Document", "Proprietary", "Unsafe"]
    assert r["additional_labels"][-1] == "Content Type: Public"
    assert r["label_confidence"] == pytest.approx(
        {"Unsafe": 0.6, "Legal Document": 0.81, "Proprietary": 0.81})


@pytest.mark.parametrize("kind, conf, safe, second, agree, basic, enhanced", [
    ("Public", 0.99, False, None, None, "Unsafe content", "Unsafe content"),
    ("Public", 0.72, True, None, None, None, "Low confidence score: 0.72"),
    ("Public", 0.60, True, "Public", True, "Low confidence score: 0.60", "Low confidence"),
    ("Public", 0.95, True, "Confidential", False, "LLM disagreement: Primary=Public", "LLM disagreement"),
    ("Highly Sensitive", 0.87, True, None, None, None, "Highly Sensitive classification requires very"),
    ("Highly Sensitive", 0.84, True, None, None, "Highly Sensitive classification requires high", "Highly"),
    ("Public", 0.95, True, None, None, None, None),
])
def test_review_needs(rows, kind, conf, safe, second, agree, basic, enhanced):
    df = rows([(kind, conf, safe, second, agree)], "k string, c double, s boolean, x string, a boolean")
    cols = [F.col(n) for n in "kcsxa"]
    empty = F.array().cast("array<struct<classification:string,contains_sensitive_visual:boolean>>")
    got = df.select(R.review_basic(*cols), R.review_enhanced(*cols, empty, empty)).first()
    for reason, want in zip(got, (basic, enhanced)):
        assert (reason is None) == (want is None)
        assert want is None or reason.startswith(want)


def test_enhanced_review_looks_at_images_and_segments(rows):
    df = rows([(["Public", "Unsafe", "Confidential"], [True, False])], "s array<string>, i array<boolean>")
    segments = F.transform("s", lambda x: F.struct(x.alias("classification")))
    images = F.transform("i", lambda x: F.struct(x.alias("contains_sensitive_visual")))
    base = [F.lit("Public"), F.lit(0.99), F.lit(True), F.lit(None), F.lit(None)]
    none = F.filter(images, lambda i: ~i["contains_sensitive_visual"])
    a, b = df.select(R.review_enhanced(*base, segments, images), R.review_enhanced(*base, segments, none)).first()
    assert a.startswith("Detected 1 images") and b.startswith("High variation")


def test_segment_rollup(rows):
    data = [("Public", 0.9), ("Confidential", 0.9), ("Confidential", 0.2)]
    df = rows([(data,), ([],), ([("Public", 0.0)],)], "s array<struct<classification:string,confidence:double>>")
    a, b, c = [r[0] for r in df.select(R.segment_rollup(F.col("s"))).collect()]
    assert a["classification_counts"] == {"Public": 1, "Confidential": 2}
    assert a["top_confidence_class"] == "Public" and a["suggests_sensitive"]
    assert b["top_confidence_class"] is None and not b["suggests_sensitive"]
    assert c["top_confidence_class"] is None and c["top_confidence"] == 0.0


def test_most_sensitive_is_symmetric(rows):
    from sealgrade.vocab import CLASSES
    df = rows([(a, b) for a in CLASSES for b in CLASSES], "a string, b string")
    r = df.select("a", "b", R.most_sensitive(F.col("a"), F.col("b")).alias("x"),
                  R.most_sensitive(F.col("b"), F.col("a")).alias("y")).collect()
    assert all(x["x"] == x["y"] == max(x["a"], x["b"], key=CLASSES.index) for x in r)


@pytest.mark.parametrize("first, second, verifier, want", [
    (("Public", 0.99), ("Unsafe", 0.1), None, ("Public", 0.99, None, "Skipped")),
    (("Public", 0.98), ("Public", 0.5), None, ("Public", 0.98, True, None)),
    (("Public", 0.8), ("Confidential", 0.6), None, ("Public", 0.8, False, "Verification agent blocked")),
    (("Public", 0.8), ("Confidential", 0.6), "hm", ("Confidential", 0.6, False, "Used conservative")),
    (("Public", 0.8), ("Confidential", 0.6),
     '{"final_classification": "Unsafe", "final_confidence": 0.7, "notes": "n"}', ("Unsafe", 0.7, False, "n")),
])
def test_routing(rows, first, second, verifier, want):
    df = rows([(first, second, verifier)],
              "primary_verdict struct<classification:string,confidence:double>, "
              "secondary_verdict struct<classification:string,confidence:double>, verification string")
    r = M.route_verification(df).first()
    assert (r["final_classification"], r["final_confidence"], r["consensus"]) == want[:3]
    notes = r["verification_notes"]
    assert (notes is None) == (want[3] is None) and (notes or "").startswith(want[3] or "")


def test_quick_exit_and_children(rows):
    found = '{"is_unsafe": true, "quick_flag": "violent", "evidence": "e", "severity": "High"}'
    df = rows([(1, found, "t" * 2000), (2, '{"is_unsafe": false}', "t"), (3, None, "t"), (4, "oops", "t")],
              "document_id int, quick_safety string, full_text string")
    out = M.quick_exit_verdict(M.with_quick_safety(df)).collect()
    assert [r["document_id"] for r in out] == [1]
    assert out[0]["safety_check"]["flags"] == ["Violence"] and len(out[0]["full_text"]) == 2000
    assert out[0]["confidence"] == 0.95 and out[0]["requires_review"]


def test_unknown_segment_class_discards_all(rows):
    bad = '[{"text": "a", "classification": "Public"}, {"text": "b", "classification": "Top"}]'
    good = '[{"text": "b", "confidence": 0.4}]'
    df = rows([(bad, "ab"), (good, "ab"), ("none", "ab")], "segments string, full_text string")
    got = [r["text_segments"] for r in M.with_segments(df).collect()]
    assert got[0] == [] and got[2] == [] and got[1][0]["start_char"] == 1


def test_batch_status_counts_each_request(rows):
    asked = rows([(1,), (2,), (2,), (3,)], "document_id int")
    done = rows([(1,), (2,), (9,)], "document_id int")
    r = M.batch_status(asked, done).first()
    assert (r["total_documents"], r["processed"], r["failed"], r["completed"]) == (4, 3, 1, True)


def test_unsafe_override_can_be_switched_off(rows):
    docs = rows([(1, "f.txt", ["p"], "p", 1, 0)],
                "document_id int, filename string, pages array<string>, full_text string, "
                "page_count int, image_count int")
    unsafe = answer(confidence=0.99, safety_assessment={
        "is_safe": False, "flags": ["Threats"], "details": "x", "confidence": 0.7})
    responses = rows([(1, "primary", 0, unsafe)],
                     "document_id int, role string, item int, response_text string")
    on = presets.enhanced(docs, responses).first()
    off = presets.enhanced(docs, responses, unsafe_override=False).first()
    assert (on["classification"], on["confidence"]) == ("Unsafe", 0.7)
    assert (off["classification"], off["confidence"]) == ("Public", 0.99)
    assert on["requires_review"] and off["requires_review"]
    basic = presets.basic(docs, responses).first()
    assert basic["classification"] == "Unsafe" and "Content Type: Public" in basic["additional_labels"]


def test_expectations(rows):
    schema = ("document_id int, classification string, confidence double, page_count int, "
              "safety_check struct<is_safe:boolean,flags:array<string>>, "
              "evidence array<struct<page:int,quote:string>>")
    verdicts = rows([
        (1, "Public", 0.9, 1, (True, ["Safe"]), [(1, "Fighter part")]),
        (2, "Unsafe", 0.5, 0, (False, ["Threats"]), []),
    ], schema)
    expect = rows([
        (1, "A", ["Public"], True, 0.85, True, True, ["aircraft", "part"], False),
        (2, "B", ["Unsafe"], False, 0.75, True, True, None, True),
        (3, "C", ["Public"], True, 0.7, False, False, None, False),
    ], "document_id int, test_id string, expected_classes array<string>, is_safe boolean, "
       "min_confidence double, need_evidence boolean, need_pages boolean, terms array<string>, "
       "need_flags boolean")
    checked = quality.check_expectations(verdicts, expect)
    got = {r["test_id"]: r for r in checked.collect()}
    assert got["A"]["status"] == "PASS" and got["A"]["warnings"] == [] and len(got["A"]["checks"]) == 6
    assert got["B"]["status"] == "FAIL" and got["B"]["failures"] == ["No evidence provided"]
    assert len(got["B"]["warnings"]) == 4
    assert got["C"]["status"] == "SKIP"
    s = quality.summary(checked).first()
    assert (s["passed"], s["failed"], s["skipped"], s["success_rate"]) == (1, 1, 1, "33.3%")


def test_no_segment_image_or_score_is_cut_off(rows):
    segs = [(f"s{i} ", "Public" if i != 54 else "Highly Sensitive", 0.9) for i in range(60)]
    df = rows([("".join(s[0] for s in segs), segs, [f'{{"classification": "Public", "confidence": {i / 100}}}' for i in range(14)],
                [("k", float(i) / 100) for i in range(30)])],
              "t string, s array<struct<text:string,classification:string,confidence:double>>, i array<string>, k array<struct<keyword:string,relevance_score:double>>")
    empty = F.lit(None)
    df = df.withColumn("s", F.transform("s", lambda x: F.struct(
        x.text, x.classification, x.confidence, empty.cast("array<string>").alias("keywords"), empty.cast("string").alias("reasoning"))))
    df = df.withColumn("k", F.transform("k", lambda x: F.struct(
        x.keyword, x.relevance_score, *[empty.cast(t).alias(n) for n, t in (("context_window", "string"), ("relationship_type", "string"), ("page", "int"), ("reasoning", "string"))])))
    r = df.select(T.locate_segments(F.col("t"), F.col("s")).alias("s"), R.parse_images(F.col("i")).alias("i"), R.keyword_relevance(F.col("k")).alias("k")).first()
    assert len(r.s) == 60 and r.s[54].classification == "Highly Sensitive" and r.s[59].end_char == len(df.first().t)
    assert [x.image_index for x in r.i] == list(range(14)) and len(r.k) == 30


def test_images_keep_their_places(rows):
    data = [("d", "images", i, f"a{i}") for i in range(14) if i != 3] + [("d", "primary", None, "p"), ("e", "primary", None, "q")]
    got = {r.document_id: r for r in M.responses_by_role(rows(data, "document_id string, role string, item int, response_text string")).collect()}
    assert [tuple(x) for x in got["d"].images] == [(i, f"a{i}") for i in range(14) if i != 3] and got["d"].primary == "p"
    assert got["e"].images == []


def test_image_numbers_cost_nothing(rows):
    """An answer's number may be anything; of two answers to one image the last text counts."""
    answer = '{"classification": "Confidential", "confidence": 0.9}'
    data = [("d", "images", 300_000_000, answer), ("d", "images", 7, "a"), ("d", "images", 7, answer), ("d", "images", -1, answer), ("d", "images", 2, None)]
    wide = M.responses_by_role(rows(data, "document_id string, role string, item int, response_text string"))
    got = M.with_images(wide).first().image_analyses
    assert [(x.image_index, x.page, x.classification) for x in got] == [(7, 8, "Confidential"), (300_000_000, 300_000_001, "Confidential")]


@pytest.mark.parametrize("change, status", [
    ({"classification": "Secret"}, "Invalid classification"), ({"confidence": None}, "Invalid confidence"),
    ({"confidence": 7.5}, "Invalid confidence"), ({"confidence": "high"}, "Invalid confidence"), ({"safety_assessment": None}, "Invalid safety assessment"),
])
def test_broken_values_become_the_fallback(rows, change, status):
    good = {"classification": "Public", "confidence": 0.95, "summary": "s", "reasoning": "r", "evidence": [],
            "safety_assessment": {"is_safe": True, "flags": ["Safe"], "details": "", "confidence": 0.9}}
    df = rows([(json.dumps(good),), (json.dumps(good | change),)], "response_text string")
    ok, bad = M.read_verdicts(df).collect()
    assert ok.parse_status == "ok" and (bad.parse_status, bad.verdict.confidence) == (status, 0.0)
