"""Feedback merging, learned patterns and learned scoring."""

import random

import pytest
from pyspark.sql import functions as F

from sealgrade.operators import feedback as FB, learned as LN, patterns as P

FEEDBACK = ("document_id string, seq bigint, reviewer_id string, approved boolean, "
            "corrected_classification string, original_classification string, feedback_notes string, "
            "timestamp string, filename string, key_indicators array<string>")


def entry(doc, seq, approved=False, to="Highly Sensitive", frm="Public", notes="", name="x.pdf",
          ts="2025-01-01", words=None, who="r"):
    return (doc, seq, who, approved, None if approved else to, frm, notes, ts, name, words or [])


@pytest.fixture
def five(rows):
    """Five corrections that share one file-name word; words seen two and three times."""
    return rows([
        entry("a", 0, name="shared_one alpha.pdf shared", notes="salary salary employee"),
        entry("b", 1, name="shared alpha twice", notes="salary record Employee"),
        entry("c", 2, name="shared alpha twice", to="Confidential", notes="other words"),
        entry("d", 3, name="shared", notes="record"),
        entry("e", 4, approved=True, name="shared twice", notes="salary"),
    ], FEEDBACK)


def test_keyword_patterns(five):
    got = {r["keyword"]: r for r in P.keyword_patterns(FB.normalize_feedback(five)).collect()}
    # "shared_one" is one word; "shared" occurs once in each of four names
    assert {k: (r["correction_count"], round(r["confidence_multiplier"], 6)) for k, r in got.items()} == {
        "shared": (4, 0.6), "alpha": (3, 0.7), "twice": (2, 0.8)}
    assert got["alpha"]["common_to"] == "Highly Sensitive" and got["alpha"]["common_count"] == 2
    # a tie goes to the pair seen first
    assert got["twice"]["common_to"] == "Highly Sensitive"


def test_multiplier_stops_at_one_half(rows):
    df = rows([entry(str(i), i, name="word") for i in range(9)], FEEDBACK)
    r = P.keyword_patterns(FB.normalize_feedback(df)).first()
    assert (r["correction_count"], r["confidence_multiplier"]) == (9, 0.5)


def test_context_patterns_and_common_words(five):
    r = P.context_patterns(FB.normalize_feedback(five)).collect()
    assert len(r) == 1 and r[0]["frequency"] == 3
    assert r[0]["common_indicators"] == ["salary", "employee", "record"]
    assert r[0]["rule"] == "Documents with 'salary, employee, record' are often Highly Sensitive, not Public"


def test_rates_and_accuracy(five):
    n = FB.normalize_feedback(five)
    assert P.correction_rate(n).first()["correction_rate"] == 0.8
    r = P.accuracy_by_class(n).first()
    assert (r["accuracy"], r["total_reviews"], r["correct"]) == (20.0, 5, 1)
    s = P.learning_summary(n).first()
    assert s["correction_rate"] == "80.0%" and s["examples_available"] == 5


def test_raw_keys_only_sees_no_human_class(five):
    n = FB.normalize_feedback(five, raw_keys_only=True)
    assert P.correction_rate(n).first()["correction_rate"] == 1.0


def test_no_feedback(rows):
    n = FB.normalize_feedback(rows([], FEEDBACK))
    assert P.correction_rate(n).first()["correction_rate"] == 0.0
    assert P.learning_summary(n).first()["total_feedback"] == 0


def test_upsert_keeps_place_and_is_idempotent(rows):
    learning = rows([entry("a", 0, who="old"), entry("b", 1, who="old")], FEEDBACK)
    incoming = rows([entry("c", 0, who="new"), entry("a", 1, who="new"), entry("a", 2, who="newer")], FEEDBACK)
    once = FB.upsert_learning(learning, incoming)
    got = [(r["document_id"], r["reviewer_id"]) for r in once.orderBy("seq").collect()]
    assert got == [("a", "newer"), ("b", "old"), ("c", "new")]
    again = FB.upsert_learning(once, incoming)
    assert [(r["document_id"], r["reviewer_id"]) for r in again.orderBy("seq").collect()] == got


def test_union_takes_first_archive_row_of_new_documents(rows):
    learning = rows([entry("a", 0, who="db")], FEEDBACK)
    archive = rows([entry("b", 5, who="late"), entry("b", 2, who="early"), entry("a", 1, who="no")], FEEDBACK)
    got = [(r["document_id"], r["reviewer_id"]) for r in FB.union_feedback(learning, archive).orderBy("seq").collect()]
    assert got == [("a", "db"), ("b", "early")]


def test_apply_feedback_in_order(rows):
    verdicts = rows([("a", "Public", True), ("b", "Public", True)],
                    "document_id string, classification string, requires_review boolean")
    reviews = rows([
        entry("a", 0, to="Confidential", who="one"), entry("a", 1, to="Unsafe", who="two"),
        entry("a", 2, approved=True, who="three")], FEEDBACK)
    got = {r["document_id"]: r for r in FB.apply_feedback(verdicts, reviews).collect()}
    a, b = got["a"], got["b"]
    assert (a["classification"], a["original_classification"], a["reviewed_by"]) == ("Unsafe", "Confidential", "three")
    assert a["human_corrected"] and a["feedback_approved"] and not a["requires_review"]
    assert b["requires_review"] and not b["human_reviewed"] and b["reviewed_by"] is None


def test_recent_search_and_export(rows):
    df = rows([entry("a", 0, ts=None, notes="Straße"), entry("b", 1, ts="2025-02-01", approved=True),
               entry("c", 2, ts="2025-03-01", words=["Salary"])], FEEDBACK)
    assert [r["document_id"] for r in FB.recent(df, 3).collect()] == ["c", "b", "a"]
    assert [r["document_id"] for r in FB.search(df, ["SALARY"]).collect()] == ["c"]
    assert [r["document_id"] for r in FB.search(df, ["straße"]).collect()] == ["a"]
    assert {r["correct_classification"] for r in FB.training_export(df).collect()} == {"Highly Sensitive"}


# --- scoring ----------------------------------------------------------------

DOCS = ("document_id int, classification string, confidence double, filename string, preview string, "
        "all_keywords array<string>")


def reference_adjust(doc, accuracy, keywords, patterns):
    """The rules in plain Python, one document at a time."""
    _, kind, conf, name, preview, _ = doc
    reason = None
    if kind in accuracy and accuracy[kind] < 70:
        conf *= 0.85
        reason = f"AI has {accuracy[kind]:.1f}% accuracy for {kind} (below threshold)"
    for word, (count, factor) in keywords:
        if word in name.lower() or word in preview.lower():
            conf *= factor
            if factor < 0.8:
                reason = f"Documents with '{word}' have been corrected {count} times"
    for frm, to, words in patterns:
        if frm == kind and sum(w in preview.lower() for w in words) >= 2:
            conf *= 0.75
            reason = f"Similar documents have been reclassified as {to}"
    return max(0.1, min(1.0, conf)), reason


def random_case(rng, size):
    vocabulary = [f"{a}{b}" for a in ("alpha", "gamma", "delta", "omega") for b in ("one", "two", "six", "ten")]
    classes = ["Public", "Confidential", "Highly Sensitive", "Unsafe"]

    def text(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    feedback = [
        entry(str(i), i, approved=rng.random() < 0.3, to=rng.choice(classes), frm=rng.choice(classes),
              name=text(2) + ".pdf", notes=text(6),
              words=[rng.choice(vocabulary + ["", "x", "ab"]) for _ in range(rng.randint(0, 8))])
        for i in range(size)
    ]
    docs = [(i, rng.choice(classes), rng.random(), text(1) + ".TXT", text(rng.randint(0, 5)).upper(),
             [rng.choice(vocabulary).upper() for _ in range(3)]) for i in range(60)]
    return feedback, docs


@pytest.mark.parametrize("round_bytes", [8 << 20, 100])
def test_adjusted_confidence_matches_a_loop(rows, round_bytes):
    feedback, docs = random_case(random.Random(1), 25)
    n = FB.normalize_feedback(rows(feedback, FEEDBACK))
    acc, kw, ctx = P.accuracy_by_class(n), P.keyword_patterns(n), P.context_patterns(n)
    accuracy = {r["classification"]: r["accuracy"] for r in acc.collect()}
    keywords = [(r["keyword"], (r["correction_count"], r["confidence_multiplier"]))
                for r in kw.orderBy("first_seq", "first_pos").collect()]
    patterns = [(r["original_classification"], r["human_classification"], r["common_indicators"])
                for r in ctx.orderBy("first_seq").collect()]
    assert keywords and patterns
    got = {r["document_id"]: r for r in LN.adjust_confidence(rows(docs, DOCS), acc, kw, ctx, round_bytes=round_bytes).collect()}
    assert len(got) == len(docs)
    for d in docs:
        conf, reason = reference_adjust(d, accuracy, keywords, patterns)
        r = got[d[0]]
        assert r["adjusted_confidence"] == pytest.approx(conf, abs=1e-9)
        assert (r["learned_reason"], r["learned_review"]) == (reason, reason is not None)
        assert 0.1 <= r["adjusted_confidence"] <= 1.0


@pytest.mark.parametrize("round_bytes", [8 << 20, 3000])
def test_override_matches_a_loop(rows, round_bytes):
    feedback, docs = random_case(random.Random(2), 60)
    got = {r["document_id"]: r for r in LN.apply_override(
        rows(docs, DOCS), rows(feedback, FEEDBACK), round_bytes=round_bytes).collect()}
    applied = 0
    for doc, kind, conf, name, preview, keywords in docs:
        want, sure, reason = kind, conf, None
        low = {k.lower() for k in keywords}
        for f in feedback:
            if f[3] or f[5] != kind:
                continue
            hits = sum(1 for i in f[9] if i in preview.lower()[:2000] or i in name.lower() or i in low)
            if hits >= max(3, len(f[9]) * 0.5):
                want, sure = f[4], min(0.98, conf + 0.10)
                reason = f"Matched {hits}/{len(f[9])} indicators"
                break
        r = got[doc]
        assert r["learned_classification"] == want and r["learned_confidence"] == pytest.approx(sure)
        assert r["was_overridden"] == (reason is not None)
        assert reason is None or reason in r["override_reason"]
        applied += reason is not None
    assert 5 < applied < len(docs)


def test_short_keywords_match(rows):
    rules = rows([("w2", 4, 0, 0), ("form", 3, 1, 0), ("é", 2, 2, 0), ("xyz", 5, 3, 0)],
                 "keyword string, correction_count bigint, first_seq bigint, first_pos int")
    docs = rows([(1, "Public", 0.9, "form.pdf", "a w2 here", []), (2, "Public", 0.9, "x.pdf", "none", []),
                 (3, "Public", 0.9, "x", "yz CAFÉ", []), (4, "Public", 0.9, None, None, [])], DOCS)
    got = {r["document_id"]: r["keyword_factor"] for r in LN.match_keyword_rules(docs, rules).collect()}
    # the name's end and the text's beginning make no match
    assert got == {1: pytest.approx(0.42), 2: 1.0, 3: pytest.approx(0.8), 4: 1.0}


def test_indicators_count_in_the_whole_text(rows):
    words = ["alphaone", "gammasix", "omegaten"]
    feedback = rows([entry("a", 1, approved=False, to="Unsafe", frm="Public", name="x.pdf", notes="n" * 200, words=words)], FEEDBACK)
    docs = rows([(1, "Public", 0.5, "y.pdf", "z" * 3000 + " ".join(words), [])], DOCS)
    whole = LN.apply_override(docs, feedback).first()
    assert whole["was_overridden"] and whole["learned_classification"] == "Unsafe"
    assert whole["override_reason"].endswith(": " + "n" * 100)
    assert LN.apply_override(docs, feedback, note_chars=None).first()["override_reason"].endswith(": " + "n" * 200)
    assert not LN.apply_override(docs, feedback, preview_chars=2000).first()["was_overridden"]


def test_no_rules(rows):
    feedback, docs = random_case(random.Random(3), 0)
    n = FB.normalize_feedback(rows(feedback, FEEDBACK))
    got = LN.adjust_confidence(rows(docs, DOCS), P.accuracy_by_class(n), P.keyword_patterns(n), P.context_patterns(n)).collect()
    assert len(got) == len(docs) and not any(r["learned_review"] for r in got)
    got = LN.apply_override(rows(docs, DOCS), rows(feedback, FEEDBACK)).collect()
    assert len(got) == len(docs) and not any(r["was_overridden"] for r in got)
    assert LN.apply_override(rows([], DOCS), rows(random_case(random.Random(3), 9)[0], FEEDBACK)).collect() == []


def test_documents_stay_where_they_are(rows):
    """Neither way of learned scoring shuffles documents or makes a row per run of a text."""
    feedback, docs = random_case(random.Random(5), 30)
    n = FB.normalize_feedback(rows(feedback, FEEDBACK))
    for df in (LN.match_keyword_rules(rows(docs, DOCS), P.keyword_patterns(n)),
               LN.apply_override(rows(docs, DOCS), rows(feedback, FEEDBACK))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Generate" not in plan


def test_same_source_class_keeps_the_last_warning(rows):
    frequent = rows([("Public", "Confidential", 9, 0, 50.0), ("Public", "Unsafe", 4, 3, 20.0),
                     ("Unsafe", None, 2, 1, 10.0), ("Confidential", "Public", 1, 2, 5.0)],
                    "original_classification string, human_classification string, count bigint, "
                    "first_seq bigint, percentage double")
    patterns = rows([("Public", "Unsafe", 3, "rule text")],
                    "original_classification string, human_classification string, first_seq bigint, rule string")
    got = LN.prompt_enhancements(frequent, patterns).orderBy("group", "position").collect()
    assert [r["key"] for r in got] == ["warning_Public", "warning_Unsafe", "rule_Public_to_Unsafe"]
    assert "'Unsafe' 4 times" in got[0]["text"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_parts_of_rules_follow_each_other(rows):
    """However many parts the rules have, a task that reads the result runs no row of Python processes, one a part."""
    feedback, docs = random_case(random.Random(6), 40)
    n = FB.normalize_feedback(rows(feedback, FEEDBACK))
    keywords, patterns = P.keyword_patterns(n), P.context_patterns(n)
    for df in (LN.match_keyword_rules(rows(docs, DOCS), keywords, round_bytes=100),
               LN.adjust_confidence(rows(docs, DOCS), P.accuracy_by_class(n), keywords, patterns, round_bytes=100),
               LN.apply_override(rows(docs, DOCS), rows(feedback, FEEDBACK), round_bytes=3000)):
        assert plan_of(df).count("MapInArrow") == 0
        assert sorted(r["document_id"] for r in df.collect()) == sorted(d[0] for d in docs)


def test_similar_words_are_counted_not_listed(rows):
    """What a document holds of learned words leaves the search as one row a pattern."""
    words = [f"word{i:04d}" for i in range(400)]
    patterns = rows([("Public", "Unsafe", 2, words), ("Public", "Confidential", 1, words), ("Unsafe", None, 3, words)],
                    "original_classification string, human_classification string, first_seq bigint, common_indicators array<string>")
    needles = patterns.select(F.explode("common_indicators").alias("w"), F.col("original_classification").alias("c"),
                              F.col("first_seq").alias("o"))
    docs = rows([(1, "Public", " ".join(words)), (2, "Unsafe", "word0001 word0002"), (3, None, "word0001"), (4, "Public", None)],
                "id int, kind string, body string")
    from sealgrade.operators.substrings import with_counts
    for size in (8 << 20, 4000):
        got = {r["id"]: r["found"] for r in with_counts(docs, "body", needles, ["o"], ("kind", "c"), "w", round_bytes=size).collect()}
        assert got[3] == got[4] == [] and {x["o"] for x in got[1]} == {1, 2} and [x["o"] for x in got[2]][0] == 3
        assert {o: sum(x["hits"] for x in got[1] if x["o"] == o) for o in (1, 2)} == {1: 400, 2: 400}
        assert size < 8 << 20 or len(got[1]) == 2


@pytest.mark.parametrize("rare, together", [(1, 1 << 21), (2, 50), (12, 1 << 21), (99, 1)])
def test_rules_by_rare_words_match_a_loop(monkeypatch, rare, together):
    import numpy as np
    import pyarrow as pa
    monkeypatch.setattr(LN, "_RARE", rare)
    monkeypatch.setattr(LN, "_TOGETHER", together)
    rng = random.Random(rare)
    vocabulary = [f"w{i:02d}" for i in range(40)]
    rules = [(i, rng.choice("AB"), [rng.choice([*vocabulary, None]) for _ in range(rng.randint(3, 30))]) for i in range(80)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 30))) for _ in range(50)] + [None]
    classes = [rng.choice("ABC") for _ in range(50)] + [None]
    words = sorted({w for _, _, x in rules for w in x if w})
    table = pa.table({"seq": [r[0] for r in rules], "rule_from": [r[1] for r in rules], "rule_to": ["x"] * 80,
                      "notes": [""] * 80, "indicators": pa.array([r[2] for r in rules], pa.list_(pa.string()))})
    index = LN.RuleIndex(table, {}, [w.encode() for w in words], np.array([words.index(w) if w else -1 for _, _, x in rules for w in x]))
    got = index.first_rules(pa.array(texts, pa.string()), pa.array([[]] * 51, pa.list_(pa.string())), pa.array(classes, pa.string())).to_pylist()
    found = 0
    for text, kind, r in zip(texts, classes, got, strict=True):
        hits = ((i, sum(w is not None and w in (text or "") for w in x), len(x)) for i, c, x in rules if c == kind)
        want = next(((i, h, n) for i, h, n in hits if h >= max(3, n / 2)), None)
        assert (r and (r["seq"], r["hits"], r["n"])) == want
        found += want is not None
    assert 5 < found < 50


def test_whole_jobs_of_both_kinds_of_rules(spark, tmp_path):
    """Every document is scored and overridden, not only counted or listed."""
    from sealgrade.catalog import REGISTRY
    text = "alphaone betatwos gammathree deltafour license"
    spark.createDataFrame([(i, "web", "en", text, len(text)) for i in range(1, 9)], "doc_id long, source string, lang string, text string, n_chars long"
                          ).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0 if i < 5 else 1, 0) for i in range(1, 7)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    scored = {r["document_id"]: r for r in REGISTRY["j05_keyword_rules"][0](spark, str(tmp_path)).collect()}
    assert set(scored) == set(range(1, 9)) and all(r["adjusted_confidence"] < 0.6 and r["learned_review"] for r in scored.values())
    changed = {r["document_id"]: r for r in REGISTRY["j06_correction_rules"][0](spark, str(tmp_path)).collect()}
    assert set(changed) == set(range(1, 9))
    assert all(r["was_overridden"] and r["learned_classification"] == "Highly Sensitive" for r in changed.values())


def test_rounds_of_rules_share_one_search_of_the_texts(rows, monkeypatch):
    """However many rounds the rules take, texts are searched for their different words once, and a text that found its
    rule is out of the rounds that follow."""
    from sealgrade.operators import substrings as S
    feedback, docs = random_case(random.Random(7), 120)
    docs = [*docs, (60, None, 0.5, None, None, None), (61, "Public", 0.5, "", "", [None, "ALPHAONE"])]
    searches, rounds = [], []
    monkeypatch.setattr(LN, "NeedleIndex", lambda *a: searches.append(1) or S.NeedleIndex(*a))

    def finds(texts, row, inputs, *rest):
        if len(inputs) == 2:
            rounds.append(texts.count())
        return S.finds(texts, row, inputs, *rest)

    monkeypatch.setattr(LN, "finds", finds)
    whole = LN.apply_override(rows(docs, DOCS), rows(feedback, FEEDBACK))
    parts = LN.apply_override(rows(docs, DOCS), rows(feedback, FEEDBACK), round_bytes=1000)
    assert len(searches) == 2 and len(rounds) > 3 and rounds == sorted(rounds, reverse=True) and rounds[-1] < rounds[0]
    order = lambda df: sorted(map(tuple, df.select("document_id", "learned_classification", "learned_confidence", "was_overridden", "override_reason").collect()))
    assert order(whole) == order(parts) and any(r[3] for r in order(parts))


def test_texts_do_not_meet_by_class(rows, spark, monkeypatch):
    """Texts of the rules' classes are chosen where they are, not in one task a class."""
    from sealgrade.operators import substrings as S
    feedback, docs = random_case(random.Random(9), 60)
    n, plans, finds = FB.normalize_feedback(rows(feedback, FEEDBACK)), [], S.finds
    for module in (LN, S):
        monkeypatch.setattr(module, "finds", lambda texts, *rest: plans.append(plan_of(texts)) or finds(texts, *rest))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        LN.apply_override(rows(docs, DOCS), rows(feedback, FEEDBACK), round_bytes=1000)
        LN.adjust_confidence(rows(docs, DOCS), P.accuracy_by_class(n), P.keyword_patterns(n), P.context_patterns(n), round_bytes=100)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    chosen = [x for x in plans if "LeftSemi" in x]
    assert len(chosen) >= 2 and not any("SortMergeJoin" in x for x in chosen)


@pytest.mark.parametrize("round_bytes", [8 << 20, 1])
def test_rules_of_one_seq_and_of_none(rows, round_bytes):
    """Rules that share their place in order, or have none, are taken alike in one round and in many; indicators that come
    twice count twice, nulls never."""
    words = ["alphaone", "gammasix", "omegaten"]
    entries = [entry(str(i), seq, approved=False, to=to, frm="Public", name="x", notes=notes, words=own) for i, (seq, to, notes, own) in enumerate([
        (None, "Unsafe", "none", words), (5, "Unsafe", "late", words), (5, "Confidential", "b", words), (5, "Confidential", "a", words),
        (1, "Unsafe", "too few", [*words[:2], None, None]), (2, "Unsafe", "twice", ["deltaone", "deltaone", "deltatwo", None])])]
    docs = [(1, "Public", 0.5, "n", " ".join(words), []), (2, "Public", 0.5, "n", "deltaone", ["DELTATWO"]), (3, "Unsafe", 0.5, "n", " ".join(words), [])]
    got = {r["document_id"]: r["override_reason"] for r in LN.apply_override(rows(docs, DOCS), rows(entries, FEEDBACK), round_bytes=round_bytes).collect()}
    assert got[1].endswith("→ 'Confidential'. Matched 3/3 indicators. Human feedback: a")
    assert got[2].endswith("Matched 3/4 indicators. Human feedback: twice") and got[3] is None


def test_texts_of_other_classes_are_not_searched(rows, monkeypatch):
    """A text whose class no rule is for cannot be overridden, nor have a similar pattern: it is not looked at."""
    import pyarrow as pa
    from sealgrade.operators import substrings as S
    seen = []
    for module in (LN, S):
        monkeypatch.setattr(module, "found_in", lambda index, texts, f=S.found_in: seen.append(len(texts)) or f(index, texts))
    rules = pa.table({"seq": [1], "rule_from": ["A"], "rule_to": ["x"], "notes": [""], "indicators": pa.array([["one", "two", "six"]], pa.list_(pa.string()))})
    index = LN.RuleIndex(rules, None, [b"one", b"two", b"six"], LN.np.arange(3))
    texts = pa.array(["one two six", "one two six", None, "one"])
    got = index.first_rules(texts, pa.array([[], [], [], ["two", "six"]], pa.list_(pa.string())), pa.array(["B", "A", None, "A"])).to_pylist()
    assert [r and r["hits"] for r in got] == [None, 3, None, 3]
    assert seen[0] == 2


def test_scoring_reads_texts_once_and_shuffles_none(rows, spark, monkeypatch):
    """No pass over the texts is made to build an index, and documents do not meet the accuracy of their class in one task a class."""
    from sealgrade.operators import substrings as S
    read = []
    monkeypatch.setattr(S, "text_counts", lambda *a: read.append(1) or {})
    feedback, docs = random_case(random.Random(8), 30)
    n = FB.normalize_feedback(rows(feedback, FEEDBACK))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = LN.adjust_confidence(rows(docs, DOCS), P.accuracy_by_class(n), P.keyword_patterns(n), P.context_patterns(n))
        assert "SortMergeJoin" not in plan_of(df) and len(df.collect()) == len(docs)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not read


def test_the_preset_gives_the_override_no_answers_or_pages(spark, tmp_path, monkeypatch):
    """Rules of many rounds write the rows that they are given: texts that nothing reads again are not among them."""
    from sealgrade.catalog import REGISTRY
    from sealgrade.plans import presets
    text = "alphaone betatwos gammathree deltafour license"
    spark.createDataFrame([(i, "web", "en", text, len(text)) for i in range(1, 9)], "doc_id long, source string, lang string, text string, n_chars long"
                          ).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0 if i < 5 else 1, 0) for i in range(1, 7)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = []
    override = LN.apply_override
    monkeypatch.setattr(presets.L, "apply_override", lambda df, *a, **k: seen.append(df.columns) or override(df, *a, **k))
    rows = REGISTRY["preset_enhanced_learned"][0](spark, str(tmp_path)).collect()
    assert len(rows) == 8 and any(r["classification"] == "Highly Sensitive" for r in rows)
    assert len(seen) == 1 and not {"pages", "primary", "secondary", "verification", "primary_verdict", "secondary_verdict"} & set(seen[0])
