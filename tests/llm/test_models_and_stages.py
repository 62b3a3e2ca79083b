"""Models against plain formulas; filtering stages on odd tables and very long texts."""

import importlib
import math
import random
import time

import numpy as np
import pytest

from sealgrade.llm import decontamination, language_id, ngram_join, pii, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice([f"w{i}" for i in range(400)]) for _ in range(n))


# ---- models


def test_ordinal_gradient_is_that_of_the_loss():
    r = np.random.default_rng(1)
    rows = [r.choice(12, r.integers(0, 6), replace=False) for _ in range(40)]
    row, col = np.repeat(np.arange(40), [len(x) for x in rows]), np.concatenate(rows).astype(np.int64)
    y, weight = r.integers(0, 3, 40), r.random(40)
    weight /= weight.sum()
    p = r.normal(size=14)
    _, grad = toxicity.ordinal_loss(p, row, col, y, weight, 12)
    for i in range(14):
        up, down = p.copy(), p.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        slope = (toxicity.ordinal_loss(up, row, col, y, weight, 12)[0] - toxicity.ordinal_loss(down, row, col, y, weight, 12)[0]) / 2e-5
        assert grad[i] == pytest.approx(slope, abs=1e-7)


def test_severity_is_the_expected_grade(rows):
    model = toxicity.Model({"bad": 0, "ba": 1}, np.array([1.5, 0.5, 0.25, 0.1, 0.7] + [0.0] * 5), np.array([0.3, 2.0]))
    got = {r.doc_id: r for r in toxicity.grade(rows([(1, "bad day", None, None, 0), (2, "bad bad", None, None, 0), (3, "fine", None, None, 0)], DOCS), model).collect()}
    for doc_id, score in ((1, 1.5 + 0.1 + 0.7), (2, 1.5 + 0.5 + 0.1 + 0.7), (3, 0.0)):
        above = [1 / (1 + math.exp(t - score)) for t in (0.3, 2.0)]
        chance = [1 - above[0], above[0] - above[1], above[1]]
        r = got[doc_id]
        assert r.severity == pytest.approx(sum(g * p for g, p in enumerate(chance)))
        assert (r.p_toxic, r.grade) == (pytest.approx(above[0]), chance.index(max(chance)))


def test_language_step_goes_down_the_loss():
    r = np.random.default_rng(2)
    e, w, b = r.normal(size=(20, 5)), r.normal(size=(5, 3)), r.normal(size=3)
    idx, share, y = np.array([2, 7, 11]), np.array([0.5, 0.3, 0.2]), 1

    def loss(e, w, b):
        z = (share[:, None] * e[idx]).sum(0) @ w + b
        return math.log(sum(math.exp(x) for x in z)) - z[y]

    def slope(x, f):
        out = np.zeros_like(x)
        for at in np.ndindex(x.shape):
            up, down = x.copy(), x.copy()
            up[at] += 1e-6
            down[at] -= 1e-6
            out[at] = (f(up) - f(down)) / 2e-6
        return out

    de, dw, db = slope(e, lambda x: loss(x, w, b)), slope(w, lambda x: loss(e, x, b)), slope(b, lambda x: loss(e, w, x))
    e2, w2, b2 = e.copy(), w.copy(), b.copy()
    language_id.sgd_step(e2, w2, b2, idx, share, y, 0.1)
    assert np.allclose(e2, e - 0.1 * math.sqrt(3) * de) and np.allclose(w2, w - 0.1 * dw) and np.allclose(b2, b - 0.01 * db)


def test_language_calibration():
    r = np.random.default_rng(3)
    y = r.integers(0, 4, 4000)
    true = r.normal(size=(4000, 4)) + 2.0 * np.eye(4)[y]
    # scores of a model three times too sure: classes are drawn with the chances of a third of them
    z = true * 2.0
    chance = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    y = (chance.cumsum(1) > r.random(4000)[:, None]).argmax(1)
    t, low = language_id.calibrated(3 * z, y)
    assert 2.5 < t < 3.6
    p = np.exp(3 * z / t) / np.exp(3 * z / t).sum(1, keepdims=True)
    right = np.sort(p.max(1)[p.argmax(1) == y])
    assert low == pytest.approx(min(language_id.HIGHEST, right[int(language_id.REJECTED * len(right))]))


def test_a_prediction_is_the_mean_of_its_subwords():
    r = np.random.default_rng(4)
    model = language_id.Model(["a", "b", "c"], r.normal(size=(1 << language_id.BITS, language_id.DIMENSIONS)).astype(np.float32),
                              r.normal(size=(language_id.DIMENSIONS, 3)).astype(np.float32), r.normal(size=3).astype(np.float32), 1.7)
    text = "Some words, and more Words"
    idx = np.concatenate(list(language_id.subwords(text)))
    z = (model.embeddings[idx].astype(float).mean(0) @ model.weights + model.bias) / 1.7
    p = np.exp(z) / np.exp(z).sum()
    label, score = model.predict([text])[0]
    assert label == "abc"[p.argmax()] and score == pytest.approx(p.max(), abs=1e-5)
    letters = " some words and more words "
    grams = {letters[i : i + n] for n in (2, 3, 4) for i in range(len(letters) - n + 1)}
    assert len(set(idx.tolist())) <= len(grams) and len(idx) == sum(len(letters) - n + 1 for n in (2, 3, 4))


# ---- near duplicates


def test_one_row_of_each_group(rows):
    base = prose(80, 1)
    near = base.replace(base.split()[5] + " ", "zz ", 1)
    data = [(1, base, "a", None, 0), (1, base, "b", None, 0), (2, near, None, None, 0), (None, base, None, None, 0), (None, base, None, None, 0),
            (None, prose(50, 2), None, None, 0), (None, prose(50, 2), None, None, 0), (None, prose(50, 2) + " end", None, None, 0),
            (7, None, None, None, 0), (8, None, None, None, 0), (8, None, None, None, 0), (9, "", None, None, 0), (None, None, None, None, 0),
            (None, None, None, None, 0), (10, prose(40, 3), None, None, 0)]
    for extra in ("", ", k long, d long, times string, turn int, _k long, k_ string"):
        docs = rows([(*r, *([1, 2, "t", 3, 4, "k"] if extra else [])) for r in data], DOCS + extra)
        got = ngram_join.one_of_each_group(docs)
        assert got.columns == docs.columns
        ids = sorted((r.doc_id for r in got.collect()), key=lambda x: (x is None, x or 0))
        # of the second group, which has no ids, one row; the null text without an id stays once
        assert ids == [1, 7, 8, 9, 10, None, None]


# ---- test items


def leaks(rows, texts, items):
    docs = rows([(i, t, None, None, 0) for i, t in enumerate(texts)], DOCS)
    found = decontamination.find_leaks(docs, rows(items, "item_id long, text string")).collect()
    return sorted((r.doc_id, r.item_id) for r in found)


def test_short_items_are_one_sequence(rows):
    texts = [prose(30, 1) + " quick brown fox " + prose(30, 2), prose(60, 3) + " brown quick fox", "Quick, brown fox", "quick brown"]
    assert leaks(rows, texts, [(5, "quick brown fox"), (6, ""), (7, None)]) == [(0, 5), (2, 5)]


def test_short_answers_are_met_with_the_words_before(rows):
    question = prose(40, 4)
    item = (1, question + "\nforty two years")
    texts = [question + " forty two years", question + " forty two", question + " forty", question, prose(90, 5),
             " ".join(question.split()[:25]) + " " + prose(20, 6), prose(30, 7) + " forty two years"]
    assert [d for d, _ in leaks(rows, texts, [item])] == [0, 1, 2, 3]


# ---- personal data


@pytest.mark.parametrize("text", ["1" * 1_000_000, "1." * 500_000, "1-" * 500_000, "http://" * 150_000, "a@" * 500_000, "+1" * 500_000])
def test_a_megabyte_is_scanned_in_seconds(text):
    start = time.monotonic()
    pii.find(text, pii._automaton())
    assert time.monotonic() - start < 12


# ---- the pipeline


def test_stages_of_odd_and_empty_tables(rows, spark, sf_dir):
    pipeline = importlib.import_module("corpus_pipeline")
    extra = ", k long, d long, _k long, ids string, decoded string, item_id long, score string, n_tokens long"
    some = [(i, prose(60, i), "en", None, 1, 1, 2, 3, "i", "d", 4, "s", 5) for i in range(12)]
    odd = [some[0], (None, some[1][1], *some[1][2:]), (None, None, *some[0][2:]), (50, "", *some[0][2:]), (51, "é" * 5000, *some[0][2:]),
           (52, " ".join(["long"] * 200_000), *some[0][2:])]
    for docs in (rows([*some, *odd], DOCS + extra), rows([], DOCS + extra), rows([], DOCS)):
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            if name != "encode":
                assert out.columns == docs.columns
            got = out.collect()
            if docs.count() == 0:
                assert got == []
            elif name in ("redact", "encode"):
                assert len(got) == docs.count()
            elif name == "near_duplicates":
                assert sum(r.text == some[0][1] for r in got) == 1 and sum(r.text == some[1][1] for r in got) == 1
