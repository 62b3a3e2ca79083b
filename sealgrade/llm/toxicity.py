"""Severity of toxic text by cumulative-link ordinal regression on sparse text features.

Features are words and word beginnings: whether one occurs, occurs again, and how much of the
text it makes up. One weight vector is shared by all grades; ordered thresholds cut its score, so
``P(grade > j) = sigmoid(w x - threshold_j)``, and the expected severity is the sum of these.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sealgrade.llm.common import Scratch, small_batches, table

#: Labelled rows of each class used for training, features kept, and rows a feature must occur in.
ROWS_EACH, FEATURES, LEAST = 3_000, 1_024, 5
#: Lengths of word beginnings; occurrences and shares of the text that count as features.
BEGINNINGS = (4, 5, 6, 7)
TIMES, SHARES = (1, 2, 4), (0.005, 0.02)
LEVELS = len(TIMES) + len(SHARES)
#: Grades: 0 clean, 1 toxic, 2 toxic with more marked words than the median toxic text.
GRADES = 3
RIDGE = 1e-4
MEMORY = 300_000
WORD = re.compile(r"\w+")


def word_features(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in BEGINNINGS if len(word) > k)]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


@dataclass
class Model:
    features: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray
    flag_from: float = 0.5

    def above(self, score: float) -> np.ndarray:
        return sigmoid(score - self.thresholds)


class Extractor:
    """Active (feature, level) numbers of a text; words' features are remembered within bounds."""

    def __init__(self, features: dict[str, int]):
        self.features, self.seen = features, {}

    def counts(self, text: str | None) -> tuple[dict[int, int], int]:
        words = Counter(WORD.findall((text or "").lower()))
        out: dict[int, int] = {}
        for w, c in words.items():
            got = self.seen.get(w)
            if got is None:
                got = tuple(self.features[f] for f in word_features(w) if f in self.features)
                if len(self.seen) >= MEMORY:
                    self.seen.clear()
                self.seen[w] = got
            for f in got:
                out[f] = out.get(f, 0) + c
        return out, words.total()

    def active(self, text: str | None) -> list[int]:
        counts, n = self.counts(text)
        out = []
        for f, c in counts.items():
            out += [f * LEVELS + i for i, t in enumerate(TIMES) if c >= t]
            out += [f * LEVELS + len(TIMES) + i for i, s in enumerate(SHARES) if c >= s * n]
        return out


def ordinal_loss(p: np.ndarray, row: np.ndarray, col: np.ndarray, y: np.ndarray, weight: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """Penalised negative log likelihood and its gradient.

    ``p`` holds ``size`` feature weights, the first threshold, and the logarithms of the steps to the others;
    ``row`` and ``col`` list the active features.
    """
    cuts, at = GRADES - 1, np.arange(len(y))
    w = p[:size]
    th = p[size] + np.r_[0, np.cumsum(np.exp(p[size + 1 :]))]
    eta = np.bincount(row, w[col], len(y))
    c = np.c_[np.zeros(len(y)), sigmoid(th[None, :] - eta[:, None]), np.ones(len(y))]
    g = c * (1 - c)
    like = np.maximum(c[at, y + 1] - c[at, y], 1e-9)
    d_eta = weight * (g[at, y + 1] - g[at, y]) / like
    d_th = np.zeros(cuts)
    for j in range(cuts):
        d_th[j] = -(weight * ((y == j) * 1.0 - (y == j + 1)) * g[:, j + 1] / like).sum()
    grad = np.zeros_like(p)
    grad[:size] = np.bincount(col, d_eta[row], size) + RIDGE * w
    grad[size] = d_th.sum()
    for j in range(1, cuts):
        grad[size + j] = d_th[j:].sum() * np.exp(p[size + j])
    return float(-(weight * np.log(like)).sum() + RIDGE / 2 * (w @ w)), grad


def fit_ordinal(rows: list[list[int]], y: np.ndarray, weight: np.ndarray, size: int, steps: int = 250) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by full-batch gradient steps (Adam) with a ridge penalty."""
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([c for r in rows for c in r], np.int64)
    p = np.zeros(size + GRADES - 1)
    p[size] = 1.0
    m, v = np.zeros_like(p), np.zeros_like(p)
    weight = weight / weight.sum()
    for t in range(1, steps + 1):
        _, grad = ordinal_loss(p, row, col, y, weight, size)
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        p = p - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return p[:size], p[size] + np.r_[0, np.cumsum(np.exp(p[size + 1 :]))]


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count: tuple[Counter, Counter] = (Counter(), Counter())
    for b in batches:
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            words = set(WORD.findall(text.lower()))
            count[toxic].update({f for w in words for f in word_features(w)})
    names = list(count[0].keys() | count[1].keys())
    for at in range(0, len(names), 10_000):
        part = names[at : at + 10_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part), pa.array([count[0][f] for f in part], pa.int64()), pa.array([count[1][f] for f in part], pa.int64())],
            names=["feature", "clean", "toxic"],
        )


def fit(documents: DataFrame, labels: DataFrame, rows_each: int = ROWS_EACH) -> Model | None:
    """A model from texts and ``labels(doc_id, toxic)``; None unless both classes occur.

    At most ``rows_each`` rows of each class are used, chosen by a hash of the text and weighed back to the classes'
    shares; every fourth one only sets the probability from which a text is flagged. Labels other than
    0 and 1 and null texts are not used. The severity grade of a toxic row is 2 if it has more occurrences of
    the clearest toxic features than the median toxic row, else 1.
    """
    spark = documents.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    known = labels.where("toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the rows to read are chosen by id first, so that only their texts pass on
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    size = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    # a hash range of each class that holds about twice the rows asked for, so that only these meet
    k = F.pmod(F.xxhash64("doc_id"), F.lit(2**31 - 1))
    share = F.when(F.col("toxic") == 1, 2.0**32 * rows_each / max(1, size.get(1, 0))).otherwise(2.0**32 * rows_each / max(1, size.get(0, 0)))
    few = known.where(k < share).distinct()
    picked = few.withColumn("n", F.row_number().over(order)).where(F.col("n") <= rows_each).drop("n")
    rows = scratch.keep(texts.where("text is not null").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic"))
    counted = rows.mapInArrow(_count_features, "feature string, clean long, toxic long").groupBy("feature").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")
    )
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return None
    p, q = F.col("toxic") / n[1], F.col("clean") / n[0]
    pooled = (p + q) / 2
    apart = F.when((pooled > 0) & (pooled < 1), (p - q) * (p - q) / (pooled * (1 - pooled))).otherwise(0.0)
    best = counted.where(F.col("clean") + F.col("toxic") >= LEAST).withColumn("apart", apart).orderBy(
        F.desc("apart"), "feature").limit(FEATURES).collect()
    features = {r["feature"]: i for i, r in enumerate(best)}
    marked = {i for i, r in enumerate(best) if r["toxic"] / n[1] > 20 * (r["clean"] + 0.5) / n[0]}

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = Extractor(features)
        for b in batches:
            found = b.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("toxic"), pa.array([x.active(t) for t in found], pa.list_(pa.int32())),
                 pa.array([sum(c for f, c in x.counts(t)[0].items() if f in marked) for t in found], pa.int64())],
                names=["doc_id", "toxic", "active", "marks"],
            )

    got = rows.mapInArrow(extract, "doc_id long, toxic int, active array<int>, marks long").collect()
    scratch.drop(rows)
    got.sort(key=lambda r: (r["doc_id"], r["toxic"], r["active"]))
    toxic = np.array([r["toxic"] for r in got])
    marks = np.array([r["marks"] for r in got])
    y = toxic + (toxic == 1) * (marks > np.median(marks[toxic == 1]))
    weight = np.array([size[t] / n[t] for t in toxic], float)
    held = np.arange(len(got)) % 4 == 3
    used = ~held if len(set(y[~held])) == len(set(y)) else np.ones(len(got), bool)
    w, th = fit_ordinal([r["active"] for r, u in zip(got, used, strict=True) if u], y[used], weight[used], len(features) * LEVELS)
    check = held if held.any() and len(set(toxic[held])) == 2 else used
    score = np.array([w[r["active"]].sum() if r["active"] else 0.0 for r in got])[check]
    prob = sigmoid(score - th[0])
    options = np.unique(np.round(prob, 3))
    hit = [(weight[check] * (toxic[check] == 1) * (prob >= o)).sum() for o in options]
    all_ = [(weight[check] * (prob >= o)).sum() for o in options]
    f1 = 2 * np.array(hit) / (np.array(all_) + (weight[check] * toxic[check]).sum())
    top = np.flatnonzero(f1 >= f1.max() - 1e-9)
    return Model(features, w, th, float(np.clip(options[top].mean(), 0.05, 0.95)))


def grade(documents: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, severity, grade, p_toxic, toxic`` for each row of ``documents(doc_id, text)``.

    ``severity`` is the expected grade, ``grade`` the likeliest, ``toxic`` whether ``p_toxic`` reaches ``model.flag_from``. A null or
    empty text has severity 0 and is not toxic, as has every row without a model. Whole texts are read; repeated
    rows and null ids are returned as they come; other columns are not read; an empty table gives no rows.
    """
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # FEATURES entries at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        x = Extractor(m.features if m else {})
        for b in batches:
            above = np.zeros((b.num_rows, GRADES - 1))
            for i, text in enumerate(b.column("text").to_pylist()):
                if m and text and text.strip():
                    above[i] = m.above(m.weights[x.active(text)].sum())
            each = np.c_[1 - above[:, 0], above[:, :-1] - above[:, 1:], above[:, -1]]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(above.sum(axis=1)), pa.array(each.argmax(axis=1).astype(np.int32)),
                 pa.array(above[:, 0]), pa.array(above[:, 0] >= (m.flag_from if m else 2.0))],
                names=["doc_id", "severity", "grade", "p_toxic", "toxic"],
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, severity double, grade int, p_toxic double, toxic boolean")


def op5_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return grade(docs, fit(docs, table(spark, sf_dir, "labels")))
