"""Language identification: averaged embeddings of hashed subwords and a linear softmax.

A text is the mean of the embeddings of its hashed letter pairs, triples and quadruples, words being
bounded by spaces; embeddings and weights are trained together by stochastic gradient descent in
numpy on a bounded sample. The scores are sharpened or flattened by one temperature, fitted on rows
kept from training, and the same rows set the score below which a prediction is rejected.
"""

from __future__ import annotations

import hashlib
import pickle
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sealgrade.llm.common import small_batches, table, trimmed

BITS, DIMENSIONS, GRAMS = 15, 16, (2, 3, 4)
#: Labelled rows used for each language and in all; the bound of the training sample.
ROWS_EACH, ROWS = 500, 5_000
EPOCHS, RATE = 4, 0.6
#: Share of rightly predicted texts that the rejecting score may turn away, and its highest value.
REJECTED, HIGHEST = 0.0005, 0.5
UNKNOWN = "und"
#: Letters hashed at once.
PIECE = 1 << 19


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    return (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)


def subwords(text: str | None) -> Iterator[np.ndarray]:
    """Hashed subwords of the whole text in pieces; nothing if it has no letter."""
    if not text:
        return
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[c]
    if not letter.any():
        return
    c = np.where(letter, c, np.uint32(32))
    c = np.r_[np.uint32(32), c[np.r_[True, (c[1:] != 32) | (c[:-1] != 32)]], np.uint32(32)]
    c = _spread(c)
    for at in range(0, len(c), PIECE):
        # pieces overlap by what the longest subword needs
        x = c[at : at + PIECE + max(GRAMS) - 1]
        h, parts = x, []
        for n in range(2, max(GRAMS) + 1):
            if len(x) < n:
                break
            h = h[: len(x) - n + 1] * np.uint32(0x01000193) + x[n - 1 :]
            own = h[: PIECE] if at + PIECE < len(c) else h
            if n in GRAMS:
                parts.append(_spread(own + np.uint32(n)) >> np.uint32(32 - BITS))
        if parts:
            yield np.concatenate(parts)


@dataclass
class Model:
    labels: list[str]
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def _logits(self, text: str | None, by_bucket: np.ndarray) -> np.ndarray | None:
        total, n = 0.0, 0
        for idx in subwords(text):
            total = total + by_bucket[idx].sum(axis=0, dtype=np.float64)
            n += len(idx)
        if not n:
            return None
        mean = total / n
        return (mean if len(self.labels) <= DIMENSIONS else mean @ self.weights) + self.bias

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        by_bucket = self.embeddings @ self.weights if len(self.labels) <= DIMENSIONS else self.embeddings
        out = []
        for t in texts:
            z = self._logits(t, by_bucket)
            if z is None:
                out.append((UNKNOWN, 0.0))
                continue
            p = softmax(z / self.temperature)
            out.append((self.labels[int(p.argmax())], float(p.max())))
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, str, bool]], seed: int = 11) -> Model | None:
    """Fit on rows (buckets, weights, label, for calibration); None without rows."""
    labels = sorted({r[2] for r in rows})
    if not labels:
        return None
    number = {x: i for i, x in enumerate(labels)}
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << BITS, DIMENSIONS)).astype(np.float32)
    w, b = np.zeros((DIMENSIONS, len(labels)), np.float32), np.zeros(len(labels), np.float32)
    fit = [r for r in rows if not r[3]] or rows
    steps, done = EPOCHS * len(fit), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(fit)):
            idx, share, label, _ = fit[i]
            sgd_step(e, w, b, idx, share, number[label], RATE * (1 - done / steps))
            done += 1
    held = [r for r in rows if r[3]] or fit
    z = np.array([(share @ e[idx]) @ w + b for idx, share, _, _ in held])
    y = np.array([number[r[2]] for r in held])
    return Model(labels, e, w, b, *calibrated(z, y))


def sgd_step(e: np.ndarray, w: np.ndarray, b: np.ndarray, idx: np.ndarray, share: np.ndarray, y: int, rate: float) -> None:
    """One step down the loss of a text with buckets ``idx`` and class ``y``. Embeddings, of which a text moves
    each a little, take steps longer by the root of their number, the bias a tenth of a step."""
    h = share @ e[idx]
    g = softmax(h @ w + b)
    g[y] -= 1
    back = w @ g
    w -= rate * np.outer(h, g)
    b -= rate * 0.1 * g
    e[idx] -= rate * len(idx) ** 0.5 * share[:, None] * back


def calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The temperature of the least loss on rows kept from training, and the score to accept from."""
    heats = np.geomspace(0.05, 20, 60)
    loss = [-np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in heats]
    t = float(heats[int(np.argmin(loss))])
    p = softmax(z / t)
    good = np.sort(p.max(axis=1)[p.argmax(axis=1) == y])
    low = float(good[int(REJECTED * len(good))]) if len(good) else 0.0
    return t, min(HIGHEST, low)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket counts of each sampled text and of two short stretches of it."""
    for b in batches:
        idx, share, label, held = [], [], [], []
        for text, lang, k, cal in zip(*(b.column(c).to_pylist() for c in ("text", "lang", "k", "held")), strict=True):
            words = text.split()
            short = [" ".join(words[(at := k // 7 % max(1, len(words) - n + 1)) : at + n]) for n in (3, 15)]
            for t in (text, *short):
                counts = np.zeros(1 << BITS, np.int64)
                for piece in subwords(t):
                    counts += np.bincount(piece, minlength=1 << BITS)
                at = np.flatnonzero(counts)
                if len(at):
                    idx.append(at.astype(np.int32))
                    share.append((counts[at] / counts.sum()).astype(np.float32))
                    label.append(lang)
                    held.append(cal)
        offsets = np.r_[0, np.cumsum([len(x) for x in idx])].astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(offsets, np.concatenate(idx or [np.empty(0, np.int32)])),
             pa.ListArray.from_arrays(offsets, np.concatenate(share or [np.empty(0, np.float32)])),
             pa.array(label, pa.string()), pa.array(held, pa.bool_())], names=["idx", "share", "lang", "held"],
        )


def fit(documents: DataFrame, where: Column | None = None, rows_each: int = ROWS_EACH, rows: int = ROWS) -> Model | None:
    """A model learned from ``text`` and non-null ``lang`` of the rows ``where`` holds.

    At most ``rows_each`` rows a language and ``rows`` in all are used, chosen by a hash (of id and text, so that
    copies do not come together), a fifth of them for calibration only.
    """
    small_batches(documents.sparkSession)
    # 31 bits: a positive number in Python and in Spark alike
    k = F.pmod(F.xxhash64("doc_id", "text"), F.lit(2**31 - 1))
    some = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    some = (some if where is None else some.where(where)).select(
        F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), k.alias("k")
    )
    # a hash range of each language that holds about twice the rows asked for, so that only these pass on
    sizes = some.groupBy("lang").agg(F.count("*").alias("of")).orderBy(F.desc("of"), "lang").limit(rows)
    few = some.join(F.broadcast(sizes), "lang").where(F.col("k") < F.lit(2.0**32) * rows_each / F.col("of"))
    w = Window.partitionBy("lang").orderBy("k", "text")
    picked = (
        few.withColumn("n", F.row_number().over(w)).where(F.col("n") <= rows_each).orderBy("n", "lang").limit(rows)
        .withColumn("held", F.col("k") % 5 == 0).select("text", "lang", "k", "held")
    )
    examples = picked.mapInArrow(trimmed(_examples), "idx array<int>, share array<float>, lang string, held boolean")
    # the sample is bounded: one task trains, and only the model comes back
    got = examples.repartition(1).mapInArrow(trimmed(_trained), "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else None


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    data = []
    for b in batches:
        idx, share = ([x.values.to_numpy() for x in b.column(c)] for c in ("idx", "share"))
        data += zip(idx, share, b.column("lang").to_pylist(), b.column("held").to_pylist(), strict=True)
    # in an order that does not depend on how the rows came
    data.sort(key=lambda r: (r[2], r[3], len(r[0]), hashlib.blake2b(r[0].tobytes() + r[1].tobytes(), digest_size=16).digest()))
    model = train(data)
    if model is not None:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])


def identify(documents: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, lang_pred, score, accepted`` for each row of ``documents(doc_id, text)``.

    ``score`` is the calibrated probability of ``lang_pred``. A null text and one without letters is ``und`` with
    score 0 and not accepted, as are all rows without a model; other rows are accepted from
    ``model.reject_below`` on. Whole texts are read. Repeated rows and null ids are returned as they come;
    other columns, such as a ``lang`` or ``score``, are not read. An empty table gives no rows.
    """
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # fixed size: buckets and languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = b.column("text").to_pylist()
            out = m.predict(texts) if m else [(UNKNOWN, 0.0)] * len(texts)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([p[0] for p in out], pa.string()), pa.array([p[1] for p in out], pa.float64()),
                 pa.array([p[0] != UNKNOWN and p[1] >= m.reject_below for p in out], pa.bool_())],
                names=["doc_id", "lang_pred", "score", "accepted"],
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")


def accepted_only(documents: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``documents``, all columns, whose language is recognised; nothing is shuffled.

    Rows with a null text or one without letters go, and all rows without a model. Repeated rows stay or go together,
    rows without an id are judged like others, and columns of any name stay. An empty table stays empty.
    """
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            out = m.predict(b.column("text").to_pylist()) if m else [(UNKNOWN, 0.0)] * b.num_rows
            yield b.filter(pa.array([p[0] != UNKNOWN and p[1] >= m.reject_below for p in out], pa.bool_()))

    return documents.mapInArrow(trimmed(run), documents.schema)


def remainder(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def op3_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, remainder() != 1)
    return identify(docs, model).select(
        "doc_id", F.coalesce(remainder() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted"
    )
