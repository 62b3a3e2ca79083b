"""Ranked lexical search: best-first intervals of documents, bounded by range maxima of postings.

A first pass notes, for every document, how often it holds the terms of the items; sums over
these notes give the statistics of the whole corpus. A second pass reads the notes, and indexes
those of consecutive documents in shards of bounded size: a list of postings a term, in order of the documents, with
each posting's whole contribution to a score (its impact) and a sparse table that gives the
place of the greatest impact in any stretch of a list.

An item's search in a shard starts with the interval of all its documents. The range maxima of the
item's terms over an interval add up to a bound of every score in it. The interval of the highest bound is taken
from a heap and split at the document that holds its greatest impact: that document is scored, what lies
before and after it are two new intervals. Intervals of few postings are scored at once. The search ends when no bound
reaches the item's last kept score, which is carried from shard to shard of a task; the best of all
tasks are then ranked by Spark.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sealgrade.llm.common import Scratch, small_batches, table

TOP = 20
#: Text bytes of the items that are searched for in one round: the bound of what is collected and broadcast.
ITEM_BYTES = 8_000_000
#: Postings of a shard (its last document may exceed them), and those of an interval that is scored at once.
SHARD_POSTINGS, LEAF = 1_000_000, 1_024
#: Tasks that rank an item's candidates before one task ranks what these leave.
FANS = 32
#: Bytes that are part of a term, A-Z in lower case; all others separate terms.
TERM_BYTES = bytes(ord(chr(b).lower()) if b > 127 or chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and characters beyond ASCII; only A-Z are lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(TERM_BYTES).split()


# ---- one shard --------------------------------------------------------------------------


class Shard:
    """Postings of some documents. ``doc`` numbers them from 0 in the order of ``ids`` (null: last among ties)."""

    def __init__(self, ids: list[int | None], doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int):
        self.ids = ids
        order = np.lexsort((doc, term))
        self.doc, self.impact = doc[order], impact[order]
        term = term[order]
        self.base = term * len(ids)
        self.key = self.base + self.doc
        self.start = np.searchsorted(term, np.arange(n_terms + 1))
        longest = int(np.diff(self.start).max(initial=1))
        self.log = np.frexp(np.arange(longest + 1))[1] - 1
        self.table = self._sparse_table(max(1, longest.bit_length()))

    def _sparse_table(self, levels: int) -> np.ndarray:
        """Row ``k``: the place of the greatest impact among the ``2**k`` postings from each place."""
        n = len(self.impact)
        table = np.empty((levels, n), np.int32)
        table[0] = np.arange(n)
        for k in range(1, levels):
            half, m = 1 << k - 1, n - (1 << k) + 1
            table[k] = table[k - 1]
            if m > 0:
                a, b = table[k - 1, :m], table[k - 1, half : half + m]
                table[k, :m] = np.where(self.impact[b] > self.impact[a], b, a)
        return table

    def greatest(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Places of the greatest impacts of stretches [start, end), none of them empty."""
        k = self.log[end - start]
        a, b = self.table[k, start], self.table[k, end - (1 << k)]
        return np.where(self.impact[b] > self.impact[a], b, a)


class Best:
    """The ``top`` highest scores above 0, equal ones by ascending id; a null id comes last."""

    def __init__(self, top: int):
        self.top, self.least, self.rows = top, 1, []

    def offer(self, found: list[tuple[int, int | None]]) -> None:
        self.rows += [(-score, i is None, i or 0) for score, i in found]
        self.rows.sort()
        del self.rows[self.top :]
        if len(self.rows) == self.top:
            self.least = -self.rows[-1][0]


def search(shard: Shard, terms: np.ndarray, counts: np.ndarray, best: Best, leaf: int = LEAF) -> int:
    """Offer ``best`` all documents of ``shard`` that can be among the best for ``terms``; how many were scored."""
    doc, impact, key, ids = shard.doc, shard.impact, shard.key, shard.ids
    heap: list[tuple] = []
    turn, scored = count(), 0

    def enter(start: np.ndarray, end: np.ndarray, counts: np.ndarray) -> None:
        some = np.flatnonzero(end > start)
        if len(some):
            start, end, counts = start[some], end[some], counts[some]
            top = shard.greatest(start, end)
            value = counts * impact[top]
            bound = int(value.sum())
            if bound >= best.least:
                heapq.heappush(heap, (-bound, next(turn), start, end, counts, int(doc[top[value.argmax()]])))

    enter(shard.start[terms], shard.start[terms + 1], counts)
    while heap and -heap[0][0] >= best.least:
        _, _, start, end, counts, middle = heapq.heappop(heap)
        size = end - start
        total = int(size.sum())
        if total <= leaf:
            at = np.arange(total) + np.repeat(start - np.cumsum(size) + size, size)
            here = doc[at]
            first = int(here.min())
            # sums of whole numbers below 2 ** 53 are exact
            score = np.bincount(here - first, impact[at] * np.repeat(counts, size))
            scored += len(score)
            good = np.flatnonzero(score >= best.least)
            if len(good):
                best.offer([(int(score[i]), ids[first + i]) for i in good.tolist()])
            continue
        # no posting of the document lies outside the stretches: the interval holds it
        split = np.searchsorted(key, shard.base[start] + middle)
        holds = (split < end) & (doc[np.minimum(split, len(doc) - 1)] == middle)
        score = int((counts * impact[np.minimum(split, len(doc) - 1)])[holds].sum())
        scored += 1
        if score >= best.least:
            best.offer([(score, ids[middle])])
        enter(start, split, counts)
        enter(split + holds, end, counts)
    return scored


# ---- passes -----------------------------------------------------------------------------


@dataclass
class Items:
    """Items of a round: their ids, their terms' numbers, and each item's terms with their counts."""

    ids: list[int | None]
    numbers: dict[bytes, int]
    terms: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, rows: list[tuple[int | None, str]]) -> Items:
        numbers: dict[bytes, int] = {}
        terms = []
        for _, text in rows:
            held = Counter(terms_of(text))
            terms.append((np.array([numbers.setdefault(t, len(numbers)) for t in held], np.int64),
                          np.array(list(held.values()), np.int64)))
        return cls([i for i, _ in rows], numbers, terms)


NOTES = "doc_id long, n long, terms array<int>, counts array<int>"


def _notes(shared):
    """Each document that has a term: its id, its number of terms, and the items' terms in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = shared.value
        for b in batches:
            kept, sizes, ends, terms, counts = [], [], [0], [], []
            for row, text in enumerate(b.column("text").to_pylist()):
                words = terms_of(text)
                if not words:
                    continue
                held = Counter(map(numbers.get, words))
                held.pop(None, None)
                kept.append(row)
                sizes.append(len(words))
                ends.append(ends[-1] + len(held))
                terms += held
                counts += held.values()
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(kept, pa.int32())), pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int32()))],
                names=["doc_id", "n", "terms", "counts"],
            )

    return run


def impacts(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, total: int, length: int) -> np.ndarray:
    """Contributions to a score: term weights, occurrences, documents' lengths, number and length of all documents."""
    m = 75 + (25 * n * total) // length
    return weight * ((1_000_000_000 * tf) // (1_000 * tf + 12 * m))


def _search(shared, total: int, length: int, top: int, shard_postings: int, leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight = shared.value
        best = [Best(top) for _ in items.ids]
        held: list[tuple] = []
        size = 0

        def searched() -> None:
            ids = [i for part in held for i in part[0]]
            n = np.concatenate([p[1] for p in held])
            per = np.concatenate([p[2] for p in held])
            doc = np.repeat(np.arange(len(ids)), per)
            term = np.concatenate([p[3] for p in held]).astype(np.int64)
            tf = np.concatenate([p[4] for p in held]).astype(np.int64)
            # documents of like length side by side have like impacts, which makes bounds closer
            place = np.empty(len(ids), np.int64)
            order = np.argsort(-n, kind="stable")
            place[order] = np.arange(len(ids))
            shard = Shard([ids[i] for i in order.tolist()], place[doc], term, impacts(weight[term], tf, n[doc], total, length), len(weight))
            for (terms, counts), b in zip(items.terms, best, strict=True):
                if len(terms):
                    search(shard, terms, counts, b, leaf)

        for b in batches:
            lists = b.column("terms")
            ends = lists.offsets.to_numpy().astype(np.int64)
            held.append((b.column("doc_id").to_pylist(), b.column("n").to_numpy(), np.diff(ends),
                         lists.values.to_numpy()[ends[0] : ends[-1]], b.column("counts").values.to_numpy()[ends[0] : ends[-1]]))
            size += int(ends[-1] - ends[0])
            if size >= shard_postings:
                searched()
                held, size = [], 0
        if size:
            searched()
        found = [(at, items.ids[at], None if null else i, -score) for at, b in enumerate(best) for score, null, i in b.rows]
        columns = list(zip(*found, strict=True)) or [[]] * 4
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                         names=["item", "item_id", "doc_id", "score"])

    return run


def _rounds(items: DataFrame, item_bytes: int) -> Iterator[Items]:
    """Different rows of ``items(item_id, text)`` in parts of bounded size."""
    rows = Scratch(items.sparkSession).keep(
        items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text != ''").distinct()
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / item_bytes))
    for part in range(n):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == part) if n > 1 else rows
        yield Items.of(sorted((tuple(r) for r in own.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1])))


def ranked_search(
    documents: DataFrame, items: DataFrame, top: int = TOP, item_bytes: int = ITEM_BYTES, shard_postings: int = SHARD_POSTINGS, leaf: int = LEAF,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` best of ``documents(doc_id, text)`` for each of ``items(item_id, text)``.

    Only scores above 0 are returned, equal ones by ascending ``doc_id``, a null one last. Null and empty texts, and those
    without a term, match nothing and count as no document. Rows that repeat a document are documents of their own;
    rows that repeat an item count once, and an id with different texts is searched for and ranked once a text.
    Other columns are not read; without items or documents there are no rows.
    """
    spark = documents.sparkSession
    small_batches(spark)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for own in _rounds(items, item_bytes):
        scratch = Scratch(spark)
        numbers = spark.sparkContext.broadcast(own.numbers)  # terms of ITEM_BYTES of text at most
        notes = scratch.keep(rows.mapInArrow(_notes(numbers), NOTES))
        numbers.destroy()
        total, length = notes.agg(F.count("*"), F.sum("n")).first()
        df = np.zeros(len(own.numbers), np.int64)
        # a row a term of these items
        for term, n in notes.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            df[term] = n
        weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        shared = spark.sparkContext.broadcast((own, weight))  # ITEM_BYTES of text at most
        found = notes.where(F.size("terms") > 0).mapInArrow(
            _search(shared, total, length or 0, top, shard_postings, leaf), "item int, item_id long, doc_id long, score long")
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        some = found.withColumn("fan", F.pmod(F.xxhash64("doc_id"), F.lit(FANS)))
        some = some.withColumn("r", F.row_number().over(Window.partitionBy("item", "fan").orderBy(*order))).where(F.col("r") <= top).drop("r", "fan")
        ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
        part = ranked.select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return out


def op13_ranked_search(spark, sf_dir):
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH w AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents WHERE text IS NOT NULL),
q AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark WHERE text IS NOT NULL) AS i
  GROUP BY item_id, term),
d AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id),
a AS (SELECT count(*) AS total, CAST(sum(n) AS BIGINT) AS length FROM d),
p AS (SELECT w.doc_id, w.term, count(*) AS tf FROM w JOIN (SELECT DISTINCT term FROM q) AS t ON t.term = w.term GROUP BY w.doc_id, w.term),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
v AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * total + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight FROM f, a),
m AS (SELECT doc_id, 75 + (25 * n * total) // length AS m FROM d, a),
s AS (
  SELECT q.item_id, p.doc_id, CAST(sum(q.times * v.weight * ((1000000000 * p.tf) // (1000 * p.tf + 12 * m.m))) AS BIGINT) AS score
  FROM q JOIN p ON p.term = q.term JOIN v ON v.term = q.term JOIN m ON m.doc_id = p.doc_id
  GROUP BY q.item_id, p.doc_id),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM s WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM r WHERE place <= 20
"""
