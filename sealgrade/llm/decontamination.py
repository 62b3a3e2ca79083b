"""Benchmark decontamination: a BM25 index of test items, queried by every training passage.

An item's impact for a word is its BM25 weight divided by the item's score for itself, so one threshold
(a share of the item) holds for all. Items lie in blocks; a passage's score in a block is bounded by
its words' largest impacts there (block-max). Words of many items cannot bring an item to the
threshold alone: as in WAND they are left out of the search, and the most they can add to any item
of a block is taken off the threshold there. Only blocks whose bound remains are scored exactly,
and every item at or above the threshold is then verified by the overlap of word sequences of its
question and of its answer.

Passages are stretches of ``2 * STRIDE`` words that overlap by half; entries of the index have ``STRIDE``
words at most (a longer item has several), so each entry lies whole in some passage. The index is built in
shards of bounded size, and each shard is broadcast and queried by all passages.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealgrade.llm.common import Scratch, small_batches, table, trimmed

WORD = re.compile(r"\w+")
STRIDE = 64
#: BM25 parameters, share of an item's own score to retrieve it, words of an overlap sequence, shares to verify
#: (of question and answer, or of all of the item).
K1, B = 1.2, 0.75
THRESHOLD, GRAM, QUESTION, ANSWER, WHOLE = 0.5, 5, 0.5, 0.5, 0.8
#: Entries of a block, and the share of entries beyond which a word is left to the bound.
BLOCK, COMMON = 4, 0.05
#: Share of an entry that words left out of the search may make up.
SLACK = 0.25
#: Bytes of item texts in one shard of the index: the bound of what is collected and broadcast.
SHARD_BYTES = 8_000_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def sequences(words: list[str], k: int = GRAM) -> set[tuple[str, ...]]:
    k = min(k, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()


def question_and_answer(text: str) -> tuple[str, str]:
    """What comes before and after the last line break; a text of one line is a question."""
    q, _, a = text.strip().rpartition("\n")
    return (q, a) if q else (a, "")


@dataclass
class Index:
    terms: dict[str, int]
    items: list[tuple[int | None, str]]
    entry_item: np.ndarray
    postings: tuple[np.ndarray, np.ndarray, np.ndarray]  # by word: start, entry, impact
    blocks: tuple[np.ndarray, np.ndarray, np.ndarray]  # by word: start, block, largest impact
    rare: dict[str, int]
    slack: np.ndarray  # by block: what the other words add to an item at most
    parts: dict[int, tuple[set, set, set]] = field(default_factory=dict)


def _csr(term: np.ndarray, other: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((other, term))
    return np.searchsorted(term[order], np.arange(n + 1)), other[order], value[order]


def build_index(items: list[tuple[int | None, str]], frequency: dict[str, int] | None = None, total: int | None = None,
                average: float | None = None) -> Index:
    """Index of items (id, text). ``frequency``, ``total`` and ``average`` (entries with a word, entries, words
    of an entry) come from all shards; left out, from these items."""
    entries = []
    for i, (_, text) in enumerate(items):
        w = words_of(text)
        entries += [(i, w[at : at + STRIDE]) for at in range(0, len(w), STRIDE)]
    if frequency is None:
        frequency = {}
        for _, w in entries:
            for t in set(w):
                frequency[t] = frequency.get(t, 0) + 1
        total, average = len(entries), sum(len(w) for _, w in entries) / max(1, len(entries))
    terms: dict[str, int] = {}
    term, entry, impact = [], [], []
    for e, (_, w) in enumerate(entries):
        count: dict[str, int] = {}
        for t in w:
            count[t] = count.get(t, 0) + 1
        scores = {}
        for t, tf in count.items():
            df = frequency.get(t, 1)
            idf = math.log(1 + (total - df + 0.5) / (df + 0.5))
            scores[t] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / average))
        own = sum(scores.values())
        for t, s in scores.items():
            term.append(terms.setdefault(t, len(terms)))
            entry.append(e)
            impact.append(s / own)
    term, entry, impact = np.array(term, np.int64), np.array(entry, np.int64), np.array(impact)
    n = len(terms)
    width = len(entries) // BLOCK + 1
    # a word of many entries is searched for all the same where an entry has too little else
    common = np.bincount(term, minlength=n) > max(8, COMMON * len(entries))
    rest = np.bincount(entry, impact * common[term], len(entries)) if len(term) else np.zeros(0)
    for e in np.flatnonzero(rest > SLACK):
        own = np.flatnonzero((entry == e) & common[term])
        for x in own[np.argsort(-impact[own], kind="stable")]:
            if rest[e] > SLACK:
                rest[e] -= impact[x]
                common[term[x]] = False
    rest = np.bincount(entry, impact * common[term], len(entries)) if len(term) else rest
    slack = np.zeros(width)
    np.maximum.at(slack, np.arange(len(entries)) // BLOCK, rest)
    seek = ~common[term]
    pair = term[seek] * width + entry[seek] // BLOCK
    keys, where = np.unique(pair, return_inverse=True)
    top = np.zeros(len(keys))
    np.maximum.at(top, where, impact[seek])
    rare = {t: i for t, i in terms.items() if not common[i]}
    return Index(terms, items, np.array([i for i, _ in entries], np.int64), _csr(term, entry, impact, n),
                 _csr(keys // width, keys % width, top, n), rare, slack)


def _expand(csr: tuple[np.ndarray, np.ndarray, np.ndarray], terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of ``terms`` its list: the place in ``terms``, the other number, the value."""
    start, other, value = csr
    size = start[terms + 1] - start[terms]
    at = np.repeat(np.arange(len(terms)), size)
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    pick = np.repeat(start[terms], size) + inside
    return at, other[pick], value[pick]


def search(index: Index, docs: list[list[str]], threshold: float = THRESHOLD) -> list[tuple[int, int, float]]:
    """(document, item, best score) of the passages' entries at or above ``threshold``."""
    if not index.terms:
        return []
    # passage p of a document covers words p * STRIDE up to (p + 2) * STRIDE
    size = np.array([len(d) for d in docs])
    base = np.r_[0, np.cumsum(np.maximum(1, -(-size // STRIDE)))]

    def placed(names: dict[str, int], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, word) of the known words: each in its own passage and, past the first, in the one before."""
        some = size[chosen]
        look = names.get
        term = np.array([look(w, -1) for i in chosen for w in docs[i]], np.int64)
        known = np.flatnonzero(term >= 0)
        doc = np.repeat(np.arange(len(chosen)), some)[known]
        half = (known - (np.cumsum(some) - some)[doc]) // STRIDE
        here, term = base[chosen][doc] + half, term[known]
        return np.r_[here, here[half > 0] - 1], np.r_[term, term[half > 0]]

    width = len(index.slack)
    passage, term = placed(index.rare, np.arange(len(docs)))
    n_terms = len(index.terms)
    pair = np.unique(passage * n_terms + term)
    passage, term = pair // n_terms, pair % n_terms
    at, block, top = _expand(index.blocks, term)
    key = passage[at] * width + block
    order = np.argsort(key, kind="stable")
    key, top = key[order], top[order]
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else key
    bound = np.add.reduceat(top, new) if len(new) else top
    key = key[new]
    alive = key[bound + index.slack[key % width] >= threshold - 1e-9]
    if (index.slack >= threshold - 1e-9).any():
        # below what the other words may add, the search can rule out nothing
        alive = np.arange(base[-1] * width)
    if not len(alive):
        return []
    held = np.unique(np.searchsorted(base, alive // width, side="right") - 1)
    passage, term = placed(index.terms, held)
    wanted = np.isin(passage, alive // width)
    pair = np.unique(passage[wanted] * n_terms + term[wanted])
    passage, term = pair // n_terms, pair % n_terms
    at, entry, impact = _expand(index.postings, term)
    p = passage[at]
    keep = np.isin(p * width + entry // BLOCK, alive)
    n = len(index.entry_item)
    key, where = np.unique(p[keep] * n + entry[keep], return_inverse=True)
    score = np.bincount(where, impact[keep], len(key))
    key, score = key[score >= threshold - 1e-9], score[score >= threshold - 1e-9]
    best: dict[tuple[int, int], float] = {}
    doc_of = np.searchsorted(base, key // n, side="right") - 1
    for d, item, s in zip(doc_of.tolist(), index.entry_item[key % n].tolist(), score.tolist(), strict=True):
        best[d, item] = max(s, best.get((d, item), 0.0))
    return [(d, i, s) for (d, i), s in sorted(best.items())]


def item_parts(text: str | None) -> tuple[set, set, set]:
    """Word sequences of an item's question, of its answer, and of all of it.

    An answer shorter than a sequence is looked for together with the words before it. An item shorter than a
    sequence is one sequence, and all of it a question.
    """
    q, a = map(words_of, question_and_answer(text or ""))
    if len(q) < GRAM:
        q, a = q + a, []
    lead = q[-(GRAM - 1) :] if 0 < len(a) < GRAM else []
    return sequences(q), sequences(lead + a) if a else set(), sequences(q + a)


def overlaps(index: Index, item: int, words: list[str]) -> tuple[float, float | None, float]:
    """Shares of the sequences of the question, the answer (null without one) and the whole item in a document."""
    if item not in index.parts:
        index.parts[item] = item_parts(index.items[item][1])

    def share(wanted: set) -> float:
        have = sequences(words, len(next(iter(wanted))))
        return sum(g in have for g in wanted) / len(wanted)

    q, a, whole = index.parts[item]
    return (share(q) if q else 0.0), (share(a) if a else None), (share(whole) if whole else 0.0)


def verified(index: Index, texts: list[str | None], threshold: float = THRESHOLD) -> list[tuple[int, int, float, float, float | None]]:
    """(document, item, score, question overlap, answer overlap) of leaks."""
    docs = [words_of(t) for t in texts]
    out = []
    for d, item, score in search(index, docs, threshold):
        q, a, whole = overlaps(index, item, docs[d])
        if (q >= QUESTION and (a is None or a >= ANSWER)) or whole >= WHOLE:
            out.append((d, item, score, q, a))
    return out


def shards(benchmark: DataFrame, shard_bytes: int = SHARD_BYTES) -> Iterator[Index]:
    """Indexes of bounded parts of ``benchmark(item_id, text)``, weighed by the frequencies of all of it."""
    scratch = Scratch(benchmark.sparkSession)
    items = scratch.keep(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
                         .where("text is not null").distinct())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / shard_bytes))
    if n == 1:
        yield build_index(sorted((tuple(r) for r in items.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1])))
        return

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard, word, length = [], [], []
            for s, text in zip(b.column("shard").to_pylist(), b.column("text").to_pylist(), strict=True):
                w = words_of(text)
                for at in range(0, len(w), STRIDE):
                    part = set(w[at : at + STRIDE])
                    shard += [s] * (len(part) + 1)
                    word += [*part, None]
                    length += [0] * len(part) + [len(w[at : at + STRIDE])]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(word, pa.string()), pa.array(length, pa.int64())],
                                             names=["shard", "word", "length"])

    dealt = scratch.keep(items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))))
    found = scratch.keep(dealt.mapInArrow(entries, "shard long, word string, length long"))
    total, words = found.where("word is null").agg(F.count("*"), F.sum("length")).first()
    df = scratch.keep(found.where("word is not null").groupBy("word").agg(F.count("*").alias("df")))
    for s in range(n):
        own = found.where((F.col("shard") == s) & F.col("word").isNotNull()).select("word").distinct()
        frequency = {r["word"]: r["df"] for r in df.join(own, "word", "left_semi").collect()}
        part = sorted((tuple(r) for r in dealt.where(F.col("shard") == s).select("item_id", "text").collect()),
                      key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        yield build_index(part, frequency, total or 0, (words or 0) / max(1, total or 0))


def find_leaks(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``doc_id, item_id, score, question_overlap, answer_overlap`` of each test item a document holds.

    Words are runs of letters, digits and underscores in lower case. Null and empty texts of either table match nothing;
    an item of fewer than five words must stand in the document word for word. Rows that repeat a document are all
    reported; rows that repeat an item count once. Null ids are returned as null. Other columns are not
    read; without documents or items there are no rows.
    """
    spark = documents.sparkSession
    small_batches(spark)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for index in shards(benchmark, shard_bytes):
        shared = spark.sparkContext.broadcast(index)  # SHARD_BYTES of text at most

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = verified(shared.value, b.column("text").to_pylist(), threshold)
                ids = b.column("doc_id").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[f[0]] for f in found], pa.int64()), pa.array([shared.value.items[f[1]][0] for f in found], pa.int64()),
                     *(pa.array([f[i] for f in found], pa.float64()) for i in (2, 3, 4))],
                    names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
                )

        part = rows.mapInArrow(run, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The rows of ``documents``, all columns, that hold no test item; nothing is shuffled.

    Null and empty texts stay, repeated rows stay or go together, rows without an id are judged like others, and
    columns of any name stay. Without items all rows stay; an empty table stays empty.
    """
    spark = documents.sparkSession
    small_batches(spark)
    for index in shards(benchmark, shard_bytes):
        shared = spark.sparkContext.broadcast(index)  # SHARD_BYTES of text at most

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[f[0] for f in verified(shared.value, b.column("text").to_pylist(), threshold)]] = False
                yield b.filter(pa.array(keep))

        documents = documents.mapInArrow(trimmed(run), documents.schema)
    return documents


def op1_decontamination(spark, sf_dir):
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
