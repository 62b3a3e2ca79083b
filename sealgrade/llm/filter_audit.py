"""How text filters interact: what each removes in every order, with duplicates found by radix text tries.

Texts are dealt out by ranges of their beginnings. Where a range starts is the shortest prefix that
tells a text from the one before it in a sorted sample, so prefixes are as long as the texts near
them need; a text that fills a range alone is spread over several tasks and met once more afterwards.
Equal texts are put together before the shuffle. In its range each text goes whole into a compressed
trie, whose terminals hold the smallest document id; a walk over the terminals flags every document of a
larger id as a duplicate and adds the failures of the other filters, found once a text. What is left is a
narrow row a document: failures as bits of a mask. Masks are counted by part, and the counts alone
give every order's steps.
"""

from __future__ import annotations

import json
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate, permutations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealgrade.llm.common import Scratch, small_batches, table

FILTERS = "ABCDE"
#: Text bytes of a range; and, for the ranges' beginnings only, rows and text bytes that are sampled.
RANGE_BYTES, SAMPLE_ROWS, SAMPLE_BYTES = 16_000_000, 20_000, 16_000_000
#: Text bytes and documents that are held to put equal texts together before the shuffle.
HELD_BYTES, HELD_DOCS = 16_000_000, 50_000
#: Thresholds of the filters: words, per cent of distinct words, per cent of capital letters, marks.
FEWEST_WORDS, DISTINCT, CAPITALS = 50, 65, 5
MARKS = re.compile(r"[#$%&*|]")
UPPER = bytes(range(ord("A"), ord("Z") + 1))


def failures(text: str) -> int:
    """Bits of the filters A to D that ``text`` fails."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    capitals = len(raw) - len(raw.translate(None, UPPER))
    return ((len(words) < FEWEST_WORDS) | (100 * len(set(words)) < DISTINCT * len(words)) << 1
            | (100 * capitals > CAPITALS * len(text)) << 2 | (MARKS.search(text) is not None) << 3)


DUPLICATE = 1 << 4


# ---- tries ------------------------------------------------------------------------------


class Node:
    """An edge's stretch of text and what hangs below it; a terminal is the end of a whole text."""

    __slots__ = ("children", "docs", "label", "least", "mask", "text")

    def __init__(self, label: str):
        self.label = label
        self.children: dict[str, Node] = {}
        self.text: str | None = None
        self.least: int | None = None
        self.mask = 0
        #: Documents since the last walk: id, part, number of rows.
        self.docs: list[tuple[int | None, str, int]] = []


def common_length(a: str, b: str) -> int:
    """Characters that ``a`` and ``b`` begin with alike."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    low, step = 0, 16
    while a[low : low + step] == b[low : low + step]:
        low += step
        step *= 2
    while step > 1:
        step //= 2
        if a[low : low + step] == b[low : low + step]:
            low += step
    return low


class RadixTrie:
    """A compressed trie of whole texts."""

    def __init__(self):
        self.root = Node("")

    def insert(self, text: str) -> Node:
        """The terminal of ``text``, made where there is none."""
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
                node, at = child, len(text)
            elif text.startswith(child.label, at):
                node, at = child, at + len(child.label)
            else:
                n = common_length(child.label, text[at : at + len(child.label)])
                middle = Node(child.label[:n])
                child.label = child.label[n:]
                middle.children[child.label[0]] = child
                node.children[text[at]] = middle
                node, at = middle, at + n
        if node.text is None:
            node.text, node.mask = text, failures(text)
        return node

    def terminals(self) -> Iterator[Node]:
        """Ends of texts, in no given order."""
        rest = [self.root]
        while rest:
            node = rest.pop()
            rest += node.children.values()
            if node.text is not None:
                yield node

    def keep_only(self, text: str) -> None:
        """Leave out all that does not lead to the terminal of ``text``, which is in the trie."""
        node = self.insert(text)
        kept = Node(text)
        kept.text, kept.least, kept.mask = text, node.least, node.mask
        self.root = Node("")
        if text:
            self.root.children[text[0]] = kept
        else:
            kept.label, self.root = "", kept


# ---- ranges -----------------------------------------------------------------------------


@dataclass
class Ranges:
    """``starts[i]`` is the prefix at which range ``i + 1`` begins; ``spread[i]`` tasks share range ``i``."""

    starts: list[str] = field(default_factory=list)
    spread: list[int] = field(default_factory=lambda: [1])

    def of(self, text: str) -> int:
        return bisect_right(self.starts, text)


def ranges_of(sample: list[tuple[str, float]], target: float) -> Ranges:
    """Ranges of about ``target`` bytes, from sampled texts and the bytes that each stands for."""
    weights: dict[str, float] = {}
    for text, weight in sample:
        weights[text] = weights.get(text, 0.0) + weight
    out, held, before = Ranges(), 0.0, None
    for text in sorted(weights):
        weight = weights[text]
        if before is not None and (held + weight > target):
            out.starts.append(text[: common_length(before, text) + 1])
            out.spread.append(1)
            held = 0.0
        held += weight
        if weight > target:
            out.spread[-1] = math.ceil(weight / target)
        before = text
    return out


def sampled_ranges(texts: DataFrame, range_bytes: int) -> Ranges:
    """Ranges for ``texts(text)``; a bounded sample of whole texts reaches the driver."""
    n, size = texts.agg(F.count("*"), F.sum(F.octet_length("text") + 32)).first()
    if not n or size <= range_bytes:
        return Ranges()
    share = min(1.0, SAMPLE_ROWS / n, SAMPLE_BYTES / size)
    got = texts.select("text").sample(share, 7).collect()
    return ranges_of([(r["text"], (len(r["text"].encode()) + 32) / share) for r in got], range_bytes)


# ---- tasks ------------------------------------------------------------------------------

ROUTED = "place int, text string, first long, ids array<long>, parts array<string>, counts array<long>"
FLAGGED = "doc_id long, part string, mask int, n long, text string"


def _gather(ranges: Ranges):
    """Equal texts of a task together, as far as they are held at once, with the place they go to."""
    base = list(accumulate(ranges.spread, initial=0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[str, dict[tuple[int | None, str], int]] = {}
        held, docs, turn = 0, 0, TaskContext.get().partitionId()

        def rows() -> pa.RecordBatch:
            where = [ranges.of(t) for t in groups]
            keys = list(map(list, groups.values()))
            columns = [
                pa.array([base[r] + turn % ranges.spread[r] for r in where], pa.int32()), pa.array(list(groups), pa.string()),
                pa.array([min((i for i, _ in k if i is not None), default=None) for k in keys], pa.int64()),
                pa.array([[i for i, _ in k] for k in keys], pa.list_(pa.int64())),
                pa.array([[p for _, p in k] for k in keys], pa.list_(pa.string())),
                pa.array([list(g.values()) for g in groups.values()], pa.list_(pa.int64())),
            ]
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ROUTED.split(", ")])

        for b in batches:
            for doc_id, part, text, n in zip(*(b.column(c).to_pylist() for c in ("doc_id", "part", "text", "n")), strict=True):
                group = groups.get(text)
                if group is None:
                    group = groups[text] = {}
                    held += len(text)
                group[doc_id, part] = group.get((doc_id, part), 0) + n
                docs += 1
                if held > HELD_BYTES or docs > HELD_DOCS:
                    yield rows()
                    groups, held, docs, turn = {}, 0, 0, turn + 1
        if groups:
            yield rows()

    return run


def _flag(shared: set[int]):
    """Rows of sorted texts to flags. At a place that shares its range with others, documents of the
    smallest id seen there stay undecided: they come with their text."""

    def walk(trie: RadixTrie, out: list[tuple], undecided: bool) -> None:
        for node in trie.terminals():
            for doc_id, part, n in node.docs:
                if doc_id is None or doc_id == node.least:
                    out.append((doc_id, part, node.mask, n, node.text if undecided and doc_id is not None else None))
                else:
                    out.append((doc_id, part, node.mask | DUPLICATE, n, None))
            node.docs = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, here, text = RadixTrie(), None, ""
        names = [c.split()[0] for c in FLAGGED.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string()]
        for b in batches:
            out: list[tuple] = []
            for place, text, ids, parts, counts in zip(
                *(b.column(c).to_pylist() for c in ("place", "text", "ids", "parts", "counts")), strict=True
            ):
                if here != place:
                    walk(trie, out, here in shared)
                    trie, here = RadixTrie(), place
                node = trie.insert(text)
                least = min((i for i in ids if i is not None), default=None)
                if least is not None and (node.least is None or least < node.least):
                    node.least = least
                node.docs += zip(ids, parts, counts, strict=True)
            walk(trie, out, here in shared)
            if here is not None:
                # texts come in order: of those seen, only the last one can come again
                trie.keep_only(text)
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def _by_tries(rows: DataFrame, ranges: Ranges) -> DataFrame:
    """Flags of ``rows(doc_id, part, text, n)``; texts of one place are sorted there, equal ones by their ids."""
    shared, places = set(), list(accumulate(ranges.spread, initial=0))
    for first, tasks in zip(places, ranges.spread, strict=False):
        shared.update(range(first, first + tasks) if tasks > 1 else ())
    dealt = rows.mapInArrow(_gather(ranges), ROUTED).repartitionById(places[-1], "place")
    return dealt.sortWithinPartitions("place", "text", F.asc_nulls_last("first")).mapInArrow(_flag(shared), FLAGGED)


def failure_masks(documents: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``doc_id, part, mask, n``: the filters that each document fails, as bits in the order of ``FILTERS``.

    ``part`` is ``source``, a null one an empty string; ``n`` counts rows that agree in id, part and text. A null text
    counts as empty. A document is a duplicate if another row with a smaller id has the same text: rows that
    share the smallest id are none, nor is a row without an id, which makes no other one a duplicate
    either. Other columns are not read; an empty table gives no rows.
    """
    spark = documents.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.lit(1).cast("long").alias("n"),
    )
    ranges = sampled_ranges(rows, range_bytes)
    first = scratch.keep(_by_tries(rows, ranges))
    decided = first.where("text is null").drop("text")
    if max(ranges.spread) == 1:
        return decided
    # each sharing task leaves its documents of a text's smallest id at most: those meet in one task now
    rest = first.where("text is not null").select("doc_id", "part", "text", "n")
    again = scratch.keep(_by_tries(rest, Ranges(ranges.starts, [1] * len(ranges.spread))))
    return decided.unionByName(again.drop("text"))


# ---- the audit --------------------------------------------------------------------------


def _steps() -> str:
    """All orders and steps as JSON: the filter's bit and the bits of those before it."""
    out = []
    for order in map("".join, permutations(FILTERS)):
        bits = [1 << FILTERS.index(f) for f in order]
        out += [{"filter_order": order, "step": k + 1, "own": b, "before": sum(bits[:k])} for k, b in enumerate(bits)]
    return json.dumps(out)


def filter_audit(documents: DataFrame, labels: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """For each part, order of the filters and step: how many documents the step keeps and removes.

    ``labels(doc_id, quality, toxic)`` marks documents; rows that repeat an id count as one that is marked if any is,
    rows without an id mark nothing. ``redundant`` fail the step's filter but were removed before, ``unique_fails``
    fail it alone, ``good_lost`` and ``toxic_lost`` are removed here with quality 1 or toxic 1; ``shapley`` sums
    the filter's removals over all orders. See ``failure_masks`` for nulls, ties and repeated rows.
    """
    masks = Scratch(documents.sparkSession).keep(failure_masks(documents, range_bytes))
    marked = (
        labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
        .where("good = 1 or toxic = 1")
    )
    every = masks.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    some = masks.join(marked, "doc_id").groupBy("part", "mask").agg(
        F.lit(0).cast("long").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"),
    )
    counts = every.unionByName(some).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    # a part has 32 masks at most
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("tally"))
    steps = F.from_json(F.lit(_steps()), "array<struct<filter_order:string,step:int,own:int,before:int>>")
    each = parts.withColumn("s", F.explode(steps)).select("part", "s.*", "tally")

    def total(what: str, where: str) -> str:
        return f"aggregate(filter(tally, x -> {where}), 0L, (a, x) -> a + {what})"

    fails, gone = "(x.mask & own) != 0", "(x.mask & before) != 0"
    return each.selectExpr(
        "part", "filter_order", "step",
        f"{total('x.n', f'not {fails} and not {gone}')} as kept",
        f"{total('x.n', f'{fails} and not {gone}')} as removed",
        f"{total('x.n', f'{fails} and {gone}')} as redundant",
        f"{total('x.n', 'x.mask = own')} as unique_fails",
        f"{total('x.good', f'{fails} and not {gone}')} as good_lost",
        f"{total('x.toxic', f'{fails} and not {gone}')} as toxic_lost",
        # a filter comes first among the k that a document fails in one of k orders
        f"{total(f'x.n * ({math.factorial(len(FILTERS))} div bit_count(x.mask))', fails)} as shapley",
    )


def op11_filter_audit(spark, sf_dir):
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^ 	-]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
m AS (
  SELECT doc_id, part,
    CASE WHEN len(ws) < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask
  FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels GROUP BY doc_id),
c AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM m LEFT JOIN l ON m.doc_id = l.doc_id GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(x, b)),
o AS (
  SELECT f1.x || f2.x || f3.x || f4.x || f5.x AS filter_order, f1.b AS b1, f2.b AS b2, f3.b AS b3, f4.b AS b4, f5.b AS b5
  FROM f f1 JOIN f f2 ON f2.x <> f1.x JOIN f f3 ON f3.x NOT IN (f1.x, f2.x)
  JOIN f f4 ON f4.x NOT IN (f1.x, f2.x, f3.x) JOIN f f5 ON f5.x NOT IN (f1.x, f2.x, f3.x, f4.x)),
s AS (
  SELECT filter_order, 1 AS step, b1 AS own, 0 AS before FROM o
  UNION ALL SELECT filter_order, 2, b2, b1 FROM o
  UNION ALL SELECT filter_order, 3, b3, b1 + b2 FROM o
  UNION ALL SELECT filter_order, 4, b4, b1 + b2 + b3 FROM o
  UNION ALL SELECT filter_order, 5, b5, b1 + b2 + b3 + b4 FROM o),
steps AS (
  SELECT part, filter_order, step, own,
    CAST(sum(CASE WHEN mask & own = 0 AND mask & before = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN mask & own <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN mask = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM c CROSS JOIN s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM steps
"""
