"""Removing repeated passages: de Bruijn compaction of repeated word windows.

A window of ``k`` words is an edge of the graph whose nodes are its first and last ``k - 1``
words. Edges that start in two documents are kept; a chain of edges without branches, the same
in every document that holds it, is one path, of which only the two ends go on. The first
document of a path is its source; the occurrence in any other document is removed once its length
and last edge agree with those at the source's coordinates.

What keeps the shuffles small: every window holds the smallest hash of its seven seven-word grams,
so a repeated window repeats that hash too. About a quarter of the windows bring a new such
anchor, and only windows with an anchor seen in two documents become edges. Whole copies of a
document are known by their digest, and all but the first are left out before. Anchors that very many
documents share are known to repeat and never meet in one task; edges combine before the
shuffle, and the join that marks path ends may be split. Joins whose smaller side grows with the
input are marked for merging, so the plan is the same at every size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sealgrade.llm.common import Scratch, grams, small_batches, table, word_runs

#: Words of a window, and of the grams whose smallest hash is a window's anchor.
K, GRAM = 13, 7
#: Frequent anchors are looked for in one of this many documents (a matter of speed only), and the
#: list of them, the one thing broadcast, holds at most HOT_KEYS numbers.
HOT_SAMPLE, HOT_COUNT, HOT_KEYS = 16, 6, 20_000
LAST = 2**63 - 1


def _words(text: str | None) -> list[bytes]:
    """Runs of anything but space and the characters 9 to 13."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _anchors(lo: np.ndarray, k: int) -> np.ndarray:
    """The anchor of each window."""
    g = grams(lo, min(GRAM, k))
    span = k - min(GRAM, k) + 1
    n = len(g) - span + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = g[:n].copy()
    for j in range(1, span):
        np.minimum(out, g[j : j + n], out=out)
    return out


def _scan(k: int):
    schema = pa.schema([("d", pa.int64()), ("k", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()),
                        ("sha", pa.string()), ("anchors", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sha, anchors = [], [], []
            for part in word_runs(b.column("text")):
                a = _anchors(part.hashes(False), k)
                new = np.r_[True, a[1:] != a[:-1]]
                at = part.at.tolist()
                for i, (start, stop) in enumerate(zip(at, at[1:], strict=False)):
                    n.append(stop - start)
                    sha.append(hashlib.sha256(part.text(i)).hexdigest())
                    # the windows that lie in this text
                    end = max(start, stop - k + 1)
                    own = a[start:end][new[start:end]] if end > start + 1 else a[start:end]
                    if end > start + 1 and not new[start]:
                        own = np.append(own, a[start])
                    anchors.append(np.unique(own).view(np.int64))
            yield pa.record_batch([b.column("d"), b.column("k"), b.column("doc_id"), pa.array(n, pa.int64()),
                                   pa.array(sha), _lists(anchors, np.int64)], schema=schema)

    return run, "d long, k long, doc_id long, n_words long, sha string, anchors array<long>"


def _lists(parts: list[np.ndarray], dtype) -> pa.ListArray:
    offsets = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate(parts) if parts else np.empty(0, dtype))


def _among(values: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Positions of the values that are in ``found``, which is not empty."""
    found = np.sort(found)
    at = np.searchsorted(found, values)
    at[at == len(found)] = 0
    return np.flatnonzero(found[at] == values)


def _edges(k: int):
    """Positions and 128-bit hashes of the windows whose anchor is among ``found``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pos, h1, h2 = [], [], []
            found = iter(b.column("found"))
            for part in word_runs(b.column("text")):
                lo, hi = part.hashes(False), part.hashes(True)
                a, at = _anchors(lo, k), part.at.tolist()
                here = [
                    _among(a[start : max(start, stop - k + 1)], next(found).values.to_numpy().view(np.uint64))
                    for start, stop in zip(at, at[1:], strict=False)
                ]
                pos += [x.astype(np.int32) for x in here]
                picked = np.concatenate([x + start for x, start in zip(here, at, strict=False)])
                cuts = np.cumsum([len(x) for x in here])[:-1]
                h1 += np.split(grams(lo, k, picked).view(np.int64), cuts)
                h2 += np.split(grams(hi, k, picked).view(np.int64), cuts)
            yield pa.record_batch(
                [b.column("d"), b.column("k"), _lists(pos, np.int32), _lists(h1, np.int64), _lists(h2, np.int64)],
                names=["d", "k", "pos", "h1", "h2"],
            )

    return run, "d long, k long, pos array<int>, h1 array<long>, h2 array<long>"


def _cut(k: int):
    """Texts without the words their spans cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, removed, sha = [], [], []
            for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                w = _words(text)
                depth = np.zeros(len(w) + 1, np.int64)
                for s in spans:
                    depth[s["start"]] += 1
                    depth[s["last"] + k] -= 1
                keep = np.flatnonzero(np.cumsum(depth[:-1]) == 0)
                left = b" ".join([w[i] for i in keep])
                removed.append(len(w) - len(keep))
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode("utf-8", "surrogatepass"))
            yield pa.record_batch([b.column("d"), b.column("k"), pa.array(removed, pa.int64()), pa.array(sha),
                                   pa.array(kept, pa.string())], names=["d", "k", "n_removed", "cut_sha", "kept_text"])

    return run, "d long, k long, n_removed long, cut_sha string, kept_text string"


def _repeated_anchors(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """``k, found``: for each document the anchors that another document holds as well."""
    spark = scratch.spark
    rows = docs.select("k", F.explode("anchors").alias("a"))
    some = rows.where(F.pmod("k", F.lit(HOT_SAMPLE)) == 0).groupBy("a").agg(F.count("*").alias("c"))
    hot = scratch.keep(some.where(F.col("c") >= HOT_COUNT).orderBy(F.desc("c"), "a").limit(HOT_KEYS).select("a"))
    listed = F.broadcast(hot)
    w = Window.partitionBy("a")
    met = (
        rows.join(listed, "a", "left_anti")
        .withColumn("least", F.min("k").over(w)).withColumn("most", F.max("k").over(w))
        .where("least < most").select("k", "a")
    )
    # a listed anchor that one row alone holds is a needless candidate, never a wrong result
    both = met.unionByName(rows.join(listed, "a", "left_semi").select("k", "a"))
    out = scratch.keep(both.groupBy("k").agg(F.collect_list("a").alias("found")))
    scratch.drop(hot)
    return out


def repeated_spans(scratch: Scratch, docs: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """``d, k, spans``: first and last window of each passage to remove from a document."""
    run, schema = _edges(k)
    kept = scratch.keep(docs.join(found.hint("merge"), "k").select("d", "k", "text", "found").mapInArrow(run, schema))
    scratch.drop(found)
    pos, h1, h2 = F.col("pos"), F.col("h1"), F.col("h2")
    occ = kept.select("d", "k", F.explode(F.transform(pos, lambda p, i: F.struct(
        p.alias("pos"), h1[i].alias("h1"), h2[i].alias("h2"),
        F.when((i > 0) & (F.get(pos, i - 1) == p - 1), F.get(h1, i - 1)).otherwise(F.lit(0)).alias("before"),
        F.when(F.get(pos, i + 1) == p + 1, F.get(h1, i + 1)).otherwise(F.lit(0)).alias("after"),
    ))).alias("e")).select("d", "k", "e.*")
    edges = scratch.keep(
        occ.groupBy("h1", "h2").agg(
            F.min("d").alias("first"), F.max("d").alias("final"),
            F.min("before").alias("b0"), F.max("before").alias("b1"),
            F.min("after").alias("a0"), F.max("after").alias("a1"),
        ).where("first < final").select(
            "h1", "h2", "first", F.when(F.expr("b0 = b1"), F.col("b0")).otherwise(0).alias("before"),
            F.when(F.expr("a0 = a1"), F.col("a0")).otherwise(0).alias("after"),
        )
    )
    # a link holds where each of two edges knows only the other as its neighbour
    links = scratch.keep(
        edges.where("after != 0").alias("p").join(
            edges.where("before != 0").alias("n"), F.expr("p.after = n.h1 and n.before = p.h1 and p.first = n.first")
        ).select("p.h1", "p.h2", F.col("n.h1").alias("n1"), F.col("n.h2").alias("n2"))
    )
    ends = (
        edges.join(links.select("h1", "h2", F.lit(True).alias("goes_on")).distinct(), ["h1", "h2"], "left")
        .join(links.select(F.col("n1").alias("h1"), F.col("n2").alias("h2"), F.lit(True).alias("came")).distinct(),
              ["h1", "h2"], "left")
        .where("goes_on is null or came is null")
        .select("h1", "h2", "first", F.col("came").isNull().alias("head"), F.col("goes_on").isNull().alias("tail"))
    )
    ends = scratch.keep(ends)
    scratch.drop(edges, links)
    marked = scratch.keep(occ.select("d", "k", "pos", "h1", "h2").join(ends.hint("merge"), ["h1", "h2"]))
    scratch.drop(kept, ends)
    w = Window.partitionBy("k", "d").orderBy("pos")
    mate = F.lead(F.struct("pos", "h1", "h2", "tail")).over(w)
    paths = scratch.keep(
        marked.withColumn("mate", F.when(F.col("tail"), F.struct("pos", "h1", "h2", "tail")).otherwise(mate))
        .where("head and mate.tail")
        .select("d", "k", "h1", "h2", "first", F.col("pos").alias("start"), F.col("mate.pos").alias("last"),
                F.struct((F.col("mate.pos") - F.col("pos")).alias("n"), F.col("mate.h1"), F.col("mate.h2")).alias("rest"))
    )
    scratch.drop(marked)
    source = scratch.keep(
        paths.where("d = first").groupBy("h1", "h2").agg(F.min("rest").alias("at_source"))
    )
    checked = paths.where("d > first").join(source, ["h1", "h2"]).where("rest = at_source")
    return scratch.keep(
        checked.groupBy("d", "k").agg(F.collect_list(F.struct("start", "last")).alias("spans"))
    )


def remove_repeats(documents: DataFrame, k: int = K) -> DataFrame:
    """Each row of ``documents`` with ``n_words``, ``n_removed``, ``kept_sha256`` and ``kept_text``.

    Needs ``doc_id`` and ``text``; other columns, whatever their names, are not read. A word goes if a
    window of ``k`` words that covers it also starts in a document of smaller ``doc_id``. Null and
    blank texts have no words; a null ``doc_id`` counts as larger than any. Rows that share a
    ``doc_id`` are no sources of each other, and each row is returned. ``kept_text`` is null where
    nothing was removed (the text stands as it is). An empty table gives no rows.
    """
    spark = documents.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    docs = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"),
        F.xxhash64("doc_id", "text").alias("k"), F.col("text").cast("string").alias("text"),
    )
    run, schema = _scan(k)
    scanned = scratch.keep(docs.select("d", "k", "doc_id", "text").mapInArrow(run, schema))
    narrow = scratch.keep(scanned.drop("anchors"))
    first = scratch.keep(
        narrow.where(F.col("n_words") >= k).groupBy("sha").agg(F.min("d").alias("first"), F.max("d").alias("final"))
        .where("first < final").drop("final")
    )
    whole = scratch.keep(narrow.join(first, "sha").where("d > first").select("d", "k").distinct())
    singles = scanned.where(F.size("anchors") > 0).select("d", "k", "anchors").join(whole.hint("merge"), ["d", "k"], "left_anti")
    found = _repeated_anchors(scratch, singles)
    scratch.drop(scanned)
    spans = repeated_spans(scratch, docs, found, k)
    run, schema = _cut(k)
    cut = scratch.keep(docs.join(spans.hint("merge"), ["d", "k"]).select("d", "k", "text", "spans").mapInArrow(run, schema).distinct())
    empty = hashlib.sha256(b"").hexdigest()
    return (
        narrow.join(whole.withColumn("copy", F.lit(True)), ["d", "k"], "left").join(cut, ["d", "k"], "left")
        .select(
            "doc_id", "n_words",
            F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
            F.when(F.col("copy"), F.lit(empty)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
            F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
        )
    )


def op4_substring_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, p, array_to_string(ws[p:p + 12], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM w WHERE len(ws) >= 13)
), first AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS i FROM win JOIN first USING (s) WHERE doc_id > m
), kept AS (
  SELECT u.doc_id, string_agg(u.word, ' ' ORDER BY u.i) AS t, count(*) AS n
  FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w) u
  ANTI JOIN gone ON gone.doc_id = u.doc_id AND gone.i = u.i GROUP BY u.doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""
