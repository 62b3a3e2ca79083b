"""Jaccard join on word shingles by chosen paths.

In one run a set picks each of its tokens with chance ``1 / (split * size)``, by a hash all sets share, so
similar sets tend to pick a common token. Sets that picked the same token share a bucket; a bucket
beyond ``LIMIT`` is split again by tokens picked in dependence of the path so far. A pair at the threshold
meets at the deepest level with a known chance ``q``, and runs are repeated until ``1 - (1 - q) ** runs``
reaches the target recall.

Buckets compare fixed-size sketches (the smallest hash of each of 128 bins) and only give candidate
links. Candidates' components then compare whole shingle sets, each pair of blocks once, so every
reported link is exact, and pairs that no bucket brought together but that share a component
are found as well. Equal sets are one class and are compared once. Joins whose smaller side grows
with the input are marked for merging, so the plan is the same at every size.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealgrade.llm.common import (
    Scratch, Words, blocks, by_sorted_groups, components, local_components, mix, shingle_set, small_batches, table, trimmed,
)

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Words a worker remembers the hashes of; fewer than elsewhere, as paths and sets need memory beside them.
REMEMBERED = 250_000
#: Levels of splitting, size up to which a bucket is not split, and the splitting rate.
DEPTH, LIMIT, SPLIT = 3, 4_096, 0.65
#: Bins of a sketch; rows and tokens of a block.
BINS, SKETCH_BLOCK, SET_BLOCK, TOKEN_BLOCK = 128, 1_024, 256, 2_000_000
#: Products of a path and a token that are formed at once.
CELLS = 1 << 20
LAST = 2**63 - 1


def runs_for(threshold: float, recall: float, split: float = SPLIT, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has met with chance ``recall``."""
    q = 1.0
    for _ in range(depth):
        q = 1 - math.exp(-threshold / split * q)
    return math.ceil(math.log(1 - recall) / math.log(1 - q))


def chosen_paths(s: np.ndarray, runs: int, split: float = SPLIT, depth: int = DEPTH) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level the (parent, path) pairs that a set picks in all runs."""
    paths = mix(np.arange(1, runs + 1, dtype=np.uint64))
    levels = []
    limit = np.uint64(min(2**64 - 1, int(2**64 / (split * max(1, len(s))))))
    step = max(1, CELLS // max(1, len(s)))
    for _ in range(depth):
        salt = mix(paths)
        which, token = [s[:0].astype(np.int64)], [s[:0]]
        for at in range(0, len(paths), step):
            p, t = np.nonzero(s[None, :] * (salt[at : at + step, None] | np.uint64(1)) <= limit)
            which.append(p + at)
            token.append(s[t])
        which, token = np.concatenate(which), np.concatenate(token)
        parent, paths = paths[which], mix(token ^ salt[which])
        levels.append((parent, paths))
    return levels


def sketch(s: np.ndarray, bins: int = BINS) -> bytes:
    """One byte for each bin of hash values: 0 if empty, else from its smallest value."""
    edges = (np.arange(bins + 1, dtype=np.float64) * (2**64 / bins))
    at = np.searchsorted(s, edges[:-1].astype(np.uint64))
    end = np.r_[at[1:], len(s)]
    low = mix(s[np.minimum(at, len(s) - 1)]) % np.uint64(255) + np.uint64(1)
    return np.where(at < end, low, 0).astype(np.uint8).tobytes()


def _scan(k: int, runs: int):
    names = ["d", "k", "doc_id", "q1", "q2", "n", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Words(REMEMBERED)
        for b in batches:
            q1, q2, size, sk = [], [], [], []
            levels: list[list[np.ndarray]] = [[] for _ in range(2 * DEPTH)]
            for text in b.column("text").to_pylist():
                s = shingle_set(text, seen, k)
                size.append(len(s))
                if not len(s):
                    q1.append(None), q2.append(None), sk.append(None)
                    for x in levels:
                        x.append(np.empty(0, np.int64))
                    continue
                dig = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                q1.append(int.from_bytes(dig[:8], "little", signed=True))
                q2.append(int.from_bytes(dig[8:], "little", signed=True))
                sk.append(sketch(s))
                for i, (parent, own) in enumerate(chosen_paths(s, runs)):
                    levels[2 * i].append(parent.view(np.int64))
                    levels[2 * i + 1].append(own.view(np.int64))
            cols = [b.column("d"), b.column("k"), b.column("doc_id"), pa.array(q1, pa.int64()), pa.array(q2, pa.int64()),
                    pa.array(size, pa.int64()), pa.array(sk, pa.binary())]
            lists = []
            for x in levels:
                offsets = np.r_[0, np.cumsum([len(p) for p in x])].astype(np.int32)
                lists.append(pa.ListArray.from_arrays(offsets, np.concatenate(x) if x else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays(
                cols + lists, names=names + [f"{w}{i}" for i in range(1, DEPTH + 1) for w in ("up", "path")]
            )

    paths = ", ".join(f"up{i} array<long>, path{i} array<long>" for i in range(1, DEPTH + 1))
    return run, f"d long, k long, doc_id long, q1 long, q2 long, n long, sketch binary, {paths}"


def _buckets(scratch: Scratch, scanned: DataFrame) -> DataFrame:
    """``q1, bucket, size``: the buckets of two classes or more where the recursion ends."""
    out, large = None, None
    for level in range(1, DEPTH + 1):
        pairs = F.explode(F.arrays_zip(F.col(f"up{level}").alias("up"), F.col(f"path{level}").alias("bucket")))
        nodes = scanned.select("q1", pairs.alias("p")).select("q1", "p.up", "p.bucket")
        if large is not None:
            nodes = nodes.join(large.select(F.col("bucket").alias("up")), "up", "left_semi")
        nodes = nodes.select("q1", "bucket")
        # copies of a class raise the count, at worst a split too many
        sizes = scratch.keep(
            nodes.groupBy("bucket").agg(F.count("*").alias("size"), F.min("q1").alias("a"), F.max("q1").alias("b"))
            .where("a < b").select("bucket", "size")
        )
        ends = sizes if level == DEPTH else sizes.where(F.col("size") <= LIMIT)
        found = nodes.join(ends.hint("merge"), "bucket")
        out = found if out is None else out.unionByName(found)
        large = sizes.where(F.col("size") > LIMIT)
    return out.distinct()


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sketches (rows against rows, or one against rows) may belong to similar sets."""
    some = (a != 0) | (b != 0)
    same = ((a == b) & some).sum(axis=-1)
    some = some.sum(axis=-1)
    return same >= np.where(some < 48, 0.3, 0.5) * some


def _candidates(threshold: float):
    def large(sk: np.ndarray, n: np.ndarray) -> tuple[list[int], list[int]]:
        u, v, rest = [], [], np.arange(len(n))
        while len(rest):
            head, rest = rest[0], rest[1:]
            queue = [head]
            while queue and len(rest):
                r = queue.pop()
                fits = np.minimum(n[rest], n[r]) >= threshold * np.maximum(n[rest], n[r]) - 1e-9
                fits[fits] = _alike(sk[rest[fits]], sk[r])
                got, rest = rest[fits], rest[~fits]
                u += got.tolist()
                v += [head] * len(got)
                queue += got.tolist()
        return u, v

    def run(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends = np.r_[starts[1:], t.num_rows]
        q, n = t.column("q1").to_numpy(), t.column("n").to_numpy()
        raw = t.column("sketch").combine_chunks()
        sk = np.frombuffer(b"".join(raw.to_pylist()), np.uint8).reshape(len(q), -1)
        group = np.repeat(np.arange(len(starts)), ends - starts)
        us, vs = [], []
        small = (ends - starts)[group] <= 32
        for lag in range(1, int(min(32, (ends - starts).max()))):
            i = np.flatnonzero((group[:-lag] == group[lag:]) & small[:-lag])
            j = i + lag
            fits = np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-9
            i, j = i[fits], j[fits]
            fits = _alike(sk[i], sk[j])
            us.append(i[fits])
            vs.append(j[fits])
        for g in np.flatnonzero(ends - starts > 32):
            s, e = starts[g], ends[g]
            i, j = large(sk[s:e], n[s:e])
            us.append(np.asarray(i, np.int64) + s)
            vs.append(np.asarray(j, np.int64) + s)
        if us:
            u, v = np.concatenate(us), np.concatenate(vs)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(q[u]), pa.array(q[v])], names=["u", "v"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Words(REMEMBERED)
        for b in batches:
            sets = [shingle_set(t, seen, k).view(np.int64) for t in b.column("text").to_pylist()]
            offsets = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
            tokens = pa.ListArray.from_arrays(offsets, np.concatenate(sets) if sets else np.empty(0, np.int64))
            at = b.schema.get_field_index("text")
            yield pa.RecordBatch.from_arrays(
                [*(c for i, c in enumerate(b.columns) if i != at), tokens],
                names=[*(c for c in b.schema.names if c != "text"), "tokens"],
            )

    return run


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, from the tokens at least two sets hold."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    tokens = np.concatenate(sets)
    order = np.argsort(tokens, kind="stable")
    tokens, row = tokens[order], row[order]
    new = np.r_[True, tokens[1:] != tokens[:-1]]
    col = np.cumsum(new) - 1
    shared = np.bincount(col) > 1
    name = np.cumsum(shared) - 1
    keep = shared[col]
    row, col = row[keep], name[col[keep]]
    out = np.zeros((n, n), np.float64)
    width = max(1, 8_000_000 // n)
    for at in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(col, [at, at + width])
        x = np.zeros((n, min(width, int(shared.sum()) - at)), np.float32)
        x[row[lo:hi], col[lo:hi] - at] = 1
        out += x @ x.T
    return out.astype(np.int64)


def _verify(threshold: float):
    def one(t: pa.Table) -> pa.RecordBatch | None:
        q, n, copies, blk = (t.column(c).to_numpy() for c in ("q1", "n", "copies", "blk"))
        tokens = t.column("tokens").combine_chunks()
        tokens = tokens.combine_chunks() if isinstance(tokens, pa.ChunkedArray) else tokens
        both = _overlaps([x.values.to_numpy() for x in tokens])
        ok = np.triu(both >= threshold * (n[:, None] + n[None, :] - both) - 1e-9, 1)
        if t.column("a")[0].as_py() != t.column("b")[0].as_py():
            ok &= blk[:, None] != blk[None, :]
        i, j = np.nonzero(ok)
        if not len(i):
            return None
        links = np.zeros(len(q), np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        label = local_components(len(q), i, j)
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays(
            [pa.array(q[some]), pa.array(q[label[some]]), pa.array(links[some])], names=["u", "v", "n_links"]
        )

    def run(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for s, e in zip(starts, np.r_[starts[1:], t.num_rows], strict=True):
            if e - s > 1 and (out := one(t.slice(s, e - s))) is not None:
                yield out

    return run


def keyed(documents: DataFrame) -> DataFrame:
    """``doc_id, d, k, text``: ``d`` orders documents (a null id last), ``k`` names a row by id and text."""
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"),
        F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("k"), F.col("text").cast("string").alias("text"),
    )


def similar_documents(
    documents: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, recall: float = RECALL,
) -> DataFrame:
    """``doc_id, k, class_id, n_links, component_id, kept`` for each row of ``documents(doc_id, text)``.

    ``class_id`` is the smallest id of the rows with the same shingle set, ``n_links`` the number of other rows
    of similarity ``threshold`` or more (copies counted), ``component_id`` the smallest id reachable over links,
    ``kept`` whether the row has that id; rows that repeat id and text are kept or go together, and of a
    group without ids the rows of one text are kept. Words are
    what ASCII white space separates, unchanged; a text of fewer words than a shingle is one shingle; null
    and blank texts link with nothing and are kept. A null id counts as larger than any. ``k`` is a hash of id
    and text. Other columns are not read; an empty table gives no rows.
    """
    spark = documents.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    docs = keyed(documents)
    run, schema = _scan(shingle, runs_for(threshold, recall))
    scanned = scratch.keep(docs.select("d", "k", "doc_id", "text").mapInArrow(trimmed(run), schema))
    narrow = scanned.select("doc_id", "d", "k", "q1", "q2")
    classes = scratch.keep(
        scanned.where("q1 is not null").groupBy("q1", "q2").agg(
            F.min(F.struct("d", "k")).alias("first"), F.count("*").alias("copies"),
            F.max("n").alias("n"), F.any_value("sketch").alias("sketch"),
        ).select("q1", "q2", F.col("first.d").alias("cls"), F.col("first.k").alias("k"), "copies", "n", "sketch")
    )
    found = scratch.keep(_buckets(scratch, scanned))
    met = found.join(classes.select("q1", "n", "sketch").hint("merge"), "q1")
    met = blocks(met, "bucket", F.ceil(F.col("size") / SKETCH_BLOCK), "q1")
    pairs = scratch.keep(by_sorted_groups(met, ["bucket", "a", "b"], _candidates(threshold), "u long, v long"))
    scratch.drop(found)
    groups = components(scratch, pairs)
    scratch.drop(pairs)
    wanted = scratch.keep(
        classes.select("q1", "k", "n", "copies").join(groups.withColumnRenamed("node", "q1"), "q1")
        .dropDuplicates(["q1"])
    )
    texts = docs.select("k", "text").join(wanted.hint("merge"), "k")
    sets = scratch.keep(
        texts.mapInArrow(trimmed(_sets(shingle)), "k long, q1 long, n long, copies long, component long, tokens array<long>")
        .dropDuplicates(["q1"])
    )
    sizes = scratch.keep(wanted.groupBy("component").agg(F.count("*").alias("size"), F.sum("n").alias("tokens_in")))
    parts = F.ceil(F.greatest(F.col("size") / SET_BLOCK, F.col("tokens_in") / TOKEN_BLOCK))
    met = blocks(sets.join(sizes, "component"), "component", parts, "q1")
    links = scratch.keep(by_sorted_groups(
        met, ["component", "a", "b"], _verify(threshold), "u long, v long, n_links long"
    ))
    scratch.drop(sets, sizes, wanted)
    degree = scratch.keep(links.groupBy(F.col("u").alias("q1")).agg(F.sum("n_links").alias("linked")))
    groups = components(scratch, links.select("u", "v").where("u != v")).withColumnRenamed("node", "q1")
    named = scratch.keep(classes.drop("sketch").join(groups, "q1").groupBy("component").agg(F.min(F.struct("cls", "k")).alias("least")))
    known = scratch.keep(
        classes.drop("sketch").join(degree, "q1", "left").join(groups, "q1", "left").join(named, "component", "left")
        .select("q1", "q2", "cls", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
                F.coalesce("least", F.struct("cls", "k")).alias("least"))
    )

    def shown(name):  # the stand-in for a null id
        return F.when(F.col(name) != LAST, F.col(name)).alias(name)
    return (
        narrow.join(known, ["q1", "q2"], "left")
        .select(
            "doc_id", "k", F.coalesce("cls", "d").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
            F.coalesce("least.cls", "d").alias("component_id"),
            # without ids in a group, the row of the smallest key stands for it
            F.coalesce((F.col("d") == F.col("least.cls")) & ((F.col("d") != LAST) | (F.col("k") == F.col("least.k"))), F.lit(True)).alias("kept"),
        ).withColumn("class_id", shown("class_id")).withColumn("component_id", shown("component_id"))
    )


def one_of_each_group(documents: DataFrame, **options) -> DataFrame:
    """One row of each group of ``similar_documents``, all columns; rows that link with nothing stay.

    It is the row of the smallest id (a null one comes last); of rows that agree in id and text, any one of
    which may stand for the others, one stays. So exact repetitions go even if their ids are null. Null and blank texts
    link with nothing, but rows that agree in id and such a text are repetitions, too. Columns may have any name; an
    empty table stays empty.
    """
    names = []
    for name in ("k", "d", "times", "turn"):
        while name in documents.columns or name in names:
            name += "_"
        names.append(name)
    k, d, times, turn = names
    kept = similar_documents(documents, **options).where("kept").select("k", F.coalesce("doc_id", F.lit(LAST)).alias("d"))
    kept = Scratch(documents.sparkSession).keep(kept.groupBy("k", "d").agg(F.count("*").alias("times"))).toDF(k, d, times)
    rows = documents.withColumns({
        k: F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")),
        d: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)),
    })

    def of(keys: DataFrame) -> DataFrame:
        return rows.join(keys.select(k, d).hint("merge"), [k, d], "left_semi")

    # repetitions are few or one row very often: those of a task go before the others meet
    again = of(kept.where(F.col(times) > 1)).withColumn(turn, F.spark_partition_id())
    again = again.dropDuplicates([k, d, turn]).dropDuplicates([k, d]).drop(turn)
    return of(kept.where(F.col(times) == 1)).unionByName(again).select(*[F.col(f"`{c}`") for c in documents.columns])


def op6_ngram_jaccard_join(spark, sf_dir):
    return similar_documents(table(spark, sf_dir, "documents")).drop("k")


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, array_to_string(ws[p:p + 4], ' ') AS g
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS p FROM w WHERE len(ws) > 0))
), n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(1) ORDER BY g)) AS h FROM s GROUP BY doc_id),
e AS (
  SELECT p.u, p.v FROM (
    SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
  ) p JOIN n x ON x.doc_id = p.u JOIN n y ON y.doc_id = p.v WHERE 10 * c >= 8 * (x.n + y.n - c)
), r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.doc_id
), m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id),
d AS (SELECT u, count(*) AS n_links FROM e GROUP BY u),
c AS (SELECT h, min(doc_id) AS class_id FROM n GROUP BY h)
SELECT m.doc_id, coalesce(c.class_id, m.doc_id) AS class_id, coalesce(d.n_links, 0)::BIGINT AS n_links, m.component_id,
  m.doc_id = m.component_id AS kept
FROM m LEFT JOIN d ON d.u = m.doc_id LEFT JOIN n ON n.doc_id = m.doc_id LEFT JOIN c USING (h)
"""
