"""Near-duplicate vectors: spherical k-means cells, blocked cosines within cells, one kept a group.

Cells only say who meets whom. Two unit vectors of cosine ``t`` are at most ``sqrt(2 - 2 t)`` apart,
so if they lie in two cells, one of them is within half of that of the plane between the two
centres. A vector that close to another cell's plane is sent there too; every pair at or above the
threshold then meets, whatever the centres, and the result is exact (recall 1). Guests of a cell are
compared with its own vectors only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealgrade.llm.common import Scratch, by_sorted_groups, components, local_components, small_batches, table

#: Vectors a cell should hold (few large cells have fewer guests), most centres, rows and bytes of the sample they are fitted on.
CELL, MAX_CELLS, SAMPLE, SAMPLE_BYTES = 4_000, 4_096, 20_000, 64_000_000
#: Vectors of a block of a cell's own vectors and of its guests; a task compares two blocks, so many rows at a time.
BLOCK, GUESTS, STRIP = 4_096, 4_096, 512
#: Guests' blocks are numbered from here.
FIRST_GUEST = 1 << 40
THRESHOLD = 0.9


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centres of unit rows ``x``; an empty cell keeps its centre."""
    rng = np.random.default_rng(seed)
    centres = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        near = np.argmax(x @ centres.T, axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1)
        centres = np.where((size > 1e-9)[:, None], total / np.maximum(size, 1e-9)[:, None], centres)
    return np.unique(centres, axis=0)


def unit_rows(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    """Vectors of one length as unit rows in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = np.asarray(column.flatten(), np.float64).reshape(n, -1)
    # by the largest value first: no square overflows or vanishes
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _near_cells(x: np.ndarray, centres: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home cell of each unit row, and the pairs (row, cell) of cells whose plane is within ``margin``."""
    s = x @ centres.T
    home = np.argmax(s, axis=1)
    gap = np.sqrt(np.maximum(0.0, 2 - 2 * (centres[home] @ centres.T)))
    near = s[np.arange(len(x)), home][:, None] - s <= margin * gap + 1e-7
    near[np.arange(len(x)), home] = True
    row, cell = np.nonzero(near)
    return home, row, cell


def _assign(centres: np.ndarray | None, threshold: float):
    """Rows for the home cell and for each other cell whose plane is near."""
    margin = math.sqrt(max(0.0, 2 - 2 * threshold)) / 2 + 1e-7

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, STRIP):
                b = whole.slice(at, STRIP)
                n = b.num_rows
                v = b.column("v")
                # vectors of another length than the centres have one cell
                like = np.zeros(n, bool) if centres is None else v.value_lengths().to_numpy() == centres.shape[1]
                home, row, cell = np.zeros(n, np.int64), np.flatnonzero(~like), np.zeros(n - like.sum(), np.int64)
                if like.any():
                    which = np.flatnonzero(like)
                    here, r, c = _near_cells(unit_rows(v.take(pa.array(which)), len(which)), centres, margin)
                    home[which] = here
                    row, cell = np.r_[row, which[r]], np.r_[cell, c]
                    order = np.lexsort((cell, row))
                    row, cell = row[order], cell[order]
                ends = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
                cells = pa.ListArray.from_arrays(pa.array(ends), pa.array(cell))
                out = b.append_column("cells", cells).take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [*out.columns[:-1], pa.array(cell), pa.array(home[row]), out.columns[-1]],
                    names=[*b.schema.names, "cell", "home", "cells"],
                )

    return run


def _compare(threshold: float):
    """Links between the rows of two blocks, each pair in one cell only; summed for each row."""

    def one(t: pa.Table) -> pa.RecordBatch | None:
        ids = t.column("cls").to_numpy()
        order = np.argsort(ids, kind="stable")
        t, ids = t.take(order), ids[order]
        blk, home, cell = (t.column(c).to_numpy() for c in ("blk", "home", "cell"))
        a, b, here = t.column("a")[0].as_py(), t.column("b")[0].as_py(), cell[0]
        left, right = np.flatnonzero(blk == a), np.flatnonzero(blk == b)
        if not len(left) or not len(right):
            return None
        x = unit_rows(t.column("v"), len(ids))
        other = np.ascontiguousarray(x[right].T)
        found = []
        for at in range(0, len(left), STRIP):
            i, j = np.nonzero(x[left[at : at + STRIP]] @ other >= threshold)
            i, j = left[at + i], right[j]
            found.append((i[i < j], j[i < j]) if a == b else (i, j))
        i, j = (np.concatenate(y) for y in zip(*found, strict=True))
        if len(i) and b >= FIRST_GUEST:
            # a pair that also meets in the guest's cell counts in the lower numbered one
            cells = t.column("cells").to_pylist()
            first = [not (home[q] < here and home[q] in cells[p]) for p, q in zip(i, j, strict=True)]
            i, j = i[first], j[first]
        copies = t.column("copies").to_numpy()
        if not len(i):
            return None
        n_links = np.zeros(len(ids), np.int64)
        np.add.at(n_links, i, copies[j])
        np.add.at(n_links, j, copies[i])
        label = local_components(len(ids), i, j)
        some = np.flatnonzero(n_links)
        t = t.take(some)
        return pa.RecordBatch.from_arrays(
            [t.column(c).combine_chunks() for c in ("q1", "q2", "cls")] + [pa.array(ids[label[some]]), pa.array(n_links[some])],
            names=["q1", "q2", "u", "v", "n_links"],
        )

    def run(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for s, e in zip(starts, np.r_[starts[1:], t.num_rows], strict=True):
            if e - s > 1 and (out := one(t.slice(s, e - s).combine_chunks())) is not None:
                yield out

    return run


def block_pairs(placed: DataFrame) -> DataFrame:
    """A row for each pair of blocks (a, b) of a cell that a vector takes part in.

    ``a`` is a block of the cell's own vectors, ``b`` one not before it, or one of guests.
    """
    first, zero = F.lit(FIRST_GUEST), F.lit(0).cast("long")
    row = placed.withColumn(
        "blk", F.when(F.col("guest"), first + F.pmod(F.xxhash64("q1", F.lit(7)), F.col("ng")))
        .otherwise(F.pmod(F.xxhash64("q1", F.lit(7)), F.col("nb")))
    )
    with_own = F.transform(F.sequence(zero, F.col("nb") - 1), lambda j: F.struct(
        F.least("blk", j).alias("a"), F.greatest("blk", j).alias("b")))
    with_guests = F.when(F.col("ng") > 0, F.transform(F.sequence(zero, F.col("ng") - 1), lambda g: F.struct(
        F.col("blk").alias("a"), (first + g).alias("b")))).otherwise(F.array().cast("array<struct<a:bigint,b:bigint>>"))
    pairs = F.when(F.col("guest"), with_own).otherwise(F.concat(with_own, with_guests))
    return row.withColumn("pair", F.explode(pairs)).select("*", "pair.a", "pair.b").drop("pair", "nb", "ng", "guest")


def near_duplicates(
    embeddings: DataFrame, threshold: float = THRESHOLD, cell_size: int = CELL, max_cells: int = MAX_CELLS,
    sample: int = SAMPLE, block: int = BLOCK, guest_block: int = GUESTS,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``embeddings(vec_id, embedding)``.

    ``n_links`` counts the other rows of cosine ``threshold`` or more (equal vectors are compared once and
    counted with their copies); ``component_id`` is the smallest id reachable. Vectors that are null, empty,
    zero, or hold a null or non-finite value link with nothing, nor do vectors of unlike length or rows
    without an id (their component is null, and they are not kept). Rows that share an id reach
    each other. Other columns are not read; an empty table gives no rows.
    """
    spark = embeddings.sparkSession
    small_batches(spark, 4_000)
    scratch = Scratch(spark)
    v = F.col("v")
    kind = embeddings.schema["embedding"].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v"))
    good = F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall(
        v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    )
    good = good & F.exists(v, lambda c: c != 0)
    rows = rows.withColumn("v", F.when(good, v))
    rows = scratch.keep(rows.select("vec_id", "v", F.xxhash64("v").alias("q1"), F.xxhash64("v", F.lit(1)).alias("q2")))
    classes = scratch.keep(
        rows.where("v is not null").groupBy("q1", "q2").agg(
            F.min("vec_id").alias("cls"), F.count("*").alias("copies"), F.any_value("v").alias("v")
        )
    )
    n = classes.count()
    top = classes.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    centres = None
    if top:
        rows_at_most = max(1, min(sample, SAMPLE_BYTES // (8 * top["dim"])))
        picked = classes.where(F.size("v") == top["dim"]).orderBy(F.xxhash64("q1"), "q1", "q2").limit(rows_at_most).select("v")
        got = picked.toArrow().column("v")
        data = unit_rows(got, len(got))
        centres = spherical_kmeans(data, max(1, min(max_cells, math.ceil(n / cell_size))))
    kinds = f"q1 long, q2 long, cls long, copies long, v {kind}"
    placed = scratch.keep(
        classes.select("q1", "q2", "cls", "copies", "v").mapInArrow(
            _assign(centres, threshold), f"{kinds}, cell long, home long, cells array<long>"
        ).withColumn("dim", F.size("v").cast("long")).withColumn("guest", F.col("cell") != F.col("home"))
    )
    sizes = scratch.keep(
        placed.groupBy("dim", "cell").agg(F.count_if(~F.col("guest")).alias("own"), F.count_if("guest").alias("guests"))
        .select("dim", "cell", F.ceil(F.col("own") / block).alias("nb"), F.ceil(F.col("guests") / guest_block).alias("ng"))
        .where("nb > 0")
    )
    met = block_pairs(placed.join(sizes, ["dim", "cell"]))
    links = scratch.keep(by_sorted_groups(
        met, ["dim", "cell", "a", "b"], _compare(threshold), "q1 long, q2 long, u long, v long, n_links long"
    ))
    scratch.drop(placed, sizes)
    degree = scratch.keep(links.groupBy("q1", "q2").agg(F.sum("n_links").alias("n_links")))
    groups = components(scratch, links.select("u", "v").where("u != v"))
    known = scratch.keep(
        classes.select("q1", "q2", "cls", "copies").join(degree, ["q1", "q2"], "left")
        .join(groups.withColumnRenamed("node", "cls"), "cls", "left")
        .select("q1", "q2", (F.col("copies") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"),
                F.coalesce("component", "cls").alias("component"))
    )
    valid = F.col("v").isNotNull()
    return (
        rows.withColumn("q1", F.when(valid, F.col("q1"))).join(known, ["q1", "q2"], "left")
        .select(
            "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
            F.coalesce("component", "vec_id").alias("component_id"),
        ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )


def op7_embedding_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), e AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.9
), r(vec_id, c) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.vec_id
), m AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT u, count(*) AS n_links FROM e GROUP BY u)
SELECT m.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, m.vec_id = component_id AS kept
FROM m LEFT JOIN n ON n.u = m.vec_id
"""
