"""Helpers that several of these operators use: staging, word hashing, blocks, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sealgrade.session import scratch_dir

#: Words a worker remembers the hashes of; beyond it the memory is cleared, not the result changed.
WORD_MEMORY = 500_000
#: Rows an Arrow batch holds at most, so that long texts do not fill a worker.
BATCH_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound what a Python worker holds at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def trimmed(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``fn`` for ``mapInArrow``, after which the worker gives memory it no longer uses back to the machine.

    Workers live on from stage to stage; what one stage had would else count for the next ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    return run


def give_back() -> None:
    """Memory that this process no longer uses goes back to the machine."""
    pa.default_memory_pool().release_unused()
    # only the GNU library has it
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


class Scratch:
    """Written intermediate tables in the shared folder, dropped when they are of no more use."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` written and read back: cuts lineage in a way that outlives lost executors."""
        path = scratch_dir(self.spark)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        self.release()
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for df in frames:
            _, path = self.paths.pop(id(df))
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def release(self) -> None:
        """Let Spark's cleaner remove the shuffle files of steps that have ended."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


# ---- words -----------------------------------------------------------------------------

#: By byte: ASCII white space. By number of bytes: the bits of a little-endian number that they fill.
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Bytes of a word up to which it is hashed eight bytes at a time along with the others.
LONG = 256


class Words:
    """128-bit hashes of words, remembered within bounds: ``ids`` index ``lo`` and ``hi``."""

    def __init__(self, limit: int = WORD_MEMORY):
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        self.seen: dict[bytes, int] = {}
        self.lo = np.empty(1 << 14, np.uint64)
        self.hi = np.empty(1 << 14, np.uint64)

    def hashes(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.seen) > self.limit:
            self._clear()
        seen = self.seen
        try:
            ids = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
        except KeyError:
            new = list(set(words).difference(seen))
            raw = b"".join([hashlib.blake2b(w, digest_size=16).digest() for w in new])
            lo, hi = np.frombuffer(raw, "<u8").reshape(-1, 2).T
            n = len(seen)
            while n + len(new) > len(self.lo):
                self.lo, self.hi = np.resize(self.lo, 2 * len(self.lo)), np.resize(self.hi, 2 * len(self.hi))
            self.lo[n : n + len(new)], self.hi[n : n + len(new)] = lo, hi
            seen.update(zip(new, range(n, n + len(new)), strict=True))
            ids = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
        return self.lo[ids], self.hi[ids]


@dataclass
class Run:
    """Consecutive texts as one run of bytes, and where words and texts begin and end in it."""

    first: int
    data: np.ndarray
    #: Where each text begins, and where the last ends.
    cuts: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    #: The number of each text's first word, and that of all words.
    at: np.ndarray
    #: Whether a text is its words joined by one space.
    joined: np.ndarray

    def words(self, i: int) -> list[bytes]:
        return self.data[self.cuts[i] : self.cuts[i + 1]].tobytes().split()

    def text(self, i: int) -> bytes:
        """The words of the ``i``-th text, joined by one space."""
        return self.data[self.cuts[i] : self.cuts[i + 1]].tobytes() if self.joined[i] else b" ".join(self.words(i))

    def hashes(self, high: bool) -> np.ndarray:
        """64-bit hashes of all words; the ``high`` ones are of another function."""
        size = self.ends - self.starts
        eights = np.ndarray(len(self.data) + 1, "<u8", np.r_[self.data, np.zeros(8, np.uint8)].tobytes(), strides=(1,))
        factor, seed = (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)) if high else (np.uint64(1), np.uint64(0x27D4EB2F165667C5))
        out = mix((eights[self.starts] & MASKS[np.minimum(size, 8)]) * factor + size.astype(np.uint64) * seed)
        more, k = np.flatnonzero((size > 8) & (size <= LONG)), 8
        while len(more):
            out[more] = mix(out[more] + (eights[self.starts[more] + k] & MASKS[np.minimum(size[more] - k, 8)]) * factor)
            k += 8
            more = more[size[more] > k]
        for i in np.flatnonzero(size > LONG):
            raw = hashlib.blake2b(self.data[self.starts[i] : self.ends[i]].tobytes(), digest_size=16).digest()
            out[i] = int.from_bytes(raw[8 * high :][:8], "little")
        return out


def word_runs(texts: pa.Array, most: int = 1 << 20) -> Iterator[Run]:
    """Runs of as many consecutive texts as have ``most`` bytes; a longer text is a run of its own.

    Words are what ASCII white space separates, unchanged; null and blank texts have none.
    """
    texts = texts.fill_null("").cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset :][: len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data or b"", np.uint8)
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        cuts = offsets[first : end + 1] - offsets[first]
        own = data[offsets[first] : offsets[end]]
        gap = SPACES[own]
        # the first and the last byte of a text have nothing beside them
        before, after = np.ones(len(own), bool), np.ones(len(own), bool)
        before[1:], after[:-1] = gap[:-1], gap[1:]
        before[cuts[cuts < len(own)]] = True
        after[cuts[cuts > 0] - 1] = True
        starts = np.flatnonzero(~gap & before)
        odd = np.searchsorted(np.flatnonzero(gap & (before | after | (own != 32))), cuts)
        yield Run(first, own, cuts, starts, np.flatnonzero(~gap & after) + 1, np.searchsorted(starts, cuts), odd[1:] == odd[:-1])
        first = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def grams(h: np.ndarray, k: int, at: np.ndarray | None = None) -> np.ndarray:
    """A hash of each ``k`` consecutive word hashes, in order, or of those that start ``at`` given places."""
    n = len(h) - k + 1 if at is None else len(at)
    if n <= 0:
        return np.empty(0, np.uint64)
    mult = mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += (h[j : j + n] if at is None else h[at + j]) * mult[j]
    return mix(out)


def shingle_set(text: str | None, words: Words, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's ``k``-word shingles; a shorter text is one shingle.

    Words are what white space separates, unchanged. Null and blank texts have none.
    """
    if not text:
        return np.empty(0, np.uint64)
    w = text.encode("utf-8", "surrogatepass").split()
    if not w:
        return np.empty(0, np.uint64)
    h, _ = words.hashes(w)
    return np.unique(grams(h, min(k, len(w))))


# ---- sorted groups ----------------------------------------------------------------------


def by_sorted_groups(
    df: DataFrame,
    keys: list[str],
    fn: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    """Apply ``fn`` to runs of whole groups.

    Rows are dealt and sorted by ``keys`` (long columns). ``fn`` gets a table of complete
    groups and the first row of each. Callers bound the size of a group (see ``blocks``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            cuts = _starts(t, keys)
            if len(cuts) > 1:
                yield from fn(t.slice(0, cuts[-1]).combine_chunks(), cuts[:-1])
            rest = t.slice(cuts[-1])
        if rest is not None and rest.num_rows:
            yield from fn(rest.combine_chunks(), np.zeros(1, np.int64))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(trimmed(run), schema)


def _starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for k in keys:
        v = t.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def blocks(df: DataFrame, key: str, n_blocks: Column, item: str) -> DataFrame:
    """Deal the rows of each ``key`` to blocks and return a row for each pair of blocks.

    A row of block ``i`` appears in all pairs (a, b), a <= b, that hold ``i``; so any two rows
    of a key meet, and no task sees more than two blocks. Columns ``a``, ``b`` and ``blk``.
    """
    own = F.pmod(F.xxhash64(item, F.lit(7)), n_blocks.cast("long"))
    return (
        df.withColumn("nb", n_blocks.cast("long")).withColumn("blk", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
        .withColumn("a", F.least("blk", "other")).withColumn("b", F.greatest("blk", "other"))
        .drop("other", "nb")
    )


def local_components(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of ``n`` rows over the given links."""
    label = np.arange(n)
    while len(left):
        old = label.copy()
        m = np.minimum(label[left], label[right])
        np.minimum.at(label, left, m)
        np.minimum.at(label, right, m)
        label = label[label]
        if np.array_equal(old, label):
            break
    return label


# ---- components -------------------------------------------------------------------------


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node reachable over ``edges(u, v)``, for nodes with edges.

    Labels travel over the edges and are then looked up once more (their label's label), until
    none changes; each round is written. A hub's edges are plain rows of a join that adaptive
    execution may split; minima combine before the shuffle. Nothing reaches the driver but a sum.
    """
    e = scratch.keep(edges.where("u != v").select("u", "v").distinct())
    labels = scratch.keep(
        e.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("label", F.col("node"))
    )
    total = None
    while True:
        by_u, by_v = labels.toDF("u", "lu"), labels.toDF("v", "lv")
        sent = e.join(by_u, "u").select(F.col("v").alias("node"), F.col("lu").alias("label")).unionByName(
            e.join(by_v, "v").select(F.col("u").alias("node"), F.col("lv").alias("label"))
        ).unionByName(labels)
        pushed = scratch.keep(sent.groupBy("node").agg(F.min("label").alias("label")))
        up = pushed.toDF("label", "higher")
        jumped = scratch.keep(pushed.join(up, "label").select("node", F.col("higher").alias("label")))
        now = jumped.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        scratch.drop(labels, pushed)
        labels = jumped
        if now == total or now is None:
            break
        total = now
    scratch.drop(e)
    return labels.toDF("node", "component")
