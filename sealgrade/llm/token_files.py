"""Token-id files: one long array of ids, document boundaries in Elias-Fano code.

Documents are dealt to shards by ranges of their id and sorted, so shard after shard the ids are in
order. A shard is a run of blocks; a block holds the ids of whole documents as little-endian
unsigned 32-bit integers, their ends and the ascending document ids as Elias-Fano sequences, and the place
of its first id. The ends take about ``2 + log2(ids / documents)`` bits a document; a directory of every 64th
one bit finds the i-th end or document id (select) without a table of 64-bit numbers: that is how files are
read. Shards' first ids are sums over the shards before.
"""

from __future__ import annotations

import math
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sealgrade.llm.common import Scratch, give_back, small_batches, table, trimmed
from sealgrade.session import scratch_dir

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END = 0
#: Ids after which a block is closed; a longer document is a block of its own.
BLOCK_IDS = 1 << 16
#: Bytes of blocks that are written, or handed to Python, at once: a row group of a file, an Arrow batch of a reading task.
GROUP_BYTES, BATCH_BYTES = 8 << 20, 4 << 20
#: Text bytes of a shard, unless their number is given.
SHARD_BYTES = 32_000_000
#: Chunks a worker remembers; the first that fit stay.
MEMORY = 1_300_000
#: New chunks that the library is given in one line.
LINE = 1_000
SAMPLE = 64

# ---- Elias-Fano ---------------------------------------------------------------------------


class EliasFano:
    """An ascending sequence of numbers below or at ``top`` in near-minimal space."""

    def __init__(self, n: int, width: int, low: bytes, high: bytes, directory: bytes):
        self.n, self.width, self.low, self.high = n, width, low, high
        self.directory = np.frombuffer(directory, "<u4")

    @classmethod
    def encode(cls, values: np.ndarray, top: int) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        width = max(0, int(top // max(1, n)).bit_length() - 1)
        high = np.zeros(n + (top >> width) + 1, np.uint8)
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        high[ones] = 1
        bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        return cls(n, width, np.packbits(bits.astype(np.uint8), bitorder="little").tobytes(),
                   np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes())

    def __getitem__(self, i: int) -> int:
        """The ``i``-th number: a select on the high bits from the nearest entry of the directory."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.directory[i // SAMPLE]), i % SAMPLE
        byte, word = at // 8, self.high[at // 8] >> (at % 8) << (at % 8)
        while (count := word.bit_count()) <= left:
            left -= count
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        upper = byte * 8 + (word & -word).bit_length() - 1 - i
        first = i * self.width
        chunk = int.from_bytes(self.low[first // 8 : (first + self.width + 7) // 8], "little")
        return upper << self.width | chunk >> first % 8 & ((1 << self.width) - 1)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        upper = (ones - np.arange(self.n)).astype(np.int64) << self.width
        if not self.width:
            return upper
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.width]
        return upper | bits.reshape(self.n, self.width).astype(np.int64) @ (1 << np.arange(self.width, dtype=np.int64))


# ---- encoding -----------------------------------------------------------------------------

#: A space between two characters that are no white space: no token crosses the place before it.
APART = re.compile(r"(?<=\S)(?= \S)")
DOUBLE = re.compile(r"\s\s")


class ChunkEncoder:
    """Ids of whole texts by the tokenizers library, which sees each repeated chunk once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        vocabulary = self.model.get_vocab(with_added_tokens=True)
        #: By id: whether the token starts with a space (the byte-level alphabet writes it as this letter).
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True
        self.seen: dict[str, bytes] = {}

    @staticmethod
    def chunks(texts: list[str]) -> tuple[list[str], pa.Array, np.ndarray, np.ndarray]:
        """What comes before each text's first safe cut, and all chunks after it without their leading space.

        Text ``i`` has the chunks from the ``i``-th of the first numbers up to the ``i``-th of the second.
        """
        heads, tails, odd = [], [], {}
        for i, text in enumerate(texts):
            if DOUBLE.search(text) or text[:1].isspace() or text[-1:].isspace():
                head, *rest = APART.split(text)
                odd[i], tail = [c[1:] for c in rest], None
            else:
                head, space, tail = text.partition(" ")
                tail = tail if space else None
            heads.append(head)
            tails.append(tail)
        cut = pc.split_pattern(pa.array(tails, pa.large_string()), " ")
        n = cut.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        n[list(odd)] = 0
        until = np.cumsum(n)
        at, until[list(odd)] = until - n, 0
        all_chunks = cut.flatten()
        if odd:
            sizes = np.array([len(x) for x in odd.values()], np.int64)
            until[list(odd)] = len(all_chunks) + np.cumsum(sizes)
            at[list(odd)] = until[list(odd)] - sizes
            all_chunks = pa.concat_arrays([all_chunks, pa.array(list(chain.from_iterable(odd.values())), pa.large_string())])
        return heads, all_chunks, at, until

    def _batch(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _parts(self, line: list[str], ids: np.ndarray) -> list[bytes]:
        """The ids of each chunk of a line: a chunk has one space, which opens its first token."""
        at = np.flatnonzero(self.opens[ids])
        if len(at) != len(line) or at[0]:
            return [x.tobytes() for x in self._batch([" " + c for c in line])]
        raw, at = ids.tobytes(), (at * 4).tolist()
        return [raw[i:j] for i, j in zip(at, [*at[1:], len(raw)], strict=True)]

    def _new(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks, each with the space before it."""
        odd = [c for c in chunks if " " in c]
        plain = [c for c in chunks if " " not in c] if odd else chunks
        lines = [plain[i : i + LINE] for i in range(0, len(plain), LINE)]
        every = self._batch([" " + " ".join(x) for x in lines] + [" " + c for c in odd])
        out = dict(zip(odd, map(np.ndarray.tobytes, every[len(lines):]), strict=True))
        for line, ids in zip(lines, every, strict=False):
            out.update(zip(line, self._parts(line, ids), strict=True))
        if len(self.seen) + len(out) <= MEMORY:
            self.seen.update(out)
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        heads, chunks, at, until = self.chunks([t or "" for t in texts])
        first = list(dict.fromkeys(heads))
        first = dict(zip(first, map(np.ndarray.tobytes, self._batch(first)), strict=True))
        # Arrow numbers the batch's chunks, so each distinct one is looked up once, and copies their ids
        numbered = chunks.dictionary_encode()
        distinct = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        own = list(map(self.seen.get, distinct))
        new = self._new([c for c, ids in zip(distinct, own, strict=True) if ids is None])
        own = pa.array([new[c] if ids is None else ids for c, ids in zip(distinct, own, strict=True)], pa.large_binary())
        ids = own.take(numbered.indices)
        if not len(ids):
            return [first[head] for head in heads]
        _, ends, data = ids.buffers()
        ends, data = np.frombuffer(ends, np.int64), memoryview(data)
        return [first[head] + data[i:j] for head, i, j in zip(heads, ends[at].tolist(), ends[until].tolist(), strict=True)]


@lru_cache(2)
def _encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


# ---- files --------------------------------------------------------------------------------

#: Null document ids come first in a block; the others are stored less the smallest of them.
FORMAT = ("shard int, block int, start_in_shard long, n_ids long, n_docs long, ids binary, "
          "width int, low binary, high binary, directory binary, n_nulls long, least long, "
          "doc_width int, doc_low binary, doc_high binary, doc_directory binary")


def _write(path: str, end: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = _encoder(path), TaskContext.get().partitionId()
        names = [f.split()[0] for f in FORMAT.split(", ")]
        doc_ids: list[int | None] = []
        parts: list[bytes] = []
        block, start, held = 0, 0, 0

        def close() -> pa.RecordBatch:
            ends = np.cumsum([len(p) // 4 for p in parts])
            ef = EliasFano.encode(ends, int(ends[-1]))
            known = [i for i in doc_ids if i is not None]
            least = known[0] if known else 0
            # differences of 64-bit numbers may need all 64 bits
            docs = EliasFano.encode(np.array([i - least for i in known], np.uint64), known[-1] - least if known else 0)
            row = [shard, block, start, int(ends[-1]), len(doc_ids), b"".join(parts), ef.width, ef.low, ef.high, ef.directory.tobytes(),
                   len(doc_ids) - len(known), least, docs.width, docs.low, docs.high, docs.directory.tobytes()]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), *[pa.binary()] * 3,
                     pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 3]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=names)

        mark = np.asarray([end], "<u4").tobytes()
        for b in batches:
            ids = encoder.encode(b.column("text").to_pylist())
            for doc_id, own in zip(b.column("doc_id").to_pylist(), ids, strict=True):
                doc_ids.append(doc_id)
                parts.append(own + mark)
                held += len(own) // 4 + 1
                if held >= block_ids:
                    yield close()
                    block, start, held = block + 1, start + held, 0
                    doc_ids, parts = [], []
        if parts:
            yield close()

    return run


def write_token_files(
    documents: DataFrame, path: str, vocabulary: str = VOCABULARY, end: int = END, block_ids: int = BLOCK_IDS,
    shards: int | None = None,
) -> None:
    """Write the ids of ``documents(doc_id, text)`` to ``path`` in ascending order of ``doc_id``.

    Every text, a null one as an empty text, is closed by the id ``end``. A null ``doc_id`` comes first;
    rows that share an id are all written, ordered by text. Other columns are not read. An empty
    table writes files without blocks.
    """
    spark = documents.sparkSession
    small_batches(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = shards or math.ceil((rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / SHARD_BYTES) or 1
    (
        rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
        .mapInArrow(trimmed(_write(vocabulary, end, block_ids)), FORMAT)
        # rows are long: the size of a group is looked at every 8 of them, not after 100
        .write.options(**{"parquet.block.size": GROUP_BYTES, "parquet.page.size.row.check.min": 8}).parquet(path)
    )


class Block:
    """A block as it lies in a file: any document's id, place and ids without reading the others."""

    def __init__(self, row: dict):
        self.n, self.nulls, self.least, self._ids = row["n_docs"], row["n_nulls"], row["least"], row["ids"]
        self.ends = EliasFano(self.n, row["width"], row["low"], row["high"], row["directory"])
        self.docs = EliasFano(self.n - self.nulls, row["doc_width"], row["doc_low"], row["doc_high"], row["doc_directory"])

    def end(self, i: int) -> int:
        return self.ends[i]

    def start(self, i: int) -> int:
        return self.ends[i - 1] if i else 0

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.least + self.docs[i - self.nulls]

    def ids(self, i: int) -> bytes:
        """The document's ids as little-endian unsigned 32-bit integers."""
        return self._ids[4 * self.start(i) : 4 * self.end(i)]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # the worker may have written files before; what it remembers of chunks is of no use here
    if _encoder.cache_info().currsize:
        _encoder.cache_clear()
        give_back()
    for b in batches:
        for at in range(b.num_rows):
            row = b.slice(at, 1).to_pylist()[0]
            block = Block(row)
            ends = np.array([block.end(i) for i in range(block.n)], np.int64)
            starts = np.r_[0, ends[:-1]]
            own = [block.ids(i) for i in range(block.n)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([block.doc_id(i) for i in range(block.n)], pa.int64()), pa.array(starts + row["first_id"], pa.int64()),
                 pa.array(ends - starts, pa.int64()), pa.array(own, pa.binary())],
                names=["doc_id", "start", "n_tokens", "ids"],
            )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (bytes) of each document in files under ``path``."""
    small_batches(spark, 200)
    # 200 blocks are 50 MB, held several times over by a task and its worker
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    files = spark.read.schema(FORMAT).parquet(path)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # one row a shard
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    blocks = files.join(F.broadcast(shards.select("shard", "before")), "shard")
    return blocks.select(
        (F.col("before") + F.col("start_in_shard")).alias("first_id"), "n_docs", "ids", "width", "low", "high", "directory",
        "n_nulls", "least", "doc_width", "doc_low", "doc_high", "doc_directory",
    ).mapInArrow(trimmed(_read), "doc_id long, start long, n_tokens long, ids binary")


def op9_token_files(spark, sf_dir):
    path = scratch_dir(spark)
    write_token_files(table(spark, sf_dir, "documents"), path)
    Scratch(spark).release()
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

