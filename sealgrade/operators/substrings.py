"""Which of many needles a text contains, by an index of the needles' rarest runs.

A text that contains a needle contains each of its runs of four bytes. A needle is entered under the eight bytes
that hold its rarest run, which is that of fewest needles, or of fewest texts where these were counted (``text_counts``).
Looking a text up costs one pass over its
bytes: the eight at all places are tested against bit tables of the entered ones, and the few places that pass are
compared with the needle byte for byte, eight at a time. Needles of up to seven bytes are entered whole.

The index goes to the texts, so searching shuffles no text, and nothing is made of a run that no needle is entered
under. Needles are taken in rounds of bounded size, each an index of its own: that is what is
collected and broadcast, however many needles there are. Rounds follow each other, and the next begins when the finds of the one before
are written; only then are rows joined with all their finds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, LongType, StructField, StructType

from sealgrade.session import stage

#: Bytes of needles, with what comes with them, of one round.
ROUND_BYTES = 8 << 20
#: Needles that come alone are taken in parts of so many rounds.
WORD_ROUNDS = 4
#: Bytes of text that are searched at once.
BUFFER_BYTES = 4 << 20
#: Rows that are searched, and given back with what they hold, at once.
ROWS = 500
_RUN, _WINDOW = 4, 8


def runs_at(buffer: np.ndarray) -> np.ndarray:
    """For each byte the number that it and the three after it make; beyond the end there are zeros."""
    padded = np.zeros(len(buffer) + _RUN - 1, np.uint8)
    padded[: len(buffer)] = buffer
    out = padded[: len(buffer)].astype(np.uint32)
    for i in range(1, _RUN):
        out |= padded[i : i + len(buffer)].astype(np.uint32) << np.uint32(8 * i)
    return out


def windows_at(runs: np.ndarray) -> np.ndarray:
    """The same with eight bytes, from the runs of four."""
    out = runs.astype(np.uint64)
    out[:-_RUN] |= runs[_RUN:].astype(np.uint64) << np.uint64(8 * _RUN)
    return out


def _low(width: int) -> np.uint64:
    """A mask of the first ``width`` bytes of a window."""
    return np.uint64((1 << 8 * width) - 1)


class RunSet:
    """Numbers, sorted and different, and a bit table that few others pass."""

    def __init__(self, runs: np.ndarray):
        self.runs = runs
        self.shift = np.uint64(64 - min(24, max(10, int(16 * len(runs)).bit_length())))
        self.bits = np.zeros(1 << (64 - int(self.shift)), bool)
        self.bits[self._slot(runs)] = True

    def _slot(self, runs: np.ndarray) -> np.ndarray:
        return (runs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def find(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of ``runs`` that are in the set, and which they are."""
        if not len(self.runs):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        place = np.flatnonzero(self.bits[self._slot(runs)])
        at = np.minimum(np.searchsorted(self.runs, runs[place]), len(self.runs) - 1)
        same = self.runs[at] == runs[place]
        return place[same], at[same]


def expand(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the stretches its number, and the places in it."""
    of = np.repeat(np.arange(len(start)), size)
    return of, np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)


class NeedleIndex:
    """Needles under their rarest runs. ``counts`` maps a run to how many texts hold it, others counting as rare; without it
    the rarest run is that of fewest places in the needles."""

    def __init__(self, needles: Sequence[bytes], counts: dict[int, int] | None = None):
        self.size = np.array([len(n) for n in needles], np.int64)
        self.start = np.cumsum(self.size) - self.size
        runs = runs_at(np.frombuffer(b"".join(needles), np.uint8))
        #: The needles one after another; the eight bytes at all a needle's places can be read here.
        self.windows = windows_at(runs)
        self.empty = np.flatnonzero(self.size == 0)
        #: How far into its needle the run lies under which it is entered.
        self.offset = np.zeros(len(needles), np.int64)
        long = np.flatnonzero(self.size >= _RUN)
        of, at = expand(self.start[long], self.size[long] - _RUN + 1)
        if counts is None:
            _, run, times = np.unique(runs[at], return_inverse=True, return_counts=True)
            held = times[run]
        else:
            held = np.array([counts.get(r, 0) for r in runs[at].tolist()], np.int64)
        order = np.lexsort((at, held, of))
        first = order[np.r_[True, np.diff(of[order]) > 0]] if len(order) else order
        self.offset[long] = at[first] - self.start[long]
        #: How far into its needle the window lies under which it is entered: that of the run, or the whole of a short needle.
        self.window = np.minimum(self.offset, np.maximum(0, self.size - _WINDOW))
        self.entered = [(w, *self._enter(np.flatnonzero(self.size == w), w)) for w in range(1, _WINDOW)]
        self.entered.append((_WINDOW, *self._enter(np.flatnonzero(self.size >= _WINDOW), _WINDOW)))

    def _enter(self, needles: np.ndarray, width: int) -> tuple[RunSet, np.ndarray, np.ndarray]:
        """The windows of ``needles``, where the needles of each begin, and the needles in that order."""
        keys = self.windows[self.start[needles] + self.window[needles]] & _low(width)
        order = np.argsort(keys, kind="stable")
        keys, first = np.unique(keys[order], return_index=True)
        return RunSet(keys), np.r_[first, len(needles)], needles[order]

    def find(self, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Different (text, needle) pairs, in order, of texts that lie one after another in ``buffer``."""
        n = max(1, len(self.size))
        every = np.arange(len(starts))
        pairs = [(every[:, None] * n + self.empty[None, :]).ravel()]
        windows = windows_at(runs_at(buffer))
        for width, keys, first, needles in self.entered:
            if not len(needles):
                continue
            place, key = keys.find(windows & _low(width))
            of, at = expand(first[key], first[key + 1] - first[key])
            needle = needles[at]
            begin = place[of] - self.window[needle]
            text = np.searchsorted(starts, place[of], side="right") - 1
            inside = (begin >= starts[text]) & (begin + self.size[needle] <= ends[text])
            begin, needle, text = begin[inside], needle[inside], text[inside]
            if width == _WINDOW:
                kept = self._equal(windows, begin, needle)
                needle, text = needle[kept], text[kept]
            pairs.append(text * n + needle)
        return np.divmod(np.unique(np.concatenate(pairs)), n)

    def _equal(self, windows: np.ndarray, begin: np.ndarray, needle: np.ndarray) -> np.ndarray:
        """Which of the places hold their needles, of eight bytes at least, whole."""
        left = np.arange(len(begin))
        for at in range(0, int(self.size[needle].max(initial=0)), _WINDOW):
            more = self.size[needle[left]] > at
            if not more.any():
                break
            some = left[more]
            # the last window of a needle ends where the needle does
            step = np.minimum(at, self.size[needle[some]] - _WINDOW)
            good = windows[begin[some] + step] == self.windows[self.start[needle[some]] + step]
            left = np.r_[left[~more], some[good]]
        return np.sort(left)


def text_parts(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows ``first`` to ``last`` of a string column at a time: their bytes, and where each text lies in these."""
    large = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BUFFER_BYTES, side="right")) - 1)
        yield first, last, flat[offsets[first] : offsets[last]], offsets[first:last] - offsets[first], offsets[first + 1 : last + 1] - offsets[first]
        first = last


def text_counts(texts: DataFrame, text: str, needles: Sequence[bytes]) -> dict[int, int]:
    """For each run of the needles that some text holds: how many texts do."""
    flat = np.frombuffer(b"".join(needles), np.uint8)
    size = np.array([len(n) for n in needles], np.int64)
    _, at = expand((np.cumsum(size) - size)[size >= _RUN], size[size >= _RUN] - _RUN + 1)
    wanted = np.unique(runs_at(flat)[at])
    if not len(wanted):
        return {}
    shared = texts.sparkSession.sparkContext.broadcast(wanted)  # ROUND_BYTES of needles at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = RunSet(shared.value)
        n = len(wanted.runs)
        total = np.zeros(n, np.int64)
        for b in batches:
            for _, _, buffer, starts, _ in text_parts(b.column(0)):
                place, at = wanted.find(runs_at(buffer))
                holder = np.searchsorted(starts, place, side="right") - 1
                total += np.bincount(np.unique(holder * n + at) % n, minlength=n)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(wanted.runs[some].astype(np.int64)), pa.array(total[some])], names=["run", "n"])

    rows = texts.select(F.col(text).cast("string").alias("text")).where("text != ''")
    counted = rows.mapInArrow(run, "run long, n long").groupBy("run").agg(F.sum("n").alias("n"))
    out = {int(r["run"]): int(r["n"]) for r in counted.collect()}  # a row a run of the needles
    shared.destroy()
    return out


def in_rounds(
    docs: DataFrame, inputs: Sequence[Column], rules: DataFrame, size: Column, index: Callable[[pa.Table], Any],
    find: Callable[..., pa.Array], kind: DataType, out: str, merge: Callable[[Column], Column],
    round_bytes: int = ROUND_BYTES, own: tuple[str, str] | None = None,
) -> DataFrame:
    """Add ``out``: what ``find`` gives by the ``index`` of ``rules``, ``size`` being a rule's bytes.

    Rules of up to ``round_bytes`` are looked up where ``docs`` are read. More are taken in parts, one after the other, over a
    written copy of ``docs``: a part's finds are written by row, ``merge`` makes one of a row's finds, and they join the copy at the end. So
    one index, in one Python process a task, is held at a time. ``find`` sees the index and the ``inputs`` of few rows at once; a null or
    empty find need not be written. With ``own`` parts only look at documents whose first column of it some rule has in the second.
    """
    rules = stage(rules)
    n = parts_of(rules, size, round_bytes)
    if n == 1:
        return where_read(docs, inputs, index(rules.toArrow()), find, kind, out)  # about ROUND_BYTES of rules
    row = _free(docs, "_row")
    kept = stage(docs.withColumn(row, F.monotonically_increasing_id()))
    texts = with_some(kept, F.col(own[0]), rules, own[1]) if own else kept
    parts = (rules.where(F.pmod(F.xxhash64(F.to_json(F.struct("*"))), F.lit(n)) == part) for part in range(n))
    found = [finds(texts, row, inputs, index(some.toArrow()), find, kind) for some in parts]
    every = reduce(DataFrame.unionByName, found).groupBy(row).agg(merge(F.col("found")).alias(out))
    return kept.join(every, row, "left").drop(row)


def with_some(docs: DataFrame, value: Column, rules: DataFrame, name: str) -> DataFrame:
    """The documents whose ``value`` some rule has in the column ``name``; a null is equal to nothing.

    A value is a class, so there are few: they go to the documents, which would otherwise meet in one task a class."""
    known = rules.select(F.col(name).alias("_some")).distinct()
    return docs.join(F.broadcast(known), value == F.col("_some"), "left_semi")


def parts_of(rules: DataFrame, size: Column, round_bytes: int) -> int:
    """In how many parts rules of ``size`` bytes each are taken."""
    return max(1, math.ceil((rules.agg(F.sum(size)).first()[0] or 0) / round_bytes))


def where_read(
    docs: DataFrame, inputs: Sequence[Column], index: Any, find: Callable[..., pa.Array], kind: DataType, out: str,
) -> DataFrame:
    """Add ``out``: what ``find`` gives by ``index``, in one pass over ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    into, own = _free(docs, out), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = find(shared.value, *b.columns[own:])
            yield pa.RecordBatch.from_arrays([*b.columns[:own], got], names=[*b.schema.names[:own], into])

    read = docs.select("*", *_inputs(docs, inputs))
    return read.mapInArrow(run, StructType([*docs.schema.fields, StructField(into, kind)])).withColumnRenamed(into, out)


def finds(
    texts: DataFrame, row: str, inputs: Sequence[Column], index: Any, find: Callable[..., pa.Array], kind: DataType,
) -> DataFrame:
    """``row, found`` of the rows for which ``find`` gives something by ``index``, written."""
    shared = texts.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = find(shared.value, *b.columns[1:])
            some = pc.greater(pc.list_value_length(got), 0) if pa.types.is_list(got.type) else pc.is_valid(got)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(some), got.filter(some)], names=[row, "found"])

    read = texts.select(row, *_inputs(texts, inputs))
    out = stage(read.mapInArrow(run, StructType([StructField(row, LongType()), StructField("found", kind)])))
    shared.destroy()
    return out


def _inputs(docs: DataFrame, inputs: Sequence[Column]) -> list[Column]:
    return [c.alias(_free(docs, f"_input_{i}")) for i, c in enumerate(inputs)]


def _free(docs: DataFrame, name: str) -> str:
    """``name`` as none of the columns is called."""
    while name in docs.columns:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches' rows, few at a time, so that what is found in them stays small."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def _payload(rows: pa.Table) -> pa.StructArray:
    return pa.StructArray.from_arrays([c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in rows.columns], rows.column_names)


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.r_[0, np.cumsum(sizes)].astype(np.int32), values)


def _needle_bytes(needle: str) -> Column:
    return F.coalesce(F.octet_length(needle), F.lit(0)) + 32


def _index(needles: pa.ChunkedArray) -> NeedleIndex:
    return NeedleIndex([n.encode("utf-8") for n in needles.to_pylist()])


def with_found(
    docs: DataFrame, text: str | Column, needles: DataFrame, needle: str = "needle", out: str = "found", round_bytes: int = ROUND_BYTES,
) -> DataFrame:
    """Add ``out``: the rows of ``needles`` whose ``needle`` stands in ``text``, as an array of structs.

    Comparison is of bytes, so letters' cases count. An empty needle stands in every text that is not null, a null
    one in none; a null text contains nothing. Rows that repeat a needle are all found. The array's order is
    not defined. Needles of more than ``round_bytes`` are taken in parts (``in_rounds``).
    """
    kind = ArrayType(StructType([StructField(f.name, f.dataType) for f in needles.schema.fields]))

    def find(shared: tuple[NeedleIndex, pa.Table], texts: pa.Array) -> pa.Array:
        sizes, which = found_in(shared[0], texts)
        return _lists(sizes, _payload(shared[1]).take(pa.array(which)))

    added = in_rounds(
        docs.drop(out), [_column(text)], needles.where(F.col(needle).isNotNull()), _needle_bytes(needle),
        lambda rows: (_index(rows.column(needle)), rows.combine_chunks()),
        find, kind, out, lambda found: F.flatten(F.collect_list(found)), round_bytes)
    return added.withColumn(out, F.coalesce(out, F.array().cast(kind)))


def _column(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name


class Groups:
    """Which of the different rows of some columns each row of ``rows`` has."""

    def __init__(self, rows: pa.Table, columns: Sequence[str]):
        numbers: dict[tuple, int] = {}
        keys = zip(*[rows.column(c).to_pylist() for c in columns], strict=True)
        self.of = np.array([numbers.setdefault(k, len(numbers)) for k in keys], np.int64)
        _, first = np.unique(self.of, return_index=True)
        self.rows = rows.select(columns).take(pa.array(first)).combine_chunks()


def with_counts(
    docs: DataFrame, text: str | Column, needles: DataFrame, groups: Sequence[str], own: tuple[str, str],
    needle: str = "needle", out: str = "found", round_bytes: int = ROUND_BYTES,
) -> DataFrame:
    """Add ``out``: how many rows of ``needles`` stand in ``text`` by their ``groups``, as an array of structs with ``hits``.

    Only needles count that have in their second ``own`` column what the document has in the first; a null is equal to
    nothing. A document that has what no needle has is not searched. With needles in parts a group may come once a part: its
    hits are to be added up; only a needle and its group come along, so parts may be ``WORD_ROUNDS`` times as large.
    """
    kind = ArrayType(StructType([*[StructField(c, needles.schema[c].dataType) for c in groups], StructField("hits", LongType())]))

    def index(rows: pa.Table) -> tuple:
        values = pc.unique(rows.column(own[1]))
        of = pc.index_in(rows.column(own[1]), value_set=values).to_numpy()
        return _index(rows.column(needle)), Groups(rows, groups), values, of

    def find(shared: tuple, texts: pa.Array, kinds: pa.Array) -> pa.Array:
        index, grouped, values, of = shared
        wanted, chosen = chosen_rows(kinds, values)
        sizes, which = found_in(index, texts.take(pa.array(chosen)))
        row, n = np.repeat(chosen, sizes), max(1, grouped.rows.num_rows)
        same = of[which] == wanted[row]
        key, hits = np.unique(row[same] * n + grouped.of[which[same]], return_counts=True)
        row, group = np.divmod(key, n)
        payload = _payload(grouped.rows.take(pa.array(group)).combine_chunks())
        columns = [payload.field(i) for i in range(len(groups))]
        return _lists(np.bincount(row, minlength=len(texts)), pa.StructArray.from_arrays([*columns, pa.array(hits, pa.int64())], [*groups, "hits"]))

    some = needles.where(F.col(needle).isNotNull() & F.col(own[1]).isNotNull())
    added = in_rounds(
        docs.drop(out), [_column(text), F.col(own[0])], some, _needle_bytes(needle), index, find, kind, out,
        lambda found: F.flatten(F.collect_list(found)), WORD_ROUNDS * round_bytes, own)
    return added.withColumn(out, F.coalesce(out, F.array().cast(kind)))


def chosen_rows(kinds: pa.Array, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``values`` each row has, -1 for none, and the rows that have one."""
    wanted = pc.fill_null(pc.index_in(kinds, value_set=values), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    return wanted, np.flatnonzero(wanted >= 0)


def found_in(index: NeedleIndex, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each text how many needles it holds, and these, text after text; a null text holds none."""
    sizes, which = np.zeros(len(texts), np.int64), []
    if not len(texts):
        return sizes, np.empty(0, np.int64)
    nulls = pc.is_null(texts).to_numpy(zero_copy_only=False)
    for first, _, buffer, starts, ends in text_parts(texts):
        row, needle = index.find(buffer, starts, ends)
        kept = ~nulls[first + row]
        sizes += np.bincount(first + row[kept], minlength=len(texts))
        which.append(needle[kept])
    return sizes, np.concatenate(which) if which else np.empty(0, np.int64)
