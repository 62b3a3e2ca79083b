"""SentencePiece encoding and decoding for vocabularies of the merge type.

A text's symbols are its characters, white space written as a mark of its own. An agenda holds each
pair of neighbouring symbols whose join is a piece, best score first and leftmost among equals; the best pair
is joined and the joined symbol's pairs with its neighbours are entered, until the agenda is empty.
Entries whose symbols have been joined to others meanwhile are passed over when they come up.

No piece holds the mark after another character, so no join ever crosses the place before a run of
marks: texts are cut there, and a chunk that repeats is worked out once. The library encodes each new
chunk of an Arrow batch too, and decodes every text's ids; where it differs, the row says so.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from operator import add

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealgrade.llm.common import table

MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: Chunks (and as many parts of chunks) that a worker remembers, and the longest of them.
MEMORY, LONGEST = 600_000, 200
#: Rows that are worked on, and checked, at once.
ROWS = 500
MARK = "▁"
#: How an entry of the agenda is laid out in one number.
SIZE_BITS, PLACE_BITS = 12, 32
#: Symbols up to which an agenda is a list; no score's place is as high as NONE.
SHORT, NONE = 48, 1 << 62
SIZES, PLACES = (1 << SIZE_BITS) - 1, (1 << PLACE_BITS) - 1
#: The library's numbers for kinds of models and of pieces, and what it decodes unknown pieces to.
MERGE_MODEL = 2
NORMAL, UNKNOWN, CONTROL, UNUSED, BYTE = 1, 2, 3, 5, 6
UNKNOWN_SURFACE = " ⁇ "


class MergeVocabulary:
    """Encoder and decoder of one model file.

    The model must be of the merge type and take texts as they are (no normalisation, no pieces defined by
    a user, white space kept); another one is refused.
    """

    def __init__(self, path: str = MODEL):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as model_pb2

        with open(path, "rb") as f:
            raw = f.read()
        spec = model_pb2.ModelProto.FromString(raw)
        kinds = {p.type for p in spec.pieces}
        plain = spec.normalizer_spec
        if (spec.trainer_spec.model_type != MERGE_MODEL or not kinds <= {NORMAL, UNKNOWN, CONTROL, UNUSED, BYTE}
                or plain.precompiled_charsmap or plain.remove_extra_whitespaces or not plain.escape_whitespaces
                or spec.trainer_spec.treat_whitespace_as_suffix):
            raise ValueError(f"{path}: not a merge-type model over unchanged texts")
        self.library = SentencePieceProcessor(model_proto=raw)
        self.prefix = plain.add_dummy_prefix
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type in (NORMAL, UNUSED)}
        # pieces of the same score share a place: then the leftmost pair comes first
        scores = {s: i for i, s in enumerate(sorted({spec.pieces[i].score for i in self.ids.values()}, reverse=True))}
        self.rank = {p: scores[spec.pieces[i].score] << SIZE_BITS + PLACE_BITS for p, i in self.ids.items() if len(p) > 1}
        self.unused = {p for p, i in self.ids.items() if spec.pieces[i].type == UNUSED}
        self.unknown = next(i for i, p in enumerate(spec.pieces) if p.type == UNKNOWN)
        self.bytes = [0] * 256 if BYTE in kinds else None
        self.kind = [p.type for p in spec.pieces]
        self.surface: list[str | int] = []
        for i, p in enumerate(spec.pieces):
            value: str | int = p.piece.replace(MARK, " ")
            if p.type == BYTE:
                value = int(p.piece[3:-1], 16)
                self.bytes[value] = i
            elif p.type in (CONTROL, UNKNOWN):
                value = "" if p.type == CONTROL else UNKNOWN_SURFACE
            self.surface.append(value)
        #: Only the bytes' pieces have no text of their own.
        self.odd = {i for i, s in enumerate(self.surface) if isinstance(s, int)}
        if max(map(len, self.ids), default=1) > SIZES:
            raise ValueError(f"{path}: pieces of more than {SIZES} characters")
        self.apart = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        self.neighbours = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.parts: dict[str, list[int]] = {}
        self.seen: dict[str, tuple[int, ...]] = {}

    # ---- one chunk ----------------------------------------------------------------------

    def merge(self, chunk: str) -> list[str]:
        """The symbols left of ``chunk`` when its agenda is empty.

        A short chunk's agenda is a list with a place for each pair, of which the least is sought.
        """
        symbols = list(chunk)
        rank = self.rank.get
        agenda = [rank(p, NONE) for p in map(add, symbols, symbols[1:])]
        if len(symbols) > SHORT or self.unused:
            return self._merge_long(symbols, agenda)
        while agenda and (best := min(agenda)) < NONE:
            i = agenda.index(best)
            piece = symbols[i] = symbols[i] + symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = rank(piece + symbols[i + 1], NONE)
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + piece, NONE)
        return symbols

    def _merge_long(self, symbols: list[str | None], places: list[int]) -> list[str]:
        """The same with a heap.

        An entry is one number: the score's place, then the place of the pair, then its length. Symbols only
        grow, so a pair of that length at that place is still the one that was entered.
        """
        n, rank = len(symbols), self.rank.get
        agenda = [r | i << SIZE_BITS | 2 for i, r in enumerate(places) if r < NONE]
        heapq.heapify(agenda)
        after, before, made = list(range(1, n + 1)), list(range(-1, n - 1)), {}
        while agenda:
            entry = heapq.heappop(agenda)
            i = entry >> SIZE_BITS & PLACES
            left, j = symbols[i], after[i]
            if left is None or j >= n or len(left) + len(symbols[j]) != entry & SIZES:
                continue
            piece = left + symbols[j]
            if piece in self.unused:
                made[piece] = left, symbols[j]
            symbols[i], symbols[j] = piece, None
            nxt, prev = after[j], before[i]
            after[i] = nxt
            if nxt < n:
                before[nxt] = i
                joined = piece + symbols[nxt]
                if (r := rank(joined)) is not None:
                    heapq.heappush(agenda, r | i << SIZE_BITS | len(joined))
            if prev >= 0:
                joined = symbols[prev] + piece
                if (r := rank(joined)) is not None:
                    heapq.heappush(agenda, r | prev << SIZE_BITS | len(joined))
        left = [s for s in symbols if s is not None]
        return [p for s in left for p in self._split(s, made)] if made else left

    def _split(self, symbol: str, made: dict[str, tuple[str, str]]) -> list[str]:
        """A piece that may not be used, as the two it was joined from."""
        if symbol not in made:
            return [symbol]
        return [p for part in made[symbol] for p in self._split(part, made)]

    def _fragments(self, chunk: str) -> list[str]:
        """Parts of ``chunk`` between neighbours that are neighbours in no piece."""
        together = list(map(self.neighbours.__contains__, map(add, chunk, chunk[1:])))
        if False not in together:
            return [chunk]
        cuts = [0, *(i for i, t in enumerate(together, 1) if not t), len(chunk)]
        return [chunk[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        out: list[int] = []
        for part in self._fragments(chunk):
            got = self.parts.get(part)
            if got is None:
                symbols = self.merge(part)
                try:
                    got = list(map(self.ids.__getitem__, symbols))
                except KeyError:
                    got = [i for s in symbols for i in ((self.ids[s],) if s in self.ids else self._spelled(s))]
                if len(part) <= LONGEST and len(self.parts) < MEMORY:
                    self.parts[part] = got
            out += got
        return tuple(out)

    def _spelled(self, symbol: str) -> list[int]:
        return [self.bytes[b] for b in symbol.encode()] if self.bytes else [self.unknown]

    # ---- texts --------------------------------------------------------------------------

    def chunks(self, text: str) -> list[str]:
        """Parts of ``text`` that no join crosses; all but a first one without the mark start with marks."""
        if not text:
            return []
        marked = text.replace(" ", MARK)
        if self.prefix:
            marked = MARK + marked
        if not self.apart:
            return [marked]
        if self.prefix and MARK + MARK not in marked and marked[-1] != MARK:
            return [MARK + c for c in marked[1:].split(MARK)]
        return re.findall(f"{MARK}+[^{MARK}]*|^[^{MARK}]+", marked)

    def encode_batch(self, texts: list[str]) -> tuple[list[list[int]], list[bool]]:
        """Ids of each text, and whether the library gives the same for all its new chunks."""
        seen = self.seen
        cut = [self.chunks(t) for t in texts]
        new = list(set().union(*cut).difference(seen))
        found = dict(zip(new, map(self._chunk, new), strict=True))
        wrong = {c for c, ids in zip(new, self._by_library(new), strict=True) if ids != list(found[c])}
        seen.update(found)
        look = seen.__getitem__
        out = [list(chain.from_iterable(map(look, chunks))) for chunks in cut]
        same = [not wrong or wrong.isdisjoint(chunks) for chunks in cut]
        # the first chunks that fit stay; long ones do not, and a difference is found again
        full = len(seen) > MEMORY
        for c in new:
            if full or len(c) > LONGEST or c in wrong:
                del seen[c]
        return out, same

    def _by_library(self, chunks: list[str]) -> list[list[int]]:
        """The library's ids of chunks, which it puts a mark before again."""
        texts = [c[1:] if self.prefix and c[:1] == MARK else c for c in chunks]
        got = self.library.encode(texts, num_threads=1) if texts else []
        for at, text in enumerate(texts):
            if not text and chunks[at]:
                got[at] = list(self._chunk(chunks[at]))  # a lone mark cannot be asked for
        return got

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``: bytes become characters, those that form none the replacement character."""
        surface = self.surface
        if self.odd.isdisjoint(ids):
            text = "".join([surface[i] for i in ids])
        else:
            parts: list[str] = []
            run = bytearray()
            for i in ids:
                s = surface[i]
                if isinstance(s, int):
                    run.append(s)
                    continue
                if run:
                    parts.append(_characters(bytes(run)))
                    run.clear()
                parts.append(s)
            text = "".join(parts) + _characters(bytes(run))
        first = next((i for i in ids if self.kind[i] != CONTROL), None)
        return text[1:] if self.prefix and first is not None and self.kind[first] in (NORMAL, UNUSED) and text[:1] == " " else text


def _characters(run: bytes) -> str:
    """A run of bytes as text; each byte that starts no character is replaced by itself."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(run):
            for size in (1, 2, 3, 4):
                try:
                    out.append(run[at : at + size].decode())
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


@lru_cache(2)
def _vocabulary(path: str) -> MergeVocabulary:
    return MergeVocabulary(path)


def encode_pieces(documents: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id, ids, decoded, agrees`` for each row of ``documents(doc_id, text)``.

    ``model`` names the model's file, which every executor must have. Whole texts are encoded; a null text
    counts as empty and gives no ids and an empty text. ``agrees`` tells whether the library found the same ids and
    text. Repeated rows and null ids are returned as they come; other columns are not read; an empty
    table gives no rows. A long text without a space is one chunk: its agenda takes time in
    proportion to its length times the logarithm of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(model)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                ids, same = vocabulary.encode_batch([t or "" for t in b.column("text").to_pylist()])
                texts = [vocabulary.decode(x) for x in ids]
                checked = vocabulary.library.decode(ids, num_threads=1) if ids else []
                agrees = [s and t == c for s, t, c in zip(same, texts, checked, strict=True)]
                ends = np.cumsum([len(x) for x in ids])
                flat = np.concatenate([np.asarray(x, np.int32) for x in ids])
                lists = pa.ListArray.from_arrays(np.r_[0, ends].astype(np.int32), flat)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists, pa.array(texts, pa.string()), pa.array(agrees)],
                                                 names=["doc_id", "ids", "decoded", "agrees"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string, agrees boolean")


def op12_sentencepiece(spark, sf_dir):
    return encode_pieces(table(spark, sf_dir, "documents")).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), "agrees",
    )
