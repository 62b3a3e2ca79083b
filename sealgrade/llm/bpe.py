"""Byte-pair encoding and decoding with forced boundaries.

Two neighbouring symbols of a word that are neighbours in no token of the vocabulary can never be
joined, so a word may be cut there for certain. The fragments between such cuts are encoded each on
its own, remembered (they repeat far more than words do), and joined again.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealgrade.llm.common import small_batches, table, trimmed

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Entries a worker remembers of chunks, words and fragments each; the first that fit stay.
MEMORY = 200_000
#: Symbols up to which a fragment's pairs are searched; no rank is as high as NONE.
SHORT, NONE = 64, 1 << 60
#: Fixed value: how the vocabulary's files split words.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Separators of the Unicode standard; str.split() also splits at the four characters of ODD.
ODD = re.compile("[\x1c-\x1f]")
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        out.setdefault(b, chr(256 + len(out) - len(plain)))
    return [out[b] for b in range(256)]


class ForcedBoundaryBpe:
    """Encoder and decoder for a vocabulary of words with an end mark."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab, self.end = model["vocab"], model["end_of_word_suffix"] or ""
        self.rank = {tuple(m): i for i, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in (self.vocab | self.special).items()}
        self.special_at = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.symbol = byte_symbols()
        self.joined = {pair for t in self.vocab for pair in self._pairs(t)}
        self.chunks: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.fragments: dict[tuple[str, ...], tuple[int, ...]] = {}

    def _pairs(self, token: str) -> Iterator[tuple[str, str]]:
        body = token.removesuffix(self.end) if self.end else token
        symbols = list(body)
        if symbols and body != token:
            symbols[-1] += self.end
        return zip(symbols, symbols[1:], strict=False)

    def cut(self, symbols: list[str]) -> list[tuple[str, ...]]:
        """Fragments between neighbours that no token joins."""
        out, at = [], 0
        for i in range(1, len(symbols)):
            if (symbols[i - 1], symbols[i]) not in self.joined:
                out.append(tuple(symbols[at:i]))
                at = i
        return [*out, tuple(symbols[at:])]

    def merge(self, fragment: tuple[str, ...]) -> tuple[int, ...]:
        """Ids of a fragment: the lowest ranked pair is joined first, the leftmost of equal ones."""
        if len(fragment) > SHORT:
            return self._merge_long(fragment)
        symbols, rank = list(fragment), self.rank.get
        ranks = [rank(p, NONE) for p in zip(symbols, symbols[1:], strict=False)]
        while ranks and (least := min(ranks)) < NONE:
            i = ranks.index(least)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank((symbols[i], symbols[i + 1]), NONE)
            if i:
                ranks[i - 1] = rank((symbols[i - 1], symbols[i]), NONE)
        return tuple([self.vocab[s] for s in symbols if s in self.vocab])

    def _merge_long(self, fragment: tuple[str, ...]) -> tuple[int, ...]:
        """The same by a heap, for fragments too long to search for each join."""
        symbols: list[str | None] = list(fragment)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, p) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := self.rank.get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != pair[0] or j >= n or symbols[j] != pair[1]:
                continue
            symbols[i], symbols[j] = pair[0] + pair[1], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n:
                    p = (symbols[k], symbols[after[k]])
                    if (r := self.rank.get(p)) is not None:
                        heapq.heappush(heap, (r, k, p))
        return tuple(self.vocab[s] for s in symbols if s is not None and s in self.vocab)

    def _word(self, word: str) -> tuple[int, ...]:
        got = self.words.get(word)
        if got is None:
            symbols = [self.symbol[b] for b in word.encode("utf-8", "surrogatepass")]
            symbols[-1] += self.end
            got = ()
            for f in self.cut(symbols):
                ids = self.fragments.get(f)
                if ids is None:
                    ids = self._remember(self.fragments, f, self.merge(f))
                got += ids
            self._remember(self.words, word, got)
        return got

    @staticmethod
    def _remember(memory: dict, key, value):
        # very long words are encoded, but not remembered
        if len(memory) < MEMORY and len(key) <= 200:
            memory[key] = value
        return value

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        out: list[int] = []
        for w in SPLIT.findall(chunk):
            out += self._word(w)
        return self._remember(self.chunks, chunk, tuple(out))

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        pieces = self.special_at.split(text) if self.special_at and "<|" in text else [text]
        chunks = self.chunks
        for piece in pieces:
            if piece in self.special:
                out.append(self.special[piece])
                continue
            # letter by letter, a sigma at a word's end has no form of its own
            low = piece.lower() if piece.isascii() else unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
            for c in SPACE.split(low) if ODD.search(low) else low.split():
                ids = chunks.get(c)
                out += self._chunk(c) if ids is None else ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The tokens of ``ids``, separated by spaces; unknown ids are left out."""
        token = self.token
        return " ".join([token[i] for i in ids if i in token])


@lru_cache(2)
def _encoder(path: str) -> ForcedBoundaryBpe:
    return ForcedBoundaryBpe(path)


def encode_documents(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``doc_id, ids, decoded`` for each row of ``documents(doc_id, text)``.

    ``path`` names the vocabulary's file, which every executor must have. Whole texts are encoded; a null
    text counts as empty and gives no ids and an empty text. Repeated rows and null ids are returned as
    they come; other columns are not read; an empty table gives no rows.
    """
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(path)
        for b in batches:
            ids, sizes, texts = [], [], []
            for text in b.column("text").to_pylist():
                got = bpe.encode(text or "")
                ids.append(np.asarray(got, np.int32))
                sizes.append(len(got))
                texts.append(bpe.decode(got))
            lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum(sizes)].astype(np.int32), np.concatenate(ids or [np.empty(0, np.int32)]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(trimmed(run), "doc_id long, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_bpe(spark, sf_dir):
    return digests(encode_documents(table(spark, sf_dir, "documents")))
