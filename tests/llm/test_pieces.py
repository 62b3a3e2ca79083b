"""Merge-type pieces against the sentencepiece library."""

import hashlib
import random
import time

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from sealgrade.llm import pieces

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", " ", "   ", "▁", "a ▁ b", "\t\n\r\0", "<s>x</s><unk><0x41>", "x\xa0　​y", "éé", "﻿", "\U0001d4b3\U0010ffff",
       "漢字 かな", "one  two   three ", "\n\n\n", "a" * 300, "ab" * 400 + " " * 40]


@pytest.fixture(scope="module")
def own():
    return pieces.MergeVocabulary()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def check(own, library, texts):
    ids, agrees = own.encode_batch(texts)
    assert ids == library.encode(texts)
    assert all(agrees)
    assert [own.decode(x) for x in ids] == library.decode(ids)


def test_odd_texts(own, library):
    check(own, library, ODD)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab  ▁\n\tthexiné.,%<>0漢\U0001d4b3")), max_size=80), min_size=1, max_size=4))
def test_any_text(own, library, texts):
    check(own, library, texts)


def test_any_ids_are_decoded(own, library):
    r = random.Random(4)
    for _ in range(3000):
        ids = [r.choice([r.randrange(3, 32000), r.randrange(3, 259), r.randrange(259, 275), 0, 28705]) for _ in range(r.randrange(12))]
        assert own.decode(ids) == library.decode(ids)


def test_list_and_heap_agenda_join_alike(own):
    r = random.Random(5)
    for _ in range(500):
        symbols = [r.choice("▁theinorabc") for _ in range(r.randrange(1, 48))]
        places = [own.rank.get(a + b, pieces.NONE) for a, b in zip(symbols, symbols[1:], strict=False)]
        assert own._merge_long(list(symbols), places) == own.merge("".join(symbols))


def test_unused_pieces_fall_back_to_what_they_were_joined_from():
    own = pieces.MergeVocabulary()
    whole = own.merge("▁the")
    assert whole == ["▁the"]
    own.unused = {"▁the"}
    parts = own.merge("▁the")
    assert len(parts) == 2 and "".join(parts) == "▁the"


def test_a_chunk_of_a_megabyte(own, library):
    r = random.Random(6)
    text = "".join(r.choice("etaoinshr") for _ in range(1_000_000))
    start = time.monotonic()
    check(own, library, [text])
    assert time.monotonic() - start < 60


def test_memory_is_bounded(own, library, monkeypatch):
    monkeypatch.setattr(pieces, "MEMORY", 20)
    small = pieces.MergeVocabulary()
    texts = [f"word{i} " * 3 + f"tail{i % 7}" for i in range(200)]
    for i in range(0, 200, 10):
        check(small, library, texts[i : i + 10])
    assert len(small.seen) <= 20 and len(small.parts) <= 20


def test_a_difference_is_told(own):
    broken = pieces.MergeVocabulary()
    broken.rank.pop("▁the")
    ids, agrees = broken.encode_batch(["see the end", "no such word"])
    assert agrees == [False, True]
    assert broken.encode_batch(["see the end"])[1] == [False]


def test_table(rows, library):
    extra = ", ids string, decoded int, agrees string"
    data = [(i, t, None, None, 0, "x", 1, "y") for i, t in enumerate([*ODD, None, "same", "same"])]
    docs = rows([*data, data[-1], (None, "no id", None, None, 0, None, None, None)], DOCS + extra)
    got = pieces.encode_pieces(docs).collect()
    assert len(got) == len(data) + 2
    texts = {i: t or "" for i, t, *_ in data} | {None: "no id"}
    for r in got:
        want = library.encode(texts[r.doc_id])
        assert r.ids == want and r.decoded == library.decode(want) and r.agrees
    assert pieces.encode_pieces(rows([], DOCS)).collect() == []


def test_query(spark, sf_dir, library):
    got = {r.doc_id: r for r in pieces.op12_sentencepiece(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "")
        row = got[d.doc_id]
        assert row.n_tokens == len(ids) and row.agrees
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
