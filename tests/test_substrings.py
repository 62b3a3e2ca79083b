"""The index of needles against Python's ``in``."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from sealgrade.operators import substrings as S

ALPHABET = list("abcab é漢\0\n")


def word(r, n):
    return "".join(r.choice(ALPHABET) for _ in range(n))


def pairs(index, texts):
    sizes, which = S.found_in(index, pa.array(texts, pa.string()))
    out, at = [], 0
    for n in sizes:
        out.append(sorted(which[at : at + n].tolist()))
        at += n
    return out


def test_pairs_like_in(monkeypatch):
    r = random.Random(1)
    for size in (4 << 20, 40):
        monkeypatch.setattr(S, "BUFFER_BYTES", size)
        for _ in range(60):
            texts = [None if r.random() < 0.1 else word(r, r.choice([0, 1, 3, 30, 200])) for _ in range(r.randrange(12))]
            needles = [word(r, r.choice([0, 1, 2, 3, 4, 5, 7, 9, 12])) for _ in range(r.randrange(30))]
            index = S.NeedleIndex([n.encode() for n in needles])
            assert pairs(index, texts) == [[i for i, n in enumerate(needles) if t is not None and n in t] for t in texts]


def test_a_slice_of_a_column():
    column = pa.array(["zero", "needle one", None, "two needles", "needle"], pa.string()).slice(1, 3)
    sizes, which = S.found_in(S.NeedleIndex([b"needle", b"one"]), column)
    assert sizes.tolist() == [2, 0, 1] and sorted(which[:2]) == [0, 1]


def test_needles_lie_under_their_rarest_run():
    counts = {int(S.runs_at(np.frombuffer(w, np.uint8))[0]): n for w, n in ((b"comm", 9), (b"ommo", 9), (b"mmon", 9), (b"monX", 1), (b"onXY", 5))}
    index = S.NeedleIndex([b"commonXY", b"common"], counts)
    assert index.offset.tolist() == [3, 0]
    assert pairs(index, ["a commonXY", "common", "onXY"]) == [[0, 1], [1], []]


def test_counts_of_runs(rows):
    texts = rows([("abcdabcd",), ("xabcdx",), ("abc",), (None,), ("",)], "t string")
    got = S.text_counts(texts, "t", [b"abcd", b"dx", b"bcdx"])
    run = lambda w: int(S.runs_at(np.frombuffer(w, np.uint8))[0])
    assert got == {run(b"abcd"): 2, run(b"bcdx"): 1}
    assert S.text_counts(texts, "t", [b"abc", b""]) == {}


@pytest.mark.parametrize("round_bytes", [8 << 20, 64])
def test_found_rows(rows, round_bytes):
    r = random.Random(2)
    texts = [(i, word(r, 60), "keep") for i in range(30)] + [(30, None, "keep"), (31, "", "keep"), (0, "abc", "again")]
    needles = [(word(r, n), i, {"x": i}) for i, n in enumerate([1, 2, 2, 3, 3, 4, 4, 5, 5, 0])] + [(None, 99, None), ("ab", 100, None), ("ab", 101, None)]
    docs = rows(texts, "id int, body string, found_1 string")
    got = S.with_found(docs, "body", rows(needles, "needle string, n int, m map<string,int>"), round_bytes=round_bytes)
    assert got.columns == ["id", "body", "found_1", "found"]
    for row in got.collect():
        want = sorted(n for w, n, _ in needles if w is not None and row.body is not None and w in row.body)
        assert sorted(x.n for x in row.found) == want
        assert all(x.m == {"x": x.n} for x in row.found if x.n < 99)


def test_no_needles_and_no_texts(rows):
    docs, none = rows([(1, "a")], "id int, body string"), rows([], "needle string, n int")
    assert S.with_found(docs, "body", none).first().found == []
    assert S.with_found(docs.limit(0), "body", rows([("a", 1)], "needle string, n int")).collect() == []


def test_a_hundred_thousand_needles():
    """Their number hardly shows: texts of 4 MB are searched in seconds."""
    r = random.Random(3)
    needles = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(5, 12))) for _ in range(100_000)]
    texts = [" ".join(r.choices(needles, k=20)) + " " + "".join(r.choice("abcdefghij ") for _ in range(1000)) for _ in range(3_000)]
    index = S.NeedleIndex([n.encode() for n in needles])
    start = time.monotonic()
    found = pairs(index, texts)
    assert time.monotonic() - start < 20
    for t, hits in list(zip(texts, found, strict=True))[:20]:
        assert hits == [i for i, n in enumerate(needles) if n in t]
