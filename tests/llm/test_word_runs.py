"""Words and their hashes from the bytes of many texts at once, and what that costs."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sealgrade.llm import common

PIECES = st.sampled_from(["", " ", "  ", "\t", "\n", "\x0b", "\x1c", "\x00", "\x85", "　", "a", "a\x00", "é", "abcdefgh", "abcdefghi", "x" * 300, "x" * 301, "😀"])
TEXTS = st.lists(st.one_of(st.none(), st.lists(PIECES, max_size=12).map("".join)), max_size=12)


def split(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


@pytest.mark.parametrize("skipped", [0, 2])
@settings(max_examples=200, deadline=None)
@given(TEXTS, st.sampled_from([1, 20, 1 << 20]))
def test_words_of_texts(skipped, texts, most):
    """Texts, words and hashes are those of each text alone, wherever runs are cut."""
    seen, done = {}, 0
    for run in common.word_runs(pa.array(texts, pa.string()).slice(skipped), most):
        assert run.first == done
        low, high = run.hashes(False), run.hashes(True)
        for i in range(len(run.cuts) - 1):
            words = split(texts[skipped + done])
            assert run.words(i) == words and run.text(i) == b" ".join(words)
            assert run.at[i + 1] - run.at[i] == len(words)
            for j, w in enumerate(words, run.at[i]):
                assert run.data[run.starts[j] : run.ends[j]].tobytes() == w
                assert seen.setdefault(w, (low[j], high[j])) == (low[j], high[j])
            done += 1
    assert done == max(0, len(texts) - skipped)
    assert len({h for h, _ in seen.values()}) == len({h for _, h in seen.values()}) == len(seen)


def test_many_words_have_different_hashes():
    words = [f"{a}{b:x}" for a in ("", "w", "prefix-", "a-long-beginning-of-a-word-") for b in range(50_000)]
    run, = common.word_runs(pa.array([" ".join(words)]), 1 << 30)
    n = len(set(words))
    for h in (run.hashes(False), run.hashes(True)):
        assert len(np.unique(h)) == n
        bits = (h[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
        assert np.abs(bits.mean(axis=0) - 0.5).max() < 0.02


def test_words_are_not_made_one_by_one(monkeypatch):
    """Words of usual length are hashed together: none is remembered or digested on its own."""
    monkeypatch.setattr(common.hashlib, "blake2b", None)
    run, = common.word_runs(pa.array([" ".join(f"word{i}" for i in range(10_000))]))
    assert len(np.unique(run.hashes(True))) == 10_000
