"""Documents of a token file by select alone: ids, places, odd ids."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sealgrade.llm import token_files as tf

DOCS = "doc_id long, text string"


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=80))
def test_differences_of_any_ids(values):
    values = sorted(values)
    gaps = [v - values[0] for v in values]
    ef = tf.EliasFano.encode(np.array(gaps, np.uint64), gaps[-1])
    assert [ef[i] for i in range(len(gaps))] == gaps


@pytest.mark.parametrize("shards", [None, 3])
def test_documents_by_select(spark, rows, tmp_path, shards):
    data = [(None, "no id"), (None, None), (-5, "a b"), (-(2**63), "least"), (2**63 - 1, "most"), (3, "x"), (3, "y"), (4, ""), (10**9, "z" * 50)]
    path = str(tmp_path / "t")
    tf.write_token_files(rows(data, DOCS), path, block_ids=7, shards=shards)
    blocks = spark.read.parquet(path).orderBy("shard", "block").collect()
    assert "doc_ids" not in blocks[0].asDict() and len(blocks) > 2
    ids, texts = [], []
    for row in blocks:
        b = tf.Block(row.asDict())
        ids += [b.doc_id(i) for i in range(b.n)]
        texts += [b.ids(i) for i in range(b.n)]
        assert b.start(0) == 0 and b.end(b.n - 1) == row.n_ids
    assert ids == sorted((i for i, _ in data), key=lambda i: (i is not None, i or 0))
    got = tf.read_token_files(spark, path).orderBy("start").collect()
    assert [(r.doc_id, bytes(r.ids)) for r in got] == list(zip(ids, texts, strict=True))
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()


def test_few_blocks_are_held_at_once(spark, rows, tmp_path):
    """Row groups and Arrow batches are bounded by bytes, whatever number of blocks a shard has."""
    data = [(i, " ".join(f"{i * j % 9973:x}" for j in range(20_000))) for i in range(120)]
    path = str(tmp_path / "t")
    tf.write_token_files(rows(data, DOCS), path, shards=1)
    meta = [pq.ParquetFile(f).metadata for f in (tmp_path / "t").glob("*.parquet")]
    sizes = [m.row_group(i).total_byte_size for m in meta for i in range(m.num_row_groups)]
    assert sum(sizes) > 2 * tf.GROUP_BYTES and max(sizes) < 2 * tf.GROUP_BYTES
    got = tf.read_token_files(spark, path).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == list(range(120))
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()

    def count(batches):
        yield from (pa.record_batch([pa.array([b.nbytes])], names=["n"]) for b in batches)

    batches = [r.n for r in spark.read.schema(tf.FORMAT).parquet(path).mapInArrow(count, "n long").collect()]
    assert len(batches) > 2 and max(batches) < 2 * tf.BATCH_BYTES


def test_reading_gives_up_what_writing_remembered():
    from sealgrade.llm import token_files as T
    assert T._encoder(T.VOCABULARY).encode(["some text of chunks"]) and T._encoder(T.VOCABULARY).seen
    assert list(T._read(iter([]))) == []
    assert not T._encoder.cache_info().currsize


def test_remembered_words_stay_when_memory_is_full(monkeypatch):
    """Frequent words come early: a full memory must not forget them, nor change ids."""
    from sealgrade.llm import bpe
    monkeypatch.setattr(bpe, "MEMORY", 3)
    small, whole = bpe.ForcedBoundaryBpe(), bpe.ForcedBoundaryBpe()
    text = " ".join(f"word{i}" for i in range(40))
    assert small.encode("the of and " + text) == [i for c in ("the of and " + text).split() for i in whole._chunk(c)]
    assert set(small.chunks) == {"the", "of", "and"}
