import collections
import hashlib
import importlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sealgrade.llm import (
    bpe, common, decontamination, embedding_dedup, language_id, ngram_join, pii, substring_dedup, token_counts, token_files, toxicity,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(5)
VOCAB = [f"w{i}" for i in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def documents():
    base = [prose(60, i) for i in range(8)]
    passage = prose(30, 99)
    texts = [
        *base, base[0], base[0], base[1].replace("w1 ", "zz "), base[2] + " tail", None, "", "  \n", "one two three", "one two three",
        base[3] + " " + passage, prose(20, 50) + " " + passage + " " + prose(20, 51), passage, " ".join(["same"] * 40), " ".join(["same"] * 33),
        "é " * 20, prose(3000, 7), prose(3000, 7) + " w1",
    ]
    return [(i, t, "en" if i % 3 else None, None if i % 4 else "s", 1) for i, t in enumerate(texts)]


@pytest.fixture
def docs(rows):
    return rows(documents(), DOCS)


@pytest.fixture
def odd(rows):
    """Null ids, repeated rows, and columns with the names the operators use."""
    extra = ", k long, d long, kept boolean, score double, ids string, spans string, n_words int"
    data = [(*r, 1, 2, True, 0.5, "x", "y", 3) for r in documents()[:12]]
    return rows([*data, data[0], (None, data[1][1], *data[1][2:]), (None, None, None, None, None, None, None, None, None, None, None, None)], DOCS + extra)


@pytest.fixture
def empty(rows):
    return rows([], DOCS)


def by_sql(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    return names, sorted(map(repr, cur.fetchall()))


def same_as_sql(df, sql, **tables):
    names, want = by_sql(sql, **tables)
    assert sorted(repr(tuple(r)) for r in df.select(*names).collect()) == want


def test_substring_dedup_is_what_sql_says(docs):
    same_as_sql(substring_dedup.remove_repeats(docs).drop("kept_text"), substring_dedup.OP4_SQL, documents=docs)


def test_substring_dedup_kept_text(docs):
    for r in substring_dedup.remove_repeats(docs).where("kept_text is not null").collect():
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256


def test_anchor_of_a_window_depends_on_its_words_only():
    a, b = common.Words(), common.Words()
    x, y = prose(40, 1).encode().split(), (prose(9, 2) + " " + prose(40, 1)).encode().split()
    p, q = substring_dedup._anchors(a.hashes(x)[0], 13), substring_dedup._anchors(b.hashes(y)[0], 13)
    assert len(p) == 28 and (q[9:] == p).all()


def test_ngram_join_is_what_sql_says(docs):
    same_as_sql(ngram_join.similar_documents(docs).drop("k"), ngram_join.OP6_SQL, documents=docs)


def test_ngram_join_splits_and_blocks(rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "LIMIT", 4)
    monkeypatch.setattr(ngram_join, "SET_BLOCK", 8)
    monkeypatch.setattr(ngram_join, "SKETCH_BLOCK", 8)
    base = prose(80, 1).split()
    data = [(i, " ".join(w if j != i else "new" for j, w in enumerate(base)), None, None, 0) for i in range(30)]
    docs = rows(data + [(100 + i, prose(50, 200 + i), None, None, 0) for i in range(20)], DOCS)
    same_as_sql(ngram_join.similar_documents(docs).drop("k"), ngram_join.OP6_SQL, documents=docs)


def test_runs_reach_the_recall():
    n, hits = ngram_join.runs_for(0.8, 0.999), 0
    r = np.random.default_rng(1)
    for _ in range(200):
        pool = r.integers(0, 2**63, 110, dtype=np.uint64)
        a, b = np.unique(pool[:100]), np.unique(pool[10:])
        paths = [set(ngram_join.chosen_paths(s, n)[-1][1].tolist()) for s in (a, b)]
        hits += bool(paths[0] & paths[1])
    assert hits >= 196


def vectors(seed=3):
    r = np.random.default_rng(seed)
    c = r.normal(size=(12, 16))
    x = np.repeat(c, 15, axis=0) + 0.28 * r.normal(size=(180, 16))
    data = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    data += [(200, data[0][1]), (201, data[0][1]), (202, None), (203, [0.0] * 16), (204, [float("nan")] * 16), (205, [1.0]),
             (206, [2.0]), (207, []), (208, [1e300] * 16), (209, [2e300] * 16), (210, [None, *data[0][1][1:]])]
    return data


@pytest.mark.parametrize("options", [{}, {"cell_size": 10, "block": 4, "guest_block": 4}, {"max_cells": 1, "block": 16}])
def test_embedding_dedup_is_brute_force(rows, options):
    data = vectors()
    df = rows(data, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df, **options).collect()}
    links = collections.defaultdict(set)
    ok = [(i, np.array(v) / max(map(abs, v))) for i, v in data if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    for i, a in ok:
        for j, b in ok:
            if i != j and len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.9:
                links[i].add(j)
    for i, _ in data:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert got[i] == (len(links[i]), min(seen), i == min(seen)), i
    assert sum(n for n, _, _ in got.values()) > 100


def test_embedding_dedup_null_ids_and_repeats(rows):
    df = rows([(None, [1.0, 0.0], 1), (1, [1.0, 0.0], 2), (1, [1.0, 0.0], 2), (2, [2.0, 0.0], 3)], "vec_id long, embedding array<float>, cell int")
    got = sorted((tuple(r) for r in embedding_dedup.near_duplicates(df).collect()), key=repr)
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 0, None, False)]


def plain_scan(text):
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m.group())
        if 13 <= len(digits) <= 19 and pii.luhn(digits):
            out.append(("card", m))
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return [(k, m.start(), m.end()) for k, m in out]


PIECES = ["a", "@", ".", "b-c", "1", "23", "4.5.6.7", " ", "-", "+1", " (", "4111111111111111", "255.", "é", "_", "%", "http://", "IBAN "]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=16).map("".join))
def test_anchors_find_what_a_plain_scan_finds(text):
    found = pii.find(text, pii._automaton())
    assert [(k, s, e) for k in pii.BASE for s, e in found[k]] == plain_scan(text)


def test_personal_data_added_kinds_and_redaction(rows):
    text = "é IBAN: DE89 3704 0044 0532 0130 00, see http://a.b/c. 12 Old Oak Street, account no 12345678 x@y.zz"
    r = pii.find_personal_data(rows([(1, text)], "doc_id long, text string")).first()
    assert {s.kind: text[s.start : s.end] for s in r.spans} == {
        "email": "x@y.zz", "url": "http://a.b/c", "iban": "DE89 3704 0044 0532 0130 00", "account": "12345678", "street": "12 Old Oak Street"}
    assert r.redacted_text == "é IBAN: [IBAN], see [URL]. [STREET], account no [ACCOUNT] [EMAIL]"


ATOMS = ["the", "ing", " ", "  ", "\n", "\t", "\x1c", "\xa0", "é", "é", "Σ", "İ", "ß", "漢字", "don't", "'S", "12", "!?", "<|endoftext|>",
         "<|startoftext|>", "<|x", "👍", "​", "aaaa", "Th", "_", "ﬁ", "½", "\x85"]
texts = st.lists(st.sampled_from(ATOMS), max_size=14).map("".join)
BPE = bpe.ForcedBoundaryBpe()
CHUNKS = token_files.ChunkEncoder(token_files.VOCABULARY)


@settings(max_examples=800, deadline=None)
@given(texts)
def test_forced_boundaries_encode_as_the_library(text):
    from tokenizers import Tokenizer

    global LIBRARY
    LIBRARY = globals().get("LIBRARY") or Tokenizer.from_file(bpe.VOCABULARY)
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert BPE.encode(text) == ids
    assert BPE.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_long_fragments_merge_alike():
    for f in (("a",) * 60, tuple("banana" * 9), tuple("thethethe")):
        assert BPE.merge(f) == BPE._merge_long(f)


@settings(max_examples=800, deadline=None)
@given(texts)
def test_chunks_encode_as_the_library(text):
    want = CHUNKS.model.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(CHUNKS.encode([text])[0], "<u4").tolist() == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=400), st.integers(0, 1000))
def test_elias_fano(values, more):
    values = np.sort(np.array(values))
    ef = token_files.EliasFano.encode(values, int(values[-1]) + more)
    assert (ef.all() == values).all() and [ef[i] for i in range(len(values))] == values.tolist()


def test_token_files_round_trip(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_files.VOCABULARY)
    token_files.write_token_files(docs, str(tmp_path / "t"), block_ids=500, shards=3)
    at = 0
    got = sorted(token_files.read_token_files(spark, str(tmp_path / "t")).withColumn("crc", F.crc32("ids")).collect())
    assert len(got) == docs.count()
    for r, d in zip(got, documents(), strict=True):
        ids = np.array([*library.encode(d[1] or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert (r.doc_id, r.start, r.n_tokens, bytes(r.ids), r.crc) == (d[0], at, len(ids) // 4, ids, zlib.crc32(ids))
        at += len(ids) // 4


def test_bpe_documents(docs):
    got = {r.doc_id: r for r in bpe.digests(bpe.encode_documents(docs)).collect()}
    for d in documents():
        ids = BPE.encode(d[1] or "")
        assert got[d[0]].n_tokens == len(ids)
        assert got[d[0]].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[d[0]].decoded_sha256 == hashlib.sha256(BPE.decode(ids).encode()).hexdigest()


def brute_search(index, docs, threshold):
    out = {}
    start, entry, impact = index.postings
    for d, words in enumerate(docs):
        for p in range(max(1, -(-len(words) // decontamination.STRIDE))):
            score = collections.Counter()
            for w in set(words[p * decontamination.STRIDE : (p + 2) * decontamination.STRIDE]):
                t = index.terms.get(w)
                if t is not None:
                    for i in range(start[t], start[t + 1]):
                        score[entry[i]] += impact[i]
            for e, s in score.items():
                if s >= threshold:
                    key = d, int(index.entry_item[e])
                    out[key] = max(s, out.get(key, 0))
    return out


@pytest.mark.parametrize("threshold", [0.1, 0.3, 0.5])
def test_search_finds_all_that_scoring_everything_finds(threshold):
    items = [(i, prose(10 + i * 7, 300 + i)) for i in range(20)] + [(99, "w1 w2 w3 w4 w5")]
    docs = [prose(n, 400 + n).split() for n in (0, 5, 64, 65, 128, 300)] + [(prose(30, 1) + " " + items[4][1] + " " + prose(90, 2)).split()]
    index = decontamination.build_index(items)
    want = brute_search(index, docs, threshold)
    got = {(d, i): s for d, i, s in decontamination.search(index, docs, threshold)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


@pytest.mark.parametrize("shard_bytes", [10**7, 200])
def test_leaks_of_planted_items_only(rows, shard_bytes):
    items = rows([(i, prose(20, 600 + i) + ("\n" + prose(8, 700 + i) if i % 2 else "")) for i in range(6)] + [(None, None), (7, "a b"), (8, "")], "item_id long, text string")
    text = {r.item_id: r.text for r in items.collect()}
    data = [(1, prose(100, 1) + " " + text[0] + " " + prose(100, 2)), (2, prose(300, 3)), (3, (text[1] or "").upper()), (4, text[3].split("\n")[0]), (5, None), (6, "")]
    docs = rows(data, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, items, shard_bytes=shard_bytes).collect()}
    assert got == {(1, 0), (3, 1)}
    assert {r.doc_id for r in decontamination.without_leaks(docs, items, shard_bytes=shard_bytes).collect()} == {2, 4, 5, 6}


def test_ledger_counts_signed_changes_once(spark, rows, tmp_path):
    kind = "op string, doc_id long, source string, lang string, tokenizer string, n_tokens long"
    ledger = token_counts.Ledger(spark, str(tmp_path / "l"))
    assert ledger.totals().collect() == []
    first = rows([("insert", 1, "a", "en", "v1", 10), ("insert", 2, "a", "en", "v1", 5), ("insert", 3, None, None, "v1", None), ("insert", None, "a", "en", "v1", 9)], kind)
    assert ledger.commit("one", first) and not ledger.commit("one", first)
    second = rows([("revise", 1, "b", "en", "v1", 12), ("delete", 2, "a", "en", "v1", None), ("delete", 9, "a", "en", "v1", 3), ("insert", 1, "b", "en", "v2", 7)], kind)
    assert ledger.commit("two", second) and not ledger.commit("one", second)
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in ledger.totals().collect()}
    assert got == {("b", "en", "v1"): (1, 12), (None, None, "v1"): (1, 0), ("b", "en", "v2"): (1, 7)}
    # a batch that broke off before its differences were whole is written anew
    (tmp_path / "l/facts/000003-three").mkdir()
    assert ledger.commit("three", rows([], kind)) and ledger.batches() == ["000001-one", "000002-two", "000003-three"]


def test_token_counts_query_is_what_sql_says(spark, docs, empty, tmp_path):
    for i, d in enumerate((docs, empty)):
        d.write.parquet(str(tmp_path / f"{i}/documents.parquet"))
        back = spark.read.parquet(str(tmp_path / f"{i}/documents.parquet"))
        same_as_sql(token_counts.op2_token_counts(spark, str(tmp_path / str(i))), token_counts.OP2_SQL, documents=back)


def test_language_is_learned_and_doubt_rejected(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.fit(docs, language_id.remainder() != 1)
    got = language_id.identify(docs, model).join(docs.select("doc_id", "lang").where(language_id.remainder() == 1), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.95 * len(got)
    assert model.predict([None, "", "12 !?"]) == [("und", 0.0)] * 3
    assert language_id.accepted_only(docs, model).count() >= 0.99 * docs.count()


def test_language_pieces_are_the_whole(monkeypatch):
    text = prose(400, 1)
    whole = np.bincount(np.concatenate(list(language_id.subwords(text))), minlength=1 << language_id.BITS)
    monkeypatch.setattr(language_id, "PIECE", 100)
    assert (np.bincount(np.concatenate(list(language_id.subwords(text))), minlength=1 << language_id.BITS) == whole).all()


def test_toxicity_grades(rows):
    bad = ["vile", "rotten"]
    r = random.Random(1)
    data = []
    for i in range(400):
        words = prose(40, 1000 + i).split()
        for _ in range((i % 4 == 0) * (1 + i % 3 * 3)):
            words.insert(r.randrange(40), r.choice(bad))
        data.append((i, " ".join(words)))
    docs, labels = rows(data, "doc_id long, text string"), rows([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert model.thresholds[0] < model.thresholds[1]
    got = {x.doc_id: x for x in toxicity.grade(docs, model).collect()}
    assert sum(got[i].toxic == (i % 4 == 0) for i in range(400)) >= 396
    assert np.mean([got[i].severity for i in range(0, 400, 4) if i % 3 == 2]) > np.mean([got[i].severity for i in range(0, 400, 4) if i % 3 == 0])


FORMS = {
    "decontamination": lambda d: decontamination.find_leaks(d, d.select(F.col("doc_id").alias("item_id"), "text").limit(0)),
    "no_leaks": lambda d: decontamination.without_leaks(d, d.select(F.col("doc_id").alias("item_id"), "text").limit(0)),
    "language": lambda d: language_id.identify(d, language_id.fit(d)),
    "accepted": lambda d: language_id.accepted_only(d, language_id.fit(d)),
    "substring": substring_dedup.remove_repeats,
    "toxicity": lambda d: toxicity.grade(d, toxicity.fit(d, d.select("doc_id", F.lit(1).alias("toxic")))),
    "join": ngram_join.similar_documents,
    "groups": ngram_join.one_of_each_group,
    "bpe": bpe.encode_documents,
    "pii": pii.find_personal_data,
    "redact": pii.without_personal_data,
    "library_counts": lambda d: token_counts.count_by_library(d, token_files.VOCABULARY),
}
FEWER = {"decontamination", "accepted", "groups"}


@pytest.mark.parametrize("name", FORMS)
def test_odd_and_empty_tables(name, odd, empty):
    got = FORMS[name](odd).collect()
    if name not in FEWER:
        assert len(got) == odd.count()
    assert FORMS[name](empty).collect() == []


def test_token_files_of_odd_and_empty_tables(spark, odd, empty, tmp_path):
    for i, d in enumerate((odd, empty)):
        token_files.write_token_files(d, str(tmp_path / str(i)))
        got = token_files.read_token_files(spark, str(tmp_path / str(i))).collect()
        assert len(got) == d.count()
    assert embedding_dedup.near_duplicates(empty.select(F.col("doc_id").alias("vec_id"), F.array().cast("array<float>").alias("embedding"))).collect() == []


def test_pipeline_keeps_clean_documents(spark, sf_dir):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {r.doc_id for r in pipeline.run(spark, sf_dir).select("doc_id").collect()}
    step = docs
    for _, stage in pipeline.STAGES[:2]:
        step = stage(spark, step, sf_dir)
        assert step.columns == docs.columns
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = {r.doc_id for r in decontamination.find_leaks(step, items).collect()}
    assert out == {r.doc_id for r in step.collect()} - leaks and leaks
