"""Ranked lexical search against scoring everything."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np

from sealgrade.llm import lexical_search as ls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ITEMS = "item_id long, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
r = random.Random(8)
WORDS = [f"w{i}" for i in range(120)] + ["Été", "ÉTÉ", "ab c", "x_y", "İ", "漢字"]


def prose(n):
    return " ".join(r.choices(WORDS, range(1, len(WORDS) + 1), k=n))


DATA = [(i * 3 % 401, prose(r.choice([1, 5, 40, 300])), None, None, 0) for i in range(250)]
DATA += [(500, None, None, None, 0), (501, "", None, None, 0), (502, "-- !", None, None, 0), (503, DATA[0][1], None, None, 0),
         (504, DATA[0][1], None, None, 0), (505, prose(30_000), None, None, 0), DATA[3], DATA[3], (None, DATA[0][1], None, None, 0)]
QUERIES = [(i, prose(r.choice([1, 3, 20, 60]))) for i in range(12)] + [(20, None), (21, ""), (22, "zzz -"), (23, "w1 w1 W1 w2"), (None, "w5 w6"), (23, "w1 w1 W1 w2")]


def brute(data, queries, top=20):
    docs = [(i, Counter(t)) for i, text, *_ in data if (t := TERM.findall((text or "").translate(LOWER)))]
    total, length = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in set(queries):
        scores = []
        for doc_id, held in docs:
            n = sum(held.values())
            m = 100 - 25 + (25 * n * total) // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * held[t]) // (1000 * held[t] + 12 * m))
                        for t in TERM.findall((text or "").translate(LOWER)) if t in held)
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        out += [(item, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def got(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()), key=repr)


def test_terms():
    for text in [*WORDS, "a-b_C9\x7fd\x80e F\x00g", "\x1f\t\n", "ÀB.Ç"]:
        assert [t.decode() for t in ls.terms_of(text)] == TERM.findall(text.translate(LOWER))


def test_like_scoring_everything(rows):
    docs, items = rows(DATA, DOCS), rows(QUERIES, ITEMS)
    assert got(ls.ranked_search(docs, items)) == brute(DATA, QUERIES)


def test_small_shards_leaves_and_rounds(rows):
    docs, items = rows(DATA, DOCS).repartition(3), rows(QUERIES, ITEMS)
    want = brute(DATA, QUERIES, 4)
    for bounds in ({"shard_postings": 1}, {"leaf": 0}, {"leaf": 3, "shard_postings": 500}, {"item_bytes": 150}):
        assert got(ls.ranked_search(docs, items, top=4, **bounds)) == want


def test_clashing_columns_and_empty_tables(rows):
    extra = ", item long, n long, terms string, score string, rank int, fan int, r int, item_id long"
    docs = rows([(*x, 1, 2, "t", "s", 3, 4, 5, 6) for x in DATA], DOCS + extra)
    items = rows([(*x, 1, "s", 2) for x in QUERIES], ITEMS + ", doc_id long, score string, rank int")
    assert got(ls.ranked_search(docs, items)) == brute(DATA, QUERIES)
    assert got(ls.ranked_search(rows([], DOCS), items)) == []
    assert got(ls.ranked_search(docs, rows([], ITEMS))) == []
    assert got(ls.ranked_search(rows([(1, "", None, None, 0), (2, None, None, None, 0)], DOCS), items)) == []


def test_greatest_is_the_greatest():
    g = np.random.default_rng(1)
    term, doc = np.divmod(g.permutation(900)[:500], 100)
    shard = ls.Shard(list(range(100)), doc, term, g.integers(0, 50, 500), 9)
    for _ in range(2000):
        t = g.integers(0, 9)
        a, b = np.sort(g.integers(shard.start[t], shard.start[t + 1] + 1, 2))
        if b > a:
            p = int(shard.greatest(np.array([a]), np.array([b]))[0])
            assert a <= p < b and shard.impact[p] == shard.impact[a:b].max()


def test_a_search_leaves_documents_out():
    """Bounds rule documents out: far fewer are scored than there are."""
    g = np.random.default_rng(2)
    n, terms = 20_000, 12
    pairs = [(t, d) for t in range(terms) for d in np.flatnonzero(g.random(n) < 0.02 * (t + 1)).tolist()]
    term, doc = np.array(pairs).T
    impact = g.pareto(2.0, len(term)) * 1000
    shard = ls.Shard(list(range(n)), doc, term, impact.astype(np.int64), terms)
    best = ls.Best(20)
    scored = ls.search(shard, np.arange(terms), np.ones(terms, np.int64), best, leaf=32)
    scores = np.bincount(doc, impact.astype(np.int64), n)
    assert [-s for s, *_ in best.rows] == sorted(scores.astype(int).tolist(), reverse=True)[:20]
    assert scored < n / 2


def test_query_is_what_sql_says(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = sorted(con.execute(ls.OP13_SQL).fetchall(), key=repr)
    assert got(ls.op13_ranked_search(spark, sf_dir)) == want and want
