"""The filter audit against plain Python and SQL."""

import random
from itertools import permutations

import duckdb
import pytest

from sealgrade.llm import filter_audit as fa

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
r = random.Random(3)
WORDS = [f"w{i}" for i in range(90)]


def prose(n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def _sample():
    head = prose(40)
    texts = [prose(n) for n in (3, 30, 49, 50, 60, 200, 2000)] + ["A" * 30 + " b", "", None, " ", "x # y", "\x1f a\x0bb", "ÀÉ " * 60]
    texts += [head + " " + prose(20) for _ in range(20)] + [head, head + " ", texts[4], texts[4], texts[4] + "x", None]
    rows = [(i * 7 % 101, t, None, None if i % 5 == 0 else f"s{i % 3}", 0) for i, t in enumerate(texts)]
    return rows + [rows[4], rows[5], (None, texts[4], None, "s1", 0), (None, texts[5], None, None, 0), (200, texts[6], None, "", 0)]


SAMPLE = _sample()


def sample():
    return list(SAMPLE)


def marks():
    return [(i, i % 2, int(i % 3 == 0)) for i in range(0, 101, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (6, None, None), (999, 1, 1)]


def brute(rows, labels):
    good, toxic = ({i for i, *m in labels if i is not None and m[k] == 1} for k in (0, 1))
    out, least = {}, {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    fails = []
    for i, t, _, part, _ in rows:
        f = {x for k, x in enumerate("ABCD") if fa.failures(t or "") >> k & 1}
        if i is not None and i > least[t or ""]:
            f.add("E")
        fails.append((i, part or "", f))
    for part in {p for _, p, _ in fails}:
        own = [(i, f) for i, p, f in fails if p == part]
        removed = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if x in f]
                before = len(own) - len(left)
                kept = [(i, f) for i, f in left if x not in f]
                removed[x] += len(gone)
                out[part, "".join(order), step] = [
                    len(kept), len(gone), sum(x in f for _, f in own) - len(gone), sum(f == {x} for _, f in own),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
                left = kept
                assert before <= len(own)
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removed[order[step - 1]])
    return out


def got(df):
    return {(x.part, x.filter_order, x.step): [x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost, x.shapley]
            for x in df.collect()}


def test_like_plain_python_and_sql(rows):
    docs, labels = rows(sample(), DOCS), rows(marks(), LABELS)
    have = got(fa.filter_audit(docs, labels))
    assert have == brute(sample(), marks())
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    con.register("labels", labels.toArrow())
    want = {r[:3]: list(r[3:]) for r in con.execute(fa.OP11_SQL).fetchall()}
    assert have == want


def test_many_ranges_and_a_text_that_several_tasks_share(rows, monkeypatch):
    monkeypatch.setattr(fa, "HELD_DOCS", 3)
    data = sample() + [(300 + i % 90, sample()[5][1], None, f"s{i % 2}", 0) for i in range(120)]
    docs, labels = rows(data, DOCS).repartition(7), rows(marks(), LABELS)
    plain = fa.sampled_ranges(docs.selectExpr("coalesce(text, '') as text"), 3000)
    assert len(plain.starts) > 2 and max(plain.spread) > 1
    assert got(fa.filter_audit(docs, labels, range_bytes=3000)) == brute(data, marks())


def test_columns_with_clashing_names(rows):
    extra = ", part string, mask int, n long, place int, first long, good long, toxic long, range int"
    docs = rows([(*x, "p", 1, 2, 3, 4, 5, 6, 7) for x in sample()], DOCS + extra)
    labels = rows([(*x, "p", 3, 4) for x in marks()], LABELS + ", part string, good long, n long")
    assert got(fa.filter_audit(docs, labels)) == brute(sample(), marks())


def test_empty_tables(rows):
    assert fa.filter_audit(rows([], DOCS), rows(marks(), LABELS)).collect() == []
    assert got(fa.filter_audit(rows(sample(), DOCS), rows([], LABELS))) == brute(sample(), [])


def test_trie_holds_whole_texts():
    trie = fa.RadixTrie()
    texts = ["", "a", "ab", "abc", "abd", "b" * 5000 + "x", "b" * 5000 + "y", "b" * 5000, "é", "éa"]
    r.shuffle(texts)
    ends = {t: trie.insert(t) for t in texts}
    assert all(trie.insert(t) is n and n.text == t for t, n in ends.items())
    assert sorted(n.text for n in trie.terminals()) == sorted(texts)
    ends["ab"].least = 9
    trie.keep_only("ab")
    assert [n.text for n in trie.terminals()] == ["ab"] and trie.insert("ab").least == 9
    trie.keep_only("ab")
    trie.insert("")
    trie.keep_only("")
    assert [n.text for n in trie.terminals()] == [""] and trie.insert("zz").text == "zz" and trie.insert("").text == ""


@pytest.mark.parametrize("a, b", [("", ""), ("a", ""), ("ab", "ac"), ("x" * 100 + "a", "x" * 100 + "b"), ("x" * 99, "x" * 40), ("q", "z")])
def test_common_length(a, b):
    want = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert fa.common_length(a, b) == want


def test_range_starts_are_shortest_prefixes():
    ranges = fa.ranges_of([(t, 10.0) for t in ("aaa", "aab", "b", "cccccc", "ccccccd")], 10.0)
    assert ranges.starts == ["aab", "b", "c", "ccccccd"] and ranges.spread == [1] * 5
    shared = fa.ranges_of([("a", 1.0), ("hot", 50.0), ("hotter", 1.0)], 10.0)
    assert shared.starts == ["h", "hott"] and shared.spread == [1, 5, 1]
    assert [shared.of(t) for t in ("", "a", "hot", "hotte", "hott", "z")] == [0, 0, 1, 2, 2, 2]


def test_query(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = {r[:3]: list(r[3:]) for r in con.execute(fa.OP11_SQL).fetchall()}
    assert got(fa.op11_filter_audit(spark, sf_dir)) == want and len(want) % 600 == 0
