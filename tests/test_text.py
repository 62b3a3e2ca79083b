"""Pagination and text expressions against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from sealgrade.functions import text as T
from sealgrade.operators import pagination as P


def one(df):
    return df.first()[0]


def value(spark, column, **cols):
    names = list(cols)
    return one(spark.createDataFrame([tuple(cols.values())], ", ".join(f"{n} string" for n in names))
               .select(column))


@pytest.mark.parametrize("n, pages", [(0, 1), (1, 1), (2000, 1), (2001, 2), (4001, 3)])
def test_char_pages(spark, n, pages):
    text = ("aé𝄞\n" * n)[:n]
    got = value(spark, T.char_pages(F.col("t")), t=text)
    assert len(got) == pages
    assert "".join(got) == text if n else got == ["[Empty file]"]
    assert all(len(p) == 2000 for p in got[:-1])


def test_blank_text_is_an_empty_file(spark):
    assert value(spark, T.char_pages(F.col("t")), t=" \n \t") == ["[Empty file]"]


def python_paragraph_pages(items, words, overlap=0):
    pages, page, count, fresh = [], [], 0, 0
    for text, is_table in items:
        if is_table:
            page.append(text)
            fresh += 1
            continue
        text = text.strip()
        if not text:
            continue
        page.append(text)
        fresh += 1
        count += len(text.split())
        if count >= words:
            pages.append("\n".join(page))
            page, count, fresh = (page[-overlap:] if overlap else []), 0, 0
    if fresh:
        pages.append("\n".join(page))
    return pages or ["[No text content found]"]


@pytest.mark.parametrize("overlap", [0, 2])
def test_paragraph_pages_match_a_loop(spark, rows, overlap):
    rng = random.Random(7)
    docs = [[]] + [
        [(" ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 260))), rng.random() < 0.2)
         for _ in range(rng.randint(1, 12))]
        for _ in range(30)
    ] + [[(" ".join(["w"] * n), False), ("tail", False)] for n in (499, 500, 501)]
    df = rows(list(enumerate(docs)), "id int, paragraphs array<struct<text:string,is_table:boolean>>")
    got = {}
    for r in P.pages_by_words(df, ["id"], overlap=overlap).collect():
        got.setdefault(r["id"], {})[r["page"]] = r["text"]
    for i, items in enumerate(docs):
        want = python_paragraph_pages(items, 500, overlap)
        assert [got[i][k] for k in sorted(got[i])] == want


def test_line_budget_pages_match_a_loop(spark, rows):
    rng = random.Random(3)
    docs = [["x" * rng.choice([0, 5, 79, 80, 160, 4000]) for _ in range(rng.randint(1, 60))] for _ in range(20)]
    df = rows(list(enumerate(docs)), "id int, paragraphs array<string>")
    got = {}
    for r in P.pages_by_line_budget(df, ["id"]).collect():
        got.setdefault(r["id"], {})[r["page"]] = r["text"]
    for i, paragraphs in enumerate(docs):
        pages, page, used = [], [], 0
        for text in filter(None, paragraphs):
            cost = max(1, len(text) // 80)
            if used + cost > 40 and page:
                pages.append("\n".join(page))
                page, used = [], 0
            page.append(text)
            used += cost
        if page:
            pages.append("\n".join(page))
        assert [got.get(i, {})[k] for k in sorted(got.get(i, {}))] == pages


def test_line_pages(spark, rows):
    text = "\n".join(str(i) for i in range(85))
    got = P.pages_by_lines(rows([(1, text)], "id int, text string"), ["id"]).orderBy("page").collect()
    assert [len(r["text"].split("\n")) for r in got] == [40, 40, 5]


def test_combined_text_and_preview(spark, rows):
    df = rows([(1, ["a", "b"], 25)], "document_id int, pages array<string>, image_count int")
    assert P.combined_text(df).first()["combined_text"] == "Page 1:\na\n\n--- Page Break ---\n\nPage 2:\nb"
    every = df.select(T.content_blocks(F.col("pages"), F.col("image_count")).alias("b")).first()["b"]
    assert [b["type"] for b in every] == ["text"] + ["image"] * 25
    blocks = df.select(T.content_blocks(F.col("pages"), F.col("image_count"), max_images=20).alias("b")).first()["b"]
    assert [b["type"] for b in blocks] == ["text"] + ["image"] * 20 + ["text"]
    assert "25 images, but only the first 20" in blocks[-1]["text"]
    assert P.with_preview(df).first()["preview"].startswith("Document Text Content:\n\nPage 1:\na")


def test_segment_location(spark, rows):
    full = "x" * 4500 + "needle" + "y" * 10
    raw = [("needle", "Public", 0.9), ("gone", None, None), ("", "Unsafe", 0.1)]
    df = rows([(full, [(t, c, s, None, None) for t, c, s in raw])],
              "full string, raw array<struct<text:string,classification:string,confidence:double,"
              "keywords:array<string>,reasoning:string>>")
    a, b, c = df.select(T.locate_segments(F.col("full"), F.col("raw"))).first()[0]
    assert (a["start_char"], a["end_char"], a["page"]) == (4500, 4506, 3)
    assert (b["start_char"], b["end_char"], b["page"], b["confidence"], b["classification"]) == (
        100, 0, 1, 0.5, "Public")
    assert (c["start_char"], c["end_char"]) == (0, 250)


def test_segments_and_pages_are_bounded_only_when_asked(spark, rows):
    full = "z" * 300_000 + "end"
    df = rows([(full, [("end", "Public", 0.5, None, None)] * 60)],
              "full string, raw array<struct<text:string,classification:string,confidence:double,"
              "keywords:array<string>,reasoning:string>>")
    got = df.select(T.locate_segments(F.col("full"), F.col("raw"))).first()[0]
    assert len(got) == 60 and got[0]["page"] == 151
    got = df.select(T.locate_segments(F.col("full"), F.col("raw"), limit=50, last_page=100)).first()[0]
    assert len(got) == 50 and got[0]["page"] == 100


def test_sheets_and_slides(spark, rows):
    sheet = rows(
        [(1, 0, "S", 1, ["a", None]), (1, 0, "S", 2, [None, ""]), (1, 0, "S", 0, ["h", "i"]),
         (1, 1, "T", 0, [None])],
        "document_id int, sheet_no int, sheet string, row_no int, cells array<string>")
    got = {r["sheet_no"]: r["text"] for r in P.sheet_pages(sheet).collect()}
    assert got == {0: "[Sheet: S]\nh | i\na | ", 1: "[Sheet: T]"}
    slides = rows([(1, 1, 0, " a "), (1, 1, 1, " "), (1, 1, 2, "b"), (1, 2, 0, None)],
                  "document_id int, slide int, shape_no int, text string")
    got = {r["slide"]: r["text"] for r in P.slide_pages(slides).collect()}
    assert got == {1: "[Slide 1]\na\nb", 2: "[Slide 2 - No text]"}


def test_legibility(spark, rows):
    docs = rows([(1,), (2,), (3,)], "document_id int")
    scores = rows([(1, 90.0), (1, 120.0), (2, 50.0)], "document_id int, score double")
    got = {r["document_id"]: r for r in P.legibility(docs, scores).collect()}
    assert got[1]["is_legible"] and got[1]["warnings"] == []
    assert got[2]["warnings"] == ["Low legibility detected (score: 50.00)"]
    assert got[3]["warnings"] == ["Low legibility detected (score: 0.00)", "Document has no pages"]


def test_keyword_in_context(spark, rows):
    words = [f"w{i}" for i in range(200)]
    words[100] = "Secret,"
    words[199] = "part number"
    df = rows([(1, " ".join(words))], "document_id int, text string")
    got = {r["keyword"]: r for r in P.keyword_in_context(df, ["secret", "part number"]).collect()}
    assert got["secret"]["position"] == 100
    assert got["secret"]["context_window"].split() == " ".join(words).split()[50:151]
    assert got["part number"]["position"] == 199
