"""Page tables, document metadata, legibility, keyword in context."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sealgrade import vocab as V
from sealgrade.functions import text as T


def explode_pages(df: DataFrame, pages: Column, keys: Sequence[str]) -> DataFrame:
    """One row per page, numbered from 1; nothing but the keys travels along."""
    return df.select(*keys, F.posexplode(pages).alias("pos", "text")).select(
        *keys, (F.col("pos") + 1).alias("page"), "text"
    )


def pages_by_chars(
    df: DataFrame, keys: Sequence[str], text: str = "text", size: int = V.PAGE_CHARS
) -> DataFrame:
    return explode_pages(df, T.char_pages(F.col(text), size), keys)


def pages_by_lines(
    df: DataFrame, keys: Sequence[str], text: str = "text", lines: int = V.PAGE_LINES
) -> DataFrame:
    split = df.select(*keys, F.split(F.col(text), "\n").alias("_lines"))
    return explode_pages(split, T.line_pages(F.col("_lines"), lines), keys)


def pages_by_words(
    df: DataFrame, keys: Sequence[str], paragraphs: str = "paragraphs",
    words: int = V.PAGE_WORDS, overlap: int = 0,
) -> DataFrame:
    """Pages of ``array<struct<text, is_table>>``; see ``paragraph_pages``."""
    return explode_pages(df, T.paragraph_pages(F.col(paragraphs), words, overlap), keys)


def pages_by_line_budget(
    df: DataFrame, keys: Sequence[str], paragraphs: str = "paragraphs",
    lines: int = V.PAGE_LINES, line_chars: int = V.LINE_CHARS,
) -> DataFrame:
    """Pages of ``array<string>``; see ``line_budget_pages``."""
    return explode_pages(df, T.line_budget_pages(F.col(paragraphs), lines, line_chars), keys)


def sheet_pages(
    rows: DataFrame, document: str = "document_id", sheet_no: str = "sheet_no",
    sheet: str = "sheet", row_no: str = "row_no", cells: str = "cells",
) -> DataFrame:
    """One page per sheet: its name, then each row that is not empty.

    A sheet is one page of text, so its rows meet in one value; the file formats
    bound a sheet at about a million rows. Empty rows are dropped before the
    shuffle, sheets without rows keep their header.
    """
    lines = rows.select(
        F.col(document).alias("document_id"), F.col(sheet_no).alias("sheet_no"),
        F.col(sheet).alias("sheet"),
        F.when(
            ~T.row_is_empty(F.col(cells)),
            F.struct(F.col(row_no).alias("n"), T.table_line(F.col(cells)).alias("line")),
        ).alias("row"),
    )
    grouped = lines.groupBy("document_id", "sheet_no", "sheet").agg(
        F.array_sort(F.collect_list("row")).alias("rows")
    )
    body = F.transform(F.col("rows"), lambda r: r["line"])
    head = F.array(F.concat(F.lit("[Sheet: "), F.col("sheet"), F.lit("]")))
    return grouped.select(
        "document_id", "sheet_no", F.array_join(F.concat(head, body), "\n").alias("text")
    )


def slide_pages(
    shapes: DataFrame, document: str = "document_id", slide: str = "slide",
    shape_no: str = "shape_no", text: str = "text",
) -> DataFrame:
    """One page per slide: ``[Slide n]`` and its non-blank shape texts."""
    parts = shapes.select(
        F.col(document).alias("document_id"), F.col(slide).alias("slide"),
        F.when(
            ~T.is_blank(F.col(text)),
            F.struct(F.col(shape_no).alias("n"), T.strip(F.col(text)).alias("t")),
        ).alias("shape"),
    )
    grouped = parts.groupBy("document_id", "slide").agg(
        F.array_sort(F.collect_list("shape")).alias("shapes")
    )
    body = F.array_join(F.transform(F.col("shapes"), lambda s: s["t"]), "\n")
    return grouped.select(
        "document_id", "slide",
        F.when(F.size("shapes") == 0, F.format_string("[Slide %s - No text]", F.col("slide").cast("string")))
        .otherwise(F.concat(F.format_string("[Slide %s]\n", F.col("slide").cast("string")), body))
        .alias("text"),
    )


def combined_text(df: DataFrame, pages: str = "pages") -> DataFrame:
    return df.withColumn("combined_text", T.combine_pages(F.col(pages)))


def with_preview(
    df: DataFrame, pages: str = "pages", image_count: str = "image_count", into: str = "preview",
    max_blocks: int | None = None, chars: int | None = None,
) -> DataFrame:
    blocks = T.content_blocks(F.col(pages), F.col(image_count))
    return df.withColumn("_blocks", blocks).withColumn(
        into, T.content_preview(F.col("_blocks"), max_blocks, chars)
    ).drop("_blocks")


def metadata(
    df: DataFrame, pages: str = "pages", filename: str = "filename",
    file_size: str = "file_size", image_count: str = "image_count",
) -> DataFrame:
    """Metadata of text formats, which are always legible."""
    suffix = F.regexp_extract(F.col(filename), r"\.([^.]*)$", 1)
    return df.select(
        "document_id", F.col(filename).alias("filename"), F.col(file_size).alias("file_size"),
        F.size(pages).alias("page_count"), F.col(image_count).alias("image_count"),
        F.lit(True).alias("is_legible"), F.lit(V.TEXT_LEGIBILITY).alias("legibility_score"),
        F.upper(suffix).alias("format"), F.array().cast("array<string>").alias("warnings"),
    )


def legibility(
    documents: DataFrame, scores: DataFrame, floor: float = V.MIN_LEGIBILITY,
    key: str = "document_id", score: str = "score",
) -> DataFrame:
    """Mean page score per document; a document without pages scores 0.

    Scores are averaged before the join, so a document with very many pages
    meets the join as one row.
    """
    means = scores.groupBy(key).agg(
        F.avg(score).alias("_mean"), F.count(score).alias("_pages")
    )
    mean, pages = F.coalesce("_mean", F.lit(0.0)), F.coalesce("_pages", F.lit(0))
    return documents.join(means, key, "left").select(
        *documents.columns,
        mean.alias("legibility_score"), pages.alias("scored_pages"),
        (mean >= floor).alias("is_legible"),
        F.array_compact(F.array(
            F.when(mean < floor, F.format_string("Low legibility detected (score: %.2f)", mean)),
            F.when(pages == 0, F.lit("Document has no pages")),
        )).alias("warnings"),
    )


def keyword_in_context(
    df: DataFrame, keywords: Sequence[str], keys: Sequence[str] = ("document_id",),
    text: str = "text", radius: int = 50,
) -> DataFrame:
    """One row per hit of each keyword with its surrounding words."""
    def named(keyword: str):
        return lambda w: F.struct(
            F.lit(keyword).alias("keyword"), w["position"].alias("position"),
            w["context_window"].alias("context_window"),
        )

    hits = F.flatten(F.array(*[
        F.transform(T.keyword_windows(F.col("_words"), k, radius), named(k)) for k in keywords
    ]))
    return (
        df.select(*keys, T.tokens(F.col(text)).alias("_words"))
        .select(*keys, F.inline(hits))
    )
