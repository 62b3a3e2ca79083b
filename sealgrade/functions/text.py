"""Pagination, assembly and lookup expressions over one document's text.

All are plain Column expressions, so they stay in one projection: no shuffle, no
Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sealgrade import vocab as V


def is_blank(text: Column) -> Column:
    return F.coalesce(~text.rlike(r"(?U)\S"), F.lit(True))


def strip(text: Column) -> Column:
    """Drop white space (not just blanks) at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def word_count(text: Column) -> Column:
    """Number of white-space separated words."""
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def char_pages(text: Column, size: int = V.PAGE_CHARS) -> Column:
    """Slices of ``size`` characters; blank text gives one ``[Empty file]`` page.

    One pass of the regular expression; slicing by offset would walk the text
    from its start for each page.
    """
    return F.when(is_blank(text), F.array(F.lit("[Empty file]"))).otherwise(
        F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{size}}}"), F.lit(0))
    )


def line_pages(lines: Column, per_page: int = V.PAGE_LINES) -> Column:
    """``per_page`` lines per page, joined by line feeds.

    ``lines`` must be a column, not an expression: it is read once per page.
    """
    starts = F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / per_page).cast("int"))
    return F.transform(
        starts, lambda i: F.array_join(F.slice(lines, i * per_page + 1, F.lit(per_page)), "\n")
    )


_FOLD = "struct<pages:array<string>,open:array<string>,used:int,fresh:int>"


def _empty_fold() -> Column:
    return F.struct(
        F.array().cast("array<string>").alias("pages"),
        F.array().cast("array<string>").alias("open"),
        F.lit(0).alias("used"),
        F.lit(0).alias("fresh"),
    ).cast(_FOLD)


def _fold_state(pages: Column, open_: Column, used: Column, fresh: Column) -> Column:
    return F.struct(
        pages.alias("pages"), open_.alias("open"), used.alias("used"), fresh.alias("fresh")
    ).cast(_FOLD)


def paragraph_pages(paragraphs: Column, words: int = V.PAGE_WORDS, overlap: int = 0) -> Column:
    """Greedy pages over ``array<struct<text, is_table>>``.

    A page closes once its paragraphs hold ``words`` words. Table text joins the
    page without being counted; blank paragraphs are dropped; there is always one
    page. With ``overlap``, a page starts with the last paragraphs of the one
    before, which are not counted.
    """

    def step(acc: Column, item: Column) -> Column:
        text = F.when(item["is_table"], item["text"]).otherwise(strip(item["text"]))
        skip = ~item["is_table"] & (F.length(text) == 0)
        grown = F.concat(acc["open"], F.array(text))
        used = acc["used"] + F.when(item["is_table"], F.lit(0)).otherwise(word_count(text))
        full = ~item["is_table"] & (used >= words)
        kept = (
            F.slice(grown, F.greatest(F.size(grown) - overlap + 1, F.lit(1)), F.lit(overlap))
            if overlap
            else F.array().cast("array<string>")
        )
        return (
            F.when(skip, acc)
            .when(
                full,
                _fold_state(
                    F.concat(acc["pages"], F.array(F.array_join(grown, "\n"))),
                    kept, F.lit(0), F.lit(0),
                ),
            )
            .otherwise(_fold_state(acc["pages"], grown, used, acc["fresh"] + 1))
        )

    def finish(acc: Column) -> Column:
        pages = F.when(
            acc["fresh"] > 0,
            F.concat(acc["pages"], F.array(F.array_join(acc["open"], "\n"))),
        ).otherwise(acc["pages"])
        return F.when(F.size(pages) == 0, F.array(F.lit("[No text content found]"))).otherwise(pages)

    return F.aggregate(paragraphs, _empty_fold(), step, finish)


def line_budget_pages(
    paragraphs: Column, lines: int = V.PAGE_LINES, line_chars: int = V.LINE_CHARS
) -> Column:
    """Pages of paragraphs that cost ``max(1, length // line_chars)`` lines each.

    A paragraph that would overflow the budget opens the next page.
    """

    def step(acc: Column, item: Column) -> Column:
        text = strip(item)
        cost = F.greatest(F.lit(1), F.floor(F.length(text) / line_chars).cast("int"))
        overflow = (acc["used"] + cost > lines) & (F.size(acc["open"]) > 0)
        return (
            F.when(F.length(text) == 0, acc)
            .when(
                overflow,
                _fold_state(
                    F.concat(acc["pages"], F.array(F.array_join(acc["open"], "\n"))),
                    F.array(text), cost, F.lit(1),
                ),
            )
            .otherwise(
                _fold_state(
                    acc["pages"], F.concat(acc["open"], F.array(text)), acc["used"] + cost, F.lit(1)
                )
            )
        )

    def finish(acc: Column) -> Column:
        return F.when(
            F.size(acc["open"]) > 0,
            F.concat(acc["pages"], F.array(F.array_join(acc["open"], "\n"))),
        ).otherwise(acc["pages"])

    return F.aggregate(paragraphs, _empty_fold(), step, finish)


def table_line(cells: Column) -> Column:
    """One table row as text: nulls become empty cells."""
    return F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), " | ")


def row_is_empty(cells: Column) -> Column:
    return ~F.exists(cells, lambda c: F.length(F.coalesce(c, F.lit(""))) > 0)


def combine_pages(pages: Column) -> Column:
    """All pages in one text, each under a ``Page n:`` line."""
    return F.array_join(
        F.transform(
            pages,
            lambda page, i: F.concat(
                F.lit("Page "), (i + 1).cast("string"), F.lit(":\n"), F.coalesce(page, F.lit(""))
            ),
        ),
        V.PAGE_BREAK,
    )


_BLOCK = "array<struct<type:string,text:string>>"


def content_blocks(pages: Column, image_count: Column, max_images: int | None = None) -> Column:
    """The block list handed to a scorer: one text block and a block for each image; with ``max_images``
    at most so many, and a note when more images exist. Image bytes stay where they
    are; an image block carries its index as text."""
    text = F.when(
        F.size(pages) > 0,
        F.array(F.struct(
            F.lit("text").alias("type"),
            F.concat(F.lit(V.TEXT_BLOCK_HEAD), combine_pages(pages)).alias("text"),
        )),
    ).otherwise(F.array())
    shown = image_count if max_images is None else F.least(image_count, F.lit(max_images))
    images = F.when(
        shown > 0,
        F.transform(
            F.sequence(F.lit(0), shown - 1),
            lambda i: F.struct(F.lit("image").alias("type"), i.cast("string").alias("text")),
        ),
    ).otherwise(F.array())
    if max_images is None:
        return F.concat(text.cast(_BLOCK), images.cast(_BLOCK))
    note = F.when(
        image_count > max_images,
        F.array(F.struct(
            F.lit("text").alias("type"),
            F.format_string(
                "\n\nNote: This document contains %d images, but only the first "
                f"{max_images} are shown due to API limitations.",
                image_count,
            ).alias("text"),
        )),
    ).otherwise(F.array())
    return F.concat(text.cast(_BLOCK), images.cast(_BLOCK), note.cast(_BLOCK))


def content_preview(
    blocks: Column, max_blocks: int | None = None, chars: int | None = None
) -> Column:
    """Text of the text blocks; of the first ``max_blocks`` and cut at ``chars``
    where a caller wants that."""
    some = blocks if max_blocks is None else F.slice(blocks, 1, max_blocks)
    text = F.array_join(F.transform(F.filter(some, lambda b: b["type"] == "text"), lambda b: b["text"]), "")
    return text if chars is None else F.substring(text, 1, chars)


def locate_segments(full_text: Column, segments: Column, limit: int | None = None, last_page: int | None = None) -> Column:
    """Give raw model segments their place in the text.

    Found: offsets of the first occurrence and page ``start // 2000 + 1``. Not found: start ``index * 100``, end 0, page 1. Found but empty: end
    ``index * 100 + 50``. All segments are placed; ``limit`` and ``last_page`` bound their number and
    pages where a caller wants that.
    """

    def place(seg: Column, i: Column) -> Column:
        text = F.coalesce(seg["text"], F.lit(""))
        start = F.when(F.length(text) == 0, F.lit(0)).otherwise(F.instr(full_text, text) - 1)
        end = F.when(start >= 0, start + F.length(text)).otherwise(F.lit(0))
        return F.struct(
            text.alias("text"),
            F.coalesce(seg["classification"], F.lit("Public")).alias("classification"),
            F.coalesce(seg["confidence"], F.lit(0.5)).alias("confidence"),
            F.when(start >= 0, F.least(F.floor(start / V.PAGE_CHARS).cast("int") + 1, F.lit(last_page).cast("int")))
            .otherwise(F.lit(1)).alias("page"),
            F.when(start >= 0, start).otherwise(i * 100).alias("start_char"),
            F.when(end > start, end).otherwise(i * 100 + 50).alias("end_char"),
            F.coalesce(seg["keywords"], F.array().cast("array<string>")).alias("keywords"),
            F.coalesce(seg["reasoning"], F.lit("")).alias("reasoning"),
        )

    return F.transform(segments if limit is None else F.slice(segments, 1, limit), place)


def keyword_union(*keyword_arrays: Column) -> Column:
    """Distinct keywords of several ``array<array<string>>`` columns, sorted."""
    empty = F.array().cast("array<array<string>>")
    some = F.concat(*[F.coalesce(a, empty) for a in keyword_arrays])
    flat = F.flatten(F.filter(some, lambda a: a.isNotNull()))
    return F.array_sort(F.array_distinct(F.filter(flat, lambda k: k.isNotNull())))


def tokens(text: Column) -> Column:
    """White-space separated words as an array."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))


def keyword_windows(words_: Column, keyword: str, radius: int = 50) -> Column:
    """Each hit of ``keyword`` with ``radius`` words on both sides, as
    ``array<struct<position, context_window>>``; ``position`` counts words from 0.

    ``words_`` must be a column, not an expression: it is read once per word.
    """
    width = len(keyword.split())
    key = keyword.lower()

    def candidate(token: Column, i: Column) -> Column:
        span = token if width == 1 else F.array_join(F.slice(words_, i + 1, F.lit(width)), " ")
        return F.struct(i.alias("i"), F.lower(span).contains(key).alias("hit"))

    hits = F.filter(F.transform(words_, candidate), lambda c: c["hit"])
    return F.transform(
        hits,
        lambda c: F.struct(
            c["i"].alias("position"),
            F.array_join(
                F.slice(
                    words_,
                    F.greatest(c["i"] - radius, F.lit(0)) + 1,
                    F.least(c["i"], F.lit(radius)) + width + radius,
                ),
                " ",
            ).alias("context_window"),
        ),
    )


def words(text: Column, longer_than: int = 0) -> Column:
    """Lower-cased words (letters, digits, underscore) longer than ``longer_than``."""
    found = F.regexp_extract_all(F.lower(text), F.lit(V.WORD), F.lit(0))
    return F.filter(found, lambda w: F.length(w) > longer_than) if longer_than else found
