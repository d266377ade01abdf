"""Chapters from an outline and pages.

Shapes: outline (pos, level, title, page) in reading order, pages (page_num, text).
Windows over the outline are global on purpose: a chapter ends before the next
one starts in outline order, also across books. An outline has one row for each
chapter, so it is small whatever the number of pages; pages are joined to it by
page number and never pass a global window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ends_sentence, is_blank, parse_title, strip


def outline_ranges(outline: DataFrame, last_page: int, book_prefix: str) -> DataFrame:
    """(pos, book_num, chapter_num, chapter_title, page_start, page_end) of the chapter rows.

    A level-1 row whose title starts with book_prefix (any case) opens a book; other rows
    that parse as chapters belong to the latest one; those before any book are left out.
    """
    order = Window.orderBy("pos")
    book = (F.col("level") == 1) & F.startswith(F.lower("title"), F.lit(book_prefix.lower()))
    rows = outline.withColumn("book_num", F.sum(book.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_book", book).withColumn("_t", parse_title(F.col("title")))
    chapters = rows.filter(~F.col("_book") & F.col("_t").isNotNull() & (F.col("book_num") > 0))
    end = F.coalesce(F.lead("page").over(order) - 1, F.lit(last_page))
    return chapters.select("pos", F.col("book_num").cast("int").alias("book_num"), F.col("_t.num").alias("chapter_num"), F.col("_t.title").alias("chapter_title"), F.col("page").alias("page_start"), end.cast("int").alias("page_end"))


def book_titles(outline: DataFrame, book_prefix: str) -> DataFrame:
    """(book_num, title) of the rows that open a book."""
    book = (F.col("level") == 1) & F.startswith(F.lower("title"), F.lit(book_prefix.lower()))
    return outline.filter(book).select(F.row_number().over(Window.orderBy("pos")).alias("book_num"), "title")


def page_spans(ranges: DataFrame) -> DataFrame:
    """A row for each page of each range, so that pages meet chapters by an equi-join."""
    pages = F.when(F.col("page_start") <= F.col("page_end"), F.sequence("page_start", "page_end"))
    return ranges.select("*", F.explode(pages).alias("page_num"))


def assemble(ranges: DataFrame, pages: DataFrame) -> DataFrame:
    """ranges with the text of their pages; chapters without text are left out.

    Pages are stripped and blank ones skipped; a page follows the one before it after a
    blank line if that one ended a sentence, else after a blank.
    """
    full = pages.filter(~is_blank(F.col("text"))).select("page_num", F.col("text").alias("raw"))
    met = page_spans(ranges).join(full, "page_num")
    before = F.lag("raw").over(Window.partitionBy("pos").orderBy("page_num"))
    glue = F.when(before.isNull(), "").when(ends_sentence(before), "\n\n").otherwise(" ")
    lines = met.withColumn("piece", F.concat(glue, strip(F.col("raw"))))
    keys = ["pos", "book_num", "chapter_num", "chapter_title", "page_start", "page_end"]
    ordered = F.sort_array(F.collect_list(F.struct("page_num", "piece")))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), "").alias("text"))


def chapters_from_outline(outline: DataFrame, pages: DataFrame, last_page: int, book_prefix: str) -> DataFrame:
    return assemble(outline_ranges(outline, last_page, book_prefix), pages)


def by_book(chapters: DataFrame, titles: DataFrame) -> DataFrame:
    """One row for each book: book_num, title (``Book n`` without one), chapters in order."""
    fields = ["chapter_num", "chapter_title", "page_start", "page_end", "text"]
    nested = chapters.groupBy("book_num").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("chapters"))
    named = nested.join(F.broadcast(titles), "book_num", "left")
    return named.select("book_num", F.coalesce("title", F.concat(F.lit("Book "), F.col("book_num").cast("string"))).alias("title"), "chapters")


def flatten_books(books: DataFrame) -> DataFrame:
    """The chapters of by_book again, with their places."""
    return books.select("book_num", F.posexplode("chapters").alias("chapter_pos", "c")).select("book_num", "chapter_pos", "c.*")


def accuracy(found: DataFrame, expected: DataFrame) -> DataFrame:
    """expected(book_num, chapter_num, page) with the found page and the drift between."""
    from ..functions.text import drift

    met = expected.join(found.select("book_num", "chapter_num", F.col("page_start").alias("found_page")), ["book_num", "chapter_num"], "left")
    return met.withColumn("drift", drift(F.col("found_page"), F.col("page")))
