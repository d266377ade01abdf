"""Reports over pages, chapters and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, token_count


def page_summary(pages: DataFrame) -> DataFrame:
    """One row: pages, characters, blank pages."""
    return pages.agg(F.count(F.lit(1)).alias("n_pages"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n_chars"), F.count_if(is_blank(F.coalesce("text", F.lit("")))).alias("n_blank"))


def book_summary(chapters: DataFrame) -> DataFrame:
    return chapters.groupBy("book_num").agg(F.count(F.lit(1)).alias("n_chapters"), F.sum(F.length("text")).alias("n_chars"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """By chunk_type: chunks, least, mean (whole) and most tokens, share tagged (whole percent)."""
    n = token_count(F.col("text")).cast("long")
    return chunks.groupBy("chunk_type").agg(F.count(F.lit(1)).alias("n_chunks"), F.min(n).alias("least"), F.floor(F.sum(n) / F.count(F.lit(1))).alias("mean"), F.max(n).alias("most"), F.floor(100 * F.count_if(F.size("characters") > 0) / F.count(F.lit(1))).alias("tagged_percent"))


def accuracy_summary(checked: DataFrame) -> DataFrame:
    """One row: matched and expected pages of chapters.accuracy."""
    return checked.agg(F.count_if(F.col("drift") == "ok").alias("matched"), F.count(F.lit(1)).alias("expected"))
