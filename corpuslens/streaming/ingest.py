"""Continuous ingest: new documents become chunks and postings batch by batch.

An extra: ids are deterministic, so a repeated batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.bm25 import term_counts
from ..operators.chunking import chunk_chapters
from ..sources.sinks import upsert


def ingest(stream: DataFrame, chunks_path: str, terms_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts a query over a stream of chapters (book_num, chapter_num, chapter_title, page_start, text)."""

    def batch(rows: DataFrame, _: int) -> None:
        spark = rows.sparkSession
        chunks = chunk_chapters(rows).persist()
        upsert(spark, chunks_path, chunks)
        counts = term_counts(chunks.withColumn("pos", F.xxhash64("id"))).withColumn("key", F.concat_ws("/", "id", "token"))
        upsert(spark, terms_path, counts, "key")
        chunks.unpersist()

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
