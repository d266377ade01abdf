"""Hybrid search: correction, four retrievers, fusion; a batch of queries in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.vectors import hashed_embedding
from ..operators import bm25, fusion, rewrite
from ..operators.dense import dense_search, matches_any
from ..operators.graph import cut_lineage

PARAGRAPHS, CHAPTERS, TOP = 20, 5, 10
PREFIX = "Represent this sentence for searching relevant passages: "


@dataclass
class Index:
    """What searches read, each from the unfiltered corpus: chunks(id, pos, chunk_type, text, characters, ...).

    Without embedding in chunks their texts are encoded by each search, without postings texts are
    searched themselves: for one batch of queries, of which nothing is to be kept.
    """

    chunks: DataFrame
    postings: dict[str, DataFrame] | None
    vocab: DataFrame


def build_index(chunks: DataFrame, encode=hashed_embedding) -> Index:
    """Postings of either granularity, the vocabulary, and vectors where chunks has none."""
    if "embedding" not in chunks.columns:
        chunks = chunks.withColumn("embedding", encode(F.col("text")))
    postings = {k: bm25.build_postings(chunks.filter(F.col("chunk_type") == k)) for k in ("paragraph", "chapter")}
    return Index(chunks, postings, rewrite.vocabulary(chunks))


def dense(index: Index, queries: DataFrame, kind: str, k: int, wanted: list[str] | None = None, encode=hashed_embedding, prefix: str = PREFIX) -> DataFrame:
    """Top k by cosine of prefixed queries (passages are encoded without); characters filter before."""
    rows = index.chunks.filter((F.col("chunk_type") == kind) & matches_any("characters", wanted))
    asked = queries.select("query_id", encode(F.concat(F.lit(prefix), F.col("text"))).alias("embedding"))
    vector = F.col("embedding") if "embedding" in rows.columns else encode(F.col("text")).alias("embedding")
    return dense_search(rows.select("id", "pos", vector), asked, k)


def sparse(index: Index, queries: DataFrame, kind: str, k: int, wanted: list[str] | None = None, exact: bool = False) -> DataFrame:
    """Top k by BM25; characters filter after a larger fetch (before, if exact)."""
    if index.postings:
        return bm25.search_filtered(index.postings[kind], queries, k, index.chunks, wanted, exact)
    rows = index.chunks.filter(F.col("chunk_type") == kind)
    if not wanted:
        return bm25.search_texts(rows, queries, k)
    return bm25.search_filtered(bm25.build_postings(rows), queries, k, index.chunks, wanted, exact)


def hybrid_search(index: Index, queries: DataFrame, paragraphs: int = PARAGRAPHS, chapters: int = CHAPTERS, top: int = TOP, wanted: list[str] | None = None, encode=hashed_embedding, payload: tuple[str, ...] = (), correct: bool = True) -> tuple[DataFrame, DataFrame]:
    """(results(query_id, rank, id, score, payload), queries as rewritten). An empty query is a ValueError.

    All four retrievers see the rewritten query. Their lists are united in a fixed
    order: dense and sparse paragraphs, dense and sparse chapters.
    """
    if not queries.filter(F.col("text").isNull() | (F.length(strip(F.col("text"))) == 0)).isEmpty():
        raise ValueError("a query is empty")
    asked = rewrite.rewrite(queries, index.vocab) if correct else queries.select("query_id", F.array_join(bm25.tokens(F.col("text")), " ").alias("rewritten"), F.array().cast("array<struct<typo:string,fix:string>>").alias("corrections"))
    asked = cut_lineage(asked)
    seen = asked.select("query_id", F.col("rewritten").alias("text"))
    lists = [f(index, seen, kind, k, wanted, **more) for kind, k in (("paragraph", paragraphs), ("chapter", chapters)) for f, more in ((dense, {"encode": encode}), (sparse, {}))]
    fused = fusion.reciprocal_rank_fusion(fusion.union_lists([x.select("query_id", "rank", "id") for x in lists]), top=top)
    if payload:
        fused = cut_lineage(fused)
        small = fused.limit(bm25.MOST_BROADCAST + 1).count() <= bm25.MOST_BROADCAST
        # payloads of hits only are moved
        fused = index.chunks.select("id", *payload).join(F.broadcast(fused) if small else fused, "id").select(*fused.columns, *payload)
    return fused, asked
