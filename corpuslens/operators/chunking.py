"""Semantic chunks: a fold over the sentences of a chapter.

The fold is sequential (a cut resets the count and carries sentences over); chapters are
independent rows. ``fold`` says it as an ``aggregate`` over a chapter's sentence array, paragraph_chunks
does it where sentences are compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.memory import released
from ..functions.text import chunk_id, sentences, token_count
from ..functions.vectors import bag_vectors, dot
from .entities import tag_characters
from .graph import cut_lineage

THRESHOLD, LEAST, MOST, OVERLAP = 0.35, 100, 400, 1
KEYS = ["book_num", "chapter_num", "chapter_title", "page_start"]


def fold(parts: Column, threshold: float = THRESHOLD, least: int = LEAST, most: int = MOST, overlap: int = OVERLAP) -> Column:
    """array<string> of chunks from array<struct<s, n, like>> (sentence, tokens, likeness to the one before).

    A cut comes before a sentence that would exceed most tokens, or that is less alike
    to the one before than threshold when there are at least ``least`` tokens. Chunks hold the
    places of their sentences until the end, so that the fold moves numbers only.
    """
    empty = F.array().cast("array<array<int>>")
    start = F.struct(empty.alias("out"), F.array(F.lit(0)).alias("cur"), F.get(parts, F.lit(0))["n"].alias("n"))

    def step(acc: Column, i: Column) -> Column:
        nxt = F.get(parts, i)
        cut = (acc["n"] + nxt["n"] > most) | ((nxt["like"] < threshold) & (acc["n"] >= least))
        none = F.array().cast("array<int>")
        carried = none if overlap == 0 else F.when(F.size(acc["cur"]) <= overlap, acc["cur"]).otherwise(F.slice(acc["cur"], -overlap, overlap))
        moved = F.concat(carried, F.array(i))
        count = F.aggregate(moved, F.lit(0), lambda a, k: a + F.get(parts, k)["n"])
        after = F.struct(F.concat(acc["out"], F.array(acc["cur"])).alias("out"), moved.alias("cur"), count.alias("n"))
        more = F.struct(acc["out"].alias("out"), F.concat(acc["cur"], F.array(i)).alias("cur"), (acc["n"] + nxt["n"]).alias("n"))
        return F.when(cut, after).otherwise(more)

    rest = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    places = F.aggregate(rest, start, step, lambda acc: F.concat(acc["out"], F.array(acc["cur"])))
    texts = F.transform(places, lambda at: F.array_join(F.transform(at, lambda k: F.get(parts, k)["s"]), " "))
    return F.when(F.size(parts) > 0, texts).otherwise(F.array().cast("array<string>"))


def sentence_parts(chapters: DataFrame, encode: Callable[[list[str]], np.ndarray] = bag_vectors) -> DataFrame:
    """chapters with parts: array<struct<s, n, like>>.

    encode maps a chapter's sentences to rows of length 1, as a sentence encoder would.
    Only likenesses of neighbours leave the worker, not the vectors.
    """
    split = chapters.withColumn("_s", sentences(F.col("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            likes = []
            for s in b.column("_s"):
                v = encode(s.as_py()) if len(s) else np.zeros((0, 1))
                likes.append([0.0, *(v[1:] * v[:-1]).sum(1).tolist()] if len(v) else [])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(likes, pa.list_(pa.float64()))], [*b.schema.names, "_like"])

    fields = ", ".join(f"`{n}` {t}" for n, t in split.dtypes)
    with_likes = split.mapInArrow(run, f"{fields}, `_like` array<double>")
    part = lambda s, x: F.struct(s.alias("s"), token_count(s).alias("n"), x.alias("like"))
    return with_likes.withColumn("parts", F.zip_with("_s", "_like", part)).drop("_s", "_like")


def paragraph_chunks(chapters: DataFrame, encode: Callable[[list[str]], np.ndarray] = bag_vectors, threshold: float = THRESHOLD, least: int = LEAST, most: int = MOST, overlap: int = OVERLAP) -> DataFrame:
    """The paragraph chunks of each chapter, as fold has them of sentence_parts; only texts of chunks leave the worker.

    encode maps sentences of several chapters to rows of length 1.
    """
    split = chapters.select(*KEYS, sentences(F.col("text")).alias("_s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, 256):
                part = b.slice(low, 256)
                chapters = part.column("_s").to_pylist()
                flat = [s for own in chapters for s in own]
                v = encode(flat) if flat else np.zeros((0, 1))
                likes, n = [0.0, *(v[1:] * v[:-1]).sum(1).tolist()], [len(s.split()) for s in flat]
                texts, first = [], 0
                for own in chapters:
                    last = first + len(own)
                    texts.append([" ".join(own[k] for k in at) for at in _folded(n[first:last], likes[first:last], threshold, least, most, overlap)])
                    first = last
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.list_(pa.string()))], [*part.schema.names[:-1], "_t"])

    fields = ", ".join(f"`{n}` {t}" for n, t in split.dtypes if n != "_s")
    rows = split.mapInArrow(released(run), f"{fields}, `_t` array<string>").select(*KEYS, F.lit("paragraph").alias("chunk_type"), F.posexplode("_t").alias("chunk_index", "text"))
    return rows.withColumn("id", _id())


def _folded(n: list[int], likes: list[float], threshold: float, least: int, most: int, overlap: int) -> list[list[int]]:
    """fold's places of sentences, from their tokens and likenesses."""
    if not n:
        return []
    out, cur, size = [], [0], n[0]
    for i in range(1, len(n)):
        if size + n[i] > most or (likes[i] < threshold and size >= least):
            out.append(cur)
            cur = [*(cur[-overlap:] if overlap else []), i]
            size = sum(n[k] for k in cur)
        else:
            cur.append(i)
            size += n[i]
    return [*out, cur]


def chapter_chunks(chapters: DataFrame) -> DataFrame:
    """A chunk of each chapter's whole text."""
    rows = chapters.select(*KEYS, F.lit("chapter").alias("chunk_type"), F.lit(0).alias("chunk_index"), "text")
    return rows.withColumn("id", _id())


def _id() -> Column:
    return chunk_id(F.col("book_num"), F.col("chapter_num"), F.col("chunk_index"), F.col("chunk_type"))


def chunk_chapters(chapters: DataFrame, encode: Callable[[list[str]], np.ndarray] = bag_vectors, threshold: float = THRESHOLD, least: int = LEAST, most: int = MOST, overlap: int = OVERLAP, people: DataFrame | None = None) -> DataFrame:
    """One chapter chunk and the paragraph chunks of each chapter, with deterministic ids.

    Columns: id, book_num, chapter_num, chapter_title, text, chunk_type, chunk_index, page_start; with people (entities),
    also characters: the ids of those that a chunk names.
    """
    chunks = chapter_chunks(chapters).unionByName(paragraph_chunks(chapters, encode, threshold, least, most, overlap))
    if people is None:
        return chunks
    chunks = cut_lineage(chunks)
    return chunks.join(tag_characters(chunks, people), "id")


def adjacent_cosine(vectors: DataFrame, order: str = "pos", partition: str | None = None) -> DataFrame:
    """Each vector's likeness to the one before it."""
    from pyspark.sql import Window

    w = (Window.partitionBy(partition) if partition else Window).orderBy(order)
    return vectors.withColumn("_before", F.lag("embedding").over(w)).withColumn("cosine", F.when(F.col("_before").isNotNull(), dot(F.col("_before"), F.col("embedding")))).drop("_before")
