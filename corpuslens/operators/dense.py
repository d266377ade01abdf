"""Exact cosine search of a batch of query vectors against all vectors.

Vectors are of length 1. The query side is a stated set: it is gathered in blocks of a
bounded number of vectors, each of which goes to every task; a task keeps the k best of
its rows for each query, and only these are shuffled. So the corpus is read once for each
block, and what moves is k rows for each query and task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.memory import released
from .bm25 import top_k

#: Query vectors that are broadcast together.
BLOCK = 4096
#: Vectors whose scores are held against the best so far at once.
ROWS = 256


def matches_any(column: str, wanted: list[str] | None):
    """Rows whose list meets wanted; without wanted, all."""
    return F.arrays_overlap(column, F.array(*map(F.lit, wanted))) if wanted else F.lit(True)


def dense_search(vectors: DataFrame, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, id, pos, score) from vectors(id, pos, embedding) and queries(query_id, embedding)."""
    spark = vectors.sparkSession
    n = queries.count()
    blocks = max(1, -(-n // block))
    part = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    schema = f"query_id {dict(queries.dtypes)['query_id']}, id {dict(vectors.dtypes)['id']}, pos long, score double"
    out = None
    for b in range(blocks):
        rows = queries.filter(part == b).select("query_id", F.col("embedding").cast("array<double>").alias("embedding")).toArrow()
        if not rows.num_rows:
            continue
        matrix = np.array(rows.column("embedding").combine_chunks().flatten().to_numpy()).reshape(rows.num_rows, -1)
        shared = spark.sparkContext.broadcast((rows.column("query_id").combine_chunks(), matrix))

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            least = np.full(len(q), -np.inf)  # a query's k-th best score so far
            kept: list[pa.Table] = []
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                scores = v @ q.T
                for low in range(0, len(v), ROWS):
                    d, j = np.nonzero(~(scores[low : low + ROWS] < least))
                    if not len(d):
                        continue
                    at = pa.array(d + low)
                    kept.append(pa.table({"q": pa.array(j), "id": batch.column("id").take(at), "pos": batch.column("pos").take(at), "score": pa.array(scores[d + low, j])}))
                    if sum(map(len, kept)) > max(50_000, 2 * k * len(q)):
                        kept = [_best(pa.concat_tables(kept), k, least)]
            if kept:
                rows = _best(pa.concat_tables(kept), k, least)
                yield from pa.table({"query_id": ids.take(rows.column("q").combine_chunks()), **{c: rows.column(c) for c in ("id", "pos", "score")}}).combine_chunks().to_batches()

        found = vectors.select("id", F.col("pos").cast("long").alias("pos"), "embedding").mapInArrow(released(best), schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    return top_k(out, k)


def _best(rows: pa.Table, k: int, least: np.ndarray) -> pa.Table:
    """The k best rows of each query, whose k-th best scores go into least."""
    q, score = rows.column("q").to_numpy(), rows.column("score").to_numpy()
    order = np.lexsort((rows.column("pos").to_numpy(), -score, q))
    starts = np.flatnonzero(np.concatenate(([True], q[order][1:] != q[order][:-1])))
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    last = order[place == k - 1]
    least[q[last]] = score[last]
    return rows.take(pa.array(order[place < k])).combine_chunks()
