"""Document fingerprints by content-defined chunking.

A gear hash (a sum of table values of the last 32 bytes, each shifted by its
distance) is taken at every byte of a text. Chunk boundaries are normalised: from
``smallest`` bytes on, a boundary needs a hash whose ``strict`` top bits are zero;
beyond ``normal`` bytes the looser mask is enough; at ``largest`` bytes a chunk ends
anyway. As the hash depends on the last 32 bytes alone, boundaries return to their
places behind an insertion or deletion. A fingerprint is the sorted set of
(digest of a chunk, its length); likeness of two is the containment of the one
with less total length: shared length / lesser total length.

Null counts as empty; empty texts have an empty fingerprint, 1.0 alike to another
empty one and 0.0 to all others; equal texts have equal fingerprints. Texts may be of any length; repeated rows are
neighbours of each other; an empty table gives an empty result; other columns are ignored, or kept with
``keep``.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_view, map_arrow, scrambled, slices, strings

SMALLEST, NORMAL, LARGEST, STRICT_BITS, LOOSE_BITS = 32, 64, 256, 7, 4
_GEAR = (scrambled(256, 0x6765617268617368) >> np.uint64(32)).astype(np.uint32)
_DIGEST_BYTES = 5
#: Rows of a bucket of neighbours in the query over edited texts.
BUCKET_ROWS = 16_384


def gear(data: np.ndarray) -> np.ndarray:
    """The 32-bit gear hash that ends at each byte."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return h


def boundaries(offsets: np.ndarray, hashes: np.ndarray, smallest: int = SMALLEST, normal: int = NORMAL, largest: int = LARGEST, strict: int = STRICT_BITS, loose: int = LOOSE_BITS) -> list[list[int]]:
    """Ends of the chunks of each text, as places in the buffer of all texts."""
    loose_at = np.flatnonzero(hashes < (1 << (32 - loose)))
    strict_at = (loose_at[hashes[loose_at] < (1 << (32 - strict))] + 1).tolist()
    loose_at = (loose_at + 1).tolist()
    out, ls, ll = [], len(strict_at), len(loose_at)
    i = j = 0
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        ends = []
        while start < end:
            i = bisect_left(strict_at, start + smallest, i)
            cut = strict_at[i] if i < ls else end
            if cut >= start + normal:
                j = bisect_left(loose_at, start + normal, j)
                cut = min(loose_at[j] if j < ll else end, start + largest)
            start = min(cut, end)
            ends.append(start)
        out.append(ends)
    return out


def chunk_sets(texts: pa.Array) -> list[dict[bytes, int]]:
    """Of each text, digest -> length of its chunks."""
    data, offsets = byte_view(texts)
    out = []
    for i, j in slices(offsets):
        part, offs = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        raw = part.tobytes()
        for start, ends in zip(offs.tolist(), boundaries(offs, gear(part)), strict=False):
            chunks = {}
            for end in ends:
                chunks[hashlib.blake2b(raw[start:end], digest_size=_DIGEST_BYTES).digest()] = end - start
                start = end
            out.append(chunks)
    return out


def as_text(chunks: dict[bytes, int]) -> str:
    return ",".join(f"{d.hex()}:{n}" for d, n in sorted(chunks.items()))


def containment(a: dict[bytes, int], b: dict[bytes, int]) -> float:
    if not a or not b:
        return float(not a and not b)
    shared = sum(n for d, n in a.items() if d in b)
    return shared / min(sum(a.values()), sum(b.values()))


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and fingerprint per row."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {"fingerprint": pa.array(map(as_text, chunk_sets(batch.column(text))), pa.string())}

    return map_arrow(docs.select(*dict.fromkeys([*keep, text])), run, [("fingerprint", T.StringType())], () if text in keep else (text,))


def with_next(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, text and next_text: that of the next row by doc_id, then text (after the last: the first).

    Rows go to buckets of about bucket_rows consecutive ids, whose limits are ids
    themselves (a null id is before all); the row at a limit goes to the bucket
    before it as well, and the first row to the last bucket. So no sort is global,
    and a bucket's rows are read in order, never held together.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    n, least = rows.agg(F.count(F.lit(1)), F.min(key)).first()
    schema = T.StructType([rows.schema["doc_id"], T.StructField("text", T.StringType()), T.StructField("next_text", T.StringType())])
    if not n:
        return spark.createDataFrame([], schema)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // bucket_rows))
    limits = rows.select(key.alias("k")).agg(F.percentile_approx("k", [i / parts for i in range(1, parts)] or [0.5], 10 * parts)).first()[0]
    guess = spark.sparkContext.broadcast(np.unique(np.array(limits, np.int64)))

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = np.sort(b.column("k").to_numpy(zero_copy_only=False).astype(np.int64))
            bucket = np.searchsorted(guess.value, k, side="right")
            at = np.flatnonzero(np.diff(bucket, prepend=-1))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[at]), pa.array(k[at])], ["b", "k"])

    # percentiles are not exact beyond 53 bits: the least id of each bucket is its limit
    limits = sorted(r[0] for r in rows.select(key.alias("k")).mapInArrow(lowest, "b long, k long").groupBy("b").agg(F.min("k")).select("min(k)").collect())[1:]
    shared = spark.sparkContext.broadcast(np.array(limits, np.int64))  # one id for each bucket
    last = len(limits)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = shared.value
        for b in batches:
            k = np.array([-(2**63) if x is None else x for x in b.column("doc_id").to_pylist()], np.int64)
            bucket = np.searchsorted(edges, k, side="right").astype(np.int32)
            names = ["doc_id", "text", "bucket", "follows"]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(bucket), pa.array(np.zeros(len(k), np.int8))], names)
            first = np.isin(k, edges) if len(edges) else np.zeros(len(k), bool)
            for pick, to, mark in ((first, bucket - 1, 1), (k == least, np.full(len(k), last, np.int32), 2)):
                if pick.any():
                    at = pa.array(np.flatnonzero(pick))
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("text").take(at), pa.array(to[pick].astype(np.int32)), pa.array(np.full(int(pick.sum()), mark, np.int8))], names)

    dealt = rows.mapInArrow(deal, T.StructType([rows.schema["doc_id"], T.StructField("text", T.StringType()), T.StructField("bucket", T.IntegerType()), T.StructField("follows", T.ByteType())]))
    ordered = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "follows", "doc_id", "text")
    out_schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("next_text", pa.string())])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            out = []
            for doc, text, bucket, follows in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if held and held[2] == bucket and not held[3]:
                    out.append((held[0], held[1], text))
                held = (doc, text, bucket, follows)
            for i in range(0, len(out), 512):
                cols = list(zip(*out[i : i + 512], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out_schema, strict=True)], schema=out_schema)

    schema.fields[0] = T.StructField("doc_id", T.LongType())
    return ordered.mapInArrow(pair, schema)


def edited(text: str, following: str) -> str:
    """text with its last quarter of characters replaced by the first as many of following."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def compare_edits(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Of each row: its fingerprint, that of its edited text, and their likeness."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        own, nxt = strings(batch.column("text")), strings(batch.column("next_text"))
        cols: dict[str, list] = {k: [] for k in ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")}
        for i in range(0, len(own), 256):
            a, b = own.slice(i, 256), nxt.slice(i, 256)
            texts = a.to_pylist()
            changed = list(map(edited, texts, b.to_pylist()))
            for x, y, s, e, n in zip(texts, changed, chunk_sets(a), chunk_sets(pa.array(changed, pa.large_string())), chunk_sets(b), strict=True):
                cols["n_chars"].append(len(x))
                cols["edited_sha256"].append(hashlib.sha256(y.encode()).hexdigest())
                cols["fingerprint"].append(as_text(s))
                cols["edited_fingerprint"].append(as_text(e))
                cols["near_edited"].append(containment(s, e))
                cols["near_next"].append(containment(s, n))
        kinds = {"n_chars": pa.int64(), "near_edited": pa.float64(), "near_next": pa.float64()}
        return {k: pa.array(v, kinds.get(k, pa.string())) for k, v in cols.items()}

    fields = [("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()), ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType())]
    return map_arrow(with_next(docs, bucket_rows), run, fields, drop=("text", "next_text"))
