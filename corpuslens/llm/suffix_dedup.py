"""Removal of repeated substrings by column-wise suffix sorting of a collection.

A byte goes if it lies in a ``length``-byte string that also starts in a document
with a smaller doc_id. Three passes, none of which holds the corpus:

1. *Anchors*. Of each window of ``length`` bytes the q-gram of least hash (the
   rightmost of equals) is selected. Equal windows select at the same place, so a
   repeated string has an anchor that repeats. Tasks deal out the hashes of their
   anchors, packed; an anchor that only one document has is out.
2. *Sorting*. Each occurrence of a repeated anchor gives a fixed-width segment: the
   anchor and as many bytes on either side as a window with it can reach. Segments
   are dealt out by anchor, and each bounded bucket is a collection in which one
   symbol per segment is inserted a round, from the last column to the first. The
   symbols in front of the sorted suffixes (the collection's Burrows-Wheeler
   column) stably order the next round, and a common prefix is one more than the
   least common prefix between the two places before. Order and common prefixes go
   through sequential files from round to round. From round ``length`` on, runs
   with common prefixes of ``length`` or more are equal windows; all but those of
   their smallest doc_id are covered.
3. *Assembly*. Covered runs are written to the checkpoint folder, what was shuffled to
   find them is given back, and then they are united per document.

Skew: a task keeps, of equal segments, only those of their smallest document and
decides the others by itself. Anchors with more occurrences than a bucket should
hold are dealt out by whole window instead of by anchor, again after the task kept
only the smallest document's of each window; the windows are sorted by the same rounds. Their list is
broadcast; by the choice of the threshold it has at most ``HOT_PER_BUCKET`` entries a bucket.
Buckets grow in number with the bytes that are read. Round files lie in a task's own folder and go with
it; a task that is lost makes them anew.

Null texts are empty; a null doc_id counts as larger than all others; rows that
share a doc_id don't cover each other; texts shorter than ``length`` lose nothing;
texts may be of any length; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import cut_lineage
from .common import buckets_of, byte_view, give_back, map_arrow, mix64, release, scrambled, slices

LENGTH, GRAM = 50, 24
#: Anchors and segments that a task holds at once; bits of the broadcast filter at most; least count of a hot anchor.
ANCHORS_HELD, HELD, BLOOM_BITS, HOT_LEAST, HOT_PER_BUCKET = 1_000_000, 100_000, 1 << 28, 4096, 100
LAST = 2**63 - 1
#: Bytes of input for each bucket.
BUCKET_BYTES = 16 << 20

_VALUE = scrambled(256, 0x736166)
_BASE = 0x9E3779B97F4A7C15


def rolling(data: np.ndarray, length: int) -> np.ndarray:
    """A polynomial hash of the length bytes from each place on, by doubling."""
    power = lambda n: np.uint64(pow(_BASE, n, 1 << 64))
    h, have, done, k = _VALUE[data], None, 0, 0
    while True:
        if length >> k & 1:
            have = h if have is None else have[: max(0, len(h) - done)] * power(1 << k) + h[done:]
            done += 1 << k
        if not length >> (k + 1):
            return mix64(have[: max(0, len(data) - length + 1)])
        h = h[: -(1 << k)] * power(1 << k) + h[1 << k :]
        k += 1


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span, cur = 1, x
    while span * 2 <= width:
        cur, span = np.minimum(cur[:-span], cur[span:]), span * 2
    n = len(x) - width + 1
    return np.minimum(cur[:n], cur[width - span : width - span + n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, 48-bit hashes) of the anchors of all texts of a buffer."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = rolling(data, gram)
    low = np.uint64(0xFFFFFFFF)
    key = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
    picked = (low - (sliding_min(key, length - gram + 1) & low)).astype(np.int64)
    # windows that run over the end of a text select nothing
    starts = np.zeros(len(data) + 1, np.int32)
    np.add.at(starts, offsets[:-1], 1)
    np.add.at(starts, np.maximum(offsets[1:] - length + 1, offsets[:-1]), -1)
    picked = picked[np.cumsum(starts)[: len(picked)] > 0]
    if not len(picked):
        return picked, np.zeros(0, np.uint64)
    # they never go back within a text, and those of texts are in order
    picked = picked[np.concatenate(([True], picked[1:] != picked[:-1]))]
    return picked, h[picked] >> np.uint64(16)


def pack48(h: np.ndarray) -> bytes:
    return (h & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + (h >> np.uint64(32)).astype(np.uint16).tobytes()


def unpack48(raw: bytes) -> np.ndarray:
    n = len(raw) // 6
    return np.frombuffer(raw, np.uint32, n).astype(np.uint64) | (np.frombuffer(raw, np.uint16, n, 4 * n).astype(np.uint64) << np.uint64(32))


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1]))) if len(sorted_values) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(sorted_values)))


def dealt(values: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    bucket = (mix64(values) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    for a, n in zip(*runs(bucket[order]), strict=True):
        yield int(bucket[order[a]]), order[a : a + n]


def filter_places(h: np.ndarray, bits: int) -> list[np.ndarray]:
    x = mix64(h + np.uint64(1))
    return [(x & np.uint64(bits - 1)).astype(np.int64), ((x >> np.uint64(32)) * np.uint64(0x9E3779B1) & np.uint64(bits - 1)).astype(np.int64)]


class Repeated:
    """Which anchors may repeat (a filter without false negatives), and which are hot."""

    def __init__(self, words: np.ndarray, hot: np.ndarray):
        self.words, self.hot = words, np.sort(hot)

    def may(self, h: np.ndarray) -> np.ndarray:
        ok = np.ones(len(h), bool)
        for p in filter_places(h, 64 * len(self.words)):
            ok &= (self.words[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1
        return ok

    def is_hot(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.zeros(len(h), bool)
        return self.hot[np.minimum(np.searchsorted(self.hot, h), len(self.hot) - 1)] == h


def repeated_anchors(docs: DataFrame, buckets: int, length: int, gram: int, hot_least: int, most_bits: int) -> Repeated:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        held = doc = 0

        def flush() -> pa.RecordBatch:
            h, d = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(h, kind="stable")
            h, d = h[order], d[order]
            starts, n = runs(h)
            many = d[starts] != d[starts + n - 1]  # documents come in order
            one, more, counts = h[starts[~many]], h[starts[many]], n[many].astype(np.uint32)
            rows = {b: [pack48(one[at]), b"", b""] for b, at in dealt(one, buckets)}
            for b, at in dealt(more, buckets):
                rows.setdefault(b, [b"", b"", b""])[1:] = [pack48(more[at]), counts[at].tobytes()]
            cols = list(zip(*rows.values(), strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), *(pa.array(c, pa.binary()) for c in cols)], ["bucket", "one", "more", "counts"])

        for b in batches:
            data, offsets = byte_view(b.column("text"))
            for i, j in slices(offsets, 1 << 20):
                offs = offsets[i : j + 1] - offsets[i]
                at, h = anchors(data[offsets[i] : offsets[j]], offs, length, gram)
                found.append((h, doc + np.searchsorted(offs, at, side="right")))
                doc, held = doc + j - i + 1, held + len(h)
                if held >= ANCHORS_HELD:
                    yield flush()
                    found, held = [], 0
        if found:
            yield flush()
        found = []
        release()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for one, more, counts in zip(*(b.column(c).to_pylist() for c in ("one", "more", "counts")), strict=True):
                ones = [unpack48(x) for x in one if x]
                many, n = [unpack48(x) for x in more if x], [np.frombuffer(x, np.uint32) for x in counts if x]
                h = np.concatenate([np.zeros(0, np.uint64), *ones, *many])
                w = np.concatenate([np.ones(sum(map(len, ones)), np.int64), *(x.astype(np.int64) for x in n)])
                order = np.argsort(h, kind="stable")
                h, w = h[order], w[order]
                starts, _ = runs(h)
                total = np.add.reduceat(w, starts) if len(starts) else w
                ok = total > 1  # in two blocks of documents, or in two documents of one
                yield pa.RecordBatch.from_arrays([pa.array(h[starts[ok]].view(np.int64)), pa.array(total[ok])], ["h", "n"])

    blobs = docs.select("text").mapInArrow(send, "bucket int, one binary, more binary, counts binary").groupBy("bucket").agg(*(F.collect_list(c).alias(c) for c in ("one", "more", "counts")))
    shared = cut_lineage(blobs.mapInArrow(meet, "h long, n long"))
    n, total = shared.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = min(most_bits, 1 << max(12, int(16 * max(n, 1)).bit_length()))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.unique(np.concatenate(filter_places(b.column("h").to_numpy().view(np.uint64), bits)))
            starts, _ = runs(p >> 6)
            masks = np.bitwise_or.reduceat(np.uint64(1) << (p & 63).astype(np.uint64), starts) if len(p) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(p[starts] >> 6), pa.array(masks.view(np.int64))], ["w", "m"])

    got = shared.select("h").mapInArrow(words, "w long, m long").groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[got.column("w").to_numpy()] = got.column("m").to_numpy().view(np.uint64)
    # at most HOT_PER_BUCKET anchors a bucket can have so many occurrences
    hot = shared.filter(F.col("n") >= max(hot_least, -(-int(total) // (HOT_PER_BUCKET * buckets)))).select("h").toArrow()
    return Repeated(table, hot.column("h").to_numpy().view(np.uint64))


class RoundFiles:
    """Order and common prefixes between two rounds, as sequential files.

    Each round writes over what the one before left, which has the same size: a file that is
    cut to nothing before it is written is flushed to disk by some file systems.
    """

    def __init__(self, folder: str):
        self.order, self.prefixes = (open(os.path.join(folder, x), "w+b") for x in ("order", "prefixes"))

    def __enter__(self) -> RoundFiles:
        return self

    def __exit__(self, *_: object) -> None:
        self.order.close()
        self.prefixes.close()

    def write(self, order: np.ndarray, prefixes: np.ndarray) -> None:
        for file, x in ((self.order, order), (self.prefixes, prefixes)):
            file.seek(0)
            file.write(x.data)

    def read(self) -> tuple[np.ndarray, np.ndarray]:
        self.order.seek(0)
        self.prefixes.seek(0)
        return np.frombuffer(self.order.read(), np.int32), np.frombuffer(self.prefixes.read(), np.uint8)


def range_min(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min of x[lo + 1 .. hi] for each pair (lo < hi)."""
    width = hi - lo
    level = np.frexp(width.astype(np.float64))[1] - 1
    out = np.empty(len(lo), x.dtype)
    cur, k = x, 0
    order = np.argsort(level.astype(np.uint8), kind="stable")
    starts, n = runs(level[order])
    for a, m in zip(starts, n, strict=True):
        at = order[a : a + m]
        while k < level[at[0]]:
            cur, k = np.minimum(cur[: -(1 << k)], cur[1 << k :]), k + 1
        out[at] = np.minimum(cur[lo[at] + 1], cur[hi[at] + 1 - (1 << k)])
    return out


def covered_windows(segments: np.ndarray, docs: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the columns of each segment that smaller documents cover; start = end: none.

    segments: one row of symbols each, of which columns low to high are of the text.
    """
    n, width = segments.shape
    columns = np.ascontiguousarray(segments.T)
    start, end = np.zeros(n, np.int32), np.zeros(n, np.int32)
    with tempfile.TemporaryDirectory() as folder, RoundFiles(folder) as files:
        files.write(np.arange(n, dtype=np.int32), np.zeros(n, np.uint8))
        for c in range(width - 1, -1, -1):
            order, prefix = files.read()
            symbols = columns[c][order]  # what stands before each sorted suffix
            perm = np.argsort(symbols, kind="stable")
            symbols, order = symbols[perm], order[perm]
            grown = np.zeros(n, np.uint8)
            same = np.flatnonzero(symbols[1:] == symbols[:-1])
            grown[same + 1] = range_min(prefix, perm[same], perm[same + 1]) + 1
            files.write(order, grown)
            if c > width - length:
                continue
            valid = (low[order] <= c) & (high[order] >= c + length)
            ids = np.where(valid, docs[order], LAST)
            first = grown < length
            first[0] = True
            at = np.flatnonzero(first)
            least = np.minimum.reduceat(ids, at)
            hit = order[valid & (ids > np.repeat(least, np.diff(np.append(at, n))))]
            end[hit] = np.maximum(end[hit], c + length)
            start[hit] = c
    return start, end


def united(keys: list[np.ndarray], start: np.ndarray, end: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Touching spans of equal keys as one."""
    if not len(start):
        return keys, start, end
    order = np.lexsort((end, start, *keys))
    keys, start, end = [k[order] for k in keys], start[order], end[order]
    other = np.zeros(len(start), bool)
    other[0] = True
    for k in keys:
        other[1:] |= k[1:] != k[:-1]
    group = np.cumsum(other)
    # the furthest end so far within a key, by lifting each key above those before
    lift = group.astype(np.int64) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift) - lift
    fresh = other.copy()
    fresh[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(fresh)
    return [k[at] for k in keys], start[at], np.maximum.reduceat(end, at)


_REPLY = "key long, mark long, start long, end long"


def _reply(doc: np.ndarray, mark: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    (doc, mark), start, end = united([doc, mark], start, end)
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (doc, mark, start, end)], ["key", "mark", "start", "end"])


def covered(docs: DataFrame, length: int, gram: int, hot_least: int, most_bits: int) -> DataFrame:
    """key, mark, start, end: covered runs of bytes of docs(key, mark, text), overlaps included."""
    buckets = buckets_of(docs, BUCKET_BYTES)
    shared = docs.sparkSession.sparkContext.broadcast(repeated_anchors(docs, buckets, length, gram, hot_least, most_bits))
    # what the first pass has shuffled goes before the second one writes
    give_back(docs.sparkSession)
    side = length - gram
    width = gram + 2 * side
    cols = ["bucket", "kind", "segments", "doc", "mark", "place"]

    def row(bucket: int, kind: int, segments: bytes, doc: np.ndarray, mark: np.ndarray, place: np.ndarray) -> tuple:
        return bucket, kind, segments, doc.astype(np.int64).tobytes(), mark.astype(np.uint32).tobytes(), place.astype(np.int64).tobytes()

    def local(order: np.ndarray, new: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Of things in groups that begin where new is set: whether the group has a smaller doc."""
        at = np.flatnonzero(new)
        least = np.minimum.reduceat(doc[order], at)
        out = np.empty(len(order), bool)
        out[order] = doc[order] > np.repeat(least, np.diff(np.append(at, len(order))))
        return out

    def flush(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        segments, h, doc, mark, place, low, high, hot = (np.concatenate(x) for x in zip(*found, strict=True))
        rows, known = [], []
        cold = np.flatnonzero(~hot)
        if len(cold):
            seg, d = segments[cold], doc[cold]
            words = np.zeros((len(cold), -(-width // 8)), np.uint64)
            words.view(np.uint8)[:, :width] = seg
            tag = mix64((mix64(words) * (scrambled(words.shape[1], 7) | np.uint64(1))).sum(1, dtype=np.uint64))
            order = np.lexsort((place[cold], d, tag, h[cold]))
            new = np.ones(len(order), bool)
            new[1:] = (words[order][1:] != words[order][:-1]).any(1) | (low[cold][order][1:] != low[cold][order][:-1]) | (high[cold][order][1:] != high[cold][order][:-1])
            sure = local(order, new, d)
            at = cold[sure]
            known.append((doc[at], mark[at], place[at] + low[at], place[at] + high[at]))
            rest = order[~sure[order]]
            at = cold[rest]
            for b, i in dealt(h[at], buckets):
                i = at[i]
                rows.append(row(b, 0, segments[i].tobytes(), doc[i], mark[i], place[i] * 65536 + low[i] * 256 + high[i]))
        warm = np.flatnonzero(hot)
        if len(warm):
            seg = segments[warm]
            total = np.zeros((len(warm), width + 1), np.uint64)
            up = np.cumprod(np.array([1] + [_BASE] * (width - 1), np.uint64))
            np.cumsum(_VALUE[seg] * up, axis=1, out=total[:, 1:])
            down = np.cumprod(np.array([1] + [pow(_BASE, -1, 1 << 64)] * side, np.uint64))
            c = np.arange(side + 1)
            tags = mix64((total[:, length : length + side + 1] - total[:, : side + 1]) * down)
            ok = (low[warm][:, None] <= c) & (high[warm][:, None] >= c + length)
            i, c = np.nonzero(ok)
            tag, d, m, p = tags[ok], doc[warm][i], mark[warm][i], place[warm][i] + c
            order = np.lexsort((p, d, tag))
            if len(order):
                # bytes of the windows, compared as they are; the hash only orders them and says where they go
                cut = np.lib.stride_tricks.sliding_window_view(seg, length, axis=1)[i, c]
                words = np.zeros((len(order), -(-length // 8)), np.uint64)
                words.view(np.uint8)[:, :length] = cut
                new = np.concatenate(([True], (words[order][1:] != words[order][:-1]).any(1)))
                sure = local(order, new, d)
                known.append((d[sure], m[sure], p[sure], p[sure] + length))
                rest = order[~sure[order]]
                # a window that two hot anchors share is sent once
                same = np.concatenate(([False], (words[rest][1:] == words[rest][:-1]).all(1) & (d[rest][1:] == d[rest][:-1]) & (m[rest][1:] == m[rest][:-1]) & (p[rest][1:] == p[rest][:-1])))
                rest = rest[~same]
                for b, i in dealt(tag[rest], buckets):
                    i = rest[i]
                    rows.append(row(b, 1, cut[i].tobytes(), d[i], m[i], p[i]))
        if known:
            d, m, s, e = (np.concatenate(x) for x in zip(*known, strict=True))
            (d, m), s, e = united([d, m], s, e)
            for b, i in dealt(d.astype(np.uint64), buckets):
                rows.append(row(b, 2, e[i].astype(np.int64).tobytes(), d[i], m[i], s[i]))
        data = list(zip(*rows, strict=True)) if rows else [()] * len(cols)
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(data, kinds, strict=True)], cols)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for b in batches:
            data, offsets = byte_view(b.column("text"))
            keys, marks = b.column("key").to_numpy(), b.column("mark").to_numpy()
            for i, j in slices(offsets, 1 << 20):
                offs = offsets[i : j + 1] - offsets[i]
                part = data[offsets[i] : offsets[j]]
                at, h = anchors(part, offs, length, gram)
                ok = shared.value.may(h)
                at, h = at[ok], h[ok]
                padded = np.concatenate((np.zeros(side, np.uint8), part, np.zeros(width, np.uint8)))
                view = np.lib.stride_tricks.sliding_window_view(padded, width)
                for a in range(0, len(at), HELD):
                    p, x = at[a : a + HELD], h[a : a + HELD]
                    d = np.searchsorted(offs, p, side="right") - 1
                    segments = view[p]  # its first column is the byte `side` before the anchor
                    low = np.maximum(0, offs[d] - (p - side))
                    high = np.minimum(width, offs[d + 1] - (p - side))
                    outside = (np.arange(width) < low[:, None]) | (np.arange(width) >= high[:, None])
                    segments = np.where(outside, np.uint8(0), segments)
                    found.append((segments, x, keys[i:j][d], marks[i:j][d], p - offs[d] - side, low, high, shared.value.is_hot(x)))
                    held += len(p)
                    if held >= HELD:
                        yield from flush(found)
                        found, held = [], 0
        if found:
            yield from flush(found)
        found = []
        release()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for kinds, segments, docs_, marks, places in zip(*(b.column(x).to_pylist() for x in cols[1:]), strict=True):
                join = lambda values, kind, k: np.frombuffer(b"".join(v for v, x in zip(values, kinds, strict=True) if x == k), kind)  # noqa: B023, E731
                parts = {k: (join(docs_, np.int64, k), join(marks, np.uint32, k), join(places, np.int64, k)) for k in range(3)}
                d, m, p = parts[0]
                if len(d):
                    seg = join(segments, np.uint8, 0).reshape(-1, width)
                    low, high = (p >> 8) & 255, p & 255
                    s, e = covered_windows(seg, d, low, high, length)
                    ok = e > s
                    base = p[ok] >> 16
                    yield _reply(d[ok], m[ok], base + s[ok], base + e[ok])
                d, m, p = parts[1]
                if len(d):
                    # segments of one window each, sorted and compared as the others are
                    seg = join(segments, np.uint8, 1).reshape(-1, length)
                    s, e = covered_windows(seg, d, np.zeros(len(d), np.int64), np.full(len(d), length), length)
                    ok = e > s
                    yield _reply(d[ok], m[ok], p[ok], p[ok] + length)
                d, m, p = parts[2]
                if len(d):
                    yield _reply(d, m, p, join(segments, np.int64, 2))
        release()

    blobs = docs.mapInArrow(send, "bucket int, kind int, segments binary, doc binary, mark binary, place binary")
    return blobs.groupBy("bucket").agg(*(F.collect_list(c).alias(c) for c in cols[1:])).mapInArrow(meet, _REPLY)


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_PA_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_least: int = HOT_LEAST, most_bits: int = BLOOM_BITS) -> DataFrame:
    """doc_id, n_bytes, removed (spans of bytes), kept (bytes) of every row."""
    if not 8 <= gram <= length <= 200:
        raise ValueError("8 <= gram <= length <= 200 is needed")
    text = F.coalesce(F.col("text"), F.lit(""))
    # the mark tells rows apart that share a doc_id
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("key"), (F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF))).alias("mark"), text.alias("text"))
    found = cut_lineage(covered(rows.select("key", "mark", "text"), length, gram, hot_least, most_bits))
    # segments go before texts are shuffled to meet their spans
    give_back(docs.sparkSession)
    found = found.groupBy("key", "mark").agg(F.collect_list(F.struct("start", "end")).alias("found"))

    def cut(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        size, removed, kept = [], [], []
        for text, spans in zip(batch.column("text").cast(pa.large_binary()), batch.column("found"), strict=True):
            raw, out, pieces, at = text.as_py(), [], [], 0
            flat = spans.values
            if flat is not None and len(flat):
                s, e = flat.field("start").to_numpy(), flat.field("end").to_numpy()
                _, s, e = united([np.zeros(len(s), np.int8)], s, e)
                for a, b in zip(s.tolist(), e.tolist(), strict=True):
                    out.append({"start": a, "end": b})
                    pieces.append(raw[at:a])
                    at = b
            pieces.append(raw[at:])
            size.append(len(raw))
            removed.append(out)
            kept.append(b"".join(pieces))
        return {"n_bytes": pa.array(size, pa.int64()), "removed": pa.array(removed, _PA_SPANS), "kept": pa.array(kept, pa.binary())}

    fields = [("n_bytes", T.LongType()), ("removed", _SPANS), ("kept", T.BinaryType())]
    return map_arrow(rows.join(found, ["key", "mark"], "left"), cut, fields, drop=("key", "mark", "text", "found"))
