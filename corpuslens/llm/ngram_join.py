"""N-gram Jaccard join: a grouped prefix join over sets of word shingles.

A document's set is its distinct ``size``-word shingles (64-bit hashes); with fewer
words, the whole sequence as one; without words it is empty. Two documents link if
100 * |intersection| >= percent * |union|. The result is the connected components
of that graph, exactly, without listing all pairs of a component:

1. *Equal sets*: documents of equal digest are one class.
2. *Screen*: linked sets share at least l of the first |x| - ceil(t|x|) + l hashes
   in hash order. A class of which fewer than l of these occur in another class
   links with nothing. Hashes are dealt out packed, by hash; a task that itself sees
   a hash in two classes sends a mark in place of the classes, so a hash that
   everybody has costs one entry for each task.
3. *Prefix*: the hashes of the classes left are ordered by a frequency sketch of
   bounded size (rare first), then by hash; two linked sets share one of their first
   |x| - ceil(t|x|) + 1.
4. *Blocks*: the least of a class's shared screening hashes, in two fixed scramblings, puts
   it into at most two blocks with classes that share it. A block of more than a bounded number
   of hashes is cut in parts at random, differently for the two. Each block is a
   bounded matrix product that gives all intersections in it; the links so found make the
   labels (components known so far) of step 5. A set so travels twice, not once for each pair.
5. *Groups*: classes with the same prefix and set size are one group. An inverted index of groups
   gives pairs of groups, filtered by size and position; lists whose groups all have
   one label are closed, and of those left, groups of the commonest label only meet the others.
6. *Parity maps*: bit b of a set's map is the parity of its hashes that fall on b, so two
   maps differ in no more bits than the sets differ in hashes. Pairs whose maps differ in more
   bits than linked sets may differ in hashes are never made, and a pair is made
   where its first shared hash of the prefix stands.
7. *Members*: group pairs are expanded to members with different labels, and these are verified.
   Pairs of the same two blocks are verified together, so each set goes there once. No link
   between labels is lost.

Null or wordless texts have an empty set and are components by themselves. Rows
with the same doc_id are judged by their texts; a null doc_id never is the smallest.
A text may be of any length: its set travels as one value. An empty table gives an empty result. Other
columns are ignored, or kept with ``keep``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components, cut_lineage
from .common import buckets_of, byte_view, map_arrow, mix64, release, scrambled, slices

SIZE, PERCENT = 4, 85
#: Counters of the frequency sketch and bits of the Bloom filter: bounds of what is broadcast.
SKETCH, BLOOM_BITS = 1 << 22, 1 << 28
#: Bits of a set's parity map, and how many of the preceding hashes of a prefix an index row carries.
PARITY_BITS, BEFORE = 1024, 8
#: Words of a map that index rows carry: the whole map folded, which is a map of fewer bits.
FOLDED = 4
#: Hashes that a screening task holds before it sends them on.
HELD = 1_000_000
#: Hashes of a block (a set counts as at least LEAST_WEIGHT), and columns of its matrix that are multiplied at once.
BLOCK_HASHES, LEAST_WEIGHT, COLUMNS = 1 << 18, 1 << 10, 1 << 13
#: Bytes of input for each bucket of the screen.
BUCKET_BYTES = 64 << 20

_SEPARATORS = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
_VALUE = scrambled(256, 0x776F7264)[_LOWER]
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BLOCK_SEEDS = scrambled(2, 0x626C6F63)
_TURN = scrambled(1024, 0x7368696E) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power(which: str, n: int) -> np.ndarray:
    """The first n powers of the base (or its inverse) modulo 2**64."""
    have = _powers.get(which)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 20), _BASE if which == "up" else _UNBASE, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps)
        if n <= 1 << 22:
            _powers[which] = have
    return have[:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each lower-cased word, number of words of each text)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~_SEPARATORS[data]
    fresh = np.zeros(n + 1, bool)
    fresh[offsets] = True
    starts = np.flatnonzero(inside & (fresh[:-1] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (fresh[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[data] * _power("up", n), out=total[1:])
    raw = (total[ends] - total[starts]) * _power("down", n)[starts]
    counts = np.diff(np.searchsorted(starts, offsets))
    return mix64(raw + (ends - starts).astype(np.uint64) * _BASE), counts


def shingle_sets(texts: pa.Array, size: int = SIZE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = byte_view(texts)
    for i, j in slices(offsets, 1 << 20):
        words, counts = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        m = max(0, len(words) - size + 1)
        grams = np.zeros(m, np.uint64)
        for k in range(size):
            grams += words[k : k + m] * _TURN[k]
        grams = mix64(grams)
        at = 0
        for c in counts.tolist():
            if c >= size:
                yield np.unique(grams[at : at + c - size + 1])
            elif c:
                whole = sum(int(w) * int(t) for w, t in zip(words[at : at + c], _TURN[512 + c * 8 :], strict=False))
                yield mix64(np.array([whole % (1 << 64)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
            at += c


def least_overlap(n, percent: int = PERCENT):
    """The least intersection of a set of size n with any set that it links with."""
    return -(-n * percent // 100)


def screen_need(n):
    """How many hashes of the screening prefix must be shared (monotone in n)."""
    return np.maximum(1, n // 10)


def _digest(hashes: np.ndarray) -> bytes:
    return hashlib.md5(hashes.tobytes(), usedforsecurity=False).digest()


def _key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little") | 1  # 0 stands for a mark


def sets_of(docs: DataFrame, size: int = SIZE, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, keep, digest and n_shingles of every row."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        sets = [(_digest(s), len(s)) for s in shingle_sets(batch.column("text"), size)]
        return {"digest": pa.array([x[0] for x in sets], pa.binary()), "n_shingles": pa.array([x[1] for x in sets], pa.int64())}

    return map_arrow(docs.select("doc_id", *keep, "text"), run, _fields("digest binary, n_shingles long"), drop=("text",))


def _fields(ddl: str) -> list:
    from pyspark.sql.types import _parse_datatype_string

    return [(f.name, f.dataType) for f in _parse_datatype_string(ddl).fields]


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of the runs of equal values."""
    starts = np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1]))) if len(sorted_values) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(sorted_values)))


def _shared_by_classes(tokens: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """tokens and keys, sorted and distinct, and whether a token has two keys or a mark."""
    order = np.lexsort((keys, tokens))
    tokens, keys = tokens[order], keys[order]
    first = np.ones(len(tokens), bool)
    first[1:] = (tokens[1:] != tokens[:-1]) | (keys[1:] != keys[:-1])
    tokens, keys = tokens[first], keys[first]
    starts, lengths = _runs(tokens)
    marked = keys[starts] == 0 if len(starts) else np.zeros(0, bool)
    return tokens, keys, np.repeat((lengths > 1) | marked, lengths)


_SCREENED = "key long, n long, m0 long, m1 long"


def _screened(tokens: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each key: itself, the number of its tokens, and the least of them in two scramblings, as rows of signed integers."""
    order = np.argsort(keys, kind="stable")
    tokens, keys = tokens[order], keys[order]
    starts, lengths = _runs(keys)
    least = [np.minimum.reduceat(mix64(tokens ^ seed), starts).view(np.int64) if len(starts) else starts for seed in _BLOCK_SEEDS]
    return np.stack([keys[starts].view(np.int64), lengths.astype(np.int64), *least])


def _screened_batch(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in rows], ["key", "n", "m0", "m1"])


def screen(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(key, n, m0, m1): how many of each class's screening hashes other classes share, and the least of those in two scramblings.

    A class of which a task holds several copies may be counted more than once,
    which only lets more classes pass.
    """
    buckets = buckets_of(docs, BUCKET_BYTES)
    packed = "bucket int, tokens binary, keys binary"

    def dealt(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        bucket = ((values >> np.uint64(7)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        for a, n in zip(*_runs(bucket[order]), strict=True):
            yield int(bucket[order[a]]), order[a : a + n]

    def send(tokens: list[np.ndarray], keys: list[int]) -> Iterator[pa.RecordBatch]:
        t, k, shared = _shared_by_classes(np.concatenate(tokens), np.repeat(np.array(keys, np.uint64), [len(x) for x in tokens]))
        own = _screened(t[shared], k[shared])
        marks = t[shared][_runs(t[shared])[0]]
        t, k = np.concatenate((t[~shared], marks)), np.concatenate((k[~shared], np.zeros(len(marks), np.uint64)))
        rows = [(bucket, t[at].tobytes(), k[at].tobytes()) for bucket, at in dealt(t)]
        # what this task counted itself travels as rows without tokens
        rows += [(bucket, b"", own[:, at].tobytes()) for bucket, at in dealt(own[0].view(np.uint64))]
        cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], ["bucket", "tokens", "keys"])

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, keys, held = [], [], 0
        for b in batches:
            for s in shingle_sets(b.column(0), size):
                n = len(s)
                if n:
                    x = s[: min(n, n - least_overlap(n, percent) + int(screen_need(n)))]
                    tokens.append(x)
                    keys.append(_key(_digest(s)))
                    held += len(x)
                if held >= HELD:
                    yield from send(tokens, keys)
                    tokens, keys, held = [], [], 0
        if tokens:
            yield from send(tokens, keys)
        tokens, keys = [], []
        release()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lists in zip(b.column("tokens").to_pylist(), b.column("keys").to_pylist(), strict=True):
                tokens, keys = [], []
                for t, k in zip(*lists, strict=True):
                    if t:
                        tokens.append(np.frombuffer(t, np.uint64))
                        keys.append(np.frombuffer(k, np.uint64))
                    else:
                        yield _screened_batch(np.frombuffer(k, np.int64).reshape(4, -1))
                if tokens:
                    t, k, shared = _shared_by_classes(np.concatenate(tokens), np.concatenate(keys))
                    shared &= k != 0
                    yield _screened_batch(_screened(t[shared], k[shared]))
        release()

    blobs = docs.select("text").mapInArrow(prefixes, packed).groupBy("bucket").agg(F.collect_list("tokens").alias("tokens"), F.collect_list("keys").alias("keys"))
    return blobs.mapInArrow(meet, _SCREENED).groupBy("key").agg(F.sum("n").alias("n"), F.min("m0").alias("m0"), F.min("m1").alias("m1"))


def bloom(ids: DataFrame, bits: int) -> np.ndarray:
    """A filter of so many bits over the column id (a null counts as 0)."""
    place = F.explode(F.array(*(F.pmod(F.xxhash64(F.coalesce("id", F.lit(0).cast("long")), F.lit(k)), F.lit(bits)) for k in (1, 2))))
    words = ids.select(place.alias("p")).groupBy((F.col("p") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("m"))
    got = words.toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[got.column("w").to_numpy()] = got.column("m").to_numpy().view(np.uint64)
    return out


def maybe_in(docs: DataFrame, ids: DataFrame, n: int, fn, ddl: str, most_bits: int = BLOOM_BITS) -> DataFrame:
    """fn of the texts of those rows whose doc_id may be among n ids; a filter of bounded size.

    It spares the join after it most rows; where there are more ids than it has room
    for, it lets more rows pass.
    """
    bits = min(most_bits, max(1 << 12, 1 << int(16 * max(n, 1)).bit_length()))
    shared = docs.sparkSession.sparkContext.broadcast(bloom(ids, bits))
    hashed = [F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(0).cast("long")), F.lit(k)), F.lit(bits)).alias(f"h{k}") for k in (1, 2)]
    names = [x for x, _ in _fields(ddl)]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = np.ones(b.num_rows, bool)
            for k in ("h1", "h2"):
                p = b.column(k).to_numpy().astype(np.int64)
                ok &= (shared.value[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1
            if ok.any():
                out = fn(b.column("text").take(pa.array(np.flatnonzero(ok))))
                yield pa.RecordBatch.from_arrays([out[x] for x in names], names)
        release()

    return docs.select("text", *hashed).mapInArrow(keep, ddl)


def frequency_sketch(sets: DataFrame, counters: int = SKETCH) -> np.ndarray:
    """Counts of hashes by hash modulo counters, of bounded size whatever the input."""
    parts = 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(counters, np.int64)
        for b in batches:
            for s in b.column("shingles"):
                at, n = np.unique((np.frombuffer(s.as_py(), np.uint64) % np.uint64(counters)).astype(np.int64), return_counts=True)
                total[at] += n
        for k, x in enumerate(np.split(total, parts)):
            at = np.flatnonzero(x)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([x[at].tobytes()], pa.binary())], ["part", "at", "n"])
        del total, x
        release()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, ats, ns in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                total = np.zeros(counters // parts, np.int64)
                for at, n in zip(ats, ns, strict=True):
                    total[np.frombuffer(at, np.int32)] += np.frombuffer(n, np.int64)
                coarse = np.ceil(4 * np.log2(total + 1)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([coarse.tobytes()], pa.binary())], ["part", "coarse"])

    summed = sets.select("shingles").mapInArrow(count, "part int, at binary, n binary").groupBy("part").agg(F.collect_list("at").alias("at"), F.collect_list("n").alias("n")).mapInArrow(add, "part int, coarse binary")
    out = np.zeros(counters, np.uint8)
    for part, coarse in summed.toLocalIterator():
        out[part * (counters // parts) : (part + 1) * (counters // parts)] = np.frombuffer(bytes(coarse), np.uint8)
    return out


def parity_map(hashes: np.ndarray, bits: int = PARITY_BITS) -> np.ndarray:
    """Bit b: the parity of the hashes that fall on b, as 64-bit words."""
    odd = np.bincount((hashes >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefix_index(sets: DataFrame, percent: int = PERCENT, counters: int = SKETCH) -> DataFrame:
    """id, n, block, gid (prefix and size), prefix (hashes that occur twice or more, with places) and parity map of each set."""
    shared = sets.sparkSession.sparkContext.broadcast(frequency_sketch(sets, counters))

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        gids, tokens, places, maps = [], [], [], []
        for s in batch.column("shingles"):
            s = np.frombuffer(s.as_py(), np.uint64)
            n = len(s)
            how_often = shared.value[(s % np.uint64(counters)).astype(np.int64)]
            order = np.lexsort((s, how_often))[: n - least_overlap(n, percent) + 1]
            gids.append(hashlib.md5(s[order].tobytes() + n.to_bytes(8, "little"), usedforsecurity=False).digest())
            # a counter of 1 (its coarse value is 4) has one hash of one set: nothing to meet
            kept = np.flatnonzero(how_often[order] > 4)
            tokens.append(s[order][kept].view(np.int64))
            places.append(kept.astype(np.int32))
            maps.append(parity_map(s))
        return {"gid": pa.array(gids, pa.binary()), "tokens": pa.array(tokens, pa.list_(pa.int64())), "places": pa.array(places, pa.list_(pa.int32())), "parity": pa.array(maps, pa.list_(pa.int64()))}

    return map_arrow(sets, run, _fields("gid binary, tokens array<long>, places array<int>, parity array<long>"), drop=("shingles",))


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, by products of bounded parts of the incidence matrix."""
    m = len(sets)
    both = np.zeros((m, m), np.float64)
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(tokens, kind="stable")
    starts, lengths = _runs(tokens[order])
    column = np.repeat(np.cumsum(lengths > 1) - 1, lengths)
    many = np.repeat(lengths > 1, lengths)  # the others only count for a set itself, which nobody asks for
    row, column = owner[order][many], column[many]
    at = 0
    while at < len(column):
        first = column[at]
        end = int(np.searchsorted(column, first + COLUMNS))
        part = np.zeros((m, column[end - 1] - first + 1), np.float32)
        part[row[at:end], column[at:end] - first] = 1
        both += part @ part.T
        at = end
    return both.astype(np.int64)


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Whether each pair of sets links (a set doesn't link with itself)."""
    n = np.array([len(s) for s in sets])
    both = intersections(sets)
    out = (both > 0) & (100 * both >= percent * (n[:, None] + n[None, :] - both))
    np.fill_diagonal(out, False)
    return out


def _by_block(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[list, ...]]:
    """Columns of the rows of each block, which come one after the other."""
    held: list[list] = [[] for _ in names]
    block = None
    for b in batches:
        blocks, cols = b.column("block").to_pylist(), [b.column(x) for x in names]
        for i, k in enumerate(blocks):
            if k != block and held[0]:
                yield tuple(held)
                held = [[] for _ in names]
            block = k
            for to, col in zip(held, cols, strict=True):
                to.append(col[i].as_py())
    if held[0]:
        yield tuple(held)


def _edges(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def block_links(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): links that span the components within each block of sets(id, blocks, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, shingles in _by_block(batches, ["id", "shingles"]):
            if len(ids) > 1:
                near = linked([np.frombuffer(s, np.uint64) for s in shingles], percent)
                label = np.arange(len(ids))
                while True:
                    least = np.minimum(label, np.where(near, label[None, :], len(ids)).min(1))
                    least = least[least]
                    if (least == label).all():
                        break
                    label = least
                at = np.flatnonzero(label != np.arange(len(ids)))
                yield _edges([ids[label[i]] for i in at], [ids[i] for i in at])
        release()

    dealt = sets.select("id", "shingles", F.explode("blocks").alias("block"))
    return dealt.repartition("block").sortWithinPartitions("block").mapInArrow(run, "a long, b long")


def verify(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of pairs(block, a, b) that link; block: that of all pairs of the same two blocks."""
    asked = pairs.groupBy("block", F.col("a").alias("id")).agg(F.collect_set("b").alias("others"))
    answering = pairs.select("block", F.col("b").alias("id"), F.array().cast("array<bigint>").alias("others"))
    wanted = asked.unionByName(answering).groupBy("block", "id").agg(F.flatten(F.collect_set("others")).alias("others"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, shingles, others in _by_block(batches, ["id", "shingles", "others"]):
            place = {x: i for i, x in enumerate(ids)}
            at = [(i, place[y]) for i, ys in enumerate(others) for y in ys]
            near = linked([np.frombuffer(s, np.uint64) for s in shingles], percent)
            found = [(i, j) for i, j in at if near[i, j]]
            yield _edges([ids[i] for i, _ in found], [ids[j] for _, j in found])
        release()

    return wanted.join(sets.select("id", "shingles"), "id").repartition("block").sortWithinPartitions("block").mapInArrow(run, "a long, b long")


def _labels(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label) of all ids: the least id of the component."""
    return ids.join(components(edges), F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("label"))


def linked_classes(sets: DataFrame, percent: int = PERCENT, counters: int = SKETCH, blocks: bool = True) -> DataFrame:
    """(node, component) over sets(id, n, blocks, shingles), of those that link with another."""
    whole_words = PARITY_BITS // 64
    first_links = cut_lineage(block_links(sets if blocks else sets.limit(0), percent))

    def overlap(n, m):  # least intersection of linked sets of sizes n and m
        return F.ceil((n + m) * percent / (100 + percent) - 1e-9)

    def may_link(x: str, y: str):
        """By size, and by how many hashes can still follow the shared one."""
        n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
        rest = F.least(n - F.col(f"{x}.place"), m - F.col(f"{y}.place"))
        return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (rest >= overlap(n, m))

    def maps(words: int) -> list:
        """all and any of the members' maps, folded to so many words."""
        fold = lambda i: F.aggregate(F.slice("parity", 1 + i, PARITY_BITS // 64 - i), F.struct(F.lit(0).cast("bigint").alias("v"), F.lit(0).alias("k")), lambda a, x: F.struct(F.when(a["k"] % words == 0, a["v"].bitwiseXOR(x)).otherwise(a["v"]).alias("v"), (a["k"] + 1).alias("k")), lambda a: a["v"])
        return [fold(i).alias(f"map{i}") for i in range(words)]

    def near_enough(x: str, y: str, words: int):
        """Whether the bits that surely differ (all of x's maps have them, none of y's, or the other way round) are no more than linked sets differ in."""
        n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
        apart = sum(F.bit_count(F.col(f"{x}.all{i}").bitwiseAND(F.bitwise_not(f"{y}.any{i}")).bitwiseOR(F.col(f"{y}.all{i}").bitwiseAND(F.bitwise_not(f"{x}.any{i}")))) for i in range(words))
        return apart <= n + m - 2 * overlap(n, m)

    labels = _labels(sets.select("id"), first_links)
    spread = cut_lineage(labels.groupBy("label").agg(F.count(F.lit(1)).alias("spread")).filter("spread > 1"))
    labels = labels.join(spread, "label", "left").withColumn("spread", F.coalesce("spread", F.lit(1)))
    index = cut_lineage(prefix_index(sets, percent, counters).join(labels, "id"))
    bounds = [f(f"map{i}").alias(f"{name}{i}") for i in range(FOLDED) for name, f in (("all", F.bit_and), ("any", F.bit_or))]
    folded = index.select("*", *maps(FOLDED))
    groups = folded.groupBy("gid").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max("spread").alias("spread"), F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("places").alias("places"), *bounds)
    groups = cut_lineage(groups)
    rows = groups.select("gid", "n", "low", "high", "spread", F.posexplode("tokens").alias("at", "token"), F.col("places"))
    rows = rows.select("gid", "n", "low", "high", "spread", "token", "at", F.col("places")[F.col("at")].alias("place"))
    # the label that most classes have anywhere stands for the commonest of a list
    open_lists = rows.groupBy("token").agg(F.min("low").alias("least"), F.max("high").alias("most"), F.max_by("low", F.struct("spread", "low")).alias("common")).filter("least <> most").select("token", "common")
    live = cut_lineage(rows.select("gid", "token", "at", "place", "low", "high").join(open_lists, "token"))
    whole = groups.select("gid", "n", "tokens", *(f"{name}{i}" for i in range(FOLDED) for name in ("all", "any")))
    before = F.slice("tokens", F.greatest(F.lit(1), F.col("at") + 1 - BEFORE), F.least(F.lit(BEFORE), F.col("at")))
    live = live.join(whole, "gid").withColumn("before", before).drop("tokens", "at")
    other = live.filter((F.col("low") != F.col("common")) | (F.col("high") != F.col("common")))
    apart = ~((F.col("x.low") == F.col("x.high")) & (F.col("y.low") == F.col("y.high")) & (F.col("x.low") == F.col("y.low")))
    # of two that both aren't of the common label, each meets the other
    once = (F.col("x.gid") < F.col("y.gid")) | ((F.col("y.low") == F.col("y.common")) & (F.col("y.high") == F.col("y.common")))
    # of the hashes that two prefixes share, the first has none before it; a later one far from it may make the pair again
    first = ~F.arrays_overlap("x.before", "y.before")
    met = other.alias("x").join(live.alias("y"), (F.col("x.token") == F.col("y.token")) & once & (F.col("x.gid") != F.col("y.gid")) & may_link("x", "y") & apart & first & near_enough("x", "y", FOLDED))
    mixed = groups.filter("low <> high").select(F.col("gid").alias("ga"), F.col("gid").alias("gb"))
    met = cut_lineage(met.select(F.least("x.gid", "y.gid").alias("ga"), F.greatest("x.gid", "y.gid").alias("gb")).distinct().unionByName(mixed))
    members = index.select("id", "gid", "n", "label", F.coalesce(F.try_element_at("blocks", F.lit(1)), "id").alias("block"), *(F.col("parity")[i].alias(f"{name}{i}") for i in range(whole_words) for name in ("all", "any")))
    both = met.join(members.alias("x"), F.col("ga") == F.col("x.gid")).join(members.alias("y"), (F.col("gb") == F.col("y.gid")) & (F.col("x.label") != F.col("y.label")) & ((F.col("ga") != F.col("gb")) | (F.col("x.id") < F.col("y.id"))) & near_enough("x", "y", whole_words))
    pairs = both.select(F.xxhash64(F.least("x.block", "y.block"), F.greatest("x.block", "y.block")).alias("block"), F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    pairs = cut_lineage(pairs)
    return components(first_links.unionByName(cut_lineage(verify(pairs, sets, percent))))


def _blocks(classes: DataFrame) -> DataFrame:
    """classes(id, n, m0, m1) with blocks: of the groups with the same m0, and with the same m1, those with more than one member, in parts of bounded weight."""
    weight = F.greatest(F.col("n"), F.lit(LEAST_WEIGHT))
    for k in (0, 1):
        sums = classes.groupBy(f"m{k}").agg(F.count(F.lit(1)).alias(f"c{k}"), F.sum(weight).alias(f"w{k}"), F.bit_xor(F.xxhash64("id")).alias(f"f{k}")).filter(f"c{k} > 1")
        # cut, so that the join under it is one whose large keys can be split
        classes = classes.join(cut_lineage(sums), f"m{k}", "left")
        parts = F.ceil(F.col(f"w{k}") / BLOCK_HASHES)
        salt = F.pmod(F.xxhash64("id", F.lit(k)), parts)
        classes = classes.withColumns({f"p{k}": parts, f"b{k}": F.when(F.col(f"c{k}") > 1, F.xxhash64(f"m{k}", salt, F.lit(k)))})
    # the same members as in the first, together: nothing new to see
    again = (F.col("f0") == F.col("f1")) & (F.col("c0") == F.col("c1")) & (F.col("p0") == 1)
    return classes.select("id", "digest", "n", F.filter(F.array(F.col("b0"), F.when(~again, F.col("b1"))), lambda x: x.isNotNull()).alias("blocks"))


def ngram_components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, counters: int = SKETCH, keep: tuple[str, ...] = (), root: str | None = None, blocks: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links) and keep of every row.

    A component_id need not be one component's alone, as rows may share a doc_id or have none. With
    root, a column of that name tells components apart (null without words). Without blocks, all
    links come from the index.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep)
    sets = cut_lineage(sets_of(docs, size, keep))
    classes = sets.filter("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"))
    low = map_arrow(classes, lambda b: {"key": pa.array(np.array([_key(x) for x in b.column("digest").to_pylist()], np.uint64).view(np.int64))}, _fields("key long"))
    need = F.greatest(F.lit(1), F.floor(F.ceil(F.col("c.n") * percent / 100) / 10))
    left = low.alias("c").join(screen(docs, size, percent).alias("s"), "key").filter(F.col("s.n") >= need)
    # numbers of their own, shorter than digests; fixed by being written
    left = cut_lineage(left.select("digest", "least", F.col("c.n").alias("n"), "m0", "m1", F.monotonically_increasing_id().alias("id")))
    many = left.count()

    def full(texts: pa.Array) -> dict[str, pa.Array]:
        got = [(_digest(s), s.tobytes()) for s in shingle_sets(texts, size)]
        return {"digest": pa.array([x[0] for x in got], pa.binary()), "shingles": pa.array([x[1] for x in got], pa.binary())}

    texts = maybe_in(docs, left.select(F.col("least").alias("id")), many, full, "digest binary, shingles binary")
    chosen = cut_lineage(_blocks(left).join(texts, "digest").dropDuplicates(["digest"]).drop("digest"))
    found = linked_classes(chosen, percent, counters, blocks)
    numbered = left.select("digest", "id").join(found, F.col("id") == F.col("node")).select("digest", F.col("component").cast("string").alias("component"))
    ids = classes.select("digest", "least").join(numbered, "digest", "left").withColumn("component", F.coalesce("component", F.hex("digest")))
    least = ids.groupBy("component").agg(F.min("least").alias("component_id"))
    own = [F.col("component").alias(root)] if root else []
    roots = ids.join(least, "component").select("digest", "component_id", *own)
    worded = sets.filter("n_shingles > 0").join(roots, "digest").drop("digest")
    # texts without words would all meet at one key
    wordless = sets.filter("n_shingles = 0").drop("digest").withColumns({"component_id": F.col("doc_id")} | ({root: F.lit(None).cast("string")} if root else {}))
    return worded.unionByName(wordless).select("doc_id", "n_shingles", "component_id", *keep, *([root] if root else []))
