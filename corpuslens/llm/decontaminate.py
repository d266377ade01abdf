"""Benchmark decontamination by Wu-Manber multi-pattern search.

Words are maximal runs of ASCII letters (lower-cased), digits and characters
beyond ASCII. A window is ``window`` consecutive words of an item (an item of
fewer words, but not none, is one window). Texts are brought to one space
between words, and windows are byte patterns with a space at either end, so an
occurrence of the pattern is an occurrence of its words.

Search: over the first m bytes of the patterns (m: the shortest), the SHIFT table
says for each block of B bytes how far the search may move on; a block that no
pattern holds moves it by m - B + 1. Where the shift is 0, the bucket of patterns
whose first m bytes end in that block is compared directly. Patterns are grouped
by length, so a short item doesn't shorten every shift.

Items are searched in blocks of about ``block_bytes`` of item text, each sent to
the executors as one broadcast; a block's tables take some 200 bytes for each byte of it in a
Python worker. Hits of several blocks are united per document. Documents never leave their partition unless they have hits
and there is more than one block.

Null or wordless texts have no words and no hits; wordless items have no windows;
a null item_id marks words but is not among the items; equal windows of several
items count for each of them; repeated rows are judged each by itself; texts may be of any length; an empty
table on either side gives documents without hits, or no rows. Other columns, whatever their names, are
ignored unless named in ``keep`` (those called as a result's are replaced).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow

WINDOW, MIN_PERCENT, BLOCK_BYTES = 13, 5, 1 << 20
#: Bytes that the search looks at together; lengths from which patterns are searched apart.
SHIFT_BLOCK, LENGTH_CLASSES = 8, (0, 16, 40)

_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def normalise(text: bytes) -> bytes:
    """The words with one space before, between and behind them; b"" without words."""
    words = text.translate(_FOLD).split()
    return b" " + b" ".join(words) + b" " if words else b""


def windows(text: bytes, size: int = WINDOW) -> list[bytes]:
    words = text.translate(_FOLD).split()
    if not words:
        return []
    n = max(1, len(words) - size + 1)
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(n)]


class WuManber:
    """Tables for patterns of similar lengths."""

    def __init__(self, patterns: list[bytes], block: int = SHIFT_BLOCK):
        self.patterns = patterns
        self.m = min(map(len, patterns))
        self.b = min(block, self.m)
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, list[int]] = defaultdict(list)
        for k, p in enumerate(patterns):
            for j in range(self.b, self.m + 1):
                part = p[j - self.b : j]
                self.shift[part] = min(self.shift.get(part, self.m), self.m - j)
            self.bucket[p[self.m - self.b : self.m]].append(k)

    def find(self, text: bytes) -> Iterator[tuple[int, int]]:
        """(start, number of the pattern) of every occurrence."""
        m, b, n, shift, far = self.m, self.b, len(text), self.shift.get, self.m - self.b + 1
        i = m
        while i <= n:
            part = text[i - b : i]
            step = shift(part, far)
            if step:
                i += step
                continue
            for k in self.bucket[part]:
                if text.startswith(self.patterns[k], i - m):
                    yield i - m, k
            i += 1


class Matcher:
    """The windows of a block of items; tables are made once in each Python worker."""

    def __init__(self, items: list[tuple[int | None, bytes]], window: int):
        owners: dict[bytes, set] = defaultdict(set)
        for item, text in items:
            for w in windows(text, window):
                owners[w].add(item)
        self.owners, self.tables = dict(owners), None

    def __getstate__(self) -> dict:
        return {"owners": self.owners, "tables": None}

    def match(self, text: bytes) -> tuple[int, list[tuple[int, int]], set]:
        """(number of words, word spans covered by occurrences, their items) of a text."""
        if self.tables is None:
            classes = defaultdict(list)
            for p in self.owners:
                classes[max(x for x in LENGTH_CLASSES if len(p) >= x)].append(p)
            self.tables = [WuManber(x) for x in classes.values()]
        s = normalise(text)
        if not s:
            return 0, [], set()
        found, items = [], set()
        for t in self.tables:
            for start, k in t.find(s):
                p = t.patterns[k]
                found.append((start, start + len(p)))
                items |= self.owners[p]
        spans, word, at = [], 0, 0
        for start, end in merged(found, 1):
            word += s.count(b" ", at, start)
            n = s.count(b" ", start, end) - 1
            spans.append((word, word + n))
            word, at = word + n, end - 1
        items.discard(None)
        return s.count(b" ") - 1, spans, items


def merged(spans: list[tuple[int, int]], overlap: int = 0) -> list[tuple[int, int]]:
    """The union of spans; those that share at least so much become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] - overlap:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_PA_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_HITS = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("hit_spans", _SPANS), ("items", T.ArrayType(T.LongType()))]


def _hits(n_words: list[int], spans: list[list[tuple[int, int]]], items: list) -> dict[str, pa.Array]:
    return {
        "n_words": pa.array(n_words, pa.int64()),
        "n_hit": pa.array([sum(b - a for a, b in x) for x in spans], pa.int64()),
        "hit_spans": pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], _PA_SPANS),
        "items": pa.array([sorted(x) for x in items], pa.list_(pa.int64())),
    }


def _search(docs: DataFrame, items: list[tuple[int | None, bytes]], window: int, text: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Matcher(items, window))

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        got = [shared.value.match(x.as_py() or b"") for x in batch.column(text).cast(pa.large_binary())]
        return _hits(*([x[i] for x in got] for i in range(3)))

    return map_arrow(docs, run, _HITS)


def _unite(hits: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        spans = [merged([(y["start"], y["end"]) for y in x.as_py()]) for x in batch.column("hit_spans")]
        items = [set(x.as_py()) for x in batch.column("items")]
        return _hits(batch.column("n_words").to_pylist(), spans, items)

    return map_arrow(hits, run, _HITS)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_percent: int = MIN_PERCENT, text: str = "text", keep: tuple[str, ...] = ("doc_id",), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """keep, n_words, n_hit, hit_spans (in words), items and contaminated per row of docs.

    contaminated: some word is hit, and at least min_percent of the words are.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    names = tuple(dict.fromkeys([*keep, text]))
    # by place, as the names of columns that are kept are anybody's
    base = docs.select(*names).toDF(*(f"_{i}" for i in range(len(names))))
    own = f"_{names.index(text)}"
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    # each block holds about block_bytes of items, whatever the size of the table
    read = lambda k: [(r[0], bytes(r[1])) for r in items.filter(part == k).collect()]
    if blocks == 1:
        out = _search(base, read(0), window, own)
    else:
        # texts without words would all meet at one key
        key = F.when(F.col(own).rlike(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"), F.sha2(own, 256))
        slim = base.select(key.alias("_key"), own).filter("_key IS NOT NULL")
        each = [_search(slim, read(k), window, own).drop(own).filter("n_hit > 0").dropDuplicates(["_key"]) for k in range(blocks)]
        found = each[0]
        for x in each[1:]:
            found = found.unionByName(x)
        found = _unite(found.groupBy("_key").agg(F.first("n_words").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.flatten(F.collect_list("hit_spans")).alias("hit_spans"), F.flatten(F.collect_list("items")).alias("items")))
        counted = _search(base, [], window, own).drop("n_hit", "hit_spans", "items").withColumn("_key", key)
        met = counted.filter("_key IS NOT NULL").join(found.drop("n_words"), "_key", "left")
        out = met.unionByName(counted.filter("_key IS NULL"), allowMissingColumns=True).drop("_key")
        out = out.withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long"))).withColumn("hit_spans", F.coalesce("hit_spans", F.array().cast(_SPANS))).withColumn("items", F.coalesce("items", F.array().cast("array<bigint>")))
    made = [name for name, _ in _HITS]
    judged = out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * min_percent))
    return judged.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(names) if c in keep and c not in (*made, "contaminated")), *made, "contaminated")
