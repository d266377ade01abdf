"""Query correction: tokens that the corpus doesn't have become their nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.memory import released
from ..functions.text import tokens
from .graph import no_rows

CUTOFF, LEAST_LENGTH = 80, 5
#: Tokens that are broadcast together.
BLOCK = 4096


def vocabulary(docs: DataFrame) -> DataFrame:
    """(token, doc_pos, token_pos): distinct tokens of docs(pos, text) with their first place."""
    words = docs.select("pos", tokens(F.col("text")).alias("w"))
    firsts = words.mapInArrow(released(_firsts), f"token string, doc_pos {dict(docs.dtypes)['pos']}, token_pos int")
    first = firsts.groupBy("token").agg(F.min(F.struct("doc_pos", "token_pos")).alias("f"))
    return first.select("token", "f.doc_pos", "f.token_pos")


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each token of a batch of (pos, w) with its first place there, so that no row a word is sorted."""
    for batch in batches:
        batch = batch.take(pc.sort_indices(batch.column("pos"), null_placement="at_start"))
        w = batch.column("w")
        size = pc.fill_null(pc.list_value_length(w), 0).to_numpy()
        flat = w.flatten().dictionary_encode()
        code = flat.indices.to_numpy(zero_copy_only=False)
        at = np.zeros(len(flat.dictionary), np.int64)
        at[code[::-1]] = np.arange(len(code))[::-1]  # of several places of a token the last one written stays, which is the first
        doc = np.searchsorted(np.cumsum(size), at, side="right")
        place = at - (np.cumsum(size) - size)[doc]
        yield pa.RecordBatch.from_arrays([flat.dictionary.cast(pa.string()), batch.column("pos").take(pa.array(doc)), pa.array(place, pa.int32())], ["token", "doc_pos", "token_pos"])


def query_tokens(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.posexplode(tokens(F.col("text"))).alias("i", "token"))


def unknown_tokens(queries: DataFrame, vocab: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """Distinct query tokens of some length that the vocabulary doesn't have."""
    return query_tokens(queries).select("token").distinct().filter(F.length("token") >= least_length).join(vocab, "token", "left_anti")


class Pattern:
    """Longest common subsequences of one string with many, a machine word at a time.

    Bit-parallel: bit i of v is 0 where the table's row steps up at the pattern's
    i-th character; all strings advance by one character together.
    """

    def __init__(self, text: str):
        self.text, self.n = text, len(text)
        codes = np.array([ord(c) for c in text], np.uint32)
        self.alphabet = np.unique(codes)
        self.masks = np.array([sum(1 << i for i in np.flatnonzero(codes == c).tolist()) for c in self.alphabet] + [0], np.uint64 if self.n <= 64 else object)

    def lcs(self, chars: np.ndarray) -> np.ndarray:
        """chars: a row of code points for each string, padded with zeros."""
        place = np.minimum(np.searchsorted(self.alphabet, chars), len(self.alphabet) - 1)
        place = np.where(self.alphabet[place] == chars, place, len(self.alphabet))
        full = (1 << self.n) - 1
        if self.n > 64:  # Python's integers have as many bits as needed
            out = []
            for row in place:
                v = full
                for m in self.masks[row]:
                    u = v & m
                    v = ((v + u) | (v - u)) & full
                out.append(self.n - v.bit_count())
            return np.array(out, np.int64)
        v = np.full(len(chars), full, np.uint64)
        for k in range(chars.shape[1]):
            u = v & self.masks[place[:, k]]
            v = (v + u) | (v - u)
        return self.n - np.bitwise_count(v & np.uint64(full)).astype(np.int64)


def nearest(unknown: DataFrame, vocab: DataFrame, cutoff: float = CUTOFF, block: int = BLOCK) -> DataFrame:
    """(token, near, ratio, doc_pos, token_pos): the best neighbour of each token in each task's share of the vocabulary.

    Tokens are a stated set: they go out in blocks of a bounded number, each against the
    whole vocabulary. Only words in the band of lengths that the cutoff allows are
    compared, all of them at once.
    """
    n = unknown.count()
    blocks = max(1, -(-n // block))
    part = F.pmod(F.xxhash64("token"), F.lit(blocks))
    schema = "token string, near string, ratio double, doc_pos long, token_pos long"
    out = no_rows(vocab.sparkSession, schema)
    for b in range(blocks):
        shared = vocab.sparkSession.sparkContext.broadcast([r[0] for r in unknown.filter(part == b).collect()])

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            found: dict[str, tuple] = {}
            patterns = [Pattern(t) for t in shared.value]
            longest = max((p.n for p in patterns), default=0) * (200 - cutoff) / cutoff if patterns else 0
            for batch in batches:
                words = batch.column("token")
                size = pc.utf8_length(words).to_numpy(zero_copy_only=False)
                keep = np.flatnonzero(size <= longest)
                if not len(keep):
                    continue
                words, size = words.take(pa.array(keep)), size[keep]
                docs, places = (batch.column(c).to_numpy()[keep] for c in ("doc_pos", "token_pos"))
                texts = np.array(words.to_pylist(), dtype=f"U{int(size.max())}")
                chars = texts.view(np.uint32).reshape(len(texts), -1)
                for p in patterns:
                    at = np.flatnonzero((size * (200 - cutoff) >= cutoff * p.n) & (size * cutoff <= (200 - cutoff) * p.n))
                    if not len(at):
                        continue
                    ratio = 200.0 * p.lcs(chars[at]) / (p.n + size[at])
                    k = np.lexsort((places[at], docs[at], -ratio))[0]
                    row = (-ratio[k], docs[at[k]], places[at[k]], words[int(at[k])].as_py())
                    if ratio[k] >= cutoff and row < found.get(p.text, (1,)):
                        found[p.text] = row
            rows = [(t, w, -r, int(d), int(i)) for t, (r, d, i, w) in found.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64()), strict=True)], ["token", "near", "ratio", "doc_pos", "token_pos"])

        out = out.unionByName(vocab.select("token", F.col("doc_pos").cast("long").alias("doc_pos"), F.col("token_pos").cast("long").alias("token_pos")).mapInArrow(released(best), schema))
    return out


def corrections(queries: DataFrame, vocab: DataFrame, cutoff: float = CUTOFF, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(token, fix, ratio): the nearest neighbour of each unknown token; ties: first seen."""
    found = nearest(unknown_tokens(queries, vocab, least_length), vocab, cutoff)
    best = F.min(F.struct((-F.col("ratio")).alias("r"), "doc_pos", "token_pos", "near")).alias("b")
    return found.groupBy("token").agg(best).select("token", F.col("b.near").alias("fix"), (-F.col("b.r")).alias("ratio"))


def rewrite(queries: DataFrame, vocab: DataFrame, cutoff: float = CUTOFF, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(query_id, rewritten, corrections): tokens in lower case joined by blanks, and what was replaced, in order."""
    fixes = corrections(queries, vocab, cutoff, least_length)
    words = query_tokens(queries).join(F.broadcast(fixes.select("token", "fix")), "token", "left")
    ordered = words.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("i", "token", "fix"))).alias("w"))
    done = ordered.select("query_id", F.array_join(F.transform("w", lambda x: F.coalesce(x["fix"], x["token"])), " ").alias("rewritten"), F.transform(F.filter("w", lambda x: x["fix"].isNotNull()), lambda x: F.struct(x["token"].alias("typo"), x["fix"].alias("fix"))).alias("corrections"))
    empty = F.array().cast("array<struct<typo:string,fix:string>>")
    return queries.select("query_id").join(done, "query_id", "left").select("query_id", F.coalesce("rewritten", F.lit("")).alias("rewritten"), F.coalesce("corrections", empty).alias("corrections"))
