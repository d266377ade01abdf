"""Quality classification by a generalised additive model with pairwise interactions.

Seventeen figures of a text (lengths, shares of kinds of bytes and words, repeated
lines and words) are binned at training quantiles. The log-odds of the label are an intercept
plus one lookup table for each figure plus one for each of a few pairs of figures.
Tables are learned by cyclic boosting: round after round, each figure in turn gets
a shallow tree (at most ``LEAVES`` leaves) on the current residuals, whose leaf
values, shrunk, are added to its table; then the pairs that would reduce the
residuals most get tables of their own from trees with one cut on either axis.
Scoring adds up table entries of the bins, for all texts at once.

The training sample is bounded: at most ``TRAIN_ROWS`` labelled rows, those of
least hash. Labels of one document that disagree count as 1 if any is 1. Without
labels, or with labels of one kind only, all scores are that share (0.5 without).
Null counts as an empty text and is scored like one. An empty table gives an empty
result; repeated rows are scored each by itself; texts may be of any length; other columns are ignored, or kept
with ``keep`` (one called score is replaced).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_view, map_arrow, mix64, scrambled, slices

#: Bound of the training sample; bins, rounds, step, leaves, pairs and their bins.
TRAIN_ROWS, BINS, ROUNDS, STEP, LEAVES, PAIRS, PAIR_BINS, PAIR_ROUNDS, LEAST_ROWS = 20_000, 32, 60, 0.15, 3, 6, 8, 30, 10
THRESHOLD = 0.3

FIGURES = ("log_bytes", "word_bytes", "upper", "digit", "stop_mark", "comma", "symbol", "pipe", "exclaim", "space", "line_words", "short_words", "capitalised", "beyond_ascii", "repeated_lines", "marked_words", "echoed_words")

_B = np.arange(256)
_IS = {
    "upper": (_B >= 65) & (_B <= 90),
    "digit": (_B >= 48) & (_B <= 57),
    "stop_mark": np.isin(_B, list(b".?")),
    "comma": np.isin(_B, list(b",;:")),
    "symbol": np.isin(_B, list(b"#$%&*@^~<>{}[]=_+\\/`\"")),
    "pipe": _B == ord("|"),
    "exclaim": _B == ord("!"),
    "space": np.isin(_B, [0x20, *range(0x09, 0x0E)]),
    "beyond_ascii": _B >= 0x80,
}
_VALUE = scrambled(256, 0x7175616C)
_BASE = 0x9E3779B97F4A7C15


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offsets])


def _repeated_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bytes of each text in lines that an earlier line of the text equals."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    ends_line = np.zeros(n + 1, bool)
    ends_line[1:] = data == 10
    starts = np.flatnonzero((edge | ends_line)[:n])
    if not len(starts):
        return np.zeros(len(offsets) - 1, np.int64)
    size = np.diff(np.append(starts, n))
    within = (np.arange(n) - np.repeat(starts, size)).astype(np.uint64)
    text = data != 10
    line = np.add.reduceat(np.where(text, mix64(_VALUE[data] + within), np.uint64(0)), starts)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    bare = np.add.reduceat(text.astype(np.int64), starts)
    order = np.lexsort((starts, line, doc))
    again = np.zeros(len(starts), bool)
    again[order[1:]] = (line[order][1:] == line[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return np.bincount(doc[again], bare[again], len(offsets) - 1)


def _word_tags(data: np.ndarray, word: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    x = data[starts[0] :]
    at = starts - starts[0]
    within = (np.arange(len(x)) - np.repeat(at, np.diff(np.append(at, len(x))))).astype(np.uint64)
    return np.add.reduceat(np.where(word[starts[0] :], mix64(_VALUE[x] + within), np.uint64(0)), at)


def figures(texts: pa.Array) -> np.ndarray:
    """A row of FIGURES for each text."""
    data, offsets = byte_view(texts)
    out = []
    for i, j in slices(offsets, 1 << 20):
        x, offs = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        n = np.diff(offs)
        least = np.maximum(n, 1)
        share = {k: _sums(f[x], offs) / least for k, f in _IS.items()}
        edge = np.zeros(len(x) + 1, bool)
        edge[offs] = True
        word = ~_IS["space"][x]
        before = np.concatenate(([False], word[:-1])) if len(x) else word
        after = np.concatenate((word[1:], [False])) if len(x) else word
        starts = np.flatnonzero(word & (edge[:-1] | ~before))
        ends = np.flatnonzero(word & (edge[1:] | ~after)) + 1
        at = np.searchsorted(starts, offs)
        words = np.diff(at)
        some = np.maximum(words, 1)
        size = ends - starts
        tag = _word_tags(x, word, starts)
        echoed = np.zeros(len(starts), bool)
        echoed[1:] = tag[1:] == tag[:-1]
        echoed[at[:-1][words > 0]] = False
        upto = lambda v: np.diff(np.concatenate(([0], np.cumsum(v)))[at])  # noqa: B023, E731
        col = {
            "log_bytes": np.log1p(n),
            "word_bytes": upto(size) / some,
            "line_words": np.log1p(words / (1 + _sums(x == 10, offs))),
            "short_words": upto(size <= 3) / some,
            "capitalised": upto(_IS["upper"][x[starts]]) / some,
            "repeated_lines": _repeated_lines(x, offs) / least,
            "echoed_words": upto(echoed) / some,
            "marked_words": upto((_IS["symbol"] | _IS["exclaim"] | _IS["pipe"])[x[ends - 1]]) / some,
        } | share
        out.append(np.stack([col[k] for k in FIGURES], 1))
    return np.concatenate(out) if out else np.zeros((0, len(FIGURES)))


@dataclass
class Additive:
    """Lookup tables by figure, and by pair of figures."""

    intercept: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(self.cuts)], 1) if self.cuts else np.zeros((len(x), 0), np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.intercept)
        for k, t in enumerate(self.tables):
            z += t[b[:, k]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            z += t[_coarse(b[:, i], self.cuts[i]), _coarse(b[:, j], self.cuts[j])]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _coarse(b: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return b * PAIR_BINS // (len(cuts) + 1)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Values of the leaves of a tree over ordered bins, from sums of gradients and weights in them."""
    leaves = [(0, len(g))]
    gain_of = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1)
    while len(leaves) < LEAVES:
        best = (1e-9, None, None)
        for a, b in leaves:
            if b - a < 2:
                continue
            gl, hl, nl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1], np.cumsum(n[a:b])[:-1]
            gain = gl**2 / (hl + 1) + (g[a:b].sum() - gl) ** 2 / (h[a:b].sum() - hl + 1) - gain_of(a, b)
            gain[(nl < LEAST_ROWS) | (n[a:b].sum() - nl < LEAST_ROWS)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (a, b), a + k + 1)
        if best[1] is None:
            break
        leaves.remove(best[1])
        leaves += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, values) of the best tree with one cut on either axis of a grid."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def four(c):
        a, b = c[:-1, :-1], c[:-1, -1:]
        d, t = c[-1:, :-1], c[-1, -1]
        return a, b - a, d - a, t - b - d + a

    gain = sum(x**2 / (y + 1) for x, y in zip(four(G), four(H), strict=True))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.zeros_like(g)
    for r in (slice(0, i + 1), slice(i + 1, None)):
        for c in (slice(0, j + 1), slice(j + 1, None)):
            out[r, c] = g[r, c].sum() / (h[r, c].sum() + 1)
    return float(gain[i, j] - g.sum() ** 2 / (h.sum() + 1)), out


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return Additive(float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    model = Additive(float(np.log(y.mean() / (1 - y.mean()))))
    model.cuts = [np.unique(np.quantile(x[:, k], np.arange(1, BINS) / BINS, method="lower")) for k in range(x.shape[1])]
    b = model.bins(x)
    sizes = [len(c) + 1 for c in model.cuts]
    model.tables = [np.zeros(s) for s in sizes]
    counts = [np.bincount(b[:, k], minlength=s) for k, s in enumerate(sizes)]
    z = np.full(len(y), model.intercept)
    for _ in range(ROUNDS):
        for k, s in enumerate(sizes):
            p = 1 / (1 + np.exp(-z))
            g, h = np.bincount(b[:, k], y - p, s), np.bincount(b[:, k], p * (1 - p), s)
            step = STEP * _tree(g, h, counts[k])
            model.tables[k] += step
            z += step[b[:, k]]
    coarse = [_coarse(b[:, k], model.cuts[k]) for k in range(len(sizes))]
    grid = lambda i, j, v: np.bincount(coarse[i] * PAIR_BINS + coarse[j], v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
    p = 1 / (1 + np.exp(-z))
    gains = sorted(((_quadrants(grid(i, j, y - p), grid(i, j, p * (1 - p)))[0], i, j) for i in range(len(sizes)) for j in range(i)), reverse=True)
    model.pairs = [(i, j) for gain, i, j in gains[:PAIRS] if gain > 0]
    model.pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            p = 1 / (1 + np.exp(-z))
            step = STEP * _quadrants(grid(i, j, y - p), grid(i, j, p * (1 - p)))[1]
            table += step
            z += step[coarse[i], coarse[j]]
    return model


def training_sample(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Figures and labels of at most so many labelled documents, those of least hash of their id."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).alias("y"), F.xxhash64("doc_id").alias("h"))
    n = known.count()
    if n > rows:
        known = known.filter(F.col("h") <= int(-(2**63) + min(1.0, 1.2 * rows / n) * (2**64 - 1)))
    picked = known.groupBy("doc_id", "h").agg(F.max("y").alias("y")).orderBy("h", "doc_id").limit(rows).select("doc_id", "y")
    # at most `rows` pairs of numbers, whatever the size of the tables
    joined = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(picked), "doc_id").select("text", F.col("y").cast("double").alias("y"))

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        x = figures(batch.column("text"))
        return {k: pa.array(x[:, i]) for i, k in enumerate(FIGURES)}

    got = map_arrow(joined, run, [(k, T.DoubleType()) for k in FIGURES], drop=("text",)).toArrow()
    order = np.lexsort([got.column(k).to_numpy() for k in ("y", *FIGURES)])
    return np.stack([got.column(k).to_numpy() for k in FIGURES], 1)[order], got.column("y").to_numpy()[order]


def score_quality(docs: DataFrame, model: Additive, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and score (0 to 1) per row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {"score": pa.array(shared.value.score(figures(batch.column(text))))}

    return map_arrow(docs.select(*dict.fromkeys([*keep, text])), run, [("score", T.DoubleType())], () if text in keep else (text,))
