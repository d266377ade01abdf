"""Language identification with a linear-chain conditional random field.

The words of a text are a sequence with one label (a language) each. The score of a
labelling is the sum of

* per word: weights of its affixes (first and last one to three bytes), of its byte
  trigrams and of itself (the lexicon), each looked up by hash, and
* per pair of neighbours: a learned transition weight.

Training sequences are code-switched on purpose: spans of training texts of
different languages are joined, and every word carries its span's label, so that
transitions are learned from switches as well as stays. Weights are fitted by
gradient steps on the conditional log-likelihood, whose gradient comes from
forward-backward, on the whole texts of a sample (``per_language`` rows of each
label, least hash of the text first; that is the only bound). A text's prediction is the label with the
greatest posterior mass over all of its words (forward-backward over the whole text); the
score is that share. Long texts are not cut: steps run over the words of many texts
at once, longest first.

A text that is null or has no letter (of Unicode's categories of letters) is ``und`` with score 0. Words are
runs of bytes of ASCII letters or of bytes beyond ASCII, lower-cased. Ties go to the first label in
alphabetical order. Without labelled rows every text is ``und``. An empty table gives an empty
result; repeated rows are judged each by itself; other columns are ignored, or kept with ``keep`` (one
called lang_pred or score is replaced).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_view, map_arrow, mix64, release, scrambled, slices, strings

#: Texts of the training sample for each label: the only bound.
PER_LANGUAGE = 300
#: Rows of the weight table, passes over the sample, words of a code-switched span at most.
WEIGHTS, EPOCHS, SPAN_WORDS, STEP, DECAY = 1 << 16, 4, 12, 0.5, 1e-4
UND = "und"

_LETTERS = np.array([b >= 0x80 or 65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_SEEDS = scrambled(8, 0x637266)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, ends, words of each text)."""
    low = _LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _LETTERS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (edge[:-1] | ~inside[:-2]))
    ends = np.flatnonzero(inside[1:-1] & (edge[1:] | ~inside[2:])) + 1
    return low, starts, ends, np.diff(np.searchsorted(starts, offsets))


def features(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the weight table: (affixes and lexicon of each word, trigrams of all words, trigrams a word)."""
    n = len(starts)
    size = ends - starts
    x = low.astype(np.uint64)
    padded = np.concatenate((x, np.zeros(4, np.uint64)))
    fixed = np.empty((n, 7), np.uint64)
    for m in (1, 2, 3):  # a shorter word has an affix of zeros
        ok = size >= m
        head, tail = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        for k in range(m):
            head = head << np.uint64(8) | np.where(ok, padded[starts + k], np.uint64(0))
            tail = tail << np.uint64(8) | np.where(ok, padded[np.maximum(ends - m + k, 0)], np.uint64(0))
        fixed[:, 2 * m - 2] = mix64(head << np.uint64(3) | np.uint64(m)) ^ _SEEDS[0]
        fixed[:, 2 * m - 1] = mix64((tail << np.uint64(3) | np.uint64(m)) ^ _SEEDS[1])
    # the word itself: a sum over its bytes of scrambled (byte, place)
    first = np.cumsum(size) - size
    within = np.arange(int(size.sum())) - np.repeat(first, size)
    byte = np.repeat(starts, size) + within
    letters = mix64(x[byte] + (within.astype(np.uint64) << np.uint64(8)) + _SEEDS[2])
    fixed[:, 6] = mix64(np.add.reduceat(letters, first) ^ _SEEDS[3]) if n else 0
    b = byte[within >= 2]
    tri = mix64((x[b - 2] << np.uint64(16) | x[b - 1] << np.uint64(8) | x[b]) ^ _SEEDS[4])
    rows = np.uint64(WEIGHTS - 1)
    return (fixed & rows).astype(np.int64), (tri & rows).astype(np.int64), np.maximum(size - 2, 0)


def emissions(weights: np.ndarray, fixed: np.ndarray, tri: np.ndarray, n_tri: np.ndarray) -> np.ndarray:
    """The summed weights of each word, for each label."""
    out = np.zeros((len(fixed), weights.shape[1]), weights.dtype)
    for k in range(fixed.shape[1]):
        out += weights[fixed[:, k]]
    some = np.flatnonzero(n_tri)
    if len(some):
        out[some] += np.add.reduceat(weights[tri], (np.cumsum(n_tri) - n_tri)[some], axis=0)
    return out


def forward_backward(scores: np.ndarray, counts: np.ndarray, transitions: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """(posterior of each word, expected transitions if asked for) of many sequences.

    scores: the emissions of all words, sequence after sequence; counts: their
    lengths. Works in probabilities, each step scaled to a sum of 1, over all
    sequences that are long enough for the step.
    """
    order = np.argsort(-counts, kind="stable")
    base = (np.cumsum(counts) - counts)[order]
    lengths = counts[order]
    e = np.exp(scores - scores.max(1, keepdims=True))
    move = np.exp(transitions - transitions.max())
    most = int(lengths[0]) if len(lengths) else 0
    alive = np.searchsorted(-lengths, -np.arange(most), side="left")  # sequences longer than t
    alpha, beta = np.empty_like(e), np.empty_like(e)
    for t in range(most):
        at = base[: alive[t]] + t
        a = e[at] if t == 0 else (alpha[at - 1] @ move) * e[at]
        alpha[at] = a / a.sum(1, keepdims=True)
    for t in range(most - 1, -1, -1):
        at = base[: alive[t]] + t
        after = alive[t + 1] if t + 1 < most else 0
        b = np.ones((len(at), e.shape[1]), e.dtype)
        nxt = at[:after] + 1
        b[:after] = (beta[nxt] * e[nxt]) @ move.T
        beta[at] = b / b.sum(1, keepdims=True)
    post = alpha * beta
    post /= post.sum(1, keepdims=True)
    if not pairs:
        return post, None
    last = np.zeros(len(e), bool)
    last[base + lengths - 1] = True
    i = np.flatnonzero(~last)
    joint = alpha[i][:, :, None] * move[None] * (beta[i + 1] * e[i + 1])[:, None, :]
    joint /= joint.sum((1, 2), keepdims=True)
    return post, joint.sum(0)


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray

    def predict(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        names, scores = [], []
        data, offsets = byte_view(texts)
        texts = strings(texts)
        for i, j in slices(offsets, 1 << 20):
            low, starts, ends, counts = words_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            mass = np.zeros((j - i, max(1, len(self.labels))))
            if len(starts) and self.labels:
                some = np.flatnonzero(counts)
                post, _ = forward_backward(emissions(self.weights, *features(low, starts, ends)), counts[some], self.transitions)
                mass[some] = np.add.reduceat(post, np.cumsum(counts[some]) - counts[some], axis=0) / counts[some][:, None]
            best = mass.argmax(1)
            for k in range(j - i):
                known = bool(self.labels) and mass[k, best[k]] > 0 and has_letter(texts[i + k].as_py())
                names.append(self.labels[best[k]] if known else UND)
                scores.append(min(1.0, float(mass[k, best[k]])) if known else 0.0)
        return names, scores


def fit(samples: dict[str, list[str]], epochs: int = EPOCHS, step: float = STEP, seed: int = 1) -> Crf:
    """A model from texts per label."""
    labels = sorted(samples)
    n = len(labels)
    weights, transitions = np.zeros((WEIGHTS, max(1, n)), np.float32), np.zeros((n, n), np.float32)
    if not n:
        return Crf(labels, weights, transitions)
    rng = np.random.default_rng(seed)
    # the words of all texts as rows of features, and the spans that they are cut into
    spans: list[tuple[int, int]] = []
    parts, total = [], 0
    for k, name in enumerate(labels):
        data, offsets = byte_view(pa.array(samples[name], pa.large_string()))
        for i, j in slices(offsets, 1 << 20):
            low, starts, ends, counts = words_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            if not len(starts):
                continue
            rows = [x.astype(np.int32) for x in features(low, starts, ends)]  # bytes of a text become numbers for a slice at a time
            parts.append((*rows, np.full(len(starts), k, np.int16)))
            for c in counts.tolist():
                at, end = total, total + c
                while at < end:
                    m = min(end, at + int(rng.integers(1, SPAN_WORDS + 1)))
                    spans.append((at, m))
                    at = m
                total = end
    if not total:
        return Crf(labels, weights, transitions)
    fixed, tri, n_tri, gold = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    n_tri = n_tri.astype(np.int64)
    first_tri = np.cumsum(n_tri) - n_tri
    square, moved = np.full_like(weights, 1e-3), np.full_like(transitions, 1e-3)
    for _ in range(epochs):
        release()
        order = rng.permutation(len(spans))
        # half of the sequences switch language from span to span, half hardly ever do
        for block in np.array_split(order, max(1, len(order) // 2000)):
            seqs = [block[i : i + 6] for i in range(0, len(block), 6)]
            stay = [np.array(sorted(s)) for s in np.array_split(np.sort(block), max(1, len(block) // 6))]
            for group in (seqs, stay):
                picked = np.concatenate([np.arange(*spans[s]) for q in group for s in q])
                counts = np.array([sum(spans[s][1] - spans[s][0] for s in q) for q in group])
                counts = counts[counts > 0]
                m = n_tri[picked]
                t = tri[np.repeat(first_tri[picked] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))]
                post, pair = forward_backward(emissions(weights, fixed[picked], t, m).astype(np.float64), counts, transitions, pairs=True)
                y = gold[picked]
                delta = -post
                delta[np.arange(len(y)), y] += 1
                grad = np.zeros_like(weights, np.float64)
                r = np.concatenate((fixed[picked].ravel(), t))
                d = np.concatenate((np.repeat(delta, fixed.shape[1], axis=0), np.repeat(delta, m, axis=0)))
                for k in range(n):
                    grad[:, k] = np.bincount(r, d[:, k], WEIGHTS)
                grad /= len(y)
                seen = np.unique(r)
                square[seen] += grad[seen] ** 2
                weights[seen] += step * (grad[seen] / np.sqrt(square[seen]) - DECAY * weights[seen])
                follow = np.ones(len(y), bool)
                follow[np.cumsum(counts) - 1] = False
                i = np.flatnonzero(follow)
                actual = np.zeros((n, n))
                np.add.at(actual, (y[i], y[i + 1]), 1)
                g = (actual - pair) / len(y)
                moved += g**2
                transitions += step * g / np.sqrt(moved)
    return Crf(labels, weights, transitions.astype(np.float32))


def training_sample(docs: DataFrame, label: str = "lang", text: str = "text", per_label: int = PER_LANGUAGE) -> dict[str, list[str]]:
    """At most per_label whole texts of each label, those of least hash; equal texts count once."""
    rows = docs.filter(F.col(label).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(label).alias("label"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    near = F.lit(False)
    for name, n in rows.groupBy("label").agg(F.approx_count_distinct("h", 0.02)).collect():
        # about twice as many distinct texts as are needed lie below the limit
        share = (2.0 * per_label + 50) / n
        limit = 2**63 - 1 if share >= 1 else int(-(2**63) + share * 2**64)
        near = near | ((F.col("label") == name) & (F.col("h") <= limit))
    near_rows = rows.filter(near).groupBy("label", "h").agg(F.min("text").alias("t"))
    least = near_rows.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("h", "t"))).filter(F.col("k") <= per_label)
    out: dict[str, list[str]] = {}
    for name, _, t in sorted(least.select("label", "h", "t").collect()):
        out.setdefault(name, []).append(t)
    return out


def predict_language(docs: DataFrame, model: Crf, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, lang_pred and score per row."""
    release()  # what training has left in the driver
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        names, scores = shared.value.predict(batch.column(text))
        return {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())}

    return map_arrow(docs.select(*dict.fromkeys([*keep, text])), run, [("lang_pred", T.StringType()), ("score", T.DoubleType())], () if text in keep else (text,))
