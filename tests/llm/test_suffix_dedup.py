"""Removal of repeated substrings against every window in plain Python."""

import random

import numpy as np
import pytest

from corpuslens.llm import suffix_dedup as sd


def brute(rows, length):
    first = {}
    order = [(sd.LAST if d is None else d, (t or "").encode()) for d, t in rows]
    for d, b in order:
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, b in order:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = True
        spans = int(np.sum(gone & ~np.concatenate(([False], gone[:-1])))) if len(b) else 0
        out.append((d, len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("abcé \n") for _ in range(n))
    pool = [text(n) for n in (20, 49, 50, 51, 60, 120, 400)]
    texts = ["".join(r.choice(pool) if r.random() < 0.4 else text(r.randint(0, 60)) for _ in range(r.randint(0, 6))) for _ in range(80)]
    texts += [None, "", "a" * 49, "a" * 50, "a" * 300, "b" + "a" * 90, texts[0], texts[0], "ab" * 200, "ab" * 30, "\0" * 60, "\0" * 70, "x" * 30, pool[4][5:] + "z", pool[2] * 40]
    ids = r.sample(range(-1000, 1000), len(texts))
    rows = list(zip(ids, texts))
    return rows + [(rows[3][0], texts[3]), (rows[5][0], texts[9]), (None, texts[1]), (None, text(70))]


@pytest.mark.parametrize("seed,length,gram,hot,bits", [(1, 50, 24, 4096, 1 << 28), (2, 50, 24, 3, 1 << 28), (3, 20, 8, 5, 64), (4, 50, 50, 4096, 1 << 28)])
def test_removed_bytes_are_those_of_all_windows(spark, seed, length, gram, hot, bits):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "") for d, t in rows], "doc_id long, text string, removed string").repartition(5)
    got = sd.remove_repeats(df, length, gram, hot, bits).collect()
    mine = sorted((sd.LAST if x.doc_id is None else x.doc_id, x.n_bytes, sum(s.end - s.start for s in x.removed), len(x.removed), bytes(x.kept)) for x in got)
    assert mine == brute(rows, length)


def test_empty(spark):
    assert sd.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = sd.remove_repeats(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.n_bytes, len(x.removed)) for x in got) == [(1, 0, 0), (2, 0, 0)]


def test_common_prefixes_of_rounds():
    r = random.Random(9)
    seg = np.array([[r.choice(b"ab") for _ in range(12)] for _ in range(300)], np.uint8)
    docs = np.array([r.randrange(50) for _ in range(300)], np.int64)
    low, high = np.array([r.randint(0, 4) for _ in docs]), np.array([r.randint(8, 12) for _ in docs])
    s, e = sd.covered_windows(seg, docs, low, high, 7)
    for i in range(300):
        hits = [c for c in range(6) if low[i] <= c and c + 7 <= high[i] and any(low[j] <= c and c + 7 <= high[j] and docs[j] < docs[i] and (seg[j, c : c + 7] == seg[i, c : c + 7]).all() for j in range(300))]
        assert (s[i], e[i]) == ((min(hits), max(hits) + 7) if hits else (0, 0))
