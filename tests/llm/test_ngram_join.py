"""The n-gram Jaccard join against all pairs in plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from corpuslens.llm import ngram_join as nj


def brute(rows, size=4, percent=85):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if both and 100 * both >= percent * len(x | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if sets[i]:
            r = find(i)
            if d is not None:
                least[r] = min(least.get(r, d), d)
    return sorted((d if d is not None else -1, len(s), (least.get(find(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 4)))
    fresh = lambda n: [word() for _ in range(n)]
    passage = fresh(30)
    texts = []
    for _ in range(12):
        base = fresh(r.choice([3, 8, 40, 90, 200]))
        for _ in range(r.choice([1, 2, 6, 25])):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = word()
            texts.append(r.choice([" ", "\n", "  "]).join(w))
    # chains: each next one a few words off
    w = fresh(120)
    for i in range(25):
        texts.append(" ".join(w))
        w[(i * 4) % 120] = word()
    texts += [" ".join(passage + fresh(r.randint(0, 8))) for _ in range(40)]
    texts += [None, "", " \n", "A b", "a B", "a b c", "a b c d", "A b c d", texts[0], texts[0]]
    r.shuffle(texts)
    return [(i if i != 7 else None, t) for i, t in enumerate(texts)] + [(3, "twice the same id here now"), (3, texts[5])]


@pytest.mark.parametrize("seed,blocks,counters", [(1, True, 1 << 22), (2, False, 256), (3, True, 1 << 12)])
def test_components_are_those_of_all_pairs(spark, seed, blocks, counters):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, n_shingles int").repartition(5)
    got = nj.ngram_components(df, blocks=blocks, counters=counters).collect()
    assert sorted((-1 if x.doc_id is None else x.doc_id, x.n_shingles, x.component_id) for x in got) == brute(rows)


def test_empty(spark):
    assert nj.ngram_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = nj.ngram_components(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1), (2, 0, 2)]


def test_sets_do_not_depend_on_the_batch():
    r = random.Random(4)
    texts = [" ".join(r.choice(["a", "B", "é\x0bx", ""]) for _ in range(r.randint(0, 30))) for _ in range(300)] + ["x" * 3_000_000 + " y z w"]
    together = [s.tolist() for s in nj.shingle_sets(pa.array(texts))]
    assert together == [next(nj.shingle_sets(pa.array([t]))).tolist() for t in texts]
    assert all(np.all(np.diff(np.array(s, np.uint64)) > 0) for s in together if len(s) > 1)


def test_parity_maps_differ_in_no_more_bits_than_sets_do():
    r = np.random.default_rng(5)
    for n in (1, 5, 60, 900):
        x = nj.mix64(r.integers(0, 1 << 40, n).astype(np.uint64))
        y = np.concatenate((x[n // 4 :], nj.mix64(r.integers(0, 1 << 40, 1 + n // 5).astype(np.uint64))))
        differ = len(np.setxor1d(x, y))
        bits = sum(int(v).bit_count() for v in (nj.parity_map(x) ^ nj.parity_map(y)).view(np.uint64))
        assert bits <= differ and (bits - differ) % 2 == 0
        assert (nj.parity_map(x) == nj.parity_map(x[::-1])).all()
