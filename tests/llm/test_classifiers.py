"""Operators 7 and 8: held-out accuracy, brute-force posteriors and awkward tables."""

import itertools
import random

import numpy as np
import pyarrow as pa

from corpuslens.llm import language_id as lid
from corpuslens.llm import quality as ql

SYLLABLES = {"aa": ["the", "ing", "ou", "wh"], "bb": ["sch", "ung", "ei", "ß"], "cc": ["ción", "os", "ñ", "lla"]}


def sentence(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def test_forward_backward_is_the_sum_over_all_labellings():
    rng = np.random.default_rng(1)
    scores, move, counts = rng.normal(size=(8, 3)), rng.normal(size=(3, 3)), np.array([1, 4, 3])
    post, pairs = lid.forward_backward(scores, counts, move, pairs=True)
    at, expected = 0, np.zeros((3, 3))
    for c in counts:
        total, marginal = 0.0, np.zeros((c, 3))
        for y in itertools.product(range(3), repeat=int(c)):
            w = np.exp(sum(scores[at + t, y[t]] for t in range(c)) + sum(move[y[t], y[t + 1]] for t in range(c - 1)))
            total += w
            for t in range(c):
                marginal[t, y[t]] += w
        assert np.allclose(post[at : at + c], marginal / total)
        for y in itertools.product(range(3), repeat=int(c)):
            w = np.exp(sum(scores[at + t, y[t]] for t in range(c)) + sum(move[y[t], y[t + 1]] for t in range(c - 1))) / total
            for t in range(c - 1):
                expected[y[t], y[t + 1]] += w
        at += c
    assert np.allclose(pairs, expected)


def test_language_id(spark):
    r = random.Random(3)
    train = [(i, sentence(r, k, r.randint(3, 60)), k, "x") for i, k in enumerate(sorted(SYLLABLES) * 60)]
    model = lid.fit(lid.training_sample(spark.createDataFrame(train + [(900, None, "aa", "x"), (901, "12", "bb", "x"), (902, "the", None, "x")], "doc_id long, text string, lang string, score string")))
    assert model.labels == ["aa", "bb", "cc"]
    assert (np.diag(model.transitions) > model.transitions.max(1) - 1e-6).all()
    texts = [(i, sentence(r, k, r.randint(2, 40)), k) for i, k in enumerate(sorted(SYLLABLES) * 40)]
    more = [(500, None, "und"), (501, "", "und"), (502, "12 34 ... !", "und"), (503, "٣ €", "und"), (504, sentence(r, "cc", 30_000), "cc"), (505, sentence(r, "aa", 40) + " " + sentence(r, "bb", 20), "aa")]
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in texts + more], "doc_id long, text string, lang_pred string")
    got = {x.doc_id: x for x in lid.predict_language(df, model).collect()}
    right = [got[i].lang_pred == k for i, _, k in texts]
    assert sum(right) / len(right) > 0.97
    for i, _, k in more:
        assert got[i].lang_pred == k and (k == "und") == (got[i].score == 0.0) and got[i].score <= 1.0
    assert 0.55 < got[505].score < 0.8  # a third of the words are of another language
    assert lid.predict_language(df.limit(0), model).count() == 0
    nothing = lid.fit(lid.training_sample(df.limit(0).withColumnRenamed("lang_pred", "lang")))
    assert {x.lang_pred for x in lid.predict_language(df, nothing).collect()} == {"und"}


def test_prediction_does_not_depend_on_the_batch():
    r = random.Random(5)
    model = lid.fit({k: [sentence(r, k, 30) for _ in range(30)] for k in SYLLABLES})
    texts = [sentence(r, r.choice(sorted(SYLLABLES)), r.randint(0, 30)) for _ in range(50)] + ["", "x"]
    names, scores = model.predict(pa.array(texts))
    for t, n, s in zip(texts, names, scores):
        (n1,), (s1,) = model.predict(pa.array([t]))
        assert n1 == n and abs(s1 - s) < 1e-6


def good(r):
    return " ".join(sentence(r, "aa", r.randint(4, 12)).capitalize() + "." for _ in range(r.randint(1, 20)))


def junk(r):
    return r.choice([" | ".join(sentence(r, "aa", 60).split()), "!! ".join(sentence(r, "bb", 40).upper().split()), "\n".join(["the same line"] * 30), " ".join(["the"] * 80)])


def test_quality(spark):
    r = random.Random(8)
    rows = [(i, good(r) if i % 3 else junk(r), int(bool(i % 3)), "x") for i in range(900)]
    docs = spark.createDataFrame([(i, t, q, s) for i, t, q, s in rows], "doc_id long, text string, score int, figures string").repartition(3)
    labels = spark.createDataFrame([(i, q, 0) for i, _, q, _ in rows[:600]] + [(0, None, 0), (None, 1, 0), (5000, 1, 0)], "doc_id long, quality int, toxic int")
    x, y = ql.training_sample(docs, labels)
    assert len(y) == 600 and x.shape[1] == len(ql.FIGURES)
    model = ql.fit(x, y)
    got = {a.doc_id: a.score for a in ql.score_quality(docs, model).collect()}
    assert sum((got[i] >= ql.THRESHOLD) == bool(q) for i, _, q, _ in rows[600:]) / 300 > 0.97
    assert len(ql.training_sample(docs, labels, rows=100)[1]) <= 100
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 200_000), (4, "\n\n"), (1, None)], "doc_id long, text string")
    scores = sorted((a.doc_id, a.score) for a in ql.score_quality(odd, model).collect())
    assert len(scores) == 5 and scores[0] == scores[1] and scores[0][1] == scores[2][1] and all(0 <= s <= 1 for _, s in scores)
    none = ql.fit(*ql.training_sample(docs, labels.limit(0)))
    assert {a.score for a in ql.score_quality(odd, none).collect()} == {0.5}
    assert ql.score_quality(odd.limit(0), model).count() == 0


def test_figures_do_not_depend_on_the_batch():
    r = random.Random(2)
    texts = ["", " ", "\n", "a\na\nb", " lead", "x x y y"] + [good(r) for _ in range(5)] + [junk(r) for _ in range(5)]
    together = ql.figures(pa.array(texts))
    assert np.allclose(together, np.concatenate([ql.figures(pa.array([t])) for t in texts]))
    k = ql.FIGURES.index
    assert together[3, k("repeated_lines")] == 1 / 5 and together[5, k("echoed_words")] == 0.5


def test_letters_and_many_languages(spark):
    r = random.Random(3)
    names = [f"l{k:03d}" for k in range(100)]
    word = lambda k: "".join(chr(97 + (k * 7 + r.randrange(3)) % 26) for _ in range(3)) + chr(97 + k // 26) + chr(97 + k % 26)
    rows = [(k * 4 + j, " ".join(word(k) for _ in range(40)), n) for k, n in enumerate(names) for j in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = lid.training_sample(df)
    assert sorted(sample) == names and all(len(x) == 4 for x in sample.values())
    model = lid.fit(sample, epochs=6)
    got = model.predict(pa.array([t for _, t, _ in rows]))[0]
    assert sum(a == n for a, (_, _, n) in zip(got, rows)) > 380
    # numerals are no letters
    assert model.predict(pa.array(["½ ² ①", "Ⅷ Ⅸ", "12 ١"])) == (["und"] * 3, [0.0] * 3)


def test_training_texts_are_whole_and_copies_count_once(spark):
    long = "x " * 50_000 + "omega"
    df = spark.createDataFrame([(i, "same text", "a") for i in range(500)] + [(900, long, "a"), (901, None, "a"), (902, "12", "a"), (903, "b", None)], "doc_id long, text string, lang string")
    assert {k: sorted(v, key=len) for k, v in lid.training_sample(df, per_label=5).items()} == {"a": ["same text", long]}


def test_additive_scores_trees_and_quadrants_by_brute_force():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 4))
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=600) > 0).astype(float)
    model = ql.fit(x, y)
    assert model.pairs
    got = model.score(x[:50])
    for row, s in zip(x[:50], got):
        bins = [sum(1 for c in cuts if c <= v) for v, cuts in zip(row, model.cuts)]
        z = model.intercept + sum(t[b] for t, b in zip(model.tables, bins))
        coarse = [b * ql.PAIR_BINS // (len(c) + 1) for b, c in zip(bins, model.cuts)]
        z += sum(t[coarse[i]][coarse[j]] for (i, j), t in zip(model.pairs, model.pair_tables))
        assert abs(s - 1 / (1 + np.exp(-z))) < 1e-9

    def value(g, h):
        return g.sum() / (h.sum() + 1)

    def gain(g, h):
        return g.sum() ** 2 / (h.sum() + 1)

    for _ in range(20):
        g, h, n = rng.normal(size=9) * 5, rng.random(9) * 9, rng.integers(0, 30, 9)
        leaves = [(0, 9)]
        while len(leaves) < ql.LEAVES:
            cuts = [(gain(g[a:k], h[a:k]) + gain(g[k:b], h[k:b]) - gain(g[a:b], h[a:b]), a, b, k) for a, b in leaves for k in range(a + 1, b) if min(n[a:k].sum(), n[k:b].sum()) >= ql.LEAST_ROWS]
            if not cuts or max(cuts)[0] <= 1e-9:
                break
            _, a, b, k = max(cuts)
            leaves = [x for x in leaves if x != (a, b)] + [(a, k), (k, b)]
        want = np.zeros(9)
        for a, b in leaves:
            want[a:b] = value(g[a:b], h[a:b])
        assert np.allclose(ql._tree(g, h, n), want)
        g, h = rng.normal(size=(6, 6)), rng.random((6, 6))
        parts = lambda i, j: [(r, c) for r in (slice(0, i), slice(i, 6)) for c in (slice(0, j), slice(j, 6))]
        best = max((sum(gain(g[p], h[p]) for p in parts(i, j)), i, j) for i in range(1, 6) for j in range(1, 6))
        got_gain, table = ql._quadrants(g, h)
        assert np.isclose(got_gain, best[0] - gain(g, h))
        for p in parts(*best[1:]):
            assert np.allclose(table[p], value(g[p], h[p]))
