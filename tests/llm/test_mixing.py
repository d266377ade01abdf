"""Mixing against numpy, and on awkward tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import mixing


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(4)
    bags = {(1, 0): ["the", "sun", "shines"], (0, 0): ["buy", "now", "!!"], (1, 1): ["idiot", "the", "clown"]}
    kinds = list(bags)
    rows = [(i, " ".join(r.choice(bags[kinds[i % 3]] + ["of"]) for _ in range(r.randint(1, 80))), "x") for i in range(300)]
    rows += [(400, None, "x"), (401, "", "x"), (402, " .!? ", "x"), (402, " .!? ", "x"), (403, "sun " * 30_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rate string")
    labels = spark.createDataFrame([(i, *kinds[i % 3]) for i in range(0, 300, 2)] + [(0, 0, 0), (9999, 1, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


WEIGHTS = {"quality=1,toxic=0": 0.6, "quality=0,toxic=0": 0.3}


def test_expected_tokens_meet_the_targets(spark, corpus):
    docs, labels = corpus
    got = mixing.mix(docs, labels, ["quality", "toxic"], WEIGHTS, 0.8, keep=("doc_id", "text")).collect()
    assert len(got) == 305
    tokens = np.array([x.n_tokens for x in got], float)
    p = np.array([x.memberships for x in got])
    r = np.array([x.rate for x in got])
    assert np.allclose(p.sum(1), 1) and (r >= 0).all() and all(x.copies in (int(x.rate), int(x.rate) + 1) for x in got)
    names = ["quality=0,toxic=0", "quality=1,toxic=0", "quality=1,toxic=1"]
    total = 0.8 * tokens.sum()
    want = total * np.array([0.3, 0.6, 0.1])
    assert np.abs((r * tokens) @ p - want).max() <= 1.01 * mixing.TOLERANCE * total / 3
    right = [x.domain == names[[1, 0, 2][x.doc_id % 3]] for x in got if x.doc_id < 300 and x.n_tokens > 10]
    assert sum(right) / len(right) > 0.95
    odd = {x.doc_id: x for x in got if x.doc_id >= 400}
    assert odd[400].n_tokens == odd[401].n_tokens == odd[402].n_tokens == 0 and odd[400].rate == 1.0 and odd[403].n_tokens == 30_000
    slim = {(x.doc_id, x.n_tokens, round(x.rate, 9), x.copies) for x in mixing.mix(docs, labels, ["quality", "toxic"], WEIGHTS, 0.8).collect()}
    assert slim == {(x.doc_id, x.n_tokens, round(x.rate, 9), x.copies) for x in got}


def test_rates_are_those_of_projected_gradient_steps(spark):
    r = np.random.default_rng(1)
    p = r.dirichlet([0.3, 0.3, 0.3], 200)
    tokens = r.integers(1, 500, 200).astype(float)
    member = spark.createDataFrame([(float(t), [float(v) for v in x]) for t, x in zip(tokens, p)], "_tokens double, _p array<double>")
    target = np.array([0.05, 0.15, 0.8]) * tokens.sum() * 0.7
    history = mixing.fit_rates(member, target.tolist())
    rates, ahead = np.ones(200), np.ones(200)
    g = (p * tokens[:, None]).T @ p
    for momentum, *h in history:
        residual = (ahead * tokens) @ p - target
        assert np.allclose(h, np.linalg.solve(g + np.eye(3) * 1e-9 * np.trace(g), residual))
        new = np.maximum(0, ahead - p @ np.array(h))
        rates, ahead = new, new + momentum * (new - rates)
    assert 1 < len(history) < mixing.ROUNDS
    mine = np.array([x[0] for x in member.select(mixing.rate(F.col("_tokens"), F.col("_p"), history)).collect()])
    assert np.allclose(mine, rates)
    assert np.abs((rates * tokens) @ p - target).max() <= mixing.TOLERANCE * target.sum() / 3


def test_posteriors_are_naive_bayes_over_hashed_words(spark, corpus):
    docs, labels = corpus
    d = mixing.fit_domains(docs, labels, ["quality", "toxic"], buckets=64)
    rows = mixing.memberships(docs, d).select("_p", F.transform(F.filter(mixing.words(F.col("text")), lambda w: w != ""), lambda w: mixing.bucket(w, 64)).alias("ids"))
    for x in rows.limit(60).collect():
        z = np.array([sum(w[i] for i in x.ids) for w in d.weights]) / np.sqrt(max(1, len(x.ids))) + np.array(d.priors)
        e = np.exp(z - z.max())
        assert np.allclose(x._p, e / e.sum())


def test_without_labels_or_rows(spark, corpus):
    docs, labels = corpus
    got = mixing.mix(docs, labels.limit(0), ["quality", "toxic"], {}, 0.5).collect()
    assert {x.domain for x in got} == {"all"} and all(abs(x.rate - 0.5) < 1e-3 for x in got if x.n_tokens)
    assert mixing.mix(docs.limit(0), labels, ["quality", "toxic"], WEIGHTS).count() == 0


def test_forty_domains_and_clashing_names(spark):
    r = random.Random(9)
    rows = [(i, " ".join(r.choice([f"word{i % 40}", "of"]) for _ in range(30)), 1, 2, 3, 4) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _tokens int, _p int, _hash int, _0 int")
    labels = spark.createDataFrame([(i, i % 40) for i in range(400)], "doc_id long, kind int")
    got = mixing.mix(docs, labels, ["kind"], {f"kind={k}": 1 / 40 for k in range(40)}, 0.5, keep=("doc_id", "_tokens", "_p", "_hash", "_0")).collect()
    assert all((x._tokens, x._p, x._hash, x._0) == (1, 2, 3, 4) and len(x.memberships) == 40 for x in got)
    assert sum(x.domain == f"kind={x.doc_id % 40}" for x in got) > 380
    assert abs(sum(x.rate * x.n_tokens for x in got) / sum(x.n_tokens for x in got) - 0.5) < 0.01
