"""Mixing to target weights with soft domain memberships.

1. *Domains.* A labelled table (doc_id and label columns) names domains by its
   distinct label combinations. A multinomial classifier over hashed words, fitted on
   a bounded sample of labelled rows, gives each document posteriors p(domain).
2. *Rates.* Each document i gets a rate r_i >= 0, the expected number of times it is
   taken, so that for every domain d the expected tokens, sum_i r_i * tokens_i * p_i(d),
   equal its target. Rates are found by projected-gradient least squares, starting
   at 1: with a_i = tokens_i * p_i and residual g = A r - target, each step is
   r_i <- max(0, r_i - s_i * <a_i, g / scale>), where s_i keeps the step stable.
   Only the residuals, one number for each domain, come to the driver each round;
   a document's rate is recomputed from the history of residuals by an expression,
   so the table of memberships is written once and no rates are shuffled. While rates are
   fitted, tokens, memberships and rates are written anew every STEPS_HELD rounds, so that no more steps
   than these are recomputed.
   The step is in the metric described at fit_rates.
3. *Copies.* The rate's whole part, and one more with the probability of the rest,
   drawn from a hash of the document.

All on DataFrame functions. Null texts have no tokens, the prior's memberships, and
keep rate 1; documents without tokens are not moved by the fit. With an empty or
unlabelled labelled table there is one domain, ``all``. There is no bound on the number of domains but that of the
rows that are learned from. Texts may be of any length. An empty table gives an empty
result; repeated rows are documents of their own; other columns, whatever their names, are ignored, or
kept with ``keep`` (those called n_tokens, domain, memberships, rate or copies are replaced).
"""

from __future__ import annotations

import json
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import cut_lineage

#: Bounds: labelled rows that are learned from, hash buckets of words.
TRAIN_ROWS, BUCKETS = 5_000, 4096
#: Rounds at most, of which so many are recomputed for a document.
ROUNDS, TOLERANCE, STEPS_HELD = 60, 1e-3, 10
_SEPARATORS = r"[\s\p{Punct}]+"


def words(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), _SEPARATORS)


def bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.hash(word), F.lit(buckets))


def numbers(values: list) -> Column:
    """A literal array (of doubles, nested as values are)."""
    kind = "array<array<double>>" if values and isinstance(values[0], list) else "array<double>"
    return F.from_json(F.lit(json.dumps(values)), kind)


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, b: a + b)


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


class Domains:
    """Names, log priors and, for each domain, a log weight for each bucket of words."""

    def __init__(self, names: list[str], priors: list[float], weights: list[list[float]]):
        self.names, self.priors, self.weights = names, priors, weights

    def _evidence(self, ids: Column, k: int) -> Column:
        w = numbers(self.weights[k])
        return F.aggregate(ids, F.lit(0.0), lambda a, i: a + F.get(w, i))

    def posteriors(self, text: Column) -> Column:
        """array<double> of p(domain) for a text.

        The evidence of n words is divided by sqrt(n): words of a text repeat and
        support each other, and memberships are to stay soft.
        """
        if len(self.names) == 1:
            return F.array(F.lit(1.0))
        ids = F.transform(F.filter(words(text), lambda w: w != ""), lambda w: bucket(w, len(self.weights[0])))

        def logs(ids: Column) -> Column:
            soft = F.sqrt(F.greatest(F.size(ids), F.lit(1)).cast("double"))
            return F.array(*(self._evidence(ids, k) / soft + F.lit(p) for k, p in enumerate(self.priors)))

        def shifted(x: Column) -> Column:
            most = F.array_max(x)
            return F.transform(x, lambda v: F.exp(v - most))

        return _let(_let(_let(ids, logs), shifted), lambda e: F.transform(e, lambda v: v / _total(e)))


def domain_of(labels: list[str]) -> Column:
    """A labelled row's domain, as name=value of each label column."""
    return F.concat_ws(",", *(F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in labels))


def fit_domains(docs: DataFrame, labelled: DataFrame, labels: list[str], text: str = "text", rows: int = TRAIN_ROWS, buckets: int = BUCKETS) -> Domains:
    """A classifier from at most so many labelled rows, those of least hash of their id; a document with several rows counts as its first domain."""
    known = labelled.dropna(subset=["doc_id", *labels]).select("doc_id", domain_of(labels).alias("domain"), F.xxhash64("doc_id").alias("h"))
    n = known.count()
    if n > rows:
        known = known.filter(F.col("h") <= int(-(2**63) + min(1.0, 1.2 * rows / n) * (2**64 - 1)))
    # rows pairs of id and name at most, whatever the size of the tables
    picked = known.groupBy("doc_id", "h").agg(F.min("domain").alias("domain")).orderBy("h", "doc_id").limit(rows).select("doc_id", "domain")
    texts = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(picked), "doc_id")
    tokens = texts.select("domain", F.explode(words(F.col("text"))).alias("w")).filter("w <> ''")
    # at most a row for each different word of the sample and domain
    by_bucket = tokens.groupBy("domain", bucket(F.col("w"), buckets).alias("b")).count().collect()
    sizes = {r[0]: r[1] for r in texts.groupBy("domain").count().collect()}
    if not sizes:
        return Domains(["all"], [0.0], [[]])
    names, everything = sorted(sizes), sum(sizes.values())
    counts = {d: [1.0] * buckets for d in names}
    for d, b, c in by_bucket:
        if d in counts:
            counts[d][b] += c
    mean = [sum(counts[d][b] / sum(counts[d]) for d in names) / len(names) for b in range(buckets)]
    weights = []
    for d in names:
        total = sum(counts[d])
        weights.append([round(log(x / total / m), 5) for x, m in zip(counts[d], mean, strict=True)])
    return Domains(names, [log(sizes[d] / everything) for d in names], weights)


def memberships(docs: DataFrame, domains: Domains, text: str = "text") -> DataFrame:
    """docs with _tokens (words) and _p (posteriors)."""
    tokens = F.size(F.filter(words(F.col(text)), lambda w: w != "")).cast("double")
    return docs.withColumns({"_tokens": tokens, "_p": domains.posteriors(F.col(text))})


def _steps(tokens: Column, p: Column, history: list[list[float]], start: Column | None = None) -> Column:
    """struct(r, y): a document's rate after the steps (from start on), and the point ahead of it for the next gradient."""
    if start is None:
        start = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y"))
    if not history:
        return start

    def step(s: Column, h: Column) -> Column:
        new = F.greatest(F.lit(0.0), s["y"] - _total(F.zip_with(p, F.slice(h, 2, F.size(p)), lambda x, g: x * g)))
        return _let(new, lambda r: F.struct(r.alias("r"), (r + F.get(h, F.lit(0)) * (r - s["r"])).alias("y")))

    return F.when(tokens > 0, F.aggregate(numbers(history), start, step)).otherwise(start)


def rate(tokens: Column, p: Column, history: list[list[float]]) -> Column:
    """A document's rate after steps (each: a momentum, then a number for each domain)."""
    return _steps(tokens, p, history)["r"]


def fit_rates(member: DataFrame, targets: list[float], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> list[list[float]]:
    """The steps that bring the expected tokens of each domain to its target.

    Minimises |A r - target|^2 in the metric of G^-1, G = sum_i tokens_i p_i p_i^T, over
    r >= 0, with distances of rates weighted by tokens. In these metrics the gradient's
    share of document i is <p_i, G^-1 residual> and its Lipschitz constant is 1, so steps
    of length 1 never overshoot: without clipping one step is exact. Clipping slows
    that down, so gradients are taken at points ahead (accelerated projected gradient), and
    the momentum starts anew when the residual grows. Ends at the tolerance, or when
    targets out of reach let the residual stand still.
    """
    n = len(targets)
    products = F.flatten(F.transform("_p", lambda x: F.transform("_p", lambda y: F.col("_tokens") * x * y)))
    flat = [0.0] * (n * n)
    for at, total in member.select(F.posexplode(products).alias("at", "v")).groupBy("at").agg(F.sum("v")).collect():
        flat[at] = total or 0.0
    gram = [flat[i * n : (i + 1) * n] for i in range(n)]
    history: list[list[float]] = []
    enough, worst, age = tolerance * max(1.0, sum(targets)) / n, [], 0
    slim, done = member.select("_tokens", "_p"), 0
    for _ in range(rounds):
        start = F.struct(F.col("s.r").alias("r"), F.col("s.y").alias("y")) if done else None
        at = slim.select("_tokens", "_p", _steps(F.col("_tokens"), F.col("_p"), history[done:], start).alias("s"))
        if len(history) - done == STEPS_HELD:
            at = slim = cut_lineage(at)
            done = len(history)
        of = lambda k, i: F.sum(F.col("s")[k] * F.col("_tokens") * F.col("_p")[i]).alias(f"{k}{i}")
        got = [x or 0.0 for x in at.agg(*(of(k, i) for k in "ry" for i in range(n))).first()]
        worst.append(max(abs(x - t) for x, t in zip(got[:n], targets, strict=True)))
        if worst[-1] <= enough or (len(worst) > 12 and min(worst[-10:]) > 0.99 * min(worst[:-10])):
            break
        age = 0 if len(worst) > 1 and worst[-1] > worst[-2] else age + 1
        residual = [x - t for x, t in zip(got[n:], targets, strict=True)]
        history.append([(age - 1) / (age + 2) if age else 0.0, *_solve(gram, residual)])
    return history


def _solve(gram: list[list[float]], residual: list[float]) -> list[float]:
    """gram^-1 residual with a small ridge, for one number a domain."""
    import numpy as np

    g = np.array(gram)
    return np.linalg.solve(g + np.eye(len(g)) * max(1e-12, 1e-9 * np.trace(g)), np.array(residual)).tolist()


def copies(rate: Column, doc_id: Column, text: Column) -> Column:
    """The whole part of a rate, and one more by a hash of the document with the probability of the rest."""
    drawn = F.pmod(F.xxhash64(doc_id, text, F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + (drawn < rate - F.floor(rate)).cast("long")).cast("long")


def targets_of(domains: Domains, weights: dict[str, float], total: float) -> list[float]:
    """Token targets by weight; domains without one share what the weights leave of 1 (or get none)."""
    others = [d for d in domains.names if d not in weights]
    rest = max(0.0, 1.0 - sum(weights.values())) / len(others) if others else 0.0
    share = [weights.get(d, rest) for d in domains.names]
    whole = sum(share) or 1.0
    return [total * x / whole for x in share]


def mix(docs: DataFrame, labelled: DataFrame, labels: list[str], weights: dict[str, float], tokens_kept: float = 1.0, text: str = "text", keep: tuple[str, ...] = ("doc_id",), train_rows: int = TRAIN_ROWS, buckets: int = BUCKETS) -> DataFrame:
    """keep, n_tokens, domain (the likeliest), memberships, rate and copies per row of docs.

    weights: the share of each domain in the mixture; its size is tokens_kept times
    the tokens of docs.
    """
    domains = fit_domains(docs, labelled, labels, text, train_rows, buckets)
    names = tuple(dict.fromkeys([*keep, text]))
    # by place, as the names of columns that are kept are anybody's
    rows = docs.select(*names, F.xxhash64("doc_id", text)).toDF(*(f"_{i}" for i in range(len(names))), "_hash")
    own = f"_{names.index(text)}"
    member = memberships(rows, domains, own)
    # written once: a filter on rates would else pull the memberships into every step of every rate
    kept = cut_lineage(member if text in keep else member.drop(own))
    total = kept.agg(F.coalesce(F.sum("_tokens"), F.lit(0.0))).first()[0]
    history = fit_rates(kept, targets_of(domains, weights, tokens_kept * total))
    best = F.array_position("_p", F.array_max("_p")).cast("int")
    out = kept.withColumn("_rate", rate(F.col("_tokens"), F.col("_p"), history))
    added = {
        "n_tokens": F.col("_tokens").cast("long"),
        "domain": F.element_at(F.array(*map(F.lit, domains.names)), best),
        "memberships": F.col("_p"),
        "rate": F.col("_rate"),
        "copies": copies(F.col("_rate"), F.col("_hash"), F.lit("")),
    }
    return out.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(names) if c in keep and c not in added), *(v.alias(k) for k, v in added.items()))
