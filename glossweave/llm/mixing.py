"""Mixing sources to target weights with soft membership, in DataFrame functions only.

A labelled table (doc_id, domain) trains a multinomial naive Bayes classifier over hashed words (a
bounded sample: the first `SAMPLE` labelled documents in hash order). It gives every document a posterior
over the domains, whatever source it came from. With n_i words, posterior p_i and rate r_i of document i,
the expected token total of domain d is sum_i r_i n_i p_id. Rates are fitted by projected gradient on the
least-squares distance of these totals from the targets (in the metric in which the documents' own
second moments are the identity, so steps of length one converge, with momentum): each step sums the
totals over all documents, moves every rate by -p_i . s, and projects it to r_i >= 0. A rate depends on its document's
posterior and the few step vectors alone, so it is a column expression: nothing is joined or collected
but one row of sums a step.

`mix` takes each document floor(r) times, and once more where a hash of it falls below the rest of r.

Defined cases: null and empty texts have no words, the prior as posterior, and a rate like any other;
labelled rows with a null id or domain, or a domain without target, are left out; domains without labelled
documents get no rate of their own; without any labelled documents all rates are 1; a repeated label
counts as often as it stands; repeated documents are taken alike; in `mix` clashing extra columns stay as they
are, `rated` takes tables without columns named as those it adds.

A document's words say as much as `EVIDENCE` words of their kind at most: posteriors of long texts would
be 0 or 1 otherwise, though their words are no independent draws. All words count in the mean.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SAMPLE = 10_000
BUCKETS = 4_096
EVIDENCE = 40
ROUNDS = 60
TOLERANCE = 1e-5


def words_of(text: Column) -> Column:
    """Array of the words between white space, lower-cased."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"\s+", -1), lambda w: w != "")


def _bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.hash(word), F.lit(buckets))


def _adding(table: Column):
    return lambda total, bucket: total + table[bucket]


class DomainModel:
    """Per domain, the log weights of word buckets less their mean over the domains, and the log prior."""

    def __init__(self, domains: list[str], prior: list[float], weights: np.ndarray):
        self.domains, self.prior, self.weights = domains, prior, weights

    def scores(self, buckets: Column) -> Column:
        """Array of log scores; the words' mean log weight counts as that of `EVIDENCE` words at most."""
        n = F.size(buckets)
        share = F.when(n > 0, F.least(n, F.lit(EVIDENCE)) / n).otherwise(0.0)
        table = [F.split(F.lit(",".join(f"{x:.5f}" for x in w)), ",").cast("array<double>") for w in self.weights]  # folded to literals
        return F.array(*[F.lit(q) + share * F.aggregate(buckets, F.lit(0.0), _adding(t)) for q, t in zip(self.prior, table, strict=True)])

def train(docs: DataFrame, labelled: DataFrame, domains: list[str], sample: int = SAMPLE, buckets: int = BUCKETS) -> DomainModel | None:
    rows = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("domain").cast("string").alias("domain")).where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # `sample` pairs at most
    counted = texts.select("domain", F.explode(words_of(F.col("text"))).alias("w")).groupBy("domain", _bucket(F.col("w"), buckets).alias("b")).agg(F.count("*").alias("n"))
    sizes = dict(texts.groupBy("domain").agg(F.count("*").alias("n")).collect())
    if not sizes:
        return None
    known = sorted(sizes)
    table = np.zeros((len(known), buckets))
    for domain, b, n in counted.collect():  # domains times buckets rows at most
        table[known.index(domain), b] = n
    smooth = (table + 0.5) / (table.sum(1, keepdims=True) + 0.5 * buckets)
    weights = np.log(smooth)
    whole = sum(sizes.values())
    return DomainModel(known, [math.log(sizes[d] / whole) for d in known], weights - weights.mean(0))


def with_posteriors(docs: DataFrame, model: DomainModel, buckets: int = BUCKETS) -> DataFrame:
    """The columns of `docs` and __n (words) and __p (posteriors in the order of model.domains)."""
    columns = docs.columns
    coded = docs.select("*", F.transform(words_of(docs["text"]), lambda w: _bucket(w, buckets)).alias("__b"))
    scored = coded.select(*columns, F.size("__b").cast("double").alias("__n"), model.scores(F.col("__b")).alias("__s"))
    top = scored.select(*columns, "__n", "__s", F.array_max("__s").alias("__m"))
    raised = top.select(*columns, "__n", F.transform("__s", lambda s: F.exp(s - F.col("__m"))).alias("__e"))
    total = F.aggregate("__e", F.lit(0.0), lambda a, x: a + x)
    shared = raised.select(*columns, "__n", "__e", total.alias("__t"))
    return shared.select(*columns, "__n", F.transform("__e", lambda x: x / F.col("__t")).alias("__p"))


def _moved(steps: list[list[float]], momentum: float = 0.0) -> Column:
    """The point after the projected steps, carried on by `momentum` times the last change: an expression over
    __p. A step is its own momentum followed by its vector."""
    start = F.struct(F.lit(1.0).alias("now"), F.lit(1.0).alias("before"))

    def step(s, v):
        ahead = s["now"] + v[0] * (s["now"] - s["before"])
        pull = F.aggregate(F.zip_with("__p", F.slice(v, 2, F.size(v)), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
        return F.struct(F.greatest(F.lit(0.0), ahead - pull).alias("now"), s["now"].alias("before"))

    if not steps:
        return F.lit(1.0)
    spelled = ";".join(",".join(map(repr, v)) for v in steps)
    vectors = F.transform(F.split(F.lit(spelled), ";"), lambda x: F.split(x, ",").cast("array<double>"))
    return F.aggregate(vectors, start, step, lambda s: s["now"] + momentum * (s["now"] - s["before"]))


def rate_of(steps: list[list[float]]) -> Column:
    """The rate after the projected steps, as an expression over __p."""
    return _moved(steps)


def fit_rates(members: DataFrame, targets: list[float], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> list[list[float]]:
    """Steps of the accelerated projected gradient. members: __n, __p; targets: share of all tokens for each domain."""
    size = len(targets)
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    p = [F.col("__p")[k] for k in range(size)]
    first = members.agg(F.sum("__n"), *[F.sum(F.col("__n") * p[i] * p[j]) for i, j in pairs]).first()
    whole = first[0] or 0.0
    if whole <= 0:
        return []
    moments = np.zeros((size, size))
    for (i, j), x in zip(pairs, first[1:], strict=True):
        moments[i, j] = moments[j, i] = x / whole
    scale = np.linalg.pinv(moments + 1e-9 * np.eye(size))
    steps: list[list[float]] = []
    pace = 1.0
    for _ in range(rounds):
        faster = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        momentum = (pace - 1) / faster if steps else 0.0
        pace = faster
        now = members.select("__n", "__p", _moved(steps, momentum).alias("__r")).agg(*[F.sum(F.col("__n") * F.col("__r") * x) for x in p]).first()
        off = np.array(list(now)) / whole - np.array(targets)
        steps.append([momentum, *[round(float(x), 10) for x in scale @ off]])
        if np.abs(off).max() <= tolerance:
            break
    return steps


def rated(docs: DataFrame, labelled: DataFrame, targets: dict[str, float]) -> DataFrame:
    """The columns of `docs` and __n, __p, __rate, __copies; `targets` are the domains' weights of all tokens."""
    wanted = {d: w for d, w in targets.items() if w >= 0}
    model = train(docs, labelled, sorted(wanted))
    if model is None:
        return docs.select("*", F.size(words_of(docs["text"])).cast("double").alias("__n"), F.array(F.lit(1.0)).alias("__p"), F.lit(1.0).alias("__rate"), F.lit(1).cast("long").alias("__copies"))
    whole = sum(wanted[d] for d in model.domains) or 1.0
    scored = with_posteriors(docs, model)
    members = materialize(scored.select("__n", "__p"), "mixing-members")
    steps = fit_rates(members, [wanted[d] / whole for d in model.domains])
    rate = F.round(rate_of(steps), 6)
    chance = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit("mixing")), F.lit(1 << 30)) / float(1 << 30)
    rates = scored.select("*", rate.alias("__rate"))
    return rates.select("*", (F.floor("__rate") + (chance < F.col("__rate") - F.floor("__rate")).cast("int")).cast("long").alias("__copies"))


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float]) -> DataFrame:
    """The rows of `docs`, each as often as its rate asks, in the columns of `docs`."""
    # all columns as one, so that none clashes with those of the computation
    packed = docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", "text")
    # an outer generator, so that no filter on the copies is pushed below and evaluates the classifier again
    repeated = F.explode_outer(F.array_repeat(F.lit(1), F.col("__copies").cast("int")))
    return rated(packed, labelled, targets).withColumn("__copy", repeated).where("__copy is not null").select("__row.*")
