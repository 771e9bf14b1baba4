"""Mixing sources to target weights by soft domain membership.

A classifier learned from the labelled table gives each document's domain posteriors
``p_i``; its tokens ``t_i`` count towards every domain in that proportion. Nonnegative rates ``r``
are then fitted by projected gradient descent so that the expected domain totals
``sum_i r_i * t_i * p_i`` come as near to the target totals as they can in least squares.

The gradient (scaled by the tokens, which leaves the projection as it is) is ``p_i . gap`` for every
document, and its step is 1 over the largest eigenvalue of ``sum_i t_i p_i p_i'`` over the documents that
can move. A pass over the documents sends a few sums to the driver (totals, these moments, the least
rate, the norm of the projected gradient). As long as no rate reaches 0, a step changes the
totals by the moments alone, so the driver takes such steps without a pass; where rates may reach 0, the
steps are kept if a pass shows that they help, and cut short if not. A rate depends on the document by its posteriors alone, so it is
replayed from the step vectors and never stored between passes.

A domain that holds less than ``least_mass`` of all expected tokens is absent: it is left out of the fit, the
other shares are scaled up, and ``Fit.absent`` names it. Without a given total, the least one is taken at
which no rate falls below 1, but at most ``growth`` times the tokens there are; where the targets would
take more, ``Fit.residual`` tells by how much they are missed.

Defined results: a null or empty text has no tokens, the classifier's prior as posterior and
the rate that goes with it; texts of any length are read whole; an empty table gives an empty result;
labelled rows of domains without a target are not learned from; repeated rows are handled one by one;
of equal posteriors none comes first, as all count; ``mix_all`` has the columns it names, ``mixed`` those of its input, whatever they are called.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import subword
from .common import add_columns, checkpointed, labelled_texts

#: Share of all tokens that each domain is to have.
TARGETS = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}
SETTINGS = subword.Settings(bits=16, width=8, epochs=2, sample=2000, grams=(3,))


def train(docs: DataFrame, labels: DataFrame, domains: list[str], domain: str = "lang", cfg: subword.Settings = SETTINGS) -> subword.Model:
    """Domain classifier from the documents of the labelled table (a bounded, hash-picked sample)."""
    y = reduce(lambda w, kd: w.when(F.col(domain) == kd[1], F.lit(kd[0])), enumerate(domains), F.when(F.lit(False), F.lit(0)))
    named = docs.select("doc_id", "text", y.alias("__y"))
    rows = labelled_texts(named.where("__y is not null"), labels.select("doc_id").join(named.where("__y is not null").select("doc_id", "__y"), "doc_id"), F.col("__y"), cfg.sample)
    return subword.train(rows, len(domains), cfg)


def posteriors(docs: DataFrame, model: subword.Model, domains: list[str]) -> DataFrame:
    """``docs`` with ``n_tokens`` (white-space separated) and a column ``p_<domain>`` each."""

    def make(texts: list[str | None]) -> list[pa.Array]:
        p = model.probabilities(texts)
        return [pa.array([len(t.split()) if t else 0 for t in texts], pa.int64()), *(pa.array(p[:, k], pa.float64()) for k in range(len(domains)))]

    return add_columns(docs, "text", {"n_tokens": T.LongType(), **{f"p_{d}": T.DoubleType() for d in domains}}, make)


@dataclass
class Fit:
    domains: list[str]
    targets: np.ndarray
    steps: list[np.ndarray]
    totals: np.ndarray
    absent: list[str]
    passes: int
    #: Norm of the projected gradient at the last pass, and the largest miss of a target, both as shares of the total.
    gradient: float
    residual: float

    def rate(self) -> Column:
        """The fitted rate as an expression of the ``p_`` columns."""
        return replay(self.domains, self.steps)


def _dot(domains: list[str], v: np.ndarray) -> Column:
    return reduce(lambda a, b: a + b, [F.col(f"p_{d}") * float(x) for d, x in zip(domains, v, strict=True)])


def replay(domains: list[str], steps: list[np.ndarray]) -> Column:
    r = F.lit(1.0)
    for step in steps:
        r = F.greatest(F.lit(0.0), r - _dot(domains, step))
    return r


@dataclass
class Sums:
    """What one pass over the documents sends: totals, moments of the documents that can move, the least rate above 0,
    how many documents have a rate of 0."""

    totals: np.ndarray
    moment: np.ndarray
    low: float
    n_zero: int


def sums(points: DataFrame, domains: list[str], steps: list[np.ndarray], gap: np.ndarray | None = None) -> Sums:
    """A pass. A document can move if its rate is above 0 or the gradient of ``gap`` raises it."""
    k = len(domains)
    pull = F.lit(0.0) if gap is None else _dot(domains, gap)
    held = points.select(*(f"p_{d}" for d in domains), F.col("n_tokens").cast("double").alias("t"), replay(domains, steps).alias("r"), pull.alias("g")).where("t > 0")
    free = (F.col("r") > 0) | (F.col("g") < 0)
    parts = [F.sum(F.col("t") * F.col("r") * F.col(f"p_{d}")).alias(f"a{i}") for i, d in enumerate(domains)]
    parts += [F.sum(F.when(free, F.col("t") * F.col(f"p_{domains[i]}") * F.col(f"p_{domains[j]}"))).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]
    got = held.agg(*parts, F.min(F.when(F.col("r") > 0, F.col("r"))).alias("low"), F.count_if(F.col("r") <= 0).alias("n_zero")).first().asDict()
    moment = np.array([[got[f"m{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    return Sums(np.array([got[f"a{i}"] or 0.0 for i in range(k)]), moment, got["low"] or 0.0, got["n_zero"])


def descend(moment: np.ndarray, gap: np.ndarray, there: np.ndarray, low: float, most: int = 20_000, tolerance: float = 1e-10) -> np.ndarray:
    """The sum of gradient steps while the moments hold: until the gap stops shrinking, or a rate of ``low`` may reach 0."""
    bound = float(np.linalg.eigvalsh(moment)[-1])
    step = np.zeros(len(gap))
    least = tolerance * max(float(np.abs(gap).max()), 1e-300)
    for _ in range(most):
        v = gap / bound
        step = step + v
        change = np.where(there, moment @ v, 0.0)
        gap = gap - change
        # Posteriors sum to 1, so no rate falls by more than the largest part of the step.
        if step.max() >= low or np.abs(change).max() <= least:
            break
    return step


def fit(points: DataFrame, weights: dict[str, float], total: float | None = None, passes: int = 60, tolerance: float = 1e-6, least_mass: float = 1e-3, growth: float = 4.0) -> Fit:
    """Rates for ``points`` (``n_tokens`` and the ``p_`` columns). ``total``: the expected tokens of the mixture."""
    domains = list(weights)
    steps: list[np.ndarray] = []
    now = sums(points, domains, steps)
    whole, tokens = now.moment, float(now.totals.sum())
    share = np.array([weights[d] for d in domains], float)
    there = now.totals > least_mass * tokens
    absent = [d for d, ok in zip(domains, there, strict=True) if not ok]
    if not there.any() or not share[there].sum():
        return Fit(domains, now.totals, steps, now.totals, absent, 1, 0.0, 0.0)
    share = np.where(there, share, 0) / share[there].sum()
    if total is None:
        pull = np.linalg.pinv(whole[np.ix_(there, there)], rcond=1e-9) @ share[there]
        total = min(growth * tokens, max([1 / v for v in pull if v > 1e-300], default=tokens))
    targets = share * total
    n = 1
    while True:
        # An absent domain has no target to miss.
        gap = np.where(there, now.totals - targets, 0.0)
        moment = whole
        if now.n_zero:
            moment, n = sums(points, domains, steps, gap).moment, n + 1
        norm = math.sqrt(max(float(gap @ moment @ gap), 0.0)) / math.sqrt(tokens)
        miss = float(np.abs(gap).max())
        if n >= passes or min(norm, miss) <= tolerance * max(total, 1.0):
            return Fit(domains, targets, steps, now.totals, absent, n, norm / max(total, 1.0), miss / max(total, 1.0))
        # Many steps on these moments may pass a rate's 0, where the moments change: they hold if they bring the totals
        # nearer by a tenth, otherwise the steps end at the first that may reach one, which always brings them nearer.
        far = sums(points, domains, [*steps, long := descend(moment, gap, there, math.inf)])
        if float((np.where(there, far.totals - targets, 0.0) ** 2).sum()) <= 0.8 * float((gap**2).sum()):
            now, n = far, n + 1
            steps.append(long)
        else:
            steps.append(descend(moment, gap, there, now.low))
            now, n = sums(points, domains, steps), n + 2


def rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, domain: str = "lang") -> tuple[DataFrame, Fit]:
    """(doc_id, n_tokens, p_*, rate) of every document, and the fit."""
    weights = weights or TARGETS
    model = train(docs, labels, list(weights), domain)
    points = checkpointed(posteriors(docs.select("doc_id", "text"), model, list(weights)).drop("text"))
    found = fit(points, weights)
    return points.withColumn("rate", found.rate()), found


def repeats(rate: Column, key: Column) -> Column:
    """Whole copies whose expectation is ``rate``: its floor, and one more by a hash of ``key``."""
    part = (F.pmod(F.xxhash64(key, F.lit(53)), F.lit(1 << 30)) / float(1 << 30)).cast("double")
    return (F.floor(rate) + (part < rate - F.floor(rate)).cast("long")).cast("int")


def mix_all(docs: DataFrame, labels: DataFrame) -> DataFrame:
    got, _ = rates(docs, labels)
    return got.withColumn("n_copies", repeats(F.col("rate"), F.col("doc_id")))


def mixed(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, domain: str = "lang") -> DataFrame:
    """Pipeline stage: every document as often as its rate says, and at least once. The default total leaves
    no rate below 1 where the targets can be met; where they can't, a rate of 0 must not lose a document."""
    weights = weights or TARGETS
    model = train(docs, labels, list(weights), domain)
    points = checkpointed(posteriors(docs.select("text"), model, list(weights)).drop("text"))
    rate = fit(points, weights).rate()
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")
    marked = posteriors(rows, model, list(weights)).withColumn("copies", F.greatest(F.lit(1), repeats(rate, F.xxhash64("doc_id", "text"))))
    return marked.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
