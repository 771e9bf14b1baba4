"""Toxicity: cumulative-link ordinal regression on sparse text features.

``P(grade > j | x) = sigmoid(w.x - theta_j)`` with one weight vector ``w`` for all ordered
thresholds ``theta_0 <= theta_1 <= ...``; the expected severity is the sum of these
probabilities. ``x`` marks which hashed words, and word beginnings of 4 to 6 letters, a text
holds. ``w`` is learned by FTRL-proximal steps, whose L1 term leaves few weights non-zero.

Defined results: a null or empty text has no feature and gets the severity of the thresholds
alone; texts of any length are read whole; without labelled rows nothing is toxic; of equally likely
grades the lowest is named; an empty table gives an empty result; repeated rows are scored one by one;
columns of the input named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashing
from .common import add_columns, labelled_texts, slices

#: A text is called toxic from this probability of grade 1 or more.
FLAG_AT = 0.4


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    prefixes: tuple[int, ...] = (4, 5, 6)
    epochs: int = 4
    alpha: float = 0.3
    l1: float = 8.0
    l2: float = 1.0
    #: Most labelled rows that training reads. It bounds what reaches the driver.
    sample: int = 8000
    #: Distinct marker features (a word and its beginnings) that a toxic text must hold to get at least grade 2, 3, ...
    steps: tuple[int, ...] = (5, 12)
    seed: int = 11


def occurrences(texts: list[str | None], cfg: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features in no set order, repeats included, and each one's document."""
    t = hashing.Texts(texts)
    start, end = t.cores()
    shift = np.uint64(64 - cfg.bits)
    doc = np.searchsorted(t.starts, start, side="right") - 1
    rows, docs = [hashing.mix(t.span_hash(start, end), 2) >> shift], [doc]
    for n in cfg.prefixes:
        long = end - start > n
        rows.append(hashing.mix(t.span_hash(start[long], start[long] + n), 20 + n) >> shift)
        docs.append(doc[long])
    return np.concatenate(rows).astype(np.int64), np.concatenate(docs)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    cfg: Settings

    def above(self, texts: list[str | None]) -> np.ndarray:
        """P(grade > j) for each text and threshold."""
        rows, docs = occurrences(texts, self.cfg)
        some = np.flatnonzero(self.weights[rows])
        keys = np.unique((docs[some] << self.cfg.bits) | rows[some])
        z = np.bincount(keys >> self.cfg.bits, self.weights[keys & ((1 << self.cfg.bits) - 1)], len(texts))
        return sigmoid(z[:, None] - self.thresholds[None, :])


def grades(bags: list[np.ndarray], toxic: np.ndarray, cfg: Settings) -> np.ndarray:
    """Severity grades where the table only says toxic or not: 0 for clean texts, otherwise 1 plus a
    grade for each of ``cfg.steps`` that the number of distinct marker features reaches. A marker
    occurs in some of every 50 toxic texts of the sample and at least 20 times as rarely in clean ones."""
    size = 1 << cfg.bits
    n1, n0 = max(1, int((toxic == 1).sum())), max(1, int((toxic == 0).sum()))
    c1, c0 = np.zeros(size), np.zeros(size)
    for bag, y in zip(bags, toxic, strict=True):
        (c1 if y else c0)[bag] += 1
    marker = (c1 >= 3 + n1 // 50) & (c1 / n1 > 20 * (c0 + 0.5) / n0)
    return np.array([0 if not y else 1 + sum(int(marker[bag].sum()) >= s for s in cfg.steps) for bag, y in zip(bags, toxic, strict=True)], np.int64)


def fit(bags: list[np.ndarray], grade: np.ndarray, levels: int, cfg: Settings) -> Model:
    """``bags``: each text's distinct features; ``grade``: 0 to ``levels``."""
    size = 1 << cfg.bits
    z, n = np.zeros(size), np.zeros(size)
    over = np.array([((grade > j).sum() + 0.5) / (len(grade) + 1) for j in range(levels)])
    theta = np.maximum.accumulate(np.log((1 - over) / over))
    start = theta.copy()
    rng = np.random.default_rng(cfg.seed)
    js = np.arange(levels)

    def weights(at: np.ndarray) -> np.ndarray:
        v = z[at]
        return np.where(np.abs(v) <= cfg.l1, 0.0, -(v - np.sign(v) * cfg.l1) / ((1 + np.sqrt(n[at])) / cfg.alpha + cfg.l2))

    for _ in range(cfg.epochs):
        for i in rng.permutation(len(grade)):
            bag = bags[i]
            w = weights(bag)
            gap = sigmoid(w.sum() - theta) - (grade[i] > js)
            g = gap.sum()
            n_new = n[bag] + g * g
            z[bag] += g - (np.sqrt(n_new) - np.sqrt(n[bag])) / cfg.alpha * w
            n[bag] = n_new
            theta = np.maximum.accumulate(np.maximum(theta + 0.02 * gap, start * 0.5))
    return Model(weights(np.arange(size)), theta, cfg)


def train(docs: DataFrame, labels: DataFrame, cfg: Settings | None = None) -> Model:
    """Learn severity grades from ``labels.toxic`` on a bounded, hash-picked sample."""
    cfg = cfg or Settings()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in slices(texts):
                rows, at = occurrences(texts[lo:hi], cfg)
                keys = np.unique((at << cfg.bits) | rows)
                cut = np.searchsorted(keys, np.arange(hi - lo + 1) << cfg.bits)
                bags = [(keys[a:b] & ((1 << cfg.bits) - 1)).astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("y").slice(lo, hi - lo), pa.array(bags, pa.binary())], names=["y", "bag"])

    learn = labelled_texts(docs, labels.where(F.col("toxic").isin(0, 1)), F.col("toxic").cast("int"), cfg.sample)
    got = learn.select("y", "text").mapInArrow(run, "y int, bag binary").collect()
    got.sort(key=lambda r: (bytes(r.bag), r.y))
    bags = [np.frombuffer(r.bag, np.int32) for r in got]
    toxic = np.array([r.y for r in got], np.int64)
    return fit(bags, grades(bags, toxic, cfg), len(cfg.steps) + 1, cfg)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``p_toxic``, ``expected_severity``, ``severity`` (likeliest grade) and ``toxic``."""

    def make(texts: list[str | None]) -> list[pa.Array]:
        above = model.above(texts)
        edges = np.hstack([np.ones((len(texts), 1)), above, np.zeros((len(texts), 1))])
        return [pa.array(above[:, 0], pa.float64()), pa.array(above.sum(axis=1), pa.float64()), pa.array((edges[:, :-1] - edges[:, 1:]).argmax(axis=1), pa.int32()), pa.array(above[:, 0] >= FLAG_AT, pa.bool_())]

    return add_columns(docs, text, {"p_toxic": T.DoubleType(), "expected_severity": T.DoubleType(), "severity": T.IntegerType(), "toxic": T.BooleanType()}, make)


def score_all(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs.select("doc_id", "text"), train(docs, labels)).drop("text")
