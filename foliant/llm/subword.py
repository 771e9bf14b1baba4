"""Supervised subword embeddings: hashed word and character n-gram vectors, averaged, softmax.

A text's vector is the mean of the learned vectors of its words, its character
3-grams (word borders included) and its repeated-neighbour marks, each hashed to one of
``2**bits`` rows; a softmax layer gives the class probabilities. Both layers are learned
by numpy stochastic gradient descent on a bounded sample of labelled rows. A feature's vector steps along
the gradient of the mean with 50 times its weight in the text, at most 1, in place of that weight alone:
the true gradient would hardly move the vectors of long texts.

The softmax is linear in the mean, so at scoring time each row's vector is folded into one
number per class: a text costs one table look-up per feature, whatever the vector width.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import slices


@dataclass(frozen=True)
class Settings:
    bits: int = 17
    width: int = 16
    epochs: int = 3
    rate: float = 0.5
    seed: int = 7
    #: Most labelled rows that training reads. It bounds what reaches the driver.
    sample: int = 3000
    grams: tuple[int, ...] = (3,)
    #: Weight of a repeated-neighbour mark against an ordinary feature.
    repeat_weight: float = 4.0


def families(texts: list[str | None], cfg: Settings) -> list[tuple[np.ndarray, np.ndarray, float]]:
    t = hashing.Texts(texts)
    shift = np.uint64(64 - cfg.bits)
    got = [(*t.words(), 1.0), *((*t.grams(n), 1.0) for n in cfg.grams), (*t.repeats(), cfg.repeat_weight)]
    return [((h >> shift).astype(np.int32), b, w) for h, b, w in got]


def bags(texts: list[str | None], cfg: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct rows and their weights, which sum to 1 (none for an empty text)."""
    fam, out = families(texts, cfg), []
    for i in range(len(texts)):
        rows = np.concatenate([h[b[i] : b[i + 1]] for h, b, _ in fam])
        weights = np.concatenate([np.full(b[i + 1] - b[i], w) for _, b, w in fam])
        ids, where = np.unique(rows, return_inverse=True)
        w = np.bincount(where, weights, len(ids))
        out.append((ids.astype(np.int32), (w / max(w.sum(), 1e-9)).astype(np.float32)))
    return out


@dataclass
class Model:
    """``table``: each hashed feature's logit for classes 1, 2, … against class 0; ``bias``: those of an empty text."""

    table: np.ndarray
    bias: np.ndarray
    cfg: Settings

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        fam = families(texts, self.cfg)
        total = np.zeros(len(texts))
        for _, b, w in fam:
            total += w * np.diff(b)
        logits = np.zeros((len(texts), len(self.bias)))
        for k in range(1, len(self.bias)):
            s = np.zeros(len(texts))
            for h, b, w in fam:
                s += w * hashing.sums(self.table[k - 1][h], b)
            logits[:, k] = self.bias[k] + s / np.maximum(total, 1)
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        return p / p.sum(axis=1, keepdims=True)


def fit(ids: list[np.ndarray], weights: list[np.ndarray], y: np.ndarray, classes: int, cfg: Settings) -> Model:
    """Plain SGD, one document a step, over ``cfg.epochs`` shuffled passes with a falling rate."""
    rng = np.random.default_rng(cfg.seed)
    table = rng.uniform(-1 / cfg.width, 1 / cfg.width, (1 << cfg.bits, cfg.width)).astype(np.float32)
    out = np.zeros((cfg.width, classes), np.float32)
    share = np.bincount(y, minlength=classes) + 1.0
    bias = np.log(share / share.sum()).astype(np.float32)
    # A small sample is passed over more often, so that it takes as many steps as a third of a full one.
    epochs = cfg.epochs if not len(y) else max(cfg.epochs, min(60, cfg.sample // len(y)))
    step, steps = 0, max(1, epochs * len(y))
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            rate = cfg.rate * (1 - step / steps)
            step += 1
            rows = table[ids[i]]
            mean = weights[i] @ rows
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = out @ p
            out -= rate * np.outer(mean, p)
            bias -= 0.1 * rate * p
            if len(rows):
                # The mean's gradient is shared by all features; scaled up by their number it keeps
                # the pace of a short text for a long one.
                table[ids[i]] = rows - (rate * np.minimum(weights[i] * 50, 1.0))[:, None] * back
    folded = (table @ (out[:, 1:] - out[:, :1])).T.astype(np.float32)
    return Model(np.ascontiguousarray(folded), (bias - bias[0]).astype(np.float64), cfg)


def bag_rows(cfg: Settings):
    """mapInArrow function: (y, text) to (y, ids, weights as binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in slices(texts):
                got = bags(texts[lo:hi], cfg)
                yield pa.RecordBatch.from_arrays([batch.column("y").slice(lo, hi - lo), pa.array([a.tobytes() for a, _ in got], pa.binary()), pa.array([w.tobytes() for _, w in got], pa.binary())], names=["y", "ids", "weights"])

    return run


def train(labelled: DataFrame, classes: int, cfg: Settings) -> Model:
    """``labelled``: (y int, text), at most ``cfg.sample`` rows. Features are made on the executors."""
    rows = labelled.select(F.col("y").cast("int"), "text").mapInArrow(bag_rows(cfg), "y int, ids binary, weights binary").collect()
    # A defined order, so that the same rows give the same model.
    rows.sort(key=lambda r: (bytes(r.ids), r.y))
    y = np.array([r.y for r in rows], np.int64)
    return fit([np.frombuffer(r.ids, np.int32) for r in rows], [np.frombuffer(r.weights, np.float32) for r in rows], y, classes, cfg)
