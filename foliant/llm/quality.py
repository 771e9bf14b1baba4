"""Quality classifier: supervised subword embeddings (see ``subword``) over whole texts.

Defined results: a null or empty text gets the model's prior; texts of any length are read whole; a
score of just the threshold is predicted 1; repeated rows are scored one by one; without labelled rows every score is 0.5; an empty table gives an empty result; a column
``score`` or ``predicted`` of the input is replaced. Labels, language, source and id are never
inputs of a score.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import subword
from .common import add_columns, fold, labelled_texts

THRESHOLD = 0.7
#: Labelled rows whose fold (crc32 of the id's text, modulo 4) is this are never learned from.
HELD_OUT_FOLD = 2


def train(docs: DataFrame, labels: DataFrame, cfg: subword.Settings | None = None) -> subword.Model:
    """Learn ``labels.quality`` (0 or 1) from a bounded, hash-picked sample outside the held-out fold."""
    cfg = cfg or subword.Settings()
    learn = labels.where((fold(F.col("doc_id")) != HELD_OUT_FOLD) & F.col("quality").isin(0, 1))
    return subword.train(labelled_texts(docs, learn, F.col("quality"), cfg.sample), 2, cfg)


def score(docs: DataFrame, model: subword.Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: label 1 likelier) and ``predicted``."""

    def make(texts: list[str | None]) -> list[pa.Array]:
        return [pa.array(model.probabilities(texts)[:, 1], pa.float64())]

    scored = add_columns(docs, text, {"score": T.DoubleType()}, make)
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def score_all(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT_FOLD).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pipeline stage: documents that the classifier doesn't reject, with their own columns."""
    model = train(docs, labels)

    def make(texts: list[str | None]) -> list[pa.Array]:
        return [pa.array(model.probabilities(texts)[:, 1] >= THRESHOLD, pa.bool_())]

    return add_columns(docs, "text", {"__good": T.BooleanType()}, make).where("__good").drop("__good")
