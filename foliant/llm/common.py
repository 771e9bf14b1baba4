"""Shared pieces of the training-data operators: checkpointing, folds, bounded samples."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows a scoring function takes from an Arrow batch at a time, so that numpy temporaries stay small.
SLICE_CHARS = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the cluster's shared checkpoint folder and cut its lineage.

    The folder is the session's ``spark.checkpoint.dir``; a private one is made only where that is unset and
    driver and executors are one process (tests, local runs). Spark deletes folders of checkpoints that nothing
    refers to any more if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="foliant-ckpt-"))
    return df.checkpoint(eager=True)


#: Rows of narrow tables to a partition.
ROWS_A_PART = 50_000


def parts_for(spark: SparkSession, n_rows: int) -> int:
    """Partitions for so many narrow rows: a shuffle writes a few files for each partition that it reads from, so a small
    table in hundreds of partitions costs more in files than in data."""
    return max(spark.sparkContext.defaultParallelism, -(-n_rows // ROWS_A_PART))


def compact(df: DataFrame) -> DataFrame:
    """``df`` materialised, in as many partitions as its rows need."""
    done = checkpointed(df)
    return done.coalesce(parts_for(df.sparkSession, done.count()))


def fold(doc_id: Column, n: int = 4) -> Column:
    """crc32 of the id's decimal text, modulo ``n``; null ids fall in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % n, F.lit(0))


def bounded_sample(labelled: DataFrame, key: str, limit: int) -> DataFrame:
    """At most ``limit`` labelled rows, picked by a hash of ``key``: the same rows at every run.

    The bound makes the result safe to broadcast and to bring to the driver.
    """
    return labelled.orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(limit)


def slices(texts: list[str | None], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``most`` characters; a longer text stands alone."""
    yield from ranges([len(text) if text else 0 for text in texts], most)


def ranges(sizes: list[int | None], most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` in sum; a larger row stands alone."""
    start = size = 0
    for i, n in enumerate(sizes):
        n = (n or 0) + 1
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)


def labelled_texts(docs: DataFrame, labels: DataFrame, y: Column, limit: int) -> DataFrame:
    """(y, text) of at most ``limit`` labelled documents: one row for each labelled id.

    ``labels`` rows whose ``y`` or ``doc_id`` is null are left out. The sample of ids is bounded,
    so it is broadcast; of repeated rows of one id the smallest text and the largest label count.
    """
    picked = labels.select("doc_id", y.alias("y")).where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    picked = bounded_sample(picked, "doc_id", limit)
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"), F.min("text").alias("text")).select("y", "text")


def add_columns(df: DataFrame, text: str, new: dict[str, T.DataType], make: Callable[[list[str | None]], list[pa.Array]]) -> DataFrame:
    """``df`` with columns that ``make`` computes from slices of the column ``text``.

    A column of ``df`` with the name of a new one is replaced. Whole texts are passed, nulls as None.
    """
    df = df.drop(*[c for c in df.columns if c in new and c != text])
    fields = df.schema.fields
    names = [f"c{i}" for i in range(len(fields) + len(new))]
    schema = T.StructType([T.StructField(n, t, True) for n, t in zip(names, [*(f.dataType for f in fields), *new.values()], strict=True)])
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Only a slice's texts are Python objects at a time.
            for lo, hi in ranges(pc.binary_length(batch.column(at)).to_pylist(), SLICE_CHARS):
                cut = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*cut.columns, *make(cut.column(at).to_pylist())], names=names)

    return df.toDF(*names[: len(fields)]).mapInArrow(run, schema).toDF(*df.columns, *new)
