"""Exact top-k by integer inner product: block-at-a-time pruning over document ranges.

A component of a vector is a term, its integer the term's weight. Rows are dealt by ranges of ids,
and each range is cut into blocks of rows in id order. A block keeps its forward index (ids and
weights, row by row) and for each term the largest and the least weight. What a query can score in a
block is at most the sum, over terms, of its weight times the block's maximum (its minimum, where the
query's weight is negative).

A query is scored in its own range first: its blocks, highest bound first, through their forward
indexes, until no bound reaches its k-th score. That score is a floor for all rows, so the query is
sent only to ranges whose bound reaches it, and there it goes on in the same way. Rows of a range
stay in one task, which streams the queries; a query's hits of all ranges meet in one top-k.

Defined results: a component x counts as floor(1024 * x), computed in doubles; vectors that are null
or hold null or non-finite components take no part, nor do rows without an id; a vector shorter than
another counts as 0 in what it lacks; of several rows of one id the least vector counts; of equal scores the
smaller id comes first; with fewer than ``k`` candidates all are returned; an empty table gives an empty
result; other columns are ignored. Scores must fit in 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed


@dataclass(frozen=True)
class Settings:
    k: int = 10
    #: Rows to a block, and rows of a range in expectation (a range's blocks are held by one task).
    block: int = 256
    part: int = 65_536
    #: Queries that a range looks at side by side.
    chunk: int = 512
    #: Bounds of so many ranges are sent to the tasks at most; beyond it, queries go to every range.
    summaries: int = 65_536


#: A block's ids, weights (int64, row by row), flags of query rows, and extremes of each term.
BLOCKS = "part int, block int, n int, ids binary, index binary, asks binary, hi binary, lo binary"
QUERIES = "part int, query_id long, v binary, best array<long>, ids array<long>"
ROUTED = "part int, n int, ids binary, index binary, least binary"
INT = np.int64


def ints(b: bytes) -> np.ndarray:
    return np.frombuffer(b, INT)


def padded(rows: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), INT)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r[:width]
    return out


def product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: by doubles where none can be rounded."""
    size = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    return (q.astype(float) @ x.astype(float).T).astype(INT) if size < 2.0**53 else q @ x.T


def bounds(q: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """The most that each query can score in each block."""
    return product(np.maximum(q, 0), hi) + product(np.minimum(q, 0), lo)


class Range:
    """The blocks of one range of ids."""

    def __init__(self, rows: list[tuple[bytes, bytes, bytes, bytes]]):
        self.ids = [ints(r[0]) for r in rows]
        flat = [ints(r[1]).reshape(len(i), -1) for r, i in zip(rows, self.ids, strict=True)]
        self.width = max((f.shape[1] for f in flat), default=0)
        # A term that a block lacks weighs 0 in it.
        self.index, self.hi, self.lo = flat, padded([ints(r[2]) for r in rows], self.width), padded([ints(r[3]) for r in rows], self.width)

    def search(self, q: np.ndarray, own: np.ndarray, least: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(scores, ids) of each query's best ``k`` rows that reach ``least``, best first.

        Each round takes the next blocks in a query's order, twice as many as the round before; queries that
        want the same block are scored in one product.
        """
        m, q = len(q), padded(list(q), max(self.width, q.shape[1]))[:, : self.width]
        bound = bounds(q, self.hi, self.lo)
        order = np.argsort(-bound, axis=1, kind="stable")
        ranked = np.take_along_axis(bound, order, axis=1)
        top = [(np.zeros(0, INT), np.zeros(0, INT))] * m
        floor, done, wide, live = least.copy(), 0, 1, np.arange(m)
        while len(live) and done < order.shape[1]:
            upto = min(order.shape[1], done + wide)
            want = ranked[live, done:upto] >= floor[live, None]
            who, col = np.nonzero(want)
            at, who = order[live[who], done + col], live[who]
            got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            by = np.argsort(at, kind="stable")
            cuts = np.flatnonzero(np.diff(at[by])) + 1
            for part in np.split(by, cuts) if len(by) else ():
                b, asks = int(at[part[0]]), who[part]
                got.append(self._score(b, asks, q[asks], own[asks], floor[asks], k))
            if got:
                asks, score, ids = (np.concatenate(x) for x in zip(*got, strict=True))
                for i in np.unique(asks):
                    mine = asks == i
                    s, d = np.concatenate([top[i][0], score[mine]]), np.concatenate([top[i][1], ids[mine]])
                    best = np.lexsort((d, -s))[:k]
                    top[i] = s[best], d[best]
                    if len(best) == k:
                        floor[i] = max(floor[i], s[best[-1]])
            done, wide = upto, 2 * wide
            live = live[ranked[live, done] >= floor[live]] if done < order.shape[1] else live[:0]
        return top

    def _score(self, b: int, asks: np.ndarray, q: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, score and id of the rows of a block that may be among a query's best."""
        ids = self.ids[b]
        s = product(q[:, : self.index[b].shape[1]], self.index[b])
        may = (s >= floor[:, None]) & (ids[None, :] != own[:, None])
        if len(ids) > k + 1:
            # One of the k + 1 best may be the query itself.
            may &= s >= np.partition(s, len(ids) - k - 1, axis=1)[:, len(ids) - k - 1, None]
        who, row = np.nonzero(may)
        score = s[who, row]
        # Ties can be many: only a query's first k of the block go on.
        by = np.lexsort((row, -score, who))
        who, row, score = who[by], row[by], score[by]
        first = np.searchsorted(who, who)
        keep = np.arange(len(who)) - first < k
        return asks[who[keep]], score[keep], ids[row[keep]]


def ranges_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Range, np.ndarray]]:
    """(part, range, flags of its query rows) of a partition's blocks."""
    rows, flags, at = [], [], None
    for b in batches:
        for part, *row, asks in zip(*(b.column(c).to_pylist() for c in ("part", "ids", "index", "hi", "lo", "asks")), strict=True):
            if rows and part != at:
                yield at, Range(rows), np.concatenate(flags)
                rows, flags = [], []
            at = part
            rows.append(tuple(row))
            flags.append(np.frombuffer(asks, bool))
    if rows:
        yield at, Range(rows), np.concatenate(flags)


def pack(rows: DataFrame, is_query: Callable[[Column], Column], id_col: str, vector: str, cfg: Settings) -> tuple[DataFrame, int]:
    """The blocks, rows dealt by ranges of ids, one row of ``BLOCKS`` for each block; and how many ranges there are at most."""
    v = F.col(vector).cast("array<double>")
    ok = F.col(id_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = rows.where(ok).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * 1024)).cast("array<long>").alias("v"))
    some = some.withColumn("asks", F.coalesce(is_query(F.col("id")), F.lit(False)))
    spark = rows.sparkSession
    n = max(spark.sparkContext.defaultParallelism, -(-rows.count() // cfg.part))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray, bool]] = []
        last, part, block = None, None, 0

        def block_of(some: list[tuple[int, np.ndarray, bool]]) -> pa.RecordBatch:
            x = padded([r[1] for r in some], max(len(r[1]) for r in some))
            columns = [np.array([r[0] for r in some], INT), x, np.array([r[2] for r in some], bool), x.max(axis=0, initial=np.iinfo(INT).min), x.min(axis=0, initial=np.iinfo(INT).max)]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([len(some)], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in columns)], names=["part", "block", "n", "ids", "index", "asks", "hi", "lo"])

        for b in batches:
            vectors = b.column("v")
            flat, at = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_pylist()
            for p, i, lo, hi, asks in zip(b.column("part").to_pylist(), b.column("id").to_pylist(), at[:-1], at[1:], b.column("asks").to_pylist(), strict=True):
                if i == last:
                    continue
                last, part = i, p
                held.append((i, flat[lo:hi], asks))
                if len(held) == cfg.block:
                    yield block_of(held)
                    held, block = [], block + 1
        if held:
            yield block_of(held)

    dealt = some.repartitionByRange(n, "id").sortWithinPartitions("id", "v").select(F.spark_partition_id().alias("part"), "id", "v", "asks")
    return checkpointed(dealt.mapInArrow(run, BLOCKS)), n


def search(rows: DataFrame, is_query: Callable[[Column], Column], id_col: str = "vec_id", vector: str = "embedding", cfg: Settings | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``cfg.k`` best rows for each row that ``is_query`` (of ``id``) picks."""
    cfg = cfg or Settings()
    k, no_floor = cfg.k, np.iinfo(INT).min
    blocks, n_ranges = pack(rows, is_query, id_col, vector, cfg)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The queries of a range, scored in it."""
        for part, there, flags in ranges_of(batches):
            ids = np.concatenate(there.ids)
            vectors = [v for x in there.index for v in x]
            picked = np.flatnonzero(flags)
            for lo in range(0, len(picked), cfg.chunk):
                at = picked[lo : lo + cfg.chunk]
                top = there.search(padded([vectors[i] for i in at], there.width), ids[at], np.full(len(at), no_floor), k)
                columns = [pa.array([part] * len(at), pa.int32()), pa.array(ids[at]), pa.array([vectors[i].tobytes() for i in at], pa.binary()), pa.array([s for s, _ in top], pa.list_(pa.int64())), pa.array([d for _, d in top], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "query_id", "v", "best", "ids"])

    queries = checkpointed(blocks.mapInArrow(own, QUERIES))
    sums = summaries(blocks, n_ranges <= cfg.summaries)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks of queries for every other range whose bound reaches their floor."""
        for b in batches:
            home = np.array(b.column("part").to_pylist())
            ids, vectors = np.array(b.column("query_id").to_pylist(), INT), [ints(v) for v in b.column("v").to_pylist()]
            least = np.array([s[-1] if len(s) == k else no_floor for s in b.column("best").to_pylist()], INT)
            for lo in range(0, len(ids), cfg.chunk):
                cut = slice(lo, lo + cfg.chunk)
                q = padded(vectors[cut], max((len(v) for v in vectors[cut]), default=0))
                for part, hi, low in sums:
                    to = home[cut] != part
                    if hi is not None and to.any():
                        w = max(q.shape[1], len(hi))
                        to &= bounds(padded(list(q), w), padded([hi], w), padded([low], w))[:, 0] >= least[cut]
                    if to.any():
                        columns = [ids[cut][to], q[to], least[cut][to]]
                        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([int(to.sum())], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in columns)], names=["part", "n", "ids", "index", "least"])

    routed = queries.mapInArrow(route, ROUTED)
    stream = blocks.select("part", F.lit(0).alias("kind"), "block", "n", "ids", "index", "hi", "lo", F.lit(None).cast("binary").alias("least")).unionByName(
        routed.select("part", F.lit(1).alias("kind"), F.lit(0).alias("block"), "n", "ids", "index", F.lit(None).cast("binary").alias("hi"), F.lit(None).cast("binary").alias("lo"), "least")
    )

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A range's blocks come first, then the queries sent to it."""
        at, held, there = None, [], None
        for b in batches:
            for part, kind, n, ids, index, hi, lo, least in zip(*(b.column(c).to_pylist() for c in ("part", "kind", "n", "ids", "index", "hi", "lo", "least")), strict=True):
                if part != at:
                    at, held, there = part, [], None
                if not kind:
                    held.append((ids, index, hi, lo))
                    continue
                there = there or Range(held)
                asks = ints(ids)
                top = there.search(ints(index).reshape(n, -1), asks, ints(least), k)
                sizes = [len(s) for s, _ in top]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asks, sizes)), pa.array(np.concatenate([d for _, d in top])), pa.array(np.concatenate([s for s, _ in top]))], names=["query_id", "vec_id", "score"])

    found = stream.repartition(n_ranges, "part").sortWithinPartitions("part", "kind", "block").mapInArrow(visit, "query_id long, vec_id long, score long")
    near = queries.select("query_id", F.explode(F.arrays_zip(F.col("ids").alias("vec_id"), F.col("best").alias("score"))).alias("hit")).select("query_id", "hit.vec_id", "hit.score")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.unionByName(found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def summaries(blocks: DataFrame, weights: bool) -> list[tuple[int, np.ndarray | None, np.ndarray | None]]:
    """(part, largest, least weights of each term) of every range; without the weights if they aren't asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, there, _ in ranges_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([there.hi.max(axis=0).tobytes()], pa.binary()), pa.array([there.lo.min(axis=0).tobytes()], pa.binary())], names=["part", "hi", "lo"])

    if not weights:
        return [(r.part, None, None) for r in blocks.select("part").distinct().collect()]
    return [(r.part, ints(r.hi), ints(r.lo)) for r in blocks.mapInArrow(run, "part int, hi binary, lo binary").collect()]


def search_all(embeddings: DataFrame) -> DataFrame:
    """Queries: every row whose id is divisible by 100, against all rows."""
    return search(embeddings.select("vec_id", "embedding"), lambda i: i % 100 == 0)
