"""Approximate nearest neighbours: hierarchical k-means tree, best-bin-first search, calibrated width.

The tree is fitted on a bounded, hash-picked sample; every vector is then put in its leaf. A
query walks the tree through a priority queue, nearest centre first, and names the leaves in
the order in which it reaches them. How many leaves a query visits is calibrated: for some
queries the true neighbours are found by brute force over all rows, and the number of leaves
is widened until their recall reaches the target. Visited leaves are compared in blocks of
bounded size, so neither a crowded leaf nor a popular query region lands in one task.

Equal vectors are held once, with the ``k + 1`` smallest ids: by the tie rule no other of
them can ever be returned, so nothing is lost.

Defined results: vectors that are null, empty, zero, of another length than most, or that
hold null or non-finite components take no part, nor do rows without an id; repeated rows of
one id and vector count once; of equally near rows the smaller id comes first; with fewer than
``k`` candidates all are returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed


@dataclass(frozen=True)
class Settings:
    k: int = 10
    #: Vectors that the tree is fitted on. It bounds what reaches the driver and the tree that is sent out.
    sample: int = 16_384
    branches: int = 12
    #: Sample vectors below which a node is a leaf.
    leaf: int = 48
    rounds: int = 8
    #: Queries whose true neighbours calibrate the width, and the recall they must reach.
    calibration: int = 160
    recall: float = 0.97
    #: Rows and queries of one block at most.
    block: int = 4096
    seed: int = 3


class Tree:
    """Centres of all nodes; ``children[i]`` is empty for a leaf, whose number is ``leaf_of[i]``."""

    def __init__(self, centres: np.ndarray, children: list[np.ndarray]):
        self.centres, self.children = centres, children
        self.leaf_of = np.full(len(children), -1)
        leaves = [i for i, c in enumerate(children) if not len(c)]
        self.leaf_of[leaves] = np.arange(len(leaves))
        self.n_leaves = len(leaves)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row: at every node the child of the nearest centre."""
        out = np.empty(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not len(rows):
                continue
            if not len(kids):
                out[rows] = self.leaf_of[node]
                continue
            near = kids[nearest(x[rows], self.centres[kids])]
            todo += [(int(c), rows[near == c]) for c in kids]
        return out

    def walk(self, q: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves that a best-bin-first walk reaches."""
        queue, found = [(0.0, 0)], []
        while queue and len(found) < most:
            _, node = heapq.heappop(queue)
            kids = self.children[node]
            if not len(kids):
                found.append(int(self.leaf_of[node]))
                continue
            gap = self.centres[kids] - q
            for d, c in zip((gap * gap).sum(axis=1), kids, strict=True):
                heapq.heappush(queue, (float(d), int(c)))
        return found


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1)[None, :] - 2 * x @ centres.T).argmin(axis=1)


def grow(x: np.ndarray, cfg: Settings) -> Tree:
    """Hierarchical k-means; a node whose rows can't be told apart stays a leaf."""
    rng = np.random.default_rng(cfg.seed)
    centres, children = [x.mean(axis=0) if len(x) else np.zeros(x.shape[1])], [np.zeros(0, np.int64)]
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if len(rows) <= cfg.leaf:
            continue
        own = x[rows]
        c = own[rng.choice(len(rows), min(cfg.branches, len(rows)), replace=False)]
        for _ in range(cfg.rounds):
            at = nearest(own, c)
            c = np.array([own[at == j].mean(axis=0) for j in range(len(c)) if (at == j).any()])
        at = nearest(own, c)
        parts = [rows[at == j] for j in range(len(c))]
        if max(map(len, parts)) == len(rows):
            continue
        ids = []
        for j, part in enumerate(parts):
            if len(part):
                ids.append(len(centres))
                centres.append(c[j])
                children.append(np.zeros(0, np.int64))
                todo.append((ids[-1], part))
        children[node] = np.array(ids)
    return Tree(np.array(centres), children)


def best(q: np.ndarray, x: np.ndarray, least: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the nearest rows and their Euclidean distances, in double precision; ties by ``least``."""
    size = (x * x).sum(axis=1)
    d = size[None, :] - 2 * q @ x.T
    # Every row that may be as near as the last one, whatever the rounding, is measured exactly.
    slack = 1e-9 * (size.max(initial=0.0) + (q * q).sum(axis=1))
    upto = np.partition(d, most - 1, axis=1)[:, most - 1] + slack if most < len(x) else np.full(len(q), np.inf)
    out = []
    for i in range(len(q)):
        rows = np.flatnonzero(d[i] <= upto[i])
        gap = x[rows] - q[i]
        exact = np.sqrt((gap * gap).sum(axis=1))
        order = np.lexsort((least[rows], exact))[:most]
        out.append((rows[order], exact[order]))
    return out


def matrix(column) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in column], np.float64)


def valid(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    ok = F.col(id_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    some = rows.where(ok).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    size = some.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return some.where(F.size("v") == (size[0].n if size else 0))


def search(rows: DataFrame, is_query, id_col: str = "vec_id", vector: str = "embedding", cfg: Settings | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``cfg.k`` nearest found for each row that ``is_query`` (of ``id``) picks."""
    cfg = cfg or Settings()
    k = cfg.k
    good = valid(rows, id_col, vector)
    near = good.withColumn("n", F.dense_rank().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    unique = near.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    # The tree needs a sample of the vectors, and the vectors need the tree: they are written once.
    unique = checkpointed(unique)
    sample = unique.orderBy(F.xxhash64("v"), "v").select("v").limit(cfg.sample).collect()
    if not sample:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree = grow(matrix(r.v for r in sample), cfg)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                leaf = tree.assign(matrix(b.column("v").to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array(leaf), b.column("v"), b.column("ids")], names=["leaf", "v", "ids"])

    placed = checkpointed(unique.mapInArrow(place, "leaf long, v array<double>, ids array<long>"))
    asked = good.where(is_query(F.col("id")))
    queries = checkpointed(asked.groupBy("v").agg(F.min("id").alias("least")).withColumn("q", F.monotonically_increasing_id()))
    width = calibrate(tree, placed, queries, cfg)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column("v").to_pylist()
            for q, v in zip(b.column("q").to_pylist(), vectors, strict=True):
                leaves = tree.walk(np.asarray(v, np.float64), width)
                yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.int64()), pa.array([q] * len(leaves), pa.int64()), pa.array([v] * len(leaves), pa.list_(pa.float64()))], names=["leaf", "q", "v"])

    visits = queries.select("q", "v").mapInArrow(visit, "leaf long, q long, v array<double>")
    visits = checkpointed(visits)
    # Leaves are as many as the sample allows, so their sizes are a bounded table.
    n_rows = {r.leaf: r["count"] for r in placed.groupBy("leaf").count().collect()}
    n_asked = {r.leaf: r["count"] for r in visits.groupBy("leaf").count().collect()}
    blocks = [(int(i), max(1, -(-n // cfg.block)), max(1, -(-n_asked.get(i, 0) // cfg.block))) for i, n in n_rows.items()]
    sizes = F.broadcast(rows.sparkSession.createDataFrame(blocks, "leaf long, a long, b long"))
    left = placed.join(sizes, "leaf").select("leaf", F.pmod(F.xxhash64("v"), F.col("a")).alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("b") - 1)).alias("turn"), "v", "ids")
    right = visits.join(sizes, "leaf").select("leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("a") - 1)).alias("part"), F.pmod(F.xxhash64("q"), F.col("b")).alias("turn"), "q", "v")

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"q": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64"), "ids": pd.Series([], dtype=object)})
        x, ids, asks = matrix(a["v"]), a["ids"].tolist(), b["q"].tolist()
        least = np.array([i[0] for i in ids], np.int64)
        got = []
        for lo in range(0, len(asks), 256):
            for q, (at, d) in zip(asks[lo : lo + 256], best(matrix(b["v"].iloc[lo : lo + 256]), x, least, k + 1), strict=True):
                got += [(q, float(s), ids[i]) for i, s in zip(at, d, strict=True)]
        return pd.DataFrame(got, columns=["q", "score", "ids"])

    keys = ["leaf", "part", "turn"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "q long, score double, ids array<long>")
    top = found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("score", F.col("ids")[0]))).where(F.col("n") <= k + 1)
    lists = top.groupBy("q").agg(F.collect_list(F.struct("score", "ids")).alias("near")).join(queries.select("q", F.col("v")), "q")
    each = asked.dropDuplicates(["id", "v"]).join(lists, "v")
    flat = F.flatten(F.transform("near", lambda x: F.transform(x["ids"], lambda i: F.struct(x["score"].alias("score"), i.alias("id")))))
    chosen = F.slice(F.array_sort(F.filter(flat, lambda x: x["id"] != F.col("id"))), 1, k)
    return each.select(F.col("id").alias("query_id"), F.posexplode(chosen).alias("rank", "hit")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.score").alias("score"))


def calibrate(tree: Tree, placed: DataFrame, queries: DataFrame, cfg: Settings) -> int:
    """Leaves to visit so that the calibration queries find ``cfg.recall`` of their true neighbours."""
    some = queries.orderBy(F.xxhash64("v"), "v").select("v").limit(cfg.calibration).collect()
    if not some or tree.n_leaves == 1:
        return 1
    asks = matrix(r.v for r in some)
    most = cfg.k + 1

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                leaf = np.array(b.column("leaf").to_pylist())
                got = best(asks, matrix(b.column("v").to_pylist()), np.array([i[0] for i in b.column("ids").to_pylist()], np.int64), most)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(asks)), [len(a) for a, _ in got])), pa.array(np.concatenate([d for _, d in got])), pa.array(leaf[np.concatenate([a for a, _ in got])])], names=["q", "d", "leaf"])

    true = placed.select("leaf", "v", "ids").mapInArrow(brute, "q long, d double, leaf long")
    true = true.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("d", "leaf"))).where(F.col("n") <= most).collect()
    orders = [{leaf: n for n, leaf in enumerate(tree.walk(q, tree.n_leaves))} for q in asks]
    # The nearest is the query itself; it would flatter the recall.
    at = np.sort([orders[r.q][r.leaf] for r in true if r.n > 1])
    return int(at[max(0, int(np.ceil(cfg.recall * len(at))) - 1)]) + 1 if len(at) else 1


def search_all(embeddings: DataFrame) -> DataFrame:
    """Queries: every row whose id is divisible by 100, against all rows."""
    return search(embeddings.select("vec_id", "embedding"), lambda i: i % 100 == 0)
