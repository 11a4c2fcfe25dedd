"""Operator 4: exact top-k by inner product over a pivot-distance index.

One more component, sqrt(M - |x|^2) with M the largest squared norm, turns the largest inner product into the smallest distance.
Vectors are keyed by their nearest pivot and their distance to it and sorted by that key across the cluster, so each run of rows
is an annulus around a pivot. For a block of queries, every task expands its annuli from the most promising on and stops where
the triangle inequality leaves no better score than the k-th best so far; a first k-th best comes from a fixed sample. The
tasks' best rows, at most k a query, are merged. Pruning is exact, ties included.

Components are turned into floor(scale * x), so scores are exact integers, in doubles below 2^53, in 64-bit integers from there
to 2^63 (beyond, they are not defined). Queries are collected in blocks of BLOCK_BYTES; each block is one pass of all tasks over
the index. The number of pivots grows with the square root of the table.

Defined cases: vectors that are null or hold a null or non-finite component, and rows with a null id, take no part; shorter
vectors count as padded with zeros; queries that repeat an id are asked once; rows that share an id with a query are its own;
fewer rows than k give as many as there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ductwork.llm.common import durable, ranked

#: Rows of an annulus; rows of the sample that gives pivots and first bounds; pivots at least and at most.
ANNULUS, SAMPLE, PIVOTS = 1024, 2048, (32, 1024)
#: Memory of a block of queries with their distances from the pivots; and how many of its queries meet an annulus at once.
BLOCK_BYTES, TOGETHER = 64 << 20, 4096
#: Batches that a task holds at once.
HELD = 64


def integers(vectors: DataFrame, scale: int) -> DataFrame:
    """id and q (array of long) of the vectors that take part."""
    whole = vectors.where("id is not null and v is not null").where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return whole.select(F.col("id").cast("long").alias("id"), F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("q"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of integers, padded with zeros, as doubles: exact below 2^53."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - (np.cumsum(sizes) - sizes)[row]] = flat
    return out


@dataclass
class Pivots:
    """Pivots in the space with one more component, and M."""

    at: np.ndarray
    most: float

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(self.most - (x * x).sum(1), 0))[:, None]])

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        square = (lifted * lifted).sum(1)[:, None] + (self.at * self.at).sum(1)[None, :] - 2 * lifted @ self.at.T
        return np.sqrt(np.maximum(square, 0))


def choose_pivots(sample: np.ndarray, most: float, count: int, steps: int = 8) -> Pivots:
    """k-means of the sample from the first distinct rows on."""
    start = np.unique(sample, axis=0)
    pivots = Pivots(np.zeros((1, sample.shape[1] + 1)), most)
    lifted = pivots.lift(sample)
    pivots.at = pivots.lift(start[np.linspace(0, len(start) - 1, min(count, len(start))).astype(int)])
    for _ in range(steps):
        near = pivots.distances(lifted).argmin(1)
        n = np.bincount(near, minlength=len(pivots.at))
        sums = np.zeros_like(pivots.at)
        np.add.at(sums, near, lifted)
        pivots.at = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], pivots.at)
    return pivots


def keyed(rows: DataFrame, pivots: Pivots, width: int) -> DataFrame:
    """The index: pivot, dist, id, q, sorted over the cluster, in the checkpoint folder."""
    held = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = held.value.distances(held.value.lift(matrix(batch.column(1), width)))
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(near)), near]), *batch.columns], names=["pivot", "dist", "id", "q"])

    index = rows.select("id", "q").mapInArrow(run, "pivot int, dist double, id long, q array<long>")
    return ranked(index, [F.col("pivot"), F.col("dist"), F.col("id")]).drop("__rank")


class Best:
    """The k best of each query so far, ties to the smaller id, and the score that a row must reach."""

    def __init__(self, floor: np.ndarray, k: int) -> None:
        self.k, self.floor = k, floor.copy()
        self.query, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        query, score, ids = np.concatenate([self.query, query]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < self.k
        self.query, self.score, self.id = query[keep], score[keep], ids[keep]
        last = place[keep] == self.k - 1
        self.floor[self.query[last]] = np.maximum(self.floor[self.query[last]], self.score[last])


def expand(parts: list[pa.RecordBatch], best: Best, ids: np.ndarray, q: np.ndarray, from_pivots: np.ndarray, norms: np.ndarray, most: float, width: int) -> None:
    """Search the annuli of some batches, the most promising first."""
    rings = []
    for batch in parts:
        pivot, dist = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(pivot)) + 1), len(pivot)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            to = from_pivots[:, pivot[a]]
            gap = np.maximum(0, np.maximum(to - dist[b - 1], dist[a] - to))
            slack = 1e-6 * (norms + most) + 1
            rings.append(((norms + most - gap * gap) / 2 + slack, batch.slice(a, b - a)))
    rings.sort(key=lambda r: -float((r[0] - best.floor).max()))
    number = np.int64 if most >= 2**53 else float
    for bound, batch in rings:
        some = np.flatnonzero(bound >= best.floor)
        if not len(some):
            continue
        x, own = matrix(batch.column(3), width).astype(number), batch.column(2).to_numpy()
        for few in np.split(some, range(TOGETHER, len(some), TOGETHER)):
            score = q[few].astype(number) @ x.T
            hit, row = np.nonzero((score >= best.floor[few][:, None]) & (own[None, :] != ids[few][:, None]))
            if len(hit):
                best.add(few[hit], score[hit, row].astype(np.int64), own[row])


def search_block(index: DataFrame, ids: np.ndarray, q: np.ndarray, floor: np.ndarray, pivots: Pivots, k: int) -> DataFrame:
    """query_id, vec_id, score: each task's best rows for one block of queries."""
    lifted = np.hstack([q, np.zeros((len(q), 1))])
    held = index.sparkSession.sparkContext.broadcast((ids, q, floor, pivots.distances(lifted), (q * q).sum(1), pivots.most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, floor, from_pivots, norms, most = held.value
        best, parts = Best(floor, k), []
        for batch in batches:
            parts += [batch.slice(i, ANNULUS) for i in range(0, batch.num_rows, ANNULUS)]
            if len(parts) >= HELD:
                expand(parts, best, ids, q, from_pivots, norms, most, q.shape[1])
                parts = []
        expand(parts, best, ids, q, from_pivots, norms, most, q.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(ids[best.query]), pa.array(best.id), pa.array(best.score)], names=["query_id", "vec_id", "score"])

    return index.select("pivot", "dist", "id", "q").mapInArrow(run, "query_id long, vec_id long, score long")


def first_floor(q: np.ndarray, ids: np.ndarray, sample: np.ndarray, sample_ids: np.ndarray, k: int, most: float) -> np.ndarray:
    """A score that each query's k-th best reaches at least: its k-th best among the sample."""
    lowest = np.iinfo(np.int64).min
    out = np.full(len(ids), lowest)
    if len(sample_ids) >= k:
        number = np.int64 if most >= 2**53 else float
        for i in range(0, len(ids), TOGETHER):
            score = (q[i : i + TOGETHER].astype(number) @ sample.T.astype(number)).astype(np.int64)
            out[i : i + TOGETHER] = np.partition(np.where(sample_ids[None, :] != ids[i : i + TOGETHER, None], score, lowest), -k, axis=1)[:, -k]
    return out


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, pivots: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score. vectors: id, v; queries are the rows whose id is divisible by every.

    pivots: their number; else it follows the table's size."""
    spark = vectors.sparkSession
    rows = durable(integers(vectors, scale))
    shape = rows.agg(F.max(F.size("q")), F.max(F.aggregate("q", F.lit(0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double"))), F.count(F.lit(1))).first()
    if shape[0] is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width, most = max(1, shape[0]), float(shape[1])
    some = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    sample_ids, sample = np.array([r[0] for r in some]), np.array([list(r[1]) + [0] * (width - len(r[1])) for r in some], float)
    pivots = pivots or int(np.clip(np.sqrt(shape[2] / ANNULUS), *PIVOTS))
    chosen = choose_pivots(sample, most, pivots)
    block_rows = max(1, BLOCK_BYTES // (8 * (width + len(chosen.at))))
    index = keyed(rows, chosen, width)
    asked = ranked(rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("q").alias("q")), [F.col("id")])
    asked = durable(asked.withColumn("__block", F.floor(F.col("__rank") / block_rows)))
    blocks = (asked.agg(F.max("__block")).first()[0] or 0) + 1
    found = []
    for b in range(blocks):
        part = asked.where(F.col("__block") == b).orderBy("id").collect()
        if not part:
            continue
        ids, q = np.array([r["id"] for r in part]), np.array([list(r["q"]) + [0] * (width - len(r["q"])) for r in part], float)
        floor = first_floor(q, ids, sample, sample_ids, k, most)
        block = search_block(index, ids, q, floor, chosen, k)
        found.append(durable(block) if blocks > 1 else block)
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) as q from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and vec_id is not null
), scored as (
  select a.vec_id as query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT as score from v a, v b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::INT as rank, vec_id, score from scored
qualify row_number() over (partition by query_id order by score desc, vec_id) <= 10
"""
