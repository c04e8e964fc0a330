"""Nearest neighbours by a block matrix join, exact through error bounds.

Vectors and queries are dealt into blocks by a hash of their id; a tile joins one
block of queries with one block of vectors. In a tile:

- both sides are unit vectors quantised to int8 with a scale for each vector, and
  one matrix product gives all approximate cosines (integers below 2**24, so
  float32 products are exact);
- the quantisation errors' norms bound how far each cosine can be off;
- pairs whose upper bound reaches the k-th best lower bound of their query survive
  and are computed again from the original vectors in double precision;
- each query keeps a heap of its k best of the tile.

Heaps of a query's tiles are merged at the end. Equal vectors are looked at once
in a tile, with their smallest ids, as no more than k of them can be in a result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import load

K, EVERY = 5, 50
#: Rows of a block, about. A tile holds two blocks and their product, some 70 MB.
QUERY_BLOCK, VECTOR_BLOCK = 1024, 8192


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (array of double): vectors without null, non-finite or only zero components, and with an id."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(fine)


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes (as float32), scale and norm of the error of each row."""
    scale = np.abs(unit).max(axis=1, keepdims=True) / 127
    codes = np.rint(unit / scale)
    return codes.astype(np.float32), scale[:, 0], np.linalg.norm(unit - codes * scale, axis=1)


def _matrix(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    flat = rows.column("v").combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    n = len(rows)
    return rows.column("id").to_numpy(), flat.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def in_range(rows: np.ndarray) -> np.ndarray:
    """Rows whose squares would leave the range of doubles, scaled by a power of two; all others as they are."""
    big = np.abs(rows).max(axis=1, keepdims=True)
    return np.where((big > 1e140) | (big < 1e-140), rows * 2.0 ** -np.floor(np.log2(big)), rows)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, summed from the first component to the last."""
    total = np.zeros(max(len(a), len(b)))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def once(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids and rows by (row, id), those that repeat both once, and which of them are the first of their row."""
    order = np.lexsort((ids, *rows.T[::-1]))
    ids, rows = ids[order], rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    other = new.copy()
    other[1:] |= ids[1:] != ids[:-1]
    return ids[other], rows[other], new[other]


def tile(q_ids, q, v_ids, v, k: int) -> list[tuple[int, int, float]]:
    """The k nearest of v for each row of q, by cosine, ties to smaller ids, without the query itself."""
    v_ids, v, new = once(v_ids, v)
    first = np.flatnonzero(new)
    distinct, last = v[first], np.append(first[1:], len(v))
    distinct, q = in_range(distinct), in_range(q)
    v_norm, q_norm = np.sqrt(dots(distinct, distinct)), np.sqrt(dots(q, q))
    (qc, qs, qe), (vc, vs, ve) = quantised(q / q_norm[:, None]), quantised(distinct / v_norm[:, None])
    rough = (qc @ vc.T).astype(np.float64) * qs[:, None] * vs[None, :]
    # |q.v - q'.v'| <= |e_q| |v| + |q'| |e_v|, and |q'| <= 1 + |e_q|
    off = qe[:, None] + (1 + qe[:, None]) * ve[None, :] + 1e-12
    room = np.minimum(last - first, k + 1)
    out = []
    lower = rough - off
    # the query's own vectors (mostly one) may be among the k best but do not count, hence as many more
    ids, times = np.unique(v_ids[np.isin(v_ids, q_ids)], return_counts=True)
    times = dict(zip(ids.tolist(), times.tolist(), strict=True))
    at = len(first) - np.minimum([k + times.get(i, 0) for i in q_ids.tolist()], len(first))
    bound = np.partition(lower, np.unique(at), axis=1)[np.arange(len(q)), at]
    for i in range(len(q)):
        near = np.flatnonzero(rough[i] + off[i] >= bound[i])
        scores = dots(distinct[near], q[i : i + 1]) / (q_norm[i] * v_norm[near])
        heap: list[tuple[float, int]] = []
        for s, j in zip(scores.tolist(), near.tolist(), strict=True):
            for other in v_ids[first[j] : first[j] + room[j]].tolist():
                if other == q_ids[i]:
                    continue
                item = (s, -other)
                if len(heap) < k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
                else:
                    break
        out += [(int(q_ids[i]), -b, s) for s, b in heap]
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest vectors by cosine, ties to smaller ids, without the row of its own id.

    Fewer than k candidates: all of them. Vectors that are null, zero or hold
    null or non-finite components take no part, nor do rows without id; vectors
    of another length than a query's are not its candidates. Rows that
    repeat an id with one vector count once; with different vectors they are rows
    of their own. An empty table gives an empty result; other
    columns are ignored whatever their names.
    """
    data, asked = (usable(x, id_col, vector_col).withColumn("dim", F.size("v")) for x in (vectors, queries))
    size = {r.side: r.n for r in data.agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("v")).unionByName(asked.agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("q"))).collect()}
    v_blocks, q_blocks = -(-size["v"] // VECTOR_BLOCK) or 1, -(-size["q"] // QUERY_BLOCK) or 1
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("id", "v", "dim", block(q_blocks).alias("qb")).withColumn("vb", every(v_blocks))
    right = data.select("id", "v", "dim", block(v_blocks).alias("vb")).withColumn("qb", every(q_blocks))

    def run(key, q: pa.Table, v: pa.Table) -> pa.Table:
        got = []
        if len(q) and len(v):
            (q_ids, qm, _), (v_ids, vm) = once(*_matrix(q)), _matrix(v)
            for at in range(0, len(q_ids), QUERY_BLOCK):
                got += tile(q_ids[at : at + QUERY_BLOCK], qm[at : at + QUERY_BLOCK], v_ids, vm, k)
        return pa.table({"query_id": pa.array([x[0] for x in got], pa.int64()), "vec_id": pa.array([x[1] for x in got], pa.int64()), "score": pa.array([x[2] for x in got], pa.float64())})

    keys = ["qb", "vb", "dim"]
    heaps = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return heaps.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2(spark, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


ORACLE = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v))) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
