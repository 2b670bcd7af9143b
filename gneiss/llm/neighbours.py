"""Nearest neighbours by a block matrix join.

Queries meet candidates in tiles (see tiles.py), where blocks of candidates stream past each block of queries. A
block of either side is quantised to int8 with one scale a vector and both are multiplied as matrices. With x = s q + e,
the error of a product is at most |s q| |e'| + |e| |x'|, and float32 adds its own where the integers are too many for it;
so a pair whose upper bound lies below the k-th largest lower bound of its query, or below the k-th score that earlier
blocks gave, can't be among the nearest. The rest is computed in double precision from the original vectors and goes
through a heap of k for each query. The result is exact.

Equal candidates within a block are multiplied once, and of each such group only the smallest ids can matter.

Defined results: vectors that are null, all zero, or hold a null or non-finite component take no part; a missing
component counts as 0 where lengths differ; rows are known by vec_id and vector, so of repeated rows each is a query and
each of the others its candidate; null ids are candidates and come last among equal scores; with fewer than k candidates
all are returned; ties go to the smaller vec_id; other columns are not carried.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from gneiss.llm.shared import read_table
from gneiss.llm.tiles import PART_BYTES, Best, Side, counted, expanded, tile_ranks

#: Vectors in a block: 2048 x 2048 products take 32 MB in double precision.
BLOCK = 2048


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales, and the norms of what they stand for, of what they miss and of x, a row each."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1.0
    q = np.rint(x / scale[:, None]).astype(np.int8)
    stands = q * scale[:, None]
    return q, scale, np.linalg.norm(stands, axis=1), np.linalg.norm(x - stands, axis=1), np.linalg.norm(x, axis=1)


def shrunk(x: np.ndarray, axis: int | None) -> tuple[np.ndarray, np.ndarray]:
    """x times a power of two (one a row, or one in all) that takes its largest component to below 1, and the exponents."""
    exponent = np.frexp(np.abs(x).max(axis=axis, keepdims=True))[1]
    return np.ldexp(x, -exponent), exponent


def inner_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of rows of x and y, summed component by component, so that equal rows give equal bits wherever they stand."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += x[:, j] * y[:, j]
    return total


def block_neighbours(queries: Side, candidates: Side, offset: int, k: int, floor: np.ndarray) -> list[list[tuple[float, int, int]]]:
    """For each query its nearest in the block, as (-inner product, place, copies), k places at most, what lies below floor left out."""
    first, group, members = candidates.groups()
    own, distinct = candidates.places(queries), candidates.vectors[first]
    # The order for a query survives a factor of its own and one of all candidates, so bounds neither overflow nor vanish.
    (x, of_query), (y, of_block) = shrunk(queries.vectors, 1), shrunk(distinct, None)
    a, b = quantised(x), quantised(y)
    products = (a[0].astype(np.float32) @ b[0].astype(np.float32).T).astype(np.float64) * a[1][:, None] * b[1][None, :]
    error = a[2][:, None] * b[3][None, :] + a[3][:, None] * b[4][None, :] + 1e-9 * a[4][:, None] * b[4][None, :] + 1e-140
    dim = distinct.shape[1]
    if dim * 127 * 127 >= 1 << 24:  # beyond, float32 rounds the sums of integers
        error += dim * 2.0**-23 * a[2][:, None] * b[2][None, :]
    upper, lower = products + error, products - error
    for r, i in enumerate(own.tolist()):
        if i >= 0 and len(members[group[i]]) == 1 and candidates.times[i] == 1:
            upper[r, group[i]] = lower[r, group[i]] = -np.inf
    least = np.where(np.isfinite(floor), np.ldexp(np.where(np.isfinite(floor), floor, 0), -(of_query[:, 0] + of_block[0, 0])), -np.inf)
    least -= 1e-9 * np.abs(np.where(np.isfinite(least), least, 0)) + 1e-140
    if len(distinct) > k:
        least = np.maximum(least, np.partition(lower, len(distinct) - k, axis=1)[:, len(distinct) - k])
    rows, columns = np.nonzero((upper >= least[:, None]) & (upper > -np.inf))
    exact = inner_products(queries.vectors[rows], distinct[columns])
    ends = np.searchsorted(rows, np.arange(len(own) + 1))
    scored = [zip((-exact[s]).tolist(), columns[s].tolist(), strict=True) for s in map(slice, ends[:-1], ends[1:])]
    return [heapq.nsmallest(k, expanded(pairs, members, candidates.times, i, offset, k)) for pairs, i in zip(scored, own.tolist(), strict=True)]


def tile_neighbours(queries: Side, candidates: Side, k: int, block: int = BLOCK) -> list[tuple[int, int, float, int]]:
    """Query and candidate by their places, inner product and copies of the k nearest of each query; candidates come in the order of ids."""
    out = []
    for a in range(0, len(queries.ids), block):
        own = queries.part(slice(a, a + block))
        best, floor = [Best(k) for _ in own.ids], np.full(len(own.ids), -np.inf)
        for b in range(0, len(candidates.ids), block):
            for r, pairs in enumerate(block_neighbours(own, candidates.part(slice(b, b + block)), b, k, floor)):
                best[r].add(pairs)
                floor[r] = -best[r].found[-1][0] if best[r].full else -np.inf
        out += [(a + r, i, -s, copies) for r, x in enumerate(best) for s, i, copies in x.found]
    return out


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, v and times of the vectors that take part."""
    # Components as they are where they are floats, else as doubles; products are in double precision of either.
    kind = "float" if vectors.schema[vector].dataType == ArrayType(FloatType(), vectors.schema[vector].dataType.containsNull) else "double"
    v = F.col(vector).cast(f"array<{kind}>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")).cast(kind))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull())
    return counted(rows.filter(~F.exists("v", bad) & F.exists("v", lambda x: x != 0)))


def nearest(vectors: DataFrame, is_query, k: int = 20, block: int = BLOCK, part_bytes: int = PART_BYTES) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest of each vector for which is_query(vec_id column) holds."""
    return tile_ranks(usable(vectors), is_query, k, block, part_bytes, np.float64, "double", lambda queries, candidates, size: tile_neighbours(queries, candidates, k, size))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


QUERIES = {"op4_neighbours": op4_neighbours}
ORACLE_SQL = {
    "op4_neighbours": """
WITH v AS (SELECT row_number() OVER () AS n, vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.n <> c.n),
r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id NULLS LAST)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
}
