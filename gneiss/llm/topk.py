"""Exact top-k search by no-random-access aggregation.

A score is the inner product of integer vectors, so a candidate's score is a sum with one share from each component. For
each component there is a list of the candidates sorted by it; a query whose component is positive reads that list from
its large end, one whose component is negative from its small end. After t entries of every list, a candidate's share is
known where its entry has been read; elsewhere it lies between the share of the list's far end and that of the entry
read last. The sums of these are a lower and an upper bound of the score. A query stops reading as soon as all but a few
candidates have upper bounds below its k-th largest lower bound (or its k-th score in earlier blocks): these outsiders
can't qualify. The few that are left get their final scores.

Queries meet candidates in tiles (see tiles.py), where blocks of candidates are sorted into lists once and read for all
queries of a block in step. Bounds are exact integers. Equal vectors of a block are one entry of the lists, and of each
such group only the smallest ids can matter.

Defined results: vectors that are null or hold a null or non-finite component take no part; a missing component counts
as 0 where lengths differ, so empty vectors score 0; components and scores stop at the ends of a long; rows are known by
vec_id and vector, so of repeated rows each is a query and each of the others its candidate; null ids are candidates and
come last among equal scores; with fewer than k candidates all are returned; other columns are not carried.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.shared import read_table
from gneiss.llm.tiles import PART_BYTES, Best, Side, counted, expanded, tile_ranks

#: Candidates whose lists are sorted together, and queries that read them in step: their bounds take 2048 x 512 x 8 bytes.
BLOCK, QUERY_BLOCK = 2048, 512
#: The first block is so many times smaller: it gives scores that let queries stop early in the others.
FIRST_PART = 8
#: Bounds are looked at after each of so many equal stretches of the lists.
STEPS = 8
#: Below all scores.
BELOW = -(1 << 140)
#: A query stops where at most so many times k candidates can still qualify.
INSIDERS = 4
LONGS = -(1 << 63), (1 << 63) - 1


def integer_vectors(vectors: DataFrame, scale: int, vector: str, *carried) -> DataFrame:
    """The carried columns and v, floor(scale * x) of each component, of rows whose vectors have finite components only."""
    v = F.col(vector).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    rows = vectors.filter(v.isNotNull() & ~F.exists(v, bad))
    return rows.select(*carried, F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x)).alias("v"))


def survivors(queries: np.ndarray, entries: np.ndarray, skipped: np.ndarray, floor: np.ndarray, k: int) -> tuple[list[np.ndarray], int]:
    """For each query the entries that can be among its k best, and how many list entries were read in all.

    skipped: for each query an entry that doesn't count for it, or -1. floor: what a score has to reach at least."""
    n, dim = entries.shape
    found: list[np.ndarray] = [np.arange(n)] * len(queries)
    depth, read, few = 0, 0, max(INSIDERS * k, 1)
    if n <= few or not dim:
        return found, 0
    order = np.argsort(entries, axis=0, kind="stable")
    values = np.take_along_axis(entries, order, axis=0)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(n)[:, None], order.shape), axis=0)
    # A list is read from its large end for the left half of these, from its small end for the right half.
    weights = np.hstack([np.where(queries > 0, queries, 0), np.where(queries < 0, queries, 0)])
    least_known = np.sort if entries.dtype == object else lambda x, axis: np.partition(x, n - k, axis=axis)
    active = np.arange(len(queries))
    while len(active):
        begin, depth = depth, min(n, depth + -(-n // STEPS))
        read += (depth - begin) * int(np.count_nonzero(queries[active]))
        counted = np.arange(n) != skipped[active, None]
        large, small = place >= n - depth, place < depth
        filled = lambda at_large, at_small: weights[active] @ np.hstack([np.where(large, entries, at_large), np.where(small, entries, at_small)]).T  # noqa: E731, B023
        upper = filled(values[max(0, n - depth - 1)], values[min(n - 1, depth)])
        least = floor[active]
        if n > k + 1 and (least == BELOW).any():
            lower = upper if depth == n else filled(values[0], values[n - 1])
            # The k-th of all but the skipped one, which takes the last place here.
            least = np.maximum(least, least_known(np.where(counted, lower, lower.min()), axis=1)[:, n - k])
        if entries.dtype == object:  # scores that stop at the ends of a long are equal
            least = np.where(least <= LONGS[0], BELOW, np.minimum(least, LONGS[1]))
        inside = counted & (upper >= least[:, None])
        stop = (inside.sum(axis=1) <= few) | (depth == n)
        for i in np.flatnonzero(stop):
            found[active[i]] = np.flatnonzero(inside[i])
        active = active[~stop]
    return found, read


def tile_topk(queries: Side, candidates: Side, k: int, block: int = BLOCK, query_block: int = QUERY_BLOCK, reads: list | None = None) -> list[tuple[int, int, int, int]]:
    """Query and candidate by their places, score and copies: for each query the candidates, which come in the order of ids, of its k best scores.

    reads: gets the number of entries read and that of all entries."""
    x, y = queries.vectors, candidates.vectors
    largest = int(np.abs(x).max(initial=0)) * int(np.abs(y).max(initial=0)) * max(1, x.shape[1])
    # Sums of whole numbers below 2^52 are exact in doubles, whose products are fast; beyond, Python's integers are used.
    unsafe = largest >= 1 << 50 or min(x.min(initial=0), y.min(initial=0)) == LONGS[0]
    kind = object if unsafe else np.float64
    best = [Best(k) for _ in x]
    floor = np.full(len(x), BELOW, kind)
    starts = [0, *range(max(1, block // FIRST_PART), len(y), block)]
    for b, end in zip(starts, [*starts[1:], len(y)], strict=True):
        own_block = candidates.part(slice(b, end))
        first, group, members = own_block.groups()
        entries = own_block.vectors[first]
        for a in range(0, len(x), query_block):
            asked = queries.part(slice(a, a + query_block))
            own = own_block.places(asked)
            skipped = np.array([group[i] if i >= 0 and len(members[group[i]]) == 1 and own_block.times[i] == 1 else -1 for i in own])
            found, read = survivors(asked.vectors.astype(kind), entries.astype(kind), skipped, floor[a : a + query_block], k)
            if reads is not None:
                reads.append((read, len(entries) * int(np.count_nonzero(asked.vectors))))
            for q, (mine, inside) in enumerate(zip(own.tolist(), found, strict=True), a):
                scores = (entries[inside].astype(kind) @ x[q].astype(kind)).tolist() if len(inside) else []
                clipped = ((-max(LONGS[0], min(LONGS[1], int(s))), g) for s, g in zip(scores, inside.tolist(), strict=True))
                best[q].add(expanded(clipped, members, own_block.times, mine, b, k))
                if best[q].full:
                    floor[q] = -best[q].found[-1][0]
    return [(q, i, -score, copies) for q, own in enumerate(best) for score, i, copies in own.found]


def top_scores(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK, part_bytes: int = PART_BYTES) -> DataFrame:
    """query_id, rank, vec_id and score: the k best of each row for which is_query(vec_id column) holds."""
    rows = counted(integer_vectors(vectors, scale, vector, F.col(key).cast("long").alias("vec_id")))
    return tile_ranks(rows, is_query, k, block, part_bytes, np.int64, "long", lambda queries, candidates, size: tile_topk(queries, candidates, k, size))


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_scores(read_table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


QUERIES = {"op11_topk": op11_topk}
ORACLE_SQL = {
    "op11_topk": """
WITH v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.n <> c.n),
r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id NULLS LAST)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
}
