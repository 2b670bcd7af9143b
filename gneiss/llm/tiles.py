"""A search of queries among all rows in tiles: what exact top-k search and nearest neighbours share.

Queries and candidates are dealt into parts of bounded size by hashes; each pair of parts is one tile, worked on by one
task, and the tiles' results are merged by a top-k for each query that also runs before the shuffle. A candidate is
shuffled once for each part of queries, a query once for each part of candidates.

Rows are known by vec_id and vector, so equal rows are one row that counts several times: as a query it gets its list as
often, and among candidates it takes as many places, one fewer in its own list. Null ids come last among equal scores.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of vectors in a part, of either side of a tile.
PART_BYTES = 32 << 20


class Side(NamedTuple):
    """Rows of one side of a tile: ids (0 where null), whether they are null, vectors, and how often each row occurs."""

    ids: np.ndarray
    null: np.ndarray
    vectors: np.ndarray
    times: np.ndarray

    def by_id(self) -> Side:
        order = np.lexsort((self.ids, self.null))
        return Side(*(x[order] for x in self))

    def part(self, rows: slice | np.ndarray) -> Side:
        return Side(*(x[rows] for x in self))

    def groups(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """The first row of each distinct vector, each row's vector, and each vector's rows, in order."""
        n, dim = self.vectors.shape
        rows = np.ascontiguousarray(self.vectors).view(np.dtype((np.void, max(1, 8 * dim)))).ravel() if dim else np.zeros(n, int)
        _, first, group = np.unique(rows, return_index=True, return_inverse=True)
        return first, group, np.split(np.argsort(group, kind="stable"), np.cumsum(np.bincount(group))[:-1])

    def places(self, others: Side) -> np.ndarray:
        """For each row of others the row here that is the same one, or -1."""
        at: dict[int, list[int]] = {}
        for i in np.flatnonzero(~self.null).tolist():
            at.setdefault(int(self.ids[i]), []).append(i)
        same = lambda i, v: np.array_equal(self.vectors[i], v)
        return np.array([next((i for i in at.get(int(q), []) if same(i, v)), -1) for q, v in zip(others.ids, others.vectors, strict=True)], int)


class Best:
    """The k best of a query: score (smallest first), place of the candidate, and how many places it takes."""

    def __init__(self, k: int):
        self.k, self.found = k, []

    def add(self, scored: list[tuple[float, int, int]]) -> None:
        self.found = sorted(self.found + scored)
        total = keep = 0
        while keep < len(self.found) and total < self.k:
            total += self.found[keep][2]
            keep += 1
        del self.found[keep:]
        self.full = total >= self.k


def expanded(scored, members: list[np.ndarray], times: np.ndarray, own: int, offset: int, k: int) -> list[tuple[float, int, int]]:
    """score, place and count of the rows of scored vectors (score, vector): at most k places of each, in the order of ids."""
    out = []
    for score, g in scored:
        left = k
        for i in members[g].tolist():
            copies = min(left, int(times[i]) - (i == own))
            if copies > 0:
                out.append((score, offset + i, copies))
                left -= copies
            if not left:
                break
    return out


def dense(lists: pa.ChunkedArray | pa.Array, width: int | None = None, kind: type = np.int64) -> np.ndarray:
    """Lists of numbers as rows of a matrix, shorter ones filled up with 0."""
    column = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(column.offsets.to_numpy())
    width = int(sizes.max(initial=0)) if width is None else width
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), kind)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def counted(rows: DataFrame) -> DataFrame:
    """vec_id, v and times of rows (vec_id, v)."""
    return rows.groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("times"))


def tile_ranks(rows: DataFrame, is_query, k: int, block: int, part_bytes: int, kind: type, score: str, search: Callable[[Side, Side, int], list[tuple[int, int, float, int]]]) -> DataFrame:
    """query_id, rank, vec_id and score of the k best of each row for which is_query(vec_id column) holds.

    rows: as counted() gives them. search: of a tile's sides, candidates in the order of ids, and the size of a block, gives
    query and candidate by their places, score and how many places the candidate takes. kind: of a vector's components."""
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query(F.col("vec_id"))).alias("q"), F.max(F.size("v")).alias("dim")).first()
    dim = max(1, counts["dim"] or 1)
    part, block = max(1, part_bytes // (8 * dim)), max(1, min(block, (part_bytes >> 1) // (8 * dim)))
    tall, wide = max(1, ceil(counts["q"] / part)), max(1, ceil(counts["n"] / part))
    # Few candidates are cut into more parts, so that a small table also occupies several tasks.
    wide = max(wide, min(16, ceil(counts["n"] / 256)))
    deal = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id", "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Queries of one id are told apart by a digest of the vector.
    known = F.sha2(F.concat_ws(",", F.col("v").cast("array<string>")), 256)
    queries = rows.filter(is_query(F.col("vec_id"))).select("vec_id", "v", "times", known.alias("digest"), deal(tall, 1).alias("row")).select("*", every(wide).alias("column"))
    candidates = rows.select("vec_id", "v", "times", deal(wide, 2).alias("column")).select("*", every(tall).alias("row"))
    kinds = {"long": pa.int64(), "double": pa.float64()}

    def side(t: pa.Table, width: int) -> Side:
        ids = t.column("vec_id").combine_chunks()
        return Side(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), dense(t.column("v"), width, kind), t.column("times").to_numpy())

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        longest = max(int(np.diff(t.column("v").combine_chunks().offsets.to_numpy()).max(initial=0)) for t in (left, right))
        own = side(right, longest).by_id()
        found = search(side(left, longest), own, block) if left.num_rows and right.num_rows else []
        of, to = pa.array([f[0] for f in found], pa.int64()), np.array([f[1] for f in found], int)
        columns = [left.column("vec_id").take(of), left.column("digest").take(of), left.column("times").take(of), pa.array(own.ids[to], pa.int64(), mask=own.null[to])]
        columns += [pa.array([f[2] for f in found], kinds[score]), pa.array([f[3] for f in found], pa.int64())]
        return pa.table(columns, names=["query_id", "digest", "asked", "vec_id", "score", "copies"])

    tiles = queries.groupBy("row", "column").cogroup(candidates.groupBy("row", "column")).applyInArrow(run, f"query_id long, digest string, asked long, vec_id long, score {score}, copies long")
    single = tiles.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    best = Window.partitionBy("query_id", "digest").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    ranked = single.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    # Each of the equal query rows gets the list.
    return ranked.withColumn("asked", F.explode(F.sequence(F.lit(1).cast("long"), F.col("asked")))).select("query_id", "rank", "vec_id", "score")
