"""Approximate nearest neighbours by layered graphs of neighbours.

Vectors are dealt by a hash of their ids into parts of bounded size, and each part is a graph of its own: all its vectors in
the lowest layer, one in LAYER_SHARE of each layer in the next. Within a layer a vector is linked with near ones that are
not nearer to each other than to it, so links lead in all directions, and links hold both ways. A part is built in one task
from exact neighbours in blocks, so building costs part size times number of vectors. A search walks each part from the few
vectors of its top layer down: in a layer it goes on from the nearest vector not yet visited until the ef nearest found
are all visited. Many queries walk in step, as array operations. The parts' results are merged by a top-k for each query.

Nearness is the cosine. Vectors that are null or hold a null or non-finite component, or have another length than most, are
left out; zero vectors have a cosine of 0 to all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.operators.catalog import Table
from gneiss.operators.vector import _as_rows, _dots, _finite, _unit, as_double

#: Links of a vector in a layer, and in the lowest one.
LINKS, LOW_LINKS = 16, 32
LAYER_SHARE = 16
#: Vectors in a part at most, about; queries that walk in step; rows that are compared with all in building.
PART, QUERIES, ROWS = 8192, 256, 512

GRAPH = "part int, place int, id long, v array<double>, links array<array<int>>"


def nearest_rows(x: np.ndarray, n: int) -> np.ndarray:
    """For each row the n nearest others by inner product, nearest first."""
    out = np.empty((len(x), n), np.int32)
    for a in range(0, len(x), ROWS):
        scores = x[a : a + ROWS] @ x.T
        scores[np.arange(len(scores)), np.arange(a, a + len(scores))] = -np.inf
        near = np.argpartition(-scores, n - 1, axis=1)[:, :n] if n < len(x) - 1 else np.argsort(-scores, axis=1)[:, :n]
        order = np.argsort(-np.take_along_axis(scores, near, axis=1), axis=1, kind="stable")
        out[a : a + ROWS] = np.take_along_axis(near, order, axis=1)
    return out


def apart(x: np.ndarray, near: np.ndarray, most: int) -> list[np.ndarray]:
    """For each row those of near (nearest first) that are nearer to it than to any taken before, most at most."""
    taken = np.full((len(x), most), -1, np.int32)
    count = np.zeros(len(x), np.int64)
    for a in range(0, len(x), ROWS):
        rows = np.arange(a, min(a + ROWS, len(x)))
        for j in range(near.shape[1]):
            c = near[rows, j]
            own = (x[rows] * x[c]).sum(axis=1)
            others = taken[rows]
            to_taken = np.where(others >= 0, np.einsum("rd,rmd->rm", x[c], x[np.maximum(others, 0)]), -np.inf)
            good = (count[rows] < most) & (own > to_taken.max(axis=1))
            taken[rows[good], count[rows[good]]] = c[good]
            count[rows[good]] += 1
    return [t[:n] for t, n in zip(taken, count, strict=True)]


def layer(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Links of each row of x, both ways; of those that come back to a row the nearest stay, 2 * most in all."""
    if len(x) < 2:
        return [np.zeros(0, np.int32)] * len(x)
    links = apart(x, nearest_rows(x, min(2 * most, len(x) - 1)), most)
    to = np.concatenate(links)
    of = np.repeat(np.arange(len(x)), [len(n) for n in links])
    pairs = np.unique(np.concatenate([np.stack([of, to], 1), np.stack([to, of], 1)]), axis=0)
    score = np.concatenate([(x[p[:, 0]] * x[p[:, 1]]).sum(axis=1) for p in np.array_split(pairs, max(1, len(pairs) // 100_000))])
    pairs = pairs[np.lexsort((-score, pairs[:, 0]))]
    starts = np.searchsorted(pairs[:, 0], np.arange(len(x) + 1))
    return [pairs[s : min(e, s + 2 * most), 1].astype(np.int32) for s, e in zip(starts[:-1], starts[1:], strict=True)]


def build(x: np.ndarray, depth: np.ndarray) -> list[list[np.ndarray]]:
    """For each layer, from the lowest one, the links of each row; depth: a row's highest layer."""
    out = []
    for level in range(int(depth.max(initial=0)) + 1):
        rows = np.flatnonzero(depth >= level)
        links: list[np.ndarray] = [np.zeros(0, np.int32)] * len(x)
        for i, own in zip(rows, layer(x[rows], LOW_LINKS // 2 if level == 0 else LINKS // 2), strict=True):
            links[i] = rows[own].astype(np.int32)
        out.append(links)
    return out


def padded(links: list[np.ndarray], n: int) -> np.ndarray:
    """Links as a matrix; n stands for none."""
    width = max((len(o) for o in links), default=0)
    out = np.full((n + 1, max(1, width)), n, np.int32)
    for i, own in enumerate(links):
        out[i, : len(own)] = own
    return out


def walk(x: np.ndarray, layers: list[np.ndarray], entry: np.ndarray, queries: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows (len(x): none) and scores of the k nearest found for each query, nearest first, and how many scores were computed.

    x has one more row, of zeros, that stands for none. layers: from the lowest; entry: the rows of the top one."""
    n, b = len(x) - 1, len(queries)
    found = np.broadcast_to(entry, (b, len(entry))).astype(np.int32)
    scores = queries @ x[entry].T
    touched = scores.size
    for level in range(len(layers) - 1, -1, -1):
        size = ef if level == 0 else max(1, ef // 4)
        seen = np.zeros((b, n + 1), bool)
        seen[:, n] = True
        order = np.argsort(-scores, axis=1, kind="stable")[:, :size]
        found, scores = np.take_along_axis(found, order, 1), np.take_along_axis(scores, order, 1)
        if found.shape[1] < size:
            fill = size - found.shape[1]
            found, scores = np.pad(found, ((0, 0), (0, fill)), constant_values=n), np.pad(scores, ((0, 0), (0, fill)), constant_values=-np.inf)
        np.put_along_axis(seen, found, True, 1)
        done = found == n
        while True:
            active = np.flatnonzero(~done.all(axis=1))
            if not len(active):
                break
            at = np.argmin(done[active], axis=1)  # the nearest that isn't visited
            done[active, at] = True
            near = layers[level][found[active, at]]
            new = ~seen[active[:, None], near]
            seen[active[:, None], near] = True
            own = np.where(new, np.einsum("qd,qmd->qm", queries[active], x[near]), -np.inf)
            touched += int(new.sum())
            every = np.concatenate([scores[active], own], axis=1)
            best = np.argsort(-every, axis=1, kind="stable")[:, :size]
            found[active] = np.take_along_axis(np.concatenate([found[active], np.where(new, near, n)], axis=1), best, 1)
            scores[active] = np.take_along_axis(every, best, 1)
            done[active] = np.take_along_axis(np.concatenate([done[active], ~new], axis=1), best, 1) | (scores[active] == -np.inf)
    return found[:, :k], scores[:, :k], touched


class GraphIndex:
    """Parts of vectors with their graphs, as a table below path."""

    def __init__(self, spark: SparkSession, path: str, key: str = "chunk_id"):
        self.spark, self.path, self.key, self.table = spark, path, key, Table(spark, path)

    @staticmethod
    def build(vectors: DataFrame, path: str, key: str = "chunk_id", vector: str = "embedding", part: int = PART) -> GraphIndex:
        rows = vectors.select(F.col(key).cast("long").alias("id"), as_double(vector).alias("v")).filter(F.col("id").isNotNull() & _finite("v"))
        size = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
        rows = rows.filter(F.size("v") == (size["size"] if size else 0))
        parts = max(1, -(-(size["count"] if size else 0) // part))
        # The highest layer of a row: as often as the hash allows, one in LAYER_SHARE each time.
        share = F.pmod(F.xxhash64(F.lit("depth"), "id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        depth = F.least(F.floor(-F.log(F.greatest(share, F.lit(1e-9))) / float(np.log(LAYER_SHARE))), F.lit(6)).cast("int")
        dealt = rows.select(F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(parts)).cast("int").alias("part"), depth.alias("depth"), "id", "v")

        def run(t: pa.Table) -> pa.Table:
            n = t.num_rows
            x = _unit(t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1))
            levels = build(x, t.column("depth").to_numpy())
            links = [[own[i].tolist() for own in levels[: d + 1]] for i, d in enumerate(t.column("depth").to_pylist())]
            return pa.table([t.column("part"), pa.array(np.arange(n), pa.int32()), t.column("id"), t.column("v"), pa.array(links, pa.list_(pa.list_(pa.int32())))], names=["part", "place", "id", "v", "links"])

        Table(vectors.sparkSession, path).write(dealt.groupBy("part").applyInArrow(run, GRAPH))
        return GraphIndex(vectors.sparkSession, path, key)

    def search(self, queries: DataFrame | list, k: int = 10, ef: int = 64) -> DataFrame:
        """query_id, rank, key and score (as knn_batch gives them), and touched: how many vectors a query was compared with, over all parts, on average of those that walked in step.

        queries: query_id and q, or a list of such pairs."""
        rows, key = self.table.read(), self.key
        asked = _as_rows(rows, queries).filter(_finite("q"))
        parts = rows.select(F.col("part").alias("part")).distinct()  # one for every PART vectors
        everywhere = asked.crossJoin(F.broadcast(parts))
        schema = pa.schema([("query_id", pa.int64()), (key, pa.int64()), ("score", pa.float64()), ("touched", pa.int64())])

        def run(graph: pa.Table, own: pa.Table) -> pa.Table:
            if not graph.num_rows or not own.num_rows:
                return schema.empty_table()
            graph = graph.take(pa.array(np.argsort(graph.column("place").to_numpy())))
            n, ids = graph.num_rows, graph.column("id").to_numpy()
            v = graph.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            q = [np.asarray(r, float) for r in own.column("q").to_pylist()]
            right = np.array([i for i, r in enumerate(q) if len(r) == v.shape[1]], int)
            if not len(right):
                return schema.empty_table()
            links = graph.column("links").to_pylist()
            top = max(len(own_links) for own_links in links)
            layers = [padded([np.array(o[level] if len(o) > level else [], np.int32) for o in links], n) for level in range(top)]
            entry = np.array([i for i, o in enumerate(links) if len(o) == top], np.int32)
            x = np.vstack([_unit(v), np.zeros((1, v.shape[1]))])
            parts = []
            for a in range(0, len(right), QUERIES):
                at = right[a : a + QUERIES]
                exact = np.stack([q[i] for i in at])
                found, _, touched = walk(x, layers, entry, _unit(exact), k, max(ef, k))
                row, column = np.nonzero(found < n)
                place = found[row, column]
                length = np.sqrt(_dots(exact, exact))[row] * np.sqrt(_dots(v, v))[place]
                score = np.divide(_dots(exact[row], v[place]), length, out=np.zeros(len(row)), where=length > 0)
                first = np.concatenate([[True], row[1:] != row[:-1]])[: len(row)]
                parts.append((own.column("query_id").to_numpy()[at][row], ids[place], score, np.where(first, touched // len(at), 0)))
            return pa.Table.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*parts, strict=True), schema, strict=True)], schema=schema)

        found = rows.groupBy("part").cogroup(everywhere.groupBy("part")).applyInArrow(run, f"query_id long, {key} long, score double, touched long")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
        found = found.withColumn("touched", F.sum("touched").over(Window.partitionBy("query_id")))
        ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        return ranked.select("query_id", "rank", key, F.round("score", 6).alias("score"), "touched")
