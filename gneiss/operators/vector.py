"""Vector operators: normalising, exact and cell-pruned nearest neighbours, int8 vectors."""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.operators.catalog import Table

#: Queries and rows in a block.
BLOCK = 2048
#: Queries of a tile, or rows of a batch, that a worker computes with at once: 256 x 2048 products take 4 MB in double precision.
SLICE = 256
#: Pairs whose scores are computed again at once: copies can make all pairs of a tile such.
PAIRS = 1 << 14


def as_double(v: str | Column) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is all zero."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length).otherwise(0.0)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """v over its length; a zero vector stays."""
    length = norm(v)
    return F.when(length > 0, F.transform(v, lambda x: x / length)).otherwise(v)


def quantised(v: Column) -> Column:
    """Symmetric int8 values of a vector, with the scale max / 127."""
    most = F.array_max(F.transform(v, lambda x: F.abs(x)))
    return F.struct(F.when(most > 0, F.transform(v, lambda x: F.round(x * 127 / most).cast("tinyint"))).otherwise(F.transform(v, lambda x: F.lit(0).cast("tinyint"))).alias("values"), (most / 127).alias("scale"))


def dequantised(q: Column) -> Column:
    return F.transform(q["values"], lambda x: x * q["scale"])


def score_column(metric: str, a: Column, b: Column) -> Column:
    if metric not in ("ip", "l2"):
        raise ValueError(f"unknown metric: {metric}")
    return cosine(a, b) if metric == "ip" else squared_distance(a, b)


def knn(vectors: DataFrame, query: DataFrame, k: int = 10, metric: str = "ip", key: str = "chunk_id", vector: str = "embedding", digits: int | None = 6) -> DataFrame:
    """key and score of the k nearest rows to the one vector in query (column q). Filter vectors before, not after.

    The query is a single row, so it is broadcast; the rest is one scan with a top-k. Scores are rounded when all is
    ranked, with digits None not at all."""
    scored = vectors.crossJoin(F.broadcast(query.limit(1))).select(key, score_column(metric, as_double(vector), as_double("q")).alias("score"))
    best = scored.orderBy(F.desc("score") if metric == "ip" else "score", key).limit(k)
    return best if digits is None else best.withColumn("score", F.round("score", digits))


def knn_batch(vectors: DataFrame, queries: list[tuple[int, list[float]]] | DataFrame, k: int = 10, key: str = "chunk_id", vector: str = "embedding", within: str | None = None) -> DataFrame:
    """query_id, rank, key, score by cosine for the queries, a list or a DataFrame (query_id, q) of any size.

    within: a column of both; a query is compared with the rows that share its value, null with null."""
    cell = F.lit(0).alias("cell") if within is None else F.coalesce(F.concat(F.lit("="), F.col(within).cast("string")), F.lit("")).alias("cell")
    asked = _as_rows(vectors, queries).select(cell, "query_id", "q") if within is None else queries.select(cell, F.col("query_id").cast("long").alias("query_id"), as_double("q").alias("q"))
    return _ranked(vectors.select(cell, F.col(key).alias("id"), as_double(vector).alias("v")), asked, k, key)


def _as_rows(vectors: DataFrame, queries: list[tuple[int, list[float]]] | DataFrame) -> DataFrame:
    """query_id, q."""
    if not isinstance(queries, DataFrame):
        queries = vectors.sparkSession.createDataFrame([(int(i), [float(x) for x in v]) for i, v in queries], "query_id long, q array<double>")
    return queries.select(F.col("query_id").cast("long").alias("query_id"), as_double("q").alias("q"))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _finite(v: str) -> Column:
    return F.col(v).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows of x and y, summed in the order of the components, so that equal rows give equal bits."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += x[:, j] * y[:, j]
    return total


def _pair_dots(x: np.ndarray, y: np.ndarray, q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """_dots of x[q] and y[c], without copies of all their rows at once."""
    total = np.empty(len(q))
    for i in range(0, len(q), PAIRS):
        total[i : i + PAIRS] = _dots(x[q[i : i + PAIRS]], y[c[i : i + PAIRS]])
    return total


def _slices(batches):
    """The batches in parts of at most SLICE rows."""
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE):
            yield batch.slice(i, SLICE)


def _sliced(search):
    """search of a tile by SLICE queries at a time, so that a worker's memory doesn't depend on the queries in the tile."""

    @functools.wraps(search)
    def run(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        found = [search(query_ids[i : i + SLICE], queries[i : i + SLICE], ids, rows, k) for i in range(0, len(queries), SLICE)]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    return run


def _cosines(products: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products over the root of the product of both squared lengths a and b, which gives parallel vectors of whole numbers equal bits,
    as two roots don't; two roots only where that product leaves the range of doubles. 0 where a vector is all zero."""
    with np.errstate(over="ignore"):
        both = a * b
    length = np.where((both > 1e-290) & (both < np.inf), np.sqrt(both), np.sqrt(a) * np.sqrt(b))
    return np.clip(np.divide(products, length, out=np.zeros(len(products)), where=length > 0), -1, 1)


#: What a matrix product of unit vectors may differ by from the sum in order.
SLACK = 1e-9


@_sliced
def _tile(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query_id, id and score of the k best rows of each query: a matrix product picks them, and their scores are computed again one by one."""
    rough = _unit(queries) @ _unit(rows).T
    least = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k, None] - SLACK if len(ids) > k else -np.inf
    q, c = np.nonzero(rough >= least)
    scores = _cosines(_pair_dots(queries, rows, q, c), _dots(queries, queries)[q], _dots(rows, rows)[c])
    order = np.lexsort((ids[c], -scores, q))
    q, c, scores = q[order], c[order], scores[order]
    stays = np.arange(len(q)) - np.searchsorted(q, q) < k
    return query_ids[q[stays]], ids[c[stays]], scores[stays]


def _ranked(rows: DataFrame, asked: DataFrame, k: int, key: str, search=None, digits: int | None = 6) -> DataFrame:
    """query_id, rank, key, score: the k best rows (cell, id, v) in the cells that each query is asked in (cell, query_id, q).

    Scores are rounded when all is ranked, with digits None not at all: whoever ranks them again needs them as they are.

    In each cell both sides are dealt into blocks of bounded size by a hash of their ids, and each pair of blocks is one
    tile, matrix products in one task, of which k rows a query reach the final ranking. Vectors with a null or non-finite
    component or without an id take no part, and vectors of different lengths don't meet."""
    rows = rows.select("cell", F.col("id").cast("long").alias("id"), "v", F.size("v").alias("dim")).filter(F.col("id").isNotNull() & _finite("v"))
    asked = asked.select("cell", "query_id", "q", F.size("q").alias("dim")).filter(_finite("q"))
    on = ["cell", "dim"]
    n = F.col("n")
    wide = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).select(*on, F.greatest(F.ceil(n / BLOCK), F.least(F.lit(16), F.ceil(n / 512))).cast("int").alias("wide"))
    tall = asked.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).select(*on, F.ceil(n / BLOCK).cast("int").alias("tall"))
    blocks = F.broadcast(wide.join(tall, on))  # a row a cell
    deal = lambda x, m, seed: F.pmod(F.xxhash64(F.lit(seed), x), F.col(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    left = asked.join(blocks, on).select(*on, "query_id", "q", deal("query_id", "tall", 1).alias("row"), every("wide").alias("column"))
    right = rows.join(blocks, on).select(*on, "id", "v", every("tall").alias("row"), deal("id", "wide", 2).alias("column"))
    schema = pa.schema([("query_id", pa.int64()), (key, pa.int64()), ("score", pa.float64())])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        matrix = lambda t, v: t.column(v).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        found = (search or _tile)(a.column("query_id").to_numpy(), matrix(a, "q"), b.column("id").to_numpy(), matrix(b, "v"), k)
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(found, schema, strict=True)], schema=schema)

    tile = [*on, "row", "column"]
    found = left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(run, f"query_id long, {key} long, score double")
    return _best(found, k, key, digits)


def _best(found: DataFrame, k: int, key: str, digits: int | None) -> DataFrame:
    """The k best rows of each query by score, ties by key, with their rank."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    score = F.col("score") if digits is None else F.round("score", digits)
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", key, score.alias("score"))


def assign_cells(vectors: DataFrame, centroids: DataFrame, key: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """key, cell: the centroid (cell, c) of largest cosine, ties to the smaller cell. Centroids number nlist, a bound of the index."""
    # One array of centroids in one row: each vector is compared in its own row, without a row for each pair.
    table = centroids.agg(F.array_sort(F.collect_list(F.struct(F.col("cell"), as_double("c").alias("c")))).alias("cs"))
    every = vectors.select(key, as_double(vector).alias("v")).crossJoin(F.broadcast(table))
    best = F.array_max(F.transform("cs", lambda x: F.struct(F.round(cosine(F.col("v"), x["c"]), 9).alias("s"), (-x["cell"]).alias("minus"))))
    return every.select(key, (-best["minus"]).cast("int").alias("cell"))


def probe(query: DataFrame, centroids: DataFrame, nprobe: int) -> DataFrame:
    """The nprobe cells nearest to the query (column q)."""
    return knn(centroids, query, nprobe, key="cell", vector="c", digits=9).select("cell")


def train_cells(vectors: DataFrame, nlist: int = 100, sample: int = 50_000, vector: str = "embedding", seed: int = 7) -> DataFrame:
    """cell, c: centroids by k-means over at most sample vectors of length 1; every vector is assigned afterwards."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.filter(F.col(vector).isNotNull()).select(normalised(as_double(vector)).alias("v"))
    rows = rows.orderBy(F.xxhash64("v")).limit(sample).select(array_to_vector("v").alias("features"))
    model = KMeans(k=nlist, seed=seed, maxIter=15).fit(rows)
    return vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cell int, c array<double>")


def knn_cells(vectors: DataFrame, query: DataFrame, centroids: DataFrame, k: int = 10, nprobe: int = 10, key: str = "chunk_id", vector: str = "embedding", digits: int = 6) -> DataFrame:
    """knn among the cells nearest to the query; vectors carry cell, as a partition column for pruning at scale."""
    near = vectors.join(F.broadcast(probe(query, centroids, nprobe)), "cell", "left_semi")
    return knn(near, query, k, key=key, vector=vector, digits=digits)


def nearest_cells(rows: DataFrame, centroids: DataFrame, nprobe: int, id_name: str, vector: str) -> DataFrame:
    """id, vector and cells, the nprobe nearest (ties to the smaller), for rows as assign_cells takes them, by matrix products.

    Rows of another length than the centroids, or with a null or non-finite component, take no part."""
    known = sorted((r["cell"], list(r["c"])) for r in centroids.collect())  # nlist rows
    numbers, matrix = np.array([i for i, _ in known], np.int32), np.array([c for _, c in known], np.float64)
    matrix = _unit(matrix)

    def run(batches):
        for batch in _slices(batches):
            v = batch.column("v")
            x = v.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            order = np.argsort(-np.round(_unit(x) @ matrix.T, 9), axis=1, kind="stable")[:, :nprobe]
            yield pa.RecordBatch.from_arrays([batch.column("id"), v, pa.array(numbers[order].tolist(), pa.list_(pa.int32()))], ["id", "v", "cells"])

    good = rows.select(F.col(id_name).cast("long").alias("id"), as_double(vector).alias("v")).filter(_finite("v") & (F.size("v") == matrix.shape[1]))
    return good.mapInArrow(run, "id long, v array<double>, cells array<int>").select(F.col("id").alias(id_name), F.col("v").alias(vector), "cells")


def with_cells(vectors: DataFrame, centroids: DataFrame, key: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """key, vector and cell of every vector: assign_cells for tables that a search reads as a whole."""
    return nearest_cells(vectors, centroids, 1, key, vector).select(key, vector, F.col("cells")[0].alias("cell"))


def cell_order(queries: DataFrame, centroids: DataFrame, nprobe: int) -> DataFrame:
    """query_id, q, place, cell: the nprobe cells nearest to each query (query_id, q), the nearest at place 0."""
    return nearest_cells(queries, centroids, nprobe, "query_id", "q").select("query_id", "q", F.posexplode("cells").alias("place", "cell"))


def recall_by_probes(cells: DataFrame, queries: DataFrame, centroids: DataFrame, k: int = 10, key: str = "chunk_id", vector: str = "embedding") -> list[float]:
    """Recall against brute force with 1, 2, ... probed cells; cells are all vectors with their cell.

    A true neighbour is found once its cell is probed, so the places of the neighbours' cells give every recall at once.
    A query's own row is left out, as it is found at no cost."""
    true = knn_batch(cells, queries, k, key, vector).filter(F.col(key) != F.col("query_id")).select("query_id", key)
    places = cell_order(queries, centroids, centroids.count()).select("query_id", "cell", "place")
    found = true.join(cells.select(F.col(key).cast("long").alias(key), "cell"), key).join(places, ["query_id", "cell"]).groupBy("place").count().collect()  # a row a cell at most
    hits = np.zeros(max((r["place"] for r in found), default=-1) + 1)
    for r in found:
        hits[r["place"]] = r["count"]
    return (np.cumsum(hits) / max(hits.sum(), 1)).tolist()


def least_probes(cells: DataFrame, queries: DataFrame, centroids: DataFrame, recall: float = 0.92, k: int = 10, sample: int = 1024, key: str = "chunk_id", vector: str = "embedding") -> int:
    """The fewest probed cells with the wanted recall, measured on all queries, or on sample of them where there are more."""
    chosen = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(sample)
    measured = recall_by_probes(cells, chosen, centroids, k, key, vector)
    return next((i for i, r in enumerate(measured, 1) if r >= recall), max(len(measured), 1))


def knn_cells_batch(cells: DataFrame, queries: DataFrame, centroids: DataFrame, k: int = 10, nprobe: int = 10, key: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """knn_batch among the nprobe cells nearest to each query; each cell's vectors meet only the queries that probe it."""
    asked = cell_order(queries, centroids, nprobe).select("cell", "query_id", "q")
    return _ranked(cells.select("cell", F.col(key).alias("id"), as_double(vector).alias("v")), asked, k, key)


def cell_radii(cells: DataFrame, centroids: DataFrame, key: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """cell and radius: the largest angle between a cell's centroid and its vectors; pi where one is zero, which has no angle.

    As Columns, since cells come out of a Python worker: a second one in the same tasks would double an executor's workers."""
    known = F.broadcast(centroids.select("cell", normalised(as_double("c")).alias("c")))
    v = as_double(vector)
    length = norm(v)
    nearness = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(v, F.col("c")) / length))
    angle = F.when((length > 0) & (length < float("inf")), F.acos(nearness)).otherwise(math.pi)
    return cells.join(known, "cell").select("cell", angle.alias("radius")).groupBy("cell").agg(F.max("radius").alias("radius"))


def knn_cells_exact(cells: DataFrame, queries: DataFrame, centroids: DataFrame, k: int = 10, nprobe: int = 10, key: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """knn_batch through cells, exactly: after the nprobe nearest cells of a query, those that can hold a vector nearer than its k-th so far.

    A vector's angle to the query is no less than the centroid's angle to it minus the cell's radius. cells are all vectors with
    their cell, queries (query_id, q) of any number; centroids and radii number nlist."""
    near = cell_order(queries, centroids, nprobe)
    first = _ranked(cells.select("cell", F.col(key).alias("id"), as_double(vector).alias("v")), near.select("cell", "query_id", "q"), k, key, digits=None)
    least = first.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
    asked = _as_rows(cells, queries).join(least, "query_id", "left").select("query_id", "q", F.when(F.col("n") >= k, F.col("least")).otherwise(-2.0).alias("least"))
    known = sorted((r["cell"], list(r["c"])) for r in centroids.collect())
    radius = {r["cell"]: r["radius"] for r in cell_radii(cells, centroids, key, vector).collect()}
    known = [x for x in known if x[0] in radius]
    numbers, matrix = np.array([i for i, _ in known], np.int32), _unit(np.array([c for _, c in known], np.float64))
    angles = np.array([radius[i] for i, _ in known])

    def reachable(batches):
        for batch in _slices(batches):
            q = _unit(batch.column("q").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
            cosines = q @ matrix.T
            nearest = np.argsort(-np.round(cosines, 9), axis=1, kind="stable")[:, :nprobe]
            bound = np.cos(np.maximum(np.arccos(np.clip(cosines, -1, 1)) - angles, 0))
            bound[~q.any(axis=1)] = 1
            wanted = bound >= batch.column("least").to_numpy()[:, None] - 2e-6  # angles are rounded
            np.put_along_axis(wanted, nearest, False, 1)
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("q"), pa.array([numbers[w].tolist() for w in wanted], pa.list_(pa.int32()))], ["query_id", "q", "cells"])

    good = asked.filter(_finite("q") & (F.size("q") == matrix.shape[1]))
    more = good.mapInArrow(reachable, "query_id long, q array<double>, cells array<int>").select("query_id", "q", F.explode("cells").alias("cell"))
    second = _ranked(cells.select("cell", F.col(key).alias("id"), as_double(vector).alias("v")), more.select("cell", "query_id", "q"), k, key, digits=None)
    return _best(first.unionByName(second), k, key, 6)


class CellIndex:
    """Vectors stored in a folder for each cell, with the centroids beside them; a search reads the folders of its cells."""

    def __init__(self, path: str, rows: DataFrame, centroids: DataFrame, key: str, vector: str):
        self.path, self.rows, self.centroids, self.key, self.vector = path, rows, centroids, key, vector

    @staticmethod
    def build(vectors: DataFrame, centroids: DataFrame, path: str, key: str = "chunk_id", vector: str = "embedding") -> CellIndex:
        table = Table(vectors.sparkSession, path)
        with table.version() as to:
            centroids.select("cell", "c").write.parquet(f"{to}/centroids")
            known = vectors.sparkSession.read.parquet(f"{to}/centroids")
            # A cell may hold any share of the vectors, so its rows come from several tasks.
            with_cells(vectors, known, key, vector).repartition("cell", F.pmod(F.xxhash64(key), F.lit(8))).write.partitionBy("cell").parquet(f"{to}/rows")
        return CellIndex.load(vectors.sparkSession, path, key, vector)

    @staticmethod
    def load(spark, path: str, key: str = "chunk_id", vector: str = "embedding") -> CellIndex:
        at = Table(spark, path).at()
        return CellIndex(path, spark.read.parquet(f"{at}/rows"), spark.read.parquet(f"{at}/centroids"), key, vector)

    def search(self, query: DataFrame, k: int = 10, nprobe: int = 10, digits: int | None = 6) -> DataFrame:
        """knn among the nprobe cells nearest to the one vector in query (column q)."""
        cells = [r["cell"] for r in probe(query, self.centroids, nprobe).collect()]  # nprobe rows
        return knn(self.rows.filter(F.col("cell").isin(cells)), query, k, key=self.key, vector=self.vector, digits=digits)

    def search_batch(self, queries: DataFrame, k: int = 10, nprobe: int = 10) -> DataFrame:
        return knn_cells_batch(self.rows, queries, self.centroids, k, nprobe, self.key, self.vector)


def store_quantised(vectors: DataFrame, path: str, key: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """Writes key, values (int8) and scale."""
    q = quantised(as_double(vector))
    return Table(vectors.sparkSession, path).write(vectors.filter(F.col(vector).isNotNull()).select(key, q.alias("q")).select(key, "q.values", "q.scale"))


def load_quantised(spark, path: str, key: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """key and vector, as far as int8 values tell, from what store_quantised wrote."""
    return Table(spark, path).read().select(key, F.transform("values", lambda x: x * F.col("scale")).alias(vector))


def knn_int8(rows: DataFrame, queries: DataFrame, k: int = 10, key: str = "chunk_id") -> DataFrame:
    """query_id, rank, key and score: knn_batch on int8 values alone. rows: as store_quantised writes them; queries (query_id, q) are quantised alike.

    Scales cancel out in a cosine, so products and lengths are integers; they are exact in tiles of floats, and a score is one
    division of them. Rows with a null or non-finite component have no values and take no part."""
    integers = lambda c: F.transform(c, lambda x: x.cast("double"))
    asked = _as_rows(rows, queries).filter(_finite("q")).select("query_id", integers(quantised(F.col("q"))["values"]).alias("q"))
    kept = rows.filter(~F.exists("values", lambda x: x.isNull())).select(F.lit(0).alias("cell"), F.col(key).alias("id"), integers(F.col("values")).alias("v"))
    return _ranked(kept, asked.select(F.lit(0).alias("cell"), "query_id", "q"), k, key, _integer_tile)


@_sliced
def _integer_tile(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_tile for vectors of small integers: their products are exact in float32 while they stay below 2^24, so no score is computed again."""
    kind = np.float32 if rows.shape[1] * 127 * 127 < 1 << 24 else np.float64
    q, c = queries.astype(kind), rows.astype(kind)
    products = (q @ c.T).astype(np.float64)
    length = np.sqrt((q * q).sum(1, dtype=np.float64)[:, None] * (c * c).sum(1, dtype=np.float64)[None, :])
    scores = np.divide(products, length, out=np.zeros_like(products), where=length > 0)
    least = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k, None] if len(ids) > k else -np.inf
    at, to = np.nonzero(scores >= least)
    order = np.lexsort((ids[to], -scores[at, to], at))
    at, to = at[order], to[order]
    stays = np.arange(len(at)) - np.searchsorted(at, at) < k
    return query_ids[at[stays]], ids[to[stays]], scores[at[stays], to[stays]]
