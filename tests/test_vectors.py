"""Searches of every fiftieth row: exactness, recall, and how much of the vectors an index touches."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.operators import graph, vector
from gneiss.plans import catalog as plans
from gneiss.plans import stored  # noqa: F401 - adds its queries


@pytest.fixture(scope="module")
def exact(spark, sf_dir):
    return {(r["query_id"], r["vec_id"]): r["score"] for r in plans.QUERIES["knn_batch_all"](spark, sf_dir).collect()}


@pytest.mark.parametrize("name", ["ivf_stored", "graph_knn", "int8_knn"])
def test_recall_of_ten(spark, sf_dir, exact, name):
    found = {(r["query_id"], r["vec_id"]): r["score"] for r in plans.QUERIES[name](spark, sf_dir).collect()}
    assert {q for q, _ in found} == {q for q, _ in exact} and len(found) == len(exact)
    assert len(exact.keys() & found.keys()) >= 0.9 * len(exact)
    if name != "int8_knn":
        assert all(found[p] == exact[p] for p in exact.keys() & found.keys())


def clustered(n=6000, dim=16, clusters=80, seed=3):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(clusters, dim))[rng.integers(0, clusters, n)] + 0.25 * rng.normal(size=(n, dim))


def frame_of(spark, x, more=()):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + list(more), "chunk_id long, embedding array<double>")


def fiftieth(rows):
    return rows.filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("q"))


def test_graph_touches_little_of_clustered_vectors(spark, tmp_path):
    x = clustered()
    x[10:40] = x[0]  # copies
    odd = [(10_000, None), (10_050, [0.0] * 16), (10_100, [float("nan")] * 16), (10_150, [1.0]), (None, [1.0] * 16)]
    rows = frame_of(spark, x, odd)
    index = graph.GraphIndex.build(rows, str(tmp_path / "g"), part=3000)
    found = index.search(fiftieth(rows)).collect()
    true = {(r["query_id"], r["chunk_id"]): r["score"] for r in vector.knn_batch(rows.filter(F.size("embedding") == 16), fiftieth(rows).filter(F.size("q") == 16)).collect()}
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in found}
    asked = {q for q, _ in true} - {10_050}  # all scores of a zero vector are equal
    assert {q for q, _ in got} == asked | {10_050}
    both = [p for p in true.keys() & got.keys() if p[0] in asked]
    # A vector with copies has more equal neighbours than ten, so scores count, not ids.
    scores = lambda pairs, q: sorted(s for (i, _), s in pairs.items() if i == q)
    hits = sum(sum(a >= b for a, b in zip(scores(got, q), scores(true, q), strict=True)) for q in asked)
    assert hits >= 0.9 * 10 * len(asked) and all(true[p] == got[p] for p in both)
    touched = {r["query_id"]: r["touched"] for r in found}
    assert np.mean([touched[q] for q in asked]) < 0.1 * len(x)
    assert graph.GraphIndex.build(rows.limit(0), str(tmp_path / "none")).search(fiftieth(rows)).count() == 0
    assert graph.GraphIndex.build(rows.filter("chunk_id = 3"), str(tmp_path / "one")).search(fiftieth(rows)).count() == len(asked) + 1


def test_cells_are_left_out_only_where_nothing_nearer_can_be(spark):
    x = clustered(3000, 8, 30)
    rows = frame_of(spark, x, [(5000, [0.0] * 8)])
    centroids = vector.train_cells(rows, nlist=30)
    cells = vector.with_cells(rows, centroids)
    found = vector.knn_cells_exact(cells, fiftieth(rows), centroids, nprobe=2)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, vector.knn_batch(rows, fiftieth(rows)).collect()))


def test_cells_rank_by_scores_that_are_not_rounded(spark):
    """Neighbours of the queries, the nearer with the larger id, whose scores are equal in six digits."""
    x = clustered(200, 8, 8)
    rng = np.random.default_rng(9)
    near = [(1000 * (1 + n) - i, (x[n] * (1 + 1e-5 * i * rng.normal(size=8))).tolist()) for n in range(0, 200, 50) for i in range(1, 15)]
    rows = frame_of(spark, x, near)
    centroids = vector.train_cells(rows, nlist=8)
    found = vector.knn_cells_exact(vector.with_cells(rows, centroids), fiftieth(rows.filter("chunk_id < 200")), centroids, nprobe=1).collect()
    batch = vector.knn_batch(rows, fiftieth(rows.filter("chunk_id < 200"))).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, batch))
    assert any(a["score"] == b["score"] and a["chunk_id"] > b["chunk_id"] for a in found for b in found if a["query_id"] == b["query_id"] and b["rank"] == a["rank"] + 1)


def test_parallel_vectors_tie_as_in_sql(spark, duck):
    """Multiples of whole-number vectors are equally near, so ids decide between them; two roots of lengths, before, did."""
    rng = np.random.default_rng(1)
    x = rng.integers(-3, 4, (40, 8)).astype(float)
    x = x[x.any(axis=1)]
    x = np.concatenate([x * 7, x, x * 3])
    rows = frame_of(spark, x)
    found = vector.knn_batch(rows, rows.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("q"))).collect()
    values = ", ".join(f"({i}, {v.tolist()}::DOUBLE[])" for i, v in enumerate(x))
    expected = duck.sql(f"""WITH t(i, v) AS (VALUES {values}), s AS (SELECT q.i query_id, t.i, list_cosine_similarity(t.v, q.v) s FROM t, t q)
    SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY s DESC, i))::INT AS rank, i FROM s QUALIFY rank <= 10""").fetchall()
    assert sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in found) == sorted(expected)
    lengths = np.array([0, 1e-160, 1, 1e160])  # squared; the products of the second and last leave the range of doubles
    assert np.allclose(vector._cosines(lengths, lengths, lengths), [0, 1, 1, 1])


@pytest.mark.parametrize("tile", [vector._tile, vector._integer_tile])
def test_a_tile_of_copies_takes_bounded_memory(tile):
    ids = np.arange(vector.BLOCK)
    rows = np.tile(np.arange(1.0, 17.0), (vector.BLOCK, 1))  # every pair of copies may be among the best
    tracemalloc.start()
    queries, found, scores = tile(ids, rows, ids, rows, 10)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 64e6
    assert (queries == np.repeat(ids, 10)).all() and (found == np.tile(np.arange(10), vector.BLOCK)).all() and np.allclose(scores, 1)


def test_radii_need_no_second_python_worker(spark):
    x = clustered(2000, 8, 20)
    rows = frame_of(spark, x, [(5000, [0.0] * 8), (5050, [1e-200] * 8)])
    centroids = vector.train_cells(rows.filter("chunk_id < 2000"), nlist=20)
    cells = vector.with_cells(rows, centroids)
    radii = vector.cell_radii(cells, centroids)
    assert radii._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    known, most = {r["cell"]: np.array(r["c"]) / np.linalg.norm(r["c"]) for r in centroids.collect()}, {}
    for r in cells.collect():
        v = np.array(r["embedding"])
        angle = np.arccos(np.clip(v @ known[r["cell"]] / np.linalg.norm(v), -1, 1)) if np.linalg.norm(v) else np.pi
        most[r["cell"]] = max(most.get(r["cell"], 0), angle)
    found = dict(map(tuple, radii.collect()))
    assert found.keys() == most.keys() and all(abs(found[i] - most[i]) < 1e-7 for i in most)


def test_within_a_label(spark):
    x = clustered(400, 8)
    rows = frame_of(spark, x).withColumn("label", F.when(F.col("chunk_id") % 3 > 0, F.col("chunk_id") % 3))
    asked = rows.filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("q"), "label")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for r in vector.knn_batch(rows, asked, 3, within="label").groupBy("query_id").agg(F.collect_set("chunk_id").alias("near")).collect():
        own = [j for j in range(400) if j % 3 == r["query_id"] % 3]
        assert set(r["near"]) == set(sorted(own, key=lambda j: -(unit[j] @ unit[r["query_id"]]))[:3])


def test_int8_scores_are_of_integers(spark, tmp_path):
    x = clustered(300, 8)
    rows = frame_of(spark, x, [(1000, None), (1001, [0.0] * 8)])
    stored_rows = vector.store_quantised(rows, str(tmp_path / "q"))
    q = np.sign(x) * np.floor(np.abs(x * 127 / np.abs(x).max(axis=1, keepdims=True)) + 0.5)
    length = np.sqrt((q * q).sum(1))
    for r in vector.knn_int8(stored_rows, fiftieth(rows), 5).collect():
        if r["query_id"] < 1000 and r["chunk_id"] < 1000:
            assert r["score"] == round(float(q[r["query_id"]] @ q[r["chunk_id"]] / (length[r["query_id"]] * length[r["chunk_id"]])), 6)
