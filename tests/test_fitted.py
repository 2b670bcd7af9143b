"""The fitted embedder: what it finds of planted near copies; its fit against a whole decomposition."""

import random

import numpy as np
from pyspark.sql import functions as F

from gneiss.operators import embedding, fitted


def test_recall_of_near_copies(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter(F.length("text") > 200).dropDuplicates(["text"])
    model = fitted.fit(docs, "text", size=64)
    rng = random.Random(1)
    texts = [r["text"] for r in docs.orderBy("doc_id").select("text").collect()]
    copies = [" ".join(w for w in t.split() if rng.random() < 0.4) for t in texts]  # more than half of the words gone

    def recall(maker):
        scores = maker.embed(copies) @ maker.embed(texts).T
        return np.mean(scores.argmax(axis=1) == np.arange(len(texts)))

    # On so few texts hashing finds some more (README has figures of larger tables).
    ours, hashed = recall(model), recall(embedding.HashingEmbedder(64))
    assert ours >= 0.9 and ours >= hashed - 0.05, (ours, hashed)


def test_directions_are_the_leading_ones(spark):
    rng = random.Random(2)
    topics = [[f"t{k}w{i}" for i in range(12)] for k in range(6)]
    texts = [" ".join(rng.choices(rng.choice(topics), k=30)) for _ in range(150)]
    frame = spark.createDataFrame([(t,) for t in texts] + [(None,), (" ",), (texts[0],)], "code string").repartition(5)
    model = fitted.fit(frame, size=6, features=512)
    rows = fitted.Weighted(sorted(set(texts)), model.idf.astype(float))
    dense = np.zeros((rows.n, 512))
    np.add.at(dense, (rows.row, rows.column), rows.value)
    best = np.linalg.svd(dense, full_matrices=False)[2][:6].T
    kept = lambda d: np.linalg.norm(dense @ d) ** 2
    found = model.directions.astype(float)
    lengths = np.linalg.norm(found, axis=0)
    assert kept(found / lengths) >= 0.98 * kept(best)
    assert np.allclose((found / lengths).T @ (found / lengths), np.eye(6), atol=1e-3)
    assert np.allclose(lengths, np.linalg.norm(dense @ (found / lengths), axis=0) ** -0.5, rtol=0.05)


def test_fits_are_alike_and_kept(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"word{i % 7} common other{i % 3}") for i in range(60)], "chunk_id long, code string")
    a, b = fitted.fit(rows, size=4, features=256), fitted.fit(rows, size=4, features=256)
    assert a.name == b.name or np.allclose(np.abs(a.directions), np.abs(b.directions), atol=1e-4)
    a.save(spark, str(tmp_path / "model"))
    again = fitted.FittedEmbedder.load(spark, str(tmp_path / "model"))
    assert again.name == a.name and np.array_equal(again.embed(["word1 common"]), a.embed(["word1 common"]))
    assert not a.embed(["", " "]).any() and a.embed([]).shape == (0, 4)
    vectors, new = embedding.embed(rows, a)
    assert vectors.count() == 60 and new.count() == 21 and new.first()["model"] == a.name
    none = fitted.fit(rows.limit(0), size=4, features=256)
    assert none.embed(["word1"]).shape == (1, 4)
