"""An embedder that is fitted on the texts it is for: the leading singular directions of their weighted term counts.

Words are hashed into a fixed number of features; a text is the vector of its log counts times the features' inverse
document frequencies, of length 1. A direction counts with the inverse root of its singular value, so the few strongest
don't drown the others. The directions come from randomised iteration (Halko,
Martinsson and Tropp, 2011): tasks multiply their rows with a random matrix and back, a grouped shuffle adds the tasks'
products up, and the driver, which gets features x (directions + OVERSAMPLE) numbers whatever the number of texts,
orthogonalises them. Each round is one pass over the sample.

The fit takes at most sample texts, by a hash of the text; document frequencies are of the same texts. Null and blank texts
take no part in the fit and have the zero vector. No model file is needed, and equal texts and settings give an equal fit."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators.catalog import Table

FEATURES, OVERSAMPLE, ROUNDS, SAMPLE = 1 << 14, 8, 3, 100_000
_WORDS = re.compile(r"\w+")


def feature_counts(text: str, features: int) -> dict[int, int]:
    return Counter(crc32(w.encode()) % features for w in _WORDS.findall((text or "").lower()))


class Weighted:
    """Rows of a sparse matrix: of each text its features and their weights, of length 1."""

    def __init__(self, texts: list[str], idf: np.ndarray):
        counts = [feature_counts(t, len(idf)) for t in texts]
        sizes = [len(c) for c in counts]
        self.n, self.row = len(texts), np.repeat(np.arange(len(texts)), sizes)
        self.column = np.fromiter((f for c in counts for f in c), np.int64, sum(sizes))
        value = np.log1p(np.fromiter((x for c in counts for x in c.values()), float, sum(sizes))) * idf[self.column]
        length = np.sqrt(np.bincount(self.row, value * value, self.n))
        self.value = value / np.maximum(length, 1e-300)[self.row]

    def times(self, m: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, m.shape[1]))
        np.add.at(out, self.row, self.value[:, None] * m[self.column])
        return out

    def back(self, y: np.ndarray, out: np.ndarray) -> None:
        np.add.at(out, self.column, self.value[:, None] * y[self.row])


class FittedEmbedder:
    def __init__(self, idf: np.ndarray, directions: np.ndarray):
        self.idf, self.directions, self.size = idf.astype(np.float32), directions.astype(np.float32), directions.shape[1]
        digest = hashlib.sha256(self.idf.tobytes() + self.directions.tobytes()).hexdigest()
        #: Vectors of another fit have other keys in a cache.
        self.name = f"fitted-{self.size}-{digest[:12]}"

    def embed(self, texts: list[str]) -> np.ndarray:
        out = Weighted(texts, self.idf.astype(float)).times(self.directions.astype(float))
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=np.zeros_like(out), where=length > 1e-12).astype(np.float32)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, float(w), d.tolist()) for i, (w, d) in enumerate(zip(self.idf, self.directions, strict=True))]
        Table(spark, path).write(spark.createDataFrame(rows, "feature int, idf float, direction array<float>"))

    @staticmethod
    def load(spark: SparkSession, path: str) -> FittedEmbedder:
        rows = Table(spark, path).read().orderBy("feature").collect()  # a row a feature
        return FittedEmbedder(np.array([r["idf"] for r in rows], np.float32), np.array([r["direction"] for r in rows], np.float32))


def _summed(rows: DataFrame, width: int) -> np.ndarray:
    """The sum of the tasks' matrices, of which rows (feature, part) hold lines as float64 bytes."""

    def run(t: pa.Table) -> pa.Table:
        lines = np.frombuffer(b"".join(t.column("part").to_pylist()), float).reshape(-1, width)
        features, at = np.unique(t.column("feature").to_numpy(), return_inverse=True)
        out = np.zeros((len(features), width))
        np.add.at(out, at, lines)
        return pa.table([pa.array(features, pa.int32()), pa.array([x.tobytes() for x in out], pa.binary())], names=["feature", "part"])

    found = rows.groupBy((F.col("feature") % 64).alias("slice")).applyInArrow(run, "feature int, part binary").collect()
    out = np.zeros((max((r["feature"] for r in found), default=-1) + 1, width))
    for r in found:
        out[r["feature"]] = np.frombuffer(r["part"], float)
    return out


def fit(texts: DataFrame, code: str = "code", size: int = 64, features: int = FEATURES, sample: int = SAMPLE, seed: int = 5) -> FittedEmbedder:
    """Fits size directions on at most sample distinct texts."""
    known = texts.select(F.col(code).cast("string").alias("t")).filter(F.length(F.trim("t")) > 0)
    chosen = known.select(F.xxhash64("t").alias("h")).distinct().orderBy("h").limit(sample)
    rows = known.withColumn("h", F.xxhash64("t")).join(chosen, "h", "left_semi").dropDuplicates(["h"]).select("t")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(features, np.int64), 0
        for batch in batches:
            for t in batch.column("t").to_pylist():
                df[list(feature_counts(t, features))] += 1
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(features + 1), pa.int32()), pa.array(np.append(df, n))], ["feature", "n"])

    df = np.zeros(features + 1)
    for r in rows.mapInArrow(counted, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():  # a row a feature
        df[r["feature"]] = r["n"]
    idf = np.log((df[-1] + 1) / (df[:-1] + 1)) + 1
    width = min(size + OVERSAMPLE, features)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(features, width)))[0]
    product = basis
    for _ in range(ROUNDS):
        sent = rows.sparkSession.sparkContext.broadcast((idf, basis))

        def multiplied(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            weights, m = sent.value
            out = np.zeros(m.shape)
            for batch in batches:
                for a in range(0, batch.num_rows, 200):
                    part = Weighted(batch.column("t").slice(a, 200).to_pylist(), weights)
                    part.back(part.times(m), out)
            used = np.flatnonzero(out.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([out[i].tobytes() for i in used], pa.binary())], ["feature", "part"])

        found = _summed(rows.mapInArrow(multiplied, "feature int, part binary"), width)
        sent.unpersist()
        product = np.zeros((features, width))
        product[: len(found)] = found
        projected = basis.T @ product
        values, turned = np.linalg.eigh((projected + projected.T) / 2)
        last, basis = basis, np.linalg.qr(product)[0]
    order = np.argsort(-values)[:size]
    scale = np.where(values[order] > 1e-9, np.maximum(values[order], 1e-9) ** -0.25, 0.0)  # values are squares of singular ones
    directions = last @ turned[:, order] * scale
    return FittedEmbedder(idf, np.pad(directions, ((0, 0), (0, max(0, size - directions.shape[1])))))
