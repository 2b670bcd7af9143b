"""Text embedding behind a cache: only texts whose key isn't cached are embedded, each distinct text once."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions import fixed
from gneiss.operators.catalog import cache_key


class Embedder(Protocol):
    name: str
    size: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Words hashed into signed buckets, vectors of length 1; a blank text has the zero vector. Needs no model file."""

    def __init__(self, size: int = 64):
        self.name, self.size = f"hashing-{size}", size

    def embed(self, texts: list[str]) -> np.ndarray:
        import re
        from zlib import crc32

        out = np.zeros((len(texts), self.size), np.float32)
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", (t or "").lower()):
                h = crc32(w.encode())
                out[i, h % self.size] += 1 if h >> 31 else -1
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=out, where=length > 0)


class QuantisedEmbedder:
    """Another embedder's vectors, each component as one of 255 steps of the vector's largest."""

    def __init__(self, inner: Embedder):
        self.inner, self.name, self.size = inner, f"{inner.name}-int8", inner.size

    def embed(self, texts: list[str]) -> np.ndarray:
        x = self.inner.embed(texts)
        most = np.abs(x).max(axis=1, keepdims=True) if len(x) else x
        scale = np.where(most > 0, most / 127, 1)
        return (np.rint(x / scale) * scale).astype(np.float32)


def cut_words(text: str, most: int) -> str:
    """The beginning of text with at most so many words, as models of a limited length take it."""
    words = text.split(None, most)
    return text if len(words) <= most else text[: len(text) - len(words[-1])].rstrip()


def batches_of(texts: list[str], size: int, most_chars: int) -> Iterator[list[str]]:
    """Texts in order, size at a time, fewer where they are long."""
    batch, chars = [], 0
    for t in texts:
        if batch and (len(batch) == size or chars + len(t) > most_chars):
            yield batch
            batch, chars = [], 0
        batch.append(t)
        chars += len(t)
    if batch:
        yield batch


def missing(chunks: DataFrame, model: str, cache: DataFrame | None, key: str = "chunk_id", code: str = "code") -> DataFrame:
    """key and code of the distinct texts that the cache doesn't hold."""
    keyed = chunks.select(F.col(code).alias("code"), cache_key(model, F.coalesce(F.col(code), F.lit(""))).alias("key"))
    texts = keyed.groupBy("key").agg(F.min("code").alias("code"))
    return texts.join(cache.select("key"), "key", "left_anti") if cache is not None else texts


def embed(chunks: DataFrame, embedder: Embedder, cache: DataFrame | None = None, key: str = "chunk_id", code: str = "code", batch_size: int = 64, most_words: int | None = None, most_chars: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """(key, embedding) for each chunk, and the new rows of the cache (key, model, embedding).

    batch_size texts go to the embedder at a time, fewer where they hold more than most_chars. They go whole, unless most_words
    is given or the embedder, as models of a limited length do, has a most_words of its own."""
    limit = most_words or getattr(embedder, "most_words", None)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = [cut_words(t, limit) if limit else t for t in batch.fillna("").tolist()]
            yield pd.Series([v for part in batches_of(texts, batch_size, most_chars) for v in embedder.embed(part)])

    new = missing(chunks, embedder.name, cache, key, code).select("key", F.lit(embedder.name).alias("model"), run("code").alias("embedding"))
    return vectors(chunks, embedder, new.unionByName(cache.select("key", "model", "embedding")) if cache is not None else new, key, code), new


def vectors(chunks: DataFrame, embedder: Embedder, cache: DataFrame, key: str = "chunk_id", code: str = "code") -> DataFrame:
    """(key, embedding) for each chunk whose text the cache holds."""
    keyed = chunks.select(key, cache_key(embedder.name, F.coalesce(F.col(code), F.lit(""))).alias("key"))
    return keyed.join(cache.select("key", "embedding"), "key").select(key, "embedding")


def classify_files(files: DataFrame, content: str = "content", most_bytes: int = fixed.MAX_FILE_BYTES) -> DataFrame:
    """files with skip: oversize, blank, or null for those to be embedded."""
    c = F.col(content)
    return files.withColumn("skip", F.when(F.octet_length(c) > most_bytes, "oversize").when(c.isNull() | (F.trim(c) == ""), "blank"))
