"""Weighted fusion of lexical and vector hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_SCORE = 0.01


def weights(lexical: float, semantic: float, current: tuple[float, float] | None = None) -> tuple[float, float]:
    """The two weights over their sum; both zero: the current ones, or halves."""
    total = lexical + semantic
    return (lexical / total, semantic / total) if total > 0 else current or (0.5, 0.5)


def result_type(b: Column, s: Column) -> Column:
    return F.when((b > 0) & (s == 0), "bm25_only").when((s > 0) & (b == 0), "semantic_only").otherwise("hybrid")


def fuse(lexical: DataFrame, semantic: DataFrame, w: tuple[float, float] = (0.5, 0.5), key: str = "chunk_id", least: float = MIN_SCORE, normalise: str = "none") -> DataFrame:
    """key, score, bm25_score, semantic_score, matched_terms, result_type; a missing score is 0, what is below least goes."""
    if normalise == "minmax":
        lexical, semantic = _minmax(lexical), _minmax(semantic)
    terms = F.col("terms") if "terms" in lexical.columns else F.array().cast("array<string>")
    both = lexical.select(key, F.col("score").alias("b"), terms.alias("t")).join(semantic.select(key, F.col("score").alias("s")), key, "full_outer")
    both = both.select(key, F.coalesce("b", F.lit(0.0)).alias("bm25_score"), F.coalesce("s", F.lit(0.0)).alias("semantic_score"), F.coalesce("t", F.array().cast("array<string>")).alias("matched_terms"))
    scored = both.withColumn("score", w[0] * F.col("bm25_score") + w[1] * F.col("semantic_score")).filter(F.col("score") >= least)
    return scored.withColumn("result_type", result_type(F.col("bm25_score"), F.col("semantic_score")))


def _minmax(hits: DataFrame) -> DataFrame:
    ends = hits.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    return hits.crossJoin(F.broadcast(ends)).withColumn("score", F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0)).drop("lo", "hi")


def top(fused: DataFrame, k: int, key: str = "chunk_id", digits: int | None = 4) -> DataFrame:
    """The k best by score, ties by key; rounded when all is ranked, with digits None not at all."""
    best = fused.orderBy(F.desc("score"), key).limit(k)
    return best if digits is None else best.withColumn("score", F.round("score", digits))


def explain(ranked: DataFrame, w: tuple[float, float], key: str = "chunk_id", rows: int = 10, digits: int = 4) -> DataFrame:
    """Rank, contributions and percentages of the first rows; ranked is the bounded output of a search."""
    share = lambda part: F.when(F.col("score") > 0, F.round(100 * part / F.col("score"), 1)).otherwise(0.0)
    lexical, semantic = w[0] * F.col("bm25_score"), w[1] * F.col("semantic_score")
    order = Window.orderBy(F.desc("score"), key)
    out = ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= rows)
    return out.select("rank", key, F.round("score", digits).alias("score"), F.round(lexical, digits).alias("bm25_part"), F.round(semantic, digits).alias("semantic_part"), share(lexical).alias("bm25_percent"), share(semantic).alias("semantic_percent"))


def top_per_group(hits: DataFrame, group: str, n: int, over: int = 10, key: str = "chunk_id") -> DataFrame:
    """Of the best over * n hits, n at most of each group, in rank order; hits with scores as they are, not rounded."""
    best = hits.orderBy(F.desc("score"), key).limit(over * n)
    order = Window.partitionBy(group).orderBy(F.desc("score"), key)
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
