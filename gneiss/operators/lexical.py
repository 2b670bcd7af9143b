"""BM25 ranking and keyword search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions import text

K1, B = 1.5, 0.75


def doc_tokens(docs: DataFrame, language: Column | str = "code", mode: str = "line", key: str = "chunk_id", code: str = "code") -> DataFrame:
    return docs.withColumn("tokens", text.tokens(F.col(code), language, mode)).withColumn("doc_len", F.size("tokens"))


def term_counts(tokens: Column) -> Column:
    """term and tf of each distinct word of a list: sorted, each stretch of equal words is one. Nothing leaves the row, whatever its size."""

    def stretches(words: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: (i == 1) | (F.get(words, i - 1) != F.get(words, i - 2)))
        count = lambda at: F.transform(at, lambda i, n: F.struct(F.get(words, i - 1).alias("term"), (F.coalesce(F.get(at, n + 1), F.size(words) + 1) - i).alias("tf")))
        return F.get(F.transform(F.array(starts), count), F.lit(0))

    counted = F.get(F.transform(F.array(F.sort_array(tokens)), stretches), F.lit(0))
    return F.when(F.size(tokens) > 0, counted).otherwise(F.array().cast("array<struct<term:string,tf:int>>"))


def term_frequency(tokenised: DataFrame, key: str = "chunk_id") -> DataFrame:
    """term, key, tf: one row for each term of a document. Terms are counted where their document is, so nothing is shuffled."""
    return tokenised.select(key, F.explode(term_counts(F.col("tokens"))).alias("t")).select("t.term", key, "t.tf")


def document_frequency(tokenised: DataFrame, key: str = "chunk_id") -> DataFrame:
    """term, df. Terms are made distinct within the document's row, so one shuffle counts them."""
    return tokenised.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(tokenised: DataFrame) -> DataFrame:
    """doc_count, total_length, avg_len; documents without tokens count."""
    return tokenised.agg(F.count(F.lit(1)).alias("doc_count"), F.coalesce(F.sum(F.col("doc_len").cast("long")), F.lit(0)).alias("total_length"), F.coalesce(F.avg(F.col("doc_len").cast("double")), F.lit(0.0)).alias("avg_len"))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1.0)


def weight(tf: Column, doc_len: Column, avg_len: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * doc_len / avg_len))


def search(tokenised: DataFrame, terms: list[str], key: str = "chunk_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, score, terms and the columns of keep for documents with a query term; a repeated term counts again.

    For a query over texts no postings are needed: each row counts the query's terms among its tokens, one aggregate of
    a single row gives all statistics, and nothing else is shuffled."""
    distinct = list(dict.fromkeys(terms))
    if not distinct:
        return tokenised.select(key, F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("terms"), *keep).limit(0)

    def count(term: str) -> Column:
        return F.size(F.filter("asked", lambda t: t == term))

    asked = tokenised.select(key, "doc_len", *keep, F.filter("tokens", lambda t: t.isin(distinct)).alias("asked"))
    counted = asked.select(key, "doc_len", *keep, *(count(t).alias(f"tf{i}") for i, t in enumerate(distinct)))
    stats = counted.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(F.col("doc_len").cast("double")).alias("avg_len"), *(F.count_if(F.col(f"tf{i}") > 0).cast("double").alias(f"df{i}") for i in range(len(distinct))))
    parts = [F.when(F.col(f"tf{i}") > 0, idf(F.col("n"), F.col(f"df{i}")) * weight(F.col(f"tf{i}"), F.col("doc_len"), F.col("avg_len"))).otherwise(0.0) for i in map(distinct.index, terms)]
    found = F.array_compact(F.array(*(F.when(F.col(f"tf{i}") > 0, F.lit(t)) for i, t in enumerate(distinct))))
    # The one row of statistics is broadcast. A score above 0 means a query term; a filter on the counts themselves would
    # be pushed below and tokenise each text once more for every term.
    scored = counted.crossJoin(F.broadcast(stats)).select(key, reduce(Column.__add__, parts).alias("score"), F.array_sort(found).alias("terms"), *keep)
    return scored.filter("score > 0")


def top(scored: DataFrame, k: int, key: str = "chunk_id", digits: int | None = 4) -> DataFrame:
    """The k best by score, ties by key; the score is rounded when all is ranked, with digits None not at all."""
    best = scored.orderBy(F.desc("score"), key).limit(k)
    return best if digits is None else best.withColumn("score", F.round("score", digits))


def keyword_search(chunks: DataFrame, query: str, key: str = "chunk_id", code: str = "code", symbols: str | None = None, limit: int = 10) -> DataFrame:
    """For each word of query 1 if the code contains it and 2 if the symbols do; the best limit rows."""
    words = query.lower().split()
    lowered = F.lower(code)
    parts = [F.when(F.contains(lowered, F.lit(w)), 1).otherwise(0) for w in words]
    if symbols:
        parts += [F.when(F.contains(F.lower(symbols), F.lit(w)), 2).otherwise(0) for w in words]
    scored = chunks.withColumn("score", reduce(Column.__add__, parts, F.lit(0)).cast("long"))
    return scored.filter("score > 0").select(key, "score").orderBy(F.desc("score"), key).limit(limit)
