"""Queries written in SQL over the functions that gneiss.functions.sql registers, and symbols' places over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.functions import fixed, sql
from gneiss.operators import symbols
from gneiss.plans.catalog import TERMS, _bm25, query, table


def _places(column: str, pattern: str, group: int, kind: str, of: str, key: str) -> str:
    """key, name, type and line of each match of a pattern: names, and line breaks in what is between the matches and in the matches before."""
    p = "'" + pattern.replace("'", "''") + "'"
    breaks = lambda x: f"coalesce(list_sum(list_transform({x}, lambda y: len(y) - len(replace(y, chr(10), '')))), 0)"
    return f"""SELECT {key}, names[i] AS name, '{kind}' AS type, (1 + {breaks('gaps[1:i]')} + {breaks('whole[1:i-1]')})::INT AS line
FROM (SELECT *, unnest(range(1, len(names) + 1)) AS i FROM (SELECT {key}, regexp_extract_all({column}, {p}, {group}) AS names, regexp_extract_all({column}, {p}, 0) AS whole, string_split_regex({column}, {p}) AS gaps FROM {of} WHERE {column} IS NOT NULL))"""


@query(" UNION ALL ".join(_places("text", p, 1, kind, "documents", "doc_id") for p, kind in fixed.PLAIN_PATTERNS))
def symbols_in_sql(spark, sf_dir):
    """A table function in a lateral join over all documents."""
    sql.register(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("gneiss_docs")
    return spark.sql("SELECT d.doc_id, s.name, s.type, s.line FROM gneiss_docs d, LATERAL plain_symbols(d.text) s")


@query(_bm25(TERMS) + " SELECT doc_id, round(sc, 4) score FROM sc ORDER BY sc DESC, doc_id LIMIT 20")
def bm25_in_sql(spark, sf_dir):
    """The flagship ranking as an SQL text: tokens once a document, frequencies of the query's terms within it, statistics in one row."""
    sql.register(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("gneiss_docs")
    counts = ", ".join(f"CAST(size(filter(t, x -> x = '{w}')) AS DOUBLE) AS tf{i}" for i, w in enumerate(TERMS))
    dfs = ", ".join(f"CAST(count_if(tf{i} > 0) AS DOUBLE) AS df{i}" for i in range(len(TERMS)))
    score = " + ".join(f"IF(tf{i} > 0, bm25_part(tf{i}, df{i}, n, doc_len, avg_len), 0D)" for i in range(len(TERMS)))
    return spark.sql(f"""WITH tok AS (SELECT doc_id, text_tokens(text) AS t FROM gneiss_docs),
counted AS (SELECT doc_id, CAST(size(t) AS DOUBLE) AS doc_len, {counts} FROM tok),
stats AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(doc_len) AS avg_len, {dfs} FROM counted),
scored AS (SELECT /*+ BROADCAST(stats) */ doc_id, {score} AS score FROM counted CROSS JOIN stats)
SELECT doc_id, round(score, 4) AS score FROM (SELECT * FROM scored WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20)""")


#: A pattern whose matches often go over a line's end.
_PAIR = r"(?:the|der|les)[ \n]+([a-zA-Z]+)"


@query(_places("text", _PAIR, 1, "pair", "documents", "doc_id") + " UNION ALL " + _places("html", r"<(\w+)[^>]*>", 1, "tag", "(SELECT page_id AS doc_id, html FROM pages)", "doc_id"))
def match_places(spark, sf_dir):
    """Names and first lines of matches that may go over lines, in whole documents and pages, without a Python worker."""

    def found(rows, key: str, column: str, pattern: str, kind: str):
        places = rows.select(F.col(key).alias("doc_id"), F.explode(symbols.matches(F.col(column), pattern)).alias("m"))
        return places.select("doc_id", F.regexp_extract("m.m", pattern, 1).alias("name"), F.lit(kind).alias("type"), F.col("m.line").alias("line"))

    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    return found(docs, "doc_id", "text", _PAIR, "pair").unionByName(found(pages, "page_id", "html", r"<(\w+)[^>]*>", "tag"))
