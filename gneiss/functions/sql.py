"""The functions of this package for SQL texts: register(spark), then

    SELECT d.doc_id, s.* FROM docs d, LATERAL plain_symbols(d.text) s
    SELECT doc_id, text_tokens(text) FROM docs
    SELECT bm25_part(tf, df, n, doc_len, avg_len) FROM postings

text_tokens and bm25_part are SQL functions, which Spark puts into the plan as expressions; plain_symbols, a table function,
runs in Python tasks. A null text has no tokens and no symbols."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from gneiss.functions import fixed, text
from gneiss.operators.lexical import K1, B


@udtf(returnType="name string, type string, line int")
class PlainSymbols:
    """Functions, classes and imports by the patterns that hold for any language, with the lines where they begin."""

    def __init__(self):
        self.rules = [(re.compile(p, re.ASCII), kind) for p, kind in fixed.PLAIN_PATTERNS]

    def eval(self, code: str) -> Iterator[tuple[str, str, int]]:
        for pattern, kind in self.rules:
            line, at = 1, 0
            for m in pattern.finditer(code or ""):
                line += code.count("\n", at, m.start())
                at = m.start()
                yield m.group(1), kind, line


def _literal(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register(spark: SparkSession) -> None:
    spark.udtf.register("plain_symbols", PlainSymbols)
    found = f"regexp_extract_all(lower(coalesce(words, '')), {_literal(text.TEXT_TOKENS)}, 0)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION text_tokens(words STRING) RETURNS ARRAY<STRING> RETURN filter({found}, t -> length(t) >= 2)")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION bm25_part(tf DOUBLE, df DOUBLE, n DOUBLE, doc_len DOUBLE, avg_len DOUBLE) RETURNS DOUBLE "
        f"RETURN ln((n - df + 0.5D) / (df + 0.5D) + 1D) * (tf * {K1 + 1}D / (tf + {K1}D * ({1 - B}D + {B}D * doc_len / avg_len)))"
    )
