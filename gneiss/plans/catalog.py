"""Named queries over the standard tables, each with SQL that gives the same rows where SQL can.

documents stand for chunks (doc_id, text, lang, source), embeddings for their vectors, events for requests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.functions import fixed, text
from gneiss.operators import catalog as store
from gneiss.operators import chunks, hybrid, lexical, symbols, vector
from gneiss.streaming import replay

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

TERMS = ["the", "that", "where", "and", "der"]
REPEATED = ["the", "and", "where", "the"]
#: The vector that the single-vector queries search for.
ASKED = 7


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenised(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", *keep)
    return docs.withColumn("tokens", text.tokens(F.col("text"), "text")).withColumn("doc_len", F.size("tokens")).drop("text")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == ASKED).select(F.col("embedding").alias("q")).limit(1)


def _queries(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def _sum(parts: list[Column]) -> Column:
    return reduce(Column.__add__, parts)


_TOK = r"""base AS (SELECT doc_id, lang, source, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+'),
  lambda x: length(x) >= 2 AND regexp_full_match(x, '[a-zA-Z_][a-zA-Z0-9_]*')) AS t FROM documents)"""


def _bm25(terms: list[str], base: str = _TOK) -> str:
    """CTEs up to sc(doc_id, sc, terms)."""
    values = ", ".join(f"('{t}', {i})" for i, t in enumerate(terms))
    return f"""WITH {base}, tok AS (SELECT doc_id, unnest(t) term FROM base),
p AS (SELECT doc_id, term, count(*)::DOUBLE tf FROM tok GROUP BY ALL), dl AS (SELECT doc_id, lang, source, len(t)::DOUBLE dl FROM base),
st AS (SELECT count(*)::DOUBLE n, avg(dl) av FROM dl), df AS (SELECT term, count(*)::DOUBLE df FROM p GROUP BY term),
asked AS (SELECT * FROM (VALUES {values}) v(term, place)),
sc AS (SELECT p.doc_id, dl.lang, dl.source, list_reduce(list(ln((n-df+0.5::DOUBLE)/(df+0.5::DOUBLE)+1.0::DOUBLE) * ((tf*2.5::DOUBLE)
  / (tf + 1.5::DOUBLE*(0.25::DOUBLE + 0.75::DOUBLE*dl/av))) ORDER BY place), lambda a, b: a + b) sc, string_agg(DISTINCT p.term, ',' ORDER BY p.term) terms
  FROM asked JOIN p USING (term) JOIN df USING (term) JOIN dl USING (doc_id) CROSS JOIN st GROUP BY ALL)"""


# Lexical ranking


@query(_bm25(TERMS) + " SELECT doc_id, round(sc, 4) score FROM sc ORDER BY sc DESC, doc_id LIMIT 20")
def bm25_topk(spark, sf_dir):
    return lexical.top(lexical.search(_tokenised(spark, sf_dir), TERMS, "doc_id"), 20, "doc_id").select("doc_id", "score")


@query(_bm25(TERMS) + " SELECT doc_id, lang, round(sc, 4) score FROM sc WHERE lang = 'en' ORDER BY sc DESC, doc_id LIMIT 20")
def bm25_lang_filter(spark, sf_dir):
    found = lexical.search(_tokenised(spark, sf_dir, "lang"), TERMS, "doc_id", ("lang",))
    return lexical.top(found.filter("lang = 'en'"), 20, "doc_id").select("doc_id", "lang", "score")


@query(_bm25(REPEATED) + " SELECT doc_id, round(sc, 4) score FROM sc ORDER BY sc DESC, doc_id LIMIT 20")
def bm25_dup_terms(spark, sf_dir):
    return lexical.top(lexical.search(_tokenised(spark, sf_dir), REPEATED, "doc_id"), 20, "doc_id").select("doc_id", "score")


@query(_bm25(TERMS) + " SELECT doc_id, terms FROM sc")
def bm25_matched_terms(spark, sf_dir):
    return lexical.search(_tokenised(spark, sf_dir), TERMS, "doc_id").select("doc_id", F.array_join("terms", ",").alias("terms"))


@query(_bm25(TERMS) + " SELECT doc_id, round(sc, 4) score FROM sc")
def bm25_scores(spark, sf_dir):
    return lexical.search(_tokenised(spark, sf_dir), TERMS, "doc_id").select("doc_id", F.round("score", 4).alias("score"))


@query(_bm25(TERMS, _TOK.replace("FROM documents)", "FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 500))")) + " SELECT doc_id, round(sc, 4) score FROM sc ORDER BY sc DESC, doc_id LIMIT 20")
def bm25_chunk_limit(spark, sf_dir):
    """The build's own limit: the first 500 chunks by id are the corpus."""
    rows = _tokenised(spark, sf_dir).orderBy("doc_id").limit(500)
    return lexical.top(lexical.search(rows, TERMS, "doc_id"), 20, "doc_id").select("doc_id", "score")


@query(f"""WITH {_TOK}, tok AS (SELECT doc_id, unnest(t) term FROM base), df AS (SELECT term, count(DISTINCT doc_id) df FROM tok GROUP BY term)
SELECT (SELECT count(*) FROM base)::BIGINT doc_count, (SELECT sum(len(t)) FROM base)::BIGINT total_length, (SELECT round(avg(len(t)), 6) FROM base) avg_len,
count(*)::BIGINT term_count, sum(strlen(term) * df + 8 * df)::BIGINT posting_bytes FROM df""")
def bm25_index_stats(spark, sf_dir):
    rows = _tokenised(spark, sf_dir)
    terms = lexical.document_frequency(rows).agg(F.count(F.lit(1)).alias("term_count"), F.sum(F.octet_length("term") * F.col("df") + 8 * F.col("df")).alias("posting_bytes"))
    return lexical.corpus_stats(rows).crossJoin(F.broadcast(terms)).withColumn("avg_len", F.round("avg_len", 6))


@query(f"WITH {_TOK} SELECT doc_id, unnest(t) term, count(*)::INT tf FROM base GROUP BY ALL".replace("SELECT doc_id, unnest(t) term, count(*)::INT tf FROM base GROUP BY ALL", "SELECT doc_id, term, count(*)::INT tf FROM (SELECT doc_id, unnest(t) term FROM base) GROUP BY ALL"))
def term_frequency(spark, sf_dir):
    return lexical.term_frequency(_tokenised(spark, sf_dir), "doc_id")


@query(f"WITH {_TOK} SELECT term, count(DISTINCT doc_id) df FROM (SELECT doc_id, unnest(t) term FROM base) GROUP BY term")
def document_frequency(spark, sf_dir):
    return lexical.document_frequency(_tokenised(spark, sf_dir))


@query(f"WITH {_TOK} SELECT doc_id, len(t)::INT doc_len FROM base")
def doc_length(spark, sf_dir):
    return _tokenised(spark, sf_dir).select("doc_id", "doc_len")


@query(f"WITH {_TOK} SELECT doc_id, md5(array_to_string(t, ' ')) tokens_md5 FROM base")
def tokenize_text(spark, sf_dir):
    return _tokenised(spark, sf_dir).select("doc_id", F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


@query()
def tokenize_code(spark, sf_dir):
    """Code tokens of every text; tested against a plain implementation, as RE2 lacks the word borders."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.tokens(F.col("text")), " ").alias("tokens"))


@query(r"SELECT page_id, md5(regexp_replace(html, '//[^\n]*', '', 'g')) code_md5 FROM pages")
def strip_comments(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.strip_comments(F.col("html"))).alias("code_md5"))


@query("""SELECT doc_id, score FROM (SELECT doc_id, ((CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(text), 'mail') THEN 1 ELSE 0 END)
+ (CASE WHEN contains(lower(source), 'the') THEN 2 ELSE 0 END) + (CASE WHEN contains(lower(source), 'mail') THEN 2 ELSE 0 END))::BIGINT score FROM documents)
WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 50""")
def keyword_search(spark, sf_dir):
    return lexical.keyword_search(table(spark, sf_dir, "documents"), "The mail", "doc_id", "text", "source", 50)


# Vectors

_Q = f"q AS (SELECT embedding::DOUBLE[] q FROM embeddings WHERE vec_id = {ASKED} LIMIT 1)"
_COS = "list_cosine_similarity(embedding::DOUBLE[], q)"


@query(f"WITH {_Q} SELECT vec_id, round({_COS}, 6) score FROM embeddings, q ORDER BY {_COS} DESC, vec_id LIMIT 10")
def knn_cosine(spark, sf_dir):
    return vector.knn(table(spark, sf_dir, "embeddings"), _asked(spark, sf_dir), key="vec_id")


@query(f"WITH {_Q} SELECT vec_id, round(s, 6) score FROM (SELECT vec_id, list_sum(list_transform(list_zip(embedding::DOUBLE[], q), lambda z: (z[1]-z[2])*(z[1]-z[2]))) s FROM embeddings, q) ORDER BY s, vec_id LIMIT 10")
def knn_l2(spark, sf_dir):
    return vector.knn(table(spark, sf_dir, "embeddings"), _asked(spark, sf_dir), key="vec_id", metric="l2")


@query(f"WITH {_Q} SELECT vec_id, round({_COS}, 6) score FROM embeddings, q WHERE label IN (1, 3, 5) ORDER BY {_COS} DESC, vec_id LIMIT 10")
def knn_filtered(spark, sf_dir):
    wanted = spark.createDataFrame([(1,), (3,), (5,)], "label int")
    rows = table(spark, sf_dir, "embeddings").join(F.broadcast(wanted), "label", "left_semi")
    return vector.knn(rows, _asked(spark, sf_dir), key="vec_id")


#: Every row whose id is divisible by 50 as query, against all rows or those that share something with it.
_NEAREST = """WITH s AS (SELECT q.vec_id query_id, c.vec_id, list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]) score
FROM embeddings c JOIN embeddings q ON q.vec_id % 50 = 0 AND {on})
SELECT query_id, rank, vec_id, round(score, 6) score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT rank FROM s) WHERE rank <= 10"""


@query(_NEAREST.format(on="c.label IS NOT DISTINCT FROM q.label"))
def knn_batch(spark, sf_dir):
    """Each query among the vectors of its own label, which the filter takes before the search."""
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "label")
    return vector.knn_batch(rows, asked, key="vec_id", within="label")


@query(_NEAREST.format(on="TRUE"))
def knn_batch_all(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return vector.knn_batch(rows, _queries(rows.filter("vec_id % 50 = 0")), key="vec_id")


@query("""WITH n AS (SELECT vec_id, embedding::DOUBLE[] v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) n FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(v, lambda x: x / n)), 6) total, round(sqrt(list_sum(list_transform(v, lambda x: (x / n) * (x / n)))), 6) length FROM n""")
def vector_normalize_check(spark, sf_dir):
    v = vector.normalised(vector.as_double("embedding"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"))
    return rows.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(vector.norm(F.col("v")), 6).alias("length"))


@query("""WITH n AS (SELECT vec_id, embedding::DOUBLE[] v, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) m FROM embeddings)
SELECT vec_id, list_sum(list_transform(v, lambda x: round(x * 127 / m)::BIGINT))::BIGINT total, round(m / 127, 9) scale FROM n""")
def vector_quantize_int8(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", vector.quantised(vector.as_double("embedding")).alias("q"))
    return rows.select("vec_id", F.aggregate("q.values", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.round("q.scale", 9).alias("scale"))


_CELLS = """c AS (SELECT vec_id::INT cell, embedding::DOUBLE[] c FROM embeddings WHERE vec_id < 16),
a AS (SELECT vec_id, embedding, arg_max(cell, (round(list_cosine_similarity(embedding::DOUBLE[], c), 9), -cell)) cell FROM embeddings, c GROUP BY vec_id, embedding)"""


@query(_NEAREST.format(on="TRUE"))
def ivf_probe(spark, sf_dir):
    """Every row whose id is divisible by 50 is asked through trained cells: first the ten nearest cells, then those that can still hold a nearer vector by their radius."""
    rows = table(spark, sf_dir, "embeddings").filter(F.col("embedding").isNotNull())
    centroids = vector.train_cells(rows)
    cells = vector.with_cells(rows, centroids, "vec_id")
    return vector.knn_cells_exact(cells, _queries(rows.filter("vec_id % 50 = 0")), centroids, key="vec_id")


@query(f"WITH {_CELLS} SELECT cell, count(*) n FROM a GROUP BY cell")
def ivf_cell_sizes(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    centroids = rows.filter("vec_id < 16").select(F.col("vec_id").cast("int").alias("cell"), vector.as_double("embedding").alias("c"))
    return vector.with_cells(rows, centroids, "vec_id").groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


@query()
def ivf_batch(spark, sf_dir):
    """The index search over trained cells: every vector is assigned, every row whose id is divisible by 50 is asked, and so
    many cells are probed that recall@10 is at least 0.9. Tested against brute force, as SQL can't train cells."""
    rows = table(spark, sf_dir, "embeddings").filter(F.col("embedding").isNotNull())
    centroids = vector.train_cells(rows)
    cells = vector.with_cells(rows, centroids, "vec_id")
    asked = _queries(rows.filter("vec_id % 50 = 0"))
    return vector.knn_cells_batch(cells, asked, centroids, nprobe=vector.least_probes(cells, asked, centroids, key="vec_id"), key="vec_id")


@query("SELECT label, count(*) n FROM embeddings GROUP BY label")
def vector_count_by_label(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


# Fusion


def _fused(spark, sf_dir, k: int = 20, w=(0.5, 0.5), least: float = hybrid.MIN_SCORE) -> DataFrame:
    words = lexical.top(lexical.search(_tokenised(spark, sf_dir), TERMS, "doc_id"), 2 * k, "doc_id", None)
    near = vector.knn(table(spark, sf_dir, "embeddings"), _asked(spark, sf_dir), 2 * k, key="vec_id", digits=None).withColumnRenamed("vec_id", "doc_id")
    return hybrid.fuse(words, near, w, "doc_id", least)


def _hybrid(w: tuple[float, float] = (0.5, 0.5), least: float = 0.01, k: int = 20) -> str:
    return _bm25(TERMS) + f""", {_Q}, lx AS (SELECT doc_id, sc b FROM sc ORDER BY b DESC, doc_id LIMIT {2 * k}),
vx AS (SELECT vec_id doc_id, {_COS} s FROM embeddings, q ORDER BY s DESC, doc_id LIMIT {2 * k}),
f AS (SELECT doc_id, coalesce(b, 0.0::DOUBLE) b, coalesce(s, 0.0::DOUBLE) s FROM lx FULL JOIN vx USING (doc_id)),
h AS (SELECT doc_id, b, s, {w[0]}::DOUBLE * b + {w[1]}::DOUBLE * s score, CASE WHEN b > 0 AND s = 0 THEN 'bm25_only' WHEN s > 0 AND b = 0 THEN 'semantic_only' ELSE 'hybrid' END result_type
  FROM f WHERE {w[0]}::DOUBLE * b + {w[1]}::DOUBLE * s >= {least}::DOUBLE)"""


def _hits(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "score", F.round("bm25_score", 6).alias("bm25_score"), F.round("semantic_score", 6).alias("semantic_score"), "result_type")


_HIT_SQL = "doc_id, round(score, 8) score, round(b, 6) bm25_score, round(s, 6) semantic_score, result_type FROM h ORDER BY h.score DESC, doc_id LIMIT 20"


@query(_hybrid() + " SELECT " + _HIT_SQL)
def hybrid_topk(spark, sf_dir):
    return _hits(hybrid.top(_fused(spark, sf_dir), 20, "doc_id", 8))


@query(_hybrid((0.25, 0.75)) + " SELECT " + _HIT_SQL)
def hybrid_weights(spark, sf_dir):
    return _hits(hybrid.top(_fused(spark, sf_dir, w=hybrid.weights(1, 3)), 20, "doc_id", 8))


@query(_hybrid(least=0.4) + " SELECT doc_id, round(score, 8) score FROM h")
def hybrid_threshold(spark, sf_dir):
    return _fused(spark, sf_dir, least=0.4).select("doc_id", F.round("score", 8).alias("score"))


@query(_hybrid() + " SELECT result_type, count(*) n FROM h GROUP BY result_type")
def hybrid_result_type(spark, sf_dir):
    return _fused(spark, sf_dir).groupBy("result_type").agg(F.count(F.lit(1)).alias("n"))


@query(_hybrid() + """, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id)::INT rank FROM (SELECT * FROM h ORDER BY score DESC, doc_id LIMIT 20))
SELECT rank, doc_id, round(score, 8) score, round(0.5::DOUBLE * b, 8) bm25_part, round(0.5::DOUBLE * s, 8) semantic_part,
CASE WHEN score > 0 THEN round(100 * (0.5::DOUBLE * b) / score, 1) ELSE 0.0::DOUBLE END bm25_percent, CASE WHEN score > 0 THEN round(100 * (0.5::DOUBLE * s) / score, 1) ELSE 0.0::DOUBLE END semantic_percent FROM r WHERE rank <= 10""")
def hybrid_explain(spark, sf_dir):
    return hybrid.explain(hybrid.top(_fused(spark, sf_dir), 20, "doc_id", None), (0.5, 0.5), "doc_id", digits=8)


@query(_bm25(TERMS) + """, best AS (SELECT doc_id, source, sc score FROM sc ORDER BY score DESC, doc_id LIMIT 50)
SELECT doc_id, source, round(score, 4) score, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id)::INT rank FROM best) WHERE rank <= 5""")
def multi_source_topn(spark, sf_dir):
    found = lexical.search(_tokenised(spark, sf_dir, "source"), TERMS, "doc_id", ("source",))
    best = hybrid.top_per_group(found.select("doc_id", "source", "score"), "source", 5, key="doc_id")
    return best.withColumn("score", F.round("score", 4))


# Chunks

_STRIP = r"regexp_replace(code, '^\s+|\s+$', '', 'g')"
_CHUNKS = f"""w AS (SELECT doc_id, lang, (i + 1)::INT start_line, least(i + 50, len(ls))::INT end_line, array_to_string(ls[i+1:i+50], chr(10)) code
  FROM (SELECT doc_id, lang, ls, unnest(range(0, len(ls), 40)) i FROM (SELECT doc_id, lang, string_split(text, chr(10)) ls FROM documents))),
ch AS (SELECT doc_id, lang, start_line, end_line, code, md5(code) ast_hash FROM w WHERE length({_STRIP}) >= 10)"""


def _chunks(spark, sf_dir) -> DataFrame:
    return chunks.chunk(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")


@query(f"WITH {_CHUNKS} SELECT doc_id, start_line, end_line, ast_hash FROM ch")
def chunk_windows(spark, sf_dir):
    return _chunks(spark, sf_dir).select("doc_id", "start_line", "end_line", "ast_hash")


@query(f"WITH {_CHUNKS} SELECT doc_id, count(*) n FROM ch GROUP BY doc_id")
def chunk_count_per_doc(spark, sf_dir):
    return _chunks(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_CHUNKS} SELECT ast_hash, count(*) n FROM ch GROUP BY ast_hash HAVING count(*) > 1")
def duplicate_chunks(spark, sf_dir):
    return chunks.duplicates(_chunks(spark, sf_dir))


@query("SELECT lang, count(*) n FROM documents GROUP BY lang ORDER BY n DESC, lang")
def chunks_by_language(spark, sf_dir):
    return store.by_language(table(spark, sf_dir, "documents"), "lang")


@query("SELECT count(*) total_chunks, count(DISTINCT source) total_repos, count(DISTINCT lang) languages, coalesce(sum(length(text)), 0)::BIGINT total_chars FROM documents")
def catalog_stats(spark, sf_dir):
    return store.stats(table(spark, sf_dir, "documents"), "text", "source", "lang")


# Symbols

_IDENT = "[A-Za-z_][A-Za-z0-9_]*"


@query(r"SELECT page_id, array_to_string(list_sort(list_distinct(list_concat(list_concat(regexp_extract_all(html, 'def\s+(\w+)', 1), regexp_extract_all(html, 'class\s+(\w+)', 1)), regexp_extract_all(html, 'async\s+def\s+(\w+)', 1)))), ',') names FROM pages")
def symbol_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(text.names(F.col("html"), "python"), ",").alias("names"))


@query(r"""SELECT type, count(*) n FROM (SELECT unnest(regexp_extract_all(html, '(?:fn|def|function|func)\s+([a-zA-Z_][a-zA-Z0-9_]*)', 1)) x, 'function' AS type FROM pages
UNION ALL SELECT unnest(regexp_extract_all(html, '(?:class|struct)\s+([a-zA-Z_][a-zA-Z0-9_]*)', 1)), 'class' FROM pages
UNION ALL SELECT unnest(regexp_extract_all(html, '(?:import|from)\s+([a-zA-Z0-9_.]+)', 1)), 'import' FROM pages) GROUP BY type""")
def symbol_counts_by_type(spark, sf_dir):
    return symbols.counts_by_type(table(spark, sf_dir, "pages").select(text.plain_symbols(F.col("html")).alias("symbols")))


@query(r"""SELECT doc_id, line, count(*) n FROM (SELECT doc_id, line, unnest(regexp_extract_all(ls[line], '\b(the|der|les)\b', 1)) w
FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1))::INT line FROM (SELECT doc_id, string_split(text, chr(10)) ls FROM documents))) GROUP BY ALL""".replace(r"\b(the|der|les)\b", r"(?:^| )(the|der|les) "))
def symbol_start_lines(spark, sf_dir):
    found = symbols.match_lines(F.col("text"), "(?:^| )(the|der|les) ")
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("m")).groupBy("doc_id", F.col("m.line").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '(\w+)\s*\(', 1))), ',') calls FROM pages")
def function_calls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(text.calls(F.col("html")), ",").alias("calls"))


@query("SELECT doc_id, (1" + "".join(f" + CAST((length(text) - length(replace(text, '{m}', ''))) / {len(m)} AS INT)" for m in fixed.COMPLEXITY_MARKS) + ")::INT complexity FROM documents")
def complexity(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.complexity(F.col("text")).alias("complexity"))


@query(r"SELECT page_id, CASE lower(regexp_extract(url, '(\.[^./]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.LANGUAGES.items()) + " END AS language FROM pages")
def language_from_path(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.language_of(F.col("url")).alias("language"))


@query(r"SELECT page_id, len(list_filter(string_split(url, '/'), lambda p: p <> '' AND (starts_with(p, '.') OR p IN ('build', 'dist', 'out', 'env', 'venv', 'target', 'node_modules')))) > 0 AS ignored FROM pages")
def ignore_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.ignored(F.col("url")).alias("ignored"))


# Catalog


@query("SELECT d.doc_id FROM documents d WHERE d.doc_id IS NULL OR d.doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def orphan_rows(spark, sf_dir):
    return store.orphans(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("""SELECT coalesce(n.n_nationkey::BIGINT, -1) repo_id, coalesce(n.n_name, s.path) path, coalesce(s.name, 'old') AS name
FROM nation n FULL JOIN (SELECT r_name path, 'new' AS name FROM region UNION ALL SELECT n_name, 'seen' FROM nation WHERE n_regionkey = 1) s ON n.n_name = s.path""")
def repo_upsert(spark, sf_dir):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    repos = nation.select(F.col("n_nationkey").cast("long").alias("repo_id"), F.col("n_name").alias("path"), F.lit("old").alias("name"), now.alias("last_indexed"), now.alias("created_at"))
    seen = region.select(F.col("r_name").alias("path"), F.lit("new").alias("name"), now.alias("last_indexed")).unionByName(nation.filter("n_regionkey = 1").select(F.col("n_name").alias("path"), F.lit("seen").alias("name"), now.alias("last_indexed")))
    out = store.upsert_repos(repos, seen)
    known = out.join(nation.select(F.col("n_name").alias("path"), F.lit(True).alias("_old")), "path", "left")
    return known.select(F.when(F.col("_old"), F.col("repo_id")).otherwise(F.lit(-1).cast("long")).alias("repo_id"), "path", "name")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) ORDER BY doc_id LIMIT 1000")
def pending_embeddings(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return store.pending(table(spark, sf_dir, "documents").select("doc_id"), vectors, "doc_id", 1000)


@query("SELECT substr(sha256('m:' || text), 1, 32) AS key, count(*) n FROM documents GROUP BY ALL")
def cache_lookup(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(store.cache_key("m", F.col("text")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) r, count(*) OVER () n FROM documents) WHERE r > n // 5")
def cache_evict(spark, sf_dir):
    return store.evicted(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), 5, "n_chars", "doc_id").select("doc_id")


@query("""WITH r AS (SELECT split_part(url, '/', 1) || '/' || split_part(url, '/', 2) || '/' || split_part(url, '/', 3) path, min(page_id) repo_id FROM pages GROUP BY ALL)
SELECT page_id, r.repo_id FROM pages p LEFT JOIN r ON p.url = r.path OR starts_with(p.url, r.path || '/')""")
def prefix_join(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("file_path"), F.lit(None).cast("long").alias("repo_id"))
    host = F.array_join(F.slice(F.split("file_path", "/"), 1, 3), "/")
    repos = pages.groupBy(host.alias("path")).agg(F.min("page_id").alias("repo_id"))
    return store.assign_repo(pages, repos).select("page_id", "repo_id")


# Changes


@query("""WITH b AS (SELECT doc_id, md5(text) h FROM documents WHERE doc_id % 5 <> 0), a AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN md5(text || '!') ELSE md5(text) END h FROM documents WHERE doc_id % 7 <> 0)
SELECT * FROM (SELECT CASE WHEN b.h IS NULL THEN 'created' WHEN a.h IS NULL THEN 'deleted' WHEN a.h <> b.h THEN 'modified' END event_type,
coalesce(a.doc_id, b.doc_id)::VARCHAR file_path, coalesce(a.h, b.h) file_hash FROM b FULL JOIN a USING (doc_id)) WHERE event_type IS NOT NULL""")
def snapshot_diff(spark, sf_dir):
    """Two states made from all documents: what the second misses is deleted, what the first misses created, every third edited."""
    docs, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    before = docs.filter(i % 5 != 0).select(i.cast("string").alias("file_path"), F.md5("text").alias("file_hash"))
    after = docs.filter(i % 7 != 0).select(i.cast("string").alias("file_path"), F.when(i % 3 == 0, F.md5(F.concat("text", F.lit("!")))).otherwise(F.md5("text")).alias("file_hash"))
    return replay.snapshot_diff(before, after)


@query("SELECT doc_id, md5(CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END) preview_md5, '1-' || n_chars AS lines, round(n_chars / 7.0::DOUBLE, 4) score FROM documents")
def preview_format(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.preview(F.col("text"))).alias("preview_md5"), text.line_range(F.lit(1), F.col("n_chars")).alias("lines"), F.round(F.col("n_chars") / 7.0, 4).alias("score"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(substr(text, 1, 1000), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '^\s+|\s+$', '', 'g')) query_md5 FROM documents")
def sanitize_query(spark, sf_dir):
    """Cutting to 1000 characters is what the operator does to a query text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.sanitised_query(F.col("text"))).alias("query_md5"))


def _requests(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))


@query()
def debounce_replay(spark, sf_dir):
    """Of each user's events of a type those that come six hours or more after the last one that passed."""
    return replay.debounce(_requests(spark, sf_dir), ["user_id", "event_type"], gap_us=6 * 3_600_000_000)


@query()
def rate_limit_replay(spark, sf_dir):
    """Three accepted requests a client and day; rejected ones don't count."""
    return replay.rate_limit(_requests(spark, sf_dir), "user_id", limit=3, window_us=24 * 3_600_000_000)


@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts)::TIMESTAMP AS day, count(*) n, round(sum(value), 4) total FROM events GROUP BY ALL")
def events_by_day(spark, sf_dir):
    day = F.window(F.col("ts").cast("timestamp"), "1 day")
    rows = table(spark, sf_dir, "events").groupBy("event_type", day.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("day"), "n", "total")
