"""Queries over stored indexes and maintained tables: each writes its index below the shared folder and reads it back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from gneiss.operators import catalog as store
from gneiss.operators import chunks, embedding, graph, segments, vector
from gneiss.plans.catalog import _CHUNKS, _COS, _Q, _TOK, ORACLE_SQL, TERMS, _asked, _bm25, query, table
from gneiss.sources import files, watch
from gneiss.streaming import replay


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; without one, below the temporary folder of a local session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = "file://" + tempfile.gettempdir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Indexes


def _texts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("code"), F.lit("text").alias("language"))


def _index(spark, sf_dir) -> segments.SegmentIndex:
    return segments.SegmentIndex.build(_texts(spark, sf_dir), folder(spark, "bm25"))


_TOP = _bm25(TERMS) + " SELECT doc_id chunk_id, round(sc, 4) score, terms FROM sc ORDER BY sc DESC, doc_id LIMIT 20"


def _top(index: segments.SegmentIndex) -> DataFrame:
    return index.search(" ".join(TERMS), None, 20).select("chunk_id", "score", F.array_join("terms", ",").alias("terms"))


@query(_TOP)
def bm25_index_search(spark, sf_dir):
    """A query over stored postings: buckets that can't reach the k-th score aren't scored."""
    return _top(_index(spark, sf_dir))


@query(_TOP)
def bm25_segments_search(spark, sf_dir):
    """An index that grew by parts: some documents came first with other texts, some came twice, others were removed and came again."""
    docs, i = _texts(spark, sf_dir), F.col("chunk_id")
    former = docs.filter(i % 3 != 0).withColumn("code", F.when(i % 4 == 0, "other words the and where").otherwise(F.col("code")))
    index = segments.SegmentIndex.build(former, folder(spark, "bm25"))
    index.update(docs.filter(i % 4 == 0))
    index.update(None, docs.filter(i % 5 == 1).select("chunk_id"))
    index.update(docs.filter((i % 3 == 0) & (i % 4 != 0)))
    index.update(docs.filter(i % 5 == 1))
    return _top(index)


@query(f"WITH {_TOK}, tok AS (SELECT doc_id, unnest(t) term FROM base) SELECT term, count(DISTINCT doc_id)::BIGINT df, count(*)::BIGINT tf FROM tok GROUP BY term")
def bm25_index_terms(spark, sf_dir):
    return _index(spark, sf_dir).terms()


@query(f"""WITH {_TOK}, tok AS (SELECT doc_id, unnest(t) term FROM base), df AS (SELECT term, count(DISTINCT doc_id) df FROM tok GROUP BY term)
SELECT (SELECT count(*) FROM base)::BIGINT doc_count, (SELECT round(avg(len(t)), 6) FROM base) avg_len, count(*)::BIGINT term_count,
(SELECT count(*) FROM embeddings)::BIGINT vector_count, true AS bm25_enabled, true AS semantic_enabled FROM df""")
def combined_stats(spark, sf_dir):
    """Statistics of both arms in one row."""
    words = _index(spark, sf_dir).stats().select("doc_count", F.round("avg_len", 6).alias("avg_len"), "term_count")
    vectors = table(spark, sf_dir, "embeddings").agg(F.count(F.lit(1)).alias("vector_count"))
    return words.crossJoin(F.broadcast(vectors)).withColumns({"bm25_enabled": F.col("doc_count") > 0, "semantic_enabled": F.col("vector_count") > 0})


def _every_fiftieth(rows: DataFrame) -> DataFrame:
    return rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


@query()
def ivf_stored(spark, sf_dir):
    """Vectors stored in a folder for each trained cell; every row whose id is divisible by 50 is asked in as many cells as recall@10 of 0.92 takes.

    Tested against brute force, as SQL can't train cells."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").filter(F.col("embedding").isNotNull())
    index = vector.CellIndex.build(rows, vector.train_cells(rows), folder(spark, "cells"), key="vec_id")
    asked = _every_fiftieth(rows)
    return index.search_batch(asked, nprobe=vector.least_probes(index.rows, asked, index.centroids, key="vec_id"))


@query()
def graph_knn(spark, sf_dir):
    """Every row whose id is divisible by 50 is asked in stored graphs of neighbours. Tested against brute force, as SQL can't build graphs."""
    rows = table(spark, sf_dir, "embeddings")
    index = graph.GraphIndex.build(rows, folder(spark, "graph"), key="vec_id")
    return index.search(_every_fiftieth(rows)).drop("touched")


@query("""WITH n AS (SELECT vec_id, embedding::DOUBLE[] v, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) m FROM embeddings),
i AS (SELECT vec_id, list_transform(v, lambda x: round(x * 127 / m)) v FROM n),
s AS (SELECT q.vec_id query_id, i.vec_id, list_dot_product(q.v, i.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(i.v, i.v)) s FROM i q JOIN i ON q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, round(s, 6) score FROM r WHERE rank <= 10""")
def int8_knn(spark, sf_dir):
    """Every row whose id is divisible by 50 is asked among stored int8 vectors, on integers."""
    path, rows = folder(spark, "int8"), table(spark, sf_dir, "embeddings")
    stored = vector.store_quantised(rows, path, key="vec_id")
    return vector.knn_int8(stored, _every_fiftieth(rows), key="vec_id")


@query(f"""WITH {_Q}, l AS (SELECT doc_id FROM documents WHERE lang = 'de'), n AS (SELECT vec_id, {_COS} s FROM embeddings, q WHERE vec_id IN (SELECT doc_id FROM l) ORDER BY s DESC, vec_id LIMIT 10)
SELECT vec_id, round(s, 6) score, source, n_chars FROM n JOIN documents ON doc_id = vec_id""")
def knn_language_payload(spark, sf_dir):
    """The language filter comes before the search, the payload joins the few hits after it."""
    docs = table(spark, sf_dir, "documents")
    wanted = docs.filter("lang = 'de'").select(F.col("doc_id").alias("vec_id"))
    best = vector.knn(table(spark, sf_dir, "embeddings").join(wanted, "vec_id", "left_semi"), _asked(spark, sf_dir), key="vec_id")
    return docs.select(F.col("doc_id").alias("vec_id"), "source", "n_chars").join(F.broadcast(best), "vec_id").select("vec_id", "score", "source", "n_chars")


# Files


def _tree(spark, sf_dir) -> str:
    """A tree with a JSON file for each region below a folder that is scanned, and one below a folder that isn't."""
    root = folder(spark, "tree")
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("src"), "n_nationkey", "n_name")
    for place in ("code", "node_modules"):
        rows.repartition("src").sortWithinPartitions("src", "n_nationkey").write.partitionBy("src").json(f"{root}/{place}")
    return root


_TREE = """SELECT 'code/src=' || n_regionkey AS folder, 'json' AS language, string_agg('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' || chr(10), '' ORDER BY n_nationkey) AS content FROM nation GROUP BY n_regionkey"""


@query(_TREE)
def scan_tree(spark, sf_dir):
    """Files of known kinds outside ignored folders, with their contents."""
    found = files.scan(spark, _tree(spark, sf_dir))
    return found.select(F.regexp_replace("file_path", "/[^/]*$", "").alias("folder"), "language", "content")


@query(_TREE)
def scan_tree_narrow(spark, sf_dir):
    found = files.scan(spark, _tree(spark, sf_dir), narrow=True)
    return found.select(F.regexp_replace("file_path", "/[^/]*$", "").alias("folder"), "language", "content")


@query(f"WITH {_CHUNKS} SELECT doc_id, start_line FROM ch WHERE doc_id % 3 = 1 ORDER BY doc_id, start_line")
def chunks_for_embedding(spark, sf_dir):
    """The chunks of one repository in the order of path and line."""
    found = chunks.chunk(table(spark, sf_dir, "documents"), "doc_id", "text", "lang").withColumn("repo_id", F.col("doc_id") % 3)
    return store.for_embedding(found, 1, "doc_id").select("doc_id", "start_line")


# Catalog

_CUSTOMERS = "SELECT c_custkey chunk_id, CASE WHEN c_custkey % 10 <> 0 THEN c_nationkey END repo_id, c_name code FROM customer"


def _customers(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return rows.select(F.col("c_custkey").alias("chunk_id"), F.when(F.col("c_custkey") % 10 != 0, F.col("c_nationkey")).alias("repo_id"), F.col("c_name").alias("code"), F.md5("c_name").alias("ast_hash"), now.alias("updated_at"))


@query(f"SELECT chunk_id FROM ({_CUSTOMERS}) WHERE repo_id IS DISTINCT FROM 3")
def delete_repo(spark, sf_dir):
    """A repository's chunks go, those without any stay."""
    return store.delete_repo(3, _customers(spark, sf_dir))[0].select("chunk_id")


@query(f"SELECT chunk_id FROM ({_CUSTOMERS}) WHERE repo_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 2)")
def without_orphans(spark, sf_dir):
    repos = table(spark, sf_dir, "nation").filter("n_regionkey < 2").select(F.col("n_nationkey").alias("repo_id"))
    return store.without_orphans(_customers(spark, sf_dir), repos).select("chunk_id")


@query("SELECT c_custkey chunk_id, CASE WHEN c_custkey = 5 THEN 'new' ELSE c_name END code, CASE WHEN c_custkey = 5 THEN md5('new') ELSE md5(c_name) END ast_hash, c_custkey = 5 AS touched FROM customer")
def update_chunk(spark, sf_dir):
    import hashlib

    out = store.update_chunk(_customers(spark, sf_dir), 5, "new", hashlib.md5(b"new").hexdigest())
    return out.select("chunk_id", "code", "ast_hash", (F.col("updated_at") > F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("touched"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT n_nationkey + 100, n_name, n_regionkey FROM nation WHERE n_regionkey = 1")
def table_versions(spark, sf_dir):
    """Written, appended to, and compacted with its old versions deleted."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    out = store.Table(spark, folder(spark, "table"))
    out.write(rows.filter("n_regionkey < 2"))
    out.append(rows.filter("n_regionkey > 2"))
    out.append(rows.filter("n_regionkey = 1").withColumn("n_nationkey", (F.col("n_nationkey") + 100).cast(rows.schema["n_nationkey"].dataType)))
    return out.vacuum(files=1)


@query("SELECT count(*) n, 0::BIGINT left_over FROM nation")
def table_cleared(spark, sf_dir):
    """clear() leaves an empty table with its columns."""
    out = store.Table(spark, folder(spark, "table"))
    n = out.write(table(spark, sf_dir, "nation")).count()
    return out.clear().agg(F.lit(n).cast("long").alias("n"), F.count(F.lit(1)).alias("left_over"))


@query("SELECT substr(sha256('m:' || text), 1, 32) AS key FROM documents GROUP BY text HAVING min(doc_id % 2) = 1")
def cache_misses(spark, sf_dir):
    """The keys of texts that a cache of the even documents doesn't hold."""
    docs = table(spark, sf_dir, "documents")
    cache = docs.filter("doc_id % 2 = 0").select(store.cache_key("m", F.col("text")).alias("key")).distinct()
    return embedding.missing(docs, "m", cache, "doc_id", "text").select("key")


@query("SELECT count(*)::BIGINT entries, sum(n_chars)::BIGINT size FROM documents")
def cache_size(spark, sf_dir):
    return store.cache_size(table(spark, sf_dir, "documents"), "n_chars")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) r, count(*) OVER () n, sum(n_chars) OVER () s FROM documents) WHERE s <= 100000 OR r > n // 5")
def cache_evict_by_size(spark, sf_dir):
    """Nothing goes while the sum of sizes is within the bound."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return store.evicted(rows, 5, "n_chars", "doc_id", size="n_chars", most=100_000).select("doc_id")


# Changes


@query(_CHUNKS.join(["WITH ", " SELECT doc_id, start_line, ast_hash FROM ch"]).replace("FROM documents", "FROM (SELECT doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || 'one more line' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0)"))
def reindexed_chunks(spark, sf_dir):
    """An index of the former state, brought up to date by the changed files only."""
    i = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    now = docs.filter(i % 7 != 0).withColumn("text", F.when(i % 3 == 0, F.concat("text", F.lit("\none more line"))).otherwise(F.col("text")))
    before = docs.filter(i % 5 != 0)
    state = lambda df: df.select(i.cast("string").alias("file_path"), F.md5("text").alias("file_hash"))
    events = replay.snapshot_diff(state(before), state(now)).select(F.col("file_path").cast("long").alias("doc_id"), "event_type")
    old = chunks.chunk(before, "doc_id", "text", "lang")
    changed = now.join(events.filter("event_type <> 'deleted'").select("doc_id"), "doc_id", "left_semi")
    new = chunks.chunk(changed, "doc_id", "text", "lang")
    return store.replace_files(old, new, events.select("doc_id"), "doc_id").select("doc_id", "start_line", "ast_hash")


@query("SELECT DISTINCT user_id::VARCHAR AS file_path FROM events")
def coalesced_paths(spark, sf_dir):
    return replay.coalesce_paths(table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("file_path")))


@query("""SELECT 1 AS round, 'created' AS event_type, 'src=' || n_regionkey AS folder, count(DISTINCT n_regionkey) AS n FROM nation WHERE n_regionkey <> 3 GROUP BY n_regionkey
UNION ALL SELECT 2, CASE WHEN n_regionkey = 3 THEN 'created' ELSE 'deleted' END, 'src=' || n_regionkey, count(DISTINCT n_regionkey) FROM nation WHERE n_regionkey IN (1, 3) GROUP BY n_regionkey""")
def tree_stream(spark, sf_dir):
    """A stream of a tree's changes, stopped and started again: a file for each region but one, then one region's goes and the last one's comes.

    Batches are kept with their numbers, so one that is repeated isn't added twice."""
    at = folder(spark, "watched")
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("src"), "n_nationkey", "n_name")
    events = store.Table(spark, f"{at}/events")

    def put(part: DataFrame, mode: str) -> None:
        part.repartition("src").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("src").json(f"{at}/tree")

    def take() -> None:
        stream = watch.changes(spark, f"{at}/tree", f"{at}/snapshots")
        replay.run_available(stream, lambda df, i: events.append(df, batch=("tree", i)), f"{at}/checkpoint")

    put(rows.filter("src <> 3"), "append")
    take()
    put(rows.filter("src = 3"), "append")
    store.Versions(spark, f"{at}/tree").remove("src=1")
    take()
    found = events.read().filter(F.endswith("file_path", F.lit(".json")))
    return found.groupBy(F.col("version").cast("int").alias("round"), "event_type", F.split("file_path", "/")[0].alias("folder")).agg(F.count(F.lit(1)).alias("n"))


# The two replays of the catalog, as folds over each key's events.
_EVENTS = "SELECT event_id, event_type, user_id, epoch_us(ts::TIMESTAMP) at_us FROM events"
ORACLE_SQL["debounce_replay"] = f"""WITH e AS ({_EVENTS}), l AS (SELECT user_id, event_type, list([at_us] ORDER BY at_us) ts FROM e GROUP BY ALL),
p AS (SELECT user_id, event_type, unnest(list_reduce(ts, lambda acc, x: CASE WHEN x[1] - acc[-1] >= 21600000000 THEN list_concat(acc, x) ELSE acc END)) at_us FROM l)
SELECT min(event_id) event_id, event_type, user_id, at_us FROM e JOIN p USING (user_id, event_type, at_us) GROUP BY ALL"""
ORACLE_SQL["rate_limit_replay"] = f"""WITH e AS ({_EVENTS}), l AS (SELECT user_id, list([{{'t': at_us, 'i': event_id}}] ORDER BY at_us, event_id) es FROM e GROUP BY user_id),
p AS (SELECT unnest(list_transform(list_reduce(es, lambda acc, x: CASE WHEN len(list_filter(acc, lambda a: a.t > x[1].t - 86400000000)) < 3 THEN list_concat(acc, x) ELSE acc END), lambda a: a.i)) event_id FROM l)
SELECT e.*, e.event_id IN (SELECT event_id FROM p) AS accepted FROM e"""


@query("SELECT doc_id, CASE WHEN strlen(text) > 20000 THEN 'oversize' WHEN text IS NULL OR trim(text, ' ') = '' THEN 'blank' END skip FROM documents")
def files_to_embed(spark, sf_dir):
    """Files that embedding skips, and why."""
    return embedding.classify_files(table(spark, sf_dir, "documents"), "text", 20_000).select("doc_id", "skip")


