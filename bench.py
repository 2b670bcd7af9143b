"""Runs the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from gneiss.operators import graph, segments, vector
from gneiss.plans import code, sqlapi, stored  # noqa: F401  (they add their queries)
from gneiss.plans.catalog import QUERIES, TERMS

HEADLINE = ["bm25_topk", "bm25_index_stats", "term_frequency", "document_frequency", "keyword_search", "knn_cosine", "knn_batch", "knn_batch_all", "hybrid_topk", "chunk_windows", "duplicate_chunks", "multi_source_topn", "snapshot_diff", "complexity", "bm25_in_sql", "int8_knn", "names_by_language", "match_places", "cache_evict"]


def timed(took: dict, name: str, work, runs: int = 2) -> None:
    """The least of several runs; the first one compiles."""
    seconds = []
    for _ in range(runs):
        began = time.perf_counter()
        work()
        seconds.append(time.perf_counter() - began)
    took[name] = round(min(seconds), 3)


def consumed(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name in HEADLINE:
        timed(took, name, lambda name=name: consumed(QUERIES[name](spark, sf)))
    # Stored indexes: building and searching apart.
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    asked = rows.filter("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "embedding AS q")
    text_index = segments.SegmentIndex(spark, stored.folder(spark, "bench-bm25"))
    timed(took, "bm25_index_build", lambda: segments.SegmentIndex.build(stored._texts(spark, sf), text_index.path))
    timed(took, "bm25_index_search", lambda: consumed(text_index.search(" ".join(TERMS), None, 20)), 3)
    changed = stored._texts(spark, sf).limit(1)
    timed(took, "bm25_index_update", lambda: text_index.update(changed))
    graphs, cells = stored.folder(spark, "bench-graph"), stored.folder(spark, "bench-cells")
    timed(took, "graph_build", lambda: graph.GraphIndex.build(rows, graphs, key="vec_id"))
    timed(took, "graph_search", lambda: consumed(graph.GraphIndex(spark, graphs, key="vec_id").search(asked)))
    timed(took, "cells_build", lambda: vector.CellIndex.build(rows, vector.train_cells(rows), cells, key="vec_id"), 1)
    index = vector.CellIndex.load(spark, cells, key="vec_id")
    timed(took, "cells_search", lambda: consumed(index.search_batch(asked, nprobe=50)))
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
