"""The engine's incremental index, its lifecycle, and what runs beside it on the driver."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss import config, validate
from gneiss.__main__ import run
from gneiss.config import Settings
from gneiss.engine import Engine
from gneiss.operators import catalog, embedding, hybrid, lexical, segments, vector
from gneiss.sources import files
from gneiss.streaming.jobs import Jobs, RateLimiter, Stream, Watch


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    (root / "a.py").write_text("def hello_world():\n    return greet()\n")
    (root / "b.js").write_text("function other() { return greet(1); }\n")
    (root / "same.py").write_text("def untouched():\n    return 1\n")
    return root


def test_a_refresh_touches_changed_files_only(spark, tree, tmp_path):
    engine = Engine(spark, str(tmp_path / "index"), embedder=embedding.HashingEmbedder(16))
    done = engine.index(str(tree))
    # Chunks without a repository outlive the indexing of one.
    loose = engine.chunks().limit(1).withColumns({"chunk_id": F.lit(-5).cast("long"), "repo_id": F.lit(None).cast("long"), "file_path": F.lit("/loose.py")})
    engine.table("chunks").append(loose)
    engine.index(str(tree))
    assert engine.chunks().filter("chunk_id = -5").count() == 1
    before = {r["file_path"]: r["created_at"] for r in engine.chunks().collect()}
    assert engine.refresh(str(tree)).count() == 0
    versions = engine.table("chunks")._versions()
    (tree / "a.py").write_text("def changed():\n    return farewell()\n")
    (tree / "b.js").unlink()
    (tree / "new.go").write_text("func fresh() int { return 1 }\n")
    events = {(r["event_type"], r["file_path"].rsplit("/", 1)[-1]) for r in engine.refresh(str(tree)).collect()}
    assert events == {("modified", "a.py"), ("deleted", "b.js"), ("created", "new.go")} and engine.table("chunks")._versions() != versions
    after = {r["file_path"]: r["created_at"] for r in engine.chunks().collect()}
    assert after[str(tree / "same.py")] == before[str(tree / "same.py")] and after[str(tree / "a.py")] > before[str(tree / "a.py")]
    assert str(tree / "b.js") not in after and engine.embeddings().count() == engine.chunks().count() == 4
    assert [r["file_path"] for r in engine.search("farewell", semantic=False).collect()] == [str(tree / "a.py")]
    assert engine.refresh(str(tree)).count() == 0
    assert engine.embedded().filter("embedding_id is null").count() == 0 and done["files"] == 3


def test_blank_queries_failing_arms_and_clearing(spark, tree, tmp_path):
    engine = Engine(spark, str(tmp_path / "index"))
    engine.index(str(tree))
    assert engine.search("  ").count() == 0 and engine.search("").count() == 0

    class Broken(embedding.HashingEmbedder):
        def embed(self, texts):
            raise FileNotFoundError("no model")

    whole = engine.search("greet").count()
    engine.embedder = Broken(64)
    assert 0 < engine.search("greet").count() <= whole
    engine.embedder = embedding.HashingEmbedder(64)
    assert engine.set_weights(3, 1) == (0.75, 0.25) and engine.set_weights(0, 0) == (0.75, 0.25)
    shown = engine.rows(engine.search("greet"), 5).first()
    assert shown["preview"].endswith("...") and shown["lines"] and "code" not in shown.asDict()
    stats = engine.stats()
    assert stats["bm25"]["doc_count"] == stats["semantic"]["count"] == 3 and stats["cache"]["entries"] == 3 and stats["weights"]["bm25_weight"] == 0.75
    assert engine.evict(10**9) == 3 and engine.search_multi("greet", 1, "python").count() == 1
    index = engine.build_cells(nlist=2)
    asked = spark.createDataFrame([(engine.embedder.embed(["greet"])[0].tolist(),)], "q array<float>")
    assert index.search(asked, 3, nprobe=2).count() == 3
    engine.vacuum()
    engine.clear()
    assert engine.chunks().count() == engine.repos().count() == 0 and engine.search("greet").count() == 0 and not engine.stats()["bm25"]["enabled"]


def test_command_line(spark, tree, tmp_path):
    engine = Engine(spark, str(tmp_path / "index"))
    code, out = run(["idx", str(tree)], engine)
    assert code == 0 and out["files"] == 3 and engine.jobs.all()[0]["status"] == "completed"
    assert run(["find", "greet", "--limit", "1"], engine)[1][0]["lines"] == "1-3"
    assert run(["stats"], engine)[1]["total_chunks"] == 3 and run(["ping"], engine)[1] == {"status": "ok", "chunks": 3}
    assert run(["cleanup"], engine)[1] == {"deleted": 0} and run(["vacuum"], engine)[0] == 0
    assert run(["remove", str(out["repo_id"])], engine)[1] == {"deleted": 3}
    assert run(["index", str(tmp_path / "none")], engine)[1]["error"] == "no such path"
    assert run(["init", str(tmp_path / "s.json")]) == (0, str(tmp_path / "s.json"))
    assert run(["--settings", str(tmp_path / "s.json"), "config"])[1]["limit"] == {"value": 10, "from": "file"}


def test_requests_and_settings_are_checked(spark, tmp_path):
    assert validate.request({"query": "x"}) == {"query": "x", "limit": 10, "per_repo": 5}
    for bad in ({"query": ""}, {"query": "x" * 1001}, {"query": "x", "limit": 101}, {"query": "x", "per_repo": 0}, {}):
        with pytest.raises(ValueError):
            validate.request(bad)
    assert validate.strict_query("  a b ") == "a b" and validate.language_name(" c++ ") == "c++"
    for call in (lambda: validate.strict_query("a\x01b"), lambda: validate.strict_query("x" * 501), lambda: validate.strict_query(" "), lambda: validate.language_name("c#"), lambda: validate.language_name("go", ["rust"]), lambda: validate.body_size(11 << 20)):
        with pytest.raises(ValueError):
            call()
    validate.body_size(None)
    assert validate.startup(Settings()) == {} and set(validate.startup(Settings(limit=0, bm25_weight=2, index_path="../x"))) == {"limit", "bm25_weight", "index_path"}
    with pytest.raises(ValueError):
        Engine(spark, str(tmp_path), Settings(limit=0))


def test_jobs():
    jobs = Jobs(most=2)
    good, bad = jobs.run("a", lambda: {"n": 1}), jobs.run("b", lambda: 1 / 0)
    assert (good.status, good.result, bad.status, bad.error) == ("completed", {"n": 1}, "failed", "division by zero")
    later = jobs.run("c", lambda: {"n": 2}, background=True)
    for _ in range(200):
        if later.status == "completed":
            break
        time.sleep(0.01)
    assert jobs.get(later.job_id)["result"] == {"n": 2} and jobs.get(good.job_id) is None and len(jobs.all()) == 2


def test_watch_and_stream(spark, tmp_path):
    steps = iter([2, ValueError("bad poll"), 3])

    def step():
        found = next(steps, 0)
        if isinstance(found, Exception):
            raise found
        return found

    watch = Watch(step, 0.01).start()
    for _ in range(300):
        if watch.polls >= 4:
            break
        time.sleep(0.01)
    assert watch.status()["running"] and watch.events == 5
    watch.stop()
    assert not watch.status()["running"]
    spark.range(5).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = Stream(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), lambda df, _: seen.append(df.count()), str(tmp_path / "c"))
    assert stream.status() == {"running": False, "batch": None, "rows": 0}
    stream.start()
    assert stream.status()["running"]
    stream.stop()
    assert not stream.status()["running"] and sum(seen) == 5


def test_rate_limiter():
    limiter = RateLimiter(per_window=2, window=60, most_clients=3, spare=1)
    assert [limiter.allow("a", t) for t in (0, 1, 2, 60, 60.5, 62)] == [True, True, False, True, False, True]
    for i, c in enumerate("bcd"):
        assert limiter.allow(c, 63 + i)
    assert limiter.stats()["active_clients"] <= 3 and "a" not in limiter._taken
    assert limiter.allow("z", 500) and limiter.stats()["active_clients"] == 1


def test_ranks_are_of_scores_before_rounding(spark):
    rows = spark.createDataFrame([(1, 0.50001), (2, 0.50004), (3, 0.50002)], "chunk_id long, score double")
    assert [(r["chunk_id"], r["score"]) for r in lexical.top(rows, 2).collect()] == [(2, 0.5), (3, 0.5)]
    assert [r["chunk_id"] for r in hybrid.top(rows, 3).collect()] == [2, 3, 1]
    assert [r["chunk_id"] for r in hybrid.top_per_group(rows.withColumn("g", F.lit(1)), "g", 2).orderBy("rank").collect()] == [2, 3]
    near = spark.createDataFrame([(i, [1.0, 1e-4 * x]) for i, x in ((1, 3), (2, 1), (3, 2), (4, 1))], "chunk_id long, embedding array<double>")
    asked = spark.createDataFrame([([1.0, 0.0],)], "q array<double>")
    assert [(r["chunk_id"], r["score"]) for r in vector.knn(near, asked, 3).collect()] == [(2, 1.0), (4, 1.0), (3, 1.0)]
    found = vector.knn_batch(near, [(9, [1.0, 0.0])], 3).orderBy("rank").collect()
    assert [r["chunk_id"] for r in found] == [2, 4, 3]


def test_terms_are_counted_in_their_rows(spark):
    rows = spark.createDataFrame([(1, ["b", "a", "b", "b"]), (2, []), (3, ["a"])], "chunk_id long, tokens array<string>")
    found = lexical.term_frequency(rows)
    assert {(r["chunk_id"], r["term"], r["tf"]) for r in found.collect()} == {(1, "a", 1), (1, "b", 3), (3, "a", 1)}
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n, ties", [(23, 3), (100, 100), (57, 1), (4, 1)])
def test_eviction_cuts_exactly(spark, n, ties):
    rows = [(f"k{i:03}", None if i == 7 and ties == 3 else i // ties, i) for i in range(n)]
    frame = spark.createDataFrame(rows, "key string, created_at int, size int")
    left = {r["key"] for r in catalog.evicted(frame).collect()}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert left == {r[0] for r in order[n // 5 :]}
    assert catalog.evicted(frame, size="size", most=10**6).count() == n
    stamped = frame.withColumn("created_at", F.timestamp_seconds(F.coalesce("created_at", F.lit(0)) + 1_700_000_000))
    assert catalog.evicted(stamped).count() == n - n // 5


def test_embedding_batches_and_limits(spark):
    assert [len(b) for b in embedding.batches_of(["ab"] * 7, 3, 100)] == [3, 3, 1]
    assert [len(b) for b in embedding.batches_of(["x" * 60, "y" * 60, "z"], 3, 100)] == [1, 2]
    assert embedding.cut_words("a b  c d", 3) == "a b  c" and embedding.cut_words("a b", 3) == "a b"
    x, y = embedding.HashingEmbedder(8).embed(["some words here"]), embedding.QuantisedEmbedder(embedding.HashingEmbedder(8)).embed(["some words here", ""])
    assert np.abs(x[0] - y[0]).max() <= np.abs(x).max() / 254 + 1e-6 and not y[1].any()
    chunks = spark.createDataFrame([(1, "one two three"), (2, "one two four")], "chunk_id long, code string")
    vectors, _ = embedding.embed(chunks, embedding.HashingEmbedder(8), most_words=2)
    assert len({tuple(r["embedding"]) for r in vectors.collect()}) == 1


def test_a_deleted_repository_is_indexed_again_by_a_refresh(spark, tree, tmp_path):
    engine = Engine(spark, str(tmp_path / "index"))
    done = engine.index(str(tree))
    assert engine.delete(done["repo_id"]) == 3 and engine.search("greet").count() == 0
    assert engine.refresh(str(tree)).count() == 3 and engine.chunks().count() == engine.embeddings().count() == 3
    assert engine.search("greet", semantic=False).count() == 2


def test_cleanup_takes_vectors_and_postings(spark, tree, tmp_path):
    engine = Engine(spark, str(tmp_path / "index"))
    engine.index(str(tree))
    engine.table("repos").write(engine.repos().limit(0))
    assert engine.cleanup() == 3
    assert engine.chunks().count() == engine.embeddings().count() == engine.search("greet").count() == 0
    assert engine.cleanup() == 0


def test_a_refresh_writes_one_segment(spark, tree, tmp_path):
    engine = Engine(spark, str(tmp_path / "index"))
    engine.index(str(tree))
    index = segments.SegmentIndex(spark, f"{engine.folder}/bm25")
    before = index._segments()
    (tree / "a.py").write_text("def changed():\n    return farewell()\n")
    engine.refresh(str(tree))
    after = index._segments()
    assert after[:-1] == before and (after[-1]["rows"], after[-1]["dead"], after[-1]["docs"]) == (1, 1, 0)
    whole = segments.SegmentIndex.build(engine.chunks(), str(tmp_path / "whole"))
    for query in ("greet", "farewell untouched return", "hello_world"):
        assert index.search(query).collect() == whole.search(query).collect()


@pytest.mark.parametrize("name", ["it's", "a[1]", "b{c,d}", "what*"])
def test_folders_of_any_name(spark, tmp_path, name):
    root = tmp_path / name
    root.mkdir()
    (root / "a.py").write_text("def inside():\n    return 1\n")
    (tmp_path / "a1").mkdir()
    (tmp_path / "a1" / "b.py").write_text("def outside():\n    return 1\n")
    assert [(r["file_path"], r["language"]) for r in files.scan(spark, str(root)).collect()] == [("a.py", "python")]


def test_settings_have_their_types(spark, tmp_path):
    found = config.load(environ={"GNEISS_CHUNK_LIMIT": "2", "GNEISS_MIN_SCORE": "0.5"})
    assert (found.chunk_limit, found.min_score) == (2, 0.5) and config.load(environ={"GNEISS_CHUNK_LIMIT": ""}).chunk_limit is None
    assert "chunk_limit" in validate.startup(config.load(environ={"GNEISS_CHUNK_LIMIT": "many"}))
    root = tmp_path / "r"
    root.mkdir()
    for i in range(4):
        (root / f"f{i}.py").write_text(f"def number_{i}():\n    return common()\n")
    engine = Engine(spark, str(tmp_path / "i"), found)
    engine.index(str(root))
    assert engine.stats()["bm25"]["doc_count"] == 2


def test_failing_arms_are_named(spark, tree, tmp_path):
    class Broken(embedding.HashingEmbedder):
        def embed(self, texts):
            raise FileNotFoundError("no model")

    class Wrong(embedding.HashingEmbedder):
        def embed(self, texts):
            raise KeyError("a fault of the program")

    engine = Engine(spark, str(tmp_path / "index"))
    engine.index(str(tree))
    engine.search("greet")
    assert engine.failures == {}
    engine.embedder = Broken(64)
    engine.search("greet")
    assert engine.failures == {"semantic": "no model"}
    engine.embedder = Wrong(64)
    with pytest.raises(KeyError):
        engine.search("greet")


def test_followed_tree(spark, tree, tmp_path):
    engine = Engine(spark, str(tmp_path / "index"))
    engine.index(str(tree))
    (tree / "a.py").write_text("def changed():\n    return farewell()\n")
    engine.follow(str(tree), once=True).awaitTermination()
    assert [r["file_path"] for r in engine.search("farewell", semantic=False).collect()] == [str(tree / "a.py")]


def test_orders_that_eviction_takes(spark):
    rows = spark.createDataFrame([(f"k{i:03}", str(i), 7) for i in range(50)], "key string, created_at string, size int")
    with pytest.raises(TypeError):
        catalog.evicted(rows)
    dated = rows.withColumn("created_at", F.date_add(F.lit("2024-01-01").cast("date"), F.col("created_at").cast("int")))
    assert {r["key"] for r in catalog.evicted(dated).collect()} == {f"k{i:03}" for i in range(10, 50)}
    same = rows.withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    assert {r["key"] for r in catalog.evicted(same.repartition(8)).collect()} == {f"k{i:03}" for i in range(10, 50)}
