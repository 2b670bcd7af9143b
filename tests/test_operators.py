"""Operators on hand-made rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss import config, validate
from gneiss.engine import Engine
from gneiss.functions import text
from gneiss.operators import catalog, chunks, embedding, hybrid, lexical, segments, symbols, vector
from gneiss.plans import catalog as plans
from gneiss.sources import files
from gneiss.streaming import replay
from gneiss.streaming.jobs import STATE_STORE


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("n", [0, 1, 39, 40, 41, 50, 51, 90, 91, 95])
def test_windows(spark, n):
    code = "\n".join(f"line number {i}" for i in range(n)) if n else ""
    found = [(r["start_line"], r["end_line"]) for r in one(spark, chunks.windows(F.col("code")), code=code)]
    lines = max(n, 1)
    assert found == [(i + 1, min(i + 50, lines)) for i in range(0, lines, 40)]


def test_windows_without_the_trailing_line(spark):
    found = one(spark, chunks.windows(F.col("code"), drop_trailing=True), code="a\r\nb\r\n")
    assert [(r["start_line"], r["end_line"], r["code"]) for r in found] == [(1, 2, "a\nb")]


def test_comments(spark):
    code = F.col("c")
    assert one(spark, text.strip_comments(code, "python"), c="a = 1 # x\nb = 2") == "a = 1 \nb = 2"
    assert one(spark, text.strip_comments(code, "python", "to_end"), c="a = 1 # x\nb = 2") == "a = 1 "
    assert one(spark, text.strip_comments(code, "java"), c="a /* x\ny */ b // c\nd") == "a  b \nd"
    assert one(spark, text.strip_comments(code, "text"), c="a // b") == "a // b"


def test_tokens(spark):
    assert one(spark, text.tokens(F.col("c"), "python"), c="def Hello_World(x1): return 12 >= y # no") == ["hello_world", "x1", "12", ">="]
    assert one(spark, text.tokens(F.col("c"), "text"), c="Été naïve 12 ab_c") == ["ab_c"]
    assert one(spark, text.tokens(F.col("c")), c=None) == []


def test_languages_and_ignored_paths(spark):
    assert one(spark, text.language_of(F.col("p")), p="a/B.PY") == "python"
    assert one(spark, text.language_of(F.col("p")), p="a/b.zzz") is None
    assert one(spark, text.language_of(F.col("p"), narrow=True), p="a/b.zzz") == "text"
    for p, expected in (("src/a.py", False), ("x/node_modules/p/lib/a.js", True), (".git/a", True), ("a/x.pyc", True), ("README", True), ("buildings/a.py", False)):
        assert one(spark, text.ignored(F.col("p")), p=p) is expected, p
    assert one(spark, text.watch_ignored(F.col("p")), p="a/distance.py") is True
    assert one(spark, text.watch_ignored(F.col("p")), p="src/main.py") is False


def test_sanitising(spark):
    assert one(spark, text.sanitised_query(F.col("q")), q="  a\x00b\x7f \n") == "ab"
    assert one(spark, text.sanitised_language(F.col("q")), q="PYTHON") == "python"
    assert one(spark, text.sanitised_language(F.col("q")), q="invalid++") is None
    assert validate.query("x" * 1500) == "x" * 1000
    with pytest.raises(ValueError):
        validate.query("  ")
    with pytest.raises(ValueError):
        validate.path("a/../b")
    assert validate.settings({"port": 0, "limit": 5}, {"port": validate.port, "limit": validate.limit}).keys() == {"port"}


PYTHON = """import os, sys as system
from a.b import c

class Greeter(Base):
    def greet(self, name) -> str:
        return hello(name)

async def go(x):
    if x:
        pass
"""


def symbols_in(spark, code, language, dedupe=False):
    frame = spark.createDataFrame([(code, language)], "code string, language string")
    return frame.select(symbols.typed_symbols(F.col("code"), F.col("language"), dedupe).alias("s")).first()["s"]


def test_python_symbols(spark):
    every = symbols_in(spark, PYTHON, "python")
    found = {(s["name"], s["type"], s["start_line"]) for s in every}
    assert {("Greeter", "class", 4), ("greet", "function", 5), ("go", "function", 8), ("os", "import", 1), ("sys", "import", 1), ("c", "import", 2)} <= found
    assert [s["parent"] for s in every if s["name"] == "Greeter"] == ["Base"]
    tree = symbols.parsed(PYTHON)
    assert {(s["name"], s["type"]) for s in tree["symbols"]} == {("Greeter", "class"), ("greet", "method"), ("go", "function")}
    assert tree["calls"] == ["hello"] and "a.b.c" in tree["imports"]
    assert symbols.parsed("def (")["error"]
    assert len(symbols_in(spark, "import a, a\nimport a", "python", dedupe=True)) == 2


@pytest.mark.parametrize(
    ("language", "code", "expected"),
    [
        ("javascript", "import {A, B as C} from 'x';\nclass Counter extends Base {\n click(e) {}\n}\nconst f = (a) => a;\nif (x) {}", {"A", "C", "Counter", "click", "f"}),
        ("java", "import a.b.C;\npublic class Foo {\n public int bar(int x) { }\n}", {"a.b.C", "Foo", "bar"}),
        ("cpp", "#include <vector>\nstruct P {};\nint add(int a) {\n}", {"vector", "P", "add"}),
        ("go", 'import (\n"fmt"\n)\ntype T struct {}\nfunc (t T) Greet(n int) {}\nfunc hello() {}', {"fmt", "T", "Greet", "hello"}),
        ("rust", "use std::io as sio;\nfn plain(x: i32) {}\nfn gen<T>(x: T) {}\nstruct S;\nimpl S {}", {"sio", "plain", "gen", "S", "impl_S"}),
        (None, "func a() interface B", {"a", "B"}),
    ],
)
def test_symbols_of_other_languages(spark, language, code, expected):
    assert {s["name"] for s in symbols_in(spark, code, language)} == expected


def test_structure_calls_and_complexity(spark):
    rows = spark.createDataFrame([(PYTHON, "python"), (None, None)], "code string, language string")
    found = symbols.structure(rows).filter("code is not null").first()
    assert found["imports"] == ["c", "os", "sys"] and "hello" in found["function_calls"] and found["complexity"] == 2
    assert symbols.parse(rows).filter("code is not null").select("parsed.calls").first()["calls"] == ["hello"]
    assert {r["type"]: r["names"] for r in symbols.names_by_type(symbols.structure(rows)).collect()}["class"] == ["Greeter"]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(1, "def hello_world(): return greet", "python"), (2, "function hello() { return greet(greet) }", "javascript"), (3, "class Other {}", "java"), (4, "", "go"), (5, "value 123 here", "markdown")]
    return spark.createDataFrame(rows, "chunk_id long, code string, language string")


def test_index_search(spark, corpus, tmp_path):
    segments.SegmentIndex.build(corpus, str(tmp_path / "bm25"))
    index = segments.SegmentIndex(spark, str(tmp_path / "bm25"))
    assert [r["chunk_id"] for r in index.search("greet").collect()] == [2, 1]
    assert [r["chunk_id"] for r in index.search("GREET", language="python").collect()] == [1]
    assert [r["chunk_id"] for r in index.search("123").collect()] == [5]
    assert index.search("").count() == 0
    once, twice = (index.search(q).first()["score"] for q in ("greet", "greet greet"))
    assert abs(twice - 2 * once) < 2e-4
    assert index.stats().first()["doc_count"] == 5
    direct = lexical.top(lexical.search(lexical.doc_tokens(corpus, F.col("language")), ["greet"]), 10)
    assert [(r["chunk_id"], r["score"]) for r in direct.collect()] == [(r["chunk_id"], r["score"]) for r in index.search("greet").collect()]


def test_vectors(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0, 0.0]) for i in range(6)] + [(9, [0.0, 0.0, 0.0])], "chunk_id long, embedding array<float>")
    asked = spark.createDataFrame([([1.0, 1.0, 0.0],)], "q array<float>")
    assert [r["chunk_id"] for r in vector.knn(rows, asked, 3).collect()] == [1, 2, 3]
    assert [(r["chunk_id"], r["score"]) for r in vector.knn(rows, asked, 2, "l2").collect()] == [(1, 0.0), (0, 1.0)]
    with pytest.raises(ValueError):
        vector.knn(rows, asked, 2, "other")
    batch = vector.knn_batch(rows, [(7, [1.0, 1.0, 0.0])], 3).orderBy("rank").collect()
    assert [r["chunk_id"] for r in batch] == [1, 2, 3]
    back = rows.select("chunk_id", vector.dequantised(vector.quantised(vector.as_double("embedding"))).alias("v"), "embedding").collect()
    assert all(abs(a - b) < 0.05 for r in back for a, b in zip(r["v"], r["embedding"], strict=True))


def test_batch_of_queries_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector, "BLOCK", 32)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 8))
    x[100:300] = x[0]
    bad = [(1000, None), (1050, [float("nan")] * 8), (1100, [None] * 8), (1150, [1.0])]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + bad, "chunk_id long, embedding array<double>")
    asked = frame.filter("chunk_id % 5 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("q"))
    found = {}
    for r in vector.knn_batch(frame, asked, 10).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["chunk_id"], r["score"]))
    assert found.pop(1150) == [(1150, 1.0)] and sorted(found) == list(range(0, 600, 5))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 6)
    for q in found:
        assert found[q] == [(j, scores[q, j]) for j in np.lexsort((np.arange(600), -scores[q]))[:10].tolist()]


def test_every_fiftieth_row_is_asked(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = plans.QUERIES["knn_batch_all"](spark, sf_dir)
    assert {r[0] for r in found.select("query_id").distinct().collect()} == {r[0] for r in rows.filter("vec_id % 50 = 0").select("vec_id").collect()}


def test_cells_have_recall(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")
    centroids = vector.train_cells(rows, nlist=8)
    celled = rows.join(vector.assign_cells(rows, centroids), "chunk_id").cache()
    hits = 0
    for i in range(5):
        asked = rows.filter(F.col("chunk_id") == i * 20).select(F.col("embedding").alias("q"))
        exact = {r["chunk_id"] for r in vector.knn(rows, asked, 10).collect()}
        assert {r["chunk_id"] for r in vector.knn_cells(celled, asked, centroids, 10, nprobe=8).collect()} == exact
        hits += len(exact & {r["chunk_id"] for r in vector.knn_cells(celled, asked, centroids, 10, nprobe=5).collect()})
    assert hits >= 45


def test_index_search_has_recall_of_every_asked_row(spark, sf_dir):
    pairs = {name: {(r["query_id"], r["vec_id"]): r["score"] for r in plans.QUERIES[name](spark, sf_dir).collect()} for name in ("ivf_batch", "knn_batch_all")}
    exact, found = pairs["knn_batch_all"], pairs["ivf_batch"]
    assert {q for q, _ in found} == {q for q, _ in exact} and len(found) == len(exact)
    assert len(exact.keys() & found.keys()) >= 0.9 * len(exact)
    assert all(found[p] == exact[p] for p in exact.keys() & found.keys())


def test_fusion(spark):
    words = spark.createDataFrame([(1, 2.0, ["a"]), (2, 1.0, ["b"])], "chunk_id long, score double, terms array<string>")
    near = spark.createDataFrame([(2, 0.5), (3, 0.9), (4, -0.2), (5, 0.001)], "chunk_id long, score double")
    found = {r["chunk_id"]: r for r in hybrid.top(hybrid.fuse(words, near), 10).collect()}
    assert set(found) == {1, 2, 3}
    assert {i: r["result_type"] for i, r in found.items()} == {1: "bm25_only", 2: "hybrid", 3: "semantic_only"}
    assert found[2]["score"] == 0.75 and found[3]["matched_terms"] == []
    assert hybrid.weights(0, 0) == (0.5, 0.5) and hybrid.weights(1, 3) == (0.25, 0.75) and hybrid.weights(0, 0, (0.6, 0.4)) == (0.6, 0.4)
    shown = hybrid.explain(hybrid.fuse(words, near), (0.5, 0.5)).orderBy("rank").collect()
    assert [r["rank"] for r in shown] == [1, 2, 3] and shown[0]["bm25_percent"] == 100.0


def test_embedding_uses_the_cache(spark, corpus):
    maker = embedding.HashingEmbedder(16)
    vectors, new = embedding.embed(corpus, maker)
    assert vectors.count() == 5 and new.count() == 5
    _, again = embedding.embed(corpus, maker, new)
    assert again.count() == 0
    assert embedding.classify_files(spark.createDataFrame([("a",), (" ",), (None,)], "content string")).filter("skip is null").count() == 1


def test_table_versions(spark, tmp_path):
    t = catalog.Table(spark, str(tmp_path / "t"))
    t.write(spark.range(3).toDF("chunk_id"))
    t.write(t.read().filter("chunk_id > 0"))
    t.append(spark.range(10, 12).toDF("chunk_id"))
    assert t.vacuum(files=1).count() == 4 and t._versions() == [4]


def test_maintenance(spark):
    repos = spark.createDataFrame([(1, "/r"), (2, "/r/sub")], "repo_id long, path string")
    rows = spark.createDataFrame([("/r/a.py", None, 1), ("/r/sub/b.py", None, 2), ("/r2/c.py", None, 3), ("/x/d.py", 9, 4)], "file_path string, repo_id long, chunk_id long")
    assert {r["file_path"]: r["repo_id"] for r in catalog.assign_repo(rows, repos).collect()} == {"/r/a.py": 1, "/r/sub/b.py": 2, "/r2/c.py": None, "/x/d.py": 9}
    assert catalog.orphans(rows, repos).count() == 4 and catalog.without_orphans(rows, repos).count() == 0
    kept = catalog.evicted(spark.createDataFrame([(str(i), i) for i in range(11)], "key string, created_at int"))
    assert {r["created_at"] for r in kept.collect()} == set(range(2, 11))


def test_engine(spark, tmp_path):
    root = tmp_path / "repo"
    (root / "node_modules" / "p" / "lib").mkdir(parents=True)
    (root / "a.py").write_text("def hello_world():\n    return greet()\n\nclass Thing:\n    pass\n")
    (root / "b.js").write_text("function other() { return greet(1); }\n")
    (root / "bad.py").write_bytes(b"value = '\xff\xfe' # some bytes\n")
    (root / "node_modules" / "p" / "lib" / "x.js").write_text("function ignored() { return 1; }\n")
    engine = Engine(spark, str(tmp_path / "index"))
    done = engine.index(str(root))
    assert done["chunks"] == 3
    found = engine.search("greet", limit=5).collect()
    assert found and {r["file_path"].rsplit("/", 1)[-1] for r in found[:2]} == {"a.py", "b.js"} and found[0]["start_line"] == 1
    assert {r["language"] for r in engine.search("greet", language="python").collect()} == {"python"}
    assert engine.search("greet", bm25=False, semantic=False).count() == 0
    assert engine.search_multi("greet", 1).count() == 1
    (root / "a.py").write_text("def changed():\n    return farewell()\n")
    (root / "b.js").unlink()
    events = {(r["event_type"], r["file_path"].rsplit("/", 1)[-1]) for r in engine.refresh(str(root)).collect()}
    assert events == {("modified", "a.py"), ("deleted", "b.js")}
    assert engine.stats()["total_chunks"] == 2 and engine.cleanup() == 0
    assert engine.delete(done["repo_id"]) == 2 and engine.chunks().count() == 0 and engine.embeddings().count() == 0


def test_narrow_scan(spark, tmp_path):
    (tmp_path / "a.rs").write_text("fn first() {}\nstruct Two;\n")
    (tmp_path / "b.py").write_bytes(b"\xff\xfe\xff")
    (tmp_path / "c.txt").write_text("not scanned at all\n")
    rows = files.chunks(files.scan(spark, str(tmp_path), narrow=True), 1, narrow=True).collect()
    assert [(r["file_path"], [s["name"] for s in r["symbols"]]) for r in rows] == [("a.rs", ["first", "Two"])]


def test_snapshot_diff(spark):
    before = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "file_path string, file_hash string")
    after = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "file_path string, file_hash string")
    assert {(r["event_type"], r["file_path"]) for r in replay.snapshot_diff(before, after).collect()} == {("modified", "b"), ("deleted", "c"), ("created", "d")}


def test_streams_agree_with_batches(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us")).orderBy("at_us", "event_id")
    end = spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("user_id"), F.lit(1 << 52).alias("at_us"))
    events.unionByName(end).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    day = 24 * 3_600_000_000
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    for name, streamed, batch in (("limit", replay.stream_rate_limit(stream, "user_id", limit=3, window_us=day), replay.rate_limit(events, "user_id", limit=3, window_us=day)), ("debounce", replay.stream_debounce(stream, ["user_id"], gap_us=day), replay.debounce(events, ["user_id"], gap_us=day))):
        got = []
        replay.run_available(streamed, lambda df, _, got=got: got.extend(df.collect()), str(tmp_path / name), "append")
        assert sorted(tuple(r) for r in got if r["user_id"] >= 0) == sorted(map(tuple, batch.collect()))


def test_settings(tmp_path):
    path = tmp_path / "s.json"
    path.write_text('{"limit": 20, "min_score": 0.2}')
    found = config.load(str(path), environ={"GNEISS_LIMIT": "30"}, min_score=0.5)
    assert (found.limit, found.min_score, found.bm25_weight) == (30, 0.5, 0.5)
    assert found.sources == config.load(str(path), environ={"GNEISS_LIMIT": "30"}, min_score=0.5).sources and found.sources["limit"] == "environment"
    assert config.conflicts(str(path), environ={"GNEISS_LIMIT": "30"}) == {"limit": (20, 30)}
