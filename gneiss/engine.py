"""The engine: indexes source trees and answers lexical, vector, hybrid and per-repository searches."""

from __future__ import annotations

import logging

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gneiss import schema, validate
from gneiss.config import Settings
from gneiss.functions import text as columns
from gneiss.operators import catalog, embedding, hybrid, segments, vector
from gneiss.sources import files, watch
from gneiss.streaming import replay
from gneiss.streaming.jobs import Jobs, RateLimiter, Watch

log = logging.getLogger(__name__)
TABLES = ("repos", "chunks", "new_chunks", "embeddings", "emb_cache", "file_state", "file_events", "scan", "removed")
HITS = "chunk_id long, score double, terms array<string>"


class Engine:
    """Tables live below one folder, each behind a version pointer: repos, chunks, embeddings, file_state, emb_cache."""

    def __init__(self, spark: SparkSession, folder: str, settings: Settings | None = None, embedder: embedding.Embedder | None = None):
        self.spark, self.folder, self.settings = spark, folder.rstrip("/"), settings or Settings()
        if wrong := validate.startup(self.settings):
            raise ValueError(f"settings: {wrong}")
        self.embedder = embedder or embedding.HashingEmbedder(self.settings.embedding_size)
        self.weights = hybrid.weights(self.settings.bm25_weight, self.settings.semantic_weight)
        self.failures: dict[str, str] = {}
        self.jobs, self.limiter = Jobs(), RateLimiter(self.settings.requests_per_minute)

    def table(self, name: str) -> catalog.Table:
        return catalog.Table(self.spark, f"{self.folder}/{name}")

    def _read(self, name: str, columns) -> DataFrame:
        try:
            return self.table(name).read()
        except FileNotFoundError:
            return self.spark.createDataFrame([], columns)

    def repos(self) -> DataFrame:
        return self._read("repos", schema.REPOS)

    def chunks(self) -> DataFrame:
        return self._read("chunks", schema.CHUNKS)

    def embeddings(self) -> DataFrame:
        return self._read("embeddings", "chunk_id long, embedding array<float>")

    def index(self, root: str, name: str | None = None) -> dict:
        """Scans root, replaces what was indexed of it, embeds new texts and returns counts."""
        root = validate.directory(root)
        seen = self.spark.createDataFrame([(root, name or root.rsplit("/", 1)[-1])], "path string, name string").withColumn("last_indexed", F.current_timestamp())
        repos = self.table("repos").write(catalog.upsert_repos(self.repos(), seen))
        repo = repos.filter(F.col("path") == root).first()["repo_id"]
        found = self.table("scan").write(self._scan(root))
        before = self.chunks()
        old = before.filter(F.col("repo_id") == repo).select("chunk_id")
        others = self._read("file_state", schema.FILE_STATE).filter(~self._below(root))
        chunks = self.table("chunks").write(catalog.delete_repo(repo, before)[0].unionByName(self._chunked(found, repo)))
        self.table("file_state").write(others.unionByName(found.select("file_path", "file_hash", F.current_timestamp().alias("seen_at"))))
        own = chunks.filter(F.col("repo_id") == repo)
        self._embed(own, old)
        self._put(own, old)
        self._drop_old()
        return {"repo_id": repo, "files": found.count(), "chunks": own.count()}

    def _scan(self, root: str) -> DataFrame:
        return files.scan(self.spark, root).withColumn("file_path", F.concat(F.lit(root + "/"), "file_path"))

    @staticmethod
    def _below(root: str):
        return F.startswith("file_path", F.lit(root + "/"))

    @staticmethod
    def _chunked(found: DataFrame, repo: int) -> DataFrame:
        return files.chunks(found, repo).withColumn("chunk_id", F.xxhash64("file_path", "start_line"))

    def _embed(self, chunks: DataFrame, removed: DataFrame) -> None:
        """Vectors of chunks take the place of those of removed (chunk_id), and chunks without a vector get one. Texts that the cache lacks are embedded once: new vectors are written before anything is made from them."""
        gone = removed.select("chunk_id").unionByName(chunks.select("chunk_id")).distinct()
        kept = self.embeddings().join(gone, "chunk_id", "left_anti")
        todo = catalog.pending(self.chunks(), kept)
        cache = self._read("emb_cache", schema.EMB_CACHE)
        _, new = embedding.embed(todo, self.embedder, cache)
        cache = self.table("emb_cache").append(new.withColumn("created_at", F.current_timestamp()))
        self.table("embeddings").write(kept.unionByName(embedding.vectors(todo, self.embedder, cache)))

    def _put(self, chunks: DataFrame | None, removed: DataFrame) -> None:
        """Brings the postings up to date: one segment with chunks, in which removed (chunk_id) are gone.

        With a limit of chunks, which are the first by id, all are indexed anew."""
        index = segments.SegmentIndex(self.spark, f"{self.folder}/bm25")
        if self.settings.chunk_limit is not None or not index.versions.numbers():
            self.build()
        else:
            index.update(chunks, removed)

    def evict(self, most_bytes: int) -> int:
        """Drops the oldest fifth of the vector cache where its vectors take more than most_bytes; returns the number of entries left."""
        cache = self._read("emb_cache", schema.EMB_CACHE).withColumn("_size", F.size("embedding") * 4)
        left = catalog.evicted(cache, size="_size", most=most_bytes).drop("_size")
        return self.table("emb_cache").write(left).count()

    def embedded(self) -> DataFrame:
        """The chunks, with embedding_id where a vector is stored."""
        return catalog.mark_embedded(self.chunks(), self.embeddings())

    def _drop_old(self) -> None:
        for name in TABLES:
            self.table(name).forget()

    def build(self) -> None:
        """Indexes all chunks anew."""
        segments.SegmentIndex.build(self.chunks(), f"{self.folder}/bm25", self.settings.chunk_limit)

    def build_cells(self, nlist: int = 100, sample: int = 50_000) -> vector.CellIndex:
        """Trains cells on a bounded sample and stores all vectors by cell."""
        vectors = self.embeddings()
        return vector.CellIndex.build(vectors, vector.train_cells(vectors, nlist, sample), f"{self.folder}/cells")

    def refresh(self, root: str) -> DataFrame:
        """The events between the last state of root and now. Only changed files are cut and embedded again, and where nothing changed nothing is written."""
        root = validate.directory(root)
        now = replay.watched(self._scan(root))
        state = self._read("file_state", schema.FILE_STATE)
        events = replay.snapshot_diff(state.filter(self._below(root)), now.select("file_path", "file_hash"))
        events = self.table("file_events").write(events.withColumn("ts", F.current_timestamp()).select("event_type", "file_path", "ts", "file_hash"))
        if not events.isEmpty():
            self._apply(root, now, events, state)
        return events.select("event_type", "file_path", "file_hash")

    def _apply(self, root: str, now: DataFrame, events: DataFrame, state: DataFrame) -> None:
        known = self.repos().filter(F.col("path") == root).first()
        if known is None:
            self.index(root)
            return
        changed = now.join(events.filter("event_type <> 'deleted'").select("file_path"), "file_path", "left_semi")
        before = self.chunks()
        old = before.join(events.select("file_path"), "file_path", "left_semi").select("chunk_id")
        new = self.table("new_chunks").write(self._chunked(changed, known["repo_id"]))
        self.table("chunks").write(catalog.replace_files(before, new, events))
        seen = events.filter("event_type <> 'deleted'").select("file_path", "file_hash", F.col("ts").alias("seen_at"))
        self.table("file_state").write(catalog.replace_files(state, seen, events))
        self._embed(new, old)
        self._put(new, old)
        self._drop_old()

    def watch(self, root: str, interval: float = 0.5) -> Watch:
        """Polls root and applies what changes; start(), stop() and status() are the watch's."""
        return Watch(lambda: self.refresh(root).count(), interval)

    def follow(self, root: str, interval: float = 0.5, once: bool = False) -> StreamingQuery:
        """Refreshes root whenever a stream of its changes brings some, and goes on where it stopped; once: takes what has changed and ends."""
        root = validate.directory(root)
        name = F.xxhash64(F.lit(root))
        at = f"{self.folder}/follow/{self.spark.range(1).select(name).first()[0] & (1 << 64) - 1:x}"
        stream = watch.changes(self.spark, root, f"{at}/snapshots")
        writer = stream.writeStream.foreachBatch(lambda events, _: None if events.isEmpty() else self.refresh(root)).option("checkpointLocation", f"{at}/checkpoint")
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{interval} seconds")).start()

    def set_weights(self, lexical_weight: float, semantic_weight: float) -> tuple[float, float]:
        self.weights = hybrid.weights(lexical_weight, semantic_weight, self.weights)
        return self.weights

    def _arm(self, name: str, find, columns: str, failures: dict[str, str]) -> DataFrame:
        """The hits of one arm, a bounded number; none where its index or its model fails, which failures then tells. Other errors are raised."""
        try:
            return self.spark.createDataFrame(find().collect(), columns)
        except (PySparkException, FileNotFoundError) as e:
            log.warning("search arm %s failed: %s", name, e)
            failures[name] = str(e).split("\n", 1)[0]
            return self.spark.createDataFrame([], columns)

    def search(self, text: str, language: str | None = None, limit: int | None = None, bm25: bool = True, semantic: bool = True, weights: tuple[float, float] | None = None) -> DataFrame:
        """Hits with scores, their parts and payload; a blank query and both arms off give none. Weights hold for this call only.

        self.failures then tells which arm failed, and why; its hits are missing."""
        limit, blank = limit or self.settings.limit, not (text or "").strip()
        chunks = self.chunks() if language is None else self.chunks().filter(F.col("language") == language)
        words = near = None
        failures: dict[str, str] = {}
        if not blank:
            text = validate.query(text)

            def of_words() -> DataFrame:
                return segments.SegmentIndex(self.spark, f"{self.folder}/bm25").search(text, language, 2 * limit, None)

            def of_vectors() -> DataFrame:
                vectors = self.embeddings().join(chunks.select("chunk_id"), "chunk_id", "left_semi") if language else self.embeddings()
                asked = self.spark.createDataFrame([([float(x) for x in self.embedder.embed([text])[0]],)], "q array<float>")
                return vector.knn(vectors, asked, 2 * limit, digits=None)

            words = self._arm("bm25", of_words, HITS, failures) if bm25 else None
            near = self._arm("semantic", of_vectors, "chunk_id long, score double", failures) if semantic else None
        self.failures = failures
        none = self.spark.createDataFrame([], HITS)
        w = hybrid.weights(*weights) if weights else self.weights
        best = hybrid.top(hybrid.fuse(words or none, near or none.drop("terms"), w, least=self.settings.min_score), limit, digits=None)
        # Few rows are left, so the payload joins a broadcast of them.
        found = chunks.select("chunk_id", "repo_id", "file_path", "start_line", "end_line", "code", "language").join(F.broadcast(best), "chunk_id")
        return found.orderBy(F.desc("score"), "chunk_id")

    def rows(self, found: DataFrame, preview: int = 200) -> DataFrame:
        """Hits as shown: preview, line range, and the score with four digits."""
        order = found.select("*", columns.preview(F.col("code"), preview).alias("preview"), columns.line_range(F.col("start_line"), F.col("end_line")).alias("lines"))
        return order.withColumn("score", F.round("score", 4)).drop("code")

    def search_multi(self, text: str, per_repo: int = 5, language: str | None = None) -> DataFrame:
        """The best per_repo hits of each repository among the vectors nearest overall."""
        found = self.search(text, language, limit=10 * per_repo, bm25=False)
        return hybrid.top_per_group(found, "repo_id", per_repo)

    def delete(self, repo_id: int) -> int:
        """Removes a repository with its chunks, vectors, postings and known files; returns the number of chunks."""
        known = self.repos().filter(F.col("repo_id") == repo_id).first()
        gone = self._remove(self.chunks().filter(F.col("repo_id") == repo_id).select("chunk_id"))
        if known is not None:
            self.table("repos").write(catalog.delete_repo(repo_id, self.repos())[0])
            # Unknown files are indexed again by the next refresh.
            self.table("file_state").write(self._read("file_state", schema.FILE_STATE).filter(~self._below(known["path"])))
        return gone

    def cleanup(self) -> int:
        """Removes chunks whose repository is null or unknown, with their vectors and postings; returns their number."""
        return self._remove(catalog.orphans(self.chunks(), self.repos()).select("chunk_id"))

    def _remove(self, ids: DataFrame) -> int:
        ids = self.table("removed").write(ids)
        gone = ids.count()
        if gone:
            self.table("chunks").write(self.chunks().join(ids, "chunk_id", "left_anti"))
            self.table("embeddings").write(self.embeddings().join(ids, "chunk_id", "left_anti"))
            self._put(None, ids)
        self._drop_old()
        return gone

    def vacuum(self) -> None:
        for name in TABLES:
            try:
                self.table(name).vacuum()
            except FileNotFoundError:  # never written
                continue

    def clear(self) -> None:
        """Empties all tables and the index; their columns stay."""
        for name in TABLES:
            try:
                self.table(name).clear()
            except FileNotFoundError:
                continue
        self.build()

    def stats(self) -> dict:
        """Counts of chunks, repositories, languages and characters, and of both search arms."""
        chunks = self.chunks()
        found = catalog.stats(chunks).first().asDict() | {"by_language": {r["language"]: r["n"] for r in catalog.by_language(chunks).collect()}}
        try:
            words = segments.SegmentIndex(self.spark, f"{self.folder}/bm25").stats().first().asDict()
        except FileNotFoundError:
            words = {"doc_count": 0}
        vectors = self.embeddings().count()
        found["bm25"] = {"enabled": words["doc_count"] > 0, **words}
        found["semantic"] = {"enabled": vectors > 0, "count": vectors}
        found["weights"] = {"bm25_weight": self.weights[0], "semantic_weight": self.weights[1]}
        found["cache"] = catalog.cache_size(self._read("emb_cache", schema.EMB_CACHE).withColumn("size", F.size("embedding") * 4)).first().asDict()
        return found | {"min_score": self.settings.min_score}
