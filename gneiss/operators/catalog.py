"""Catalog maintenance over immutable tables: every change is a new DataFrame, stored by copy and pointer swap."""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType


def upsert_repos(repos: DataFrame, seen: DataFrame) -> DataFrame:
    """repos with the rows of seen (path, name, last_indexed) put in by path; new paths get an id from a hash of the path."""
    both = repos.alias("r").join(seen.alias("s"), "path", "full_outer")
    return both.select(F.coalesce("r.repo_id", F.xxhash64("path")).alias("repo_id"), "path", F.coalesce("s.name", "r.name").alias("name"), F.coalesce("s.last_indexed", "r.last_indexed").alias("last_indexed"), F.coalesce("r.created_at", "s.last_indexed").alias("created_at"))


def delete_repo(repo_id: int, *tables: DataFrame) -> list[DataFrame]:
    """Each table without the rows of a repository; chunk tables without repo_id go by a semi join on the first one's chunks."""
    return [t.filter((F.col("repo_id") != repo_id) | F.col("repo_id").isNull()) for t in tables]


def orphans(chunks: DataFrame, repos: DataFrame, key: str = "repo_id") -> DataFrame:
    """Chunks whose repository is null or unknown."""
    return chunks.join(repos.select(key), key, "left_anti")


def without_orphans(chunks: DataFrame, repos: DataFrame, key: str = "repo_id") -> DataFrame:
    return chunks.join(repos.select(key), key, "left_semi")


def update_chunk(chunks: DataFrame, chunk_id: int, code: str, ast_hash: str) -> DataFrame:
    own = F.col("chunk_id") == chunk_id
    return chunks.withColumns({"code": F.when(own, code).otherwise(F.col("code")), "ast_hash": F.when(own, ast_hash).otherwise(F.col("ast_hash")), "updated_at": F.when(own, F.current_timestamp()).otherwise(F.col("updated_at"))})


def assign_repo(chunks: DataFrame, repos: DataFrame, path: str = "file_path") -> DataFrame:
    """Unassigned chunks get the repository whose path is a prefix of theirs, the longest one.

    Instead of testing all pairs, each path is exploded into its parent folders and joined on equality."""
    parts = F.split(path, "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    keyed = chunks.select(path, F.explode(folders).alias("_folder")).distinct()
    found = keyed.join(repos.select(F.col("path").alias("_folder"), F.col("repo_id").alias("_repo")), "_folder").groupBy(path).agg(F.max_by("_repo", F.length("_folder")).alias("_repo"))
    return chunks.join(found, path, "left").withColumn("repo_id", F.coalesce("repo_id", "_repo")).drop("_repo")


def pending(chunks: DataFrame, embeddings: DataFrame, key: str = "chunk_id", limit: int | None = None) -> DataFrame:
    """Chunks without an embedding, by key; limit is a batch size, none by default."""
    rows = chunks.join(embeddings.select(key), key, "left_anti")
    return rows.orderBy(key).limit(limit) if limit is not None else rows


def by_language(chunks: DataFrame, language: str = "language") -> DataFrame:
    return chunks.groupBy(language).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), language)


def stats(chunks: DataFrame, code: str = "code", repo: str = "repo_id", language: str = "language") -> DataFrame:
    """One row: chunks, repositories, languages and characters."""
    return chunks.agg(F.count(F.lit(1)).alias("total_chunks"), F.count_distinct(repo).alias("total_repos"), F.count_distinct(language).alias("languages"), F.coalesce(F.sum(F.length(code).cast("long")), F.lit(0)).alias("total_chars"))


def cache_key(model: str, code) -> F.Column:
    return F.substring(F.sha2(F.concat(F.lit(model + ":"), code), 256), 1, 32)


def cache_size(cache: DataFrame, size: str = "size") -> DataFrame:
    """One row: entries and their summed size."""
    return cache.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum(F.col(size).cast("long")), F.lit(0)).alias("size"))


def evicted(cache: DataFrame, share: int = 5, order: str = "created_at", key: str = "key", size: str | None = None, most: int = 0) -> DataFrame:
    """cache without the oldest 1/share of its rows, in the order of order (nulls first) and key; with size only where its sum is above most.

    order is a number, a date or a timestamp; other types raise. The value at the cut is found by counts over ever finer
    ranges, and of the rows that share it those that go by a rank of key, taken in a sort over ranges: no task takes the
    rows that go."""
    kind = cache.schema[order].dataType
    if not isinstance(kind, (NumericType, DateType, TimestampType, TimestampNTZType)):
        raise TypeError(f"no order to evict by: {order} is of type {kind.simpleString()}")
    stats = cache.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col(size).cast("long")), F.lit(0)).alias("size") if size else F.lit(0).alias("size")).first()
    n = stats["n"] // share
    if n == 0 or (size and stats["size"] <= most):
        return cache
    number = F.col(order) if isinstance(kind, NumericType) else F.unix_micros(F.col(order).cast("timestamp"))
    value = F.coalesce(number.cast("double"), F.lit(-1e300))
    low, high = cache.agg(F.min(value), F.max(value)).first()
    before = 0  # rows below low; up to high there are n or more
    while high > low:
        slot = F.least(F.floor((value - low) / F.lit((high - low) / 1024)), F.lit(1023))
        slots = cache.filter((value >= low) & (value <= high)).groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
        for r in sorted(slots.collect()):  # 1024 rows at most
            low, high = r["low"], r["high"]
            if before + r["n"] >= n:
                break
            before += r["n"]
    tied = cache.filter(value == low)
    cut = key_at(tied, key, n - before)
    return cache.filter(value > low).unionByName(tied.filter(F.col(key) > F.lit(cut)) if cut is not None else tied)


def key_at(rows: DataFrame, key: str, n: int):
    """The n-th smallest key (keys are distinct; None for n = 0), by counts over the tasks of a sort over ranges."""
    if n <= 0:
        return None
    placed = rows.select(key).repartitionByRange(key).withColumn("_part", F.spark_partition_id())
    parts = sorted((r["_part"], r["n"], r["low"], r["high"]) for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).collect())
    for _, count, low, high in parts:  # a row a task
        if n <= count:
            # One task's range of keys.
            return rows.filter((F.col(key) >= F.lit(low)) & (F.col(key) <= F.lit(high))).select(key).orderBy(key).limit(n).agg(F.max(key)).first()[0]
        n -= count
    return None


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("_n = 1").drop("_n")


def for_embedding(chunks: DataFrame, repo_id: int | None = None, path: str = "file_path") -> DataFrame:
    """The chunks of a repository, or with None or 0 of all, in the order of path and first line."""
    own = chunks.filter(F.col("repo_id") == repo_id) if repo_id else chunks
    return own.orderBy(path, "start_line")


def replace_files(chunks: DataFrame, new: DataFrame, changed: DataFrame, path: str = "file_path") -> DataFrame:
    """chunks without those of changed paths, and the new ones of these."""
    return chunks.join(changed.select(path).distinct(), path, "left_anti").unionByName(new, allowMissingColumns=True)


def mark_embedded(chunks: DataFrame, embeddings: DataFrame, key: str = "chunk_id") -> DataFrame:
    """chunks whose embedding_id names their vector's row, null where there is none."""
    has = embeddings.select(key, F.lit(True).alias("_has"))
    return chunks.join(has, key, "left").withColumn("embedding_id", F.when(F.col("_has"), F.col(key))).drop("_has")


class Versions:
    """Numbered states of something stored in a folder: a small JSON file each, the latest one holds.

    Data goes to new folders, which no other writer knows; a state then names the folders that it consists of. A state's
    file is created only where none has its number, so of two writers one finds that it was late."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _store(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p, p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def numbers(self) -> list[int]:
        p, fs = self._store("")
        if not fs.exists(p):
            return []
        return sorted(int(x[6:]) for x in (s.getPath().getName() for s in fs.listStatus(p)) if x.startswith("state-"))

    def state(self, number: int) -> dict:
        p, fs = self._store(f"state-{number}")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def now(self) -> tuple[int, dict]:
        """Number and content of the present state; 0 and an empty one where there is none."""
        numbers = self.numbers()
        return (numbers[-1], self.state(numbers[-1])) if numbers else (0, {"folders": []})

    def new_folder(self) -> str:
        return f"data-{uuid.uuid4().hex}"

    def commit(self, number: int, state: dict) -> bool:
        """Makes state the one after number; False where another writer was first."""
        p, fs = self._store(f"state-{number + 1}")
        try:
            stream = fs.create(p, False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception) or "already exists" in str(e.java_exception):
                return False
            raise
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        return True

    def forget(self, keep: int = 2) -> None:
        """Deletes all states but the latest ones and the folders that only those had; with two kept, plans over the one before still read."""
        numbers = self.numbers()
        stay = {f for n in numbers[-keep:] for f in self.state(n)["folders"]}
        for n in numbers[:-keep]:
            for folder in [*(f for f in self.state(n)["folders"] if f not in stay), f"state-{n}"]:
                self.remove(folder)

    def remove(self, name: str) -> None:
        p, fs = self._store(name)
        fs.delete(p, True)


class Table:
    """A Parquet table as versions: a writer fills a new folder, then a state that names it; a read plan keeps its folders.

    An append adds a folder to those of the version before and copies nothing. Writers beside each other: appends all
    count, in the order of their states; of two writes the later one holds."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.versions = spark, path.rstrip("/"), Versions(spark, path)

    def _versions(self) -> list[int]:
        return self.versions.numbers()

    def folders(self) -> list[str]:
        """The folders of the present version."""
        number, state = self.versions.now()
        if not number:
            raise FileNotFoundError(self.path)
        return [f"{self.path}/{f}" for f in state["folders"]]

    def at(self) -> str:
        """The one folder of a version that was written at once."""
        return self.folders()[-1]

    def read(self) -> DataFrame:
        return self.spark.read.parquet(*self.folders())

    @contextmanager
    def version(self, batch: tuple[str, int] | None = None, append: bool = False):
        """A new folder, which makes the version (append: is added to it) when the block ends without an error.

        batch: a stream's name and the number of its batch, which is kept with the data."""
        folder = self.versions.new_folder()
        yield f"{self.path}/{folder}"
        while True:
            number, state = self.versions.now()
            if batch and state.get("batches", {}).get(batch[0], -1) >= batch[1]:
                return  # the batch came in while this writer was at it
            batches = state.get("batches", {}) | ({batch[0]: batch[1]} if batch else {})
            if self.versions.commit(number, {"folders": [*state["folders"], folder] if append else [folder], "batches": batches}):
                return

    def has_batch(self, stream: str, batch_id: int) -> bool:
        """Whether the batch of that number, or a later one, of the stream is in the table."""
        return self.versions.now()[1].get("batches", {}).get(stream, -1) >= batch_id

    def write(self, df: DataFrame, partition_by: tuple[str, ...] = (), batch: tuple[str, int] | None = None) -> DataFrame:
        if not (batch and self.has_batch(*batch)):
            with self.version(batch) as to:
                df.write.partitionBy(*partition_by).parquet(to)
        return self.read()

    def clear(self) -> DataFrame:
        """An empty version with the same columns."""
        return self.write(self.read().limit(0))

    def append(self, df: DataFrame, batch: tuple[str, int] | None = None) -> DataFrame:
        """Adds rows. With batch (a stream's name and a batch's number) a batch that is there already is left out, so one that is replayed changes nothing."""
        if not (batch and self.has_batch(*batch)):
            with self.version(batch, append=True) as to:
                df.write.parquet(to)
        return self.read()

    def vacuum(self, files: int | None = None, keep: int = 1) -> DataFrame:
        """Rewrites the table into few files and deletes older versions."""
        now = self.write(self.read().coalesce(files) if files else self.read())
        self.forget(keep)
        return now

    def forget(self, keep: int = 2) -> None:
        self.versions.forget(keep)
