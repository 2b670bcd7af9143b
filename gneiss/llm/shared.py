"""What the operators share: the shared folder, written intermediate tables, key checks."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts mean it: a blank and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


#: Folders of sessions without spark.checkpoint.dir, by application.
_own_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and all runs in one process (tests, one machine), a temporary one for the session."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        path = _own_folders.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="gneiss-")
        _own_folders[spark.sparkContext.applicationId] = path
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark deletes the shuffle files of a query at its end.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, batch: int = 2000) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts lineage, survives lost executors, computes Python stages once.

    What the plan of df shuffled is deleted once the table is whole. batch: rows that go to a Python worker at a time;
    fewer where rows are large."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(batch), CLEAN_UP: "true"}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)
    out = spark.read.schema(df.schema).parquet(path)
    out.gneiss_path = path
    return out


def _give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library's
    if trim:
        trim(0)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, for mapInArrow. Workers stay for later stages: what a task took, its worker gives back to the system when it is through."""

    def task(batches):
        yield from run(batches)
        _give_back()

    return task


def _store(spark: SparkSession, path: str):
    """The path as Spark's file systems know it, and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, path: str) -> bool:
    p, store = _store(spark, path)
    return store.exists(p)


def drop_path(spark: SparkSession, path: str) -> None:
    p, store = _store(spark, path)
    store.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file; None where there is none."""
    p, store = _store(spark, path)
    if not store.exists(p):
        return None
    stream = store.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    p, store = _store(spark, path)
    stream = store.create(p, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def drop_written(*tables: DataFrame) -> None:
    """Deletes tables made by written() that no later plan reads."""
    for df in tables:
        drop_path(df.sparkSession, df.gneiss_path)


#: Keys that hold more than one of HOT_SHARE of all rows, and more than HOT_ROWS, are joined by broadcast: HOT_SHARE of them at most.
HOT_SHARE, HOT_ROWS = 100_000, 1000


def join_hot(rows: DataFrame, side: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows joined with side, which has a row for each key and in size how many of all rows have it; total: of all keys.

    The few keys that hold many rows are joined by broadcast, the rest by shuffle, so no task gets all rows of a key."""
    hot = F.col(size) > max(HOT_ROWS, total // HOT_SHARE)
    many = F.broadcast(side.filter(hot))
    rest = rows.join(many.select(key), key, "left_anti").join(side.filter(~hot), key)
    return rows.join(many, key).unionByName(rest)


def join_salted(rows: DataFrame, side: DataFrame, counts: DataFrame, key: str, size: str, total: int, spread: str, per_task: int = 1000) -> DataFrame:
    """rows joined with side, whose rows are large, one for each key; counts has each key's number of rows in size.

    A key with many rows is parted by a hash of spread, and its row of side goes to each part."""
    parts = F.ceil(F.col(size) / per_task)
    salted = join_hot(rows, counts, key, size, total).withColumn("_salt", F.pmod(F.xxhash64(spread), parts)).drop(size)
    copied = side.join(counts, key).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop(size)
    return salted.join(copied, [key, "_salt"]).drop("_salt")


def join_spread(rows: DataFrame, side: DataFrame, counts: DataFrame, keys: list[str], size: str, total: int, spread: str) -> DataFrame:
    """rows joined with side, which has a row for each value of keys; counts has in size how many of all rows have it.

    Values that hold many rows (by the bounds of join_hot) are parted by a hash of spread, and their rows of side go to each
    part. rows is read once, and a part is about a thousandth of all rows."""
    hot = counts.filter(F.col(size) > max(HOT_ROWS, total // HOT_SHARE)).select(*keys, F.ceil(F.col(size) / max(HOT_ROWS, total // 1000)).alias("_parts"))
    parted = lambda df: df.join(F.broadcast(hot), keys, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1).cast("long")))
    salted = parted(rows).withColumn("_salt", F.pmod(F.xxhash64(spread), F.col("_parts"))).drop("_parts")
    copied = parted(side).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")
    return salted.join(copied, [*keys, "_salt"]).drop("_salt")


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_path(uri: str) -> str | None:
    """The path behind file:// or a bare path; None for another store."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith(os.sep) else None
