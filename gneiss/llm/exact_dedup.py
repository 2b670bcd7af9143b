"""Exact deduplication by stateful streaming.

A digest log is written for the rows of a table and streamed into keyed state on disk (RocksDB) that never expires: for
each digest the identifier of the best holder so far, a content locator, and the number of rows. The locator is the
number of the run that brought the holder; the folder of the state lists for each run the Parquet table that its texts
can be read from, so the holder's identifier leads to its bytes. A run on a folder that earlier runs have used meets what
they left there. Rows that hit a digest are checked byte by byte against the holder's normalised text, whichever run it
came in; rows of a digest that fails this are grouped by their full bytes instead, those of earlier runs included.

Texts are equal when identical after every blank and U+0009 to U+000D is deleted. Of equal texts the row with the most
code points stays, then the smallest doc_id.

A run that stopped is to be repeated with the same rows: its log, once written, is taken as it is, and the stream goes on
where it stopped, so no row counts twice.

Defined results: a null text counts as empty, so null, empty and blank texts are one group; a null doc_id comes after
every other; rows that repeat a doc_id count as rows of their own in group_size and stay or go by doc_id, but
keep_first_copies keeps one row of each group, of several alike in code points and doc_id the one whose text has the
smallest hash; an empty table gives an empty table; other columns are not carried, so none can clash.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.shared import SPACES, drop_path, drop_written, exists, join_hot, new_path, read_table, read_text, text_or_empty, write_text, written

#: State on disk, in bounded memory for all stores of an executor; what changed goes to a change log, not a full copy.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    # Else every store reserves megabytes of disk ahead of use.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Identifiers of copies are broadcast up to so many rows (under 20 MB); beyond, texts are joined by shuffle.
BROADCAST_HITS = 300_000
ROWS_PER_SALT = 200
#: A null doc_id sorts after every other.
LAST = (1 << 63) - 1


def normalised(text: Column) -> Column:
    """The text without blanks and U+0009 to U+000D."""
    return reduce(lambda c, space: F.replace(c, F.lit(space)), SPACES, text)


def sha256_digest(norm: Column) -> Column:
    return F.sha2(norm, 256)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def digest_log(docs: DataFrame, digest=sha256_digest, run: int = 0) -> DataFrame:
    """A row for each document: digest, doc_id, code points of the original text, and the run as its locator."""
    return docs.select("doc_id", digest(normalised(text_or_empty())).alias("digest"), F.length(text_or_empty()).cast("long").alias("points"), F.lit(run).alias("run"))


class State:
    """The folder of a state: runs.json (the source table of each finished run), log, and the stream's checkpoint with the keyed state."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.sources: list[str] = json.loads(read_text(spark, f"{self.folder}/runs.json") or "[]")

    def log(self, run: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/log/part={run}").drop("part")

    def write_log(self, rows: DataFrame, digest, run: int) -> None:
        if not exists(self.spark, f"{self.folder}/log/part={run}/_SUCCESS"):
            digest_log(rows, digest, run).write.mode("overwrite").parquet(f"{self.folder}/log/part={run}")

    def stream(self) -> DataFrame:
        """Streams what is new in the log into the keyed state and returns the state: digest, keep_id, keep_run, group_size.

        The best holder is the maximum of (code points, -doc_id, -run), so the order of arrival doesn't matter."""
        spark, checkpoint = self.spark, f"{self.folder}/stream"
        before = {k: spark.conf.get(k, None) for k in STATE_CONF}
        for k, v in STATE_CONF.items():
            spark.conf.set(k, v)
        try:
            minus = lambda c, other: (-F.coalesce(F.col(c), F.lit(other))).alias(f"minus_{c}")
            holder = F.max(F.struct(F.col("points"), minus("doc_id", LAST), minus("run", 0))).alias("holder")
            rows = spark.readStream.schema("doc_id long, digest string, points long, run int, part int").parquet(f"{self.folder}/log")
            query = rows.groupBy("digest").agg(holder, F.count(F.lit(1)).alias("rows")).writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
            query.awaitTermination()
            state = spark.read.format("statestore").load(checkpoint)
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        holder, rows = (f"value.`{f.name}`" for f in state.schema["value"].dataType.fields)
        keep = -F.col(f"{holder}.minus_doc_id")
        return state.select(F.col("key.digest").alias("digest"), F.when(keep != LAST, keep).alias("keep_id"), (-F.col(f"{holder}.minus_run")).alias("keep_run"), F.col(rows).alias("group_size"))

    def texts(self, run: int) -> DataFrame:
        """doc_id and text of the rows of an earlier run, through its locator."""
        return _rows(self.spark.read.parquet(self.sources[run]))

    def finish(self, source: str) -> None:
        self.sources.append(source)
        write_text(self.spark, f"{self.folder}/runs.json", json.dumps(self.sources))


def _held(state: State, docs: DataFrame, keeps: DataFrame, digest, run: int) -> DataFrame:
    """digest and held, the normalised text of the holder, of each row of keeps whose holder came in an earlier run."""
    found = []
    for earlier in [r["keep_run"] for r in keeps.filter(F.col("keep_run") < run).select("keep_run").distinct().collect()]:  # at most one row a run
        own = keeps.filter(F.col("keep_run") == earlier).select("digest", "keep_id")
        ids = own.select(F.col("keep_id").alias("_id")).distinct()
        ids = F.broadcast(ids) if ids.limit(BROADCAST_HITS + 1).count() <= BROADCAST_HITS else ids
        texts = state.texts(earlier).join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
        texts = texts.select("doc_id", normalised(text_or_empty()).alias("held")).withColumn("digest", digest(F.col("held")))
        found.append(texts.join(own.withColumnRenamed("digest", "_digest"), F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("digest") == F.col("_digest"))).select("digest", "held"))
    return reduce(DataFrame.unionByName, found) if found else None


def _mismatches(state: State, docs: DataFrame, found: DataFrame, digest, run: int, total: int) -> DataFrame:
    """Digests under which some row's normalised bytes differ from its holder's. Normalises and moves only texts of shared digests."""
    shared = found.filter("group_size > 1")
    ids = shared.select(F.col("doc_id").alias("_id")).distinct()
    keeps = shared.select("digest", "keep_id", "keep_run", "group_size", F.ceil(F.col("group_size") / ROWS_PER_SALT).alias("_salts")).distinct()
    if shared.limit(BROADCAST_HITS + 1).count() <= BROADCAST_HITS:
        ids = F.broadcast(ids)
    hits = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    hits = hits.select("doc_id", normalised(text_or_empty()).alias("norm")).withColumn("digest", digest(F.col("norm")))
    hits = join_hot(hits, keeps, "digest", "group_size", total)
    # The holder's text goes to every part of a large group, so no task gets the whole group.
    held = hits.filter((F.col("keep_run") == run) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("digest", F.col("norm").alias("held"))
    earlier = _held(state, docs, keeps, digest, run)
    held = (held.unionByName(earlier) if earlier else held).groupBy("digest").agg(F.min("held").alias("held"))
    held = held.join(keeps.select("digest", "_salts"), "digest").select("digest", "held", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1)).alias("_salt"))
    salted = hits.select("digest", "norm", F.pmod(F.monotonically_increasing_id(), F.col("_salts")).alias("_salt"))
    return salted.join(held, ["digest", "_salt"], "left").filter(~F.col("norm").eqNullSafe(F.col("held"))).select("digest").distinct()


def _apart(state: State, docs: DataFrame, wrong: DataFrame, digest, run: int) -> DataFrame:
    """The rows of docs under digests that several texts share, grouped by full bytes together with those of earlier runs."""
    rows = docs.withColumn("_run", F.lit(run))
    for earlier in range(run):
        ids = state.log(earlier).join(wrong, "digest", "left_semi").select(F.col("doc_id").alias("_id")).distinct()
        texts = state.texts(earlier).join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
        rows = rows.unionByName(texts.withColumn("_run", F.lit(earlier)))
    norm = normalised(text_or_empty())
    apart = rows.withColumn("norm", norm).withColumn("digest", digest(F.col("norm"))).join(wrong, "digest", "left_semi")
    best = F.max(F.struct(F.length(text_or_empty()).alias("points"), (-F.coalesce(F.col("doc_id"), F.lit(LAST))).alias("minus_id")))["minus_id"]
    groups = apart.groupBy("digest", "norm").agg((-best).alias("keep_id"), F.count(F.lit(1)).alias("group_size")).withColumn("keep_id", F.when(F.col("keep_id") != LAST, F.col("keep_id")))
    return apart.filter(F.col("_run") == run).select("doc_id", "digest", "norm").join(groups, ["digest", "norm"]).select("doc_id", "digest", "keep_id", "group_size")


def exact_dedup(docs: DataFrame, digest=sha256_digest, state_dir: str | None = None, source: str | None = None) -> DataFrame:
    """doc_id, digest, keep_id, group_size and kept for each row of docs.

    state_dir: a folder whose state this run takes up and adds to; by default a new one, deleted at the end. source: the
    Parquet table that docs is, for later runs to read holders' texts from; where none is given, a kept state gets a copy."""
    docs, spark = _rows(docs), docs.sparkSession
    folder = state_dir or new_path(spark, "dedup-state")
    state = State(spark, folder)
    run = len(state.sources)
    state.write_log(docs, digest, run)
    log = state.log(run)
    groups = written(state.stream(), "dedup-groups")
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    found = written(join_hot(log.select("doc_id", "digest"), groups, "digest", "group_size", total), "dedup-found")
    wrong = written(_mismatches(state, docs, found, digest, run, total), "dedup-wrong")
    if not wrong.isEmpty():
        columns = ["doc_id", "digest", "keep_id", "group_size"]
        again = written(found.select(*columns).join(wrong, "digest", "left_anti").unionByName(_apart(state, docs, wrong, digest, run)), "dedup-found")
        drop_written(found)
        found = again
    if state_dir is None:
        drop_path(spark, folder)
    else:
        if source is None:
            source = f"{folder}/texts/part={run}"
            docs.write.mode("overwrite").parquet(source)
        state.finish(source)
    drop_written(wrong, groups)
    return found.select("doc_id", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))


def keep_first_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, one for each group, with the columns of docs."""
    found = written(exact_dedup(docs), "dedup-kept")
    ids = found.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("ids")).first()
    dropped = found.filter(~F.col("kept")).select(F.col("doc_id").alias("_id"))
    if ids["n"] == ids["ids"]:
        return docs.join(dropped.distinct(), F.col("doc_id").cast("long").eqNullSafe(F.col("_id")), "left_anti")
    # Repeated or null identifiers: rows of the identifier and digest that stay, and of these the one that the contract prefers.
    keyed = docs.withColumns({"_digest": sha256_digest(normalised(text_or_empty())), "_row": F.struct(*docs.columns)})
    kept = found.filter("kept").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_kept")).distinct()
    keyed = keyed.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_kept")))
    order = F.struct(-F.length(text_or_empty()), F.xxhash64(text_or_empty()))
    return keyed.groupBy("_digest").agg(F.min_by("_row", order).alias("_row")).select("_row.*")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(read_table(spark, sf_dir, "documents"), source=f"{sf_dir}/documents.parquet")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


QUERIES = {"op6_exact_dedup": op6_exact_dedup}
ORACLE_SQL = {
    "op6_exact_dedup": r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id IS NOT DISTINCT FROM first_value(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id ASC NULLS LAST)
"""
}
