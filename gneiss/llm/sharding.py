"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in long arithmetic of DataFrame functions.

A row's shard depends on its key and the number of shards alone. With one more shard, a row stays or moves into the
new shard. No ring table exists and nothing is broadcast but one row for each pair of shard and sub-bucket.

Slots number the rows of a shard without gaps. A shard, and a key, may hold any share of the rows, so a shard's rows are
dealt over sub-buckets by a hash of their place in the input: sub-buckets are counted, counts summed before each, and rows
ranked within theirs, so no task holds a whole shard or all rows of a key. Places are taken once, in a written table of
everything but the texts.

Defined results: a null key counts as key 0; rows that repeat a key share a shard and get slots of their own; a null
text has size 16 and crc 0; an empty table gives an empty table; other columns are not carried, so none can clash.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.llm.shared import read_table, text_or_empty, written

#: The multiplier of the published algorithm's 64-bit generator.
MULTIPLIER = 2862933555777941757
_M32 = 0xFFFFFFFF
_C0, _C1 = MULTIPLIER & _M32, MULTIPLIER >> 32
#: Steps are about ln(shards) on average; beyond so many steps an error is raised, never a wrong shard returned.
MAX_STEPS = 192


def _next_state(key: Column) -> Column:
    """key * MULTIPLIER + 1 modulo 2**64. Each partial product stays below 2**63, as ANSI arithmetic raises on overflow."""
    low, high = key.bitwiseAND(F.lit(_M32)), F.shiftrightunsigned(key, 32)
    a = low.bitwiseAND(F.lit(0xFFFF)) * F.lit(_C0) + F.lit(1)
    b = F.shiftrightunsigned(low, 16) * F.lit(_C0)
    c = a + F.shiftleft(b.bitwiseAND(F.lit(0xFFFF)), 16)
    carry = F.shiftrightunsigned(c, 32) + F.shiftrightunsigned(b, 16)
    cross = high.bitwiseAND(F.lit(0xFFFF)) * F.lit(_C0) + F.shiftleft(F.shiftrightunsigned(high, 16) * F.lit(_C0 & 0xFFFF), 16).bitwiseAND(F.lit(_M32))
    top = (carry + cross + low * F.lit(_C1)).bitwiseAND(F.lit(_M32))
    return F.shiftleft(top, 32).bitwiseOR(c.bitwiseAND(F.lit(_M32)))


def jump_hash(key: Column, shards: int) -> Column:
    """The shard from 0 to shards - 1 of a long key."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"), key.cast("long").alias("k"))

    def step(s: Column, _: Column) -> Column:
        k = _next_state(s["k"])
        jump = ((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftrightunsigned(k, 33) + 1).cast("double"))).cast("long")
        moved = F.struct(s["j"].alias("b"), jump.alias("j"), k.alias("k"))
        return F.when(s["j"] < shards, moved).otherwise(s)

    def done(s: Column) -> Column:
        return F.when(s["j"] >= shards, s["b"].cast("int")).otherwise(F.raise_error(F.lit("jump hash: too few steps")).cast("int"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, MAX_STEPS))), start, step, done)


def shard_documents(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", rows_per_task: int = 1_000_000) -> DataFrame:
    """key, size, text_crc32, shard, grown_shard (with one more shard) and slot for each row of docs."""
    at = F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long"))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(text_or_empty(text)).cast("long") + 16).alias("size"),
        F.crc32(text_or_empty(text)).alias("text_crc32"),
        jump_hash(at, shards).alias("shard"),
        jump_hash(at, shards + 1).alias("grown_shard"),
        F.xxhash64(F.monotonically_increasing_id()).alias("place"),
    )
    rows = written(rows, "shard-rows")
    subs = max(8, ceil(rows.count() / (shards * rows_per_task)) * 8)
    rows = rows.withColumn("sub", F.pmod("place", F.lit(subs)).cast("int"))
    counts = rows.groupBy("shard", "sub").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # At most shards * subs rows, eight for every rows_per_task rows of a shard: a size known before the plan runs.
    base = F.broadcast(base) if shards * subs <= 200_000 else base
    within = Window.partitionBy("shard", "sub").orderBy("doc_id", "text_crc32", "size", "place")
    return (
        rows.withColumn("rank", F.row_number().over(within).cast("long"))
        .join(base, ["shard", "sub"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - 1).alias("slot"), "grown_shard")
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: DuckDB has no function for jump hashing, and slots within a shard are free: see tests for the brute-force version.
QUERIES = {"op2_sharding": op2_sharding}
ORACLE_SQL: dict[str, str] = {}
