"""Mixing sources to target weights.

Sizes are summed per source, targets and repetition rates derived, and each document emitted floor(rate) times plus one
copy drawn with the rate's fraction as probability. The draw is a hash of seed, doc_id and text, so reruns agree and no
state or order is involved; rows that are alike in all three draw by their places in the input besides, each for itself.

Targets: sources by code point, nulls last, weigh 3, 1, 2, repeating; they share share * (all sizes). A target stops at
cap * (its source's size) and what is above is shared again by weight until none is above. That is the level L at which
sum(min(cap * size, L * weight)) equals the whole. Sources are numbered by a sort over ranges, and L comes from rounds of
one aggregate each: what sources at their limits leave is shared by the weights of the others, until no other is above.

Defined results: a null text has size 0 and draws as an empty one; a source whose size is 0 has target 0 and rate 0; a
null doc_id draws as the text "null"; an empty table gives an empty table; other columns stay as they are and the
operator's own columns replace columns of the same names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.shared import join_hot, read_table, text_or_empty, written

WEIGHTS = (3.0, 1.0, 2.0)
#: The source table is broadcast up to so many sources (under 10 MB); beyond, only large sources are, the rest is joined by shuffle.
BROADCAST_SOURCES = 50_000
#: Keys of repeated rows are broadcast up to so many (under 10 MB); beyond, only hot ones are, the rest is joined by shuffle.
BROADCAST_KEYS = 50_000


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))).cast("long")


def _weighed(sizes: DataFrame) -> DataFrame:
    """sizes with number, a source's place by code point, nulls last, and weight."""
    placed = sizes.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    placed = written(placed.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}), "mix-placed")
    # A row for each task of the sort.
    parts = sorted((r["part"], r["n"], r["low"]) for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("low")).collect())
    before, rows = 0, []
    for part, n, low in parts:
        rows.append((part, before - low))
        before += n
    shift = F.broadcast(placed.sparkSession.createDataFrame(rows, "part int, shift long"))
    numbered = placed.join(shift, "part").withColumn("number", F.col("place") + F.col("shift"))
    return numbered.select(*sizes.columns, "number", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("number") % len(WEIGHTS) + 1).cast("int")).alias("weight"))


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, target, rate; sizes has a row for each source: source and source_size."""
    rows = written(_weighed(sizes).withColumn("limit", F.col("source_size") * F.lit(float(cap))), "mix-weighed")
    whole = (rows.agg(F.sum("source_size")).first()[0] or 0) * float(share)
    level = 0.0
    while True:
        at_limit = F.col("limit") < F.lit(level) * F.col("weight")
        used, rest = rows.agg(F.coalesce(F.sum(F.when(at_limit, F.col("limit"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~at_limit, F.col("weight"))), F.lit(0.0))).first()
        following = (whole - used) / rest if rest else float("inf")  # no smaller than the level before
        if following <= level or not rest:
            level = max(level, following)
            break
        level = following
    target = F.least("limit", F.lit(level) * F.col("weight")) if level != float("inf") else F.col("limit")
    return rows.select("source", "source_size", target.alias("target")).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))


def draw(key: Column, seed: int) -> Column:
    """A number from 0 to 1, below 1, of seed and key: the first 13 hexadecimal digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _drawn(rows: DataFrame, docs: DataFrame, seed: int) -> DataFrame:
    """rows with draw, a number of their own. docs: where repeated rows are looked for."""
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.md5(text_or_empty().cast("binary")))
    own = lambda df: df.withColumn("_draw_key", key)
    repeated = own(docs).groupBy("_draw_key").agg(F.count(F.lit(1)).alias("_times")).filter("_times > 1")
    repeated = written(repeated, "mix-repeated")
    rows = own(rows)
    if repeated.isEmpty():
        return rows.withColumn("_draw", draw(F.col("_draw_key"), seed)).drop("_draw_key")
    place = F.when(F.col("_times").isNotNull(), F.concat(F.lit(":"), F.col("_place").cast("string"))).otherwise("")
    placed = rows.withColumn("_place", F.monotonically_increasing_id())
    if repeated.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        marked = placed.join(F.broadcast(repeated), "_draw_key", "left")
    else:
        marked = join_hot(placed, repeated, "_draw_key", "_times", docs.count()).unionByName(placed.join(repeated, "_draw_key", "left_anti"), allowMissingColumns=True)
    return marked.withColumn("_draw", draw(F.concat("_draw_key", place), seed)).drop("_draw_key", "_place", "_times")


def mix_sources(docs: DataFrame, seed: int = 17, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """docs with size, source_size, target and copies, the number of times that the mix takes the row."""
    # Sizes are computed in the aggregate and again beside each row: cheaper than to write texts or to shuffle them.
    sized = docs.withColumn("size", word_count(text_or_empty()))
    per_source = written(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "mix-sources")
    named = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    targets = source_targets(per_source.select("source", "source_size"), share, cap).withColumn("_source", named).drop("source")
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "rate", "copies")]
    rows = _drawn(sized.select(*own, "size").withColumn("_source", named), docs.select("doc_id", "text"), seed)
    if per_source.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(targets), "_source")
    else:
        counts = per_source.select(named.alias("_source"), "n")
        joined = join_hot(rows, written(targets.join(counts, "_source"), "mix-targets"), "_source", "n", docs.count())
    whole = F.floor("rate")
    copies = (whole + F.when(F.col("_draw") < F.col("rate") - whole, 1).otherwise(0)).cast("long")
    return joined.select(*own, "size", "source_size", "target", copies.alias("copies"))


def emit_mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row as many times as the mix takes it, with the columns of docs."""
    return mix_sources(docs, **options).filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


QUERIES = {"op8_mixing": op8_mixing}
ORACLE_SQL = {
    "op8_mixing": r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(text, '')) AS digest, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
      source_size * 2.0::DOUBLE AS lim FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE * 1.5::DOUBLE - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
      / sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(lim, coalesce((SELECT max(level) FROM l WHERE level * weight <= lim), 1e300::DOUBLE) * weight) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM t)
SELECT d.doc_id, d.size, r.source_size, r.target,
  (d.size * (floor(rate) + CASE WHEN ('0x' || substr(md5('17:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || d.digest), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""
}
