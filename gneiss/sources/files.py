"""Source trees as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions import fixed, text
from gneiss.operators.chunks import chunk


def scan(spark: SparkSession, root: str, narrow: bool = False, most_bytes: int = fixed.MAX_FILE_BYTES) -> DataFrame:
    """file_path (below root), language, content, file_hash, modified of files that aren't ignored, too large or of an unknown kind.

    The size limit reaches the scan, so larger files are not opened. Undecodable bytes are replaced, or with narrow the file skipped."""
    literal = re.sub(r"([\[\]{}*?\\])", r"\\\1", root)  # a folder's name, not a pattern
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(literal).filter(F.col("length") <= most_bytes)
    base = root.split(":", 1)[-1].strip("/")
    path = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    rows = found.withColumn("file_path", F.substring(path, F.instr(path, F.lit(base)) + len(base) + 1, F.length(path)))
    rows = rows.filter(~text.ignored(F.col("file_path"), narrow))
    if narrow:
        rows = rows.filter(F.substring_index("file_path", ".", -1).isin(fixed.NARROW_EXTENSIONS) & F.is_valid_utf8(F.col("content").cast("string")))
    rows = rows.withColumn("language", text.language_of(F.col("file_path"), narrow)).filter(F.col("language").isNotNull())
    return rows.select("file_path", "language", F.make_valid_utf8(F.col("content").cast("string")).alias("content"), F.md5("content").alias("file_hash"), F.col("modificationTime").alias("modified"))


def chunks(files: DataFrame, repo_id: int, narrow: bool = False) -> DataFrame:
    """The chunk rows of scanned files, with name symbols (narrow: typed plain symbols)."""
    rows = chunk(files, drop_trailing=narrow, min_bytes=narrow)
    symbols = text.plain_symbols(F.col("code")) if narrow else F.transform(text.names(F.col("code"), F.col("language")), lambda n: F.struct(n.alias("name"), F.lit("name").alias("type")))
    now = F.current_timestamp()
    return rows.select("chunk_id", F.lit(repo_id).cast("long").alias("repo_id"), "file_path", "start_line", "end_line", "code", "language", symbols.alias("symbols"), "ast_hash", F.lit(None).cast("long").alias("embedding_id"), now.alias("created_at"), now.alias("updated_at"))
