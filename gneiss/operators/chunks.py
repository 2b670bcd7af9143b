"""Line windows of source texts with content hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions import fixed, text


def windows(code: Column, size: int = fixed.CHUNK_LINES, overlap: int = fixed.CHUNK_OVERLAP, drop_trailing: bool = False) -> Column:
    """start_line, end_line and code of each window; a window begins every size - overlap lines.

    drop_trailing: lines end in a line break or a carriage return and line break, and no empty line follows the last."""
    lines = F.split(code, "\r?\n" if drop_trailing else "\n", -1)
    if drop_trailing:
        lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    # The lines are split once: the lambda below gets them as its argument.
    starts = lambda ls: F.when(F.size(ls) > 0, F.sequence(F.lit(0), F.size(ls) - 1, F.lit(size - overlap)))

    def cut(ls: Column) -> Column:
        return F.transform(starts(ls), lambda i: F.struct((i + 1).alias("start_line"), F.least(i + size, F.size(ls)).alias("end_line"), F.array_join(F.slice(ls, i + 1, F.lit(size)), "\n").alias("code")))

    return F.element_at(F.transform(F.array(lines), cut), 1)


def chunk(files: DataFrame, path: str = "file_path", code: str = "content", language: str = "language", keep: tuple[str, ...] = (), drop_trailing: bool = False, min_chars: int = fixed.MIN_CHUNK_CHARS, min_bytes: bool = False) -> DataFrame:
    """A row for each window that is long enough: path, language, start_line, end_line, code, ast_hash (MD5) and chunk_id.

    chunk_id is a hash of path and first line, so the same text gets the same ids in any order of files."""
    rows = files.select(path, language, *keep, F.explode(windows(F.col(code), drop_trailing=drop_trailing)).alias("w")).select(path, language, *keep, "w.*")
    long_enough = F.octet_length("code") >= min_chars if min_bytes else text.stripped_length(F.col("code")) >= min_chars
    return rows.filter(long_enough).withColumn("ast_hash", F.md5("code")).withColumn("chunk_id", F.xxhash64(path, "start_line"))


def duplicates(chunks: DataFrame, key: str = "ast_hash") -> DataFrame:
    """Hashes that occur more than once, with their counts."""
    return chunks.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def with_hash(chunks: DataFrame, ast_hash: str, path: str = "file_path") -> DataFrame:
    return chunks.filter(F.col("ast_hash") == ast_hash).orderBy(path, "start_line")
