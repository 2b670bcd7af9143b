"""A BM25 index of immutable segments, for many queries and small changes.

A segment holds some documents: their terms (docs), postings in blocks (blocks), the terms' document counts (terms) and
the ids of documents of older segments that it replaces or removes (dead). A change writes one segment, whatever the size
of the rest; numbers of documents, their length and counts of terms are sums over segments, to which a removed document
adds its own with a minus. Segments next to each other are merged when several of one size have gathered, so their number
grows with the logarithm of the index.

Blocks: documents of a segment, sorted by language and length in each task, are dealt into buckets of BUCKET, and all postings
of a term in a bucket are one row, with the largest frequency and the least length among them. A document's score can't exceed
the sum, over the terms of a query, of what its bucket's rows allow. A search reads the bucket bounds first, scores the
most promising buckets, and then only those that can still reach the k-th score. A term that all documents hold is as many
rows as there are buckets, and they lie in the files of all tasks, each sorted by term and bucket.

Words don't move when a segment is written: a text is tokenised once, and its task sorts and writes what comes of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions import text
from gneiss.operators.catalog import Versions
from gneiss.operators.lexical import doc_tokens, idf, term_counts, top, weight

#: Documents in a bucket; buckets that a search scores to find a first k-th score; so many segments of one size are merged.
BUCKET, FIRST_BUCKETS, FAN = 128, 64, 4
#: Terms of a document in a row that goes to a Python worker, which gets 10,000 rows at a time; postings that it makes blocks of together.
SLICE, POSTINGS = 64, 200_000
#: Rows of one or two numbers that are broadcast at most (buckets of a search, removed documents); more are joined by shuffle.
BROADCAST_ROWS = 1_500_000

DOCS = "chunk_id long, language string, doc_len int, terms array<string>, tfs array<int>"
BLOCKS = "term string, bucket long, language string, chunk_ids array<long>, tfs array<int>, doc_lens array<int>, max_tf int, min_len int"
TERMS = "term string, df long"
DEAD = "chunk_id long"
GONE = "chunk_id long, doc_len int, seq int"


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def blocked(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """BLOCKS from sorted documents in slices (chunk_id, language, doc_len, terms, tfs), with part, the task's number, and place, the bucket's.

    Whole buckets are put together, as many as hold most postings."""
    held, numbers, n, made, last = [], [], 0, -1, None
    for batch in batches:
        if not batch.num_rows:
            continue
        language, place = batch.column("language"), batch.column("place").to_numpy()
        code = language.dictionary_encode().indices.fill_null(-1).to_numpy()
        new = np.concatenate([[(place[0], language[0].as_py()) != last], (place[1:] != place[:-1]) | (code[1:] != code[:-1])])
        last = place[-1], language[-1].as_py()
        bucket = made + np.cumsum(new)
        before = np.concatenate([[0], np.cumsum(np.diff(batch.column("terms").offsets.to_numpy()))])
        begin = 0
        for end in [*np.flatnonzero(new).tolist(), batch.num_rows]:
            if end < batch.num_rows and n + before[end] - before[begin] >= most:
                yield _blocks([*held, batch.slice(begin, end - begin)], np.concatenate([*numbers, bucket[begin:end]]))
                held, numbers, n, begin = [], [], 0, end
        held.append(batch.slice(begin))
        numbers.append(bucket[begin:])
        n += before[-1] - before[begin]
        made = int(bucket[-1])
    if held:
        yield _blocks(held, np.concatenate(numbers))


def _blocks(slices: list[pa.RecordBatch], number: np.ndarray) -> pa.RecordBatch:
    """The blocks of slices of documents; number: of each one's bucket."""
    rows = pa.Table.from_batches(slices).combine_chunks().to_batches()[0]
    terms, tfs = rows.column("terms"), rows.column("tfs").flatten().to_numpy()
    words = terms.flatten().dictionary_encode()
    doc = np.repeat(np.arange(rows.num_rows), np.diff(terms.offsets.to_numpy()))
    size = max(1, len(words.dictionary))
    group = (number - number[0])[doc] * size + words.indices.to_numpy()
    order = np.argsort(group, kind="stable")
    groups, starts, sizes = np.unique(group[order], return_index=True, return_counts=True)
    lens = rows.column("doc_len").to_numpy()[doc[order]]
    bucket = (int(rows.column("part")[0].as_py()) << 40) + int(number[0]) + groups // size
    columns = [words.dictionary.take(pa.array(groups % size)), pa.array(bucket, pa.int64()), rows.column("language").take(pa.array(doc[order][starts])), _lists(rows.column("chunk_id").take(pa.array(doc[order])), sizes), _lists(pa.array(tfs[order], pa.int32()), sizes)]
    columns += [_lists(pa.array(lens, pa.int32()), sizes), pa.array(np.maximum.reduceat(tfs[order], starts), pa.int32()), pa.array(np.minimum.reduceat(lens, starts), pa.int32())]
    return pa.RecordBatch.from_arrays(columns, ["term", "bucket", "language", "chunk_ids", "tfs", "doc_lens", "max_tf", "min_len"])


class SegmentIndex:
    """docs, blocks, terms and dead of all segments, below path; the present segments, oldest first, are a state of Versions."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.versions = spark, path.rstrip("/"), Versions(spark, path)
        #: What the last search read: blocks scored, and blocks of its terms.
        self.read: dict[str, int] = {}

    @staticmethod
    def build(chunks: DataFrame, path: str, limit: int | None = None) -> SegmentIndex:
        """An index of chunks (chunk_id, code, language) alone; limit: the first so many by chunk_id."""
        index = SegmentIndex(chunks.sparkSession, path)
        index._change(chunks.orderBy("chunk_id").limit(limit) if limit is not None else chunks, None, anew=True)
        return index

    def _segments(self) -> list[dict]:
        number, state = self.versions.now()
        if not number:
            raise FileNotFoundError(self.path)
        return state["segments"]

    def _of(self, segments: list[dict], name: str, columns: str) -> DataFrame:
        """A table of all segments, with seq, the segment's number."""
        parts = [self.spark.read.schema(columns).parquet(f"{self.path}/{s['folder']}/{name}").withColumn("seq", F.lit(s["seq"])) for s in segments]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], columns + ", seq int")

    def _live(self, rows: DataFrame, segments: list[dict]) -> DataFrame:
        """rows (chunk_id, seq) without those that a later segment removes."""
        n = sum(s["dead"] for s in segments)
        if not n:
            return rows
        dead = self._of(segments, "dead", DEAD).groupBy("chunk_id").agg(F.max("seq").alias("_dead"))
        marked = rows.join(F.broadcast(dead) if n <= BROADCAST_ROWS else dead, "chunk_id", "left")
        return marked.filter(F.col("_dead").isNull() | (F.col("seq") >= F.col("_dead"))).drop("_dead")

    def docs(self) -> DataFrame:
        """The documents that count: chunk_id, language, doc_len, terms and tfs."""
        segments = self._segments()
        return self._live(self._of(segments, "docs", DOCS), segments).drop("seq")

    def update(self, chunks: DataFrame | None, removed: DataFrame | None = None) -> None:
        """Puts chunks in, in place of those of their ids, and takes out removed (chunk_id): one new segment, and merges that are due."""
        self._change(chunks, removed)
        while (run := self._due()) is not None:
            self._merge(run)
        self.versions.forget()

    def _change(self, chunks: DataFrame | None, removed: DataFrame | None, anew: bool = False) -> None:
        """Readers meet the index before or after; where another writer was first, its segments count as older ones."""
        folder = self.versions.new_folder()
        to = f"{self.path}/{folder}"
        if chunks is None:
            chunks = self.spark.createDataFrame([], "chunk_id long, code string, language string")
        tokenised = doc_tokens(chunks, F.coalesce("language", F.lit("code"))).select(F.col("chunk_id").cast("long").alias("chunk_id"), "language", "doc_len", term_counts(F.col("tokens")).alias("counts"))
        self._write(tokenised.select("chunk_id", "language", "doc_len", F.col("counts.term").alias("terms"), F.col("counts.tf").alias("tfs")), to)
        while True:
            number, state = self.versions.now()
            segments = [] if anew else state.get("segments", [])
            seq = 1 + max((s["seq"] for s in segments), default=0)
            facts = self._finish(to, segments, removed)
            segment = {"folder": folder, "seq": seq, **facts}
            now = [*segments, segment]
            if self.versions.commit(number, {"folders": [s["folder"] for s in now], "segments": now}):
                break
        if anew:
            self.versions.forget()

    def _write(self, docs: DataFrame, to: str) -> None:
        """docs and blocks of a segment, each in one pass: parting them by range would make them twice, first for a sample."""
        docs.sortWithinPartitions("language", "doc_len", "chunk_id").write.parquet(f"{to}/docs")
        # A row's number in its task is in the lower 33 bits.
        place = F.floor(F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) / BUCKET)
        known = self.spark.read.schema(DOCS).parquet(f"{to}/docs").withColumns({"part": F.spark_partition_id(), "place": place}).filter(F.size("terms") > 0)
        parts = known.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("terms"), F.lit(SLICE))))
        parts = parts.select("chunk_id", "language", "doc_len", *(F.slice(c, F.col("at"), F.lit(SLICE)).alias(c) for c in ("terms", "tfs")), "part", "place")
        most = POSTINGS
        blocks = parts.mapInArrow(lambda batches: blocked(batches, most), BLOCKS)
        blocks.sortWithinPartitions("term", "bucket").write.parquet(f"{to}/blocks")

    def _finish(self, to: str, older: list[dict], removed: DataFrame | None) -> dict:
        """dead and terms of a segment, against the older ones, and its numbers."""
        docs = self.spark.read.schema(DOCS).parquet(f"{to}/docs")
        ids = docs.select("chunk_id")
        if removed is not None:
            ids = ids.unionByName(removed.select(F.col("chunk_id").cast("long").alias("chunk_id")))
        # Which documents go is told by their numbers alone; words are read of those only, and not moved.
        gone = self._live(self._of(older, "docs", DOCS).select("chunk_id", "doc_len", "seq"), older).join(ids.distinct(), "chunk_id", "left_semi")
        if not older:
            gone = gone.limit(0)
        gone.select("chunk_id", "doc_len", "seq").write.mode("overwrite").parquet(f"{to}/gone")
        gone = self.spark.read.schema(GONE).parquet(f"{to}/gone")
        gone.select("chunk_id").write.mode("overwrite").parquet(f"{to}/dead")
        facts = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("doc_len").cast("long")), F.lit(0)).alias("length")).first()
        own, less = facts(docs), facts(gone)
        sign = lambda df, n: df.select(F.explode("terms").alias("term"), F.lit(n).cast("long").alias("n"))
        counts = sign(docs, 1)
        if less["n"]:
            pairs = gone.select("chunk_id", "seq")
            out = self._of(older, "docs", DOCS).join(F.broadcast(pairs) if less["n"] <= BROADCAST_ROWS else pairs, ["chunk_id", "seq"], "left_semi")
            counts = counts.unionByName(sign(out, -1))
        counts = counts.groupBy("term").agg(F.sum("n").alias("df")).filter("df <> 0")
        counts.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{to}/terms")
        return {"rows": own["n"], "docs": own["n"] - less["n"], "length": own["length"] - less["length"], "dead": less["n"]}

    def _due(self) -> tuple[int, int] | None:
        """First and last place of neighbouring segments that are to be merged: the newest ones of a size, when there are FAN."""
        sizes = [(s["rows"] + s["dead"]).bit_length() // 2 for s in self._segments()]
        for tier in sorted(set(sizes)):
            first = len(sizes)
            while first and sizes[first - 1] <= tier:
                first -= 1
            if len(sizes) - first >= FAN:
                return first, len(sizes)
        return None

    def _merge(self, run: tuple[int, int]) -> None:
        """Writes the run's live documents as one segment; what it removes from older ones stays removed."""
        number, state = self.versions.now()
        own, older = state["segments"][run[0] : run[1]], state["segments"][: run[0]]
        folder = self.versions.new_folder()
        to = f"{self.path}/{folder}"
        self._write(self._live(self._of(own, "docs", DOCS), own).drop("seq"), to)
        dead = self._of(own, "dead", DEAD).select("chunk_id").distinct()
        if older:
            dead = dead.join(self._of(older, "docs", DOCS).select("chunk_id"), "chunk_id", "left_semi")
        (dead if older else dead.limit(0)).write.parquet(f"{to}/dead")
        counts = self._of(own, "terms", TERMS).groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0")
        counts.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{to}/terms")
        rows = self.spark.read.schema(DOCS).parquet(f"{to}/docs").count()
        gone = self.spark.read.schema(DEAD).parquet(f"{to}/dead").count()
        merged = {"folder": folder, "seq": own[-1]["seq"], "rows": rows, "docs": sum(s["docs"] for s in own), "length": sum(s["length"] for s in own), "dead": gone}
        now = [*older, merged, *state["segments"][run[1] :]]
        # Where another writer was first, the merge is left to a later change.
        self.versions.commit(number, {"folders": [s["folder"] for s in now], "segments": now})

    def search(self, query: str, language: str | None = None, limit: int = 10, digits: int | None = 4) -> DataFrame:
        """chunk_id, score, terms: the same rows as a search of all texts. Statistics are of the whole corpus, the language filters documents only."""
        segments = self._segments()
        n, length = sum(s["docs"] for s in segments), sum(s["length"] for s in segments)
        none = self.spark.createDataFrame([], "chunk_id long, score double, terms array<string>")
        asked = self.spark.createDataFrame([(query,)], "q string").select(F.explode(text.tokens(F.col("q"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("times"))
        times = {r["term"]: r["times"] for r in asked.collect()}  # the words of one query
        wanted = F.col("term").isin(list(times))
        counts = self._of(segments, "terms", TERMS).filter(wanted).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0").collect() if times else []
        if not counts or not n:
            return none
        known = F.broadcast(self.spark.createDataFrame([(r["term"], times[r["term"]], r["df"]) for r in counts], "term string, times long, df long"))
        avg = F.lit(length / n)
        part = lambda tf, doc_len: F.col("times") * idf(F.lit(float(n)), F.col("df")) * weight(tf, doc_len, avg)
        blocks = self._of(segments, "blocks", BLOCKS).filter(wanted)
        blocks = (blocks if language is None else blocks.filter(F.col("language") == language)).join(known, "term")
        bounds = blocks.groupBy("seq", "bucket").agg(F.sum(part(F.col("max_tf"), F.col("min_len"))).alias("bound"), F.count(F.lit(1)).alias("blocks")).withColumn("bound", F.col("bound") * (1 + 1e-9))
        best = bounds.orderBy(F.desc("bound"), "seq", "bucket").limit(max(FIRST_BUCKETS, 4 * limit // BUCKET)).collect()
        if not best:
            return none
        total = bounds.agg(F.sum("blocks")).first()[0]
        first = self.spark.createDataFrame([(r["seq"], r["bucket"]) for r in best], "seq int, bucket long")
        scored = top(self._scored(blocks, F.broadcast(first), part, segments), limit, digits=None).collect()  # limit rows
        least = scored[-1]["score"] if len(scored) == limit else 0.0
        found = self.spark.createDataFrame(scored, "chunk_id long, score double, terms array<string>")
        rest = bounds.filter(F.col("bound") >= least).join(F.broadcast(first), ["seq", "bucket"], "left_anti")
        left = rest.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("blocks"), F.lit(0)).alias("blocks")).first()
        self.read = {"blocks": total, "scored": sum(r["blocks"] for r in best) + left["blocks"]}
        if left["n"]:
            rest = rest.select("seq", "bucket")
            found = found.unionByName(self._scored(blocks, F.broadcast(rest) if left["n"] <= BROADCAST_ROWS else rest, part, segments))
        return top(found, limit, digits=digits)

    def _scored(self, blocks: DataFrame, buckets: DataFrame, part, segments: list[dict]) -> DataFrame:
        """chunk_id, score and terms of all documents of the buckets."""
        rows = blocks.join(buckets, ["seq", "bucket"], "left_semi")
        rows = rows.select("seq", "term", "times", "df", F.explode(F.arrays_zip("chunk_ids", "tfs", "doc_lens")).alias("p")).select("seq", "term", "times", "df", F.col("p.chunk_ids").alias("chunk_id"), F.col("p.tfs").alias("tf"), F.col("p.doc_lens").alias("doc_len"))
        parts = self._live(rows, segments).groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("term", part(F.col("tf"), F.col("doc_len")).alias("part")))).alias("parts"))
        # Added up in the order of terms, so that equal documents have equal scores.
        score = F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["part"])
        return parts.select("chunk_id", score.alias("score"), F.transform("parts", lambda x: x["term"]).alias("terms"))

    def terms(self) -> DataFrame:
        """term, df and tf of the documents that count."""
        rows = self.docs().select(F.explode(F.arrays_zip("terms", "tfs")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.tfs").alias("tf"))
        counts = self._of(self._segments(), "terms", TERMS).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
        return counts.join(rows, "term").select("term", "df", "tf")

    def stats(self) -> DataFrame:
        """doc_count, total_length, avg_len, term_count and the bytes of the postings."""
        segments = self._segments()
        n, length = sum(s["docs"] for s in segments), sum(s["length"] for s in segments)
        counts = self._of(segments, "terms", TERMS).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
        size = counts.agg(F.count(F.lit(1)).alias("term_count"), F.coalesce(F.sum(F.octet_length("term") * F.col("df") + 8 * F.col("df")), F.lit(0)).alias("posting_bytes"))
        known = self.spark.createDataFrame([(n, length, length / n if n else 0.0)], "doc_count long, total_length long, avg_len double")
        return known.crossJoin(F.broadcast(size))


def skipped_share(index: SegmentIndex) -> float:
    """The share of its terms' blocks that the last search left out."""
    return 1 - index.read["scored"] / index.read["blocks"] if index.read.get("blocks") else 0.0


