"""Removal of passages that repeat across documents, by suffix automata of reference shards.

A window is 13 consecutive words of a document; a word goes if a window that covers it also starts in a document with a
smaller doc_id. Every text is one's own reference here, so the reference is as large as the corpus, and no automaton of
all of it can be broadcast. It is cut down and sharded without losing a window:

1. Copies. Of rows whose words are all equal one of the smallest doc_id is worked on; every window of a copy with a larger
   doc_id also starts there, so such a copy loses all words from 13 words on. Groups of copies go no further.
2. Anchors. Of the eight 6-grams within a window the one with the smallest hash is the window's anchor. Equal windows
   have equal anchors, so windows whose anchor occurs in one document only are no repeats. About two of nine 6-grams are
   anchors; they are counted over all documents.
3. Passages. The runs of consecutive windows that share an anchor which occurs in several documents are passages (seldom
   over 20 words). Equal passages are one reference passage with its smallest doc_id.
4. Shards. Reference passages are dealt into shards of bounded size by their anchor. Reference passages of an anchor that
   has more words than an automaton may take are cut into windows, which are dealt by their words. A shard's suffix automaton holds all its
   passages, and each state the smallest doc_id of the passages that contain its strings. The shard's passages are
   streamed through it for matching statistics: at each word the state of the longest match gives, by way of suffix
   links, the state of the last 13 words and so the smallest document in which this window starts.
5. Spans. Windows that start in a smaller document are merged into maximal spans, and their words removed.

Defined results: a null or blank text has no words; texts of fewer than 13 words stay whole; null doc_ids come after
all others, each a row of its own of which none is smaller than another; rows that repeat a doc_id are one document for
windows, none smaller than another, and keep or lose their own words; an empty table gives an empty table; other columns
are not carried. Words are compared by 32-bit hashes, 13 in a row, after a 64-bit hash of their anchor; a row is known by
its doc_id and a 64-bit hash of its text.
"""

from __future__ import annotations

import hashlib
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.shared import drop_written, join_spread, read_table, written
from gneiss.llm.tokenizer import text_blocks
from gneiss.llm.words import gram_hashes, word_hashes

WINDOW, GRAM = 13, 6
#: Words of reference passages in one shard: its automaton has at most twice as many states.
SHARD_WORDS = 100_000
#: An anchor with more than so many shards' words is cut; an automaton of as many takes under 200 MB.
CROWDED = 4
#: Up to so many ids (under 20 MB) are broadcast to pick out texts; beyond, texts are shuffled.
BROADCAST_IDS = 500_000
LAST = (1 << 63) - 1


def window_anchors(hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """The anchor of the window that begins at each word, for all but the last window - 1 words."""
    grams = gram_hashes(hashes, gram)
    width, low = window - gram + 1, grams
    done = 1
    while done < width:
        step = min(done, width - done)
        low = np.minimum(low[:-step], low[step:]) if len(low) > step else low[:0]
        done += step
    return low.view(np.int64)


class SuffixAutomaton:
    """Of several sequences; each state keeps the smallest owner of the sequences that contain its strings."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.owner = [-1], [0], [LAST]

    def add(self, sequence: list[int], owner: int) -> None:
        nexts, link, length, owners = self.next, self.link, self.length, self.owner
        last = 0
        for x in sequence:
            q = nexts[last].get(x)
            if q is not None:
                if length[q] != length[last] + 1:
                    q = self._clone(last, x, q)
                last = q
            else:
                nexts.append({})
                new = len(nexts) - 1
                length.append(length[last] + 1)
                owners.append(LAST)
                link.append(0)
                p = last
                while p != -1 and x not in nexts[p]:
                    nexts[p][x] = new
                    p = link[p]
                if p != -1:
                    q = nexts[p][x]
                    link[new] = q if length[q] == length[p] + 1 else self._clone(p, x, q)
                last = new
            if owner < owners[last]:
                owners[last] = owner

    def _clone(self, p: int, x: int, q: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        nexts.append(dict(nexts[q]))
        clone = len(nexts) - 1
        length.append(length[p] + 1)
        link.append(link[q])
        self.owner.append(LAST)
        link[q] = clone
        while p != -1 and nexts[p].get(x) == q:
            nexts[p][x] = clone
            p = link[p]
        return clone

    def close(self) -> None:
        """Hands owners on from longer strings to their suffixes; to be called after the last add."""
        for s in np.argsort(np.array(self.length), kind="stable")[:0:-1].tolist():
            p = self.link[s]
            if self.owner[s] < self.owner[p]:
                self.owner[p] = self.owner[s]

    def least_owners(self, sequence: list[int], window: int) -> list[int]:
        """For each window of sequence the smallest owner of a sequence that contains it, LAST if there is none."""
        nexts, link, length, owners = self.next, self.link, self.length, self.owner
        state, matched, found = 0, 0, []
        for i, x in enumerate(sequence):
            while state and x not in nexts[state]:
                state = link[state]
                matched = length[state]
            if x in nexts[state]:
                state = nexts[state][x]
                matched += 1
            while length[link[state]] >= window if state else False:
                state = link[state]
                matched = length[state]
            if i >= window - 1:
                found.append(owners[state] if matched >= window else LAST)
        return found


def _texts(docs: DataFrame) -> DataFrame:
    """id, row (a hash of the text) and text of each row; id and row together stand for a row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text).alias("row"), text.alias("text"))


ROW = ["id", "row"]


def _blocks(batch: pa.RecordBatch):
    texts = batch.column("text").cast(pa.binary())
    for a, b in text_blocks(texts):
        yield a, b, texts.slice(a, b - a).to_pylist()


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """id, row, n_words, the digest of all words, and the distinct anchors of each row."""

    def run(batches):
        for batch in batches:
            for a, b, texts in _blocks(batch):
                hashes, at = word_hashes(texts)
                low = window_anchors(hashes, window, gram)
                anchors = [np.unique(low[i : j - window + 1]) if j - i >= window else low[:0] for i, j in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ROW), pa.array(np.diff(at), pa.int64()), pa.array([_sha(t.split()) for t in texts]), pa.array(anchors, pa.list_(pa.int64()))], [*ROW, "n_words", "sha", "anchors"])

    return _texts(docs).mapInArrow(run, "id long, row long, n_words long, sha string, anchors array<long>")


def _passages(docs: DataFrame, repeated: DataFrame, window: int, gram: int) -> DataFrame:
    """id, row, start, anchor and words of each run of windows that share a repeated anchor; repeated has id, row and anchors."""
    schema = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("anchor", pa.int64()), ("words", pa.binary())])

    def run(batches):
        for batch in batches:
            for a, _, texts in _blocks(batch):
                hashes, at = word_hashes(texts)
                low, short = window_anchors(hashes, window, gram), hashes.astype(np.uint32)
                for i, text_start in enumerate(at[:-1].tolist()):
                    n = int(at[i + 1]) - text_start - window + 1
                    if n <= 0:
                        continue
                    own = low[text_start : text_start + n]
                    hit = np.isin(own, np.array(batch.column("anchors")[a + i].as_py(), np.int64))
                    edge = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1])]))
                    starts, ends = edge, np.append(edge[1:], n)
                    chosen = hit[starts]
                    starts, ends = starts[chosen], ends[chosen]
                    if len(starts):
                        raw = short[text_start : text_start + n + window - 1].tobytes()
                        words = [raw[4 * x : 4 * (y + window - 1)] for x, y in zip(starts.tolist(), ends.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(starts), batch.column(c)[a + i].as_py()), pa.int64()) for c in ROW), pa.array(starts, pa.int64()), pa.array(own[starts], pa.int64()), pa.array(words, pa.binary())], schema=schema)

    return _texts(_chosen(docs, repeated)).join(repeated, ROW).mapInArrow(run, "id long, row long, start long, anchor long, words binary")


def _least(reference: DataFrame, deal: str, window: int) -> DataFrame:
    """key, anchor and owners (for each window of the passage the smallest id in which it starts) of each reference passage, dealt by deal."""
    schema = pa.schema([("key", pa.int64()), ("anchor", pa.int64()), ("owners", pa.list_(pa.int64()))])
    size = reference.agg(F.sum(F.length("words"))).first()[0] or 0
    shards = max(1, ceil(size / 4 / SHARD_WORDS))

    def run(table: pa.Table) -> pa.Table:
        automaton = SuffixAutomaton()
        passages = [np.frombuffer(w, np.uint32).tolist() for w in table.column("words").to_pylist()]
        for passage, owner in zip(passages, table.column("owner").to_pylist(), strict=True):
            automaton.add(passage, owner)
        automaton.close()
        owners = [automaton.least_owners(p, window) for p in passages]
        return pa.Table.from_arrays([*(table.column(c).combine_chunks() for c in ("key", "anchor")), pa.array(owners, pa.list_(pa.int64()))], schema=schema)

    return reference.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), deal), F.lit(shards))).groupBy("shard").applyInArrow(run, "key long, anchor long, owners array<long>")


def _owners(reference: DataFrame, window: int) -> DataFrame:
    """As _least, with the passages of crowded anchors cut into windows."""
    crowded = reference.groupBy("anchor").agg(F.sum(F.length("words")).alias("size")).filter(F.col("size") > 4 * CROWDED * SHARD_WORDS).select("anchor")
    # At most one anchor for each SHARD_WORDS words of the reference, so their number is checked before a broadcast.
    n = crowded.limit(BROADCAST_IDS + 1).count()
    if n == 0:
        return _least(reference, "anchor", window)
    crowded = F.broadcast(crowded) if n <= BROADCAST_IDS else crowded
    every = F.sequence(F.lit(0), (F.length("words") / 4).cast("int") - window)
    cut = F.transform(every, lambda i: F.struct(i.alias("i"), F.col("words").substr(i * 4 + 1, F.lit(4 * window)).alias("words")))
    rows = reference.join(crowded, "anchor", "left_semi").select("key", "anchor", "owner", F.explode(cut).alias("w")).select("key", "anchor", "owner", "w.*")
    rows = rows.withColumn("window", F.xxhash64("anchor", "words"))
    windows = written(rows.groupBy("window", "anchor", "words").agg(F.min("owner").alias("owner")).withColumnRenamed("window", "key"), "windows")
    least = _least(windows, "key", window).select(F.col("key").alias("window"), "anchor", F.col("owners")[0].alias("least"))
    found = rows.select("key", "anchor", "i", "window").join(least, ["window", "anchor"]).groupBy("key", "anchor").agg(F.array_sort(F.collect_list(F.struct("i", "least"))).alias("w"))
    found = found.select("key", "anchor", F.transform("w", lambda w: w["least"]).alias("owners"))
    return _least(reference.join(crowded, "anchor", "left_anti"), "anchor", window).unionByName(found)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row of docs; with texts also kept_text, the words that stay."""
    rows = written(_anchors(docs, window, gram), "anchors")
    copies = rows.groupBy("sha").agg(F.min(F.struct(*ROW)).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = copies.select("sha", F.col("first.id").alias("first_id"), F.col("first.row").alias("first_row"))
    few = F.broadcast(copies) if copies.limit(BROADCAST_IDS // 2 + 1).count() <= BROADCAST_IDS // 2 else copies
    rows_of = rows.join(few, "sha", "left").withColumns({"first_id": F.coalesce("first_id", "id"), "first_row": F.coalesce("first_row", "row")})
    firsts = rows_of.filter("id = first_id and row = first_row")

    every = firsts.select(*ROW, F.explode("anchors").alias("anchor"))
    several = every.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n")).filter("low < high")
    several = written(several.select("anchor", "n"), "anchor-counts")
    shared = join_spread(every, several.select("anchor"), several, ["anchor"], "n", rows.count(), "row")
    repeated = written(shared.groupBy(*ROW).agg(F.collect_set("anchor").alias("anchors")), "repeated-anchors")
    # Only what the result needs stays on disk besides the repeated anchors.
    rows_of = written(rows_of.select("id", "row", "n_words", "sha", "first_id", "first_row"), "whole-rows")
    drop_written(rows, several)

    found = written(_passages(docs, repeated, window, gram).withColumn("key", F.xxhash64("anchor", "words")), "passages")
    drop_written(repeated)
    reference = written(found.groupBy("key", "anchor", "words").agg(F.min("id").alias("owner"), F.count(F.lit(1)).alias("n")), "reference")
    least = written(_owners(reference, window), "least-owners")
    counts = reference.groupBy("key", "anchor").agg(F.sum("n").alias("n"))
    hits = join_spread(found.select(*ROW, "start", "key", "anchor"), least, counts, ["key", "anchor"], "n", found.count(), "row")
    hits = hits.select(*ROW, F.expr("transform(filter(transform(owners, (o, i) -> struct(o as owner, i as i)), x -> x.owner < id), x -> start + x.i)").alias("starts")).filter(F.size("starts") > 0)
    # Rows of one id and text give equal lists: a set of lists, not a list of all.
    hits = written(hits.groupBy(*ROW).agg(F.flatten(F.collect_set("starts")).alias("starts")), "repeats")
    drop_written(found, reference, least)

    def run(batches):
        for batch in batches:
            out = []
            for text, starts in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("starts"), strict=True):
                words = text.split()
                # 1 where a window begins, -1 behind its end: the running sum is above 0 on the spans that go.
                change = np.zeros(len(words) + 1, np.int64)
                starts = np.unique(starts.values.to_numpy(zero_copy_only=False))
                np.add.at(change, starts, 1)
                np.add.at(change, starts + window, -1)
                stays = np.cumsum(change)[:-1] == 0
                kept = [words[i] for i in np.flatnonzero(stays).tolist()]
                out.append((len(words) - len(kept), _sha(kept), b" ".join(kept).decode() if texts else None))
            columns = [*(batch.column(c) for c in ROW), *(pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string())))]
            yield pa.RecordBatch.from_arrays(columns, ["first_id", "first_row", "cut", "cut_sha", "cut_text"])

    schema = "first_id long, first_row long, cut long, cut_sha string, cut_text string"
    cut = _texts(_chosen(docs, hits)).join(hits, ROW).mapInArrow(run, schema)
    cut = (cut if texts else cut.drop("cut_text")).dropDuplicates(["first_id", "first_row"])
    if texts:
        plain = F.array_join(F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0)), " ")
        own = rows_of.dropDuplicates(ROW).withColumnRenamed("id", "_id").withColumnRenamed("row", "_row")
        rows_of = _texts(docs).join(own, (F.col("id") == F.col("_id")) & (F.col("row") == F.col("_row"))).withColumn("plain", plain)
    later = F.col("id") > F.col("first_id")
    gone = later & (F.col("n_words") >= window)
    # Copies with a larger id than their first one need no join.
    parts = [rows_of.filter(later).withColumns({c: F.lit(None).cast(cut.schema[c].dataType) for c in cut.columns[2:]}), rows_of.filter(~later).join(cut, ["first_id", "first_row"], "left")]
    out = parts[0].unionByName(parts[1])
    columns = [
        F.when(F.col("id") != LAST, F.col("id")).alias("doc_id"),
        "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("cut", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(gone, F.lit(_sha([]))).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
    ]
    return out.select(*columns, *[F.when(gone, F.lit("")).otherwise(F.coalesce("cut_text", "plain")).alias("kept_text")] * texts)


def _chosen(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs narrowed to the ids of a written table before any shuffle, where they are few enough to be broadcast."""
    if rows.count() > BROADCAST_IDS:
        return docs
    return docs.join(F.broadcast(rows.select(F.col("id").alias("_id")).distinct()), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)) == F.col("_id"), "left_semi")


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"))


QUERIES = {"op10_substrings": op10_substrings}
#: Windows as strings of 13 words joined by U+001F, which no word that the tables hold contains.
ORACLE_SQL = {
    "op10_substrings": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
g AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 12], chr(31))) AS h FROM s),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS low FROM g),
r AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 13)))) AS gone FROM f WHERE low < doc_id GROUP BY doc_id),
k AS (SELECT d.doc_id, d.w, list_filter(range(1, len(d.w) + 1), lambda i: r.gone IS NULL OR NOT list_contains(r.gone, i)) AS stays FROM d LEFT JOIN r ON d.doc_id = r.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - len(stays))::BIGINT AS n_removed, sha256(array_to_string(list_transform(stays, lambda i: w[i]), ' ')) AS kept_sha256 FROM k
"""
}
