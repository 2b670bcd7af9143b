"""Token ids in flat binary files.

A data set is a folder: for each part a .bin file of ids (unsigned integers of one width, nothing else), an .idx file of
64-bit offsets (one more than documents, counted in ids from the part's start), a .doc file of 64-bit document ids, and
one manifest.json that lists the parts in order with their bases: the ids and documents of all parts before, from prefix
sums of the parts' counts. Documents are in ascending doc_id, so a range partitioning and a sort within partitions do;
each task encodes its texts and writes its own part under a name of its own, and only parts that the write stage returned
are in the manifest, so failed or repeated attempts leave nothing that is read. Readers map .bin and .idx into memory
where the store is a file system of their machine, and read the files from another store.

Texts move, not ids: compressed, both take about as much in the shuffle, and ids would have to be written once more.

Defined results: a null text counts as empty: the end id alone; a null doc_id comes first and is stored as -2**63; rows
that repeat a doc_id are in the order of a hash of their texts, and may fall into several parts; an empty table gives a
manifest without parts; other columns are not carried.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.shared import local_path, new_path, read_table, written
from gneiss.llm.tokenizer import BlankEncoder, text_blocks

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
NULL_ID = -(1 << 63)

#: Bytes of text that are encoded together.
BLOCK = 2 << 20

_encoders: dict[tuple, BlankEncoder] = {}


def _encoder(vocabulary: str, dtype: str) -> BlankEncoder:
    """One for each worker, vocabulary and width, kept between tasks."""
    if (key := (vocabulary, dtype)) not in _encoders:
        _encoders[key] = BlankEncoder(vocabulary, dtype)
    return _encoders[key]


def _store(folder: str):
    """(file system, path) of the shared folder."""
    from pyarrow import fs

    path = local_path(folder)
    return (fs.LocalFileSystem(), path) if path else fs.FileSystem.from_uri(folder)


def _put(folder: str, name: str, data) -> None:
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/{name}") as out:
        out.write(data)


def _array(folder: str, name: str, dtype: str) -> np.ndarray:
    """A file as an array: mapped into memory, or read where the store isn't a file system of this machine."""
    store, path = _store(folder)
    if local_path(folder):
        return np.memmap(f"{path}/{name}", dtype, "r") if os.path.getsize(f"{path}/{name}") else np.zeros(0, dtype)
    with store.open_input_file(f"{path}/{name}") as f:
        return np.frombuffer(f.read(), dtype)


def write_token_files(docs: DataFrame, folder: str | None = None, vocabulary: str = VOCABULARY, end_id: int = END_ID, dtype: str = "<u2") -> str:
    """Writes the ids of all texts to folder (by default a new one in the shared folder) and returns it. dtype has to hold every id."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # A hash beside doc_id, so that many rows of one doc_id needn't share a task.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("_hash"), text.alias("text"))
    rows = rows.repartitionByRange("doc_id", "_hash").sortWithinPartitions("doc_id", "_hash").select("doc_id", "text")

    def run(batches):
        encoder, name = _encoder(vocabulary, dtype), f"part-{uuid.uuid4().hex}"
        store, path = _store(folder)
        store.create_dir(path, recursive=True)
        ids_of, lengths = [], []
        with store.open_output_stream(f"{path}/{name}.bin") as out:
            for batch in batches:
                texts = batch.column("text")
                ids_of.append(batch.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False))
                for a, b in text_blocks(texts, BLOCK):
                    ids, counts = encoder.encode(texts.slice(a, b - a), end_id)
                    lengths.append(counts)
                    out.write(ids.tobytes())
        lengths = np.concatenate([*lengths, np.zeros(0, np.int64)])
        if not len(lengths):
            store.delete_file(f"{path}/{name}.bin")
            return
        _put(folder, f"{name}.idx", np.concatenate([[0], np.cumsum(lengths)]).astype("<u8").tobytes())
        _put(folder, f"{name}.doc", np.concatenate(ids_of).astype("<i8").tobytes())
        yield pa.RecordBatch.from_pydict({"at": [TaskContext.get().partitionId()], "name": [name], "docs": [len(lengths)], "tokens": [int(lengths.sum())]}, pa.schema([("at", pa.int32()), ("name", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    # One row for each part, so what comes to the driver grows with the number of partitions only.
    parts = [r.asDict() for r in written(rows.mapInArrow(run, "at int, name string, docs long, tokens long"), "token-parts").orderBy("at").collect()]
    for what in ("docs", "tokens"):
        for part, base in zip(parts, accumulate((p[what] for p in parts), initial=0), strict=False):
            part[f"first_{what}"] = base
    _put(folder, "manifest.json", json.dumps({"dtype": dtype, "end_id": end_id, "parts": parts}).encode())
    return folder


def read_manifest(folder: str) -> dict:
    return json.loads(_array(folder, "manifest.json", "u1").tobytes())


def read_token_files(spark: SparkSession, folder: str, digests: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids (array of long), or with digests ids_crc32 in place of ids, for each document in folder."""
    manifest = read_manifest(folder)
    dtype = manifest["dtype"]
    schema = "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digests else "ids array<long>")
    parts = spark.createDataFrame([(p["name"], p["first_tokens"]) for p in manifest["parts"]], "name string, base long")

    def run(batches):
        for batch in batches:
            for part in batch.to_pylist():
                ids, offsets, doc = (_array(folder, f"{part['name']}.{x}", t) for x, t in (("bin", dtype), ("idx", "<u8"), ("doc", "<i8")))
                offsets = offsets.astype(np.int64)
                for i in range(0, len(doc), 1000):
                    own, ends = doc[i : i + 1000], offsets[i : i + 1001]
                    spans = [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                    last = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in spans], pa.int64()) if digests else pa.array([x.astype(np.int64) for x in spans], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.asarray(own), pa.int64(), mask=np.asarray(own) == NULL_ID), pa.array(ends[:-1] + part["base"]), pa.array(np.diff(ends)), last], ["doc_id", "start", "n_tokens", "ids_crc32" if digests else "ids"])

    return parts.repartition(max(1, len(manifest["parts"]))).mapInArrow(run, schema)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(spark, write_token_files(read_table(spark, sf_dir, "documents")), digests=True)


QUERIES = {"op9_token_files": op9_token_files}
ORACLE_SQL: dict[str, str] = {}
