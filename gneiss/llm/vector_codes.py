"""Compression of vectors to codes of integer codebooks.

Vectors become integers, floor(4096 * x), and are cut into 8 equal consecutive parts; each part position has a codebook
of 16 entries, at first those parts of the 16 smallest ids. In each round the codebooks go to the tasks as a broadcast.
There, batches of rows are compared with all entries at once: |x|^2 - 2 x c + |c|^2 from exact integer matrix products,
and the first of the nearest entries is taken. Each task adds up the parts of each entry and emits one row for each
component of an entry; a grouped shuffle adds the tasks' rows up, and the driver gets sums and counts of the codebooks,
16 x the length of a vector, whatever the number of rows. Rows themselves move only to be summed by label, where a label
that holds many rows is joined by broadcast. Integer vectors are written once and read in each round.

Defined results: rows whose vector is null or holds a null or non-finite component are dropped; vectors are filled up
with 0 to the longest length, and that to a multiple of 8; ids order as numbers, null last, and rows of one id by their
integers; with fewer than 16 rows a codebook has as many entries; components and errors stop at the ends of a long; an
empty table gives an empty one; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.shared import drop_written, join_hot, read_table, written
from gneiss.llm.tiles import dense
from gneiss.llm.topk import LONGS, integer_vectors

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Bytes of components that are compared with a codebook at a time.
BATCH_BYTES = 8 << 20


def assigned(x: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the first of the nearest entries, and its squared distance."""
    distance = (codebook * codebook).sum(axis=1)[None, :] - 2 * (x @ codebook.T)
    nearest = distance.argmin(axis=1)
    return nearest, (x * x).sum(axis=1) + distance[np.arange(len(x)), nearest]


def parts_of(lists: pa.Array, parts: int, width: int, kind: type) -> Iterator[tuple[slice, np.ndarray]]:
    """Blocks of rows as a slice and an array of row, part and component."""
    step = max(1, BATCH_BYTES // (8 * parts * width))
    for a in range(0, len(lists), step):
        x = dense(lists[a : a + step], parts * width).astype(kind)
        yield slice(a, a + len(x)), x.reshape(len(x), parts, width)


def summed(batches: Iterator[pa.RecordBatch], codebooks: np.ndarray) -> Iterator[pa.RecordBatch]:
    """part, entry, position, total and members: of all rows of a task, a row for each component of an entry that has any."""
    parts, entries, width = codebooks.shape
    sums, members = np.zeros(codebooks.shape, codebooks.dtype), np.zeros((parts, entries), np.int64)
    for batch in batches:
        for _, x in parts_of(batch.column("v"), parts, width, codebooks.dtype.type):
            for p in range(parts):
                nearest, _ = assigned(x[:, p], codebooks[p])
                np.add.at(sums[p], nearest, x[:, p])
                members[p] += np.bincount(nearest, minlength=entries)
    p, e, i = (a.ravel() for a in np.indices(sums.shape))
    keep = members[p, e] > 0
    p, e, i = p[keep], e[keep], i[keep]
    totals = pa.array([Decimal(int(t)) for t in sums[p, e, i]], pa.decimal128(38, 0))
    yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(i, pa.int32()), totals, pa.array(members[p, e], pa.int64())], names=["part", "entry", "position", "total", "members"])


def coded(batches: Iterator[pa.RecordBatch], codebooks: np.ndarray) -> Iterator[pa.RecordBatch]:
    """vec_id, label, code and error of each row."""
    parts, _, width = codebooks.shape
    for batch in batches:
        for rows, x in parts_of(batch.column("v"), parts, width, codebooks.dtype.type):
            codes, error = np.empty((len(x), parts), np.uint8), np.zeros(len(x), codebooks.dtype)
            for p in range(parts):
                codes[:, p], distance = assigned(x[:, p], codebooks[p])
                error = error + distance
            text = codes.tobytes().hex()
            own = batch.slice(rows.start, len(x))
            columns = [own.column("vec_id"), own.column("label"), pa.array([text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)], pa.string()), pa.array([min(LONGS[1], int(e)) for e in error], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error"])


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks as an array of part, entry and position; None where there are no rows. rows: vec_id and integer v, written."""
    spark = rows.sparkSession
    ends = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"), F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high")).first()
    if not ends["n"]:
        return None
    width = max(1, -(-ends["dim"] // parts))
    largest = max(abs(ends["low"] or 0), abs(ends["high"] or 0))
    # Where squares or sums might leave 64 bits, Python's integers take their place.
    kind = np.int64 if 4 * largest * largest * width * parts < 1 << 62 and largest * ends["n"] < 1 << 62 else object
    seeds = rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    codebooks = np.array([r["v"] + [0] * (parts * width - len(r["v"])) for r in seeds], kind).reshape(len(seeds), parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(codebooks)
        sums = rows.select("v").mapInArrow(lambda batches, sent=sent: summed(batches, sent.value), "part int, entry int, position int, total decimal(38,0), members long")
        found = sums.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("members").alias("members")).collect()
        codebooks = codebooks.copy()
        for r in found:
            codebooks[r["part"], r["entry"], r["position"]] = int(r["total"]) // r["members"]
        sent.unpersist()
    return codebooks


def fingerprint(codebooks: np.ndarray) -> str:
    return sha256(",".join(str(int(x)) for x in codebooks.ravel()).encode()).hexdigest()


def encode(rows: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """vec_id, label, code and error of rows, which hold vec_id, label and integer v."""
    sent = rows.sparkSession.sparkContext.broadcast(codebooks)
    label = rows.schema["label"].dataType.simpleString()
    return rows.select("vec_id", "label", "v").mapInArrow(lambda batches: coded(batches, sent.value), f"vec_id long, label {label}, code string, error long")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of all vectors that take part."""
    rows = written(integer_vectors(vectors, scale, vector, F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label")), "code-vectors")
    codebooks = train(rows, parts, entries, rounds)
    if codebooks is None:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    codes = written(encode(rows, codebooks).withColumn("_label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))), "codes")
    drop_written(rows)
    sums = codes.groupBy("_label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error"), F.count(F.lit(1)).alias("n"))
    sums = written(sums.select("_label", "n", F.least("label_error", F.lit(LONGS[1]).cast("decimal(38,0)")).cast("long").alias("label_error")), "label-errors")
    return join_hot(codes, sums, "_label", "n", codes.count()).select("vec_id", "label", "code", "error", "label_error", F.lit(fingerprint(codebooks)).alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(read_table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _sql() -> str:
    """The rounds one after another: components (u), entries (c), assignments (a)."""
    steps = [
        f"r AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS n, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "f AS (SELECT n, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i, len(v) AS dim FROM r)",
        f"u AS MATERIALIZED (SELECT n, (i // (dim // {PARTS}))::INT AS p, (i % (dim // {PARTS}))::INT AS i, x FROM f)",
        f"c0 AS MATERIALIZED (SELECT p, (n - 1)::INT AS e, i, x AS c FROM u WHERE n <= {ENTRIES})",
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"d{i} AS (SELECT n, p, e, sum((x - c) * (x - c))::BIGINT AS d FROM u JOIN c{i} USING (p, i) GROUP BY n, p, e)")
        steps.append(f"a{i} AS MATERIALIZED (SELECT n, p, min(d) AS d, min({{'d': d, 'e': e}}).e AS e FROM d{i} GROUP BY n, p)")
        if i < ROUNDS:
            steps.append(f"m{i} AS (SELECT p, e, i, floor(sum(x) / count(*))::BIGINT AS c FROM u JOIN a{i} USING (n, p) GROUP BY p, e, i)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT p, e, i, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (p, e, i))")
    return (
        "WITH " + ",\n".join(steps) + f",\nk AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, i)) AS s FROM c{ROUNDS}),\n"
        f"o AS (SELECT n, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY n)\n"
        "SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s AS codebooks_sha256 FROM r JOIN o USING (n), k"
    )


QUERIES = {"op12_vector_codes": op12_vector_codes}
ORACLE_SQL = {"op12_vector_codes": _sql()}
