"""The corpus pipeline: toxicity filter, exact and near deduplication, mixing to target weights, BPE encoding.

STAGES lists (name, function) in order. A function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. Each works on all that the stage before it kept, and its decisions take effect. run()
writes each stage's rows as Parquet in the shared folder and reads them again, as a cluster job does between stages.

Defined results: rows are judged by their texts, never merged by doc_id, so rows with null or repeated doc_ids go through
like others; a null or blank text counts as empty: it isn't toxic unless the model's bias says so, all such rows are one
group of exact copies, are linked with nothing, have size 0 and give no ids; a null source comes last in the mix; of equal
rows one stays in front of the mix; columns of any name pass through all stages but the last; empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import bpe, exact_dedup, minhash, mixing, toxicity
from gneiss.llm.shared import drop_written, read_table, written


#: Rows that go to a Python worker at a time: rows are whole texts, and both sides hold a batch's bytes more than once.
BATCH_ROWS = 500


def _whole_texts(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counterfactual-regularised classifier, fitted on the label table, doesn't reject."""
    _whole_texts(spark)
    return toxicity.keep_clean(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose texts are equal but for white space."""
    return exact_dedup.keep_first_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more over shingles of five words."""
    _whole_texts(spark)
    return minhash.keep_representatives(docs, shingle=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.emit_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every document of the mix."""
    _whole_texts(spark)
    return bpe.encode_documents(docs, decode=False).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("mixing", mix),
    ("bpe", encode),
]

#: SQL can express neither the classifier nor the encoding: see tests for the brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        following = written(stage(spark, docs, sf_dir), name, batch=BATCH_ROWS)
        if before is not None:
            drop_written(before)
        docs = before = following
    return STAGES[-1][1](spark, docs, sf_dir)
