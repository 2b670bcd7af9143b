"""The segmented index against an index of all texts, and what its searches read."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gneiss.operators import lexical, segments

WORDS = [f"w{i}" for i in range(60)] + ["common"] * 40


def texts(seed, ids):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(WORDS, k=rng.randint(0, 60))), rng.choice(["text", "python", None])) for i in ids]


SCHEMA = "chunk_id long, code string, language string"


def direct(spark, rows, query, language=None, k=10):
    """chunk_id and score of a search of the texts themselves."""
    frame = spark.createDataFrame(rows, SCHEMA)
    tokenised = lexical.doc_tokens(frame, F.coalesce("language", F.lit("code")))
    found = lexical.search(tokenised, query.split(), keep=("language",))
    found = found if language is None else found.filter(F.col("language") == language)
    return [(r["chunk_id"], r["score"]) for r in lexical.top(found, k).collect()]


def searched(index, query, language=None, k=10):
    return [(r["chunk_id"], r["score"]) for r in index.search(query, language, k).collect()]


def test_changes_equal_a_full_build(spark, tmp_path):
    now = {r[0]: r for r in texts(1, range(300))}
    index = segments.SegmentIndex.build(spark.createDataFrame(list(now.values()), SCHEMA), str(tmp_path / "i"))
    rng = random.Random(4)
    for step in range(7):
        changed = texts(10 + step, rng.sample(range(330), 12 if step % 2 else 1))
        gone = [i for i in rng.sample(sorted(now), 9 if step % 3 == 0 else 0) if i not in {r[0] for r in changed}]
        before = {s["folder"] for s in index._segments()}
        index._change(spark.createDataFrame(changed, SCHEMA), spark.createDataFrame([(i,) for i in gone] or [(10**6,)], "chunk_id long"))
        after = index._segments()
        assert len({s["folder"] for s in after} - before) == 1 and after[-1]["rows"] == len(changed)
        while (run := index._due()) is not None:
            index._merge(run)
        now = {i: r for i, r in now.items() if i not in gone} | {r[0]: r for r in changed}
        rows = list(now.values())
        assert len(index._segments()) < segments.FAN + 3
        assert sum(s["docs"] for s in index._segments()) == len(rows)
        for query, language in (("common w3 w7", None), ("w5 w5 w9", "python")):
            assert searched(index, query, language) == direct(spark, rows, query, language)
    whole = segments.SegmentIndex.build(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "whole"))
    assert sorted(map(tuple, index.terms().collect())) == sorted(map(tuple, whole.terms().collect()))
    assert index.stats().first() == whole.stats().first()
    assert sorted(r["chunk_id"] for r in index.docs().select("chunk_id").collect()) == sorted(now)


def test_hot_terms_are_many_blocks_and_most_are_skipped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "BUCKET", 16)
    monkeypatch.setattr(segments, "FIRST_BUCKETS", 4)
    rng = random.Random(2)
    rows = [(i, " ".join(["common"] * rng.randint(1, 3) + rng.choices(WORDS[:60], k=rng.randint(2, 80)) + ["rare"] * (i % 500 == 0)), "text") for i in range(3000)]
    index = segments.SegmentIndex.build(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "i"))
    blocks = index._of(index._segments(), "blocks", segments.BLOCKS).filter("term = 'common'")
    assert blocks.count() >= 3000 / 16 and blocks.agg(F.max(F.size("chunk_ids"))).first()[0] <= 16
    assert searched(index, "common") == direct(spark, rows, "common")
    assert segments.skipped_share(index) > 0.5, index.read
    assert searched(index, "rare common w1") == direct(spark, rows, "rare common w1")
    assert searched(index, "common w1 w2", k=40) == direct(spark, rows, "common w1 w2", k=40)


def test_empty_and_odd_indexes(spark, tmp_path):
    index = segments.SegmentIndex.build(spark.createDataFrame([], SCHEMA), str(tmp_path / "i"))
    assert index.search("a word").count() == 0 and index.stats().first()["doc_count"] == 0
    index.update(spark.createDataFrame([(1, None, None), (2, "", "text"), (3, "one word", "text")], SCHEMA))
    assert searched(index, "word")[0][0] == 3 and index.search("").count() == 0 and index.search("absent").count() == 0
    index.update(None, spark.createDataFrame([(3,), (3,), (77,)], "chunk_id long"))
    assert index.search("word").count() == 0 and index.stats().first()["doc_count"] == 2
    with pytest.raises(FileNotFoundError):
        segments.SegmentIndex(spark, str(tmp_path / "none")).search("a")


def test_two_writers_both_count(spark, tmp_path):
    a = segments.SegmentIndex.build(spark.createDataFrame(texts(1, range(20)), SCHEMA), str(tmp_path / "i"))
    commit, late = a.versions.commit, []

    def other_first(number, state):
        if not late:
            late.append(1)
            segments.SegmentIndex(spark, a.path).update(spark.createDataFrame([(50, "second writer", "text")], SCHEMA))
        return commit(number, state)

    a.versions.commit = other_first
    a.update(spark.createDataFrame([(51, "first writer", "text")], SCHEMA))
    assert {i for i, _ in searched(a, "writer")} == {50, 51} and a.stats().first()["doc_count"] == 22


def test_python_workers_hold_few_postings(spark):
    """Slices of long documents make blocks of whole buckets, a few at a time; all in one batch, before, were one."""
    kinds = {"chunk_id": pa.int64(), "language": pa.string(), "doc_len": pa.int32(), "terms": pa.list_(pa.string()), "tfs": pa.list_(pa.int32()), "part": pa.int32(), "place": pa.int64()}
    docs = [[i, "text" if i < 30 else None, 9, [f"t{j}" for j in range(part, part + 5)], [1 + i % 3] * 5, 2, i // 8] for i in range(60) for part in (0, 5)]
    batches = [pa.RecordBatch.from_pydict({n: [r[c] for r in docs[a : a + 25]] for c, n in enumerate(kinds)}, pa.schema(kinds)) for a in range(0, 120, 25)]
    made = list(segments.blocked(iter(batches), 100))
    assert len(made) > 3 and max(sum(map(len, b.column("chunk_ids").to_pylist())) for b in made) <= 100 + 80
    rows = [r for b in made for r in b.to_pylist()]
    assert sorted((r["term"], i) for r in rows for i in r["chunk_ids"]) == sorted((f"t{j}", i) for i in range(60) for j in range(10))
    assert len({(r["term"], r["bucket"]) for r in rows}) == len(rows) == 10 * 9
    assert {r["bucket"] >> 40 for r in rows} == {2} and all((r["language"] is None) == (min(r["chunk_ids"]) >= 30) for r in rows)


def test_terms_are_counted_without_a_worker(spark):
    rows = spark.createDataFrame([(1, ["b", "é", "b"]), (None, ["c"]), (3, []), (4, None)], "chunk_id long, tokens array<string>")
    found = lexical.term_frequency(rows)
    assert sorted(map(tuple, found.collect()), key=str) == sorted([("b", 1, 2), ("é", 1, 1), ("c", None, 1)], key=str)
    assert "InArrow" not in found._jdf.queryExecution().executedPlan().toString()


def test_texts_are_read_once_and_words_of_removed_documents_not_kept(spark, tmp_path):
    """Parting documents by range, before, made them twice, first for a sample; words of removed documents were joined by shuffle and written."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = texts(1, range(90))
    index = segments.SegmentIndex.build(spark.createDataFrame(rows, SCHEMA).mapInArrow(counted, SCHEMA), str(tmp_path / "i"))
    assert seen.value == 90
    index.update(spark.createDataFrame(texts(2, range(40, 70)), SCHEMA).mapInArrow(counted, SCHEMA))
    assert seen.value == 120
    gone = spark.read.parquet(f"{index.path}/{index._segments()[-1]['folder']}/gone")
    assert gone.columns == ["chunk_id", "doc_len", "seq"] and sorted(r["chunk_id"] for r in gone.collect()) == list(range(40, 70))


@pytest.mark.parametrize("most", [0, 10**6])
def test_removed_documents_are_the_same_by_broadcast_and_by_shuffle(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(segments, "BROADCAST_ROWS", most)
    rows, more, last = texts(1, range(60)), texts(2, range(30, 80)), texts(3, range(50, 55))
    index = segments.SegmentIndex.build(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "i"))
    index.update(spark.createDataFrame(more, SCHEMA))
    index.update(None, spark.createDataFrame([(i,) for i in range(50, 60)], "chunk_id long"))
    index.update(spark.createDataFrame(last, SCHEMA))
    now = [r for r in rows if r[0] < 30] + [r for r in more if not 50 <= r[0] < 60] + last
    assert searched(index, "common w3 w7") == direct(spark, now, "common w3 w7")
    whole = segments.SegmentIndex.build(spark.createDataFrame(now, SCHEMA), str(tmp_path / "whole"))
    assert sorted(map(tuple, index.terms().collect())) == sorted(map(tuple, whole.terms().collect())) and index.stats().first() == whole.stats().first()
