"""What a task of a Python worker leaves behind."""

from gneiss.llm import bpe, shared


def test_a_task_gives_memory_back_when_its_own_is_free(monkeypatch):
    seen = []

    class Cache:
        def __del__(self):
            seen.append("freed")

    def run(batches):
        cache = Cache()
        for x in batches:
            yield x + 1, cache is not None

    monkeypatch.setattr(shared, "_give_back", lambda: seen.append("given back"))
    assert [x for x, _ in shared.giving_back(run)(iter([1, 2]))] == [2, 3]
    assert seen == ["freed", "given back"]


def test_encoding_tasks_give_back(spark, monkeypatch):
    given = []
    monkeypatch.setattr(bpe, "giving_back", lambda run: given.append(run) or run)
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    bpe.encode_documents(docs)
    bpe.encode_digests(docs)
    assert len(given) == 2
