"""Streams: state with timers, the watch source, progress, batches that come twice."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from gneiss.operators.catalog import Table
from gneiss.sources import watch
from gneiss.streaming import jobs, replay

COLUMNS = "event_id long, user string, at_us long"
SECOND = 1_000_000


@pytest.fixture
def rocks(spark):
    for k, v in jobs.STATE_STORE.items():
        spark.conf.set(k, v)
    yield spark
    for k in jobs.STATE_STORE:
        spark.conf.unset(k)


def streamed(spark, batches, make, folder):
    """What make gives for a stream of batches, one file each; a last event of another key lets the watermark pass all."""
    for i, rows in enumerate([*batches, [(-1, "end", 10**12)]]):
        spark.createDataFrame(rows, COLUMNS).coalesce(1).write.parquet(f"{folder}/in/{i:03}")
    stream = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    found = []
    replay.run_available(make(stream), lambda df, _: found.extend(df.collect()), f"{folder}/check")
    return sorted(tuple(r) for r in found if r["user"] != "end")


@pytest.mark.parametrize("seed", [0, 1])
def test_any_split_into_batches_equals_the_replay(rocks, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice("abc"), 3600 * SECOND + rng.randint(0, 60) * SECOND // 2) for i in range(120)]  # many ties
    shuffled = sorted(rows, key=lambda r: r[2] + rng.randint(0, 3 * SECOND))  # up to three seconds out of order
    cuts = sorted(rng.sample(range(1, len(rows)), 3))
    batches = [shuffled[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
    frame = rocks.createDataFrame(rows, COLUMNS)
    if seed:
        make, batch = (lambda df: replay.stream_debounce(df, ["user"], gap_us=2 * SECOND, late_us=4 * SECOND)), replay.debounce(frame, ["user"], gap_us=2 * SECOND)
    else:
        make, batch = (lambda df: replay.stream_rate_limit(df, "user", limit=3, window_us=5 * SECOND, late_us=4 * SECOND)), replay.rate_limit(frame, "user", limit=3, window_us=5 * SECOND)
    assert streamed(rocks, batches, make, str(tmp_path)) == sorted(map(tuple, batch.collect()))


def test_late_events_take_no_part_and_idle_keys_leave_no_state(rocks, tmp_path):
    batches = [[(1, "a", SECOND), (2, "b", 2 * SECOND)], [(3, "b", 100 * SECOND)], [(4, "a", SECOND), (5, "b", 101 * SECOND)], [(6, "c", 300 * SECOND)]]
    found = streamed(rocks, batches, lambda df: replay.stream_rate_limit(df, "user", limit=5, window_us=10 * SECOND), str(tmp_path))
    assert [r[0] for r in found] == [1, 2, 3, 5, 6]  # 4 was behind the watermark
    state = rocks.read.format("statestore").option("stateVarName", "kept").load(f"{tmp_path}/check")
    assert {r["key"]["user"] for r in state.select("key").collect()} <= {"end"}


def test_a_key_streams_past_its_rule(spark):
    rows = spark.range(30_000).select(F.col("id").alias("event_id"), F.lit("hot").alias("user"), (F.col("id") * 1000).alias("at_us")).repartition(3)
    found = replay.rate_limit(rows, "user", limit=10, window_us=SECOND)
    assert found.filter("accepted").count() == 300
    assert replay.debounce(rows, ["user"], gap_us=SECOND).count() == 30
    assert replay.debounce(rows.limit(0), ["user"]).count() == 0


def events_of(spark, root, folder, sink):
    table = Table(spark, sink)
    stream = watch.changes(spark, root, f"{folder}/state")
    replay.run_available(stream, lambda df, i: table.append(df, batch=("watch", i)), f"{folder}/check")
    return table


def test_tree_stream_goes_on_after_a_restart(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "src").mkdir(parents=True)
    (root / "src/a.py").write_text("a = 1\n")
    (root / "top.py").write_text("b = 1\n")
    (root / ".hidden").write_text("x")
    run = lambda: events_of(spark, str(root), str(tmp_path), f"{tmp_path}/sink")
    seen = lambda t, v: {(r["event_type"], r["file_path"]) for r in t.read().filter(F.col("version") == v).collect()}
    table = run()
    assert seen(table, 1) == {("created", "src/a.py"), ("created", "top.py")}
    (root / "src/a.py").write_text("a = 2, longer\n")
    (root / "top.py").unlink()
    (root / "new").mkdir()
    (root / "new/c.py").write_text("c\n")
    os.utime(root / "src/a.py")
    table = run()
    assert seen(table, 2) == {("modified", "src/a.py"), ("deleted", "top.py"), ("created", "new/c.py")}
    (root / "new/c.py").unlink()
    (root / "new").rmdir()
    table = run()
    assert seen(table, 3) == {("deleted", "new/c.py")} and table.read().count() == 6
    assert len(os.listdir(tmp_path / "state")) <= 2


def test_a_batch_that_is_read_again_gives_the_same_events(tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.py").write_text("one")
    options = {"path": str(root), "state": str(tmp_path / "state")}
    reader = watch.TreeReader(options)
    start, end = reader.initialOffset(), reader.latestOffset()
    first = [list(reader.read(p)) for p in reader.partitions(start, end)]
    (root / "a.py").write_text("other")
    again = watch.TreeReader(options)  # as after a restart
    assert [list(again.read(p)) for p in again.partitions(start, end)] == first and first == [[(1, "created", "a.py", "f97c5d29941bfb1b2fdab0874906ab82")]]
    after = again.latestOffset()
    assert [e[1] for p in again.partitions(end, after) for e in again.read(p)] == ["modified"]


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"))
    for batch in (0, 1, 1, 0, 2):
        table.append(spark.range(3), batch=("s", batch))
    table.append(spark.range(1), batch=("other", 0))
    assert table.read().count() == 10 and table.has_batch("s", 2) and not table.has_batch("s", 3)
    table.write(spark.range(5), batch=("s", 2))
    assert table.read().count() == 10
    # A writer that is stopped before its state is written leaves nothing that counts, and its batch can come again.
    with pytest.raises(ZeroDivisionError), table.version(("s", 3), append=True) as to:
        spark.range(100).write.parquet(to)
        1 / 0  # noqa: B018
    assert table.read().count() == 10
    assert table.append(spark.range(2), batch=("s", 3)).count() == 12


def test_two_writers_of_a_table(spark, tmp_path):
    a, b = Table(spark, str(tmp_path / "t")), Table(spark, str(tmp_path / "t"))
    a.write(spark.range(3))
    with a.version(append=True) as to:  # both begin before either ends
        spark.range(4).write.parquet(to)
        b.append(spark.range(5))
    assert a.read().count() == 12
    a.forget(1)
    assert a.read().count() == 12


def test_progress_of_streams_is_in_the_registry(spark, tmp_path):
    registry = jobs.Jobs()
    listener = registry.listen(spark)
    try:
        spark.range(7).coalesce(1).write.parquet(str(tmp_path / "in"))
        source = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        query = source.writeStream.queryName("copy").foreachBatch(lambda df, _: df.count()).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        broken = source.writeStream.foreachBatch(lambda df, _: 1 / 0).option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
        with pytest.raises(Exception, match="division"):
            broken.awaitTermination()
        for _ in range(100):
            done, failed = registry.get(str(query.runId)), registry.get(str(broken.runId))
            if done and failed and done["finished_at"] and failed["finished_at"]:
                break
            time.sleep(0.1)
        assert (done["kind"], done["status"], done["result"]["rows"], done["result"]["batch"]) == ("stream copy", "completed", 7, 0)
        assert failed["status"] == "failed" and "division" in failed["error"]
    finally:
        spark.streams.removeListener(listener)
