"""Incremental and stateful operators: snapshot differences, debouncing, rate limits."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StructField, StructType

from gneiss.functions import text


def snapshot_diff(before: DataFrame, after: DataFrame, deletions: bool = True) -> DataFrame:
    """event_type, file_path and file_hash between two states (file_path, file_hash): created, modified, deleted."""
    both = before.select("file_path", F.col("file_hash").alias("old")).join(after.select("file_path", F.col("file_hash").alias("new")), "file_path", "full_outer")
    kind = F.when(F.col("old").isNull(), "created").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified")
    out = both.select(kind.alias("event_type"), "file_path", F.coalesce("new", "old").alias("file_hash")).filter("event_type is not null")
    return out if deletions else out.filter("event_type <> 'deleted'")


def watched(files: DataFrame) -> DataFrame:
    return files.filter(~text.watch_ignored(F.col("file_path")))


class Gap:
    """Passes what comes gap_us or more after the last that passed."""

    def __init__(self, gap_us: int, kept: Iterable[int] = ()):
        self.span, self.kept = gap_us, deque(kept)

    def takes(self, t: int) -> bool:
        if self.kept and t - self.kept[0] < self.span:
            return False
        self.kept = deque([t])
        return True


class Quota:
    """Passes what has fewer than limit passed ones in the window_us before it; what doesn't pass doesn't count."""

    def __init__(self, window_us: int, limit: int, kept: Iterable[int] = ()):
        self.span, self.limit, self.kept = window_us, limit, deque(kept)

    def takes(self, t: int) -> bool:
        while self.kept and self.kept[0] <= t - self.span:
            self.kept.popleft()
        if len(self.kept) >= self.limit:
            return False
        self.kept.append(t)
        return True


def _order(events: DataFrame, key: list[str], at: str) -> list[str]:
    """Of equal times the first is the first in the order of the other columns."""
    return [at, *(c for c in events.columns if c not in (at, *key))]


def _accepted(events: DataFrame, key: list[str], at: str, rule: Callable[[], Gap | Quota]) -> DataFrame:
    """events with accepted, by a rule for each key. Acceptance feeds back, so a key's events are sorted, on disk where they are
    many, and stream past the rule in one task; memory holds what the rule keeps, not the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state = None, rule()
        for batch in batches:
            out = []
            for *now, t in zip(*(batch.column(c).to_pylist() for c in (*key, at)), strict=True):
                if now != own:
                    own, state = now, rule()
                out.append(state.takes(t))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], [*batch.schema.names, "accepted"])

    ordered = events.repartition(*key).sortWithinPartitions(*key, *_order(events, key, at))
    return ordered.mapInArrow(run, StructType([*events.schema, StructField("accepted", BooleanType())]))


def debounce(events: DataFrame, key: list[str], at: str = "at_us", gap_us: int = 100_000) -> DataFrame:
    """Of each key's events those that come gap_us or more after the last one passed, of equal times the first in the order of the other columns."""
    return _accepted(events, key, at, lambda: Gap(gap_us)).filter("accepted").drop("accepted")


def rate_limit(requests: DataFrame, client: str, at: str = "at_us", limit: int = 60, window_us: int = 60_000_000) -> DataFrame:
    """requests with accepted: fewer than limit accepted ones of the client lie within the window before; rejected ones don't count."""
    return _accepted(requests, [client], at, lambda: Quota(window_us, limit))


class InOrder(StatefulProcessor):
    """Hands a key's events to a rule in the order of time, once the watermark says that no earlier ones come.

    Until then they are kept; then what the rule keeps is, and it goes by a timer once nothing later can depend on it. So a
    key that is idle leaves no state, and the result doesn't depend on how events are dealt into batches."""

    def __init__(self, columns: StructType, order: list[str], at: str, rule: Callable[[list[int]], Gap | Quota]):
        self.columns, self.order, self.at, self.rule = columns, order, at, rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.columns)
        self.kept = handle.getListState("kept", "at long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803 - names that Spark calls
        due = set()
        for r in rows:
            self.waiting.appendValue(tuple(r[c] for c in self.columns.names))
            due.add(r[self.at] // 1000 + 1)
        for t in due:
            self.handle.registerTimer(t)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        passed_us = timerValues.getCurrentWatermarkInMs() * 1000
        place = {c: i for i, c in enumerate(self.columns.names)}
        waiting = [tuple(r) for r in self.waiting.get()]
        ready = [r for r in waiting if r[place[self.at]] <= passed_us]
        rule = self.rule([r[0] for r in self.kept.get()])
        ready.sort(key=lambda r: [(r[place[c]] is not None, r[place[c]]) for c in self.order])
        for r in ready:
            yield Row(**dict(zip(self.columns.names, r, strict=True)), accepted=rule.takes(r[place[self.at]]))
        left = [r for r in waiting if r[place[self.at]] > passed_us]
        self.waiting.put(left) if left else self.waiting.clear()
        kept = [(t,) for t in rule.kept if t + rule.span > passed_us]
        self.kept.put(kept) if kept else self.kept.clear()
        if kept and ready:
            self.handle.registerTimer((kept[-1][0] + rule.span) // 1000 + 1)

    def close(self) -> None:
        pass


def _stream_accepted(events: DataFrame, key: list[str], at: str, late_us: int, rule: Callable[[list[int]], Gap | Quota]) -> DataFrame:
    columns = StructType(list(events.schema))
    timed = events.withColumn("_time", F.timestamp_micros(at)).withWatermark("_time", f"{late_us} microseconds")
    processor = InOrder(columns, _order(events, key, at), at, rule)
    return timed.groupBy(*key).transformWithState(processor, StructType([*columns, StructField("accepted", BooleanType())]), "append", "EventTime")


def stream_debounce(events: DataFrame, key: list[str], at: str = "at_us", gap_us: int = 100_000, late_us: int = 0) -> DataFrame:
    """debounce over a stream. An event comes out once the watermark, late_us behind the latest time seen, has passed it; events behind the watermark take no part.

    Needs the RocksDB state store (jobs.STATE_STORE)."""
    return _stream_accepted(events, key, at, late_us, lambda kept: Gap(gap_us, kept)).filter("accepted").drop("accepted")


def stream_rate_limit(requests: DataFrame, client: str, at: str = "at_us", limit: int = 60, window_us: int = 60_000_000, late_us: int = 0) -> DataFrame:
    """rate_limit over a stream, with times and late requests as in stream_debounce."""
    return _stream_accepted(requests, [client], at, late_us, lambda kept: Quota(window_us, limit, kept))


def coalesce_paths(events: DataFrame) -> DataFrame:
    """The paths of a micro-batch, each once."""
    return events.select("file_path").distinct()


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Hands each micro-batch of what is there to each() and ends."""
    query = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
