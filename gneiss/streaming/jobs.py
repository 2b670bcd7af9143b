"""Driver-side state of long-running work: a registry of jobs, streams that can be started, asked and stopped, a request limiter."""

from __future__ import annotations

import threading
import time
import uuid
from collections import deque
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener


@dataclass
class Job:
    kind: str
    status: str = "pending"
    job_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    created_at: float = field(default_factory=time.time)
    finished_at: float | None = None
    result: dict | None = None
    error: str | None = None


class Jobs:
    """Jobs by id, the latest ones: pending, running, completed or failed."""

    def __init__(self, most: int = 1000):
        self.most, self._jobs, self._lock = most, {}, threading.Lock()

    def run(self, kind: str, work: Callable[[], dict], background: bool = False) -> Job:
        job = Job(kind)
        with self._lock:
            self._jobs[job.job_id] = job
            for old in list(self._jobs)[: max(0, len(self._jobs) - self.most)]:
                del self._jobs[old]

        def do() -> None:
            job.status = "running"
            try:
                job.result, job.status = work(), "completed"
            except Exception as e:  # noqa: BLE001 - kept for whoever asks for the job
                job.error, job.status = str(e), "failed"
            job.finished_at = time.time()

        if background:
            threading.Thread(target=do, daemon=True).start()
        else:
            do()
        return job

    def known(self, job_id: str, kind: str) -> Job:
        """The job of that id, which is made where there is none."""
        with self._lock:
            job = self._jobs.setdefault(job_id, Job(kind, job_id=job_id))
            for old in list(self._jobs)[: max(0, len(self._jobs) - self.most)]:
                del self._jobs[old]
        return job

    def listen(self, spark: SparkSession) -> Progress:
        """From now on the session's streaming queries are jobs, under their run ids."""
        listener = Progress(self)
        spark.streams.addListener(listener)
        return listener

    def get(self, job_id: str) -> dict | None:
        job = self._jobs.get(job_id)
        return asdict(job) if job else None

    def all(self) -> list[dict]:
        return [asdict(j) for j in self._jobs.values()]


#: What streams with state and timers need.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Progress(StreamingQueryListener):
    """Keeps a job for each streaming query that the session runs: its batch, rows so far, rows a second and error are the job's result."""

    def __init__(self, jobs: Jobs):
        self.jobs = jobs

    def _job(self, run_id: str, name: str | None) -> Job:
        return self.jobs.known(str(run_id), f"stream {name}" if name else "stream")

    def onQueryStarted(self, event) -> None:  # noqa: N802 - names that Spark calls
        job = self._job(event.runId, event.name)
        job.status, job.result = "running", {"batch": None, "rows": 0, "rows_per_second": 0.0}

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        job = self._job(p.runId, p.name)
        before = (job.result or {}).get("rows", 0)
        job.result = {"batch": p.batchId, "rows": before + p.numInputRows, "rows_per_second": p.processedRowsPerSecond}

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        job = self._job(event.runId, None)
        job.error, job.status, job.finished_at = event.exception, "failed" if event.exception else "completed", time.time()


class Watch:
    """Polls: calls step() every interval seconds until stopped; what step returns is counted as its events."""

    def __init__(self, step: Callable[[], int], interval: float = 0.5):
        self.step, self.interval = step, interval
        self.polls = self.events = 0
        self.error: str | None = None
        self._stop, self._thread = threading.Event(), None

    def start(self) -> Watch:
        if self._thread is None or not self._thread.is_alive():
            self._stop.clear()
            self._thread = threading.Thread(target=self._loop, daemon=True)
            self._thread.start()
        return self

    def _loop(self) -> None:
        while not self._stop.is_set():
            try:
                self.events += self.step()
                self.error = None
            except Exception as e:  # noqa: BLE001 - a failed poll is tried again
                self.error = str(e)
            self.polls += 1
            self._stop.wait(self.interval)

    def stop(self) -> None:
        self._stop.set()
        if self._thread is not None:
            self._thread.join()

    def status(self) -> dict:
        return {"running": self._thread is not None and self._thread.is_alive(), "polls": self.polls, "events": self.events, "error": self.error}


class Stream:
    """A structured stream with a checkpoint: start, stop and status."""

    def __init__(self, source: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"):
        self.source, self.each, self.checkpoint, self.mode, self.query = source, each, checkpoint, mode, None

    def start(self) -> Stream:
        if self.query is None or not self.query.isActive:
            self.query = self.source.writeStream.foreachBatch(self.each).outputMode(self.mode).option("checkpointLocation", self.checkpoint).start()
        return self

    def stop(self) -> None:
        if self.query is not None:
            self.query.processAllAvailable()
            self.query.stop()

    def status(self) -> dict:
        last = self.query.lastProgress if self.query is not None else None
        return {"running": self.query is not None and self.query.isActive, "batch": last["batchId"] if last else None, "rows": last["numInputRows"] if last else 0}


class RateLimiter:
    """The live form of rate_limit, for requests to one driver: at most so many clients, the longest unused go first."""

    def __init__(self, per_window: int = 60, window: float = 60.0, most_clients: int = 10_000, idle: float = 120.0, spare: int = 100):
        self.per_window, self.window, self.most_clients, self.idle, self.spare = per_window, window, most_clients, idle, spare
        self._taken: dict[str, deque] = {}
        self._cleaned, self._lock = None, threading.Lock()

    def allow(self, client: str, now: float | None = None) -> bool:
        now = time.time() if now is None else now
        with self._lock:
            if self._cleaned is None or now - self._cleaned > self.window:
                self._cleaned = now if self._cleaned is None else self._clean(now)
            if client not in self._taken:
                if len(self._taken) >= self.most_clients:
                    oldest = sorted(self._taken, key=lambda c: self._taken[c][0] if self._taken[c] else now)
                    for c in oldest[: len(self._taken) - self.most_clients + self.spare]:
                        del self._taken[c]
                self._taken[client] = deque()
            taken = self._taken[client]
            while taken and taken[0] <= now - self.window:
                taken.popleft()
            if len(taken) >= self.per_window:
                return False
            taken.append(now)
            return True

    def _clean(self, now: float) -> float:
        """Forgets clients whose first request kept is older than idle."""
        for client in [c for c, taken in self._taken.items() if taken and taken[0] < now - self.idle]:
            del self._taken[client]
        return now

    def stats(self) -> dict:
        return {"active_clients": len(self._taken), "per_window": self.per_window, "most_clients": self.most_clients}
