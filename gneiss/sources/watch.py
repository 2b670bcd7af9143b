"""A source tree as a stream of changes: spark.readStream.format("gneiss_tree").

Offsets are numbers of snapshots. A batch takes a new one: each top-level entry of the tree is a partition, whose task walks
it, hashes files that changed in size or time, writes the entry's part of the snapshot and compares it with the part of the
snapshot before. A part that is there already is read instead, so a batch that is run again, after a restart or the loss of
an executor, gives the same events, whatever the tree has become. Snapshots older than the last committed one are deleted.

Options: path (the tree) and state (a folder for snapshots), both where the driver and all executors see them as files;
maxBytes, above which files are left out. Events are those of snapshot_diff: created, modified and deleted files with the
MD5 of their bytes, and version, the snapshot they appeared in. Files that watches ignore give none. A file that can't be
read counts as absent; links to folders aren't followed.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from gneiss.functions import fixed

SCHEMA = "version long, event_type string, file_path string, file_hash string"
#: The entry that stands for files in the root itself.
ROOT_FILES = "."


def ignored(path: str) -> bool:
    """functions.text.watch_ignored, for a path in Python."""
    return path.rsplit("/", 1)[-1].startswith(".") or any(path.endswith(p[1:]) if p[0] == "*" else p in path for p in fixed.WATCH_IGNORED)


def _local(path: str) -> str:
    return "/" + path[5:].lstrip("/") if path.startswith("file:") else path


def _write(path: str, value) -> None:
    """Whole or not at all."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "w") as f:
        json.dump(value, f)
    os.replace(own, path)


def _read(path: str):
    if not os.path.exists(path):
        return None
    with open(path) as f:
        return json.load(f)


@dataclass
class Entry(InputPartition):
    """A top-level entry between two snapshots."""

    name: str
    start: int
    end: int


class TreeReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.state = _local(options["path"]).rstrip("/"), _local(options["state"]).rstrip("/")
        self.most = int(options.get("maxBytes", fixed.MAX_FILE_BYTES))

    def _versions(self) -> list[int]:
        names = os.listdir(self.state) if os.path.isdir(self.state) else []
        return sorted(int(n[1:]) for n in names if n[0] == "v" and os.path.exists(f"{self.state}/{n}/entries.json"))

    def initialOffset(self) -> dict:  # noqa: N802 - names that Spark calls
        return {"version": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"version": max(self._versions(), default=0) + 1}

    def partitions(self, start: dict, end: dict) -> list[Entry]:
        at = f"{self.state}/v{end['version']}/entries.json"
        names = _read(at)
        if names is None:
            before = _read(f"{self.state}/v{start['version']}/entries.json") or []
            found = [e.name for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False)] if os.path.isdir(self.root) else []
            names = sorted({ROOT_FILES, *found, *before})
            _write(at, names)
        return [Entry(n, start["version"], end["version"]) for n in names]

    def _part(self, name: str, version: int) -> str:
        return f"{self.state}/v{version}/{hashlib.md5(name.encode()).hexdigest()}.json"

    def _files(self, name: str) -> Iterator[tuple[str, os.stat_result]]:
        top = self.root if name == ROOT_FILES else f"{self.root}/{name}"
        for folder, inner, files in os.walk(top):
            if name == ROOT_FILES:
                inner.clear()
            for f in files:
                path = f"{folder}/{f}"
                below = path[len(self.root) + 1 :]
                try:
                    facts = os.stat(path)
                except OSError:
                    continue
                if facts.st_size <= self.most and not ignored(below):
                    yield below, facts

    def _snapshot(self, name: str, before: dict) -> dict:
        """Path: size, time, hash."""
        now = {}
        for below, facts in self._files(name):
            known = before.get(below)
            if known and known[:2] == [facts.st_size, facts.st_mtime_ns]:
                now[below] = known
                continue
            try:
                with open(f"{self.root}/{below}", "rb") as f:
                    now[below] = [facts.st_size, facts.st_mtime_ns, hashlib.file_digest(f, "md5").hexdigest()]
            except OSError:
                continue
        return now

    def read(self, partition: Entry) -> Iterator[tuple]:
        before = _read(self._part(partition.name, partition.start)) or {}
        now = _read(self._part(partition.name, partition.end))
        if now is None:
            now = self._snapshot(partition.name, before)
            _write(self._part(partition.name, partition.end), now)
        for path in sorted(before.keys() | now.keys()):
            old, new = before.get(path), now.get(path)
            kind = "created" if old is None else "deleted" if new is None else "modified" if old[2] != new[2] else None
            if kind:
                yield partition.end, kind, path, (new or old)[2]

    def commit(self, end: dict) -> None:
        for version in self._versions():
            if version < end["version"]:
                folder = f"{self.state}/v{version}"
                for name in os.listdir(folder):
                    os.remove(f"{folder}/{name}")
                os.rmdir(folder)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gneiss_tree"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TreeReader:  # noqa: N802
        return TreeReader(self.options)


def changes(spark, root: str, state: str, **options):
    """The stream of root's changes."""
    spark.dataSource.register(TreeSource)
    return spark.readStream.format(TreeSource.name()).options(path=root, state=state, **options).load()
