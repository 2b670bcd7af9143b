"""Exact top-k, vector codes and conversation repair against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.llm import repair, tiles, topk, vector_codes

LAST = (1 << 63) - 1
VECTORS = "vec_id long, embedding array<double>, label int"
ODD = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (0, [3.0, -1.0], None), (None, [9.0, 9.0], 1), (None, [9.0, 9.0], None), (1, None, 1), (2, [float("nan"), 1.0], 1), (3, [float("inf"), 1.0], 1), (4, [None, 1.0], 1),
       (5, [], 2), (100, [1.0, 2.0], 2), (6, [0.5], 2), (7, [1.0, 2.0, -3.0], 1), (8, [0.0, 0.0], 1), (200, [1e300, -1e300], 3), (9, [0.25, -0.25], 3)]


def whole(x, scale):
    return max(-LAST - 1, min(LAST, int(np.floor(min(max(x * scale, -1e30), 1e30)))))


def usable(rows, scale):
    return [(i, tuple(whole(x, scale) for x in v), label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]


# Exact top-k


def best(rows, every, k):
    rows, out = usable(rows, 1024), []
    for n, (i, v, _) in enumerate(rows):
        if i is None or i % every:
            continue
        scored = [(-max(-LAST - 1, min(LAST, sum(a * b for a, b in zip(v, w, strict=False)))), j is None, j or 0) for m, (j, w, _) in enumerate(rows) if m != n]
        out.append((i, tuple((-s, None if none else j) for s, none, j in sorted(scored)[:k])))
    return sorted(out, key=str)


def listed(frame):
    lists = defaultdict(list)
    for r in frame.collect():
        lists[r["query_id"], r["rank"]].append((r["score"], r["vec_id"]))
    return lists


@pytest.mark.parametrize("part_bytes, block", [(32 << 20, 2048), (200, 3)])
def test_top_scores_of_odd_rows(spark, part_bytes, block):
    frame = spark.createDataFrame(ODD, VECTORS).withColumns({c: F.lit(1) for c in ("v", "times", "rank", "score", "digest", "row", "column", "copies")})
    expected = defaultdict(list)
    for i, pairs in best(ODD, 100, 4):
        for rank, pair in enumerate(pairs, 1):
            expected[i, rank].append(pair)
    plain = lambda lists: {k: sorted(v, key=str) for k, v in lists.items()}
    assert plain(listed(topk.top_scores(frame, lambda i: i % 100 == 0, 4, block=block, part_bytes=part_bytes))) == plain(expected)
    assert topk.top_scores(frame.limit(0), lambda i: i % 100 == 0).count() == 0


def test_lists_stop_early_and_lose_nothing(monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 16))
    y = np.floor(1024 * (centres[rng.integers(0, 60, 6000)] * 3 + rng.normal(size=(6000, 16)) * 0.1)).astype(np.int64)
    x, none = y[:50], np.zeros(6000, bool)
    reads = []
    found = topk.tile_topk(tiles.Side(np.arange(50), none[:50], x, np.ones(50, int)), tiles.Side(np.arange(6000), none, y, np.ones(6000, int)), 10, reads=reads)
    got = defaultdict(list)
    for q, c, s, _ in found:
        got[q].append((-s, c))
    for q in range(50):
        assert sorted(got[q])[:10] == sorted((-int(s), c) for c, s in enumerate(y @ x[q]) if c != q)[:10]
    assert sum(a for a, _ in reads) < 0.6 * sum(b for _, b in reads)


def test_tiles_of_equal_and_large_vectors(monkeypatch):
    rng = random.Random(3)
    for _ in range(200):
        dim, k, top = rng.randint(0, 4), rng.randint(1, 4), rng.choice([3, 50, 1 << 62])
        rows = defaultdict(int)
        for _ in range(rng.randint(1, 60)):
            rows[rng.choice([None, *range(12)]), tuple(rng.randint(-top, top) for _ in range(dim))] += rng.choice([1, 1, 1, 2, 6])
        keys = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
        side = lambda own: tiles.Side(np.array([i or 0 for i, _ in own], np.int64), np.array([i is None for i, _ in own], bool), np.array([v for _, v in own], np.int64).reshape(len(own), dim), np.array([rows[o] for o in own]))  # noqa: E731, B023
        queries = [q for q in keys if q[0] is not None and q[0] % 3 == 0]
        monkeypatch.setattr(topk, "STEPS", rng.choice([1, 2, 8, 30]))
        got = [[] for _ in queries]
        for q, c, s, copies in topk.tile_topk(side(queries), side(keys), k, block=rng.choice([5, 13, 100]), query_block=rng.choice([2, 9])):
            got[q] += [(-s, keys[c][0] is None, keys[c][0] or 0)] * copies
        for q, key in enumerate(queries):
            scored = []
            for other, times in rows.items():
                s = sum(a * b for a, b in zip(key[1], other[1], strict=True))
                scored += [(-max(-LAST - 1, min(LAST, s)), other[0] is None, other[0] or 0)] * (times - (other == key))
            assert sorted(got[q])[:k] == sorted(scored)[:k]


# Vector codes


def codes(rows):
    rows = sorted(usable(rows, 4096), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = max(1, -(-max(len(v) for _, v, _ in rows) // 8))
    parts = [[tuple((*v, *[0] * (8 * width - len(v)))[p * width : (p + 1) * width]) for p in range(8)] for _, v, _ in rows]
    books = [[own[p] for own in parts[:16]] for p in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda p, x: min((far(x, c), e) for e, c in enumerate(books[p]))
    for _ in range(6):
        for p in range(8):
            members = defaultdict(list)
            for own in parts:
                members[nearest(p, own[p])[1]].append(own[p])
            books[p] = [tuple(sum(x) // len(members[e]) for x in zip(*members[e], strict=True)) if e in members else c for e, c in enumerate(books[p])]
    found = [[nearest(p, own[p]) for p in range(8)] for own in parts]
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    total = defaultdict(int)
    for (_, _, label), f in zip(rows, found, strict=True):
        total[label] += min(LAST, sum(d for d, _ in f))
    return sorted(((i, "".join(f"{e:02x}" for _, e in f), min(LAST, sum(d for d, _ in f)), min(LAST, total[label]), digest) for (i, _, label), f in zip(rows, found, strict=True)), key=str)


def test_vector_codes(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) for _ in range(19)], rng.choice([None, 1, 2])) for i in range(300)]
    names = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    for case in (rows, rows[:5], ODD, [(1, [1e300] * 3, 1)] * 3):
        frame = spark.createDataFrame(case, VECTORS).withColumns({c: F.lit(1) for c in ("v", "code", "n", "_label", "part", "entry")})
        monkeypatch.setattr(vector_codes, "BATCH_BYTES", 3000)
        assert sorted(map(tuple, vector_codes.compress(frame).select(names).collect()), key=str) == codes(case)
    assert vector_codes.compress(frame.limit(0)).columns == ["vec_id", "label", *names[1:]]
    assert vector_codes.compress(frame.limit(0)).count() == 0


# Conversation repair

SHOWN = re.compile(r"[^\x20\x09-\x0D]")


def with_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text, fault = " " if role is None else role, " " if text is None else text, zlib.crc32(key.encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fault, text)
        out += [(conv, turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def repaired(conversation):
    digest = lambda r: hashlib.sha256(f"{'' if r[0] is None else r[0]}:{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()
    rows = sorted(conversation, key=lambda r: (r[1] is not None, r[1] or 0, digest(r)))
    seen, faults = set(), []
    for _, _, role, text in rows:
        shown = SHOWN.findall(text)
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [r[1] for r in rows if r[1] is not None]
    goes = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(None)
    def ways(i, state, inserted):
        """Cost, letters and lines of the best way to the end; least letters first among equal costs."""
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []

        def add(cost, letter, line, rest):
            if rest is not None:
                found.append((rest[0] + cost, letter + rest[1], (line, *rest[2]) if line is not None else rest[2]))

        if inserted < 3:
            for name in ("user", "assistant"):
                if (state, name[0]) in goes:
                    add(2, "I", f"{name}:", ways(i, goes[state, name[0]], inserted + 1))
        if i < len(rows):
            _, _, role, text = rows[i]
            add(3, "D", None, ways(i + 1, state, 0))
            if faults[i] not in ("blank", "duplicate"):
                cut = faults[i] == "truncated"
                if (state, role[:1]) in goes:
                    add(cut, "K", f"{role}:{text}", ways(i + 1, goes[state, role[:1]], 0))
                for name in ("user", "assistant"):
                    if (state, name[0]) in goes:
                        add(2 + cut, "R", f"{name}:{text}", ways(i + 1, goes[state, name[0]], 0))
        return min(found, default=None)

    for i in range(len(rows), 0, -40):  # not too deep a recursion
        for state in ("", "s", "u", "a"):
            ways(i, state, 0)
    cost, audit, lines = ways(0, "", 0)
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def all_repaired(rows):
    groups = {r[0]: [] for r in rows}
    for r in with_damage(rows):
        groups[r[0]].append(r)
    return sorted(((c, *repaired(own)) for c, own in groups.items()), key=str)


def random_rows(seed, n, conversations):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t", None, "one. two", "é \U0001f600.", "end. \x0b", "\x00", "word " * 50 + "."]
    return [(rng.choice(conversations), rng.choice([None, *range(40)]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "anna"]), rng.choice(texts)) for _ in range(n)]


CONVERSATIONS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("piece_rows, n, conversations", [(512, 600, [None, *range(60)]), (3, 500, [*range(4)]), (1, 300, [None, 7])])
def test_repair(spark, monkeypatch, piece_rows, n, conversations):
    monkeypatch.setattr(repair, "PIECE_ROWS", piece_rows)
    rows = random_rows(n, n, conversations)
    rows += rows[:20]
    frame = spark.createDataFrame(rows, CONVERSATIONS).withColumns({c: F.lit(1) for c in ("kind", "key", "at", "cell", "part", "run", "chain", "cost", "_fault", "copy")})
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        assert sorted(map(tuple, repair.repair(repair.damaged(frame)).collect()), key=str) == all_repaired(rows)
        assert repair.repair(repair.damaged(frame.limit(0))).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_repair_of_dropped_conversations_and_long_texts(spark):
    dropped = [c for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:5]
    rows = [(c, 0, "user", "Gone.") for c in dropped] + [(1000, 1, "user", "x" * 3_000_000 + "."), (1000, 2, "assistant", "y. " * 700_000), (1001, -(1 << 63), "user", "A."), (1001, LAST, "assistant", "B.")]
    frame = spark.createDataFrame(rows, CONVERSATIONS)
    found = sorted(map(tuple, repair.repair(repair.damaged(frame)).collect()), key=str)
    expected = [(c, min(LAST, gaps), *rest) for c, gaps, *rest in all_repaired(rows)]
    assert found == expected
    assert [r[1:] for r in found if r[0] in dropped] == [(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())] * 5


def test_one_conversation_spreads_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(repair, "PART_ROWS", 200)
    rows = [(5, i // 3, random.Random(i).choice(["user", "assistant"]), f"Text {i % 700}.") for i in range(3000)] + [(i, 0, "user", "Ask.") for i in range(10, 1000)]
    written = []
    monkeypatch.setattr(repair, "written", lambda df, name, **k: written.append((name, repair_written(df, name, **k))) or written[-1][1])
    found = {r["conv_id"]: r for r in repair.repair(repair.damaged(spark.createDataFrame(rows, CONVERSATIONS))).collect()}
    assert sorted(map(tuple, found.values()), key=str) == all_repaired(rows)
    tasks = dict(written)["repair-tasks"]
    sizes = [r["n"] for r in tasks.filter("cells is not null").groupBy("part").agg(F.sum(F.length("cells")).alias("n")).collect()]
    assert len(sizes) >= 8 and max(sizes) < 1000


repair_written = repair.written
