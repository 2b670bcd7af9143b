"""Conversation structure repair on a graph of tight arcs.

A conversation's rows, by turn, are edited until the roles' initials read (s?(ua)+)?: rows are kept, get another role or
are deleted, and empty rows are inserted. Costs are lengths of paths through a graph with a node for each place between
rows and each state of that pattern (nothing yet, after s, after u, after a). Least costs from the start (forward) and to
the end (backward) show which arcs are optimal: those for which forward cost, own cost and backward cost add up to the
least cost of all. The walk along optimal arcs takes, at each step, all that the frontier offers with the least letter.
A letter leads from a state to one state at most, so the frontier starts as one state and stays one.

Rows are sorted over all tasks by conversation, turn and a digest, so a conversation of any size spreads over many. One
that lies within a task is solved there. Of one that touches an end of its task, the task gives the least costs from
each state to each state across its rows, a 4 x 4 matrix. The driver, which gets at most two of them a task, chains the
matrices into forward and backward costs at each task's ends, with these each piece of at most PIECE_ROWS rows walks from
each state that optimal paths enter it in, in parallel, and a last stage follows the states through the pieces in order.
That stage also hashes a conversation's repaired text, which SHA-256 allows in one order only: texts stream through it.
Rows that repeat an earlier one of their conversation are found by digests, whose counts show hot ones, and come as
marks into the same sort, so texts move once.

Defined results: a null role, text, conv_id or turn counts as one space in texts and in the key of the damage; rows with
null turns come first; rows of one turn go by the SHA-256 of conv_id, role and text; null conv_ids are one conversation;
of equal rows the first counts and the rest are duplicates; a conversation without rows after damage gives zeros, an
empty audit and the hash of an empty string; gaps stop at the end of a long; an empty table gives an empty one; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256
from math import ceil
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.shared import SPACES, drop_written, join_hot, read_table, written

#: Bounds of a task's rows and bytes in the sort, and of a piece of a conversation that touches an end of its task.
PART_ROWS, PART_BYTES = 100_000, 64 << 20
PIECE_ROWS, PIECE_BYTES = 512, 1 << 20

FAR, LONGEST = 1 << 60, (1 << 63) - 1
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)  # faults
START, AFTER_S, AFTER_U, AFTER_A = STATES = range(4)
DELETE_COST, REROLE_COST, INSERT_COST, TRUNCATED_COST = 3, 2, 2, 1
#: State after a role's initial (by its place in "sua"), from each state that may come before.
FOLLOWS = {0: {START: AFTER_S}, 1: {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U}, 2: {AFTER_U: AFTER_A}}
#: The one insertion that a state allows: its role's initial and the state after it.
INSERTS = {s: (i, FOLLOWS[i][s]) for s in STATES for i in (1, 2) if s in FOLLOWS[i]}
ROLES = {1: b"user", 2: b"assistant"}
LEGAL = {(0, 1), (1, 2), (2, 1)}
SUMS = ["blank", "duplicate", "truncated", "illegal"]


def _row_arcs(initial: int, fault: int) -> list[list[tuple[str, int, int, int]]]:
    """By state: letter, cost, next state and the initial that it gives (-1: none), least letter first."""
    arcs = [[("D", DELETE_COST, s, -1)] for s in STATES]
    if fault not in (BLANK, DUPLICATE):
        extra = TRUNCATED_COST if fault == TRUNCATED else 0
        for s, t in FOLLOWS.get(initial, {}).items():
            arcs[s].append(("K", extra, t, initial))
        for i in ROLES:
            for s, t in FOLLOWS[i].items():
                arcs[s].append(("R", REROLE_COST + extra, t, i))
    return arcs


#: By 4 * initial + fault; an initial of 3 stands for all others.
ARCS = [_row_arcs(i, f) for i in range(4) for f in range(4)]


def after_inserts(ahead: list[int]) -> list[int]:
    """Forward costs of a place with insertions there."""
    out = list(ahead)
    for _ in range(2):  # more than two in a row only add to the cost
        for s, (_, t) in INSERTS.items():
            out[t] = min(out[t], out[s] + INSERT_COST)
    return out


def before_inserts(behind: list[int]) -> list[int]:
    """Backward costs of a place with insertions there."""
    out = list(behind)
    for _ in range(2):
        for s, (_, t) in INSERTS.items():
            out[s] = min(out[s], out[t] + INSERT_COST)
    return out


BEGIN, END = [0, FAR, FAR, FAR], before_inserts([0, FAR, FAR, 0])


def forward(ahead: list[int], cell: int) -> list[int]:
    """Costs after a row from those at the place before it."""
    ahead, out = after_inserts(ahead), [FAR] * 4
    for s, arcs in enumerate(ARCS[cell]):
        for _, cost, t, _ in arcs:
            out[t] = min(out[t], ahead[s] + cost)
    return out


def backward(behind: list[int], cell: int) -> list[int]:
    return before_inserts([min(cost + behind[t] for _, cost, t, _ in arcs) for arcs in ARCS[cell]])


def matrix_of(cells: bytes) -> list[list[int]]:
    """Least costs across rows, from each state (row) to each (column)."""
    return [reduce(forward, cells, [0 if s == t else FAR for t in STATES]) for s in STATES]


IDENTITY = matrix_of(b"")


def chained(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    return [advanced(row, b) for row in a]


def advanced(ahead: list[int], m: list[list[int]]) -> list[int]:
    return [min(FAR, min(ahead[s] + m[s][t] for s in STATES)) for t in STATES]


def receded(m: list[list[int]], behind: list[int]) -> list[int]:
    return [min(FAR, min(m[s][t] + behind[t] for t in STATES)) for s in STATES]


def edits(cells: bytes, entries: list[int], ahead: list[int], behind: list[int], cost: int, last: bool) -> Iterator[tuple[int, int, list[tuple[str, int, int]]]]:
    """For each entry state on an optimal path: the state, the state at the end, and letter, row and initial (-1: deleted) of each edit.

    ahead, behind: least costs from the conversation's start to the first row, and from behind the last row to its end.
    last: whether nothing follows, so insertions at the end belong here."""
    to_come = [behind]
    for cell in reversed(cells):
        to_come.append(backward(to_come[-1], cell))
    to_come.reverse()
    so_far = [after_inserts(ahead)]
    for cell in cells:
        so_far.append(after_inserts(forward(so_far[-1], cell)))
    for entry in entries:
        if ahead[entry] + to_come[0][entry] != cost:
            continue
        state, path = entry, []
        for row, cell in enumerate((*cells, -1)):
            if cell < 0 and not last:
                break
            while True:
                insert = INSERTS[state]
                arcs = [("I", INSERT_COST, insert[1], insert[0])]
                if cell >= 0:
                    arcs = sorted(ARCS[cell][state] + arcs)
                elif so_far[row][state] == cost and state in (START, AFTER_A):
                    break
                for letter, own, t, initial in arcs:
                    if so_far[row][state] + own + to_come[row + (letter != "I")][t] == cost:
                        break
                path.append((letter, row, initial))
                state = t
                if letter != "I":
                    break
        yield entry, state, path


def lines(path: list[tuple[str, int, int]], roles: list[bytes], texts: list[bytes]) -> list[bytes]:
    """The repaired rows as role:text."""
    return [ROLES[i] + b":" if e == "I" else (roles[r] if e == "K" else ROLES[i]) + b":" + texts[r] for e, r, i in path if e != "D"]


class Rows:
    """Rows of a conversation in one task, in order."""

    def __init__(self, conv_id, first: bool):
        self.conv_id, self.first = conv_id, first
        self.cells, self.roles, self.texts, self.turns = bytearray(), [], [], []

    def add(self, turn: int | None, cell: int, role: bytes, text: bytes) -> None:
        self.cells.append(cell)
        self.roles.append(role)
        self.texts.append(text)
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)

    def counts(self) -> list[int]:
        faults, initials = [c % 4 for c in self.cells], [c // 4 for c in self.cells]
        return [faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)] + [sum(p not in LEGAL for p in zip(initials, initials[1:], strict=False))]

    def ends(self) -> list[int | None]:
        """Least, largest and number of turns; initials of the first and the last row."""
        turns = [self.turns[0], self.turns[-1], len(self.turns)] if self.turns else [None, None, 0]
        return turns + ([self.cells[0] // 4, self.cells[-1] // 4] if self.cells else [None, None])

    def solved(self) -> dict:
        cost = reduce(backward, reversed(self.cells), END)[START]
        ((_, _, path),) = edits(bytes(self.cells), [START], BEGIN, END, cost, True)
        low, high, n, *_ = self.ends()
        digest = sha256(b"\n".join(lines(path, self.roles, self.texts))).hexdigest()
        return {"conv_id": self.conv_id, "gaps": min(LONGEST, high - low + 1 - n) if n else 0, **dict(zip(SUMS, self.counts(), strict=True)), "cost": cost, "audit": "".join(e for e, _, _ in path), "repaired_sha256": digest}

    def pieces(self, part: int) -> Iterator[dict]:
        """Pieces with costs across what is before and behind each of them in this task; the first has the sums of all."""
        cuts, size = [0], 0
        for i, text in enumerate(self.texts):
            if i - cuts[-1] >= PIECE_ROWS or size + len(text) > PIECE_BYTES and i > cuts[-1]:
                cuts.append(i)
                size = 0
            size += len(text)
        spans = list(zip(cuts, [*cuts[1:], len(self.texts)], strict=True))
        matrices = [matrix_of(bytes(self.cells[a:b])) for a, b in spans]
        before, after = [IDENTITY], [IDENTITY]
        for m in matrices:
            before.append(chained(before[-1], m))
        for m in reversed(matrices):
            after.append(chained(m, after[-1]))
        flat = lambda m: [x for row in m for x in row]
        for i, (a, b) in enumerate(spans):
            row = {"part": part, "run": 0 if self.first else 1, "piece": i, "before": flat(before[i]), "after": flat(after[len(spans) - 1 - i])}
            row |= {"cells": bytes(self.cells[a:b]), "roles": self.roles[a:b], "texts": self.texts[a:b]}
            if not i:
                row |= {"conv_id": self.conv_id, "ends": self.ends(), "across": flat(before[-1]), **dict(zip(SUMS, self.counts(), strict=True))}
            yield row


def _square(flat: list[int]) -> list[list[int]]:
    return [flat[4 * i : 4 * i + 4] for i in STATES]


PACKED = "part int, run int, piece int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, ends array<long>, across array<long>, before array<long>, after array<long>, cells binary, roles array<binary>, texts array<binary>"
RESULT = ["conv_id", "gaps", *SUMS, "cost", "audit", "repaired_sha256"]


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def _packed_schema(conv_id: pa.DataType) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary())}
    return pa.schema([("conv_id", conv_id)] + [(n, kinds[k]) for n, k in (c.split() for c in PACKED.split(", "))])


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a task: whole conversations solved, those at its ends in pieces."""
    current, part, marked, out, schema = None, 0, False, [], None
    for batch in batches:
        schema = schema or _packed_schema(batch.schema.field("conv_id").type)
        for conv_id, turn, kind, cell, role, text, part in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "kind", "cell", "role", "text", "part")), strict=True):
            if current is None or current.conv_id != conv_id:
                if current is not None:
                    out += current.pieces(part) if current.first else [current.solved()]
                current = Rows(conv_id, current is None)
            if kind == MARK:
                marked = True
            elif kind == ROW:
                current.add(turn, cell - cell % 4 + DUPLICATE if marked and cell % 4 != BLANK else cell, role, text)
                marked = False
        if len(out) >= 1000:
            yield _batch(out, schema)
            out = []
    if current is not None:
        yield _batch(out, schema)
        for piece in current.pieces(part):
            yield _batch([piece], schema)


ABSENT, MARK, ROW = range(3)


class Link(NamedTuple):
    """What a task's part of a conversation needs to know of the rest."""

    chain: int
    ahead: list[int]
    behind: list[int]
    cost: int
    last: bool


def chain_runs(runs: list) -> tuple[dict[tuple[int, int], Link], list[dict]]:
    """Links by task and place (0: at its start, 1: at its end), and the sums of each chain. runs: first pieces, by task and place."""
    chains: list[list] = []
    for r in runs:
        if chains and chains[-1][-1]["conv_id"] == r["conv_id"]:
            chains[-1].append(r)
        else:
            chains.append([r])
    links, sums = {}, []
    for number, chain in enumerate(chains):
        matrices = [_square(r["across"]) for r in chain]
        ahead, behind = [BEGIN], [END]
        for m in matrices:
            ahead.append(advanced(ahead[-1], m))
        for m in reversed(matrices):
            behind.append(receded(m, behind[-1]))
        cost = behind[-1][START]
        for i, r in enumerate(chain):
            links[r["part"], r["run"]] = Link(number, ahead[i], behind[len(chain) - 1 - i], cost, i == len(chain) - 1)
        total = {k: sum(r[k] for r in chain) for k in SUMS}
        seen = [r["ends"] for r in chain if r["ends"][3] is not None]
        total["illegal"] += sum((a[4], b[3]) not in LEGAL for a, b in zip(seen, seen[1:], strict=False))
        turns = [e for e in seen if e[2]]
        distinct = sum(e[2] for e in turns) - sum(a[1] == b[0] for a, b in zip(turns, turns[1:], strict=False))
        sums.append({"conv_id": chain[0]["conv_id"], "gaps": min(LONGEST, turns[-1][1] - turns[0][0] + 1 - distinct) if turns else 0, **total, "cost": cost})
    return links, sums


WALKED = pa.schema([("chain", pa.int64()), ("part", pa.int32()), ("run", pa.int32()), ("piece", pa.int32()), ("entries", pa.list_(pa.int32())), ("exits", pa.list_(pa.int32())), ("audits", pa.list_(pa.string())), ("bodies", pa.list_(pa.binary()))])


def walked(batches: Iterator[pa.RecordBatch], links: dict[tuple[int, int], Link]) -> Iterator[pa.RecordBatch]:
    """Pieces with their edits and repaired text for each state that optimal paths enter them in."""
    for batch in batches:
        for i in range(batch.num_rows):
            r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            link = links[r["part"], r["run"]]
            ahead, behind = advanced(link.ahead, _square(r["before"])), receded(_square(r["after"]), link.behind)
            last = link.last and r["after"] == [x for row in IDENTITY for x in row]
            found = list(edits(r["cells"], list(STATES), ahead, behind, link.cost, last))
            yield _batch([{**{k: r[k] for k in ("part", "run", "piece")}, "chain": link.chain, "entries": [e for e, _, _ in found], "exits": [x for _, x, _ in found],
                           "audits": ["".join(e for e, _, _ in path) for _, _, path in found], "bodies": [b"\n".join(lines(path, r["roles"], r["texts"])) for _, _, path in found]}], WALKED)


def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """chain, audit and repaired_sha256 of each chain, whose pieces come in order."""
    schema = pa.schema([("chain", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    chain, state, audit, digest, begun = None, START, [], sha256(), False

    def result() -> pa.RecordBatch:
        return _batch([{"chain": chain, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}], schema)

    for batch in batches:
        for i in range(batch.num_rows):
            if (own := batch.column("chain")[i].as_py()) != chain:
                if chain is not None:
                    yield result()
                chain, state, audit, digest, begun = own, START, [], sha256(), False
            at = batch.column("entries")[i].as_py().index(state)
            audit.append(batch.column("audits")[i][at].as_py())
            if body := batch.column("bodies")[i][at].as_py():
                digest.update(b"\n" + body if begun else body)
                begun = True
            state = batch.column("exits")[i][at].as_py()
    if chain is not None:
        yield result()


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and kind: rows after damage, and one of kind ABSENT for each that was dropped."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20).alias("_fault"))
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("_fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "_fault", F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    absent = F.col("_fault") == 0
    return rows.select("conv_id", *(F.when(~absent, F.col(c)).alias(c) for c in ("turn", "role", "text")), F.when(absent, ABSENT).otherwise(ROW).alias("kind"))


def cell_of(role: Column, text: Column) -> Column:
    """4 * the place of the role's initial in "sua" (3: elsewhere) + the fault that shows in the row itself."""
    first, shown = F.substring(role, 1, 1), F.rtrim(text, F.lit(SPACES))
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    fault = F.when(shown == "", BLANK).when(F.substring(shown, -1, 1).isin(".", "!", "?"), NONE).otherwise(TRUNCATED)
    return (4 * initial + fault).cast("int")


def repair(rows: DataFrame) -> DataFrame:
    """RESULT for each conversation of rows: conv_id, turn, role, text, as they are after damage, and kind (ABSENT: there was a row)."""
    spark = rows.sparkSession
    key = F.sha2(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.length("role").cast("string"), F.concat("role", "text")), 256)
    # Numbers of rows differ from run to run at most among equal rows; once written, they stay.
    rows = written(rows.select("conv_id", "turn", "kind", F.when(F.col("kind") == ROW, key).alias("key"), F.monotonically_increasing_id().alias("at"), cell_of(F.col("role"), F.col("text")).alias("cell"), F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text")), "repair-rows")
    real = rows.filter(F.col("kind") == ROW)
    # Of rows with one digest the first stays; the others are marked.
    first = real.groupBy("key").agg(F.min(F.struct("turn", "at")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = written(first.select("key", "n", F.col("first.at").alias("first")), "repair-first")
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes")).first()
    marks = join_hot(real.select("key", "conv_id", "turn", "at"), first, "key", "n", counts["n"]).filter("at <> first")
    marks = marks.select("conv_id", "turn", F.lit(MARK).alias("kind"), "key", "at")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(counts["n"] / PART_ROWS), ceil((counts["bytes"] or 0) / PART_BYTES))
    order = ["conv_id", "turn", "key", "at"]
    sorted_rows = rows.unionByName(marks, allowMissingColumns=True).repartitionByRange(parts, *order).sortWithinPartitions(*order, "kind")
    conv_id = rows.schema["conv_id"].dataType.simpleString()
    tasks = written(sorted_rows.select("conv_id", "turn", "kind", "cell", "role", "text", F.spark_partition_id().alias("part")).mapInArrow(packed, f"conv_id {conv_id}, {PACKED}"), "repair-tasks")
    drop_written(rows, first)
    # At most two rows a task, without texts.
    runs = tasks.filter("piece = 0").select("conv_id", "part", "run", "ends", "across", *SUMS).orderBy("part", "run").collect()
    links, sums = chain_runs(runs)
    sent = spark.sparkContext.broadcast(links)
    walks = tasks.filter("piece is not null").select("part", "run", "piece", "before", "after", "cells", "roles", "texts")
    walks = walks.mapInArrow(lambda batches: walked(batches, sent.value), "chain long, part int, run int, piece int, entries array<int>, exits array<int>, audits array<string>, bodies array<binary>")
    ends = walks.repartition("chain").sortWithinPartitions("chain", "part", "run", "piece").mapInArrow(followed, "chain long, audit string, repaired_sha256 string")
    known = spark.createDataFrame([(i, *(s[c] for c in ["conv_id", "gaps", *SUMS, "cost"])) for i, s in enumerate(sums)], f"chain long, conv_id {conv_id}, {', '.join(f'{c} long' for c in ['gaps', *SUMS, 'cost'])}")
    return tasks.filter("piece is null").select(*RESULT).unionByName(ends.join(known, "chain").select(*RESULT))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(read_table(spark, sf_dir, "conversations")))


def _sql() -> str:
    """Damage, faults and counts as windows; the edits by a recursion from the last row to the first.

    e0 to e3 are, for each state, cost, letters and repaired text of the best way to the end: equal cost and state compare by the letters to come."""

    def step(letter: str, cost: str, to: int, line: str | None, when: str = "TRUE") -> str:
        rest = f"p.e{to}"
        text = f"{rest}.r" if line is None else f"{line} || CASE WHEN {rest}.r = '' THEN '' ELSE chr(10) END || {rest}.r"
        return f"CASE WHEN {when} THEN {{'c': {rest}.c + {cost}, 's': '{letter}' || {rest}.s, 'r': {text}}} END"

    def own(s: int) -> str:
        to, role = (3, "assistant") if s == 2 else (2, "user")
        sound, extra = "x.fault NOT IN ('blank', 'duplicate')", "(x.fault = 'truncated')::INT"
        keep = "x.role || ':' || x.text"
        ways = [step("D", "3", s, None), step("K", extra, to, keep, f"{sound} AND x.initial = '{role[0]}'"), step("R", f"2 + {extra}", to, f"'{role}:' || x.text", sound)]
        return "list_min([" + ", ".join(ways + ([step("K", extra, 1, keep, f"{sound} AND x.initial = 's'")] if s == 0 else [])) + "])"

    def insert(s: int) -> str:
        to, role = (3, "assistant") if s == 2 else (2, "user")
        return f"{{'c': e{to}.c + 2, 's': 'I' || e{to}.s, 'r': '{role}:' || CASE WHEN e{to}.r = '' THEN '' ELSE chr(10) END || e{to}.r}}"

    # Insertions lead from 3 to 2 and from 2 to 3, so 2 comes first, then 3, then the others.
    closed = "SELECT {keep}, list_min([e0, {i0}]) AS e0, list_min([e1, {i1}]) AS e1, e2, e3 FROM (SELECT * REPLACE (list_min([e3, {i3}]) AS e3) FROM (SELECT * REPLACE (list_min([e2, {i2}]) AS e2) FROM {rows}))"
    close = lambda rows: closed.format(keep="conv_id, pos", rows=rows, **{f"i{s}": insert(s) for s in STATES})
    shift = ", ".join(["-1"] * 8)
    return rf"""
WITH RECURSIVE b AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
f AS (SELECT *, xor(list_reduce(flatten(list_transform(string_split(k, ''), lambda x: [ascii(x)::BIGINT, {shift}])),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END, 4294967295::BIGINT), 4294967295) % 20 AS f FROM b),
d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE f WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM f),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat_ws(':', coalesce(conv_id::VARCHAR, ''), length(role)::VARCHAR, role || text)), copy) AS pos, left(role, 1) AS initial FROM d),
x AS MATERIALIZED (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
  lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS pair FROM n),
t AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n FROM x GROUP BY conv_id),
z AS (SELECT conv_id, n + 1 AS pos, {{'c': 0::BIGINT, 's': '', 'r': ''}} AS e0, {{'c': 1000000000::BIGINT, 's': '', 'r': ''}} AS e1, {{'c': 1000000000::BIGINT, 's': '', 'r': ''}} AS e2, {{'c': 0::BIGINT, 's': '', 'r': ''}} AS e3 FROM t),
w AS ({close("z")}
  UNION ALL {close(f"(SELECT x.conv_id, x.pos, {', '.join(f'{own(s)} AS e{s}' for s in STATES)} FROM w p JOIN x ON x.conv_id IS NOT DISTINCT FROM p.conv_id AND x.pos = p.pos - 1)")}),
o AS (SELECT DISTINCT conv_id FROM conversations)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(w.e0.c, 0) AS cost, coalesce(w.e0.s, '') AS audit, sha256(coalesce(w.e0.r, '')) AS repaired_sha256
FROM o LEFT JOIN t ON o.conv_id IS NOT DISTINCT FROM t.conv_id LEFT JOIN w ON o.conv_id IS NOT DISTINCT FROM w.conv_id AND w.pos = 1
"""


QUERIES = {"op13_repair": op13_repair}
ORACLE_SQL = {"op13_repair": _sql()}
