"""BPE encoding and decoding with content-defined chunk reuse.

A gear hash over the UTF-8 bytes cuts each text into chunks whose borders depend on the bytes before them alone, so
documents that share a passage share its chunks. Each task encodes the whole words of a chunk once and keeps their ids
in a bounded cache under the chunk's 128-bit digest. Chunk joins are repaired: the stretch from the last whole word
before a join to the first one after it, however many chunks it spans, is encoded again by the library, which has to give
the ids of these two words again at its ends. Where it does, the encodings agree from there on, and what is between the
words is the repair; where it doesn't, the stretch grows to the whole text.

Within a chunk, words are taken apart where the tokenizer's own pattern always does, and the library encodes each piece
once while a task's store has it. Decoding joins the tokens' strings as the library does for a tokenizer without a
decoder. Nothing is shuffled; a lost executor costs its tasks and its caches only.

Defined results: a null text counts as empty: no ids; a null doc_id stays null; repeated rows give repeated rows; texts
of any length are encoded whole; an empty table gives an empty table; other columns are not carried.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gneiss.llm.shared import giving_back, read_table
from gneiss.llm.tokenizer import Library, PieceStore, bytes_of, gather, joined_sides, piece_borders, pieces_of, sides, text_blocks

VOCABULARY = "word_bpe_49k.json"
#: Chunks of about 512 bytes, and of MIN_CHUNK at least; a cut depends on the 32 bytes before it.
CHUNK_BITS, MIN_CHUNK, WINDOW = 9, 64, 32
#: Chunks, pieces of words and stretches in a task's caches, about 60 MB together.
CHUNKS, PIECES, STRETCHES = 20_000, 150_000, 20_000
#: Bytes of text that are encoded together.
BLOCK = 1 << 20
#: What is before the first whole word of a chunk, and that word.
_FIRST = re.compile(rb"[^ \t-\r]*[ \t-\r]+([^ \t-\r]+)(?=[ \t-\r])")
#: The first byte of U+0300 and what follows. Before lower characters, a letter takes no combining mark, so it can be lower-cased ahead.
_COMBINING = 0xCC


def _gear_table() -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.sha256(bytes([i])).digest()[:4] for i in range(256)), "<u4").astype(np.uint32)


GEAR = _gear_table()


def cut_points(data: np.ndarray, borders: np.ndarray) -> list[list[int]]:
    """Where the chunks of each text begin, and its end, never within a UTF-8 character. borders: of the texts in data."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):  # h[i] becomes the sum of GEAR[data[i - k]] << k for k below 32
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    found = np.flatnonzero((h >> np.uint32(32 - CHUNK_BITS)) == 0) + 1
    for _ in range(3):
        inside = found < len(data)
        inside[inside] = data[found[inside]] & 0xC0 == 0x80
        found[inside] += 1
    at = np.searchsorted(found, borders)
    found, cuts = found.tolist(), []
    for i, (start, end) in enumerate(zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)):
        own = [start]
        for x in found[at[i] : at[i + 1]]:
            if x - own[-1] >= MIN_CHUNK and x - start >= WINDOW and x < end:
                own.append(x)
        cuts.append([*own, end])
    return cuts


class ChunkEncoder:
    def __init__(self, vocabulary: str = VOCABULARY, chunks: int = CHUNKS, pieces: int = PIECES, stretches: int = STRETCHES):
        import xxhash

        self.digest = xxhash.xxh3_128_digest
        self.library = Library(vocabulary, "<u4")
        self.pieces, self.stretches, self.chunks = PieceStore(self.library, pieces), PieceStore(self.library, stretches), PieceStore(self.library, chunks, 256 * chunks)
        #: Of each chunk known: its text up to the end of the first whole word, its text from the last one, and how many ids these words have.
        self.edges: dict[bytes, tuple[bytes, bytes, int, int]] = {}
        #: Chunks met, of these found in the cache; joins repaired, texts encoded whole as a join didn't agree.
        self.figures = {"chunks": 0, "reused": 0, "joins": 0, "whole": 0}
        cases = [self.library.whole([chr(i + j) for i in range(26)]) for j in (65, 97)]
        self.lowers = all(np.array_equal(a, b) for a, b in zip(*cases, strict=True))
        vocab = self.library.tokenizer.get_vocab(with_added_tokens=True)
        self.strings = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.strings[i] = token.encode()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a column of texts without nulls, one text after another, and how many each has."""
        if apart := sides(texts, self.library):
            return joined_sides(*self._encode(apart[0]), *apart[1:])
        return self._encode(texts)

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, borders = bytes_of(texts)
        raw = data.tobytes()
        chunks_of = [[raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)] for cuts in cut_points(data, borders)]
        chunks = [c for own in chunks_of for c in own]
        keys = [self.digest(c) for c in chunks]
        new = {k: c for k, c in zip(keys, chunks, strict=True) if k not in self.edges}
        self._learn(new)
        edges = [self.edges[k] for k in keys]

        # Parts of the texts in order: a chunk's number, or -1 - (a stretch's number); beside a stretch the chunks left and right of it, -1 for none.
        stretches, beside, parts, sizes, n = [], [], [], [], 0
        for own in chunks_of:
            before, stretch, left = len(parts), b"", -1
            for n, chunk in enumerate(own, n):  # noqa: B020, PLR1704
                first, last, _, _ = edges[n]
                if not last:
                    stretch += chunk
                    continue
                stretches.append((stretch + first).decode())
                beside.append((left, n))
                parts += [-len(stretches), n]
                stretch, left = last, n
            n += bool(own)
            if stretch:
                stretches.append(stretch.decode())
                beside.append((left, -1))
                parts.append(-len(stretches))
            sizes.append(len(parts) - before)
        self.figures["chunks"] += len(keys)
        self.figures["reused"] += len(keys) - len(new)
        self.figures["joins"] += len(stretches)
        out = self._joined(texts, self.chunks.known(keys), edges, stretches, np.array(beside, np.int64).reshape(-1, 2), np.array(parts, np.int64), np.array(sizes, np.int64))
        self.pieces.turn()
        self.stretches.turn()
        if self.chunks.turn():
            self.edges = {k: self.edges[k] for k in self.chunks.row_of}
        return out

    def _learn(self, new: dict[bytes, bytes]) -> None:
        """Encodes the whole words of new chunks and keeps their ids and edges."""
        if not new:
            return
        words, edges = [], []
        for chunk in new.values():
            found = _FIRST.match(chunk)
            if not found:  # no whole word: a chunk that only takes part in stretches
                words.append(b"")
                edges.append((0, 0, b"", b""))
                continue
            begin = found.start(1)
            body = chunk if chunk[-1] in b" \t\n\x0b\x0c\r" else chunk[: -len(chunk.rsplit(None, 1)[-1])]
            body = body.rstrip()
            last = len(body) - len(body.rsplit(None, 1)[-1])
            words.append(chunk[begin : len(body)])
            edges.append((found.end(1) - begin, last - begin, chunk[: found.end(1)], chunk[last:]))
        data = np.frombuffer(b" ".join(words), np.uint8).copy()
        if self.lowers:
            upper = (data >= 65) & (data <= 90)
            upper[:-1] &= data[1:] < _COMBINING
            data[upper] += 32
        sizes = np.array([len(w) for w in words])
        at = np.cumsum(sizes + 1) - sizes - 1
        first, last = at + [e[0] for e in edges], at + [e[1] for e in edges]
        ids, before, starts = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)
        if len(data):
            starts = piece_borders(data, np.unique(np.concatenate([at[at < len(data)], first, last])), True)
            distinct, code = pieces_of(data, starts)
            ids, counts = self.pieces.gather(self.pieces.rows(distinct)[code])
            before = np.concatenate([[0], np.cumsum(counts)])
        # The number of ids before each place; blanks between chunks have none.
        until = lambda x: before[np.searchsorted(starts, x)]
        begin, end = until(at), until(at + sizes)
        row = self.chunks.append(ids, end - begin)
        self.chunks.row_of.update(zip(new, range(row, row + len(new)), strict=True))
        n_first, n_last = (until(first) - begin).tolist(), (end - until(last)).tolist()
        self.edges.update((k, (e[2], e[3], a, b)) for k, e, a, b in zip(new, edges, n_first, n_last, strict=True))

    def _joined(self, texts: pa.Array, rows: np.ndarray, edges: list, stretches: list[str], beside: np.ndarray, parts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts from those of chunks and stretches."""
        again = self.stretches.rows(stretches)
        ids = np.concatenate([self.chunks.ids[: self.chunks.used], self.stretches.ids[: self.stretches.used]])
        starts = np.concatenate([self.chunks.starts[rows], self.stretches.starts[again] + self.chunks.used])
        counts = np.concatenate([self.chunks.counts[rows], self.stretches.counts[again]])
        own = len(rows) + np.arange(len(again))
        # A last entry for what stands beside a stretch at an end of a text.
        words = np.array([*((e[2], e[3]) for e in edges), (0, 0)], np.int64)
        left, right = words[beside[:, 0], 1], words[beside[:, 1], 0]
        ends = starts + counts
        agrees = counts[own] >= left + right
        for side, n, a, b in ((0, left, starts[own], ends[beside[:, 0]] - left), (1, right, ends[own] - right, starts[beside[:, 1]])):
            n = np.where(agrees & (beside[:, side] >= 0), n, 0)
            every = np.arange(len(n))
            same = np.concatenate([[0], np.cumsum(gather(ids, a, n, every) != gather(ids, b, n, every))])
            border = np.cumsum(n)
            agrees &= same[border] == same[border - n]
        starts[own] += left
        counts[own] -= left + right
        picked = np.where(parts >= 0, parts, len(rows) - 1 - parts)
        if not agrees.all():
            return self._whole(texts, ids, starts, counts, picked, sizes, np.isin(picked, own[~agrees]))
        ends = np.concatenate([[0], np.cumsum(counts[picked])])[np.concatenate([[0], np.cumsum(sizes)])]
        return gather(ids, starts, counts, picked), np.diff(ends)

    def _whole(self, texts, ids, starts, counts, picked, sizes, wrong) -> tuple[np.ndarray, np.ndarray]:
        """As _joined; texts with a part for which wrong holds are encoded whole."""
        found, ends = [], np.cumsum(sizes)
        for text, a, b in zip(texts.to_pylist(), ends - sizes, ends, strict=True):
            if wrong[a:b].any():
                self.figures["whole"] += 1
                found.append(self.library.whole([text])[0])
            else:
                found.append(gather(ids, starts, counts, picked[a:b]))
        return np.concatenate(found), np.array([len(x) for x in found])

    def decode(self, ids: np.ndarray) -> bytes:
        return b" ".join(map(self.strings.__getitem__, ids.tolist()))


def _encoded(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, ChunkEncoder]]:
    """Of each block of rows: the rows, the ids of their texts, and where each text's begin (one more entry than texts)."""
    encoder = ChunkEncoder(vocabulary)  # a task's own: a worker goes on to other stages, which need its memory
    for batch in batches:
        texts = batch.column("text").fill_null("")
        for a, b in text_blocks(texts, BLOCK):
            ids, counts = encoder.encode(texts.slice(a, b - a))
            yield batch.slice(a, b - a), ids, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), encoder


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY, decode: bool = True) -> DataFrame:
    """doc_id, ids (array of int) and, with decode, decoded (the text that the ids decode to) for each row of docs."""

    def run(batches):
        for batch, ids, at, encoder in _encoded(batches, vocabulary):
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
            decoded = [pa.array([encoder.decode(ids[a:b]).decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string())] if decode else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, *decoded], names)

    names = ["doc_id", "ids", *["decoded"] * decode]
    return _input(docs).mapInArrow(giving_back(run), "doc_id long, ids array<int>" + ", decoded string" * decode)


def encode_digests(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: as encode_documents, but ids and texts stay in the workers."""

    def run(batches):
        for batch, ids, at, encoder in _encoded(batches, vocabulary):
            spans = [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            sha = [hashlib.sha256(x.tobytes()).hexdigest() for x in spans]
            decoded = [hashlib.sha256(encoder.decode(x)).hexdigest() for x in spans]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at)), pa.array(sha, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _input(docs).mapInArrow(giving_back(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _input(docs: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(read_table(spark, sf_dir, "documents"))


QUERIES = {"op7_bpe": op7_bpe}
ORACLE_SQL: dict[str, str] = {}
