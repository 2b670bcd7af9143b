"""Reading public tokenizer files, and encoding of text in pieces that a tokenizer can't join.

A tokenizer that first splits a text by a pattern encodes it as the concatenation of the encodings of any pieces whose
borders are borders of that pattern. Pieces recur all the time, so each worker keeps their ids in a bounded store, the
library encodes new pieces only, many in one call, and texts are put together from the store's rows by array operations.
"""

from __future__ import annotations

import os
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a store holds before it drops those that weren't met again.
PIECES = 400_000
#: Longer pieces are encoded but not kept.
LONGEST = 2000
#: Strings that go to the library in one text, parted by a special token.
JOINED = 64


def vocabulary_path(name: str) -> str:
    """Where the file of a public tokenizer lies; a path stays as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def load(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path(name))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Library:
    """The library's encodings of many strings at a time.

    Around a special token each side is encoded as a text of its own, so short strings joined by one give their own ids."""

    def __init__(self, name: str, dtype: str):
        self.tokenizer, self.dtype = load(name), np.dtype(dtype)
        plain = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items() if not (t.normalized or t.lstrip or t.rstrip or t.single_word)}
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.mark_id, self.mark = min(plain.items()) if plain else (-1, "")
        #: What a string has to hold to make, or to take part in, a special token.
        self.openings = sorted({s[:2] for s in self.special})

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and each text's number of ids."""
        found = [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([*found, np.zeros(0, self.dtype)]), np.array([len(x) for x in found], np.int64)

    def encode(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As whole, for many short strings."""
        alone = [i for i, s in enumerate(strings) if not self.mark or any(o in s for o in self.openings)]
        if len(alone) == len(strings):
            return self.whole(strings)
        if alone:
            apart = np.zeros(len(strings), bool)
            apart[alone] = True
            parts = [self.encode([strings[i] for i in np.flatnonzero(~apart).tolist()]), self.whole([strings[i] for i in alone])]
            order = np.argsort(np.concatenate([np.flatnonzero(~apart), alone]), kind="stable")
            ids, counts = (np.concatenate([p[j] for p in parts]) for j in (0, 1))
            return gather(ids, np.cumsum(counts) - counts, counts, order), counts[order]
        joined = [self.mark.join(strings[i : i + JOINED]) for i in range(0, len(strings), JOINED)]
        ids, ends = self.whole(joined)
        # A mark after each joined text, so that every string ends with one.
        ids = np.insert(ids, np.cumsum(ends), self.mark_id)
        marks = np.flatnonzero(ids == self.mark_id)
        if len(marks) != len(strings):
            return self.whole(strings)
        return ids[ids != self.mark_id], np.diff(marks, prepend=-1) - 1


def gather(ids: np.ndarray, starts: np.ndarray, counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The ids of rows, one after another; a row's ids are ids[start : start + count]."""
    n = counts[rows]
    ends = np.cumsum(n)
    at = np.arange(ends[-1] if len(ends) else 0)
    at += np.repeat(starts[rows] - ends + n, n)
    return ids[at]


class PieceStore:
    """Ids of pieces, a numbered row each; row 0 is empty. most: rows, and room: ids, that it holds before it drops some."""

    def __init__(self, library: Library, most: int = PIECES, room: int | None = None):
        self.library, self.most, self.room = library, most, room or 32 * most
        self.row_of: dict[str | bytes, int] = {}
        self.n = self.used = self.fixed = 0
        self.ids = np.zeros(1 << 16, library.dtype)
        self.starts, self.counts, self.met = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, bool)
        self.fix([])

    def fix(self, ids: list[int]) -> int:
        """A row of these ids that is never dropped; to be called before any piece is learnt."""
        self.fixed = self.append(np.array(ids, self.ids.dtype), np.array([len(ids)])) + 1
        return self.fixed - 1

    def append(self, ids: np.ndarray, counts: np.ndarray) -> int:
        """The first of the new rows."""
        first, at = self.n, self.used
        self.n, self.used = first + len(counts), at + len(ids)
        if self.used > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(self.used, self.ids.dtype)])
        if self.n > len(self.starts):
            self.starts, self.counts, self.met = (np.concatenate([x, np.zeros(self.n, x.dtype)]) for x in (self.starts, self.counts, self.met))
        self.ids[at : self.used] = ids
        self.counts[first : self.n] = counts
        self.starts[first : self.n] = at + np.cumsum(counts) - counts
        self.met[first : self.n] = False
        return first

    def known(self, keys: list) -> np.ndarray:
        """The row of each key, -1 for new ones."""
        found = np.fromiter(map(self.row_of.get, keys, repeat(-1)), np.int64, len(keys))
        self.met[found[found >= 0]] = True
        return found

    def rows(self, pieces: list[str]) -> np.ndarray:
        """The row of each piece; the library encodes new ones."""
        found = self.known(pieces)
        new = np.flatnonzero(found < 0)
        if len(new):
            new_pieces = [pieces[i] for i in new.tolist()]
            strings = list(dict.fromkeys(new_pieces))
            first = self.append(*self.library.encode(strings))
            learnt = dict(zip(strings, range(first, self.n), strict=True))
            found[new] = np.fromiter(map(learnt.__getitem__, new_pieces), np.int64, len(new))
            self.row_of.update((p, r) for p, r in learnt.items() if len(p) <= LONGEST)
        return found

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of rows, one after another, and how many each has."""
        return gather(self.ids, self.starts, self.counts, rows), self.counts[rows]

    def turn(self) -> bool:
        """To be called between blocks of texts. A full store keeps what was met again, the latest half at most; rows are other ones afterwards."""
        if self.n <= self.most and self.used <= self.room:
            return False
        keep = self.met[: self.n].copy()
        if self.used > self.room:  # long rows: the latest ones within half of the room
            keep &= np.cumsum((self.counts[: self.n] * keep)[::-1])[::-1] <= self.room // 2
        late = np.flatnonzero(keep)
        keep[late[: max(0, len(late) - self.most // 2)]] = False
        keep[: self.fixed] = True
        stays, moved = keep.tolist(), (np.cumsum(keep) - 1).tolist()
        self.row_of = {p: moved[r] for p, r in self.row_of.items() if stays[r]}
        ids, counts = self.gather(np.flatnonzero(keep))
        self.n = self.used = 0
        self.append(ids, counts)
        return True


#: Classes of bytes: of characters beyond ASCII and control characters, letters, digits, marks, the apostrophe, a blank, other white space.
_OTHER, _LETTER, _DIGIT, _MARK, _QUOTE, _BLANK, _SPACE = range(7)
_CLASS = np.zeros(256, np.uint8)
for _i in range(33, 127):
    _CLASS[_i] = _LETTER if chr(_i).isalpha() else _DIGIT if chr(_i).isdigit() else _MARK
_CLASS[ord("'")], _CLASS[ord(" ")], _CLASS[9:14] = _QUOTE, _BLANK, _SPACE
#: Whether a piece always ends between bytes of two classes. A letter behind an apostrophe may belong to it.
_ENDS = np.zeros((8, 8), bool)
for _pair in ((_LETTER, _DIGIT), (_DIGIT, _LETTER), (_LETTER, _MARK), (_LETTER, _QUOTE), (_DIGIT, _MARK), (_DIGIT, _QUOTE), (_MARK, _LETTER), (_MARK, _DIGIT)):
    _ENDS[_pair] = True
_ENDS[_LETTER : _QUOTE + 1, _BLANK : _SPACE + 1] = True
#: First bytes of characters that are never white space: visible ASCII, and beyond it all but those that U+0085, U+00A0, U+1680, U+2000 and following, and U+3000 begin with.
_VISIBLE = np.zeros(256, bool)
_VISIBLE[33:127] = _VISIBLE[0xC3:] = True
_VISIBLE[[0xE1, 0xE2, 0xE3]] = False


def piece_borders(data: np.ndarray, borders: np.ndarray, keep_blanks: bool) -> np.ndarray:
    """Where pieces begin, and len(data): at all borders of texts, and where every text's tokenization has a border.

    Of white space before a visible character the last one stands alone, and with keep_blanks a blank goes with what
    follows it, as byte-level tokenizers have it."""
    kind = _CLASS[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[borders] = begins[len(data)] = True
    if len(data) > 1:
        begins[1:-1] |= _ENDS.ravel()[kind[:-1] * np.uint8(8) + kind[1:]]
        before = np.zeros(len(data), bool)
        before[:-1] = (kind[:-1] >= _BLANK) & _VISIBLE[data[1:]]
        # The last character of a text stands before none of this text.
        inner = borders[(borders > 0) & (borders < len(data))]
        before[inner - 1] = False
        begins[:-1] |= before
        begins[1:] |= before & (kind == _SPACE) if keep_blanks else before
    return np.flatnonzero(begins)


def pieces_of(data: np.ndarray, starts: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The distinct strings from each start to the next, and the number among them of each."""
    cut = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(data))
    coded = cut.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy()


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts without nulls, one after another, and where each begins (one more entry than texts)."""
    texts = texts.cast(pa.string())
    _, offsets, data = texts.buffers()
    borders = np.frombuffer(offsets, np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[borders[0] : borders[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, borders - borders[0]


def sides(texts: pa.Array, library: Library) -> tuple[pa.Array, np.ndarray, np.ndarray] | None:
    """The sides of special tokens in texts, where each text's sides begin, and the special token's id behind each side (-1: none); None without any.

    Around a special token each side is encoded as a text of its own."""
    if not any(pc.any(pc.match_substring(texts, s)).as_py() for s in library.special):
        return None
    apart = re.compile("(" + "|".join(map(re.escape, library.special)) + ")")
    parts = [apart.split(t) for t in texts.to_pylist()]
    behind = [library.special.get(p, -1) for text in parts for p in [*text, ""][1::2]]
    return pa.array([p for text in parts for p in text[::2]], pa.string()), np.cumsum([0, *(len(t) // 2 + 1 for t in parts)]), np.array(behind)


def joined_sides(ids: np.ndarray, counts: np.ndarray, begins: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts, and how many each has, from those of their sides."""
    special = behind >= 0
    ids = np.insert(ids, np.cumsum(counts)[special], behind[special])
    return ids, np.add.reduceat(counts + special, begins[:-1])


class BlankEncoder:
    """For byte-level tokenizers with the pattern of letters, digits, marks and white space, each with a blank before it."""

    def __init__(self, name: str, dtype: str = "<u2", most: int = PIECES):
        self.store = PieceStore(Library(name, dtype), most)

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a column of texts without nulls, one text after another, and how many each has, with end_id behind each."""
        if apart := sides(texts, self.store.library):
            ids, counts = joined_sides(*self._encode(apart[0]), *apart[1:])
        else:
            ids, counts = self._encode(texts)
        if end_id is not None:
            ids = np.insert(ids, np.cumsum(counts), end_id)
            counts = counts + 1
        return ids, counts

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, borders = bytes_of(texts)
        starts = piece_borders(data, borders[:-1], True) if len(data) else np.zeros(1, np.int64)
        distinct, code = pieces_of(data, starts)
        ids, counts = self.store.gather(self.store.rows(distinct)[code])
        self.store.turn()
        before = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(before[np.searchsorted(starts, borders)])


def text_blocks(column, most_bytes: int = 1 << 20):
    """Slices (start, end) of an Arrow column of texts, each of about most_bytes or one text."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > most_bytes:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)
