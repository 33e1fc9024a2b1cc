"""Texts to pieces in numpy, over the UTF-8 bytes of whole blocks: classes of code points, runs of a class, numbers of distinct pieces."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LETTER, DIGIT, MARK, SPACE, OTHER = range(5)
#: A code point has the class of the one here that the library splits like it, before and after each of them.
_LIKE = {"a": LETTER, "1": DIGIT, "!": MARK, "\t": SPACE, " ": SPACE}
_POINTS = 0x110000
#: Code points that Unicode has given out, or may; those beyond are private or in planes without any, and alike.
_GIVEN = [c for c in (*range(0x40000), *range(0xE0000, 0xE1000)) if not 0xD800 <= c < 0xE000]
_BEYOND = 0x40000
#: Bytes of text that one block takes; a longer text is a block of its own.
BLOCK_BYTES = 4_000_000


class Table(NamedTuple):
    """Classes of all code points as runs, and those that normalisation changes; small enough to go with a task.

    OTHER are code points whose normalisation depends on their neighbours or changes their length in UTF-8.
    """

    starts: np.ndarray
    kinds: np.ndarray
    changed: np.ndarray
    to: np.ndarray

    def kind(self) -> np.ndarray:
        return np.repeat(self.kinds, np.diff(np.r_[self.starts, _POINTS]))


def _classes(pre) -> np.ndarray:
    """Class of each code point, by the spans into which the library's pre-tokenizer splits strings that hold it."""

    def spans(c: str) -> tuple:
        return tuple(tuple(s for _, s in pre.pre_tokenize_str(x)) for r in "a1!" for x in (r + c + r, r + c + c))

    known = {spans(c): k for c, k in _LIKE.items()}
    out = np.full(_POINTS, known[spans(chr(_BEYOND))], np.uint8)
    out[0xD800:0xE000] = OTHER
    at, gap = np.array(_GIVEN), np.ones(len(_GIVEN), bool)
    for _, (a, b) in pre.pre_tokenize_str("".join(map(chr, _GIVEN))):  # a piece is of one class but for its first code point
        gap[a:b] = False
        out[at[a]] = known[spans(chr(at[a]))]
        if b > a + 1:
            out[at[a + 1 : b]] = known[spans(chr(at[a + 1]))]
    for c in at[gap]:
        out[c] = known[spans(chr(c))]
    return out


def _meets_neighbours(c: int) -> bool:
    """Canonical composition may join or reorder it with others; so may code points that Python's tables do not have."""
    return unicodedata.combining(chr(c)) != 0 or unicodedata.category(chr(c)) == "Cn" or 0x1100 <= c < 0x1200


@lru_cache(maxsize=8)
def table(path: str) -> Table:
    """The table of a tokenizers file, from the library's own normalizer and pre-tokenizer; about a second."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    kind, changed, to = _classes(t.pre_tokenizer), [], []
    if t.normalizer is not None:
        points = [c for c in _GIVEN if c != 1]
        got = t.normalizer.normalize_str("\x01".join(map(chr, points))).split("\x01")
        second = {int(p[1], 16) for p in (unicodedata.decomposition(chr(c)).split() for c in points) if len(p) == 2 and p[0][0] != "<"}
        raw = kind.copy()
        kind[np.isin(np.arange(_POINTS), _GIVEN, invert=True)] = OTHER
        for c, s in zip(points, got, strict=True):
            if s == " ":
                kind[c] = SPACE
            elif c in second or _meets_neighbours(c) or len(s) != 1 or len(s.encode()) != len(chr(c).encode()):
                kind[c] = OTHER
            elif ord(s) != c:
                kind[c] = raw[ord(s)]
                changed.append(c)
                to.append(ord(s))
    starts = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]])
    return Table(starts, kind[starts], np.array(changed, np.int64), np.array(to, np.int64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of strings without a copy; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at.astype(np.int64) - int(at[0])


def byte_blocks(offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `size` bytes of text together; a longer text is alone."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1)
        yield start, min(end, n)
        start = min(end, n)


class Classified(NamedTuple):
    data: np.ndarray  # normalised bytes
    kind: np.ndarray  # class of each byte's code point
    lead: np.ndarray  # first bytes of code points
    other: np.ndarray  # places of code points of no class


class Classifier:
    """Classes of the code points of UTF-8 bytes by a table."""

    def __init__(self, t: Table):
        self.kind = t.kind()
        self.to = np.arange(_POINTS, dtype=np.int32)
        self.to[t.changed] = t.to
        self.low, self.ascii = self.to[:256].copy(), self.kind[:256].copy()
        self.low[128:] = np.arange(128, 256)
        self.low, self.ascii = self.low.astype(np.uint8), self.ascii
        self.normal = len(t.changed) > 0

    def __call__(self, data: np.ndarray) -> Classified:
        kind = self.ascii[data]
        lead = (data & 0xC0) != 0x80
        out = self.low[data] if self.normal else data
        wide = np.flatnonzero(data >= 0xC0)
        if not len(wide):
            return Classified(out, kind, lead, np.empty(0, np.int64))
        more = np.r_[data[wide[0] :], np.zeros(3, np.uint8)]  # a cut code point at the end reads zeros
        b = [more[wide - wide[0] + k].astype(np.int32) for k in range(4)]
        size = 2 + (b[0] >= 0xE0) + (b[0] >= 0xF0)
        tail = [x & 0x3F for x in b]
        point = np.where(size == 2, (b[0] & 0x1F) << 6 | tail[1], np.where(size == 3, (b[0] & 0x0F) << 12 | tail[1] << 6 | tail[2], (b[0] & 0x07) << 18 | tail[1] << 12 | tail[2] << 6 | tail[3]))
        of = self.kind[point]
        for k in range(4):
            some = size > k
            kind[wide[some] + k] = of[some]
        to = self.to[point]
        if self.normal and (new := np.flatnonzero((to != point) & (of < OTHER))).size:
            for k in range(4):
                some = new[size[new] > k]
                shift = 6 * (size[some] - 1 - k)
                out[wide[some] + k] = (to[some] >> shift) & 0x3F | 0x80
            head = np.array([0, 0, 0xC0, 0xE0, 0xF0])[size[new]]
            out[wide[new]] = (to[new] >> (6 * (size[new] - 1))) | head
        return Classified(out, kind, lead, wide[of == OTHER])


def run_starts(kind: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Marks of the bytes where a run of one class begins; `rows` are the offsets of the rows, where runs end too."""
    out = np.empty(len(kind), bool)
    out[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=out[1:])
    out[rows[rows < len(kind)]] = True
    return out


#: Endings after an apostrophe that are one piece with it.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def join_endings(begin: np.ndarray, c: Classified, rows: np.ndarray) -> None:
    """Let an apostrophe that is a whole piece before letters take the ending that they begin with, in place."""
    at = np.flatnonzero(c.data[:-1] == 0x27)
    at = at[begin[at] & begin[at + 1] & (c.kind[at + 1] == LETTER)]
    at = at[~np.isin(at + 1, rows)]
    if not len(at):
        return
    one = c.data[at + 1]
    second = np.minimum(at + 2, len(c.data) - 1)
    two = np.where((at + 2 < len(c.data)) & ~begin[second], c.data[second], 0)
    for ending in ENDINGS:
        fits = one == ord(ending[0])
        if len(ending) == 2:
            fits = fits & (two == ord(ending[1]))
        begin[at[fits] + 1] = False
        stop = at[fits] + 1 + len(ending)
        begin[stop[stop < len(begin)]] = True


def numbered(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(number of each piece, the distinct pieces); pieces lie end to end in `data`."""
    if not len(starts):
        return np.empty(0, np.int32), []
    offsets = np.r_[starts, len(data)].astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    coded = pieces.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist()


class Known:
    """Ids of pieces, remembered up to a number of pieces; one flat array holds them."""

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.begin, self.size, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def missing(self, pieces: list[bytes]) -> list[bytes]:
        """Those of distinct pieces that are not known; too many known ones are forgotten first."""
        if len(self.at) > self.limit:
            self.clear()
        return [p for p in pieces if p not in self.at]

    def add(self, pieces: list[bytes], sizes: np.ndarray, ids: np.ndarray) -> None:
        n = len(self.at)
        self.at.update(zip(pieces, range(n, n + len(pieces)), strict=True))
        self.begin = np.r_[self.begin, len(self.flat) + np.cumsum(sizes) - sizes]
        self.size = np.r_[self.size, sizes]
        self.flat = np.r_[self.flat, ids.astype(np.int32)]

    def ids(self, pieces: list[bytes], numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids) of the pieces in order, each by its number."""
        if not len(numbers):
            return np.empty(0, np.int64), np.empty(0, np.int32)
        own = np.fromiter(map(self.at.__getitem__, pieces), np.int64, len(pieces))
        return gathered(self.flat, self.begin[own], self.size[own], numbers)


def gathered(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, values) of the slices flat[begin : begin + size] that `numbers` name, one after the other."""
    sizes = size[numbers]
    ends = np.cumsum(sizes)
    where = np.repeat(begin[numbers] - ends + sizes, sizes)
    where += np.arange(len(where))
    return sizes, flat[where]
