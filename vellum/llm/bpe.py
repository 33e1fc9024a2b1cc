"""Byte-level BPE: encoding by batched merge rounds in numpy, decoding from a table of bytes."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vellum.llm._store import ship
from vellum.llm.pieces import SPACE, Classifier, Known, Table, byte_blocks, gathered, join_endings, numbered, run_starts, table, text_bytes

#: Pieces whose ids a worker remembers; code points of text that one round of batches of other operators takes.
REMEMBERED, BLOCK_CHARS = 500_000, 2_000_000
NONE = np.iinfo(np.int64).max


def byte_letters() -> dict[str, int]:
    """Letter of a byte-level vocabulary -> byte: printable bytes stand for themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Bpe:
    """Encoder and decoder of one vocabulary file; immutable but for the pieces that it remembers.

    Texts are split over bytes, with the classes of code points that the tokenizers library has.
    """

    def __init__(self, path: str, classes: Table):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec["normalizer"] or model["end_of_word_suffix"]:
            raise ValueError(f"{path}: not a byte-level BPE without prefix space and normalizer")
        vocab, letters = model["vocab"], byte_letters()
        self.special = {x["content"].encode(): x["id"] for x in spec["added_tokens"]}
        self.base = max([*vocab.values(), *self.special.values()]) + 1
        self.byte_id = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.byte_id[b] = vocab[letter]
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        key = left * self.base + right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        bytes_of = [b""] * self.base
        for token, i in vocab.items():
            bytes_of[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for token, i in self.special.items():
            bytes_of[i] = token
        self.size = np.array(list(map(len, bytes_of)), np.int64)
        self.begin, self.flat = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(bytes_of), np.uint8)
        self.classify, self.known = Classifier(classes), Known(REMEMBERED)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each piece, ids of all). All pieces take part in each round: every piece merges all places of its lowest-ranked pair."""
        fixed = [k for k, p in enumerate(pieces) if p in self.special]
        sizes = np.array(list(map(len, pieces)), np.int64)
        sym = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        word = np.repeat(np.arange(len(pieces)), sizes)
        if fixed:
            plain = ~np.isin(word, fixed)
            sym, word = np.r_[sym[plain], [self.special[pieces[k]] for k in fixed]], np.r_[word[plain], fixed]
        done_sym, done_word = [], []
        while len(sym):
            key = sym[:-1] * self.base + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.full(len(sym), NONE)
            hit = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank[:-1][hit] = self.ranks[at[hit]]
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(sym)]))
            over = low == NONE
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
            place = np.flatnonzero((rank == low) & ~over)
            if not len(place):
                break
            # in a run of overlapping places (a a a) the first, third, ... merge
            fresh = np.r_[True, np.diff(place) != 1]
            nth = np.arange(len(place)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            place = place[nth % 2 == 0]
            sym[place] = self.made[at[place]]
            stay = ~over
            stay[place + 1] = False
            sym, word = sym[stay], word[stay]
        sym, word = np.concatenate([*done_sym, sym[:0]]), np.concatenate([*done_word, word[:0]])
        order = np.argsort(word, kind="stable")
        return np.bincount(word, minlength=len(pieces)), sym[order].astype(np.int32)

    def split(self, data: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Marks of the bytes where a piece begins: runs of letters, of digits, of marks, each with a space before it, and of white space."""
        c = self.classify(data)
        begin = run_starts(c.kind, rows)
        if not len(data):
            return begin
        # the last code point of white space before other text is a piece, or begins one if it is a space
        after = np.flatnonzero(begin[1:] & (c.kind[:-1] == SPACE) & (c.kind[1:] != SPACE)) + 1
        after = after[~np.isin(after, rows)]
        last = after - 1
        for _ in range(3):
            last = np.where(c.lead[last], last, last - 1)
        begin[last] = True
        begin[after[data[after - 1] == 0x20]] = False
        join_endings(begin, c, rows)
        return begin

    def learn(self, pieces: list[bytes]) -> None:
        for i in range(0, len(pieces), 50_000):
            some = pieces[i : i + 50_000]
            self.known.add(some, *self.merge(some))

    def encode(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each row, ids of all rows) of a block of UTF-8 texts; `rows` are their offsets.

        Strings of special tokens become their ids.
        """
        begin, raw, fixed = None, None, []
        for text, i in self.special.items():
            raw = data.tobytes() if raw is None else raw
            found = raw.find(text)
            while found >= 0:
                if np.searchsorted(rows, found, side="right") == np.searchsorted(rows, found + len(text) - 1, side="right"):
                    fixed.append((found, len(text), i))
                found = raw.find(text, found + 1)
        taken: list[tuple[int, int, int]] = []
        for at, size, i in sorted(fixed, key=lambda x: (x[0], -x[1])):
            if not taken or at >= taken[-1][0] + taken[-1][1]:
                taken.append((at, size, i))
        edges = np.unique(np.r_[rows, np.array([e for at, size, _ in taken for e in (at, at + size)], np.int64)])
        begin = self.split(data, edges)
        for at, size, _ in taken:
            begin[at] = True
            begin[at + 1 : at + size] = False
        starts = np.flatnonzero(begin)
        numbers, pieces = numbered(data, starts)
        self.learn(self.known.missing(pieces))
        sizes, ids = self.known.ids(pieces, numbers)
        return np.diff(np.r_[0, np.cumsum(sizes)][np.searchsorted(starts, rows)]), ids

    def decode(self, sizes: np.ndarray, ids: np.ndarray) -> pa.Array:
        """The texts of rows of so many ids each, special ones included; bytes that are no UTF-8 become U+FFFD."""
        n_bytes, data = gathered(self.flat, self.begin, self.size, ids)
        ends = np.r_[0, np.cumsum(n_bytes)][np.cumsum(sizes)]
        rows = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(data)])
        try:
            return rows.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([x.decode("utf-8", "replace") for x in rows.to_pylist()], pa.string())


def blocks(texts: list[str | None], chars: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about `chars` code points together; a longer text is alone."""
    start, n = 0, 0
    for i, t in enumerate(texts):
        size = len(t or "")
        if n and n + size > chars:
            yield start, i
            start, n = i, 0
        n += size
    if start < len(texts):
        yield start, len(texts)


_coders: dict[str, Bpe] = {}


def coder(path: str, classes: Table) -> Bpe:
    """The worker's own encoder, which later tasks of the same process go on to use."""
    if path not in _coders:
        _coders[path] = Bpe(path, classes)
    return _coders[path]


def bpe(docs: DataFrame, path: str, text_col: str = "text", decode: bool = True) -> DataFrame:
    """`docs` with ids (array of int) and, on request, decoded (string) of each whole text.

    `path` is a tokenizers JSON file of a byte-level BPE, at the same place on all machines. Ids equal
    the tokenizers library's without added special tokens; decoded is the library's decode of the ids.

    Null and empty texts have no ids and decode to the empty text. Repeated rows are encoded one by one.
    An empty table gives an empty one. Columns of `docs` named ids or decoded are replaced.

    No shuffle: batches of rows go through Arrow, blocks of a bounded number of code points at a time; a
    longer text is a block of its own. A worker remembers the ids of a bounded number of pieces.
    """
    ship(docs.sparkSession)
    made = ("ids", "decoded") if decode else ("ids",)
    base = docs.drop(*made)
    fields = [*base.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)]
    fields += [T.StructField("decoded", T.StringType(), False)] if decode else []
    where = base.columns.index(text_col)

    classes = table(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = coder(path, classes)
        for batch in batches:
            data, rows = text_bytes(batch.column(where))
            for a, b in byte_blocks(rows):
                sizes, ids = words.encode(data[rows[a] : rows[b]], rows[a : b + 1] - rows[a])
                offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
                cols = [*batch.slice(a, b - a).columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))]
                cols += [words.decode(sizes, ids)] if decode else []
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return base.mapInArrow(run, T.StructType(fields))
