"""Toxicity: a linear-chain conditional random field tags toxic words; marginals make scores and offsets."""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm._store import ship
from vellum.llm.ngram_join import mixed, shingles
from vellum.llm.pieces import LETTER, SPACE, Classifier, Table, byte_blocks, gathered, numbered, run_starts, text_bytes

#: The fit takes at most so many labelled documents of each kind, whole.
FIT_TOXIC, FIT_CLEAN = 3000, 6000
#: A word marks toxic text if so many groups of near copies of toxic texts have it (and so many neighbours), at so many times the clean
#: rate, and if fewer than CHANCE marks of all would do so by chance.
MIN_GROUPS, MIN_RATIO, CHANCE = 4, 4.0, 0.05
#: The field's weights are fitted on so many texts of each kind, whole, cut into sequences of so many words; steps of the fit.
FIT_TEXTS, SEQUENCE, STEPS, RATE = 120, 200, 80, 0.2
#: Words with the highest marginals that make the document's score; limits of its weights.
TOP, DENSITY, DOCUMENT_STEPS = 3, 5.0, 400
#: Besides the word itself, its beginnings of these lengths can mark toxic text (inflected and compound words).
#: A beginning needs so many different words in toxic texts.
STEMS, STEM_WORDS = (4, 5, 6, 7), 3
#: Words of a worker whose marks are remembered; words of one batch of sequences; bytes of text that the fit takes at a time.
REMEMBERED, CELLS, FIT_BLOCK = 500_000, 250_000, 500_000
N_FEATURES = 6


@dataclass
class Field:
    """What a fit gives.

    words: log ratio of each marking word, or beginning of words (with a hyphen after it). emit: weights
    for the toxic tag of (1, the word's ratio, the ratio of its beginning, ratio before, ratio after,
    capitals). move: weights between tags. document: weights of `summary` for a document's score.
    """

    words: dict[str, float]
    emit: np.ndarray
    move: np.ndarray
    document: np.ndarray = field(default_factory=lambda: np.array([-3.0, 6.0, 0.0, 0.0]))


def marks(word: str) -> list[str]:
    """What can mark toxic text in a word: itself and its beginnings."""
    return [word, *(f"{word[:k]}-" for k in STEMS if k <= len(word))]


@lru_cache(maxsize=1)
def letters() -> Classifier:
    """Letters against all else, and the lower case of those that keep their length in UTF-8."""
    points = (c for c in range(0x40000) if not 0xD800 <= c < 0xE000)  # there are no letters beyond
    kind = np.full(0x110000, SPACE, np.uint8)
    low = []
    for c in points:
        x = chr(c)
        if x.isalpha():
            kind[c] = LETTER
            y = x.lower()
            if y != x and len(y) == 1 and len(y.encode()) == len(x.encode()):
                low.append((c, ord(y)))
    starts = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]])
    return Classifier(Table(starts, kind[starts], np.array([c for c, _ in low]), np.array([x for _, x in low])))


@dataclass
class Split:
    """Words of a block of texts: runs of letters in lower case, by number, with their places in bytes.

    Of row r they are first[r] to first[r + 1].
    """

    numbers: np.ndarray
    words: list[str]
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    capital: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def split(data: np.ndarray, rows: np.ndarray) -> Split:
    c = letters()(data)
    keep = c.kind == LETTER
    begin = run_starts(c.kind, rows) & keep
    last = keep.copy()
    last[:-1] &= ~keep[1:]
    last[rows[1:-1][rows[1:-1] > 0] - 1] = keep[rows[1:-1][rows[1:-1] > 0] - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
    numbers, words = numbered(c.data[keep], np.flatnonzero(begin[keep]))
    second = np.minimum(starts + 1, max(0, len(data) - 1))
    capital = (c.data[starts] != data[starts]) & (c.data[second] != data[second]) if len(starts) else np.empty(0, bool)
    return Split(numbers, [w.decode("utf-8", "replace") for w in words], starts, ends, np.searchsorted(starts, rows), capital)


def split_all(texts: pa.Array) -> Split:
    """`split` of many texts block by block, without places; numbers are of all texts' words together."""
    number: dict[str, int] = {}
    numbers, capital, first = [], [], [np.zeros(1, np.int64)]
    data, rows = text_bytes(texts)
    for a, b in byte_blocks(rows, FIT_BLOCK):
        s = split(data[rows[a] : rows[b]], rows[a : b + 1] - rows[a])
        own = np.array([number.setdefault(w, len(number)) for w in s.words], np.int32)
        numbers.append(own[s.numbers])
        capital.append(s.capital)
        first.append(s.first[1:] + first[-1][-1])
    join = lambda xs, kind: np.concatenate([*xs, np.empty(0, kind)])
    none = np.empty(0, np.int64)
    return Split(join(numbers, np.int32).astype(np.int32), list(number), none, none, np.concatenate(first), join(capital, bool).astype(bool))


class Ratios:
    """Log ratios of words and of their beginnings, for a list of distinct words; remembers some."""

    def __init__(self, words: dict[str, float]):
        self.words, self.heads = words, {x[:3] for x in words}
        self.known: dict[str, tuple[float, float]] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        """(words, 2): the word's own log ratio, the largest of its beginnings; 0 without."""
        out = np.zeros((len(words), 2))
        for i, w in enumerate(words):
            if w[:3] in self.heads:
                got = self.known.get(w)
                if got is None:
                    if len(self.known) > REMEMBERED:
                        self.known.clear()
                    got = self.known[w] = (self.words.get(w, 0.0), max(self.words.get(m, 0.0) for m in marks(w)[1:] or [""]))
                out[i] = got
        return out


def _features(ratio: np.ndarray, capital: np.ndarray, length: np.ndarray) -> np.ndarray:
    """(texts, words, N_FEATURES) from (texts, words, 2) ratios padded with zeros."""
    most = ratio.max(2)
    before, after = np.zeros_like(most), np.zeros_like(most)
    before[:, 1:], after[:, :-1] = most[:, :-1], most[:, 1:]
    inside = np.arange(most.shape[1]) < length[:, None]
    marked = most > 0
    return np.stack([np.ones_like(most), ratio[:, :, 0], ratio[:, :, 1], before, after, capital & marked], 2) * inside[:, :, None]


def _chain(emit: np.ndarray, length: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Marginals of the toxic tag (texts, words) by forward-backward, and the messages.

    emit: score of the toxic tag against the other; words past a text's length have marginal 0.
    """
    n, width = emit.shape
    potential = np.exp(move)
    top = np.maximum(emit, 0.0)
    scale = np.stack([np.exp(-top), np.exp(emit - top)], 2).transpose(1, 0, 2).copy()  # a step's texts lie together
    forward, backward = np.empty((width, n, 2)), np.ones((width, n, 2))
    a = scale[0] / scale[0].sum(1, keepdims=True)
    forward[0] = a
    for t in range(1, width):
        a = (a @ potential) * scale[t]
        a /= a.sum(1, keepdims=True)
        forward[t] = a
    b = np.ones((n, 2))
    for t in range(width - 2, -1, -1):
        b = (b * scale[t + 1]) @ potential.T
        b /= b.sum(1, keepdims=True)
        b[t + 1 >= length] = 1.0
        backward[t] = b
    inside = (np.arange(width)[:, None] < length).astype(float)
    both = forward * backward
    marginal = (both[:, :, 1] / both.sum(2) * inside).T
    return marginal, (forward, scale * backward, inside)


def _moves(chain: tuple[np.ndarray, ...], move: np.ndarray) -> np.ndarray:
    """Expected moves between tags (2, 2), summed up over all texts, from a chain's messages."""
    forward, back, inside = chain
    potential = np.exp(move)
    each = [[forward[:-1, :, i] * (potential[i, j] * back[1:, :, j]) for j in (0, 1)] for i in (0, 1)]
    weight = inside[1:] / sum(each[0] + each[1])
    return np.array([[(each[i][j] * weight).sum() for j in (0, 1)] for i in (0, 1)])


def _padded(values: np.ndarray, first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, longest, ...) of the values first[r] to first[r + 1] of each of `rows`, and their numbers."""
    length = first[rows + 1] - first[rows]
    out = np.zeros((len(rows), max(1, int(length.max(initial=0))), *values.shape[1:]), values.dtype)
    out[np.arange(out.shape[1]) < length[:, None]] = values[np.repeat(first[rows], length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)]
    return out, length


def _tail(k: int, n: int, p: float) -> float:
    """Chance of k or more of n at probability p."""
    log = lambda x: math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) + x * math.log(p) + (n - x) * math.log(1 - p)
    return sum(math.exp(log(x)) for x in range(k, n + 1))


def _groups(texts: pa.Array) -> np.ndarray:
    """A number for each text; texts with one of three least shingle hashes in common have the same."""
    up, first = list(range(len(texts))), {}

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    _, rows = text_bytes(texts)
    for a, b in byte_blocks(rows, FIT_BLOCK):
        owner, got = shingles(texts.slice(a, b - a).to_pylist())
        at = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else owner
        for salt in (11, 12, 13) if len(owner) else ():
            for d, h in zip((owner[at] + a).tolist(), np.minimum.reduceat(mixed(got, salt), at).tolist(), strict=True):
                up[root(d)] = root(first.setdefault((salt, h), d))
    return np.array([root(i) for i in range(len(texts))], np.int64)


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of numbers."""
    key = a.astype(np.int64) << 32
    key |= b
    key.sort()
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    return key >> 32, key & 0xFFFFFFFF


class _Marks:
    """Numbers of the marks of some words, flat."""

    def __init__(self, n_words: int):
        self.begin, self.size, self.flat = np.zeros(n_words, np.int64), np.zeros(n_words, np.int64), array("i")

    def add(self, word: int, numbers: list[int]) -> None:
        self.begin[word], self.size[word] = len(self.flat), len(numbers)
        self.flat.extend(numbers)

    def spread(self, words: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(mark, other) for every mark of each word."""
        n, flat = gathered(np.frombuffer(self.flat, np.int32) if len(self.flat) else np.empty(0, np.int32), self.begin, self.size, words)
        return flat, np.repeat(others, n)

    def only(self, good: np.ndarray) -> _Marks:
        out = _Marks(len(self.size))
        for w in np.flatnonzero(self.size):
            out.add(w, [i for i in self.flat[self.begin[w] : self.begin[w] + self.size[w]] if good[i]])
        return out


def marking(s: Split, toxic: np.ndarray, groups: np.ndarray) -> dict[str, float]:
    """Log ratio of the marks that groups of toxic texts have more often than clean ones, beyond chance.

    A mark's evidence is the lesser of the groups and the different neighbours that it has in toxic
    texts: a passage that many of them share marks nothing.
    """
    n_groups = [len(np.unique(groups[toxic == k])) for k in (0, 1)]
    if not all(n_groups):
        return {}
    row = s.row
    at = np.flatnonzero((toxic == 1)[row])
    pairs = _distinct(s.numbers[at], groups[row[at]])
    number: dict[str, int] = {}
    of = _Marks(len(s.words))
    in_texts = np.unique(pairs[0])
    for w in in_texts:
        of.add(w, [number.setdefault(m, len(number)) for m in marks(s.words[w])])
    in_toxic = np.bincount(_distinct(*of.spread(*pairs))[0], minlength=len(number))
    often = in_toxic >= MIN_GROUPS
    names, heads = list(number), {m[:3] for m, i in number.items() if often[i]}
    kept = _Marks(len(s.words))
    for w, word in enumerate(s.words):
        if word[:3] in heads:
            kept.add(w, [i for m in marks(word) if (i := number.get(m, -1)) >= 0 and often[i]])
    clean = np.flatnonzero((toxic == 0)[row] & (kept.size[s.numbers] > 0))
    in_clean = np.bincount(_distinct(*kept.spread(*_distinct(s.numbers[clean], groups[row[clean]])))[0], minlength=len(number))
    rate = (in_toxic / n_groups[1]) / ((in_clean + 0.5) / n_groups[0])
    likely = often & (rate >= MIN_RATIO)
    kept = kept.only(likely)
    at = at[kept.size[s.numbers[at]] > 0]
    beside = [np.where(np.isin(at, s.first), 0, s.numbers[at - 1] + 1), np.where(np.isin(at + 1, s.first), 0, s.numbers[np.minimum(at + 1, len(s.numbers) - 1)] + 1)]
    _, neighbours = np.unique(beside[0].astype(np.int64) << 32 | beside[1], return_inverse=True)
    near = np.bincount(_distinct(*kept.spread(s.numbers[at], neighbours))[0], minlength=len(number))
    spelled = np.bincount(kept.spread(in_texts, in_texts)[0], minlength=len(number))
    share, out = n_groups[1] / sum(n_groups), {}
    for i in np.flatnonzero(likely):
        m, n, c = names[i], int(min(in_toxic[i], near[i])), int(in_clean[i])
        r = (n / n_groups[1]) / ((c + 0.5) / n_groups[0])
        if (m[-1] != "-" or spelled[i] >= STEM_WORDS) and n >= MIN_GROUPS and r >= MIN_RATIO and _tail(n, n + c, share) * len(number) < CHANCE:
            out[m] = float(min(math.log(r), 6.0))
    return out


def _weights(s: Split, toxic: np.ndarray, words: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """(emit, move) by gradient ascent on the likelihood of the tags; a word's is toxic if its text is and it has a mark."""
    emit, move = np.array([-4.0, 1.0, 1.0, 0.0, 0.0, 0.0]), np.zeros((2, 2))
    some = np.concatenate([np.flatnonzero((toxic == k) & (np.diff(s.first) > 0))[:FIT_TEXTS] for k in (1, 0)])
    bounds = [np.r_[np.arange(s.first[r], s.first[r + 1], SEQUENCE), s.first[r + 1]] for r in some]
    begin, end = np.concatenate([b[:-1] for b in bounds]), np.concatenate([b[1:] for b in bounds])
    bad = np.repeat(toxic[some], [len(b) - 1 for b in bounds])
    length = end - begin
    at = begin[:, None] + np.arange(length.max())
    inside = at < end[:, None]
    at = np.where(inside, at, 0)
    ratio = Ratios(words)(s.words)[s.numbers][at] * inside[:, :, None]
    tag = (ratio.max(2) > 0) & (bad == 1)[:, None]
    x = _features(ratio, s.capital[at], length)
    pairs = inside[:, 1:]
    moves = np.array([[((tag[:, :-1] == a) & (tag[:, 1:] == b) & pairs).sum() for b in (0, 1)] for a in (0, 1)])
    n = inside.sum()
    speed, spread = [np.zeros(N_FEATURES), np.zeros((2, 2))], [np.zeros(N_FEATURES), np.zeros((2, 2))]
    for step in range(1, STEPS + 1):  # Adam, with a weak Gaussian prior
        marginal, chain = _chain(x @ emit, length, move)
        off = ((tag - marginal) * inside).ravel()
        slope = [off @ x.reshape(-1, N_FEATURES) / n - 1e-4 * emit, (moves - _moves(chain, move)) / n - 1e-4 * move]
        for k, weights in enumerate((emit, move)):
            speed[k] = 0.9 * speed[k] + 0.1 * slope[k]
            spread[k] = 0.99 * spread[k] + 0.01 * slope[k] ** 2
            weights += RATE * (speed[k] / (1 - 0.9**step)) / (np.sqrt(spread[k] / (1 - 0.99**step)) + 1e-8)
    return emit, move


def summary(marginal: np.ndarray) -> np.ndarray:
    """What a document's marginals say: 1, the chance that one of the TOP highest is toxic, the expected toxic words as a log and per hundred."""
    k = min(TOP, len(marginal))
    top = np.partition(marginal, -k)[-k:]
    total = marginal.sum()
    return np.array([1.0, min(1.0, max(0.0, 1 - np.prod(1 - top))), np.log1p(total), min(DENSITY, 100 * total / len(marginal))])


def _document(z: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Weights of `summary` by logistic regression; none but the first is negative, so more toxic words never lower a score."""
    w, scale = np.array([-3.0, 6.0, 0.0, 0.0]), np.r_[1.0, np.maximum(z[:, 1:].std(0), 1e-6)]
    x, w = z / scale, w * scale
    for _ in range(DOCUMENT_STEPS):
        p = 1 / (1 + np.exp(-(x @ w)))
        slope = x.T @ (p - toxic) / len(z) + 1e-3 * np.r_[0.0, w[1:]]
        bend = (x * (p * (1 - p))[:, None]).T @ x / len(z) + 2e-3 * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step / max(1.0, np.abs(step).max())
        w[1:] = np.maximum(w[1:], 0.0)
    return w / scale


def fit(rows: list[tuple[str, int]]) -> Field:
    """`fit_columns` of (text, toxic) rows."""
    return fit_columns(pa.array([t for t, _ in rows], pa.string()), np.array([t for _, t in rows], np.int64))


def fit_columns(texts: pa.Array, toxic: np.ndarray) -> Field:
    """A field from texts and their labels: the words that mark toxic texts, the field's weights, the document's weights.

    The document's weights are fitted on marginals of texts that had no part in the words: each half of
    the groups of near copies is scored with words of the other. Without texts of both kinds nothing is toxic.
    """
    none = Field({}, np.array([-8.0, *[0.0] * (N_FEATURES - 1)]), np.zeros((2, 2)))
    if len(np.unique(toxic)) < 2:
        return none
    s, groups = split_all(texts), _groups(texts)
    words = marking(s, toxic, groups)
    if not words or not (np.diff(s.first) > 0)[toxic == 1].any():
        return none
    out = Field(words, *_weights(s, toxic, words))
    half, z, seen = mixed(groups.astype(np.uint64)) % np.uint64(2), [], []
    for k in (0, 1):
        other = _rows(s, np.flatnonzero(half != k))
        some = Field(marking(other, toxic[half != k], groups[half != k]), out.emit, out.move)
        mine = np.flatnonzero((half == k) & (np.diff(s.first) > 0))
        for r, m in marginals(s, mine, some, Ratios(some.words)):
            z.append(summary(m))
            seen.append(toxic[r])
    out.document = _document(np.array(z), np.array(seen))
    return out


def _rows(s: Split, rows: np.ndarray) -> Split:
    """Some rows of a split."""
    n = np.diff(s.first)[rows]
    at = np.repeat(s.first[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
    none = np.empty(0, np.int64)
    return Split(s.numbers[at], s.words, none, none, np.r_[0, np.cumsum(n)], s.capital[at])


def marginals(s: Split, rows: np.ndarray, field: Field, ratios: Ratios) -> Iterator[tuple[int, np.ndarray]]:
    """(row, marginals of its words) of each of `rows`, at least one word each; rows of like lengths are computed together.

    A text with no marking word has equal potentials throughout; its marginals depend on its length alone.
    """
    of = ratios(s.words)
    marked = np.r_[0, np.cumsum((of.max(1) > 0)[s.numbers], dtype=np.int32)] if len(of) else np.zeros(1, np.int32)
    hard = marked[s.first[rows + 1]] > marked[s.first[rows]]
    length = s.first[rows + 1] - s.first[rows]
    for i in np.flatnonzero(~hard):
        m = _plain(int(min(length[i], SEQUENCE)), field.emit[0], field.move.tobytes())
        if length[i] > SEQUENCE:  # the middle of a longer text repeats
            m = np.insert(m, SEQUENCE // 2, np.full(length[i] - SEQUENCE, m[SEQUENCE // 2]))
        yield rows[i], m
    order = np.flatnonzero(hard)[np.argsort(length[hard], kind="stable")]
    while len(order):
        n = int(np.searchsorted(length[order] * np.arange(1, len(order) + 1), CELLS, side="right"))
        some, order = rows[order[: max(1, n)]], order[max(1, n) :]
        words, size = _padded(s.numbers, s.first, some)
        big, _ = _padded(s.capital, s.first, some)
        inside = np.arange(words.shape[1]) < size[:, None]
        marginal, _ = _chain(_features(of[words] * inside[:, :, None], big, size) @ field.emit, size, field.move)
        for r, m, n in zip(some, marginal, size, strict=True):
            yield r, m[:n]


@lru_cache(maxsize=4096)
def _plain(n: int, bias: float, move: bytes) -> np.ndarray:
    return _chain(np.full((1, n), bias), np.array([n]), np.frombuffer(move).reshape(2, 2))[0][0]


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, toxic, text of at most FIT_TOXIC and FIT_CLEAN labelled documents that are not held out, the least hashes first; whole texts."""
    own = labels.filter("doc_id is not null and toxic in (0, 1)").filter(~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    own = own.withColumn("h", F.xxhash64(F.lit("fit"), F.col("doc_id")))
    part = lambda k, n: own.filter(F.col("toxic") == k).orderBy("h", "doc_id").limit(n)
    some = part(1, FIT_TOXIC).union(part(0, FIT_CLEAN)).select("doc_id", "toxic")  # bounded by the two numbers
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text")).join(F.broadcast(some), "doc_id")
    return rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def held_out(ident):
    """Rows that no fit may see: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.pmod(F.crc32(ident.cast("string")), F.lit(5)) == 0, F.lit(False))


def fit_field(docs: DataFrame, labels: DataFrame) -> Field:
    """The field of a bounded, fixed sample of the labelled rows, fitted on the driver."""
    rows = training_rows(docs, labels).orderBy("doc_id", "toxic").select("text", "toxic").toArrow()  # the two bounds, at most; Arrow's bytes, no strings
    return fit_columns(rows["text"].combine_chunks(), rows["toxic"].to_numpy().astype(np.int64))


def score_block(data: np.ndarray, rows: np.ndarray, field: Field, ratios: Ratios) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """(score of each whole text, its offending spans in code points) of a block of UTF-8 texts; `rows` are their offsets.

    The score is a logistic function of `summary` of the marginals. A span is a word whose marginal is a
    half or more, in a text that scores as much.
    """
    s = split(data, rows)
    score, spans = np.zeros(len(rows) - 1), [[] for _ in range(len(rows) - 1)]
    mine = np.flatnonzero(np.diff(s.first) > 0)
    lead = (data & 0xC0) != 0x80
    for r, m in marginals(s, mine, field, ratios):
        score[r] = 1 / (1 + math.exp(-float(summary(m) @ field.document)))
        if score[r] >= 0.5 and (hit := np.flatnonzero(m >= 0.5)).size:
            points = np.r_[0, np.cumsum(lead[rows[r] : rows[r + 1]])]
            at = s.first[r] + hit
            spans[r] = list(zip(points[s.starts[at] - rows[r]].tolist(), points[s.ends[at] - rows[r]].tolist(), strict=True))
    return score, spans


def score_texts(texts: list[str], field: Field) -> list[tuple[float, list[tuple[int, int]]]]:
    """(score, offending spans) of each whole text."""
    score, spans = score_block(*text_bytes(pa.array(texts, pa.string())), field, Ratios(field.words))
    return list(zip(score.tolist(), spans, strict=True))


def toxicity(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """`docs` with score (0 to 1) and offending (array of start, end in code points) of each whole text.

    Only the text makes the score. Null and empty texts, and texts without letters, score 0. Repeated rows
    score alike; an empty table gives an empty one; columns of `docs` named score or offending are
    replaced. No shuffle; one block of texts at a time.
    """
    ship(docs.sparkSession)
    base = docs.drop("score", "offending")
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False)]), False)
    schema = T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType(), False), T.StructField("offending", span, False)])
    where, arrow = base.columns.index(text_col), pa.list_(pa.struct([pa.field("start", pa.int32(), False), pa.field("end", pa.int32(), False)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = Ratios(field.words)
        for batch in batches:
            data, rows = text_bytes(batch.column(where))
            for a, b in byte_blocks(rows):
                score, spans = score_block(data[rows[a] : rows[b]], rows[a : b + 1] - rows[a], field, ratios)
                listed = pa.array([[{"start": x, "end": y} for x, y in s] for s in spans], arrow)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(score), listed], names=schema.names)

    return base.mapInArrow(run, schema)
