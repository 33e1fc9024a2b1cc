"""N-gram Jaccard join: documents whose word 5-shingles overlap enough, by T-occurrence search."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm._store import partitions, ship, stored
from vellum.llm.bpe import blocks
from vellum.llm.components import components

WORDS = 5
#: Ranges of tokens that are counted apart, at least; with more shuffle partitions, as many as those; and one for
#: so many bytes of text, so that a range of any table fits a task.
BUCKETS, BUCKET_BYTES = 64, 8 << 20
#: Documents and shingles of one cell of the search; a larger cluster is searched in pairs of such blocks.
CELL, CELL_SHINGLES = 1500, 2_000_000
#: Members of a component that a set is compared with before it searches.
LEADERS = 16
#: Documents of clusters up to this number (of 40 bytes) are broadcast to the texts; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Weight of a probe against a step of the merge, for the number of lists that are probed and not merged.
PROBE = 0.0085
_U = np.uint64
_P, _INVERSE = _U(0x9E3779B97F4A7C15), _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_PLACE = [_U(pow(0xD6E8FEB86659FD93, k + 1, 2**64)) for k in range(WORDS)]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x + _U(salt)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(document's place, shingle) of all distinct shingles, sorted; shingles are 64-bit hashes.

    Words are runs without ASCII white space, A-Z lower-cased; a text of fewer than five words is one
    shingle, a text without words none.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    begins = np.cumsum([0, *(len(x) + 1 for x in raw)])
    space = _SPACE[data]
    start = np.flatnonzero(~space & np.r_[True, space[:-1]])
    end = np.flatnonzero(space & np.r_[False, ~space[:-1]])
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    power = np.cumprod(np.full(len(data), _P, np.uint64))
    sums = np.r_[_U(0), np.cumsum((data.astype(np.uint64) + _U(1)) * power)]
    back = np.cumprod(np.full(len(data), _INVERSE, np.uint64))
    word = mixed((sums[end] - sums[start]) * back[start])
    doc = np.searchsorted(begins, start, side="right") - 1
    n = np.bincount(doc, minlength=len(raw))
    first = np.r_[0, np.cumsum(n)]
    if len(word) >= WORDS:
        whole = np.zeros(len(word) - WORDS + 1, np.uint64)
        for k in range(WORDS):
            whole += word[k : k + len(whole)] * _PLACE[k]
        inside = doc[: len(whole)] == doc[WORDS - 1 :]
        owner, got = doc[: len(whole)][inside], mixed(whole[inside])
    else:
        owner, got = np.empty(0, np.int64), np.empty(0, np.uint64)
    short = np.flatnonzero((n > 0) & (n < WORDS))
    if len(short):
        one = [sum(int(word[first[d] + k]) * int(_PLACE[k]) for k in range(n[d])) + int(n[d]) for d in short]
        owner, got = np.r_[owner, short], np.r_[got, mixed(np.array([x % 2**64 for x in one], np.uint64), 1)]
    order = np.lexsort((got, owner))
    owner, got = owner[order], got[order]
    new = np.r_[True, (owner[1:] != owner[:-1]) | (got[1:] != got[:-1])]
    return owner[new], got[new]


def _digests(owner: np.ndarray, got: np.ndarray, n_docs: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document: shingles and 128 bits that tell its set; of the first half only `bits` (fewer in tests)."""
    n = np.bincount(owner, minlength=n_docs)
    at = np.r_[0, np.cumsum(n)][:-1]
    out = []
    for salt in (2, 3):
        total = np.zeros(n_docs, np.uint64)
        if len(got):
            total[n > 0] = np.add.reduceat(mixed(got, salt), at[n > 0])
        out.append(mixed(total, salt))
    return n, (out[0] & _U(2**bits - 1)).view(np.int64), out[1].view(np.int64)


def _names(h1: np.ndarray, h2: np.ndarray, shared: frozenset[int]) -> np.ndarray:
    """A set's name: its first half, but both halves in one where different sets share the first."""
    return np.where(np.isin(h1, np.fromiter(shared, np.int64, len(shared))), h1 ^ h2, h1) if shared else h1


def overlap_needed(n: int) -> int:
    """Least overlap of a set of n with any set that it links with (similarity 0.8)."""
    return -(-4 * n // 5)


def linked(overlap: int, n: int, m: int) -> bool:
    """100 * overlap >= 80 * (n + m - overlap)"""
    return 9 * overlap >= 4 * (n + m)


class Index:
    """Inverted lists of sets that came in the order of their sizes, searched with DivideSkip."""

    def __init__(self):
        self.lists: dict[int, list[int]] = defaultdict(list)
        self.sizes: dict[int, int] = {}

    def add(self, rank: int, tokens: list[int]) -> None:
        self.sizes[rank] = len(tokens)
        for t in tokens:
            self.lists[t].append(rank)

    def search(self, tokens: list[int], skip: Callable[[int], bool]) -> Iterator[int]:
        """Ranks of the sets that link with one that is as large or larger; those that `skip` holds for are not probed.

        The lists are divided: the longest ones, fewer than the overlap T that the query needs, are set
        aside; the short ones are merged by a heap. A set in at least T - L short lists is looked up in
        the L long ones by binary search, until it has the overlap or can't reach it.
        """
        n, need, lists = len(tokens), overlap_needed(len(tokens)), self.lists
        own = sorted((lists[t] for t in tokens if t in lists), key=len)
        if not 0 < need <= len(own):
            return
        aside = min(need - 1, int(need / (PROBE * math.log2(len(own[-1]) + 1) + 1)))
        short, long = own[: len(own) - aside], own[len(own) - aside :]
        last, count = -1, 0
        for rank in heapq.merge(*short, [1 << 62]):
            if rank == last:
                count += 1
                continue
            if count >= need - aside and count and not skip(last):
                m = self.sizes[last]
                wanted = -(-4 * (n + m) // 9)
                for left, values in enumerate(long):
                    if count >= wanted or count + aside - left < wanted:
                        break
                    at = bisect_left(values, last)
                    count += at < len(values) and values[at] == last
                if count >= wanted:
                    yield last
            last, count = rank, 1


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common values of two sorted sets."""
    if not len(a) or not len(b):
        return 0
    return int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())


def links(sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Links that join components, enough to tell the components of all links among `sets`.

    Sets come by size and search among those before them. Members of the first component that arises
    are indexed apart: a set that links with one of its LEADERS first members is in it already and
    searches only the others, so a large group of near copies takes a few comparisons for each.
    """
    up = list(range(len(sets)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(i: int, j: int) -> bool:
        a, b = root(i), root(j)
        up[max(a, b)] = min(a, b)
        return a != b

    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    group, rest, leaders = Index(), Index(), []
    for rank, i in enumerate(order):
        tokens, n, found = sets[i].tolist(), len(sets[i]), None
        for j in leaders:
            if linked(overlap(sets[j], sets[i]), n, len(sets[j])):
                found = j
                break
        if found is not None:
            join(i, found)
            yield i, found
        for index in (rest,) if found is not None else (group, rest):
            for r in index.search(tokens, lambda r: root(order[r]) == root(i)):
                if join(i, order[r]):
                    yield i, order[r]
                    if not leaders:
                        leaders.append(order[r])
        mine = bool(leaders) and root(i) == root(leaders[0])
        if mine and len(leaders) < LEADERS:
            leaders.append(i)
        (group if mine else rest).add(rank, tokens)


def row_key(id_: Column, text: Column) -> Column:
    """64 bits of hash of a row's id (null is an id of its own) and text."""
    return F.xxhash64(id_.isNull(), id_, F.coalesce(text, F.lit("")))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Blocks of (id, key, text) rows with their shingles."""
    for batch in batches:
        texts = batch.column(2).to_pylist()
        for a, b in blocks(texts):
            yield batch.slice(a, b - a), *shingles(texts[a:b])


def _tokens(owner: np.ndarray, got: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document's place, bucket, token) of all distinct tokens, sorted.

    A bucket is a range of shingles, a token 32 other bits of one: it may stand for several, which only
    adds candidates.
    """
    bucket = ((got >> _U(32)) * _U(n_buckets)) >> _U(32)
    token = got & _U(0xFFFFFFFF)
    order = np.lexsort((token, bucket, owner))
    owner, bucket, token = owner[order], bucket[order], token[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (bucket[1:] != bucket[:-1]) | (token[1:] != token[:-1])
    return owner[new], bucket[new], token[new]


def shingle_sets(docs: DataFrame, n_buckets: int, bits: int = 64) -> DataFrame:
    """(id, key, text) -> id, key, n_shingles, n_tokens, h1, h2: the size of each document's set and 128 bits of hash of it."""

    def run(batches):
        for block, owner, got in _batches(batches):
            n, h1, h2 = _digests(owner, got, block.num_rows, bits)
            size = np.bincount(_tokens(owner, got, n_buckets)[0], minlength=block.num_rows)
            cols = [block.column(0), block.column(1), pa.array(n, pa.int64()), pa.array(size, pa.int64()), pa.array(h1), pa.array(h2)]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "key", "n_shingles", "n_tokens", "h1", "h2"])

    return docs.mapInArrow(run, "id bigint, key bigint, n_shingles bigint, n_tokens bigint, h1 bigint, h2 bigint")


def _postings(docs: DataFrame, n_buckets: int, shared: frozenset[int], bits: int) -> DataFrame:
    """bucket, sets, counts, tokens: a row for each block of texts and bucket, with each set's tokens (4 bytes) there.

    A task sends a set that it has sent before no second time.
    """

    def run(batches):
        seen: set[int] = set()
        for block, owner, got in _batches(batches):
            n, h1, h2 = _digests(owner, got, block.num_rows, bits)
            h1 = _names(h1, h2, shared)
            fresh = np.zeros(block.num_rows, bool)
            for d, h in enumerate(h1.tolist()):
                if n[d] and h not in seen:
                    seen.add(h)
                    fresh[d] = True
            use = fresh[owner]
            owner, bucket, token = _tokens(owner[use], got[use], n_buckets)
            if not len(owner):
                continue
            order = np.argsort(bucket, kind="stable")
            owner, bucket, token = owner[order], bucket[order], token[order]
            run_at = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (bucket[1:] != bucket[:-1])])
            of = bucket[run_at]
            row = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            run_ends, token_ends = np.r_[row, len(run_at)], np.r_[run_at[row], len(token)]
            cells = lambda ends, x: pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])
            counts = np.diff(np.r_[run_at, len(token)]).astype("<u4")
            cols = [pa.array(of[row].astype(np.int32)), cells(run_ends, h1[owner[run_at]].astype("<i8")), cells(run_ends, counts), cells(token_ends, token.astype("<u4"))]
            yield pa.RecordBatch.from_arrays(cols, names=["bucket", "sets", "counts", "tokens"])

    return docs.mapInArrow(run, "bucket int, sets binary, counts binary, tokens binary")


def _shared(table: pa.Table) -> pa.Table:
    """One bucket's inverted lists: per set, the tokens that other sets have too, with the number of sets."""
    flat = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind)
    token, owner = flat("tokens", "<u4"), np.repeat(flat("sets", "<i8"), flat("counts", "<u4"))
    order = np.lexsort((owner, token))
    token, owner = token[order], owner[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    token, owner = token[new], owner[new]
    first = np.ones(len(token), bool)
    first[1:] = token[1:] != token[:-1]
    count = np.diff(np.r_[np.flatnonzero(first), len(token)])
    df = np.repeat(count, count)
    token, owner, df = (x[df >= 2] for x in (token, owner, df))
    order = np.argsort(owner, kind="stable")
    token, owner, df = token[order], owner[order], df[order]
    first = np.ones(len(owner), bool)
    first[1:] = owner[1:] != owner[:-1]
    at = np.flatnonzero(first)
    ends = np.r_[at, len(owner)].astype(np.int32)
    cell = lambda x: pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends * 4), pa.py_buffer(np.ascontiguousarray(x.astype("<u4")))])
    bucket = np.full(len(at), table["bucket"][0].as_py(), np.int32)
    cols = [pa.array(bucket), pa.array(owner[at], pa.int64()), pa.array(np.diff(ends), pa.int32()), cell(token), cell(df)]
    return pa.table(cols, names=["bucket", "set", "n", "tokens", "counts"])


def _rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per set, the tokens of its prefix that other sets have: all tokens ordered by their number of sets, then by value."""
    for batch in batches:
        tokens, sets = [], []
        for s, take, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            token = np.concatenate([np.frombuffer(c["tokens"], "<u4").astype(np.int64) | (c["bucket"] << 32) for c in cells])
            count = np.concatenate([np.frombuffer(c["counts"], "<u4") for c in cells])
            got = token[np.lexsort((token, count))[:take]]
            tokens.append(got)
            sets.append(np.full(len(got), s, np.int64))
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(sets))], names=["token", "set"])


def _candidates(docs: DataFrame, sets: DataFrame, n_buckets: int, clash: frozenset[int], bits: int) -> DataFrame:
    """(set, other): every two sets that can link are connected by such pairs.

    Two sets with similarity 0.8 share a token of their prefixes: the n - ceil(0.8 n) + 1 rarest of n.
    A set with that many tokens of its own has no candidate, and its tokens go no further.
    """
    # a partition is a bucket, so that a task's share does not grow with the table
    shared = _postings(docs, n_buckets, clash, bits).repartitionById(n_buckets, "bucket").groupBy("bucket").applyInArrow(_shared, "bucket int, set bigint, n int, tokens binary, counts binary")
    cells = shared.groupBy("set").agg(F.sum("n").alias("n"), F.collect_list(F.struct("bucket", "tokens", "counts")).alias("cells"))
    sizes = sets.groupBy(F.col("h1").alias("set")).agg(F.max("n_shingles").alias("n_shingles"), F.min("n_tokens").alias("n_tokens"))
    prefix = F.col("n_shingles") - F.expr("(4 * n_shingles + 4) div 5") + 1
    cells = cells.join(sizes, "set").withColumn("take", (prefix - (F.col("n_tokens") - F.col("n"))).cast("int"))
    lists = stored(cells.filter("take > 0").select("set", "take", "cells").mapInArrow(_rarest, "token bigint, set bigint"), "prefixes")
    first = lists.groupBy("token").agg(F.min("set").alias("other"), F.max("set").alias("last")).filter("other <> last").select("token", "other")
    return lists.join(first, "token").filter("set <> other").select("set", "other").distinct()


def _searched(table: pa.Table, shared: frozenset[int], bits: int) -> pa.Table:
    """One cell: (set, other) for links that tell the cell's components."""
    by_set: dict[int, np.ndarray] = {}
    texts, wanted = table["text"].to_pylist(), table["set"].to_pylist()
    for a, b in blocks(texts):
        owner, got = shingles(texts[a:b])
        n, h1, h2 = _digests(owner, got, b - a, bits)
        h1 = _names(h1, h2, shared)
        ends = np.cumsum(n)
        for d in range(b - a):
            if int(h1[d]) == wanted[a + d]:
                by_set[wanted[a + d]] = got[ends[d] - n[d] : ends[d]]
    ids = sorted(by_set)
    out = [(ids[i], ids[j]) for i, j in links([by_set[x] for x in ids])]
    return pa.table({"set": [x for x, _ in out], "other": [y for _, y in out]}, schema=pa.schema([("set", pa.int64()), ("other", pa.int64())]))


def _cells(docs: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, i, j, set, text): one row of each set in every pair of blocks that its block is in."""
    full = F.greatest(F.count(F.lit(1)) / CELL, F.sum("n_shingles") / CELL_SHINGLES)
    members = clusters.groupBy("cluster").agg(F.ceil(full).cast("int").alias("blocks"))
    clusters = clusters.drop("n_shingles")
    placed = clusters.join(members, "cluster").withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    placed = stored(placed, "placed")
    placed = F.broadcast(placed) if placed.count() <= BROADCAST_ROWS else placed
    joined = docs.select("key", "text").join(placed, "key")
    rows = joined.filter("copies = 1").select("cluster", "set", "text", "block", "blocks")
    if not placed.filter("copies > 1").isEmpty():  # rows that repeat an id and text: one of them
        rows = rows.union(joined.filter("copies > 1").groupBy("cluster", "set", "block", "blocks").agg(F.min("text").alias("text")).select(rows.columns))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")
    return rows.select("cluster", "set", "text", "block", other).select("cluster", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "set", "text")


def first_rows(rows: DataFrame, by: str) -> DataFrame:
    """by, id, key, copies: of each `by` the row of the least id (null is the last), then key; how many rows are like it."""
    alike = rows.groupBy(by, "id", "key").agg(F.count(F.lit(1)).alias("copies"))
    least = alike.groupBy(by).agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "key", "copies")).alias("r"))
    return least.select(by, "r.id", "r.key", "r.copies")


def ngram_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """Per row: id, key (`row_key`), n_shingles and root, equal for rows that links connect; null without shingles.

    `bits` of a set's hash name it; sets that share them are named by 64 bits of both halves instead.
    """
    spark = docs.sparkSession
    ship(spark)
    id_, text = F.col(f"`{id_col}`").cast("bigint"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(id_.alias("id"), row_key(id_, text).alias("key"), text.alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(BUCKETS, partitions(spark), math.ceil(size / BUCKET_BYTES))
    found = stored(shingle_sets(rows, n_buckets, bits), "sets")
    halves = found.groupBy("h1").agg(F.min("h2").alias("lo"), F.max("h2").alias("hi")).filter("lo <> hi")
    clash = frozenset(r["h1"] for r in halves.collect())  # 64 bits: a few in 10**10 sets
    name = F.when(F.col("h1").isin(*clash), F.col("h1").bitwiseXOR(F.col("h2"))).otherwise(F.col("h1")) if clash else F.col("h1")
    sets = found.select("id", "key", "n_shingles", "n_tokens", name.alias("h1"))
    pairs = _candidates(rows, sets, n_buckets, clash, bits)
    clusters = components(pairs)
    clusters = clusters.select(F.col("node").alias("set"), F.col("root").alias("cluster")).union(clusters.select("root", "root").distinct())
    kept = first_rows(sets.filter("n_shingles > 0"), "h1")
    sizes = sets.groupBy("h1").agg(F.max("n_shingles").alias("n_shingles"))
    placed = clusters.join(kept, clusters["set"] == kept["h1"]).join(sizes, "h1").select("cluster", "set", "key", "copies", "n_shingles")
    cells = _cells(rows, placed)
    links_of = lambda table: _searched(table, clash, bits)
    roots = components(stored(cells.groupBy("cluster", "i", "j").applyInArrow(links_of, "set bigint, other bigint"), "links"))
    named = sets.filter("n_shingles > 0").join(roots.withColumnRenamed("node", "h1"), "h1", "left").select("id", "key", "n_shingles", F.coalesce("root", "h1").alias("root"))
    return named.union(sets.filter("n_shingles = 0").select("id", "key", "n_shingles", F.lit(None).cast("bigint")))


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles and component_id, the least id that links lead to, itself included.

    Two documents link when the Jaccard similarity of their sets of word 5-shingles is 0.8 or more.
    All links count: the search is exact, up to collisions of 64-bit hashes of shingles and of 128-bit hashes of sets.

    Null or empty texts have no shingles and link with nothing. Rows with equal sets are one node of
    the search, however many they are; rows that repeat an id are documents with that id. A null id is
    no component_id unless no other id is in its component. An empty table gives an empty table. Other columns are not read.

    Plan: one pass tells each document's set (48 bytes). A second one sends every different set's tokens
    to the bucket of their hash range, 4 bytes each and 12 for a set, where tokens of one set only are dropped; the
    tokens left order each set's prefix by rareness, and sets that share a token of their prefixes make
    clusters. Only texts of clusters move: a cell (a cluster, or two blocks of a large one) is searched
    with DivideSkip, and pairs that are already connected are not probed.
    """
    rows = ngram_rows(docs, id_col, text_col)
    named = rows.filter("root IS NOT NULL")
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    out = named.join(least, "root").select("id", "n_shingles", "component_id")
    return out.union(rows.filter("root IS NULL").select("id", "n_shingles", "id")).withColumnRenamed("id", id_col)
