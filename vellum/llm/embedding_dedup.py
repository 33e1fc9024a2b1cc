"""Embedding near-dedup: ITQ codes, multi-index Hamming tables, reranking with the original vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm._store import let, ship, stored
from vellum.llm.components import components

#: Rotations are fitted on at most so many vectors, and numbers in them, of each of at most so many
#: dimensions (the commonest); those of the least hashes.
FIT_ROWS, FIT_VALUES, FIT_DIMS = 20_000, 2_000_000, 8
FIT_STEPS, SEED, MAX_BITS = 30, 7, 64
#: The search has as many tables as find this share of planted pairs at the threshold, of PLANTED pairs of each kind.
RECALL, PLANTED = 0.99, 2_000
#: Beyond so many tables the chunks get shorter; at no bits at all every two vectors meet.
MAX_TABLES = 64
#: A vector asks for its own chunk and for those with some of this many bits turned, the nearest to turning.
WEAK = 3


class Rotations:
    """Bits of unit vectors: signs of (vector - mean) @ matrix, one matrix after the other without end.

    Iterative quantisation: principal directions, turned so that signs lose least, from a new start for
    each matrix. Without vectors to fit on, turned at random. At most 64 bits a matrix.
    """

    def __init__(self, dims: int, x: np.ndarray | None = None):
        self.bits = min(MAX_BITS, dims)
        self.mean, self.axes, self.p, self.matrices = np.zeros(dims), None, None, []
        if x is not None:
            self.mean = x.mean(0)
            _, _, v = np.linalg.svd((x - self.mean).T @ (x - self.mean))  # of the dimensions, not of the rows
            self.axes = v[: self.bits].T
            self.p = (x - self.mean) @ self.axes
        self.dims = dims

    def _more(self) -> None:
        rng = np.random.default_rng([SEED, self.dims, len(self.matrices)])
        if self.p is None:
            self.matrices.append(np.linalg.qr(rng.normal(size=(self.dims, self.bits)))[0])
            return
        r = np.linalg.qr(rng.normal(size=(self.bits, self.bits)))[0]
        for _ in range(FIT_STEPS):
            u, _, vt = np.linalg.svd(np.sign(self.p @ r).T @ self.p)
            r = (u @ vt).T
        self.matrices.append(self.axes @ r)

    def columns(self, start: int, end: int) -> np.ndarray:
        """The matrix of bits start to end."""
        while len(self.matrices) * self.bits < end:
            self._more()
        first = start // self.bits
        some = np.concatenate(self.matrices[first : -(-end // self.bits)] or [np.zeros((self.dims, 0))], axis=1)
        return some[:, start - first * self.bits : end - first * self.bits]


def packed(signs: np.ndarray) -> np.ndarray:
    code = np.zeros(len(signs), np.uint64)
    for k in range(signs.shape[1]):
        code |= signs[:, k].astype(np.uint64) << np.uint64(k)
    return code


def weak(values: np.ndarray) -> np.ndarray:
    """Places of the bits that are the nearest to turning, for each row of projected values."""
    return np.argsort(np.abs(values), axis=1, kind="stable")[:, :WEAK].astype(np.uint64)


def meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether chunks of projected values differ in weak bits of one side alone, row by row."""
    differ = packed(a > 0) ^ packed(b > 0)
    masks = [np.bitwise_or.reduce(np.uint64(1) << weak(v), axis=1, initial=np.uint64(0)) for v in (a, b)]
    return (differ & ~masks[0] == 0) | (differ & ~masks[1] == 0)


def planted(x: np.ndarray, threshold: float, spread: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unit vectors at the threshold: rows of `x`, moved in any direction or (`spread`) as two rows differ."""
    rng = np.random.default_rng(SEED)
    at, i, j = rng.integers(0, len(x), (3, PLANTED))
    a, any_way = x[at], rng.normal(size=(PLANTED, x.shape[1]))
    u = x[i] - x[j] if spread else any_way
    u = u - (u * a).sum(1, keepdims=True) * a
    flat = np.linalg.norm(u, axis=1) < 1e-9
    u[flat] = (any_way - (any_way * a).sum(1, keepdims=True) * a)[flat]
    u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-12)
    t = min(1.0, max(-1.0, threshold))
    b = t * a + math.sqrt(1 - t * t) * u
    return a, b / np.linalg.norm(b, axis=1, keepdims=True)


class Plan(NamedTuple):
    """Chunks of `width` bits cut one after the other from the bits of `matrix`, a table for each."""

    mean: np.ndarray
    matrix: np.ndarray
    width: int
    tables: int
    radius: int
    found: float

    def keys(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code, a key for each table) of unit vectors; a key is the chunk and, from bit 32, a byte for each weak bit's place."""
        values = (x - self.mean) @ self.matrix
        keys = np.zeros((len(x), self.tables), np.uint64)
        for k in range(self.tables):
            some = values[:, k * self.width : (k + 1) * self.width]
            keys[:, k] = packed(some > 0)
            places = weak(some)
            for i in range(WEAK):  # no chunk has a bit 63
                place = places[:, i] if i < places.shape[1] else np.uint64(63)
                keys[:, k] |= place << np.uint64(32 + 8 * i)
        return packed(values[:, :MAX_BITS] > 0).view(np.int64), keys.view(np.int64)


def plan(rotations: Rotations, x: np.ndarray, n: int, threshold: float) -> Plan:
    """The search among n nodes that finds RECALL of planted pairs at the threshold, made from unit vectors `x`.

    Chunks have about log2(n) bits, so that the candidates of a vector stay few; fewer if that takes
    more than MAX_TABLES tables. The radius is the most bits in which codes of planted pairs differ.
    """
    pairs = [[v - rotations.mean for v in planted(x, threshold, spread)] for spread in (False, True)]
    first = rotations.columns(0, MAX_BITS)
    radius = max(int(np.bitwise_count(packed(a @ first > 0) ^ packed(b @ first > 0)).max()) for a, b in pairs)
    width = max(8, min(22, math.ceil(math.log2(max(n, 2)))))
    while True:
        met = [np.zeros(PLANTED, bool) for _ in pairs]
        for k in range(MAX_TABLES):
            m = rotations.columns(k * width, (k + 1) * width)
            for found, (a, b) in zip(met, pairs, strict=True):
                found |= meet(a @ m, b @ m)
            least = min(f.mean() for f in met)
            if least >= RECALL:
                return Plan(rotations.mean, rotations.columns(0, max(MAX_BITS, (k + 1) * width)), width, k + 1, radius, float(least))
        width -= 1


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vector: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    good = F.forall(vector, lambda x: F.coalesce(finite(x), F.lit(False)))
    return F.coalesce(good & F.exists(vector, lambda x: x != 0), F.lit(False))


def scaled(vector: Column) -> Column:
    """A vector times a power of two, which is exact, so that no square of it overflows or vanishes."""
    most = F.array_max(F.transform(vector, lambda x: F.abs(x)))
    by = F.pow(F.lit(2.0), -F.greatest(F.lit(-1000.0), F.floor(F.log2(most))))
    return let(by, lambda m: F.transform(vector, lambda x: x * m))


def cosine(a: Column, b: Column) -> Column:
    """In double precision, of `scaled` vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def fitted_plan(vectors: np.ndarray, n: int, threshold: float) -> Plan:
    x = unit(vectors)
    return plan(Rotations(x.shape[1], x), x, n, threshold)


@lru_cache(64)
def unfitted_plan(dims: int, n: int, threshold: float) -> Plan:
    """Without vectors to fit on: a random rotation turns a bit of a pair at the threshold equally often, wherever it lies."""
    x = np.random.default_rng(SEED).normal(size=(PLANTED, dims))
    return plan(Rotations(dims), unit(x), n, threshold)


def _codes(nodes: DataFrame, models: dict[int, Plan], n_other: int, threshold: float) -> DataFrame:
    """node, label, dims, radius, code (signs packed into 64 bits) and a key for each table.

    `n_other` nodes have dimensions without a fitted plan.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
            at = lists.offsets.to_numpy()
            for dims in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dims)
                model = models.get(dims) or unfitted_plan(dims, n_other, threshold)
                code, keys = model.keys(unit(flat[at[rows][:, None] + np.arange(dims)]))
                some, same = pa.array(rows), lambda v: pa.array(np.full(len(rows), v, np.int32))  # noqa: B023
                lists_of = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * model.tables), pa.array(keys.ravel()))
                cols = [batch.column(0).take(some), batch.column(1).take(some), same(dims), same(model.radius), pa.array(code), lists_of]
                yield pa.RecordBatch.from_arrays(cols, names=["node", "label", "dims", "radius", "code", "keys"])

    return nodes.select("node", "label", "vector").mapInArrow(run, "node bigint, label int, dims int, radius int, code bigint, keys array<bigint>")


def embedding_links(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, DataFrame]:
    """(nodes, links): nodes are different (label, vector) pairs with their members; links are (a, b, cosine), a < b.

    The bits of the codes are cut into chunks, a table for each. Two nodes meet if they agree in a chunk
    but for weak bits of one of them; their codes are compared, then the vectors' cosine. `plan` chooses
    the tables on planted pairs, so recall does not depend on the number of rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), F.col(f"`{label_col}`").cast("int").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    good = rows.filter(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable(F.col("vector")))
    nodes = stored(good.groupBy("label", "vector").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("members")), "nodes")
    dims = nodes.groupBy(F.size("vector").alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dims").limit(FIT_DIMS).collect()
    models = {}
    for d in dims:
        some = nodes.filter(F.size("vector") == d["dims"]).orderBy(F.xxhash64("node")).limit(min(FIT_ROWS, max(1, FIT_VALUES // d["dims"]))).select("vector").collect()
        models[d["dims"]] = fitted_plan(np.array([r[0] for r in some]), d["n"], threshold)
    n_other = nodes.count() - sum(d["n"] for d in dims)
    codes = stored(_codes(nodes, models, n_other, threshold), "codes")
    table = codes.select("label", "dims", "radius", "node", "code", F.posexplode("keys").alias("k", "key"))
    chunk = F.col("key").bitwiseAND(F.lit((1 << 32) - 1))
    asked = [chunk]
    for i in range(WEAK):
        place = F.shiftrightunsigned("key", 32 + 8 * i).bitwiseAND(F.lit(255)).cast("int")
        turned = F.call_function("shiftleft", F.lit(1).cast("bigint"), place)
        asked += [x.bitwiseXOR(turned) for x in asked]
    asking = table.select("label", "dims", "k", F.explode(F.array(*asked)).alias("chunk"), F.col("node").alias("x"), F.col("code").alias("code_x"), "radius")
    asked_for = table.select("label", "dims", "k", chunk.alias("chunk"), F.col("node").alias("y"), F.col("code").alias("code_y"))
    met = asking.join(asked_for, ["label", "dims", "k", "chunk"]).filter(
        (F.col("x") != F.col("y")) & (F.bit_count(F.col("code_x").bitwiseXOR(F.col("code_y"))) <= F.col("radius"))
    ).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    pairs = met.select("a", "b").distinct()
    v = nodes.select("node", scaled(F.col("vector")).alias("vector"))
    ranked = pairs.join(v.withColumnsRenamed({"node": "a", "vector": "va"}), "a").join(v.withColumnsRenamed({"node": "b", "vector": "vb"}), "b")
    links = ranked.select("a", "b", cosine(F.col("va"), F.col("vb")).alias("cosine")).filter(F.col("cosine") >= threshold)
    return nodes, stored(links, "links")


def embedding_dedup(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per row: id, n_links (other vectors linked directly), component_id (least id reachable), kept (it is its own).

    Vectors link when their labels are equal and their cosine is `threshold` or more. No link below it
    is made; a link can be missed: the search finds RECALL of pairs planted at the threshold (see `plan`).

    Null labels, and vectors that are null, empty, zero or hold null or non-finite components, link with
    nothing. Vectors of any lengths are searched, those beyond the FIT_DIMS commonest with random rotations.
    Equal vectors of a label are one node of the search, however many they are; they link with
    each other. Rows that repeat an id are vectors of their own with that id. A null id links with
    nothing. An empty table gives an empty one. Other columns are not read.
    """
    nodes, links = embedding_links(vectors, threshold, id_col, vector_col, label_col)
    size = nodes.select("node", "members")
    both = links.select("a", "b").union(links.select("b", "a"))
    other = both.join(size.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("members").alias("others"))
    roots = components(links.select("a", "b"))
    # rows find their node by 128 bits of hash of label and vector: no vector moves, and Spark splits the tasks of a node with very many rows
    name = [F.xxhash64(F.lit(k), F.col("label"), F.col("vector")).alias(f"h{k}") for k in (1, 2)]
    known = nodes.select("node", "members", *name).join(other, "node", "left").join(roots, "node", "left").select(
        "h1", "h2", (F.col("members") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("root", "node").alias("root")
    )
    rows = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    fits = F.col("label").isNotNull() & F.col("id").isNotNull() & usable(F.col("vector"))
    linked = rows.filter(fits).select("id", *name).join(stored(known, "known"), ["h1", "h2"]).select("id", F.col("n").alias("n_links"), F.col("root").alias("component_id"))
    alone = rows.filter(~fits).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.union(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))
    return out.withColumnRenamed("id", id_col)
