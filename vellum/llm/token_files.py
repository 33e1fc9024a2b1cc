"""Token files: Parquet lists of token ids in document order, read back by column and by page."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm._store import new_path, partitions, ship
from vellum.llm.pieces import DIGIT, SPACE, Classifier, Known, Table, byte_blocks, join_endings, numbered, run_starts, table, text_bytes

#: Layout of the files: version 2 pages hold integers as deltas; small row groups and pages, each with
#: its place and its least and largest id in the file's page indexes, let a reader take few of them.
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "false",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
}
#: Words whose ids a worker remembers.
REMEMBERED = 500_000
SCHEMA = "part int, doc_id bigint, start_in_part bigint, n_tokens bigint, tokens array<int>"


class Words:
    """Ids of texts by the tokenizers library, word by word, with a bounded memory of words.

    The split into words is done here over bytes, with the library's own classes of code points; the
    library encodes each new word. Rows with an added token's string, or with code points whose
    normalisation depends on their neighbours, go to the library whole.
    """

    def __init__(self, path: str, classes: Table):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        def load() -> Tokenizer:
            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            return t

        self.whole, self.each = load(), load()
        self.each.normalizer = normalizers.Sequence([])
        self.each.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.added = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        suffix = self.whole.model.end_of_word_suffix
        if not suffix:
            raise ValueError(f"{path}: ids of words must show where each ends")
        vocab = self.whole.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith(suffix)]] = True
        self.classify, self.known = Classifier(classes), Known(REMEMBERED)

    def learn(self, words: list[bytes]) -> None:
        """Have the library encode new words, many at a time; the last id of each tells its end."""
        for i in range(0, len(words), 20_000):
            some = words[i : i + 20_000]
            ids = np.array(self.each.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, np.int32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(some):
                raise ValueError("a word without an end")
            self.known.add(some, np.diff(np.r_[0, ends]), ids)

    def slow_rows(self, data: np.ndarray, rows: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Rows that the library must encode whole."""
        at, raw = [other], data.tobytes()
        for text in self.added:
            found = raw.find(text)
            while found >= 0:
                at.append(np.array([found]))
                found = raw.find(text, found + 1)
        return np.unique(np.searchsorted(rows, np.concatenate(at), side="right") - 1)

    def encode(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each row, ids of all rows) of a block of UTF-8 texts; `rows` are their offsets."""
        c = self.classify(data)
        slow = self.slow_rows(data, rows, c.other)
        for r in slow:
            c.kind[rows[r] : rows[r + 1]] = SPACE
        begin = run_starts(c.kind, rows)
        begin |= (c.kind == DIGIT) & c.lead
        join_endings(begin, c, rows)
        keep = c.kind != SPACE
        begin &= keep
        numbers, words = numbered(c.data[keep], np.flatnonzero(begin[keep]))
        self.learn(self.known.missing(words))
        sizes, ids = self.known.ids(words, numbers)
        n_words = np.searchsorted(np.flatnonzero(begin), rows)
        at = np.r_[0, np.cumsum(sizes)][n_words]
        per_row = np.diff(at)
        if len(slow):
            got = [np.array(e.ids, np.int32) for e in self.whole.encode_batch_fast([data[rows[r] : rows[r + 1]].tobytes().decode() for r in slow], add_special_tokens=False)]
            per_row[slow] = [len(x) for x in got]
            ids = np.insert(ids, np.repeat(at[slow], per_row[slow]), np.concatenate(got))
        return per_row, ids


_coders: dict[str, Words] = {}


def coder(path: str, classes: Table) -> Words:
    """The worker's own encoder, which later tasks of the same process go on to use."""
    if path not in _coders:
        _coders[path] = Words(path, classes)
    return _coders[path]


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every text, each with `end_id` after it, to Parquet files under `path` in ascending id order.

    File k holds the k-th range of ids, sorted. Rows that repeat an id stand next to each other, by a
    hash of the text; null ids come first; null and empty texts are the end id alone; an empty table
    writes files without rows. Other columns are not read. The texts move in one range shuffle, before
    they are encoded; each row is encoded once.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).withColumn("h", F.xxhash64("text"))
    ranged = rows.repartitionByRange(partitions(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    classes = table(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, before, part = coder(tokenizer, classes), 0, TaskContext.get().partitionId()
        for batch in batches:
            data, rows = text_bytes(batch.column(1))
            for a, b in byte_blocks(rows):
                n_ids, ids = words.encode(data[rows[a] : rows[b]], rows[a : b + 1] - rows[a])
                ids, sizes = np.insert(ids, np.cumsum(n_ids), end_id), n_ids + 1
                ends = np.cumsum(sizes)
                tokens = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids, pa.int32()))
                cols = [pa.array(np.full(b - a, part, np.int32)), batch.column(0).slice(a, b - a), pa.array(before + ends - sizes), pa.array(sizes), tokens]
                before += int(ends[-1])
                yield pa.RecordBatch.from_arrays(cols, names=names)

    ranged.mapInArrow(run, SCHEMA).write.options(**LAYOUT).parquet(path)


def read_starts(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens; reads no token page."""
    meta = spark.read.schema(SCHEMA).parquet(path).select("part", "doc_id", "start_in_part", "n_tokens")
    return _placed(meta).drop("part", "start_in_part")


def _placed(rows: DataFrame) -> DataFrame:
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # of a row for each file
    spark_rows = rows.select("part", "n_tokens").groupBy("part").agg(F.sum("n_tokens").alias("all"))
    offsets = spark_rows.select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("offset"))
    return rows.join(F.broadcast(offsets), "part").withColumn("start", F.col("start_in_part") + F.col("offset")).drop("offset")


def read_tokens(spark, path: str, ids: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, tokens of all documents or of the listed ones (page indexes skip the others)."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    starts = _placed(rows) if ids is None else _placed(rows.drop("tokens")).filter(F.col("doc_id").isin(ids)).select("part", "doc_id", "start_in_part", "start")
    if ids is None:
        return starts.select("doc_id", "start", "n_tokens", "tokens")
    some = rows.filter(F.col("doc_id").isin(ids))
    return some.join(starts.drop("doc_id"), ["part", "start_in_part"]).select("doc_id", "start", "n_tokens", "tokens")


def token_crc32(tokens: DataFrame) -> DataFrame:
    """`tokens` with ids_crc32 in place of the list: crc32 of the ids as little-endian unsigned 32-bit integers."""
    kept = [c for c in tokens.columns if c != "tokens"]
    fields = [tokens.schema[c] for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(kept))
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            at = lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(crc, pa.int64())], names=[*kept, "ids_crc32"])

    return tokens.select(*kept, "tokens").mapInArrow(run, T.StructType([*fields, T.StructField("ids_crc32", T.LongType())]))


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the token files of `docs` to the shared folder and read all of them."""
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer, path)
    return read_tokens(docs.sparkSession, path)
