"""Corpus preparation in stages, each one of the operators of vellum.llm over all rows of the one before."""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm._store import collected, delete, read_paths, stored
from vellum.llm.bpe import bpe
from vellum.llm.line_dedup import line_dedup
from vellum.llm.mixing import mix
from vellum.llm.ngram_join import first_rows, ngram_rows, row_key
from vellum.llm.quality_rules import quality_rules
from vellum.llm.queries import vocabulary


_left = threading.local()


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first deletes what the stages before it, in this thread, left in the shared folder and `docs` does not read."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        needed, old = read_paths(docs), getattr(_left, "paths", [])
        for path in old:
            if path.rsplit("/", 1)[-1] not in needed:
                delete(spark, path)
        with collected() as made:
            out = f(spark, docs, sf_dir)
        _left.paths = made + [p for p in old if p.rsplit("/", 1)[-1] in needed]
        return out

    return run


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep.

    Null and empty texts have no words and go; rows that repeat are judged alike; all columns stay; an empty table gives an empty one.
    """
    return quality_rules(docs).filter("kept").select(*docs.columns)


@_stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less the lines that other documents hold; n_chars follows the text.

    A null text is empty; rows that repeat an id are one document; of other columns only those of documents stay; an empty
    table gives an empty one.
    """
    return line_dedup(docs).selectExpr("doc_id", "text", "lang", "source", "cast(char_length(text) as bigint) as n_chars")


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row; rows without words all stay.

    It is the row of the least id, null ids last; of several texts of that id that of the least hash, and of
    rows that repeat both the least by its columns.
    """
    rows = ngram_rows(docs)
    first = first_rows(rows.filter("root IS NOT NULL"), "root").select("key", "copies")
    bare = rows.filter("root IS NULL").select("key", F.lit(1).cast("bigint").alias("copies")).distinct()
    keep = stored(first.union(bare), "first")
    joined = docs.withColumn("__key", row_key(F.col("doc_id"), F.col("text"))).join(keep.withColumnRenamed("key", "__key"), "__key")
    out = joined.filter("copies = 1").select(*docs.columns)
    if keep.filter("copies > 1").isEmpty():
        return out
    least = joined.filter("copies > 1").groupBy("__key").agg(F.min(F.struct(*docs.columns)).alias("r"))
    return out.union(least.select("r.*"))


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at equal weights: documents repeat or go.

    A null source is a source of its own; null and empty texts count one unit; all columns stay; an empty table gives an empty one.
    """
    return mix(docs).select(*docs.columns)


@_stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and the token ids of each copy, with their number and the hash of what they decode to.

    Null and empty texts have no ids; rows that repeat are encoded one by one; an empty table gives an empty one.
    """
    out = bpe(docs.select("doc_id", "source", "text"), vocabulary("byte_bpe_50k.json"))
    return out.select("doc_id", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mixing", mixing), ("tokens", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
