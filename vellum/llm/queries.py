"""Queries opN_<name> over whole tables, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import oracles
from vellum.llm._store import ship
from vellum.llm.bpe import bpe
from vellum.llm.embedding_dedup import embedding_dedup
from vellum.llm.line_dedup import line_dedup
from vellum.llm.mixing import mix
from vellum.llm.ngram_join import ngram_components
from vellum.llm.quality_rules import COUNTS, quality_rules
from vellum.llm.secrets import KINDS, find_secrets
from vellum.llm.sharding import shard_by_bytes
from vellum.llm.token_files import round_trip, token_crc32
from vellum.llm.toxicity import fit_field, held_out, toxicity


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; every operator takes it as a parameter."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("byte_bpe_50k.json"))
    return out.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    return out.select("doc_id", *COUNTS, "base_failed", "kept")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "n_chars", "text", "copy", "n_copies", "shuffle_key")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_crc32(round_trip(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(_table(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(_table(spark, sf_dir, "embeddings"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("byte_bpe_50k.tiktoken")).drop("text")
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("secrets", lambda s: s["kind"] != "random")
    return out.select("doc_id", *map(of, KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    field = fit_field(docs, _table(spark, sf_dir, "labels"))
    out = toxicity(docs, field)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_mixing": op4_mixing,
    "op5_token_files": op5_token_files,
    "op6_sharding": op6_sharding,
    "op7_ngram_join": op7_ngram_join,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_secrets": op9_secrets,
    "op10_toxicity": op10_toxicity,
}
ORACLE = dict(oracles.SQL)
