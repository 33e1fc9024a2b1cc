"""Documents as typed blocks: split, classify, filter noise, renumber, hash, count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions import text
from vellum.session import table


def blocks(docs: DataFrame) -> DataFrame:
    """One row per line of a document: type by content, reading order, text hash."""
    b = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    t = F.trim(F.col("line"))
    kind = (
        F.when(t == "", "blank")
        .when(F.lower(t).contains("licen"), "license")
        .when(F.length(t) < 40, "short")
        .otherwise("text")
    )
    return b.select("doc_id", "pos", kind.alias("block_type"), t.alias("block_text"), text.text_hash(t).alias("text_hash"))


def keep_content(b: DataFrame) -> DataFrame:
    """Drop noise types; the kept rows get a dense order and remember the old one."""
    kept = b.filter(~F.col("block_type").isin("blank", "license"))
    order = F.row_number().over(W.partitionBy("doc_id").orderBy("pos")) - 1
    return kept.withColumn("new_pos", order)


def block_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = keep_content(blocks(table(spark, sf_dir, "documents")))
    return k.groupBy("doc_id", "block_type").agg(
        F.count("*").alias("n_blocks"),
        F.max("new_pos").cast("bigint").alias("last_pos"),
        F.sum(F.length("block_text")).cast("bigint").alias("n_text"),
        F.min("text_hash").alias("min_hash"),
    )


_BLOCKS_SQL = """
b0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
b AS (SELECT doc_id, pos, trim(line, ' ') AS t,
 CASE WHEN trim(line, ' ') = '' THEN 'blank' WHEN lower(line) LIKE '%licen%' THEN 'license'
      WHEN length(trim(line, ' ')) < 40 THEN 'short' ELSE 'text' END AS block_type FROM b0)
"""

QUERIES = {"block_summary": block_summary}
ORACLE = {
    "block_summary": f"""
WITH {_BLOCKS_SQL},
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS new_pos FROM b WHERE block_type NOT IN ('blank','license'))
SELECT doc_id, block_type, count(*) AS n_blocks, max(new_pos)::BIGINT AS last_pos,
 sum(length(t))::BIGINT AS n_text, min(sha1(lower(t))) AS min_hash
FROM k GROUP BY doc_id, block_type
""",
}
