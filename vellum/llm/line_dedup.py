"""Line dedup: lines that many documents hold stay in one of them only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm._store import let, stored

#: The white space that keys are stripped of, and the letters that they fold.
STRIP = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """Stripped at both ends, A-Z lower-cased; other letters keep their case."""
    t = F.btrim(line, F.lit(STRIP))
    ascii_only = F.octet_length(t) == F.char_length(t)
    return F.when(ascii_only, F.lower(t)).otherwise(F.translate(t, UPPER, UPPER.lower()))


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the text less its repeated lines, and n_lines and n_dropped (long).

    A line whose key has `min_chars` code points or more and is in `min_docs` documents or more
    stays only in the document with the largest id. Keys are compared by 128 bits of hash.

    Null or empty text is one empty line, so it becomes the empty text. A null id takes no part: such rows keep all
    lines and count for no key. Rows that repeat an id are one document for the counts, and each is
    cut by itself. An empty table gives an empty table. Columns of `docs` named n_lines or n_dropped
    are replaced; all others pass through.

    Plan: one shuffle of 32-byte (key, id) rows with a partial aggregation on both sides of it, so a
    line that all documents hold is pre-counted in each task. The common keys are written to the shared
    folder: Spark knows their size, broadcasts them if they are few, and else splits the tasks of a
    line that very many documents hold. One join of the documents with their own list of dropped positions.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    row = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in kept if c != text_col]).alias("row")
    own = docs.select(row, F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    own = own.withColumn("th", F.xxhash64("text"))
    lines = F.split("text", "\n")
    line = (
        own.filter(F.col("id").isNotNull())
        .select("id", "th", F.posexplode(lines).alias("pos", "line"))
        .filter(F.char_length(F.btrim("line", F.lit(STRIP))) >= min_chars)
        .withColumn("key", line_key(F.col("line")))
        .select("id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"))
    )
    common = stored(
        line.groupBy("h1", "h2").agg(F.count_distinct("id").alias("n"), F.max("id").alias("keep")).filter(F.col("n") >= min_docs).drop("n"),
        "common-lines",
    )
    dropped = line.join(common, ["h1", "h2"]).filter(F.col("id") != F.col("keep")).groupBy("id", "th").agg(F.collect_set("pos").alias("drop"))

    def reassembled(own_lines: Column) -> Column:  # array_except hashes: linear in the lines
        keep = F.array_except(F.sequence(F.lit(0), F.size(own_lines) - 1), F.col("drop"))
        return F.array_join(F.transform(keep, lambda p: F.get(own_lines, p)), "\n")

    out = own.join(dropped, ["id", "th"], "left")
    cut = F.when(F.col("drop").isNull(), F.col("text")).otherwise(let(lines, reassembled))
    return out.select(
        *[cut.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in kept],
        F.size(lines).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )
