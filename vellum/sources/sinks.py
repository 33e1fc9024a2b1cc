"""Sinks: deterministic Parquet snapshots with a manifest, CSV by panel, JSON lines, append with a key check."""

from __future__ import annotations

import bisect
import os
from urllib.parse import unquote, urlparse

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Session settings under which a folder of many small files takes few tasks to list and to read.
_SMALL_FILES = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": "64", "spark.sql.sources.ignoreDataLocality": "true", "spark.sql.files.openCostInBytes": "64k"}


def write_snapshot(tables: dict[str, tuple[DataFrame, list[str]]], root: str) -> DataFrame:
    """Each table as zstd Parquet without dictionaries, range-partitioned and sorted by its keys; returns the manifest.

    The manifest has name, rows and an order-free checksum of each table, by name.
    """
    out = None
    for name in sorted(tables):
        df, keys = tables[name]
        path = f"{root}/{name}"
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.options(**{"compression": "zstd", "parquet.enable.dictionary": "false"}).parquet(path)
        again = df.sparkSession.read.schema(df.schema).parquet(path)
        h = F.conv(F.substring(F.md5(F.to_json(F.struct("*"))), 1, 8), 16, 10).cast("bigint")
        one = again.agg(F.lit(name).alias("name"), F.count("*").alias("n_rows"), F.coalesce(F.sum(h), F.lit(0)).alias("checksum"))
        out = one if out is None else out.unionByName(one)
    return out


def write_panel_csv(df: DataFrame, path: str, meta: dict[str, str], panel: str = "panel_id") -> None:
    """One folder of CSV per panel, with constant provenance columns; null panels go to unknown_panel.

    A panel is one file, but that adaptive execution splits what is far larger than its advisory size.
    """
    name = F.coalesce(F.regexp_replace(F.col(panel), r"[^A-Za-z0-9._-]+", "_"), F.lit("unknown_panel"))
    out = df.withColumns({k: F.lit(v) for k, v in meta.items()}).withColumn("panel_file", name).hint("rebalance", "panel_file")
    if path.startswith("file:"):
        _write_folders(out, path)
    else:
        out.write.partitionBy("panel_file").option("header", True).csv(path)


def _write_folders(df: DataFrame, path: str) -> None:
    """The folders of write_panel_csv on a disk that all executors share, without Hadoop's local file system.

    Where its native library is missing, that one starts a chmod process for each folder and file. Lines are Spark's own; a
    file gets its name when it is whole, the same in each attempt of its task, and _SUCCESS comes last.
    """
    root, cols = unquote(urlparse(path).path), [c for c in df.columns if c != "panel_file"]
    os.makedirs(root)  # an error where there is one
    header = df.sparkSession.range(1).select(F.to_csv(F.struct(*[F.lit(c).alias(f"c{i}") for i, c in enumerate(cols)]))).first()[0]
    lines = df.select("panel_file", F.to_csv(F.struct(*cols)).alias("line")).sortWithinPartitions("panel_file")

    def run(batches):
        at, file, name = TaskContext.get(), None, None
        part, hidden = f"part-{at.partitionId():05d}.csv", f".{at.taskAttemptId()}"

        def close():
            file.close()
            os.replace(file.name, os.path.join(os.path.dirname(file.name), part))

        for b in batches:
            names, texts, i = b.column(0).to_pylist(), b.column(1).to_pylist(), 0
            while i < len(names):
                j = bisect.bisect_right(names, names[i], i)
                if names[i] != name:
                    if file:
                        close()
                    name = names[i]
                    folder = os.path.join(root, f"panel_file={name}")
                    os.makedirs(folder, exist_ok=True)
                    file = open(os.path.join(folder, hidden), "w", encoding="utf-8", newline="")
                    file.write(header + "\n")
                file.write("\n".join(texts[i:j]) + "\n")
                i = j
        if file:
            close()
        yield from ()

    lines.mapInArrow(run, "n int").write.format("noop").mode("overwrite").save()
    open(os.path.join(root, "_SUCCESS"), "w").close()


def read_panel_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """What write_panel_csv wrote, as strings, with panel_file; a header of other columns is an error.

    It is a folder of very many small files: they are listed once, as no schema is inferred, and read many to a task. A file
    is read as one stream, so a value may hold line ends, and without buffers for a wide table.
    """
    s = spark.newSession()
    for k, v in (spark.conf.getAll | _SMALL_FILES).items():
        if s.conf.isModifiable(k):
            s.conf.set(k, v)
    schema = ", ".join(f"`{c}` string" for c in [*columns, "panel_file"])
    small = {"multiLine": True, "maxColumns": max(64, 2 * len(columns)), "inputBufferSize": 8192}
    return s.read.schema(schema).options(header=True, enforceSchema=False, **small).csv(path)


def write_json_lines(df: DataFrame, path: str, order: list[str]) -> None:
    """Byte-deterministic JSON lines: rows in order, keys sorted."""
    cols = sorted(df.columns)
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def new_rows(existing: DataFrame, rows: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """Rows whose key is not there yet; the same key with another digest is an error."""
    have = existing.select(*keys, F.col(digest).alias("__have"))
    j = rows.join(have, keys, "left")
    bad = F.col("__have").isNotNull() & (F.col("__have") != F.col(digest))
    j = j.withColumn("__have", F.when(bad, F.raise_error(F.concat_ws(":", F.lit("key exists with another digest"), *keys)).cast("string")).otherwise(F.col("__have")))
    return j.filter("__have is null").drop("__have")
