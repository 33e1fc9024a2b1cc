"""Intermediate tables in the folder that all executors share, and small helpers."""

from __future__ import annotations

import atexit
import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_written: list[tuple[SparkSession, str]] = []
_own = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of this machine only where it is unset (local tests)."""
    got = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.vellum.sharedDir", None)
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors share")
        got = "file://" + tempfile.mkdtemp(prefix="vellum-shared-")
        spark.conf.set("spark.vellum.sharedDir", got)
    return got.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder on whatever file system it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone by then
            return


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/vellum-{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    if getattr(_own, "paths", None) is not None:
        _own.paths.append(path)
    return path


@contextmanager
def collected() -> Iterator[list[str]]:
    """The paths that this thread makes within the block."""
    before, _own.paths = getattr(_own, "paths", None), []
    made = _own.paths
    try:
        yield made
    finally:
        _own.paths = before
        if before is not None:
            before += made


def read_paths(df: DataFrame) -> str:
    """The folders and files that a plan scans, as one text."""
    leaves, out = df._jdf.queryExecution().analyzed().collectLeaves(), []
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation":
            out.append(leaf.relation().location().rootPaths().mkString(" "))
    return " ".join(out)


def stored(df: DataFrame, label: str, **options) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.options(**{"compression": "zstd"} | options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Python workers find this package where the driver did; a cluster gets it with --py-files or its image."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (_ROOT, env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")) if x)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with `value` computed once however often `body` uses it, in inner lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
