"""Relational building blocks: top-1, paging, admission, folds and pivots over any table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.session import scratch


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order given (ties must be broken by it)."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def keyset_page(df: DataFrame, cols: list[str], after: tuple, size: int) -> DataFrame:
    """The page of `size` rows after a cursor, by `cols` ascending."""
    later = F.struct(*cols) > F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(cols, after, strict=True)])
    return df.filter(later).orderBy(*cols).limit(size)


def admit(waiting: DataFrame, active: DataFrame, key: str, order: list[str], slots: Column) -> DataFrame:
    """Waiting rows of each key, as many as its slots less its active rows, in order."""
    used = active.groupBy(key).agg(F.count("*").alias("__used"))
    w = W.partitionBy(key).orderBy(*order)
    ranked = waiting.withColumn("__rn", F.row_number().over(w)).join(used, key, "left")
    return ranked.filter(F.col("__rn") <= slots - F.coalesce("__used", F.lit(0))).drop("__rn", "__used")


def pivot_counts(df: DataFrame, keys: list[str], of: str, values: list[str], prefix: str = "n_") -> DataFrame:
    """Count per value in fixed order, 0 where there is none, and the total."""
    counts = [F.count_if(F.col(of) == v).alias(f"{prefix}{v}") for v in values]
    return df.groupBy(*keys).agg(*counts, F.count("*").alias("total"))


def fold_status(df: DataFrame, keys: list[str], status: Column, running: Column | None = None) -> DataFrame:
    """One status for each set of item statuses, by the first rule that holds.

    Anything open: running or pending; all done: succeeded; some done and some failed: partial_failed;
    all cancelled: cancelled; else failed.
    """
    done = ["succeeded", "reused"]
    s = F.col("__s")
    has = lambda *xs: F.arrays_overlap(s, F.array(*map(F.lit, xs)))
    folded = (
        F.when(F.size(s) == 0, "succeeded")
        .when(has("pending", "queued", "processing"), F.when(F.col("__active"), "running").otherwise("pending"))
        .when(F.size(F.array_except(s, F.array(*map(F.lit, done)))) == 0, "succeeded")
        .when(has(*done) & has("failed"), "partial_failed")
        .when(F.size(F.array_except(s, F.array(F.lit("cancelled")))) == 0, "cancelled")
        .otherwise("failed")
    )
    act = F.bool_or(running if running is not None else F.lit(False))
    return df.groupBy(*keys).agg(F.collect_set(status).alias("__s"), act.alias("__active")).withColumn("run_status", folded).drop("__s", "__active")


def first_mode(df: DataFrame, keys: list[str], value: str, pos: str) -> DataFrame:
    """The commonest non-empty value per key; of equal counts the one seen first."""
    counted = df.filter(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(pos).alias("first_pos"))
    return latest_per_key(counted, keys, [F.desc("n"), F.col("first_pos")])


def best_of_duplicates(df: DataFrame, keys: list[str], best: list[str]) -> DataFrame:
    """Rows with group_size, best_row (the `best` columns of their key's least row) and kept (whether it is theirs); `best` tells rows of a key apart.

    One row a key is aggregated in every task first and joined back, so copies of one key need not be in one task.
    """
    g = df.groupBy(*keys).agg(F.count("*").alias("group_size"), F.min(F.struct(*best)).alias("best_row"))
    g = g.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = [df[k].eqNullSafe(g[f"__{k}"]) for k in keys]
    return df.join(g, same).drop(*[f"__{k}" for k in keys]).withColumn("kept", F.struct(*best).eqNullSafe(F.col("best_row")))


def ancestor(nodes: DataFrame, depth: int = 32) -> DataFrame:
    """(start, found, steps): the nearest ancestor that qualifies, itself included, of `nodes` (id, parent, ok); at most `depth` steps, so cycles end.

    Pointer doubling: in each round a node without an answer takes that of the node it points to, or points
    where that one does; rounds are the logarithm of `depth`, each written to the shared folder.
    """
    spark = nodes.sparkSession
    own = F.col("ok")
    none = F.lit(None).cast("bigint")
    at = nodes.select(
        F.col("id").cast("bigint").alias("id"),
        F.when(~own, F.col("parent").cast("bigint")).alias("ptr"),
        F.when(~own, 1).alias("dist"),
        F.when(own, F.col("id").cast("bigint")).otherwise(none).alias("found"),
        F.when(own, 0).alias("steps"),
    )
    covered = 0
    while covered < depth:
        path = scratch(spark, "ancestor")
        at.write.parquet(path)
        at = spark.read.parquet(path)
        p = at.select(F.col("id").alias("ptr"), F.col("ptr").alias("p_ptr"), F.col("dist").alias("p_dist"), F.col("found").alias("p_found"), F.col("steps").alias("p_steps"))
        at = at.join(p, "ptr", "left").select(
            "id",
            F.when(F.col("found").isNull() & F.col("p_found").isNull(), F.col("p_ptr")).alias("ptr"),
            (F.col("dist") + F.col("p_dist")).alias("dist"),
            F.coalesce("found", "p_found").alias("found"),
            F.coalesce("steps", F.col("dist") + F.col("p_steps")).alias("steps"),
        )
        covered = 2 * covered + 1
    return at.filter(F.col("steps") <= depth).select(F.col("id").alias("start"), "found", "steps")
