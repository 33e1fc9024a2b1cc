"""Mixing: sources reach their target weights by Poisson replication, in a global random order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.llm._store import let, partitions, stored

#: A mean above this is drawn as a sum of that many smaller ones: exp(-mean) stays far from underflow.
MEAN_LIMIT = 32.0
#: Inverse distributions are listed up to so many copies for one draw; at a mean of 32 the tail beyond it is below 2**-60.
TAIL = 128
#: Sources up to this number are broadcast (under 200 bytes of means and distribution head each, 128 doubles at most: 11 MB).
BROADCAST_SOURCES = 10_000


def uniform(*parts: Column | str) -> Column:
    """52 bits of the MD5 of the parts, joined by |, as a double in [0, 1)."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string") if isinstance(p, Column) else F.lit(p), F.lit("null")) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))


def _cdf(mean: Column) -> Column:
    """[P(X <= 0), P(X <= 1), ...] of a Poisson distribution."""
    step = lambda s, k: F.struct(
        (s["p"] * mean / k).alias("p"),
        F.concat(s["c"], F.array(F.element_at(s["c"], -1) + s["p"] * mean / k)).alias("c"),
    )
    zero = F.exp(-mean)
    return F.aggregate(F.sequence(F.lit(1), F.lit(TAIL)), F.struct(zero.alias("p"), F.array(zero).alias("c")), step, lambda s: s["c"])


def source_means(docs: DataFrame, weights: dict[str, float] | None = None, size: float = 1.0, source_col: str = "source") -> DataFrame:
    """Per source: rows, target repetition rate, the draws that make it up and the distribution of one draw.

    rate = size * all rows * weight share / rows of the source. Without `weights`, all sources weigh
    the same; with them, unlisted sources weigh 0 (null is the source None).
    """
    counts = docs.groupBy(F.col(f"`{source_col}`").alias("__source")).agg(F.count(F.lit(1)).alias("__n"))
    if weights is None:
        weight: Column = F.lit(1.0)
    else:
        weight = F.lit(0.0)
        for k, v in weights.items():
            weight = F.when(F.col("__source").eqNullSafe(F.lit(k)), F.lit(float(v))).otherwise(weight)
    counts = counts.withColumn("__w", weight)
    everything = W.partitionBy()  # of a row for each source
    counts = counts.withColumns({"__all": F.sum("__n").over(everything), "__sum": F.sum("__w").over(everything)})
    rate = F.lit(float(size)) * F.col("__all") * F.col("__w") / (F.col("__sum") * F.col("__n"))
    return (
        counts.withColumn("__rate", F.when(F.col("__sum") > 0, rate).otherwise(0.0))
        .withColumn("__draws", F.greatest(F.lit(1), F.ceil(F.col("__rate") / MEAN_LIMIT)).cast("int"))
        .withColumn("__cdf", _cdf(F.col("__rate") / F.col("__draws")))
        .select("__source", "__rate", "__draws", "__cdf")
    )


def mix(docs: DataFrame, weights: dict[str, float] | None = None, size: float = 1.0, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Each row as often as a Poisson draw seeded by its id says; columns of `docs` plus copy, n_copies, rate, shuffle_key.

    The draw of a row inverts the Poisson distribution of its source's rate at a uniform hash of
    (seed, id, draw), so it is the same in any run and partitioning. Rows lie in the order of a hash
    of (seed, id, copy): dealt to partitions by one hash, sorted in them by it.

    A null id is hashed as 'null'; a null source is a source of its own; repeated rows draw the same
    count each; null or empty texts are rows like others. An empty table gives an empty one. Columns
    of `docs` named copy, n_copies, rate or shuffle_key are replaced. The text moves in one shuffle,
    by a uniform key: a source that holds a third of all rows spreads evenly.
    """
    made = ("copy", "n_copies", "rate", "shuffle_key")
    base = docs.drop(*made)
    means = stored(source_means(base, weights, size, source_col), "mix-means")
    if means.count() <= BROADCAST_SOURCES:
        means = F.broadcast(means)
    ident = F.col(f"`{id_col}`")
    draw = lambda j: let(uniform(seed, ident, j), lambda u: F.size(F.filter(F.col("__cdf"), lambda c: c <= u)))
    drawn = F.aggregate(F.sequence(F.lit(1), F.col("__draws")), F.lit(0), lambda s, j: s + draw(j))
    out = (
        base.join(means, F.col(f"`{source_col}`").eqNullSafe(F.col("__source")))
        .withColumn("n_copies", drawn.cast("bigint"))
        .filter(F.col("n_copies") > 0)
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_copies"))))
        .withColumn("rate", F.col("__rate"))
        .withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), F.coalesce(ident.cast("string"), F.lit("null")), F.col("copy").cast("string"))))
        .select(*[f"`{c}`" for c in base.columns], *made)
    )
    return out.repartition(partitions(docs.sparkSession), "shuffle_key").sortWithinPartitions("shuffle_key")
