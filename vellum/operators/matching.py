"""Joins of assets, results, audit rows and titles by ids, file names and contained names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.lower(F.element_at(F.split(F.regexp_replace(F.coalesce(path, F.lit("")), r"\\", "/"), "/"), -1))


def refs_to_blocks(refs: DataFrame, blocks: DataFrame, doc: str = "doc") -> DataFrame:
    """Each image reference with the first block of its document whose image has its file name and a matching path.

    The file name is the equality of the join; of paths, one must end with the other.
    """
    a = refs.withColumn("__base", basename(F.col("image")))
    b = blocks.select(doc, "block_id", "image_path", F.col("global_order").alias("__at"), basename(F.col("image_path")).alias("__base"))
    j = a.join(b, [doc, "__base"]).filter(F.col("image").endswith(F.col("image_path")) | F.col("image_path").endswith(F.col("image")))
    w = W.partitionBy(doc, "image").orderBy("__at")
    return j.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn", "__at", "__base")


def results_to_assets(results: DataFrame, assets: DataFrame, paper: str = "paper_id") -> DataFrame:
    """`results` with asset_id: of the same panel, else of the same file name; the least id of equals; null if none."""
    by_panel = assets.filter("coalesce(panel_id, '') <> ''").groupBy(paper, "panel_id").agg(F.min("asset_id").alias("__p"))
    by_name = assets.withColumn("__base", basename(F.col("path"))).filter("__base <> ''").groupBy(paper, "__base").agg(F.min("asset_id").alias("__n"))
    r = results.withColumn("__base", basename(F.col("image_ref")))
    j = r.join(by_panel, [paper, "panel_id"], "left").join(by_name, [paper, "__base"], "left")
    return j.withColumn("asset_id", F.coalesce("__p", "__n")).drop("__p", "__n", "__base")


def assets_to_rows(assets: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """asset_id, source, row_id: the first table, in the order given, with a row of one of the asset's file names."""
    names = assets.select("asset_id", F.explode(F.transform("names", basename)).alias("base")).filter("base <> ''")
    rows = None
    for k, (name, df) in enumerate(tables.items()):
        one = df.select(basename(F.col("source_image")).alias("base"), F.col("row_id"), F.lit(name).alias("source"), F.lit(k).alias("rank"))
        rows = one if rows is None else rows.unionByName(one)
    w = W.partitionBy("asset_id").orderBy("rank", "row_id")
    return names.join(rows, "base").withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("asset_id", "source", "row_id")


def title_key(c: Column) -> Column:
    """Lower case, without extension, other runs than letters and digits as one space."""
    base = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\.(pdf|json|md)$", "")
    return F.trim(F.regexp_replace(base, r"[^\p{L}\p{N}]+", " "))


def contained_titles(titles: DataFrame, names: DataFrame) -> DataFrame:
    """Each title with the longest name that it contains as a run of whole words, or that contains it; then the best quality, then the least name.

    Runs of words make an equality for the join: a title of n words has n (n + 1) / 2 of them.
    """
    def runs(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
        w = F.split(key, " ")
        spans = F.flatten(F.transform(F.sequence(F.lit(1), F.size(w)), lambda a: F.transform(F.sequence(a, F.size(w)), lambda b: F.array_join(F.slice(w, a, b - a + 1), " "))))
        return df.filter(F.col(key) != "").select(*cols, F.explode(F.array_distinct(spans)).alias("__run"))

    t = titles.withColumn("t_key", title_key(F.col("title")))
    n = names.withColumn("n_key", title_key(F.col("name")))
    inside = runs(t, "t_key", ["title"]).join(n.filter("n_key <> ''").withColumnRenamed("n_key", "__run"), "__run")
    around = runs(n, "n_key", ["name", "quality"]).join(t.filter("t_key <> ''").select("title", F.col("t_key").alias("__run")), "__run")
    j = inside.select("title", "name", "quality", F.length("__run").alias("score")).union(around.select("title", "name", "quality", F.length("__run").alias("score")))
    w = W.partitionBy("title").orderBy(F.desc("score"), F.desc("quality"), "name")
    return j.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def contained_parts(a: DataFrame, b: DataFrame) -> DataFrame:
    """key, match_key, score of texts `a` (key, name) and `b` (match_key, match) of which one contains the other; score is the shorter one's length.

    Parts of a text make an equality for the join, of those lengths only that the other side has: a bounded
    number for names and titles, which are short.
    """
    def parts(df: DataFrame, col: str, lengths: DataFrame) -> DataFrame:
        sized = df.join(F.broadcast(lengths)).filter(F.size("lens") > 0)  # one row of different lengths
        cut = F.flatten(F.transform(F.filter("lens", lambda k: k <= F.length(col)), lambda k: F.transform(F.sequence(F.lit(1), F.length(col) - k + 1), lambda i: F.substr(F.col(col), i, k))))
        return sized.withColumn("part", F.explode(F.array_distinct(cut))).drop("lens")

    lens = lambda df, col: df.filter(F.col(col) != "").agg(F.array_sort(F.collect_set(F.length(col))).alias("lens"))
    inside = parts(a, "name", lens(b, "match")).join(b.withColumnRenamed("match", "part"), "part")
    around = parts(b, "match", lens(a, "name")).join(a.withColumnRenamed("name", "part"), "part")
    cols = ["key", "match_key", F.length("part").alias("score")]
    return inside.select(*cols).union(around.select(*cols)).distinct()
