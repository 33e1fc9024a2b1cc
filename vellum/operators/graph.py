"""Document and figure graphs: blocks to figures, panels, evidence and packets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions import text

#: Types that are page noise.
NOISE = ("page_header", "page_footer", "page_number", "page_footnote", "page_aside_text")
#: Bucket -> (relation, scope, policy, confidence).
BUCKETS = {
    "visual": ("same_panel_visual", "visual", "use_for_facts", 0.9),
    "caption": ("primary_caption", "panel", "use_for_facts", 0.95),
    "footnote": ("caption_footnote", "figure", "use_for_disambiguation", 0.65),
    "local_text": ("same_panel", "panel", "use_for_facts", 0.8),
    "heading": ("same_section", "section", "use_for_disambiguation", 0.65),
    "background": ("background", "figure", "background_only", 0.45),
    "sibling": ("sibling_panel", "panel", "do_not_use_for_current_panel", 0.25),
    "excluded": ("excluded", "panel", "do_not_use_for_current_panel", 0.1),
    "table": ("adjacent_table", "panel", "use_for_facts", 0.78),
    "formula": ("adjacent_formula", "figure", "use_for_disambiguation", 0.65),
    "reference": ("citation", "figure", "use_for_disambiguation", 0.55),
}
#: Relation -> priority when evidence repeats; others have 0.
PRIORITY = {"primary_caption": 100, "same_panel": 90, "same_figure": 70, "adjacent_table": 65, "adjacent_formula": 65, "citation": 60, "same_section": 50, "background": 20, "sibling_panel": 10, "excluded": 0}


def filter_noise(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, filtered): kept blocks get dense global and per-page orders and remember the old one."""
    kept = blocks.filter(~F.col("type").isin(*NOISE)).withColumn("old_order", F.col("global_order"))
    pages = W.partitionBy("doc", "page").orderBy("old_order")
    # the dense global order is the page's offset and the order in the page: no window over a whole document
    own = kept.withColumn("reading_order", F.row_number().over(pages) - 1)
    sizes = own.groupBy("doc", "page").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy("doc").orderBy("page").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("doc", "page", before.alias("__before"))
    out = own.join(offsets, ["doc", "page"]).withColumn("global_order", (F.col("__before") + F.col("reading_order")).cast("int")).drop("__before")
    return out, blocks.filter(F.col("type").isin(*NOISE)).withColumn("reason", F.concat(F.lit("noise:"), F.col("type")))


def open_headings(blocks: DataFrame, key: list[str], pos: str, level: str, levels: int = 6) -> DataFrame:
    """`blocks` with open: array<struct<at, level>> of the headings that hold at each block, the outermost first.

    A heading holds until the next one of its level or a higher one (a smaller number). One window a
    level carries its last heading; one that a higher level's later heading has closed is dropped. No self-join.
    """
    w = W.partitionBy(*key).orderBy(pos).rowsBetween(W.unboundedPreceding, -1)
    last = [F.last(F.when(F.col(level) == n, F.col(pos)), ignorenulls=True).over(w).alias(f"__h{n}") for n in range(1, levels + 1)]
    out = blocks.select("*", *last)
    found = []
    for n in range(1, levels + 1):
        at = F.col(f"__h{n}")
        closed = F.lit(False)
        for k in range(1, n):
            closed = closed | F.coalesce(F.col(f"__h{k}") > at, F.lit(False))
        found.append(F.when(at.isNotNull() & ~closed, F.struct(at.alias("at"), F.lit(n).alias("level"))))
    return out.withColumn("open", F.array_compact(F.array(*found))).drop(*[f"__h{n}" for n in range(1, levels + 1)])


def figures(blocks: DataFrame) -> DataFrame:
    """Visual blocks with figure and panel: the number in the caption, carried forward over visuals without one.

    Visuals of one page and figure are its panels, by (y, x); a figure without a number is named by its first visual.
    """
    v = blocks.filter(F.col("type").isin("image", "chart")).withColumn("number", text.figure_number(F.col("caption")))
    w = W.partitionBy("doc", "page").orderBy("global_order")
    carried = F.last("number", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    v = v.withColumn("number", carried)
    name = F.when(F.col("number").isNotNull(), F.concat(F.lit("fig-"), F.col("number").cast("string"))).otherwise(F.concat(F.lit("fig-u"), F.first("global_order").over(w).cast("string")))
    v = v.withColumn("figure_id", name)
    by = W.partitionBy("doc", "page", "figure_id").orderBy(F.coalesce(F.col("bbox")[1], F.lit(0.0)), F.coalesce(F.col("bbox")[0], F.lit(0.0)), "global_order")
    v = v.withColumn("panel_pos", F.row_number().over(by) - 1)
    letter = F.when(F.col("panel_pos") < 26, F.char(F.lit(97) + F.col("panel_pos"))).otherwise(F.concat(F.lit("p"), (F.col("panel_pos") + 1).cast("string")))
    return v.withColumn("panel_id", F.concat_ws("-", "figure_id", letter))


def select_evidence(panels: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc, panel_id, bucket, block_id, text): every block of the panel's page in its bucket, by type and distance."""
    p = panels.select("doc", "page", "panel_id", "figure_id", F.col("block_id").alias("visual"), F.col("global_order").alias("at"))
    b = blocks.select("doc", "page", "block_id", "type", "text", "global_order")
    j = p.join(b, ["doc", "page"]).withColumn("gap", F.col("global_order") - F.col("at"))
    bucket = (
        F.when(F.col("block_id") == F.col("visual"), "visual")
        .when(F.col("type").isin("image", "chart"), "sibling")
        .when((F.col("type") == "table") & F.col("gap").between(-3, 5), "table")
        .when((F.col("type") == "formula") & F.col("gap").between(-3, 5), "formula")
        .when(F.col("type") == "reference", "reference")
        .when((F.col("type") == "heading") & (F.col("gap") < 0), "heading")
        .when((F.col("type") == "text") & F.col("gap").between(-3, 3), "local_text")
        .when(F.col("type") == "text", "background")
    )
    return j.withColumn("bucket", bucket).filter("bucket is not null").select("doc", "panel_id", "bucket", "block_id", "text")


def packets(evidence: DataFrame) -> DataFrame:
    """Evidence items with relation, scope, policy, confidence and text hash, repeats by (block, hash, scope) dropped."""
    rows = [(b, *v) for b, v in BUCKETS.items()]
    dims = evidence.sparkSession.createDataFrame(rows, "bucket string, relation string, scope string, policy string, confidence double")
    e = evidence.join(F.broadcast(dims), "bucket").withColumn("text_hash", F.sha1(F.coalesce("text", F.lit(""))))  # eleven rows
    prio = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    e = e.withColumn("priority", F.coalesce(F.try_element_at(prio, F.col("relation")), F.lit(0)) + F.col("confidence"))
    w = W.partitionBy("doc", "panel_id", "block_id", "text_hash", "scope").orderBy(F.desc("priority"), "bucket")
    return e.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn", "priority")
