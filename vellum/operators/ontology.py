"""Ontology gaps: rejected measurements whose metric and unit agree become candidates for an overlay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions import units


def gap_candidates(rejected: DataFrame, reasons: list[str], min_support: int = 2) -> DataFrame:
    """Rejected rows with a listed reason whose metric and unit have one dimension, with support, status and confidence.

    Support counts distinct (paper, figure, panel, unit) of a metric and dimension, those with nulls too; it is
    joined back, since a window cannot count distinct values.
    """
    metric, unit = F.trim(F.coalesce("metric_name", F.lit(""))), F.trim(F.coalesce("unit", F.lit("")))
    named = F.concat_ws(" ", metric, F.coalesce("evidence_text", F.lit("")))
    c = rejected.filter(F.col("rejection_reason").isin(*reasons) & (metric != "") & (metric != "metric_name_unknown") & (unit != ""))
    c = c.withColumn("metric_dimension", units.metric_dimension(named)).withColumn("unit_dimension", units.unit_dimension(unit))
    c = c.filter("unit_dimension <> '' and unit_dimension = metric_dimension")
    support = c.groupBy("metric_name", "metric_dimension").agg(F.count_distinct(F.struct("paper_id", "figure_id", "panel_id", "unit")).alias("support_count"))
    base = F.lit(0.7) + F.when(F.size("evidence_ids") > 0, 0.1).otherwise(0.0) + F.when(F.coalesce("group_id", F.lit("")) != "", 0.1).otherwise(0.0)
    own = F.coalesce(F.col("confidence"), F.lit(0.0))
    blended = F.when(own != 0, (base + own) / 2).otherwise(base)
    status = F.when(F.col("support_count") >= min_support, "auto_accepted_overlay").otherwise("auto_proposed_review_required")
    return c.join(support, ["metric_name", "metric_dimension"]).withColumn("proposal_confidence", F.least(F.lit(0.95), F.greatest(F.lit(0.0), blended))).withColumn("approval_status", status)


def overlay(candidates: DataFrame, existing: DataFrame | None = None, pos: str = "pos") -> DataFrame:
    """metric_name, dimension, support: the last accepted candidate of each metric; new metrics win over existing ones."""
    # the last place of each dimension first: a window over the candidates would sort all rows of a common metric in one task
    keys = ["metric_name", "metric_dimension", "support_count"]
    new = candidates.filter("approval_status = 'auto_accepted_overlay'").groupBy(*keys).agg(F.max(pos).alias("__pos"))
    last = W.partitionBy("metric_name").orderBy(F.desc("__pos"), "metric_dimension")
    new = new.withColumn("rn", F.row_number().over(last)).filter("rn = 1")
    new = new.select("metric_name", F.col("metric_dimension").alias("dimension"), F.col("support_count").alias("support"))
    return new if existing is None else new.unionByName(existing.join(new, "metric_name", "left_anti").select(*new.columns))


def unit_allowed(pairs: DataFrame, contract: DataFrame) -> DataFrame:
    """`pairs` (metric, unit) with allowed: a blank unit is not, an unknown metric is, else the contract (metric, units) lists it."""
    known = contract.select("metric", F.transform("units", units.contract_unit).alias("__units"))
    j = pairs.join(known, "metric", "left")
    blank = F.trim(F.coalesce("unit", F.lit(""))) == ""
    return j.withColumn("allowed", F.when(blank, False).when(F.col("__units").isNull(), True).otherwise(F.array_contains("__units", units.contract_unit(F.col("unit"))))).drop("__units")
