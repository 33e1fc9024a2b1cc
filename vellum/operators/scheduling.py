"""Bounded admission of batch items, reuse and failure propagation, intents and recovery, as set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Job statuses that hold a slot, and item statuses that are final.
ACTIVE, FINAL = ("pending", "retry", "redis_dispatched", "processing"), ("succeeded", "reused", "failed", "cancelled")


def free_slots(batches: DataFrame, jobs: DataFrame) -> DataFrame:
    """batch_id, slots: concurrency less active jobs; batches without jobs keep all."""
    used = jobs.filter(F.col("status").isin(*ACTIVE)).groupBy("batch_id").agg(F.count("*").alias("used"))
    return batches.join(used, "batch_id", "left").select("batch_id", F.greatest(F.lit(0), F.col("concurrency") - F.coalesce("used", F.lit(0))).alias("slots"))


def schedule(items: DataFrame, batches: DataFrame, jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Pending items with their decision: queued, reused, failed, waiting or left; in (paper, ordinal) order until slots run out.

    items: batch_id, item_id, paper_id, ordinal, sha256, config, retry. jobs: batch_id, paper_id, config, status.
    runs: run_id, sha256, config, status. An explicit retry neither reuses nor inherits a failure. A paper has one job
    at a time: the first of its items is queued, later ones wait.
    """
    busy = jobs.filter(F.col("status").isin(*ACTIVE)).select("paper_id").distinct().withColumn("busy", F.lit(True))
    good = runs.filter("status = 'succeeded'").groupBy("sha256", "config").agg(F.max("run_id").alias("run_id"))
    bad = jobs.filter("status = 'failed'").select("paper_id", "config").distinct().withColumn("failed_before", F.lit(True))
    i = items.join(busy, "paper_id", "left").join(good, ["sha256", "config"], "left").join(bad, ["paper_id", "config"], "left")
    decided = F.when(F.coalesce("busy", F.lit(False)), "waiting").when(~F.col("retry") & F.col("run_id").isNotNull(), "reused").when(~F.col("retry") & F.coalesce("failed_before", F.lit(False)), "failed").otherwise("queued")
    i = i.withColumn("decision", decided)
    order = W.partitionBy("batch_id").orderBy("paper_id", "ordinal")
    nth = F.row_number().over(W.partitionBy("paper_id", "decision").orderBy("batch_id", "ordinal"))
    i = i.withColumn("decision", F.when((F.col("decision") == "queued") & (nth > 1), "waiting").otherwise(F.col("decision")))
    before = F.coalesce(F.sum((F.col("decision") == "queued").cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    i = i.withColumn("before", before).join(free_slots(batches, jobs), "batch_id")
    final = F.when(F.col("before") < F.col("slots"), F.col("decision")).otherwise("left")
    return i.select("batch_id", "item_id", "paper_id", "ordinal", final.alias("decision"), F.when(final == "reused", F.col("run_id")).alias("run_id"))


def cancel(items: DataFrame, batch_ids: list[str]) -> DataFrame:
    """Items of the batches that are not final become cancelled; those in work are asked to stop."""
    hit = F.col("batch_id").isin(*batch_ids)
    status = F.when(hit & (F.col("status") == "processing"), "cancelling").when(hit & ~F.col("status").isin(*FINAL), "cancelled").otherwise(F.col("status"))
    return items.withColumn("status", status)


def stale_jobs(jobs: DataFrame, now: str, minutes: int = 15, limit: int = 20) -> DataFrame:
    """Oldest queued jobs untouched for `minutes`, and processing ones whose lease ran out."""
    at = F.lit(now).cast("timestamp")
    old = F.col("status").isin("pending", "retry", "redis_dispatched") & (F.col("updated_at") < at - F.expr(f"INTERVAL {minutes} MINUTES"))
    lost = (F.col("status") == "processing") & (F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") < at))
    return jobs.filter(old | lost).orderBy("updated_at", "job_id").limit(limit)


def discard_repeats(uploads: DataFrame) -> DataFrame:
    """One paper for each (project, file): the first that is not deleted, with the number of uploads."""
    w = W.partitionBy("project_id", "sha256").orderBy("created_at", "paper_id")
    live = uploads.filter("status <> 'deleted'")
    return live.withColumn("n", F.count("*").over(W.partitionBy("project_id", "sha256"))).withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
