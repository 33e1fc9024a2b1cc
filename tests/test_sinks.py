"""A folder of CSV for each panel: whole in both ways of writing, few tasks for many panels, hot panels spread."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from vellum.sources import sinks

VALUES = ["plain", 'say "a\\b", so', "two\nlines\r\nand three", "", None, " spaced "]


def _files(root):
    return {d.name: sorted(f.read_text(newline="") for f in d.glob("part-*.csv")) for d in root.iterdir() if d.is_dir()}


def test_panels_written_either_way_are_the_same_and_read_whole(spark, tmp_path):
    df = spark.createDataFrame([(i, v, f"p/{i % 4}" if i % 4 else None) for i, v in enumerate(VALUES * 3)], "k long, `a,b` string, panel_id string").withColumnRenamed("a,b", "a")
    sinks.write_panel_csv(df, f"file://{tmp_path}/own", {"run": "r,1"})
    sinks.write_panel_csv(df, f"{tmp_path}/spark", {"run": "r,1"})
    assert _files(tmp_path / "own") == _files(tmp_path / "spark") and len(_files(tmp_path / "own")) == 4
    assert {p.name for p in (tmp_path / "own").rglob("*") if p.is_file() and not p.name.startswith("part-")} == {"_SUCCESS"}
    got = sinks.read_panel_csv(spark, f"file://{tmp_path}/own", ["k", "a", "panel_id", "run"])
    want = df.select(F.col("k").cast("string"), F.trim(F.nullif("a", F.lit(""))).alias("a"), "panel_id", F.lit("r,1"), F.coalesce(F.regexp_replace("panel_id", "/", "_"), F.lit("unknown_panel")))
    assert sorted(map(str, got.collect())) == sorted(str(r) for r in got.sparkSession.createDataFrame(want.collect(), got.schema).collect())
    with pytest.raises(Exception, match="(?i)header"):
        sinks.read_panel_csv(spark, f"file://{tmp_path}/own", ["k", "b", "panel_id", "run"]).collect()
    with pytest.raises(FileExistsError):
        sinks.write_panel_csv(df, f"file://{tmp_path}/own", {})


def test_many_panels_take_few_tasks(spark, tmp_path):
    spark.range(2000).select(F.col("id").alias("event_id"), F.col("id").alias("user_id")).write.parquet(f"{tmp_path}/events.parquet")
    sc = spark.sparkContext
    sc.setJobGroup("many_panels", "")
    try:
        rows = __spark_entry__.queries()["written_panels"](spark, f"file://{tmp_path}").collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    seen = sc.statusTracker()
    stages = {s for j in seen.getJobIdsForGroup("many_panels") for s in seen.getJobInfo(j).stageIds}
    assert len(rows) == 1502 and {(r["panel_file"], r["n"]) for r in rows} >= {("json", 2000), ("unknown_panel", 500), ("fig_1_1999", 1)}
    assert sum(s.numTasks for s in map(seen.getStageInfo, stages) if s) < 400


def test_no_events_are_no_panels(spark, tmp_path):
    spark.range(0).select(F.col("id").alias("event_id"), F.col("id").alias("user_id")).write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in __spark_entry__.queries()["written_panels"](spark, f"file://{tmp_path}").collect()] == [("json", 0, None)]


def test_a_hot_panel_is_more_than_one_task(spark, tmp_path):
    key, before = "spark.sql.adaptive.advisoryPartitionSizeInBytes", spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set(key, "256k")
    try:
        df = spark.range(0, 400000, 1, 8).select(F.md5(F.col("id").cast("string")).alias("v"), F.lit(None).cast("string").alias("panel_id"))
        sinks.write_panel_csv(df, f"file://{tmp_path}/hot", {})
    finally:
        spark.conf.set(key, before)
    assert len(list((tmp_path / "hot" / "panel_file=unknown_panel").glob("part-*.csv"))) > 1
    assert sinks.read_panel_csv(spark, f"file://{tmp_path}/hot", ["v", "panel_id"]).agg(F.count("*"), F.count_distinct("v")).first()[:] == (400000, 400000)
