"""Spatial joins inside a page, and greedy clusters of boxes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions import geom


def relations(boxes: DataFrame, page: list[str]) -> DataFrame:
    """(page, source, target, relation) for all ordered pairs of a page; `boxes` has id and bbox."""
    a = boxes.select(*page, F.col("id").alias("source"), F.col("bbox").alias("a"))
    b = boxes.select(*page, F.col("id").alias("target"), F.col("bbox").alias("b"))
    j = a.join(b, page).filter("source <> target").withColumn("relation", geom.relation(F.col("a"), F.col("b")))
    return j.filter("relation is not null").select(*page, "source", "target", "relation")


def best_iou(content: DataFrame, layout: DataFrame, page: list[str], least: float) -> DataFrame:
    """Each content box with the layout box of its page that overlaps it most, if enough; the first of equals."""
    a = content.select(*page, F.col("id").alias("block"), F.col("bbox").alias("a"))
    b = layout.select(*page, F.col("id").alias("layout"), F.col("bbox").alias("b"))
    j = a.join(b, page).withColumn("iou", geom.iou(F.col("a"), F.col("b"))).filter(F.col("iou") >= least)
    w = W.partitionBy(*page, "block").orderBy(F.desc("iou"), "layout")
    return j.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select(*page, "block", "layout", "iou")


def greedy_clusters(boxes: DataFrame, page: list[str], gap_x: float = 60.0, gap_y: float = 70.0) -> DataFrame:
    """(page, id, cluster): boxes in (y, x, id) order join the first cluster whose growing union is near, else start one.

    The union depends on what joined before, so a page is one Pandas group; a page holds few boxes.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in boxes.select(*page, "id").schema)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(x=pdf["bbox"].map(lambda b: b[0]), y=pdf["bbox"].map(lambda b: b[1])).sort_values(["y", "x", "id"])
        unions: list[list[float]] = []
        out = []
        for b in pdf["bbox"]:
            for k, u in enumerate(unions):
                dx, dy = max(0.0, max(b[0], u[0]) - min(b[2], u[2])), max(0.0, max(b[1], u[1]) - min(b[3], u[3]))
                if dx <= gap_x and dy <= gap_y:
                    unions[k] = [min(u[0], b[0]), min(u[1], b[1]), max(u[2], b[2]), max(u[3], b[3])]
                    out.append(k)
                    break
            else:
                unions.append(list(b))
                out.append(len(unions) - 1)
        return pdf.assign(cluster=out)[[*page, "id", "cluster"]]

    return boxes.select(*page, "id", "bbox").groupBy(*page).applyInPandas(run, f"{fields}, cluster int")
