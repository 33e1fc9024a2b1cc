"""Geometry queries: boxes are derived from part and supplier keys, pages from brands."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions import geom
from vellum.operators import spatial
from vellum.session import table


def _boxes(spark, d, extra=0):
    p = table(spark, d, "part")
    x, y = (F.col("p_partkey") * 37 + extra) % 500, (F.col("p_partkey") * 53 + extra) % 700
    b = geom.box(x, y, x + F.col("p_size") * 4 + 20, y + F.col("p_size") * 3 + 15)
    return p.select("p_brand", F.expr("p_partkey div 400").alias("page"), F.col("p_partkey").alias("id"), b.alias("bbox"))


def spatial_relations(spark, d):
    r = spatial.relations(_boxes(spark, d), ["p_brand", "page"])
    return r.groupBy("p_brand", "relation").agg(F.count("*").alias("n"), F.sum("source").alias("sources"), F.sum("target").alias("targets"))


def iou_best_match(spark, d):
    return spatial.best_iou(_boxes(spark, d).filter("id % 2 = 0"), _boxes(spark, d, 11).filter("id % 2 = 1"), ["p_brand", "page"], 0.05).select("block", "layout", F.round("iou", 6).alias("iou"))


def band_join(spark, d):
    """Lines of an order within 3 before and 5 after its returned lines."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey")
    g = li.filter("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi"))
    j = li.filter("l_returnflag <> 'R'").join(g, "l_orderkey").filter("l_linenumber between lo - 3 and hi + 5")
    return j.groupBy("l_orderkey").agg(F.count("*").alias("n_near"), F.min("l_partkey").alias("first_part"))


def nearby_captions(spark, d):
    """The first five boxes near a visual: in a reading-order band, or with shared width and a small gap below it."""
    b = _boxes(spark, d)
    v = b.filter("id % 10 = 0").select("p_brand", "page", F.col("id").alias("visual"), F.col("bbox").alias("a"))
    c = b.filter("id % 10 <> 0").select("p_brand", "page", F.col("id").alias("caption"), F.col("bbox").alias("b"))
    j = v.join(c, ["p_brand", "page"]).filter(
        F.col("caption").between(F.col("visual") - 40, F.col("visual") + 60) | ((geom.x_overlap(F.col("a"), F.col("b")) >= 0.2) & (geom.y_gap(F.col("a"), F.col("b")) <= 90))
    )
    w = W.partitionBy("visual").orderBy("caption")
    return j.withColumn("nth", F.row_number().over(w)).filter("nth <= 5").select("visual", "caption", "nth")


def bbox_union(spark, d):
    b = _boxes(spark, d)
    return b.groupBy("p_brand").agg(F.min(F.col("bbox")[0]).alias("x0"), F.min(F.col("bbox")[1]).alias("y0"), F.max(F.col("bbox")[2]).alias("x1"), F.max(F.col("bbox")[3]).alias("y1"))


def bbox_clusters(spark, d):
    b = _boxes(spark, d).withColumn("page", F.expr("id div 100"))
    return spatial.greedy_clusters(b, ["p_brand", "page"])


QUERIES = {f.__name__: f for f in (spatial_relations, iou_best_match, band_join, nearby_captions, bbox_union, bbox_clusters)}


def _box_sql(name, extra=0):
    return f"""{name} AS (SELECT p_brand, p_partkey // 400 AS page, p_partkey AS id, ((p_partkey * 37 + {extra}) % 500)::DOUBLE AS x0, ((p_partkey * 53 + {extra}) % 700)::DOUBLE AS y0,
 ((p_partkey * 37 + {extra}) % 500 + p_size * 4 + 20)::DOUBLE AS x1, ((p_partkey * 53 + {extra}) % 700 + p_size * 3 + 15)::DOUBLE AS y1 FROM part)"""


_INTER = "greatest(0.0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0.0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
_AREA = "({0}.x1 - {0}.x0) * ({0}.y1 - {0}.y0)"
ORACLE = {
    "spatial_relations": f"""
WITH {_box_sql("p")}, r AS (SELECT a.p_brand, a.id AS source, b.id AS target, CASE WHEN a.x0 <= b.x0 AND a.y0 <= b.y0 AND a.x1 >= b.x1 AND a.y1 >= b.y1 THEN 'contains'
 WHEN a.y1 <= b.y0 THEN 'above' WHEN a.y0 >= b.y1 THEN 'below' WHEN a.x1 <= b.x0 THEN 'left_of' WHEN a.x0 >= b.x1 THEN 'right_of' WHEN {_INTER} > 0 THEN 'overlaps'
 WHEN greatest(0, greatest(a.x0, b.x0) - least(a.x1, b.x1)) < 60 OR greatest(0, greatest(a.y0, b.y0) - least(a.y1, b.y1)) < 60 THEN 'near' END AS relation
 FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.page = b.page AND a.id <> b.id)
SELECT p_brand, relation, count(*) AS n, sum(source)::BIGINT AS sources, sum(target)::BIGINT AS targets FROM r WHERE relation IS NOT NULL GROUP BY ALL""",
    "iou_best_match": f"""
WITH {_box_sql("p")}, {_box_sql("q", 11)}, j AS (SELECT a.id AS block, b.id AS layout, {_INTER} / greatest({_AREA.format("a")} + {_AREA.format("b")} - {_INTER}, 1.0) AS iou
 FROM p a JOIN q b ON a.p_brand = b.p_brand AND a.page = b.page AND a.id % 2 = 0 AND b.id % 2 = 1)
SELECT block, layout, round(iou, 6) AS iou FROM j WHERE iou >= 0.05 QUALIFY row_number() OVER (PARTITION BY block ORDER BY iou DESC, layout) = 1""",
    "band_join": "WITH g AS (SELECT l_orderkey, min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) SELECT l.l_orderkey, count(*) AS n_near, min(l_partkey) AS first_part FROM lineitem l JOIN g ON l.l_orderkey = g.l_orderkey AND l_returnflag <> 'R' AND l_linenumber BETWEEN lo - 3 AND hi + 5 GROUP BY l.l_orderkey",
    "nearby_captions": f"""
WITH {_box_sql("p")}, j AS (SELECT a.id AS visual, b.id AS caption FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.page = b.page AND a.id % 10 = 0 AND b.id % 10 <> 0
 AND (b.id BETWEEN a.id - 40 AND a.id + 60 OR (greatest(0.0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) / greatest(least(a.x1 - a.x0, b.x1 - b.x0), 1.0) >= 0.2 AND greatest(0, greatest(a.y0, b.y0) - least(a.y1, b.y1)) <= 90)))
SELECT visual, caption, (row_number() OVER (PARTITION BY visual ORDER BY caption))::INT AS nth FROM j QUALIFY nth <= 5""",
    "bbox_union": f"WITH {_box_sql('p')} SELECT p_brand, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM p GROUP BY p_brand",
}
