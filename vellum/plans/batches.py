"""Batch scheduling, asset gates and payload repair bound to orders, part and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import assets, repair, scheduling
from vellum.session import table


def schedule_items(spark, d):
    """Pending orders as items of fifty batches; a customer is the paper."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    batch = (F.col("o_custkey") % 50).alias("batch_id")
    config = F.substring("o_orderpriority", 1, 1).alias("config")
    items = o.filter("o_orderstatus = 'P'").select(batch, F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("paper_id"), F.col("o_orderkey").alias("ordinal"), (F.col("o_custkey") % 97).alias("sha256"), config, (F.col("o_orderkey") % 10 == 0).alias("retry"))
    live = o.filter("o_orderstatus = 'O' and o_orderkey % 5 = 0").select(batch, F.col("o_custkey").alias("paper_id"), config, F.lit("processing").alias("status"))
    dead = o.filter("o_orderstatus = 'F' and o_orderkey % 7 = 0").select(batch, F.col("o_custkey").alias("paper_id"), config, F.lit("failed").alias("status"))
    runs = c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("run_id"), (F.col("c_custkey") % 97).alias("sha256"), (F.col("c_custkey") % 5 + 1).cast("string").alias("config"), F.lit("succeeded").alias("status"))
    batches = spark.range(50).select(F.col("id").alias("batch_id"), (F.lit(20) + F.col("id")).alias("concurrency"))
    return scheduling.schedule(items, batches, live.unionByName(dead), runs)


def asset_gate(spark, d):
    p = table(spark, d, "part").withColumns({"w": F.col("p_size") * 8, "h": (F.col("p_partkey") % 200).cast("int"), "size": (F.col("p_retailprice") / 4).cast("bigint")})
    caption = F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.col("p_name"))
    panel = F.when(F.col("p_partkey") % 9 == 0, "a")
    skip = assets.skip_reason(F.col("w"), F.col("h"), F.col("size"), caption, F.when(F.col("p_partkey") % 3 == 0, F.lit("near")))
    return p.select("p_partkey", F.coalesce(skip, F.lit("")).alias("skip_reason"), assets.asset_readiness(skip, caption, panel).alias("readiness"), assets.image_readability(F.col("w"), F.col("h")).alias("readability"), assets.evidence_shape(F.lit("image"), caption, F.col("p_type"), F.lit(0.0)).alias("shape"))


def repair_payloads(spark, d):
    """Props with faults put in: words for numbers, fences, noise keys, fields outside the schema."""
    e = table(spark, d, "events")
    k = F.col("event_id") % 4
    payload = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).when(k == 2, F.concat(F.lit('{"confidence":"high","":1,"note":"'), F.col("event_type"), F.lit('"}'))).otherwise(F.lit("not json"))
    spec = {"k": repair.Field("number"), "score": repair.Field("number", aliases=("confidence",), default=0.4), "label": repair.Field("string")}
    r = repair.repair(e.select("event_id", payload.alias("payload")), spec)
    kinds = F.array_join(F.array_sort(F.transform("repairs", lambda x: x["repair"])), ";")
    return r.select("event_id", "k", "score", F.coalesce("label", F.lit("")).alias("label"), kinds.alias("repairs"), "degraded")


QUERIES = {f.__name__: f for f in (schedule_items, asset_gate, repair_payloads)}
ORACLE = {
    "schedule_items": """
WITH i AS (SELECT o_custkey % 50 AS batch_id, o_orderkey AS item_id, o_custkey AS paper_id, o_orderkey AS ordinal, o_custkey % 97 AS h, substr(o_orderpriority, 1, 1) AS cfg, o_orderkey % 10 = 0 AS retry FROM orders WHERE o_orderstatus = 'P'),
live AS (SELECT o_custkey AS paper_id, o_custkey % 50 AS batch_id FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 5 = 0),
dead AS (SELECT DISTINCT o_custkey AS paper_id, substr(o_orderpriority, 1, 1) AS cfg FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 7 = 0),
run AS (SELECT c_custkey % 97 AS h, (c_custkey % 5 + 1)::VARCHAR AS cfg, max(c_custkey) AS run_id FROM customer WHERE c_custkey % 3 = 0 GROUP BY ALL),
a AS (SELECT i.*, run.run_id, CASE WHEN i.paper_id IN (SELECT paper_id FROM live) THEN 'waiting' WHEN NOT retry AND run.run_id IS NOT NULL THEN 'reused' WHEN NOT retry AND dead.paper_id IS NOT NULL THEN 'failed' ELSE 'queued' END AS d
 FROM i LEFT JOIN run ON run.h = i.h AND run.cfg = i.cfg LEFT JOIN dead ON dead.paper_id = i.paper_id AND dead.cfg = i.cfg),
b AS (SELECT *, CASE WHEN d = 'queued' AND row_number() OVER (PARTITION BY paper_id, d ORDER BY batch_id, ordinal) > 1 THEN 'waiting' ELSE d END AS d2 FROM a),
s AS (SELECT b AS batch_id, greatest(0, 20 + b - (SELECT count(*) FROM live WHERE live.batch_id = b)) AS slots FROM range(50) t(b)),
c AS (SELECT *, coalesce(sum((d2 = 'queued')::INT) OVER (PARTITION BY batch_id ORDER BY paper_id, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM b),
f AS (SELECT c.*, CASE WHEN n < slots THEN d2 ELSE 'left' END AS decision FROM c JOIN s ON c.batch_id = s.batch_id)
SELECT batch_id, item_id, paper_id, ordinal, decision, CASE WHEN decision = 'reused' THEN run_id END AS run_id FROM f""",
    "asset_gate": """
WITH p AS (SELECT *, p_size * 8 AS w, (p_partkey % 200)::INT AS h, floor(p_retailprice / 4)::BIGINT AS size, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_name END AS cap, CASE WHEN p_partkey % 3 = 0 THEN 'near' ELSE '' END AS near FROM part),
s AS (SELECT *, concat_ws('; ', CASE WHEN w < 32 OR h < 32 THEN 'too small: ' || w || 'x' || h END, CASE WHEN size < 256 THEN 'file too small: ' || size || ' bytes' END, CASE WHEN cap = '' AND near = '' THEN 'missing caption and nearby context' END) AS why FROM p)
SELECT p_partkey, why AS skip_reason, CASE WHEN why <> '' THEN 'skip' WHEN cap = '' OR p_partkey % 9 = 0 THEN 'low_confidence' ELSE 'ready' END AS readiness,
 CASE WHEN w < 50 OR h < 50 THEN 'too_small' WHEN w < 180 OR h < 180 THEN 'low_resolution' ELSE 'usable' END AS readability,
 CASE WHEN regexp_matches(lower(cap || ' ' || p_type), 'sem|tem|afm|confocal|microscopy|microscope|scale bar') THEN 'microscopy_structure' WHEN regexp_matches(lower(cap || ' ' || p_type), 'ftir|raman|xrd|xps|spectrum|spectra') THEN 'chemical_characterization'
 WHEN regexp_matches(lower(cap || ' ' || p_type), 'omics|transcript|gene|pathway|metabol') THEN 'omics_or_pathway_analysis' WHEN regexp_matches(lower(cap || ' ' || p_type), 'simulation|model|mesh|finite element') THEN 'simulation_spatial_field'
 WHEN regexp_matches(lower(cap || ' ' || p_type), 'photo|sample|hydrogel|colony|gel|bead|macro') THEN 'macro_material_photo' ELSE 'conceptual_schematic' END AS shape FROM s""",
    "repair_payloads": """
SELECT event_id, CASE WHEN event_id % 4 < 2 THEN (props::JSON->>'k')::DOUBLE END AS k, CASE WHEN event_id % 4 = 2 THEN 0.9 ELSE 0.4 END::DOUBLE AS score, '' AS label,
 CASE event_id % 4 WHEN 2 THEN 'copy_alias_property;drop_additional_property;noise_key_dropped;string_to_number' WHEN 3 THEN 'fill_known_required;json_decode_failed' ELSE 'fill_known_required' END AS repairs, event_id % 4 = 3 AS degraded FROM events""",
}
