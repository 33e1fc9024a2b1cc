"""Reports, records and the document graph over events, conversations, parts and lines."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions import geom
from vellum.operators import assets, audit, graph, heatmap, matching, ontology, reports
from vellum.plans import points
from vellum.session import table
from vellum.sources import files

#: Event type -> block type, and metric and unit of rejected rows by user.
KINDS = {"click": "text", "error": "image", "purchase": "table", "signup": "heading", "view": "page_footer"}
METRICS = ["growth rate", "pressure", "mystery", "yield percent"]
UNITS = ["1/h", "Pa", "%"]
KEYS = ["a//b/./c", "/x/y/", "./q", "w\\v"]


def _map(values, c):
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), c)


def _pick(values, k):
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values)).cast("int") + 1)


def loaded_blocks(spark, d):
    """Conversations as files of page-nested blocks, two turns a page, loaded again."""
    c = table(spark, d, "conversations")
    block = F.struct(F.when(F.col("role") == "user", "Title").otherwise("paragraph").alias("type"), F.col("text"), F.array(F.col("turn"), F.lit(1), F.lit(2), F.lit(3)).alias("bbox"), F.struct(F.col("turn").alias("level")).alias("content"))
    page = c.groupBy("conv_id", F.expr("turn div 2").alias("page")).agg(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))).alias("own"))
    doc = page.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("page", F.col("own.b").alias("b")))).alias("pages"))
    f = doc.select(F.col("conv_id").cast("string").alias("path"), F.to_json(F.col("pages.b")).alias("value"))
    b = files.load_blocks(f)
    return b.select("doc", "page", "reading_order", "block_id", "type", F.md5("text").alias("text_md5"), F.col("bbox")[0].alias("x0"), "level")


def loaded_layout(spark, d):
    """Parts as layout pages of a brand, a file for each 20,000 keys of it; boxes of three numbers go."""
    p = table(spark, d, "part").withColumn("path", F.concat(F.expr("p_partkey div 20000").cast("string"), F.lit("/"), "p_brand"))
    box = F.when(F.col("p_partkey") % 4 != 0, F.array(F.lit(0), F.lit(0), F.col("p_size"), F.lit(9))).otherwise(F.array(F.lit(1), F.lit(2), F.lit(3)))
    g = p.groupBy("path", (F.col("p_partkey") % 3).alias("page_idx")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", F.struct(F.col("p_type").alias("type"), box.alias("bbox")).alias("b")))).alias("own"))
    doc = g.groupBy("path").agg(F.struct(F.array_sort(F.collect_list(F.struct("page_idx", F.col("own.b").alias("preproc_blocks")))).alias("pages")).alias("j"))
    l = files.load_layout(doc.select("path", F.to_json("j").alias("value")))
    return l.groupBy(F.regexp_replace("doc", "^[^/]*/", "").alias("doc"), "page").agg(F.count("*").alias("n"), F.sum(F.col("bbox")[2]).alias("width"), F.min("type").alias("first_type"))


def _blocks(spark, d):
    e = table(spark, d, "events")
    at = F.array(F.lit(0.0), F.col("event_id").cast("double"), F.lit(9.0), F.col("event_id") + 5.0)
    return e.select(F.col("user_id").alias("doc"), F.expr("event_id div 100").cast("int").alias("page"), F.col("event_id").alias("global_order"), F.concat(F.lit("b"), F.col("event_id").cast("string")).alias("block_id"), _map(KINDS, F.col("event_type")).alias("type"),
                    F.concat(F.lit("t"), (F.col("event_id") % 10).cast("string")).alias("text"), F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("Fig. "), (F.col("event_id") % 7).cast("string"))).alias("caption"), at.alias("bbox"))


def graph_noise(spark, d):
    """Kept blocks by their new and old order, and what was left out with its reason."""
    kept, lost = graph.filter_noise(_blocks(spark, d))
    k = kept.select("doc", "page", "old_order", "global_order", "reading_order", F.lit("").alias("reason"))
    return k.unionByName(lost.select("doc", "page", F.col("global_order").alias("old_order"), F.lit(None).cast("int").alias("global_order"), F.lit(None).cast("int").alias("reading_order"), "reason"))


def graph_evidence(spark, d):
    """Figures by carried numbers, their panels' evidence by bucket, and the packets that are left of it."""
    b = _blocks(spark, d)
    e = graph.select_evidence(graph.figures(b), b)
    p = graph.packets(e).groupBy("doc", "bucket").agg(F.count("*").alias("n_kept"), F.round(F.sum("confidence"), 4).alias("confidence"))
    return e.groupBy("doc", "bucket").agg(F.count("*").alias("n"), F.count_distinct("panel_id").alias("n_panels")).join(p, ["doc", "bucket"])


def gap_overlay(spark, d):
    """Rejected rows whose metric and unit agree, their support, and the overlay of the accepted ones."""
    e = table(spark, d, "events")
    r = e.select(_pick(METRICS, F.col("user_id")).alias("metric_name"), _pick(UNITS, F.col("event_id")).alias("unit"), F.lit("").alias("evidence_text"), _pick(["gap", "other"], F.col("event_id")).alias("rejection_reason"), F.col("user_id").alias("paper_id"), F.col("event_type").alias("figure_id"),
                 F.lit("p").alias("panel_id"), F.array().cast("array<string>").alias("evidence_ids"), F.when(F.col("event_id") % 3 == 0, "g").alias("group_id"), F.lit(0.5).alias("confidence"), F.col("event_id").alias("pos"))
    c = ontology.gap_candidates(r, ["gap"])
    o = ontology.overlay(c, spark.createDataFrame([("pressure", "old", 1), ("extra", "old", 1)], "metric_name string, dimension string, support bigint"))
    g = c.groupBy("metric_name").agg(F.count("*").alias("n"), F.max("support_count").alias("support_count"), F.round(F.sum("proposal_confidence"), 4).alias("confidence"))
    return o.join(g, "metric_name", "left")


def heatmap_grid(spark, d):
    """Cells of parts' heatmaps, their boxes from payloads of three forms, and the value of the nearest of 80 colours."""
    p = table(spark, d, "part")
    k = F.col("p_partkey") % 3
    left, side = F.col("p_partkey") % 50, F.col("p_size") + 10
    payload = F.when(k == 0, F.to_json(F.array(left, left, left + side, left + side))).when(k == 1, F.to_json(F.struct((left + side).alias("x0"), left.alias("y0"), left.alias("x1"), (left + side).alias("y1")))).otherwise(F.to_json(F.struct(left.alias("x"), left.alias("y"), side.alias("width"), side.alias("height"))))
    xs = heatmap.axis_values(F.when(k == 0, F.array(F.col("p_size").cast("double"), F.lit(1.0), F.lit(1.0))).otherwise(F.array().cast("array<double>")), F.lit(0.0), F.lit(4.0))
    b = p.select("p_partkey", heatmap.coerce_box(F.parse_json(payload), F.lit(200), F.lit(150)).alias("bbox"), xs.alias("xs"), F.array(F.lit(1.0), F.lit(2.0)).alias("ys"))
    values = heatmap.palette_values(F.lit(0.0), F.lit(79.0))
    palette = F.transform(values, lambda v, i: F.struct(F.array(i, i, i).alias("rgb"), v.alias("value")))
    g = heatmap.grid(b, "xs", "ys").withColumn("px", F.least("px", F.lit(300)))
    return g.select("p_partkey", "x_value", "y_value", "px", "py", F.round(heatmap.nearest_value(F.array("px", "px", "px"), palette), 6).alias("value"))


def matched_assets(spark, d):
    """Results by panel or file name, images of references by file name, and the table that has an asset's row."""
    o = table(spark, d, "orders")
    a = o.select((F.col("o_custkey") % 50).alias("paper_id"), F.col("o_orderkey").alias("asset_id"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("p"), (F.col("o_orderkey") % 20).cast("string"))).alias("panel_id"), F.concat(F.lit("D/"), (F.col("o_orderkey") % 30).cast("string"), F.lit(".PNG")).alias("path"))
    e = table(spark, d, "events")
    r = e.select((F.col("user_id") % 50).alias("paper_id"), "event_id", F.concat(F.lit("p"), (F.col("event_id") % 25).cast("string")).alias("panel_id"), F.concat(F.lit("x\\"), (F.col("event_id") % 40).cast("string"), F.lit(".png")).alias("image_ref"))
    return matching.results_to_assets(r, a).select("event_id", "asset_id")


def asset_rows(spark, d):
    e = table(spark, d, "events")
    a = e.select(F.col("event_id").alias("asset_id"), F.array(F.concat(F.lit("a/"), (F.col("event_id") % 90).cast("string")), F.concat((F.col("event_id") % 70).cast("string"))).alias("names"))
    s = lambda lo, hi: table(spark, d, "customer").filter(f"c_custkey between {lo} and {hi}").select(F.concat(F.lit("z/"), F.col("c_custkey").cast("string")).alias("source_image"), F.col("c_custkey").alias("row_id"))
    return matching.assets_to_rows(a, {"facts": s(40, 60), "metrics": s(0, 75)})


def asset_shapes(spark, d):
    """What captions say that parts show, their figure labels and panel letters."""
    p = table(spark, d, "part")
    words = _pick(["SEM of cold", "Raman spectra", "gene pathway", "finite element model", "photo", "Fig. 3b plain", "b)"], F.col("p_partkey"))
    kind = F.when(F.col("p_partkey") % 10 == 0, " Chart ").otherwise("image")
    return p.select("p_partkey", assets.evidence_shape(kind, words, F.lit(""), F.lit(0.1)).alias("shape"), assets.figure_label(words).alias("label"), assets.panel_letter(words).alias("letter"))


def delivery_reports(spark, d):
    r = reports.count_report({n: table(spark, d, n) for n in ("nation", "region", "customer")}, "2024-01-01")
    new = table(spark, d, "nation").filter("n_nationkey < 3").select(F.col("n_name").alias("metric_id"), F.lit("new").alias("dimension"), F.col("n_nationkey").cast("bigint").alias("support"))
    old = table(spark, d, "nation").filter("n_nationkey between 2 and 4").select(F.col("n_name").alias("metric_id"), F.lit("old").alias("dimension"), F.col("n_nationkey").cast("bigint").alias("support"))
    return r.unionAll(reports.overlay_document(new, old))


def audit_reviews(spark, d):
    e = table(spark, d, "events")
    p = e.select(F.col("user_id").alias("run_id"), F.lpad(F.col("event_id").cast("string"), 8, "0").alias("panel_id"), F.col("event_type").alias("panel_decision"), (F.col("event_id") % 4).alias("n_facts"), F.when(F.col("event_type") == "error", "bad").alias("error"))
    a = reports.audit_documents(p)
    return a.select("run_id", F.get_json_object("audit", "$.facts").cast("bigint").alias("facts"), F.get_json_object("audit", "$.panels[0].panel_id").alias("first_panel"), F.md5("review").alias("review_md5"))


def figure_lines(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("doc"), F.concat(F.lit("i/"), (F.col("event_id") % 40).cast("string"), F.lit(".png")).alias("image_path"), F.col("event_id").alias("pos"))
    return reports.figure_records(e, ["pos"])


def previews(spark, d):
    """Turns as CSV texts with quotes, commas and line ends in cells."""
    c = table(spark, d, "conversations")
    line = lambda q, n: F.concat(F.lit('"'), F.replace(q, F.lit('"'), F.lit('""')), F.lit('",'), n, F.lit("\r\n"))
    body = F.concat(F.lit("text,n\r\n"), line(F.col("text"), F.col("turn").cast("string")), F.lit(" , \r\n"), line(F.concat(F.lit('say "hi", '), "role"), F.lit("x")))
    p = reports.csv_preview(c.select("conv_id", "turn", body.alias("csv")), "csv")
    return p.select("conv_id", "turn", F.array_join("preview.headers", "|").alias("headers"), F.size("preview.rows").alias("n_rows"), F.md5(F.col("preview.rows")[0][0]).alias("cell_md5"), F.col("preview.rows")[1][0].alias("second"))


def adopted_rows(spark, d):
    target = T.StructType([T.StructField("c_custkey", T.StringType()), T.StructField("C_ACCTBAL", T.IntegerType()), T.StructField("status", T.StringType()), T.StructField("gone", T.LongType())])
    a = reports.adopted(table(spark, d, "customer"), target, {"status": "active"})
    return a.select("c_custkey", F.col("C_ACCTBAL").alias("balance"), "status", "gone")


def object_keys(spark, d):
    k = spark.createDataFrame([(x,) for x in KEYS], "key string")
    return k.select("key", reports.object_key(F.col("key")).alias("clean"))


def panel_contexts(spark, d):
    c = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("pos"), _pick(["caption", "table", "formula"], F.col("turn")).alias("kind"), "text")
    p = reports.panel_contexts(c, ["conv_id"])
    return p.select("conv_id", F.md5("caption").alias("caption"), F.md5("tables").alias("tables"), F.md5("formulas").alias("formulas"))


def touching_edges(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("relation"))
    n = table(spark, d, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("node"))
    return reports.touching(li, n).groupBy("node", "relation").agg(F.count("*").alias("n"), F.sum("src").alias("sources"))


def batch_items(spark, d):
    """Items whose file no paper has, and the hash of what changes results in their configuration."""
    o = table(spark, d, "orders")
    items = o.select(F.col("o_custkey").alias("batch_id"), F.col("o_orderkey").alias("ordinal"), (F.col("o_orderkey") % 200).cast("string").alias("sha256"))
    papers = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("sha256"))
    config = F.create_map(F.lit("prompt_version"), F.col("sha256"), F.lit("workers"), F.lit("9"), F.lit("model_version"), F.lit("m"))
    return reports.unregistered(items, papers).select("batch_id", "ordinal", reports.semantic_config(config).alias("config"))


def summary_counts(spark, d):
    return reports.summary_counts({"orders": table(spark, d, "orders").withColumnRenamed("o_custkey", "key"), "events": table(spark, d, "events").withColumnRenamed("user_id", "key")}, "key")


def payload_rows(spark, d):
    """Rows in fixed columns with ISO times; payloads that are no object or empty give way to a fallback."""
    e = table(spark, d, "events")
    p = F.when(F.col("event_id") % 4 == 0, "{}").when(F.col("event_id") % 4 == 1, "no").otherwise(F.col("props"))
    r = reports.fixed_rows(e.select("event_id", "ts", p.alias("payload")), ["event_id", "ts", "payload", "none"])
    return r.select("event_id", "ts", reports.with_fallback(F.col("payload"), F.lit('{"k":0}')).alias("payload"), "none")


QUERIES = {
    f.__name__: f
    for f in (
        loaded_blocks, loaded_layout, graph_noise, graph_evidence, gap_overlay, heatmap_grid, matched_assets, asset_rows, asset_shapes, delivery_reports, audit_reviews, figure_lines, previews, adopted_rows,
        object_keys, panel_contexts, touching_edges, batch_items, summary_counts, payload_rows,
    )
}

_KIND = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items()) + " END"
_BLOCKS = f"""b AS (SELECT user_id AS doc, (event_id // 100)::INT AS page, event_id AS ord, 'b' || event_id AS block_id, {_KIND} AS type, 't' || event_id % 10 AS text, CASE WHEN event_id % 5 = 0 THEN event_id % 7 END AS num FROM events)"""
_BUCKETS = ", ".join(f"('{b}', '{s}', {c}, {graph.PRIORITY.get(r, 0)})" for b, (r, s, _, c) in graph.BUCKETS.items())
_M = " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(METRICS))
_U = " ".join(f"WHEN {i} THEN '{u}'" for i, u in enumerate(UNITS))
_PAIRS = points.ORACLE["unit_dimension"].split("VALUES ", 1)[1].split("), u(pos", 1)[1]
_DIMS = "p(metric, unit) AS (VALUES " + ", ".join(f"('{m}', '{u}')" for m in METRICS for u in UNITS) + "), u(pos" + _PAIRS.rsplit("SELECT *,", 1)[0]
ORACLE = {
    "loaded_blocks": "SELECT conv_id::VARCHAR AS doc, (turn // 2)::INT AS page, (turn % 2)::INT AS reading_order, 'p' || (turn // 2) || '-b' || (turn % 2) || '-g' || turn AS block_id, CASE WHEN role = 'user' THEN 'heading' ELSE 'text' END AS type, md5(text) AS text_md5, turn::DOUBLE AS x0, turn::INT AS level FROM conversations",
    "loaded_layout": "SELECT p_brand AS doc, (p_partkey % 3)::INT AS page, count(*) AS n, sum(p_size)::DOUBLE AS width, min(p_type) AS first_type FROM part WHERE p_partkey % 4 <> 0 GROUP BY ALL",
    "graph_noise": f"WITH {_BLOCKS} SELECT doc, page, ord AS old_order, (row_number() OVER (PARTITION BY doc ORDER BY page, ord) - 1)::INT AS global_order, (row_number() OVER (PARTITION BY doc, page ORDER BY ord) - 1)::INT AS reading_order, '' AS reason FROM b WHERE type <> 'page_footer' UNION ALL SELECT doc, page, ord, NULL, NULL, 'noise:page_footer' FROM b WHERE type = 'page_footer'",
    "graph_evidence": f"""WITH {_BLOCKS}, v AS (SELECT *, last_value(num IGNORE NULLS) OVER (PARTITION BY doc, page ORDER BY ord) AS number, first_value(ord) OVER (PARTITION BY doc, page ORDER BY ord) AS first FROM b WHERE type = 'image'),
f AS (SELECT *, CASE WHEN number IS NOT NULL THEN 'fig-' || number ELSE 'fig-u' || first END AS fig FROM v), pos AS (SELECT *, row_number() OVER (PARTITION BY doc, page, fig ORDER BY ord) AS k FROM f),
p AS (SELECT doc, page, block_id AS visual, ord AS at_, fig || '-' || CASE WHEN k <= 26 THEN chr((96 + k)::INT) ELSE 'p' || k END AS panel_id FROM pos),
e AS (SELECT p.doc, p.panel_id, b.block_id, b.text, CASE WHEN b.block_id = visual THEN 'visual' WHEN type = 'image' THEN 'sibling' WHEN type = 'table' AND ord - at_ BETWEEN -3 AND 5 THEN 'table' WHEN type = 'heading' AND ord < at_ THEN 'heading' WHEN type = 'text' AND ord - at_ BETWEEN -3 AND 3 THEN 'local_text' WHEN type = 'text' THEN 'background' END AS bucket FROM p JOIN b USING (doc, page)),
d(bucket, scope, confidence, prio) AS (VALUES {_BUCKETS}), x AS (SELECT e.*, scope, confidence, prio + confidence AS pr FROM e JOIN d USING (bucket)),
kept AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY doc, panel_id, block_id, text, scope ORDER BY pr DESC, bucket) = 1), g AS (SELECT doc, bucket, count(*) AS n_kept, round(sum(confidence)::DOUBLE, 4) AS confidence FROM kept GROUP BY ALL)
SELECT x.doc, x.bucket, count(*) AS n, count(DISTINCT panel_id) AS n_panels, any_value(n_kept) AS n_kept, any_value(g.confidence) AS confidence FROM x JOIN g ON g.doc = x.doc AND g.bucket = x.bucket GROUP BY x.doc, x.bucket""",
    "gap_overlay": f"""WITH {_DIMS}, e AS (SELECT *, CASE user_id % {len(METRICS)} {_M} END AS metric, CASE event_id % {len(UNITS)} {_U} END AS unit FROM events WHERE event_id % 2 = 0),
c AS (SELECT e.*, x.metric_dimension FROM e JOIN x USING (metric, unit) WHERE x.metric_dimension <> '' AND x.metric_dimension = x.unit_dimension),
g AS (SELECT metric AS metric_name, metric_dimension, count(*) AS n, count(DISTINCT (user_id, event_type, unit)) AS s, round(sum(CASE WHEN event_id % 3 = 0 THEN 0.65 ELSE 0.6 END)::DOUBLE, 4) AS confidence FROM c GROUP BY ALL),
o AS (SELECT metric_name, metric_dimension AS dimension, s AS support FROM g WHERE s >= 2), all_o AS (SELECT * FROM o UNION ALL SELECT * FROM (VALUES ('pressure', 'old', 1), ('extra', 'old', 1)) v(metric_name, dimension, support) WHERE metric_name NOT IN (SELECT metric_name FROM o))
SELECT all_o.metric_name, dimension, support, n, s AS support_count, confidence FROM all_o LEFT JOIN g ON g.metric_name = all_o.metric_name""",
    "heatmap_grid": """WITH p AS (SELECT p_partkey, p_partkey % 3 AS k, least(199, p_partkey % 50) AS l, least(149, p_partkey % 50) AS t, least(199, p_partkey % 50 + p_size + 10) AS r, least(149, p_partkey % 50 + p_size + 10) AS b, p_size FROM part),
x AS (SELECT *, CASE WHEN k = 0 THEN CASE WHEN p_size = 1 THEN [1.0::DOUBLE] ELSE list_sort([1.0::DOUBLE, p_size::DOUBLE]) END ELSE [0.0::DOUBLE, 1, 2, 3, 4] END AS xs FROM p), c AS (SELECT *, unnest(xs) AS x_value, generate_subscripts(xs, 1) - 1 AS i FROM x), y AS (SELECT c.*, j, (j + 1)::DOUBLE AS y_value FROM c, (VALUES (0), (1)) v(j)),
q AS (SELECT *, floor(l + (r - l) * (i + 0.5::DOUBLE) / len(xs))::INT AS px, floor(b - (b - t) * (j + 0.5::DOUBLE) / 2)::INT AS py FROM y) SELECT p_partkey, x_value, y_value, px, py, round((79 - least(79, px))::DOUBLE, 6) AS value FROM q""",
    "matched_assets": """WITH a AS (SELECT o_custkey % 50 AS paper_id, o_orderkey AS asset_id, CASE WHEN o_orderkey % 3 = 0 THEN 'p' || o_orderkey % 20 END AS panel_id, o_orderkey % 30 || '.png' AS base FROM orders)
SELECT event_id, coalesce((SELECT min(asset_id) FROM a WHERE a.paper_id = user_id % 50 AND a.panel_id = 'p' || event_id % 25), (SELECT min(asset_id) FROM a WHERE a.paper_id = user_id % 50 AND a.base = event_id % 40 || '.png')) AS asset_id FROM events""",
    "asset_rows": """WITH n AS (SELECT event_id AS asset_id, event_id % 90 AS base FROM events UNION ALL SELECT event_id, event_id % 70 FROM events), r AS (SELECT c_custkey AS row_id, 'facts' AS source, 0 AS rank FROM customer WHERE c_custkey BETWEEN 40 AND 60 UNION ALL SELECT c_custkey, 'metrics', 1 FROM customer WHERE c_custkey <= 75)
SELECT asset_id, source, row_id FROM n JOIN r ON base = row_id QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY rank, row_id) = 1""",
    "asset_shapes": "SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'experimental_performance_plot' ELSE CASE p_partkey % 7 WHEN 0 THEN 'microscopy_structure' WHEN 1 THEN 'chemical_characterization' WHEN 2 THEN 'omics_or_pathway_analysis' WHEN 3 THEN 'simulation_spatial_field' WHEN 4 THEN 'macro_material_photo' ELSE 'conceptual_schematic' END END AS shape, CASE WHEN p_partkey % 7 = 5 THEN 'Fig. 3b' END AS label, CASE WHEN p_partkey % 7 = 6 THEN 'b' END AS letter FROM part",
    "delivery_reports": """SELECT '# Data delivery' || chr(10) || chr(10) || 'Snapshot: 2024-01-01' || chr(10) || chr(10) || '## Record counts' || chr(10) || chr(10) || '- customer: ' || (SELECT count(*) FROM customer) || chr(10) || '- nation: ' || (SELECT count(*) FROM nation) || chr(10) || '- region: ' || (SELECT count(*) FROM region) || chr(10) AS report
UNION ALL SELECT '{"version":"overlay_v1","contracts":[' || string_agg('{"metric_id":"' || n_name || '","dimension":"' || CASE WHEN n_nationkey < 3 THEN 'new' ELSE 'old' END || '","support":' || n_nationkey || '}', ',' ORDER BY n_name) || ']}' FROM nation WHERE n_nationkey <= 4""",
    "audit_reviews": """WITH k AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), l AS (SELECT user_id, string_agg('- ' || event_type || ': ' || n, chr(10) ORDER BY event_type) AS kinds FROM k GROUP BY user_id),
g AS (SELECT user_id, sum(event_id % 4)::BIGINT AS facts, lpad(min(event_id)::VARCHAR, 8, '0') AS first_panel, coalesce(string_agg('- ' || lpad(event_id::VARCHAR, 8, '0') || ': bad', chr(10) ORDER BY event_id) FILTER (WHERE event_type = 'error'), '') AS errors FROM events GROUP BY user_id)
SELECT user_id AS run_id, facts, first_panel, md5('## Decisions' || chr(10) || kinds || chr(10) || '## Errors' || chr(10) || errors) AS review_md5 FROM g JOIN l USING (user_id)""",
    "figure_lines": """SELECT user_id AS doc, event_id % 40 || '.png' AS filename, '{"doc":' || user_id || ',"image_path":"i/' || event_id % 40 || '.png","pos":' || min(event_id) || '}' AS record FROM events GROUP BY user_id, event_id % 40""",
    "previews": """SELECT conv_id, turn, 'text|n' AS headers, 2 AS n_rows, md5(text) AS cell_md5, 'say "hi", ' || role AS second FROM conversations""",
    "adopted_rows": "SELECT c_custkey::VARCHAR AS c_custkey, trunc(c_acctbal)::INT AS balance, 'active' AS status, NULL::BIGINT AS gone FROM customer",
    "object_keys": "SELECT * FROM (VALUES ('a//b/./c', 'a/b/c'), ('/x/y/', 'x/y'), ('./q', 'q'), ('w\\v', 'w/v')) v(key, clean)",
    "panel_contexts": "SELECT conv_id, md5(coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (WHERE turn % 3 = 0), '')) AS caption, md5(left(coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE turn % 3 = 1), ''), 2000)) AS tables, md5(left(coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE turn % 3 = 2), ''), 1000)) AS formulas FROM conversations GROUP BY conv_id",
    "touching_edges": "SELECT s_suppkey AS node, l_returnflag AS relation, count(*) AS n, sum(l_partkey)::BIGINT AS sources FROM supplier JOIN lineitem ON l_partkey = s_suppkey OR l_suppkey = s_suppkey WHERE s_suppkey % 2 = 0 GROUP BY ALL",
    "batch_items": """SELECT o_custkey AS batch_id, o_orderkey AS ordinal, sha256('{"model_version":"m","prompt_version":"' || o_orderkey % 200 || '"}') AS config FROM orders WHERE o_orderkey % 200 NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)""",
    "summary_counts": "WITH o AS (SELECT o_custkey AS key, count(*) AS n FROM orders GROUP BY 1), e AS (SELECT user_id AS key, count(*) AS n FROM events GROUP BY 1) SELECT coalesce(o.key, e.key) AS key, coalesce(o.n, 0) AS n_orders, coalesce(e.n, 0) AS n_events FROM o FULL JOIN e ON o.key = e.key",
    "payload_rows": """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, CASE WHEN event_id % 4 < 2 THEN '{"k":0}' ELSE props END AS payload, NULL::VARCHAR AS none FROM events""",
}
