"""Sources, captions, audits, sinks and jobs: Markdown, images, summaries, snapshots, repeats, over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import geom, text
from vellum.operators import assets, audit, captions, digitize, matching, scheduling
from vellum.session import scratch, table
from vellum.sources import files, sinks

#: Candidates of a panel's caption and sentences that name panels.
SENTENCES = ["Fig. 2a,b and 3(c) rise", "figure 10 b", "panel a, (b) and [ c ]", "2 (a, b)", "no panel", "Fig. 2"]
CANDIDATES = ["a shows growth before and after 5 % change", "a Fig. 2 copy", "b other panel text", "a) short", "a; Fig. 3b elsewhere", "a compared growth of ten percent 10% vs. none"]


def _lines(c):
    return F.concat_ws("\n", *c)


def markdown_references(spark, d):
    """Conversations as Markdown: a heading for each user turn, an image for each other one; images with section and lines around."""
    c = table(spark, d, "conversations")
    line = F.when(F.col("role") == "user", F.concat(F.lit("# S"), F.col("turn").cast("string"))).otherwise(F.concat(F.lit("![alt "), F.col("turn").cast("string"), F.lit("](./img/"), F.col("turn").cast("string"), F.lit('.png "t")')))
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))).alias("ls"))
    f = g.select(F.col("conv_id").cast("string").alias("path"), F.array_join(F.col("ls.l"), "\n").alias("value"))
    return files.markdown_images(f)


def markdown_tables(spark, d):
    """Rows of orders as a pipe table behind prose, read back; a ragged row goes."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.concat(F.lit("| "), F.col("o_orderkey").cast("string"), F.lit(" | "), "o_orderstatus", F.lit(" |")).alias("r")))).alias("rs"))
    body = F.concat(F.lit("intro\n| key | status |\n|---|---|\n"), F.array_join(F.col("rs.r"), "\n"), F.lit("\n| lone |\n\nafter | x | y |"))
    t = o.select("o_custkey", files.markdown_table(body, "| key").alias("t"))
    return t.select("o_custkey", F.size("t").alias("n_rows"), F.array_join(F.col("t")[0], ",").alias("head"), F.col("t")[1][0].alias("first"))


def image_headers(spark, d):
    """PNG headers built from parts' keys; other bytes have no size."""
    p = table(spark, d, "part")
    four = lambda c: F.lpad(F.hex(c), 8, "0")
    head = F.when(F.col("p_partkey") % 3 == 0, "FFD8FFE0").otherwise("89504E470D0A1A0A")
    raw = F.unhex(F.concat(head, F.lit("0000000D49484452"), four(F.col("p_partkey") + 1), four(F.col("p_size"))))
    return p.select("p_partkey", files.png_size(raw).alias("s")).select("p_partkey", "s.width", "s.height")


def event_summaries(spark, d):
    """Events as log lines of each user's run, some broken: counts, errors, the last event, progress, state and quality."""
    e = table(spark, d, "events")
    name = F.element_at(F.create_map(*[F.lit(x) for kv in {"click": "chart_facts_extracted", "error": "phase failed", "purchase": "metric_candidates_created", "signup": "benchmark_metrics_accepted", "view": "image_observation_completed"}.items() for x in kv]), F.col("event_type"))
    k = (F.col("event_id") % 5).alias("fact_count")
    line = F.to_json(F.struct(name.alias("event"), F.concat(F.lit("p"), (F.col("event_id") % 8).cast("string")).alias("panel_id"), k, (F.col("event_id") % 5).alias("candidate_count"), (F.col("event_id") % 5).alias("observation_count"), F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("message")))
    logged = e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("pos"), F.try_parse_json(F.when(F.col("event_id") % 13 == 0, "{broken").otherwise(line)).alias("event"))
    s = audit.with_progress(audit.running_summary(logged), F.lit(9), F.col("processed_panels"))
    state = audit.result_state(F.col("benchmark_metrics"), F.col("chart_facts"), F.col("image_observations"), F.col("digitization_results"), F.col("errors"))
    return s.withColumn("state", state).withColumn("quality", audit.quality_score(F.col("benchmark_metrics"), F.col("chart_facts"), F.col("image_observations"))).drop("digitization_results")


def panel_references(spark, d):
    s = spark.createDataFrame([(i, x) for i, x in enumerate(SENTENCES)], "i int, s string")
    pair = lambda r: F.concat(r["figure"], r["label"])
    return s.select("i", F.array_join(F.array_sort(F.transform(captions.figure_panels(F.col("s")), pair)), ",").alias("refs"), F.array_join(F.array_sort(captions.sentence_labels(F.col("s"), F.lit("2"))), ",").alias("labels"))


def caption_choice(spark, d):
    """Scores of candidates for panel a of figure 2, the best of them, and merged captions."""
    c = spark.createDataFrame([(i, x) for i, x in enumerate(CANDIDATES)], "i int, candidate string").withColumns({"label": F.lit("a"), "figure": F.lit("2")})
    best = captions.best_captions(c, ["figure", "label"]).select("i", F.lit(True).alias("best"))
    merged = captions.merge_captions(F.col("candidate"), F.lit("growth before and after"))
    return c.join(best, "i", "left").select("i", F.round(captions.caption_score(F.col("candidate"), F.col("label"), F.col("figure")), 4).alias("score"), F.coalesce("best", F.lit(False)).alias("best"), merged.alias("merged"))


def reference_blocks(spark, d):
    e = table(spark, d, "events")
    refs = e.filter("event_id % 4 = 0").select(F.col("user_id").alias("doc"), F.concat(F.lit("x/img/"), (F.col("event_id") % 30).cast("string"), F.lit(".png")).alias("image")).distinct()
    path = F.when(F.col("event_id") % 2 == 0, F.lit("img/")).otherwise(F.lit("other/"))
    blocks = e.filter("event_id % 3 = 0").select(F.col("user_id").alias("doc"), F.col("event_id").alias("block_id"), F.concat(path, (F.col("event_id") % 30).cast("string"), F.lit(".png")).alias("image_path"), F.col("event_id").alias("global_order"))
    return matching.refs_to_blocks(refs, blocks).select("doc", "image", "block_id")


def packet_images(spark, d):
    e = table(spark, d, "events")
    p = e.select(F.concat(F.lit("p"), (F.col("event_id") % 50).cast("string")).alias("panel_id"), F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("a/b/"), F.col("event_id").cast("string"))).alias("image_ref"), F.col("event_id").alias("pos"))
    return audit.panel_images(p)


def title_names(spark, d):
    """Titles of parts against brand words: whole words either way, the longest, then the best quality, then the least name."""
    p = table(spark, d, "part").filter("p_partkey < 40").select(F.concat(F.lit("The "), F.upper("p_name"), F.lit("_v"), F.col("p_partkey").cast("string"), F.lit(".PDF")).alias("title"))
    n = table(spark, d, "part").filter("p_partkey < 200").select(F.element_at(F.split("p_name", " "), -1).alias("name")).distinct().withColumn("quality", F.length("name"))
    return matching.contained_titles(p, n)


def stale_and_repeated(spark, d):
    """The 20 oldest stale jobs, and one paper for each (project, file) that is not deleted."""
    o = table(spark, d, "orders")
    jobs = o.select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "F", "processing").when(F.col("o_orderstatus") == "O", "pending").otherwise("succeeded").alias("status"), F.col("o_orderdate").cast("timestamp").alias("updated_at"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate").cast("timestamp")).alias("lease_expires_at"))
    s = scheduling.stale_jobs(jobs, "1998-01-01 00:00:00").select(F.lit("stale").alias("what"), F.col("job_id").alias("id"), F.lit(1).cast("bigint").alias("n"))
    up = o.select((F.col("o_custkey") % 7).alias("project_id"), (F.col("o_orderkey") % 90).alias("sha256"), F.when(F.col("o_orderkey") % 6 == 0, "deleted").otherwise("uploaded").alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("paper_id"))
    r = scheduling.discard_repeats(up).select(F.lit("paper").alias("what"), F.col("paper_id").alias("id"), "n")
    return s.unionByName(r)


def snapshot_manifest(spark, d):
    """Two tables written as a snapshot, and what the manifest says of them."""
    n, r = table(spark, d, "nation").select("n_nationkey", "n_name"), table(spark, d, "region").select("r_regionkey", "r_name")
    m = sinks.write_snapshot({"regions": (r, ["r_regionkey"]), "nations": (n, ["n_nationkey"])}, scratch(spark, "snapshot"))
    return m


def written_panels(spark, d):
    """Facts written as a folder of CSV for each panel and as sorted JSON lines, and read again."""
    e = table(spark, d, "events").select("event_id", F.when(F.col("user_id") % 4 != 0, F.concat(F.lit("fig 1/"), F.col("user_id").cast("string"))).alias("panel_id"))
    path = scratch(spark, "panels")
    sinks.write_panel_csv(e, f"{path}/csv", {"source": "t"})
    sinks.write_json_lines(e, f"{path}/json", ["event_id"])
    c = sinks.read_panel_csv(spark, f"{path}/csv", ["event_id", "panel_id", "source"]).groupBy("panel_file").agg(F.count("*").alias("n"), F.max("source").alias("source"))
    j = spark.read.text(f"{path}/json").agg(F.lit("json").alias("panel_file"), F.count("*").alias("n"), F.min("value").alias("source"))
    return j.unionByName(c)


def appended_rows(spark, d):
    """Rows whose key is new; equal ones that are there already go."""
    c = table(spark, d, "customer").select("c_custkey", F.md5("c_name").alias("digest"))
    return sinks.new_rows(c.filter("c_custkey % 3 = 0"), c, ["c_custkey"], "digest")


def box_forms(spark, d):
    """Boxes of four numbers or null, safe names, stripped tags, readiness and large boxes."""
    p = table(spark, d, "part")
    box = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit(1.0), F.lit(2.0))).when(F.col("p_partkey") % 3 == 1, F.array(F.lit(0.0), F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0))).otherwise(F.array(F.lit(0.0), F.lit(0.0), F.col("p_size").cast("double"), F.lit(2.0)))
    name = text.safe_name(F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.concat("p_name", F.lit("/#"), "p_brand")))
    ready = assets.asset_readiness(F.when(F.col("p_size") % 4 == 0, "x"), F.when(F.col("p_size") % 4 == 1, "cap"), F.lit(None).cast("string"))
    return p.select("p_partkey", geom.area(geom.valid_box(box)).alias("area"), name.alias("name"), text.strip_tags(F.concat(F.lit("<b>"), "p_name", F.lit("</b>  x"))).alias("plain"), assets.image_readability(F.col("p_size") * 10, F.lit(300)).alias("read"), ready.alias("ready"))


def rebuilt_points(spark, d):
    """Points of users' stored results: listed, nested under a series, or in the raw output; those without a value go."""
    e = table(spark, d, "events")
    point = F.struct(F.when(F.col("event_id") % 3 != 0, F.col("event_id")).alias("x"), F.when(F.col("event_type") != "error", F.col("event_id") % 4).alias("y_value"), F.col("event_type").alias("category"))
    g = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", point.alias("p")))).alias("ps"))
    ps, k = F.col("ps.p"), F.col("user_id") % 3
    raw = F.when(k == 0, F.to_json(F.struct(ps.alias("points")))).when(k == 1, F.to_json(F.struct(F.struct(F.array(F.struct(F.lit("s 1").alias("name"), ps.alias("points"))).alias("data_points")).alias("raw_output")))).otherwise(F.to_json(F.struct(F.struct(F.array(F.struct(F.lit("s2").alias("series_name"), ps.alias("data_points"))).alias("series")).alias("raw_output"))))
    return audit.rebuilt_points(g.select(F.col("user_id").cast("string").alias("panel_id"), raw.alias("payload"))).drop("z_value", "x_unit")


def chart_payloads(spark, d):
    """Answers of events: objects, objects in a wrapper or between prose, and texts that are none."""
    e = table(spark, d, "events")
    k, own = F.col("event_id") % 4, F.concat(F.lit('{"chart_type":"'), "event_type", F.lit('"}'))
    a = F.when(k == 0, own).when(k == 1, F.concat(F.lit('{"chart_digitization_result":'), own, F.lit("}"))).when(k == 2, F.concat(F.lit("So: "), own, F.lit(" ok"))).otherwise("none")
    p = digitize.chart_payload(a)
    return e.select("event_id", F.get_json_object(p, "$.chart_type").alias("chart_type"), F.get_json_object(p, "$.digitization_status").alias("status"), F.get_json_object(p, "$.raw_output_text").alias("text"))


QUERIES = {
    f.__name__: f
    for f in (
        rebuilt_points, chart_payloads, markdown_references, markdown_tables, image_headers, event_summaries, panel_references, caption_choice, reference_blocks, packet_images, title_names, stale_and_repeated, snapshot_manifest, written_panels,
        appended_rows, box_forms,
    )
}
_SUM = "sum(('0x' || substr(md5({0}), 1, 8))::BIGINT)::BIGINT"
ORACLE = {
    "markdown_references": """WITH l AS (SELECT conv_id, turn AS no, role = 'user' AS head, CASE WHEN role = 'user' THEN '# S' || turn ELSE '![alt ' || turn || '](./img/' || turn || '.png "t")' END AS line FROM conversations),
w AS (SELECT *, last_value(CASE WHEN head THEN 'S' || no END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY no) AS section, string_agg(line, chr(10) ORDER BY no) OVER (PARTITION BY conv_id ORDER BY no ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM l)
SELECT conv_id::VARCHAR AS path, no::INT AS line_no, section, near, 'alt ' || no AS alt, 'img/' || no || '.png' AS image FROM w WHERE NOT head""",
    "rebuilt_points": """WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, CASE user_id % 3 WHEN 0 THEN '' WHEN 1 THEN 's 1' ELSE 's2' END AS s FROM events)
SELECT user_id::VARCHAR AS panel_id, user_id || ':' || CASE s WHEN '' THEN 'series' WHEN 's 1' THEN 's_1' ELSE s END || ':' || i AS fact_id, i::VARCHAR AS point_index, s AS series_name, CASE WHEN event_id % 3 <> 0 THEN event_id::VARCHAR ELSE event_type END AS x_value, (event_id % 4)::VARCHAR AS y_value, event_type AS category_label FROM n WHERE event_type <> 'error'""",
    "chart_payloads": "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN event_type END AS chart_type, CASE WHEN event_id % 4 = 3 THEN 'failed' END AS status, CASE WHEN event_id % 4 = 3 THEN 'none' END AS text FROM events",
    "markdown_tables": "SELECT o_custkey, (count(*) + 1)::INT AS n_rows, 'key,status' AS head, min(o_orderkey)::VARCHAR AS first FROM orders GROUP BY o_custkey",
    "image_headers": "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN (p_partkey + 1)::INT END AS width, CASE WHEN p_partkey % 3 <> 0 THEN p_size END AS height FROM part",
    "event_summaries": """WITH e AS (SELECT user_id AS run_id, event_id, CASE WHEN event_id % 13 <> 0 THEN event_type END AS t, event_id % 5 AS k, CASE event_type WHEN 'click' THEN 'chart_facts_extracted' WHEN 'error' THEN 'phase failed' WHEN 'purchase' THEN 'metric_candidates_created' WHEN 'signup' THEN 'benchmark_metrics_accepted' ELSE 'image_observation_completed' END AS name FROM events),
g AS (SELECT run_id, count(*) AS n_events, count(DISTINCT CASE WHEN t IS NOT NULL THEN event_id % 8 END) AS processed_panels, coalesce(max(k) FILTER (WHERE t = 'click'), 0) AS chart_facts, coalesce(sum(k) FILTER (WHERE t = 'purchase'), 0)::BIGINT AS metric_candidates, count(*) FILTER (WHERE t = 'signup') AS benchmark_metrics,
 coalesce(sum(k) FILTER (WHERE t = 'view'), 0)::BIGINT AS image_observations, count(*) FILTER (WHERE t = 'error') AS errors, 'm' || min(event_id) FILTER (WHERE t = 'error') AS first_error, arg_max(name, event_id) FILTER (WHERE t IS NOT NULL) AS last_event FROM e GROUP BY run_id)
SELECT *, least(100, processed_panels * 100 // 9)::INT AS progress_percent, CASE WHEN errors > 0 AND benchmark_metrics = 0 AND chart_facts = 0 AND image_observations = 0 THEN 'pipeline_errors' WHEN benchmark_metrics > 0 THEN 'benchmark_metrics_ready' WHEN chart_facts > 0 THEN 'chart_facts_ready' ELSE 'semantic_only' END AS state, 3 * benchmark_metrics + 2 * chart_facts + image_observations AS quality FROM g""",
    "panel_references": "SELECT * FROM (VALUES (0, '2a,2b,3c', 'a,b,c'), (1, '10b', ''), (2, '', 'a,b,c'), (3, '2a,2b', 'a,b'), (4, '', ''), (5, '', '')) v(i, refs, labels)",
    "caption_choice": """SELECT * FROM (VALUES (0, round((2.8 + 1 + 1 + 0.5 + 9 / 25.0)::DOUBLE, 4), false, 'a shows growth before and after 5 % change'), (1, 0.0::DOUBLE, false, 'a Fig. 2 copy growth before and after'), (2, 0.0, false, 'b other panel text growth before and after'),
(3, round((2 / 25.0)::DOUBLE, 4), false, 'a) short growth before and after'), (4, 0.0, false, 'a; Fig. 3b elsewhere growth before and after'), (5, round((2.8 + 1 + 1 + 0.5 + 9 / 25.0)::DOUBLE, 4), true, 'a compared growth of ten percent 10% vs. none growth before and after')) v(i, score, best, merged)""",
    "reference_blocks": """WITH r AS (SELECT DISTINCT user_id AS doc, event_id % 30 AS k FROM events WHERE event_id % 4 = 0), b AS (SELECT user_id AS doc, event_id % 30 AS k, event_id FROM events WHERE event_id % 3 = 0 AND event_id % 2 = 0)
SELECT doc, 'x/img/' || k || '.png' AS image, min(event_id) AS block_id FROM r JOIN b USING (doc, k) GROUP BY ALL""",
    "packet_images": "SELECT 'p' || event_id % 50 AS panel_id, max(event_id)::VARCHAR AS image FROM events WHERE event_id % 5 <> 0 GROUP BY 1",
    "title_names": """WITH t AS (SELECT 'The ' || upper(p_name) || '_v' || p_partkey || '.PDF' AS title, p_name FROM part WHERE p_partkey < 40), n AS (SELECT DISTINCT list_last(string_split(p_name, ' ')) AS name FROM part WHERE p_partkey < 200)
SELECT title, name, length(name)::INT AS quality, length(name)::INT AS score FROM t JOIN n ON list_contains(string_split(p_name, ' '), name) QUALIFY row_number() OVER (PARTITION BY title ORDER BY length(name) DESC, name) = 1""",
    "stale_and_repeated": """WITH j AS (SELECT * FROM orders WHERE (o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1997-12-31 23:45:00') OR (o_orderstatus = 'F' AND (o_orderkey % 2 <> 0 OR o_orderdate < TIMESTAMP '1998-01-01')) ORDER BY o_orderdate, o_orderkey LIMIT 20),
u AS (SELECT o_orderkey, o_orderdate, o_custkey % 7 AS p, o_orderkey % 90 AS s, count(*) OVER (PARTITION BY o_custkey % 7, o_orderkey % 90) AS n FROM orders WHERE o_orderkey % 6 <> 0)
SELECT 'stale' AS what, o_orderkey AS id, 1::BIGINT AS n FROM j UNION ALL SELECT 'paper', o_orderkey, n FROM (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY p, s ORDER BY o_orderdate, o_orderkey) = 1)""",
    "snapshot_manifest": f"""SELECT 'nations' AS name, count(*) AS n_rows, {_SUM.format("'{{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}}'")} AS checksum FROM nation UNION ALL SELECT 'regions', count(*), {_SUM.format("'{{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}}'")} FROM region""".replace("{{", "{").replace("}}", "}"),
    "written_panels": """SELECT CASE WHEN user_id % 4 <> 0 THEN 'fig_1_' || user_id ELSE 'unknown_panel' END AS panel_file, count(*) AS n, 't' AS source FROM events GROUP BY 1 UNION ALL SELECT 'json', count(*), min('{"event_id":' || event_id || ',"panel_id":' || CASE WHEN user_id % 4 <> 0 THEN '"fig 1/' || user_id || '"' ELSE 'null' END || '}') FROM events""",
    "appended_rows": "SELECT c_custkey, md5(c_name) AS digest FROM customer WHERE c_custkey % 3 <> 0",
    "box_forms": """SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN p_size * 2.0::DOUBLE ELSE 0 END AS area, CASE WHEN p_partkey % 5 = 0 THEN 'unknown' ELSE regexp_replace(p_name || '/#' || p_brand, '[^A-Za-z0-9._-]+', '_', 'g') END AS name, p_name || ' x' AS plain,
 CASE WHEN p_size * 10 < 50 THEN 'too_small' WHEN p_size * 10 < 180 THEN 'low_resolution' ELSE 'usable' END AS read, CASE p_size % 4 WHEN 0 THEN 'skip' WHEN 1 THEN 'ready' ELSE 'low_confidence' END AS ready FROM part""",
}
