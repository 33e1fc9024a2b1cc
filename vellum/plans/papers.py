"""Figures and panels of pages, and papers, jobs, runs and files over their life, on customers, orders, events and pages."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.operators import audit, lifecycle, panels
from vellum.session import table

_TEXT = "cast({} as string)"


def _visuals(spark, d):
    """Customers as visuals: five documents of six pages; the page decides what captions and orders its visuals have."""
    c = table(spark, d, "customer")
    v = c.select((F.col("c_nationkey") % 5).cast("string").alias("doc"), (F.col("c_custkey") % 6).cast("int").alias("page"), F.col("c_custkey").cast("string").alias("block_id"), F.col("c_custkey").alias("key"))
    r = F.row_number().over(W.partitionBy("doc", "page").orderBy("key")) - 1
    caption = F.when(F.col("page") == 0, "Fig. 7 (a) left side; (b) right side").when((F.col("page") == 1) & (F.col("r") % 2 == 0), F.concat(F.lit("Figure "), F.expr("r div 2").cast("string"))).when(F.col("page") == 2, "no number here").otherwise("")
    v = v.withColumn("r", r).withColumn("caption", caption).withColumn("reading_order", (F.col("r") * F.when(F.col("page") == 3, 5).otherwise(1)).cast("int"))
    return v.withColumn("bbox", F.lit(None).cast("array<double>")).withColumn("matched", F.lit(False))


def figure_groups(spark, d):
    """Figures, labels and unique ids of all visuals; a figure may have more than 26 of them."""
    return panels.group_visuals(_visuals(spark, d)).select("doc", "page", "block_id", "provenance", "label", "figure_size", "figure_id", "panel_id")


def figure_rollup(spark, d):
    return panels.rollup(panels.group_visuals(_visuals(spark, d)))


def figure_members(spark, d):
    """Lines of an order as the panels of a figure."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"))
    m = panels.figure_members(li.select(F.lit("d").alias("doc"), F.col("l_orderkey").alias("figure_id"), F.col("part").alias("panel_id"), F.col("l_linenumber").alias("asset_index")))
    return m.select("figure_id", "asset_index", "figure_group_size", "panel_index", F.array_join(F.transform("siblings", lambda x: x.cast("string")), ",").alias("siblings"), "is_multi")


def _facts(spark, d):
    e = table(spark, d, "events")
    status = F.element_at(F.array(*map(F.lit, ["digitized", "failed", "", "no_chart_detected", "Partially_Digitized", "axis_unreadable"])), (F.col("event_id") % 6).cast("int") + 1)
    index = F.when(F.col("event_id") % 7 == 0, "axis").when(F.col("event_id") % 11 == 0, "").otherwise(F.col("event_id").cast("string"))
    value = F.when(F.col("event_id") % 5 != 0, F.col("value"))
    return e.select("event_id", F.col("user_id").alias("figure_id"), F.col("event_type").alias("panel_id"), index.alias("point_index"), status.alias("digitization_status"), value.alias("x_value"), F.lit(None).cast("string").alias("y_value"), F.lit("").alias("z_value"))


def fact_row_states(spark, d):
    s = _facts(spark, d).select("*", lifecycle.row_state().alias("s"))
    first = F.row_number().over(W.partitionBy("figure_id").orderBy(*lifecycle.fact_order(), "event_id"))
    return s.select("event_id", "s.*", first.alias("place"))


def displayable_facts(spark, d):
    """Facts that can be shown, and those of panels that have none built again."""
    f = _facts(spark, d).withColumn("panel_id", F.concat_ws("-", F.col("figure_id").cast("string"), "panel_id"))
    again = f.groupBy("figure_id", "panel_id").agg(F.max("event_id").alias("event_id")).select("event_id", "figure_id", "panel_id", F.lit("again").alias("point_index"), F.lit("digitized").alias("digitization_status"), F.lit(1.0).alias("x_value"), F.lit(None).cast("string").alias("y_value"), F.lit("").alias("z_value"))
    out = audit.rebuild_facts(f.filter("event_id % 3 = 1"), again.select(f.columns))
    return out.groupBy("panel_id").agg(F.count("*").alias("n"), F.count_if(F.col("point_index") == "again").alias("n_again"))


def test_like_runs(spark, d):
    e = table(spark, d, "events")
    series = F.when(F.col("user_id") % 3 == 0, "A Test Series 1").otherwise(F.col("event_type"))
    p = e.select("user_id", series.alias("series_name"), F.when(F.col("user_id") % 3 == 1, "Day").alias("x_unit"), F.lit("g").alias("y_unit"), F.lit("time").alias("x_axis_label"), F.when(F.col("event_id") % 50 != 0, "Water uptake").otherwise("").alias("y_axis_label"))
    return lifecycle.test_like(p, "user_id")


def _papers(spark, d):
    o = table(spark, d, "orders")
    status = F.element_at(F.array(*map(F.lit, lifecycle.PAPER_STATUSES)), (F.col("o_orderkey") % 5).cast("int") + 1)
    return o.select(F.col("o_orderkey").alias("paper_id"), F.col("o_custkey").alias("project_id"), status.alias("status"), F.col("o_orderpriority").alias("body"))


def scoped_papers(spark, d):
    p = _papers(spark, d)
    some = lifecycle.scoped(p, {"paper_statuses": ["failed", "completed"]})
    none = lifecycle.scoped(p, {"paper_ids": []})
    one = lifecycle.scoped(lifecycle.live(p), {"project_id": 7, "paper_ids": list(range(1000)) + [5, 5]})
    name = lambda df, n: df.groupBy("status").agg(F.count("*").alias("n")).withColumn("scope", F.lit(n))
    return name(some, "statuses").unionByName(name(none, "none")).unionByName(name(one, "project"))


def upload_checks(spark, d):
    t = table(spark, d, "documents")
    head = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, "%PDF-1.7 ").otherwise("PK")
    body = F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.concat(head, F.coalesce("text", F.lit("")))).cast("binary")
    f = lifecycle.checked_uploads(t.select("doc_id", F.octet_length(body).alias("size_bytes"), body.alias("content")), 5000)
    return f.select("doc_id", "problem")


def job_attempts(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("paper_id"), F.col("o_orderkey").alias("job_id"))
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("paper_id"))
    nxt = lifecycle.next_attempt(asked, o, ["paper_id"]).select("paper_id", F.lit(None).cast("bigint").alias("job_id"), "attempt")
    return lifecycle.attempts(o, ["paper_id"]).select("paper_id", "job_id", F.col("attempt").cast("bigint").alias("attempt")).unionByName(nxt)


def runs_and_failures(spark, d):
    """Tasks without a run become one; open runs that an error event names fail with its first message."""
    e = table(spark, d, "events")
    tasks = e.select(F.col("user_id").alias("task_id"), F.col("event_id").alias("attempt"), F.col("event_type").alias("kind"))
    runs = e.filter("user_id % 2 = 0").select(F.col("user_id").alias("task_id")).distinct()
    new = lifecycle.new_runs(tasks, runs).select(F.col("task_id").alias("id"), F.lit("new").alias("status"), F.col("kind").alias("error"))
    own = runs.select(F.col("task_id").alias("run_id"), F.when(F.col("task_id") % 4 == 0, "succeeded").otherwise("running").alias("status"))
    bad = e.filter("event_type = 'error'").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("pos"), F.concat(F.lit("at "), F.col("event_id").cast("string")).alias("message"))
    return new.unionByName(lifecycle.finalised(own, bad).select(F.col("run_id").alias("id"), "status", "error"))


def archived_assets(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("figure_id"), (F.col("l_returnflag") != "R").alias("is_active"))
    again = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("paper_id"))
    a = lifecycle.archive(li, again)
    return a.groupBy("paper_id").agg(F.count_if("is_active").alias("n_active"), F.count("figure_id").alias("n_figures"))


def enqueue_report(spark, d):
    """Lines ask for the order of their part: asked twice, deleted, missing and busy ones."""
    asked = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), (F.col("l_partkey") * 3).alias("paper_id"))
    busy = table(spark, d, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("paper_id"))
    return lifecycle.enqueue(asked, _papers(spark, d), busy).groupBy("status").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.sum("paper_id").alias("ids"))


def paper_reads(spark, d):
    assets = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("paper_id"), (F.col("l_returnflag") != "A").alias("is_active"))
    e = table(spark, d, "events").select(F.col("user_id").alias("paper_id"), F.col("event_id").alias("result_id"), F.col("event_type").alias("status"))
    return lifecycle.paper_reads(_papers(spark, d), assets, e, 4)


def job_recovery(spark, d):
    """Orders as jobs: lost ones go back or are cancelled; the newest of a type of each customer."""
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "processing").otherwise("pending")
    jobs = o.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("paper_id"), F.col("o_orderpriority").alias("job_type"), status.alias("status"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")).alias("lease_expires_at"), (F.col("o_orderkey") % 4 == 0).alias("cancel_requested"), (F.col("o_orderkey") % 9).alias("generation"))
    r = lifecycle.recovered(jobs, F.lit("1999-01-01").cast("timestamp"))
    newest = lifecycle.latest_job(r, "1-URGENT").select("job_id", F.lit(True).alias("newest"))
    return r.join(newest, "job_id", "left").select("job_id", "status", "generation", F.coalesce("newest", F.lit(False)).alias("newest"))


def audit_choice(spark, d):
    e = table(spark, d, "events")
    source = F.element_at(F.array(*map(F.lit, ["historical", "current", "object", "running", "other"])), (F.expr("event_id div 16") % 5).cast("int") + 1)
    path = F.concat(F.when(F.col("event_id") % 3 == 0, "data/fake_").otherwise("data/run"), F.lpad(F.col("event_id").cast("string"), 8, "0"))
    return lifecycle.best_audit(e.select(F.col("user_id").alias("paper_id"), source.alias("source"), path.alias("path")))


def artifact_choice(spark, d):
    """Files of users' folders: one artifact each, nested lists first; images found in the folder or above it."""
    e = table(spark, d, "events")
    name = F.element_at(F.array(*map(F.lit, ["x_content_list.json", "result.zip", "content_list_v2_a.json", "notes.txt"])), (F.col("value").cast("int") % 4) + 1)
    f = e.filter("event_id % 40 < 3 or user_id % 3 = 0").select(F.concat_ws("/", F.concat(F.lit("s"), F.col("user_id").cast("string")), F.col("event_type"), name).alias("path"))
    return lifecycle.artifacts(f)


def image_lookup(spark, d):
    e = table(spark, d, "events")
    folder = F.concat_ws("/", F.concat(F.lit("s"), F.col("user_id").cast("string")), "event_type", F.lit("auto"))
    at = F.when(F.col("event_id") % 3 == 0, folder).when(F.col("event_id") % 3 == 1, F.substring_index(folder, "/", 1)).otherwise(F.lit("elsewhere"))
    file = F.concat((F.col("event_id") % 10).cast("string"), F.lit(".png"))
    files = e.filter("event_id % 2 = 0").select(F.concat_ws("/", at, file).alias("path")).distinct()
    wanted = e.select(F.col("user_id").alias("doc"), file.alias("name"), folder.alias("folder")).distinct()
    return lifecycle.named_files(wanted, files)


def asset_ingest(spark, d):
    c = table(spark, d, "conversations")
    path = F.concat_ws("/", "role", F.concat((F.col("turn") % 4).cast("string"), F.lit(".jpg")))
    listed = c.filter("turn % 2 = 0").select(F.col("conv_id").alias("doc"), F.col("turn").alias("pos"), path.alias("path"))
    return lifecycle.ingest(listed, c.select(F.col("conv_id").alias("doc"), F.col("turn").alias("pos"), path.alias("path"))).select("doc", "name", "source", "pos", "path", "asset_index")


def file_checks(spark, d):
    """Media types of names, problems of PDFs, and metadata where the element's entries win."""
    p = table(spark, d, "part")
    suffix = F.element_at(F.array(*map(F.lit, [*sorted(lifecycle.MEDIA), "exe"])), (F.col("p_partkey") % (len(lifecycle.MEDIA) + 1)).cast("int") + 1)
    merged = lifecycle.merged_metadata(F.create_map(F.lit("a"), F.col("p_brand")), F.create_map(F.lit("a"), F.lit("default"), F.lit("b"), F.col("p_name")))
    return p.select("p_partkey", lifecycle.media_type(F.concat(F.lit("f."), F.upper(suffix))).alias("media"), lifecycle.pdf_problem(F.col("p_size") % 4, F.col("p_partkey") % 3, F.col("p_partkey") % 2).alias("problem"), merged["a"].alias("a"), merged["b"].alias("b"))


def result_versions(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("model_version"), F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("p"), (F.col("event_id") % 3).cast("string"))).otherwise("").alias("prompt_version"))
    v = lifecycle.versions(e, "user_id")
    return v.select("user_id", F.array_join("models", ",").alias("models"), F.array_join("prompts", ",").alias("prompts"))


def audit_event_counts(spark, d):
    e = table(spark, d, "events")
    repairs = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("enum"), F.col("event_type"))).otherwise(F.array().cast("array<string>"))
    a = lifecycle.audit_counts(e.select("event_type", repairs.alias("repairs"), F.when(F.col("event_type") == "view", F.concat(F.lit("phase"), (F.col("user_id") % 2).cast("string"))).alias("phase")))
    c = lifecycle.decision_counts(e.select(F.col("event_type").alias("panel_decision")))
    return a.unionByName(c.select(F.lit("decision").alias("what"), F.col("panel_decision").alias("name"), "n"))


def layout_lines(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.col("l_returnflag").alias("t")))).alias("l"), F.sum("l_quantity").alias("q"), F.max("l_linenumber").alias("m"))
    size = F.when(F.col("l_orderkey") % 5 != 0, F.array(F.lit(600), F.lit(800)))
    box = F.when(F.col("l_orderkey") % 3 != 0, F.array(F.col("q"), F.lit(10.0), F.col("q") + 300.0, F.col("m").cast("double")))
    return li.select("l_orderkey", lifecycle.layout_context(size, box, F.transform("l", lambda x: x["t"])).alias("line"))


def level_headings(spark, d):
    """Of each level the last order before an order of its customer: level from the priority, title from the status."""
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("pos"), F.substring("o_orderpriority", 1, 1).cast("int").alias("level"), F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderstatus")).alias("title"))
    h = lifecycle.nearest_headings(o, ["o_custkey"])
    return h.select("pos", F.array_join(F.transform("headings", lambda x: F.concat_ws(":", x["level"].cast("string"), x["title"])), ",").alias("headings"))


def line_contexts(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    c = lifecycle.line_context(lines, ["doc_id"], F.col("line").contains("and the"), 4, 15)
    return c.select("doc_id", "line_no", F.md5("context").alias("context_md5"))


QUERIES = {
    f.__name__: f
    for f in (
        figure_groups, figure_rollup, figure_members, fact_row_states, displayable_facts, test_like_runs, scoped_papers, upload_checks, job_attempts, runs_and_failures, archived_assets, enqueue_report,
        paper_reads, job_recovery, audit_choice, artifact_choice, image_lookup, asset_ingest, file_checks, result_versions, audit_event_counts, layout_lines, level_headings, line_contexts,
    )
}

_VIS = """v AS (SELECT (c_nationkey % 5)::VARCHAR AS doc, (c_custkey % 6)::INT AS page, c_custkey::VARCHAR AS block_id, row_number() OVER (PARTITION BY c_nationkey % 5, c_custkey % 6 ORDER BY c_custkey) - 1 AS r FROM customer),
c AS (SELECT *, count(*) OVER (PARTITION BY doc, page) AS n, count(*) OVER (PARTITION BY doc) AS all_n FROM v),
g AS (SELECT *, CASE WHEN n = 1 THEN 'layout_or_spatial_visual_grouping' WHEN page = 0 THEN 'same_caption_composite' WHEN page = 1 AND n >= 3 THEN 'separate_caption' WHEN page = 2 THEN 'fallback_single_visual' WHEN (n - 1) * CASE WHEN page = 3 THEN 5 ELSE 1 END > 3 THEN 'spatially_separated' ELSE 'uncertain_split_conservative' END AS provenance,
 CASE WHEN page = 0 THEN 0 WHEN page = 1 AND n >= 3 THEN r // 2 ELSE r END AS grp, CASE page WHEN 0 THEN '7' WHEN 1 THEN CASE WHEN n >= 3 OR r % 2 = 0 THEN (r // 2)::VARCHAR END END AS number FROM c),
p AS (SELECT *, row_number() OVER (PARTITION BY doc, page, grp ORDER BY r) AS place, count(*) OVER (PARTITION BY doc, page, grp) AS figure_size, 'figure-' || coalesce(number, all_n::VARCHAR) AS base FROM g),
l AS (SELECT *, CASE WHEN place <= 26 THEN chr((96 + place)::INT) ELSE 'p' || place END AS label FROM p),
f AS (SELECT doc, base, page, grp, row_number() OVER (PARTITION BY doc, base ORDER BY page, grp) AS nth FROM (SELECT DISTINCT doc, base, page, grp FROM p)),
x AS (SELECT l.*, base || CASE WHEN nth > 1 THEN '-' || nth ELSE '' END AS figure_id FROM l JOIN f USING (doc, base, page, grp))"""
_FACTS = """f AS (SELECT event_id, user_id AS figure_id, event_type AS panel_id, CASE WHEN event_id % 7 = 0 THEN 'axis' WHEN event_id % 11 = 0 THEN '' ELSE event_id::VARCHAR END AS point_index,
 CASE event_id % 6 WHEN 0 THEN 'digitized' WHEN 1 THEN 'failed' WHEN 2 THEN '' WHEN 3 THEN 'no_chart_detected' WHEN 4 THEN 'partially_digitized' ELSE 'axis_unreadable' END AS status, event_id % 5 <> 0 AS valued FROM events)"""
_PAPERS = """papers AS (SELECT o_orderkey AS paper_id, o_custkey AS project_id, CASE o_orderkey % 5 WHEN 0 THEN 'uploaded' WHEN 1 THEN 'processing' WHEN 2 THEN 'completed' WHEN 3 THEN 'failed' ELSE 'deleted' END AS status, o_orderpriority AS body FROM orders)"""
_MEDIA = " ".join(f"WHEN {i} THEN '{lifecycle.MEDIA[s]}'" for i, s in enumerate(sorted(lifecycle.MEDIA)))
ORACLE = {
    "figure_groups": f"WITH {_VIS} SELECT doc, page, block_id, provenance, label, figure_size, figure_id, figure_id || '-' || label AS panel_id FROM x",
    "figure_rollup": f"WITH {_VIS} SELECT doc, figure_id, count(*) AS n_panels, min(page) AS page, string_agg(label, ',' ORDER BY page, place) AS labels FROM x GROUP BY ALL",
    "figure_members": "WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), w AS (SELECT l_orderkey AS figure_id, l_linenumber AS asset_index, count(*) OVER (PARTITION BY l_orderkey)::INT AS figure_group_size, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber)::INT AS panel_index, string_agg(l_linenumber, ',' ORDER BY l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS siblings FROM l) SELECT *, figure_group_size > 1 AS is_multi FROM w",
    "fact_row_states": f"WITH {_FACTS} SELECT event_id, point_index NOT IN ('', 'axis') AND status NOT IN ('no_chart_detected', 'failed') AND valued AS usable, status IN ('digitized', 'partially_digitized') AS succeeded, status IN ('failed', 'axis_unreadable') AS failed, row_number() OVER (PARTITION BY figure_id ORDER BY panel_id, coalesce(try_cast(point_index AS INT), 0), event_id)::INT AS place FROM f",
    "displayable_facts": f"""WITH {_FACTS}, n AS (SELECT *, figure_id || '-' || panel_id AS p, (point_index NOT IN ('', 'axis') AND valued) OR status IN ('failed', 'no_chart_detected', 'axis_unreadable') AS shown FROM f),
s AS (SELECT p AS panel_id, count(*) AS n FROM n WHERE event_id % 3 = 1 AND shown GROUP BY p), a AS (SELECT DISTINCT p AS panel_id FROM n)
SELECT panel_id, coalesce(s.n, 1) AS n, CASE WHEN s.n IS NULL THEN 1 ELSE 0 END::BIGINT AS n_again FROM a LEFT JOIN s USING (panel_id)""",
    "test_like_runs": "SELECT user_id, bool_and(CASE user_id % 3 WHEN 0 THEN true WHEN 1 THEN event_id % 50 <> 0 ELSE false END) AS test_like FROM events GROUP BY user_id",
    "scoped_papers": f"WITH {_PAPERS} SELECT status, count(*) AS n, 'statuses' AS scope FROM papers WHERE status IN ('failed', 'completed') GROUP BY status UNION ALL SELECT status, count(*) AS n, 'project' AS scope FROM papers WHERE status <> 'deleted' AND project_id = 7 AND paper_id < 1000 GROUP BY status",
    "upload_checks": "WITH f AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 0 ELSE strlen(coalesce(text, '')) + CASE doc_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 9 ELSE 2 END END AS size FROM documents) SELECT doc_id, CASE WHEN size = 0 THEN 'empty' WHEN size > 5000 THEN 'too_large' WHEN doc_id % 3 <> 1 THEN 'not_pdf' END AS problem FROM f",
    "job_attempts": "SELECT o_custkey AS paper_id, o_orderkey AS job_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS attempt FROM orders UNION ALL SELECT c_custkey, NULL, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) + 1 FROM customer",
    "runs_and_failures": """WITH bad AS (SELECT user_id, min(event_id) AS first FROM events WHERE event_type = 'error' GROUP BY user_id)
SELECT user_id AS id, 'new' AS status, arg_min(event_type, event_id) AS error FROM events WHERE user_id % 2 <> 0 GROUP BY user_id
UNION ALL SELECT e.user_id, CASE WHEN e.user_id % 4 = 0 THEN 'succeeded' WHEN first IS NOT NULL THEN 'failed' ELSE 'running' END, CASE WHEN e.user_id % 4 <> 0 AND first IS NOT NULL THEN 'at ' || first END FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 2 = 0) e LEFT JOIN bad USING (user_id)""",
    "archived_assets": "SELECT l_orderkey AS paper_id, count(*) FILTER (WHERE l_returnflag <> 'R' AND coalesce(o_orderstatus, '') <> 'P') AS n_active, count(*) FILTER (WHERE coalesce(o_orderstatus, '') <> 'P') AS n_figures FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey",
    "enqueue_report": f"""WITH {_PAPERS}, a AS (SELECT l_partkey * 3 AS paper_id, min(l_orderkey * 10 + l_linenumber) AS pos FROM lineitem GROUP BY 1),
s AS (SELECT a.*, CASE WHEN p.paper_id IS NULL THEN 'not_found' WHEN o.o_orderstatus = 'O' THEN 'skipped' ELSE 'queued' END AS status FROM a LEFT JOIN papers p ON p.paper_id = a.paper_id AND p.status <> 'deleted' LEFT JOIN orders o ON o.o_orderkey = a.paper_id)
SELECT status, count(*) AS n, min(pos) AS first, sum(paper_id)::BIGINT AS ids FROM s GROUP BY status""",
    "paper_reads": f"WITH {_PAPERS} SELECT paper_id, left(body, 4) AS preview, (SELECT count(*) FROM lineitem WHERE l_orderkey = paper_id AND l_returnflag <> 'A') AS n_assets, (SELECT arg_max(event_type, event_id) FROM events WHERE user_id = paper_id) AS latest FROM papers WHERE status <> 'deleted'",
    "job_recovery": """WITH j AS (SELECT *, o_orderstatus = 'O' AND (o_orderkey % 3 = 0 OR o_orderdate < TIMESTAMP '1999-01-01') AS lost FROM orders)
SELECT o_orderkey AS job_id, CASE WHEN lost AND o_orderkey % 4 = 0 THEN 'cancelled' WHEN lost THEN 'retry' WHEN o_orderstatus = 'O' THEN 'processing' ELSE 'pending' END AS status, o_orderkey % 9 + lost::INT AS generation, coalesce(o_orderkey = max(o_orderkey) FILTER (WHERE o_orderpriority = '1-URGENT') OVER (PARTITION BY o_custkey), false) AS newest FROM j""",
    "audit_choice": """WITH a AS (SELECT user_id AS paper_id, (event_id // 16) % 5 AS k, CASE WHEN event_id % 3 = 0 THEN 'data/fake_' ELSE 'data/run' END || lpad(event_id::VARCHAR, 8, '0') AS path FROM events)
SELECT paper_id, CASE k WHEN 0 THEN 'historical' WHEN 1 THEN 'current' WHEN 2 THEN 'object' ELSE 'running' END AS source, path FROM a WHERE k < 4 AND (k = 3 OR path NOT LIKE '%/fake\\_%' ESCAPE '\\') QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY k DESC, path) = 1""",
    "artifact_choice": """WITH f AS (SELECT 's' || user_id AS scope, trunc(value)::INT % 4 AS k, event_type FROM events WHERE event_id % 40 < 3 OR user_id % 3 = 0), p AS (SELECT scope, CASE k WHEN 2 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS rank, scope || '/' || event_type || '/' || CASE k WHEN 0 THEN 'x_content_list.json' WHEN 1 THEN 'result.zip' ELSE 'content_list_v2_a.json' END AS path FROM f WHERE k < 3)
SELECT scope, path, sha256(path) AS artifact_key FROM (SELECT DISTINCT * FROM p) QUALIFY row_number() OVER (PARTITION BY scope ORDER BY rank, path) = 1""",
    "image_lookup": """WITH e AS (SELECT event_id, user_id AS doc, 's' || user_id AS top, 's' || user_id || '/' || event_type AS mid, 's' || user_id || '/' || event_type || '/auto' AS folder, event_id % 10 || '.png' AS name FROM events),
f AS (SELECT DISTINCT CASE event_id % 3 WHEN 0 THEN folder WHEN 1 THEN top ELSE 'elsewhere' END AS at, name FROM e WHERE event_id % 2 = 0), w AS (SELECT DISTINCT doc, name, folder, top FROM e)
SELECT w.doc, w.name, w.folder, coalesce(a.at, b.at) || '/' || w.name AS path FROM w LEFT JOIN f a ON a.at = w.folder AND a.name = w.name LEFT JOIN f b ON b.at = w.top AND b.name = w.name""",
    "asset_ingest": """WITH c AS (SELECT conv_id AS doc, turn AS pos, role || '/' || (turn % 4) || '.jpg' AS path, (turn % 4) || '.jpg' AS name FROM conversations), b AS (SELECT *, 0 AS source FROM c WHERE pos % 2 = 0 UNION ALL SELECT *, 1 FROM c),
o AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY doc, name ORDER BY source, pos, path) = 1) SELECT doc, name, source, pos, path, (row_number() OVER (PARTITION BY doc ORDER BY source, pos, name) - 1)::INT AS asset_index FROM o""",
    "file_checks": f"SELECT p_partkey, CASE p_partkey % {len(lifecycle.MEDIA) + 1} {_MEDIA} ELSE 'application/octet-stream' END AS media, CASE WHEN p_size % 4 = 0 THEN 'no_pages' WHEN p_partkey % 6 = 0 THEN 'blank' END AS problem, p_brand AS a, p_name AS b FROM part",
    "result_versions": "WITH e AS (SELECT DISTINCT user_id, event_type AS m, CASE WHEN event_id % 4 <> 0 THEN 'p' || event_id % 3 END AS p FROM events) SELECT user_id, string_agg(DISTINCT m, ',' ORDER BY m) AS models, coalesce(string_agg(DISTINCT p, ',' ORDER BY p), '') AS prompts FROM e GROUP BY user_id",
    "audit_event_counts": """SELECT 'event' AS what, event_type AS name, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT 'repair', unnest(['enum', event_type]) AS r, count(*) FROM events WHERE event_id % 3 = 0 GROUP BY r
UNION ALL SELECT 'phase', 'phase' || user_id % 2 AS p, count(*) FROM events WHERE event_type = 'view' GROUP BY p UNION ALL SELECT 'decision', event_type, count(*) FROM events GROUP BY event_type""",
    "layout_lines": """WITH t AS (SELECT l_orderkey, l_returnflag AS t, count(*) AS n FROM lineitem GROUP BY ALL), s AS (SELECT l_orderkey, 'page_blocks: ' || string_agg(t || ': ' || n, ', ' ORDER BY t) AS blocks FROM t GROUP BY ALL),
q AS (SELECT l_orderkey, sum(l_quantity) AS q, max(l_linenumber) AS m FROM lineitem GROUP BY ALL)
SELECT l_orderkey, concat_ws(' | ', CASE WHEN l_orderkey % 5 <> 0 THEN 'page_dimensions: 600x800pt' END, CASE WHEN l_orderkey % 3 <> 0 THEN format('image_bbox_on_page: [{:.0f}, 10, {:.0f}, {:.0f}]', q, q + 300, m::DOUBLE) END,
 CASE WHEN l_orderkey % 3 <> 0 AND l_orderkey % 5 <> 0 THEN CASE WHEN q + 150 < 360 THEN 'layout: single_column' ELSE 'layout: double_column_right' END END, blocks) AS line FROM q JOIN s USING (l_orderkey)""",
    "level_headings": """WITH o AS (SELECT o_custkey, o_orderkey AS pos, left(o_orderpriority, 1)::INT AS level, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderstatus END AS title FROM orders),
j AS (SELECT a.pos, b.level, max(b.pos) AS seen, arg_max(b.title, b.pos) AS title FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND b.pos < a.pos AND b.title IS NOT NULL GROUP BY a.pos, b.level),
h AS (SELECT pos, string_agg(level || ':' || title, ',' ORDER BY seen) AS headings FROM j GROUP BY pos) SELECT o.pos, coalesce(headings, '') AS headings FROM o LEFT JOIN h USING (pos)""",
    "line_contexts": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
w AS (SELECT *, string_agg(line, chr(10) ORDER BY line_no) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 4 PRECEDING AND 15 FOLLOWING) AS context FROM l) SELECT doc_id, line_no::INT AS line_no, md5(context) AS context_md5 FROM w WHERE contains(line, 'and the')""",
}
