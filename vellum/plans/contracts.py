"""Evidence and result contracts, axes and candidates over conversations, events and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import axes, contracts, lifecycle
from vellum.session import table

#: Labels, hints, ids and payloads that exercise the tables of the axis operators.
LABELS = ["Time (h)", "Stress [MPa]", "Uptake (g) (dry) ", "(mm)", "rate ) (", "Depth", "", "a (b) c"]
HINTS = [["day", "mg/L"], ["Time (h)", "Intensity (a.u.)"], ["Concentration"], ["foo", "bar"], ["Strain", "Stress (MPa)"], [], ["%", "h"], ["density", "depth"]]
KEYS = ["x_strain_mm_per_mm", "x_load_mpa", "x_time_min", "x_hydrogen_mmol_m2", "x_depth", "x_a_b_h"]
CAPTIONS = ["Fig. 3 Results. (a) First thing. (b) Second", "(a)", "text b)", "figure 12", "Configure 3", "b: only this, then. more", ""]
PANELS = ["fig-3-a", "figure 2 b", "Fig. 10 C", "c", "figure-4", "panel"]
WORDS = ["High", " very low ", "0.7", "85%", "1.7", "-2", "unknown", ""]
MESSAGES = ["HTTP 429 too many", "Read Timeout", "bad request", "service temporarily away", ""]
PATHS = ["a/batch_fake1/x", "runs/my_fake_run/a", "data/fake_/x", "x/y/run_audit.json", "a/b_fake/run_audit.json"]


def _pairs(spark, values, schema="v string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")


def axis_labels(spark, d):
    a = _pairs(spark, LABELS).withColumn("a", axes.axis_label(F.col("v")))
    k = _pairs(spark, KEYS).withColumn("a", axes.key_label(F.col("v"), "x"))
    return a.union(k).select("v", "a.label", "a.unit")


def axis_hint_pairs(spark, d):
    h = _pairs(spark, HINTS, "v array<string>").withColumn("h", axes.axis_hints(F.col("v")))
    filled = h.withColumn("f", axes.fill_axis(F.lit(""), F.lit(""), F.col("h.x")))
    return filled.select("i", "h.x", "h.y", "f.label", "f.unit")


def caption_texts(spark, d):
    """Caption focus for panel a and b, full-caption tests, unit hints, panel and figure keys, confidences, retries, fake paths."""
    c = _pairs(spark, CAPTIONS).select(F.lit("focus").alias("what"), "v", F.concat_ws("#", contracts.caption_focus(F.col("v"), F.lit("fig-3-a")), contracts.caption_focus(F.col("v"), F.lit("fig-3-b")), contracts.full_caption(F.col("v")).cast("string")).alias("got"))
    u = _pairs(spark, CAPTIONS + LABELS).select(F.lit("units"), "v", F.array_join(axes.unit_hints(F.col("v")), ","))
    p = _pairs(spark, PANELS).select(F.lit("panel"), "v", F.concat_ws("#", lifecycle.figure_key(F.col("v")), lifecycle.panel_key(F.col("v")), lifecycle.panel_letter(F.col("v"))))
    w = _pairs(spark, WORDS).select(F.lit("confidence"), "v", F.coalesce(F.format_number(contracts.confidence_value(F.col("v")), 2), F.lit("none")))
    m = _pairs(spark, MESSAGES).select(F.lit("retry"), "v", lifecycle.retryable(F.col("v")).cast("string"))
    f = _pairs(spark, PATHS).select(F.lit("fake"), "v", lifecycle.fake_path(F.col("v")).cast("string"))
    return c.union(u).union(p).union(w).union(m).union(f)


def _evidence(spark, d):
    """Turns as evidence items: bucket by turn, an id that two turns share, policy by role, empty ids now and then."""
    c = table(spark, d, "conversations")
    n = len(contracts.ORDER)
    bucket = F.element_at(F.array(*map(F.lit, contracts.ORDER)), (F.col("turn") % n).cast("int") + 1)
    ident = F.when((F.col("conv_id") + F.col("turn")) % 11 == 0, "").otherwise(F.concat(F.lit("e"), F.expr("turn div 3").cast("string")))
    policy = F.when(F.col("role") == "user", "use_for_facts").when(F.col("turn") % 4 == 1, "background_only").otherwise("use_for_disambiguation")
    relation = F.when(F.col("turn") % n == 0, "primary_caption").otherwise("citation")
    return c.select("conv_id", bucket.alias("bucket"), F.col("turn").alias("pos"), ident.alias("evidence_id"), F.when(F.col("turn") == 0, "caption").otherwise("text").alias("source_type"), relation.alias("relation"), policy.alias("use_policy"), F.when(F.col("conv_id") % 2 == 0, "caption_segment").otherwise("text").alias("text_level"), "text")


def contract_items(spark, d):
    i = contracts.contract_items(_evidence(spark, d), ["conv_id"])
    return i.select("conv_id", "item", "evidence_id", "bucket", "use_policy", "role", F.md5("text_excerpt").alias("excerpt_md5"), "caption_segment_ref")


def prompt_items(spark, d):
    p = contracts.prompt_items(_evidence(spark, d), ["conv_id"])
    use, other = contracts.by_policy(p)
    counts = use.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text_excerpt")).alias("chars")).withColumn("use", F.lit(True))
    return counts.unionByName(other.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text_excerpt")).alias("chars")).withColumn("use", F.lit(False)))


def contract_documents(spark, d):
    """The documents' ids read back from their JSON."""
    doc = contracts.contract_document(contracts.contract_items(_evidence(spark, d), ["conv_id"]), ["conv_id"])
    get = lambda p: F.get_json_object("document", p)
    return doc.select("conv_id", get("$.n_items").cast("int").alias("n_items"), get("$.extractable").alias("extractable"), get("$.items[0].evidence_id").alias("first_id"))


def evidence_defaults(spark, d):
    """Evidence ids of each conversation for an answer that names two of its own and one that is not allowed."""
    e = _evidence(spark, d).filter("evidence_id <> ''").withColumn("source_type", F.when(F.col("pos") % 2 == 0, "image").otherwise("text"))
    g = e.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "evidence_id", "use_policy", "source_type"))).alias("ev"))
    told = F.array(F.lit("e1"), F.lit("nowhere"), F.lit("e0"))
    return g.select("conv_id", F.array_join(axes.evidence_ids(told, F.col("ev")), ",").alias("ids"), F.array_join(axes.default_ids(F.col("ev")), ",").alias("defaults"), F.array_join(axes.valid_ids(told, F.transform("ev", lambda x: x["evidence_id"])), ",").alias("valid"))


def semantic_results(spark, d):
    """Semantic payloads of events: other names, missing fields, confidences as numbers beyond the range and as words."""
    e = table(spark, d, "events")
    kind = F.col("event_id") % 4
    payload = F.to_json(F.struct(
        F.when(kind == 0, "background").when(kind == 1, F.col("event_type")).alias("relevance"),
        F.when(kind != 2, F.col("event_type")).alias("task"),
        F.lit("a1").alias("assay_class"),
        F.when(kind != 3, "m").alias("metric_type"),
        F.when(kind < 2, "extract_supporting_observation").alias("panel_decision"),
        F.lit("line").alias("panel_type"),
        F.when(kind == 0, (F.col("value") / 100).cast("string")).when(kind == 1, "High").alias("confidence"),
    ))
    wrapped = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"panel":'), payload, F.lit("}"))).otherwise(payload)
    s = e.select("event_id", contracts.semantic(contracts.unwrapped(wrapped, "panel", ["panel_type"])).alias("s")).select("event_id", "s.*")
    return s.withColumn("confidence", F.round("confidence", 6))


def visual_facts(spark, d):
    """Fact candidates of each user's events; those of one type say nothing and go, others lack an id."""
    e = table(spark, d, "events")
    c = F.struct(
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("id"), F.col("event_id").cast("string"))).alias("fact_id"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("subject"),
        F.when(F.col("event_type") == "signup", "x").alias("observation_name"),
    )
    g = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", c.alias("c")))).alias("cs"))
    payload = F.to_json(F.struct(F.transform("cs", lambda x: x["c"]).alias("visual_fact_candidates")))
    return contracts.visual_facts(g.select(F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("panel_id"), payload.alias("payload")))


def heatmap_candidates(spark, d):
    e = table(spark, d, "events")
    c = F.struct(
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("name"),
        F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).alias("value"),
        F.col("user_id").cast("string").alias("estimate"),
        F.when(F.col("event_id") % 2 == 0, F.array(F.lit("1"), F.col("event_id").cast("string"))).alias("value_range"),
    )
    g = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", c.alias("c")))).alias("cs"))
    payload = F.to_json(F.struct(F.transform("cs", lambda x: x["c"]).alias("benchmark_candidates")))
    x = g.select("user_id", F.explode(axes.candidates(payload)).alias("c")).select("user_id", "c.*")
    return x


def axis_payloads(spark, d):
    """The axis value of event payloads in any of three places; zero and empty ones fall through."""
    e = table(spark, d, "events")
    k = F.col("event_id") % 4
    p = F.to_json(F.struct(
        F.when(k == 0, F.col("event_type")).when(k == 1, F.lit("")).alias("x_axis"),
        F.when(k == 2, "0").alias("x"),
        F.struct(F.when(k != 3, F.col("user_id").cast("string")).alias("x_label")).alias("axis_labels"),
        F.struct(F.lit("last").alias("x_axis_label")).alias("axes"),
    ))
    return e.select("event_id", axes.axis_payload(p, "x").alias("axis"))


def metric_groups(spark, d):
    """Customers' segments against their nation's category: the nation's wins, another own one is kept."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("group_id"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("metric_category"))
    n = table(spark, d, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("group_id"), F.when(F.col("n_nationkey") % 4 == 0, "BUILDING").otherwise("MACHINERY").alias("metric_category"))
    return contracts.with_groups(c, n).drop("group_id")


def series_key_points(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("series_name"), F.col("event_id").alias("point_index"), F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("chart_point_id"), F.when(F.col("event_id") % 7 != 0, F.round("value", 0)).alias("y_value"))
    k = contracts.key_points(e, ["user_id"])
    return k.select("user_id", "series_name", F.array_join("points", ",").alias("points"))


def routing(spark, d):
    """Decisions of panels and what stands in where no model answered."""
    p = table(spark, d, "part")
    kind = F.when(F.col("p_size") % 3 == 0, "Chart").when(F.col("p_size") % 3 == 1, "image").otherwise("")
    f = p.withColumn("f", contracts.fallback(kind)).select("p_partkey", "f.*")
    decided = f.withColumn("digitize", contracts.digitize(F.col("panel_decision"), F.col("needs_digitization") & (F.col("p_partkey") % 2 == 0)))
    return decided.groupBy("panel_type", "evidence_role", "digitize").agg(F.count("*").alias("n"))


def evidence_levels(spark, d):
    """Levels, formats and roles of every relation and policy, and the containment test of caption parts."""
    relations = ["primary_caption", "same_panel_visual", "adjacent_table", "adjacent_formula", "same_section", "background", "sibling_panel", "citation"]
    policies = ["use_for_facts", "use_for_disambiguation", "background_only", "do_not_use_for_current_panel"]
    r = spark.createDataFrame([(a, b) for a in relations for b in policies], "relation string, policy string")
    html = F.when(F.col("policy") == "background_only", "<table>")
    return r.select("relation", "policy", contracts.text_level(F.col("relation"), F.lit("list")).alias("level"), contracts.text_format(html, F.when(F.col("relation") == "citation", "x")).alias("format"),
                    contracts.evidence_role(F.col("relation"), F.col("policy")).alias("role"), contracts.policy_role(F.col("relation"), F.col("policy")).alias("policy_role"), contracts.contained(F.col("relation"), F.lit("the <b>primary_caption</b> and citation")).alias("inside"))


QUERIES = {f.__name__: f for f in (axis_labels, axis_hint_pairs, caption_texts, contract_items, prompt_items, contract_documents, evidence_defaults, semantic_results, visual_facts, heatmap_candidates, axis_payloads, metric_groups, series_key_points, routing, evidence_levels)}


def _q(s):
    return "'" + s.replace("'", "''") + "'"


def _values(xs):
    return ", ".join(f"({i}, {_q(x)})" for i, x in enumerate(xs))


_LISTS = ", ".join(f"({i}, {x!r}::VARCHAR[])" for i, x in enumerate(HINTS))
_HAS = lambda c, ws: "(" + " OR ".join(f"contains({c}, {_q(w)})" for w in ws) + ")"
_UNIT_ONLY = lambda c: f"({c} <> '' AND {_HAS(f'lower({c})', axes.UNIT_PARTS)} AND NOT {_HAS(f'lower({c})', axes.LABEL_WORDS)} AND NOT contains({c}, '('))"
_IN = lambda ws: "(" + ", ".join(map(_q, ws)) + ")"
_SPLIT = "regexp_matches(trim(v), '(?s)^(.*)\\(([^(]*)\\)[^()]*$')"
_PART = lambda k: f"trim(regexp_extract(trim(v), '(?s)^(.*)\\(([^(]*)\\)[^()]*$', {k}))"
_SUFFIXES = sorted(axes.KEY_UNITS.items(), key=lambda kv: -len(kv[0]))
_KEYCASE = " ".join(f"WHEN ends_with(v, '_{s}') THEN {_q(u)}" for s, u in _SUFFIXES)
_KEYCUT = " ".join(f"WHEN ends_with(v, '_{s}') THEN left(substr(v, 3), length(v) - 2 - {len(s) + 1})" for s, _ in _SUFFIXES)
_ORDER = " ".join(f"WHEN {i} THEN '{b}'" for i, b in enumerate(contracts.ORDER))
_EVIDENCE = f"""e AS (SELECT conv_id, CASE turn % {len(contracts.ORDER)} {_ORDER} END AS bucket, turn % {len(contracts.ORDER)} AS place, turn AS pos, CASE WHEN (conv_id + turn) % 11 = 0 THEN '' ELSE 'e' || (turn // 3) END AS evidence_id,
 CASE WHEN turn = 0 THEN 'caption' ELSE 'text' END AS source_type, CASE WHEN turn % {len(contracts.ORDER)} = 0 THEN 'primary_caption' ELSE 'citation' END AS relation,
 CASE WHEN role = 'user' THEN 'use_for_facts' WHEN turn % 4 = 1 THEN 'background_only' ELSE 'use_for_disambiguation' END AS use_policy, CASE WHEN conv_id % 2 = 0 THEN 'caption_segment' ELSE 'text' END AS text_level, text FROM conversations),
d AS (SELECT * FROM e WHERE evidence_id <> '' QUALIFY row_number() OVER (PARTITION BY conv_id, evidence_id ORDER BY place, pos) = 1),
i AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY place, pos) - 1 AS item, source_type = 'caption' AND relation = 'primary_caption' AND text_level = 'caption_segment' AS ref FROM d)"""
_ROLE = "CASE WHEN use_policy = 'background_only' THEN 'background' WHEN use_policy = 'use_for_facts' AND relation = 'primary_caption' THEN 'primary' ELSE 'supporting' END"
_FOCUS = lambda x: f"CASE WHEN regexp_matches(v, '(?i)\\(?\\s*{x}\\s*[\\):.\\s,;]') THEN split_part(regexp_extract(v, '(?is)(\\(?\\s*{x}\\s*[\\):.\\s,;].*)', 1), '.', 1) ELSE v END"
_LEVELS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in contracts.LEVELS.items())
ORACLE = {
    "axis_labels": f"""WITH l(i, v) AS (VALUES {_values(LABELS)}), k(i, v) AS (VALUES {_values(KEYS)})
SELECT v, CASE WHEN {_SPLIT} AND {_PART(1)} <> '' THEN {_PART(1)} ELSE trim(v) END AS label, CASE WHEN {_SPLIT} THEN {_PART(2)} ELSE '' END AS unit FROM l
UNION ALL SELECT v, replace(CASE {_KEYCUT} ELSE substr(v, 3) END, '_', ' ') AS label, CASE {_KEYCASE} ELSE '' END AS unit FROM k""",
    "axis_hint_pairs": f"""WITH h(i, v) AS (VALUES {_LISTS}), u AS (SELECT i, v, list_filter(v, lambda x: {_UNIT_ONLY('x')}) AS units FROM h),
a AS (SELECT *, len(units) >= 2 AND len(list_filter(v, lambda x: contains(x, '(') AND contains(x, ')'))) = 0 AS alone, coalesce(list_filter(units, lambda x: lower(x) IN {_IN(axes.TIME_UNITS)} OR x IN {_IN(axes.LENGTH_UNITS)})[1], units[1], '') AS xu, coalesce(list_filter(v, lambda x: {_HAS('lower(x)', axes.X_WORDS)})[1], '') AS xw FROM u),
b AS (SELECT *, coalesce(list_filter(units, lambda x: x <> xu)[1], '') AS yu, coalesce(list_filter(v, lambda x: x <> xw AND {_HAS('lower(x)', axes.Y_WORDS)})[1], '') AS yw FROM a),
c AS (SELECT *, yw = '' AND len(v) = 1 AND xw = '' AS lone FROM b), e AS (SELECT *, CASE WHEN lone THEN v[1] ELSE yw END AS y1, CASE WHEN NOT lone AND xw = '' AND len(v) >= 2 THEN v[1] ELSE xw END AS x2 FROM c),
r AS (SELECT i, CASE WHEN alone THEN xu ELSE x2 END AS x, CASE WHEN alone THEN yu WHEN y1 = '' AND len(v) >= 2 THEN coalesce(list_filter(v, lambda z: z <> x2)[1], '') ELSE y1 END AS y FROM e)
SELECT i, x, y, CASE WHEN {_UNIT_ONLY('x')} THEN CASE WHEN lower(x) IN {_IN(axes.TIME_UNITS)} THEN 'Time' ELSE '' END ELSE trim(split_part(x, '(', 1)) END AS label,
 CASE WHEN {_UNIT_ONLY('x')} THEN x WHEN contains(x, '(') THEN regexp_extract(x, '\\(([^(]*)\\)', 1) ELSE '' END AS unit FROM r""",
    "caption_texts": f"""WITH c(i, v) AS (VALUES {_values(CAPTIONS)}), u(i, v) AS (VALUES {_values(CAPTIONS + LABELS)}), p(i, v) AS (VALUES {_values(PANELS)}), w(i, v) AS (VALUES {_values(WORDS)}), m(i, v) AS (VALUES {_values(MESSAGES)}), f(i, v) AS (VALUES {_values(PATHS)}),
pk AS (SELECT v, regexp_extract(lower(v), '\\bfig(?:ure)?[-_\\s.]*(\\d+)\\b', 1) AS n, regexp_extract(lower(v), '\\bfig(?:ure)?[-_\\s.]*(\\d+)[-_\\s.]*([a-z])\\b', 1) AS pn, regexp_extract(lower(v), '\\bfig(?:ure)?[-_\\s.]*(\\d+)[-_\\s.]*([a-z])\\b', 2) AS pl FROM p),
wk AS (SELECT v, CASE lower(trim(v)) {" ".join(f"WHEN '{k}' THEN {x}" for k, x in contracts.CONFIDENCES.items())} ELSE coalesce(try_cast(trim(v) AS DOUBLE), try_cast(nullif(regexp_extract(v, '^([0-9.]+)%$', 1), '') AS DOUBLE) / 100) END AS x FROM w)
SELECT 'focus' AS what, v, {_FOCUS('a')} || '#' || {_FOCUS('b')} || '#' || (regexp_matches(v, '(?i)\\b(?:fig(?:ure)?\\.?)\\s*\\d+'))::VARCHAR AS got FROM c
UNION ALL SELECT 'units', v, array_to_string(list_filter([{", ".join(map(_q, axes.HINT_UNITS))}], lambda x: contains(lower(v), lower(x))), ',') FROM u
UNION ALL SELECT 'panel', v, CASE WHEN n <> '' THEN 'fig-' || n ELSE '' END || '#' || CASE WHEN pl <> '' THEN 'fig-' || pn || '-' || pl ELSE '' END || '#' || CASE WHEN regexp_matches(v, '^[a-z]$') THEN v ELSE pl END FROM pk
UNION ALL SELECT 'confidence', v, CASE WHEN x IS NULL THEN 'none' ELSE format('{{:.2f}}', greatest(0, least(1, x))) END FROM wk
UNION ALL SELECT 'retry', v, {_HAS('lower(v)', lifecycle.RETRY)}::VARCHAR FROM m
UNION ALL SELECT 'fake', v, ({_HAS('lower(v)', lifecycle.FAKE)} OR ends_with(lower(v), '_fake/run_audit.json'))::VARCHAR FROM f""",
    "contract_items": f"WITH {_EVIDENCE} SELECT conv_id, item::INT AS item, evidence_id, bucket, use_policy, {_ROLE} AS role, md5(CASE WHEN ref THEN '' ELSE left(text, 360) END) AS excerpt_md5, ref AS caption_segment_ref FROM i",
    "prompt_items": f"WITH {_EVIDENCE.replace('FROM e WHERE', 'FROM e WHERE place < 5 AND')} SELECT conv_id, count(*) AS n, sum(length(CASE WHEN ref THEN '' ELSE left(text, 240) END))::BIGINT AS chars, use_policy = 'use_for_facts' AS use FROM i WHERE item < 20 GROUP BY ALL",
    "contract_documents": f"""WITH {_EVIDENCE} SELECT conv_id, count(*)::INT AS n_items, '[' || coalesce(string_agg('"' || evidence_id || '"', ',' ORDER BY item) FILTER (WHERE use_policy = 'use_for_facts'), '') || ']' AS extractable, arg_min(evidence_id, item) AS first_id FROM i GROUP BY conv_id""",
    "evidence_defaults": f"""WITH {_EVIDENCE}, g AS (SELECT conv_id, list(evidence_id ORDER BY pos) AS ids, list(evidence_id ORDER BY pos) FILTER (WHERE use_policy = 'use_for_facts') AS usable, list(evidence_id ORDER BY pos) FILTER (WHERE use_policy = 'use_for_facts' AND pos % 2 = 0) AS visual FROM e WHERE evidence_id <> '' GROUP BY conv_id),
v AS (SELECT *, list_filter(['e1', 'nowhere', 'e0'], lambda x: list_contains(ids, x)) AS valid, coalesce(visual, usable, ids)[1:3] AS defaults FROM g),
a AS (SELECT *, list_concat(valid, visual[1:3]) AS own FROM v)
SELECT conv_id, array_to_string(CASE WHEN visual IS NOT NULL THEN list_filter(own, lambda x, k: list_position(own, x) = k) WHEN len(valid) > 0 THEN valid ELSE defaults END, ',') AS ids, array_to_string(defaults, ',') AS defaults, array_to_string(valid, ',') AS valid FROM a""",
    "semantic_results": """WITH e AS (SELECT *, event_id % 4 AS k FROM events), r AS (SELECT event_id, k, value, event_type, CASE k WHEN 0 THEN 'context_only' WHEN 1 THEN event_type ELSE 'unusable' END AS panel_relevance, CASE WHEN k < 2 THEN 'extract_supporting_observation' ELSE 'skip_metrics' END AS panel_decision,
 CASE k WHEN 0 THEN 0 WHEN 1 THEN 0 ELSE 3 END AS n_missing, CASE k WHEN 0 THEN greatest(0, least(1, value / 100)) WHEN 1 THEN 0.9 ELSE 0.5 END AS c FROM e)
SELECT event_id, panel_relevance, panel_decision, CASE WHEN k < 2 THEN 'supporting_observation' ELSE 'unusable' END AS evidence_role, CASE WHEN k <> 2 THEN event_type ELSE '' END AS application_task, CASE WHEN k <> 3 THEN 'm' ELSE '' END AS metric_category,
 round((CASE WHEN n_missing > 0 THEN least(c, 0.4) ELSE c END)::DOUBLE, 6) AS confidence, n_missing::INT AS n_missing FROM r""",
    "visual_facts": "WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events) SELECT 'p' || user_id AS panel_id, i::INT AS index, CASE WHEN event_id % 3 = 0 THEN 'id' || event_id ELSE 'p' || user_id || '-vf-' || i END AS fact_id, 'other_visual_fact' AS fact_type, event_type AS subject, CASE WHEN event_type = 'signup' THEN 'x' ELSE '' END AS attribute, '' AS value FROM n WHERE event_type <> 'error'",
    "heatmap_candidates": "WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events) SELECT user_id, i::INT AS index, event_type AS metric_name, CASE WHEN event_id % 3 = 0 THEN event_id::VARCHAR ELSE user_id::VARCHAR END AS value, CASE WHEN event_id % 2 = 0 THEN '1' ELSE '' END AS value_min, CASE WHEN event_id % 2 = 0 THEN event_id::VARCHAR ELSE '' END AS value_max, event_id % 2 = 0 AS needs_review FROM n WHERE event_type <> 'error'",
    "axis_payloads": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 3 THEN 'last' ELSE CASE WHEN user_id = 0 THEN 'last' ELSE user_id::VARCHAR END END AS axis FROM events",
    "metric_groups": """WITH j AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS own, CASE WHEN n_nationkey % 4 = 0 THEN 'BUILDING' WHEN n_nationkey % 2 = 0 THEN 'MACHINERY' END AS grp FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)
SELECT id, coalesce(grp, own, '') AS metric_category, CASE WHEN own <> grp THEN own END AS domain_metric_category FROM j""",
    "series_key_points": """WITH e AS (SELECT user_id, event_type AS series_name, event_id, 'c' || event_id AS cid, CASE WHEN event_id % 7 <> 0 THEN round(value, 0) END AS y FROM events),
g AS (SELECT user_id, series_name, [arg_min(cid, event_id), arg_min(cid, (y, event_id)) FILTER (WHERE y IS NOT NULL), arg_min(cid, (-y, event_id)) FILTER (WHERE y IS NOT NULL), arg_max(cid, event_id)] AS p FROM e GROUP BY ALL), f AS (SELECT user_id, series_name, list_filter(p, lambda x: x IS NOT NULL) AS p FROM g)
SELECT user_id, series_name, array_to_string(list_filter(p, lambda x, k: list_position(p, x) = k), ',') AS points FROM f""",
    "routing": "WITH p AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'chart' WHEN 1 THEN 'image' ELSE 'unknown' END AS panel_type FROM part) SELECT panel_type, CASE WHEN panel_type = 'chart' THEN 'primary_metric_panel' ELSE 'supporting_observation' END AS evidence_role, panel_type = 'chart' AND p_partkey % 2 = 0 AS digitize, count(*) AS n FROM p GROUP BY ALL",
    "evidence_levels": f"""WITH r(relation) AS (VALUES ('primary_caption'), ('same_panel_visual'), ('adjacent_table'), ('adjacent_formula'), ('same_section'), ('background'), ('sibling_panel'), ('citation')), p(policy) AS (VALUES ('use_for_facts'), ('use_for_disambiguation'), ('background_only'), ('do_not_use_for_current_panel')),
x AS (SELECT *, CASE policy WHEN 'background_only' THEN 'background' WHEN 'do_not_use_for_current_panel' THEN 'non_current_panel' ELSE 'supporting' END AS base, relation IN ('primary_caption', 'same_panel_visual') AS main FROM r, p)
SELECT relation, policy, CASE relation {_LEVELS} ELSE 'list' END AS level, CASE WHEN policy = 'background_only' THEN 'html' WHEN relation = 'citation' THEN 'latex' ELSE 'plain_text' END AS format,
 CASE WHEN main THEN 'primary' ELSE base END AS role, CASE WHEN main AND policy = 'use_for_facts' THEN 'primary' ELSE base END AS policy_role, relation IN ('primary_caption', 'citation') AS inside FROM x""",
}
