"""Point, JSON and ontology queries over events, nation and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions import units
from vellum.operators import digitize, matching, ontology
from vellum.operators.relational import latest_per_key
from vellum.session import table

#: Pairs that exercise the unit and metric tables, among them the case-folded collisions.
PAIRS = [("growth rate", "1/h"), ("glucose concentration", "mM"), ("pore size", "mm"), ("yield percent", "%"), ("modulus", "MPa"), ("pressure", "Pa"), ("phosphate", "mg/L"), ("viability", "wt%"), ("peak load", "N"), ("cell count", "CFU/mL"), ("film thickness", "um"), ("mystery", "")]

#: Units in forms that the two folds read alike and unlike.
FORMS = ["µm", "μm", "um", "mm ", "mg/L", "mg per l", "m*s", "N·m", "x^2", "", " "]


def props_json(spark, d):
    e = table(spark, d, "events").withColumn("k", F.try_variant_get(F.try_parse_json("props"), "$.k", "int"))
    return e.groupBy(F.expr("k div 10").alias("bucket"), "event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"), F.count_if(F.col("k").isNull()).alias("n_missing"))


def canonical_hash(spark, d):
    """scope:base:index:hash16 keys and the SHA-256 of a canonical rendering with sorted keys."""
    e = table(spark, d, "events")
    c = F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"), F.lit(',"event_type":"'), F.col("event_type"), F.lit('","user_id":'), F.col("user_id").cast("string"), F.lit("}"))
    h = F.sha2(c, 256)
    key = F.concat_ws(":", F.concat(F.lit("u"), F.col("user_id").cast("string")), "event_type", F.lpad(F.col("event_id").cast("string"), 8, "0"), F.substring(h, 1, 16))
    return e.select("event_id", key.alias("natural_key"), h.alias("payload_hash"))


def point_dedupe(spark, d):
    """First of the events with equal text keys."""
    e = table(spark, d, "events")
    cols = ["user_id", "event_type", "props"]
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols] + [F.date_format("ts", "yyyy-MM-dd")]
    return latest_per_key(e.withColumn("key", F.sha1(F.concat_ws("\x1f", *parts))), ["key"], [F.col("event_id")]).select("event_id", "key")


def point_explode(spark, d):
    """A values map per user and day, unpivoted to (category, value) points; the first value of a category stays."""
    e = table(spark, d, "events").withColumn("day", F.dayofmonth("ts"))
    per = e.groupBy("user_id", "day", "event_type").agg(F.min_by("value", "event_id").alias("value"))
    maps = per.groupBy("user_id", "day").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "value"))).alias("values"))
    return maps.select("user_id", "day", F.explode("values").alias("category", "value"))


def unit_dimension(spark, d):
    df = spark.createDataFrame(PAIRS, "metric string, unit string")
    u, m = units.unit_dimension(F.col("unit")), units.metric_dimension(F.col("metric"))
    return df.select("metric", "unit", u.alias("unit_dimension"), m.alias("metric_dimension"), ((u != "") & (u == m)).alias("compatible"))


def ontology_gaps(spark, d):
    """Rejected rows by metric and unit bucket with their distinct support; two or more make a candidate."""
    e = table(spark, d, "events").filter("event_type in ('error', 'signup')").withColumn("dim", F.col("user_id") % 7)
    g = e.groupBy("event_type", "dim").agg(F.count_distinct(F.struct("user_id", F.dayofmonth("ts"))).alias("support"), F.max_by("value", F.struct("ts", "event_id")).alias("last_value"), F.count("*").alias("n_rows"))
    conf = F.least(F.lit(0.95), F.greatest(F.lit(0.0), F.lit(0.4) + F.lit(0.01) * F.col("support")))
    return g.withColumn("status", F.when(F.col("support") >= 2, "candidate").otherwise("observed")).withColumn("confidence", F.round(conf, 6))


def fuzzy_title(spark, d):
    """Names that contain another or that another contains; the longest contained one wins, then the least key."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.lower("n_name").alias("name"))
    m = matching.contained_parts(n, n.withColumnsRenamed({"key": "match_key", "name": "match"})).filter("match_key <> key")
    return latest_per_key(m, ["key"], [F.desc("score"), F.col("match_key")]).select(F.col("key").alias("title_key"), "match_key", "score")


def nearest_palette(spark, d):
    """The palette entry (the ten least ids) nearest to each vector by squared distance; of equal ones the least."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    palette = e.orderBy("vec_id").limit(10).agg(F.array_sort(F.collect_list(F.struct("vec_id", "v"))).alias("p"))  # ten entries
    d2 = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    best = F.array_min(F.transform("p", lambda q: F.struct(d2(F.col("v"), q["v"]).alias("d"), q["vec_id"].alias("k"))))
    return e.withColumn("one", F.lit(1)).join(F.broadcast(palette.withColumn("one", F.lit(1))), "one").select("vec_id", best["k"].alias("nearest"), F.round(best["d"], 4).alias("distance"))


def alias_fields(spark, d) -> DataFrame:
    """Field chains with Python truth: 0 and '' fall through to the next."""
    e = table(spark, d, "events")
    falsy = F.nullif(F.col("value"), F.lit(0.0))
    return e.select("event_id", F.coalesce(falsy, F.lit(0.5)).alias("confidence"), F.coalesce(F.nullif(F.get_json_object("props", "$.label"), F.lit("")), "event_type").alias("label"))


QUERIES = {f.__name__: f for f in (props_json, canonical_hash, point_dedupe, point_explode, unit_dimension, ontology_gaps, fuzzy_title, nearest_palette, alias_fields)}

_VALUES = ", ".join(f"('{m}', '{u}')" for m, u in PAIRS)
_FOLD = "replace(replace(replace(replace(replace(lower(trim({0})), ' ', ''), '*', ''), '·', ''), '^', ''), 'per', '/')"
_UNIT_ROWS = ", ".join(f"({i}, '{dim}', '{u}')" for i, (dim, u) in enumerate((dim, u) for dim, us in units.UNITS.items() for u in us))
_RULES = [(t, dim) for t, dim in units.METRIC_RULES] + [(t.lower().replace(" ", "_"), dim) for dim, terms in units.METRIC_TERMS.items() for t in terms]
_RULE_ROWS = ", ".join(f"({i}, '{t}', '{dim}')" for i, (t, dim) in enumerate(_RULES))
ORACLE = {
    "props_json": "WITH e AS (SELECT event_type, (props::JSON->>'k')::INT AS k FROM events) SELECT (k // 10)::BIGINT AS bucket, event_type, count(*) AS n, sum(k)::BIGINT AS total, count(*) FILTER (WHERE k IS NULL) AS n_missing FROM e GROUP BY ALL",
    "canonical_hash": """WITH c AS (SELECT *, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}') AS h FROM events) SELECT event_id, 'u' || user_id || ':' || event_type || ':' || lpad(event_id::VARCHAR, 8, '0') || ':' || substr(h, 1, 16) AS natural_key, h AS payload_hash FROM c""",
    "point_dedupe": "WITH k AS (SELECT event_id, sha1(concat_ws(chr(31), user_id, event_type, props, strftime(ts, '%Y-%m-%d'))) AS key FROM events) SELECT min(event_id) AS event_id, key FROM k GROUP BY key",
    "point_explode": "SELECT user_id, day(ts)::INT AS day, event_type AS category, first(value ORDER BY event_id) AS value FROM events GROUP BY ALL",
    "unit_dimension": f"""WITH p(metric, unit) AS (VALUES {_VALUES}), u(pos, dim, unit) AS (VALUES {_UNIT_ROWS}), r(pos, term, dim) AS (VALUES {_RULE_ROWS}),
x AS (SELECT metric, unit, coalesce((SELECT arg_min(u.dim, u.pos) FROM u WHERE p.unit <> '' AND {_FOLD.format("u.unit")} = {_FOLD.format("p.unit")}), '') AS unit_dimension,
 coalesce((SELECT arg_min(r.dim, r.pos) FROM r WHERE contains(replace(lower(p.metric), ' ', '_'), r.term)), '') AS metric_dimension FROM p)
SELECT *, unit_dimension <> '' AND unit_dimension = metric_dimension AS compatible FROM x""",
    "ontology_gaps": "WITH g AS (SELECT event_type, user_id % 7 AS dim, count(DISTINCT (user_id, day(ts))) AS support, last(value ORDER BY ts, event_id) AS last_value, count(*) AS n_rows FROM events WHERE event_type IN ('error', 'signup') GROUP BY ALL) SELECT *, CASE WHEN support >= 2 THEN 'candidate' ELSE 'observed' END AS status, round(least(0.95::DOUBLE, 0.4::DOUBLE + 0.01::DOUBLE * support), 6) AS confidence FROM g",
    "fuzzy_title": "SELECT a.n_nationkey AS title_key, b.n_nationkey AS match_key, least(length(a.n_name), length(b.n_name))::INT AS score FROM nation a JOIN nation b ON a.n_nationkey <> b.n_nationkey AND (contains(lower(a.n_name), lower(b.n_name)) OR contains(lower(b.n_name), lower(a.n_name))) QUALIFY row_number() OVER (PARTITION BY a.n_nationkey ORDER BY least(length(a.n_name), length(b.n_name)) DESC, b.n_nationkey) = 1",
    "nearest_palette": "WITH p AS (SELECT vec_id AS k, embedding AS q FROM embeddings ORDER BY vec_id LIMIT 10), x AS (SELECT vec_id, k, list_distance(embedding::DOUBLE[], q::DOUBLE[]) AS d FROM embeddings, p) SELECT vec_id, k AS nearest, round(d * d, 4) AS distance FROM x QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1",
    "alias_fields": "SELECT event_id, coalesce(nullif(value, 0), 0.5)::DOUBLE AS confidence, coalesce(nullif(props::JSON->>'label', ''), event_type) AS label FROM events",
}


def payload_points(spark, d):
    """Points of JSON payloads (a series for each event type of a user), exploded, numbered and gated."""
    e = table(spark, d, "events")
    series = e.groupBy("user_id", "event_type").agg(F.array_sort(F.collect_list(F.struct(F.col("event_id").alias("x"), F.col("value").alias("y"), F.lit("u").alias("y_unit")))).alias("data_points"))
    payload = F.to_json(F.struct(F.array_sort(F.collect_list(F.struct(F.col("event_type").alias("name"), "data_points"))).alias("series")))
    pts = digitize.gate_points(digitize.dedupe_points(digitize.explode_points(series.groupBy("user_id").agg(payload.alias("payload"))), ["user_id"]))
    return pts.groupBy("user_id", "series_name").agg(
        F.count("*").alias("n_points"), F.min("point_index").cast("bigint").alias("first_index"), F.round(F.sum("y_value"), 2).alias("total"), F.max("gated_confidence").alias("confidence"), F.first("review_reason").alias("reasons")
    )


def unit_forms(spark, d):
    """Units as the registry and as contracts fold them, and whether a metric's contract allows them."""
    p = spark.createDataFrame([(u,) for u in FORMS], "unit string").withColumn("metric", F.when(F.col("unit").contains("m"), "size").otherwise("other"))
    contract = spark.createDataFrame([("size", ["um", "mm", "mg per L"])], "metric string, units array<string>")
    a = ontology.unit_allowed(p, contract)
    return a.select("unit", units.normal_unit(F.col("unit")).alias("registry"), units.contract_unit(F.col("unit")).alias("contract"), "allowed")


QUERIES["unit_forms"] = unit_forms
_FORMS = ", ".join(f"('{u}')" for u in FORMS)
ORACLE["unit_forms"] = f"""
WITH f(unit) AS (VALUES {_FORMS}), x AS (SELECT unit, {_FOLD.format("unit")} AS registry, replace(replace(replace(replace(replace(replace(lower(trim(unit)), 'µ', 'u'), 'μ', 'u'), ' ', ''), '·', ''), '^', ''), 'per', '/') AS contract FROM f)
SELECT *, CASE WHEN trim(unit) = '' THEN false WHEN NOT contains(unit, 'm') THEN true ELSE contract IN ('um', 'mm', 'mg/l') END AS allowed FROM x"""
QUERIES["payload_points"] = payload_points
ORACLE["payload_points"] = """
WITH n AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_type, event_id) - 1 AS i FROM events)
SELECT user_id, event_type AS series_name, count(*) AS n_points, min(i) AS first_index, round(sum(value), 2) AS total, 0.5::DOUBLE AS confidence,
 'missing_x_axis_label;missing_y_axis_label;missing_x_axis_unit;visual_digitization_needs_verification' AS reasons FROM n GROUP BY ALL"""
