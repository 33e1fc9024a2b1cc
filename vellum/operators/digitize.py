"""Model payloads to points, gated points and fact rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Statistics of a box plot, in order.
BOX = ("min", "q1", "median", "q3", "max")
#: Fields whose texts make a point's identity.
POINT_KEY = ("series_name", "series", "x_value", "x", "x_axis_label", "x_unit", "y_value", "y", "y_axis_label", "y_unit", "z_value", "z", "z_label", "z_unit", "category_label", "category")
#: Statuses that make a whole result doubtful.
BAD_STATUS = ("axis_unreadable", "legend_unreadable", "too_low_resolution", "failed", "unknown")
BAD_AXIS, BAD_CALIBRATION = ("unreadable", "partially_readable", "unknown"), ("unavailable", "unknown")
EXACT_SOURCES = ("table_exact", "caption_exact", "text_exact")


def decode_json(text: Column) -> Column:
    """VARIANT of a model's answer: the text itself, else its first fenced block, else from its first to its last brace, else null.

    Control characters within texts, which JSON forbids, count as spaces if nothing else reads the answer.
    """
    fenced = F.nullif(F.regexp_extract(text, r"(?s)```(?:json|JSON)?\s*(.*?)\s*```", 1), F.lit(""))
    braced = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    forms = [F.trim(text), fenced, braced]
    clean = [F.regexp_replace(f, r"[\x00-\x1f]", " ") for f in forms]
    return F.coalesce(*[F.try_parse_json(f) for f in [*forms, *clean]])


def repair_summary(severities: Column) -> Column:
    """Whether an array of repair severities degrades a payload: one critical, three errors, or twelve of any."""
    n = lambda s: F.size(F.filter(severities, lambda x: x == s))
    return (n("critical") >= 1) | (n("error") >= 3) | (F.size(severities) >= 12)


def _get(path: str, kind: str = "string", of: str = "point") -> Column:
    return F.try_variant_get(of, path, kind)


def _text(*paths: str) -> Column:
    """The first of the paths that is a non-empty text."""
    return F.coalesce(*[F.nullif(F.trim(_get(p)), F.lit("")) for p in paths])


def explode_points(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """`payloads` with a row for each point of its flat, by-series and map-of-series lists, in order.

    A point with a list of points gives those; a map of values gives a point for each category; a box
    plot one for each statistic. Names of series pass down to points without one.
    """
    spark = payloads.sparkSession
    keep = [f"`{c}`" for c in payloads.columns if c != payload]
    cols = ", ".join(keep)
    answers = payloads.withColumn("__json", decode_json(F.col(payload)))
    v = "'variant'"
    flat = f"SELECT {cols}, 0 AS o, p.pos AS a, 0 AS b, 0 AS f, cast(null AS string) AS name, p.value AS point FROM {{answers}}, LATERAL variant_explode(try_variant_get(__json, '$.data_points', {v})) p"
    series = f"""SELECT {cols}, 1 AS o, s.pos AS a, p.pos AS b, 0 AS f, coalesce(try_variant_get(s.value, '$.series_name', 'string'), try_variant_get(s.value, '$.name', 'string')) AS name, p.value AS point
        FROM {{answers}}, LATERAL variant_explode(try_variant_get(__json, '$.series', {v})) s,
        LATERAL variant_explode(coalesce(try_variant_get(s.value, '$.data_points', {v}), try_variant_get(s.value, '$.points', {v}))) p"""
    named = f"""SELECT {cols}, 1 AS o, s.pos AS a, n.pos AS b, p.pos AS f, n.key AS name, p.value AS point
        FROM {{answers}}, LATERAL variant_explode(try_variant_get(__json, '$.series', {v})) s, LATERAL variant_explode(s.value) n,
        LATERAL variant_explode(coalesce(try_variant_get(n.value, '$.data_points', {v}), try_variant_get(n.value, '$.points', {v}))) p
        WHERE n.key NOT IN ('series_name', 'name', 'data_points', 'points') AND try_variant_get(s.value, '$.series_name', 'string') IS NULL AND try_variant_get(s.value, '$.name', 'string') IS NULL"""
    points = spark.sql(f"{flat} UNION ALL {series} UNION ALL {named}", answers=answers)
    nested = spark.sql(f"""
        SELECT {cols}, o, a, b, f, coalesce(n.pos, 0) AS c,
          coalesce(try_variant_get(n.value, '$.series_name', 'string'), try_variant_get(point, '$.series_name', 'string'), try_variant_get(point, '$.series', 'string'), name) AS name, coalesce(n.value, point) AS point
        FROM {{points}}, LATERAL variant_explode_outer(coalesce(try_variant_get(point, '$.points', {v}), try_variant_get(point, '$.data_points', {v}))) n
        WHERE schema_of_variant(coalesce(n.value, point)) LIKE 'OBJECT%'""", points=points)
    valued = spark.sql(f"""
        SELECT {cols}, o, a, b, f, c, coalesce(m.pos, 0) AS d, coalesce(if(m.key IS NULL, null, try_variant_get(point, '$.gene', 'string')), if(m.key IS NULL, null, try_variant_get(point, '$.group', 'string')), name) AS name, m.key AS map_key, m.value AS map_value, point
        FROM {{nested}}, LATERAL variant_explode_outer(try_variant_get(point, '$.values', {v})) m""", nested=nested)
    is_box = F.lower(F.coalesce(_get("$.type"), F.lit(""))).isin("boxplot", "box_plot", "box")
    stats = F.filter(F.array(*[F.struct(F.lit(s).alias("key"), _get(f"$.{s}", "double").alias("value")) for s in BOX]), lambda s: s["value"].isNotNull())
    none = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("double").alias("value")))
    boxed = valued.withColumn("__stats", F.when(is_box & (F.size(stats) > 0), stats).otherwise(none)).select(*keep, "o", "a", "b", "f", "c", "d", "name", "map_key", "map_value", "point", F.posexplode("__stats").alias("e", "stat"))
    raw_x = F.coalesce(_get("$.x_value"), _get("$.x"))
    x = F.coalesce(_get("$.x_value", "double"), _get("$.x", "double"))
    value = F.coalesce(F.try_variant_get("map_value", "$", "double"), F.col("stat.value"), _get("$.value", "double"))
    category = F.coalesce(F.col("stat.key"), _text("$.category", "$.category_label"), F.col("map_key"), F.when(raw_x.isNull(), _text("$.label")), F.when(raw_x.isNull() & value.isNotNull(), F.col("name")), F.when(x.isNull(), raw_x))
    z = F.coalesce(_get("$.z_value"), _get("$.z"))
    out = boxed.select(
        *keep, "o", "a", "b", "f", "c", "d", "e",
        F.coalesce("name", F.lit("")).alias("series_name"),
        x.alias("x_value"),
        F.coalesce(_get("$.y_value", "double"), _get("$.y", "double"), value).alias("y_value"),
        F.expr("try_cast(coalesce(try_variant_get(point, '$.z_value', 'string'), try_variant_get(point, '$.z', 'string')) AS double)").alias("z_num"),
        F.nullif(z, F.lit("")).alias("z_text"),
        F.coalesce(category, F.lit("")).alias("category_label"),
        *[F.coalesce(_text(*p), F.lit("")).alias(n) for n, p in {"x_axis_label": ["$.x_axis_label"], "y_axis_label": ["$.y_axis_label"], "x_unit": ["$.x_unit"], "y_unit": ["$.y_unit", "$.unit"], "z_label": ["$.z_label", "$.z_axis_label", "$.value_label"], "z_unit": ["$.z_unit"]}.items()],
        F.coalesce(_text("$.value_source"), F.lit("vlm_visual_estimate")).alias("value_source"),
        F.coalesce(F.nullif(_get("$.confidence", "double"), F.lit(0.0)), F.lit(0.5)).alias("confidence"),
        F.sha1(F.concat_ws("\x1f", F.coalesce("name", F.lit("")), F.coalesce("map_key", "stat.key", F.lit("")), F.coalesce(value.cast("string"), F.lit("")), *[F.coalesce(_get(f"$.{k}"), F.lit("")) for k in POINT_KEY])).alias("point_key"),
    )
    return out


def dedupe_points(points: DataFrame, result: list[str]) -> DataFrame:
    """The first of points with equal keys in a result, numbered from 0 in order."""
    order = ["o", "a", "b", "f", "c", "d", "e"]
    first = points.withColumn("__rn", F.row_number().over(W.partitionBy(*result, "point_key").orderBy(*order))).filter("__rn = 1").drop("__rn")
    return first.withColumn("point_index", F.row_number().over(W.partitionBy(*result).orderBy(*order)) - 1).drop(*order, "point_key")


def cap(reasons: Column) -> Column:
    """The highest confidence that reasons allow: the first rule that holds."""
    has = lambda r: F.array_contains(reasons, r)
    starts = lambda p: F.exists(reasons, lambda r: r.startswith(p))
    x, y = has("missing_x_axis_label"), has("missing_y_axis_label")
    return F.when((x & y) | starts("digitization_status_"), 0.55).when(starts("axis_readability_") | starts("calibration_status_") | x | y, 0.6).otherwise(0.65)


def gate_points(points: DataFrame) -> DataFrame:
    """Points with reasons, capped confidence and review flag; visual estimates need verification."""
    miss = lambda cond, reason: F.when(cond, reason)
    none = lambda c: F.col(c) == ""
    has_x, has_y = F.col("x_value").isNotNull(), F.col("y_value").isNotNull()
    reasons = F.array_compact(F.array(
        miss(has_x & none("x_axis_label") & none("category_label"), "missing_x_axis_label"),
        miss(has_y & none("y_axis_label"), "missing_y_axis_label"),
        miss(has_x & none("x_unit") & none("category_label"), "missing_x_axis_unit"),
        miss(has_y & none("y_unit"), "missing_y_axis_unit"),
        miss(~F.col("value_source").isin(*EXACT_SOURCES), "visual_digitization_needs_verification"),
    ))
    p = points.withColumn("reasons", reasons)
    held = F.when(F.size("reasons") > 0, F.least(F.col("confidence"), cap(F.col("reasons")))).otherwise(F.col("confidence"))
    return p.withColumn("gated_confidence", held).withColumn("needs_verification", F.size("reasons") > 0).withColumn("review_reason", F.array_join("reasons", ";")).drop("reasons")


def result_reasons(status: Column, readability: Column, calibration: Column) -> Column:
    """Reasons that a whole result is doubtful for, in order."""
    of = lambda c, bad, name: F.when(F.coalesce(c, F.lit("unknown")).isin(*bad), F.concat(F.lit(f"{name}_"), F.coalesce(c, F.lit("unknown"))))
    return F.array_compact(F.array(of(status, BAD_STATUS, "digitization_status"), of(readability, BAD_AXIS, "axis_readability"), of(calibration, BAD_CALIBRATION, "calibration_status")))


def fact_rows(points: DataFrame, results: DataFrame, events: DataFrame) -> DataFrame:
    """All-text fact rows: a row for each point, an axis row for a result without points, one for a panel that only failed or was skipped.

    points, results and events have paper_id, figure_id, panel_id; points keep the confidence from before the gate.
    """
    ids = ["paper_id", "figure_id", "panel_id"]
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = points.select(*ids, F.concat_ws(":", *ids, F.lit("point"), F.col("point_index").cast("string")).alias("fact_id"), text("point_index").alias("point_index"), "series_name",
                        F.coalesce(F.col("x_value").cast("string"), "category_label").alias("x_value"), text("y_value").alias("y_value"), F.coalesce("z_text", F.lit("")).alias("z_value"),
                        text("confidence").alias("confidence"), F.lit("digitized").alias("digitization_status"))
    rest = [F.lit("").alias(c) for c in ("point_index", "series_name", "x_value", "y_value", "z_value")]
    axis = results.join(points, ids, "left_anti").select(*ids, F.concat_ws(":", *ids, F.lit("axis")).alias("fact_id"), F.lit("axis").alias("point_index"), *rest[1:], text("result_confidence").alias("confidence"), F.coalesce("digitization_status", F.lit("unknown")).alias("digitization_status"))
    first = W.partitionBy(*ids).orderBy("pos")
    lost = events.withColumn("rn", F.row_number().over(first)).filter("rn = 1").join(results, ids, "left_anti")
    status = F.when((F.col("event") == "skipped") & (F.col("reason") == "visual_asset_too_small"), "too_low_resolution").otherwise("failed")
    kind = F.when(F.col("event") == "skipped", "skip").otherwise("failed")
    gone = lost.select(*ids, F.concat_ws(":", *ids, kind).alias("fact_id"), *rest, F.lit("").alias("confidence"), status.alias("digitization_status"))
    return own.unionByName(axis).unionByName(gone)


def natural_key(scope: Column, base: Column, index: Column, payload: Column) -> Column:
    """scope:base:index8:hash16 with the SHA-256 of the payload's canonical JSON (sorted keys, compact)."""
    return F.concat_ws(":", scope, F.substring(base, 1, 120), F.lpad(index.cast("string"), 8, "0"), F.substring(F.sha2(F.to_json(F.parse_json(payload)), 256), 1, 16))


def chart_payload(answer: Column) -> Column:
    """JSON object of a chart answer: decoded, out of its wrapper if it has one; an answer that is no object gives a failed result that says why."""
    decoded = decode_json(answer)
    inner = F.try_variant_get(decoded, "$.chart_digitization_result", "variant")
    is_object = lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    failed = F.to_json(F.struct(F.lit("failed").alias("digitization_status"), F.array(F.lit("non_json_chart_digitization_output")).alias("warnings"), answer.alias("raw_output_text")))
    return F.when(is_object(inner), F.to_json(inner)).when(is_object(decoded), F.to_json(decoded)).otherwise(failed)
