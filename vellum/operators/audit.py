"""Audit tables: displayable facts, rebuilds, panel images, string matrices, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses that show a row without values.
TERMINAL = ("failed", "too_low_resolution", "axis_unreadable", "legend_unreadable", "no_chart_detected")


def has_values() -> Column:
    """A point with an index other than axis and an x, y or z."""
    index = F.trim(F.coalesce(F.col("point_index"), F.lit("")))
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    return ~index.isin("", "axis") & (given("x_value") | given("y_value") | given("z_value"))


def displayable() -> Column:
    return has_values() | F.lower(F.trim(F.coalesce(F.col("digitization_status"), F.lit("")))).isin(*TERMINAL)


def rebuild_facts(facts: DataFrame, rebuilt: DataFrame, panel: str = "panel_id") -> DataFrame:
    """Displayable facts, and the rebuilt rows of panels that have none; rows without a panel stay as they are.

    A panel shows its own rows or its rebuilt ones, never both.
    """
    named = F.coalesce(F.col(panel), F.lit("")) != ""
    loose = facts.filter(~named)
    shown = facts.filter(named & displayable())
    return loose.unionByName(shown).unionByName(rebuilt.filter(named).join(shown.select(panel).distinct(), panel, "left_anti").select(facts.columns))


def panel_images(packets: DataFrame, pos: str = "pos") -> DataFrame:
    """panel_id, image: the file name of the last packet with an image."""
    p = packets.filter("coalesce(panel_id, '') <> '' and coalesce(image_ref, '') <> ''")
    return p.groupBy("panel_id").agg(F.max_by(F.element_at(F.split("image_ref", "/"), -1), pos).alias("image"))


def string_matrix(df: DataFrame, headers: dict[str, list[str]], order: list[str], cap: int = 500) -> DataFrame:
    """One text column for each header, its first present alias, and total, the number of all rows; at most `cap` rows."""
    have = set(df.columns)
    cells = []
    for name, aliases in headers.items():
        found = [F.col(a).cast("string") for a in [name, *aliases] if a in have]
        cells.append(F.coalesce(*found, F.lit("")).alias(name))
    total = df.agg(F.count("*").alias("total"))  # one row
    return df.orderBy(*order).limit(cap).select(*cells).join(F.broadcast(total))


def running_summary(events: DataFrame, run: str = "run_id", pos: str = "pos") -> DataFrame:
    """Per run, from VARIANT events in order: panels seen, counts by kind, errors, the first message of one, the last event.

    Broken lines come as null events: they count as events and nothing else.
    """
    get = lambda p, t="string": F.try_variant_get("event", p, t)
    name = F.coalesce(F.nullif(get("$.event"), F.lit("")), F.nullif(get("$.phase_name"), F.lit("")))
    e = events.withColumns({"__name": name, "__panel": F.nullif(get("$.panel_id"), F.lit("")), "__message": get("$.message")})
    failed = F.coalesce(F.nullif(get("$.exception_type"), F.lit("")).isNotNull() | F.col("__name").contains("failed"), F.lit(False))
    of = lambda kind: F.col("__name") == kind
    number = lambda p: F.coalesce(get(p, "bigint"), F.lit(0))
    total = lambda kind, p: F.coalesce(F.sum(F.when(of(kind), number(p))), F.lit(0))
    return e.groupBy(run).agg(
        F.count("*").alias("n_events"),
        F.count_distinct("__panel").alias("processed_panels"),
        F.coalesce(F.max(F.when(of("chart_facts_extracted"), number("$.fact_count"))), F.lit(0)).alias("chart_facts"),
        total("metric_candidates_created", "$.candidate_count").alias("metric_candidates"),
        F.count_if(of("benchmark_metrics_accepted")).alias("benchmark_metrics"),
        total("image_observation_completed", "$.observation_count").alias("image_observations"),
        F.count_if(of("chart_digitization_completed")).alias("digitization_results"),
        F.count_if(failed).alias("errors"),
        F.min_by("__message", F.when(failed & F.col("__message").isNotNull(), F.col(pos))).alias("first_error"),
        F.max_by("__name", F.when(F.col("__name").isNotNull(), F.col(pos))).alias("last_event"),
    )


def with_progress(runs: DataFrame, total: Column, done: Column) -> DataFrame:
    """progress_percent: whole percent of the panels done, 100 at most, 0 without panels."""
    return runs.withColumn("progress_percent", F.when(total > 0, F.least(F.lit(100), F.floor(done * 100 / total))).otherwise(0).cast("int"))


def result_state(metrics: Column, facts: Column, observations: Column, digitized: Column, errors: Column) -> Column:
    """pipeline_errors if there is nothing but errors, else by what there is."""
    nothing = (metrics == 0) & (facts == 0) & (observations == 0) & (digitized == 0)
    return F.when((errors > 0) & nothing, "pipeline_errors").when(metrics > 0, "benchmark_metrics_ready").when(facts > 0, "chart_facts_ready").otherwise("semantic_only")


def quality_score(metrics: Column, facts: Column, observations: Column) -> Column:
    return 3 * metrics + 2 * facts + observations


#: Text fields of a stored point; lists of points may stand one level deeper.
_POINT = ("series_name", "series", "x_value", "x", "y_value", "y", "z_value", "z", "category_label", "category", "x_axis_label", "x_label", "y_axis_label", "y_label", "x_unit", "y_unit", "unit", "confidence")
_FLAT = "struct<" + ",".join(f"{c}:string" for c in _POINT) + ">"
_NESTED = "array<struct<" + ",".join(f"{c}:string" for c in (*_POINT, "name")) + f",data_points:array<{_FLAT}>,points:array<{_FLAT}>>>"


def _present(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _point_list(raw: Column) -> Column:
    """array<struct(name, p)> of a JSON list of points; an item with a list of points gives those, under its name."""
    items = F.coalesce(F.from_json(raw, _NESTED), F.array().cast(_NESTED))

    def own(i: Column) -> Column:
        name = F.coalesce(_present(i["series_name"]), _present(i["series"]), _present(i["name"]))
        inner = F.coalesce(i["data_points"], i["points"])
        point = F.struct(*[i[c].alias(c) for c in _POINT])
        named = lambda n, p: F.struct(n.alias("name"), p.alias("p"))
        return F.when(inner.isNotNull(), F.transform(inner, lambda p: named(F.coalesce(_present(p["series_name"]), name), p))).otherwise(F.array(named(_present(i["series_name"]), point)))

    return F.flatten(F.transform(items, own))


def rebuilt_points(results: DataFrame, payload: str = "payload") -> DataFrame:
    """`results` with a row for each point of their stored JSON that has a y or a z: point_index from 1, fact_id, series, x, y, z.

    Points come from the result's list, else from its raw output's list, else from the raw output's series; numbers stay as they were
    written, so 0.0 is a value. x falls back to the category, then to the axis' label.
    """
    get = lambda p: F.get_json_object(payload, p)
    lists = [_point_list(get(p)) for p in ("$.points", "$.raw_output.data_points", "$.raw_output.series")]
    found = F.when(F.size(lists[0]) > 0, lists[0]).when(F.size(lists[1]) > 0, lists[1]).otherwise(lists[2])
    keep = [c for c in results.columns if c != payload]
    rows = results.select(*keep, get("$.x_axis.unit").alias("__x_unit"), F.posexplode(found).alias("__pos", "__q"))
    p = lambda *cs: F.coalesce(*[_present(F.col(f"__q.p.{c}")) for c in cs])
    series = F.coalesce("__q.name", p("series"), F.lit(""))
    category = F.coalesce(p("category_label", "category"), F.lit(""))
    token = F.regexp_replace(F.when(series == "", "series").otherwise(series), r"[^A-Za-z0-9._-]+", "_")
    index = F.col("__pos") + 1
    out = rows.select(
        *keep,
        F.concat_ws(":", *keep, token, index.cast("string")).alias("fact_id"),
        index.cast("string").alias("point_index"),
        series.alias("series_name"),
        F.coalesce(p("x_value", "x"), F.nullif(category, F.lit("")), p("x_axis_label", "x_label"), F.lit("")).alias("x_value"),
        F.coalesce(p("x_unit"), _present(F.col("__x_unit")), F.lit("")).alias("x_unit"),
        p("y_value", "y").alias("y_value"),
        p("z_value", "z").alias("z_value"),
        category.alias("category_label"),
    )
    return out.filter("y_value IS NOT NULL OR z_value IS NOT NULL")
