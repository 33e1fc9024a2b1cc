"""Axes of charts: labels with units, hints, aliases in payloads, evidence ids, candidates. Native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of horizontal and of vertical axes, parts of units, words that are no unit, units of time.
X_WORDS = ("time", "day", "hour", "min", "depth", "strain", "cycle")
Y_WORDS = ("intensity", "hydrogen", "h2", "stress", "rate", "expression", "concentration", "density", "uptake", "production")
UNIT_PARTS = ("/", "^", "µ", "%", "mol", "mmol", "mg", "g", "ml", "l", "mpa", "pa", "a.u.", "hour", "hours", "day", "days", "min", "s")
LABEL_WORDS = ("time", "depth", "hydrogen", "intensity", "stress", "strain", "rate", "expression", "concentration", "density")
TIME_UNITS = ("h", "hr", "hrs", "hour", "hours", "day", "days", "min", "s", "sec", "seconds")
LENGTH_UNITS = ("%", "mm", "µm", "nm")
#: Suffix of a point's key -> unit, the longest suffix first.
KEY_UNITS = {"mmol_per_m2": "mmol/m^2", "mm_per_mm": "mm/mm", "l_per_m2": "L/m^2", "mmol_m2": "mmol/m^2", "l_m2": "L/m^2", "mpa": "MPa", "min": "min", "pa": "Pa", "h": "h"}
#: Units looked for in captions and tables.
HINT_UNITS = ("day", "h", "min", "s", "%", "a.u.", "mg", "g", "µm", "nm", "mm", "Pa", "MPa", "mg/L")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def given(c: Column) -> Column:
    """A text as such if it has one, else null."""
    return F.nullif(F.trim(c), F.lit(""))


def axis_label(c: Column) -> Column:
    """struct(label, unit): 'Name (unit)' split at the last parentheses; a text that is a unit alone is its own label."""
    text = F.trim(F.coalesce(c, F.lit("")))
    form = r"(?s)^(.*)\(([^(]*)\)[^()]*$"
    split = text.rlike(form)
    label, unit = (F.trim(F.regexp_extract(text, form, k)) for k in (1, 2))
    return F.struct(F.when(split & (label != ""), label).otherwise(text).alias("label"), F.when(split, unit).otherwise("").alias("unit"))


def key_label(key: Column, axis: str) -> Column:
    """struct(label, unit) from a point's key such as x_strain_mm_per_mm."""
    text = F.substring(key, len(axis) + 2, 10_000)
    unit, rest = F.lit(""), text
    for suffix, name in sorted(KEY_UNITS.items(), key=lambda kv: len(kv[0])):
        hit = F.lower(text).endswith("_" + suffix)
        unit = F.when(hit, name).otherwise(unit)
        rest = F.when(hit, F.substring(text, F.lit(1), F.length(text) - len(suffix) - 1)).otherwise(rest)
    return F.struct(F.trim(F.replace(rest, F.lit("_"), F.lit(" "))).alias("label"), unit.alias("unit"))


def x_like(c: Column) -> Column:
    return _any(F.lower(c), X_WORDS)


def y_like(c: Column) -> Column:
    return _any(F.lower(c), Y_WORDS)


def unit_only(c: Column) -> Column:
    text = F.trim(c)
    return (text != "") & _any(F.lower(text), UNIT_PARTS) & ~_any(F.lower(text), LABEL_WORDS) & ~text.contains("(")


def time_unit(c: Column) -> Column:
    return F.lower(F.trim(c)).isin(*TIME_UNITS)


def axis_hints(hints: Column) -> Column:
    """struct(x, y) from a list of hints: units alone if there are two, else by their words, else by their order."""
    h = F.filter(F.transform(F.coalesce(hints, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    units = F.filter(h, unit_only)
    first = lambda xs: F.coalesce(F.get(xs, F.lit(0)), F.lit(""))
    x_unit = F.coalesce(F.get(F.filter(units, lambda u: time_unit(u) | u.isin(*LENGTH_UNITS)), F.lit(0)), first(units))
    y_unit = first(F.filter(units, lambda u: u != x_unit))
    by_unit = (F.size(units) >= 2) & ~F.exists(h, lambda u: u.contains("(") & u.contains(")"))
    x_word = first(F.filter(h, x_like))
    y_word = first(F.filter(h, lambda u: (u != x_word) & y_like(u)))
    y_one = F.when((y_word == "") & (F.size(h) == 1) & (x_word == ""), first(h)).otherwise(y_word)
    x_two = F.when(~((y_word == "") & (F.size(h) == 1) & (x_word == "")) & (x_word == "") & (F.size(h) >= 2), first(h)).otherwise(x_word)
    y_two = F.when((y_one == "") & (F.size(h) >= 2), first(F.filter(h, lambda u: u != x_two))).otherwise(y_one)
    return F.struct(F.when(by_unit, x_unit).otherwise(x_two).alias("x"), F.when(by_unit, y_unit).otherwise(y_two).alias("y"))


def fill_axis(label: Column, unit: Column, hint: Column) -> Column:
    """struct(label, unit): an axis' own label and unit, else those that its hint tells; a unit of time names the axis Time."""
    told = axis_label(hint)
    alone = unit_only(hint)
    new_label = F.when(alone, F.when(time_unit(hint), "Time").otherwise("")).otherwise(told["label"])
    new_unit = F.when(alone, F.trim(hint)).otherwise(told["unit"])
    return F.struct(F.coalesce(given(label), new_label, F.lit("")).alias("label"), F.coalesce(given(unit), new_unit, F.lit("")).alias("unit"))


def axis_payload(payload: Column, axis: str) -> Column:
    """The first value of an axis in a JSON payload that is not empty: in the payload, then under axis_labels, then under axes."""
    names = (f"{axis}_axis", axis, f"{axis}_label", f"{axis}_axis_label")
    empty = ("", "0", "0.0", "false", "{}", "[]", "null")
    found = [F.get_json_object(payload, f"$.{place}{n}") for place in ("", "axis_labels.", "axes.") for n in names]
    return F.coalesce(*[F.when(~v.isin(*empty), v) for v in found])


def unit_hints(text: Column) -> Column:
    """Units of HINT_UNITS that the text holds, in their order."""
    return F.filter(F.array(*map(F.lit, HINT_UNITS)), lambda u: F.lower(text).contains(F.lower(u)))


def valid_ids(ids: Column, allowed: Column) -> Column:
    """Ids that are allowed, in their order."""
    return F.filter(F.coalesce(ids, F.array().cast("array<string>")), lambda x: F.array_contains(allowed, x))


def default_ids(evidence: Column) -> Column:
    """The first three ids of an array of struct(evidence_id, use_policy, source_type): extractable visuals, else extractable, else any."""
    named = F.filter(evidence, lambda e: F.coalesce(e["evidence_id"], F.lit("")) != "")
    usable = F.filter(named, lambda e: e["use_policy"] == "use_for_facts")
    visual = F.filter(usable, lambda e: e["source_type"].isin("chart", "image"))
    best = F.when(F.size(visual) > 0, visual).when(F.size(usable) > 0, usable).otherwise(named)
    return F.slice(F.transform(best, lambda e: e["evidence_id"]), 1, 3)


def evidence_ids(ids: Column, evidence: Column) -> Column:
    """Valid ids and the first three extractable visuals; without visuals the valid ones, else the default."""
    valid = valid_ids(ids, F.transform(evidence, lambda e: e["evidence_id"]))
    visual = F.slice(F.transform(F.filter(evidence, lambda e: (e["use_policy"] == "use_for_facts") & e["source_type"].isin("chart", "image")), lambda e: e["evidence_id"]), 1, 3)
    return F.when(F.size(visual) > 0, F.array_distinct(F.concat(valid, visual))).when(F.size(valid) > 0, valid).otherwise(default_ids(evidence))


def truthy(entries: Column, keep: list[str]) -> Column:
    """Entries of a string map whose key is listed and whose value is not empty."""
    return F.map_filter(entries, lambda k, v: k.isin(*keep) & (F.coalesce(v, F.lit("")) != ""))


def candidates(payload: Column) -> Column:
    """Heatmap candidates of a JSON payload that name a metric: array of struct(index, metric_name, value, value_min, value_max, needs_review)."""
    item = "struct<metric_name:string,name:string,type:string,value:string,value_or_range:string,estimate:string,value_range:array<string>,value_min:string,value_max:string,needs_review:boolean>"
    raw = F.coalesce(F.get_json_object(payload, "$.heatmap_candidates"), F.get_json_object(payload, "$.benchmark_candidates"))
    items = F.coalesce(F.from_json(raw, f"array<{item}>"), F.array().cast(f"array<{item}>"))
    numbered = F.transform(items, lambda c, i: F.struct((i + 1).alias("index"), c.alias("c")))

    def one(x: Column) -> Column:
        c = x["c"]
        ranged = c["value_range"].isNotNull()
        end = lambda k, own: F.coalesce(F.get(c["value_range"], F.lit(k)), own, F.lit(""))
        return F.struct(
            x["index"].alias("index"),
            F.coalesce(given(c["metric_name"]), given(c["name"]), given(c["type"])).alias("metric_name"),
            F.coalesce(given(c["value"]), given(c["value_or_range"]), given(c["estimate"]), F.lit("")).alias("value"),
            end(0, c["value_min"]).alias("value_min"),
            end(1, c["value_max"]).alias("value_max"),
            F.coalesce(c["needs_review"], ranged).alias("needs_review"),
        )

    return F.filter(F.transform(numbered, one), lambda x: x["metric_name"].isNotNull())
