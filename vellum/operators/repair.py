"""Schema-directed repair of model payloads: typed fields and a log of what was changed."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.operators.digitize import decode_json

#: Words that stand for a number.
CONFIDENCE_WORDS = {"high": 0.9, "very high": 1.0, "medium": 0.6, "moderate": 0.6, "low": 0.3, "very low": 0.1}
#: Severity of each kind of repair that is not info.
SEVERITY = {
    "enum_value": "warn", "array_to_string": "warn", "dict_to_string": "warn", "fill_known_required": "warn", "copy_alias_property": "info",
    "drop_additional_property": "error", "noise_key_dropped": "error", "json_decode_failed": "critical", "payload_not_dict": "critical", "payload_empty": "critical",
}
#: Keys that are dropped, besides empty ones.
NOISE_KEYS = (":", ".", ",", " ", "", "null", "undefined", "none")


@dataclass(frozen=True)
class Field:
    """kind: string, number, boolean, array (of strings). Values outside enum are mapped by words; aliases are other keys."""

    kind: str
    enum: tuple[str, ...] = ()
    words: dict[str, str] = field(default_factory=dict)
    aliases: tuple[str, ...] = ()
    default: str | float | bool | None = None


def clean_key(key: Column) -> Column:
    """Without quotes, white space and leading dots."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(key), "^['\"]+|['\"]+$", ""), r"^\.+", ""))


def _log(path: str, kind: str, when: Column) -> Column:
    return F.when(when, F.struct(F.lit(path).alias("path"), F.lit(kind).alias("repair"), F.lit(SEVERITY.get(kind, "info")).alias("severity")))


def _field(name: str, spec: Field) -> tuple[Column, list[Column]]:
    """(typed value, log entries) of one field of column __clean (map of text to VARIANT)."""
    at = lambda k: F.try_element_at("__clean", F.lit(k))
    own, other = at(name), F.coalesce(*[at(a) for a in spec.aliases]) if spec.aliases else F.lit(None).cast("variant")
    v = F.coalesce(own, other)
    kind = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    text = F.try_variant_get(v, "$", "string")
    log = [_log(name, "copy_alias_property", own.isNull() & other.isNotNull())]
    is_list, is_object, is_null = kind.startswith("ARRAY"), kind.startswith("OBJECT"), kind == "VOID"
    if spec.kind == "array":
        out = F.when(is_null, F.array().cast("array<string>")).when(is_list, F.try_variant_get(v, "$", "array<string>")).otherwise(F.array(text))
        return out, [*log, _log(name, "null_to_empty_array", is_null & v.isNotNull()), _log(name, "scalar_to_array", ~is_null & ~is_list)]
    if spec.kind == "number":
        number, said = F.try_variant_get(v, "$", "double"), F.lower(F.trim(text))
        words = F.create_map(*[F.lit(x) for kv in CONFIDENCE_WORDS.items() for x in kv])
        plain = F.when(said.rlike(r"^[-+]?\d+(\.\d*)?([eE][-+]?\d+)?$"), said.cast("double"))
        out = F.when(kind == "STRING", F.coalesce(F.try_element_at(words, said), plain)).otherwise(number)
        log.append(_log(name, "string_to_number", (kind == "STRING") & out.isNotNull()))
    elif spec.kind == "boolean":
        said = F.lower(F.trim(text))
        out = F.when(kind == "STRING", F.when(said.isin("true", "yes", "1"), True).when(said.isin("false", "no", "0"), False)).otherwise(F.try_variant_get(v, "$", "boolean"))
        log.append(_log(name, "string_to_boolean", (kind == "STRING") & out.isNotNull()))
    else:
        joined = F.array_join(F.filter(F.try_variant_get(v, "$", "array<string>"), lambda x: x != ""), "; ")
        out = F.when(is_null & v.isNotNull(), F.lit("")).when(is_list, joined).when(is_object, F.to_json(v)).otherwise(text)
        log += [_log(name, "null_to_string", is_null & v.isNotNull()), _log(name, "array_to_string", is_list), _log(name, "dict_to_string", is_object), _log(name, "scalar_to_string", ~is_null & ~is_list & ~is_object & (kind != "STRING"))]
        if spec.enum:
            mapped = F.try_element_at(F.create_map(*[F.lit(x) for kv in (spec.words or {"": ""}).items() for x in kv]), F.lower(out))
            wrong = ~out.isin(*spec.enum) & mapped.isNotNull()
            log.append(_log(name, "enum_value", wrong))
            out = F.when(wrong, mapped).otherwise(out)
    if spec.default is not None:
        log.append(_log(name, "fill_known_required", out.isNull()))
        out = F.coalesce(out, F.lit(spec.default))
    return out, log


def repair(payloads: DataFrame, spec: dict[str, Field], payload: str = "payload") -> DataFrame:
    """`payloads` with a typed column for each field, repairs (path, repair, severity) and degraded.

    The answer's JSON is decoded (fences allowed), its keys cleaned, noise keys and keys outside the
    schema dropped; fields are coerced to their kinds. One expression tree for each schema, no Python worker.
    """
    keep = [c for c in payloads.columns if c != payload]
    json = decode_json(F.col(payload))
    d = payloads.withColumn("__json", json).withColumn("__kind", F.coalesce(F.schema_of_variant("__json"), F.lit("")))
    d = d.withColumn("__raw", F.when(F.col("__kind").startswith("OBJECT"), F.try_variant_get("__json", "$", "map<string,variant>")))
    entries = F.transform(F.map_entries(F.coalesce("__raw", F.expr("cast(map() as map<string,variant>)"))), lambda e: F.struct(clean_key(e["key"]).alias("key"), e["value"].alias("value")))
    d = d.withColumn("__entries", entries)
    noise = lambda e: F.lower(e["key"]).isin(*NOISE_KEYS)
    known = [*spec, *[a for s in spec.values() for a in s.aliases]]
    good = F.filter("__entries", lambda e: ~noise(e) & e["key"].isin(*known))
    keys = F.array_distinct(F.transform(good, lambda e: e["key"]))
    d = d.withColumn("__good", good).withColumn("__keys", keys)
    last = F.transform("__keys", lambda k: F.element_at(F.filter("__good", lambda e: e["key"] == k), -1)["value"])
    d = d.withColumn("__clean", F.map_from_arrays("__keys", last))
    fields, logs = {}, []
    for name, s in spec.items():
        fields[name], log = _field(name, s)
        logs += log
    dropped = lambda test, kind: F.transform(F.filter("__entries", test), lambda e: F.struct(e["key"].alias("path"), F.lit(kind).alias("repair"), F.lit("error").alias("severity")))
    whole = [
        _log("", "json_decode_failed", F.col("__json").isNull()),
        _log("", "payload_not_dict", F.col("__json").isNotNull() & F.col("__raw").isNull()),
        _log("", "payload_empty", F.col("__raw").isNotNull() & (F.size("__entries") == 0)),
    ]
    all_logs = F.concat(F.array_compact(F.array(*whole, *logs)), dropped(noise, "noise_key_dropped"), dropped(lambda e: ~noise(e) & ~e["key"].isin(*known), "drop_additional_property"))
    out = d.select(*keep, *[c.alias(n) for n, c in fields.items()], all_logs.alias("repairs"))
    n = lambda s: F.size(F.filter("repairs", lambda r: r["severity"] == s))
    return out.withColumn("degraded", (n("critical") >= 1) | (n("error") >= 3) | (F.size("repairs") >= 12))
