"""Reports and records: fixed rows, count reports, audit and overlay documents, figure records, previews, adopted tables, phases."""

from __future__ import annotations

import csv
import io
import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.operators.lifecycle import media_type

#: Columns and rows of a CSV preview; characters of a table and of formulas in a panel's context; final statuses.
PREVIEW_COLUMNS, PREVIEW_ROWS = 12, 20
TABLE_CHARS, FORMULA_CHARS = 2000, 1000
FINAL = ("succeeded", "partial_failed", "failed", "cancelled")
#: Configuration keys that change results; all others do not.
SEMANTIC_KEYS = ("model_version", "prompt_version", "schema_version", "ontology_version", "use_classifier")
PREVIEW = "struct<headers: array<string>, rows: array<array<string>>>"


def fixed_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """The listed columns, those that lack as null: times as ISO text in UTC, nested values as canonical JSON."""
    kinds = {f.name: f.dataType for f in df.schema}

    def cell(name: str) -> Column:
        kind = kinds.get(name)
        if kind is None:
            return F.lit(None).cast("string").alias(name)
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss").alias(name)
        nested = isinstance(kind, (T.StructType, T.ArrayType, T.MapType, T.VariantType))
        return (F.to_json(name) if nested else F.col(name)).alias(name)

    return df.select(*map(cell, columns))


def count_report(tables: dict[str, DataFrame], snapshot: str) -> DataFrame:
    """One row: a Markdown report of the numbers of rows, tables by name."""
    lines = None
    for name in sorted(tables):
        one = tables[name].agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        lines = one if lines is None else lines.unionByName(one)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "n"))), lambda x: F.concat(F.lit("- "), x["name"], F.lit(": "), x["n"].cast("string"))), "\n")
    return lines.agg(F.concat(F.lit(f"# Data delivery\n\nSnapshot: {snapshot}\n\n## Record counts\n\n"), listed, F.lit("\n")).alias("report"))


def audit_documents(panels: DataFrame, run: str = "run_id") -> DataFrame:
    """run, audit, review: panels (panel_id, panel_decision, n_facts, error) as JSON by panel, and a Markdown review of decisions and errors."""
    one = F.struct("panel_id", "panel_decision", "n_facts", "error")
    g = panels.groupBy(run).agg(F.array_sort(F.collect_list(one)).alias("panels"), F.sum("n_facts").alias("facts"), F.array_sort(F.collect_set("panel_decision")).alias("kinds"))
    of = lambda k: F.size(F.filter("panels", lambda p: p["panel_decision"] == k)).cast("string")
    lines = F.transform("kinds", lambda k: F.concat(F.lit("- "), k, F.lit(": "), of(k)))
    errors = F.transform(F.filter("panels", lambda p: p["error"].isNotNull()), lambda p: F.concat(F.lit("- "), p["panel_id"], F.lit(": "), p["error"]))
    review = F.concat_ws("\n", F.lit("## Decisions"), F.array_join(lines, "\n"), F.lit("## Errors"), F.array_join(errors, "\n"))
    return g.select(run, F.to_json(F.struct(F.size("panels").alias("n_panels"), "facts", "panels")).alias("audit"), review.alias("review"))


def overlay_document(new: DataFrame, existing: DataFrame) -> DataFrame:
    """One row: JSON of metric contracts (metric_id, dimension, support), new ones before existing ones, sorted by metric."""
    both = new.select("metric_id", "dimension", "support").unionByName(existing.join(new, "metric_id", "left_anti").select("metric_id", "dimension", "support"))
    listed = F.array_sort(F.collect_list(F.struct("metric_id", "dimension", "support")))  # a bounded vocabulary of metrics
    return both.agg(F.to_json(F.struct(F.lit("overlay_v1").alias("version"), listed.alias("contracts"))).alias("document"))


def staged_outputs(files: DataFrame, run: str) -> DataFrame:
    """Files (path, content) of a run's folder: filename below it, media type, size, SHA-256."""
    name = F.regexp_replace("path", r"^.*?/" + run + "/", "")
    return files.select(F.lit(run).alias("run_id"), name.alias("filename"), media_type(name).alias("media_type"), F.octet_length("content").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def figure_records(figures: DataFrame, order: list[str]) -> DataFrame:
    """doc, filename, record: the first figure of each file name as a JSON line of all columns."""
    name = F.element_at(F.split("image_path", "/"), -1)
    w = W.partitionBy("doc", "filename").orderBy(*order)
    first = figures.withColumn("filename", name).withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
    return first.select("doc", "filename", F.to_json(F.struct(*sorted(figures.columns))).alias("record"))


def append_log(events: DataFrame, path: str, checkpoint: str):
    """A streaming query that appends events as JSON lines; each event is written once, whatever restarts."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def preview(text: str) -> tuple[list[str], list[list[str]]]:
    """(headers, rows) of a CSV text: rows that hold something, cut to PREVIEW_COLUMNS and PREVIEW_ROWS."""
    rows = [r for r in csv.reader(io.StringIO(text, newline="")) if any(c.strip() for c in r)]
    head, body = (rows or [[]])[0], rows[1 : PREVIEW_ROWS + 1]
    return head[:PREVIEW_COLUMNS], [r[:PREVIEW_COLUMNS] for r in body]


def csv_preview(df: DataFrame, text_col: str, out: str = "preview") -> DataFrame:
    """`df` with struct(headers, rows) of each CSV text; quotes may hold commas, line ends and doubled quotes. Arrow: Spark's own
    reader splits files, not cells of a column, into records."""

    @F.pandas_udf(PREVIEW)
    def read(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([preview(t or "") for t in column], columns=["headers", "rows"])

    return df.withColumn(out, read(F.col(text_col)))


def adopted(source: DataFrame, target: T.StructType, defaults: dict[str, object]) -> DataFrame:
    """Rows of another table in the target's columns and types: columns that it lacks get their default or null, others go."""
    have = {c.lower(): c for c in source.columns}
    cols = []
    for f in target:
        own = F.col(have[f.name.lower()]) if f.name.lower() in have else F.lit(None)
        filled = F.coalesce(own.cast(f.dataType), F.lit(defaults[f.name]).cast(f.dataType)) if f.name in defaults else own.cast(f.dataType)
        cols.append(filled.alias(f.name))
    return source.select(*cols)


def object_key(key: Column) -> Column:
    """A key without leading and doubled slashes and dots; one that climbs out of its folder is an error."""
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(key, r"\\", "/"), r"(^|/)(\./)+", "$1"), r"/+", "/")
    clean = F.regexp_replace(clean, r"^/+|/+$", "")
    bad = clean.rlike(r"(^|/)\.\.(/|$)") | (clean == "")
    return F.when(bad, F.raise_error(F.concat(F.lit("bad object key: "), key)).cast("string")).otherwise(clean)


def panel_contexts(items: DataFrame, key: list[str]) -> DataFrame:
    """key, caption, tables, formulas: texts of a panel's items (kind, pos, text) in order, tables and formulas cut to their lengths."""
    g = items.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "kind", "text"))).alias("all"))
    of = lambda kind, sep: F.array_join(F.transform(F.filter("all", lambda x: x["kind"] == kind), lambda x: x["text"]), sep)
    return g.select(*key, of("caption", " ").alias("caption"), F.substring(of("table", "\n"), 1, TABLE_CHARS).alias("tables"), F.substring(of("formula", "\n"), 1, FORMULA_CHARS).alias("formulas"))


def touching(edges: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """node and the edges (src, dst, relation) that start or end there, each once; two equality joins."""
    out = nodes.join(edges, F.col(node) == F.col("src"))
    back = nodes.join(edges, (F.col(node) == F.col("dst")) & (F.col("src") != F.col("dst")))
    return out.unionByName(back)


def unregistered(items: DataFrame, papers: DataFrame) -> DataFrame:
    """Batch items (batch_id, ordinal, sha256) whose file no paper has, by batch and ordinal."""
    return items.join(papers.select("sha256").distinct(), "sha256", "left_anti").orderBy("batch_id", "ordinal")


def semantic_config(config: Column) -> Column:
    """SHA-256 of the keys of a configuration (a string map) that change results, sorted."""
    kept = F.map_filter(config, lambda k, _: k.isin(*SEMANTIC_KEYS))
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept)))), 256)


def summary_counts(results: dict[str, DataFrame], by: str) -> DataFrame:
    """by, and n_<name> for each table: its rows of that key; 0 where there is none."""
    out = None
    for name, df in results.items():
        one = df.groupBy(by).agg(F.count("*").alias(f"n_{name}"))
        out = one if out is None else out.join(one, by, "full")
    return out.na.fill(0, [f"n_{name}" for name in results])


def with_fallback(payload: Column, fallback: Column) -> Column:
    """A payload that is a JSON object with a key, else the fallback."""
    return F.when(F.size(F.json_object_keys(payload)) > 0, payload).otherwise(fallback)


def compact_contract(name: str, schema: dict) -> dict:
    """What an answer must hold, from a JSON schema: its name, its fields with types, those required, values of enumerations, an empty answer."""
    fields = {k: v for k, v in schema.get("properties", {}).items() if isinstance(v, dict)}
    empty = {"array": [], "object": {}, "number": None, "integer": None, "boolean": False}
    kind = lambda v: "|".join(v["type"]) if isinstance(v.get("type"), list) else v.get("type", "any")
    return {
        "object_name": name or schema.get("title", "output"),
        "fields": {k: kind(v) for k, v in fields.items()},
        "required": list(schema.get("required", [])),
        "enums": {k: v["enum"] for k, v in fields.items() if isinstance(v.get("enum"), list)},
        "skeleton": {k: empty.get(kind(v), "") for k, v in fields.items()},
    }


def phases(panels: DataFrame, classify: Callable[[dict], dict], digitize: Callable[[dict], dict], observe: Callable[[dict], dict]) -> DataFrame:
    """panel_id, phase, payload, error: each panel classified, then digitized or observed by what its class says.

    The callables stand for a model; each gets a panel as a dict and gives one. A panel whose class fails is
    observed; a failure of a phase is a row with its message, and other panels go on.
    """
    names = panels.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for values in pdf.itertuples(index=False):
                panel = dict(zip(names, values, strict=True))
                seen: dict = {}
                for phase, call in (("classify", classify), ("digitize", digitize), ("observe", observe)):
                    if phase != "classify" and (phase == "digitize") != bool(seen.get("needs_digitization")):
                        continue
                    try:
                        got = call(panel | seen)
                        seen = got if phase == "classify" else seen
                        rows.append((panel["panel_id"], phase, json.dumps(got, sort_keys=True), None))
                    except Exception as e:  # noqa: BLE001  a model's failure is a result
                        rows.append((panel["panel_id"], phase, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["panel_id", "phase", "payload", "error"])

    return panels.mapInPandas(run, "panel_id string, phase string, payload string, error string")


def follow(status: Callable[[], str], seconds: float = 2.0, limit: float = 3600.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """Ask for a run's status until it is final; the last status when the limit is over."""
    waited, got = 0.0, status()
    while got not in FINAL and waited < limit:
        sleep(seconds)
        waited += seconds
        got = status()
    return got
