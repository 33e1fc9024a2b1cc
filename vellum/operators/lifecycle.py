"""Papers, runs, jobs and assets over their life: ids, recovery, archives, reads, reports and checks as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Statuses of papers; values of usable, good and failed rows; media types by suffix.
PAPER_STATUSES = ("uploaded", "processing", "completed", "failed", "deleted")
NO_CHART, GOOD, BAD = ("no_chart_detected", "failed"), ("digitized", "partially_digitized"), ("failed", "too_low_resolution", "axis_unreadable", "legend_unreadable")
MEDIA = {"json": "application/json", "jsonl": "application/x-ndjson", "csv": "text/csv", "md": "text/markdown", "png": "image/png", "jpg": "image/jpeg", "pdf": "application/pdf"}
#: Parts of paths that tests write; parts of messages after which a call is tried again.
FAKE, RETRY = ("/batch_fake", "_fake_", "/fake_"), ("http 429", "http 502", "http 503", "http 504", "timeout", "temporarily")
#: Sources of an audit, the most trusted first.
AUDIT_SOURCES = ("running", "object", "current", "historical")


def _text(c: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))


def row_state() -> Column:
    """struct(usable, succeeded, failed) of a fact row: a point with a value, a digitized one, one that could not be."""
    status, index = _text("digitization_status"), _text("point_index")
    valued = (_text("x_value") != "") | (_text("y_value") != "") | (_text("z_value") != "")
    usable = ~index.isin("", "axis") & ~status.isin(*NO_CHART) & valued
    return F.struct(usable.alias("usable"), status.isin(*GOOD).alias("succeeded"), status.isin(*BAD).alias("failed"))


def fact_order() -> list[Column]:
    """Figure, panel, then the point's index as a number, 0 for none."""
    return [F.col("figure_id"), F.col("panel_id"), F.coalesce(F.col("point_index").try_cast("int"), F.lit(0))]


def fake_path(path: Column) -> Column:
    low, out = F.lower(path), F.lit(False)
    for part in FAKE:
        out = out | low.contains(part)
    return out | low.rlike(r"_fake/[a-z]+_audit\.json$")


def test_like(points: DataFrame, run: str) -> DataFrame:
    """run, test_like: whether there are points and all look like those that tests make."""
    sample = _text("series_name").contains("test series") | ((_text("x_unit") == "day") & (_text("y_unit") == "g") & (_text("x_axis_label") == "time") & _text("y_axis_label").contains("water uptake"))
    return points.groupBy(run).agg(F.bool_and(sample).alias("test_like"))


def live(df: DataFrame, status: str = "status") -> DataFrame:
    """Rows that are not deleted."""
    return df.filter(F.col(status) != "deleted")


def scoped(papers: DataFrame, scope: dict) -> DataFrame:
    """Papers of a scope {project_id, paper_ids, paper_statuses}; other keys and statuses are errors, an empty list takes nothing."""
    if extra := sorted(set(scope) - {"project_id", "paper_ids", "paper_statuses"}):
        raise ValueError(f"unknown scope keys: {', '.join(extra)}")
    if bad := sorted(set(scope.get("paper_statuses", ())) - set(PAPER_STATUSES)):
        raise ValueError(f"unknown paper statuses: {', '.join(bad)}")
    out = papers.filter(F.col("project_id") == int(scope["project_id"])) if "project_id" in scope else papers
    for key, col in (("paper_ids", "paper_id"), ("paper_statuses", "status")):
        if key in scope:
            out = out.filter(F.col(col).isin(*sorted(set(scope[key]))) if scope[key] else F.lit(False))
    return out


def checked_uploads(files: DataFrame, limit: int) -> DataFrame:
    """Files (size_bytes, content) with `problem`: empty, too_large, not_pdf by the first bytes, or null."""
    size, head = F.col("size_bytes"), F.substring("content", 1, 5)
    return files.withColumn("problem", F.when(size == 0, "empty").when(size > limit, "too_large").when(F.hex(head) != "255044462D", "not_pdf"))


def attempts(jobs: DataFrame, key: list[str]) -> DataFrame:
    """`jobs` (key, job_id) with attempt: jobs of the key before it, and one."""
    return jobs.withColumn("attempt", F.row_number().over(W.partitionBy(*key).orderBy("job_id")))


def next_attempt(requests: DataFrame, jobs: DataFrame, key: list[str]) -> DataFrame:
    """`requests` with the attempt number of the job that they would start."""
    n = jobs.groupBy(*key).agg(F.count("*").alias("prior"))
    return requests.join(n, key, "left").withColumn("attempt", F.coalesce("prior", F.lit(0)) + 1).drop("prior")


def new_runs(tasks: DataFrame, runs: DataFrame) -> DataFrame:
    """Tasks (task_id, ...) that have no run yet, each once: its first by attempt."""
    first = tasks.withColumn("__rn", F.row_number().over(W.partitionBy("task_id").orderBy("attempt"))).filter("__rn = 1").drop("__rn")
    return first.join(runs.select("task_id"), "task_id", "left_anti")


def finalised(runs: DataFrame, failures: DataFrame) -> DataFrame:
    """Runs (run_id, status) with those that have a failure and are not final set to failed, and its first message."""
    f = failures.groupBy("run_id").agg(F.min_by("message", "pos").alias("message"))
    hit = F.col("message").isNotNull() & ~F.col("status").isin("succeeded", "failed")
    j = runs.join(f, "run_id", "left")
    return j.withColumn("error", F.when(hit, F.col("message"))).withColumn("status", F.when(hit, "failed").otherwise(F.col("status"))).drop("message")


def archive(assets: DataFrame, reparsed: DataFrame) -> DataFrame:
    """Assets (paper_id, figure_id, is_active) with those of papers that are parsed again inactive and without a figure."""
    again = reparsed.select("paper_id").distinct().withColumn("__again", F.lit(True))
    j = assets.join(again, "paper_id", "left")
    hit = F.coalesce("__again", F.lit(False))
    return j.withColumn("is_active", F.col("is_active") & ~hit).withColumn("figure_id", F.when(~hit, F.col("figure_id"))).drop("__again")


def enqueue(requested: DataFrame, papers: DataFrame, busy: DataFrame) -> DataFrame:
    """Requests (pos, paper_id), each paper once at its first place, as queued, skipped (it has a job) or not_found (missing or deleted)."""
    first = requested.groupBy("paper_id").agg(F.min("pos").alias("pos"))
    have = live(papers).select("paper_id").distinct().withColumn("__have", F.lit(True))
    held = busy.select("paper_id").distinct().withColumn("__busy", F.lit(True))
    j = first.join(have, "paper_id", "left").join(held, "paper_id", "left")
    status = F.when(F.col("__have").isNull(), "not_found").when(F.col("__busy").isNotNull(), "skipped").otherwise("queued")
    return j.select("pos", "paper_id", status.alias("status"))


def paper_reads(papers: DataFrame, assets: DataFrame, results: DataFrame, preview: int = 500) -> DataFrame:
    """paper_id, preview, n_assets (active ones), latest (the result of the largest id): what a list of papers shows."""
    a = assets.groupBy("paper_id").agg(F.count_if("is_active").alias("n_assets"))
    e = results.groupBy("paper_id").agg(F.max_by("status", "result_id").alias("latest"))
    j = live(papers).join(a, "paper_id", "left").join(e, "paper_id", "left")
    return j.select("paper_id", F.substring(F.coalesce("body", F.lit("")), 1, preview).alias("preview"), F.coalesce("n_assets", F.lit(0)).alias("n_assets"), "latest")


def latest_job(jobs: DataFrame, kind: str) -> DataFrame:
    """paper_id, job_id: the newest job of a type for a message that names none."""
    return jobs.filter(F.col("job_type") == kind).groupBy("paper_id").agg(F.max("job_id").alias("job_id"))


def recovered(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs in work whose lease ran out: cancelled if that was asked for, else to be tried again; generation goes up by one."""
    lost = (F.col("status") == "processing") & (F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") < now))
    status = F.when(lost & F.col("cancel_requested"), "cancelled").when(lost, "retry").otherwise(F.col("status"))
    return jobs.withColumn("generation", F.col("generation") + lost.cast("int")).withColumn("status", status)


def best_audit(audits: DataFrame) -> DataFrame:
    """One audit of each paper: of the most trusted source, then of the least path; fake paths count only if they run."""
    rank = F.array_position(F.array(*map(F.lit, AUDIT_SOURCES)), F.col("source"))
    known = audits.withColumn("rank", rank).filter((F.col("rank") > 0) & ((F.col("source") == "running") | ~fake_path(F.col("path"))))
    return known.groupBy("paper_id").agg(F.min_by(F.struct("source", "path"), F.struct("rank", "path")).alias("r")).select("paper_id", "r.*")


def artifacts(files: DataFrame) -> DataFrame:
    """scope, path: one artifact of each top-level folder, nested lists before archives before flat lists, then by path."""
    name = F.element_at(F.split("path", "/"), -1)
    rank = F.when(name.rlike(r"content_list_v2.*\.json$"), 0).when(name == "result.zip", 1).when(name.endswith("content_list.json"), 2)
    f = files.withColumn("scope", F.element_at(F.split("path", "/"), 1)).withColumn("rank", rank).filter("rank IS NOT NULL")
    return f.groupBy("scope").agg(F.min_by("path", F.struct("rank", "path")).alias("path"), F.sha2(F.min_by("path", F.struct("rank", "path")), 256).alias("artifact_key"))


def ingest(listed: DataFrame, markdown_only: DataFrame) -> DataFrame:
    """Assets of content lists, then of Markdown alone, one for each (doc, file name): the first by source and place; asset_index from 0."""
    both = listed.withColumn("source", F.lit(0)).unionByName(markdown_only.withColumn("source", F.lit(1)))
    b = both.withColumn("name", F.element_at(F.split("path", "/"), -1)).filter("name <> ''")
    one = b.groupBy("doc", "name").agg(F.min_by(F.struct("source", "pos", "path"), F.struct("source", "pos", "path")).alias("r")).select("doc", "name", "r.*")
    return one.withColumn("asset_index", F.row_number().over(W.partitionBy("doc").orderBy("source", "pos", "name")) - 1)


def named_files(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """wanted (doc, name, folder) with the path of the file of that name in the folder or the nearest one above it."""
    f = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.regexp_replace("path", "/?[^/]*$", "").alias("at"), "path")
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda k: F.struct((F.size(parts) - k).alias("up"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("at")))
    w = wanted.select("doc", "name", "folder", F.explode(above).alias("a")).select("doc", "name", "folder", "a.*")
    j = w.join(f, ["name", "at"]).groupBy("doc", "name", "folder").agg(F.min_by("path", F.struct("up", "path")).alias("path"))
    return wanted.join(j, ["doc", "name", "folder"], "left")


def pdf_problem(pages: Column, chars: Column, images: Column) -> Column:
    """Why a PDF is rejected: it has no pages, or neither text nor images; else null."""
    return F.when(pages == 0, "no_pages").when((chars == 0) & (images == 0), "blank")


def model_chain(first: str, fallbacks: list[str]) -> list[str]:
    """Models to try in order, each once."""
    return list(dict.fromkeys([first, *fallbacks]))


def retryable(message: Column) -> Column:
    low, out = F.lower(F.coalesce(message, F.lit(""))), F.lit(False)
    for part in RETRY:
        out = out | low.contains(part)
    return out


def media_type(name: Column) -> Column:
    suffix = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in MEDIA.items() for x in kv]), suffix), F.lit("application/octet-stream"))


def merged_metadata(element: Column, default: Column) -> Column:
    """Entries of two string maps; those of the element win."""
    return F.map_from_entries(F.concat(F.map_entries(F.map_filter(default, lambda k, _: ~F.map_contains_key(element, k))), F.map_entries(element)))


def decision_counts(panels: DataFrame) -> DataFrame:
    return panels.groupBy("panel_decision").agg(F.count("*").alias("n")).orderBy("panel_decision")


def versions(results: DataFrame, by: str) -> DataFrame:
    """Different models and prompts of a key's results, sorted; empty ones do not count."""
    of = lambda c: F.array_sort(F.collect_set(F.nullif(c, F.lit(""))))
    return results.groupBy(by).agg(of("model_version").alias("models"), of("prompt_version").alias("prompts"))


def audit_counts(events: DataFrame) -> DataFrame:
    """Events by kind, their repairs by kind, and phases by name, as (what, name, n)."""
    of = lambda df, what, c: df.filter(F.col(c).isNotNull()).groupBy(F.lit(what).alias("what"), F.col(c).alias("name")).agg(F.count("*").alias("n"))
    repairs = events.select(F.explode("repairs").alias("repair"))
    return of(events, "event", "event_type").unionByName(of(repairs, "repair", "repair")).unionByName(of(events, "phase", "phase"))


PHONETIC_ID = r"\bfig(?:ure)?[-_\s.]*(\d+)"


def figure_key(c: Column) -> Column:
    """fig-N of any spelling of a figure's name, else empty."""
    n = F.regexp_extract(F.lower(F.trim(c)), PHONETIC_ID + r"\b", 1)
    return F.when(n != "", F.concat(F.lit("fig-"), n)).otherwise("")


def panel_key(c: Column) -> Column:
    """fig-N-x of any spelling of a panel's name, else empty."""
    form = PHONETIC_ID + r"[-_\s.]*([a-z])\b"
    n, x = (F.regexp_extract(F.lower(F.trim(c)), form, k) for k in (1, 2))
    return F.when(x != "", F.concat(F.lit("fig-"), n, F.lit("-"), x)).otherwise("")


def panel_letter(c: Column) -> Column:
    """The letter of a panel's name or of a lone letter, else empty."""
    low = F.lower(F.trim(c))
    return F.when(low.rlike("^[a-z]$"), low).otherwise(F.element_at(F.split(panel_key(c), "-"), -1))


def layout_context(page_size: Column, bbox: Column, types: Column) -> Column:
    """A line that tells a page's size, an image's place, its column and the counts of the first 50 block types; parts that lack are left out."""
    number = lambda c: F.format_string("%.0f", c)
    size = F.when(F.size(page_size) == 2, F.concat(F.lit("page_dimensions: "), page_size[0].cast("string"), F.lit("x"), page_size[1].cast("string"), F.lit("pt")))
    boxed = F.size(bbox) == 4
    place = F.when(boxed, F.concat(F.lit("image_bbox_on_page: ["), F.array_join(F.transform(bbox, number), ", "), F.lit("]")))
    middle = (bbox[0] + bbox[2]) / 2
    column = F.when(boxed & (page_size[0] > 0), F.when(middle < page_size[0] * 0.6, "layout: single_column").otherwise("layout: double_column_right"))
    first = F.slice(types, 1, 50)
    counts = F.transform(F.array_sort(F.array_distinct(first)), lambda t: F.concat(t, F.lit(": "), F.size(F.filter(first, lambda x: x == t)).cast("string")))
    blocks = F.when(F.size(first) > 0, F.concat(F.lit("page_blocks: "), F.array_join(counts, ", ")))
    return F.concat_ws(" | ", size, place, column, blocks)


def nearest_headings(blocks: DataFrame, key: list[str], pos: str = "pos", levels: int = 6) -> DataFrame:
    """Blocks (key, pos, level, title) with `headings`: of each level the last heading before the block, those that come first in the text first.

    A window for each level, no self-join; a level's heading stays until the next one of that level.
    """
    w = W.partitionBy(*key).orderBy(pos).rowsBetween(W.unboundedPreceding, -1)
    out, names = blocks, []
    for n in range(1, levels + 1):
        at = F.when((F.col("level") == n) & (F.coalesce("title", F.lit("")) != ""), F.struct(F.col(pos).alias("at"), F.lit(n).alias("level"), F.col("title").alias("title")))
        out = out.withColumn(f"__l{n}", F.last(at, ignorenulls=True).over(w))
        names.append(f"__l{n}")
    return out.withColumn("headings", F.array_sort(F.array_compact(F.array(*names)))).drop(*names)


def line_context(lines: DataFrame, key: list[str], hit: Column, before: int = 40, after: int = 159) -> DataFrame:
    """Lines (key, line_no, line) that `hit` holds for, with the text of the lines around them."""
    w = W.partitionBy(*key).orderBy("line_no").rowsBetween(-before, after)
    return lines.withColumn("context", F.array_join(F.collect_list("line").over(w), "\n")).filter(hit)
