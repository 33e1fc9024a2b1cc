"""Literal fixtures for sources, markers, graphs, folds, sinks and streams."""

import json
import random
import re
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from vellum.functions import units
from vellum.operators import assets, audit, captions, digitize, graph, heatmap, markers, matching, ontology, relational, repair, scheduling, spatial
from vellum.plans import reports as report_plans
from vellum.sources import files, sinks
from vellum.streaming import queues


def block_files(spark, tmp_path, pages, name="doc.json"):
    (tmp_path / name).write_text(json.dumps(pages) if not isinstance(pages, str) else pages)
    return files.whole_files(spark, f"file://{tmp_path}/{name}")


def test_blocks_and_noise(spark, tmp_path):
    page = [
        {"type": "page_header", "content": "h"}, {"type": "title", "content": "Intro", "text_level": 1}, {"type": "page_number", "content": "1"},
        {"type": "page_footnote", "content": "f"}, {"type": "page_aside_text", "content": "x"}, {"type": "paragraph", "content": "Body", "bbox": [0, 1, 2, 3]},
        {"type": "page_footer", "content": "y"},
    ]
    b = files.load_blocks(block_files(spark, tmp_path, [page, [{"type": "list", "content": {"list_type": "reference_list"}, "bbox": [1, 2, 3]}]]))
    kept, filtered = graph.filter_noise(b)
    got = [(r["type"], r["reading_order"], r["global_order"], r["old_order"], r["bbox"]) for r in kept.orderBy("global_order").collect()]
    assert got == [("heading", 0, 0, 1, None), ("text", 1, 1, 5, [0.0, 1.0, 2.0, 3.0]), ("reference", 0, 2, 7, None)]
    assert filtered.count() == 5


@pytest.mark.parametrize("bad", ["{}", "[1, 2", '[{"type": "text"}]'])
def test_bad_block_files(spark, tmp_path, bad):
    with pytest.raises(Exception, match="not a list of pages"):
        files.load_blocks(block_files(spark, tmp_path, bad)).collect()


def test_layout(spark, tmp_path):
    pages = {"pages": [{"page_idx": 3, "preproc_blocks": [{"type": "image", "bbox": [0, 0, 5, 5]}, {"type": "text", "bbox": [1]}]}, {"blocks": [{"type": "text", "bbox": [1, 2, 3, 4]}]}]}
    got = files.load_layout(block_files(spark, tmp_path, pages, "layout.json")).orderBy("page").collect()
    assert [(r["page"], r["type"]) for r in got] == [(1, "text"), (3, "image")]
    assert files.load_layout(block_files(spark, tmp_path, "nonsense", "broken.json")).count() == 0


def test_markdown(spark):
    md = spark.createDataFrame([("p", "# A\ntext\n![Fig 1](./img/a.png)\n## B\n\n![x](b.png \"t\")\n| h | u |\n|---|---|\n| 1 | 2 |\n| bad |\n| 3 | 4 |\nend")], "path string, value string")
    got = files.markdown_images(md).orderBy("line_no").collect()
    assert [(r["section"], r["alt"], r["image"]) for r in got] == [("A", "Fig 1", "img/a.png"), ("B", "x", "b.png")]
    assert md.select(files.markdown_table(F.col("value"), "| h").alias("t")).first()["t"] == [["h", "u"], ["1", "2"], ["3", "4"]]


def test_zip_and_discovery(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/full.md", "# hi")
        z.writestr("y.md", "lo")
        z.writestr("z.txt", "no")
    got = files.zip_members(spark, f"file://{tmp_path}", ".md")
    assert {(r["name"], bytes(r["content"])) for r in got.collect()} == {("x/full.md", b"# hi"), ("y.md", b"lo")}
    assert files.preferred_member(got.select("archive", "name"), ["full.md"]).first()["name"] == "x/full.md"
    with pytest.raises(Exception, match="uncompressed size"):
        files.zip_members(spark, f"file://{tmp_path}", ".md", limit=3).collect()
    (tmp_path / "b.pdf").write_bytes(b"%PDF-")
    assert [(r["size_bytes"], r["ordinal"]) for r in files.discover(spark, f"file://{tmp_path}").collect()] == [(5, 0)]


def test_image_sizes(spark):
    png = bytes.fromhex("89504E470D0A1A0A0000000D49484452000001000000002A08060000")
    df = spark.createDataFrame([(bytearray(png),), (bytearray(b"GIF89a"),)], "c binary").select(files.png_size(F.col("c")).alias("s"))
    assert [r["s"] and tuple(r["s"]) for r in df.collect()] == [(256, 42), None]
    assert files.jpeg_size(b"\xff\xd8\xff\xe0\x00\x04\x00\x00\xff\xc0\x00\x11\x08\x00\x10\x00\x20\x03" + bytes(9)) == (32, 16)


@pytest.mark.parametrize(
    ("caption", "want"),
    [("(a) one; (b) two", "ab"), ("a) one b) two", "ab"), ("a. one", "a"), ("a: one", "a"), ("(a-d) Shared (e) Control", "abcde"), ("p (a) of", "a"), ("p < (a)", ""), ("n = (a)", ""), ("z stack (a)", ""), ("", "")],
)
def test_markers(caption, want):
    assert "".join(m[0] for m in markers.find_markers(caption)) == want


def test_marker_groups():
    got = {m[0]: (m[3], m[4]) for m in markers.find_markers("(a-d) Shared (e) Control")}
    assert got["a"] == (0.68, "grouped_shared") and got["e"] == (0.95, "exact")


def test_figures_and_packets(spark):
    rows = [("d", 0, 0, "p0", "heading", "Intro", None, None), ("d", 0, 1, "p1", "image", "", "Fig. 1 (a)", [0.0, 0.0, 9.0, 9.0]), ("d", 0, 2, "p2", "image", "", None, [0.0, 20.0, 9.0, 29.0]), ("d", 0, 3, "p3", "text", "near", None, None), ("d", 0, 9, "p4", "text", "far", None, None)]
    b = spark.createDataFrame(rows, "doc string, page int, global_order int, block_id string, type string, text string, caption string, bbox array<double>")
    f = graph.figures(b)
    assert {(r["block_id"], r["figure_id"], r["panel_id"]) for r in f.collect()} == {("p1", "fig-1", "fig-1-a"), ("p2", "fig-1", "fig-1-b")}
    e = graph.packets(graph.select_evidence(f, b)).filter("panel_id = 'fig-1-a'")
    assert {(r["block_id"], r["bucket"]) for r in e.collect()} == {("p0", "heading"), ("p1", "visual"), ("p2", "sibling"), ("p3", "local_text"), ("p4", "background")}


@pytest.mark.parametrize(
    ("statuses", "want"),
    [(["succeeded", "reused"], "succeeded"), (["succeeded", "failed"], "partial_failed"), (["failed"], "failed"), (["cancelled"], "cancelled"), (["succeeded", "cancelled"], "failed"), (["pending", "failed"], "pending")],
)
def test_status_fold(spark, statuses, want):
    df = spark.createDataFrame([(1, s) for s in statuses], "k int, s string")
    assert relational.fold_status(df, ["k"], F.col("s")).first()["run_status"] == want


def test_clusters_same_as_a_slow_fold(spark):
    rng = random.Random(3)
    boxes = [(p, i, [x := rng.random() * 400, y := rng.random() * 400, x + 40.0, y + 30.0]) for p in range(8) for i in range(12)]
    got = {(r["page"], r["id"]): r["cluster"] for r in spatial.greedy_clusters(spark.createDataFrame(boxes, "page int, id int, bbox array<double>"), ["page"]).collect()}
    for page in range(8):
        unions = []
        for _, i, b in sorted((x for x in boxes if x[0] == page), key=lambda x: (x[2][1], x[2][0], x[1])):
            near = [k for k, u in enumerate(unions) if max(0, b[0] - u[2], u[0] - b[2]) <= 60 and max(0, b[1] - u[3], u[1] - b[3]) <= 70]
            k = near[0] if near else len(unions)
            unions[k : k + 1] = [[min(unions[k][0], b[0]), min(unions[k][1], b[1]), max(unions[k][2], b[2]), max(unions[k][3], b[3])] if near else b]
            assert got[(page, i)] == k


def test_unit_traps(spark):
    df = spark.createDataFrame([("%",), ("mm",), ("Pa",), ("bar",), ("",), (None,)], "u string").select(units.unit_dimension(F.col("u")).alias("d"))
    assert [r["d"] for r in df.collect()] == ["signal", "concentration", "stress", "pressure", "", ""]
    df = spark.createDataFrame([("phosphate",), ("biomass",), ("Growth-Rate",), ("",), (None,), ("yield",)], "m string").select(units.metric_dimension(F.col("m")).alias("d"))
    assert [r["d"] for r in df.collect()] == ["acidity", "mass", "rate", "", "", "fraction"]


def test_snapshot_and_append(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    m = [tuple(r) for i in (1, 2) for r in sinks.write_snapshot({"t": (df, ["k"])}, f"file://{tmp_path}/{i}").collect()]
    assert m[0] == m[1] and m[0][:2] == ("t", 2)
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    assert [r["k"] for r in sinks.new_rows(old, df, ["k"], "v").collect()] == [2]
    with pytest.raises(Exception, match="another digest"):
        sinks.new_rows(old, spark.createDataFrame([(1, "z")], "k int, v string"), ["k"], "v").collect()
    sinks.write_json_lines(df, f"file://{tmp_path}/j", ["k"])
    assert [r["value"] for r in spark.read.text(f"file://{tmp_path}/j").orderBy("value").collect()] == ['{"k":1,"v":"a"}', '{"k":2,"v":"b"}']
    sinks.write_panel_csv(df.withColumn("panel_id", F.when(F.col("k") == 1, "a/b")), f"file://{tmp_path}/c", {"run": "r1"})
    assert {p.name for p in (tmp_path / "c").iterdir() if p.is_dir()} == {"panel_file=a_b", "panel_file=unknown_panel"}


def test_stream_leases_same_as_replay(spark):
    got = {r["event_id"]: (r["generation"], r["outcome"]) for r in queues.finished(queues.lease(queues.event_stream(spark, "/root/testdata/sf0.001"), 3600)).collect()}
    state, want = {}, {}
    for r in spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts", "event_id").collect():
        at, (until, gen) = r["ts"].timestamp(), state.get(r["user_id"], (-1, 0))
        if r["event_type"] == "view":
            out = "busy" if until > at else "claimed"
            until, gen = (until, gen) if until > at else (at + 3600, gen + 1)
        elif until <= at:
            out = "fenced"
        elif r["event_type"] == "purchase":
            out, until = "released", -1
        else:
            out, until = "renewed", at + 3600
        state[r["user_id"]], want[r["event_id"]] = (until, gen), (gen, out)
    assert got == want


def test_points_of_all_shapes(spark):
    payload = {
        "data_points": [{"x": 1, "y": 2, "y_unit": "mM"}, {"x": 1, "y": 2, "y_unit": "mM"}, {"values": {"a": 3, "b": 4}, "gene": "g"}, {"type": "boxplot", "min": 1, "median": 2.5, "label": "s"}, "noise"],
        "series": [{"name": "s1", "points": [{"x": "Day 2", "y": 5}, {"points": [{"x": 7, "y": 0.0, "z": "high"}]}]}, {"s2": {"data_points": [{"x": 9, "y": 9, "value_source": "table_exact", "x_axis_label": "t", "y_axis_label": "c", "x_unit": "h", "y_unit": "M"}]}}],
    }
    df = spark.createDataFrame([("p", "f", "a", "text ```json\n" + json.dumps(payload) + "\n``` end"), ("p", "f", "b", "no json")], "paper_id string, figure_id string, panel_id string, payload string")
    pts = digitize.gate_points(digitize.dedupe_points(digitize.explode_points(df), ["paper_id", "figure_id", "panel_id"]))
    got = [(r["series_name"], r["x_value"], r["category_label"], r["y_value"], r["z_text"], r["gated_confidence"]) for r in pts.orderBy("point_index").collect()]
    assert got == [
        ("", 1.0, "", 2.0, None, 0.5), ("g", None, "a", 3.0, None, 0.5), ("g", None, "b", 4.0, None, 0.5), ("", None, "min", 1.0, None, 0.5), ("", None, "median", 2.5, None, 0.5),
        ("s1", None, "Day 2", 5.0, None, 0.5), ("s1", 7.0, "", 0.0, "high", 0.5), ("s2", 9.0, "", 9.0, None, 0.5),
    ]
    assert [r["needs_verification"] for r in pts.orderBy("point_index").collect()] == [True] * 7 + [False]
    results = spark.createDataFrame([("p", "f", "a", 0.7, "digitized"), ("p", "f", "c", 0.4, None)], "paper_id string, figure_id string, panel_id string, result_confidence double, digitization_status string")
    events = spark.createDataFrame([("p", "f", "a", 0, "failed", "x"), ("p", "f", "d", 1, "skipped", "visual_asset_too_small"), ("p", "f", "d", 2, "failed", "y")], "paper_id string, figure_id string, panel_id string, pos int, event string, reason string")
    facts = {(r["panel_id"], r["point_index"], r["digitization_status"]) for r in digitize.fact_rows(pts, results, events).collect()}
    assert facts == {("a", str(i), "digitized") for i in range(8)} | {("c", "axis", "unknown"), ("d", "", "too_low_resolution")}


def test_small_expressions(spark):
    one = spark.range(1).select(
        digitize.cap(F.array(F.lit("missing_x_axis_label"), F.lit("missing_y_axis_label"))).alias("a"), digitize.cap(F.array(F.lit("axis_readability_unknown"))).alias("b"),
        digitize.repair_summary(F.array(*[F.lit("error")] * 3)).alias("c"), digitize.repair_summary(F.array(F.lit("warn"))).alias("d"),
        heatmap.axis_values(F.array().cast("array<double>"), F.lit(0.0), F.lit(10.0)).alias("e"), heatmap.axis_values(F.array(F.lit(2.0), F.lit(1.0), F.lit(2.0)), F.lit(None), F.lit(None)).alias("f"),
        digitize.natural_key(F.lit("s"), F.lit("b"), F.lit(3), F.lit('{"b":1,"a":2}')).alias("g"), digitize.natural_key(F.lit("s"), F.lit("b"), F.lit(3), F.lit('{"a": 2, "b": 1}')).alias("h"),
        digitize.result_reasons(F.lit("failed"), F.lit("readable"), F.lit(None).cast("string")).alias("i"),
    ).first()
    assert (one["a"], one["b"], one["c"], one["d"]) == (0.55, 0.6, True, False)
    assert one["e"] == [0.0, 2.5, 5.0, 7.5, 10.0] and one["f"] == [1.0, 2.0]
    assert one["g"] == one["h"] and one["g"].startswith("s:b:00000003:")
    assert one["i"] == ["digitization_status_failed", "calibration_status_unknown"]


def test_audit_rebuild(spark):
    cols = "panel_id string, point_index string, x_value string, y_value string, z_value string, digitization_status string"
    facts = spark.createDataFrame([("a", "axis", "", "", "", "digitized"), ("b", "1", "x", "", "", ""), ("c", "", "", "", "", "failed"), (None, "", "", "", "", "")], cols)
    rebuilt = spark.createDataFrame([("a", "1", "Day 2", "1800", "", ""), ("a", "2", "Day 30", "1200", "", ""), ("b", "1", "no", "", "", ""), ("d", "1", "x", "0.0", "0.3", "")], cols)
    got = sorted((r["panel_id"] or "", r["point_index"], r["x_value"]) for r in audit.rebuild_facts(facts, rebuilt).collect())
    assert got == [("", "", ""), ("a", "1", "Day 2"), ("a", "2", "Day 30"), ("b", "1", "x"), ("c", "", ""), ("d", "1", "x")]
    packets = spark.createDataFrame([("a", "x/1.png", 0), ("a", "y/2.png", 1), ("a", "", 2)], "panel_id string, image_ref string, pos int")
    assert audit.panel_images(packets).first()["image"] == "2.png"
    rows = audit.string_matrix(facts, {"panel": ["panel_id"], "gone": []}, ["point_index", "panel_id"], 2)
    assert [(r["gone"], r["total"]) for r in rows.collect()] == [("", 4)] * 2


def test_assets(spark):
    a = lambda *v: spark.createDataFrame([v], "w int, h int, size int, caption string, near string, panel string, kind string")
    c = F.col
    skip = assets.skip_reason(c("w"), c("h"), c("size"), c("caption"), c("near"))
    out = lambda *v: tuple(a(*v).select(skip, assets.asset_readiness(skip, c("caption"), c("panel")), assets.image_readability(c("w"), c("h")), assets.evidence_shape(c("kind"), c("caption"), c("near"), F.lit(0.0))).first())
    assert out(10, 40, 5, "", " ", None, "image") == ("too small: 10x40; file too small: 5 bytes; missing caption and nearby context", "skip", "too_small", "conceptual_schematic")
    assert out(100, 400, 5000, "SEM image", "", None, "image") == (None, "ready", "low_resolution", "microscopy_structure")
    assert out(None, 400, 5000, "growth", "", "a", "chart") == (None, "low_confidence", "unknown", "experimental_performance_plot")


def test_layout_blocks_do_not_carry_their_page(spark):
    # each block came with the VARIANT of its whole page, which grew with the square of a page's blocks
    file = json.dumps([{"page_idx": 2, "preproc_blocks": [{"type": f"t{i}", "bbox": [0, 0, i, 1]} for i in range(3)]}, {"page_id": 7, "blocks": [{"bbox": [1, 2, 3, 4]}]}, 5, {"blocks": 1}])
    f = spark.createDataFrame([("a", file), ("b", '{"x": {"blocks": [{"bbox": [1, 2, 3, 4]}]}}'), ("c", '{"pages": 3}'), ("d", None)], "path string, value string")
    got = files.load_layout(f)
    assert sorted((r["doc"], r["page"], r["pos"], r["type"] or "", r["bbox"][2]) for r in got.collect()) == [("a", 2, 0, "t0", 0.0), ("a", 2, 1, "t1", 1.0), ("a", 2, 2, "t2", 2.0), ("a", 7, 0, "", 3.0)]
    plan = got._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Generate":
        plan = plan.children().head()
    assert plan.schema().simpleString().count("variant") == 1


def test_layout_files_of_a_brand_stay_small(spark, tmp_path, monkeypatch):
    # a brand was one file, however many parts it has; rows without a key or of no brand are as in the SQL
    rows = [(i * 9_999, "b/1" if i % 2 else None, f"t{i}", i) for i in range(40)] + [(None, "b/1", "a", 9)]
    spark.createDataFrame(rows, "p_partkey bigint, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    seen, load = [], files.load_layout
    monkeypatch.setattr(files, "load_layout", lambda f: seen.append(f) or load(f))
    got = report_plans.loaded_layout(spark, f"file://{tmp_path}").collect()
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    assert sorted(map(tuple, got), key=str) == sorted(con.execute(report_plans.ORACLE["loaded_layout"]).fetchall(), key=str)
    assert seen[0].filter("path is not null").count() == 20


def test_ontology(spark):
    rows = [("r", "growth rate", "1/h", "p1", 0), ("r", "growth rate", "1/s", "p2", 1), ("r", "pore size", "inch", "p1", 2), ("r", "pore size", "nm", "p1", 2), ("r", "yield", "kg", "p1", 3), ("other", "growth rate", "1/h", "p3", 4)]
    df = spark.createDataFrame([(r, m, u, p, "f", "a", "", ["e"], None, 0.5, i) for r, m, u, p, i in rows], "rejection_reason string, metric_name string, unit string, paper_id string, figure_id string, panel_id string, evidence_text string, evidence_ids array<string>, group_id string, confidence double, pos int")
    got = ontology.gap_candidates(df, ["r"])
    assert {(r["metric_name"], r["support_count"], r["approval_status"], round(r["proposal_confidence"], 3)) for r in got.collect()} == {("growth rate", 2, "auto_accepted_overlay", 0.65), ("pore size", 1, "auto_proposed_review_required", 0.65)}
    assert [tuple(r) for r in ontology.overlay(got).collect()] == [("growth rate", "rate", 2)]
    pairs = spark.createDataFrame([("m", "mg / L"), ("m", "kg"), ("m", ""), ("n", "x")], "metric string, unit string")
    contract = spark.createDataFrame([("m", ["mg/L"])], "metric string, units array<string>")
    assert {(r["metric"], r["unit"], r["allowed"]) for r in ontology.unit_allowed(pairs, contract).collect()} == {("m", "mg / L", True), ("m", "kg", False), ("m", "", False), ("n", "x", True)}


def test_metric_dimension_reads_a_name_once(spark):
    # the text was made again for each of 133 terms, which took 0.8 ms a row
    named = spark.createDataFrame([("a",)], "m string").select(units.metric_dimension(F.col("m")).alias("d"))
    plan = named._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1
    terms = [t for t, _ in units.METRIC_RULES] + [t for ts in units.METRIC_TERMS.values() for t in ts]
    names = [*terms, *(f"{a} {b}" for a in terms[::7] for b in terms[::5]), "x", "", " -", "Peak_Load (N)", "Half-Life", "%"]

    def plain(name):
        text = re.sub("[^a-z0-9%]+", " ", name.lower()).strip()
        by_rule = [d for t, d in units.METRIC_RULES if t in text.replace(" ", "_")]
        return [*by_rule, *(d for d, ts in units.METRIC_TERMS.items() for t in ts if t.lower() in text), ""][0]

    got = spark.createDataFrame([(x,) for x in names], "m string").select("m", units.metric_dimension(F.col("m")).alias("d")).collect()
    assert [(r["m"], r["d"]) for r in got] == [(x, plain(x)) for x in names]


def test_overlay_takes_the_last_dimension_and_counts_nulls(spark):
    rows = [("1/h", "rate", "p1", None, 0), ("1/h", "rate", "p2", None, 1), ("cm", "size", "p1", "f", 2), ("cm", "size", "p2", "f", 3), ("1/h", "rate", "p1", None, 4)]
    df = spark.createDataFrame([("r", "other", u, p, f, "a", t, ["e"], None, 0.5, i) for u, t, p, f, i in rows], "rejection_reason string, metric_name string, unit string, paper_id string, figure_id string, panel_id string, evidence_text string, evidence_ids array<string>, group_id string, confidence double, pos int")
    c = ontology.gap_candidates(df, ["r"])
    assert [tuple(r) for r in ontology.overlay(c).collect()] == [("other", "rate", 2)]
    assert [tuple(r) for r in ontology.overlay(c.filter("pos < 4")).collect()] == [("other", "length", 2)]


def test_repair(spark):
    spec = {
        "kind": repair.Field("string", enum=("trend", "other"), words={"qualitative_trend": "trend"}),
        "score": repair.Field("number", aliases=("confidence",), default=0.4),
        "ok": repair.Field("boolean"),
        "ids": repair.Field("array"),
        "note": repair.Field("string"),
    }
    good = {"kind": "qualitative_trend", " '.confidence' ": "high", "ok": "yes", "ids": "e1", "note": ["a", "", "b"], "": 1, "extra": {}}
    df = spark.createDataFrame([(0, json.dumps(good)), (1, "nope"), (2, "[1]"), (3, '```json\n{"ok": true, "ids": ["x"], "note": 5, "score": 0.7, "kind": "trend"}\n```'), (4, "{}")], "k int, payload string")
    got = {r["k"]: r for r in repair.repair(df, spec).collect()}
    assert tuple(got[0])[1:6] == ("trend", 0.9, True, ["e1"], "a; b")
    assert {(r["path"], r["repair"]) for r in got[0]["repairs"]} == {("kind", "enum_value"), ("score", "copy_alias_property"), ("score", "string_to_number"), ("ok", "string_to_boolean"), ("ids", "scalar_to_array"), ("note", "array_to_string"), ("", "noise_key_dropped"), ("extra", "drop_additional_property")}
    assert [got[k]["degraded"] for k in range(5)] == [False, True, True, False, True]
    assert tuple(got[3])[1:6] == ("trend", 0.7, True, ["x"], "5") and [r["repair"] for r in got[3]["repairs"]] == ["scalar_to_string"]


def test_heatmap(spark):
    boxes = ['[0.1, 0.2, 0.5, 0.6]', '{"left": 10, "top": 20, "right": 300, "bottom": 60}', '{"x": 1, "y": 2, "width": 3, "height": 4}', "[5, 5, 5, 9]", '{"x": 1}']
    df = spark.createDataFrame([(i, b) for i, b in enumerate(boxes)], "k int, b string")
    got = [r["box"] for r in df.select("k", heatmap.coerce_box(F.parse_json("b"), F.lit(200), F.lit(100)).alias("box")).orderBy("k").collect()]
    assert got == [[20, 20, 100, 60], [10, 20, 199, 60], [1, 2, 4, 6], None, None]
    p = spark.createDataFrame([("a", [0.0, 0.0, 4.0, 2.0], [1.0, 2.0], [10.0])], "panel string, bbox array<double>, xs array<double>, ys array<double>")
    assert [(r["x_value"], r["y_value"], r["px"], r["py"]) for r in heatmap.grid(p, "xs", "ys").orderBy("i").collect()] == [(1.0, 10.0, 1, 1), (2.0, 10.0, 3, 1)]
    palette = F.array(*[F.struct(F.array(*map(F.lit, c)).alias("rgb"), F.lit(v).alias("value")) for c, v in (((0, 0, 0), 0.0), ((255, 255, 255), 1.0), ((0, 0, 0), 9.0))])
    assert spark.range(1).select(heatmap.nearest_value(F.array(F.lit(9), F.lit(9), F.lit(9)), palette)).first()[0] == 0.0


def test_matching(spark):
    refs = spark.createDataFrame([("d", "img/A.png"), ("d", "b.png"), ("e", "img/A.png")], "doc string, image string")
    blocks = spark.createDataFrame([("d", "p1", "x/img/a.png", 1), ("d", "p0", "x/img/A.png", 2), ("d", "p2", "other/img/A.png", 0), ("d", "p3", "c.png", 3)], "doc string, block_id string, image_path string, global_order int")
    assert {(r["image"], r["block_id"]) for r in matching.refs_to_blocks(refs, blocks).collect()} == {("img/A.png", "p2")}
    results = spark.createDataFrame([("p", "a", "z/1.png"), ("p", "b", "z/2.png"), ("p", "c", "no")], "paper_id string, panel_id string, image_ref string")
    own = spark.createDataFrame([("p", 7, "a", "q/9.png"), ("p", 8, None, "q/2.PNG")], "paper_id string, asset_id int, panel_id string, path string")
    assert {(r["panel_id"], r["asset_id"]) for r in matching.results_to_assets(results, own).collect()} == {("a", 7), ("b", 8), ("c", None)}
    named = spark.createDataFrame([(1, ["x/1.png", "2.png"])], "asset_id int, names array<string>")
    t = lambda *rows: spark.createDataFrame(list(rows), "source_image string, row_id int")
    assert tuple(matching.assets_to_rows(named, {"facts": t(("k/2.png", 5), ("2.png", 4)), "observations": t(("1.png", 1))}).first()) == (1, "facts", 4)
    titles = spark.createDataFrame([("A study of gels.pdf",), ("Nothing",)], "title string")
    names = spark.createDataFrame([("study of gels", 1), ("Study", 9), ("study of gels!", 2)], "name string, quality int")
    assert [tuple(r) for r in matching.contained_titles(titles, names).collect()] == [("A study of gels.pdf", "study of gels!", 2, 13)]


def test_schedule(spark):
    items = spark.createDataFrame(
        [("b", 1, 10, 0, "h1", "c", False), ("b", 2, 11, 1, "h2", "c", False), ("b", 3, 12, 2, "h3", "c", False), ("b", 4, 12, 3, "h3", "c", False), ("b", 5, 13, 4, "h5", "c", True), ("b", 6, 14, 5, "h6", "c", False), ("b", 7, 15, 6, "h7", "c", False), ("b", 8, 16, 7, "h2", "c", False)],
        "batch_id string, item_id int, paper_id int, ordinal int, sha256 string, config string, retry boolean",
    )
    batches = spark.createDataFrame([("b", 4)], "batch_id string, concurrency int")
    jobs = spark.createDataFrame([("b", 10, "c", "processing"), ("x", 13, "c", "failed"), ("x", 14, "c", "failed")], "batch_id string, paper_id int, config string, status string")
    runs = spark.createDataFrame([(5, "h2", "c", "succeeded"), (6, "h2", "other", "succeeded"), (7, "h3", "c", "failed")], "run_id int, sha256 string, config string, status string")
    got = {r["item_id"]: (r["decision"], r["run_id"]) for r in scheduling.schedule(items, batches, jobs, runs).collect()}
    assert got == {1: ("waiting", None), 2: ("reused", 5), 3: ("queued", None), 4: ("waiting", None), 5: ("queued", None), 6: ("failed", None), 7: ("queued", None), 8: ("left", None)}


def test_captions(spark):
    df = spark.createDataFrame([("Fig. 2a, b and 3(c) differ; see panel d",)], "s string")
    r = df.select(captions.figure_panels(F.col("s")).alias("p"), captions.sentence_labels(F.col("s"), F.lit("2")).alias("l")).first()
    assert [(x["figure"], x["label"]) for x in r["p"]] == [("2", "a"), ("2", "b"), ("3", "c")] and r["l"] == ["a", "b", "c", "d"]
    c = spark.createDataFrame([("p", "a", "2", "a growth before and after 5 %"), ("p", "a", "2", "a Fig. 2 overview"), ("p", "a", "2", "b other"), ("p", "a", "2", "a see Fig. 2b")], "panel string, label string, figure string, candidate string")
    assert [x["candidate"] for x in captions.best_captions(c, ["panel"]).collect()] == ["a growth before and after 5 %"]
    m = spark.range(1).select(captions.merge_captions(F.lit("a b c"), F.lit("b  c")).alias("x"), captions.merge_captions(F.lit("a"), F.lit("b")).alias("y")).first()
    assert tuple(m) == ("a b c", "a b")


def test_running_summary(spark):
    lines = ['{"event":"chart_facts_extracted","fact_count":3,"panel_id":"a"}', '{"event":"chart_facts_extracted","fact_count":2,"panel_id":"b"}', "broken", '{"phase_name":"x_failed","message":"m1"}', '{"event":"metric_candidates_created","candidate_count":4}', '{"exception_type":"E","message":"m2","event":"chart_digitization_completed"}']
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "run_id int, pos int, line string").select("run_id", "pos", F.try_parse_json("line").alias("event"))
    r = audit.running_summary(df).first()
    assert tuple(r)[1:] == (6, 2, 3, 4, 0, 0, 1, 2, "m1", "chart_digitization_completed")
    out = audit.with_progress(spark.createDataFrame([(3, 2), (0, 0), (2, 5)], "t int, d int"), F.col("t"), F.col("d"))
    assert [x["progress_percent"] for x in out.collect()] == [66, 0, 100]
    states = spark.createDataFrame([(1, 0, 0, 0, 9), (0, 1, 0, 0, 9), (0, 0, 0, 0, 9), (0, 0, 0, 0, 0)], "m int, f int, o int, g int, e int").select(audit.result_state(*map(F.col, "mfoge")).alias("s"))
    assert [x["s"] for x in states.collect()] == ["benchmark_metrics_ready", "chart_facts_ready", "pipeline_errors", "semantic_only"]


def test_job_commands(spark, tmp_path):
    s = 1_000_000
    rows = [(1, 0, 0, "claim", "w1", 0), (1, 1, 10 * s, "claim", "w2", 0), (1, 2, 20 * s, "renew", "w1", 1), (1, 3, 2000 * s, "claim", "w2", 0), (1, 4, 2001 * s, "complete", "w1", 1), (1, 5, 2002 * s, "fail", "w2", 2), (1, 6, 2003 * s, "retry", "", 0), (1, 7, 2004 * s, "claim", "w3", 0), (1, 8, 2005 * s, "complete", "w3", 3), (2, 9, 0, "complete", "w", 0)]
    spark.createDataFrame(rows, queues.COMMANDS).write.parquet(f"file://{tmp_path}/in")
    got = queues.finished(queues.job_commands(spark.readStream.schema(queues.COMMANDS).parquet(f"file://{tmp_path}/in")))
    want = [(True, "processing", 1), (False, "processing", 1), (True, "processing", 1), (True, "processing", 2), (False, "processing", 2), (True, "failed", 2), (True, "pending", 2), (True, "processing", 3), (True, "succeeded", 3), (False, "pending", 0)]
    assert [(r["ok"], r["status"], r["generation"]) for r in got.orderBy("seq").collect()] == want
