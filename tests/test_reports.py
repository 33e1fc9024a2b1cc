"""Literals for reports, phases, sentence classes and markers."""

import pytest
from pyspark.sql import functions as F

from vellum.operators import captions, lifecycle, markers, nested, reports


def test_sentence_classes(spark):
    rows = [
        ("Fig. 3a shows growth of cells.", "strong"),
        ("In Figure 3 (a, b) growth was 16.1% overall.", "excluded"),
        ("Fig. 3a lasted 7 days.", "weak"),
        ("Fig. 3b shows decay.", "weak"),
        ("Panel b lasted 7 days.", "excluded"),
        ("a schematic of the set-up", "strong"),
        ("Shown beside (a) here; Fig. 3b", "strong"),
        ("Nothing of note here", None),
    ]
    d = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(rows)], "i int, s string")
    got = d.select("i", captions.sentence_class(F.col("s"), F.lit("a"), F.lit("Figure 3")).alias("c")).orderBy("i").collect()
    assert [r["c"] for r in got] == [c for _, c in rows]


def test_lone_markers():
    assert markers.lone_markers("a Growth over time; b Decay. c Fig. 3 copy") == [("a", 0), ("b", 20)]
    assert markers.lone_markers("") == []


def test_phases_go_on_after_failures(spark):
    p = spark.createDataFrame([("p1", "chart"), ("p2", "image"), ("p3", "bad")], "panel_id string, kind string")

    def classify(panel):
        if panel["kind"] == "bad":
            raise ValueError("no class")
        return {"needs_digitization": panel["kind"] == "chart"}

    got = reports.phases(p, classify, lambda x: {"points": 1}, lambda x: {"seen": x["kind"]}).collect()
    assert sorted((r["panel_id"], r["phase"], r["payload"], r["error"]) for r in got) == [
        ("p1", "classify", '{"needs_digitization": true}', None), ("p1", "digitize", '{"points": 1}', None), ("p2", "classify", '{"needs_digitization": false}', None),
        ("p2", "observe", '{"seen": "image"}', None), ("p3", "classify", None, "ValueError: no class"), ("p3", "observe", '{"seen": "bad"}', None),
    ]


def test_follow_ends_at_a_final_status():
    seen, slept = iter(["pending", "running", "failed", "running"]), []
    assert reports.follow(lambda: next(seen), 1.0, sleep=slept.append) == "failed" and slept == [1.0, 1.0]
    assert reports.follow(lambda: "running", 1.0, 3.0, slept.append) == "running"


def test_compact_contract():
    c = reports.compact_contract("panel", {"required": ["b"], "properties": {"b": {"type": "string", "enum": ["x"]}, "a": {"type": ["number", "null"]}, "c": {"type": "array"}, "d": True}})
    assert c["fields"] == {"b": "string", "a": "number|null", "c": "array"} and c["enums"] == {"b": ["x"]} and c["skeleton"] == {"b": "", "a": "", "c": []}


def test_csv_preview_limits():
    head, rows = reports.preview("\r\n" + ",".join(map(str, range(20))) + "\n" + "\n".join("r" for _ in range(40)))
    assert len(head) == 12 and len(rows) == 20 and reports.preview("") == ([], [])


def test_object_keys_do_not_climb(spark):
    for bad in ("a/../b", "..", "", "/"):
        with pytest.raises(Exception, match="bad object key"):
            spark.createDataFrame([(bad,)], "k string").select(reports.object_key(F.col("k"))).collect()


def test_staged_outputs_and_log(spark, tmp_path):
    f = spark.createDataFrame([("x/r1/a/out.JSON", b"{}"), ("x/r1/b", b"")], "path string, content binary")
    assert [(r["filename"], r["media_type"], r["size_bytes"]) for r in reports.staged_outputs(f, "r1").orderBy("filename").collect()] == [("a/out.JSON", "application/json", 2), ("b", "application/octet-stream", 0)]
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "a"), (2, "b")], "i int, e string").write.parquet(src)
    for _ in range(2):
        reports.append_log(spark.readStream.schema("i int, e string").parquet(src), str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_caption_text_without_footnotes(spark):
    d = spark.sql("SELECT map('image_caption', array('a', 'b'), 'image_footnote', array('n')) AS m UNION ALL SELECT map('image_footnote', array('n'))")
    assert sorted(r[0] for r in d.select(nested.caption_text(F.col("m"), F.lit("s"))).collect()) == ["a b", "s"]


def test_finalised_runs_stay(spark):
    runs = spark.createDataFrame([(1, "succeeded"), (2, "running")], "run_id int, status string")
    bad = spark.createDataFrame([(1, 0, "x"), (2, 5, "late"), (2, 1, "early")], "run_id int, pos int, message string")
    assert sorted((r["run_id"], r["status"], r["error"]) for r in lifecycle.finalised(runs, bad).collect()) == [(1, "succeeded", None), (2, "failed", "early")]
