"""Literals for figures, panels, nested blocks, contracts and ancestors that go beyond the catalogue's SQL."""

import json

import pytest
from pyspark.sql import functions as F

from vellum.operators import axes, contracts, digitize, graph, lifecycle, nested, panels, relational

AB = "Fig. 1 (a) Left side; (b) right side"


def page(captions, orders=None, boxes=None, matched=False):
    n = len(captions)
    return [(g, why) for g, why in panels.group_page(captions, orders or list(range(n)), boxes or [None] * n, [matched] * n)]


def test_every_exit_of_the_grouping():
    near, far = [[0, 0, 100, 100], [120, 0, 220, 100]], [[0, 0, 100, 100], [900, 900, 1000, 1000]]
    assert page(["x"]) == [([0], "layout_or_spatial_visual_grouping")]
    assert page(["Fig. 1 x", "", "Fig. 2 y", ""]) == [([0, 1], "separate_caption"), ([2, 3], "separate_caption")]
    assert page(["", "Fig. 1 x", "Fig. 2 y"])[0] == ([0], "separate_caption")
    assert page([AB, AB]) == [([0, 1], "same_caption_composite")]
    assert page([AB, "more"]) == [([0, 1], "nested_composite_caption")]
    assert page(["(a) one; (b) two", "(c) three"], matched=True) == [([0, 1], "layout_group")]
    assert page(["", ""], boxes=near) == [([0, 1], "bbox_spatial_cluster")]
    assert page(["", "", ""], boxes=[*near, far[1]]) == [([0, 1], "bbox_spatial_cluster"), ([2], "uncertain_split_conservative")]
    assert page(["", ""], boxes=far) == [([0], "uncertain_split_conservative"), ([1], "uncertain_split_conservative")]
    assert page(["text", ""]) == [([0], "fallback_single_visual"), ([1], "fallback_single_visual")]
    assert page(["", ""], orders=[0, 9]) == [([0], "spatially_separated"), ([1], "spatially_separated")]


def test_labels_never_repeat():
    assert panels.labels([AB, AB]) == ["a", "b"]
    own = panels.labels(["(c) own", "", ""])
    assert own[0] == "c" and len(set(own)) == 3
    many = panels.labels([""] * 30)
    assert many[:2] == ["a", "b"] and many[26] == "p27" and len(set(many)) == 30


def test_shared_caption_segments():
    got = panels.caption_segments("(a-d) Shared growth of all; (e) Control")
    assert got["a"] == got["d"] and got["a"][1:] == ("grouped_shared", 0.68) and got["a"][0].startswith("a-d")
    assert got["e"][1] == "exact" and got["e"][0].startswith("e) Control")
    assert panels.caption_segments("") == {} and panels.letters_of("a, b and d") == {"a", "b", "d"} and panels.letters_of("a to c") == {"a", "b", "c"}


def test_graph_panel_ids_of_large_figures(spark):
    rows = [("d", 0, "image", f"b{i}", i, "Fig. 1" if i == 0 else "", [0.0, float(i), 1.0, i + 1.0]) for i in range(30)]
    b = spark.createDataFrame(rows, "doc string, page int, type string, block_id string, global_order int, caption string, bbox array<double>")
    assert graph.figures(b).select("panel_id").distinct().count() == 30


def test_nested_parts(spark):
    block = {
        "type": "chart", "bbox": [1, 2], "image_caption": ["Fig. 1", {"type": "equation inline", "content": "a<b"}],
        "content": {"level": 2, "text": "deep", "image_caption": "Fig. 1", "chart_footnote": {"x": ["note", 3]}, "items": [{"y": {"latex": " x^2 "}}], "table_html": " <table></table> "},
    }
    rows = [(json.dumps(block),), ("not json",), (None,), ("[1]",), (json.dumps({"content": "<TABLE>x"}),)]
    got = [r["parts"] for r in nested.block_parts(spark.createDataFrame(rows, "block string")).collect()]
    assert got[0]["captions"] == {"image_caption": ["Fig. 1 a<b", "Fig. 1"]} and got[0]["footnotes"] == {"chart_footnote": ["note 3"]}
    assert got[0]["rich_caption"] == "<text>Fig. 1</text> <equation_inline>a&lt;b</equation_inline>"
    assert (got[0]["latex"], got[0]["table_html"], got[0]["mathml"]) == ("x^2", "<table></table>", None)
    assert got[1]["text"] is None and got[2]["text"] is None and got[3]["captions"] == {} and got[4]["table_html"] == "<TABLE>x"


def test_answers_with_prose_and_control_characters(spark):
    texts = ['{"a": 1}', 'x ```json\n{"a": 2}\n``` y', 'Sure: {"a": 3} done', '{"a": "l1\nl2"}', "none", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.try_variant_get(digitize.decode_json(F.col("t")), "$.a", "string").alias("a"))
    assert [r["a"] for r in got.orderBy("i").collect()] == ["1", "2", "3", "l1 l2", None, None]


def test_long_named_series_stay_apart(spark):
    points = [{"x": i, "y": i} for i in range(3)]
    payload = json.dumps({"series": [{"s1": {"points": points}, "s2": {"points": points}}]})
    got = digitize.dedupe_points(digitize.explode_points(spark.createDataFrame([("r", payload)], "id string, payload string")), ["id"]).orderBy("point_index").collect()
    assert [r["series_name"] for r in got] == ["s1"] * 3 + ["s2"] * 3


def test_ancestors_of_many_nodes(spark):
    n = 1_200_000  # chains of 12, whose last node qualifies
    nodes = spark.range(n).selectExpr("id", "if(id % 12 = 11, null, id + 1) AS parent", "id % 12 = 11 AS ok")
    got = relational.ancestor(nodes).selectExpr("count(*) AS n", "sum(if(found = start + steps AND steps = 11 - start % 12, 0, 1)) AS wrong").first()
    assert (got["n"], got["wrong"]) == (n, 0)
    ring = spark.createDataFrame([(1, 2, False), (2, 1, False), (3, 9, False), (4, 5, False), (5, None, True)], "id bigint, parent bigint, ok boolean")
    assert [tuple(r) for r in relational.ancestor(ring).orderBy("start").collect()] == [(4, 5, 1), (5, 5, 0)]
    chain = spark.range(40).selectExpr("id", "id + 1 AS parent", "id = 39 AS ok")
    assert relational.ancestor(chain, 32).agg(F.max("steps")).first()[0] == 32


def test_scopes_are_checked(spark):
    p = spark.createDataFrame([(1, 1, "failed")], "paper_id int, project_id int, status string")
    for bad in ({"papers": [1]}, {"paper_statuses": ["odd"]}):
        with pytest.raises(ValueError):
            lifecycle.scoped(p, bad)


def test_empty_evidence(spark):
    none = spark.createDataFrame([], "k int, bucket string, pos int, evidence_id string, source_type string, relation string, use_policy string, text_level string, text string")
    assert contracts.contract_document(contracts.contract_items(none, ["k"]), ["k"]).count() == 0
    assert lifecycle.model_chain("a", ["b", "a", "b"]) == ["a", "b"]
    one = spark.range(1).select(axes.axis_hints(F.lit(None).cast("array<string>")).alias("h")).first()["h"]
    assert (one["x"], one["y"]) == ("", "")
