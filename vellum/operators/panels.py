"""Figures and panels of a page: which visuals belong together and why, unique figure ids, panel labels, rollups."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.operators.markers import find_markers

#: How far apart reading orders of one figure may be; visuals among which boxes decide; gaps as shares of the mean size, and at least.
FAR, FEW, GAP_X, GAP_Y, LEAST_X, LEAST_Y = 3, range(2, 7), 0.35, 0.35, 60.0, 70.0
_FIGURE = re.compile(r"(?i)\bfig(?:ure)?\.?\s*(\d+)")
SCHEMA = "doc string, page int, block_id string, place int, grp int, provenance string, number string, label string"


def number_of(caption: str) -> str | None:
    m = _FIGURE.search(caption)
    return m[1] if m else None


def merged(captions: list[str]) -> str:
    """Different non-empty captions, one after the other."""
    return " ".join(dict.fromkeys(c for c in captions if c))


def composite(caption: str) -> bool:
    """Whether a caption speaks of two panels or more."""
    return len(find_markers(caption)) >= 2


def near(union: list[float], sizes: list[tuple[float, float]], box: list[float]) -> bool:
    """Whether a box lies within the gaps of a cluster's union; gaps follow the mean size."""
    wide, high = (sum(s[k] for s in sizes) / len(sizes) for k in (0, 1))
    dx = max(0.0, max(box[0], union[0]) - min(box[2], union[2]))
    dy = max(0.0, max(box[1], union[1]) - min(box[3], union[3]))
    return dx <= max(LEAST_X, GAP_X * wide) and dy <= max(LEAST_Y, GAP_Y * high)


def clusters(boxes: list[list[float]]) -> list[list[int]]:
    """Boxes in (y, x) order, cut where the next one is not near the cluster so far."""
    order = sorted(range(len(boxes)), key=lambda i: (boxes[i][1], boxes[i][0]))
    out: list[list[int]] = []
    for i in order:
        b = boxes[i]
        if out:
            own = [boxes[k] for k in out[-1]]
            union = [min(x[0] for x in own), min(x[1] for x in own), max(x[2] for x in own), max(x[3] for x in own)]
            if near(union, [(x[2] - x[0], x[3] - x[1]) for x in [*own, b]], b):
                out[-1].append(i)
                continue
        out.append([i])
    return out


def group_page(captions: list[str], orders: list[int], boxes: list[list[float] | None], matched: list[bool]) -> list[tuple[list[int], str]]:
    """(visuals, provenance) of each figure of one page, for visuals in reading order.

    The first rule that holds decides: a lone visual; two numbers in captions; one number and a composite
    caption; all visuals in the layout and a composite caption; boxes; a caption without a number; visuals
    far apart; a composite caption; else each visual is a figure.
    """
    everyone = list(range(len(captions)))
    numbers = [number_of(c) for c in captions]
    kinds, told = {n for n in numbers if n}, [c.strip() for c in captions if c.strip()]
    whole, alone = merged(captions), [[i] for i in everyone]
    if len(captions) <= 1:
        return [(g, "layout_or_spatial_visual_grouping") for g in alone]
    if len(kinds) >= 2:
        named: dict[str, list[int]] = {}
        last = None
        for i, n in enumerate(numbers):
            last = n or last
            named.setdefault(last or f"without {i}", []).append(i)
        return [(g, "separate_caption") for g in named.values()]
    if len(kinds) == 1 and composite(whole):
        return [(everyone, "same_caption_composite" if len(set(told)) == 1 else "nested_composite_caption")]
    if all(matched) and composite(whole):
        return [(everyone, "layout_group")]
    shared = not told or len({c.lower() for c in told}) == 1 or len(kinds) == 1
    if len(captions) in FEW and all(boxes) and shared:
        found = clusters(boxes)
        if any(len(g) > 1 for g in found):
            return [(g, "bbox_spatial_cluster" if len(g) > 1 else "uncertain_split_conservative") for g in found]
    if any(c.strip() and not n for c, n in zip(captions, numbers, strict=True)):
        return [(g, "fallback_single_visual") for g in alone]
    if max(orders) - min(orders) > FAR:
        return [(g, "spatially_separated") for g in alone]
    if composite(whole):
        return [(everyone, "same_caption_composite")]
    return [(g, "uncertain_split_conservative") for g in alone]


def letter(place: int) -> str:
    """a to z for the first 26 places, then p27 and so on."""
    return chr(96 + place) if place <= 26 else f"p{place}"


def labels(captions: list[str]) -> list[str]:
    """A label for each visual of a figure, no two alike: of its own caption's markers, the marker of its place, any free marker, the letter of its place."""
    markers = [m[0] for m in find_markers(merged(captions))]
    out: list[str] = []
    for place, caption in enumerate(captions, 1):
        wanted: Iterator[str] = iter([*(m[0] for m in find_markers(caption)), *markers[place - 1 : place], *markers, letter(place)])
        out.append(next((w for w in wanted if w not in out), f"{letter(place)}{place}"))
    return out


def group_visuals(visuals: DataFrame) -> DataFrame:
    """Visuals (doc, page, block_id, reading_order, bbox, caption, matched) with figure_id, panel_id, label and provenance.

    The rules of a page depend on one another in order, so a page is one Pandas group; a page holds few
    visuals. A figure is named by the number in its captions, else by the number of visuals of its document;
    repeated names of a document get -2, -3 and so on by page and place, which windows over figures count.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["reading_order", "block_id"])
        captions = [c or "" for c in pdf["caption"]]
        boxes = [None if b is None else [float(x) for x in b] for b in pdf["bbox"]]
        rows = []
        for k, (members, why) in enumerate(group_page(captions, pdf["reading_order"].tolist(), boxes, pdf["matched"].tolist())):
            own = [captions[i] for i in members]
            number = number_of(merged(own))
            for place, (i, label) in enumerate(zip(members, labels(own), strict=True), 1):
                r = pdf.iloc[i]
                rows.append((r["doc"], int(r["page"]), r["block_id"], place, k, why, number, label))
        return pd.DataFrame(rows, columns=["doc", "page", "block_id", "place", "grp", "provenance", "number", "label"])

    cols = ["doc", "page", "block_id", "reading_order", "bbox", "caption", "matched"]
    got = visuals.select(*cols).groupBy("doc", "page").applyInPandas(run, SCHEMA)
    figures = got.groupBy("doc", "page", "grp").agg(F.max("number").alias("number"), F.count("*").alias("figure_size"))
    total = visuals.groupBy("doc").agg(F.count("*").alias("n"))
    figures = figures.join(total, "doc").withColumn("base", F.concat(F.lit("figure-"), F.coalesce("number", F.col("n").cast("string"))))
    nth = F.row_number().over(W.partitionBy("doc", "base").orderBy("page", "grp"))
    figures = figures.withColumn("figure_id", F.when(nth == 1, F.col("base")).otherwise(F.concat_ws("-", "base", nth.cast("string"))))
    out = got.drop("number").join(figures.drop("n", "number"), ["doc", "page", "grp"])
    return out.withColumn("panel_id", F.concat_ws("-", "figure_id", "label")).drop("grp", "base")


def figure_members(panels: DataFrame) -> DataFrame:
    """Panels (doc, figure_id, panel_id, asset_index) with figure_group_size, panel_index from 1, siblings (all indices of the figure) and is_multi."""
    g = panels.groupBy("doc", "figure_id").agg(F.array_sort(F.collect_list("asset_index")).alias("siblings"))
    own = F.array_position("siblings", F.col("asset_index")).cast("int")
    return panels.join(g, ["doc", "figure_id"]).select(*panels.columns, F.size("siblings").alias("figure_group_size"), own.alias("panel_index"), "siblings", (F.size("siblings") > 1).alias("is_multi"))


def rollup(panels: DataFrame) -> DataFrame:
    """doc, figure_id, n_panels, page (the first), labels in order."""
    first = F.struct("page", "place")
    return panels.groupBy("doc", "figure_id").agg(F.count("*").alias("n_panels"), F.min("page").alias("page"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(first.alias("at"), "label"))), lambda x: x["label"]), ",").alias("labels"))


_SHARED = re.compile(r"(?:^|[\s;,.])\(?\s*([A-Za-z](?:\s*(?:,|/|&|and|–|-|to)\s*[A-Za-z])*)\s*[).:]", re.IGNORECASE)


def letters_of(marker: str) -> set[str]:
    """Letters that 'a-d', 'a to c' or 'a, b and d' name."""
    out: set[str] = set()
    for part in re.split(r"\s*(?:,|/|&|and)\s*", marker.lower()):
        ends = re.fullmatch(r"\s*([a-z])(?:\s*(?:–|-|to)\s*([a-z]))?\s*", part)
        if ends:
            out |= {chr(c) for c in range(ord(ends[1]), ord(ends[2] or ends[1]) + 1)}
    return out


def marker_groups(caption: str) -> list[tuple[int, int, frozenset[str], float]]:
    """(boundary, start, labels, confidence) of a caption's marker groups by start.

    Groups written together and single markers that no group claims; of equal starts the larger group, and
    no group whose labels the group before it has.
    """
    found = [(m.start(), m.start(1), m.end(1), frozenset(letters_of(m[1])), 0.9) for m in _SHARED.finditer(caption)]
    found = [f for f in found if f[3]]
    claimed = {(s, e) for _, s, e, _, _ in found}
    found += [(s, s, e, frozenset((m,)), conf) for m, s, e, conf, _ in find_markers(caption) if (s, e) not in claimed]
    out: list[tuple[int, int, frozenset[str], float]] = []
    for boundary, start, _, names, conf in sorted(found, key=lambda f: (f[1], -len(f[3]))):
        if any(start == o[1] for o in out) or (out and len(out[-1][2]) > 1 and names <= out[-1][2]):
            continue
        out.append((boundary, start, names, conf))
    return out


def caption_segments(caption: str) -> dict[str, tuple[str, str, float]]:
    """label -> (text, exact or grouped_shared, confidence) up to the next group; the first group of a label counts."""
    body = " ".join(caption.split())
    groups, out = marker_groups(body), {}
    for (_, start, names, conf), nxt in zip(groups, [*(g[0] for g in groups[1:]), len(body)], strict=False):
        piece = body[start:nxt].strip(" ;,")
        shared = len(names) > 1
        for name in sorted(names) if piece else ():
            out.setdefault(name, (piece, "grouped_shared" if shared else "exact", round(min(conf, 0.68) if shared else conf, 3)))
    return out
