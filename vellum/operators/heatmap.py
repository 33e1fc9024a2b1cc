"""Heatmaps as tables: boxes from payloads, grids of cells, values by the nearest colour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coerce_box(v: Column, width: Column, height: Column) -> Column:
    """[left, top, right, bottom] in whole pixels from a VARIANT list or object (ltrb, x0y0x1y1 or x, y, width, height).

    Boxes with no number over 1 are shares of the image; corners may come in any order and are held
    within the image; null without four numbers or without an area.
    """
    at = lambda p: F.try_variant_get(v, p, "double")
    kinds = [[at(p) for p in ps] for ps in (["$[0]", "$[1]", "$[2]", "$[3]"], ["$.left", "$.top", "$.right", "$.bottom"], ["$.x0", "$.y0", "$.x1", "$.y1"])]
    x, y, w, h = (at(f"$.{k}") for k in ("x", "y", "width", "height"))
    kinds.append([x, y, x + w, y + h])
    whole = F.coalesce(*[F.when(k[0].isNotNull() & k[1].isNotNull() & k[2].isNotNull() & k[3].isNotNull(), F.array(*k)) for k in kinds])
    share = F.array_max(F.transform(whole, F.abs)) <= 1.0
    sides = [F.when(share, whole[i] * n).otherwise(whole[i]) for i, n in enumerate((width, height, width, height))]
    fit = lambda c, n: F.least((n - 1).cast("int"), F.greatest(F.lit(0), F.bround(c).cast("int")))
    box = F.array(fit(F.least(sides[0], sides[2]), width), fit(F.least(sides[1], sides[3]), height), fit(F.greatest(sides[0], sides[2]), width), fit(F.greatest(sides[1], sides[3]), height))
    return F.when(whole.isNotNull() & (box[2] > box[0]) & (box[3] > box[1]), box)


def axis_values(values: Column, lo: Column, hi: Column, n: int = 5) -> Column:
    """The first ten of the sorted distinct values; without values, n evenly spaced ones of the range, rounded to 6 digits."""
    given = F.filter(values, lambda x: x.isNotNull())
    spaced = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(lo + (hi - lo) * i / (n - 1), 6))
    none = F.array().cast("array<double>")
    return F.when(F.size(given) > 0, F.slice(F.array_sort(F.array_distinct(given)), 1, 10)).when(lo.isNotNull() & hi.isNotNull(), spaced).otherwise(none)


def grid(panels: DataFrame, xs: str, ys: str) -> DataFrame:
    """A row for each cell of a panel: its x and y values, its place and the centre in the box."""
    p = panels.withColumns({"n_x": F.size(xs), "n_y": F.size(ys)}).select("*", F.posexplode(xs).alias("i", "x_value")).select("*", F.posexplode(ys).alias("j", "y_value"))
    cx = F.col("bbox")[0] + (F.col("bbox")[2] - F.col("bbox")[0]) * (F.col("i") + 0.5) / F.col("n_x")
    cy = F.col("bbox")[3] - (F.col("bbox")[3] - F.col("bbox")[1]) * (F.col("j") + 0.5) / F.col("n_y")
    return p.withColumns({"px": F.floor(cx).cast("int"), "py": F.floor(cy).cast("int")}).drop(xs, ys, "n_x", "n_y")


def nearest_value(rgb: Column, palette: Column) -> Column:
    """value of the palette entry struct(rgb, value) with the least squared distance; the first of equals."""
    dist = lambda a: F.aggregate(F.zip_with(rgb, a, lambda p, q: ((p - q) * (p - q)).cast("double")), F.lit(0.0), lambda s, x: s + x)
    scored = F.transform(palette, lambda e, i: F.struct(dist(e["rgb"]).alias("d"), i.alias("i"), e["value"].alias("value")))
    return F.array_min(scored)["value"]


def palette_values(lo: Column, hi: Column, n: int = 80) -> Column:
    """n values from the top of a colour bar to its bottom."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: hi - (hi - lo) * i / (n - 1))
