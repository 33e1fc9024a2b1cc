"""Readiness of image assets, and what their captions say they show."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least side in pixels and least size in bytes of an extractable asset; limits of panel images.
MIN_SIDE, MIN_BYTES, TOO_SMALL, LOW_RESOLUTION = 32, 256, 50, 180
#: Share of the page that makes a box a large one.
LARGE_SHARE = 0.15
#: Shape -> words, any of which the text contains; the first shape that matches decides.
SHAPES = {
    "microscopy_structure": ["sem", "tem", "afm", "confocal", "microscopy", "microscope", "scale bar"],
    "chemical_characterization": ["ftir", "raman", "xrd", "xps", "spectrum", "spectra"],
    "omics_or_pathway_analysis": ["omics", "transcript", "gene", "pathway", "metabol"],
    "simulation_spatial_field": ["simulation", "model", "mesh", "finite element"],
    "macro_material_photo": ["photo", "sample", "hydrogel", "colony", "gel", "bead", "macro"],
}


def image_readability(width: Column, height: Column) -> Column:
    """unknown, too_small, low_resolution or usable."""
    under = lambda n: (width < n) | (height < n)
    return F.when(width.isNull() | height.isNull(), "unknown").when(under(TOO_SMALL), "too_small").when(under(LOW_RESOLUTION), "low_resolution").otherwise("usable")


def skip_reason(width: Column, height: Column, size: Column, caption: Column, nearby: Column) -> Column:
    """All reasons to skip an asset, joined; null if there is none."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    why = F.concat_ws(
        "; ",
        F.when((width < MIN_SIDE) | (height < MIN_SIDE), F.format_string("too small: %dx%d", width, height)),
        F.when(size < MIN_BYTES, F.format_string("file too small: %d bytes", size)),
        F.when(blank(caption) & blank(nearby), "missing caption and nearby context"),
    )
    return F.nullif(why, F.lit(""))


def asset_readiness(skip: Column, caption: Column, panel: Column) -> Column:
    weak = (F.trim(F.coalesce(caption, F.lit(""))) == "") | (F.coalesce(panel, F.lit("")) != "")
    return F.when(skip.isNotNull(), "skip").when(weak, "low_confidence").otherwise("ready")


def evidence_shape(kind: Column, caption: Column, nearby: Column, area_share: Column) -> Column:
    """By type, then by the first list of words with one in the text, then by the share of the page."""
    text = F.lower(F.concat_ws(" ", caption, nearby))
    out = F.when(F.lower(F.trim(kind)) == "chart", "experimental_performance_plot")
    for shape, words in SHAPES.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | text.contains(w)
        out = out.when(hit, shape)
    return out.otherwise("conceptual_schematic")


def figure_label(text: Column) -> Column:
    """'Fig. 3b' or 'figure 3' as written, or null."""
    return F.nullif(F.regexp_extract(text, r"(?i)\b(fig(?:ure)?\.?\s*\d+[a-z]?)\b", 1), F.lit(""))


def panel_letter(text: Column) -> Column:
    """The letter of 'panel a', 'a)' or 'a', or null."""
    return F.lower(F.nullif(F.regexp_extract(F.trim(text), r"(?i)^(?:panel\s*)?([a-z])\)?$", 1), F.lit("")))
