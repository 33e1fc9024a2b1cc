"""Native text expressions: every function takes and returns Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def compact(c: Column) -> Column:
    """Collapse runs of Unicode white space to one space and trim."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def text_hash(c: Column, fold: bool = True) -> Column:
    """SHA-1 of the text; `fold` lower-cases it first."""
    return F.sha1(F.lower(c) if fold else c)


def slug(c: Column) -> Column:
    """Lower-case, other runs than letters and digits become one hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def figure_number(c: Column) -> Column:
    """The number in 'Fig. 3', 'Figure 3' or null."""
    got = F.regexp_extract(c, r"(?i)\bfig(?:ure|\.)?\s*\.?\s*(\d+)", 1)
    return F.when(got != "", got.cast("int"))


def reference_markers(c: Column) -> Column:
    """Distinct bracketed citations such as [1, 2-5], first order kept."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"\[\d+(?:\s*[,\-–]\s*\d+)*\]"), F.lit(0)))


def safe_name(c: Column) -> Column:
    """File-name-safe text; null or nothing left becomes 'unknown'."""
    got = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^A-Za-z0-9._-]+", "_")
    return F.when(got == "", F.lit("unknown")).otherwise(got)


def strip_tags(c: Column) -> Column:
    """Markup removed, white space compacted."""
    return compact(F.regexp_replace(c, r"<[^>]+>", " "))


def sentences(c: Column) -> Column:
    """Split after . ! ? or an ideographic full stop that white space follows."""
    return F.filter(F.split(c, r"(?<=[.!?。])\s+"), lambda s: F.length(s) > 0)


def label_range(lo: Column, hi: Column) -> Column:
    """'a'..'d' -> [a, b, c, d]."""
    return F.transform(F.sequence(F.ascii(lo), F.ascii(hi)), lambda x: F.char(x))
