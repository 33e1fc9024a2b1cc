"""Panel markers in captions, with their positions, and the caption segments that they open."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

#: Strong markers are parenthesised, weak ones end with ) . or : at a segment start.
STRONG = re.compile(r"\(([A-Za-z])(?:\s*[-–]\s*([A-Za-z]))?\)")
WEAK = re.compile(r"(?:(?<=^)|(?<=[;.]\s)|(?<=\s))([a-h])[).:](?=\s)")
#: What must not stand before a marker: statistics and axes read like labels.
REJECT = re.compile(r"(?:\bp\s*[<=>]|\bn\s*=|\br\s*=|axis|stack|\bt[- ]?test)[^;.]{0,16}$", re.IGNORECASE)


def find_markers(caption: str) -> list[tuple[str, int, int, float, str]]:
    """(marker, start, end, confidence, kind), by start; one for each (marker, start)."""
    found = {}
    for m in STRONG.finditer(caption):
        before = caption[max(0, m.start() - 24) : m.start()]
        if REJECT.search(before):
            continue
        lo, hi = m[1].lower(), (m[2] or m[1]).lower()
        for c in range(ord(lo), ord(hi) + 1):
            found[(chr(c), m.start())] = (chr(c), m.start(), m.end(), 0.95 if lo == hi else 0.68, "exact" if lo == hi else "grouped_shared")
    for m in WEAK.finditer(caption):
        before, after = caption[max(0, m.start() - 24) : m.start()], caption[m.end() : m.end() + 16]
        if REJECT.search(before) or re.match(r"\s*(?:axis|stack|test|value)", after, re.IGNORECASE):
            continue
        found.setdefault((m[1], m.start()), (m[1], m.start(), m.end(), 0.7, "weak"))
    return sorted(found.values(), key=lambda x: (x[1], -x[3], x[0]))


@udtf(returnType="marker string, start int, stop int, confidence double, kind string")
class Markers:
    def eval(self, caption: str):
        yield from find_markers(caption or "")


def detect_markers(df: DataFrame, caption: str) -> DataFrame:
    """`df` with a row for each marker of its caption: Spark has no expression for match positions."""
    return df.lateralJoin(Markers(F.col(caption).outer()))


def segments(markers: DataFrame, key: list[str], caption: str) -> DataFrame:
    """Each marker's text up to the next marker that starts later."""
    w = W.partitionBy(*key).orderBy("start").rangeBetween(1, W.unboundedFollowing)
    nxt = F.coalesce(F.min("start").over(w), F.length(caption))
    body: Column = F.trim(F.substring(F.col(caption), F.col("stop") + 1, nxt - F.col("stop")))
    return markers.withColumn("segment", F.regexp_replace(body, r"[;.\s]+$", ""))


#: A lone lower-case letter after a start or a stop and before a word; a figure's name that must not follow it.
LONE = re.compile(r"(?:^\s*|[;:,.)\]}\-]\s*)([a-z])(?=\s+[A-Za-z0-9(\[]|$)")
NAMED = re.compile(r"\s*[;:,\-]?\s*fig(?:ure)?\.?\s*\d+", re.IGNORECASE)


def lone_markers(caption: str) -> list[tuple[str, int]]:
    """(letter, position) of lower-case letters that open a part of a caption without brackets."""
    body = " ".join(caption.split())
    return [(m[1], m.start(1)) for m in LONE.finditer(body) if not NAMED.match(body, m.end(1)) and not body[: m.start(1)][-1:].isalnum()]
