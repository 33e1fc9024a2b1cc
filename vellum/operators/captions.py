"""Which figure and panels a sentence speaks of, and which caption text fits a panel best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions import text

#: A list of panel letters; weights of a caption's score; values that belong to the whole figure.
_LIST = r"[a-z](?:\s*,\s*[a-z])*"
OWN_LABEL, PERCENT, COMPARISON, LENGTH, TITLE, WORDS_FOR_ONE = 2.8, 1.0, 1.0, 0.5, 2.5, 25.0
PARENT_VALUES = ("16.1%", "1.3%", "0.7%", "7 days", "7 d", "prolonged")


def figure_panels(sentence: Column) -> Column:
    """array<struct<figure, label>> of 'Fig. 2a,b' and '2(a)' references, distinct."""
    s = F.lower(text.compact(sentence))
    found = F.concat(
        F.regexp_extract_all(s, F.lit(rf"\bfig(?:ure)?\.?\s*\d+\s*\(?\s*(?:{_LIST})\b"), F.lit(0)),
        F.regexp_extract_all(s, F.lit(rf"\b\d+\s*\(\s*(?:{_LIST})\s*\)"), F.lit(0)),
    )
    one = lambda r: F.transform(F.regexp_extract_all(F.regexp_extract(r, rf"\d+\s*\(?\s*({_LIST})", 1), F.lit("[a-z]"), F.lit(0)), lambda x: F.struct(F.regexp_extract(r, r"(\d+)", 1).alias("figure"), x.alias("label")))
    return F.array_distinct(F.flatten(F.transform(found, one)))


def sentence_labels(sentence: Column, figure: Column) -> Column:
    """Panel labels that a sentence names for one figure, or by 'panel a', '(a)' or '[a]'."""
    own = F.transform(F.filter(figure_panels(sentence), lambda r: r["figure"] == figure), lambda r: r["label"])
    s = F.lower(sentence)
    bare = F.transform(F.regexp_extract_all(s, F.lit(r"\bpanel\s*[a-z]\b|\([a-z]\)|\[\s*[a-z]\s*\]"), F.lit(0)), lambda r: F.regexp_extract(F.regexp_replace(r, "panel", ""), "([a-z])", 1))
    return F.array_distinct(F.concat(own, bare))


def reliable(candidate: Column, label: Column, figure: Column) -> Column:
    """The text starts with the panel's label, is no bare figure title, and speaks of no other panel of the figure."""
    s = F.lower(text.compact(candidate))
    starts = F.regexp_like(s, F.concat(F.lit("^"), label, F.lit(r"([\s\)\]:;.,-]|$)")))
    title = F.regexp_like(s, F.concat(F.lit("^"), label, F.lit(r"[;:,.-]?\s*(?:fig(?:ure)?\.?\s*\d+)\b")))
    refs = figure_panels(candidate)
    foreign = F.exists(refs, lambda r: F.when(F.coalesce(figure, F.lit("")) == "", r["label"] != label).otherwise((r["figure"] != figure) | (r["label"] != label)))
    return F.coalesce((F.coalesce(label, F.lit("")) != "") & starts & ~title & ~foreign, F.lit(False))


def caption_score(candidate: Column, label: Column, figure: Column) -> Column:
    """Additive score of a reliable candidate, else 0: own label, percentages, comparisons, length, less figure titles."""
    s = F.lower(text.compact(candidate))
    n = F.size(F.split(s, " "))
    score = (
        F.when(s.startswith(F.concat(label, F.lit(" "))), OWN_LABEL).otherwise(0.0)
        + F.when(s.rlike(r"\d+(?:\.\d+)?\s*%"), PERCENT).otherwise(0.0)
        + F.when(s.rlike(r"\b(before|after|vs\.?|versus|compared|difference)\b"), COMPARISON).otherwise(0.0)
        + F.when(n.between(5, 30), LENGTH).otherwise(0.0)
        - F.when(s.contains("figure") | s.contains("fig."), TITLE).otherwise(0.0)
        + F.least(n, F.lit(40)) / WORDS_FOR_ONE
    )
    return F.when(reliable(candidate, label, figure), score).otherwise(0.0)


def best_captions(candidates: DataFrame, keys: list[str], least: float = 0.25) -> DataFrame:
    """Per panel (label, figure, candidate), the candidate with the highest score over the threshold; the longer of equals."""
    c = candidates.withColumn("score", caption_score(F.col("candidate"), F.col("label"), F.col("figure"))).filter(F.col("score") > least)
    w = W.partitionBy(*keys).orderBy(F.desc("score"), F.desc(F.length("candidate")), "candidate")
    return c.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def merge_captions(a: Column, b: Column) -> Column:
    """The longer of two captions if one contains the other, else both."""
    x, y = text.compact(F.coalesce(a, F.lit(""))), text.compact(F.coalesce(b, F.lit("")))
    return F.when(x.contains(y), x).when(y.contains(x), y).otherwise(F.concat_ws(" ", x, y))


def sentence_class(sentence: Column, label: Column, figure: Column) -> Column:
    """strong, weak or excluded for a panel, or null: whether a sentence names it, alone, and speaks of values of the whole figure.

    A sentence that names the panel is strong; with a value of the whole figure it is weak, and excluded if it names
    others too. One that names other panels only is weak, with such a value excluded. One that merely starts
    with the letter or has it in brackets is weak.
    """
    s = F.lower(sentence)
    number = F.coalesce(F.regexp_extract(F.coalesce(figure, F.lit("")), r"(\d+)", 1), F.lit(""))
    named = sentence_labels(sentence, number)
    start = F.regexp_like(s, F.concat(F.lit(r"^\s*(?:panel\s*)?"), label, F.lit(r"[\s)\]:;\-]")))
    labels = F.when(start & ~F.array_contains(named, label), F.array_append(named, label)).otherwise(named)
    by_number = F.regexp_like(s, F.concat(F.lit(r"\b(?:fig(?:ure)?\.?\s*)?"), number, F.lit(r"\s*(?:"), label, F.lit(r"\b|\(\s*"), label, F.lit(r"(?:\s*,\s*[a-z])*\))")))
    direct = F.when(number != "", by_number).otherwise(s.startswith(F.concat(label, F.lit(" "))))
    shared = F.lit(False)
    for v in PARENT_VALUES:
        shared = shared | s.contains(v)
    many, mine = F.size(labels) > 1, F.array_contains(labels, label)
    bracketed = F.regexp_like(s, F.concat(F.lit(r"\("), label, F.lit(r"\)|\["), label, F.lit(r"\]|\b"), label, F.lit(r"[)\]:;\-]")))
    known = F.coalesce(label, F.lit("")) != ""
    return (
        F.when(known & (direct | mine), F.when(shared & many, "excluded").when(shared, "weak").otherwise("strong"))
        .when(F.size(labels) > 0, F.when(shared, "excluded").otherwise("weak"))
        .when(known & (F.trim(s).startswith(label) | bracketed), "weak")
    )
