"""Nested block content: texts, captions, markup and formulas of JSON blocks, page nesting, and Markdown from blocks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import escape
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Keys that hold no text.
STRUCTURAL = frozenset(("level", "bbox", "img_path", "image_path", "path", "image_source", "html", "table_html", "type", "list_type"))
#: Keys of captions and of footnotes, those of formulas and of tables.
CAPTIONS = ("image_caption", "chart_caption", "table_caption", "caption")
FOOTNOTES = ("image_footnote", "chart_footnote", "table_footnote", "footnote")
LATEX, MATHML, TABLES = ("latex", "math_content", "formula_latex"), ("mathml", "formula_mathml"), ("table_html", "html")
#: The parser's own type map; others pass through in lower case.
PARSER_TYPES = {
    "text": "paragraph", "paragraph": "paragraph", "title": "heading", "doc_title": "heading", "image": "image", "chart": "image", "table": "table",
    "equation": "formula", "interline_equation": "formula", "inline_formula": "formula", "list": "list", "page_header": "page_header", "page_footer": "page_footer",
    "page_footnote": "page_footnote", "page_number": "page_number", "header": "page_header", "footer": "page_footer", "footnote": "page_footnote",
    "image_caption": "caption", "chart_caption": "caption", "table_caption": "caption", "ref_text": "reference", "aside_text": "aside", "ocr_text": "ocr_text", "paragraph_title": "heading",
}
PARTS = "text string, captions map<string, array<string>>, footnotes map<string, array<string>>, rich_caption string, table_html string, latex string, mathml string"


def compact(text: str) -> str:
    return " ".join(text.split())


def leaves(value: Any, skip: frozenset = STRUCTURAL) -> Iterator[str]:
    """Non-empty texts of nested JSON, depth first; nothing below a key of `skip`."""
    waiting = [value]
    while waiting:
        v = waiting.pop()
        if isinstance(v, dict):
            waiting += [x for k, x in reversed(v.items()) if k not in skip]
        elif isinstance(v, list):
            waiting += reversed(v)
        elif v is not None and str(v):
            yield str(v)


def sources(block: dict) -> list[dict]:
    """The block, then its content if that is an object."""
    inner = block.get("content")
    return [block, inner] if isinstance(inner, dict) else [block]


def gathered(block: dict, keys: tuple[str, ...]) -> dict[str, list[str]]:
    """key -> its different compacted texts, from the block before its content."""
    out: dict[str, list[str]] = {}
    for place in sources(block):
        for key in keys:
            text = compact(" ".join(leaves(place.get(key))))
            if text and text not in out.setdefault(key, []):
                out[key].append(text)
    return {k: v for k, v in out.items() if v}


def typed_tokens(value: Any) -> Iterator[tuple[str, str]]:
    """(type, text) tokens of a caption; an object with content or text is one token, other objects hold tokens."""
    if isinstance(value, list):
        for v in value:
            yield from typed_tokens(v)
    elif isinstance(value, dict):
        inner = next((k for k in ("content", "text") if k in value), None)
        if inner is None:
            for v in value.values():
                yield from typed_tokens(v)
        elif text := compact(" ".join(leaves(value[inner]))):
            yield str(value.get("type") or "text"), text
    elif value is not None and (text := compact(str(value))):
        yield "text", text


def rich_caption(block: dict) -> str:
    """Tokens of all captions as <type>text</type>, with safe tag names and escaped text."""
    out: dict[str, list[tuple[str, str]]] = {}
    for place in sources(block):
        for key in CAPTIONS:
            for token in typed_tokens(place.get(key)):
                if token not in out.setdefault(key, []):
                    out[key].append(token)
    tag = lambda t: re.sub(r"[^a-zA-Z0-9_:-]+", "_", t.strip()).strip("_:") or "text"
    return " ".join(f"<{tag(t)}>{escape(text, quote=False)}</{tag(t)}>" for tokens in out.values() for t, text in tokens)


def first_text(value: Any, keys: tuple[str, ...]) -> str | None:
    """The first non-blank text under one of `keys`: of an object its own keys before what it holds."""
    if isinstance(value, dict):
        own = [value[k].strip() for k in keys if isinstance(value.get(k), str) and value[k].strip()]
        return own[0] if own else first_text(list(value.values()), keys)
    if isinstance(value, list):
        return next((found for v in value if (found := first_text(v, keys))), None)
    return None


def table_markup(block: dict) -> str | None:
    """Markup of a table: the block's own before its content's; a content text that holds a table tag."""
    found = [p[k].strip() for p in sources(block) for k in TABLES if isinstance(p.get(k), str) and p[k].strip()]
    inner = block.get("content")
    return found[0] if found else inner.strip() if isinstance(inner, str) and "<table" in inner.lower() else None


def parts(block: Any) -> tuple:
    """All of PARTS for one block; what is no object has none."""
    if not isinstance(block, dict):
        return None, {}, {}, "", None, None, None
    text = compact(" ".join(leaves(block.get("text") or block.get("content"))))
    return text, gathered(block, CAPTIONS), gathered(block, FOOTNOTES), rich_caption(block), table_markup(block), first_text(block, LATEX), first_text(block, MATHML)


def block_parts(blocks: DataFrame, json_col: str = "block") -> DataFrame:
    """`blocks` with `parts`: text, captions, footnotes, rich_caption, table_html, latex, mathml of each JSON block.

    JSON of any depth has no native traversal: Arrow batches of one column. Broken JSON and null have no parts.
    """

    @F.pandas_udf(PARTS)
    def read(column: pd.Series) -> pd.DataFrame:
        rows = []
        for raw in column:
            try:
                block = json.loads(raw) if raw else None
            except ValueError:
                block = None
            rows.append(parts(block))
        return pd.DataFrame(rows, columns=[f.split()[0] for f in re.split(r", (?=\w+ (?:string|map))", PARTS)])

    return blocks.withColumn("parts", read(F.col(json_col)))


def parser_type(raw: Column) -> Column:
    """The parser's type of a raw block type."""
    known = F.create_map(*[F.lit(x) for kv in PARSER_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, raw), F.lower(raw))


def nest_pages(blocks: DataFrame, doc: str = "doc", page: str = "page_idx", pos: str = "pos", block: str = "block") -> DataFrame:
    """doc, pages: flat blocks as a list of pages in order, each a list of its blocks in order; without a page, page 0."""
    at = F.coalesce(F.col(page), F.lit(0)).alias("page")
    one = blocks.select(doc, at, pos, block).groupBy(doc, "page").agg(F.array_sort(F.collect_list(F.struct(pos, block))).alias("own"))
    nested = one.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("page", F.col(f"own.{block}").alias("own")))).alias("pages"))
    return nested.select(doc, F.col("pages.own").alias("pages"))


def flatten_pages(nested: DataFrame, doc: str = "doc") -> DataFrame:
    """doc, page_idx, pos, block: nested pages as flat blocks."""
    pages = nested.select(doc, F.posexplode("pages").alias("page_idx", "own"))
    return pages.select(doc, "page_idx", F.posexplode("own").alias("pos", "block"))


def elements(blocks: DataFrame, images: DataFrame, doc: str = "doc") -> DataFrame:
    """Blocks (doc, pos, raw_type, text, caption, image_path) as parser elements with type, text and image.

    An image without a path takes, in order, the next of the document's listed images (doc, nth, path,
    alt), its caption the image's alt text if it has none; those beyond the list stay unresolved.
    """
    t = blocks.withColumn("element_type", parser_type(F.col("raw_type")))
    open_ = (F.col("element_type") == "image") & (F.coalesce("image_path", F.lit("")) == "")
    w = W.partitionBy(doc).orderBy("pos")
    t = t.withColumn("nth", F.when(open_, F.sum(open_.cast("int")).over(w) - 1))
    j = t.join(images.select(doc, "nth", F.col("path").alias("listed"), "alt"), [doc, "nth"], "left")
    path = F.coalesce(F.nullif("image_path", F.lit("")), F.col("listed"))
    caption = F.coalesce(F.nullif("caption", F.lit("")), F.col("alt"), F.lit(""))
    image = F.col("element_type") == "image"
    return j.select(doc, "pos", "element_type", F.when(image, caption).otherwise(F.col("text")).alias("text"), path.alias("image_path"), (image & path.isNull()).alias("unresolved"))


def image_names(images: DataFrame, doc: str = "doc") -> DataFrame:
    """doc, name, path, alt: of the images (doc, pos, path, alt) with one file name the last."""
    name = F.element_at(F.split("path", "/"), -1)
    return images.withColumn("name", name).groupBy(doc, "name").agg(F.max_by(F.struct("path", "alt"), "pos").alias("r")).select(doc, "name", "r.path", "r.alt")


def markdown(blocks: DataFrame, doc: str = "doc", preview: int = 20_000) -> DataFrame:
    """doc, markdown, preview from blocks (pos, type, text, caption, image_path): images as links, other texts as paragraphs."""
    image = F.col("type").isin("image", "chart") & (F.coalesce("image_path", F.lit("")) != "")
    alt = F.coalesce(F.nullif("caption", F.lit("")), F.nullif("text", F.lit("")), F.col("type"))
    line = F.when(image, F.concat(F.lit("!["), alt, F.lit("]("), F.col("image_path"), F.lit(")"))).otherwise(F.nullif("text", F.lit("")))
    lines = blocks.withColumn("line", line).filter("line is not null").groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    body = F.array_join(F.col("l.line"), "\n\n")
    plain = F.replace(F.replace(F.replace(body, F.lit("!["), F.lit("[")), F.lit("]("), F.lit(" ")), F.lit(")"), F.lit(" "))
    return lines.select(doc, body.alias("markdown"), F.substring(F.trim(F.regexp_replace(plain, r"(?U)\s+", " ")), 1, preview).alias("preview"))


def caption_text(captions: Column, structured: Column) -> Column:
    """A visual's caption: its captions (map of lists) but for footnotes, else the structured one."""
    body = F.flatten(F.map_values(F.map_filter(captions, lambda k, _: ~k.contains("footnote"))))
    return F.when(F.size(body) > 0, F.array_join(body, " ")).otherwise(F.coalesce(structured, F.lit("")))
