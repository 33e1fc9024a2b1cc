"""Sources: nested block JSON, layouts, Markdown, zip members, PDF folders, image headers, event logs."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Raw block type -> type; others pass through in lower case.
BLOCK_TYPES = {
    "title": "heading", "paragraph": "text", "text": "text", "list": "list", "image": "image", "chart": "chart", "table": "table",
    "equation": "formula", "equation_interline": "formula", "interline_equation": "formula", "ref_text": "reference", "code": "code",
    "page_header": "page_header", "page_footer": "page_footer", "page_number": "page_number", "page_footnote": "page_footnote", "page_aside_text": "page_aside_text",
}


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def load_blocks(files: DataFrame) -> DataFrame:
    """(path, value) with a page-nested JSON list -> one typed row per block; anything else is an error that names the file."""
    raw = files.withColumn("json", F.try_parse_json("value"))
    good = F.schema_of_variant(F.col("json")).startswith("ARRAY<ARRAY<") | (F.schema_of_variant(F.col("json")) == "ARRAY<VOID>")
    checked = raw.withColumn("json", F.when(F.coalesce(good, F.lit(False)), F.col("json")).otherwise(F.raise_error(F.concat(F.lit("not a list of pages of blocks: "), F.col("path"))).cast("variant")))
    rows = files.sparkSession.sql("SELECT path, p.pos AS page, b.pos AS reading_order, b.value AS block FROM {files}, LATERAL variant_explode(json) p, LATERAL variant_explode(p.value) b", files=checked)
    get = lambda p, t="string": F.try_variant_get("block", p, t)
    kinds = F.create_map(*[F.lit(x) for kv in BLOCK_TYPES.items() for x in kv])
    t = F.lower(F.coalesce(get("$.type"), F.lit("")))
    box = F.array(*[get(f"$.bbox[{i}]", "double") for i in range(4)])
    ref_list = (t == "list") & (F.coalesce(get("$.content.list_type"), F.lit("")) == "reference_list")
    caption = F.coalesce(*[get(p) for p in ("$.image_caption", "$.chart_caption", "$.table_caption", "$.content.image_caption", "$.content.chart_caption", "$.content.table_caption")])
    w = W.partitionBy("path").orderBy("page", "reading_order")
    return rows.select(
        F.col("path").alias("doc"),
        "page",
        "reading_order",
        (F.row_number().over(w) - 1).alias("global_order"),
        F.when(ref_list, "reference").otherwise(F.coalesce(F.try_element_at(kinds, t), t)).alias("type"),
        F.coalesce(get("$.text"), get("$.content"), get("$.content.title_content"), get("$.content.text")).alias("text"),
        caption.alias("caption"),
        F.when(F.forall(box, lambda x: x.isNotNull()) & get("$.bbox[4]", "double").isNull(), box).alias("bbox"),
        F.coalesce(get("$.img_path"), get("$.image_path"), get("$.path"), get("$.content.image_source.path")).alias("image_path"),
        F.coalesce(get("$.text_level", "int"), get("$.content.level", "int")).alias("level"),
    ).withColumn("block_id", F.format_string("p%d-b%d-g%d", "page", "reading_order", "global_order"))


def load_layout(files: DataFrame) -> DataFrame:
    """Layout blocks of a list of pages or {pages: [...]}; boxes without four numbers and broken files give no rows."""
    raw = files.select("path", F.try_parse_json("value").alias("json"))
    # only a list's values have no key; a page's number is taken before its blocks are dealt out, so that no block carries its whole page
    pages = files.sparkSession.sql(
        "SELECT path AS doc, p.pos AS ordinal, p.value AS pg FROM {raw}, LATERAL variant_explode(coalesce(try_variant_get(json, '$.pages', 'variant'), json)) p WHERE p.key IS NULL",
        raw=raw,
    )
    get = lambda p, t: F.try_variant_get("pg", p, t)
    page = F.coalesce(get("$.page_idx", "int"), get("$.page_id", "int"), F.col("ordinal"))
    own = pages.select("doc", page.alias("page"), F.coalesce(get("$.preproc_blocks", "variant"), get("$.blocks", "variant")).alias("blocks"))
    rows = files.sparkSession.sql("SELECT doc, page, b.pos AS pos, b.value AS block FROM {own}, LATERAL variant_explode(blocks) b", own=own)
    box = F.array(*[F.try_variant_get("block", f"$.bbox[{i}]", "double") for i in range(4)])
    return rows.select("doc", "page", "pos", F.try_variant_get("block", "$.type", "string").alias("type"), box.alias("bbox")).filter(F.forall("bbox", lambda x: x.isNotNull()))


def markdown_images(files: DataFrame) -> DataFrame:
    """Image references line by line with the section above them and three lines around."""
    lines = files.select("path", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    w = W.partitionBy("path").orderBy("line_no")
    head = F.regexp_extract("line", r"^#{1,6}\s+(.+)$", 1)
    lines = lines.withColumn("section", F.last(F.when(head != "", head), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    lines = lines.withColumn("near", F.substring(F.array_join(F.collect_list("line").over(w.rowsBetween(-3, 3)), "\n"), 1, 1000))
    alt, ref = (F.regexp_extract("line", r"!\[([^\]]*)\]\(([^)\s]+)[^)]*\)", k) for k in (1, 2))
    return lines.select("path", "line_no", "section", "near", alt.alias("alt"), F.regexp_replace(ref, r"^[./]+", "").alias("image")).filter("image <> ''")


def markdown_table(text: Column, header: str) -> Column:
    """Cells of the first pipe table whose header row starts with `header`: array of arrays; ragged rows go."""
    lines = F.transform(F.split(text, "\n"), lambda s: F.trim(s))
    at = F.array_position(F.transform(lines, lambda s: s.startswith(header)), F.lit(True)).cast("int")
    rest = F.slice(lines, at, F.size(lines))
    stop = F.array_position(F.transform(rest, lambda s: s.startswith("|")), F.lit(False)).cast("int")
    rows = F.when(stop > 0, F.slice(rest, F.lit(1), F.greatest(stop - 1, F.lit(0)))).otherwise(rest)
    cells = F.transform(rows, lambda s: F.transform(F.split(F.regexp_replace(s, r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)))
    body = F.filter(cells, lambda r, i: (i != 1) & (F.size(r) == F.size(cells[0])))
    return F.when(at > 0, body)


def zip_members(spark: SparkSession, path: str, suffix: str, limit: int = 500 << 20) -> DataFrame:
    """(archive, name, content) of members with a suffix; an archive over the uncompressed limit is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path).select("path", "content")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    if sum(i.file_size for i in z.infolist()) > limit:
                        raise ValueError(f"{name}: uncompressed size over {limit}")
                    got = [(name, i.filename, z.read(i)) for i in z.infolist() if i.filename.endswith(suffix)]
                yield pd.DataFrame(got, columns=["archive", "name", "content"])

    return files.mapInPandas(run, "archive string, name string, content binary")


def preferred_member(names: DataFrame, order: list[str]) -> DataFrame:
    """One name per archive: the first of `order` that a name ends with, else the shallowest, shortest, least one."""
    rank = F.lit(len(order))
    for i, s in reversed(list(enumerate(order))):
        rank = F.when(F.col("name").endswith(s), i).otherwise(rank)
    key = F.struct(rank.alias("r"), F.size(F.split("name", "/")).alias("d"), F.length("name").alias("l"), F.col("name").alias("n"))
    return names.groupBy("archive").agg(F.min_by("name", key).alias("name"))


def discover(spark: SparkSession, root: str, pattern: str = "*.pdf") -> DataFrame:
    """Files under a folder by relative path, with size, SHA-256 and ordinal; equal paths once."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return f.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256")).dropDuplicates(["path"]).withColumn("ordinal", F.row_number().over(W.orderBy("path")) - 1)


def png_size(content: Column) -> Column:
    """Width and height from a PNG header, null for others; native."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    ok = F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A"
    return F.when(ok, F.struct(number(17).alias("width"), number(21).alias("height")))


def jpeg_size(data: bytes) -> tuple[int, int] | None:
    """Width and height by walking a JPEG's segments to the frame header."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 <= len(data) and data[at] == 0xFF:
        kind, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", data[at + 5 : at + 9])
            return w, h
        at += 2 + size
    return None


def event_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as VARIANT; broken lines are dropped."""
    return spark.read.text(path).select(F.try_parse_json("value").alias("event")).filter("event is not null")
