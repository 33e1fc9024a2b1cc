"""Nested blocks over conversations, pages and events: texts, captions, page lists, elements, Markdown."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import nested
from vellum.session import table

#: Raw types that exercise the parser's map, by turn.
RAW = ["text", "title", "chart", "Ref_Text", "interline_equation", "image"]


def _clean(c):
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def nested_parts(spark, d):
    """Turns as JSON blocks three objects deep: text without structural keys, captions of block and content, tags, formula, table."""
    c = table(spark, d, "conversations")
    tok = lambda t, x: F.struct(F.lit(t).alias("type"), x.alias("content"))
    inner = F.struct(
        F.col("turn").alias("level"),
        F.struct(F.col("role").alias("who"), F.array(F.col("text")).alias("said")).alias("body"),
        F.array(tok("text", F.col("role")), tok("equation inline", F.lit("a < b"))).alias("image_caption"),
        F.struct(F.concat(F.lit(" x_"), F.col("turn").cast("string")).alias("latex")).alias("math"),
        F.concat(F.lit("<table>"), F.col("role"), F.lit("</table>")).alias("html"),
    )
    block = F.to_json(F.struct(F.lit("chart").alias("type"), F.col("role").alias("image_caption"), inner.alias("content")))
    p = nested.block_parts(c.select("conv_id", "turn", block.alias("block")))
    caption = F.col("parts.captions")["image_caption"]
    return p.select("conv_id", "turn", F.md5("parts.text").alias("text_md5"), F.array_join(caption, "|").alias("caption"), "parts.rich_caption", "parts.latex", "parts.table_html")


def _flat(spark, d):
    """Events of a user as flat blocks; every fifth has no page."""
    e = table(spark, d, "events")
    page = F.when(F.col("event_id") % 5 != 0, (F.col("event_id") % 3).cast("int"))
    return e.select(F.col("user_id").alias("doc"), page.alias("page_idx"), F.col("event_id").alias("pos"), F.col("event_type").alias("block"))


def pages_nested(spark, d):
    n = nested.nest_pages(_flat(spark, d))
    return n.select("doc", F.array_join(F.transform("pages", lambda p: F.array_join(p, ",")), "|").alias("pages"))


def pages_flattened(spark, d):
    f = nested.flatten_pages(nested.nest_pages(_flat(spark, d)))
    return f.groupBy("doc", "page_idx").agg(F.count("*").alias("n"), F.min_by("block", "pos").alias("first_block"), F.max("pos").alias("last_pos"))


def parser_elements(spark, d):
    """Turns by raw type; images without a path take the next of the conversation's listed images."""
    c = table(spark, d, "conversations")
    raw = F.element_at(F.array(*map(F.lit, RAW)), (F.col("turn") % len(RAW)).cast("int") + 1)
    path = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("img/"), F.col("turn").cast("string"), F.lit(".png")))
    b = c.select(F.col("conv_id").alias("doc"), F.col("turn").alias("pos"), raw.alias("raw_type"), F.col("role").alias("text"), F.lit("").alias("caption"), path.alias("image_path"))
    images = c.filter("turn < 2").select(F.col("conv_id").alias("doc"), F.col("turn").alias("nth"), F.concat(F.lit("md/"), F.col("turn").cast("string")).alias("path"), F.concat(F.lit("alt "), "role").alias("alt"))
    return nested.elements(b, images)


def image_names(spark, d):
    """Links of pages by their last path part: the last one wins."""
    p = table(spark, d, "pages").select(F.col("page_id").alias("doc"), F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)">'), F.lit(1))).alias("pos", "path"))
    return nested.image_names(p.withColumn("alt", F.col("pos").cast("string")))


def markdown_from_blocks(spark, d):
    c = table(spark, d, "conversations")
    kind = F.when(F.col("turn") % 3 == 1, "image").otherwise("text")
    b = c.select(F.col("conv_id").alias("doc"), F.col("turn").alias("pos"), kind.alias("type"), _clean(F.col("text")).alias("text"), F.when(F.col("turn") % 2 == 0, F.col("role")).alias("caption"), F.when(F.col("turn") % 3 == 1, F.lit("a.png")).alias("image_path"))
    m = nested.markdown(b)
    return m.select("doc", F.md5("markdown").alias("markdown_md5"), F.length("preview").alias("preview_length"))


QUERIES = {f.__name__: f for f in (nested_parts, pages_nested, pages_flattened, parser_elements, image_names, markdown_from_blocks)}
_CLEAN = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
_TYPES = " ".join(f"WHEN {i} THEN '{nested.PARSER_TYPES.get(r, r.lower())}'" for i, r in enumerate(RAW))
ORACLE = {
    "nested_parts": f"""SELECT conv_id, turn, md5({_CLEAN.replace("text,", "role || ' ' || text || ' ' || role || ' a < b  x_' || turn,")}) AS text_md5, role || '|' || role || ' a < b' AS caption,
 '<text>' || role || '</text> <equation_inline>a &lt; b</equation_inline>' AS rich_caption, 'x_' || turn AS latex, '<table>' || role || '</table>' AS table_html FROM conversations""",
    "pages_nested": "WITH b AS (SELECT user_id AS doc, CASE WHEN event_id % 5 <> 0 THEN event_id % 3 ELSE 0 END AS page, event_id, event_type FROM events), p AS (SELECT doc, page, string_agg(event_type, ',' ORDER BY event_id) AS own FROM b GROUP BY ALL) SELECT doc, string_agg(own, '|' ORDER BY page) AS pages FROM p GROUP BY doc",
    "pages_flattened": """WITH b AS (SELECT user_id AS doc, CASE WHEN event_id % 5 <> 0 THEN event_id % 3 ELSE 0 END AS page, event_id, event_type FROM events),
p AS (SELECT doc, page, count(*) AS n, arg_min(event_type, event_id) AS first_block FROM b GROUP BY ALL)
SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY page) - 1)::INT AS page_idx, n, first_block, (n - 1)::INT AS last_pos FROM p""",
    "parser_elements": f"""WITH b AS (SELECT conv_id AS doc, turn AS pos, CASE turn % {len(RAW)} {_TYPES} END AS element_type, role AS text, CASE WHEN conv_id % 3 = 0 THEN 'img/' || turn || '.png' END AS path FROM conversations),
n AS (SELECT *, CASE WHEN element_type = 'image' AND path IS NULL THEN count(*) FILTER (WHERE element_type = 'image' AND path IS NULL) OVER (PARTITION BY doc ORDER BY pos) - 1 END AS nth FROM b),
j AS (SELECT n.*, 'md/' || c.turn AS listed, 'alt ' || c.role AS alt FROM n LEFT JOIN conversations c ON c.conv_id = n.doc AND c.turn = n.nth AND c.turn < 2)
SELECT doc, pos, element_type, CASE WHEN element_type = 'image' THEN coalesce(alt, '') ELSE text END AS text, coalesce(path, listed) AS image_path, element_type = 'image' AND coalesce(path, listed) IS NULL AS unresolved FROM j""",
    "image_names": """WITH p AS (SELECT page_id AS doc, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS xs FROM pages), x AS (SELECT doc, unnest(xs) AS path, generate_subscripts(xs, 1) - 1 AS pos FROM p),
n AS (SELECT *, list_last(string_split(path, '/')) AS name FROM x) SELECT doc, name, path, pos::VARCHAR AS alt FROM n QUALIFY row_number() OVER (PARTITION BY doc, name ORDER BY pos DESC) = 1""",
    "markdown_from_blocks": f"""WITH l AS (SELECT conv_id AS doc, turn, CASE WHEN turn % 3 = 1 THEN '![' || CASE WHEN turn % 2 = 0 THEN role ELSE coalesce(nullif({_CLEAN}, ''), 'image') END || '](a.png)' ELSE nullif({_CLEAN}, '') END AS line FROM conversations),
m AS (SELECT doc, string_agg(line, chr(10) || chr(10) ORDER BY turn) AS markdown FROM l WHERE line IS NOT NULL GROUP BY doc)
SELECT doc, md5(markdown) AS markdown_md5, length(left(trim(regexp_replace(replace(replace(replace(markdown, '![', '['), '](', ' '), ')', ' '), '\\s+', ' ', 'g')), 20000))::INT AS preview_length FROM m""",
}
