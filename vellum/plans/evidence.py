"""Evidence queries over documents, labels and pages: dedupe, readiness, gates, rebuilds, text."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions import text
from vellum.operators.relational import best_of_duplicates
from vellum.plans.blocks import blocks
from vellum.session import table

#: Tag -> block type.
TAG_TYPES = {"h1": "heading", "p": "text", "li": "list", "ul": "list", "a": "link", "b": "text", "div": "layout", "article": "layout", "nav": "noise", "script": "noise", "style": "noise"}


def block_noise_report(spark, d):
    b = blocks(table(spark, d, "documents")).withColumn("kept", ~F.col("block_type").isin("blank", "license"))
    return b.groupBy("block_type", "kept").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


def _graded(spark, d):
    docs = table(spark, d, "documents").withColumn("text_hash", text.text_hash(text.compact(F.col("text"))))
    return best_of_duplicates(docs.select("doc_id", "source", "text_hash"), ["text_hash"], ["source", "doc_id"])


def exact_dedupe(spark, d):
    return _graded(spark, d).filter("kept").select("doc_id", "text_hash", "group_size")


def dedupe_report(spark, d):
    """(kept, removed): the winner of each group with each of its losers."""
    return _graded(spark, d).filter("not kept").select(F.col("best_row.doc_id").alias("kept_id"), F.col("doc_id").alias("removed_id"))


def html_type_counts(spark, d):
    p = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1))).alias("tag"))
    lookup = F.create_map(*[F.lit(x) for kv in TAG_TYPES.items() for x in kv])
    return p.withColumn("block_type", F.coalesce(F.try_element_at(lookup, F.col("tag")), F.col("tag"))).groupBy("page_id", "block_type").agg(F.count("*").alias("n"))


def readiness(spark, d):
    n, t = F.col("n_chars"), F.col("text")
    why = F.concat_ws("; ", F.when(n < 100, "too_small"), F.when(~t.contains("\n"), "no_context"), F.when(n > 20000, "too_large"))
    state = F.when(n < 100, "skip").when(why != "", "low_confidence").otherwise("ready")
    return table(spark, d, "documents").select("doc_id", why.alias("reasons"), state.alias("readiness"))


def quality_gate(spark, d):
    """Reasons in order, joined without repeats, and the cap of the first one."""
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    j = j.withColumn("r", F.array_compact(F.array(F.when(F.col("quality") == 0, "axis_readability"), F.when(F.col("toxic") == 1, "calibration_status"), F.when(F.col("n_chars") < 500, "unit_missing"), F.when(F.col("n_chars") < 200, "scale_missing"))))
    cap = F.when(F.array_contains("r", "axis_readability") | F.array_contains("r", "calibration_status"), 0.6).when(F.size("r") > 0, 0.65).otherwise(0.95)
    return j.select("doc_id", F.array_join("r", ";").alias("reasons"), cap.alias("confidence"), (F.size("r") > 0).alias("needs_review"))


def fact_rebuild(spark, d):
    """Displayable facts stay; documents without one get rebuilt lines; those without either get a missing row."""
    docs, labels = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "labels")
    have = labels.filter("quality = 1").select("doc_id", F.lit("existing").alias("origin"), F.lit(1).cast("bigint").alias("n_points"))
    todo = docs.join(have, "doc_id", "left_anti")
    built = todo.withColumn("n_points", F.size(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).cast("bigint"))
    rebuilt = built.filter("n_points > 0").select("doc_id", F.lit("rebuilt").alias("origin"), "n_points")
    missing = built.filter("n_points = 0").select("doc_id", F.lit("missing").alias("origin"), "n_points")
    return have.unionByName(rebuilt).unionByName(missing)


def sentence_split(spark, d):
    s = table(spark, d, "documents").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("pos", "sentence"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.max(F.length("sentence")).cast("bigint").alias("longest"), F.sum(F.length("sentence")).cast("bigint").alias("chars"))


def keyword_argmax(spark, d):
    """The category with most contained terms; of equal scores the larger name."""
    p = table(spark, d, "part")
    cats = {"metal": ["bolt", "ring", "gear"], "colour": ["red", "blue", "green"], "size": ["small", "large", "mini"], "other": ["widget", "ing"]}
    score = lambda words: sum((F.col("p_name").contains(w).cast("int") for w in words), F.lit(0))
    best = F.greatest(*[F.struct(score(w).alias("score"), F.lit(c).alias("category")) for c, w in cats.items()])
    return p.select("p_partkey", best["category"].alias("category"), best["score"].alias("score"))


def citation_markers(spark, d):
    c = table(spark, d, "conversations")
    m = text.reference_markers(F.concat(F.col("text"), F.lit(" [1, 2-5] and ["), F.col("turn").cast("string"), F.lit("]")))
    return c.select("conv_id", "turn", F.array_join(m, "|").alias("markers"), F.size(m).alias("n_markers"))


def figure_labels(spark, d):
    p = table(spark, d, "part").withColumn("caption", F.concat(F.lit("Figure "), F.col("p_partkey").cast("string"), F.lit(". "), F.col("p_name")))
    return p.select("p_partkey", text.figure_number(F.col("caption")).alias("figure"), text.slug(F.col("caption")).alias("slug"), text.safe_name(F.col("p_name")).alias("file_name"))


QUERIES = {f.__name__: f for f in (block_noise_report, exact_dedupe, dedupe_report, html_type_counts, readiness, quality_gate, fact_rebuild, sentence_split, keyword_argmax, citation_markers, figure_labels)}

_HASH = "sha1(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))))"
_TAGS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TAG_TYPES.items())
ORACLE = {
    "block_noise_report": """WITH b0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
b AS (SELECT doc_id, CASE WHEN trim(line, ' ') = '' THEN 'blank' WHEN lower(line) LIKE '%licen%' THEN 'license' WHEN length(trim(line, ' ')) < 40 THEN 'short' ELSE 'text' END AS block_type FROM b0)
SELECT block_type, block_type NOT IN ('blank', 'license') AS kept, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM b GROUP BY ALL""",
    "exact_dedupe": f"SELECT doc_id, {_HASH} AS text_hash, count(*) OVER (PARTITION BY {_HASH}) AS group_size FROM documents QUALIFY row_number() OVER (PARTITION BY {_HASH} ORDER BY source, doc_id) = 1",
    "dedupe_report": f"WITH g AS (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY {_HASH} ORDER BY source, doc_id) AS kept_id FROM documents) SELECT kept_id, doc_id AS removed_id FROM g WHERE kept_id <> doc_id",
    "html_type_counts": f"WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) SELECT page_id, CASE tag {_TAGS} ELSE tag END AS block_type, count(*) AS n FROM t GROUP BY ALL",
    "readiness": "WITH r AS (SELECT doc_id, n_chars, concat_ws('; ', CASE WHEN n_chars < 100 THEN 'too_small' END, CASE WHEN NOT contains(text, chr(10)) THEN 'no_context' END, CASE WHEN n_chars > 20000 THEN 'too_large' END) AS reasons FROM documents) SELECT doc_id, reasons, CASE WHEN n_chars < 100 THEN 'skip' WHEN reasons <> '' THEN 'low_confidence' ELSE 'ready' END AS readiness FROM r",
    "quality_gate": "WITH r AS (SELECT d.doc_id, quality, toxic, concat_ws(';', CASE WHEN quality = 0 THEN 'axis_readability' END, CASE WHEN toxic = 1 THEN 'calibration_status' END, CASE WHEN n_chars < 500 THEN 'unit_missing' END, CASE WHEN n_chars < 200 THEN 'scale_missing' END) AS reasons FROM documents d JOIN labels l ON d.doc_id = l.doc_id) SELECT doc_id, reasons, (CASE WHEN quality = 0 OR toxic = 1 THEN 0.6 WHEN reasons <> '' THEN 0.65 ELSE 0.95 END)::DOUBLE AS confidence, reasons <> '' AS needs_review FROM r",
    "fact_rebuild": "WITH h AS (SELECT doc_id FROM labels WHERE quality = 1), b AS (SELECT doc_id, len(regexp_extract_all(text, '[0-9]+')) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM h)) SELECT doc_id, 'existing' AS origin, 1::BIGINT AS n_points FROM h UNION ALL SELECT doc_id, CASE WHEN n > 0 THEN 'rebuilt' ELSE 'missing' END, n FROM b",
    "sentence_split": "WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?。])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS s FROM documents) SELECT doc_id, count(*) AS n_sentences, max(length(s)) AS longest, sum(length(s))::BIGINT AS chars FROM s WHERE s <> '' GROUP BY doc_id",
    "keyword_argmax": """WITH c AS (SELECT p_partkey, unnest(['metal', 'colour', 'size', 'other']) AS category, unnest([contains(p_name, 'bolt')::INT + contains(p_name, 'ring')::INT + contains(p_name, 'gear')::INT,
 contains(p_name, 'red')::INT + contains(p_name, 'blue')::INT + contains(p_name, 'green')::INT, contains(p_name, 'small')::INT + contains(p_name, 'large')::INT + contains(p_name, 'mini')::INT, contains(p_name, 'widget')::INT + contains(p_name, 'ing')::INT]) AS score FROM part)
SELECT p_partkey, category, score FROM c QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, category DESC) = 1""",
    "citation_markers": "WITH m AS (SELECT conv_id, turn, unnest(l) AS m, generate_subscripts(l, 1) AS pos FROM (SELECT conv_id, turn, regexp_extract_all(text || ' [1, 2-5] and [' || turn || ']', '\\[\\d+(?:\\s*[,\\-–]\\s*\\d+)*\\]') AS l FROM conversations)), f AS (SELECT conv_id, turn, m, min(pos) AS pos FROM m GROUP BY ALL) SELECT conv_id, turn, string_agg(m, '|' ORDER BY pos) AS markers, count(*)::INT AS n_markers FROM f GROUP BY conv_id, turn",
    "figure_labels": "SELECT p_partkey, p_partkey::INT AS figure, 'figure-' || p_partkey || '-' || replace(p_name, ' ', '-') AS slug, replace(p_name, ' ', '_') AS file_name FROM part",
}
