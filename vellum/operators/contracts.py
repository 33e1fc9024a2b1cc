"""Evidence contracts and result contracts: roles, excerpts, prompt maps, caption focus, semantic and fact projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions import text
from vellum.operators.axes import given

#: Buckets in the order in which a contract lists them; a prompt takes the first five.
ORDER = ("primary_caption", "allowed_context", "tables", "formulas", "references", "background_context", "sibling_context", "excluded_context")
#: Relation -> level of its text; other texts have their block's type.
LEVELS = {
    "primary_caption": "caption_body", "caption_continuation": "caption_body", "adjacent_table": "table", "adjacent_formula": "formula",
    "same_section": "section_heading", "background": "background_text", "sibling_panel": "sibling_panel",
}
#: Words for confidences.
CONFIDENCES = {"high": 0.9, "very high": 1.0, "medium": 0.6, "moderate": 0.6, "low": 0.3, "very low": 0.1}
#: Other names of semantic fields, required fields, excerpt lengths and the number of prompt items.
ALIASES = {
    "panel_relevance": "relevance", "application_task": "task,application", "assay": "assay_class", "metric_category": "metric_type",
    "panel_decision": "", "panel_type": "", "confidence": "",
}
REQUIRED = ("panel_relevance", "panel_decision", "application_task", "assay", "metric_category", "panel_type")
EXCERPT, PROMPT_EXCERPT, PROMPT_ITEMS, FOCUS = 360, 240, 20, 500
MISSING_CAP, UNKNOWN = 0.4, 0.5


def _lookup(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def text_level(relation: Column, block_type: Column) -> Column:
    return F.coalesce(_lookup(LEVELS, relation), F.nullif(block_type, F.lit("")), F.lit("text"))


def text_format(html: Column, latex: Column) -> Column:
    return F.when(F.coalesce(html, F.lit("")) != "", "html").when(F.coalesce(latex, F.lit("")) != "", "latex").otherwise("plain_text")


def evidence_role(relation: Column, policy: Column) -> Column:
    """The role of an item: a caption or the panel's own visual is primary whatever its policy."""
    return (
        F.when(relation.isin("primary_caption", "same_panel_visual"), "primary")
        .when(policy == "background_only", "background")
        .when(policy == "do_not_use_for_current_panel", "non_current_panel")
        .otherwise("supporting")
    )


def policy_role(relation: Column, policy: Column) -> Column:
    """The role where an item has none: only extractable captions and visuals are primary."""
    return F.when((policy != "use_for_facts") & relation.isin("primary_caption", "same_panel_visual") & ~policy.isin("background_only", "do_not_use_for_current_panel"), "supporting").when(
        policy == "background_only", "background"
    ).when(policy == "do_not_use_for_current_panel", "non_current_panel").otherwise(evidence_role(relation, policy))


def segment_reference() -> Column:
    """An item that stands for a caption segment; its text is told elsewhere."""
    return (F.col("source_type") == "caption") & (F.col("relation") == "primary_caption") & (F.col("text_level") == "caption_segment")


def contract_items(evidence: DataFrame, key: list[str], excerpt: int = EXCERPT) -> DataFrame:
    """Items (key, bucket, pos, evidence_id, source_type, relation, use_policy, text_level, text) in contract order.

    Of items with one id the first in the order of buckets stays; items without an id go. `item` numbers
    those of a key from 0.
    """
    place = _lookup({b: i for i, b in enumerate(ORDER)}, F.col("bucket"))
    e = evidence.withColumn("place", place).filter("place IS NOT NULL AND coalesce(evidence_id, '') <> ''")
    first = W.partitionBy(*key, "evidence_id").orderBy("place", "pos")
    e = e.withColumn("rn", F.row_number().over(first)).filter("rn = 1")
    item = F.row_number().over(W.partitionBy(*key).orderBy("place", "pos", "evidence_id")) - 1
    ref = segment_reference()
    role = policy_role(F.col("relation"), F.col("use_policy"))
    own = F.substring(F.coalesce("text", F.lit("")), 1, excerpt)
    return e.select(*key, item.alias("item"), "evidence_id", "bucket", "relation", "use_policy", role.alias("role"), F.when(ref, "").otherwise(own).alias("text_excerpt"), ref.alias("caption_segment_ref"))


def prompt_items(evidence: DataFrame, key: list[str]) -> DataFrame:
    """The first PROMPT_ITEMS items of a key from the first five buckets, with short excerpts."""
    return contract_items(evidence.filter(F.col("bucket").isin(*ORDER[:5])), key, PROMPT_EXCERPT).filter(F.col("item") < PROMPT_ITEMS)


def by_policy(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(for facts, for disambiguation)"""
    use = F.coalesce(F.col("use_policy") == "use_for_facts", F.lit(False))
    return items.filter(use), items.filter(~use)


def contract_document(items: DataFrame, key: list[str]) -> DataFrame:
    """key, document: JSON with the items in order, their ids by policy, and the number of them."""
    one = F.struct("item", "evidence_id", "bucket", "relation", "use_policy", "role", "text_excerpt")
    g = items.groupBy(*key).agg(F.array_sort(F.collect_list(one)).alias("items"))
    ids = lambda use: F.transform(F.filter("items", lambda x: (x["use_policy"] == "use_for_facts") == F.lit(use)), lambda x: x["evidence_id"])
    doc = F.struct(F.size("items").alias("n_items"), ids(True).alias("extractable"), ids(False).alias("disambiguation"), F.col("items").alias("items"))
    return g.select(*key, F.to_json(doc).alias("document"))


def full_caption(c: Column) -> Column:
    """A caption that names a figure's number; a lone panel letter is none."""
    clean = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    lone = clean.rlike(r"^(?:text\s*)?\(?[A-Za-z]\)?\s*$")
    return (clean != "") & ~lone & clean.rlike(r"(?i)\b(?:fig(?:ure)?\.?)\s*\d+")


def caption_focus(caption: Column, panel_id: Column) -> Column:
    """The caption from the panel's label to the next full stop, at most FOCUS characters; without a short label or a hit its beginning."""
    label = F.lower(F.trim(F.element_at(F.split(F.coalesce(panel_id, F.lit("")), "-"), -1)))
    body = F.trim(F.regexp_replace(F.coalesce(caption, F.lit("")), r"(?U)\s+", " "))
    form = F.concat(F.lit(r"(?is)(\(?\s*\Q"), label, F.lit(r"\E\s*[\):.\s,;].*)"))
    tail = F.substring(F.call_function("regexp_extract", body, form, F.lit(1)), 1, FOCUS)
    head = F.substring_index(tail, ".", 1)
    usable = (label != "") & (F.length(label) <= 3)
    return F.when(~usable, F.substring(F.coalesce(caption, F.lit("")), 1, FOCUS)).when(tail == "", F.substring(body, 1, FOCUS)).otherwise(F.when(head != "", head).otherwise(tail))


def contained(part: Column, whole: Column) -> Column:
    """Whether a part's text, with its tags set apart, is in the whole's; without a whole it is."""
    fold = lambda c: F.lower(text.compact(F.replace(F.replace(c, F.lit("<"), F.lit(" <")), F.lit(">"), F.lit("> "))))
    return F.when(F.coalesce(whole, F.lit("")) == "", True).otherwise((fold(part) != "") & fold(whole).contains(fold(part)))


def confidence_value(c: Column) -> Column:
    """A number, a percentage or a word as a confidence within 0 and 1; null for others."""
    low = F.lower(F.trim(c))
    percent = F.regexp_extract(low, r"^([0-9.]+)%$", 1).try_cast("double") / 100
    got = F.coalesce(percent, low.try_cast("double"), _lookup(CONFIDENCES, low))
    return F.when(got.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), got)))


def semantic(payload: Column) -> Column:
    """struct of the semantic fields of a JSON payload: other names copied, confidence held within 0 and 1 and to MISSING_CAP if a required field lacks."""
    field = lambda k: F.coalesce(*[given(F.get_json_object(payload, f"$.{n}")) for n in [k, *filter(None, ALIASES.get(k, "").split(","))]])
    missing = F.lit(0)
    for k in REQUIRED:
        missing = missing + field(k).isNull().cast("int")
    word = F.lower(F.get_json_object(payload, "$.confidence"))
    number = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(word.try_cast("double"), _lookup(CONFIDENCES, word), F.lit(UNKNOWN))))
    relevance = F.when(field("panel_relevance") == "background", "context_only").otherwise(F.coalesce(field("panel_relevance"), F.lit("unusable")))
    decision = F.coalesce(field("panel_decision"), F.lit("skip_metrics"))
    own_role = F.coalesce(given(F.get_json_object(payload, "$.evidence_role")))
    role = F.coalesce(own_role, F.when(decision == "extract_supporting_observation", "supporting_observation").when(relevance == "unusable", "unusable").otherwise("schematic_context"))
    return F.struct(
        relevance.alias("panel_relevance"),
        decision.alias("panel_decision"),
        role.alias("evidence_role"),
        F.coalesce(field("application_task"), F.lit("")).alias("application_task"),
        F.coalesce(field("metric_category"), F.lit("")).alias("metric_category"),
        F.when(missing > 0, F.least(number, F.lit(MISSING_CAP))).otherwise(number).alias("confidence"),
        missing.alias("n_missing"),
    )


def digitize(decision: Column, needs: Column) -> Column:
    """A panel is digitized if metrics are extracted from it and it needs that."""
    return F.coalesce((decision == "extract_target_metrics") & needs, F.lit(False))


def fallback(block_type: Column) -> Column:
    """struct(role, decision, needs_digitization, panel_type) of a panel that no model classified, by its block's type."""
    chart = F.coalesce(F.lower(block_type) == "chart", F.lit(False))
    return F.struct(
        F.when(chart, "primary_metric_panel").otherwise("supporting_observation").alias("evidence_role"),
        F.when(chart, "extract_target_metrics").otherwise("extract_supporting_observation").alias("panel_decision"),
        chart.alias("needs_digitization"),
        F.coalesce(F.nullif(F.lower(block_type), F.lit("")), F.lit("unknown")).alias("panel_type"),
    )


def unwrapped(payload: Column, name: str, required: list[str]) -> Column:
    """The object under `name` of a JSON payload if it has a required field or is all there is, else the payload."""
    inner = F.get_json_object(payload, f"$.{name}")
    keys = F.coalesce(F.json_object_keys(inner), F.array().cast("array<string>"))
    fits = F.arrays_overlap(keys, F.array(*map(F.lit, required))) if required else F.lit(False)
    alone = F.size(F.json_object_keys(payload)) == 1
    return F.when(inner.startswith("{") & (fits | alone), inner).otherwise(payload)


def visual_facts(panels: DataFrame, payload: str = "payload", panel: str = "panel_id") -> DataFrame:
    """panel, index, fact_id, fact_type, subject, attribute, value: fact candidates of JSON payloads that say something.

    Candidates are numbered from 1 as they stand; one without an id is named by panel and number.
    """
    names = ("fact_id", "fact_type", "subject_slot", "subject", "target_entity", "attribute_slot", "attribute", "observation_name", "value_slot", "value", "qualitative_value")
    item = "array<struct<" + ",".join(f"{n}:string" for n in names) + ">>"
    rows = panels.select(panel, F.posexplode(F.from_json(F.get_json_object(payload, "$.visual_fact_candidates"), item)).alias("pos", "c"))
    first = lambda *ks: F.coalesce(*[given(F.col(f"c.{k}")) for k in ks], F.lit(""))
    out = rows.select(
        panel,
        (F.col("pos") + 1).alias("index"),
        F.coalesce(given(F.col("c.fact_id")), F.concat(F.col(panel), F.lit("-vf-"), (F.col("pos") + 1).cast("string"))).alias("fact_id"),
        F.coalesce(given(F.col("c.fact_type")), F.lit("other_visual_fact")).alias("fact_type"),
        first("subject_slot", "subject", "target_entity").alias("subject"),
        first("attribute_slot", "attribute", "observation_name").alias("attribute"),
        first("value_slot", "value", "qualitative_value").alias("value"),
    )
    return out.filter("subject <> '' OR attribute <> '' OR value <> ''")


def with_groups(payloads: DataFrame, groups: DataFrame, key: str = "group_id") -> DataFrame:
    """`payloads` (key, metric_category) with their group's category; an own one that differs is kept as domain_metric_category."""
    g = groups.select(key, F.col("metric_category").alias("of_group"))
    j = payloads.join(g, key, "left")
    own, of = given(F.col("metric_category")), given(F.col("of_group"))
    return j.withColumn("domain_metric_category", F.when(own.isNotNull() & of.isNotNull() & (own != of), own)).withColumn("metric_category", F.coalesce(of, own, F.lit(""))).drop("of_group")


def key_points(points: DataFrame, key: list[str], series: str = "series_name") -> DataFrame:
    """key, series, and `points`: ids of a series' first, least, greatest and last point, each point once, in that order.

    Points are (key, series, point_index, chart_point_id, y_value); of equal values the first counts; points
    without a value are first or last all the same.
    """
    order = F.struct("point_index", "chart_point_id")
    g = points.groupBy(*key, series).agg(
        F.min_by("chart_point_id", order).alias("first"),
        F.min_by("chart_point_id", F.when(F.col("y_value").isNotNull(), F.struct("y_value", "point_index", "chart_point_id"))).alias("least"),
        F.min_by("chart_point_id", F.when(F.col("y_value").isNotNull(), F.struct((-F.col("y_value")).alias("down"), "point_index", "chart_point_id"))).alias("greatest"),
        F.max_by("chart_point_id", order).alias("last"),
    )
    return g.select(*key, series, F.array_distinct(F.array_compact(F.array("first", "least", "greatest", "last"))).alias("points"))
