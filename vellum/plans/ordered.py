"""Ordered and stateful analytics over events, orders and conversations, as windows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.operators.relational import first_mode
from vellum.operators import graph
from vellum.session import table


def _by(*keys):
    return W.partitionBy(*keys)


def heading_stack(spark, d):
    """Ancestors of each visual: headings before it that no later heading of the same or a higher level closes.

    Orders of a customer are the page, odd keys headings with the priority's digit as level, even keys visuals.
    """
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("level"))
    h = graph.open_headings(o.withColumn("level", F.when(F.col("o_orderkey") % 2 == 1, F.col("level"))), ["o_custkey"], "o_orderkey", "level")
    path = h.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("visual"), F.posexplode(F.reverse("open")).alias("pos", "h"))
    return path.select("visual", F.col("h.at").alias("heading"), F.col("h.level").alias("level"), (F.col("pos") + 1).alias("distance"))


def neighbour_context(spark, d):
    c = table(spark, d, "conversations")
    w = _by("conv_id").orderBy("turn").rangeBetween(-3, 3)
    return c.select("conv_id", "turn", (F.count("*").over(w) - 1).alias("n_near"), (F.sum(F.length("text")).over(w) - F.length("text")).alias("near_chars"), F.min("turn").over(w).alias("first_turn"))


def sibling_context(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role")
    per = c.groupBy("conv_id", "role").agg(F.count("*").alias("n"), F.min("turn").alias("lo"), F.max("turn").alias("hi")).withColumnRenamed("role", "other_role")
    j = c.join(per, "conv_id").filter("other_role <> role")  # a conversation has few roles
    return j.groupBy("conv_id", "turn").agg(F.sum("n").alias("n_siblings"), F.min("lo").alias("first_sibling"), F.max("hi").alias("last_sibling"))


def citation_lookahead(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    label = c.select("conv_id", "turn", F.regexp_extract("text", "([A-Za-z]{5,})", 1).alias("label")).filter("label <> ''")
    ahead = c.select("conv_id", F.col("turn").alias("cited_in"), F.col("text").alias("later"))
    j = label.join(ahead, "conv_id").filter("cited_in between turn + 1 and turn + 2").filter(F.col("later").contains(F.col("label")))
    return j.select("conv_id", "turn", "label", "cited_in")


def section_carry(spark, d):
    e = table(spark, d, "events")
    w = _by("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return e.select("event_id", F.last(F.when(F.col("event_type") == "signup", F.col("value")), ignorenulls=True).over(w).alias("carried"))


def series_summary(spark, d):
    e = table(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    by_value = lambda v: F.struct(v, F.col("ts"), F.col("event_id"))
    g = e.groupBy("user_id", "event_type").agg(
        F.count("*").alias("n_points"),
        F.min_by("value", "at").alias("first_value"),
        F.max_by("value", "at").alias("final_value"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.min_by("event_id", by_value(F.col("value"))).alias("min_point"),
        F.min_by("event_id", by_value(-F.col("value"))).alias("max_point"),
        F.bool_or(F.col("value") > 50).alias("needs_check"),
    )
    trend = F.when(F.col("n_points") < 2, "single").when(F.col("final_value") > F.col("first_value"), "up").when(F.col("final_value") < F.col("first_value"), "down").otherwise("flat")
    return g.withColumn("trend", trend)


def mode_first_seen(spark, d):
    return first_mode(table(spark, d, "events"), ["user_id"], "event_type", "event_id").select("user_id", "event_type", "n", "first_pos")


def live_progress(spark, d):
    e = table(spark, d, "events")
    err = F.col("event_type") == "error"
    return e.groupBy("user_id").agg(
        F.count_distinct("event_type").alias("n_panels"), F.max("value").alias("max_value"), F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).alias("n_candidates"),
        F.count_if(err).alias("n_errors"), F.min(F.when(err, F.col("event_id"))).alias("first_error"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_event"),
    )


def rate_window(spark, d):
    e = table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    near = lambda s: _by("user_id").orderBy("us").rangeBetween(-s * 1_000_000, 0)
    return e.select("event_id", F.count("*").over(near(3600)).alias("n_hour"), F.count("*").over(near(86400)).alias("n_day"), (F.count("*").over(near(3600)) > 2).alias("limited"))


def failure_islands(spark, d):
    """Runs of consecutive error events; a run of two or more opens the breaker."""
    e = table(spark, d, "events").withColumn("err", F.col("event_type") == "error")
    w = _by("user_id").orderBy("ts", "event_id")
    e = e.withColumn("island", F.row_number().over(w) - F.row_number().over(_by("user_id", "err").orderBy("ts", "event_id")))
    return e.filter("err").groupBy("user_id", "island").agg(F.count("*").alias("n_failures"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event")).filter("n_failures >= 2").drop("island")


def session_gaps(spark, d):
    e = table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    w = _by("user_id").orderBy("us", "event_id")
    new = F.when(F.col("us") - F.lag("us").over(w) <= 12 * 3600 * 1_000_000, 0).otherwise(1)
    e = e.withColumn("new", new).withColumn("session", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return e.groupBy("user_id", "session").agg(F.count("*").alias("n_events"), F.min("event_id").alias("first_event"), ((F.max("us") - F.min("us")) / 1_000_000).cast("bigint").alias("seconds"))


def token_rollup(spark, d):
    r = table(spark, d, "events").rollup("event_type").agg(F.count("*").alias("n_calls"), F.round(F.sum("value"), 2).alias("total"), F.grouping("event_type").cast("int").alias("is_total"))
    return r.withColumn("event_type", F.coalesce("event_type", F.lit("all")))


def breaker_state(spark, d):
    """Consecutive failures before each event, reset by any success."""
    e = table(spark, d, "events")
    w = _by("user_id").orderBy("ts", "event_id")
    ok = F.sum(F.when(F.col("event_type") != "error", 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0))
    e = e.withColumn("block", ok)
    fails = F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).over(_by("user_id", "block").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0))
    return e.select("event_id", fails.alias("failures"), (fails >= 2).alias("is_open"))


QUERIES = {f.__name__: f for f in (heading_stack, neighbour_context, sibling_context, citation_lookahead, section_carry, series_summary, mode_first_seen, live_progress, rate_window, failure_islands, session_gaps, token_rollup, breaker_state)}
_W = "OVER (PARTITION BY user_id ORDER BY ts, event_id"
ORACLE = {
    "heading_stack": """
WITH o AS (SELECT o_custkey, o_orderkey AS k, substr(o_orderpriority, 1, 1)::INT AS level FROM orders),
j AS (SELECT v.o_custkey, v.k AS visual, h.k AS heading, h.level FROM o v JOIN o h ON v.o_custkey = h.o_custkey AND h.k < v.k AND v.k % 2 = 0 AND h.k % 2 = 1),
m AS (SELECT *, min(level) OVER (PARTITION BY o_custkey, visual ORDER BY heading DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM j)
SELECT visual, heading, level, (row_number() OVER (PARTITION BY o_custkey, visual ORDER BY heading DESC))::INT AS distance FROM m WHERE low IS NULL OR low > level""",
    "neighbour_context": "SELECT conv_id, turn, count(*) OVER w - 1 AS n_near, (sum(length(text)) OVER w - length(text))::BIGINT AS near_chars, min(turn) OVER w AS first_turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)",
    "sibling_context": "SELECT a.conv_id, a.turn, count(*) AS n_siblings, min(b.turn) AS first_sibling, max(b.turn) AS last_sibling FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn <> b.turn AND a.role <> b.role GROUP BY ALL",
    "citation_lookahead": "WITH l AS (SELECT conv_id, turn, regexp_extract(text, '([A-Za-z]{5,})', 1) AS label FROM conversations) SELECT l.conv_id, l.turn, label, c.turn AS cited_in FROM l JOIN conversations c ON l.conv_id = c.conv_id AND c.turn BETWEEN l.turn + 1 AND l.turn + 2 WHERE label <> '' AND contains(c.text, label)",
    "section_carry": f"SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM events",
    "series_summary": """
WITH g AS (SELECT user_id, event_type, count(*) AS n_points, first(value ORDER BY ts, event_id) AS first_value, last(value ORDER BY ts, event_id) AS final_value, min(value) AS min_value, max(value) AS max_value,
 first(event_id ORDER BY value, ts, event_id) AS min_point, first(event_id ORDER BY value DESC, ts, event_id) AS max_point, bool_or(value > 50) AS needs_check FROM events GROUP BY ALL)
SELECT *, CASE WHEN n_points < 2 THEN 'single' WHEN final_value > first_value THEN 'up' WHEN final_value < first_value THEN 'down' ELSE 'flat' END AS trend FROM g""",
    "mode_first_seen": "WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_pos FROM events WHERE event_type <> '' GROUP BY ALL) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first_pos) = 1",
    "live_progress": "SELECT user_id, count(DISTINCT event_type) AS n_panels, max(value) AS max_value, count(*) FILTER (WHERE event_type = 'purchase') AS n_candidates, count(*) FILTER (WHERE event_type = 'error') AS n_errors, min(event_id) FILTER (WHERE event_type = 'error') AS first_error, last(event_type ORDER BY ts, event_id) AS last_event FROM events GROUP BY user_id",
    "rate_window": "SELECT event_id, count(*) OVER h AS n_hour, count(*) OVER y AS n_day, count(*) OVER h > 2 AS limited FROM events WINDOW h AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW), y AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW)",
    "failure_islands": f"WITH e AS (SELECT *, event_type = 'error' AS err, row_number() {_W}) - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) AS island FROM events) SELECT user_id, count(*) AS n_failures, min(event_id) AS first_event, max(event_id) AS last_event FROM e WHERE err GROUP BY user_id, island HAVING count(*) >= 2",
    "session_gaps": f"WITH e AS (SELECT *, CASE WHEN ts - lag(ts) {_W}) <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, (sum(new) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS session FROM e) SELECT user_id, session, count(*) AS n_events, min(event_id) AS first_event, ((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000)::BIGINT AS seconds FROM s GROUP BY ALL",
    "token_rollup": "SELECT coalesce(event_type, 'all') AS event_type, count(*) AS n_calls, round(sum(value), 2) AS total, grouping(event_type)::INT AS is_total FROM events GROUP BY ROLLUP (event_type)",
    "breaker_state": f"WITH e AS (SELECT *, sum((event_type <> 'error')::INT) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS block FROM events), f AS (SELECT event_id, (sum((event_type = 'error')::INT) OVER (PARTITION BY user_id, block ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS failures FROM e) SELECT event_id, failures, failures >= 2 AS is_open FROM f",
}
