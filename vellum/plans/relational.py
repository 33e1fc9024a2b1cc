"""Scheduling and snapshot queries bound to orders, lineitem and customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import audit
from vellum.operators import relational as R
from vellum.session import table

_C = "pending queued processing succeeded reused failed cancelled".split()


def active_counts(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    j = o.join(li.select("l_orderkey", "l_returnflag"), F.col("o_orderkey") == F.col("l_orderkey")).filter("o_orderstatus <> 'F'")
    return j.groupBy("o_orderstatus", "l_returnflag").agg(F.count("*").alias("n_active"), F.count_distinct("o_custkey").alias("n_runs"))


def window_open(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    n = o.filter("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    open_ = F.coalesce("n", F.lit(0))
    j = c.join(n, c.c_custkey == n.o_custkey, "left").filter(F.col("c_custkey") % 5 + 1 > open_)
    return j.select("c_custkey", (F.col("c_custkey") % 5 + 1).alias("allowance"), open_.alias("n_open"))


def compatible_runs(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    two = o.join(li.filter("l_returnflag = 'R'"), o.o_orderkey == F.col("l_orderkey"), "left_semi")
    two = two.join(li.filter("l_linestatus = 'O'"), o.o_orderkey == F.col("l_orderkey"), "left_semi")
    return R.latest_per_key(two, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")


def compatible_failed(spark, d):
    c, o, li = table(spark, d, "customer"), table(spark, d, "orders"), table(spark, d, "lineitem")
    late = li.filter("l_linenumber = 1").groupBy("l_orderkey").agg(F.max("l_returnflag").alias("flag"))
    j = c.join(o, c.c_custkey == o.o_custkey).join(late, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    j = j.filter((F.col("o_orderstatus") == "F") | F.col("flag").isNull() | (F.col("flag") == "R"))
    top = R.latest_per_key(j, ["c_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")])
    return top.select("c_custkey", "o_orderkey", "o_orderstatus", F.coalesce("flag", F.lit("-")).alias("flag"))


def no_live_job(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o.filter("o_orderstatus = 'O'"), c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", "c_name")


def status_pivot(spark, d):
    return R.pivot_counts(table(spark, d, "lineitem"), ["l_returnflag"], "l_linestatus", ["F", "O", "X"])


def status_fold(spark, d):
    s = F.element_at(F.array(*map(F.lit, _C)), (F.col("l_partkey") % 7 + 1).cast("int"))
    return R.fold_status(table(spark, d, "lineitem"), ["l_orderkey"], s, F.col("l_suppkey") % 2 == 0)


def keyset_page(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return R.keyset_page(o, ["o_custkey", "o_orderkey"], (40, 100), 64)


def bounded_admission(spark, d):
    o = table(spark, d, "orders")
    got = R.admit(o.filter("o_orderstatus = 'P'"), o.filter("o_orderstatus = 'O'"), "o_custkey", ["o_orderdate", "o_orderkey"], F.lit(6))
    return got.select("o_custkey", "o_orderkey")


def latest_per_key(spark, d):
    return R.latest_per_key(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


def ancestor_walk(spark, d):
    o = table(spark, d, "orders")
    return R.ancestor(o.select(F.col("o_orderkey").alias("id"), F.expr("o_orderkey div 2").alias("parent"), (F.col("o_orderstatus") == "F").alias("ok")))


def snapshot_tables(spark, d):
    """As of a cutoff: scoped orders, their lines by semi-join, counts and checksums by table."""
    o = table(spark, d, "orders").filter("o_orderdate < timestamp_ntz'1997-01-01' and o_orderstatus <> 'P'")
    li = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == o.o_orderkey, "left_semi")
    c = table(spark, d, "customer").join(o, F.col("c_custkey") == o.o_custkey, "left_semi")
    parts = [("customer", c, ["c_custkey", "c_name"]), ("lineitem", li, ["l_orderkey", "l_linenumber", "l_partkey"]), ("orders", o, ["o_orderkey", "o_custkey"])]
    out = None
    for name, df, cols in parts:
        # the sum of 52 bits of each row's hash does not depend on the order of rows, and is made in every task
        h = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(x).cast("string") for x in cols])), 1, 8), 16, 10).cast("bigint")
        one = df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"), F.sum(h).alias("checksum"))
        out = one if out is None else out.unionByName(one)
    return out


def unpivot_points(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_discount", "l_tax")
    long = li.unpivot("l_returnflag", ["l_quantity", "l_discount", "l_tax"], "measure", "value")
    return long.groupBy("l_returnflag", "measure").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.round(F.sum("value"), 2).alias("total"))


def box_unpivot(spark, d):
    """Box-plot statistics of each part type, unpivoted to points."""
    stats = table(spark, d, "part").groupBy("p_type").agg(F.min("p_size").cast("double").alias("min"), F.percentile("p_size", 0.25).alias("q1"), F.percentile("p_size", 0.5).alias("median"), F.percentile("p_size", 0.75).alias("q3"), F.max("p_size").cast("double").alias("max"))
    return stats.unpivot("p_type", ["min", "q1", "median", "q3", "max"], "point", "value")


def table_matrix(spark, d):
    """Header-ordered string matrix of at most 500 rows with the uncapped total."""
    return audit.string_matrix(table(spark, d, "customer"), {"c0": ["c_custkey"], "c1": ["name", "c_name"], "c2": ["c_nationkey"], "c3": ["gone"]}, ["c_custkey"])


QUERIES = {f.__name__: f for f in (active_counts, window_open, compatible_runs, compatible_failed, no_live_job, status_pivot, status_fold, keyset_page, bounded_admission, latest_per_key, ancestor_walk, snapshot_tables, unpivot_points, box_unpivot, table_matrix)}

_SUM = "sum(('0x' || substr(md5({0}), 1, 8))::BIGINT)::BIGINT"
ORACLE = {
    "active_counts": "SELECT o_orderstatus, l_returnflag, count(*) AS n_active, count(DISTINCT o_custkey) AS n_runs FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F' GROUP BY ALL",
    "window_open": "SELECT c_custkey, c_custkey % 5 + 1 AS allowance, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS n_open FROM customer WHERE c_custkey % 5 + 1 > (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')",
    "compatible_runs": "SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O') QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "compatible_failed": "WITH late AS (SELECT l_orderkey, max(l_returnflag) AS flag FROM lineitem WHERE l_linenumber = 1 GROUP BY l_orderkey) SELECT c_custkey, o_orderkey, o_orderstatus, coalesce(flag, '-') AS flag FROM customer JOIN orders ON c_custkey = o_custkey LEFT JOIN late ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' OR flag IS NULL OR flag = 'R' QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1",
    "no_live_job": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')",
    "status_pivot": "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS n_F, count(*) FILTER (WHERE l_linestatus = 'O') AS n_O, count(*) FILTER (WHERE l_linestatus = 'X') AS n_X, count(*) AS total FROM lineitem GROUP BY l_returnflag",
    "status_fold": """
WITH s AS (SELECT l_orderkey, list_extract(['pending','queued','processing','succeeded','reused','failed','cancelled'], (l_partkey % 7 + 1)::INT) AS s, l_suppkey % 2 = 0 AS act FROM lineitem),
g AS (SELECT l_orderkey, bool_or(act) AS act, bool_or(s IN ('pending','queued','processing')) AS opn, bool_and(s IN ('succeeded','reused')) AS done,
 bool_or(s IN ('succeeded','reused')) AS part_done, bool_or(s = 'failed') AS bad, bool_and(s = 'cancelled') AS gone FROM s GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN opn THEN CASE WHEN act THEN 'running' ELSE 'pending' END WHEN done THEN 'succeeded' WHEN part_done AND bad THEN 'partial_failed' WHEN gone THEN 'cancelled' ELSE 'failed' END AS run_status FROM g""",
    "keyset_page": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE (o_custkey, o_orderkey) > (40, 100) ORDER BY o_custkey, o_orderkey LIMIT 64",
    "bounded_admission": "WITH a AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey), w AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders WHERE o_orderstatus = 'P') SELECT w.o_custkey, o_orderkey FROM w LEFT JOIN a ON a.o_custkey = w.o_custkey WHERE rn <= 6 - coalesce(n, 0)",
    "latest_per_key": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "ancestor_walk": "WITH RECURSIVE n AS (SELECT o_orderkey AS id, o_orderkey // 2 AS parent, o_orderstatus = 'F' AS ok FROM orders), walk AS (SELECT id AS start, id, parent, ok, 0 AS steps FROM n UNION ALL SELECT w.start, n.id, n.parent, n.ok, w.steps + 1 FROM walk w JOIN n ON w.parent = n.id WHERE NOT w.ok AND w.steps < 32) SELECT start, id AS found, steps FROM walk WHERE ok",
    "snapshot_tables": f"""
WITH o AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' AND o_orderstatus <> 'P')
SELECT 'customer' AS table_name, count(*) AS n_rows, {_SUM.format("concat_ws('|', c_custkey, c_name)")} AS checksum FROM customer WHERE c_custkey IN (SELECT o_custkey FROM o)
UNION ALL SELECT 'lineitem', count(*), {_SUM.format("concat_ws('|', l_orderkey, l_linenumber, l_partkey)")} FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)
UNION ALL SELECT 'orders', count(*), {_SUM.format("concat_ws('|', o_orderkey, o_custkey)")} FROM o""",
    "unpivot_points": "SELECT l_returnflag, measure, count(*) AS n, min(value) AS lo, max(value) AS hi, round(sum(value), 2) AS total FROM (SELECT l_returnflag, unnest(['l_quantity','l_discount','l_tax']) AS measure, unnest([l_quantity, l_discount, l_tax]) AS value FROM lineitem) GROUP BY ALL",
    "box_unpivot": "WITH s AS (SELECT p_type, min(p_size)::DOUBLE AS a, quantile_cont(p_size, 0.25)::DOUBLE AS b, quantile_cont(p_size, 0.5)::DOUBLE AS c, quantile_cont(p_size, 0.75)::DOUBLE AS d, max(p_size)::DOUBLE AS e FROM part GROUP BY p_type) SELECT p_type, unnest(['min','q1','median','q3','max']) AS point, unnest([a, b, c, d, e]) AS value FROM s",
    "table_matrix": "SELECT c_custkey::VARCHAR AS c0, coalesce(c_name, '') AS c1, coalesce(c_nationkey::VARCHAR, '') AS c2, '' AS c3, (SELECT count(*) FROM customer) AS total FROM customer ORDER BY c_custkey LIMIT 500",
}
