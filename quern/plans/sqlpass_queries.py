"""One conformance query per category of SQL that reaches Spark unchanged.

Joins, sets and subqueries go through ``run_sql``. Ordered work in groups that
may be large (as-of, running figures, ranges) uses the bucketed operators.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quern.functions.keys import keep_all
from quern.operators import sequences as S
from quern.operators.results import run_sql
from quern.plans.registry import query
from quern.sources.tables import read_table, read_tables

_MONEY = "CAST(sum(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"


def _own_views(text: str, tables: tuple[str, ...]) -> str:
    """The text over views of its own names, so that a caller's views stay as they are."""
    names = "|".join(tables)
    return re.sub(
        rf"\b(FROM|JOIN) ({names})\b(?! [a-z]\b)|\b(FROM|JOIN) ({names})\b",
        lambda m: f"{m[1]} quern_{m[2]} AS {m[2]}" if m[1] else f"{m[3]} quern_{m[4]}",
        text,
    )


def _sql(name: str, tables: tuple[str, ...], text: str, oracle: str | None = None, args: dict | None = None) -> None:
    """Register a query whose Spark text runs through ``run_sql``; the checking text is the same unless given."""

    @query(name, oracle or text)
    def _run(spark, d):
        read_tables(spark, d, tables, prefix="quern_")
        return run_sql(spark, _own_views(text, tables), args=args)


_sql(
    "i01_projection_filter",
    ("orders",),
    """
    SELECT o_orderkey, CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 300000 THEN 'middle' ELSE 'high' END AS band,
           coalesce(o_orderstatus, '?') AS status
    FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_orderpriority LIKE '%URGENT%'
      AND o_totalprice BETWEEN 1000 AND 400000 AND o_custkey IS NOT NULL
    """,
)
_sql(
    "i02_inner_join",
    ("lineitem", "orders", "customer"),
    f"""
    SELECT c_mktsegment, o_orderpriority, count(*) AS n, {_MONEY.format('l_extendedprice')} AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    GROUP BY c_mktsegment, o_orderpriority
    """,
)
_sql(
    "i03_left_join",
    ("orders", "customer"),
    f"""
    SELECT c_custkey, coalesce(orders, 0) AS orders, amount FROM customer LEFT JOIN (
      SELECT o_custkey, count(*) AS orders, {_MONEY.format('o_totalprice')} AS amount
      FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey
    """,
)
_sql(
    "i03_right_join",
    ("orders", "customer"),
    """
    SELECT c_custkey, c_mktsegment, CAST(newest AS STRING) AS newest FROM (
      SELECT o_custkey, max(o_orderkey) AS newest FROM orders GROUP BY o_custkey) o
    RIGHT JOIN customer ON c_custkey = o_custkey
    """,
)


@query(
    "i03_outer_join_hot_keys",
    """
    SELECT c_custkey, CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_totalprice FROM customer
    LEFT JOIN orders o ON c_custkey = o_custkey
    """,
)
def _outer_rows(spark, d):
    """All customers with each of their orders; one customer may hold a large part of the orders."""
    every = read_table(spark, d, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").cast("string").alias("o_orderkey"), "o_totalprice"
    )
    return keep_all(read_table(spark, d, "customer").select("c_custkey"), every, ["c_custkey"])


_sql(
    "i03_full_join",
    ("customer", "supplier"),
    """
    SELECT CAST(c.k AS STRING) AS customer_key, CAST(s.k AS STRING) AS supplier_key, coalesce(c.n, 0) + coalesce(s.n, 0) AS n
    FROM (SELECT c_custkey % 40 AS k, count(*) AS n FROM customer GROUP BY 1) c
    FULL JOIN (SELECT s_suppkey AS k, count(*) AS n FROM supplier GROUP BY 1) s ON c.k = s.k
    """,
)
_sql(
    "i04_semi_join",
    ("orders", "customer"),
    """
    SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT DISTINCT o_custkey FROM orders)
      AND EXISTS (SELECT 1 FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F') f WHERE o_custkey = c_custkey)
    """,
)
_sql(
    "i04_anti_join",
    ("part", "lineitem"),
    """
    SELECT p_partkey FROM part WHERE NOT EXISTS (
      SELECT 1 FROM (SELECT DISTINCT l_partkey FROM lineitem) l WHERE l_partkey = p_partkey)
    """,
)


@query(
    "i05_range_join",
    """
    SELECT band, count(*) AS n FROM orders JOIN (
        SELECT unnest(generate_series(0, (SELECT CAST(max(o_totalprice) AS BIGINT) // 30000 FROM orders))) AS band) b
      ON o_totalprice >= band * 30000 AND o_totalprice < band * 30000 + 20000 GROUP BY 1
    """,
)
def _range_join(spark, d):
    """Price bands up to the highest price; a third of each band's width belongs to none."""
    orders = read_table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    bands = orders.agg((F.max("o_totalprice").cast("long") / 30000).cast("long").alias("last")).select(
        F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("band")
    ).selectExpr("band", "band * 30000 AS low", "band * 30000 + 20000 AS high")
    return S.range_join(orders, bands, "o_totalprice", "low", "high", 20000).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


@query(
    "i06_asof_join",
    """
    SELECT e.event_id, CAST(p.event_id AS VARCHAR) AS purchase_id, CAST(p.ts AS VARCHAR) AS purchase_ts
    FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p
      ON e.user_id = p.user_id AND e.ts > p.ts
    """,
)
def _asof(spark, d):
    events = read_table(spark, d, "events").select("event_id", "user_id", "ts", "event_type").withColumn("hour", F.date_trunc("hour", "ts"))
    found = S.latest_before(events, ["user_id"], ["hour"], "ts", F.col("event_type") == "purchase", ["event_id"])
    return found.select(
        "event_id", F.col("latest.event_id").cast("string").alias("purchase_id"), F.col("latest.ts").cast("string").alias("purchase_ts")
    )


_RUN_SPAN = "CAST(floor(value * 60000000) AS BIGINT)"


@query(
    "i06_interval_join",
    f"""
    SELECT r.event_id, count(*) AS n_errors, min(x.event_id) AS first_error
    FROM events r JOIN events x
      ON r.event_type <> 'error' AND x.event_type = 'error'
     AND epoch_us(r.ts) < epoch_us(x.ts) + {_RUN_SPAN.replace('value', 'x.value')}
     AND epoch_us(x.ts) < epoch_us(r.ts) + {_RUN_SPAN.replace('value', 'r.value')}
    GROUP BY r.event_id
    """,
)
def _interval(spark, d):
    """Runs (events other than errors, lasting ``value`` minutes) against the error windows that overlap them."""
    events = read_table(spark, d, "events").select("event_id", "ts", "value", "event_type")
    at = F.unix_micros(F.col("ts").cast("timestamp"))  # the session clock is UTC
    span = lambda: [at.alias("s"), (at + F.expr(_RUN_SPAN)).alias("e")]
    runs = events.filter("event_type <> 'error'").select("event_id", *span())
    errors = events.filter("event_type = 'error'").select(F.col("event_id").alias("error_id"), *span())
    errors = errors.withColumnsRenamed({"s": "es", "e": "ee"})
    met = S.interval_join(runs, errors, ("s", "e"), ("es", "ee"), totals=(["event_id"], "error_id"))
    return met.withColumnsRenamed({"n": "n_errors", "first": "first_error"})


_sql(
    "i07_group_having",
    ("lineitem",),
    f"""
    SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))) AS DOUBLE) AS revenue, round(avg(l_linenumber), 6) AS mean_line
    FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10
    """,
)
_CUBE = """
    SELECT r_name, c_mktsegment, grouping(r_name) + 0 AS all_regions, count(*) AS n,
           CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    GROUP BY {}
"""
for _name, _grouping in {
    "cube": "CUBE (r_name, c_mktsegment)",
    "rollup": "ROLLUP (r_name, c_mktsegment)",
    "grouping_sets": "GROUPING SETS ((r_name), (c_mktsegment), (r_name, c_mktsegment))",
}.items():
    _sql(f"i08_{_name}", ("customer", "nation", "region"), _CUBE.format(_grouping))


@query(
    "i09_running_total",
    """
    SELECT o_orderkey, o_custkey, row_number() OVER w AS order_no,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER w AS DOUBLE) AS spent
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    """,
)
def _running(spark, d):
    """Spend and order number so far; a customer with very many orders is cut by day."""
    orders = read_table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate",
        F.col("o_totalprice").cast("decimal(18,2)").alias("price"),
    )
    sums = {"spent": F.col("price"), "order_no": F.lit(1).cast("long")}
    out = S.running_totals(orders, ["o_custkey"], ["o_orderdate"], ["o_orderdate", "o_orderkey"], sums)
    return out.select("o_orderkey", "o_custkey", "order_no", F.col("spent").cast("double").alias("spent"))


@query(
    "i09_lag",
    """
    SELECT event_id, lag(event_type) OVER w AS before_type, CAST(lag(event_id) OVER w AS VARCHAR) AS before_id
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
    """,
)
def _lag(spark, d):
    events = read_table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", F.date_trunc("hour", "ts").alias("hour"))
    out = S.previous_row(events, ["user_id"], ["hour"], ["ts", "event_id"], ["event_type", "event_id"])
    return out.select("event_id", F.col("previous.event_type").alias("before_type"), F.col("previous.event_id").cast("string").alias("before_id"))


_sql(
    "i09_rank_top",
    ("orders",),
    """
    SELECT o_custkey, o_orderkey, rn FROM (
      SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn
      FROM orders) t WHERE rn <= 3
    """,
)
_sql(
    "i09_moving_frame",
    ("orders",),
    """
    SELECT status, CAST(day AS STRING) AS day, n, sum(n) OVER (PARTITION BY status ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS three_days
    FROM (SELECT o_orderstatus AS status, CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1, 2) t
    """,
    """
    SELECT status, CAST(day AS STRING) AS day, n, CAST(sum(n) OVER (PARTITION BY status ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS three_days
    FROM (SELECT o_orderstatus AS status, CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1, 2) t
    """,
)
_sql(
    "i10_order_limit_offset",
    ("lineitem",),
    """
    SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey ORDER BY n DESC, l_orderkey LIMIT 50 OFFSET 25
    """,
)
_sql(
    "i11_set_operations",
    ("customer", "supplier", "orders"),
    """
    SELECT 'intersect' AS kind, c_custkey AS k FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders) a
    UNION ALL
    SELECT 'except' AS kind, c_custkey AS k FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) b
    UNION ALL
    SELECT 'union' AS kind, k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) c
    """,
)
_SCALAR = """
    SELECT event_id, {json} AS k, upper(substring(event_type, 1, 3)) || '-' || CAST(length(event_type) AS STRING) AS code,
           year(ts) AS y, month(ts) AS m, {hour} AS h, round(value / 3, 4) AS third, abs(floor(value) - 50) AS off,
           {words} AS words
    FROM events
"""
_sql(
    "i12_scalar_functions",
    ("events",),
    _SCALAR.format(
        json="CAST(get_json_object(props, '$.k') AS BIGINT)", hour="hour(ts)",
        words="array_join(split(replace(props, '\"', ''), ' '), '|')",
    ),
    _SCALAR.format(
        json="CAST(json_extract_string(props, '$.k') AS BIGINT)", hour="hour(ts)",
        words="array_to_string(string_split(replace(props, '\"', ''), ' '), '|')",
    ).replace("year(ts)", "CAST(year(ts) AS INTEGER)").replace("month(ts)", "CAST(month(ts) AS INTEGER)")
    .replace("abs(floor(value) - 50)", "CAST(abs(floor(value) - 50) AS BIGINT)"),
)
_sql(
    "i13_subqueries",
    ("orders",),
    """
    WITH busy AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 10)
    SELECT o_orderkey, o_custkey FROM orders o
    WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)
      AND o_totalprice >= (SELECT max(o_totalprice) FROM orders x WHERE x.o_custkey = o.o_custkey)
      AND o_custkey IN (SELECT o_custkey FROM busy)
    """,
)
_sql(
    "i13_bound_parameters",
    ("orders",),
    "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderdate >= :since AND o_totalprice < :most GROUP BY o_orderstatus",
    "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderdate >= DATE '1999-06-01' AND o_totalprice < 250000 GROUP BY 1",
    {"since": "1999-06-01", "most": 250000},
)
