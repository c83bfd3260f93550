"""Queries on results and the common business questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import fixed
from quern.operators import results as R
from quern.plans.registry import query
from quern.session import shared_dir
from quern.plans.views import view
from quern.sources.tables import read_table


def _money(*cols: str):
    return {c: F.col(c).cast("double") for c in cols}


@query(
    "b01_run_sql",
    """
    SELECT user_id, status, count(*) AS n, CAST(sum(execution_time_ms) AS BIGINT) AS total_ms
    FROM hist WHERE execution_time_ms >= 100 GROUP BY user_id, status
    ORDER BY user_id, status
    """,
    views=("hist",),
)
def _run_sql(spark, d):
    view(spark, d, "hist").createOrReplaceTempView("quern_hist")
    return R.run_sql(
        spark,
        """SELECT user_id, status, count(*) AS n, sum(execution_time_ms) AS total_ms
           FROM quern_hist WHERE execution_time_ms >= :least GROUP BY user_id, status
           ORDER BY user_id, status;""",
        args={"least": 100},
    )


@query(
    "b02_cap_rows",
    "SELECT id, user_id, status FROM hist ORDER BY created_at DESC, id LIMIT 1000",
    views=("hist",),
)
def _cap_rows(spark, d):
    return R.cap_rows(view(spark, d, "hist").orderBy(F.desc("created_at"), "id").select("id", "user_id", "status"))


@query(
    "b03_page",
    """
    SELECT id, user_id, status, (SELECT count(*) FROM hist) AS total,
           CAST(ceil((SELECT count(*) FROM hist) / 20.0) AS BIGINT) AS pages
    FROM hist ORDER BY created_at DESC, id LIMIT 20 OFFSET 20
    """,
    views=("hist",),
)
def _page(spark, d):
    rows = R.page_with_total(view(spark, d, "hist"), [F.desc("created_at"), "id"], page_no=2, size=20)
    return rows.select("id", "user_id", "status", "total", "pages")


@query(
    "b03_page_far_down",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem
    ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity LIMIT 50 OFFSET 4950
    """,
)
def _far_page(spark, d):
    """Page 100 of 50 rows."""
    lines = read_table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"
    )
    order = [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    return R.page(lines, order, 100, 50)


@query(
    "b03_page_after_key",
    """
    SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
    WHERE o_orderstatus > 'F' OR (o_orderstatus = 'F' AND (o_totalprice < 200000 OR (o_totalprice = 200000 AND o_orderkey > 5)))
    ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey LIMIT 50
    """,
)
def _after(spark, d):
    """The rows that follow a known one."""
    orders = read_table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return R.page_after(orders, ["o_orderstatus", F.desc("o_totalprice"), "o_orderkey"], ["F", 200000.0, 5], 50)


@query("b04_preview", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 100")
def _preview(spark, d):
    return R.preview(read_table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"])


@query(
    "b05_search_rows",
    """
    SELECT c_custkey, c_name FROM customer
    WHERE contains(lower(CAST(c_custkey AS VARCHAR)), 'ma') OR contains(lower(c_name), 'ma')
       OR contains(lower(CAST(c_nationkey AS VARCHAR)), 'ma')
       OR contains(lower(CAST(c_acctbal AS VARCHAR)), 'ma') OR contains(lower(c_mktsegment), 'ma')
    """,
)
def _search_rows(spark, d):
    return R.search_rows(read_table(spark, d, "customer"), "MA").select("c_custkey", "c_name")


@query(
    "b05_search_rows_indexed",
    """
    SELECT c_custkey, c_name FROM customer
    WHERE contains(lower(CAST(c_custkey AS VARCHAR)), 'mer#0000001') OR contains(lower(c_name), 'mer#0000001')
       OR contains(lower(CAST(c_nationkey AS VARCHAR)), 'mer#0000001')
       OR contains(lower(CAST(c_acctbal AS VARCHAR)), 'mer#0000001') OR contains(lower(c_mktsegment), 'mer#0000001')
    """,
)
def _search_indexed(spark, d):
    """The search of b05 with a three-character text, through a trigram index of the whole table."""
    customers = read_table(spark, d, "customer")
    index = R.build_text_index(customers, "c_custkey", shared_dir(spark, "text-index"))
    return R.indexed_search(customers, index, "c_custkey", "MER#0000001").select("c_custkey", "c_name")


@query(
    "b05_search_rows_numbers",
    """
    SELECT id, execution_time_ms FROM hist
    WHERE contains(lower(coalesce(generated_sql, 'null')), 'null')
       OR contains(lower(user_question), 'null') OR contains(status, 'null')
    """,
    views=("hist",),
)
def _search_nulls(spark, d):
    return R.search_rows(view(spark, d, "hist"), "null").select("id", "execution_time_ms")


@query(
    "b06_sort_rows",
    """
    SELECT p_partkey, p_name FROM part ORDER BY lower(p_name) DESC, p_partkey
    """,
)
def _sort_rows(spark, d):
    parts = read_table(spark, d, "part").select("p_partkey", "p_name")
    return R.sort_rows(parts, "p_name", "desc", tie=["p_partkey"])


@query(
    "b06_sort_rows_numeric",
    "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey",
)
def _sort_numeric(spark, d):
    parts = read_table(spark, d, "part").select("p_partkey", "p_retailprice")
    return R.sort_rows(parts, "p_retailprice", "desc", tie=["p_partkey"])


@query(
    "b07_format_cells",
    """
    SELECT CAST(id AS VARCHAR) AS id, coalesce(generated_sql, '-') AS generated_sql,
           CASE WHEN isnan(value) THEN 'NaN' WHEN isinf(value) THEN 'Infinity' WHEN value = 1e20 THEN '100000000000000000000'
                WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR)
                ELSE printf('%.2f', value) END AS value
    FROM (SELECT h.id, h.generated_sql, CASE h.id % 50 WHEN 1 THEN 'NaN'::DOUBLE WHEN 2 THEN 'Infinity'::DOUBLE WHEN 3 THEN 1e20
                 ELSE e.value END AS value FROM hist h JOIN events e ON h.id = e.event_id)
    """,
    views=("hist",),
)
def _format_cells(spark, d):
    value = F.expr("CASE event_id % 50 WHEN 1 THEN double('NaN') WHEN 2 THEN double('Infinity') WHEN 3 THEN 1e20 ELSE value END")
    events = read_table(spark, d, "events").select(F.col("event_id").alias("id"), value.alias("value"))
    return R.format_cells(view(spark, d, "hist").select("id", "generated_sql").join(events, "id"))


@query(
    "b08_iso_datetimes",
    """
    SELECT event_id, CASE WHEN extract('microsecond' FROM ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
           ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS ts FROM events
    UNION ALL
    SELECT -1 - o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') FROM orders
    """,
)
def _iso(spark, d):
    events = read_table(spark, d, "events").select("event_id", "ts")
    orders = read_table(spark, d, "orders").select((F.lit(-1) - F.col("o_orderkey")).alias("event_id"), F.col("o_orderdate").alias("ts"))
    return R.iso_datetimes(events.unionByName(orders))


_AUDIT_SQL = {
    "token": "CASE WHEN sql_text IS NULL OR sql_text = '' THEN 'empty' "
    + " ".join(f"WHEN contains(' ' || upper(trim(sql_text)) || ' ', ' {w} ') THEN '{w}'" for w in fixed.TOKEN_WORDS)
    + " END",
    "substring": "CASE WHEN sql_text IS NULL OR trim(sql_text) = '' THEN 'empty' "
    + " ".join(f"WHEN contains(upper(sql_text), '{w}') THEN '{w}'" for w in fixed.SUBSTRING_WORDS)
    + " END",
    "strict": "CASE " + " ".join(f"WHEN contains(upper(sql_text), '{w}') THEN '{w}'" for w in fixed.STRICT_WORDS) + " END",
    "injection": "CASE "
    + " ".join(
        "WHEN contains(sql_text, '{0}') THEN '{0}'".format(p.replace("'", "''")) for p in fixed.INJECTION_PATTERNS
    )
    + " END",
}


def _register_audit(rule: str, hit_sql: str) -> None:
    @query(
        f"b09_audit_sql_{rule}",
        f"""
        SELECT stmt_id, '{rule}' AS rule, {hit_sql} AS hit, ({hit_sql}) IS NOT NULL AS rejected,
               CASE WHEN ends_with(trim(sql_text), ';') THEN trim(sql_text) ELSE trim(sql_text) || ';' END AS clean_sql
        FROM sql_log
        """,
        views=("sql_log",),
    )
    def _audit(spark, d):
        return R.audit_sql(view(spark, d, "sql_log"), "sql_text", rule).select(
            "stmt_id", "rule", "hit", "rejected", "clean_sql"
        )


for _rule, _hit in _AUDIT_SQL.items():
    _register_audit(_rule, _hit)


@query(
    "b09_audit_summary",
    "SELECT rule, hit, count(*) AS n FROM ("
    + " UNION ALL ".join(f"SELECT '{r}' AS rule, {h} AS hit FROM sql_log" for r, h in _AUDIT_SQL.items())
    + ") GROUP BY rule, hit",
    views=("sql_log",),
)
def _audit_summary(spark, d):
    return R.audit_summary(view(spark, d, "sql_log"), "sql_text", list(_AUDIT_SQL))


_ROLLING = """
    WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS seen FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)
    SELECT CAST(a.seen AS VARCHAR) AS day,
           count(DISTINCT CASE WHEN b.seen > a.seen - 7 THEN b.user_id END) AS users_7d,
           count(DISTINCT b.user_id) AS users_30d
    FROM (SELECT DISTINCT seen FROM d) a JOIN d b ON b.seen <= a.seen AND b.seen > a.seen - 30
    GROUP BY a.seen
"""


@query("b12_rolling_active_users_exact", _ROLLING)
def _rolling_exact(spark, d):
    out = R.rolling_active_users_exact(read_table(spark, d, "events"))
    return out.withColumn("day", F.col("day").cast("string"))


@query("b12_rolling_active_users")
def _rolling(spark, d):
    """By day sketches stored once and unioned over 7 and 30 days; within the sketch's error of the exact query."""
    stored = shared_dir(spark, "day-sketches")
    R.day_sketches(read_table(spark, d, "events")).write.parquet(stored)
    return R.rolling_active_users(spark.read.parquet(stored)).withColumn("day", F.col("day").cast("string"))


@query(
    "b11_daily_order_stats",
    """
    SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, count(*) AS order_count,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_sales
    FROM orders
    WHERE o_orderdate >= (SELECT CAST(max(o_orderdate) AS DATE) - INTERVAL 30 DAY FROM orders)
    GROUP BY 1 ORDER BY 1 DESC
    """,
)
def daily_order_stats(spark, d):
    out = R.daily_order_stats(read_table(spark, d, "orders"))
    return out.withColumns({"day": F.col("day").cast("string"), **_money("total_sales")})


@query(
    "b12_daily_active_users",
    """
    SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(DISTINCT user_id) AS active_users
    FROM events WHERE ts >= (SELECT CAST(max(ts) AS DATE) - INTERVAL 30 DAY FROM events) GROUP BY 1
    """,
)
def _dau(spark, d):
    return R.daily_active_users(read_table(spark, d, "events")).withColumn("day", F.col("day").cast("string"))


@query(
    "b13_top_products",
    """
    SELECT p_partkey, p_name, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity
    FROM lineitem JOIN part ON l_partkey = p_partkey
    WHERE l_shipdate >= DATE '2001-06-01' AND l_shipdate < DATE '2001-07-01'
    GROUP BY 1, 2 ORDER BY quantity DESC, p_partkey LIMIT 10
    """,
)
def _top_products(spark, d):
    top = R.top_products(read_table(spark, d, "lineitem"), read_table(spark, d, "part"), 10, month="2001-06")
    return top.withColumns(_money("quantity"))


@query(
    "b13_top_products_newest_month",
    """
    SELECT p_partkey, p_name, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity
    FROM lineitem JOIN part ON l_partkey = p_partkey
    WHERE l_shipdate >= (SELECT date_trunc('month', max(l_shipdate)) FROM lineitem)
    GROUP BY 1, 2 ORDER BY quantity DESC, p_partkey LIMIT 10
    """,
)
def _top_products_newest(spark, d):
    return R.top_products(read_table(spark, d, "lineitem"), read_table(spark, d, "part")).withColumns(_money("quantity"))


@query(
    "b14_monthly_sales",
    """
    SELECT strftime(o_orderdate, '%Y-%m') AS month,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS sales_amount
    FROM orders GROUP BY 1
    """,
)
def _monthly_sales(spark, d):
    return R.monthly_sales(read_table(spark, d, "orders")).withColumns(_money("sales_amount"))


@query(
    "b15_recent_rows",
    """
    SELECT o_orderkey, o_custkey FROM orders
    WHERE o_orderdate >= (SELECT max(o_orderdate) - INTERVAL 30 DAY FROM orders)
    ORDER BY o_totalprice DESC, o_orderkey LIMIT 10
    """,
)
def _recent(spark, d):
    orders = read_table(spark, d, "orders")
    return R.recent_rows(orders, "o_orderdate", [F.desc("o_totalprice"), "o_orderkey"]).select("o_orderkey", "o_custkey")


@query(
    "b16_mask_columns",
    """
    SELECT user_id, CASE WHEN length(username) < 8 THEN repeat('*', length(username))
           ELSE left(username, 3) || repeat('*', length(username) - 7) || right(username, 4) END AS username,
           sha256(email) AS email, '***' AS nation_id, is_active
    FROM sys_user
    """,
    views=("sys_user",),
)
def _mask(spark, d):
    users = view(spark, d, "sys_user").select("user_id", "username", "email", "nation_id", "is_active")
    return R.mask_columns(users, {"username": "mask", "email": "hash", "nation_id": "replace"})


@query(
    "b17_row_filter",
    """
    SELECT c_custkey, c_nationkey FROM customer
    WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)
    """,
)
def _row_filter(spark, d):
    grants = read_table(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return R.row_filter(read_table(spark, d, "customer"), grants, "c_nationkey").select("c_custkey", "c_nationkey")


@query(
    "b18_column_filter",
    "SELECT c_custkey, c_name, c_nationkey, CAST(NULL AS VARCHAR) AS c_mktsegment FROM customer",
)
def _column_filter(spark, d):
    customer = read_table(spark, d, "customer").drop("c_acctbal")
    return R.column_filter(customer, ["c_custkey", "c_name", "c_nationkey"], keep_shape=True)


_QUESTION = """CASE event_type WHEN 'purchase' THEN '最近的订单' WHEN 'view' THEN '用户列表'
    WHEN 'click' THEN '销售额' WHEN 'signup' THEN '用户的订单' ELSE user_id::STRING END"""


@query(
    "b19_query_route",
    f"""
    SELECT CASE WHEN contains(q, '销售') OR contains(q, '订单') THEN 'sales_orders'
                WHEN contains(q, '用户') THEN 'users' ELSE 'other' END AS route, count(*) AS n
    FROM (SELECT {_QUESTION} AS q FROM events) GROUP BY 1
    """,
)
def _route(spark, d):
    questions = read_table(spark, d, "events").select(F.expr(_QUESTION).alias("q"))
    return R.query_route(questions, "q").groupBy("route").agg(F.count(F.lit(1)).alias("n"))
