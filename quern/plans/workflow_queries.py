"""Queries on workflow nodes, validation, feedback, templates and the service log."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import fixed
from quern.operators import workflow as G
from quern.operators.results import page
from quern.plans.registry import query
from quern.session import shared_dir
from quern.plans.views import view
from quern.sources.tables import read_table

NODE_ORDER = ["node_order", "l_partkey", "l_suppkey", "duration_ms", "start_time"]
_ORDER = ", ".join(NODE_ORDER)


@query(
    "g01_task_timeline",
    f"""
    SELECT task_id, user_id, node_order, node_type, CAST(start_time AS VARCHAR) AS start_time,
           CAST(end_time AS VARCHAR) AS end_time, duration_ms,
           CAST(epoch_ms(start_time) - epoch_ms(lag(end_time) OVER (PARTITION BY task_id ORDER BY {_ORDER})) AS VARCHAR) AS gap_ms
    FROM (SELECT n.*, o_custkey AS user_id, start_time + to_milliseconds(duration_ms) AS end_time
          FROM node_log n JOIN orders ON o_orderkey = task_id)
    """,
    views=("node_log",),
)
def _timeline(spark, d):
    tasks = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("user_id"))
    nodes = view(spark, d, "node_log").withColumn("part_block", F.floor(F.col("l_partkey") / 64))
    out = G.task_timeline(tasks, nodes, NODE_ORDER, ["node_order", "part_block"])
    return out.select(
        "task_id", "user_id", "node_order", "node_type", F.col("start_time").cast("string").alias("start_time"),
        F.col("end_time").cast("string").alias("end_time"), "duration_ms", F.col("gap_ms").cast("string").alias("gap_ms"),
    )


@query(
    "g02_node_durations",
    """
    SELECT node_type, count(*) AS calls, count(*) FILTER (node_status = 'failed') AS failures,
           round(avg(duration_ms), 6) AS mean_ms, max(duration_ms) AS max_ms FROM node_log GROUP BY 1
    """,
    views=("node_log",),
)
def _durations(spark, d):
    return G.node_durations(view(spark, d, "node_log"))


@query("g02_duration_percentiles")
def _percentiles(spark, d):
    """p50, p95 and p99 of durations per node type, from sketches stored per type and day and merged.

    Approximate by design (rank error of a KLL sketch), so no checking SQL:
    tests hold the ranks of the values against exact ranks.
    """
    sketches = G.duration_sketches(view(spark, d, "node_log"))
    stored = shared_dir(spark, "duration-sketches")
    sketches.write.parquet(stored)
    return G.duration_percentiles(spark.read.parquet(stored))


@query(
    "g03_task_progress",
    """
    SELECT task_id, CASE WHEN bool_or(node_status = 'failed' OR node_type = 'error_handling') THEN 0
           ELSE max(CASE node_type WHEN 'sql_generation' THEN 40 WHEN 'sql_validation' THEN 60 WHEN 'sql_execution' THEN 80
                    WHEN 'result_processing' THEN 100 ELSE 0 END) END AS progress_percentage
    FROM node_log GROUP BY 1
    """,
    views=("node_log",),
)
def _progress(spark, d):
    return G.task_progress(view(spark, d, "node_log"))


_WORD = "CASE WHEN sql_text IS NULL OR trim(sql_text) = '' THEN 'SQL不能为空' " + " ".join(
    f"WHEN contains(upper(sql_text), '{w}') THEN '不允许使用 {w} 操作'" for w in fixed.SUBSTRING_WORDS
) + " END"
_PATTERN = "CASE " + " ".join(
    "WHEN contains(sql_text, '{0}') THEN '检测到潜在的SQL注入风险: {0}'".format(p.replace("'", "''"))
    for p in fixed.INJECTION_PATTERNS
) + " END"


@query(
    "g04_validation_result",
    f"""
    SELECT stmt_id, word IS NULL AS syntax_valid, pattern IS NULL AS security_valid, user_id <> 0 AS permission_valid,
           word IS NULL AND pattern IS NULL AND user_id <> 0 AS valid,
           concat_ws('|', word, pattern, CASE WHEN user_id = 0 THEN '用户ID缺失' END) AS errors
    FROM (SELECT stmt_id, user_id, {_WORD} AS word, {_PATTERN} AS pattern
          FROM (SELECT * REPLACE (user_id % 4 AS user_id) FROM sql_log))
    """,
    views=("sql_log",),
)
def _validation(spark, d):
    log = view(spark, d, "sql_log").withColumn("user_id", F.expr("user_id % 4"))
    return G.validation_result(log).select(
        "stmt_id", "syntax_valid", "security_valid", "permission_valid", "valid", F.array_join("errors", "|").alias("errors")
    )


_MESSAGE = """CASE event_type WHEN 'error' THEN '语法错误' WHEN 'click' THEN '权限不足，查询超时'
    WHEN 'view' THEN '连接断开' WHEN 'signup' THEN '语法, 权限, 超时' END"""


@query(
    "g05_error_suggestions",
    f"""
    SELECT event_id, CASE WHEN m IS NULL OR NOT (contains(m, '语法') OR contains(m, '权限') OR contains(m, '超时'))
           THEN '{"|".join(fixed.DEFAULT_HINTS)}' ELSE concat_ws('|', """
    + ", ".join(f"CASE WHEN contains(m, '{w}') THEN '{'|'.join(h)}' END" for w, h in fixed.ERROR_HINTS.items())
    + f") END AS suggestions FROM (SELECT event_id, {_MESSAGE} AS m FROM events)",
)
def _suggestions(spark, d):
    failed = read_table(spark, d, "events").select("event_id", F.expr(_MESSAGE).alias("error_message"))
    return G.error_suggestions(failed).select("event_id", F.array_join("suggestions", "|").alias("suggestions"))


@query(
    "g06_error_code_names",
    "SELECT log_id, CASE code "
    + " ".join(f"WHEN {k} THEN '{v}'" for k, v in fixed.ERROR_CODES.items())
    + " ELSE '未知错误' END AS error_message FROM (SELECT log_id, error_code + log_id % 9 AS code FROM sys_log)",
    views=("sys_log",),
)
def _codes(spark, d):
    log = view(spark, d, "sys_log").withColumn("error_code", F.expr("error_code + log_id % 9"))
    return G.error_code_names(log).select("log_id", "error_message")


@query(
    "g07_feedback_search",
    """
    SELECT task_id, user_id, rating FROM feedback WHERE feedback_type = 'bad' AND NOT is_processed
    ORDER BY created_at DESC, task_id LIMIT 20 OFFSET 20
    """,
    views=("feedback",),
)
def _feedback(spark, d):
    found = G.feedback_search(view(spark, d, "feedback"), "bad", False)
    return page(found, [F.desc("created_at"), "task_id"], 2, 20).select("task_id", "user_id", "rating")


@query(
    "g08_feedback_summary",
    """
    SELECT feedback_type, count(*) AS n, count(*) FILTER (is_processed) AS processed, round(avg(rating), 6) AS mean_rating,
           round(count(*) / (SELECT count(*) FROM feedback)::DOUBLE, 6) AS share FROM feedback GROUP BY 1
    """,
    views=("feedback",),
)
def _summary(spark, d):
    return G.feedback_summary(view(spark, d, "feedback"))


@query(
    "g08_positive_share",
    """
    SELECT round(count(*) FILTER (feedback_type = 'good') / count(*)::DOUBLE, 6) AS positive_share,
           count(*) FILTER (feedback_type = 'good') / count(*)::DOUBLE >= 0.7 AS goal_met FROM feedback
    """,
    views=("feedback",),
)
def _positive(spark, d):
    return G.positive_share(view(spark, d, "feedback"))


@query(
    "g09_validate_templates",
    """
    SELECT template_id, array_to_string(list_sort(list_filter(used, lambda x: NOT list_contains(names, x))), ',') AS undeclared,
           array_to_string(list_sort(list_filter(names, lambda x: NOT list_contains(used, x))), ',') AS unused,
           len(list_filter(used, lambda x: NOT list_contains(names, x))) = 0
           AND len(list_filter(names, lambda x: NOT list_contains(used, x))) = 0 AS valid
    FROM (SELECT template_id, regexp_extract_all(template_content, '\\{(\\w+)\\}', 1) AS used,
                 list_filter(string_split(variable_list, ','), lambda x: x <> '') AS names FROM tmpl)
    """,
    views=("tmpl",),
)
def _templates(spark, d):
    out = G.validate_templates(view(spark, d, "tmpl"))
    return out.select(
        "template_id", F.array_join("undeclared", ",").alias("undeclared"), F.array_join("unused", ",").alias("unused"), "valid"
    )


@query(
    "g10_log_search",
    """
    SELECT log_id, module, response_time_ms FROM sys_log WHERE user_id = 13 AND log_level = 'warning'
      AND created_at >= TIMESTAMP '2024-01-05 00:00:00' AND created_at <= TIMESTAMP '2024-01-20 00:00:00'
    ORDER BY created_at DESC, log_id LIMIT 20
    """,
    views=("sys_log",),
)
def _log(spark, d):
    found = G.log_search(view(spark, d, "sys_log"), 13, "warning", "2024-01-05 00:00:00", "2024-01-20 00:00:00")
    return page(found, [F.desc("created_at"), "log_id"], 1, 20).select("log_id", "module", "response_time_ms")


@query(
    "g11_log_metrics",
    """
    SELECT module, CAST(date_trunc('hour', created_at) AS VARCHAR) AS hour, count(*) AS calls,
           round(count(*) FILTER (log_level = 'error') / count(*)::DOUBLE, 6) AS error_rate,
           round(avg(response_time_ms), 6) AS mean_ms FROM sys_log GROUP BY 1, 2
    """,
    views=("sys_log",),
)
def _metrics(spark, d):
    return G.log_metrics(view(spark, d, "sys_log")).withColumn("hour", F.col("hour").cast("string"))


@query(
    "g12_validate_questions",
    """
    SELECT doc_id, CASE WHEN q IS NULL OR trim(q, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN '用户问题不能为空'
           WHEN length(q) > 1000 THEN '问题描述过长，请控制在1000字符以内' WHEN doc_id % 50 <= 0 THEN '无效的用户ID' END AS reason
    FROM (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '  ' ELSE text END AS q FROM documents)
    """,
)
def _questions(spark, d):
    asked = read_table(spark, d, "documents").select(
        "doc_id", F.expr("CASE WHEN doc_id % 11 = 0 THEN '  ' ELSE text END AS user_question"), F.expr("doc_id % 50 AS user_id")
    )
    return G.validate_questions(asked).select("doc_id", "reason")
