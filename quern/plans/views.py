"""Input views over the star-schema tables, one text for Spark SQL and for the checking engine.

``$name`` stands for a base table. Spark gets it as a DataFrame, so filters and
column pruning reach its scan. Themes,
tables, fields, links and users grow with the data; the eight roles with their
25 permissions are the nations.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from quern.sources.tables import read_table

VIEWS: dict[str, str] = {
    "hist": """
        SELECT event_id AS id, user_id,
               CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'view' THEN 'completed'
                    WHEN 'error' THEN 'failed' WHEN 'click' THEN 'cancelled' ELSE 'processing' END AS status,
               CAST(event_id % 7 AS INT) AS theme_id,
               concat('question ', CAST(event_id % 50 AS STRING), ' about ', event_type) AS user_question,
               CASE WHEN event_type = 'error' THEN NULL
                    ELSE concat('SELECT * FROM t', CAST(event_id % 7 AS STRING)) END AS generated_sql,
               CAST(floor(value) AS BIGINT) AS execution_time_ms,
               CAST(replace(replace(props, '{"k": ', ''), '}', '') AS BIGINT) AS llm_tokens_used,
               ts AS created_at
        FROM $events""",
    "fav": """
        SELECT user_id, event_id AS history_id, concat('fav ', CAST(event_id AS STRING)) AS favorite_name
        FROM $events WHERE event_id % 5 = 0
        UNION ALL
        SELECT user_id, event_id AS history_id, 'dup' AS favorite_name FROM $events WHERE event_id % 20 = 0""",
    "theme": """
        SELECT s_suppkey AS theme_id, s_name AS theme_name, concat('theme of ', lower(s_name)) AS theme_description,
               (s_suppkey % 20 = 0) AS is_public, 10 - s_nationkey % 10 AS sort_order
        FROM $supplier""",
    "mtable": """
        SELECT p_partkey AS table_id, concat(upper(p_name), ' ', CAST(p_partkey AS STRING)) AS table_name_cn,
               concat('t_', CAST(p_partkey AS STRING)) AS table_name_en, (p_size % 6 <> 5) AS is_active
        FROM $part""",
    "table_theme": """
        SELECT DISTINCT l_partkey AS table_id, l_suppkey AS theme_id FROM $lineitem""",
    "mfield": """
        SELECT DISTINCT l_partkey * 10 + l_linenumber AS field_id, l_partkey AS table_id,
               concat('f_', CAST(l_linenumber AS STRING)) AS field_name_en,
               concat('Field ', CAST(l_linenumber AS STRING)) AS field_name_cn,
               CASE l_linenumber % 4 WHEN 0 THEN 'string' WHEN 1 THEN 'integer' WHEN 2 THEN 'decimal'
                    ELSE 'datetime' END AS field_type,
               CASE l_linenumber WHEN 1 THEN 'mask' WHEN 2 THEN 'hash' ELSE 'none' END AS desensitization_type,
               (l_linenumber <> 4) AS is_active
        FROM $lineitem""",
    # every tenth supplier also stands for a theme (and role) without any link
    "every_theme": """
        SELECT s_suppkey AS theme_id, s_name AS theme_name FROM $supplier
        UNION ALL SELECT -1 - s_suppkey AS theme_id, concat('empty ', s_name) AS theme_name FROM $supplier WHERE s_suppkey % 10 = 0""",
    "every_role": """
        SELECT s_suppkey AS role_id, concat('role_', lower(s_name)) AS role_code FROM $supplier
        UNION ALL SELECT -1 - s_suppkey AS role_id, concat('empty_', lower(s_name)) AS role_code FROM $supplier WHERE s_suppkey % 10 = 0""",
    "glossary": """
        SELECT p_partkey AS term_id, p_brand AS term_name, p_name AS term_description,
               CASE WHEN p_partkey % 3 = 0 THEN 'user' ELSE 'admin' END AS term_type,
               CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 5 ELSE NULL END AS user_id
        FROM $part""",
    "sys_user": """
        SELECT c_custkey AS user_id, c_name AS username, concat(lower(c_name), '@example.com') AS email,
               (c_custkey % 10 <> 0) AS is_active, (c_custkey % 17 = 0) AS is_deleted, c_nationkey AS nation_id
        FROM $customer""",
    "sys_role": """
        SELECT CAST(n_nationkey AS BIGINT) AS role_id, concat('role_', lower(n_name)) AS role_code,
               concat('Role of ', lower(n_name)) AS role_name, (n_nationkey <> 6) AS is_active
        FROM $nation WHERE n_nationkey < 8""",
    "user_role": """
        SELECT c_custkey AS user_id, CAST(c_custkey % 4 AS BIGINT) AS role_id FROM $customer
        UNION ALL
        SELECT c_custkey AS user_id, CAST(4 + c_custkey % 4 AS BIGINT) AS role_id FROM $customer
        WHERE c_custkey % 2 = 0""",
    "sys_permission": """
        SELECT CAST(n_nationkey AS BIGINT) AS permission_id,
               concat('res', CAST(n_regionkey AS STRING), ':',
                      CASE n_nationkey % 4 WHEN 0 THEN 'read' WHEN 1 THEN 'write' WHEN 2 THEN 'export'
                           ELSE '*' END) AS permission_code,
               CASE n_nationkey % 3 WHEN 0 THEN 'menu' WHEN 1 THEN 'data_theme'
                    ELSE 'data_table' END AS permission_type,
               CASE WHEN n_nationkey % 3 = 1 THEN CAST(n_regionkey AS BIGINT) END AS data_theme_id,
               CASE WHEN n_nationkey % 3 = 2 THEN CAST(n_nationkey AS BIGINT) END AS table_id,
               (n_nationkey <> 23) AS is_active
        FROM $nation""",
    "role_permission": """
        SELECT CAST(r.n_nationkey AS BIGINT) AS role_id, CAST(p.n_nationkey AS BIGINT) AS permission_id
        FROM $nation r JOIN $nation p ON p.n_nationkey % 3 = (3 - r.n_nationkey % 3) % 3
        WHERE r.n_nationkey < 8""",
    # as many roles as suppliers and permissions as parts, for the lists
    "many_roles": """
        SELECT s_suppkey AS role_id, concat('role_', lower(s_name)) AS role_code FROM $supplier""",
    "many_permissions": """
        SELECT p_partkey AS permission_id, concat('res', CAST(p_size AS STRING), ':', lower(p_type)) AS permission_code,
               CASE p_partkey % 3 WHEN 0 THEN 'menu' WHEN 1 THEN 'data_theme' ELSE 'data_table' END AS permission_type
        FROM $part""",
    "node_log": """
        SELECT l_orderkey AS task_id, l_linenumber AS node_order,
               CASE l_linenumber % 5 WHEN 1 THEN 'sql_generation' WHEN 2 THEN 'sql_validation'
                    WHEN 3 THEN 'sql_execution' WHEN 4 THEN 'result_processing'
                    ELSE 'error_handling' END AS node_type,
               CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'success' END AS node_status,
               CAST(floor(l_quantity) AS BIGINT) AS duration_ms, l_shipdate AS start_time, l_partkey, l_suppkey
        FROM $lineitem""",
    "feedback": """
        SELECT o_orderkey AS task_id, o_custkey AS user_id,
               CASE o_orderstatus WHEN 'O' THEN 'good' WHEN 'F' THEN 'bad' ELSE 'suggestion' END AS feedback_type,
               CAST(substring(o_orderpriority, 1, 1) AS INT) AS rating, (o_orderkey % 3 = 0) AS is_processed,
               o_orderdate AS created_at
        FROM $orders""",
    "sys_log": """
        SELECT event_id AS log_id,
               CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'warning' ELSE 'info' END AS log_level,
               concat('module_', CAST(event_id % 4 AS STRING)) AS module, user_id,
               CAST(floor(value) AS BIGINT) AS response_time_ms,
               CASE event_type WHEN 'error' THEN 500002 ELSE 0 END AS error_code, ts AS created_at
        FROM $events""",
    "sql_log": """
        SELECT o_orderkey AS stmt_id, o_custkey AS user_id,
               CASE o_orderkey % 8 WHEN 0 THEN 'SELECT * FROM users LIMIT 10;' WHEN 1 THEN 'drop table users'
                    WHEN 2 THEN 'SELECT created_at FROM orders' WHEN 3 THEN 'SELECT 1 -- note'
                    WHEN 4 THEN 'WITH a AS (SELECT 1) SELECT * FROM a'
                    WHEN 5 THEN 'SELECT updated_at FROM t; DELETE FROM t'
                    WHEN 6 THEN 'select name from t where a = 1' ELSE '  ' END AS sql_text
        FROM $orders""",
    "tmpl": """
        SELECT p_partkey AS template_id,
               CASE p_partkey % 3 WHEN 0 THEN 'Use {table_schema} to answer {user_question}'
                    WHEN 1 THEN 'Answer {user_question}' ELSE 'No variables' END AS template_content,
               CASE p_partkey % 4 WHEN 0 THEN 'table_schema,user_question' WHEN 1 THEN 'user_question'
                    ELSE '' END AS variable_list
        FROM $part""",
    "lineage": """
        SELECT o_orderkey AS lineage_id,
               concat('raw_', CAST(o_custkey AS STRING), ', ', 'ods_', CAST(o_orderkey % 4 AS STRING), ',') AS input_tables,
               concat('dwd_', o_orderstatus) AS output_table
        FROM $orders""",
}

_BASE = re.compile(r"\$(\w+)(?: ([rp])\b)?")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived view as a lazy DataFrame."""
    text = VIEWS[name].replace("{", "{{").replace("}", "}}")
    text = _BASE.sub(lambda m: f"{{{m.group(1)}}} AS {m.group(2) or m.group(1)}", text)
    bases = {m.group(1) for m in _BASE.finditer(VIEWS[name])}
    return spark.sql(text, **{base: read_table(spark, sf_dir, base) for base in bases})


def with_views(*names: str) -> str:
    """The same views as a ``WITH`` prefix for the checking engine."""
    parts = [f"{name} AS ({_BASE.sub(lambda m: f"{m.group(1)} {m.group(2) or ''}", VIEWS[name])})" for name in names]
    return "WITH " + ",\n".join(parts) + "\n"
