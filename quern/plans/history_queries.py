"""Queries on history, statistics and favourites."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import history as H
from quern.operators.results import page
from quern.plans.registry import query
from quern.plans.views import view
from quern.sources.tables import read_table

USER, START, END = 13, "2024-01-05 00:00:00", "2024-01-20 00:00:00"
_RANGE = f"created_at >= TIMESTAMP '{START}' AND created_at <= TIMESTAMP '{END}'"
_SCOPE = f"user_id = {USER} AND {_RANGE}"
_STATS = """count(*) AS total_queries, count(*) FILTER (status = 'completed') AS successful_queries,
    count(*) FILTER (status = 'failed') AS failed_queries,
    CASE WHEN count(*) = 0 THEN 0.0::DOUBLE
         ELSE round(count(*) FILTER (status = 'completed') / count(*)::DOUBLE, 6) END AS success_rate,
    round(avg(execution_time_ms) FILTER (status = 'completed'), 6) AS avg_execution_time_ms,
    CAST(coalesce(sum(llm_tokens_used), 0) AS BIGINT) AS total_tokens_used"""
# table ids of an entry; some of them do not exist
_TABLE_IDS_SPARK = "array_distinct(array(id % 30, (id + user_id) % 25, id * 2))"
_TABLE_IDS_DUCK = "list_distinct([id % 30, (id + user_id) % 25, id * 2])"


def _with_tables(spark, d):
    return view(spark, d, "hist").withColumn("table_ids", F.expr(_TABLE_IDS_SPARK))


def _text(df, *cols):
    return df.withColumns({c: F.col(c).cast("string") for c in cols})


@query(
    "c01_history_search",
    f"""
    SELECT id, user_question, status, CAST(created_at AS VARCHAR) AS created_at FROM hist
    WHERE {_SCOPE} AND status = 'completed'
      AND (user_question ILIKE '%view%' OR generated_sql ILIKE '%view%')
    ORDER BY hist.created_at DESC, id LIMIT 20 OFFSET 0
    """,
    views=("hist",),
)
def _search(spark, d):
    found = H.history_search(view(spark, d, "hist"), USER, status="completed", theme_id=0, start=START, end=END, keyword="view")
    rows = page(found, [F.desc("created_at"), "id"], 1, 20).select("id", "user_question", "status", "created_at")
    return _text(rows, "created_at")


@query(
    "c01_history_search_wildcards",
    """
    SELECT id, user_id FROM hist WHERE user_question ILIKE '%question _ about%' OR generated_sql ILIKE '%question _ about%'
    """,
    views=("hist",),
)
def _search_wild(spark, d):
    return H.history_search(view(spark, d, "hist"), keyword="QUESTION _ about").select("id", "user_id")


@query("c02_history_count", f"SELECT count(*) AS total FROM hist WHERE {_SCOPE}", views=("hist",))
def _count(spark, d):
    return H.history_count(view(spark, d, "hist"), user_id=USER, start=START, end=END)


@query(
    "c03_with_favorite_flag",
    """
    SELECT id, user_id, EXISTS (SELECT 1 FROM fav f WHERE f.user_id = h.user_id AND f.history_id = h.id) AS is_favorite
    FROM hist h
    """,
    views=("hist", "fav"),
)
def _flag(spark, d):
    return H.with_favorite_flag(view(spark, d, "hist"), view(spark, d, "fav")).select("id", "user_id", "is_favorite")


@query(
    "c03_with_favorite_flag_of_user",
    f"""
    SELECT id, EXISTS (SELECT 1 FROM fav f WHERE f.user_id = {USER} AND f.history_id = h.id) AS is_favorite FROM hist h
    """,
    views=("hist", "fav"),
)
def _flag_user(spark, d):
    return H.with_favorite_flag(view(spark, d, "hist"), view(spark, d, "fav"), USER).select("id", "is_favorite")


_DETAIL = f"""
    SELECT h.id, h.user_id, t.theme_name, n.table_names
    FROM hist h LEFT JOIN theme t ON h.theme_id = t.theme_id
    LEFT JOIN (SELECT id, string_agg(table_name_cn, ',' ORDER BY table_name_cn) AS table_names
               FROM (SELECT id, unnest({_TABLE_IDS_DUCK}) AS table_id FROM hist) JOIN mtable USING (table_id)
               GROUP BY id) n ON n.id = h.id
"""


@query("c04_with_theme_and_tables", _DETAIL, views=("hist", "theme", "mtable"))
def _themed(spark, d):
    out = H.with_theme_and_tables(_with_tables(spark, d), view(spark, d, "theme"), view(spark, d, "mtable"))
    return out.select("id", "user_id", "theme_name", F.array_join("table_names", ",").alias("table_names"))


@query(
    "c05_history_detail",
    f"SELECT *, EXISTS (SELECT 1 FROM fav f WHERE f.user_id = 8 AND f.history_id = x.id) AS is_favorite FROM ({_DETAIL}) x "
    "WHERE id = 0 AND user_id = 8",
    views=("hist", "theme", "mtable", "fav"),
)
def _detail(spark, d):
    out = H.history_detail(
        _with_tables(spark, d), view(spark, d, "fav"), view(spark, d, "theme"), view(spark, d, "mtable"), 0, 8
    )
    return out.select("id", "user_id", "theme_name", F.array_join("table_names", ",").alias("table_names"), "is_favorite")


@query("c06_query_statistics", f"SELECT {_STATS} FROM hist WHERE {_SCOPE}", views=("hist",))
def _stats(spark, d):
    return H.query_statistics(view(spark, d, "hist"), USER, START, END)


@query(
    "c06_query_statistics_by_user",
    f"SELECT user_id, {_STATS} FROM hist WHERE {_RANGE} GROUP BY user_id",
    views=("hist",),
)
def _stats_by_user(spark, d):
    return H.query_statistics(view(spark, d, "hist"), start=START, end=END, by=["user_id"])


@query("c07_status_distribution", f"SELECT status, count(*) AS n FROM hist WHERE {_RANGE} GROUP BY status", views=("hist",))
def _status(spark, d):
    return H.status_distribution(view(spark, d, "hist"), start=START, end=END)


@query(
    "c08_daily_statistics",
    f"SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, status, count(*) AS n FROM hist WHERE {_RANGE} GROUP BY 1, 2",
    views=("hist",),
)
def _daily(spark, d):
    return _text(H.daily_statistics(view(spark, d, "hist"), start=START, end=END), "day")


@query(
    "c09_theme_statistics",
    f"""
    SELECT h.theme_id::BIGINT AS theme_id, theme_name, count(*) AS n, count(*) FILTER (status = 'completed') AS completed
    FROM hist h LEFT JOIN theme t ON h.theme_id = t.theme_id WHERE {_RANGE} GROUP BY 1, 2
    """,
    views=("hist", "theme"),
)
def _themes(spark, d):
    return H.theme_statistics(view(spark, d, "hist"), view(spark, d, "theme"), start=START, end=END)


@query(
    "c10_most_used_tables",
    f"""
    SELECT table_id, table_name_cn, count(*) AS uses
    FROM (SELECT unnest({_TABLE_IDS_DUCK}) AS table_id FROM hist) JOIN mtable USING (table_id)
    GROUP BY 1, 2 ORDER BY uses DESC, table_id LIMIT 10
    """,
    views=("hist", "mtable"),
)
def _used(spark, d):
    return H.most_used_tables(_with_tables(spark, d), view(spark, d, "mtable"))


@query(
    "c11_popular_questions",
    "SELECT user_question, count(*) AS asked FROM hist GROUP BY 1 ORDER BY asked DESC, user_question LIMIT 10",
    views=("hist",),
)
def _popular(spark, d):
    return H.popular_questions(view(spark, d, "hist"))


@query(
    "c12_admin_overview",
    """
    SELECT (SELECT count(*) FROM sys_user) AS total_users,
           count(*) FILTER (CAST(created_at AS DATE) = (SELECT CAST(max(created_at) AS DATE) FROM hist)) AS total_queries_today,
           round(count(*) FILTER (status = 'completed') / count(*)::DOUBLE, 6) AS success_rate,
           round(avg(execution_time_ms) FILTER (status = 'completed') / 1000, 6) AS avg_response_time
    FROM hist
    """,
    views=("hist", "sys_user"),
)
def _admin(spark, d):
    return H.admin_overview(view(spark, d, "sys_user"), view(spark, d, "hist"))


@query(
    "c13_add_favorites",
    """
    SELECT user_id, id AS history_id, min('new ' || user_question) AS favorite_name FROM (
        SELECT user_id, id, user_question FROM hist WHERE status = 'completed'
        UNION ALL SELECT user_id, id, 'again' FROM hist WHERE theme_id = 3)
    WHERE (user_id, id) NOT IN (SELECT (user_id, history_id) FROM fav) GROUP BY 1, 2
    """,
    views=("hist", "fav"),
)
def _add(spark, d):
    hist = view(spark, d, "hist")
    name = F.concat(F.lit("new "), F.col("user_question")).alias("favorite_name")
    new = (
        hist.filter("status = 'completed'")
        .select("user_id", F.col("id").alias("history_id"), name)
        .unionByName(
            hist.filter("theme_id = 3").select(
                "user_id", F.col("id").alias("history_id"), F.lit("new again").alias("favorite_name")
            )
        )
    )
    return H.add_favorites(new, view(spark, d, "fav"), order=F.col("favorite_name"))


_FAV_EXTRA = "concat('folder ', CAST(history_id % 3 AS STRING)) AS folder_name"


@query(
    "c14_favorite_search",
    f"""
    SELECT user_id, history_id, favorite_name FROM (SELECT *, {_FAV_EXTRA} FROM fav)
    WHERE folder_name = 'folder 1' AND favorite_name ILIKE '%FAV%' AND history_id % 4 IN (0, 1)
    ORDER BY history_id DESC, user_id, favorite_name LIMIT 20
    """,
    views=("fav",),
)
def _fav_search(spark, d):
    fav = view(spark, d, "fav").selectExpr("*", _FAV_EXTRA, "array(CAST(history_id % 4 AS STRING), 'all') AS tags")
    found = H.favorite_search(fav, folder="folder 1", keyword="FAV", tags=["0", "1"])
    order = [F.desc("history_id"), "user_id", "favorite_name"]
    return page(found, order, 1, 20).select("user_id", "history_id", "favorite_name")


@query(
    "c15_favorite_detail",
    """
    SELECT f.user_id, h.id, favorite_name, user_question, status
    FROM fav f JOIN hist h ON f.history_id = h.id AND f.user_id = h.user_id
    """,
    views=("fav", "hist"),
)
def _fav_detail(spark, d):
    return H.favorite_detail(view(spark, d, "fav"), view(spark, d, "hist")).select(
        "user_id", "id", "favorite_name", "user_question", "status"
    )


# two rounds of changes per entry: one to the status, a later one to the time
_CHANGES = """
    SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'timeout' END AS status, CAST(NULL AS BIGINT) AS execution_time_ms,
           1 AS step FROM {events} WHERE event_type <> 'click'
    UNION ALL
    SELECT event_id AS id, NULL AS status, event_id % 100 AS execution_time_ms, 2 AS step FROM {events} WHERE value > 50
"""


@query(
    "c16_apply_history_updates",
    f"""
    WITH ch AS ({_CHANGES.format(events="events")}),
    last AS (SELECT id, arg_max(status, step) FILTER (status IS NOT NULL) AS status,
                    arg_max(execution_time_ms, step) FILTER (execution_time_ms IS NOT NULL) AS ms, max(step) AS step
             FROM ch GROUP BY id)
    SELECT h.id, coalesce(l.status, h.status) AS status, coalesce(l.ms, h.execution_time_ms) AS execution_time_ms,
           coalesce(l.step, 0) AS updated_at
    FROM hist h LEFT JOIN last l USING (id)
    """,
    views=("hist",),
)
def _updates(spark, d):
    hist = view(spark, d, "hist").select("id", "status", "execution_time_ms", F.lit(0).alias("updated_at"))
    changes = spark.sql(_CHANGES, events=read_table(spark, d, "events"))
    return H.apply_history_updates(hist, changes, ["status", "execution_time_ms"], seq="step")


@query(
    "c17_delete_history",
    """
    SELECT id, user_id FROM hist h WHERE NOT (status = 'failed' AND user_id % 2 = 0)
    """,
    views=("hist",),
)
def _delete(spark, d):
    return _deleted(spark, d)[0].select("id", "user_id")


def _deleted(spark, d):
    """Everyone asks to delete failed entries; odd users ask in the name of somebody else."""
    hist = view(spark, d, "hist")
    asked = hist.filter("status = 'failed'").select("id", F.expr("IF(user_id % 2 = 0, user_id, -user_id)").alias("user_id"))
    return H.delete_history(hist, view(spark, d, "fav"), asked)


@query(
    "c17_delete_history_favorites",
    """
    SELECT f.user_id, history_id, favorite_name FROM fav f
    WHERE history_id NOT IN (SELECT id FROM hist WHERE status = 'failed' AND user_id % 2 = 0)
    """,
    views=("hist", "fav"),
)
def _delete_fav(spark, d):
    return _deleted(spark, d)[1]


@query(
    "c17_delete_history_count",
    "SELECT count(*) AS deleted FROM hist WHERE status = 'failed' AND user_id % 2 = 0",
    views=("hist",),
)
def _delete_count(spark, d):
    return _deleted(spark, d)[2]


@query(
    "c18_expire_tasks",
    """
    SELECT id, status FROM hist WHERE NOT (status IN ('success', 'completed', 'failed', 'cancelled')
        AND created_at < (SELECT max(created_at) FROM hist) - INTERVAL 24 HOUR)
    """,
    views=("hist",),
)
def _expire(spark, d):
    return H.expire_tasks(view(spark, d, "hist")).select("id", "status")


@query("c19_active_tasks", "SELECT count(*) AS active FROM hist WHERE status IN ('pending', 'running', 'processing')", views=("hist",))
def _active(spark, d):
    return H.active_tasks(view(spark, d, "hist"))


@query(
    "c20_batch_status",
    """
    SELECT id % 100 AS batch_id, count(*) AS total_tasks, count(*) FILTER (status = 'completed') AS completed_tasks,
           count(*) FILTER (status = 'failed') AS failed_tasks FROM hist GROUP BY 1
    """,
    views=("hist",),
)
def _batch(spark, d):
    return H.batch_status(view(spark, d, "hist").withColumn("batch_id", F.expr("id % 100")))


@query(
    "c21_access_summary",
    """
    SELECT user_question, count(*) AS access_count, CAST(max(created_at) AS VARCHAR) AS last_accessed_at
    FROM hist GROUP BY 1
    """,
    views=("hist",),
)
def _access(spark, d):
    return _text(H.access_summary(view(spark, d, "hist")), "last_accessed_at")
