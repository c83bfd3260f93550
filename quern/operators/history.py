"""Query history: search, favourites, statistics, updates and expiry.

Every aggregate combines inside the map tasks before the shuffle, so a user,
question or theme that holds a third of the log reaches its reducer as one
partial row per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import fixed
from quern.functions.columns import like_any, rate
from quern.functions.keys import keys_of


def _in_range(ts: str, start: datetime | str | None, end: datetime | str | None) -> list[Column]:
    """Both ends belong to the range."""
    bounds = []
    if start:
        bounds.append(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    if end:
        bounds.append(F.col(ts) <= F.lit(end).cast("timestamp_ntz"))
    return bounds


def in_state(word: str, col: str = "status") -> Column:
    """The state under the history's word or the task table's word for it."""
    words = next((pair for pair in fixed.SAME_STATES if word in pair), (word,))
    return F.col(col).isin(*words)


def history_search(
    hist: DataFrame,
    user_id: int | None = None,
    status: str | None = None,
    theme_id: int | None = None,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
    keyword: str | None = None,
) -> DataFrame:
    """All given filters together. Empty ones are skipped, so theme 0 means any theme.

    The keyword is a case-insensitive LIKE on question or SQL text. Page the
    result by ``[desc("created_at"), "id"]``.
    """
    conditions = _in_range("created_at", start, end)
    if user_id is not None:
        conditions.append(F.col("user_id") == user_id)
    if status:
        conditions.append(in_state(status))
    if theme_id:
        conditions.append(F.col("theme_id") == theme_id)
    if keyword:
        conditions.append(like_any(keyword, "user_question", "generated_sql"))
    for condition in conditions:
        hist = hist.filter(condition)
    return hist


def history_count(hist: DataFrame, **filters: object) -> DataFrame:
    return history_search(hist, **filters).agg(F.count(F.lit(1)).alias("total"))


def with_favorite_flag(hist: DataFrame, fav: DataFrame, user_id: int | None = None) -> DataFrame:
    """``is_favorite`` is true when the viewing user (or, without one, the row's own user) keeps the entry."""
    if user_id is None:
        keys = fav.select("user_id", F.col("history_id").alias("id")).distinct()
        on = ["user_id", "id"]
    else:
        keys = fav.filter(F.col("user_id") == user_id).select(F.col("history_id").alias("id")).distinct()
        on = ["id"]
    marked = hist.join(keys.withColumn("_kept", F.lit(True)), on, "left")
    return marked.select(*hist.columns, F.coalesce("_kept", F.lit(False)).alias("is_favorite"))


def with_theme_and_tables(hist: DataFrame, theme: DataFrame, tables: DataFrame) -> DataFrame:
    """Theme name and sorted table names; NULL when there are none.

    Only (id, name) pairs are shuffled to rebuild the lists, which are as long
    as the entry's own ``table_ids``.
    """
    names = (
        hist.select("id", F.explode("table_ids").alias("table_id"))
        .join(tables.select("table_id", "table_name_cn"), "table_id")
        .groupBy("id")
        .agg(F.sort_array(F.collect_list("table_name_cn")).alias("table_names"))
    )
    return hist.join(theme.select("theme_id", "theme_name"), "theme_id", "left").join(names, "id", "left")


def history_detail(
    hist: DataFrame, fav: DataFrame, theme: DataFrame, tables: DataFrame, history_id: int, user_id: int
) -> DataFrame:
    """One entry, and only for its owner."""
    own = hist.filter((F.col("id") == history_id) & (F.col("user_id") == user_id))
    return with_theme_and_tables(with_favorite_flag(own, fav, user_id), theme, tables)


def _scoped(hist: DataFrame, user_id, start, end) -> DataFrame:
    return history_search(hist, user_id=user_id, start=start, end=end)


def statistics_columns() -> list[Column]:
    done = in_state("completed")
    total, completed = F.count(F.lit(1)), F.count_if(done)
    return [
        total.alias("total_queries"),
        completed.alias("successful_queries"),
        F.count_if(F.col("status") == "failed").alias("failed_queries"),
        rate(completed, total).alias("success_rate"),
        F.round(F.avg(F.when(done, F.col("execution_time_ms"))), 6).alias("avg_execution_time_ms"),
        F.coalesce(F.sum("llm_tokens_used"), F.lit(0)).alias("total_tokens_used"),
    ]


def query_statistics(hist: DataFrame, user_id=None, start=None, end=None, by: Sequence[str] = ()) -> DataFrame:
    """Totals in one scan; mean time over completed entries only. ``by`` gives one row per group."""
    scoped = _scoped(hist, user_id, start, end)
    return scoped.groupBy(*by).agg(*statistics_columns()) if by else scoped.agg(*statistics_columns())


def status_distribution(hist: DataFrame, user_id=None, start=None, end=None) -> DataFrame:
    return _scoped(hist, user_id, start, end).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def daily_statistics(hist: DataFrame, user_id=None, start=None, end=None) -> DataFrame:
    return (
        _scoped(hist, user_id, start, end)
        .groupBy(F.to_date("created_at").alias("day"), "status")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def theme_statistics(hist: DataFrame, theme: DataFrame, user_id=None, start=None, end=None) -> DataFrame:
    """Counts per theme first, names joined to the few resulting rows."""
    counts = (
        _scoped(hist, user_id, start, end)
        .groupBy(F.col("theme_id").cast("long").alias("theme_id"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(in_state("completed")).alias("completed"))
    )
    return counts.join(theme.select("theme_id", "theme_name"), "theme_id", "left")


def most_used_tables(hist: DataFrame, tables: DataFrame, n: int = 10) -> DataFrame:
    used = (
        hist.select(F.explode("table_ids").alias("table_id")).groupBy("table_id").agg(F.count(F.lit(1)).alias("uses"))
    )
    return (
        used.join(tables.select("table_id", "table_name_cn"), "table_id").orderBy(F.desc("uses"), "table_id").limit(n)
    )


def popular_questions(hist: DataFrame, n: int = 10) -> DataFrame:
    return (
        hist.groupBy("user_question")
        .agg(F.count(F.lit(1)).alias("asked"))
        .orderBy(F.desc("asked"), "user_question")
        .limit(n)
    )


def admin_overview(users: DataFrame, hist: DataFrame) -> DataFrame:
    """Users, queries on the newest day, success rate and mean response time in seconds.

    One pass over the log, grouped by day; the few days are then added up.
    """
    total_users = users.agg(F.count(F.lit(1))).scalar()
    done = in_state("completed")
    taken = F.when(done, F.col("execution_time_ms"))
    days = hist.groupBy(F.to_date("created_at").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(done).alias("done"), F.sum(taken).alias("ms"), F.count(taken).alias("timed")
    )
    return days.agg(
        F.coalesce(F.max_by("n", "day"), F.lit(0)).alias("total_queries_today"),
        rate(F.sum("done"), F.sum("n")).alias("success_rate"),
        F.round(F.sum("ms") / F.sum("timed") / 1000, 6).alias("avg_response_time"),
    ).select(total_users.alias("total_users"), "*")


def add_favorites(new: DataFrame, existing: DataFrame, order: Column) -> DataFrame:
    """Favourites to insert: the first per (user, entry) in the batch, none that exist already."""
    keys = ["user_id", "history_id"]
    rest = [c for c in new.columns if c not in keys]
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(order.alias("_order"), *rest)).alias("_row")).select(*keys, "_row.*")
    return first.join(keys_of(existing, *keys), keys, "left_anti").select(*new.columns)


def favorite_search(
    fav: DataFrame, user_id=None, folder: str | None = None, keyword: str | None = None, tags: Sequence[str] = ()
) -> DataFrame:
    if user_id is not None:
        fav = fav.filter(F.col("user_id") == user_id)
    if folder:
        fav = fav.filter(F.col("folder_name") == folder)
    if keyword:
        fav = fav.filter(like_any(keyword, *[c for c in ("favorite_name", "user_question") if c in fav.columns]))
    if tags:
        fav = fav.filter(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    return fav


def favorite_detail(fav: DataFrame, hist: DataFrame, user_id=None) -> DataFrame:
    """Favourites with the entry they keep, which must belong to the same user."""
    if user_id is not None:
        fav, hist = fav.filter(F.col("user_id") == user_id), hist.filter(F.col("user_id") == user_id)
    return fav.withColumnRenamed("history_id", "id").join(hist, ["user_id", "id"])


def latest_supplied(changes: DataFrame, key: Sequence[str], fields: Sequence[str], seq: str) -> DataFrame:
    """Per key and field the last supplied value.

    A field counts as supplied when it is listed in ``supplied``, or without
    that column when it is not NULL. Changes to different fields of one key
    add up, as they would one after the other; of changes at the same moment
    the greater value stays, whatever the partitioning.
    """

    def given(name: str) -> Column:
        return F.array_contains("supplied", name) if "supplied" in changes.columns else F.col(name).isNotNull()

    return changes.groupBy(*key).agg(
        *[F.max_by(F.struct(F.col(f).alias("v")), F.when(given(f), F.struct(F.col(seq), F.col(f)))).alias(f) for f in fields],
        F.max(seq).alias("_seq"),
    )


def apply_history_updates(
    hist: DataFrame, changes: DataFrame, fields: Sequence[str], seq: str = "changed_at", key: str = "id"
) -> DataFrame:
    """Overwrite supplied fields only and refresh ``updated_at``; changes to unknown ids are ignored."""
    if "updated_at" not in hist.columns:
        hist = hist.withColumn("updated_at", F.col("created_at"))
    latest = latest_supplied(changes, [key], fields, seq).select(
        key, *[F.col(f).alias(f"_new_{f}") for f in fields], F.col("_seq").alias("_new_updated_at")
    )
    joined = hist.join(latest, key, "left")

    def value(name: str) -> Column:
        if name == "updated_at":
            return F.coalesce("_new_updated_at", "updated_at").alias(name)
        if name in fields:
            return F.when(F.col(f"_new_{name}").isNotNull(), F.col(f"_new_{name}.v")).otherwise(F.col(name)).alias(name)
        return F.col(name)

    return joined.select(*[value(c) for c in hist.columns])


def delete_history(
    hist: DataFrame, fav: DataFrame, ids: DataFrame, user_id: int | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """History and favourites that stay, and a one-row count of deleted entries.

    ``ids`` holds ``id`` and, without ``user_id``, the asking ``user_id``; only
    the asker's own entries go, with everybody's favourites of them.
    """
    asked = ids if user_id is None else ids.select("id", F.lit(user_id).cast(hist.schema["user_id"].dataType).alias("user_id"))
    asked = keys_of(asked, "id", "user_id")
    doomed = hist.select("id", "user_id").join(asked, ["id", "user_id"], "left_semi")
    kept = hist.join(asked, ["id", "user_id"], "left_anti").select(*hist.columns)
    kept_fav = fav.join(keys_of(doomed, F.col("id").alias("history_id")), "history_id", "left_anti").select(*fav.columns)
    return kept, kept_fav, doomed.agg(F.count(F.lit(1)).alias("deleted"))


def expire_tasks(tasks: DataFrame, hours: int = 24, status: str = "status", ts: str = "created_at") -> DataFrame:
    """Drop finished tasks strictly older than the limit, counted from the newest entry."""
    now = tasks.agg(F.max(ts)).scalar()
    old = F.col(ts) < now - F.make_dt_interval(F.lit(0), F.lit(hours))
    return tasks.filter(~F.coalesce(F.col(status).isin(*fixed.EXPIRABLE_STATES) & old, F.lit(False)))


def active_tasks(tasks: DataFrame, status: str = "status") -> DataFrame:
    return tasks.filter(F.col(status).isin(*fixed.ACTIVE_STATES)).agg(F.count(F.lit(1)).alias("active"))


def batch_status(tasks: DataFrame, batch: str = "batch_id", status: str = "status") -> DataFrame:
    return tasks.groupBy(batch).agg(
        F.count(F.lit(1)).alias("total_tasks"),
        F.count_if(in_state("completed", status)).alias("completed_tasks"),
        F.count_if(F.col(status) == "failed").alias("failed_tasks"),
    )


def access_summary(hist: DataFrame) -> DataFrame:
    return hist.groupBy("user_question").agg(
        F.count(F.lit(1)).alias("access_count"), F.max("created_at").alias("last_accessed_at")
    )
