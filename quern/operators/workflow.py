"""Workflow nodes, validation, feedback, templates and the service log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quern.functions import fixed
from quern.functions.columns import any_of, rate, stripped
from quern.functions.guards import EMPTY, first_hit, prepared
from quern.operators.history import _in_range
from quern.operators.sequences import previous_row

#: Nodes of a task that stay together when their gaps are worked out.
NODES = 10_000


def task_timeline(
    tasks: DataFrame, nodes: DataFrame, order: Sequence[str] = ("node_order", "start_time"),
    bucket: Sequence[str] = ("_block",),
) -> DataFrame:
    """Nodes of each task in order, with end time and the gap in ms to the end of the node before.

    A task's nodes are linked before the join, which keeps or drops whole tasks.
    ``node_order`` counts the nodes of a task, so unless another ``bucket`` is
    given, a task with very many nodes is cut at every ``NODES`` of them.
    """
    timed = nodes.withColumn("end_time", F.timestamp_add("MILLISECOND", F.col("duration_ms"), F.col("start_time")))
    timed = timed.withColumn("_block", F.floor(F.col("node_order") / NODES))
    linked = previous_row(timed, ["task_id"], bucket, order, ["end_time"], "_before")
    gap = F.unix_millis(F.col("start_time").cast("timestamp")) - F.unix_millis(F.col("_before.end_time").cast("timestamp"))
    return linked.withColumn("gap_ms", gap).drop("_before", "_block").join(tasks, "task_id")


def node_durations(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("node_type").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(F.col("node_status") == "failed").alias("failures"),
        F.round(F.avg("duration_ms"), 6).alias("mean_ms"),
        F.max("duration_ms").alias("max_ms"),
    )


def task_progress(nodes: DataFrame) -> DataFrame:
    """Progress of the furthest step that succeeded; 0 once a step failed or errors were handled."""
    reached = F.coalesce(
        *[F.when(F.col("node_type") == step, F.lit(value)) for step, value in fixed.STEP_PROGRESS.items()], F.lit(0)
    )
    failed = (F.col("node_status") == "failed") | (F.col("node_type") == "error_handling")
    return nodes.groupBy("task_id").agg(
        F.when(F.bool_or(failed), F.lit(0)).otherwise(F.max(reached)).alias("progress_percentage")
    )


def _message(condition: Column, text: Column) -> Column:
    return F.when(condition, F.array(text)).otherwise(F.array().cast("array<string>"))


def validation_result(df: DataFrame, sql: str = "sql_text", user: str = "user_id") -> DataFrame:
    """Three checks and their errors in the order syntax, security, permission."""
    upper = prepared(F.col(sql), "substring")
    word, pattern = first_hit(F.col(sql), "substring", F.col("_upper")), first_hit(F.col(sql), "injection")
    before, after = fixed.WORD_ERROR
    checked = df.withColumn("_upper", upper).withColumns({"_word": word, "_pattern": pattern, "_user_ok": F.coalesce(F.col(user) != 0, F.lit(False))})
    syntax_error = F.when(F.col("_word") == EMPTY, F.lit(fixed.SQL_EMPTY)).otherwise(
        F.concat(F.lit(before), F.col("_word"), F.lit(after))
    )
    errors = F.concat(
        _message(F.col("_word").isNotNull(), syntax_error),
        _message(F.col("_pattern").isNotNull(), F.concat(F.lit(fixed.INJECTION_ERROR), F.col("_pattern"))),
        _message(~F.col("_user_ok"), F.lit(fixed.USER_MISSING)),
    )
    syntax, security = F.col("_word").isNull(), F.col("_pattern").isNull()
    return checked.select(
        *df.columns,
        syntax.alias("syntax_valid"),
        security.alias("security_valid"),
        F.col("_user_ok").alias("permission_valid"),
        (syntax & security & F.col("_user_ok")).alias("valid"),
        errors.alias("errors"),
    )


def error_suggestions(df: DataFrame, message: str = "error_message") -> DataFrame:
    """Hints for each key word found, all of them; the general pair when none is found."""
    pairs = [
        (F.coalesce(F.contains(F.col(message), F.lit(word)), F.lit(False)), F.array(*[F.lit(h) for h in hints]))
        for word, hints in fixed.ERROR_HINTS.items()
    ]
    none = F.array().cast("array<string>")
    found = F.concat(*[F.when(hit, hints).otherwise(none) for hit, hints in pairs])
    general = F.array(*[F.lit(h) for h in fixed.DEFAULT_HINTS])
    return df.withColumn("suggestions", F.when(any_of([hit for hit, _ in pairs]), found).otherwise(general))


def error_code_names(df: DataFrame, code: str = "error_code") -> DataFrame:
    """Message of an error code; the fourteen codes are a constant map in the plan."""
    pairs = [F.lit(x) for pair in fixed.ERROR_CODES.items() for x in pair]
    message = F.try_element_at(F.create_map(*pairs), F.col(code).cast("int"))
    return df.withColumn("error_message", F.coalesce(message, F.lit(fixed.UNKNOWN_ERROR)))


def feedback_search(feedback: DataFrame, feedback_type: str | None = None, processed: bool | None = None) -> DataFrame:
    if feedback_type:
        feedback = feedback.filter(F.col("feedback_type") == feedback_type)
    if processed is not None:
        feedback = feedback.filter(F.col("is_processed") == processed)
    return feedback


SUB_SCORES = ("sql_accuracy", "result_relevance", "response_speed")


def feedback_summary(feedback: DataFrame) -> DataFrame:
    """Counts and mean scores per type with each type's share of all feedback."""
    scores = [c for c in ("rating", *SUB_SCORES) if c in feedback.columns]
    per_type = feedback.groupBy("feedback_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("is_processed").alias("processed"),
        *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in scores],
    )
    # the total of the few types, so that the feedback is read once
    return per_type.withColumn("share", rate(F.col("n"), F.sum("n").over(W.partitionBy(F.lit(1)))))


def positive_share(feedback: DataFrame, goal: float = 0.7) -> DataFrame:
    share = rate(F.count_if(F.col("feedback_type") == "good"), F.count(F.lit(1)))
    return feedback.agg(share.alias("positive_share")).withColumn("goal_met", F.col("positive_share") >= goal)


def validate_templates(df: DataFrame, content: str = "template_content", declared: str = "variable_list") -> DataFrame:
    """``{name}`` placeholders against the declared list: missing, unused and valid."""
    used = F.array_distinct(F.regexp_extract_all(F.col(content), F.lit(r"\{(\w+)\}"), F.lit(1)))
    names = F.filter(F.transform(F.split(F.coalesce(declared, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    checked = df.withColumns({"_used": F.coalesce(used, F.array().cast("array<string>")), "_declared": F.array_distinct(names)})
    return checked.select(
        *df.columns,
        F.array_sort(F.array_except("_used", "_declared")).alias("undeclared"),
        F.array_sort(F.array_except("_declared", "_used")).alias("unused"),
    ).withColumn("valid", (F.size("undeclared") == 0) & (F.size("unused") == 0))


def log_search(log: DataFrame, user_id=None, status: str | None = None, start=None, end=None, status_col: str = "log_level") -> DataFrame:
    conditions = _in_range("created_at", start, end)
    if user_id is not None:
        conditions.append(F.col("user_id") == user_id)
    if status:
        conditions.append(F.col(status_col) == status)
    for condition in conditions:
        log = log.filter(condition)
    return log


def log_metrics(log: DataFrame) -> DataFrame:
    """Calls, error rate and mean response per module and hour."""
    calls = F.count(F.lit(1))
    return log.groupBy("module", F.date_trunc("hour", "created_at").alias("hour")).agg(
        calls.alias("calls"),
        rate(F.count_if(F.col("log_level") == "error"), calls).alias("error_rate"),
        F.round(F.avg("response_time_ms"), 6).alias("mean_ms"),
    )


def validate_questions(df: DataFrame, question: str = "user_question", user: str = "user_id") -> DataFrame:
    """Why a question is refused, NULL when it is accepted; the first failing check counts."""
    text = F.col(question)
    reason = F.coalesce(
        F.when(text.isNull() | (stripped(text) == ""), F.lit(fixed.QUESTION_EMPTY)),
        F.when(F.char_length(text) > fixed.QUESTION_MAX_CHARS, F.lit(fixed.QUESTION_TOO_LONG)),
        F.when(F.col(user).isNull() | (F.col(user) <= 0), F.lit(fixed.QUESTION_BAD_USER)),
    )
    return df.withColumn("reason", reason)


# --- duration percentiles from stored KLL sketches ---

#: Accuracy of a sketch: normalised rank error about 1.65 / k ** 0.96 (1.3 % at 200, 99 % confidence).
SKETCH_K = 200
QUANTILES = (0.5, 0.95, 0.99)


def duration_sketches(nodes: DataFrame, by: Sequence[str] = ("node_type",), period: str = "start_time", value: str = "duration_ms") -> DataFrame:
    """One KLL sketch of durations per group and day, built in one scan; store it and merge upward later.

    Null durations are left out of the sketches (their rows still count in
    ``calls``, not in ``measured``); a group without durations has null percentiles.
    """
    day = F.date_trunc("day", F.col(period).cast("timestamp")).alias("day")
    return nodes.groupBy(*by, day).agg(
        F.count(F.lit(1)).alias("calls"),
        F.count(value).alias("measured"),
        F.kll_sketch_agg_bigint(F.col(value).cast("long"), SKETCH_K).alias("sketch"),
    )


def duration_percentiles(sketches: DataFrame, by: Sequence[str] = ("node_type",), quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """Merged sketches of all days per group: calls, and p50, p95, p99 (or the given quantiles) in ms."""
    merged = sketches.groupBy(*by).agg(
        F.sum("calls").alias("calls"), F.sum("measured").alias("measured"), F.kll_merge_agg_bigint("sketch").alias("sketch")
    )
    values = F.when(F.col("measured") > 0, F.kll_sketch_get_quantile_bigint("sketch", F.array(*[F.lit(q) for q in quantiles])))
    names = [f"p{round(q * 100):d}" for q in quantiles]
    return merged.select(*by, "calls", *[F.get(values, i).alias(n) for i, n in enumerate(names)])
