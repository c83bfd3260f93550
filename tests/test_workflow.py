from datetime import datetime

from quern.functions import fixed
from quern.operators import catalog as C
from quern.operators import workflow as G


def test_timeline_gap(spark):
    nodes = spark.createDataFrame(
        [(1, 2, datetime(2024, 1, 1, 0, 0, 5), 10), (1, 1, datetime(2024, 1, 1), 1500), (2, 1, datetime(2024, 1, 1), None)],
        "task_id int, node_order int, start_time timestamp_ntz, duration_ms long",
    )
    tasks = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "task_id int, name string")
    out = {(r.task_id, r.node_order): (r.end_time, r.gap_ms) for r in G.task_timeline(tasks, nodes).collect()}
    assert out[(1, 1)] == (datetime(2024, 1, 1, 0, 0, 1, 500000), None)
    assert out[(1, 2)][1] == 3500
    assert out[(2, 1)] == (None, None)


def test_progress(spark):
    nodes = spark.createDataFrame(
        [(1, "sql_generation", "success"), (1, "sql_validation", "success"), (2, "result_processing", "success"), (3, "sql_validation", "failed"),
         (4, "sql_execution", "success"), (4, "error_handling", "success"), (5, "other", "success")],
        "task_id int, node_type string, node_status string",
    )
    assert {r.task_id: r.progress_percentage for r in G.task_progress(nodes).collect()} == {1: 60, 2: 100, 3: 0, 4: 0, 5: 0}


def test_validation_errors_in_order(spark):
    df = spark.createDataFrame([("drop t -- x", 0), (None, 1), ("SELECT 1", 1), ("SELECT 1", None)], "sql_text string, user_id int")
    out = [(r.valid, r.errors) for r in G.validation_result(df).collect()]
    assert out == [
        (False, ["不允许使用 DROP 操作", "检测到潜在的SQL注入风险: --", "用户ID缺失"]),
        (False, ["SQL不能为空"]), (True, []), (False, ["用户ID缺失"]),
    ]


def test_suggestions_add_up(spark):
    df = spark.createDataFrame([("语法与超时",), ("?",), (None,)], "error_message string")
    out = [r.suggestions for r in G.error_suggestions(df).collect()]
    assert out == [[*fixed.ERROR_HINTS["语法"], *fixed.ERROR_HINTS["超时"]], list(fixed.DEFAULT_HINTS), list(fixed.DEFAULT_HINTS)]


def test_error_codes(spark):
    df = spark.createDataFrame([(500002,), (1,), (None,)], "error_code int")
    assert [r.error_message for r in G.error_code_names(df).collect()] == ["查询引擎错误", "未知错误", "未知错误"]


def test_templates(spark):
    df = spark.createDataFrame([("{a} {b} {a}", "b, a"), ("{a}", ""), ("x", None), ("x", "c")], "template_content string, variable_list string")
    assert [(r.valid, r.undeclared, r.unused) for r in G.validate_templates(df).collect()] == [
        (True, [], []), (False, ["a"], []), (True, [], []), (False, [], ["c"]),
    ]


def test_question_checks(spark):
    df = spark.createDataFrame([("\n ", 1), ("x" * 1001, 1), ("x" * 1000, 1), ("x", 0), ("x", None), (None, 0)], "user_question string, user_id int")
    assert [r.reason for r in G.validate_questions(df).collect()] == [
        fixed.QUESTION_EMPTY, fixed.QUESTION_TOO_LONG, None, fixed.QUESTION_BAD_USER, fixed.QUESTION_BAD_USER, fixed.QUESTION_EMPTY,
    ]


def test_generated_texts_for_a_table_without_fields(spark):
    tables = spark.createDataFrame([(1, "表", "t", None), (2, "空", "e", "")], "table_id int, table_name_cn string, table_name_en string, table_description string")
    fields = spark.createDataFrame([(2, 1, "乙", "b", "json"), (1, 1, "甲", "a", "integer")], "field_id int, table_id int, field_name_cn string, field_name_en string, field_type string")
    ddl = {r.table_id: r.ddl for r in C.table_ddl(tables, fields).collect()}
    assert ddl == {1: "CREATE TABLE t (\n    a INT,\n    b VARCHAR(255)\n);", 2: "CREATE TABLE e (\n\n);"}
    docs = {r.table_id: r.doc for r in C.table_docs(tables, fields).collect()}
    assert docs == {1: "表名: 表 (t)\n描述: 无描述\n字段说明:\n- 甲 (a): integer\n- 乙 (b): json", 2: "表名: 空 (e)\n描述: 无描述"}
    assert {r.table_id: r.prompt_line for r in C.schema_prompt(tables, fields).collect()} == {1: "表表(t): 甲(a), 乙(b)", 2: "表空(e): "}
