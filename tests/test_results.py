from datetime import datetime
from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import guards
from quern.operators import results as R


def cells(df):
    return [tuple(r) for r in df.collect()]


def test_page_info_of_empty_and_size_zero(spark):
    empty = spark.createDataFrame([], "id long")
    assert cells(R.page_info(empty, 20)) == [(0, 0)]
    some = spark.range(41)
    assert cells(R.page_info(some, 20)) == [(41, 3)]
    assert cells(R.page_info(some, 0)) == [(41, 0)]
    assert R.page(some, ["id"], 3, 20).collect()[0].id == 40
    assert R.page(some, ["id"], 4, 20).count() == 0


def test_pages_cover_all_rows_once_in_spite_of_ties(spark):
    df = spark.range(55).withColumn("tie", F.col("id") % 3)
    seen = [r.id for p in range(1, 7) for r in R.page(df, ["tie", "id"], p, 10).collect()]
    assert sorted(seen) == list(range(55))


@pytest.mark.parametrize("page,size", [(1, 7), (3, 7), (9, 40), (13, 8), (14, 8), (50, 8), (1, 500)])
def test_far_pages_equal_near_pages(spark, page, size, monkeypatch):
    df = spark.range(100).select(F.col("id"), F.expr("IF(id % 9 = 0, NULL, id % 4)").alias("tie"))
    order = [F.desc("tie"), "id"]
    near = [r.id for r in R.page(df, order, page, size).collect()]
    monkeypatch.setattr(R, "SORTED_ROWS", 5)
    monkeypatch.setattr(R, "SPLITTERS", 4)
    far = [r.id for r in R.page(df, order, page, size).collect()]
    assert far == near
    if near and page > 1:
        key = df.orderBy(*order).offset((page - 1) * size - 1).limit(1).first()
        assert [r.id for r in R.page_after(df, order, [key.tie, key.id], size).collect()] == near


def test_page_where_one_leading_value_holds_most_rows(spark, monkeypatch):
    monkeypatch.setattr(R, "SORTED_ROWS", 50)
    df = spark.range(3000).select("id", F.expr("IF(id % 20 = 0, id, 7)").alias("k"), F.expr("concat('n', id % 7)").alias("name"))
    order = ["k", F.desc("name"), F.col("id").desc_nulls_last()]
    for page in (1, 40, 140, 150, 151):
        want = [r.id for r in df.orderBy(*order).offset((page - 1) * 20).limit(20).collect()]
        assert [r.id for r in R.page(df, order, page, 20).collect()] == want


def test_cap_keeps_a_smaller_limit(spark):
    assert R.cap_rows(spark.range(10).limit(3), 5).count() == 3
    assert R.cap_rows(spark.range(10), 5).count() == 5


def test_search_reads_null_as_text_and_takes_wildcards_literally(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, "50%", 1.5), (3, "NULLable", 10000000.0)], "id int, name string, v double")
    assert {r.id for r in R.search_rows(df, "null").collect()} == {1, 3}
    assert {r.id for r in R.search_rows(df, "%").collect()} == {2}
    assert {r.id for r in R.search_rows(df, "2.0").collect()} == set()
    assert {r.id for r in R.search_rows(df, "10000000").collect()} == {3}
    assert R.search_rows(df, "").count() == 3


def test_sort_rows(spark):
    df = spark.createDataFrame([(1, "b"), (2, "A"), (3, None), (4, "z")], "id int, s string")
    assert [r.id for r in R.sort_rows(df, "s").collect()] == [2, 1, 3, 4]
    assert [r.id for r in R.sort_rows(df, "s", "desc").collect()] == [4, 3, 1, 2]
    numbers = spark.createDataFrame([(10,), (9,), (100,)], "n int")
    assert [r.n for r in R.sort_rows(numbers, "n").collect()] == [9, 10, 100]
    assert R.toggled_direction("a", "a", "asc") == "desc"
    assert R.toggled_direction("b", "a", "desc") == "asc"


def exact(x: float) -> str:
    if x == int(x):
        return str(int(x))
    text = str(abs(Decimal(x)).quantize(Decimal("0.01"), ROUND_HALF_UP))
    return f"-{text}" if x < 0 else text


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.one_of(
            st.floats(-1e9, 1e9, allow_nan=False),
            st.integers(-10**7, 10**7).map(lambda n: n / 1000),
            st.integers(-10**5, 10**5).map(lambda n: (2 * n + 1) / 200),
        ),
        min_size=1,
        max_size=200,
    )
)
def test_two_decimals_are_exact(spark, values):
    values = [v + 0.0 for v in values if v != 0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    shown = [r.v for r in R.format_cells(df).orderBy(F.col("i").cast("int")).collect()]
    assert shown == [exact(v) for v in values]


def test_format_cells(spark):
    df = spark.createDataFrame(
        [(None, 1.005, Decimal("2.50"), True), (3, 0.125, Decimal("4.00"), None)], "a int, b double, c decimal(10,2), d boolean"
    )
    assert cells(R.format_cells(df)) == [("-", "1.00", "2.50", "true"), ("3", "0.13", "4", "-")]


def test_iso_datetimes(spark):
    df = spark.createDataFrame(
        [(datetime(2024, 1, 2, 3, 4, 5), 1), (datetime(2024, 1, 2, 3, 4, 5, 60), 2), (None, 3)], "t timestamp_ntz, n int"
    )
    assert [r.t for r in R.iso_datetimes(df).orderBy("n").collect()] == [
        "2024-01-02T03:04:05", "2024-01-02T03:04:05.000060", None,
    ]


STATEMENTS = {
    "SELECT created_at FROM t": (None, "CREATE", None, None),
    "SELECT updated_at FROM t": (None, None, "UPDATE", None),
    "drop table t": ("DROP", "DROP", "DROP", None),
    "DROP\tTABLE t": (None, "DROP", "DROP", None),
    "SELECT 1;DELETE FROM t": (None, "DELETE", "DELETE", None),
    "SELECT 1 -- x": (None, None, None, "--"),
    "SELECT 1 ;-- x": (None, None, None, "--"),
    "x' or '1'='1": (None, None, None, None),
    "x' OR '1'='1": (None, None, None, "' OR '1'='1"),
    "": ("empty", "empty", None, None),
    " \n\t": (None, "empty", None, None),
    None: ("empty", "empty", None, None),
}


def test_statement_rules_stay_apart(spark):
    df = spark.createDataFrame([(s,) for s in STATEMENTS], "s string")
    for position, rule in enumerate(("token", "substring", "strict", "injection")):
        got = {r.s: r.hit for r in R.audit_sql(df, "s", rule).collect()}
        assert got == {s: hits[position] for s, hits in STATEMENTS.items()}, rule


def test_normalised_statement(spark):
    df = spark.createDataFrame([(" a ",), ("a;",), ("",), (None,), ("  ",)], "s string")
    assert [r.clean_sql for r in R.audit_sql(df, "s", "token").collect()] == ["a;", "a;", "", "", ";"]


@pytest.mark.parametrize(
    "sql", ["DROP TABLE t", "SELECT 1; DELETE\nFROM t", "INSERT INTO t VALUES (1)", "SET a=b", "", "  ", None, "CACHE TABLE t", "-- x\nSET a=b",
     "SELECT TRANSFORM(a) USING 'cat' AS (b) FROM (SELECT 1 AS a)", "SELECT reflect('java.lang.System', 'currentTimeMillis')",
     "SELECT `java_method`('java.util.UUID', 'randomUUID')", "WITH q AS (SELECT max(try_reflect('a', 'b')) x FROM range(2)) SELECT * FROM q",
     "SELECT * FROM parquet.`/root/x`", "SELECT (SELECT count(*) FROM JSON.`/x`)", "SELECT system.builtin.reflect('a', 'b')",
     "SELECT " + ", ".join(f"{i} AS c{i}" for i in range(60)) + ", reflect('a', 'b')"]
)
def test_run_sql_refuses(spark, sql):
    with pytest.raises(ValueError):
        R.run_sql(spark, sql)


def test_run_sql_gives_all_rows(spark):
    assert R.run_sql(spark, "SELECT id FROM range(2500)").count() == 2500
    assert R.run_sql(spark, "SELECT 'no reflect here, nor parquet' AS reflect FROM range(1)").count() == 1


def test_numbers_as_cells(spark):
    values = [float("nan"), float("inf"), float("-inf"), 1e19, -1e20, 1e300, 2.0**53, -0.0, 0.005, 1.005, 123456789.125, None, 5e-324]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    shown = [r.v for r in R.format_cells(df).collect()]
    assert shown[:5] == ["NaN", "Infinity", "-Infinity", "1" + "0" * 19, "-1" + "0" * 20]
    assert shown[5] == "1" + "0" * 300 and shown[6] == "9007199254740992"
    assert shown[8:] == ["0.01", "1.00", "123456789.13", "-", "0.00"]


def test_search_finds_every_digit(spark):
    df = spark.createDataFrame([(1, 1e-15), (2, 1.25e-7), (3, -3e22), (4, 12345678.9)], "id int, v double")
    found = lambda t: [r.id for r in R.search_rows(df, t).collect()]
    assert found("0.000000000000001") == [1] and found("0.000000125") == [2]
    # the JVM prints this double with one digit
    assert found("-30000000000000000000000") == [3] and found("12345678.9") == [4]


def test_run_sql_binds_and_caps(spark):
    assert cells(R.run_sql(spark, "-- note\nSELECT id FROM range(10) WHERE id >= :low ;", {"low": 3}, max_rows=2)) == [(3,), (4,)]
    assert cells(R.run_sql(spark, "WITH a AS (SELECT 1 AS created_at) SELECT * FROM a")) == [(1,)]
    assert guards.read_only_problem("(SELECT 1)") is None
    hostile = "0 OR 1=1"
    assert R.run_sql(spark, "SELECT id FROM range(3) WHERE CAST(id AS STRING) = :v", {"v": hostile}).count() == 0


def test_masking(spark):
    df = spark.createDataFrame([("13812345678", "a", "s"), ("1234567", None, None), ("12345678", "", "t")], "p string, h string, e string")
    out = R.mask_columns(df, {"p": "mask", "h": "replace"}).collect()
    assert [r.p for r in out] == ["138****5678", "*******", "123*5678"]
    assert [r.h for r in out] == ["***", None, "***"]
    assert cells(R.mask_columns(df, {"p": "mask"}, enabled=False)) == cells(df)
    key = F.lit("0123456789abcdef")
    back = R.mask_columns(df, {"e": "encrypt"}, key=key).select(F.aes_decrypt(F.unbase64("e"), key).cast("string").alias("e"))
    assert [r.e for r in back.collect()] == ["s", None, "t"]


def test_row_and_column_filters(spark):
    df = spark.createDataFrame([(1, "n"), (2, "s"), (3, None)], "id int, region string")
    grants = spark.createDataFrame([("n",), ("n",)], "region string")
    assert cells(R.row_filter(df, grants, "region")) == [(1, "n")]
    assert R.column_filter(df, ["id"]).columns == ["id"]
    kept = R.column_filter(df, ["id"], keep_shape=True)
    assert kept.schema == df.schema and {r.region for r in kept.collect()} == {None}


def test_business_queries_follow_the_newest_row(spark):
    df = spark.createDataFrame(
        [(datetime(2020, 1, d), float(d)) for d in (1, 2, 31)] + [(datetime(2020, 1, 31), 0.1)], "o_orderdate timestamp_ntz, o_totalprice double"
    )
    assert [(str(r.day), r.order_count, str(r.total_sales)) for r in R.daily_order_stats(df, 29).collect()] == [
        ("2020-01-31", 2, "31.10"), ("2020-01-02", 1, "2.00"),
    ]
    assert R.daily_order_stats(df.limit(0)).count() == 0


def test_question_routes(spark):
    df = spark.createDataFrame([("订单和用户",), ("用户",), (None,)], "q string")
    assert [r.route for r in R.query_route(df, "q").collect()] == ["sales_orders", "users", "other"]
