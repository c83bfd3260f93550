from datetime import datetime

from pyspark.sql import functions as F

from quern.operators import access as A
from quern.operators import catalog as C
from quern.operators import history as H
from quern.operators import results as R

HIST = "id long, user_id long, status string, theme_id int, user_question string, generated_sql string, execution_time_ms long, llm_tokens_used long, created_at timestamp_ntz"


def hist(spark, rows=()):
    return spark.createDataFrame(list(rows), HIST)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def day(d, h=0):
    return datetime(2024, 1, d, h)


def test_statistics_of_nothing(spark):
    assert rows(H.query_statistics(hist(spark), 1)) == [(0, 0, 0, 0.0, None, 0)]


def test_statistics_with_nulls(spark):
    df = hist(spark, [(1, 1, "failed", 1, "q", None, 5, None, day(1)), (2, 1, "completed", 1, "q", "s", None, None, day(2))])
    assert rows(H.query_statistics(df, 1)) == [(2, 1, 1, 0.5, None, 0)]


def test_search_bounds_and_falsy_filters(spark):
    df = hist(spark, [(i, 1, "completed", i % 2, "a_b", None, 1, 1, day(i)) for i in (1, 2, 3)])
    assert H.history_search(df, 1, start=day(1), end=day(3)).count() == 3
    assert H.history_search(df, 1, theme_id=0, status="", keyword="").count() == 3
    assert H.history_search(df, 1, theme_id=1).count() == 2
    assert H.history_search(df, 1, keyword="A_B").count() == 3
    assert H.history_search(df, 1, keyword="x").count() == 0


def test_updates_add_up_and_may_set_null(spark):
    df = hist(spark, [(1, 1, "a", 1, "q", "s", 5, 1, day(1)), (2, 1, "b", 1, "q", "s", 6, 1, day(1))])
    changes = spark.createDataFrame(
        [(1, "x", None, day(2), ["status"]), (1, None, None, day(3), ["execution_time_ms"]), (1, "y", 9, day(1), ["status", "execution_time_ms"]), (8, "z", 1, day(4), ["status"])],
        "id long, status string, execution_time_ms long, changed_at timestamp_ntz, supplied array<string>",
    )
    out = H.apply_history_updates(df, changes, ["status", "execution_time_ms"]).select("id", "status", "execution_time_ms", "updated_at")
    assert rows(out) == [(1, "x", None, day(3)), (2, "b", 6, day(1))]
    implied = H.apply_history_updates(df, changes.drop("supplied"), ["status", "execution_time_ms"])
    assert rows(implied.select("id", "status", "execution_time_ms"))[0] == (1, "x", 9)


def test_both_words_for_a_state(spark):
    df = hist(spark, [(1, 1, "success", 1, "q", "s", 4, 1, day(1)), (2, 1, "completed", 1, "q", "s", 6, 1, day(1)), (3, 1, "running", 1, "q", "s", 5, 1, day(1))])
    assert rows(H.query_statistics(df)) == [(3, 2, 0, 0.666667, 5.0, 3)]
    assert H.history_search(df, status="completed").count() == 2
    assert H.history_search(df, status="processing").count() == 1
    assert rows(H.active_tasks(df)) == [(1,)]


def test_changes_at_the_same_moment_do_not_depend_on_partitions(spark):
    changes = spark.createDataFrame([(1, v, 1) for v in "bca"], "id int, name string, step int")
    for n in (1, 3, 7):
        out = H.latest_supplied(changes.repartition(n), ["id"], ["name"], "step").first()
        assert out.name.v == "c"


def test_delete_only_own_rows(spark):
    df = hist(spark, [(1, 1, "a", 1, "q", "s", 5, 1, day(1)), (2, 2, "b", 1, "q", "s", 6, 1, day(1))])
    fav = spark.createDataFrame([(1, 1), (2, 1), (2, 2)], "user_id long, history_id long")
    ids = spark.createDataFrame([(1,), (2,), (1,)], "id long")
    kept, kept_fav, count = H.delete_history(df, fav, ids, 1)
    assert [r.id for r in kept.collect()] == [2]
    assert rows(kept_fav) == [(2, 2)]
    assert rows(count) == [(1,)]


def test_add_favorites(spark):
    new = spark.createDataFrame([(1, 1, "b"), (1, 1, "a"), (1, 2, "c")], "user_id long, history_id long, favorite_name string")
    old = new.filter("history_id = 2")
    assert rows(H.add_favorites(new, old, F.col("favorite_name"))) == [(1, 1, "a")]


def test_expiry_is_strict(spark):
    df = hist(spark, [(1, 1, "failed", 1, "q", "s", 5, 1, day(1)), (2, 1, "failed", 1, "q", "s", 5, 1, day(2)), (3, 1, None, 1, "q", "s", 5, 1, day(1)),
                      (4, 1, "pending", 1, "q", "s", 5, 1, day(1)), (5, 1, "completed", 1, "q", "s", 5, 1, day(3))])
    assert [r.id for r in H.expire_tasks(df).orderBy("id").collect()] == [2, 3, 4, 5]


def test_upsert_adds_new_keys(spark):
    base = spark.createDataFrame([(1, "a", "x")], "id int, name string, note string")
    changes = spark.createDataFrame([(1, "b", 1), (2, "n", 1)], "id int, name string, step int")
    assert rows(C.upsert_metadata(base, changes, "id", "step")) == [(1, "b", "x"), (2, "n", None)]


def test_cardinality_kinds(spark):
    a = spark.createDataFrame([(1,), (2,), (None,), (None,)], "k int")
    b = spark.createDataFrame([(1,), (1,)], "k int")
    kinds = [C.relation_cardinality(x, "k", y, "k").first().observed for x, y in ((a, a), (a, b), (b, a), (b, b))]
    assert kinds == ["one_to_one", "one_to_many", "many_to_one", "many_to_many"]


def test_profile_counts(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, None), (2, "bcd", None)], "n int, s string, e double")
    exact = {r.column_name: (r.row_count, r.distinct_count, r.null_count, r.min_value, r.max_value, r.max_length, r.is_numeric) for r in C.profile_columns(df, exact=df.columns).collect()}
    assert exact == {"n": (3, 2, 0, "1", "2", None, True), "s": (3, 2, 1, "a", "bcd", 3, False), "e": (3, 0, 3, None, None, None, True)}
    empty = C.profile_columns(df.limit(0)).collect()
    assert [(r.row_count, r.distinct_count) for r in empty] == [(0, 0)] * 3
    many = C.profile_columns(spark.range(20_000)).first()
    assert abs(many.distinct_count - 20_000) < 2_000 and many.row_count == 20_000


def test_approximate_daily_users(spark):
    df = spark.range(30_000).select(F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"), F.expr("IF(id % 3 = 0, 7, id)").alias("user_id"))
    exact = R.daily_active_users(df).first().active_users
    rough = R.daily_active_users(df, approximate=True).first().active_users
    assert exact == 20_000 and abs(rough - exact) < 0.1 * exact


def test_permission_wildcards(spark):
    held = {1: ["a:b:c"], 2: ["a:*"], 3: ["a:b:*"], 4: ["*"], 5: [], 6: [], 7: ["b:*"], 8: ["a:b:c", "b:*"]}
    users = spark.createDataFrame([(u, u == 5, True) for u in held], "user_id int, is_superuser boolean, is_active boolean")
    codes = sorted({c for cs in held.values() for c in cs})
    permissions = spark.createDataFrame(list(enumerate(codes)), "permission_id int, permission_code string")
    links = [(u, codes.index(c)) for u, cs in held.items() for c in cs]
    user_role = spark.createDataFrame([(u, 100 * u + p) for u, p in links], "user_id int, role_id int")
    role_permission = spark.createDataFrame([(100 * u + p, p) for u, p in links], "role_id int, permission_id int")

    def allowed(required):
        out = A.check_permissions(users, user_role, role_permission, permissions, required)
        assert "collect_" not in out._jdf.queryExecution().executedPlan().toString()
        return {r.user_id for r in out.collect() if r.allowed}

    assert allowed(["a:b:c"]) == {1, 2, 3, 4, 5, 8}
    assert allowed(["a:b:c", "b:x"]) == {4, 5, 8}
    assert allowed([]) == set(held)


def test_grants_by_union_and_intersection(spark):
    user_role = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 1), (3, 3)], "user_id int, role_id int")
    role_permission = spark.createDataFrame([(1, 10), (2, 10), (1, 11), (1, 11)], "role_id int, permission_id int")
    assert rows(A.effective_grants(user_role, role_permission)) == [(1, 10), (1, 11), (2, 10), (2, 11)]
    assert rows(A.effective_grants(user_role, role_permission, "intersection")) == [(1, 10), (2, 10), (2, 11)]


def test_replace_links_clears_and_sets(spark):
    links = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "user_id int, role_id int")
    new = spark.createDataFrame([(1, 3), (1, 3), (2, None)], "user_id int, role_id int")
    assert rows(A.replace_links(links, "user_id", new)) == [(1, 3)]
