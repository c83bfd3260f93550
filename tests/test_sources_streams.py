import json

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quern.session import shared_dir
from quern.sources import exports as X
from quern.sources.tables import read_json_column, read_table
from quern.streaming import streams as H


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_csv_cells_are_quoted_and_capped(spark):
    df = spark.createDataFrame([(2, 'say "hi", ok', 1.5), (1, None, 2.0), (3, "", None)], "id int, s string, v double")
    path = shared_dir(spark, "csv")
    report = X.export_csv(df, path, max_rows=2, order=["id"]).first()
    assert (report.total, report.exported, report.truncated) == (3, 2, True)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert lines == ['"id","s","v"', '"1","","2"', '"2","say ""hi"", ok","1.5"']


def test_json_export(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "id int, s string")
    path = shared_dir(spark, "json")
    about = X.export_json(df, path, 7).first()
    assert about.columns == ["id", "s"] and about.metadata.total_count == 2 and about.metadata.execution_time_ms == 7
    assert [json.loads(r.value) for r in spark.read.text(f"{path}/rows").orderBy("value").collect()] == [{"id": 1, "s": None}, {"id": 2, "s": "x"}]


def test_json_column(spark):
    df = spark.createDataFrame([('["a","b"]',), ("broken",), (None,)], "j string")
    assert [r.j for r in read_json_column(df, "j", "array<string>").collect()] == [["a", "b"], None, None]


def test_import_sets_bad_rows_aside(spark):
    path = shared_dir(spark, "import")
    lines = ["table_id,field_name_cn,field_name_en,field_type,desensitization_type", "1,a,b,string,mask", "x,a,b,string,none", "2,a,,string,none", "3,a,b,blob,none", "4,a,b,date,", "5,a"]
    spark.createDataFrame([(l,) for l in lines], "value string").coalesce(1).write.text(path)
    good, bad = X.import_metadata(spark, path, "field")
    assert [r.table_id for r in good.orderBy("table_id").collect()] == [1, 4]
    assert sorted(r.reason for r in bad.collect()) == ["bad field_type", "malformed", "malformed", "missing field_name_en"]


@pytest.fixture(scope="module")
def parts(spark, sf_dir):
    """The events in six files, in time order."""
    path = shared_dir(spark, "events")
    events = read_table(spark, sf_dir, "events").orderBy("ts")
    for day in range(0, 30, 5):
        chunk = events.filter((F.dayofmonth("ts") > day) & (F.dayofmonth("ts") <= day + 5))
        chunk.coalesce(1).write.mode("append").parquet(path)
    return path, events


def messages(df):
    return df.select(F.col("user_id").alias("task_id"), "ts", F.expr("IF(event_type = 'error', 'failed', 'running')").alias("status"))


def drain(spark, source, build, mode, out, schema):
    stream = build(H.read_stream(spark, source, schema, max_files=1))
    H.start_batches(stream, f"{out}/data", f"{out}/checkpoint", mode).awaitTermination()
    return H.read_batches(spark, f"{out}/data", stream.schema)


def test_task_state_over_many_batches_equals_batch(spark, parts):
    path, events = parts
    build = lambda s: H.stream_task_state(messages(s))
    out = shared_dir(spark, "state")
    got = H.latest_of_batches(drain(spark, path, build, "update", out, events.schema), "task_id")
    batch = messages(events).groupBy("task_id").agg(F.max("ts").alias("ts"), F.max_by("status", "ts").alias("status"))
    assert rows(got.select(batch.columns)) == rows(batch)
    # starting again with the same checkpoint finds nothing new and changes nothing
    again = H.latest_of_batches(drain(spark, path, build, "update", out, events.schema), "task_id")
    assert rows(again.select(batch.columns)) == rows(batch)


def test_query_stats_close_windows_once(spark, parts):
    path, events = parts
    build = lambda s: H.stream_query_stats(
        s.select(F.expr("IF(event_type = 'view', 'completed', 'failed')").alias("status"), F.col("ts").alias("created_at"))
    )
    got = drain(spark, path, build, "append", shared_dir(spark, "stats"), events.schema)
    hours = got.select("window_start").collect()
    assert len(hours) == len(set(hours))
    closed = events.agg((F.max("ts") - F.expr("INTERVAL 10 MINUTES")).alias("w")).first().w
    batch = (
        events.groupBy(F.date_trunc("hour", "ts").alias("h"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "view").alias("done"))
        .filter(F.col("h") + F.expr("INTERVAL 1 HOUR") <= F.lit(closed).cast("timestamp_ntz"))
    )
    assert rows(got.select(F.col("window_start").cast("string"), "total", "completed")) == rows(
        batch.select(F.col("h").cast("string"), "n", "done")
    )


def test_metadata_sync_over_many_batches(spark, parts):
    path, events = parts
    out = shared_dir(spark, "sync")
    base = spark.range(5).select(F.col("id").alias("doc_id"), F.lit("old").alias("source"), F.lit("2020-01-01 00:00:00").cast("timestamp_ntz").alias("updated_at"))
    changes = lambda s: s.select(F.expr("user_id % 9 + 2").alias("doc_id"), F.col("event_type").alias("source"), F.col("ts").alias("updated_at"))
    stream = changes(H.read_stream(spark, path, events.schema, max_files=1))
    H.start_metadata_sync(stream, f"{out}/data", f"{out}/checkpoint").awaitTermination()
    got = H.synced_documents(base, H.read_batches(spark, f"{out}/data", stream.schema))
    newest = changes(events).groupBy("doc_id").agg(F.max_by("source", "updated_at").alias("source"), F.max("updated_at").alias("updated_at"))
    expected = base.join(newest, "doc_id", "left_anti").unionByName(newest)
    assert rows(got) == rows(expected)


def test_metadata_sync_out_of_time_order(spark):
    """A change that comes later but is older does not win; compacting the log changes nothing."""
    path, out = shared_dir(spark, "late"), shared_dir(spark, "late-out")
    schema = "doc_id long, source string, updated_at timestamp_ntz"
    for day, name in ((3, "c"), (1, "a"), (2, "b")):
        change = spark.sql(f"SELECT 1L AS doc_id, '{name}' AS source, TIMESTAMP_NTZ'2024-01-0{day} 00:00:00' AS updated_at")
        change.coalesce(1).write.mode("append").parquet(path)
        changes = H.read_stream(spark, path, change.schema)
        H.start_metadata_sync(changes, f"{out}/data", f"{out}/checkpoint").awaitTermination()
    base = spark.createDataFrame([(1, "old", datetime(2020, 1, 1)), (2, "kept", datetime(2020, 1, 1))], schema)
    log = H.read_batches(spark, f"{out}/data", base.schema)
    assert log.count() == 3
    assert {(r.doc_id, r.source) for r in H.synced_documents(base, log).collect()} == {(1, "c"), (2, "kept")}
    assert {(r.doc_id, r.source) for r in H.compact(base, log, f"{out}/base").collect()} == {(1, "c"), (2, "kept")}


def test_capped_export_needs_an_order(spark):
    with pytest.raises(ValueError):
        X.export_csv(spark.range(3), shared_dir(spark, "csv"), max_rows=2)
    whole = X.export_csv(spark.range(30), shared_dir(spark, "csv")).first()
    assert (whole.total, whole.exported, whole.truncated) == (30, 30, False)


def test_a_file_whose_name_holds_pattern_characters(spark, tmp_path):
    spark.range(7).coalesce(1).write.parquet(f"{tmp_path}/x")
    part = next(tmp_path.glob("x/part-*.parquet"))
    odd = tmp_path / "x" / "a[1]{b}.parquet"
    odd.write_bytes(part.read_bytes())
    stream = H.read_stream(spark, str(odd), spark.range(1).schema)
    out = shared_dir(spark, "odd")
    H.start_batches(stream, f"{out}/data", f"{out}/checkpoint", "append").awaitTermination()
    assert H.read_batches(spark, f"{out}/data", stream.schema).count() == 7


def test_timeouts_over_many_batches(spark, parts):
    path, events = parts
    build = lambda s: H.stream_task_timeout(messages(s), gap="60 minutes")
    got = drain(spark, path, build, "append", shared_dir(spark, "timeout"), events.schema)
    assert {r.last_status for r in got.select("last_status").distinct().collect()} == {"running"}
    keys = [(r.task_id, r.last_seen) for r in got.collect()]
    assert len(keys) == len(set(keys)) and keys
