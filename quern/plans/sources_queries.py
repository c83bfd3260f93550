"""Queries that read sources, and that write a sink and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import catalog as C
from quern.plans.registry import query
from quern.plans.views import view
from quern.session import shared_dir
from quern.sources import exports as X
from quern.sources.tables import TABLES, json_value, read_json_column, read_table, read_tables, table_stats


@query(
    "a01_read_tables",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in TABLES),
)
def _read(spark, d):
    counts = [
        df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n")) for name, df in read_tables(spark, d).items()
    ]
    whole = counts[0]
    for one in counts[1:]:
        whole = whole.unionByName(one)
    return whole


@query(
    "a02_read_json_column",
    """
    SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total,
           max(json_extract_string(props, '$.k')) AS top FROM events GROUP BY 1
    """,
)
def _json(spark, d):
    events = read_json_column(read_table(spark, d, "events"), "props", "k long", "parsed")
    return events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("parsed.k").alias("total"), F.max(json_value("props", "$.k")).alias("top")
    )


@query(
    "a03_export_csv",
    """
    SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, '"' || o_orderpriority || '", ok' AS o_orderpriority,
           CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS o_orderstatus,
           regexp_replace(CAST(o_totalprice AS VARCHAR), '\\.0$', '') AS o_totalprice,
           strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate
    FROM orders
    """,
)
def _csv(spark, d):
    orders = read_table(spark, d, "orders").select(
        "o_orderkey", F.expr("""concat('"', o_orderpriority, '", ok')""").alias("o_orderpriority"),
        F.expr("IF(o_orderkey % 3 > 0, o_orderstatus, NULL)").alias("o_orderstatus"), "o_totalprice", "o_orderdate",
    )
    path = shared_dir(spark, "export-csv")
    X.export_csv(orders, path)
    return spark.read.options(**X.CSV_OPTIONS).schema(", ".join(f"{c} string" for c in orders.columns)).csv(path)


@query(
    "a03_export_csv_report",
    "SELECT count(*) AS total, least(count(*), 10000) AS exported, count(*) > 10000 AS truncated FROM events",
)
def _csv_report(spark, d):
    report = X.export_csv(read_table(spark, d, "events"), shared_dir(spark, "export-csv"), max_rows=10_000, order=["event_id"])
    return report.select("total", "exported", "truncated")


@query(
    "a04_export_json",
    "SELECT event_id, user_id, event_type, value, CAST(ts AS VARCHAR) AS ts FROM events",
)
def _json_export(spark, d):
    events = read_table(spark, d, "events").select(
        "event_id", "user_id", "event_type", "value", F.col("ts").cast("string").alias("ts")
    )
    path = shared_dir(spark, "export-json")
    X.export_json(events, path, execution_time_ms=12)
    return spark.read.schema(events.schema).json(f"{path}/rows")


@query(
    "a04_export_json_metadata",
    "SELECT 'event_id,user_id,value' AS columns, count(*) AS total_count, 12 AS execution_time_ms FROM events",
)
def _json_about(spark, d):
    events = read_table(spark, d, "events").select("event_id", "user_id", "value")
    about = X.export_json(events, shared_dir(spark, "export-json"), execution_time_ms=12)
    return about.select(
        F.array_join("columns", ",").alias("columns"), F.col("metadata.total_count").alias("total_count"),
        F.col("metadata.execution_time_ms").alias("execution_time_ms"),
    )


@query(
    "a05_import_metadata",
    """
    SELECT reason, count(*) AS n FROM (
      SELECT CASE WHEN term_id % 10 = 1 THEN 'malformed' WHEN term_id % 10 = 2 THEN 'missing term_name'
                  WHEN term_id % 10 = 3 THEN 'bad term_type' ELSE 'stored' END AS reason FROM glossary) GROUP BY 1
    """,
    views=("glossary",),
)
def _import(spark, d):
    """A glossary file with a short line, an empty name and an unknown kind in every ten lines."""
    line = F.expr(
        """CASE term_id % 10 WHEN 1 THEN concat('"', term_name, '"')
           ELSE concat_ws(',', IF(term_id % 10 = 2, '', concat('"', term_name, '"')), concat('"', term_description, '"'),
                          IF(term_id % 10 = 3, 'nobody', term_type)) END AS value"""
    )
    path = shared_dir(spark, "import")
    view(spark, d, "glossary").select(line).write.text(path)
    # the files carry no header line: every line is a row
    options = {**X.CSV_OPTIONS, "header": "false"}
    good, bad = X.import_metadata(spark, path, "glossary", options)
    return (
        good.select(F.lit("stored").alias("reason"))
        .unionByName(bad.select("reason"))
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "a06_export_metadata",
    """
    SELECT field_id, table_id, field_name_en FROM mfield
    WHERE table_id IN (SELECT table_id FROM table_theme WHERE theme_id IN (1, 4))
    """,
    views=("mfield", "table_theme"),
)
def _export_metadata(spark, d):
    tables, fields, links = (view(spark, d, v) for v in ("mtable", "mfield", "table_theme"))
    path = shared_dir(spark, "export-metadata")
    X.export_metadata(tables, fields, links, [1, 4], path)
    names = ", ".join(f"{c} string" for c in fields.columns)
    back = spark.read.options(**X.CSV_OPTIONS).schema(names).csv(f"{path}/fields")
    return back.select(F.col("field_id").cast("long").alias("field_id"), F.col("table_id").cast("long").alias("table_id"), "field_name_en")


_COMPARED = ("customer", "orders", "lineitem", "part", "events", "embeddings")


@query(
    "a08_schema_diff",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, column_name, 'retyped' AS change FROM (DESCRIBE {t}) "
        "WHERE column_type NOT IN ('BIGINT', 'DOUBLE', 'VARCHAR')"
        for t in _COMPARED
    )
    + " UNION ALL SELECT 'orders', 'o_orderpriority', 'added' UNION ALL SELECT 'orders', 'o_comment', 'removed'",
)
def _schema_diff(spark, d):
    """Live column types against those that the rows suggest once they have been exported as JSON and read back."""
    tables = read_tables(spark, d, _COMPARED)
    stored = {}
    for name, df in tables.items():
        if name == "orders":
            df = df.drop("o_orderpriority").withColumn("o_comment", F.lit("x"))
        path = shared_dir(spark, f"schema-{name}")
        X.export_json(df, path)
        stored[name] = spark.read.json(f"{path}/rows")
    return C.schema_diff(C.live_schema(tables), C.live_schema(stored)).select("table_name", "column_name", "change")


@query(
    "d22_table_stats",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS row_count, (SELECT count(*) FROM (DESCRIBE {t})) AS column_count, "
        f"count(*) > 0 AS has_bytes FROM {t}"
        for t in ("orders", "lineitem", "events")
    ),
)
def _table_stats(spark, d):
    """File sizes are not visible to SQL: only that there are bytes is checked."""
    stats = [table_stats(df, name) for name, df in read_tables(spark, d, ("orders", "lineitem", "events")).items()]
    whole = stats[0].unionByName(stats[1]).unionByName(stats[2])
    return whole.select(
        "table_name", "row_count", F.col("column_count").cast("long").alias("column_count"), (F.col("size_bytes") > 0).alias("has_bytes")
    )
