"""Writing results and metadata as CSV or JSON, and reading metadata files back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quern.functions import fixed
from quern.functions.columns import cell_text
from quern.functions.keys import keys_of

CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"'}


def _first(df: DataFrame, max_rows: int | None, order: Sequence[str | Column]) -> DataFrame:
    if max_rows is not None and not order:
        raise ValueError("a capped export needs an order that ends in a unique key")
    ordered = df.orderBy(*order) if order else df
    return ordered if max_rows is None else ordered.limit(max_rows)


def _counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    """The rows, counted while they are written, so that the input is computed once."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("total")), seen


def export_csv(
    df: DataFrame, path: str, max_rows: int | None = None, order: Sequence[str | Column] = ()
) -> DataFrame:
    """Write rows as CSV, every cell quoted and quotes doubled; all of them, unless ``max_rows`` keeps the first of an order.

    NULL becomes an empty cell. Returns one row: path, total, exported, truncated.
    """
    texts = [
        F.when(F.col(f.name).isNotNull(), cell_text(F.col(f.name), f.dataType)).alias(f.name) for f in df.schema.fields
    ]
    rows, seen = _counted(df)
    _first(rows, max_rows, order).select(*texts).write.options(**CSV_OPTIONS, quoteAll="true", emptyValue="").csv(path)
    total = seen.get["total"]
    exported = total if max_rows is None else min(total, max_rows)
    return df.sparkSession.createDataFrame(
        [(path, total, exported, total > exported)], "path string, total long, exported long, truncated boolean"
    )


def export_json(
    df: DataFrame, path: str, execution_time_ms: int = 0, order: Sequence[str | Column] = (), max_rows: int | None = None
) -> DataFrame:
    """Rows as one JSON object per line below ``rows``; columns and figures in one line below ``metadata``."""
    rows, seen = _counted(df)
    _first(rows, max_rows, order).write.option("ignoreNullFields", "false").json(f"{path}/rows")
    about = df.sparkSession.range(1).select(
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
        F.struct(
            F.lit(seen.get["total"]).cast("long").alias("total_count"),
            F.lit(execution_time_ms).alias("execution_time_ms"),
            F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("exported_at"),
        ).alias("metadata"),
    )
    about.write.json(f"{path}/metadata")
    return df.sparkSession.read.schema(about.schema).json(f"{path}/metadata")


def metadata_of_themes(
    tables: DataFrame, fields: DataFrame, links: DataFrame, theme_ids: Sequence[int]
) -> tuple[DataFrame, DataFrame]:
    """Tables and fields that belong to the listed themes."""
    wanted = keys_of(links.filter(F.col("theme_id").isin(*theme_ids)), "table_id")
    kept = tables.join(wanted, "table_id", "left_semi").select(*tables.columns)
    return kept, fields.join(kept.select("table_id"), "table_id", "left_semi").select(*fields.columns)


def export_metadata(
    tables: DataFrame, fields: DataFrame, links: DataFrame, theme_ids: Sequence[int], path: str, fmt: str = "csv"
) -> None:
    """Write the metadata of the themes, all of it, below ``tables`` and ``fields``."""
    write = {"csv": export_csv, "json": export_json}[fmt]
    for name, frame in zip(("tables", "fields"), metadata_of_themes(tables, fields, links, theme_ids)):
        write(frame, f"{path}/{name}")


# columns, required columns and value domains of import files
IMPORTS = {
    "table": (
        "table_name_cn string, table_name_en string, data_source string, update_method string",
        ("table_name_cn", "table_name_en"),
        {"update_method": fixed.UPDATE_METHODS},
    ),
    "field": (
        "table_id long, field_name_cn string, field_name_en string, field_type string, desensitization_type string",
        ("table_id", "field_name_cn", "field_name_en", "field_type"),
        {"field_type": fixed.FIELD_TYPES, "desensitization_type": fixed.MASKING_KINDS},
    ),
    "glossary": (
        "term_name string, term_description string, term_type string",
        ("term_name",),
        {"term_type": fixed.TERM_TYPES},
    ),
}
CORRUPT = "_corrupt_record"


def import_metadata(
    spark: SparkSession, path: str, kind: str, options: dict[str, str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rows that may be stored, and rows set aside with the first reason found.

    The schema is fixed, so no pass infers it; lines with missing or
    unreadable cells are kept as text.
    """
    schema, required, domains = IMPORTS[kind]
    rows = (
        spark.read.schema(f"{schema}, {CORRUPT} string")
        .options(**(options or CSV_OPTIONS), mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, columnPruning="false")
        .csv(path)
    )
    reasons = [F.when(F.col(CORRUPT).isNotNull(), F.lit("malformed"))]
    reasons += [F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.lit(f"missing {c}")) for c in required]
    reasons += [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*values), F.lit(f"bad {c}")) for c, values in domains.items()]
    checked = rows.withColumn("reason", F.coalesce(*reasons))
    good = checked.filter("reason IS NULL").drop(CORRUPT, "reason")
    return good, checked.filter("reason IS NOT NULL")
