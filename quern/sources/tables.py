"""Parquet tables, JSON kept in text columns, and table size figures."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table_path(base_dir: str, name: str) -> str:
    return f"{base_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    """One parquet table with the schema that its files have now."""
    return spark.read.parquet(table_path(base_dir, name))


def read_tables(
    spark: SparkSession, base_dir: str, names: Iterable[str] = TABLES, prefix: str | None = None
) -> dict[str, DataFrame]:
    """Read parquet tables; with a ``prefix`` (may be empty) also register them as temp views."""
    frames = {name: read_table(spark, base_dir, name) for name in names}
    if prefix is not None:
        for name, frame in frames.items():
            frame.createOrReplaceTempView(f"{prefix}{name}")
    return frames


def read_json_column(df: DataFrame, col: str, schema: DataType | str, out: str | None = None) -> DataFrame:
    """Parse JSON text into typed values; text that is not JSON gives NULL."""
    return df.withColumn(out or col, F.from_json(F.col(col), schema))


def json_value(col: str, path: str) -> Column:
    return F.get_json_object(F.col(col), path)


def table_stats(df: DataFrame, table_name: str) -> DataFrame:
    """Rows, bytes on disk and column count of a table read from files.

    Rows are counted per file before the sum; the file's size comes from its
    metadata column, so only row counts from the footers are read.
    """
    per_file = df.groupBy(F.col("_metadata.file_path").alias("file_path")).agg(
        F.count(F.lit(1)).alias("n"), F.max("_metadata.file_size").alias("bytes")
    )
    return per_file.agg(
        F.lit(table_name).alias("table_name"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("size_bytes"),
        F.lit(len(df.columns)).alias("column_count"),
    )
