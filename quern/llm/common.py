"""Staging in the shared folder, global row numbers and column helpers for the training-data operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.session import shared_dir

#: White space of the word rule ``[^\x20\x09-\x0D]+``.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path in the folder that driver and executors share, deleted when the application ends."""
    return shared_dir(spark, purpose)


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here, lost executors cost nothing made before."""
    path = shared_path(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session: the one size that users set to their data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def global_row_number(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """Number all rows from 0 in an order without sending them to one task.

    Rows are dealt by ranges and numbered per partition; the offsets come from
    one count per partition. The order should be total: equal rows are
    numbered in any order.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = staged(
        dealt.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at")), "rank"
    )
    per_part = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        "__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__offset")
    )
    return dealt.join(offsets, "__part").withColumn(name, F.col("__at") + F.col("__offset")).drop(
        "__part", "__at", "__offset"
    )


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*cols: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the columns and the seed only."""
    return F.shiftrightunsigned(F.xxhash64(*cols, F.lit(seed)), 11).cast("double") * F.lit(2.0**-53)
