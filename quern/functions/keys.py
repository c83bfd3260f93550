"""Keys for semi, anti and outer joins when one key may hold a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame


def keys_of(df: DataFrame, *cols: str | Column) -> DataFrame:
    """Distinct keys for the right side of a semi or anti join.

    A key that repeats leaves each map task once instead of filling one
    reducer, and the result is already partitioned for the join.
    """
    return df.select(*cols).distinct()


def keep_all(kept: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Outer join that keeps every row of ``kept``, for an ``other`` side with hot keys.

    Spark splits hot keys of both sides in inner joins but only of the kept
    side in outer joins. So matches come from an inner join, and rows without
    a match from an anti join against distinct keys.
    """
    matched = kept.join(other, list(on))
    alone = kept.join(keys_of(other, *on), list(on), "left_anti")
    return matched.unionByName(alone, allowMissingColumns=True)
