"""Named queries and, where SQL can state them, their checking text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.plans.views import with_views
from quern.session import prepare

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query; ``views`` are put before ``sql`` as common table expressions."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            text = sql.strip()
            if views:
                prefix = with_views(*views)
                text = prefix.rstrip() + (",\n" + text[5:] if text[:5].upper() == "WITH " else "\n" + text)
            ORACLE[name] = text
        return run

    return register
