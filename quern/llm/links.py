"""Connected components of links between keys, by rounds of joins on staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of undirected (a, b) links; root is the component's smallest node.

    Large and small stars take turns: first every node's larger neighbours are
    tied to its smallest one, then its smaller neighbours are. Links never
    grow in number, a hub is reduced to one minimum per task before it is
    shuffled, and the rounds end when nothing changes. Null keys and links of a
    node with itself tie nothing.
    """
    edges = staged(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .filter("u > v")
        .distinct(),
        "links",
    )
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = staged(
            small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u > v").distinct(), "links"
        )
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
