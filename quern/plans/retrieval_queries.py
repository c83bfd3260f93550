"""Queries on retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import retrieval as V
from quern.plans.registry import query
from quern.session import shared_dir
from quern.sources.tables import read_table

# the first vector of every label asks, all vectors answer
_KNN = """
    SELECT query_id, item_id, similarity, rank FROM (
      SELECT query_id, item_id, similarity,
             row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS rank
      FROM (SELECT q.vec_id AS query_id, i.vec_id AS item_id,
                   round(list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 6) AS similarity
            FROM (SELECT min(vec_id) AS vec_id, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label) q,
                 embeddings i {where}))
    WHERE rank <= 5
"""


def _sides(spark, d):
    vectors = read_table(spark, d, "embeddings")
    asked = vectors.groupBy("label").agg(
        F.min("vec_id").alias("query_id"), F.min_by("embedding", "vec_id").alias("embedding")
    )
    return asked, vectors.withColumnRenamed("vec_id", "item_id")


@query("f01_similar_items", _KNN.format(where=""))
def _similar(spark, d):
    asked, items = _sides(spark, d)
    return V.similar_items(asked, items, 5)


@query("f01_similar_items_blocks", _KNN.format(where=""))
def _similar_blocks(spark, d):
    """The first vector of every label asks, in questions of another order and name."""
    asked, items = _sides(spark, d)
    return V.similar_items(asked.orderBy(F.desc("query_id")), items, 5)


@query(
    "f01_similar_items_all",
    _KNN.format(where="").replace(
        "SELECT min(vec_id) AS vec_id, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label",
        "SELECT vec_id, embedding FROM embeddings",
    ),
)
def _similar_all(spark, d):
    """Every vector asks."""
    vectors = read_table(spark, d, "embeddings")
    return V.similar_items(vectors.withColumnRenamed("vec_id", "query_id"), vectors.withColumnRenamed("vec_id", "item_id"), 5)


@query("f01_similar_items_indexed")
def _similar_indexed(spark, d):
    """Every vector whose id is divisible by 50 asks the inverted-file index; all vectors are indexed.

    Approximate by design, so no checking SQL: recall against the exact
    query is tested (at least 0.9).
    """
    vectors = read_table(spark, d, "embeddings")
    items = vectors.withColumnRenamed("vec_id", "item_id")
    centres = V.fit_centres(items)
    index = V.build_ivf(items, shared_dir(spark, "ivf"), centres)
    probes = V.calibrate_probes(items, index, centres, 5)
    asked = vectors.filter(F.col("vec_id") % 50 == 0).withColumnRenamed("vec_id", "query_id")
    return V.search_ivf(asked, index, centres, 5, probes)


@query("f02_similar_allowed", _KNN.format(where="WHERE i.label IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)"))
def _allowed(spark, d):
    asked, items = _sides(spark, d)
    labels = read_table(spark, d, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("label"))
    allowed = items.join(labels, "label", "left_semi").select("item_id")
    return V.similar_allowed(asked, items, allowed, 5)


@query(
    "f03_replace_documents",
    """
    SELECT doc_id, source, n_chars, md5(text) AS text_hash FROM documents d
    WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
    UNION ALL
    SELECT doc_id, 'new', n_chars, md5(upper(source) || text) FROM documents JOIN labels USING (doc_id)
    """,
)
def _replace(spark, d):
    store = read_table(spark, d, "documents").select("doc_id", "source", "n_chars", "text")
    labels = read_table(spark, d, "labels").select("doc_id")
    changed = store.join(labels, "doc_id").select(
        "doc_id", F.lit("new").alias("source"), "n_chars", F.concat(F.upper("source"), "text").alias("text")
    )
    return V.replace_documents(store, changed).select("doc_id", "source", "n_chars", F.md5("text").alias("text_hash"))
