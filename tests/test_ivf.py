import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import retrieval as V
from quern.session import shared_dir


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_recall_against_exact(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    items = vectors.withColumnRenamed("vec_id", "item_id")
    centres = V.fit_centres(items)
    index = V.build_ivf(items, shared_dir(spark, "ivf-test"), centres)
    assert index.count() == V.unusable(items).filter("usable AND item_id IS NOT NULL").count()  # every row is indexed
    probes = V.calibrate_probes(items, index, centres, 5)
    assert probes <= len(centres)
    asked = vectors.filter(F.col("vec_id") % 50 == 0).withColumnRenamed("vec_id", "query_id")
    found = V.search_ivf(asked, index, centres, 5, probes)
    exact = V.similar_items(asked, items, 5)
    assert V.recall(found, exact) >= 0.9
    assert found.groupBy("query_id").count().filter("count <> 5").count() == 0


def test_odd_vectors_and_small_tables(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)]
    rows += [(100, None), (101, [0.0, 0.0, 0.0, 0.0]), (102, [1.0, float("nan"), 0.0, 0.0]), (103, [1.0, 2.0]), (None, [1.0, 0.0, 0.0, 0.0])]
    items = spark.createDataFrame(rows, "item_id long, embedding array<double>")
    centres = V.fit_centres(items, lists=6)
    index = V.build_ivf(items, shared_dir(spark, "ivf-odd"), centres)
    asked = items.filter("item_id < 10").withColumnRenamed("item_id", "query_id")
    found = V.search_ivf(asked, index, centres, 3, probes=6)  # all lists: exact
    exact = V.similar_items(asked, items, 3)
    assert V.recall(found, exact) == 1.0
    empty = V.fit_centres(items.limit(0))
    assert empty.shape[0] == 0
