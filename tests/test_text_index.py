import pytest

from quern.operators import results as R
from quern.session import shared_dir

ROWS = [
    (1, "Ærøskøbing café", 10.5, None),
    (2, "100% pure_data", None, "x.*y"),
    (3, "ΣΊΣΥΦΟΣ and sisyphus", 3.0, "ok"),
    (4, "plain text", 100.25, "a"),
    (5, None, None, None),
    (6, "İstanbul", 1.0, "İİİ"),
    (7, "aaaa", 2.0, "aaa"),
]


@pytest.fixture(scope="module")
def table(spark):
    df = spark.createDataFrame(ROWS, "id long, name string, amount double, note string")
    return df, R.build_text_index(df, "id", shared_dir(spark, "text-index-test"))


@pytest.mark.parametrize(
    "text", ["café", "CAFÉ", "% pure", "_data", "x.*", "ΣΊΣ", "σίσ", "null", "aaa", "aa", "a", "", "100.2", "zzz", "stanb", "İst"]
)
def test_same_rows_as_scan(table, text):
    df, index = table
    want = sorted(r.id for r in R.search_rows(df, text).collect())
    got = sorted(r.id for r in R.indexed_search(df, index, "id", text).collect())
    assert got == want


def test_reads_only_needed_buckets(table):
    df, index = table
    plan = R.indexed_search(df, index, "id", "plain")._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.split("\n") if "FileScan parquet [key" in line)
    assert "PartitionFilters: [bucket" in scan and " IN (" in scan.split("PartitionFilters: [bucket")[1]
    assert "PushedFilters: [In(gram" in scan


def test_build_is_cut_by_rows(spark, monkeypatch):
    monkeypatch.setattr(R, "POSTING_ROWS", 20, raising=False)
    df = spark.range(2000).selectExpr("id", "'the same words' AS name").coalesce(1)
    index = R.build_text_index(df, "id", shared_dir(spark, "text-index-cut"))
    per_file = index.groupBy("bucket", "_metadata.file_path").count().collect()
    per_bucket = index.groupBy("bucket").count().collect()
    assert max(r["count"] for r in per_bucket) >= 2000 > 2 * max(r["count"] for r in per_file)  # no task writes a whole bucket
    assert index.groupBy("key", "gram").count().filter("count > 1").isEmpty()
    assert R.indexed_search(df, index, "id", "same w").count() == 2000
