from collections import Counter

from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from quern.llm import pii, quality
from quern.llm.queries import ORACLE, QUERIES, TOKENIZER_FILE
from tests.llm.test_minhash import brute_groups
from tests.llm.test_quality import brute as brute_quality
from tests.oracle import connect, difference, duck_rows, spark_rows


def test_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_sql(spark, sf_dir):
    con = connect(sf_dir)
    for name, sql in ORACLE.items():
        assert difference(spark_rows(QUERIES[name](spark, sf_dir)), duck_rows(con, sql)) is None, name


def test_stages(spark, docs, rows):
    """Each stage against plain Python on what the stage before it kept."""
    stages = dict(corpus_pipeline.STAGES)
    columns = docs.columns
    good = stages["quality rules"](spark, docs, "").cache()
    assert good.columns == columns
    judged = quality.quality_metrics(docs).collect()
    assert good.count() == sum(r.kept for r in judged) and all(not brute_quality(r.text)[5] for r in good.collect())
    left = [(r.doc_id, r.text) for r in good.collect()]
    one = stages["minhash near-dedup"](spark, good, "").cache()
    assert one.columns == columns and one.count() == len(set(brute_groups(left)))
    assert {r.doc_id for r in one.collect()} == set(brute_groups(left))
    told = one.withColumn("text", F.concat("text", F.lit(" a@b.cd")))
    clean = stages["personal data"](spark, told, "")
    assert clean.columns == columns
    assert Counter((r.text, r.n_chars) for r in clean.collect()) == Counter(
        (x, len(x)) for x in (pii.redact(r.text, pii.find_spans(r.text)) for r in told.collect())
    )
    mixed = stages["source mix"](spark, one, "").cache()
    assert mixed.columns == columns and max(Counter(r.doc_id for r in mixed.collect()).values()) <= 3
    library = Tokenizer.from_file(TOKENIZER_FILE)
    ids = stages["bpe encoding"](spark, mixed, "").collect()
    want = Counter((r.doc_id, tuple(library.encode(r.text, add_special_tokens=False).ids)) for r in mixed.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in ids) == want


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "lang", "source", "ids", "n_tokens"] and out.count() > 0
