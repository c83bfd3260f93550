"""The corpus pipeline: quality rules, near-dedup, personal data, source mix, encoding.

Each stage takes all rows that its predecessor kept and returns the columns of
``documents``; the last returns token ids. ``spark`` and ``sf_dir`` are there
for stages that need other tables; none of these does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import encoding, minhash, mixing, pii, quality
from quern.llm.common import read, staged
from quern.llm.queries import TOKENIZER_FILE
from quern.session import prepare, ship_package


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that no quality rule rejects."""
    return quality.keep_good(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of equal and near-equal documents the one with the smallest id."""
    return minhash.keep_one(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: personal data replaced by its kind in brackets; n_chars follows the new text."""
    clean = pii.find_pii(docs, spans_col="__spans", redacted_col="text").drop("__spans")
    if "n_chars" in clean.columns:
        clean = clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return clean


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: every document as often as the source weights take it."""
    return mixing.apply_mix(docs, mixing.mix(docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: token ids of every document; repeats stay."""
    ids = encoding.encode(docs, TOKENIZER_FILE, keep=("doc_id", "lang", "source"))
    return ids.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality rules", good_documents),
    ("minhash near-dedup", one_of_each_group),
    ("personal data", without_personal_data),
    ("source mix", mixed_sources),
    ("bpe encoding", encoded),
]

#: Near-dedup, rounding and encoding have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder before the next."""
    ship_package(prepare(spark))
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
