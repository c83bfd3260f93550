"""The registered queries of the training-data operators, with SQL where it can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import encoding, html_text, licences, minhash, mixing, phrases, pii, quality, search, sharding, substrings, suffixes, vectors
from quern.llm.common import read
from quern.session import prepare, ship_package

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

TOKENIZER_FILE = "/opt/tokenizers/word_bpe_49k.json"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(prepare(spark))
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql.strip()
        return run

    return register


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(read(spark, sf_dir, "documents"), keep_text=True)
    # the remaining bytes as text; a character that lost some of its bytes shows as U+FFFD, the digest is of the bytes
    return found.withColumn("kept_text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")


@query("op2_html_text")
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = html_text.Model.trained(html_text.labelled_pages())
    found = html_text.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"), model)
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op3_bpe_encode")
def op3_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode(read(spark, sf_dir, "documents"), TOKENIZER_FILE, digests=True)


@query("op4_embedding_dedup", sql=vectors.oracle())
def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.link_vectors(read(spark, sf_dir, "embeddings"))


@query("op5_pii")
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_pii(docs, spans_col="found").select("doc_id", "found")
    label = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("found", lambda s: s["kind"].isin(*pii.BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(kind) for kind in pii.BASE],
        F.sha2(F.array_join(F.transform(base, label), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("found", label), ",").alias("spans"),
    )


@query("op6_licence_scan", sql=licences.oracle())
def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(read(spark, sf_dir, "documents"))


@query("op7_minhash_dedup", sql=minhash.oracle())
def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


@query("op8_quality_rules", sql=quality.oracle())
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_metrics(read(spark, sf_dir, "documents"))


@query("op9_mix_sources")
def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    decided = mixing.mix(docs)
    rows = docs.select("doc_id", "source", mixing.doc_key("doc_id", "text").alias("doc")).alias("d")
    same = F.col("d.source").eqNullSafe(F.col("m.source")) & (F.col("d.doc") == F.col("m.doc"))
    return rows.join(decided.alias("m"), same).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken")
    )


@query("op10_shard")
def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"))


@query("op11_lexical_search", sql=search.oracle())
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op12_substring_dedup", sql=substrings.oracle())
def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeated_windows(read(spark, sf_dir, "documents"))


@query("op13_phrase_mining", sql=phrases.oracle())
def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))
