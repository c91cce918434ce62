"""The registered queries of the corpus operators, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracespark.llm.collocations import collocations
from tracespark.llm.decontamination import contamination
from tracespark.llm.lexical_search import ranked
from tracespark.llm.licenses import license_scan
from tracespark.llm.line_dedup import line_dedup
from tracespark.llm.multiset_hash import paired_fingerprints
from tracespark.llm.sentencepiece_codec import encoded
from tracespark.llm.sharding import byte_shards
from tracespark.llm.simhash import near_groups
from tracespark.llm.sql import SQL  # noqa: F401
from tracespark.llm.suffix_dedup import without_repeats
from tracespark.llm.token_counts import corpus_counts
from tracespark.llm.toxicity import toxicity
from tracespark.llm.url_filters import judged

#: Folder of public tokenizer files.
TOKENIZERS = "/opt/tokenizers"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_shards(docs, 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = without_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(_table(spark, sf_dir, "pages"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return encoded(docs, f"{TOKENIZERS}/piece_bpe_32k.model").select("doc_id", "n_tokens", "ids", "round_trip")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_counts(_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired_fingerprints(_table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).withColumnRenamed("item", "item_id")


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_licenses": op2_licenses,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_url_filters": op4_url_filters,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_token_counts": op6_token_counts,
    "op7_toxicity": op7_toxicity,
    "op8_simhash": op8_simhash,
    "op9_decontamination": op9_decontamination,
    "op10_fingerprints": op10_fingerprints,
    "op11_line_dedup": op11_line_dedup,
    "op12_collocations": op12_collocations,
    "op13_lexical_search": op13_lexical_search,
}

