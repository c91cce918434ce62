"""Corpus cleaning: the stages that turn raw documents into token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracespark.llm.common import dropped, stored
from tracespark.llm.decontamination import benchmark_hits
from tracespark.llm.sentencepiece_codec import encoded
from tracespark.llm.simhash import first_of_groups
from tracespark.llm.suffix_dedup import without_repeats
from tracespark.llm.toxicity import fit, scored

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns in one struct, so that none clashes with what an
    operator adds."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", *([F.struct(*rest).alias("rest")] if rest else []))


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that ``packed`` has put together, in their order."""
    return df.select(*[F.col(c if c in ("doc_id", "text") else f"rest.`{c}`").alias(c) for c in columns])


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, learned from the labels, does not call toxic.

    Null and empty texts have the score of no match and stay, unless labels teach that
    texts without a match are toxic; texts of any length are read whole; repeated rows each stay
    or go, and rows of equal texts alike; a null doc_id has no label; an empty table gives no
    rows; all columns stay, whatever their names.
    """
    grammar = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return unpacked(scored(packed(docs), grammar).where("score < 0.5"), docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest doc_id.

    Null and empty texts are one group; of repeated rows one stays, rows of one id and
    different texts are different documents, and a null doc_id stays only where its group
    has no other; texts of any length are compared whole; an empty table gives no rows; all
    columns stay, whatever their names.
    """
    return first_of_groups(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of repeated 200-byte windows; texts that nothing is left
    of go, all others stay.

    Null and empty texts have no windows and stay as they are, as do texts shorter than a
    window; repeated rows of a window's length repeat each other; null ids are ids; an
    empty table gives no rows. n_chars, where it is a column, is counted anew for texts
    that were cut; all other columns stay, whatever their names.
    """
    cut = without_repeats(packed(docs), as_text=True).where("n_removed = 0 or trim(kept) <> ''")
    own = F.col("n_removed") > 0
    new = {"text": F.when(own, F.col("kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(own, F.char_length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("rest.n_chars"))
    return cut.select(*[new.get(c, F.col(c if c == "doc_id" else f"rest.`{c}`")).alias(c) for c in docs.columns])


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no passage of the benchmark occurs.

    Null and empty texts have no words and stay; texts of any length are searched whole;
    repeated rows each stay or go; an empty benchmark lets all stay; an empty table gives no rows; all columns stay, whatever
    their names.
    """
    hits = benchmark_hits(packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return unpacked(hits.where("size(items) = 0"), docs.columns)


def as_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the texts: ids, n_tokens, and round_trip (whether the decoder
    gives the text again).

    Null and empty texts have no ids; texts of any length are encoded whole; repeated rows each
    get theirs, and equal texts equal ids; an empty table gives no rows. Of columns of these three names the stage's own stay, all others stay.
    """
    added = ["ids", "n_tokens", "round_trip"]
    kept = [c for c in docs.columns if c != "text" and c not in added]
    return encoded(packed(docs), MODEL).select(
        *[F.col(c if c == "doc_id" else f"rest.`{c}`").alias(c) for c in kept], *added)


STAGES = [
    ("toxicity", without_toxic),
    ("simhash near-dedup", without_near_copies),
    ("suffix-array dedup", without_repeated_passages),
    ("benchmark decontamination", without_benchmarks),
    ("sentencepiece", as_token_ids),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what the one before has written, which
    is deleted when the next one's is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name.replace(" ", "-"))
            if k:
                dropped(before)
    return docs
