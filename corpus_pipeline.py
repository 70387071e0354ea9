"""A training corpus from documents: STAGES in order, each written as Parquet and read again as the next one's documents.

When a stage begins, the output of the one before is written, so the tables that the pipeline worked with until then are deleted; tables of
other callers stay. Every stage takes nulls in any column, repeated rows, empty and very long texts, extra columns of any name, and an
empty table, for which it gives no rows. All stages but the last return the columns that they get.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netloom.llm import _words
from netloom.llm._shared import fresh_path, owned, release, sweep, tune
from netloom.llm.bpe import bpe_round_trip
from netloom.llm.ngram_join import keep_one
from netloom.llm.quality_rules import keep_good
from netloom.llm.source_mixing import mixed
from netloom.llm.suffix_dedup import remove_repeats

OWNER = "pipeline"


def begin(spark: SparkSession) -> None:
    sweep(spark, OWNER)
    tune(spark)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised quality rules keep. Null and empty texts fail the base limits and go; of repeated rows all
    stay or none."""
    begin(spark)
    with owned(OWNER):
        return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id (null last): five-word shingles, similarity 0.8 or
    more. Repeated rows are copies; texts without words all stay."""
    begin(spark)
    with owned(OWNER):
        return keep_one(docs, 5, 80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 200-byte strings that start in two places; n_chars is counted anew. All rows stay, a null text stays null."""
    begin(spark)
    with owned(OWNER):
        return remove_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order that gives every source its target weight, a null source being one of its own."""
    begin(spark)
    with owned(OWNER):
        return mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document; a null or empty text has no ids."""
    begin(spark)
    with owned(OWNER):
        return bpe_round_trip(docs, _words.default_tokenizer())


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("repeated passages", repeated_passages), ("source mixing", mixing), ("bpe encoding", encoding)]
#: EM, similarity links and byte spans on the output of the stages before: no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = fresh_path(spark, f"stage{k}")
        out = stage(spark, docs, sf_dir)
        schema = out.schema
        out.write.parquet(path)
        docs = spark.read.schema(schema).parquet(path)
        release(spark)
    return docs


QUERIES = {"pipeline": run}
