"""From raw documents to packed training sequences, in five stages.

Each stage takes all rows that the stage before it kept, with the columns of `documents`, and its decisions take effect:

1. language ID drops documents without letters, those in which no language holds half of the likelihood of an average word,
   and those that fit none of the languages learned,
2. exact dedup keeps of equal texts the row with the largest doc_id,
3. near dedup keeps of each group of near duplicates the row with the smallest doc_id,
4. mixing repeats or leaves out documents so that sources come near their target weights,
5. packing cuts and packs the tokens of what is left; its rows are pieces with their places, and `row` tells copies apart.

Rows: null, empty and letterless texts go in stage 1; repeated rows are one row after stage 2; extra columns, whatever their
names, stay until stage 5, which has columns of its own. An empty table gives an empty result.

No stage can be expressed in SQL as a whole; the tests hold run() against a plain version of the five stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagelens.llm import blocknames, langid, mixing, neardup, packing
from pagelens.llm.common import new_dir, spread, tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted_documents(docs, tokenizer_path("piece_bpe_32k.model"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return blocknames.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.kept_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=0, capacity=2048)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; each result is written to shared storage and read by the next stage."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    for name, stage in STAGES:
        path = new_dir(spark, name)
        kept = stage(spark, docs, sf_dir)
        kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
    return docs
