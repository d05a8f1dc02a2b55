"""The corpus pipeline: quality rules, near-duplicates, repeated passages, mixing, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procstats.llm import bpe, cover, mixing, near, quality
from procstats.llm.common import same_columns, stored

RANKS = "byte_bpe_multi_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or are mostly boilerplate lines, go."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return same_columns(quality.judge(docs, model).where("kept"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8 or more) the document with the smallest doc_id stays."""
    return near.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages of 35 words or more that stand at two places go; n_chars follows."""
    return cover.strip(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often (0 to 2 times) as the mix takes its words, fractions rounded by a hash of the id."""
    return same_columns(mixing.copies(docs), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens and the token ids of what is left."""
    out = bpe.encode(docs.select("doc_id", "source", "lang", "text"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return out.select("doc_id", "source", "lang", "n_tokens", "ids")


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("repeated passages", repeated_passages),
          ("source mix", source_mix), ("tokens", tokens)]

#: The line labeller is a trained model, which SQL cannot express; tests/llm compares the near-duplicate and passage stages with brute force,
#: of run() only columns, row counts, copies and token lengths.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = stored(docs)
    return docs
