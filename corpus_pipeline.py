"""The training-text pipeline: toxicity, near-duplicates, repeated substrings, benchmark passages, tokens.

Each stage reads what the one before it wrote. Defined results of all stages: a null text counts as an empty one and
stays null; documents that lose all their words to the substring stage go; a null doc_id is never a group's smallest; of
rows that repeat doc_id and text one stays after the near-duplicates; ties can't arise, as groups are named by their
smallest id; texts of any length are read whole; an empty table goes through as one; other columns stay as they are,
whatever their names (n_chars follows a text that was cut), until the last stage, which returns ids and digests."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from evidentia.llm import bpe, decontaminate, similar, substrings, toxicity
from evidentia.llm.common import materialize, table

#: A repeated string goes from this many words on, or from as many bytes whatever its words.
REPEATED_WORDS, REPEATED_BYTES = 51, 300


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 stay."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group that five-word shingles of a similarity of 0.8 or more link."""
    return similar.keep_one(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages of over fifty words leave the texts; documents left without a word go."""
    return substrings.rewrite(docs, REPEATED_BYTES, REPEATED_WORDS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark windows stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with their number and the round trip's digests."""
    return bpe.tokenize(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_duplicates), ("substrings", remove_repeats), ("decontaminate", drop_contaminated), ("bpe", tokenize)]

#: Trees, components and merges are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
