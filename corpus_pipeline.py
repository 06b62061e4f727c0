"""A training corpus from `documents`: without toxic documents, near-duplicates and benchmark passages, mixed by source, as token files."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.llm import decontaminate, mix, near_dup, token_file, toxicity
from wavemill.llm.common import materialise, scratch_path, table
from wavemill.llm.queries import END_ID


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from `labels` on the documents at hand, scores under 0.5."""
    return toxicity.keep_clean(docs, *toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts of similarity 0.8 or more, that of the smallest doc_id. Rows without a doc_id or without words stay."""
    return near_dup.one_of_each(docs, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any window of a `benchmark` item."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it."""
    return mix.apply_mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back: doc_id, start, n_tokens, ids_crc32."""
    path = scratch_path(spark, "tokens")
    token_file.write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return token_file.read_token_files(spark, path)


STAGES = [("toxicity", drop_toxic), ("near_dup", drop_near_duplicates), ("decontamination", drop_contaminated), ("mix", mix_sources), ("token_ids", write_tokens)]

#: SQL can express neither the learned lexicon nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each stage's result is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
