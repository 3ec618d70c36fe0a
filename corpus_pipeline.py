"""A training corpus from the documents: five stages, each an operator of shelfmark.llm.

Each stage takes the rows its predecessor kept, written as Parquet and read again. All but
the last give the columns of the documents, and any others there are. Nulls in any column,
empty texts, repeated rows and ids, and empty tables are fine.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import decontaminate, language, mixing, ngram_join, token_output
from shelfmark.llm.common import with_row_key
from shelfmark.session import materialize, new_work_path

TOKENIZER = "word_bpe_49k.json"
END_ID = 2


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or without a language that makes up half of them, go."""
    return language.in_known_language(docs, language.fit_not_held_out(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (five words, Jaccard 0.8 or more) exactly one row stays, the first in its files.

    Rows are told apart by where they are, not by doc_id: rows that repeat an id or have none
    are documents of their own. Texts without words are like no other and stay.
    """
    keyed, key = with_row_key(docs)
    groups = ngram_join.jaccard_groups(keyed.select(F.col(key).alias("doc_id"), "text"), words=5, num=4, den=5)
    stays = groups.filter("doc_id = component_id").select(F.col("doc_id").alias("_stays"))
    return keyed.join(stays, F.col(key) == F.col("_stays"), "left_semi").drop(key)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds an item of the benchmark go, each by itself, whatever its doc_id."""
    keyed, key = with_row_key(docs)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = decontaminate.find_leaks(keyed.select(F.col(key).alias("doc_id"), "text"), benchmark)
    return decontaminate.without_leaks(keyed, leaks, key=key).drop(key)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mixture takes it, in training order: so the files follow each other."""
    keyed, key = with_row_key(docs)
    return mixing.training_order(keyed, mixing.mix(keyed, key=key), key).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids, written as ORC in the order of the rows and read back: where each document's ids are, and their checksum."""
    keyed, key = with_row_key(docs)
    path = new_work_path(spark, "tokens")
    token_output.write_tokens(keyed, path, public_tokenizers.path(TOKENIZER), end_id=END_ID, order_by=[key])
    return token_output.token_digests(token_output.read_tokens(spark, path))


STAGES = [
    ("language", known_language),
    ("near duplicates", one_of_each_group),
    ("decontamination", decontaminated),
    ("mixture", mixed),
    ("token output", encoded),
]

# Language models, similarity joins and tokenizers are not expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
