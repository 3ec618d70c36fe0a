"""Registered queries of the operators and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import chat_format, conversation_trie, decontaminate, exact_dedup, language, line_dedup, mixing, ngram_join, sharding, spelling, token_counts, token_output, top_inner
from shelfmark.llm.common import table, with_row_key
from shelfmark.llm.oracles import ORACLES  # noqa: F401  (read by the entry module)
from shelfmark.session import materialize, new_work_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

TOKENIZER = "word_bpe_49k.json"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path() -> str:
    return public_tokenizers.path(TOKENIZER)


@query
def op1_ngram_jaccard_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return ngram_join.jaccard_groups(docs, words=4, num=85, den=100)


@query
def op2_source_mixture(spark, sf_dir):
    docs, key = with_row_key(table(spark, sf_dir, "documents"))
    plan = materialize(mixing.mix(docs, key=key), "mixture")
    return mixing.training_places(plan, key).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.size("positions")).cast("long").alias("taken"),
        "first_place",
        "last_place",
    )


@query
def op3_benchmark_leaks(spark, sf_dir):
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op4_stratified_shards(spark, sf_dir):
    return sharding.shard_rows(table(spark, sf_dir, "documents"), shards=8).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op5_language_mixture(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit_not_held_out(docs))


@query
def op6_length_histogram(spark, sf_dir):
    lengths = token_counts.encoded_lengths(table(spark, sf_dir, "documents"), tokenizer_path())
    return token_counts.length_histogram(lengths)


@query
def op7_line_dedup(spark, sf_dir):
    cleaned = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


@query
def op8_token_orc(spark, sf_dir):
    path = new_work_path(spark, "tokens")
    token_output.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=2)
    return token_output.token_digests(token_output.read_tokens(spark, path))


@query
def op9_exact_dedup(spark, sf_dir):
    return exact_dedup.deduplicate(spark, f"{sf_dir}/documents.parquet")


# What user and system turns must hold: the tools that conversations call.
CHAT_SCHEMAS = """
    (values ('user', array(named_struct('name', 'content', 'type', 'string', 'required', true, 'max_length', 300, 'minimum', null, 'maximum', null),
                          named_struct('name', 'turn', 'type', 'integer', 'required', true, 'max_length', null, 'minimum', 0, 'maximum', 6))),
           ('system', array(named_struct('name', 'content', 'type', 'string', 'required', true, 'max_length', null, 'minimum', null, 'maximum', null),
                            named_struct('name', 'turn', 'type', 'integer', 'required', false, 'max_length', null, 'minimum', 0, 'maximum', 0)))
    ) as schemas(tool, fields)
"""


@query
def op10_tool_call_links(spark, sf_dir):
    calls, results = chat_format.conversation_records(table(spark, sf_dir, "conversations"))
    return chat_format.link_calls(calls, results, spark.sql(f"select * from {CHAT_SCHEMAS}"))


@query
def op11_spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


@query
def op12_exact_top_k(spark, sf_dir):
    return top_inner.top_inner_products(table(spark, sf_dir, "embeddings"), k=5, every=50)


@query
def op13_conversation_trie(spark, sf_dir):
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"))
