"""One query for each operator and one for the pipeline, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from evalloom.llm.common import table
from evalloom.llm.conversation_trie import conversation_trie
from evalloom.llm.embedding_dedup import embedding_links
from evalloom.llm.license_scan import license_scan
from evalloom.llm.minhash import near_duplicates
from evalloom.llm.oracle import ORACLE
from evalloom.llm.packing import best_fit_pack
from evalloom.llm.phrase_mining import best_phrases
from evalloom.llm.piece_sampling import sample_pieces
from evalloom.llm.quality_classifier import quality_classifier
from evalloom.llm.quality_rules import quality_rules
from evalloom.llm.repeat_groups import remove_repeats
from evalloom.llm.substring_dedup import remove_windows
from evalloom.llm.token_counts import token_counts
from evalloom.llm.toxicity import toxicity
from evalloom.session import spread


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents; a table with fewer splits than cores, such as one small file, is dealt to all of them."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir), percent=85)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_windows(_documents(spark, sf_dir), size=13)


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_documents(spark, sf_dir), least=200)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(_documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op9_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_pieces(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), added=True)


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_phrases(_documents(spark, sf_dir), top=2000, least=10, share=50)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_minhash_near_dedup, op2_substring_dedup, op3_embedding_near_dedup, op4_toxicity, op5_license_scan, op6_quality_rules, op7_suffix_array_dedup, op8_quality_classifier, op9_piece_sampling, op10_best_fit_packing, op11_phrase_mining, op12_conversation_trie, op13_token_counts,
)} | {"pipeline": corpus_pipeline.run}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
