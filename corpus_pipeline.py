"""The pipeline over ``documents``: each stage is written as Parquet and read again by the next.

Quality rules and the quality classifier drop documents, near-dedup keeps one
document of each group, suffix-array dedup cuts repeated strings out of the texts,
and packing returns where each piece of a document stands.  All stages but the last
return the columns of ``documents``.  Labels come from ``labels`` beside the
documents; models are fitted on the stage's own input.

Cases: a null or empty text fails the quality rules; rows without an id pass the
filters by their text, are never linked or cut, and are left out of the packing; rows
that repeat an id leave near-dedup as one; an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm import minhash, packing, quality_classifier, quality_rules, repeat_groups
from evalloom.llm.common import cut_lineage, table


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_rows(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.keep_rows(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    dropped = minhash.near_duplicates(docs, percent=80).filter("NOT kept").select("doc_id").distinct()
    kept = docs.filter("doc_id IS NOT NULL").join(dropped, "doc_id", "left_anti").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.filter("doc_id IS NULL"))


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = repeat_groups.strip_repeats(docs, least=200)
    kind = dict(docs.dtypes).get("n_chars")
    return cut.withColumn("n_chars", F.length("text").cast(kind)) if kind else cut


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(docs, public_tokenizers.path("byte_bpe_50k.json"), added=True)


STAGES = [
    ("quality rules", rules_stage),
    ("quality classifier", classifier_stage),
    ("minhash near-dedup", near_dedup_stage),
    ("suffix-array dedup", repeats_stage),
    ("best-fit packing", packing_stage),
]

#: models and tokens are beyond SQL; the tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
