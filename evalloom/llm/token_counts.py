"""Token counts kept by digest: a text is encoded once for each tokenizer version.

The cache is a Parquet folder of (content, n_tokens), one partition for each digest
of a tokenizer.  Documents are listed by the SHA-256 of their normalised text;
digests that the cache lacks are taken once each, the text of one document is
fetched for each of them and encoded, and the counts are appended.  All documents
then take their counts from the cache.  A second run over the same texts encodes
nothing, and a changed tokenizer file or library starts a partition of its own.

Appending is safe to repeat: a count follows from its key, so rows written twice by
two runs agree and are read as one.  A run that dies before its append leaves the
cache as it was.

Cases: a null text is the empty text (0 tokens); rows without an id are counted like
others; repeated rows give a row each; an empty table gives no rows and leaves the
cache alone; columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm.common import cut_lineage
from evalloom.llm.packing import Encoder
from evalloom.session import shared_folder

SCHEMA = "content binary, n_tokens bigint, tokenizer string"


def tokenizer_digest(path: str) -> str:
    """Hex digest of the tokenizer's file, its library and the library's version."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    with open(path, "rb") as f:
        content = hashlib.sha256(f.read()).hexdigest()
    return hashlib.sha256(f"{library.__name__} {library.__version__} {content}".encode()).hexdigest()


def _is_plain_byte_level(path: str) -> bool:
    """Whether the file says byte-level pieces of the common pattern and nothing else that changes ids."""
    with open(path) as f:
        saved = json.load(f)
    before, model = saved.get("pre_tokenizer") or {}, saved["model"]
    return (
        before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not saved.get("normalizer")
        and model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t.get("normalized") and t["content"].isspace() for t in saved.get("added_tokens", []))
    )


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts of whole texts, as the library of the file gives them without begin, end or other added tokens."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)]
    if _is_plain_byte_level(path):
        encode = Encoder(path, added=True)
        return lambda texts: [len(encode(t)) // 4 for t in texts]
    from tokenizers import Tokenizer

    tokens = Tokenizer.from_file(path)
    tokens.no_truncation()
    tokens.no_padding()
    return lambda texts: [len(e) for e in tokens.encode_batch(texts, add_special_tokens=False)]


def open_cache(spark: SparkSession, folder: str, tokenizer: str) -> DataFrame:
    """(content, n_tokens) of one tokenizer; a folder that is not there yet is made."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    rows = spark.read.schema(SCHEMA).parquet(folder).filter(F.col("tokenizer") == tokenizer)
    return rows.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def _encode_misses(path: str, at_once: int = 256):
    def run(batches):
        count = counter(path)
        seen: set[bytes] = set()
        for batch in batches:
            content, texts = batch.column(0), batch.column(1)
            fresh: list[int] = []
            for i, c in enumerate(content.to_pylist()):
                if c not in seen:  # rows that repeat their id come here together
                    seen.add(c)
                    fresh.append(i)
            if len(seen) > 200_000:
                seen.clear()
            counts: list[int] = []
            for k in range(0, len(fresh), at_once):
                counts += count(texts.take(pa.array(fresh[k : k + at_once])).to_pylist())
            yield pa.RecordBatch.from_arrays([content.take(pa.array(fresh, pa.int64())), pa.array(counts, pa.int64())], ["content", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str, cache: str | None = None, normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """(doc_id, content, n_bytes, n_tokens) of every document.

    ``cache``: a folder that all executors reach, kept between runs; without one the
    run has a fresh one under ``spark.checkpoint.dir``.  ``normalise`` may map texts
    to a form with the same count, so that more of them meet in one digest; lengths
    are of the text as it is.
    """
    spark = docs.sparkSession
    folder, version = cache or shared_folder(spark, "token-counts"), tokenizer_digest(path)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    normal = normalise(text) if normalise else text
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.unhex(F.sha2(normal.cast("binary"), 256)).alias("content"), normal.alias("text"), F.octet_length(text).cast("bigint").alias("n_bytes"))
    listed = cut_lineage(keyed.select("doc_id", "content", "n_bytes"), "listed")
    misses = listed.groupBy("content").agg(F.min("doc_id").alias("holder")).join(open_cache(spark, folder, version), "content", "left_anti")
    misses = cut_lineage(misses, "misses")
    texts = keyed.select("doc_id", "content", "text").join(misses.withColumnRenamed("content", "missing"), F.expr("content = missing AND doc_id <=> holder"), "left_semi")
    counted = texts.select("content", "text").mapInArrow(_encode_misses(path), "content binary, n_tokens bigint")
    counted.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(folder)
    return listed.join(open_cache(spark, folder, version), "content").select("doc_id", "content", "n_bytes", "n_tokens")


def token_counts(docs: DataFrame, path: str, limit: int = 512, cache: str | None = None) -> DataFrame:
    return count_tokens(docs, path, cache).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
