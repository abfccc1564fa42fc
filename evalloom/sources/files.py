"""File trees: digests, evidence indexes, determinism checks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_digests(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Relative path, digest and size of every file below a root.

    Spark's file index leaves out names that begin with ``_`` or ``.``.
    """
    prefix = root.rstrip("/") + "/"
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
        .select(
            F.lit(root).alias("root"),
            F.substring_index(F.col("path"), prefix, -1).alias("path"),
            F.sha2("content", 256).alias("sha256"),
            F.col("length").alias("bytes"),
        )
    )


def drop_caches(files: DataFrame, path: str = "path") -> DataFrame:
    """The tree without cache folders and compiled files."""
    return files.filter(~F.col(path).rlike(r"(^|/)(__pycache__|\.pytest_cache|\.ruff_cache)/|\.py[co]$"))


def _digest_trees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    # rows arrive sorted by root and path, so one running digest is all the state
    root, digest, n = None, None, 0
    for batch in batches:
        done = []
        for r, p, s in zip(batch["root"], batch["path"], batch["sha256"], strict=True):
            if r != root:
                if root is not None:
                    digest.update(b"}")
                    done.append((root, n, digest.hexdigest()))
                root, digest, n = r, hashlib.sha256(b"{"), 0
            entry = f"{json.dumps(p, ensure_ascii=False)}:{json.dumps(s)}"
            digest.update(("," + entry if n else entry).encode())
            n += 1
        yield pd.DataFrame(done, columns=["root", "files", "tree_sha256"])
    if root is not None:
        digest.update(b"}")
        yield pd.DataFrame([(root, n, digest.hexdigest())], columns=["root", "files", "tree_sha256"])


def tree_digest(files: DataFrame) -> DataFrame:
    """Digest per root of its sorted ``{path: digest}`` object.

    A digest reads its input in order, so a root is one task's stream; only the
    running hash is kept in memory, never the list of files.
    """
    listed = files.groupBy("root", "path").agg(F.max("sha256").alias("sha256"))
    ordered = listed.repartition("root").sortWithinPartitions("root", "path")
    return ordered.mapInPandas(_digest_trees, "root string, files bigint, tree_sha256 string")


def evidence_index(files: DataFrame, patterns: list[str]) -> DataFrame:
    """Files whose path matches any pattern, once per path."""
    hit = F.col("path").rlike("|".join(f"(?:{p})" for p in patterns))
    return (
        files.filter(hit)
        .groupBy("root", "path")
        .agg(F.min_by(F.struct("sha256", "bytes"), "sha256").alias("f"))
        .select("root", "path", "f.sha256", "f.bytes")
    )


def determinism_check(first: DataFrame, second: DataFrame) -> DataFrame:
    """Whether two runs produced the same tree digest per root."""
    a = tree_digest(first).select("root", F.col("tree_sha256").alias("a"))
    b = tree_digest(second).select("root", F.col("tree_sha256").alias("b"))
    return a.join(b, "root", "full_outer").select("root", F.col("a").eqNullSafe(F.col("b")).alias("identical"))
