"""Shared tables, written intermediate results and components."""

from __future__ import annotations

import gc
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom import session

__all__ = ["components", "cut_lineage", "drop_written", "keyed_texts", "labelled", "remainder", "table"]


def cut_lineage(df: DataFrame, purpose: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; the shuffles behind it may then go.

    Spark removes the shuffle files of finished jobs when the driver collects its
    garbage, so that is asked for here: the disk then holds about one step.
    """
    written = session.cut_lineage(df, purpose, codec)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_texts(docs: DataFrame) -> DataFrame:
    """doc_id and text of rows that have an id; other columns are pruned at the scan."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL")


def remainder(column: str, n: int):
    """crc32 of the id's decimal text, modulo n: the fold of a labelled row."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def fold_of(ids, n: int):
    """:func:`remainder` for a numpy array of ids."""
    import numpy as np

    return np.fromiter((zlib.crc32(str(int(i)).encode()) % n for i in ids), np.int64, len(ids))


def labelled(labels: DataFrame, texts: DataFrame, column: str, bound: int, balanced: bool = False, where=None) -> DataFrame:
    """At most ``bound`` labelled ids (``doc_id``, ``y``) of ``texts``, those with the smallest hashes.

    Rows without an id or label are left out; an id with several labels takes the
    largest.  ``balanced`` takes up to half of the bound from each label.
    """
    rows = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(column).cast("int").alias("y"))
    # labels of absent documents must not use up the bound
    rows = rows.filter("doc_id IS NOT NULL AND y IN (0, 1)").join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = (rows.filter(where) if where is not None else rows).groupBy("doc_id").agg(F.max("y").alias("y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    if not balanced:
        return rows.orderBy(*order).limit(bound)
    half = bound // 2
    return rows.filter("y = 1").orderBy(*order).limit(half).unionByName(rows.filter("y = 0").orderBy(*order).limit(half))


def drop_written(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete folders of :func:`cut_lineage` that no later step reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for frame in frames:
        for folder in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def _open(links: DataFrame) -> bool:
    """Whether some node has two links down, or one down and one up: then the links are no stars yet."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(links.select("v", F.lit(0), F.lit(1)))
    return bool(ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 OR down = 1 AND up = 1").limit(1).count())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that a link ``u, v`` names; component is the smallest node it reaches.

    Large-star and small-star steps; each round is written to the shared folder,
    so a lost executor costs no earlier round, and the round before is deleted.
    The number of rounds is logarithmic in the longest path.
    """
    spark = edges.sparkSession
    links = cut_lineage(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while _open(links):
        both = links.union(links.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        after = cut_lineage(small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).filter("u <> v").distinct(), "links")
        drop_written(spark, links)
        links = after
    return links.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
