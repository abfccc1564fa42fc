"""Session helpers: the shared folder, size-checked broadcasts, lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: folder of each local application that names none; a running session cannot take the setting
_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder that every executor can reach.

    The cluster names its folder in ``spark.checkpoint.dir``.  Only a local
    master may fall back to a temporary folder of this machine.
    """
    base = spark.conf.get(CHECKPOINT_CONF, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{CHECKPOINT_CONF} must name a shared folder on a cluster")
        app = spark.sparkContext.applicationId
        base = _local_folders.get(app) or _local_folders.setdefault(app, tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, purpose: str = "cut", codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written table survives the loss of executors, so an iterative job never
    recomputes earlier rounds.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = 200_000, max_bytes: int = 64 << 20) -> DataFrame:
    """Hint a broadcast only after counting at most ``max_rows`` rows of ``max_bytes`` as JSON.

    The count stops at the row limit; a larger side is returned without the hint and
    Spark then picks a shuffled join.
    """
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    rows, held = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(size)).first()
    return F.broadcast(df) if rows <= max_rows and (held or 0) <= max_bytes else df


def literal_table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small fixed table built inside the JVM from literals."""
    packed = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(row, names, strict=True)]) for row in rows])
    return spark.range(1).select(F.inline(packed).alias(*names))


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Give a scan with fewer splits than cores one partition per core.

    Meant for costly row work behind small or unsplittable files; a scan that
    already has enough splits is returned as it is.  Rows go by the hash of a
    key, so a retried task sees the same rows.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores, key)
