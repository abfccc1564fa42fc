"""Deterministic sampling: order by a keyed hash, never by a random generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalloom.plans.scan import matched, running


def rank_hash(seed: int | str, value: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}\0"), value.cast("string")), 256)


def uniform(examples: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """The n smallest by hash: a top-k, so no full sort happens."""
    return examples.withColumn("rank", rank_hash(seed, F.col(key))).orderBy("rank").limit(n)


def balanced(examples: DataFrame, n: int, seed: int, dataset: str, key: str) -> DataFrame:
    """Round-robin over datasets in hash order, members in hash order.

    At most n members per dataset can matter, so the per-dataset rank is cut at n
    and Spark trims each partition before the shuffle.
    """
    members = W.partitionBy(dataset).orderBy(rank_hash(seed, F.col(key)))
    ranked = examples.withColumn("turn", F.row_number().over(members)).filter(F.col("turn") <= n)
    return ranked.orderBy("turn", rank_hash(seed, F.col(dataset))).limit(n)


def one_per_image(examples: DataFrame, seed: int, image: str, key: str) -> DataFrame:
    """Lowest-hash row per image."""
    rest = [c for c in examples.columns if c != image]
    picked = examples.groupBy(image).agg(F.min_by(F.struct(*rest), rank_hash(seed, F.col(key))).alias("row"))
    return picked.select(image, "row.*")


def even_cover(examples: DataFrame, group: str, image: str, bucket: Column, *, size: int = 6, minimum: int = 4) -> DataFrame:
    """At most ``size`` distinct images per group, evenly spread over their sorted order.

    Groups with fewer than ``minimum`` images come out with the ``too_few`` flag
    and no picks.  Ranks come from a bucketed scan, so a hot group is split.
    """
    images = examples.select(group, image).distinct()
    ranked = running(images, [group], [image], bucket, {"position": ("sum", F.lit(1))})
    totals = images.groupBy(group).agg(F.count(F.lit(1)).alias("n_images"))
    slots = F.when(
        F.col("n_images") <= size, F.sequence(F.lit(0).cast("bigint"), F.col("n_images") - 1)
    ).otherwise(
        F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(size - 1).cast("bigint")),
                    lambda i: F.expr("0") + F.floor(i * (F.col("n_images") - 1) / (size - 1)))
    )
    wanted = totals.withColumn("slot", F.explode(slots))
    picks = matched(wanted.filter(F.col("n_images") >= minimum), ranked.withColumn("slot", F.col("position") - 1), [group, "slot"])
    return picks.select(group, "slot", image, "n_images")


def content_rank(df: DataFrame, sha: str, ident: str, *, prefix: int = 3, span: int = 1_000_000) -> DataFrame:
    """Rank of every row in (hash, id) order without a global sort.

    Distinct hashes are ranked by hash prefix and offset by the sizes of the
    earlier ones; rows that share a hash are ranked among themselves in id
    buckets, so a hash held by a third of all rows is still split.
    """
    sizes = df.groupBy(sha).agg(F.count(F.lit(1)).alias("copies"))
    offsets = running(sizes, [], [sha], F.substring(sha, 1, prefix), {"before": ("sum", "copies")}, inclusive=False)
    inner = running(
        df.select(sha, ident), [sha], [ident], F.floor(F.col(ident) / span), {"inner": ("sum", F.lit(1))}
    )
    return matched(inner, offsets, [sha]).select(ident, sha, (F.col("before") + F.col("inner")).alias("rank"), "copies")


def blind_ids(df: DataFrame, sha: str, ident: str, *, width: int = 3) -> DataFrame:
    """Public id by content order beside the private id."""
    ranked = content_rank(df, sha, ident)
    number = F.col("rank").cast("string")
    padded = F.when(F.length(number) < width, F.lpad(number, width, "0")).otherwise(number)
    return ranked.select(F.concat(F.lit("candidate_"), padded).alias("blind_id"), ident, sha)
