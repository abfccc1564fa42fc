"""Ordered value series: clusters, splits, cycles, run-length rows, paired traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalloom.operators.logs import run_segments
from evalloom.plans.scan import matched, moving_mean, neighbour, percentiles, running, segments
from evalloom.session import cut_lineage


def gap_clusters(rows: DataFrame, keys: list[str], value: str, gap: float, bucket: Column) -> DataFrame:
    """Sorted values split where the step exceeds ``gap``; size and centre of each group."""
    numbered = segments(
        rows, keys, [value], bucket, [value], lambda last, row: row[value] - last[value] > gap, "cluster"
    )
    return numbered.groupBy(*keys, "cluster").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("centre"))


def largest_gap_split(rows: DataFrame, keys: list[str], order: list[str], value: str, bucket: Column, minimum: float) -> DataFrame:
    """Cut the sorted weights at the largest gap, the later one on a tie; abstain below ``minimum``."""
    ahead = neighbour(rows, keys, order, bucket, [value], prefix="next_", ahead=True)
    step = F.round(F.col(f"next_{value}") - F.col(value), 9)
    best = ahead.filter(F.col(f"next_{value}").isNotNull()).groupBy(*keys).agg(
        F.max(F.struct(step.alias("gap"), F.col(value).alias("low"), F.col(f"next_{value}").alias("high"))).alias("cut")
    )
    return best.select(*keys, "cut.gap", "cut.low", "cut.high", (F.col("cut.gap") < minimum).alias("abstain"))


def count_cycles(
    rows: DataFrame, keys: list[str], order: list[str], value: str, bucket: Column, value_bucket: Column,
    *, half: int = 4, low: float = 0.04, high: float = 0.96, lift: float = 0.30, minimum_run: int = 8,
) -> DataFrame:
    """Smooth, take the 4th and 96th percentile, count runs above the midpoint plus a share of the amplitude."""
    # the smoothed series and its percentiles are read more than once: compute them once
    smooth = cut_lineage(moving_mean(rows, keys, order, bucket, value, half), "smooth")
    marks = cut_lineage(percentiles(smooth, keys, "smooth", {"low": low, "high": high}, value_bucket), "marks")
    amplitude = (F.col("high") - F.col("low")) / 2.0
    level = (F.col("low") + F.col("high")) / 2.0 + lift * amplitude
    flagged = matched(smooth, marks, keys).withColumn("above", F.round(F.col("smooth") - level, 9) > 0)
    runs = run_segments(flagged, keys, ["idx"], F.col("above"), F.floor(F.col("idx") / 100_000), minimum_run)
    counted = runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("cycles"), F.min("width").alias("narrowest"))
    return matched(marks, counted, keys, "left").select(
        *keys, F.coalesce("cycles", F.lit(0)).alias("cycles"), "narrowest", F.round(amplitude, 6).alias("amplitude")
    )


def argmax_with_abstain(scores: DataFrame, keys: list[str], label: str, score: str, minimum: float) -> DataFrame:
    """Best label; none when the best is below ``minimum`` or tied."""
    order = W.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(label))
    top = scores.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= 2)
    both = top.groupBy(*keys).agg(
        F.max(F.when(F.col("__r") == 1, F.col(label))).alias("best"),
        F.max(F.when(F.col("__r") == 1, F.col(score))).alias("best_score"),
        F.max(F.when(F.col("__r") == 2, F.col(score))).alias("second"),
    )
    clear = (F.col("best_score") >= minimum) & (F.col("second").isNull() | (F.col("best_score") > F.col("second")))
    return both.select(*keys, F.when(clear, F.col("best")).alias("label"), "best_score")


def rle_expand_match(
    runs: DataFrame, keys: list[str], order: str, bit: str, length: str, bucket: Column, templates: dict[str, str]
) -> DataFrame:
    """Expand (bit, length) runs and score the row against periodic templates.

    A run knows where it starts from a running sum, so its cells are made and
    compared in place.
    """
    offsets = running(runs, keys, [order], bucket, {"__start": ("sum", length)}, inclusive=False)
    cells = offsets.select(*keys, bit, F.explode(F.sequence(F.col("__start"), F.col("__start") + F.col(length) - 1)).alias("pos"))
    wanted = F.array(
        *[
            F.struct(F.lit(name).alias("label"), F.substring(F.lit(t), (F.col("pos") % len(t) + 1).cast("int"), F.lit(1)).alias("want"))
            for name, t in templates.items()
        ]
    )
    return (
        cells.select(*keys, bit, F.inline(wanted))
        .groupBy(*keys, "label")
        .agg(F.count_if(F.col(bit).cast("string") == F.col("want")).alias("score"), F.count(F.lit(1)).alias("cells"))
    )


def profile_residual(traces: DataFrame, keys: list[str], left: str, right: str, limit: float) -> DataFrame:
    """Mean absolute difference of two centred traces over the positions both have."""
    both = traces.filter(F.col(left).isNotNull() & F.col(right).isNotNull())
    centres = both.groupBy(*keys).agg(F.avg(left).alias("__l"), F.avg(right).alias("__r"))
    gap = F.abs((F.col(left) - F.col("__l")) - (F.col(right) - F.col("__r")))
    out = matched(both, centres, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("positions"), F.avg(gap).alias("r"))
    return out.select(
        *keys, "positions", F.round("r", 6).alias("residual"), F.when(F.round("r", 9) < limit, "yes").otherwise("no").alias("answer")
    )


def rank_signature(items: dict[str, Column], minimum_gap: float) -> Column:
    """Rank of each named item inside its row; null when two neighbours are too close."""
    packed = F.array_sort(F.array(*[F.struct(v.alias("v"), F.lit(n).alias("n")) for n, v in items.items()]))
    names = F.transform(packed, lambda x: x["n"])
    steps = F.zip_with(F.slice(packed, 2, len(items) - 1), F.slice(packed, 1, len(items) - 1), lambda a, b: a["v"] - b["v"])
    ranks = F.concat_ws("", *[(F.array_position(names, n) - 1).cast("string") for n in items])
    return F.when(F.array_min(steps) >= minimum_gap, ranks)


def signature_mismatch(left: Column, right: Column, size: int) -> Column:
    out = F.lit(0)
    for i in range(1, size + 1):
        out = out + F.when(F.substring(left, i, 1) != F.substring(right, i, 1), 1).otherwise(0)
    return F.when(left.isNotNull() & right.isNotNull(), out)
