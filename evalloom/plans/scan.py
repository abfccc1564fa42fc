"""Ordered scans that survive a hot key.

A window over one key sorts that whole key in one task.  These helpers cut each
key into ordered buckets, scan every bucket on its own, and carry one summary
row per bucket across.  Only the summaries of a key meet in one task.  Rows with
a null key form one sequence, as in a window.

``bucket`` must never fall while ``order`` rises, and must be a plain function
of the row (for example ``event_id div 100000``), so that a retried task sees
the same buckets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_BUCKET = "__bucket"
_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def _as_col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` that ``left`` keeps; a null key is a key of its own."""
    side = right.select(*[F.col(k).alias(f"__on_{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & left[k].eqNullSafe(side[f"__on_{i}"])
    return left.join(side, same, how).drop(*[f"__on_{i}" for i in range(len(keys))])


def _rejoin(rows: DataFrame, carries: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with the carry of its key and bucket."""
    return matched(rows, carries, [*keys, _BUCKET])


def running(
    df: DataFrame,
    keys: list[str],
    order: list,
    bucket: str | Column,
    specs: dict[str, tuple[str, str | Column]],
    *,
    inclusive: bool = True,
) -> DataFrame:
    """Add running ``sum``/``max``/``min`` columns per key in ``order``.

    ``specs`` maps an output name to ``(kind, value)``.  With ``inclusive=False``
    the current row is left out; a running sum over no rows is 0.
    """
    local = W.partitionBy(*keys, _BUCKET).orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    base = df.withColumn(_BUCKET, _as_col(bucket))
    for name, (_, value) in specs.items():
        base = base.withColumn(f"__v_{name}", _as_col(value))
    scanned = base
    for name, (kind, _) in specs.items():
        scanned = scanned.withColumn(f"__l_{name}", _AGG[kind](f"__v_{name}").over(local))
    totals = base.groupBy(*keys, _BUCKET).agg(
        *[_AGG[kind](f"__v_{name}").alias(f"__t_{name}") for name, (kind, _) in specs.items()]
    )
    before = W.partitionBy(*(keys or [F.lit(0)])).orderBy(_BUCKET).rowsBetween(W.unboundedPreceding, -1)
    carries = totals.select(
        *keys,
        _BUCKET,
        *[_AGG[kind](f"__t_{name}").over(before).alias(f"__c_{name}") for name, (kind, _) in specs.items()],
    )
    out = _rejoin(scanned, carries, keys)
    for name, (kind, _) in specs.items():
        carry, here = F.col(f"__c_{name}"), F.col(f"__l_{name}")
        if kind == "sum":
            value = F.coalesce(carry, F.lit(0)) + F.coalesce(here, F.lit(0))
        elif kind == "max":
            value = F.coalesce(F.greatest(carry, here), carry, here)
        else:
            value = F.coalesce(F.least(carry, here), carry, here)
        out = out.withColumn(name, value)
    return out.select(*df.columns, *specs)


def neighbour(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: str | Column,
    columns: list[str],
    *,
    prefix: str = "prev_",
    ahead: bool = False,
) -> DataFrame:
    """Add the previous (or next, with ``ahead``) row's ``columns`` per key."""
    base = df.withColumn(_BUCKET, _as_col(bucket))
    local = W.partitionBy(*keys, _BUCKET).orderBy(*order)
    shift = F.lead if ahead else F.lag
    packed = F.struct(*columns)
    scanned = base.withColumn("__row", packed).withColumn("__near", shift("__row").over(local))
    rank = F.struct(*order)
    edge = (F.min_by if ahead else F.max_by)(packed, rank)
    edges = base.groupBy(*keys, _BUCKET).agg(edge.alias("__edge"))
    between = W.partitionBy(*(keys or [F.lit(0)])).orderBy(_BUCKET)
    carries = edges.select(*keys, _BUCKET, shift("__edge").over(between).alias("__far"))
    out = _rejoin(scanned, carries, keys).withColumn("__near", F.coalesce("__near", "__far"))
    return out.select(*df.columns, *[F.col(f"__near.{c}").alias(f"{prefix}{c}") for c in columns])


def segments(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: str | Column,
    columns: list[str],
    starts: Callable[[Column, Column], Column],
    name: str = "segment",
) -> DataFrame:
    """Number consecutive runs per key in one scan.

    ``starts(previous, row)`` says from two structs of ``columns`` whether a row
    opens a new run; the first row of a key always does.  Inside a bucket this is
    known at once; for the first row of a bucket it follows from the last row of
    the bucket before, which the summaries hold.
    """
    base = df.withColumn(_BUCKET, _as_col(bucket)).withColumn("__row", F.struct(*columns))
    local = W.partitionBy(*keys, _BUCKET).orderBy(*order)
    near = base.withColumn("__near", F.lag("__row").over(local))
    opens = F.when(F.col("__near").isNotNull() & starts(F.col("__near"), F.col("__row")), 1).otherwise(0).cast("bigint")
    scanned = near.withColumn("__inner", F.sum(opens).over(local.rowsBetween(W.unboundedPreceding, 0))).drop("__near")
    rank = F.struct(*order)
    totals = scanned.groupBy(*keys, _BUCKET).agg(
        F.max("__inner").alias("__n"), F.min_by("__row", rank).alias("__first"), F.max_by("__row", rank).alias("__last")
    )
    across = W.partitionBy(*(keys or [F.lit(0)])).orderBy(_BUCKET)
    joined_on = totals.withColumn("__far", F.lag("__last").over(across)).withColumn(
        "__open",
        F.when(F.col("__far").isNull() | starts(F.col("__far"), F.col("__first")), 1).otherwise(0).cast("bigint"),
    )
    before = F.sum(F.col("__n") + F.col("__open")).over(across.rowsBetween(W.unboundedPreceding, -1))
    carries = joined_on.select(*keys, _BUCKET, (F.coalesce(before, F.lit(0)) + F.col("__open")).alias("__base"))
    out = _rejoin(scanned, carries, keys)
    return out.select(*df.columns, (F.col("__inner") + F.col("__base")).alias(name))


def streak_lengths(
    df: DataFrame, keys: list[str], order: list[str], bucket: str | Column, hit: Column, name: str = "streak"
) -> DataFrame:
    """Length of the running streak of hits at each row, 0 at any other row, in one scan."""
    base = df.withColumn(_BUCKET, _as_col(bucket)).withColumn("__hit", hit.cast("bigint"))
    local = W.partitionBy(*keys, _BUCKET).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    scanned = base.withColumn("__hits", F.sum("__hit").over(local)).withColumn(
        "__reset", F.max(F.when(F.col("__hit") == 0, F.col("__hits"))).over(local)
    )
    totals = scanned.groupBy(*keys, _BUCKET).agg(F.max("__hits").alias("__n"), F.max("__reset").alias("__at"))
    before = W.partitionBy(*(keys or [F.lit(0)])).orderBy(_BUCKET).rowsBetween(W.unboundedPreceding, -1)
    counted = totals.withColumn("__upto", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    # hits counted up to the last reset of an earlier bucket
    base_at = F.max(F.when(F.col("__at").isNotNull(), F.col("__upto") + F.col("__at"))).over(before)
    carries = counted.select(*keys, _BUCKET, (F.col("__upto") - F.coalesce(base_at, F.lit(0))).alias("__carry"))
    out = _rejoin(scanned, carries, keys)
    length = F.when(F.col("__reset").isNotNull(), F.col("__hits") - F.col("__reset")).otherwise(F.col("__hits") + F.col("__carry"))
    return out.select(*df.columns, length.alias(name))


def ranked(df: DataFrame, keys: list[str], order: list[str], bucket: str | Column, name: str = "idx") -> DataFrame:
    """Position of each row per key, counted from 0."""
    out = running(df, keys, order, bucket, {name: ("sum", F.lit(1).cast("bigint"))})
    return out.withColumn(name, F.col(name) - 1)


def percentiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], bucket: Column) -> DataFrame:
    """Exact linear percentiles per key without gathering a key's values.

    Equal values are counted first; a bucketed running count over the distinct
    values then shows which of them cover the wanted positions.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    upto = running(counts, keys, [value], bucket, {"__upto": ("sum", "__n")})
    totals = counts.groupBy(*keys).agg(F.sum("__n").alias("__total"))
    placed = matched(upto, totals, keys)
    first, last = F.col("__upto") - F.col("__n"), F.col("__upto") - 1
    picks = []
    for name, p in probs.items():
        at = (F.col("__total") - 1) * p
        covers = lambda spot: F.when((first <= spot) & (spot <= last), F.col(value))
        picks += [
            F.max(covers(F.floor(at))).alias(f"__lo_{name}"),
            F.max(covers(F.ceil(at))).alias(f"__hi_{name}"),
            F.max(at - F.floor(at)).alias(f"__w_{name}"),
        ]
    got = placed.groupBy(*keys).agg(*picks)
    return got.select(
        *keys,
        *[(F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * F.col(f"__w_{n}")).alias(n) for n in probs],
    )


def moving_mean(
    df: DataFrame, keys: list[str], order: list[str], bucket: str | Column, value: str, half: int, *, block: int = 100_000
) -> DataFrame:
    """Centred mean over ``2 * half + 1`` rows, the edge rows repeated beyond both ends.

    Rows are numbered, cut into blocks, and the few rows next to a cut are copied
    to the neighbouring block.
    """
    numbered = ranked(df, keys, order, bucket, "idx")
    ends = df.groupBy(*keys).agg(
        F.min_by(value, F.struct(*order)).alias("__first"),
        F.max_by(value, F.struct(*order)).alias("__last"),
        F.count(F.lit(1)).alias("__count"),
    )
    here, spot = F.floor(F.col("idx") / block), F.col("idx") % block
    homes = F.array_compact(
        F.array(
            F.struct(here.alias("b"), F.lit(True).alias("own")),
            F.when(spot < half, F.struct((here - 1).alias("b"), F.lit(False).alias("own"))),
            F.when(spot >= block - half, F.struct((here + 1).alias("b"), F.lit(False).alias("own"))),
        )
    )
    spread = numbered.withColumn("__home", F.explode(homes)).select(*numbered.columns, "__home.b", "__home.own")
    near = W.partitionBy(*keys, "b").orderBy("idx").rowsBetween(-half, half)
    summed = spread.withColumn("__sum", F.sum(value).over(near)).filter("own")
    summed = matched(summed, ends, keys)
    before = F.greatest(F.lit(0), half - F.col("idx"))
    after = F.greatest(F.lit(0), F.col("idx") + half - (F.col("__count") - 1))
    mean = (F.col("__sum") + before * F.col("__first") + after * F.col("__last")) / (2 * half + 1)
    return summed.withColumn("smooth", mean).select(*numbered.columns, "smooth")
