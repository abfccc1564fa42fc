"""Ordered run logs: sequence, clock and transition checks, pairing, as-of and interval lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.plans.scan import neighbour, ranked, running, segments
from evalloom.session import literal_table


def check_sequence(events: DataFrame, run: str, sequence: str) -> DataFrame:
    """Runs whose sequence is not exactly 1..n, judged from counts instead of a per-run sort.

    Positions are unique when as many distinct ones exist as rows, and then
    1..n means the smallest is 1 and the largest is n.
    """
    positions = events.groupBy(run, sequence).agg(F.count(F.lit(1)).alias("rows"))
    per_run = positions.groupBy(run).agg(
        F.sum("rows").alias("events"),
        F.count(F.lit(1)).alias("positions"),
        F.min(sequence).alias("first"),
        F.max(sequence).alias("last"),
    )
    contiguous = (
        (F.col("first") == 1) & (F.col("positions") == F.col("events")) & (F.col("last") == F.col("events"))
    )
    return per_run.withColumn("contiguous", contiguous)


def sequence_gaps(events: DataFrame, run: str, sequence: str) -> DataFrame:
    """Events whose predecessor position is absent, found by an equi-join on the position."""
    prior = events.select(run, (F.col(sequence) + 1).alias(sequence)).distinct()
    return events.filter(F.col(sequence) != 1).join(prior, [run, sequence], "left_anti")


def check_monotone_clock(events: DataFrame, keys: list[str], order: str, clock: str, bucket: Column) -> DataFrame:
    """Events whose clock fell below the highest one seen before."""
    seen = running(events, keys, [order], bucket, {"highest": ("max", clock)}, inclusive=False)
    return seen.filter(F.col(clock) < F.col("highest"))


def check_transitions(
    events: DataFrame, keys: list[str], order: str, state: str, bucket: Column,
    *, start: str, allowed: list[tuple[str, str]], terminal: list[str],
) -> DataFrame:
    """Wrong first state, repeated start, disallowed step, step after a terminal state."""
    prior = neighbour(events, keys, [order], bucket, [state])
    before = F.col(f"prev_{state}")
    table = literal_table(events.sparkSession, allowed, [f"prev_{state}", state]).withColumn("__ok", F.lit(True))
    joined = prior.join(F.broadcast(table), [f"prev_{state}", state], "left")
    rule = (
        F.when(before.isNull() & (F.col(state) != start), "bad_start")
        .when(before.isin(*terminal), "after_terminal")
        .when(before.isNotNull() & F.col("__ok").isNull(), "bad_transition")
    )
    return joined.withColumn("rule", rule).filter("rule IS NOT NULL").select(*events.columns, f"prev_{state}", "rule")


def pair_start_finish(events: DataFrame, keys: list[str], order: str, kind: str, start: str, finish: str) -> DataFrame:
    """Finish events with the last start of the same attempt; unmatched start is null."""
    last_start = events.filter(F.col(kind) == start).groupBy(*keys).agg(F.max(order).alias("started"))
    done = events.filter(F.col(kind) == finish)
    return done.join(last_start, keys, "left").select(*keys, F.col(order).alias("finished"), "started", "outcome")


def milestones(events: DataFrame, run: str, order: str) -> DataFrame:
    """First staging, last finished gate and its outcome, number of repairs."""
    def at(kind: str) -> Column:
        return F.when(F.col("kind") == kind, F.col(order))

    return events.groupBy(run).agg(
        F.min(at("candidate_staged")).alias("first_staging"),
        F.max(at("public_gate_finished")).alias("last_finish"),
        F.max_by("outcome", at("public_gate_finished")).alias("last_outcome"),
        F.count_if(F.col("kind") == "public_gate_started").alias("starts"),
        F.count_if((F.col("kind") == "public_gate_finished") & (F.col("outcome") == "failed")).alias("repairs"),
    )


def selected_without_pass(selected: DataFrame, passes: DataFrame, key: str, at: str) -> DataFrame:
    """Selections with no earlier-or-equal pass; the earliest pass decides, so no range join is needed."""
    earliest = passes.groupBy(key).agg(F.min(at).alias("__first"))
    joined = selected.join(earliest, key, "left")
    return joined.filter(F.col("__first").isNull() | (F.col("__first") > F.col(at))).drop("__first")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, bucket: Column) -> DataFrame:
    """Latest right value at or before each left time: one ordered stream, one running maximum."""
    packed = F.struct(F.col(at).alias("at"), F.col(value).alias("value"))
    rows = right.select(*keys, at, F.lit(0).alias("__side"), F.lit(None).cast("bigint").alias("__id"), packed.alias("__known"))
    asks = left.select(
        *keys, at, F.lit(1).alias("__side"), F.col("event_id").cast("bigint").alias("__id"),
        F.lit(None).cast(rows.schema["__known"].dataType).alias("__known"),
    )
    merged = running(rows.unionByName(asks), keys, [at, "__side", "__id"], bucket, {"known": ("max", "__known")})
    return merged.filter("__side = 1").select(
        F.col("__id").alias("event_id"), *keys, at, F.col("known.at").alias("as_of"), F.col("known.value").alias(value)
    )


def active_counts(intervals: DataFrame, probes: DataFrame, start: str, end: str, at: str, bucket: Column) -> DataFrame:
    """How many half-open intervals hold each probe time; an open end never closes.

    Every start adds one and every end takes one away, so a running sum over the
    merged times answers all probes without any range join.
    """
    zero = F.lit(0).cast("bigint")
    ups = intervals.select(F.col(start).alias(at), zero.alias("side"), F.lit(1).cast("bigint").alias("step"))
    downs = intervals.filter(F.col(end).isNotNull()).select(
        F.col(end).alias(at), zero.alias("side"), F.lit(-1).cast("bigint").alias("step")
    )
    asks = probes.select(at, F.lit(1).cast("bigint").alias("side"), zero.alias("step"))
    merged = ups.unionByName(downs).unionByName(asks)
    counted = running(merged, [], [at, "side"], bucket, {"active": ("sum", "step")})
    return counted.filter("side = 1").select(at, "active")


def active_ids(intervals: DataFrame, probes: DataFrame, ident: str, start: str, end: str, at: str, width: int, horizon: int) -> DataFrame:
    """Ids whose interval holds the probe time, by an equi-join on time slots of ``width``."""
    closed = F.coalesce(F.col(end), F.lit(horizon))
    slots = F.sequence(F.floor(F.col(start) / width), F.floor(closed / width))
    spread = intervals.filter(closed >= F.col(start)).select(ident, start, end, F.explode(slots).alias("slot"))
    asked = probes.withColumn("slot", F.floor(F.col(at) / width))
    return (
        asked.join(spread, "slot")
        .filter((F.col(start) <= F.col(at)) & (F.col(end).isNull() | (F.col(end) > F.col(at))))
        .select(at, ident)
    )


def phase_seconds(started: Column, finished: Column) -> Column:
    """Seconds between two microsecond times, floored at 0, null when either is missing."""
    return F.round(F.greatest(F.lit(0).cast("bigint"), finished - started) / 1e6, 6)


def survivor_shrink(passes: DataFrame, run: str, order: str, survivors: str, bucket: Column) -> DataFrame:
    """Passes that bring back an id the pass before had dropped."""
    prior = neighbour(passes, [run], [order], bucket, [survivors])
    back = F.array_except(F.col(survivors), F.col(f"prev_{survivors}"))
    return prior.withColumn("reintroduced", F.coalesce(F.size(back), F.lit(0))).filter("reintroduced > 0").select(
        run, order, "reintroduced"
    )


def run_segments(rows: DataFrame, keys: list[str], order: list[str], flag: Column, bucket: Column, minimum: int) -> DataFrame:
    """Maximal runs of true rows with at least ``minimum`` members."""
    flagged = rows.withColumn("__on", flag)
    numbered = segments(flagged, keys, order, bucket, ["__on"], lambda last, row: last["__on"] != row["__on"])
    return (
        numbered.filter("__on")
        .groupBy(*keys, "segment")
        .agg(
            F.count(F.lit(1)).alias("width"),
            F.min(F.struct(*order)).alias("first"),
            F.max(F.struct(*order)).alias("last"),
        )
        .filter(F.col("width") >= minimum)
    )


def run_gaps(rows: DataFrame, keys: list[str], order: list[str], flag: Column, bucket: Column, minimum: int, *, span: int = 100_000) -> DataFrame:
    """Maximal runs of true rows with their rows' places: ``start``, ``stop`` (behind the last row), ``width`` and ``gap``, the rows since the kept run before."""
    placed = ranked(rows, keys, order, bucket, "__at")
    runs = run_segments(placed, keys, ["__at"], flag, F.floor(F.col("__at") / span), minimum)
    spans = runs.select(*keys, F.col("first.__at").alias("start"), (F.col("last.__at") + 1).alias("stop"), "width")
    before = neighbour(spans, keys, ["start"], F.floor(F.col("start") / span), ["stop"])
    return before.select(*keys, "start", "stop", "width", (F.col("start") - F.col("prev_stop")).alias("gap"))
