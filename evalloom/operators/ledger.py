"""Folds over append-only event ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.plans.scan import matched, running, streak_lengths
from evalloom.session import literal_table

TERMINAL = ("scored", "unparseable", "refused")
RETRYABLE = ("attempt_started", "api_error")
DISPOSITIONS = ("complete", "scientific-fail", "infra-fail", "budget-incomplete")


def latest_status(events: DataFrame, keys: list[str], seq: str = "seq", status: str = "status") -> DataFrame:
    """Last status per sample in ledger order."""
    return events.groupBy(*keys).agg(F.max_by(status, seq).alias("status"))


def latest_terminal(events: DataFrame, keys: list[str], columns: list[str], seq: str = "seq") -> DataFrame:
    """Last terminal event per sample."""
    picked = F.max_by(F.struct(*columns), seq)
    return (
        events.filter(F.col("status").isin(*TERMINAL))
        .groupBy(*keys)
        .agg(picked.alias("e"))
        .select(*keys, *[F.col(f"e.{c}").alias(c) for c in columns])
    )


def reasoning_tokens(flat: str | Column, nested: str | Column) -> Column:
    """Flat token count, else the one kept under the completion details."""
    return F.coalesce(flat, nested)


def event_summary(
    events: DataFrame, group: list[str], key: str = "sample_key", seq: str = "seq", *, usage: tuple[str, ...] = ("completion_tokens",), nested: str | Column | None = None
) -> DataFrame:
    """Attempted samples, latest status counts, accuracy over latest scored, usage over all events.

    ``usage`` names the token counts to add up; an event with any of them is a usage
    record.  ``nested`` is the reasoning count under the completion details, taken where
    an event has no flat one.

    One shuffle per level: samples first, then groups, both with partial
    aggregation, so a hot sample or group stays cheap.
    """
    scored = F.col("status") == "scored"
    reasoning = F.col("reasoning_tokens") if nested is None else reasoning_tokens("reasoning_tokens", nested)
    samples = events.groupBy(*group, key).agg(
        F.max_by("status", F.when(F.col("status").isNotNull(), F.col(seq))).alias("last"),
        F.max_by("correct", F.when(scored, F.col(seq))).alias("correct"),
        F.bool_or(scored).alias("any_scored"),
        F.count(F.coalesce(*[F.col(c) for c in usage])).alias("usage_records"),
        *[F.sum(c).alias(c) for c in usage],
        F.sum(reasoning).alias("reasoning_tokens"),
        F.sum("cost").alias("cost"),
    )
    last = F.col("last")
    return samples.groupBy(*group).agg(
        F.count(F.lit(1)).alias("attempted_samples"),
        F.count_if(last == "scored").alias("latest_scored"),
        F.count_if(last == "unparseable").alias("latest_unparseable"),
        F.count_if(last == "api_error").alias("latest_api_error"),
        F.count_if(last == "attempt_started").alias("latest_started"),
        F.count_if("any_scored").alias("scored_samples"),
        F.count_if(F.col("any_scored") & F.coalesce("correct", F.lit(False))).alias("correct_samples"),
        F.try_divide(
            F.count_if(F.col("any_scored") & F.coalesce("correct", F.lit(False))), F.count_if("any_scored")
        ).alias("accuracy"),
        F.sum("usage_records").alias("usage_records"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*usage, "reasoning_tokens")],
        F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("cost"),
    )


def status_pivot(events: DataFrame, group: str, statuses: tuple[str, ...]) -> DataFrame:
    """Events per status and group; the status list is fixed so no extra pass finds it."""
    counts = events.groupBy(group).pivot("status", list(statuses)).count()
    return counts.na.fill(0, list(statuses))


def remaining_examples(
    examples: DataFrame, events: DataFrame, key: str = "sample_key", *, retry_errors: bool, seq: str = "seq"
) -> DataFrame:
    """Examples not yet closed; with ``retry_errors`` a retryable last status stays open."""
    latest = latest_status(events, [key], seq)
    closed = latest.filter(~F.col("status").isin(*RETRYABLE)) if retry_errors else latest
    return examples.join(closed.select(key), key, "left_anti")


def pending_plan(plans: DataFrame, events: DataFrame, *, retry_errors: bool, seq: str = "seq") -> DataFrame:
    """Lowest numbered plan that has an unfinished sample, with its open sample count."""
    open_samples = remaining_examples(plans, events, "sample_key", retry_errors=retry_errors, seq=seq)
    return (
        open_samples.groupBy("plan_no").agg(F.count(F.lit(1)).alias("open_samples")).orderBy("plan_no").limit(1)
    )


def batch_completeness(events: DataFrame, group: list[str], key: str = "sample_key", seq: str = "seq") -> DataFrame:
    """Whether every sample of a batch ended scored and priced."""
    priced = F.col("status").isin(*TERMINAL)
    samples = events.groupBy(*group, key).agg(
        F.max_by("status", seq).alias("last"),
        F.bool_or(F.col("status") == "scored").alias("scored"),
        F.max_by(F.col("cost").isNotNull(), F.when(priced, F.col(seq))).alias("priced"),
    )
    return samples.groupBy(*group).agg(
        F.count(F.lit(1)).alias("selected"),
        F.count_if("scored").alias("scored_samples"),
        F.count_if("priced").alias("cost_records"),
        (F.bool_and("scored") & F.bool_and(F.col("last") == "scored")).alias("all_scored"),
        (
            F.bool_and("scored")
            & F.bool_and(F.col("last") == "scored")
            & (F.count_if("priced") == F.count(F.lit(1)))
        ).alias("complete"),
    )


def run_reconcile(records: DataFrame, state: DataFrame, run: str) -> DataFrame:
    """Token, cost and turn totals per run against the stored state; a run without one is held against zeros."""
    counted = {"input_tokens": "input_tokens", "cache_read_input_tokens": "cache_read_input_tokens", "output_tokens": "completion_tokens", "reasoning_output_tokens": "reasoning_tokens", "provider_turns": "num_turns"}
    totals = records.groupBy(run).agg(
        F.count(F.lit(1)).alias("episodes"),
        *[F.sum(F.coalesce(column, F.lit(0))).alias(name) for name, column in counted.items()],
        F.round(F.sum(F.coalesce("cost", F.lit(0.0))), 9).alias("cost_usd"),
    )
    stored = lambda c: F.coalesce(c, F.lit(0))
    matches = matched(totals, state, [run], "left").select(
        run,
        "episodes",
        *counted,
        F.round("cost_usd", 6).alias("cost_usd"),
        (F.col("episodes") == stored("state_episodes")).alias("episodes_match"),
        (F.col("provider_turns") == stored("state_turns")).alias("turns_match"),
        (F.abs(stored("state_cost") - F.col("cost_usd")) < 1e-8).alias("cost_match"),
    )
    return matches.withColumn("passed", F.col("episodes_match") & F.col("turns_match") & F.col("cost_match"))


def disposition(eligible: Column, exception: Column, verified: Column) -> Column:
    """complete, else timeout, else infrastructure, else scientific failure."""
    return (
        F.when(eligible, "complete")
        .when(exception == "AgentTimeoutError", "budget-incomplete")
        .when(exception.isNotNull() | ~F.coalesce(verified, F.lit(False)), "infra-fail")
        .otherwise("scientific-fail")
    )


def disposition_counts(records: DataFrame) -> DataFrame:
    """Histogram over the four fixed classes, zeros included."""
    classes = literal_table(records.sparkSession, [(c,) for c in DISPOSITIONS], ["disposition"])
    counts = records.groupBy("disposition").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(classes).join(counts, "disposition", "left").na.fill(0, ["n"])


def budget_assessment(usage: DataFrame, run: str, *, budget: float, minimum_start: float, blocking: list[str]) -> DataFrame:
    """Remaining budget, use capped at 1, and whether the run may be compared."""
    remaining = F.greatest(F.lit(0.0), F.lit(float(budget)) - F.col("used"))
    out = usage.groupBy(run).agg(
        F.sum("seconds").alias("used"),
        F.max("stop_reason").alias("stop_reason"),
        F.count_if("infrastructure").alias("infrastructure_outcomes"),
        F.count_if("deviation").alias("deviations"),
    )
    fulfilled = remaining < minimum_start
    return out.select(
        run,
        F.round("used", 6).alias("used"),
        F.round(remaining, 6).alias("remaining"),
        F.round(F.least(F.col("used") / budget, F.lit(1.0)), 6).alias("utilisation"),
        fulfilled.alias("budget_fulfilled"),
        (
            fulfilled
            & ~F.col("stop_reason").isin(*blocking)
            & (F.col("infrastructure_outcomes") == 0)
            & (F.col("deviations") == 0)
        ).alias("comparison_eligible"),
    )


def identity_check(events: DataFrame, pinned: list[str], name: str) -> DataFrame:
    """Observed models outside the pinned set."""
    allowed = literal_table(events.sparkSession, [(p,) for p in pinned], [name])
    return events.select(name).distinct().join(F.broadcast(allowed), name, "left_anti")


def final_usage(events: DataFrame, run: str, message: str, seq: str, is_result: Column) -> DataFrame:
    """Usage of the last result record of a run, else the sum of each message's final record."""
    per_message = events.groupBy(run, message).agg(
        F.max_by("completion_tokens", seq).alias("tokens"),
        F.max(F.when(is_result, F.struct(F.col(seq), F.col("completion_tokens")))).alias("result"),
    )
    return (
        per_message.groupBy(run)
        .agg(F.sum("tokens").alias("messages_total"), F.max("result").alias("result"))
        .select(
            run,
            "messages_total",
            F.col("result.completion_tokens").alias("result_tokens"),
            F.coalesce("result.completion_tokens", "messages_total").alias("final_tokens"),
        )
    )


def first_seen_claim(events: DataFrame, key: str, episode: str) -> DataFrame:
    """Every later reuse of an id with the episode that claimed it first.

    The first episode per id comes from a partial aggregation, not from a window
    that would sort a hot id in one task.
    """
    uses = events.select(key, episode).distinct()
    first = events.groupBy(key).agg(F.min(episode).alias("first_seen"))
    return uses.join(first, key).filter(F.col(episode) > F.col("first_seen"))


def streaks(events: DataFrame, keys: list[str], seq: str, bucket: Column, miss: Column, limit: int) -> DataFrame:
    """Length of the running streak of misses at each event, reset by any other event."""
    counted = streak_lengths(events, keys, [seq], bucket, miss)
    return counted.withColumn("at_limit", F.col("streak") >= limit)


def retry_delay(streak: Column, schedule: list[int]) -> Column:
    """Back-off for a failure count, clamped to the schedule."""
    index = F.least(F.greatest(streak - 1, F.lit(0)), F.lit(len(schedule) - 1))
    return F.element_at(F.array(*[F.lit(s) for s in schedule]), (index + 1).cast("int")).cast("bigint")


def budget_cutoff(
    events: DataFrame, keys: list[str], seq: str, bucket: Column, value: str, limit: float, *, scale: int = 6
) -> DataFrame:
    """First event per run at which the running total reaches the limit."""
    # whole units of 10^-scale, so totals do not depend on the order of addition
    units = F.round(F.col(value) * (10**scale), 0).cast("bigint")
    totals = running(events, keys, [seq], bucket, {"__used": ("sum", units)})
    reached = F.col("__used") >= int(round(limit * 10**scale))
    return totals.groupBy(*keys).agg(
        F.min(F.when(reached, F.col(seq))).alias("cutoff"),
        (F.max("__used") / 10**scale).alias("total"),
    )


def terminal_errors(events: DataFrame, run: str, seq: str, completed: Column, error: Column, markers: Column) -> DataFrame:
    """Split a run's errors at its last completion; name the class of the terminal ones."""
    totals = events.groupBy(run).agg(F.max(F.when(completed, F.col(seq))).alias("last_completed"))
    errors = events.filter(error).withColumn("marker", markers).select(run, seq, "marker")
    joined = totals.join(errors, run, "left")
    terminal = F.col(seq) > F.coalesce("last_completed", F.lit(-1))
    return joined.groupBy(run).agg(
        F.count_if(F.coalesce(terminal, F.lit(False))).alias("terminal_errors"),
        F.count_if(F.coalesce(F.col(seq) < F.col("last_completed"), F.lit(False))).alias("recovered_errors"),
        F.when(F.count_if(terminal & (F.col("marker") == "quota")) > 0, "terminal_hard_quota")
        .when(F.count_if(terminal & (F.col("marker") == "rate")) > 0, "terminal_transient_rate_limit")
        .when(F.count_if(terminal) > 0, "terminal_provider_error")
        .alias("failure_class"),
    )


def episode_transition(events: DataFrame, episode: str) -> DataFrame:
    """Outcome of an episode from the counts of its candidates."""
    n, eligible, incomplete = F.col("candidates"), F.col("eligible"), F.col("incomplete")
    counts = events.groupBy(episode).agg(
        F.count_if("is_candidate").alias("candidates"),
        F.count_if(F.col("is_candidate") & F.col("is_eligible")).alias("eligible"),
        F.count_if(F.col("is_candidate") & F.col("is_incomplete")).alias("incomplete"),
        F.bool_or("valid_submission").alias("valid"),
    )
    transition = (
        F.when((n > 0) & ~F.col("valid"), "invalid_submission_preserved")
        .when((n > 0) & (incomplete == n), "budget_incomplete_preserved")
        .when((n > 0) & (eligible == n), "working_seed_added")
        .when((n > 0) & (eligible == 0), "failed_outcome_added")
        .when(n > 0, "mixed_candidate_outcomes")
        .otherwise("invalid_submission")
    )
    return counts.withColumn("transition", transition)


def episode_fact(episodes: DataFrame, usage: DataFrame, rewards: DataFrame, bucket: Column) -> DataFrame:
    """One row per episode with usage, reward, and library sizes before it began."""
    joined = (
        episodes.join(usage, "episode", "left")
        .join(rewards, "episode", "left")
        .na.fill(0, ["tokens", "turns"])
    )
    return running(
        joined,
        [],
        ["episode"],
        bucket,
        {
            "library_size_before": ("sum", F.coalesce("added", F.lit(0))),
            "failure_memory_before": ("sum", F.coalesce("failed", F.lit(0))),
        },
        inclusive=False,
    )
