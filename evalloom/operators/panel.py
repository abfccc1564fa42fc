"""Panel scoring: accuracies, verdicts, feedback summaries, branch and memory selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalloom.session import broadcast_if_small

from evalloom.operators.ledger import latest_terminal
from evalloom.plans.scan import running


def panel_verdict(panel: DataFrame, candidate: str, evaluator: str, accuracy: str, threshold: float) -> DataFrame:
    """Mean accuracy and the hard flag under the four aggregation rules.

    A candidate has one row per evaluator of a fixed panel, so the collected list
    is bounded; it is added up in evaluator order to keep the mean reproducible.
    """
    listed = F.array_sort(F.collect_list(F.struct(F.col(evaluator), F.col(accuracy))))
    total = F.aggregate(listed, F.lit(0.0), lambda acc, row: acc + row[accuracy])
    a = F.col(accuracy)
    out = panel.groupBy(candidate).agg(
        F.count(F.lit(1)).alias("evaluators"),
        total.alias("__total"),
        F.bool_and(a < threshold).alias("hard_all_below"),
        F.bool_or(a < threshold).alias("hard_any_below"),
        (F.count_if(a <= threshold) * 2 > F.count(F.lit(1))).alias("hard_majority"),
    )
    mean = F.col("__total") / F.col("evaluators")
    return out.withColumn("mean_accuracy", mean).withColumn("hard_mean", mean < threshold).drop("__total")


def panel_report(panel: DataFrame, costs: DataFrame, threshold: float) -> DataFrame:
    """Candidates hard for a majority of evaluators, with their cost, hardest first."""
    verdict = panel_verdict(panel, "candidate", "evaluator", "accuracy", threshold)
    return hardest_first(
        verdict.filter("hard_majority").join(costs, "candidate"), "mean_accuracy", "candidate", "candidate"
    )


def hardest_first(df: DataFrame, accuracy: str, episode: str, ident: str) -> DataFrame:
    return df.orderBy(F.col(accuracy).asc(), F.col(episode).desc(), F.col(ident).cast("string").asc())


def sample_by_evaluator_grid(
    samples: DataFrame, evaluators: Column, events: DataFrame, columns: list[str], key: str = "sample_key"
) -> DataFrame:
    """Every sample with every evaluator of the panel, status ``missing`` where no terminal event exists.

    The panel is an array literal exploded in place, so no join builds the grid.
    """
    grid = samples.select(key, F.explode(evaluators).alias("evaluator"))
    terminal = latest_terminal(events, [key, "evaluator"], ["status", *columns])
    return grid.join(terminal, [key, "evaluator"], "left").withColumn(
        "status", F.coalesce("status", F.lit("missing"))
    )


def feedback_summary(feedback: DataFrame) -> DataFrame:
    """Status and accuracy totals per evaluator plus the total row, from twice nested responses."""
    responses = feedback.select(F.explode("sample_responses").alias("s")).select(F.inline("s.responses"))
    rows = responses.filter(F.col("evaluator").isNotNull() & F.col("status").isNotNull())
    scored = F.col("status") == "scored"
    right = scored & F.coalesce("correct", F.lit(False))
    return rows.rollup("evaluator").agg(
        F.count(F.lit(1)).alias("responses"),
        F.count_if(scored).alias("scored_samples"),
        F.count_if(right).alias("correct_samples"),
        F.try_divide(F.count_if(right), F.count_if(scored)).alias("accuracy"),
        F.count_if(F.col("status") == "unparseable").alias("unparseable"),
        F.count_if(F.col("status") == "api_error").alias("api_error"),
        F.count_if(F.col("status") == "attempt_started").alias("started"),
    )


def feedback_totals(verdicts: DataFrame) -> DataFrame:
    """Counts of hard, not hard and incomplete candidates with the mean of the complete ones."""
    done = F.col("complete")
    return verdicts.agg(
        F.count(F.lit(1)).alias("evaluated"),
        F.count_if(done & F.col("hard")).alias("hard_seed"),
        F.count_if(done & ~F.col("hard")).alias("valid_not_hard"),
        F.count_if(~done).alias("incomplete"),
        F.round(F.avg(F.when(done, F.col("mean_accuracy"))), 9).alias("mean_candidate_accuracy"),
    )


def exact_sum(value: Column) -> Column:
    """Sum of doubles that does not depend on the order of the rows.

    Up to 12 decimal places are added as decimals; where a value is no such decimal
    (not finite, or 1e16 and more), the plain sum is given.
    """
    exact = value.try_cast("decimal(28,12)")
    return F.when(F.count_if(value.isNotNull() & exact.isNull()) == 0, F.sum(exact).cast("double")).otherwise(F.sum(value))


def feedback_reconcile(rows: DataFrame, state: DataFrame, group: str) -> DataFrame:
    """Count and cost of fresh rows against the stored state; bootstrap rows are kept apart."""
    fresh = ~F.col("bootstrap")
    totals = rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("evaluated"),
        F.count_if(fresh).alias("fresh"),
        F.count_if("bootstrap").alias("bootstrapped"),
        F.round(exact_sum(F.when(fresh, F.coalesce("cost", F.lit(0.0))).otherwise(0.0)), 9).alias("cost"),
        F.round(exact_sum(F.when(F.col("bootstrap"), F.coalesce("cost", F.lit(0.0))).otherwise(0.0)), 9).alias("boot_cost"),
    )
    count_ok = F.col("state_count") == F.col("evaluated")
    cost_ok = F.abs(F.coalesce("state_cost", F.lit(0.0)) - F.col("cost")) < 1e-8
    return totals.join(state, group, "left").select(
        group,
        "evaluated",
        "fresh",
        "bootstrapped",
        F.round("cost", 6).alias("cost_usd"),
        F.round("boot_cost", 6).alias("bootstrap_cost_usd"),
        F.coalesce(count_ok, F.lit(False)).alias("count_match"),
        cost_ok.alias("cost_match"),
        (F.coalesce(count_ok, F.lit(False)) & cost_ok).alias("passed"),
    )


def request_bound(panel: DataFrame, group: str, examples_per_candidate: int, retries: int) -> DataFrame:
    """Candidates x examples x evaluators x (1 + retries).

    Both distinct counts come from plain aggregations over (group, member) pairs.
    """
    candidates = panel.select(group, "candidate").distinct().groupBy(group).agg(F.count(F.lit(1)).alias("candidates"))
    evaluators = panel.select(group, "evaluator").distinct().groupBy(group).agg(F.count(F.lit(1)).alias("evaluators"))
    bound = F.col("candidates") * F.col("evaluators") * examples_per_candidate * (1 + retries)
    return candidates.join(evaluators, group).withColumn("maximum_requests", bound)


def branch_assignment(rows: DataFrame, n_targets: int, bucket: Column) -> DataFrame:
    """Target by cycling over the targets; parent = best earlier complete row of that target.

    Each episode asks a question of one target and answers as a row of another,
    so both go into one ordered stream per target and a running minimum serves
    every question without a self-join.
    """
    assigned = (F.col("episode") - 1) % n_targets
    assigned = F.when(assigned < 0, assigned + n_targets).otherwise(assigned)
    rank = F.struct(F.col("accuracy").alias("a"), (-F.col("episode")).alias("e"), F.col("candidate").alias("c"))
    answers = rows.filter("complete").select(
        F.col("target").alias("t"), "episode", F.lit(1).alias("side"), F.col("candidate").alias("who"), rank.alias("rank")
    )
    questions = rows.select(
        assigned.alias("t"), "episode", F.lit(0).alias("side"), F.col("candidate").alias("who"),
        F.lit(None).cast(answers.schema["rank"].dataType).alias("rank"),
    )
    stream = questions.unionByName(answers)
    best = running(stream, ["t"], ["episode", "side", "who"], bucket, {"best": ("min", "rank")}, inclusive=False)
    return best.filter("side = 0").select(
        F.col("who").alias("candidate"),
        "episode",
        F.col("t").alias("target"),
        F.coalesce(F.col("best.c").cast("string"), F.lit("initial_profile")).alias("parent"),
    )


def memory_bank(rows: DataFrame, samples: DataFrame, *, limit: int, samples_per_row: int) -> DataFrame:
    """Half the hardest, then the newest, distinct; each keeps samples with misses first.

    Both halves are top-k queries, so only a few rows ever meet in one task.
    """
    slots = (limit + 1) // 2
    difficulty = [F.col("accuracy").asc(), F.col("episode").desc(), F.col("candidate").cast("string").asc()]
    recency = [F.col("episode").desc(), F.col("candidate").cast("string").asc()]
    one = W.partitionBy(F.lit(0))
    hard = rows.orderBy(*difficulty).limit(slots).withColumn("priority", F.row_number().over(one.orderBy(*difficulty)))
    new = (
        rows.orderBy(*recency)
        .limit(slots + limit)
        .withColumn("priority", F.lit(slots) + F.row_number().over(one.orderBy(*recency)))
    )
    chosen = (
        hard.unionByName(new)
        .groupBy("candidate", "episode", "accuracy")
        .agg(F.min("priority").alias("priority"))
        .orderBy("priority")
        .limit(limit)
    )
    keep = samples.groupBy("candidate", "sample_id").agg(F.bool_or("missed").alias("missed"))
    ranked = (
        keep.join(F.broadcast(chosen), "candidate")
        .withColumn(
            "rank",
            F.row_number().over(
                W.partitionBy("candidate").orderBy((~F.col("missed")).asc(), F.col("sample_id").cast("string"))
            ),
        )
        .filter(F.col("rank") <= samples_per_row)
    )
    return ranked.select("candidate", "episode", "accuracy", "sample_id", "missed", "rank")


def bootstrap_join(manifest: DataFrame, results: DataFrame, digests: DataFrame, forward: DataFrame) -> DataFrame:
    """Manifest record x result x digest x policy compatibility, with the first failed rule."""
    joined = (
        manifest.join(results, "candidate", "left")
        .join(digests, "candidate", "left")
        .join(
            broadcast_if_small(forward.withColumn("forward", F.lit(True))),
            (F.col("result_policy") == F.col("source_policy")) & (F.col("policy") == F.col("target_policy")),
            "left",
        )
    )
    compatible = (F.col("result_policy") == F.col("policy")) | F.col("forward").isNotNull()
    issue = (
        F.when(F.col("copies") > 1, "duplicate_candidate")
        .when(F.col("actual_sha").isNull() | (F.col("actual_sha") != F.col("candidate_sha")), "hash_mismatch")
        .when(~F.coalesce(compatible, F.lit(False)), "policy_incompatible")
        .when(~F.col("status").eqNullSafe("complete"), "not_complete")
        .when(~F.col("protected_valid").eqNullSafe(True), "not_protected_valid")
    )
    return joined.select("candidate", F.coalesce(issue, F.lit("ok")).alias("verdict"))
