"""Gate reports, class balance, reconciliation of id and digest sets, memories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.session import literal_table


def gate_pass_rates(reports: DataFrame, group: str) -> DataFrame:
    """Passes per gate over all candidates of the group; a missing gate counts as failed."""
    totals = reports.groupBy(group).agg(F.count(F.lit(1)).alias("candidates"))
    passes = (
        reports.select(group, F.explode("gates").alias("gate", "passed"))
        .groupBy(group, "gate")
        .agg(F.count_if("passed").alias("passes"))
    )
    return passes.join(totals, group).withColumn("rate", F.col("passes") / F.col("candidates"))


def report_summary(reports: DataFrame, group: str) -> DataFrame:
    """Fractions and risk counts of one gate report per group."""
    n = F.count(F.lit(1))
    return reports.groupBy(group).agg(
        n.alias("candidates"),
        (F.count_if("eligible") / n).alias("eligible_fraction"),
        F.bool_and("eligible").alias("all_eligible"),
        (F.count_if("registry_distinct") / n).alias("distinct_fraction"),
        (F.count_if("review_ready") / n).alias("ready_fraction"),
        F.count_if(F.col("alias_status") == "pass").alias("alias_pass"),
        F.count_if(F.col("alias_status") == "not_applicable").alias("alias_not_applicable"),
        F.count_if(F.col("alias_status") == "fail").alias("alias_fail"),
    )


def mean_rewards(rows: DataFrame, group: str, rewards: str) -> DataFrame:
    """Mean per reward key where a missing row or key counts as 0; ``mean_reward`` 0 without keys."""
    totals = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    sums = (
        rows.select(group, F.explode(rewards).alias("key", "value"))
        .groupBy(group, "key")
        .agg(F.sum("value").alias("total"))
    )
    return totals.join(sums, group, "left").select(
        group,
        F.coalesce(F.concat(F.lit("mean_"), "key"), F.lit("mean_reward")).alias("metric"),
        F.coalesce(F.col("total") / F.col("n"), F.lit(0.0)).alias("value"),
    )


def class_balance(rows: DataFrame, supplement: DataFrame, group: str, declared: list[str], excluded: list[str]) -> DataFrame:
    """Two off-quarantine answers per declared family, in the main or the supplemental rows.

    Two distinct answers exist exactly when the smallest and the largest differ,
    so no answer set is collected.
    """

    def classes(df: DataFrame, prefix: str) -> DataFrame:
        kept = F.when(~F.col("quarantined"), F.col("answer"))
        return df.groupBy(group, "prompt_family").agg(
            F.coalesce(F.min(kept) < F.max(kept), F.lit(False)).alias(f"{prefix}_balanced")
        )

    named = sorted({*declared, *excluded})
    every = rows.select(group).distinct()
    grid = every.select(group, F.explode(F.array(*[F.lit(x) for x in named]).cast("array<string>")).alias("prompt_family"))
    if not declared:  # then the families that a group shows are the declared ones
        grid = grid.unionByName(rows.select(group, "prompt_family")).distinct()
    is_declared = F.col("prompt_family").isin(*declared) if declared else F.col("main_balanced").isNotNull()
    is_excluded = F.col("prompt_family").isin(*excluded) if excluded else F.lit(False)
    joined = grid.join(classes(rows, "main"), [group, "prompt_family"], "left").join(
        classes(supplement, "extra"), [group, "prompt_family"], "left"
    )
    verdict = (
        F.when(is_excluded & ~is_declared, "unknown_exclusion")
        .when(is_excluded & ~F.coalesce("extra_balanced", F.lit(False)), "supplement_unbalanced")
        .when(~is_excluded & F.col("main_balanced").isNull(), "absent")
        .when(~is_excluded & ~F.col("main_balanced"), "unbalanced")
        .otherwise("ok")
    )
    return joined.select(group, "prompt_family", verdict.alias("verdict"))


def coverage_complete(rows: DataFrame, group: str) -> DataFrame:
    """Whether each family covers every scene of its group exactly once."""
    cells = rows.groupBy(group, "prompt_family", "scene_id").agg(F.count(F.lit(1)).alias("n"))
    scenes = rows.select(group, "scene_id").distinct().groupBy(group).agg(F.count(F.lit(1)).alias("scenes"))
    covered = cells.groupBy(group, "prompt_family").agg(
        F.count(F.lit(1)).alias("covered"), F.count_if(F.col("n") > 1).alias("repeated")
    )
    return covered.join(scenes, group).withColumn(
        "complete", (F.col("covered") == F.col("scenes")) & (F.col("repeated") == 0)
    )


def dataset_stats(rows: DataFrame, group: str, expected_scenes: int) -> DataFrame:
    """Scene, row, eligible, quarantined and family counts in one pass over the rows."""
    scenes = rows.groupBy(group, "scene_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("quarantined").alias("quarantined"),
        F.collect_set("prompt_family").alias("families"),
    )
    spread = scenes.groupBy(group).agg(
        F.count(F.lit(1)).alias("scene_count"),
        F.sum("rows").alias("row_count"),
        F.sum("quarantined").alias("quarantined_rows"),
        F.max(F.size("families")).cast("bigint").alias("families_per_scene"),
    )
    return spread.select(
        group,
        "scene_count",
        "row_count",
        (F.col("row_count") - F.col("quarantined_rows")).alias("eligible_rows"),
        "quarantined_rows",
        "families_per_scene",
        (F.col("scene_count") == expected_scenes).alias("as_expected"),
    )


def ambiguous(rows: DataFrame, content: str, decision: str) -> DataFrame:
    """Contents that carry more than one decision."""
    return (
        rows.groupBy(content)
        .agg(F.count(F.lit(1)).alias("n"), F.min(decision).alias("lowest"), F.max(decision).alias("highest"))
        .filter(F.col("lowest") < F.col("highest"))
    )


def duplicate_content(rows: DataFrame, content: str, ident: str) -> DataFrame:
    return (
        rows.groupBy(content)
        .agg(F.count(F.lit(1)).alias("copies"), F.min(ident).alias("first_id"), F.max(ident).alias("last_id"))
        .filter(F.col("copies") > 1)
    )


def cohort_collisions(rows: DataFrame, cell: list[str], ident: str) -> DataFrame:
    """Members of every cell with more than one, as rows: a big cell is never one list."""
    sizes = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") > 1)
    return rows.select(*cell, ident).join(sizes, cell)


def funnel_counts(events: DataFrame, attempt: list[str], state: str) -> DataFrame:
    """Attempts that ever reached each state."""
    return events.select(*attempt, state).distinct().groupBy(state).agg(F.count(F.lit(1)).alias("attempts"))


def terminal_reasons(events: DataFrame, attempt: list[str], state: str, order: str, reason: str, terminal: list[str]) -> DataFrame:
    last = events.groupBy(*attempt).agg(F.max_by(F.struct(state, reason), order).alias("last"))
    return (
        last.filter(F.col(f"last.{state}").isin(*terminal))
        .groupBy(F.col(f"last.{state}").alias(state), F.col(f"last.{reason}").alias(reason))
        .agg(F.count(F.lit(1)).alias("attempts"))
    )


def common_fields(rows: DataFrame, json_column: str, declared: list[str]) -> DataFrame:
    """For each declared or seen key: in how many objects, and whether in all of them."""
    keyed = rows.select(F.explode(F.concat(F.json_object_keys(json_column), F.array(F.lit("")))).alias("field"))
    counts = keyed.groupBy("field").agg(F.count(F.lit(1)).alias("n"))
    # the empty key marks each object once and so carries the object count
    total = counts.filter("field = ''").select(F.col("n").alias("objects"), F.lit(1).alias("one"))
    wanted = literal_table(rows.sparkSession, [(x,) for x in declared], ["field"]).withColumn("declared", F.lit(True))
    seen = counts.filter("field <> ''").join(F.broadcast(wanted), "field", "full_outer")
    return (
        seen.withColumn("one", F.lit(1))
        .join(F.broadcast(total), "one")
        .select(
            "field",
            F.coalesce("declared", F.lit(False)).alias("declared"),
            F.coalesce("n", F.lit(0)).alias("n"),
            (F.coalesce("n", F.lit(0)) == F.col("objects")).alias("common"),
        )
    )


def shared_fields(rows: DataFrame, json_column: str, declared: list[str]) -> DataFrame:
    """Declared keys found in at least one object."""
    # each task first reduces its keys to the few declared ones; all keys of all rows never meet
    seen = rows.select(F.explode(F.json_object_keys(json_column)).alias("field")).filter(F.col("field").isin(declared)).distinct()
    return literal_table(rows.sparkSession, [(x,) for x in declared], ["field"]).intersect(seen)


def declared_minus_excluded(spark, declared: list[str], excluded: DataFrame) -> DataFrame:
    """Declared names kept, dropped by an exclusion, and exclusions nobody declared."""
    names = literal_table(spark, [(x,) for x in declared], ["family"]).withColumn("declared", F.lit(True))
    drop = excluded.select("family").distinct().withColumn("excluded", F.lit(True))
    both = names.join(drop, "family", "full_outer")
    return both.select(
        "family",
        F.when(F.col("declared").isNull(), "unknown").when(F.col("excluded"), "excluded").otherwise("kept").alias("outcome"),
    )


def one_to_one_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Number of right rows per left row; anything but one is a violation."""
    counts = right.groupBy(key).agg(F.count(F.lit(1)).alias("matches"))
    return left.select(key).join(counts, key, "left").select(
        key,
        F.coalesce("matches", F.lit(0)).alias("matches"),
        F.when(F.col("matches").isNull(), "missing").when(F.col("matches") > 1, "duplicate").otherwise("ok").alias("verdict"),
    )


def plan_drift(planned: DataFrame, current: DataFrame, key: str, digest: str) -> DataFrame:
    """Planned rows that are gone or whose digest changed."""
    now = current.select(key, F.col(digest).alias("__now"), F.lit(True).alias("__found"))
    joined = planned.select(key, digest).join(now, key, "left")
    verdict = F.when(F.col("__found").isNull(), "missing").when(~F.col(digest).eqNullSafe(F.col("__now")), "changed")
    return joined.select(key, verdict.alias("verdict")).filter("verdict IS NOT NULL")


def set_reconcile(sides: dict[str, DataFrame], key: str) -> DataFrame:
    """Presence of each id on each side, for ids that are not on all of them.

    One union and one aggregation replace a chain of full outer joins.
    """
    tagged = [df.select(key, *[F.lit(name == side).alias(f"in_{side}") for side in sides]) for name, df in sides.items()]
    together = reduce(DataFrame.unionByName, tagged)
    merged = together.groupBy(key).agg(*[F.bool_or(f"in_{side}").alias(f"in_{side}") for side in sides])
    complete = reduce(lambda a, b: a & b, [F.col(f"in_{side}") for side in sides])
    return merged.filter(~complete)


def hash_consensus(sources: dict[str, DataFrame], key: str, digest: str) -> DataFrame:
    """Whether all sources name the same digest for an id; a missing one counts as a value."""
    tagged = [df.select(key, F.col(digest).alias("h")) for df in sources.values()]
    merged = reduce(DataFrame.unionByName, tagged).groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.count("h").alias("known"), F.min("h").alias("low"), F.max("h").alias("high")
    )
    agree = ((F.col("known") == len(sources)) & (F.col("low") == F.col("high"))) | (
        (F.col("known") == 0) & (F.col("n") == len(sources))
    )
    return merged.select(key, F.col("known").alias("known_sources"), F.coalesce(agree, F.lit(False)).alias("consensus"))


def verify_evidence(manifest: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Recomputed digests and sizes against the manifest, with repeated and unlisted paths."""
    listed = manifest.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("listed"), F.max("sha256").alias("want_sha"), F.max("bytes").alias("want_bytes")
    )
    found = actual.groupBy(*keys).agg(F.max("sha256").alias("have_sha"), F.max("bytes").alias("have_bytes"))
    joined = listed.join(found, keys, "full_outer")
    verdict = (
        F.when(F.col("listed").isNull(), "unlisted")
        .when(F.col("listed") > 1, "duplicated")
        .when(F.col("have_sha").isNull(), "missing")
        .when(F.col("have_bytes") != F.col("want_bytes"), "size_mismatch")
        .when(F.col("have_sha") != F.col("want_sha"), "digest_mismatch")
        .otherwise("ok")
    )
    return joined.select(*keys, verdict.alias("verdict"))


def apply_exclusions(rows: DataFrame, exclusions: DataFrame, key: str) -> DataFrame:
    """Outcome per row and per exclusion; an exclusion must bind the state and hit a failing row."""
    have = rows.select(key, "campaign_id", "state_sha", "conforming", F.lit(True).alias("__row"))
    want = exclusions.select(
        key, F.col("campaign_id").alias("x_campaign"), F.col("state_sha").alias("x_state"), F.lit(True).alias("__ex")
    )
    joined = have.join(want, key, "full_outer")
    outcome = (
        F.when(F.col("__row").isNull(), "unused_exclusion")
        .when(F.col("__ex") & (F.col("x_campaign") != F.col("campaign_id")), "wrong_campaign")
        .when(F.col("__ex") & (F.col("x_state") != F.col("state_sha")), "stale_state")
        .when(F.col("__ex") & F.col("conforming"), "refused_conforming")
        .when(F.col("__ex"), "excluded")
        .when(~F.col("conforming"), "contract_violation")
        .otherwise("kept")
    )
    return joined.select(key, outcome.alias("outcome"))


def paired_design(scenes: DataFrame, families: list[str], excluded: list[str]) -> DataFrame:
    """Each scene once per family that is not excluded; the families are exploded in place."""
    kept = [f for f in families if f not in set(excluded)]
    return scenes.withColumn("prompt_family", F.explode(F.array(*[F.lit(f) for f in kept])))


def known_id_check(rows: DataFrame, key: str, references: str, known: DataFrame, known_id: str, limits: tuple[int, int]) -> DataFrame:
    """Unknown references and lists of a wrong size or with repeats."""
    listed = F.size(references)
    shape = (~listed.between(*limits)) | (F.size(F.array_distinct(references)) < listed)
    flat = rows.select(key, F.explode(references).alias(known_id))
    unknown = (
        flat.join(known.select(known_id).distinct(), known_id, "left_anti")
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("unknown"))
    )
    return (
        rows.select(key, shape.alias("bad_shape"))
        .join(unknown, key, "left")
        .select(key, "bad_shape", F.coalesce("unknown", F.lit(0)).alias("unknown"))
        .filter("bad_shape OR unknown > 0")
    )


def failed_gates(gates: Column) -> Column:
    """Names of failed gates in order."""
    return F.array_sort(F.map_keys(F.map_filter(gates, lambda _, passed: ~passed)))


def reason_code(failed: Column) -> Column:
    return F.when(
        F.size(failed) > 0, F.concat(F.lit("protected_gate_failure_"), F.array_join(F.slice(failed, 1, 3), "_"))
    ).otherwise("protected_verifier_rejection")


def extend_memories(reports: DataFrame, ident: str, summary: Column, cell: list[str]) -> DataFrame:
    """Route each outcome into the known or negative memory, and every one into the registry.

    A row is read once: its memory rows are an array exploded in place.
    """
    failed = failed_gates(F.col("gates"))
    row = lambda memory, reason, note: F.struct(
        memory.alias("memory"), reason.alias("reason_code"), note.alias("note")
    )
    main = row(
        F.when(F.col("eligible"), "known").otherwise("negative"),
        F.when(~F.col("eligible"), reason_code(failed)),
        F.when(F.col("eligible"), summary).otherwise(
            F.concat(
                summary,
                F.lit(" Protected failures: "),
                F.when(F.size(failed) > 0, F.array_join(failed, ", ")).otherwise("none recorded"),
                F.lit("."),
            )
        ),
    )
    registry = row(F.lit("registry"), F.lit(None).cast("string"), F.concat_ws("|", *cell))
    return reports.select(ident, F.inline(F.array(main, registry)))


def merge_snapshot(base: DataFrame, promoted: DataFrame, ident: str, ordinal: str) -> DataFrame:
    """Base rows, then promoted ids not yet present; each id keeps its first position."""
    both = base.select(ident, F.lit(0).alias("part"), ordinal).unionByName(
        promoted.select(ident, F.lit(1).alias("part"), ordinal)
    )
    first = both.groupBy(ident).agg(F.min(F.struct("part", ordinal)).alias("at"))
    return first.select(ident, F.when(F.col("at.part") == 0, "base").otherwise("promoted").alias("origin"), F.col(f"at.{ordinal}").alias(ordinal))
