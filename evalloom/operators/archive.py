"""Quality-diversity archive: target scores, admission rules, summaries and the ordered fold."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalloom.functions.similarity import rms_distance
from evalloom.session import shared_folder


@dataclass(frozen=True)
class ArchivePolicy:
    """Limits of one archive."""

    cells: tuple[str, ...]
    max_elites: int = 3
    similarity_ceiling: float = 0.68
    local_similarity_ceiling: float = 0.60
    stability_floor: float = 0.5
    error_ceiling: float | None = None
    global_floor: float = 0.08
    local_floor: float = 0.09
    vector_size: int = 64


def admission_reason(policy: ArchivePolicy, known_values: dict[str, list[str]] | None = None) -> Column:
    """First rule that keeps a candidate out, before any distance is looked at; null when it may go on."""
    bad_axis = F.lit(False)
    for axis, values in (known_values or {}).items():
        bad_axis = bad_axis | ~F.col(axis).isin(*values)
    vector = F.col("vector")
    bad_vector = (F.size(vector) != policy.vector_size) | F.exists(
        vector, lambda x: x.isNull() | F.isnan(x) | ~x.between(0.0, 1.0)
    )
    error, stability = F.col("error_fraction"), F.col("stability")
    rules: list[tuple[Column, str]] = [
        (~F.col("valid"), "protected_invalid"),
        (~F.col("attested"), "descriptor_attestation_incomplete"),
        (bad_axis, "descriptor_attestation_invalid"),
        (~F.col("cell").isin(*policy.cells), "outside_prespecified_feasible_mask"),
        (F.col("similarity") >= policy.similarity_ceiling, "global_semantic_similarity_ceiling"),
        (bad_vector, "descriptor_attestation_invalid"),
        (~error.between(0.0, 1.0), "descriptor_attestation_invalid"),
    ]
    if policy.error_ceiling is not None:
        rules.append((error > policy.error_ceiling, "oracle_ablation_fragility_ceiling"))
    rules += [
        (~stability.between(0.0, 1.0), "descriptor_attestation_invalid"),
        (stability < policy.stability_floor, "descriptor_instability_floor"),
    ]
    # a rule that a null leaves open refuses
    refused = [(F.coalesce(condition, F.lit(True)), reason) for condition, reason in rules]
    out = F.when(*refused[0])
    for condition, reason in refused[1:]:
        out = out.when(condition, reason)
    return out


def target_statistics(decisions: DataFrame, group: list[str], target: str) -> DataFrame:
    """Selections, completions, matches, admissions, trailing misses, last episode, observed cells.

    The trailing misses are the decisions after the last match, so two partial
    aggregations replace an ordered scan.
    """
    keys = [*group, target]
    last_match = decisions.filter("matched").groupBy(*keys).agg(F.max("episode").alias("__last"))
    totals = decisions.join(last_match, keys, "left").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("selected_count"),
        F.count_if("matched").alias("match_count"),
        F.count_if("admitted").alias("admission_count"),
        F.count_if(F.col("__last").isNull() | (F.col("episode") > F.col("__last"))).alias("consecutive_misses"),
        F.max("episode").alias("last_selected_episode"),
    )
    observed = (
        decisions.filter("observed")
        .groupBy(*keys, "cell")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*keys)
        # at most one entry per cell of the fixed grid
        .agg(F.array_sort(F.collect_list(F.struct("cell", "n"))).alias("cells"))
        .select(*keys, F.array_join(F.transform("cells", lambda c: F.concat_ws("=", c["cell"], c["n"].cast("string"))), ",").alias("observed_cells"))
    )
    return totals.join(observed, keys, "left").withColumn("observed_cells", F.coalesce("observed_cells", F.lit("")))


def target_scores(
    stats: DataFrame, *, coverage: float, feasibility: float, exploration: float, penalty: float, cooldown: int
) -> DataFrame:
    """Weighted balance of coverage, feasibility, uncertainty, recent misses and cooldown."""
    occ, done, hit = F.col("occupancy"), F.col("completed"), F.col("matched")
    misses = F.least(F.lit(3), F.col("consecutive_misses")) / 3.0
    cooling = F.coalesce(F.col("episode_index") - F.col("last_selected_episode") <= cooldown, F.lit(False))
    score = (
        F.lit(coverage) * (1.0 / (occ + 1.0))
        + F.lit(feasibility) * ((hit + 1.0) / (done + 2.0))
        + F.lit(exploration) * (1.0 / F.sqrt(done + 1.0))
        - F.lit(penalty) * misses
        - F.when(cooling, 1.0).otherwise(0.0)
    )
    return stats.withColumn("cooldown_active", cooling).withColumn("score", score)


def target_rank(seed: int, episode: Column, cell: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}\0"), episode.cast("string"), F.lit("\0"), cell), 256)


def select_target(scores: DataFrame, group: list[str], seed: int) -> DataFrame:
    """Highest score, ties by the larger hash; beside it the older rule: smallest hash among the least occupied."""
    rank = target_rank(seed, F.col("episode_index"), F.col("cell"))
    ranked = scores.withColumn("rank", rank)
    return ranked.groupBy(*group).agg(
        F.max_by("cell", F.struct(F.round("score", 12), "rank")).alias("adaptive_target"),
        F.round(F.max("score"), 6).alias("score"),
        F.min_by("cell", F.struct("occupancy", "rank")).alias("coverage_target"),
    )


def first_elites(rows: DataFrame, group: list[str], cell: str, order: str, limit: int) -> DataFrame:
    """The first admitted rows of each cell: what an archive holds while slots are open."""
    window = W.partitionBy(*group, cell).orderBy(order)
    return rows.withColumn("__slot", F.row_number().over(window)).filter(F.col("__slot") <= limit).drop("__slot")


def min_pairwise_distance(elites: DataFrame, group: list[str], ident: str, vector: str = "vector") -> DataFrame:
    """Smallest distance inside each cell, 1 with fewer than two elites; cells are bounded by policy."""
    right = elites.select(*group, F.col(ident).alias("__id"), F.col(vector).alias("__v"))
    pairs = elites.join(right, group).filter(F.col(ident) < F.col("__id"))
    near = pairs.groupBy(*group).agg(F.min(rms_distance(F.col(vector), F.col("__v"))).alias("d"))
    sizes = elites.groupBy(*group).agg(F.count(F.lit(1)).alias("elites"))
    return sizes.join(near, group, "left").select(
        *group, "elites", F.round(F.coalesce("d", F.lit(1.0)), 9).alias("min_distance")
    )


def packed_elites(elites: DataFrame, group: list[str], ident: str) -> DataFrame:
    """One row per archive with its elites as an array; the policy bounds cells and slots."""
    return elites.groupBy(*group).agg(
        F.collect_list(F.struct(F.col(ident).alias("eid"), F.col("cell").alias("ecell"), F.col("vector").alias("evec"))).alias("elites")
    )


def nearest_elite(candidates: DataFrame, elites: DataFrame, group: list[str], ident: str) -> DataFrame:
    """Distance of each candidate to the nearest elite of its archive and of its cell, itself left out."""
    joined = candidates.join(packed_elites(elites, group, ident), group, "left")
    others = F.filter("elites", lambda e: e["eid"] != F.col(ident))
    local = F.filter("elites", lambda e: (e["eid"] != F.col(ident)) & (e["ecell"] == F.col("cell")))
    distance = lambda e: rms_distance(F.col("vector"), e["evec"])
    least = lambda found: F.round(F.coalesce(F.array_min(F.transform(found, distance)), F.lit(1.0)), 9)
    return joined.select(ident, least(others).alias("global_distance"), least(local).alias("local_distance"))


def worst_elite(elites: DataFrame, group: list[str], ident: str) -> DataFrame:
    """Elite with the highest similarity, then the larger id, of each full cell."""
    return elites.groupBy(*group).agg(
        F.count(F.lit(1)).alias("elites"), F.max_by(ident, F.struct("similarity", ident)).alias("worst")
    )


def archive_summary(elites: DataFrame, archives: DataFrame, group: list[str], cells: list[str], ident: str) -> DataFrame:
    """Occupancy and closest pair of every feasible cell, empty cells included."""
    grid = archives.select(*group, F.explode(F.array(*[F.lit(c) for c in cells])).alias("cell"))
    measured = min_pairwise_distance(elites, [*group, "cell"], ident)
    return grid.join(measured, [*group, "cell"], "left").select(
        *group,
        "cell",
        F.coalesce("elites", F.lit(0)).alias("occupancy"),
        F.when(F.col("elites") >= 2, F.col("min_distance")).alias("min_distance"),
    )


def coverage(summary: DataFrame, group: list[str]) -> DataFrame:
    return summary.groupBy(*group).agg(
        F.count(F.lit(1)).alias("feasible_cells"),
        F.count_if(F.col("occupancy") > 0).alias("occupied_cells"),
        (F.count_if(F.col("occupancy") > 0) / F.count(F.lit(1))).alias("coverage"),
        F.sum("occupancy").alias("elites"),
    )


def occupied_cells_to_avoid(summary: DataFrame, target: str) -> DataFrame:
    """Non-empty cells other than the target, fullest first."""
    return summary.filter((F.col("cell") != target) & (F.col("occupancy") > 0)).orderBy(
        F.col("occupancy").desc(), F.col("cell").asc()
    )


# ---------------------------------------------------------------------------
# the ordered fold
# ---------------------------------------------------------------------------


def _spread(vectors: list[np.ndarray]) -> float:
    """Smallest pairwise distance, 1 below two members."""
    if len(vectors) < 2:
        return 1.0
    stack = np.stack(vectors)
    gaps = np.sqrt(((stack[:, None, :] - stack[None, :, :]) ** 2).mean(axis=2))
    return float(gaps[np.triu_indices(len(vectors), 1)].min())


def attested_step(policy: ArchivePolicy, elites: list[dict], row: dict) -> tuple[str, bool, int | None]:
    """Decide one candidate against the archive and change it in place when admitted."""
    vector = np.asarray(row["vector"])
    here = [e for e in elites if e["cell"] == row["cell"]]
    if elites:
        gaps = np.sqrt(((np.stack([e["vector"] for e in elites]) - vector) ** 2).mean(axis=1))
        if gaps.min() < policy.global_floor:
            return "global_behavioral_distance_floor", False, None
        own = [g for g, e in zip(gaps, elites, strict=True) if e["cell"] == row["cell"]]
        if own and min(own) < policy.local_floor:
            return "within_cell_behavioral_distance_floor", False, None
    newcomer = {"cell": row["cell"], "id": int(row["candidate_id"]), "similarity": float(row["similarity"]), "vector": vector}
    if len(here) < policy.max_elites:
        elites.append(newcomer)
        return "open_elite_slot", True, None
    before = _spread([e["vector"] for e in here])
    options = [
        (_spread([e["vector"] for e in here if e is not old] + [vector]), old["id"], old) for old in here
    ]
    gain, _, out = max(options, key=lambda o: (o[0], o[1]))
    if gain > before + 1e-12:
        elites.remove(out)
        elites.append(newcomer)
        return "maximin_dispersion_improved", True, out["id"]
    return "cell_full_no_dispersion_improvement", False, None


def declared_step(policy: ArchivePolicy, elites: list[dict], row: dict) -> tuple[str, bool, int | None]:
    """As ``attested_step`` for declared descriptors, judged by named neighbour similarities."""
    here = [e for e in elites if e["cell"] == row["cell"]]
    named = dict(zip(row["neighbour_ids"], row["neighbour_scores"], strict=True))
    seen = {e["id"]: named[e["id"]] for e in here if e["id"] in named}
    if len(seen) < len(here):
        return "incomplete_within_cell_neighbor_evidence", False, None
    newcomer = {
        "cell": row["cell"], "id": int(row["candidate_id"]), "similarity": float(row["similarity"]), "vector": np.zeros(0),
    }
    if len(here) < policy.max_elites:
        if max(seen.values(), default=0.0) >= policy.local_similarity_ceiling:
            return "within_cell_similarity_ceiling", False, None
        elites.append(newcomer)
        return "open_elite_slot", True, None
    worst = max(here, key=lambda e: (e["similarity"], e["id"]))
    if row["similarity"] < worst["similarity"]:
        elites.remove(worst)
        elites.append(newcomer)
        return "lower_similarity_replacement", True, worst["id"]
    return "cell_full_no_local_improvement", False, None


_ELITE = "struct<cell:string,id:bigint,similarity:double,vector:array<double>>"
_STATE_SCHEMA = f"campaign_id bigint, from_block bigint, lookahead bigint, elites array<{_ELITE}>"
_OUT_SCHEMA = (
    "campaign_id bigint, block bigint, episode bigint, candidate_id bigint, cell string, reason string,"
    f" admitted boolean, replaced bigint, changed boolean, elites array<{_ELITE}>"
)
_OUT_COLUMNS = [c.split()[0] for c in
    ["campaign_id", "block", "episode", "candidate_id", "cell", "reason", "admitted", "replaced", "changed", "elites"]]


def _load(elites) -> list[dict]:
    if elites is None:
        return []
    return [
        {"cell": e["cell"], "id": int(e["id"]), "similarity": float(e["similarity"]), "vector": np.asarray(e["vector"], dtype=float)}
        for e in elites
    ]


def _dump(elites: list[dict]) -> list[dict]:
    return [{**e, "vector": e["vector"].tolist()} for e in elites]


def archive_fold(
    rows: DataFrame, policy: ArchivePolicy, *, step=attested_step, block_rows: int = 4096, first_lookahead: int = 4
) -> tuple[DataFrame, DataFrame]:
    """Decisions and final elites of every campaign, in episode order.

    ``rows`` has ``campaign_id, episode, candidate_id, cell, similarity, vector``
    (or neighbour lists) plus ``reason``: rows with a reason are settled by plain
    columns and never reach Python.  The rest is cut into blocks of episodes.  In
    each round all blocks a campaign looks ahead to are folded in parallel from
    the same archive; blocks up to and including the first one that changes it
    are final, the others are folded again from the new archive.  Admissions get
    rare as an archive fills, so the look-ahead doubles while nothing changes and
    a campaign that holds a third of all rows still runs as many tasks.  The
    outcome is that of the one-by-one fold.
    """
    spark = rows.sparkSession
    settled = rows.filter("reason IS NOT NULL").select(
        "campaign_id", "episode", "candidate_id", "cell", "reason",
        F.lit(False).alias("admitted"), F.lit(None).cast("bigint").alias("replaced"),
    )
    base = shared_folder(spark, "archive-fold")
    rows.filter("reason IS NULL").drop("reason").withColumn("block", F.floor(F.col("episode") / block_rows)).write.parquet(f"{base}/open")
    open_rows = spark.read.parquet(f"{base}/open")
    ends = open_rows.groupBy("campaign_id").agg(F.min("block").alias("low"), F.max("block").alias("high"))
    ends.select(
        "campaign_id", F.col("low").alias("from_block"), F.lit(first_lookahead).cast("bigint").alias("lookahead"),
        F.array().cast(f"array<{_ELITE}>").alias("elites"), "high",
    ).write.parquet(f"{base}/state-0")

    def fold(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=_OUT_COLUMNS)
        elites = _load(right["elites"].iloc[0])
        changed = False
        out = []
        for row in left.sort_values(["episode", "candidate_id"]).to_dict("records"):
            reason, admitted, replaced = step(policy, elites, row)
            changed = changed or admitted
            out.append([row["campaign_id"], row["block"], row["episode"], row["candidate_id"], row["cell"], reason, admitted, replaced, None, None])
        first = left.iloc[0]
        out.append([first["campaign_id"], first["block"], None, None, None, None, None, None, changed, _dump(elites) if changed else None])
        frame = pd.DataFrame(out, columns=_OUT_COLUMNS)
        for name in ("episode", "candidate_id", "replaced"):
            frame[name] = frame[name].astype("Int64")
        return frame

    rounds = 0
    while True:
        state = spark.read.parquet(f"{base}/state-{rounds}")
        if state.filter("from_block <= high").limit(1).count() == 0:
            break
        todo = state.filter("from_block <= high")
        window = F.sequence(F.col("from_block"), F.least(F.col("high"), F.col("from_block") + F.col("lookahead") - 1))
        asked = todo.select("campaign_id", F.explode(window).alias("block"), "elites")
        # only blocks that hold rows take part; the archive row is small and bounded by policy
        work = open_rows.join(asked.select("campaign_id", "block"), ["campaign_id", "block"], "left_semi")
        folded = (
            work.groupBy("campaign_id", "block")
            .cogroup(asked.groupBy("campaign_id", "block"))
            .applyInPandas(fold, _OUT_SCHEMA)
        )
        folded.write.parquet(f"{base}/round-{rounds}")
        result = spark.read.parquet(f"{base}/round-{rounds}")
        marks = result.filter("changed")
        first = marks.groupBy("campaign_id").agg(
            F.min("block").alias("change_block"), F.min_by("elites", "block").alias("new_elites")
        )
        after = state.join(first, "campaign_id", "left")
        reach = F.col("from_block") + F.col("lookahead")
        active = F.col("from_block") <= F.col("high")
        after.select(
            "campaign_id",
            F.when(~active, F.col("from_block")).when(F.col("change_block").isNotNull(), F.col("change_block") + 1).otherwise(reach).alias("from_block"),
            F.when(F.col("change_block").isNotNull(), F.lit(first_lookahead).cast("bigint")).otherwise(F.col("lookahead") * 2).alias("lookahead"),
            F.coalesce("new_elites", "elites").alias("elites"),
            "high",
        ).write.parquet(f"{base}/state-{rounds + 1}")
        (
            result.filter("changed IS NULL")
            .join(first.select("campaign_id", "change_block"), "campaign_id", "left")
            .filter("change_block IS NULL OR block <= change_block")
            .select("campaign_id", "episode", "candidate_id", "cell", "reason", "admitted", "replaced")
            .write.mode("append").parquet(f"{base}/decisions")
        )
        rounds += 1
    if rounds:
        decided = settled.unionByName(spark.read.parquet(f"{base}/decisions"))
    else:
        decided = settled
    final = spark.read.parquet(f"{base}/state-{rounds}").select("campaign_id", F.inline("elites"))
    return decided, final


def fold_in_order(policy: ArchivePolicy, step=attested_step):
    """A plain one-by-one fold over sorted rows; the yardstick of the tests and of the stream."""

    def run(elites: list[dict], rows: Iterator[dict]) -> list[tuple]:
        return [(row["candidate_id"], *step(policy, elites, row)) for row in rows]

    return run
