"""Archive queries bound to the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom import views as v
from evalloom.operators import archive as A
from evalloom.registry import query

CELLS = tuple(f"c{i}" for i in range(9))
POLICY = A.ArchivePolicy(cells=CELLS[:8], similarity_ceiling=0.30, stability_floor=0.70, global_floor=0.08, local_floor=0.09)
SEED = 7


def candidates(spark, d):
    """Candidates with the fields the admission rules read."""
    return v.v_vec(spark, d).select(
        "*",
        (F.col("episode") % 11 != 0).alias("attested"),
        F.when(F.col("episode") % 13 != 0, F.col("similarity")).alias("error_fraction"),
        F.concat(F.lit("c"), ((F.col("episode") * 7 + F.col("campaign_id")) % 9).cast("string")).alias("target"),
    )


_CAND = """cand AS (SELECT *, episode % 11 <> 0 AS attested, CASE WHEN episode % 13 <> 0 THEN similarity END AS error_fraction,
    'c' || ((episode * 7 + campaign_id) % 9) AS target FROM v_vec)"""


@query(
    "admission_rules",
    views=("v_vec",),
    sql=f"""WITH {_CAND} SELECT candidate_id, CASE WHEN NOT valid THEN 'protected_invalid'
        WHEN NOT attested THEN 'descriptor_attestation_incomplete' WHEN cell = 'c8' THEN 'outside_prespecified_feasible_mask'
        WHEN similarity >= 0.30 THEN 'global_semantic_similarity_ceiling'
        WHEN error_fraction IS NULL THEN 'descriptor_attestation_invalid'
        WHEN stability < 0.70 THEN 'descriptor_instability_floor' END AS reason FROM cand""",
)
def admission_rules(spark, d):
    return candidates(spark, d).select("candidate_id", A.admission_reason(POLICY).alias("reason"))


def decisions(spark, d):
    """Decisions of a plain archive: valid rows of low similarity are admitted."""
    return candidates(spark, d).select(
        "campaign_id", "target", "cell", "episode",
        (F.col("valid") & (F.col("cell") == F.col("target"))).alias("matched"),
        (F.col("valid") & (F.col("similarity") < 0.1)).alias("admitted"),
        F.col("valid").alias("observed"),
    )


_DEC = f"""{_CAND}, dec AS (SELECT campaign_id, target, cell, episode, valid AND cell = target AS matched,
    valid AND similarity < 0.1 AS admitted, valid AS observed FROM cand),
    lm AS (SELECT campaign_id, target, max(episode) AS last FROM dec WHERE matched GROUP BY ALL),
    ob AS (SELECT campaign_id, target, string_agg(cell || '=' || n, ',' ORDER BY cell) AS observed_cells FROM
        (SELECT campaign_id, target, cell, count(*) AS n FROM dec WHERE observed GROUP BY ALL) GROUP BY ALL),
    st AS (SELECT campaign_id, target, count(*) AS selected_count, count(*) FILTER (matched) AS match_count,
        count(*) FILTER (admitted) AS admission_count, count(*) FILTER (last IS NULL OR episode > last) AS consecutive_misses,
        max(episode) AS last_selected_episode FROM dec LEFT JOIN lm USING (campaign_id, target) GROUP BY ALL)"""


@query(
    "target_statistics",
    views=("v_vec",),
    sql=f"WITH {_DEC} SELECT st.*, coalesce(observed_cells, '') AS observed_cells FROM st LEFT JOIN ob USING (campaign_id, target)",
)
def target_statistics(spark, d):
    return A.target_statistics(decisions(spark, d), ["campaign_id"], "target")


_SCORES = f"""{_DEC}, gr AS (SELECT * FROM (SELECT DISTINCT campaign_id FROM dec), (SELECT unnest({list(CELLS)}) AS cell)),
    oc AS (SELECT campaign_id, cell, least(count(*), 3) AS n FROM dec WHERE admitted GROUP BY ALL),
    nx AS (SELECT campaign_id, max(episode) + 1 AS episode_index FROM dec GROUP BY 1),
    x AS (SELECT gr.campaign_id, gr.cell, coalesce(oc.n, 0) AS occupancy, coalesce(selected_count, 0) AS completed,
        coalesce(match_count, 0) AS matched, coalesce(consecutive_misses, 0) AS consecutive_misses, last_selected_episode,
        episode_index FROM gr LEFT JOIN oc USING (campaign_id, cell) LEFT JOIN st ON st.campaign_id = gr.campaign_id
        AND st.target = gr.cell JOIN nx ON nx.campaign_id = gr.campaign_id),
    sc AS (SELECT *, coalesce(episode_index - last_selected_episode <= 3, false) AS cooldown_active,
        0.5::DOUBLE * (1.0::DOUBLE / (occupancy + 1)) + 0.3::DOUBLE * ((matched + 1.0::DOUBLE) / (completed + 2.0::DOUBLE))
        + 0.2::DOUBLE * (1.0::DOUBLE / sqrt(completed + 1)) - 0.25::DOUBLE * (least(3, consecutive_misses) / 3)
        - CASE WHEN coalesce(episode_index - last_selected_episode <= 3, false) THEN 1 ELSE 0 END AS score FROM x)"""


def _scores(spark, d):
    dec = decisions(spark, d)
    stats = A.target_statistics(dec, ["campaign_id"], "target").withColumnRenamed("target", "cell")
    grid = dec.groupBy("campaign_id").agg((F.max("episode") + 1).alias("episode_index"))
    grid = grid.select("*", F.explode(F.array(*[F.lit(c) for c in CELLS])).alias("cell"))
    occupied = dec.filter("admitted").groupBy("campaign_id", "cell").agg(F.least(F.count(F.lit(1)), F.lit(3)).alias("occupancy"))
    full = (
        grid.join(occupied, ["campaign_id", "cell"], "left")
        .join(stats, ["campaign_id", "cell"], "left")
        .withColumnsRenamed({"selected_count": "completed", "match_count": "matched"})
        .na.fill(0, ["occupancy", "completed", "matched", "consecutive_misses"])
    )
    return A.target_scores(full, coverage=0.5, feasibility=0.3, exploration=0.2, penalty=0.25, cooldown=3)


@query(
    "target_scores",
    views=("v_vec",),
    sql=f"WITH {_SCORES} SELECT campaign_id, cell, occupancy, cooldown_active, round(score, 9) AS score FROM sc",
)
def target_scores(spark, d):
    return _scores(spark, d).select("campaign_id", "cell", "occupancy", "cooldown_active", F.round("score", 9).alias("score"))


@query(
    "select_target",
    views=("v_vec",),
    sql=f"""WITH {_SCORES}, r AS (SELECT *, sha256('{SEED}' || chr(0) || episode_index || chr(0) || cell) AS rank FROM sc)
    SELECT campaign_id, arg_max(cell, (round(score, 12), rank)) AS adaptive_target, round(max(score), 6) AS score,
        arg_min(cell, (occupancy, rank)) AS coverage_target FROM r GROUP BY 1""",
)
def select_target(spark, d):
    return A.select_target(_scores(spark, d), ["campaign_id"], SEED)


def elites(spark, d):
    return A.first_elites(v.v_vec(spark, d).filter("valid"), ["campaign_id"], "cell", "episode", POLICY.max_elites)


_EL = """el AS (SELECT * FROM v_vec WHERE valid QUALIFY row_number() OVER (PARTITION BY campaign_id, cell ORDER BY episode) <= 3)"""
_MP = f"""{_EL}, mp AS (SELECT a.campaign_id, a.cell, min(list_distance(a.vector, b.vector) / 8) AS d FROM el a JOIN el b
    ON a.campaign_id = b.campaign_id AND a.cell = b.cell AND a.candidate_id < b.candidate_id GROUP BY ALL),
    sz AS (SELECT campaign_id, cell, count(*) AS elites FROM el GROUP BY ALL)"""


@query(
    "min_pairwise_distance",
    views=("v_vec",),
    sql=f"""WITH {_MP} SELECT campaign_id, cell, elites, round(coalesce(d, 1.0), 9) AS min_distance FROM sz LEFT JOIN mp
        USING (campaign_id, cell)""",
)
def min_pairwise_distance(spark, d):
    return A.min_pairwise_distance(elites(spark, d), ["campaign_id", "cell"], "candidate_id")


@query(
    "nearest_elite",
    views=("v_vec",),
    sql=f"""WITH {_EL}, p AS (SELECT c.candidate_id, e.cell = c.cell AS own, list_distance(c.vector, e.vector) / 8 AS d
        FROM v_vec c JOIN el e ON c.campaign_id = e.campaign_id AND c.candidate_id <> e.candidate_id)
    SELECT c.candidate_id, round(coalesce(min(d), 1.0), 9) AS global_distance,
        round(coalesce(min(d) FILTER (own), 1.0), 9) AS local_distance FROM v_vec c LEFT JOIN p USING (candidate_id) GROUP BY 1""",
)
def nearest_elite(spark, d):
    return A.nearest_elite(v.v_vec(spark, d), elites(spark, d), ["campaign_id"], "candidate_id")


@query(
    "worst_elite",
    views=("v_vec",),
    sql=f"""WITH {_EL} SELECT campaign_id, cell, count(*) AS elites, arg_max(candidate_id, (similarity, candidate_id)) AS worst
        FROM el GROUP BY ALL""",
)
def worst_elite(spark, d):
    return A.worst_elite(elites(spark, d), ["campaign_id", "cell"], "candidate_id")


_SUM = f"""{_MP}, sm AS (SELECT g.campaign_id, g.cell, coalesce(elites, 0) AS occupancy,
    CASE WHEN elites >= 2 THEN round(d, 9) END AS min_distance FROM (SELECT * FROM (SELECT DISTINCT campaign_id FROM v_vec),
    (SELECT unnest({list(CELLS)}) AS cell)) g LEFT JOIN sz USING (campaign_id, cell) LEFT JOIN mp USING (campaign_id, cell))"""


def _summary(spark, d):
    archives = v.v_vec(spark, d).select("campaign_id").distinct()
    return A.archive_summary(elites(spark, d), archives, ["campaign_id"], list(CELLS), "candidate_id")


@query("archive_summary", views=("v_vec",), sql=f"WITH {_SUM} SELECT * FROM sm")
def archive_summary(spark, d):
    return _summary(spark, d)


@query(
    "archive_coverage",
    views=("v_vec",),
    sql=f"""WITH {_SUM} SELECT campaign_id, count(*) AS feasible_cells, count(*) FILTER (occupancy > 0) AS occupied_cells,
        count(*) FILTER (occupancy > 0) / count(*) AS coverage, CAST(sum(occupancy) AS BIGINT) AS elites FROM sm GROUP BY 1""",
)
def archive_coverage(spark, d):
    return A.coverage(_summary(spark, d), ["campaign_id"])


@query(
    "occupied_cells_to_avoid",
    views=("v_vec",),
    sql=f"WITH {_SUM} SELECT campaign_id, cell, occupancy FROM sm WHERE occupancy > 0 AND cell <> 'c3'",
)
def occupied_cells_to_avoid(spark, d):
    return A.occupied_cells_to_avoid(_summary(spark, d), "c3").select("campaign_id", "cell", "occupancy")


def fold_input(spark, d):
    return candidates(spark, d).select(
        "campaign_id", "episode", "candidate_id", "cell", "similarity", "vector", A.admission_reason(POLICY).alias("reason")
    )


@query("archive_fold", views=())
def archive_fold(spark, d):
    return A.archive_fold(fold_input(spark, d), POLICY)[0]


@query("archive_fold_elites", views=())
def archive_fold_elites(spark, d):
    return A.archive_fold(fold_input(spark, d), POLICY)[1].select("campaign_id", "cell", "id", "similarity")


def declared_input(spark, d):
    """Candidates that name the similarity to the two rows before them of their campaign and cell."""
    from evalloom.plans.scan import neighbour

    rows = candidates(spark, d)
    bucket = F.expr("episode div 100000")
    once = neighbour(rows, ["campaign_id", "cell"], ["episode"], bucket, ["candidate_id"])
    twice = neighbour(once, ["campaign_id", "cell"], ["episode"], bucket, ["prev_candidate_id"])
    ids = F.array_compact(F.array("prev_candidate_id", "prev_prev_candidate_id"))
    reason = (
        F.when(~F.col("valid"), "protected_invalid")
        .when(~F.col("cell").isin(*POLICY.cells), "outside_prespecified_feasible_mask")
        .when(F.col("similarity") >= POLICY.similarity_ceiling, "global_semantic_similarity_ceiling")
    )
    return twice.select(
        "campaign_id", "episode", "candidate_id", "cell", "similarity",
        ids.alias("neighbour_ids"),
        F.transform(ids, lambda _: F.col("similarity")).alias("neighbour_scores"),
        reason.alias("reason"),
    )


@query("archive_fold_declared", views=())
def archive_fold_declared(spark, d):
    return A.archive_fold(declared_input(spark, d), POLICY, step=A.declared_step)[0]
