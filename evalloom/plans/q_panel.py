"""Panel queries bound to the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom import views as v
from evalloom.operators import panel as P
from evalloom.registry import query
from evalloom.session import literal_table

T = v.HARD_THRESHOLD

_VERDICT_SQL = f"""SELECT candidate, count(*) AS evaluators, bool_and(accuracy < {T}) AS hard_all_below,
    bool_or(accuracy < {T}) AS hard_any_below, count(*) FILTER (accuracy <= {T}) * 2 > count(*) AS hard_majority,
    list_reduce(list(accuracy ORDER BY evaluator), lambda a, b: a + b) / count(*) AS mean_accuracy,
    list_reduce(list(accuracy ORDER BY evaluator), lambda a, b: a + b) / count(*) < {T} AS hard_mean
    FROM v_panel GROUP BY candidate"""


@query("panel_verdict", views=("v_panel",), sql=_VERDICT_SQL)
def panel_verdict(spark, d):
    return P.panel_verdict(v.v_panel(spark, d), "candidate", "evaluator", "accuracy", T)


@query(
    "panel_report",
    views=("v_panel",),
    sql=f"""WITH x AS ({_VERDICT_SQL}), c AS (SELECT sample_key AS candidate, round(sum(cost), 6) AS cost
        FROM v_ledger GROUP BY 1) SELECT x.*, cost FROM x JOIN c USING (candidate) WHERE hard_majority""",
)
def panel_report(spark, d):
    costs = (
        v.v_ledger(spark, d)
        .groupBy(F.col("sample_key").alias("candidate"))
        .agg(F.round(F.sum("cost"), 6).alias("cost"))
    )
    return P.panel_report(v.v_panel(spark, d), costs, T)


@query(
    "hardest_first",
    views=("v_panel",),
    sql="SELECT candidate, evaluator, accuracy FROM v_panel",
)
def hardest_first(spark, d):
    return P.hardest_first(v.v_panel(spark, d), "accuracy", "candidate", "evaluator").select(
        "candidate", "evaluator", "accuracy"
    )


@query(
    "hardest_top10",
    views=("v_panel",),
    sql="SELECT candidate, evaluator, accuracy FROM v_panel ORDER BY accuracy, candidate DESC, evaluator LIMIT 10",
)
def hardest_top10(spark, d):
    return hardest_first(spark, d).limit(10)


@query(
    "sample_by_evaluator_grid",
    views=("v_ledger",),
    sql="""WITH e AS (SELECT unnest(['m0', 'm1', 'm2', 'm3']) AS evaluator),
    s AS (SELECT DISTINCT sample_key FROM v_ledger),
    t AS (SELECT sample_key, evaluator, arg_max(status, seq) AS status,
        arg_max(correct, seq) AS correct FROM v_ledger
        WHERE status IN ('scored', 'unparseable', 'refused') GROUP BY ALL)
    SELECT sample_key, evaluator, coalesce(status, 'missing') AS status, correct
    FROM s CROSS JOIN e LEFT JOIN t USING (sample_key, evaluator)""",
)
def sample_by_evaluator_grid(spark, d):
    ledger = v.v_ledger(spark, d)
    panel = F.array(*[F.lit(f"m{i}") for i in range(4)])
    return P.sample_by_evaluator_grid(ledger.select("sample_key").distinct(), panel, ledger, ["correct"])


@query(
    "feedback_summary",
    views=("v_ledger",),
    sql="""SELECT evaluator, count(*) AS responses, count(*) FILTER (status = 'scored') AS scored_samples,
        count(*) FILTER (correct) AS correct_samples,
        count(*) FILTER (correct) / count(*) FILTER (status = 'scored') AS accuracy,
        count(*) FILTER (status = 'unparseable') AS unparseable, count(*) FILTER (status = 'api_error') AS api_error,
        count(*) FILTER (status = 'attempt_started') AS started FROM v_ledger GROUP BY ROLLUP (evaluator)""",
)
def feedback_summary(spark, d):
    response = F.struct("evaluator", "status", "correct")
    nested = v.v_ledger(spark, d).select(
        F.array(F.struct(F.col("event_id").alias("sample_id"), F.array(response).alias("responses"))).alias(
            "sample_responses"
        )
    )
    return P.feedback_summary(nested)


@query(
    "feedback_totals",
    views=("v_panel",),
    sql=f"""WITH x AS ({_VERDICT_SQL}), s AS (SELECT candidate, sum(scored) AS n FROM v_panel GROUP BY 1)
    SELECT count(*) AS evaluated, count(*) FILTER (n >= 20 AND hard_majority) AS hard_seed,
        count(*) FILTER (n >= 20 AND NOT hard_majority) AS valid_not_hard, count(*) FILTER (n < 20) AS incomplete,
        round(avg(mean_accuracy) FILTER (n >= 20), 9) AS mean_candidate_accuracy FROM x JOIN s USING (candidate)""",
)
def feedback_totals(spark, d):
    panel = v.v_panel(spark, d)
    scored = panel.groupBy("candidate").agg((F.sum("scored") >= 20).alias("complete"))
    verdict = P.panel_verdict(panel, "candidate", "evaluator", "accuracy", T)
    return P.feedback_totals(verdict.withColumnRenamed("hard_majority", "hard").join(scored, "candidate"))


@query(
    "feedback_reconcile",
    views=("v_ledger",),
    sql="""SELECT evaluator, count(*) AS evaluated, count(*) FILTER (plan_no <> 0) AS fresh,
        count(*) FILTER (plan_no = 0) AS bootstrapped, round(sum(cost) FILTER (plan_no <> 0), 6) AS cost_usd,
        round(sum(cost) FILTER (plan_no = 0), 6) AS bootstrap_cost_usd, evaluator <> 'm1' AS count_match,
        evaluator <> 'm2' AS cost_match, evaluator = 'm0' AS passed FROM v_ledger GROUP BY evaluator""",
)
def feedback_reconcile(spark, d):
    rows = v.v_ledger(spark, d).withColumn("bootstrap", F.col("plan_no") == 0)
    # the stored state: one count too many for m1, one cent too much for m2
    state = rows.groupBy("evaluator").agg(
        (F.count(F.lit(1)) + F.when(F.col("evaluator") == "m1", 1).otherwise(0)).alias("state_count"),
        (
            F.round(P.exact_sum(F.when(F.col("plan_no") != 0, F.col("cost"))), 9)
            + F.when(F.col("evaluator") == "m2", 0.01).otherwise(0.0)
        ).alias("state_cost"),
    )
    return P.feedback_reconcile(rows, state, "evaluator")


@query(
    "request_bound",
    views=("v_panel",),
    sql="""SELECT target, count(DISTINCT candidate) AS candidates, count(DISTINCT evaluator) AS evaluators,
        count(DISTINCT candidate) * count(DISTINCT evaluator) * 5 * 3 AS maximum_requests FROM v_panel GROUP BY 1""",
)
def request_bound(spark, d):
    return P.request_bound(v.v_panel(spark, d), "target", 5, 2)


_COMPLETE_SQL = f"""x AS ({_VERDICT_SQL}),
    r AS (SELECT candidate, candidate AS episode, candidate % 3 AS target, mean_accuracy AS accuracy, n >= 20 AS complete
        FROM x JOIN (SELECT candidate, sum(scored) AS n FROM v_panel GROUP BY 1) USING (candidate))"""


def _episode_rows(spark, d):
    panel = v.v_panel(spark, d)
    scored = panel.groupBy("candidate").agg((F.sum("scored") >= 20).alias("complete"))
    verdict = P.panel_verdict(panel, "candidate", "evaluator", "accuracy", T)
    return verdict.join(scored, "candidate").select(
        "candidate",
        F.col("candidate").alias("episode"),
        (F.col("candidate") % 3).alias("target"),
        F.col("mean_accuracy").alias("accuracy"),
        "complete",
    )


@query(
    "branch_assignment",
    views=("v_panel",),
    sql=f"""WITH {_COMPLETE_SQL}
    SELECT e.candidate, e.episode, (e.episode + 2) % 3 AS target,
        coalesce(CAST((SELECT p.candidate FROM r p WHERE p.complete AND p.target = (e.episode + 2) % 3
            AND p.episode < e.episode ORDER BY p.accuracy, p.episode DESC, p.candidate LIMIT 1) AS VARCHAR),
            'initial_profile') AS parent FROM r e""",
)
def branch_assignment(spark, d):
    return P.branch_assignment(_episode_rows(spark, d), 3, F.expr("episode div 100000"))


@query(
    "memory_bank",
    views=("v_panel",),
    sql=f"""WITH {_COMPLETE_SQL},
    h AS (SELECT *, row_number() OVER (ORDER BY accuracy, episode DESC, CAST(candidate AS VARCHAR)) AS hr,
          row_number() OVER (ORDER BY episode DESC, CAST(candidate AS VARCHAR)) AS nr FROM r WHERE complete),
    c AS (SELECT candidate, episode, accuracy FROM h ORDER BY CASE WHEN hr <= 6 THEN hr ELSE 6 + nr END LIMIT 11),
    s AS (SELECT sample_key AS candidate, attempt_id AS sample_id, bool_or(status = 'scored' AND NOT correct) AS missed
          FROM v_ledger GROUP BY ALL)
    SELECT candidate, episode, accuracy, sample_id, missed, CAST(rank AS INTEGER) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY NOT missed, CAST(sample_id AS VARCHAR)) AS rank
        FROM c JOIN s USING (candidate)) WHERE rank <= 3""",
)
def memory_bank(spark, d):
    samples = v.v_ledger(spark, d).select(
        F.col("sample_key").alias("candidate"),
        F.col("attempt_id").alias("sample_id"),
        ((F.col("status") == "scored") & ~F.col("correct")).alias("missed"),
    )
    return P.memory_bank(_episode_rows(spark, d).filter("complete"), samples, limit=11, samples_per_row=3)


@query(
    "bootstrap_join",
    views=("v_panel",),
    sql=f"""WITH {_COMPLETE_SQL},
    q AS (SELECT candidate, CASE WHEN candidate % 7 = 0 THEN NULL ELSE sha256(CAST(candidate AS VARCHAR)) END AS actual,
        'p' || (candidate % 4) AS rp, complete, accuracy > 0.3 AS pv FROM r)
    SELECT candidate, CASE WHEN actual IS NULL THEN 'hash_mismatch'
        WHEN rp NOT IN ('p0', 'p1') THEN 'policy_incompatible' WHEN NOT complete THEN 'not_complete'
        WHEN NOT pv THEN 'not_protected_valid' ELSE 'ok' END AS verdict FROM q""",
)
def bootstrap_join(spark, d):
    rows = _episode_rows(spark, d)
    sha = F.sha2(F.col("candidate").cast("string"), 256)
    manifest = rows.select(
        "candidate", sha.alias("candidate_sha"), F.lit("p1").alias("policy"), F.lit(1).alias("copies")
    )
    results = rows.select(
        "candidate",
        F.concat(F.lit("p"), (F.col("candidate") % 4).cast("string")).alias("result_policy"),
        F.when(F.col("complete"), "complete").otherwise("incomplete").alias("status"),
        (F.col("accuracy") > 0.3).alias("protected_valid"),
    )
    digests = rows.filter(F.col("candidate") % 7 != 0).select("candidate", sha.alias("actual_sha"))
    forward = literal_table(spark, [("p0", "p1")], ["source_policy", "target_policy"])
    return P.bootstrap_join(manifest, results, digests, forward)
