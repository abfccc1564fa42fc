"""Ledger queries bound to the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom import views as v
from evalloom.operators import ledger as L
from evalloom.registry import query

# events per ordered bucket of a scan; see evalloom.plans.scan
SPAN = 1_000_000


def bucket():
    return F.expr(f"event_id div {SPAN}")


@query(
    "latest_status",
    views=("v_ledger",),
    sql="SELECT sample_key, arg_max(status, seq) AS status FROM v_ledger GROUP BY sample_key",
)
def latest_status(spark, d):
    return L.latest_status(v.v_ledger(spark, d), ["sample_key"])


@query(
    "event_summary",
    views=("v_ledger",),
    sql="""
    WITH s AS (SELECT evaluator, sample_key, arg_max(status, seq) AS last,
        coalesce(arg_max(correct, seq) FILTER (status = 'scored'), false) AS c,
        bool_or(status = 'scored') AS sc, count(completion_tokens) AS ur, sum(completion_tokens) AS ct,
        sum(completion_tokens + seq % 7) AS pt, sum(2 * completion_tokens + seq % 7) AS tt,
        sum(coalesce(reasoning_tokens, CASE WHEN completion_tokens % 2 = 0 THEN completion_tokens // 3 END)) AS rt, sum(cost) AS cost FROM v_ledger GROUP BY ALL)
    SELECT evaluator, CAST(sum(pt) AS BIGINT) AS prompt_tokens, CAST(sum(tt) AS BIGINT) AS total_tokens, count(*) AS attempted_samples,
        count(*) FILTER (last = 'scored') AS latest_scored,
        count(*) FILTER (last = 'unparseable') AS latest_unparseable,
        count(*) FILTER (last = 'api_error') AS latest_api_error,
        count(*) FILTER (last = 'attempt_started') AS latest_started,
        count(*) FILTER (sc) AS scored_samples, count(*) FILTER (sc AND c) AS correct_samples,
        count(*) FILTER (sc AND c) / count(*) FILTER (sc) AS accuracy,
        CAST(sum(ur) AS BIGINT) AS usage_records, CAST(sum(ct) AS BIGINT) AS completion_tokens,
        CAST(coalesce(sum(rt), 0) AS BIGINT) AS reasoning_tokens, round(sum(cost), 6) AS cost
    FROM s GROUP BY evaluator""",
)
def event_summary(spark, d):
    events = v.v_ledger(spark, d).withColumn("prompt_tokens", F.expr("completion_tokens + seq % 7")).withColumn("total_tokens", F.expr("prompt_tokens + completion_tokens"))
    nested = F.when(F.col("completion_tokens") % 2 == 0, F.expr("completion_tokens div 3"))
    return L.event_summary(events, ["evaluator"], usage=("prompt_tokens", "completion_tokens", "total_tokens"), nested=nested)


@query(
    "status_pivot",
    views=("v_ledger",),
    sql="""SELECT evaluator, count(*) FILTER (status = 'attempt_started') AS attempt_started,
        count(*) FILTER (status = 'scored') AS scored, count(*) FILTER (status = 'unparseable') AS unparseable,
        count(*) FILTER (status = 'api_error') AS api_error FROM v_ledger GROUP BY evaluator""",
)
def status_pivot(spark, d):
    return L.status_pivot(v.v_ledger(spark, d), "evaluator", v.STATUSES)


@query(
    "latest_terminal",
    views=("v_ledger",),
    sql="""SELECT sample_key, evaluator, status, correct, event_id FROM v_ledger
        WHERE status IN ('scored', 'unparseable', 'refused')
        QUALIFY row_number() OVER (PARTITION BY sample_key, evaluator ORDER BY seq DESC) = 1""",
)
def latest_terminal(spark, d):
    return L.latest_terminal(v.v_ledger(spark, d), ["sample_key", "evaluator"], ["status", "correct", "event_id"])


def _ledger_of_examples(spark, d):
    """Ledger events whose sample is a document: user ids double as document ids."""
    ledger = v.v_ledger(spark, d).withColumnRenamed("sample_key", "doc_id")
    return ledger.select("doc_id", "status", "seq")


_OPEN_SQL = """
    WITH last AS (SELECT sample_key, arg_max(status, seq) AS status FROM v_ledger GROUP BY 1)
    SELECT doc_id, dataset_id FROM v_examples e WHERE NOT EXISTS (
        SELECT 1 FROM last l WHERE l.sample_key = e.doc_id {cond})"""


@query("remaining_examples", views=("v_examples", "v_ledger"), sql=_OPEN_SQL.format(cond=""))
def remaining_examples(spark, d):
    examples = v.v_examples(spark, d).select("doc_id", "dataset_id")
    return L.remaining_examples(examples, _ledger_of_examples(spark, d), "doc_id", retry_errors=False)


@query(
    "remaining_examples_retry",
    views=("v_examples", "v_ledger"),
    sql=_OPEN_SQL.format(cond="AND l.status NOT IN ('attempt_started', 'api_error')"),
)
def remaining_examples_retry(spark, d):
    examples = v.v_examples(spark, d).select("doc_id", "dataset_id")
    return L.remaining_examples(examples, _ledger_of_examples(spark, d), "doc_id", retry_errors=True)


@query(
    "pending_plan",
    views=("v_ledger",),
    sql="""
    WITH last AS (SELECT sample_key, arg_max(status, seq) AS status FROM v_ledger GROUP BY 1),
    plans AS (SELECT DISTINCT plan_no, sample_key FROM v_ledger)
    SELECT plan_no, count(*) AS open_samples FROM plans JOIN last USING (sample_key)
    WHERE status IN ('attempt_started', 'api_error') GROUP BY plan_no ORDER BY plan_no LIMIT 1""",
)
def pending_plan(spark, d):
    ledger = v.v_ledger(spark, d)
    plans = ledger.select("plan_no", "sample_key").distinct()
    return L.pending_plan(plans, ledger, retry_errors=True)


@query(
    "batch_completeness",
    views=("v_ledger",),
    sql="""
    WITH s AS (SELECT attempt_id % 50 AS plan, evaluator, sample_key, arg_max(status, seq) AS last,
        bool_or(status = 'scored') AS sc, coalesce(arg_max(cost IS NOT NULL, seq)
        FILTER (status IN ('scored', 'unparseable', 'refused')), false) AS priced FROM v_ledger GROUP BY ALL)
    SELECT plan, evaluator, count(*) AS selected, count(*) FILTER (sc) AS scored_samples,
        count(*) FILTER (priced) AS cost_records, bool_and(sc) AND bool_and(last = 'scored') AS all_scored,
        bool_and(sc) AND bool_and(last = 'scored') AND count(*) FILTER (priced) = count(*) AS complete
    FROM s GROUP BY plan, evaluator""",
)
def batch_completeness(spark, d):
    ledger = v.v_ledger(spark, d).withColumn("plan", F.col("attempt_id") % 50)
    return L.batch_completeness(ledger, ["plan", "evaluator"])


@query(
    "run_reconcile",
    views=("v_ledger",),
    sql="""SELECT plan_no, CAST(sum(coalesce(completion_tokens, 0) + event_id % 7) AS BIGINT) AS input_tokens,
        CAST(sum(CASE WHEN event_id % 4 = 0 THEN 0 ELSE event_id % 11 END) AS BIGINT) AS cache_read_input_tokens,
        count(*) AS episodes, CAST(sum(coalesce(completion_tokens, 0)) AS BIGINT) AS output_tokens,
        CAST(sum(coalesce(reasoning_tokens, 0)) AS BIGINT) AS reasoning_output_tokens,
        CAST(sum(episode % 3) AS BIGINT) AS provider_turns, round(sum(cost), 6) AS cost_usd,
        plan_no <> 2 AS episodes_match, plan_no NOT IN (2, 3) AS turns_match, plan_no NOT IN (2, 4) AS cost_match,
        plan_no NOT IN (2, 3, 4) AS passed FROM v_ledger GROUP BY plan_no""",
)
def run_reconcile(spark, d):
    records = v.v_ledger(spark, d).withColumn("num_turns", F.col("episode") % 3).withColumn("input_tokens", F.expr("coalesce(completion_tokens, 0) + event_id % 7"))
    records = records.withColumn("cache_read_input_tokens", F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 11))
    # the stored state, with a drift in two runs that the check must find, and without one run
    state = records.groupBy("plan_no").agg(
        F.count(F.lit(1)).alias("state_episodes"),
        (F.sum("num_turns") + F.when(F.col("plan_no") == 3, 1).otherwise(0)).alias("state_turns"),
        (F.round(F.sum("cost"), 9) + F.when(F.col("plan_no") == 4, 0.01).otherwise(0.0)).alias("state_cost"),
    )
    return L.run_reconcile(records, state.filter("plan_no <> 2"), "plan_no")


def _dispositions(spark, d):
    ledger = v.v_ledger(spark, d)
    exception = F.when(F.col("status") == "api_error", "ProviderError").when(
        F.col("status") == "attempt_started", "AgentTimeoutError"
    )
    return ledger.select(
        "event_id",
        L.disposition(F.col("correct"), exception, F.col("completion_tokens") % 2 == 0).alias("disposition"),
    )


_DISPOSITION_SQL = """SELECT event_id, CASE WHEN correct THEN 'complete'
    WHEN status = 'attempt_started' THEN 'budget-incomplete'
    WHEN status = 'api_error' OR completion_tokens % 2 <> 0 THEN 'infra-fail'
    ELSE 'scientific-fail' END AS disposition FROM v_ledger"""


@query("disposition", views=("v_ledger",), sql=_DISPOSITION_SQL)
def disposition(spark, d):
    return _dispositions(spark, d)


@query(
    "disposition_counts",
    views=("v_ledger",),
    sql=f"""WITH x AS ({_DISPOSITION_SQL})
    SELECT c.disposition, count(x.disposition) AS n FROM
    (VALUES ('complete'), ('scientific-fail'), ('infra-fail'), ('budget-incomplete')) c(disposition)
    LEFT JOIN x USING (disposition) GROUP BY 1""",
)
def disposition_counts(spark, d):
    return L.disposition_counts(_dispositions(spark, d))


@query(
    "budget_assessment",
    views=("v_ledger",),
    sql="""WITH u AS (SELECT sample_key, sum(cost) AS used, max(status) AS stop_reason,
        count(*) FILTER (status = 'api_error' AND completion_tokens < 20) AS infra,
        count(*) FILTER (status = 'unparseable' AND completion_tokens < 5) AS dev FROM v_ledger GROUP BY 1)
    SELECT sample_key, round(used, 6) AS used, round(greatest(0.0, 3000.0 - used), 6) AS remaining,
        round(least(used / 3000, 1.0), 6) AS utilisation, greatest(0.0, 3000.0 - used) < 60 AS budget_fulfilled,
        greatest(0.0, 3000.0 - used) < 60 AND stop_reason <> 'api_error' AND infra = 0 AND dev = 0
        AS comparison_eligible FROM u""",
)
def budget_assessment(spark, d):
    usage = v.v_ledger(spark, d).select(
        "sample_key",
        F.col("cost").alias("seconds"),
        F.col("status").alias("stop_reason"),
        ((F.col("status") == "api_error") & (F.col("completion_tokens") < 20)).alias("infrastructure"),
        ((F.col("status") == "unparseable") & (F.col("completion_tokens") < 5)).alias("deviation"),
    )
    return L.budget_assessment(usage, "sample_key", budget=3000.0, minimum_start=60.0, blocking=["api_error"])


@query(
    "identity_check",
    views=("v_ledger",),
    sql="SELECT DISTINCT evaluator FROM v_ledger WHERE evaluator NOT IN ('m0', 'm1')",
)
def identity_check(spark, d):
    return L.identity_check(v.v_ledger(spark, d), ["m0", "m1"], "evaluator")


@query(
    "confidence_histogram",
    views=("v_ledger",),
    sql="""SELECT evaluator, CASE WHEN completion_tokens >= 50 THEN 'high' ELSE 'low' END AS confidence,
        count(*) AS n FROM v_ledger GROUP BY ALL""",
)
def confidence_histogram(spark, d):
    confidence = F.when(F.col("completion_tokens") >= 50, "high").otherwise("low")
    return v.v_ledger(spark, d).groupBy("evaluator", confidence.alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "final_usage",
    views=("v_ledger",),
    sql="""WITH m AS (SELECT sample_key, attempt_id, arg_max(completion_tokens, seq) AS t FROM v_ledger GROUP BY ALL),
    s AS (SELECT sample_key, CAST(sum(t) AS BIGINT) AS messages_total FROM m GROUP BY 1),
    r AS (SELECT sample_key, arg_max(completion_tokens, seq) AS result_tokens FROM v_ledger
          WHERE status = 'scored' AND completion_tokens >= 95 GROUP BY 1)
    SELECT s.sample_key, messages_total, result_tokens, coalesce(result_tokens, messages_total) AS final_tokens
    FROM s LEFT JOIN r USING (sample_key)""",
)
def final_usage(spark, d):
    is_result = (F.col("status") == "scored") & (F.col("completion_tokens") >= 95)
    return L.final_usage(v.v_ledger(spark, d), "sample_key", "attempt_id", "seq", is_result)


@query(
    "first_seen_claim",
    views=("v_ledger",),
    sql="""WITH f AS (SELECT sample_key, min(episode) AS first_seen FROM v_ledger GROUP BY 1)
    SELECT DISTINCT sample_key, episode, first_seen FROM v_ledger JOIN f USING (sample_key)
    WHERE episode > first_seen""",
)
def first_seen_claim(spark, d):
    return L.first_seen_claim(v.v_ledger(spark, d), "sample_key", "episode")


_STREAK_SQL = """
    WITH m AS (SELECT *, CASE WHEN status = 'scored' THEN 0 ELSE 1 END AS miss FROM v_ledger),
    g AS (SELECT *, sum(1 - miss) OVER (PARTITION BY sample_key ORDER BY seq) AS grp FROM m),
    s AS (SELECT *, CAST(sum(miss) OVER (PARTITION BY sample_key, grp ORDER BY seq) AS BIGINT) AS streak FROM g)
    """


@query(
    "streaks",
    views=("v_ledger",),
    sql=_STREAK_SQL + "SELECT sample_key, event_id, streak, streak >= 4 AS at_limit FROM s",
)
def streaks(spark, d):
    ledger = v.v_ledger(spark, d)
    out = L.streaks(ledger, ["sample_key"], "event_id", bucket(), F.col("status") != "scored", 4)
    return out.select("sample_key", "event_id", "streak", "at_limit")


@query(
    "retry_delay",
    views=("v_ledger",),
    sql=_STREAK_SQL
    + """SELECT sample_key, event_id, streak,
        CAST(list_extract([5, 30, 120, 600], CAST(least(greatest(streak - 1, 0), 3) + 1 AS BIGINT)) AS BIGINT)
        AS delay_seconds FROM s""",
)
def retry_delay(spark, d):
    return streaks(spark, d).select(
        "sample_key", "event_id", "streak", L.retry_delay(F.col("streak"), [5, 30, 120, 600]).alias("delay_seconds")
    )


@query(
    "budget_cutoff",
    views=("v_ledger",),
    sql="""WITH r AS (SELECT sample_key, event_id, sum(CAST(round(cost * 1000000) AS BIGINT))
        OVER (PARTITION BY sample_key ORDER BY seq) AS used FROM v_ledger)
    SELECT sample_key, min(event_id) FILTER (used >= 2500000000) AS cutoff,
        CAST(max(used) AS DOUBLE) / 1000000 AS total FROM r GROUP BY 1""",
)
def budget_cutoff(spark, d):
    return L.budget_cutoff(v.v_ledger(spark, d), ["sample_key"], "event_id", bucket(), "cost", 2500.0)


@query(
    "terminal_errors",
    views=("v_events",),
    sql="""WITH t AS (SELECT user_id, max(event_id) FILTER (event_type = 'purchase') AS lc FROM v_events GROUP BY 1),
    e AS (SELECT user_id, event_id, CASE WHEN k % 7 = 0 THEN 'quota' WHEN k % 7 = 1 THEN 'rate' ELSE 'other' END AS m
          FROM v_events WHERE event_type = 'error')
    SELECT t.user_id, count(*) FILTER (event_id > coalesce(lc, -1)) AS terminal_errors,
        count(*) FILTER (event_id < lc) AS recovered_errors,
        CASE WHEN count(*) FILTER (event_id > coalesce(lc, -1) AND m = 'quota') > 0 THEN 'terminal_hard_quota'
             WHEN count(*) FILTER (event_id > coalesce(lc, -1) AND m = 'rate') > 0 THEN 'terminal_transient_rate_limit'
             WHEN count(*) FILTER (event_id > coalesce(lc, -1)) > 0 THEN 'terminal_provider_error' END AS failure_class
    FROM t LEFT JOIN e USING (user_id) GROUP BY t.user_id""",
)
def terminal_errors(spark, d):
    marker = F.when(F.col("k") % 7 == 0, "quota").when(F.col("k") % 7 == 1, "rate").otherwise("other")
    return L.terminal_errors(
        v.v_events(spark, d), "user_id", "event_id",
        F.col("event_type") == "purchase", F.col("event_type") == "error", marker,
    )


@query(
    "episode_transition",
    views=("v_ledger",),
    sql="""WITH c AS (SELECT episode, count(*) FILTER (status <> 'attempt_started' AND completion_tokens >= 60) AS candidates,
        count(*) FILTER (status <> 'attempt_started' AND completion_tokens >= 60 AND status = 'scored') AS eligible,
        count(*) FILTER (status <> 'attempt_started' AND completion_tokens >= 60 AND status = 'api_error') AS incomplete,
        bool_or(correct) AS valid FROM (SELECT * REPLACE (attempt_id // 2 AS episode) FROM v_ledger) GROUP BY 1)
    SELECT *, CASE WHEN candidates = 0 THEN 'invalid_submission'
        WHEN NOT valid THEN 'invalid_submission_preserved'
        WHEN incomplete = candidates THEN 'budget_incomplete_preserved'
        WHEN eligible = candidates THEN 'working_seed_added'
        WHEN eligible = 0 THEN 'failed_outcome_added' ELSE 'mixed_candidate_outcomes' END AS transition FROM c""",
)
def episode_transition(spark, d):
    rows = v.v_ledger(spark, d).select(
        F.expr("attempt_id div 2").alias("episode"),
        ((F.col("status") != "attempt_started") & (F.col("completion_tokens") >= 60)).alias("is_candidate"),
        (F.col("status") == "scored").alias("is_eligible"),
        (F.col("status") == "api_error").alias("is_incomplete"),
        F.col("correct").alias("valid_submission"),
    )
    return L.episode_transition(rows, "episode")


@query(
    "episode_fact",
    views=("v_ledger",),
    sql="""WITH e AS (SELECT DISTINCT episode FROM v_ledger),
    u AS (SELECT episode, CAST(sum(completion_tokens) AS BIGINT) AS tokens, count(*) AS turns,
          max(us) - min(us) AS span_us FROM v_ledger WHERE status <> 'attempt_started' GROUP BY 1),
    r AS (SELECT episode, count(*) FILTER (correct) AS added, count(*) FILTER (NOT correct) AS failed
          FROM v_ledger WHERE status = 'scored' GROUP BY 1)
    SELECT e.episode, coalesce(tokens, 0) AS tokens, coalesce(turns, 0) AS turns, span_us, added, failed,
        CAST(coalesce(sum(added) OVER w, 0) AS BIGINT) AS library_size_before,
        CAST(coalesce(sum(failed) OVER w, 0) AS BIGINT) AS failure_memory_before
    FROM e LEFT JOIN u USING (episode) LEFT JOIN r USING (episode)
    WINDOW w AS (ORDER BY e.episode ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def episode_fact(spark, d):
    ledger = v.v_ledger(spark, d)
    usage = (
        ledger.filter(F.col("status") != "attempt_started")
        .groupBy("episode")
        .agg(
            F.sum("completion_tokens").alias("tokens"),
            F.count(F.lit(1)).alias("turns"),
            (F.max("us") - F.min("us")).alias("span_us"),
        )
    )
    rewards = (
        ledger.filter(F.col("status") == "scored")
        .groupBy("episode")
        .agg(F.count_if("correct").alias("added"), F.count_if(~F.col("correct")).alias("failed"))
    )
    return L.episode_fact(
        ledger.select("episode").distinct(), usage, rewards, F.expr(f"episode div {SPAN // 100}")
    )
