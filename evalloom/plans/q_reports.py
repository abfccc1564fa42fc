"""Report, balance and reconciliation queries bound to the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom import views as v
from evalloom.operators import reports as R
from evalloom.plans.q_checks import _ELIGIBLE_SQL, _eligible
from evalloom.registry import query

_GATES_SQL = """g AS (SELECT candidate_id, campaign_id, unnest([
    {'gate': 'quality', 'passed': g_quality}, {'gate': 'clean', 'passed': g_clean},
    {'gate': 'long', 'passed': g_long}, {'gate': 'english', 'passed': g_english}], recursive := true) FROM v_reports)"""


@query(
    "gate_pass_rates",
    views=("v_reports",),
    sql=f"""WITH {_GATES_SQL}, t AS (SELECT campaign_id, count(*) AS candidates FROM v_reports GROUP BY 1)
    SELECT campaign_id, gate, count(*) FILTER (passed) AS passes, any_value(candidates) AS candidates,
        count(*) FILTER (passed) / any_value(candidates) AS rate
    FROM g JOIN t USING (campaign_id) WHERE passed IS NOT NULL GROUP BY ALL""",
)
def gate_pass_rates(spark, d):
    return R.gate_pass_rates(v.v_reports(spark, d), "campaign_id")


@query(
    "report_summary",
    views=("v_reports",),
    sql=f"""SELECT campaign_id, count(*) AS candidates, count(*) FILTER ({_ELIGIBLE_SQL}) / count(*) AS eligible_fraction,
        bool_and({_ELIGIBLE_SQL}) AS all_eligible, count(*) FILTER (n_chars >= 200) / count(*) AS distinct_fraction,
        count(*) FILTER (lang = 'en') / count(*) AS ready_fraction, count(*) FILTER (toxic = 0) AS alias_pass,
        count(*) FILTER (toxic IS NULL) AS alias_not_applicable, count(*) FILTER (toxic = 1) AS alias_fail
    FROM v_reports GROUP BY 1""",
)
def report_summary(spark, d):
    reports = v.v_reports(spark, d)
    alias = F.when(F.col("toxic").isNull(), "not_applicable").when(F.col("toxic") == 0, "pass").otherwise("fail")
    rows = reports.select(
        "campaign_id",
        _eligible(reports).alias("eligible"),
        (F.col("n_chars") >= 200).alias("registry_distinct"),
        (F.col("lang") == "en").alias("review_ready"),
        alias.alias("alias_status"),
    )
    return R.report_summary(rows, "campaign_id")


@query(
    "mean_rewards",
    views=("v_reports",),
    sql="""WITH n AS (SELECT size_class, count(*) AS n FROM v_reports GROUP BY 1),
    k AS (SELECT size_class, 'mean_quality' AS metric, sum(quality) AS s FROM v_reports WHERE quality IS NOT NULL GROUP BY ALL
        UNION ALL SELECT size_class, 'mean_clean', sum(1 - toxic) FROM v_reports WHERE toxic IS NOT NULL GROUP BY ALL)
    SELECT size_class, coalesce(metric, 'mean_reward') AS metric, coalesce(CAST(s AS DOUBLE) / n, 0) AS value
    FROM n LEFT JOIN k USING (size_class)""",
)
def mean_rewards(spark, d):
    rewards = F.map_filter(
        F.create_map(
            F.lit("quality"), F.col("quality").cast("double"), F.lit("clean"), (1 - F.col("toxic")).cast("double")
        ),
        lambda _, x: x.isNotNull(),
    )
    return R.mean_rewards(v.v_reports(spark, d).withColumn("rewards", rewards), "size_class", "rewards")


@query(
    "class_balance",
    views=("v_manifest",),
    sql="""WITH b AS (SELECT dataset_id, prompt_family, count(DISTINCT answer) FILTER (NOT quarantined) AS n
        FROM v_manifest GROUP BY ALL),
    f AS (SELECT unnest(['f_declared_only', 'f_good', 'f_not_good', 'f_unknown']) AS prompt_family),
    g AS (SELECT * FROM (SELECT DISTINCT dataset_id FROM v_manifest), f)
    SELECT dataset_id, prompt_family, CASE
        WHEN prompt_family = 'f_unknown' THEN 'unknown_exclusion'
        WHEN prompt_family = 'f_not_good' AND coalesce(n, 0) < 2 THEN 'supplement_unbalanced'
        WHEN prompt_family = 'f_declared_only' THEN 'absent'
        WHEN prompt_family = 'f_good' AND n IS NULL THEN 'absent'
        WHEN prompt_family = 'f_good' AND n < 2 THEN 'unbalanced' ELSE 'ok' END AS verdict
    FROM g LEFT JOIN b USING (dataset_id, prompt_family)""",
)
def class_balance(spark, d):
    manifest = v.v_manifest(spark, d)
    main = manifest.filter("prompt_family = 'f_good'")
    extra = manifest.filter("prompt_family = 'f_not_good'")
    return R.class_balance(main, extra, "dataset_id", list(v.DECLARED_FAMILIES), ["f_not_good", "f_unknown"])


@query(
    "coverage_complete",
    views=("v_manifest",),
    sql="""WITH m AS (SELECT * FROM v_manifest WHERE NOT (prompt_family = 'f_not_good' AND margin > 70)),
    c AS (SELECT dataset_id, prompt_family, scene_id, count(*) AS n FROM m GROUP BY ALL),
    s AS (SELECT dataset_id, count(DISTINCT scene_id) AS scenes FROM m GROUP BY 1)
    SELECT dataset_id, prompt_family, count(*) AS covered, count(*) FILTER (n > 1) AS repeated, any_value(scenes) AS scenes,
        count(*) = any_value(scenes) AND count(*) FILTER (n > 1) = 0 AS complete
    FROM c JOIN s USING (dataset_id) GROUP BY ALL""",
)
def coverage_complete(spark, d):
    rows = v.v_manifest(spark, d).filter("NOT (prompt_family = 'f_not_good' AND margin > 70)")
    return R.coverage_complete(rows, "dataset_id")


@query(
    "dataset_stats",
    views=("v_manifest",),
    sql="""SELECT dataset_id, count(DISTINCT scene_id) AS scene_count, count(*) AS row_count,
        count(*) FILTER (NOT quarantined) AS eligible_rows, count(*) FILTER (quarantined) AS quarantined_rows,
        count(DISTINCT prompt_family) AS families_per_scene, count(DISTINCT scene_id) = 50 AS as_expected
    FROM v_manifest GROUP BY 1""",
)
def dataset_stats(spark, d):
    return R.dataset_stats(v.v_manifest(spark, d), "dataset_id", 50)


@query(
    "ambiguous_pixels",
    views=("v_examples",),
    sql="""SELECT image_path, count(*) AS n, min(CAST(doc_id % 3 AS BIGINT)) AS lowest, max(CAST(doc_id % 3 AS BIGINT)) AS highest
        FROM v_examples GROUP BY 1 HAVING min(doc_id % 3) < max(doc_id % 3)""",
)
def ambiguous_pixels(spark, d):
    rows = v.v_examples(spark, d).withColumn("decision", F.col("doc_id") % 3)
    return R.ambiguous(rows, "image_path", "decision")


@query(
    "duplicate_content",
    views=("v_reports",),
    sql="""SELECT sha, count(*) AS copies, min(candidate_id) AS first_id, max(candidate_id) AS last_id
        FROM v_reports GROUP BY 1 HAVING count(*) > 1""",
)
def duplicate_content(spark, d):
    return R.duplicate_content(v.v_reports(spark, d), "sha", "candidate_id")


@query(
    "cohort_collisions",
    views=("v_reports",),
    sql="""SELECT lang, campaign_id, size_class, candidate_id, members FROM (SELECT *, count(*) OVER
        (PARTITION BY lang, campaign_id, size_class) AS members FROM v_reports) WHERE members > 1""",
)
def cohort_collisions(spark, d):
    return R.cohort_collisions(v.v_reports(spark, d), ["lang", "campaign_id", "size_class"], "candidate_id")


_DAY = "us // 86400000000"


@query(
    "funnel_counts",
    views=("v_events",),
    sql=f"""SELECT event_type, count(DISTINCT (user_id, {_DAY})) AS attempts FROM v_events GROUP BY 1""",
)
def funnel_counts(spark, d):
    events = v.v_events(spark, d).withColumn("day", F.expr("us div 86400000000"))
    return R.funnel_counts(events, ["user_id", "day"], "event_type")


@query(
    "terminal_reasons",
    views=("v_events",),
    sql=f"""WITH l AS (SELECT user_id, {_DAY} AS day, arg_max(event_type, event_id) AS event_type,
        arg_max(k % 5, event_id) AS reason FROM v_events GROUP BY ALL)
    SELECT event_type, reason, count(*) AS attempts FROM l WHERE event_type IN ('purchase', 'error') GROUP BY ALL""",
)
def terminal_reasons(spark, d):
    events = v.v_events(spark, d).withColumn("day", F.expr("us div 86400000000")).withColumn("reason", F.col("k") % 5)
    return R.terminal_reasons(events, ["user_id", "day"], "event_type", "event_id", "reason", ["purchase", "error"])


def _ledger_json(spark, d):
    return v.v_ledger(spark, d).select(
        F.to_json(F.struct("event_id", "status", "completion_tokens", "reasoning_tokens")).alias("raw")
    )


@query(
    "common_fields",
    views=("v_ledger",),
    sql="""WITH n AS (SELECT count(*) AS n, count(reasoning_tokens) AS r FROM v_ledger)
    SELECT unnest([{'field': 'event_id', 'declared': true, 'n': n, 'common': true},
        {'field': 'status', 'declared': true, 'n': n, 'common': true},
        {'field': 'completion_tokens', 'declared': false, 'n': n, 'common': true},
        {'field': 'reasoning_tokens', 'declared': true, 'n': r, 'common': r = n},
        {'field': 'scene', 'declared': true, 'n': 0, 'common': false}], recursive := true) FROM n""",
)
def common_fields(spark, d):
    return R.common_fields(_ledger_json(spark, d), "raw", ["event_id", "status", "reasoning_tokens", "scene"])


@query(
    "shared_fields",
    views=("v_ledger",),
    sql="""SELECT unnest(['event_id', 'status']) AS field UNION
        SELECT 'reasoning_tokens' FROM v_ledger WHERE reasoning_tokens IS NOT NULL""",
)
def shared_fields(spark, d):
    return R.shared_fields(_ledger_json(spark, d), "raw", ["event_id", "status", "reasoning_tokens", "scene"])


@query(
    "declared_minus_excluded",
    views=(),
    sql="""WITH d AS (SELECT 'src' || range AS family FROM range(15)),
    x AS (SELECT DISTINCT source AS family FROM documents d JOIN labels USING (doc_id) WHERE toxic = 1)
    SELECT coalesce(d.family, x.family) AS family, CASE WHEN d.family IS NULL THEN 'unknown'
        WHEN x.family IS NOT NULL THEN 'excluded' ELSE 'kept' END AS outcome FROM d FULL JOIN x USING (family)""",
)
def declared_minus_excluded(spark, d):
    excluded = v.v_reports(spark, d).filter("toxic = 1").select(F.col("campaign_id").alias("family"))
    return R.declared_minus_excluded(spark, [f"src{i}" for i in range(15)], excluded)


@query(
    "one_to_one_join",
    views=(),
    sql="""WITH g AS (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM labels WHERE toxic = 1)
    SELECT d.doc_id, count(g.doc_id) AS matches, CASE count(g.doc_id) WHEN 0 THEN 'missing' WHEN 1 THEN 'ok' ELSE 'duplicate' END
        AS verdict FROM documents d LEFT JOIN g USING (doc_id) GROUP BY 1""",
)
def one_to_one_join(spark, d):
    labels = v.table(spark, d, "labels")
    gates = labels.select("doc_id").unionByName(labels.filter("toxic = 1").select("doc_id"))
    return R.one_to_one_join(v.v_docs(spark, d), gates, "doc_id")


def _current_files(spark, d):
    changed = F.when(F.col("bytes") % 7 == 0, F.sha2("sha256", 256)).otherwise(F.col("sha256"))
    return v.v_files(spark, d).filter("bytes % 10 <> 0").withColumn("sha256", changed)


@query(
    "plan_drift",
    views=("v_files",),
    sql="""SELECT page_id, CASE WHEN bytes % 10 = 0 THEN 'missing' ELSE 'changed' END AS verdict FROM v_files
        WHERE bytes % 10 = 0 OR bytes % 7 = 0""",
)
def plan_drift(spark, d):
    return R.plan_drift(v.v_files(spark, d), _current_files(spark, d), "page_id", "sha256")


@query(
    "set_reconcile",
    views=("v_labelled",),
    sql="""WITH s AS (SELECT doc_id, quality IS NOT NULL AS in_declared, lang = 'en' AS in_actual,
        coalesce(toxic, 0) = 0 AS in_results FROM v_labelled)
    SELECT * FROM s WHERE NOT (in_declared AND in_actual AND in_results) AND (in_declared OR in_actual OR in_results)""",
)
def set_reconcile(spark, d):
    docs = v.labelled_docs(spark, d)
    return R.set_reconcile(
        {
            "declared": docs.filter("quality IS NOT NULL"),
            "actual": docs.filter("lang = 'en'"),
            "results": docs.filter("coalesce(toxic, 0) = 0"),
        },
        "doc_id",
    )


@query(
    "hash_consensus",
    views=("v_files",),
    sql="""SELECT page_id, CAST(6 - (bytes % 11 = 0)::INT - (bytes % 13 = 0)::INT AS BIGINT) AS known_sources,
        NOT (bytes % 11 = 0) AND NOT (bytes % 13 = 0) AND NOT (bytes % 7 = 0) AS consensus FROM v_files""",
)
def hash_consensus(spark, d):
    files = v.v_files(spark, d).select("page_id", "sha256", "bytes")
    return R.hash_consensus(
        {
            "ledger": files,
            "packet": files,
            "record": files.withColumn("sha256", F.when(F.col("bytes") % 11 != 0, F.col("sha256"))),
            "start_state": files.filter("bytes % 13 <> 0"),
            "materialised": files,
            "recomputed": files.withColumn(
                "sha256", F.when(F.col("bytes") % 7 == 0, F.sha2("sha256", 256)).otherwise(F.col("sha256"))
            ),
        },
        "page_id",
        "sha256",
    )


@query(
    "verify_evidence",
    views=("v_files",),
    sql="""SELECT page_id, CASE WHEN bytes % 17 = 0 THEN CASE WHEN bytes % 10 = 0 THEN NULL ELSE 'unlisted' END
        WHEN bytes % 19 = 0 THEN 'duplicated' WHEN bytes % 10 = 0 THEN 'missing' WHEN bytes % 23 = 0 THEN 'size_mismatch'
        WHEN bytes % 7 = 0 THEN 'digest_mismatch' ELSE 'ok' END AS verdict FROM v_files
        WHERE NOT (bytes % 17 = 0 AND bytes % 10 = 0)""",
)
def verify_evidence(spark, d):
    files = v.v_files(spark, d)
    listed = files.filter("bytes % 17 <> 0")
    manifest = listed.unionByName(listed.filter("bytes % 19 = 0")).withColumn(
        "bytes", F.when(F.col("bytes") % 23 == 0, F.col("bytes") + 1).otherwise(F.col("bytes"))
    )
    return R.verify_evidence(manifest, _current_files(spark, d), ["page_id"])


@query(
    "apply_exclusions",
    views=("v_reports",),
    sql="""WITH r AS (SELECT candidate_id, campaign_id, size_class, sha, coalesce(quality, 1) = 1 AS ok, n_chars FROM v_reports),
    x AS (SELECT * FROM r WHERE n_chars % 3 = 0)
    SELECT candidate_id, CASE WHEN n_chars % 3 = 0 AND n_chars % 4 = 0 THEN 'wrong_campaign'
        WHEN n_chars % 3 = 0 AND n_chars % 5 = 0 THEN 'stale_state' WHEN n_chars % 3 = 0 AND ok THEN 'refused_conforming'
        WHEN n_chars % 3 = 0 THEN 'excluded' WHEN NOT ok THEN 'contract_violation' ELSE 'kept' END AS outcome FROM r
    UNION ALL SELECT -1 - candidate_id, 'unused_exclusion' FROM x WHERE size_class > 2""",
)
def apply_exclusions(spark, d):
    rows = v.v_reports(spark, d).select(
        "candidate_id",
        "campaign_id",
        F.col("sha").alias("state_sha"),
        (F.coalesce("quality", F.lit(1)) == 1).alias("conforming"),
        "n_chars",
        "size_class",
    )
    n = F.col("n_chars")
    wanted = rows.filter("n_chars % 3 = 0")
    exclusions = wanted.select(
        "candidate_id",
        F.when(n % 4 == 0, "elsewhere").otherwise(F.col("campaign_id")).alias("campaign_id"),
        F.when(n % 5 == 0, "old").otherwise(F.col("state_sha")).alias("state_sha"),
    ).unionByName(wanted.filter("size_class > 2").select((-1 - F.col("candidate_id")).alias("candidate_id"), "campaign_id", "state_sha"))
    return R.apply_exclusions(rows, exclusions, "candidate_id")


@query(
    "paired_design",
    views=("v_examples",),
    sql="""SELECT doc_id, image_path, f AS prompt_family FROM v_examples, (VALUES ('f_good'), ('f_not_good')) t(f)""",
)
def paired_design(spark, d):
    scenes = v.v_examples(spark, d).select("doc_id", "image_path")
    return R.paired_design(scenes, list(v.DECLARED_FAMILIES), ["f_declared_only"])


@query(
    "known_id_check",
    views=("v_fp",),
    sql="""WITH c AS (SELECT id, [id, id // 2, (id * 7) % 50, id % 3] AS refs FROM v_fp),
    k AS (SELECT DISTINCT item_id FROM benchmark),
    u AS (SELECT id, count(*) AS unknown FROM (SELECT id, unnest(refs) AS r FROM c) WHERE r NOT IN (SELECT item_id FROM k) GROUP BY 1)
    SELECT id, len(list_distinct(refs)) < 4 AS bad_shape, coalesce(unknown, 0) AS unknown FROM c LEFT JOIN u USING (id)
    WHERE len(list_distinct(refs)) < 4 OR unknown > 0""",
)
def known_id_check(spark, d):
    refs = F.array("id", F.expr("id div 2"), (F.col("id") * 7) % 50, F.col("id") % 3)
    rows = v.v_fp(spark, d).select("id", refs.alias("refs"))
    return R.known_id_check(rows, "id", "refs", v.table(spark, d, "benchmark"), "item_id", (1, 5))


@query(
    "extend_memories",
    views=("v_reports",),
    sql=f"""WITH {_GATES_SQL}, f AS (SELECT candidate_id, coalesce(list(gate ORDER BY gate) FILTER (NOT passed), []) AS fg
        FROM g GROUP BY 1),
    r AS (SELECT candidate_id, {_ELIGIBLE_SQL} AS e, 'Outcome ' || candidate_id AS s, fg,
        campaign_id || '|' || lang || '|' || size_class AS cell FROM v_reports JOIN f USING (candidate_id))
    SELECT candidate_id, CASE WHEN e THEN 'known' ELSE 'negative' END AS memory, CASE WHEN e THEN NULL
        WHEN len(fg) > 0 THEN 'protected_gate_failure_' || array_to_string(fg[1:3], '_')
        ELSE 'protected_verifier_rejection' END AS reason_code,
        CASE WHEN e THEN s ELSE s || ' Protected failures: ' || CASE WHEN len(fg) > 0 THEN array_to_string(fg, ', ')
        ELSE 'none recorded' END || '.' END AS note FROM r
    UNION ALL SELECT candidate_id, 'registry', NULL, cell FROM r""",
)
def extend_memories(spark, d):
    reports = v.v_reports(spark, d)
    summary = F.concat(F.lit("Outcome "), F.col("candidate_id").cast("string"))
    rows = reports.withColumn("eligible", _eligible(reports))
    return R.extend_memories(rows, "candidate_id", summary, ["campaign_id", "lang", "size_class"])


@query(
    "merge_snapshot",
    views=("v_labelled",),
    sql="""WITH b AS (SELECT doc_id, n_chars AS ord FROM v_labelled WHERE quality = 1),
    p AS (SELECT doc_id, n_chars * 2 AS ord FROM v_labelled WHERE toxic = 0)
    SELECT doc_id, 'base' AS origin, ord FROM b UNION ALL
    SELECT doc_id, 'promoted', ord FROM p WHERE doc_id NOT IN (SELECT doc_id FROM b)""",
)
def merge_snapshot(spark, d):
    docs = v.labelled_docs(spark, d)
    base = docs.filter("quality = 1").select("doc_id", F.col("n_chars").alias("ord"))
    promoted = docs.filter("toxic = 0").select("doc_id", (F.col("n_chars") * 2).alias("ord"))
    return R.merge_snapshot(base, promoted, "doc_id", "ord")
