"""Source and sink queries bound to the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom import views as v
from evalloom.registry import query
from evalloom.session import spread
from evalloom.sources import files as FL
from evalloom.sources import jsonl as J
from evalloom.sources import manifests as M

_LINE_SCHEMA = (
    T.StructType()
    .add("event_id", T.LongType())
    .add("status", T.StringType())
    .add("completion_tokens", T.LongType())
    .add("cost", T.DoubleType())
)


def _lines(spark, d):
    """Ledger rows as JSON lines; some are cut, blank or not an object, by their token count."""
    k = F.col("completion_tokens")
    text = F.to_json(F.struct("event_id", "status", "completion_tokens", "cost"))
    line = (
        F.when(k == 3, F.left(text, F.lit(12))).when(k == 4, "   ").when(k == 5, "[1, 2]").otherwise(text)
    )
    ledger = spread(v.v_ledger(spark, d), "event_id")
    return ledger.select((F.col("event_id") + 1).alias("line"), line.alias("text"))


@query(
    "read_jsonl",
    views=("v_ledger",),
    sql="""SELECT event_id + 1 AS line, event_id, status, completion_tokens, cost FROM v_ledger
        WHERE completion_tokens NOT IN (3, 4, 5)""",
)
def read_jsonl(spark, d):
    return J.parse_lines(_lines(spark, d), "text", _LINE_SCHEMA)[0]


@query(
    "read_jsonl_errors",
    views=("v_ledger",),
    sql="""SELECT event_id + 1 AS line, CASE completion_tokens WHEN 3 THEN 'invalid JSON' ELSE 'not a JSON object' END AS error
        FROM v_ledger WHERE completion_tokens IN (3, 5)""",
)
def read_jsonl_errors(spark, d):
    return J.parse_lines(_lines(spark, d), "text", _LINE_SCHEMA)[1]


@query(
    "manifest_legacy_rename",
    views=("v_manifest",),
    sql="SELECT scene_id, prompt_family, dataset_id AS world FROM v_manifest",
)
def manifest_legacy_rename(spark, d):
    manifest = v.v_manifest(spark, d)
    old = F.col("scene_id") % 2 == 0
    rows = manifest.select(
        "scene_id",
        "prompt_family",
        F.when(~old, F.col("dataset_id")).alias("world"),
        F.when(old, F.col("dataset_id")).alias("harness"),
    )
    return J.legacy_rename(rows, "world", "harness")


@query(
    "discover_manifests",
    views=("v_files",),
    sql="""WITH l AS (SELECT root, CASE WHEN bytes % 7 = 0 THEN 'vlm_manifest.jsonl' WHEN bytes % 2 = 0 THEN 'run' || page_id % 5
        || '/vlm_manifest.jsonl' ELSE 'other/' || page_id || '.json' END AS rel FROM v_files),
    o AS (SELECT root, bool_or(rel = 'vlm_manifest.jsonl') AS own, bool_or(rel LIKE '%vlm_manifest.jsonl') AS hit FROM l GROUP BY 1)
    SELECT DISTINCT root, rel AS relative FROM l JOIN o USING (root) WHERE rel LIKE '%vlm_manifest.jsonl'
        AND (NOT own OR rel = 'vlm_manifest.jsonl')
    UNION ALL SELECT root, NULL FROM o WHERE NOT hit""",
)
def discover_manifests(spark, d):
    page = F.col("page_id").cast("string")
    rel = (
        F.when(F.col("bytes") % 7 == 0, M.MANIFEST_NAME)
        .when(
            F.col("bytes") % 2 == 0,
            F.concat(F.lit("run"), (F.col("page_id") % 5).cast("string"), F.lit(f"/{M.MANIFEST_NAME}")),
        )
        .otherwise(F.concat(F.lit("other/"), page, F.lit(".json")))
    )
    return M.discover_manifests(v.v_files(spark, d).select("root", rel.alias("relative")), "root", "relative")


@query(
    "load_examples",
    views=("v_examples",),
    sql="""SELECT doc_id, 'quarantined' AS rule, 'true' AS detail FROM v_examples WHERE quarantined
        UNION ALL SELECT doc_id, 'answer_outside_candidates', NULL FROM v_examples WHERE answer IS NULL
        UNION ALL SELECT doc_id, 'missing_keys', CASE WHEN answer IS NOT NULL THEN 'question' WHEN doc_id % 13 = 0 THEN 'answer,question' ELSE 'answer' END
            FROM v_examples WHERE answer IS NULL OR doc_id % 13 = 0
        UNION ALL SELECT doc_id, 'unsupported_version', 'candidate-vlm-manifest-0.0.9' FROM v_examples WHERE doc_id % 17 = 0
        UNION ALL SELECT doc_id, 'blank_text', 'prompt_family' FROM v_examples WHERE doc_id % 19 = 0""",
)
def load_examples(spark, d):
    rows = v.v_examples(spark, d)
    ident = F.col("doc_id").cast("string")
    written = {
        "schema_version": F.when(F.col("doc_id") % 17 == 0, "candidate-vlm-manifest-0.0.9").otherwise(M.MANIFEST_VERSION),
        "example_id": ident, "source_record_id": F.col("dataset_id"), "campaign_id": F.col("dataset_id"), "candidate_id": ident,
        "image_path": F.col("image_path"), "question": F.when(F.col("doc_id") % 13 != 0, "Is it good?"), "answer": F.col("answer"),
        "candidates": F.col("candidates"), "prompt_family": F.when(F.col("doc_id") % 19 == 0, "  ").otherwise("f_good"), "quarantined": F.col("quarantined"),
    }
    raw = F.to_json(F.struct(*[c.alias(k) for k, c in written.items()]))
    return M.load_violations(rows.withColumn("raw", raw), ["doc_id"], raw="raw")


@query(
    "load_snapshots",
    views=("v_examples",),
    sql="""SELECT dataset_id || '/' || left(image_path, 2) AS manifest, min(dataset_id) AS dataset_id, count(*) AS row_count,
        0 AS repeated_keys, min(dataset_id) = max(dataset_id) AS single_dataset FROM v_examples GROUP BY 1""".replace(
        "0 AS rep", "CAST(0 AS BIGINT) AS rep"
    ),
)
def load_snapshots(spark, d):
    manifest = F.concat_ws("/", "dataset_id", F.left("image_path", F.lit(2)))
    rows = v.v_examples(spark, d).withColumn("manifest", manifest)
    return M.load_snapshots(rows, "manifest", "dataset_id", "sample_key")


@query(
    "export_eval_manifest",
    views=("v_manifest",),
    sql="""SELECT 'rec:' || dataset_id || '::' || scene_id || '_' || prompt_family AS example_id, 'rec:' || dataset_id AS source_record_id,
        'candidate-vlm-manifest-0.1.0' AS schema_version, dataset_id AS campaign_id, scene_id % 50 AS candidate_id, 'Is it good?' AS question,
        CASE WHEN scene_id % 3 = 0 THEN 'admitted' ELSE 'pending' END AS human_admission,
        image_path, answer, 'yes,no' AS candidates, prompt_family, margin, false AS quarantined, true AS development_only
        FROM v_manifest WHERE NOT quarantined""",
)
def export_eval_manifest(spark, d):
    rows = v.v_manifest(spark, d).withColumns({
        "campaign_id": F.col("dataset_id"), "candidate_id": F.col("scene_id") % 50, "question": F.lit("Is it good?"),
        "human_admission": F.when(F.col("scene_id") % 3 == 0, "admitted").otherwise("pending"),
    })
    return M.export_eval_manifest(rows, F.concat(F.lit("rec:"), "dataset_id"))


@query(
    "build_catalogue",
    views=("v_reports",),
    sql="""SELECT campaign_id || ':' || candidate_id AS record_id, campaign_id, candidate_id, sha, quality, toxic,
        CASE WHEN candidate_id % 29 <> 0 THEN 'About ' || lang ELSE '' END AS title, CASE WHEN candidate_id % 29 <> 0 THEN 'Is it good?' ELSE '' END AS question,
        candidate_id % 29 <> 0 AND candidate_id IN (SELECT doc_id FROM labels) AS complete,
        CAST(1 AS BIGINT) AS copies FROM v_reports""",
)
def build_catalogue(spark, d):
    candidates = v.v_reports(spark, d).select("candidate_id", "campaign_id", "sha")
    gates = v.table(spark, d, "labels").withColumnRenamed("doc_id", "candidate_id")
    about = v.v_reports(spark, d).filter("candidate_id % 29 <> 0").select("candidate_id", F.concat(F.lit("About "), "lang").alias("title"), F.lit("Is it good?").alias("question"))
    out = M.build_catalogue(candidates, gates, "campaign_id", "candidate_id", about)
    return out.select("record_id", "campaign_id", "candidate_id", "sha", "quality", "toxic", "title", "question", "complete", "copies")


@query(
    "read_catalogue",
    views=("v_reports",),
    sql="""SELECT campaign_id || ':' || lang || ':' || size_class AS record_id, count(*) AS copies FROM v_reports GROUP BY 1
        HAVING count(*) > 1""",
)
def read_catalogue(spark, d):
    record = F.concat_ws(":", "campaign_id", "lang", F.col("size_class").cast("string"))
    return M.repeated_records(v.v_reports(spark, d).select(record.alias("record_id")))


@query(
    "check_catalogue",
    views=("v_reports",),
    sql="""WITH r AS (SELECT campaign_id || ':' || lang || ':' || size_class AS record_id, count(*) AS copies, count(*) FILTER (candidate_id % 23 = 0) AS others
        FROM v_reports GROUP BY 1)
    SELECT record_id, 'repeated_record' AS rule, CAST(copies AS VARCHAR) AS detail FROM r WHERE copies > 1
    UNION ALL SELECT record_id, 'unsupported_version', CAST(others AS VARCHAR) FROM r WHERE others > 0""",
)
def check_catalogue(spark, d):
    record = F.concat_ws(":", "campaign_id", "lang", F.col("size_class").cast("string"))
    version = F.when(F.col("candidate_id") % 23 == 0, "0.0.9").otherwise("0.1.0")
    return M.check_catalogue(v.v_reports(spark, d).select(record.alias("record_id"), version.alias("schema_version")), "0.1.0")


@query(
    "read_events",
    views=("v_ledger",),
    sql="""SELECT event_id, 1 + count(*) AS copies FROM v_ledger WHERE completion_tokens >= 40 AND completion_tokens < 50
        GROUP BY 1""",
)
def read_events(spark, d):
    ledger = v.v_ledger(spark, d).select("event_id", "sample_key", "status", "completion_tokens")
    legacy = ledger.filter("completion_tokens < 50").drop("status")
    return J.read_events(legacy, ledger.filter("completion_tokens >= 40"), "event_id")[1]


def _appends(spark, d):
    ledger = v.v_ledger(spark, d).select("event_id", "attempt_id", "completion_tokens")
    target = ledger.filter("completion_tokens < 10").select("attempt_id")
    incoming = ledger.withColumn("attempt_id", F.when(F.col("completion_tokens") != 99, F.col("attempt_id")))
    return J.append_unique(target, incoming, "attempt_id", "event_id")


_APPEND_SQL = """WITH t AS (SELECT DISTINCT attempt_id FROM v_ledger WHERE completion_tokens < 10),
    i AS (SELECT event_id, CASE WHEN completion_tokens <> 99 THEN attempt_id END AS attempt_id, completion_tokens FROM v_ledger),
    j AS (SELECT *, row_number() OVER (PARTITION BY attempt_id ORDER BY event_id) AS rn FROM i),
    r AS (SELECT event_id, attempt_id, completion_tokens, CASE WHEN attempt_id IS NULL THEN 'missing_id'
        WHEN attempt_id IN (SELECT attempt_id FROM t) THEN 'already_stored' WHEN rn > 1 THEN 'repeated_in_batch' END AS reason FROM j)
    """


@query(
    "append_unique",
    views=("v_ledger",),
    sql=_APPEND_SQL + "SELECT event_id, attempt_id, completion_tokens FROM r WHERE reason IS NULL",
)
def append_unique(spark, d):
    return _appends(spark, d)[0].select("event_id", "attempt_id", "completion_tokens")


@query("append_rejects", views=("v_ledger",), sql=_APPEND_SQL + "SELECT event_id, reason FROM r WHERE reason IS NOT NULL")
def append_rejects(spark, d):
    return _appends(spark, d)[1].select("event_id", "reason")


@query(
    "canonical_json",
    views=("v_ledger",),
    sql="""SELECT event_id, sha256(to_json({'completion_tokens': completion_tokens, 'correct': correct, 'event_id': event_id,
        'reasoning_tokens': reasoning_tokens, 'status': status})) AS digest FROM v_ledger""",
)
def canonical_json(spark, d):
    names = ["status", "event_id", "completion_tokens", "reasoning_tokens", "correct"]
    return v.v_ledger(spark, d).select("event_id", J.sha256_json({n: F.col(n) for n in names}).alias("digest"))


@query(
    "tree_digest",
    views=("v_files",),
    sql="""SELECT root, count(*) AS files, sha256('{' || string_agg('"' || path || '":"' || sha || '"', ',' ORDER BY path) || '}')
        AS tree_sha256 FROM (SELECT root, path, max(sha256) AS sha FROM v_files GROUP BY ALL) GROUP BY root""",
)
def tree_digest(spark, d):
    return FL.tree_digest(v.v_files(spark, d))


@query(
    "evidence_index",
    views=("v_files",),
    sql="""SELECT root, path, min(sha256) AS sha256, arg_min(bytes, sha256) AS bytes FROM v_files
        WHERE regexp_matches(path, '^en/|\\.html$') GROUP BY ALL""",
)
def evidence_index(spark, d):
    return FL.evidence_index(v.v_files(spark, d), [r"^en/", r"\.html$"])


@query(
    "determinism_check",
    views=("v_files",),
    sql="""SELECT root, NOT bool_or(bytes % 7 = 0 OR bytes % 10 = 0) AS identical FROM v_files GROUP BY root""",
)
def determinism_check(spark, d):
    from evalloom.plans.q_reports import _current_files

    return FL.determinism_check(v.v_files(spark, d), _current_files(spark, d))


@query(
    "cohort_summary",
    views=("v_reports",),
    sql="""SELECT campaign_id, count(*) AS candidates, count(*) FILTER (coalesce(quality = 1, false)) AS eligible,
        min(sha) AS first_sha, max(sha) AS last_sha FROM v_reports GROUP BY 1""",
)
def cohort_summary(spark, d):
    rows = v.v_reports(spark, d).withColumn("eligible", F.coalesce(F.col("quality") == 1, F.lit(False)))
    return M.cohort_summary(rows, "campaign_id")
