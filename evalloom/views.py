"""Views that bind the operators to the star-schema test tables.

Each view exists twice with the same rules: as a DataFrame function and as a SQL
common table expression used by the comparison queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.session import spread

STATUSES = ("attempt_started", "scored", "unparseable", "api_error")
HARD_THRESHOLD = 0.6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_us(column: str):
    """Microseconds since 1970 of a timestamp without time zone, free of session settings."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {column})")


def v_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        "value",
        "props",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        epoch_us("ts").alias("us"),
    )


def v_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = (
        F.when(F.col("event_type") == "view", "attempt_started")
        .when(F.col("event_type").isin("click", "purchase"), "scored")
        .when(F.col("event_type") == "signup", "unparseable")
        .otherwise("api_error")
    )
    return v_events(spark, sf_dir).select(
        F.col("event_id").alias("seq"),
        "event_id",
        F.col("user_id").alias("sample_key"),
        F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")).alias("evaluator"),
        F.expr("event_id div 100").alias("episode"),
        (F.col("user_id") % 5).alias("plan_no"),
        F.expr("event_id div 2").alias("attempt_id"),
        status.alias("status"),
        ((status == "scored") & (F.col("k") % 10 < 6)).alias("correct"),
        F.col("k").alias("completion_tokens"),
        F.when(F.col("k") % 3 == 0, F.lit(None)).otherwise(F.expr("k div 2")).cast("bigint").alias("reasoning_tokens"),
        F.col("value").alias("cost"),
        "us",
    )


def v_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = v_ledger(spark, sf_dir).filter(F.col("status") == "scored")
    return (
        scored.groupBy(F.col("sample_key").alias("candidate"), "evaluator")
        .agg(
            F.count(F.lit(1)).alias("scored"),
            F.count_if("correct").alias("n_correct"),
        )
        .withColumn("accuracy", F.col("n_correct") / F.col("scored"))
        .withColumn("target", F.col("candidate") % 3)
    )


def v_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = (
        F.when(F.col("role") == "system", "candidate_staged")
        .when(F.col("role") == "user", "public_gate_started")
        .otherwise("public_gate_finished")
    )
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("run"),
        (F.col("turn") + 1).alias("sequence"),
        kind.alias("kind"),
        F.expr("turn div 2").alias("attempt"),
        F.when(F.length("text") % 2 == 0, "passed").otherwise("failed").alias("outcome"),
        "role",
        "text",
    )


def v_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def v_docs_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents for work that is costly per text."""
    return spread(v_docs(spark, sf_dir), "doc_id")


def labelled_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v_docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")


def v_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_docs(spark, sf_dir).select(
        "doc_id",
        F.sha2(F.concat(F.lit("docs\0"), F.col("doc_id").cast("string")), 256).alias("sample_key"),
        F.col("source").alias("dataset_id"),
        F.concat_ws("/", "lang", F.md5("text")).alias("image_path"),
        (F.coalesce("toxic", F.lit(0)) == 1).alias("quarantined"),
        F.when(F.col("quality") == 1, "yes").when(F.col("quality") == 0, "no").alias("answer"),
        F.array(F.lit("yes"), F.lit("no")).alias("candidates"),
        (F.col("n_chars") % 161 - 80).cast("double").alias("margin"),
    )


EMITTED_FAMILIES = ("f_good", "f_not_good")
DECLARED_FAMILIES = ("f_good", "f_not_good", "f_declared_only")


def v_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    flipped = F.when(F.col("answer") == "yes", "no").when(F.col("answer") == "no", "yes")
    families = F.array(
        F.struct(F.lit("f_good").alias("prompt_family"), F.col("answer").alias("family_answer")),
        F.struct(F.lit("f_not_good").alias("prompt_family"), flipped.alias("family_answer")),
    )
    return v_examples(spark, sf_dir).select(
        F.col("doc_id").alias("scene_id"),
        "dataset_id",
        "image_path",
        "quarantined",
        "candidates",
        "margin",
        F.col("answer").alias("decision"),
        F.inline(families).alias("prompt_family", "answer"),
    )


def v_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    gates = F.create_map(
        F.lit("quality"), F.col("quality") == 1,
        F.lit("clean"), F.col("toxic") == 0,
        F.lit("long"), F.col("n_chars") >= 200,
        F.lit("english"), F.col("lang") == "en",
    )
    return labelled_docs(spark, sf_dir).select(
        F.col("doc_id").alias("candidate_id"),
        F.col("source").alias("campaign_id"),
        "lang",
        "quality",
        "toxic",
        "n_chars",
        F.map_filter(gates, lambda _, v: v.isNotNull()).alias("gates"),
        F.sha2("text", 256).alias("sha"),
        F.expr("n_chars div 1000").alias("size_class"),
    )


def v_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.regexp_extract("url", "://([^/]+)", 1).alias("root"),
        F.regexp_extract("url", "://[^/]+/(.*)$", 1).alias("path"),
        F.sha2("html", 256).alias("sha256"),
        F.length("html").cast("bigint").alias("bytes"),
    )


def v_fp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        (F.col("p_size") % 5).cast("bigint").alias("family"),
        (F.col("p_partkey") % 5).alias("arity"),
        F.col("p_brand").alias("relation"),
        F.col("p_type").alias("margin_operator"),
        (1 + F.col("p_size") % 4).cast("bigint").alias("depth"),
        F.split("p_name", " ").alias("entities"),
        F.array("p_type", F.concat(F.lit("x"), (F.col("p_size") % 3).cast("string"))).alias("primitives"),
        F.col("p_name").alias("text"),
    )


def v_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    return (
        table(spark, sf_dir, "embeddings")
        .select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
        .select(
            F.col("vec_id").alias("candidate_id"),
            (F.col("vec_id") % 10).alias("campaign_id"),
            F.expr("vec_id div 10").alias("episode"),
            F.concat(F.lit("c"), (F.col("label") % 9).cast("string")).alias("cell"),
            F.transform(x, lambda v: (v + 1) / 2).alias("vector"),
            F.abs(x[0]).alias("similarity"),
            (1 - F.abs(x[1])).alias("stability"),
            (x[2] > -0.2).alias("valid"),
        )
    )


def v_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per scene; the 8x8 grid stays an array of 64, so a scene is never grouped."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("bigint").alias("candidate"),
        F.col("vec_id").alias("scene"),
        F.expr("transform(embedding, v -> CAST(v > CAST(0.2 AS FLOAT) AS DOUBLE))").alias("impact"),
        F.expr("transform(embedding, v -> CAST(v < CAST(-0.3 AS FLOAT) AS DOUBLE))").alias("error"),
    )


def v_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("scene"),
        F.col("l_linenumber").cast("bigint").alias("i"),
        F.col("l_quantity").alias("x"),
        (F.col("l_extendedprice") / 1000).alias("y"),
        (F.col("l_discount") * 10).alias("r"),
        (F.col("l_quantity") - 25).alias("m"),
        "l_returnflag",
        "l_linestatus",
        "l_partkey",
    )


def v_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of an acyclic graph: every link leads from a customer to a later one."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("src"),
        (F.col("o_custkey") + 1 + F.col("o_orderkey") % 997).alias("dst"),
        "o_orderkey",
    )


VIEW_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "v_events": (
        (),
        """SELECT event_id, ts, user_id, event_type, value, props,
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, epoch_us(ts) AS us FROM events""",
    ),
    "v_ledger": (
        ("v_events",),
        """SELECT event_id AS seq, event_id, user_id AS sample_key, 'm' || (event_id % 3) AS evaluator,
        event_id // 100 AS episode, user_id % 5 AS plan_no, event_id // 2 AS attempt_id,
        CASE WHEN event_type = 'view' THEN 'attempt_started'
             WHEN event_type IN ('click', 'purchase') THEN 'scored'
             WHEN event_type = 'signup' THEN 'unparseable' ELSE 'api_error' END AS status,
        event_type IN ('click', 'purchase') AND k % 10 < 6 AS correct,
        k AS completion_tokens, CASE WHEN k % 3 = 0 THEN NULL ELSE k // 2 END AS reasoning_tokens,
        value AS cost, us FROM v_events""",
    ),
    "v_panel": (
        ("v_ledger",),
        """SELECT *, n_correct / scored AS accuracy, candidate % 3 AS target FROM (
        SELECT sample_key AS candidate, evaluator, count(*) AS scored,
        count(*) FILTER (correct) AS n_correct
        FROM v_ledger WHERE status = 'scored' GROUP BY ALL)""",
    ),
    "v_turns": (
        (),
        """SELECT conv_id AS run, turn + 1 AS sequence,
        CASE role WHEN 'system' THEN 'candidate_staged' WHEN 'user' THEN 'public_gate_started'
             ELSE 'public_gate_finished' END AS kind,
        turn // 2 AS attempt, CASE WHEN length(text) % 2 = 0 THEN 'passed' ELSE 'failed' END AS outcome,
        role, text FROM conversations""",
    ),
    "v_labelled": ((), "SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)"),
    "v_examples": (
        ("v_labelled",),
        """SELECT doc_id, sha256('docs' || chr(0) || doc_id) AS sample_key, source AS dataset_id,
        lang || '/' || md5(text) AS image_path, coalesce(toxic, 0) = 1 AS quarantined,
        CASE quality WHEN 1 THEN 'yes' WHEN 0 THEN 'no' END AS answer,
        ['yes', 'no'] AS candidates, CAST(n_chars % 161 - 80 AS DOUBLE) AS margin FROM v_labelled""",
    ),
    "v_manifest": (
        ("v_examples",),
        """SELECT doc_id AS scene_id, dataset_id, image_path, quarantined, candidates, margin,
        answer AS decision, f AS prompt_family,
        CASE WHEN f = 'f_good' THEN answer WHEN answer = 'yes' THEN 'no'
             WHEN answer = 'no' THEN 'yes' END AS answer
        FROM v_examples, (VALUES ('f_good'), ('f_not_good')) t(f)""",
    ),
    "v_reports": (
        ("v_labelled",),
        """SELECT doc_id AS candidate_id, source AS campaign_id, lang, quality, toxic, n_chars,
        quality = 1 AS g_quality, toxic = 0 AS g_clean, n_chars >= 200 AS g_long, lang = 'en' AS g_english,
        sha256(text) AS sha, n_chars // 1000 AS size_class FROM v_labelled""",
    ),
    "v_files": (
        (),
        """SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS root,
        regexp_extract(url, '://[^/]+/(.*)$', 1) AS path, sha256(html) AS sha256, length(html) AS bytes
        FROM pages""",
    ),
    "v_fp": (
        (),
        """SELECT p_partkey AS id, CAST(p_size % 5 AS BIGINT) AS family, p_partkey % 5 AS arity,
        p_brand AS relation, p_type AS margin_operator, CAST(1 + p_size % 4 AS BIGINT) AS depth,
        string_split(p_name, ' ') AS entities, [p_type, 'x' || (p_size % 3)] AS primitives,
        p_name AS text FROM part""",
    ),
    "v_vec": (
        (),
        """SELECT vec_id AS candidate_id, vec_id % 10 AS campaign_id, vec_id // 10 AS episode,
        'c' || (label % 9) AS cell, list_transform(x, lambda v: (v + 1) / 2) AS vector,
        abs(x[1]) AS similarity, 1 - abs(x[2]) AS stability, x[3] > -0.2 AS valid
        FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)""",
    ),
    "v_grid": (
        (),
        """SELECT CAST(label AS BIGINT) AS candidate, vec_id AS scene, i - 1 AS pos, (i - 1) // 8 AS y, (i - 1) % 8 AS x,
        CAST(v > CAST(0.2 AS FLOAT) AS DOUBLE) AS impact, CAST(v < CAST(-0.3 AS FLOAT) AS DOUBLE) AS error
        FROM (SELECT label, vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)""",
    ),
    "v_li": (
        (),
        """SELECT l_orderkey AS scene, CAST(l_linenumber AS BIGINT) AS i, l_quantity AS x,
        l_extendedprice / 1000 AS y, l_discount * 10 AS r, l_quantity - 25 AS m,
        l_returnflag, l_linestatus, l_partkey FROM lineitem""",
    ),
    "v_edges": (
        (),
        """SELECT o_custkey AS src, o_custkey + 1 + o_orderkey % 997 AS dst, o_orderkey FROM orders""",
    ),
}


def with_views(names: tuple[str, ...], sql: str) -> str:
    """Prefix ``sql`` with the named views and those they build on."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for parent in VIEW_SQL[name][0]:
            visit(parent)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    if not ordered:
        return sql
    ctes = ",\n".join(f"{name} AS ({VIEW_SQL[name][1]})" for name in ordered)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        rest = body[5:].lstrip()
        if rest[:10].upper() == "RECURSIVE ":
            return f"WITH RECURSIVE {ctes},\n{rest[10:]}"
        return f"WITH {ctes},\n{rest}"
    return f"WITH {ctes}\n{body}"
