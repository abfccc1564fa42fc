"""Contract checks bound to the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom import views as v
from evalloom.functions import text as TX
from evalloom.operators import checks as C
from evalloom.plans.q_panel import _episode_rows, _COMPLETE_SQL
from evalloom.operators import panel as P
from evalloom.registry import query


def _raw_ledger(spark, d):
    """Ledger rows as raw JSON: a null value is written as an absent key."""
    ledger = v.v_ledger(spark, d)
    return ledger.select(
        "event_id",
        "reasoning_tokens",
        F.to_json(F.struct("event_id", "sample_key", "status", "completion_tokens", "reasoning_tokens")).alias("raw"),
    )


@query(
    "check_required_keys",
    views=("v_ledger",),
    sql="""SELECT event_id, unnest([{'r': 'missing_keys', 'd': 'created_at' || CASE WHEN reasoning_tokens IS NULL
        THEN ',reasoning_tokens' ELSE '' END}, {'r': 'unknown_keys', 'd': 'completion_tokens'}], recursive := true)
        FROM v_ledger""".replace("'r'", "'rule'").replace("'d'", "'detail'"),
)
def check_required_keys(spark, d):
    required = ["event_id", "sample_key", "status", "reasoning_tokens", "created_at"]
    return C.violations(_raw_ledger(spark, d), ["event_id"], C.required_key_rules(F.col("raw"), required, exact=True))


@query(
    "check_closed_choice",
    views=("v_examples",),
    sql="""WITH c AS (SELECT e.doc_id, CASE WHEN n_chars % 5 = 0 THEN [lang] WHEN n_chars % 5 = 1 THEN ['en', lang, 'fr']
        ELSE ['en', 'de'] END AS cs, lang AS a FROM v_examples e JOIN documents USING (doc_id))
    SELECT doc_id, 'too_few_candidates' AS rule, CAST(len(cs) AS VARCHAR) AS detail FROM c WHERE len(cs) < 2
    UNION ALL SELECT doc_id, 'repeated_candidates', CAST(len(cs) AS VARCHAR) FROM c WHERE len(list_distinct(cs)) < len(cs)
    UNION ALL SELECT doc_id, 'answer_outside_candidates', a FROM c WHERE NOT list_contains(cs, a)""",
)
def check_closed_choice(spark, d):
    docs = v.v_docs(spark, d)
    candidates = (
        F.when(F.col("n_chars") % 5 == 0, F.array("lang"))
        .when(F.col("n_chars") % 5 == 1, F.array(F.lit("en"), "lang", F.lit("fr")))
        .otherwise(F.array(F.lit("en"), F.lit("de")))
    )
    return C.violations(docs, ["doc_id"], C.closed_choice_rules(candidates, F.col("lang")))


@query(
    "choice_text",
    views=("v_examples",),
    sql="""SELECT doc_id, CASE n_chars % 6 WHEN 0 THEN CAST(n_chars AS VARCHAR) WHEN 1 THEN CAST(n_chars / 4.0 AS VARCHAR)
        WHEN 4 THEN source WHEN 5 THEN CAST(-n_chars AS VARCHAR) END AS choice FROM documents
        WHERE n_chars % 6 NOT IN (2, 3)""",
)
def choice_text(spark, d):
    n = F.col("n_chars")
    raw = (
        F.when(n % 6 == 0, n.cast("string"))
        .when(n % 6 == 1, (n / 4.0).cast("string"))
        .when(n % 6 == 2, "true")
        .when(n % 6 == 3, '"  "')
        .when(n % 6 == 4, F.concat(F.lit('"'), "source", F.lit('"')))
        .otherwise((-n).cast("string"))
    )
    return v.v_docs(spark, d).select("doc_id", TX.choice_text(raw).alias("choice")).filter("choice IS NOT NULL")


@query(
    "check_relative_path",
    views=("v_files",),
    sql="""WITH p AS (SELECT page_id, CASE bytes % 4 WHEN 0 THEN '/' || path WHEN 1 THEN 'a/../' || path WHEN 2 THEN ''
        ELSE path END AS p FROM v_files)
    SELECT page_id, 'empty' AS rule, p AS detail FROM p WHERE p = ''
    UNION ALL SELECT page_id, 'absolute', p FROM p WHERE p LIKE '/%'
    UNION ALL SELECT page_id, 'parent_step', p FROM p WHERE regexp_matches(p, '(^|/)\\.\\.(/|$)')""",
)
def check_relative_path(spark, d):
    n = F.col("bytes") % 4
    path = (
        F.when(n == 0, F.concat(F.lit("/"), "path"))
        .when(n == 1, F.concat(F.lit("a/../"), "path"))
        .when(n == 2, "")
        .otherwise(F.col("path"))
    )
    return C.violations(v.v_files(spark, d), ["page_id"], C.relative_path_rules(path))


_BRANDS = [f"Brand#{i}" for i in range(1, 21)]
_WORDS = ["small", "red", "ring", "widget", "large", "blue", "steel", "plate"]
_TYPES = ["STANDARD", "ECONOMY", "MEDIUM", "PROMO", "LARGE", "SMALL"]


@query(
    "check_fingerprint",
    views=("v_fp",),
    sql=f"""SELECT id, 'relation_invalid' AS rule, relation AS detail FROM v_fp WHERE relation NOT IN {tuple(_BRANDS)}
    UNION ALL SELECT id, 'margin_operator_invalid', margin_operator FROM v_fp WHERE margin_operator NOT IN {tuple(_TYPES[:5])}
    UNION ALL SELECT id, 'entities_invalid', array_to_string(list_sort(entities), ',') FROM v_fp
        WHERE len(list_distinct(entities)) < len(entities) OR NOT list_has_all({_WORDS}, entities)
    UNION ALL SELECT id, 'primitives_invalid', array_to_string(list_sort(primitives), ',') FROM v_fp
        WHERE NOT list_has_all({_TYPES + ['x0', 'x1']}, primitives)
    UNION ALL SELECT id, 'depth_invalid', CAST(depth AS VARCHAR) FROM v_fp WHERE depth NOT BETWEEN 1 AND 3""",
)
def check_fingerprint(spark, d):
    rules = C.fingerprint_rules(
        {"relation": _BRANDS, "margin_operator": _TYPES[:5]},
        {"entities": _WORDS, "primitives": [*_TYPES, "x0", "x1"]},
        F.col("depth"),
        (1, 3),
    )
    return C.violations(v.v_fp(spark, d), ["id"], rules)


@query(
    "check_signature",
    views=("v_fp",),
    sql="""WITH s AS (SELECT id, replace(lower(relation), '#', CASE WHEN family = 0 THEN '#' ELSE '_' END) AS dv,
        CASE WHEN depth = 4 THEN upper(margin_operator) ELSE lower(margin_operator) END AS st,
        ['yesno', 'comparison', 'selection', 'threshold', 'other'][family + 1] AS sig,
        ['yesno', 'comparison', 'selection', 'threshold', 'other'][arity + 1] AS dec,
        text || ' of ' || margin_operator AS mech FROM v_fp)
    SELECT id, 'decision_var_invalid' AS rule, dv AS detail FROM s WHERE NOT regexp_full_match(dv, '[a-z][a-z0-9_]{2,63}')
    UNION ALL SELECT id, 'structure_invalid', st FROM s WHERE NOT regexp_full_match(st, '[a-z][a-z0-9_]{2,63}')
    UNION ALL SELECT id, 'declared_type_unknown', dec FROM s WHERE dec = 'other'
    UNION ALL SELECT id, 'signature_type_unknown', sig FROM s WHERE sig = 'other'
    UNION ALL SELECT id, 'decision_type_disagrees', sig || '>' || dec FROM s WHERE sig <> 'other' AND sig <> dec
    UNION ALL SELECT id, 'mechanism_too_short', CAST(length(mech) AS VARCHAR) FROM s WHERE length(mech) < 20""",
)
def check_signature(spark, d):
    kinds = C.literals(["yesno", "comparison", "selection", "threshold", "other"])
    mark = F.when(F.col("family") == 0, "#").otherwise("_")
    fp = v.v_fp(spark, d)
    rules = C.signature_rules(
        F.replace(F.lower("relation"), F.lit("#"), mark),
        F.when(F.col("depth") == 4, F.upper("margin_operator")).otherwise(F.lower("margin_operator")),
        F.element_at(kinds, (F.col("family") + 1).cast("int")),
        F.element_at(kinds, (F.col("arity") + 1).cast("int")),
        F.concat("text", F.lit(" of "), "margin_operator"),
    )
    return C.violations(fp, ["id"], rules)


@query(
    "check_text_lengths",
    views=(),
    sql="""SELECT doc_id, 'text_length' AS rule, CAST(length(trim(text, ' ')) AS VARCHAR) AS detail FROM documents
        WHERE length(trim(text, ' ')) NOT BETWEEN 80 AND 2000
    UNION ALL SELECT doc_id, 'source_length', CAST(length(source) AS VARCHAR) FROM documents WHERE length(source) NOT BETWEEN 5 AND 64""",
)
def check_text_lengths(spark, d):
    return C.violations(v.v_docs(spark, d), ["doc_id"], C.length_rules({"text": (80, 2000), "source": (5, 64)}))


@query(
    "check_hypothesis",
    views=("v_panel",),
    sql=f"""WITH {_COMPLETE_SQL},
    a AS (SELECT e.*, (e.episode + 2) % 3 AS t, coalesce(CAST((SELECT p.candidate FROM r p WHERE p.complete
        AND p.target = (e.episode + 2) % 3 AND p.episode < e.episode
        ORDER BY p.accuracy, p.episode DESC, p.candidate LIMIT 1) AS VARCHAR), 'initial_profile') AS parent FROM r e),
    h AS (SELECT *, (episode * episode + 2) % 3 AS ct, CASE WHEN episode % 4 = 0 THEN 'x' ELSE parent END AS cp,
        [candidate, candidate // 2, candidate % 7] AS ev, accuracy * 1.8 AS pa FROM a)
    SELECT candidate, 'target_not_assigned' AS rule, CAST(ct AS VARCHAR) AS detail FROM h WHERE ct <> t
    UNION ALL SELECT candidate, 'parent_not_assigned', cp FROM h WHERE cp <> parent
    UNION ALL SELECT candidate, 'evidence_invalid', '3' FROM h WHERE len(list_distinct(ev)) < 3
    UNION ALL SELECT candidate, 'predicted_accuracy_invalid', CAST(round(pa, 6) AS VARCHAR) FROM h WHERE pa > 1""",
)
def check_hypothesis(spark, d):
    rows = _episode_rows(spark, d)
    assigned = P.branch_assignment(rows, 3, F.expr("episode div 100000")).select(
        "candidate", F.col("target").alias("assigned"), "parent"
    )
    joined = rows.join(assigned, "candidate")
    rules = C.hypothesis_rules(
        (F.col("episode") * F.col("episode") + 2) % 3,
        F.col("assigned"),
        F.when(F.col("episode") % 4 == 0, "x").otherwise(F.col("parent")),
        F.col("parent"),
        F.array("candidate", F.expr("candidate div 2"), F.col("candidate") % 7),
        F.col("accuracy") * 1.8,
    )
    return C.violations(joined, ["candidate"], rules)


@query(
    "check_vector",
    views=("v_vec",),
    sql="""WITH x AS (SELECT candidate_id, CASE WHEN episode % 5 = 0 THEN vector[1:63] ELSE vector END AS vec FROM v_vec),
    w AS (SELECT candidate_id, list_transform(vec, lambda a: (a - 0.5) * 4 + 0.5) AS vec FROM x)
    SELECT candidate_id, 'wrong_size' AS rule, CAST(len(vec) AS VARCHAR) AS detail FROM w WHERE len(vec) <> 64
    UNION ALL SELECT candidate_id, 'out_of_range', CAST(len(list_filter(vec, lambda a: a < 0 OR a > 1)) AS VARCHAR)
    FROM w WHERE len(list_filter(vec, lambda a: a < 0 OR a > 1)) > 0""",
)
def check_vector(spark, d):
    short = F.when(F.col("episode") % 5 == 0, F.slice("vector", 1, 63)).otherwise(F.col("vector"))
    wide = v.v_vec(spark, d).select("candidate_id", F.transform(short, lambda a: (a - 0.5) * 4 + 0.5).alias("vec"))
    return C.violations(wide, ["candidate_id"], C.vector_rules(F.col("vec"), 64))


@query(
    "quarantine_filter",
    views=("v_manifest",),
    sql="SELECT scene_id, prompt_family, answer, margin FROM v_manifest WHERE NOT quarantined",
)
def quarantine_filter(spark, d):
    return v.v_manifest(spark, d).filter(~F.col("quarantined")).select("scene_id", "prompt_family", "answer", "margin")


@query(
    "all_quarantined",
    views=("v_manifest",),
    sql="""SELECT image_path, count(*) AS n FROM v_manifest GROUP BY 1 HAVING bool_and(quarantined)""",
)
def all_quarantined(spark, d):
    return (
        v.v_manifest(spark, d)
        .groupBy("image_path")
        .agg(F.count(F.lit(1)).alias("n"), F.bool_and("quarantined").alias("q"))
        .filter("q")
        .drop("q")
    )


_GAP_SQL = """CASE WHEN {m} BETWEEN 20 AND 80 THEN 'far_separate' WHEN {m} BETWEEN 1 AND 20 THEN 'near_separate'
    WHEN {m} BETWEEN -1 AND 1 THEN 'tangent' WHEN {m} BETWEEN -20 AND -1 THEN 'near_overlap'
    WHEN {m} BETWEEN -80 AND -20 THEN 'deep_overlap' END"""
_ANGLE_SQL = """CASE WHEN {m} BETWEEN 10 AND 60 THEN 'far_acute' WHEN {m} BETWEEN 2 AND 10 THEN 'near_acute'
    WHEN {m} BETWEEN -2 AND 2 THEN 'right' WHEN {m} BETWEEN -10 AND -2 THEN 'near_obtuse'
    WHEN {m} BETWEEN -60 AND -10 THEN 'far_obtuse' END"""


@query(
    "margin_bin",
    views=("v_li",),
    sql=f"""SELECT {_GAP_SQL.format(m='m')} AS gap_bin, {_ANGLE_SQL.format(m='m')} AS angle_bin, count(*) AS n,
        min(m) AS low, max(m) AS high FROM v_li GROUP BY ALL""",
)
def margin_bin(spark, d):
    m = F.col("m")
    return (
        v.v_li(spark, d)
        .groupBy(C.first_bin(m, C.GAP_BINS).alias("gap_bin"), C.first_bin(m, C.ANGLE_BINS).alias("angle_bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("low"), F.max("m").alias("high"))
    )


@query(
    "margin_bin_rows",
    views=("v_examples",),
    sql=f"SELECT doc_id, margin, {_GAP_SQL.format(m='margin')} AS gap_bin FROM v_examples",
)
def margin_bin_rows(spark, d):
    return v.v_examples(spark, d).select(
        "doc_id", "margin", C.first_bin(F.col("margin"), C.GAP_BINS).alias("gap_bin")
    )


_GOLD_FAMILIES = {
    "gap": [*C.GAP_OVERLAP_FAMILIES, *C.GAP_SEPARATE_FAMILIES, C.GAP_CHOICE_FAMILY],
    "angle": [*C.ACUTE_FAMILIES, C.OBTUSE_FAMILY, C.ACUTE_CHOICE_FAMILY],
    "count": [*C.COUNT_FAMILIES, C.MORE_THAN_FAMILY, C.AT_MOST_FAMILY, C.EXACTLY_FAMILY],
}


@query(
    "gold_answer",
    views=("v_examples",),
    sql=f"""WITH f AS (SELECT unnest({[w + ':' + x for w, xs in _GOLD_FAMILIES.items() for x in xs]}) AS wf),
    x AS (SELECT doc_id, split_part(wf, ':', 1) AS world, split_part(wf, ':', 2) AS prompt_family, margin,
          abs(CAST(margin AS BIGINT)) % 8 AS n FROM v_examples, f)
    SELECT doc_id, world, prompt_family, CASE world
        WHEN 'gap' THEN CASE WHEN prompt_family IN {C.GAP_SEPARATE_FAMILIES} THEN CASE WHEN margin <= 0 THEN 'no' ELSE 'yes' END
            WHEN prompt_family = '{C.GAP_CHOICE_FAMILY}' THEN CASE WHEN margin <= 0 THEN 'B' ELSE 'A' END
            ELSE CASE WHEN margin <= 0 THEN 'yes' ELSE 'no' END END
        WHEN 'angle' THEN CASE WHEN prompt_family IN {C.ACUTE_FAMILIES} THEN CASE WHEN margin > 0 THEN 'yes' ELSE 'no' END
            WHEN prompt_family = '{C.OBTUSE_FAMILY}' THEN CASE WHEN margin < 0 THEN 'yes' ELSE 'no' END
            ELSE CASE WHEN margin >= 0 THEN 'A' ELSE 'B' END END
        ELSE CASE WHEN prompt_family IN {C.COUNT_FAMILIES} THEN CAST(n AS VARCHAR)
            WHEN prompt_family = '{C.MORE_THAN_FAMILY}' THEN CASE WHEN n > 3 THEN 'yes' ELSE 'no' END
            WHEN prompt_family = '{C.AT_MOST_FAMILY}' THEN CASE WHEN n <= 3 THEN 'yes' ELSE 'no' END
            ELSE CASE WHEN n = 4 THEN 'yes' ELSE 'no' END END END AS answer FROM x""",
)
def gold_answer(spark, d):
    pairs = F.array(
        *[F.struct(F.lit(w).alias("world"), F.lit(x).alias("prompt_family")) for w, xs in _GOLD_FAMILIES.items() for x in xs]
    )
    rows = v.v_examples(spark, d).select("doc_id", "margin", F.inline(pairs))
    family, margin = F.col("prompt_family"), F.col("margin")
    count = F.abs(margin).cast("bigint") % 8
    answer = (
        F.when(F.col("world") == "gap", C.gap_answer(family, margin))
        .when(F.col("world") == "angle", C.angle_answer(family, margin))
        .otherwise(C.count_answer(family, count))
    )
    return rows.select("doc_id", "world", "prompt_family", answer.alias("answer"))


_ELIGIBLE_SQL = """coalesce(quality IS NOT NULL AND toxic = 0 AND quality = 1 AND n_chars >= 200 AND lang = 'en', false)"""


def _eligible(reports):
    return C.eligible(
        F.col("quality").isNotNull(),
        F.when(F.col("toxic") == 0, 1.0),
        [F.col("quality") == 1, F.col("n_chars") >= 200, F.col("lang") == "en"],
    )


@query("eligible", views=("v_reports",), sql=f"SELECT candidate_id, {_ELIGIBLE_SQL} AS eligible FROM v_reports")
def eligible(spark, d):
    reports = v.v_reports(spark, d)
    return reports.select("candidate_id", _eligible(reports).alias("eligible"))


@query(
    "transaction_status",
    views=("v_reports",),
    sql=f"""WITH e AS (SELECT candidate_id, {_ELIGIBLE_SQL} AS e, n_chars % 3 <> 0 AS audited,
        n_chars % 5 <> 0 AND n_chars % 7 <> 0 AND sha < 'c' AND (n_chars % 2 = 0 OR n_chars % 4 = 1) AS ev FROM v_reports)
    SELECT candidate_id, NOT audited OR NOT e OR ev AS commit_complete, audited AND e AND NOT ev AS process_incomplete,
        e AND NOT (audited AND e AND NOT ev) AS seed_eligible FROM e""",
)
def transaction_status(spark, d):
    reports = v.v_reports(spark, d)
    n = F.col("n_chars")
    status = C.transaction_status(
        _eligible(reports),
        n % 3 != 0,
        F.when(n % 5 != 0, n),
        F.when(n % 7 != 0, n),
        F.col("sha") < "c",
        F.array(
            F.when(n % 2 == 0, "passed").otherwise("failed"), F.when(n % 4 == 1, "passed").otherwise("failed")
        ),
    )
    return reports.select("candidate_id", F.inline(F.array(status)))


@query(
    "check_audit_doc",
    views=("v_turns",),
    sql="""WITH t AS (SELECT run, sequence, CASE WHEN attempt % 2 = 0 THEN '# Human audit' ELSE '# Audit' END || chr(10)
        || 'Reviewer: ' || CASE WHEN length(text) % 3 = 0 THEN 'TODO' ELSE role END || chr(10)
        || '| prompt family |' || chr(10) || '`f_good`' || CASE WHEN length(text) % 5 = 0 THEN '' ELSE ' `f_not_good`' END
        || chr(10) || 'Signed-off-by: ' || CASE WHEN outcome = 'failed' THEN '____' ELSE '**' || role || '**' END AS doc,
        attempt, length(text) AS n, outcome FROM v_turns)
    SELECT run, sequence, CASE WHEN attempt % 2 = 0 THEN '' ELSE '# Human audit' END AS missing_sections,
        CASE WHEN n % 5 = 0 THEN 'f_not_good' ELSE '' END AS missing_families,
        n % 3 <> 0 AND outcome = 'passed' AS signed FROM t""",
)
def check_audit_doc(spark, d):
    n = F.length("text")
    doc = F.concat(
        F.when(F.col("attempt") % 2 == 0, "# Human audit").otherwise("# Audit"),
        F.lit("\nReviewer: "),
        F.when(n % 3 == 0, "TODO").otherwise(F.col("role")),
        F.lit("\n| prompt family |\n`f_good`"),
        F.when(n % 5 == 0, "").otherwise(" `f_not_good`"),
        F.lit("\nSigned-off-by: "),
        F.when(F.col("outcome") == "failed", "____").otherwise(F.concat(F.lit("**"), "role", F.lit("**"))),
    )
    audit = C.audit_document(doc, ["f_good", "f_not_good"])
    return v.v_turns(spark, d).select("run", "sequence", F.inline(F.array(audit)))


@query(
    "check_boundary_text",
    views=(),
    sql="""SELECT source, count(*) AS documents, count(*) FILTER (trim(CASE WHEN n_chars % 4 = 0 THEN '  ' ELSE text END) = '')
        AS blank FROM documents GROUP BY source""",
)
def check_boundary_text(spark, d):
    declared = F.when(F.col("n_chars") % 4 == 0, "  ").otherwise(F.col("text"))
    blank = F.length(F.trim(F.coalesce(declared, F.lit("")))) == 0
    return v.v_docs(spark, d).groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(blank).alias("blank")
    )


@query(
    "check_source_rows",
    views=("v_fp",),
    sql="""WITH s AS (SELECT id, text, count(*) OVER (PARTITION BY text, relation) AS copies,
        CASE WHEN depth = 1 THEN [entities, primitives] WHEN depth = 2 THEN [entities, primitives, ['']]
        ELSE [entities, primitives, [relation]] END AS g, id % 97 / 90 AS f FROM v_fp)
    SELECT id, 'repeated_id' AS rule, CAST(copies AS VARCHAR) AS detail FROM s WHERE copies > 1
    UNION ALL SELECT id, 'concept_groups_invalid', CAST(len(g) AS VARCHAR) FROM s WHERE len(g) < 3 OR g[3][1] = ''
    UNION ALL SELECT id, 'floor_invalid', CAST(f AS VARCHAR) FROM s WHERE f > 1""",
)
def check_source_rows(spark, d):
    fp = v.v_fp(spark, d)
    copies = fp.groupBy("text", "relation").agg(F.count(F.lit(1)).alias("copies"))
    groups = (
        F.when(F.col("depth") == 1, F.array("entities", "primitives"))
        .when(F.col("depth") == 2, F.array("entities", "primitives", F.array(F.lit(""))))
        .otherwise(F.array("entities", "primitives", F.array("relation")))
    )
    rules = C.source_row_rules(groups, F.col("id") % 97 / 90, F.col("copies"))
    return C.violations(fp.join(copies, ["text", "relation"]), ["id"], rules)


@query(
    "size_limits",
    views=("v_files",),
    sql="""SELECT root, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS total_bytes, count(*) > 5 AS too_many_files,
        sum(bytes) > 30000 AS too_large FROM v_files GROUP BY root HAVING count(*) > 5 OR sum(bytes) > 30000""",
)
def size_limits(spark, d):
    return C.size_limits(v.v_files(spark, d), "root", "bytes", 5, 30000)


@query(
    "forbidden_fields",
    views=("v_ledger",),
    sql="""SELECT event_id, reasoning_tokens IS NOT NULL AND reasoning_tokens > 20 AS forbidden FROM v_ledger""",
)
def forbidden_fields(spark, d):
    inner = F.to_json(
        F.struct(
            F.concat(F.lit('"answer":'), "status").alias("note"),
            F.array(F.struct(F.when(F.col("reasoning_tokens") > 20, F.col("status")).alias("gold_answer"))).alias("items"),
        )
    )
    return v.v_ledger(spark, d).select("event_id", C.has_forbidden_field(inner, ["gold_answer", "answer"]).alias("forbidden"))


@query(
    "secret_scan",
    views=(),
    sql="""SELECT doc_id, CASE WHEN contains(text, 'token = ') THEN 'value' WHEN contains(text, 'dG9rZW4gPSA=') THEN 'base64'
        ELSE 'pattern' END AS hit FROM documents WHERE contains(text, 'token = ') OR contains(text, 'dG9rZW4gPSA=')
        OR regexp_matches(text, '[a-z0-9.]+@[a-z0-9]+\\.example\\.com')""",
)
def secret_scan(spark, d):
    patterns = (*C.SECRET_PATTERNS, r"[a-z0-9.]+@[a-z0-9]+\.example\.com")
    hit = C.secret_hit(F.col("text"), ["token = "], patterns)
    return v.v_docs_spread(spark, d).select("doc_id", hit.alias("hit")).filter("hit IS NOT NULL")


@query(
    "payload_allowlist",
    views=("v_files",),
    sql="""WITH r AS (SELECT root FROM v_files GROUP BY root ORDER BY count(*) DESC, root LIMIT 30),
    f AS (SELECT page_id, v.root, split_part(regexp_replace(path, '[?#].*$', ''), '/', -1) AS base, sha256 < '8' AS ok FROM v_files v)
    SELECT page_id, 'outside_payload' AS rule, root AS detail FROM f WHERE split_part(root, '.', 1) NOT IN ('m', 'blog', 'www')
    UNION ALL SELECT page_id, 'excluded_type', '.html' FROM f WHERE base LIKE '%.html' AND NOT ok
    UNION ALL SELECT page_id, 'excluded_name', base FROM f WHERE base IN ('825', '') """,
)
def payload_allowlist(spark, d):
    path = F.regexp_replace("path", r"[?#].*$", "")
    rules = C.payload_rules(
        F.col("host"), path, F.col("sha256") < "8", ["m", "blog", "www"], [".html", ".zip", ".log"], ["825", ""]
    )
    fixed = [(n, bad, F.col("root") if n == "outside_payload" else detail) for n, bad, detail in rules]
    files = v.v_files(spark, d).withColumn("host", F.substring_index("root", ".", 1))
    return C.violations(files, ["page_id"], fixed)


@query(
    "required_flags",
    views=("v_reports",),
    sql="""SELECT candidate_id, coalesce(g_quality AND g_clean, false) AND g_long AND g_english AS passed FROM v_reports""",
)
def required_flags(spark, d):
    return v.v_reports(spark, d).select(
        "candidate_id", C.required_flags(F.col("gates"), ["quality", "clean"]).alias("passed")
    )
