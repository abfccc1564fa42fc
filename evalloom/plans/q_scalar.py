"""Scalar function queries bound to the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom import views as v
from evalloom.functions import geometry as GE
from evalloom.functions import text as TX
from evalloom.functions.similarity import cell_key, rms_distance
from evalloom.operators import checks as C
from evalloom.plans.q_similarity import jaccard_sql, tokens_sql
from evalloom.registry import query
from evalloom.session import spread


@query(
    "tokens",
    views=(),
    sql=f"""SELECT doc_id, CAST(len({tokens_sql('text')}) AS INTEGER) AS n,
        md5(array_to_string(list_sort({tokens_sql('text')}), ' ')) AS digest FROM documents""",
)
def tokens(spark, d):
    found = TX.tokens(F.col("text"))
    return v.v_docs_spread(spark, d).select(
        "doc_id", F.size(found).alias("n"), F.md5(F.array_join(F.array_sort(found), " ")).alias("digest")
    )


@query(
    "jaccard",
    views=("v_turns",),
    sql=f"""WITH p AS (SELECT run, sequence, {tokens_sql('text')} AS a, {tokens_sql("split_part(text, chr(10), 1)")} AS b FROM v_turns)
    SELECT run, sequence, {jaccard_sql('a', 'b')} AS overlap FROM p""",
)
def jaccard(spark, d):
    first_line = F.split_part("text", F.lit("\n"), F.lit(1))
    return v.v_turns(spark, d).select(
        "run", "sequence", TX.jaccard(TX.tokens(F.col("text")), TX.tokens(first_line)).alias("overlap")
    )


@query(
    "rms_distance",
    views=("v_vec",),
    sql="""WITH c AS (SELECT campaign_id, arg_min(vector, candidate_id) AS c FROM v_vec GROUP BY 1)
    SELECT candidate_id, round(list_distance(vector, c) / 8, 9) AS distance FROM v_vec JOIN c USING (campaign_id)""",
)
def rms_distance_to_first(spark, d):
    vec = v.v_vec(spark, d)
    first = vec.groupBy("campaign_id").agg(F.min_by("vector", "candidate_id").alias("c"))
    return vec.join(first, "campaign_id").select(
        "candidate_id", F.round(rms_distance(F.col("vector"), F.col("c")), 9).alias("distance")
    )


@query(
    "normalize_answer",
    views=(),
    sql="""SELECT doc_id, md5(trim(regexp_replace(trim(replace(lower(nfc_normalize(text)), 'ß', 'ss'), chr(32) || chr(10)),
        '\\s+', ' ', 'g'), ' ' || chr(9) || chr(13) || chr(10) || '"' || chr(39) || '`.,:;!?')) AS digest FROM documents""",
)
def normalize_answer(spark, d):
    return v.v_docs_spread(spark, d).select("doc_id", F.md5(TX.normalize_answer(F.col("text"))).alias("digest"))


@query(
    "score_response",
    views=("v_ledger",),
    sql="""WITH r AS (SELECT event_id, completion_tokens AS k, CASE WHEN completion_tokens % 4 = 0 THEN ' YES. '
        WHEN completion_tokens % 4 = 1 THEN 'no' WHEN completion_tokens % 4 = 2 THEN 'Maybe' ELSE '"no"' END AS a FROM v_ledger),
    s AS (SELECT *, CASE WHEN k % 11 = 0 THEN 'refused' WHEN k % 4 = 2 OR k % 5 = 0 OR k % 7 = 0 OR k % 9 = 0 OR k > 95
        THEN 'unparseable' ELSE 'scored' END AS status FROM r)
    SELECT event_id, status, CASE WHEN status = 'scored' THEN CASE WHEN k % 4 = 0 THEN 'yes' ELSE 'no' END END AS prediction,
        CASE WHEN status = 'scored' THEN CAST(k / 100 AS DOUBLE) END AS confidence,
        CASE WHEN status = 'scored' THEN k % 4 <> 0 END AS correct FROM s""",
)
def score_response(spark, d):
    k = F.col("completion_tokens")
    answer = (
        F.when(k % 4 == 0, " YES. ").when(k % 4 == 1, "no").when(k % 4 == 2, "Maybe").otherwise('\\"no\\"')
    )
    confidence = (
        F.when(k % 7 == 0, "true").when(k > 95, "1.5").otherwise((k / 100).cast("string"))
    )
    extra = F.when(k % 5 == 0, ', "note": 1').otherwise("")
    content = F.concat(
        F.lit('{"answer": "'), answer, F.lit('", "confidence": '), confidence, extra, F.when(k % 9 == 0, "").otherwise("}")
    )
    ledger = spread(v.v_ledger(spark, d), "event_id").select(
        "event_id",
        content.alias("content"),
        F.array(F.lit("yes"), F.lit("no")).alias("candidates"),
        F.lit("no").alias("gold"),
        F.when(k % 11 == 0, "declined").alias("refusal"),
    )
    return TX.score_responses(ledger).select("event_id", "status", "prediction", "confidence", "correct")


@query(
    "contains_phrase",
    views=(),
    sql="""SELECT doc_id, contains(' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ', ' of the ')
        AS found FROM documents""",
)
def contains_phrase(spark, d):
    return v.v_docs_spread(spark, d).select("doc_id", TX.contains_phrase(F.col("text"), F.lit("of-the")).alias("found"))


@query(
    "redact",
    views=(),
    sql="""SELECT doc_id, md5(replace(replace(text, split_part(text, ' ', 1), '[BLINDED_AGENT]'), source, '[BLINDED_MODEL]'))
        AS digest FROM documents""",
)
def redact(spark, d):
    first = F.split_part("text", F.lit(" "), F.lit(1))
    blind = TX.redact(F.col("text"), [(first, "[BLINDED_AGENT]"), (F.col("source"), "[BLINDED_MODEL]"), (F.lit(""), "x")])
    return v.v_docs_spread(spark, d).select("doc_id", F.md5(blind).alias("digest"))


@query(
    "effort_signals",
    views=("v_ledger",),
    sql="""SELECT event_id, greatest(completion_tokens - reasoning_tokens, 0) AS visible_output_tokens,
        round(completion_tokens / 80, 6) AS budget_fraction,
        CASE WHEN completion_tokens <> 0 THEN round(reasoning_tokens / completion_tokens, 6) END AS reasoning_fraction,
        length(status || '  by ' || evaluator) AS rationale_characters, CAST(3 AS BIGINT) AS rationale_words
        FROM v_ledger WHERE reasoning_tokens IS NOT NULL
    UNION ALL SELECT event_id, NULL, round(completion_tokens / 80, 6), NULL, length(status || '  by ' || evaluator), 3
        FROM v_ledger WHERE reasoning_tokens IS NULL""",
)
def effort_signals(spark, d):
    rationale = F.concat("status", F.lit("  by "), "evaluator")
    signals = TX.effort_signals(F.col("completion_tokens"), F.col("reasoning_tokens"), 80, rationale)
    return v.v_ledger(spark, d).select("event_id", F.inline(F.array(signals)))


@query(
    "cell_key",
    views=("v_reports",),
    sql="""SELECT 'lang=' || lang || '|size=' || size_class AS cell, count(*) AS n FROM v_reports GROUP BY 1""",
)
def cell_keys(spark, d):
    key = cell_key({"lang": F.col("lang"), "size": F.col("size_class")})
    return v.v_reports(spark, d).groupBy(key.alias("cell")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "angle_bucket",
    views=("v_li",),
    sql="""WITH a AS (SELECT (x * 13 - y) AS deg FROM v_li), m AS (SELECT deg - 180 * floor(deg / 180) AS a FROM a)
    SELECT CASE WHEN a < 22.5 OR a >= 157.5 THEN 'horizontal' WHEN a < 67.5 THEN 'rising' WHEN a < 112.5 THEN 'vertical'
        ELSE 'falling' END AS axis, count(*) AS n FROM m GROUP BY 1""",
)
def angle_bucket(spark, d):
    degrees = F.col("x") * 13 - F.col("y")
    return v.v_li(spark, d).groupBy(GE.angle_bucket(degrees).alias("axis")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "bit_codes",
    views=("v_grid",),
    sql="""WITH g AS (SELECT scene, max(impact) FILTER (pos = 0) AS b0, max(impact) FILTER (pos = 1) AS b1,
        max(impact) FILTER (pos = 2) AS b2, max(impact) FILTER (pos = 8) AS b3, max(impact) FILTER (pos = 9) AS b4,
        max(impact) FILTER (pos = 10) AS b5, max(impact) FILTER (pos = 16) AS b6, max(impact) FILTER (pos = 17) AS b7,
        max(impact) FILTER (pos = 18) AS b8 FROM v_grid GROUP BY scene),
    c AS (SELECT scene, CAST(b0 + 2 * b1 + 4 * b2 + 8 * b3 + 16 * b4 + 32 * b5 + 64 * b6 + 128 * b7 + 256 * b8 AS BIGINT) AS code FROM g)
    SELECT scene, code, code & 1 AS low_bit, code % 3 = 0 AS by_three FROM c""",
)
def bit_codes(spark, d):
    cells = [F.col("impact")[y * 8 + x] > 0 for y in range(3) for x in range(3)]
    coded = v.v_grid(spark, d).select("scene", GE.pack_bits(cells).alias("code"))
    return coded.select("scene", "code", GE.low_bit(F.col("code")).alias("low_bit"), GE.divisible(F.col("code"), 3).alias("by_three"))


@query(
    "transpose_bits",
    views=("v_ledger",),
    sql="""WITH b AS (SELECT event_id, lpad(CAST(event_id AS VARCHAR), 9, '0') AS b FROM v_ledger)
    SELECT event_id, b[1] || b[4] || b[7] || b[2] || b[5] || b[8] || b[3] || b[6] || b[9] AS bits FROM b""",
)
def transpose_bits(spark, d):
    bits = F.lpad(F.col("event_id").cast("string"), 9, "0")
    return v.v_ledger(spark, d).select("event_id", GE.transpose_bits(bits).alias("bits"))


@query(
    "lens_area",
    views=("v_li",),
    sql="""WITH c AS (SELECT DISTINCT r + 1 AS r1, x / 10 AS r2, y / 20 AS d FROM v_li),
    a AS (SELECT *, CASE WHEN d >= r1 + r2 OR d <= abs(r1 - r2) THEN 0 ELSE acos((d * d + r1 * r1 - r2 * r2) / (2 * d * r1)) END AS h1,
        CASE WHEN d >= r1 + r2 OR d <= abs(r1 - r2) THEN 0 ELSE acos((d * d + r2 * r2 - r1 * r1) / (2 * d * r2)) END AS h2 FROM c)
    SELECT round(r1, 9) AS r1, round(r2, 9) AS r2, round(d, 9) AS d, round(CASE WHEN d >= r1 + r2 THEN 0.0
        WHEN d <= abs(r1 - r2) THEN pi() * least(r1, r2) * least(r1, r2)
        ELSE r1 * r1 * (h1 - sin(2 * h1) / 2) + r2 * r2 * (h2 - sin(2 * h2) / 2) END, 5) AS area FROM a""",
)
def lens_area(spark, d):
    circles = v.v_li(spark, d).select(
        (F.col("r") + 1).alias("r1"), (F.col("x") / 10).alias("r2"), (F.col("y") / 20).alias("d")
    ).distinct()
    area = GE.lens_area(F.col("r1"), F.col("r2"), F.col("d"))
    return circles.select(F.round("r1", 9).alias("r1"), F.round("r2", 9).alias("r2"), F.round("d", 9).alias("d"), F.round(area, 5).alias("area"))


@query(
    "truncate_text",
    views=(),
    sql="SELECT doc_id, md5(left(text, 1000)) AS digest, least(length(text), 1000) AS n FROM documents",
)
def truncate_text(spark, d):
    short = TX.truncate(F.col("text"), 1000)
    return v.v_docs(spark, d).select("doc_id", F.md5(short).alias("digest"), F.length(short).cast("bigint").alias("n"))
