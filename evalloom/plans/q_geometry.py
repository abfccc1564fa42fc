"""Series, grid, point set and graph queries bound to the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom import views as v
from evalloom.operators import geometry as G
from evalloom.operators import graph as N
from evalloom.operators import rerender as X
from evalloom.operators import series as S
from evalloom.registry import query


def event_bucket():
    return F.expr("event_id div 1000000")


@query(
    "gap_clusters",
    views=("v_events",),
    sql="""WITH k AS (SELECT DISTINCT user_id, k FROM v_events), s AS (SELECT *, CASE WHEN k - lag(k) OVER w > 3 OR lag(k) OVER w
        IS NULL THEN 1 ELSE 0 END AS b FROM k WINDOW w AS (PARTITION BY user_id ORDER BY k)),
    c AS (SELECT *, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY k) AS BIGINT) AS cluster FROM s)
    SELECT user_id, cluster, count(*) AS n, avg(k) AS centre FROM c GROUP BY ALL""",
)
def gap_clusters(spark, d):
    rows = v.v_events(spark, d).select("user_id", "k").distinct()
    return S.gap_clusters(rows, ["user_id"], "k", 3, F.expr("k div 16"))


@query(
    "largest_gap_split",
    views=("v_events",),
    sql="""WITH s AS (SELECT user_id, value, lead(value) OVER (PARTITION BY user_id ORDER BY value, event_id) AS nxt FROM v_events),
    m AS (SELECT user_id, max((round(nxt - value, 9), value, nxt)) AS c FROM s WHERE nxt IS NOT NULL GROUP BY 1)
    SELECT user_id, c[1] AS gap, c[2] AS low, c[3] AS high, c[1] < 40 AS abstain FROM m""",
)
def largest_gap_split(spark, d):
    rows = v.v_events(spark, d).select("user_id", "event_id", "value")
    return S.largest_gap_split(rows, ["user_id"], ["value", "event_id"], "value", F.floor(F.col("value") / 64), 40.0)


@query(
    "smooth_and_count_cycles",
    views=("v_events",),
    sql="""WITH p AS (SELECT user_id, event_id, CAST(k AS DOUBLE) AS v, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY user_id) AS c,
        first_value(k) OVER w AS f, last_value(k) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING
        AND UNBOUNDED FOLLOWING) AS l FROM v_events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    m AS (SELECT *, (sum(v) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)
        + greatest(0, 4 - idx) * f + greatest(0, idx + 4 - (c - 1)) * l) / 9 AS smooth FROM p),
    q AS (SELECT user_id, quantile_cont(smooth, 0.04) AS low, quantile_cont(smooth, 0.96) AS high FROM m GROUP BY 1),
    a AS (SELECT m.user_id, idx, round(smooth - ((low + high) / 2 + 0.3 * ((high - low) / 2)), 9) > 0 AS above FROM m JOIN q USING (user_id)),
    g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY idx) - row_number() OVER (PARTITION BY user_id, above ORDER BY idx)
        AS grp FROM a),
    r AS (SELECT user_id, count(*) AS width FROM g WHERE above GROUP BY user_id, grp HAVING count(*) >= 3)
    SELECT q.user_id, count(width) AS cycles, min(width) AS narrowest, round((any_value(high) - any_value(low)) / 2, 6) AS amplitude
    FROM q LEFT JOIN r USING (user_id) GROUP BY 1""",
)
def smooth_and_count_cycles(spark, d):
    rows = v.v_events(spark, d).select("user_id", "event_id", F.col("k").cast("double").alias("v"))
    return S.count_cycles(
        rows, ["user_id"], ["event_id"], "v", event_bucket(), F.floor(F.col("smooth") / 8), minimum_run=3
    )


@query(
    "argmax_with_abstain",
    views=(),
    sql="""WITH s AS (SELECT source, n_chars // 500 AS size_class, lang, count(*) AS score FROM documents GROUP BY ALL),
    t AS (SELECT source, size_class, max(score) AS best_score FROM s GROUP BY ALL)
    SELECT t.source, t.size_class, CASE WHEN best_score >= 2 AND count(*) = 1 THEN min(lang) END AS label, best_score
    FROM t JOIN s ON s.source = t.source AND s.size_class = t.size_class AND s.score = t.best_score GROUP BY t.source, t.size_class, best_score""",
)
def argmax_with_abstain(spark, d):
    scores = v.v_docs(spark, d).groupBy("source", F.expr("n_chars div 500").alias("size_class"), "lang").agg(
        F.count(F.lit(1)).alias("score")
    )
    return S.argmax_with_abstain(scores, ["source", "size_class"], "lang", "score", 2)


_TEMPLATES = {"A": "0101010101", "B": "0011001100", "C": "0000011111"}


@query(
    "rle_expand_match",
    views=("v_events",),
    sql=f"""WITH r AS (SELECT user_id, event_id, k % 2 AS bit, 1 + k % 4 AS len, CAST(coalesce(sum(1 + k % 4) OVER (PARTITION BY user_id
        ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM v_events),
    c AS (SELECT user_id, bit, unnest(range(s, s + len)) AS pos FROM r)
    SELECT user_id, label, count(*) FILTER (CAST(bit AS VARCHAR) = t[pos % 10 + 1]) AS score, count(*) AS cells
    FROM c, (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _TEMPLATES.items())}) x(label, t) GROUP BY ALL""",
)
def rle_expand_match(spark, d):
    runs = v.v_events(spark, d).select(
        "user_id", "event_id", (F.col("k") % 2).alias("bit"), (1 + F.col("k") % 4).alias("len")
    )
    return S.rle_expand_match(runs, ["user_id"], "event_id", "bit", "len", event_bucket(), _TEMPLATES)


@query(
    "profile_residual",
    views=("v_events",),
    sql="""WITH t AS (SELECT user_id, k // 4 AS pos, avg(k) FILTER (event_type = 'click') AS l, avg(k) FILTER (event_type = 'view') AS r
        FROM v_events GROUP BY ALL),
    b AS (SELECT *, avg(l) OVER (PARTITION BY user_id) AS lm, avg(r) OVER (PARTITION BY user_id) AS rm FROM t WHERE l IS NOT NULL AND r IS NOT NULL),
    x AS (SELECT user_id, count(*) AS positions, avg(abs((l - lm) - (r - rm))) AS r FROM b GROUP BY 1)
    SELECT user_id, positions, round(r, 6) AS residual, CASE WHEN round(r, 9) < 1.25 THEN 'yes' ELSE 'no' END AS answer FROM x""",
)
def profile_residual(spark, d):
    at = lambda kind: F.avg(F.when(F.col("event_type") == kind, F.col("k")))
    traces = v.v_events(spark, d).groupBy("user_id", F.expr("k div 4").alias("pos")).agg(at("click").alias("l"), at("view").alias("r"))
    return S.profile_residual(traces, ["user_id"], "l", "r", 1.25)


@query(
    "rank_signature",
    views=("v_vec",),
    sql="""WITH s AS (SELECT candidate_id, campaign_id, list_sort([{'v': vector[1], 'n': 'a'}, {'v': vector[2], 'n': 'b'},
        {'v': vector[3], 'n': 'c'}, {'v': vector[4], 'n': 'd'}]) AS p FROM v_vec),
    g AS (SELECT candidate_id, campaign_id, CASE WHEN least(p[2].v - p[1].v, p[3].v - p[2].v, p[4].v - p[3].v) >= 0.002 THEN
        array_to_string(list_transform(['a', 'b', 'c', 'd'], lambda n: CAST(list_position(list_transform(p, lambda x: x.n), n) - 1 AS VARCHAR)), '')
        END AS sig FROM s),
    r AS (SELECT campaign_id, arg_min(sig, candidate_id) FILTER (sig IS NOT NULL) AS ref FROM g GROUP BY 1)
    SELECT candidate_id, sig, CAST((sig[1] <> ref[1])::INT + (sig[2] <> ref[2])::INT + (sig[3] <> ref[3])::INT + (sig[4] <> ref[4])::INT
        AS INTEGER) AS mismatches FROM g JOIN r USING (campaign_id)""",
)
def rank_signature(spark, d):
    x = F.col("vector")
    sig = S.rank_signature({"a": x[0], "b": x[1], "c": x[2], "d": x[3]}, 0.002)
    rows = v.v_vec(spark, d).select("candidate_id", "campaign_id", sig.alias("sig"))
    ref = rows.groupBy("campaign_id").agg(F.min_by("sig", F.when(F.col("sig").isNotNull(), F.col("candidate_id"))).alias("ref"))
    return rows.join(ref, "campaign_id").select(
        "candidate_id", "sig", S.signature_mismatch(F.col("sig"), F.col("ref"), 4).alias("mismatches")
    )


_MASKED = "mk AS (SELECT *, least(impact + error, 1) AS m FROM v_grid)"
_GEOM = f"""{_MASKED}, pt AS (SELECT candidate, scene, y, x FROM mk WHERE m > 0),
    mo AS (SELECT scene, count(*) AS n, var_pop(y) AS cyy, var_pop(x) AS cxx, covar_pop(y, x) AS cxy,
        (max(y) - min(y) + 1) * (max(x) - min(x) + 1) AS box FROM pt GROUP BY 1),
    sp AS (SELECT a.scene, max((a.y - b.y) ** 2 + (a.x - b.x) ** 2) AS d2 FROM pt a JOIN pt b USING (scene) GROUP BY 1),
    ge AS (SELECT s.scene, s.candidate, coalesce(n, 0) / 64 AS fraction, coalesce(sqrt(d2) / (sqrt(2) * 7), 0) AS span,
        CASE WHEN n > 1 THEN least(20.0, ((cyy + cxx) / 2 + sqrt(((cyy - cxx) / 2) ** 2 + cxy ** 2) + 0.05)
            / ((cyy + cxx) / 2 - sqrt(((cyy - cxx) / 2) ** 2 + cxy ** 2) + 0.05)) ELSE 1.0 END AS elongation,
        coalesce(n / box, 0) AS fill FROM (SELECT DISTINCT scene, candidate FROM v_grid) s LEFT JOIN mo USING (scene) LEFT JOIN sp USING (scene))"""
_COMP = """RECURSIVE walk AS (SELECT scene, y, x, y * 8 + x AS root FROM (SELECT scene, y, x FROM v_grid WHERE impact + error > 0)
        UNION SELECT w.scene, g.y, g.x, w.root FROM walk w JOIN v_grid g ON g.scene = w.scene AND g.impact + g.error > 0
        AND abs(g.y - w.y) + abs(g.x - w.x) = 1),
    lab AS (SELECT scene, y, x, min(root) AS component FROM walk GROUP BY ALL)"""


def _measured(spark, d):
    grid = v.v_grid(spark, d)
    return G.support_geometry(grid.withColumn("mask", G.support(F.col("impact"), F.col("error"))), "mask")


@query(
    "support_geometry",
    views=("v_grid",),
    sql=f"""WITH {_GEOM} SELECT scene, round(fraction, 9) AS fraction, round(span, 9) AS span, round(elongation, 6) AS elongation,
        round(fill, 9) AS fill FROM ge""",
)
def support_geometry(spark, d):
    g = _measured(spark, d)
    return g.select("scene", *[F.round(c, 9).alias(c) for c in ("fraction", "span", "fill")], F.round("elongation", 6).alias("elongation"))


@query(
    "component_count",
    views=("v_grid",),
    sql=f"""WITH {_COMP} SELECT s.scene, count(DISTINCT component) AS components FROM (SELECT DISTINCT scene FROM v_grid) s
        LEFT JOIN lab USING (scene) GROUP BY 1""",
)
def component_count(spark, d):
    return _measured(spark, d).select("scene", "components")


@query(
    "component_table",
    views=("v_grid",),
    sql=f"""WITH {_COMP} SELECT scene, component, count(*) AS size, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1,
        avg(y) AS cy, avg(x) AS cx FROM lab GROUP BY ALL HAVING count(*) >= 2""",
)
def component_table(spark, d):
    grid = v.v_grid(spark, d).withColumn("mask", G.support(F.col("impact"), F.col("error")))
    return G.component_table(grid, "scene", "mask", minimum=2)


_COMP_8 = _COMP.replace("abs(g.y - w.y) + abs(g.x - w.x) = 1", "greatest(abs(g.y - w.y), abs(g.x - w.x)) = 1")


@query(
    "component_table_diagonal",
    views=("v_grid",),
    sql=f"""WITH {_COMP_8} SELECT scene, component, count(*) AS size, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1,
        avg(y) AS cy, avg(x) AS cx FROM lab GROUP BY ALL HAVING count(*) >= 2""",
)
def component_table_diagonal(spark, d):
    grid = v.v_grid(spark, d).withColumn("mask", G.support(F.col("impact"), F.col("error")))
    return G.component_table(grid, "scene", "mask", minimum=2, diagonal=True)


@query(
    "component_labels_joined",
    views=("v_grid",),
    sql=f"WITH {_COMP} SELECT scene * 64 + y * 8 + x AS node, scene * 64 + component AS component FROM lab",
)
def component_labels_joined(spark, d):
    """The same components through the distributed graph form: one node per active cell."""
    grid = v.v_grid(spark, d)
    mask = G.support(F.col("impact"), F.col("error"))
    cells = grid.select("scene", F.posexplode(mask).alias("pos", "m")).filter("m > 0")
    nodes = cells.select((F.col("scene") * 64 + F.col("pos")).alias("node"), "pos")
    right = nodes.filter("pos % 8 < 7").select(F.col("node").alias("src"), (F.col("node") + 1).alias("dst"))
    down = nodes.filter("pos < 56").select(F.col("node").alias("src"), (F.col("node") + 8).alias("dst"))
    present = nodes.select(F.col("node").alias("dst"))
    edges = right.unionByName(down).join(present, "dst", "left_semi")
    return N.connected_components(nodes.select("node"), edges)


@query(
    "centre_grid",
    views=("v_grid",),
    sql=f"""WITH {_MASKED}, c AS (SELECT scene, CAST(round_even(3.5 - avg(y), 0) AS BIGINT) AS dy, CAST(round_even(3.5 - avg(x), 0) AS BIGINT) AS dx
        FROM mk WHERE m > 0 GROUP BY 1)
    SELECT scene, y + dy AS y, x + dx AS x FROM mk JOIN c USING (scene) WHERE m > 0 AND y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7""",
)
def centre_grid(spark, d):
    grid = v.v_grid(spark, d).withColumn("mask", G.support(F.col("impact"), F.col("error")))
    centred = G.centre_grid(grid, "mask", "mask", "centred")
    return (
        centred.select("scene", F.posexplode("centred").alias("pos", "on"))
        .filter("on > 0")
        .select("scene", F.expr("CAST(pos div 8 AS BIGINT)").alias("y"), F.expr("CAST(pos % 8 AS BIGINT)").alias("x"))
    )


_SCALE = """CASE WHEN {s} < 0.30 THEN 'focal' WHEN {s} < 0.65 THEN 'regional' ELSE 'distributed' END"""
_SHAPE = """CASE WHEN {c} >= 2 THEN 'multipart' WHEN {e} >= 2.75 OR ({f} <= 0.55 AND {s} > 0) THEN 'pathlike' ELSE 'compact' END"""
_FULL = f"""{_COMP}, {_GEOM}, cc AS (SELECT scene, count(DISTINCT component) AS c FROM lab GROUP BY 1),
    gs AS (SELECT ge.*, coalesce(c, 0) AS components, least(1.0, coalesce(c, 0) / 8) AS parts,
        least(1.0, log2(greatest(1.0, elongation)) / log2(20.0)) AS stretch FROM ge LEFT JOIN cc USING (scene)),
    sc AS (SELECT *, CASE WHEN fraction > 0 THEN {_SCALE.format(s='span')} END AS scale, CASE WHEN fraction > 0 THEN
        {_SHAPE.format(c='round_even(parts * 8, 0)', e='2.0 ** (stretch * log2(20.0))', f='fill', s='span')} END AS shape FROM gs)"""


@query(
    "descriptor_v1",
    views=("v_grid",),
    sql=f"""WITH {_FULL} SELECT scene, CASE WHEN fraction >= 0.55 THEN 'global' WHEN fraction >= 0.25 OR span >= 0.65 THEN 'long_range'
        ELSE 'local' END AS extent, CASE WHEN fraction >= 0.60 THEN 'diffuse' WHEN components >= 2 THEN 'multipart'
        WHEN elongation >= 2.75 OR (span >= 0.60 AND fraction <= 0.50) THEN 'elongated' ELSE 'compact' END AS topology FROM gs""",
)
def descriptor_v1(spark, d):
    extent, topology = G.descriptor_v1(F.col("fraction"), F.col("span"), F.col("components"), F.col("elongation"))
    return _measured(spark, d).select("scene", extent.alias("extent"), topology.alias("topology"))


@query(
    "descriptor_robust",
    views=("v_grid",),
    sql=f"WITH {_FULL} SELECT scene, scale, shape FROM sc",
)
def descriptor_robust(spark, d):
    return G.scene_profiles(v.v_grid(spark, d)).select("scene", "scale", "shape")


@query(
    "descriptor_occupancy",
    views=("v_grid",),
    sql=f"""WITH {_FULL} SELECT scale IS NOT NULL AS described, scale, shape, count(*) AS n, CAST(0 AS BIGINT) AS level FROM sc GROUP BY ALL
    UNION ALL SELECT scale IS NOT NULL, scale, NULL, count(*), 1 FROM sc GROUP BY 1, 2
    UNION ALL SELECT scale IS NOT NULL, NULL, NULL, count(*), 3 FROM sc GROUP BY 1
    UNION ALL SELECT NULL, NULL, NULL, count(*), 7 FROM sc""",
)
def descriptor_occupancy(spark, d):
    return G.descriptor_occupancy(G.scene_profiles(v.v_grid(spark, d)))


_PROFILE = f"""{_FULL}, er AS (SELECT scene, avg(error) AS e FROM v_grid GROUP BY 1),
    pr AS (SELECT candidate, count(*) AS scenes, count(scale) / count(*) AS nonempty_fraction, quantile_cont(fraction, 0.5) AS mf,
        quantile_cont(span, 0.5) AS ms, quantile_cont(parts, 0.5) AS mp, quantile_cont(stretch, 0.5) AS mt, quantile_cont(fill, 0.5) AS ml,
        quantile_cont(span, 0.75) - quantile_cont(span, 0.25) AS iqr_span, avg(e) AS error_fraction FROM sc JOIN er USING (scene) GROUP BY 1),
    dp AS (SELECT *, {_SCALE.format(s='ms')} AS scale, {_SHAPE.format(c='round_even(mp * 8, 0)', e='2.0 ** (mt * log2(20.0))', f='ml', s='ms')}
        AS shape FROM pr),
    ag AS (SELECT dp.*, (SELECT count(*) FROM sc WHERE sc.candidate = dp.candidate AND sc.scale = dp.scale AND sc.shape = dp.shape) / scenes
        AS stability FROM dp)"""


@query(
    "robust_profile",
    views=("v_grid",),
    sql=f"""WITH {_PROFILE} SELECT candidate, scenes, scale, shape, round(nonempty_fraction, 9) AS nonempty_fraction, round(mf, 9) AS median_fraction,
        round(ms, 9) AS median_span, round(iqr_span, 9) AS iqr_span, round(stability, 9) AS stability,
        round(error_fraction, 9) AS error_fraction FROM ag""",
)
def robust_profile(spark, d):
    p = G.robust_profile(G.scene_profiles(v.v_grid(spark, d)), "candidate")
    return p.select(
        "candidate", "scenes", "scale", "shape", F.round("nonempty_fraction", 9).alias("nonempty_fraction"),
        F.round(F.col("q_fraction")[1], 9).alias("median_fraction"), F.round(F.col("q_span")[1], 9).alias("median_span"),
        F.round(F.col("q_span")[2] - F.col("q_span")[0], 9).alias("iqr_span"), F.round("stability", 9).alias("stability"),
        F.round("error_fraction", 9).alias("error_fraction"),
    )


@query(
    "mean_grid",
    views=("v_grid",),
    sql="""SELECT candidate, CAST(pos AS INTEGER) AS pos, round(avg(impact), 9) AS mean FROM v_grid GROUP BY ALL""",
)
def mean_grid(spark, d):
    means = G.mean_grid(v.v_grid(spark, d), "candidate", "impact", "mean")
    return means.select("candidate", F.posexplode("mean").alias("pos", "m")).select("candidate", "pos", F.round("m", 9).alias("mean"))


@query(
    "attest_candidate",
    views=("v_grid",),
    sql=f"""WITH {_PROFILE} SELECT candidate, scenes, scale, shape, round(stability, 9) AS stability,
        CASE WHEN nonempty_fraction < 2.0 / 3 THEN 'incomplete' ELSE 'complete' END AS status, error_fraction > 0.5 AS warned,
        CAST(149 AS INTEGER) AS vector_size FROM ag""",
)
def attest_candidate(spark, d):
    return G.attest(v.v_grid(spark, d), "candidate").select(
        "candidate", "scenes", "scale", "shape", F.round("stability", 9).alias("stability"), "status", "warned", F.size("vector").alias("vector_size")
    )


@query(
    "block_majority",
    views=(),
    sql="""WITH g AS (SELECT vec_id, i - 1 AS pos, CAST(floor(abs(e) * 1000) AS BIGINT) & 1 AS bit FROM (SELECT vec_id,
        unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings)),
    b AS (SELECT vec_id, (pos // 8) // 2 AS br, (pos % 8) // 2 AS bc, CASE WHEN sum(bit) > 2 THEN 1 ELSE 0 END AS m FROM g GROUP BY ALL),
    f AS (SELECT vec_id, string_agg(CAST(m AS VARCHAR), '' ORDER BY br, bc) AS field FROM b GROUP BY 1),
    s AS (SELECT *, (field[1]::INT + field[4]::INT + field[6]::INT + field[7]::INT + field[10]::INT + field[11]::INT + field[13]::INT
        + field[16]::INT) / 8 AS a, (field[2]::INT + field[3]::INT + field[5]::INT + field[8]::INT + field[9]::INT + field[12]::INT
        + field[14]::INT + field[15]::INT) / 8 AS b FROM f)
    SELECT vec_id, field, CASE WHEN a >= b THEN 'A' ELSE 'B' END AS glyph FROM s""",
)
def block_majority(spark, d):
    bits = F.expr("transform(embedding, e -> CAST(floor(abs(e) * CAST(1000 AS FLOAT)) AS BIGINT) & 1)")
    rows = v.table(spark, d, "embeddings").select("vec_id", bits.alias("bits"))
    rows = rows.select("vec_id", G.block_majority(F.col("bits"), 8, 2).alias("field"))
    a = G.template_overlap(F.col("field"), "#..#.##..##.#..#")
    b = G.template_overlap(F.col("field"), ".##.#..##..#.##.")
    return rows.select("vec_id", F.array_join(F.transform("field", lambda x: x.cast("string")), "").alias("field"), F.when(a >= b, "A").otherwise("B").alias("glyph"))


def _circle_points(spark, d):
    angle = F.col("k") * F.lit(0.06283185307179587)
    radius = 50 + F.col("value") / 100
    return v.v_events(spark, d).select(
        "user_id", (F.cos(angle) * radius + F.col("user_id") % 20).alias("x"), (F.sin(angle) * radius - F.col("user_id") % 7).alias("y")
    )


_FIT = """SELECT user_id, n, mx, my, (cxz * cyy - cyz * cxy) / (cxx * cyy - cxy * cxy) AS a, (cyz * cxx - cxz * cxy) / (cxx * cyy - cxy * cxy) AS b, mz
    FROM (SELECT user_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(x * x + y * y) AS mz, var_pop(x) AS cxx, var_pop(y) AS cyy,
    covar_pop(x, y) AS cxy, covar_pop(x, x * x + y * y) AS cxz, covar_pop(y, x * x + y * y) AS cyz FROM {src} GROUP BY 1)"""
_CIRCLE = "SELECT user_id, n, a / 2 AS cx, b / 2 AS cy, sqrt(greatest(mz - a * mx - b * my + a * a / 4 + b * b / 4, 0)) AS r FROM ({fit})"


@query(
    "circle_fit",
    views=("v_events",),
    sql=f"""WITH p AS (SELECT user_id, cos(k * 0.06283185307179587::DOUBLE) * (50 + value / 100) + user_id % 20 AS x,
        sin(k * 0.06283185307179587::DOUBLE) * (50 + value / 100) - user_id % 7 AS y FROM v_events),
    f1 AS ({_CIRCLE.format(fit=_FIT.format(src='p'))}),
    inl AS (SELECT p.* FROM p JOIN f1 USING (user_id) WHERE abs(sqrt((x - cx) ** 2 + (y - cy) ** 2) - r) <= 0.6),
    f2 AS ({_CIRCLE.format(fit=_FIT.format(src='inl'))}),
    f AS (SELECT f1.user_id, f1.n, coalesce(f2.n >= 12 AND f2.n < f1.n, false) AS refit, f1.cx AS c1x, f1.cy AS c1y, f1.r AS r1,
        CASE WHEN coalesce(f2.n >= 12 AND f2.n < f1.n, false) THEN f2.cx ELSE f1.cx END AS cx,
        CASE WHEN coalesce(f2.n >= 12 AND f2.n < f1.n, false) THEN f2.cy ELSE f1.cy END AS cy,
        CASE WHEN coalesce(f2.n >= 12 AND f2.n < f1.n, false) THEN f2.r ELSE f1.r END AS r FROM f1 LEFT JOIN f2 USING (user_id)),
    u AS (SELECT p.x, p.y, f.* FROM p JOIN f USING (user_id) WHERE NOT refit OR abs(sqrt((x - c1x) ** 2 + (y - c1y) ** 2) - r1) <= 0.6)
    SELECT user_id, any_value(n) AS n, any_value(refit) AS refit, round(any_value(cx), 5) AS cx, round(any_value(cy), 5) AS cy,
        round(any_value(r), 5) AS r, count(*) AS used, count(DISTINCT floor(degrees(atan2(y - cy, x - cx)) / 5)) * 5 AS arc_deg,
        round(sqrt(avg((sqrt((x - cx) ** 2 + (y - cy) ** 2) - r) ** 2)), 6) AS rms FROM u GROUP BY user_id""",
)
def circle_fit(spark, d):
    fit = G.circle_fit(_circle_points(spark, d), ["user_id"], "x", "y", residual=0.6)
    return fit.select("user_id", "n", "refit", *[F.round(c, 5).alias(c) for c in ("cx", "cy", "r")], "used", "arc_deg", F.round("rms", 6).alias("rms"))


_AXIS = """ax AS (SELECT {k}, points, a - 180 * floor(a / 180) AS angle FROM (SELECT {k}, count(*) AS points,
    degrees(atan2(round(2 * covar_pop(x, y), 9), round(var_pop(x) - var_pop(y), 9))) / 2 + 0.0 AS a FROM v_li GROUP BY {k}))"""
_AXIS_CLASS = """CASE WHEN angle < 22.5 OR angle >= 157.5 THEN 'horizontal' WHEN angle < 67.5 THEN 'rising' WHEN angle < 112.5 THEN 'vertical'
    ELSE 'falling' END"""


@query(
    "principal_axis",
    views=("v_li",),
    sql=f"WITH {_AXIS.format(k='scene')} SELECT scene, points, round(angle, 5) AS angle, {_AXIS_CLASS} AS axis FROM ax",
)
def principal_axis(spark, d):
    out = G.principal_axis(v.v_li(spark, d), ["scene"], "x", "y")
    return out.select("scene", "points", F.round("angle", 5).alias("angle"), "axis")


@query(
    "orientation_vote",
    views=("v_li",),
    sql=f"""WITH {_AXIS.format(k='scene')}, c AS (SELECT scene % 500 AS panel, {_AXIS_CLASS} AS axis FROM ax WHERE points >= 3),
    n AS (SELECT panel, count(*) AS components, count(*) FILTER (axis = 'horizontal') AS h, count(*) FILTER (axis = 'rising') AS r,
        count(*) FILTER (axis = 'vertical') AS v, count(*) FILTER (axis = 'falling') AS f FROM c GROUP BY 1)
    SELECT panel, components, CASE WHEN components < 8 THEN 'ABSTAIN' WHEN h >= r AND h >= v AND h >= f THEN 'horizontal'
        WHEN r >= v AND r >= f THEN 'rising' WHEN v >= f THEN 'vertical' ELSE 'falling' END AS vote FROM n""",
)
def orientation_vote(spark, d):
    axes = G.principal_axis(v.v_li(spark, d), ["scene"], "x", "y", minimum=3)
    return G.orientation_vote(axes.withColumn("panel", F.col("scene") % 500), "panel", 8)


@query(
    "radial_majority",
    views=("v_li",),
    sql="""WITH d AS (SELECT scene, sqrt((x - 25) ** 2 + (y - 50) ** 2) <= 25 AS inside FROM v_li)
    SELECT scene, count(*) FILTER (inside) AS inner, count(*) FILTER (NOT inside) AS outer,
        CASE WHEN count(*) FILTER (inside) >= count(*) FILTER (NOT inside) THEN 'core' ELSE 'rim' END AS regime FROM d GROUP BY 1""".replace(
        " AS inner", ' AS "inner"').replace(" AS outer", ' AS "outer"'),
)
def radial_majority(spark, d):
    return G.radial_majority(v.v_li(spark, d), ["scene"], "x", "y", (25.0, 50.0), 25.0)


@query(
    "common_circle_score",
    views=("v_li",),
    sql="""WITH p AS (SELECT scene, x, y, r * 5 + 30 AS r FROM v_li), n AS (SELECT scene, count(*) AS fragments FROM p GROUP BY 1),
    l AS (SELECT scene, list_sort(list({'r': r, 'x': x, 'y': y})) AS c FROM p JOIN n USING (scene) WHERE fragments = 3 GROUP BY 1),
    s AS (SELECT scene, round(greatest(sqrt((c[1].x - c[2].x) ** 2 + (c[1].y - c[2].y) ** 2), sqrt((c[1].x - c[3].x) ** 2 + (c[1].y - c[3].y) ** 2),
        sqrt((c[2].x - c[3].x) ** 2 + (c[2].y - c[3].y) ** 2)) / c[2].r + 0.35 * ((c[3].r - c[1].r) / c[2].r), 9) AS score FROM l)
    SELECT n.scene, fragments, score, CASE WHEN fragments <> 3 THEN 'wrong_count' WHEN score <= 0.7 THEN 'yes' WHEN score >= 1.1 THEN 'no'
        ELSE 'ambiguous' END AS answer FROM n LEFT JOIN s USING (scene)""",
)
def common_circle_score(spark, d):
    fits = v.v_li(spark, d).select("scene", "x", "y", (F.col("r") * 5 + 30).alias("r"))
    return G.common_circle_score(fits, "scene")


@query(
    "min_pairwise_gap",
    views=("v_li",),
    sql="""WITH n AS (SELECT scene, count(*) AS shapes FROM v_li GROUP BY 1), g AS (SELECT a.scene,
        min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) - a.r - b.r) AS gap FROM v_li a JOIN v_li b ON a.scene = b.scene AND a.i < b.i GROUP BY 1)
    SELECT n.scene, shapes, round(gap, 6) AS gap FROM n LEFT JOIN g USING (scene)""",
)
def min_pairwise_gap(spark, d):
    return G.min_pairwise_gap(v.v_li(spark, d), "scene", "i").select("scene", "shapes", F.round("gap", 6).alias("gap"))


def _shapes(spark, d):
    truth = v.v_li(spark, d).select("scene", F.col("i"), "x", "y", (F.col("r") + 1).alias("r"))
    shift = F.col("x") % 3 * 0.2
    found = truth.filter("x <> 17").select("scene", (F.col("x") + shift).alias("x"), "y", (F.col("r") + shift / 2).alias("r"))
    area = F.lit(3.141592653589793) * F.col("r") * F.col("r") * F.when(F.col("x") > 45, 1.6).otherwise(1.0)
    return truth, found.withColumn("area", area)


@query("greedy_match", views=())
def greedy_match(spark, d):
    truth, found = _shapes(spark, d)
    return G.greedy_match(truth, found.drop("area"), "scene")


@query("verify_shapes", views=())
def verify_shapes(spark, d):
    truth, found = _shapes(spark, d)
    errors = G.greedy_match(truth, found.drop("area"), "scene")
    gaps = min_pairwise_gap(spark, d).select("scene", "gap")
    return X.verify_shapes(
        truth, found, errors, gaps, "scene", canvas=110.0,
        tolerances={"centre": 0.5, "radius": 0.3, "area_fraction": 0.06, "area_edge": 0.1},
    )


@query(
    "two_circle_verdict",
    views=("v_li",),
    sql="""WITH c AS (SELECT scene, i, l_partkey, m, m + (y - 50) / 20 AS mh, r * 36 AS arc FROM v_li)
    SELECT scene, i, l_partkey, CASE WHEN arc >= 90 AND abs(mh - m) > 2 THEN 'margin' WHEN arc >= 90 AND abs(m) > 1 AND (mh <= 0) <> (m <= 0)
        THEN 'label_flip' WHEN arc < 90 AND abs(m) > 2 AND (mh <= 0) <> (m <= 0) THEN 'low_confidence_flip' ELSE 'ok' END AS verdict FROM c""",
)
def two_circle_verdict(spark, d):
    m_hat = F.col("m") + (F.col("y") - 50) / 20
    verdict = X.two_circle_verdict(
        F.col("m"), m_hat, F.col("r") * 36, minimum_arc=90.0, tolerance=2.0, label_band=1.0, low_band=2.0
    )
    return v.v_li(spark, d).select("scene", "i", "l_partkey", verdict.alias("verdict"))


@query(
    "reachable_from",
    views=("v_edges",),
    sql="""WITH RECURSIVE roots AS (SELECT DISTINCT src AS node FROM v_edges WHERE src NOT IN (SELECT dst FROM v_edges)),
    walk AS (SELECT node, CAST(0 AS BIGINT) AS hops FROM roots UNION SELECT dst, hops + 1 FROM walk JOIN v_edges ON src = node)
    SELECT node, min(hops) AS hops FROM walk GROUP BY 1""",
)
def reachable_from(spark, d):
    edges = v.v_edges(spark, d)
    roots = edges.select(F.col("src").alias("node")).distinct().join(
        edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti"
    )
    return N.reachable_from(roots, edges)


@query(
    "follow_chain",
    views=("v_edges",),
    sql="""WITH RECURSIVE one AS (SELECT src, arg_min(dst, o_orderkey) AS dst FROM v_edges GROUP BY src),
    walk AS (SELECT src, dst AS cur, CAST(1 AS BIGINT) AS hops FROM one UNION ALL SELECT walk.src, one.dst, hops + 1 FROM walk JOIN one ON one.src = cur)
    SELECT src, arg_max(cur, hops) AS "end", max(hops) AS hops, 'ok' AS verdict FROM walk GROUP BY src""",
)
def follow_chain(spark, d):
    one = v.v_edges(spark, d).groupBy("src").agg(F.min_by("dst", "o_orderkey").alias("dst"))
    return N.follow_chain(one)


def _manifest_hooks():
    flip = F.when(F.col("decision") == "yes", "no").when(F.col("decision") == "no", "yes")
    return X.Hooks(
        decision=F.col("decision_now"),
        margin=F.col("margin_now"),
        quarantined=F.col("quarantined"),
        answer=F.when(F.col("prompt_family") == "f_good", F.col("decision")).otherwise(flip),
        candidates=F.array(F.lit("yes"), F.lit("no")),
        supported=F.col("decision_now").isNotNull(),
    )


def _stored(spark, d):
    manifest = v.v_manifest(spark, d)
    margin = F.col("margin")
    return manifest.select(
        "scene_id", "dataset_id", "prompt_family", "quarantined", "candidates", "decision",
        F.when(margin % 7 == 0, F.concat(F.col("answer"), F.lit("!"))).otherwise(F.col("answer")).alias("answer"),
        F.when(margin % 11 == 0, margin + 0.1).when(margin % 11 == 1, margin + 1e-12).otherwise(margin).alias("margin"),
        F.col("decision").alias("decision_now"),
        margin.alias("margin_now"),
    )


@query(
    "exact_rerender_check",
    views=("v_manifest",),
    sql="""WITH o AS (SELECT dataset_id, CASE WHEN decision IS NULL THEN 'u' WHEN margin % 11 = 0 OR margin % 7 = 0 THEN 'f' ELSE 'k' END AS o FROM v_manifest)
    SELECT dataset_id, count(*) FILTER (o = 'k') AS ok, count(*) FILTER (o = 'f') AS failed, count(*) FILTER (o = 'u') AS unsupported
    FROM o GROUP BY 1""",
)
def exact_rerender_check(spark, d):
    checked = X.exact_rerender_check(_stored(spark, d), ["dataset_id"], _manifest_hooks())
    return X.tally(checked, "dataset_id")


@query(
    "corruption_coverage",
    views=("v_manifest",),
    sql="""SELECT dataset_id, unnest(['wrong_answer', 'blank_image']) AS mutation, true AS caught FROM (SELECT DISTINCT dataset_id FROM v_manifest
        WHERE decision IS NOT NULL)""",
)
def corruption_coverage(spark, d):
    manifest = v.v_manifest(spark, d).filter("decision IS NOT NULL")
    rows = manifest.withColumn("decision_now", F.col("decision")).withColumn("margin_now", F.col("margin"))
    return X.corruption_coverage(rows, "dataset_id", "scene_id", _manifest_hooks(), ["scene_id", "prompt_family"])


@query(
    "symmetry_invariance",
    views=("v_li",),
    sql="""WITH s AS (SELECT scene, i, l_partkey, x, y, r FROM v_li)
    SELECT scene, i, l_partkey, 'radius_up' AS twin, CASE WHEN (x > 25 AND r <= 9) <> (x > 25 AND r + 1 <= 9) THEN 'gold_flips' ELSE 'ok' END AS outcome FROM s
    UNION ALL SELECT scene, i, l_partkey, 'mirror', CASE WHEN 50 - x <> x THEN 'false_twin' ELSE 'ok' END FROM s""",
)
def symmetry_invariance(spark, d):
    scenes = v.v_li(spark, d)
    twin = lambda name, x, r: F.struct(F.lit(name).alias("name"), x.alias("x"), F.col("y").alias("y"), r.alias("r"))
    twins = F.array(twin("radius_up", F.col("x"), F.col("r") + 1), twin("mirror", 50 - F.col("x"), F.col("r")))
    picture = lambda x, y: F.xxhash64(x, y)
    gold = lambda x, r: (x > 25) & (r <= 9)
    t = F.col("twin")
    return X.symmetry_invariance(
        scenes, ["scene", "i", "l_partkey"], twins,
        picture(F.col("x"), F.col("y")), picture(t["x"], t["y"]), gold(F.col("x"), F.col("r")), gold(t["x"], t["r"]),
    )
