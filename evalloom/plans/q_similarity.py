"""Similarity queries bound to the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom import views as v
from evalloom.functions import text as TX
from evalloom.operators import checks as C
from evalloom.operators import similarity as S
from evalloom.registry import query
from evalloom.session import broadcast_if_small

THRESHOLD = 0.68


def tokens_sql(column: str) -> str:
    return f"""list_distinct(list_transform(list_filter(regexp_extract_all(lower({column}), '[a-z0-9]+'),
        lambda w: NOT list_contains({list(TX.STOP_WORDS)}, w)), lambda w: coalesce(map_extract_value(MAP {TX.SYNONYMS}, w), w)))"""


def jaccard_sql(a: str, b: str) -> str:
    return f"""CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN 0.0
        ELSE CAST(len(list_intersect({a}, {b})) AS DOUBLE) / len(list_distinct(list_concat({a}, {b}))) END"""


def score_sql(a: str, b: str) -> str:
    def eq(name: str, w: float) -> str:
        return f"CASE WHEN {a}.{name} IS NOT DISTINCT FROM {b}.{name} THEN CAST({w} AS DOUBLE) ELSE 0.0 END"

    return f"""round({eq('family', .15)} + {eq('arity', .10)} + {eq('relation', .25)} + {eq('margin_operator', .20)}
        + CAST(0.10 AS DOUBLE) * {jaccard_sql(a + '.entities', b + '.entities')}
        + CAST(0.05 AS DOUBLE) * {jaccard_sql(a + '.primitives', b + '.primitives')}
        + {eq('depth', .05)} + CAST(0.10 AS DOUBLE) * {jaccard_sql(a + '.tokens', b + '.tokens')}, 6)"""


_FP_SQL = f"""fp AS (SELECT id, family, arity, relation, margin_operator, depth, list_sort(list_distinct(entities)) AS entities,
    list_sort(list_distinct(primitives)) AS primitives, list_sort({tokens_sql('text')}) AS tokens FROM v_fp)"""
_EDGE_SQL = f"""{_FP_SQL},
    pr AS (SELECT family, arity, relation, margin_operator, depth, entities, primitives, tokens, min(id) AS rep, count(*) AS n
        FROM fp GROUP BY ALL),
    ed AS (SELECT a.rep AS left_id, b.rep AS right_id, {score_sql('a', 'b')} AS score,
        CASE WHEN a.rep = b.rep THEN a.n * (a.n - 1) // 2 ELSE a.n * b.n END AS pairs
        FROM pr a JOIN pr b ON a.rep <= b.rep
        AND (a.family = b.family)::INT * 15 + (a.arity = b.arity)::INT * 10 + (a.relation = b.relation)::INT * 25
          + (a.margin_operator = b.margin_operator)::INT * 20 + (a.depth = b.depth)::INT * 5 >= 43)"""


@query(
    "similarity_edges",
    views=("v_fp",),
    sql=f"WITH {_EDGE_SQL} SELECT * FROM ed WHERE score >= {THRESHOLD} AND pairs > 0",
)
def similarity_edges(spark, d):
    return S.similarity_edges(v.v_fp(spark, d), THRESHOLD)


@query(
    "sibling_risk",
    views=("v_fp",),
    sql=f"""WITH {_EDGE_SQL}, t AS (SELECT rep, max(score) AS top_score FROM (SELECT left_id AS rep, score FROM ed
        WHERE score >= {THRESHOLD} AND pairs > 0 UNION ALL SELECT right_id, score FROM ed WHERE score >= {THRESHOLD} AND pairs > 0)
        GROUP BY 1) SELECT fp.id, top_score FROM fp JOIN pr USING (family, arity, relation, margin_operator, depth, entities,
        primitives, tokens) JOIN t USING (rep)""",
)
def sibling_risk(spark, d):
    return S.sibling_scores(v.v_fp(spark, d), THRESHOLD)


def _registry(fp):
    """The first row of each relation and operator stands for the known worlds."""
    # the ids alone are aggregated: whole rows in an aggregation would be sorted first
    keys = ["id", "relation", "margin_operator"]
    first = fp.groupBy(*keys[1:]).agg(F.min("id").alias("id")).select(*[F.col(c).alias(f"first_{c}") for c in keys])
    same = [F.col(c).eqNullSafe(F.col(f"first_{c}")) for c in keys]
    return fp.join(broadcast_if_small(first), same).select(*fp.columns).dropDuplicates(keys[1:])


_MEMORY_SQL = "mem AS (SELECT * FROM fp QUALIFY row_number() OVER (PARTITION BY relation, margin_operator ORDER BY id) = 1)"
_TOP_SQL = f"""{_FP_SQL}, {_MEMORY_SQL}, sc AS (SELECT fp.id, mem.id AS memory_id, {score_sql('fp', 'mem')} AS score FROM fp, mem),
    top AS (SELECT id, memory_id, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, CAST(memory_id AS VARCHAR)) AS rank
        FROM sc)"""


@query(
    "semantic_neighbors",
    views=("v_fp",),
    sql=f"WITH {_TOP_SQL} SELECT id, CAST(rank AS INTEGER) AS rank, memory_id, score FROM top WHERE rank <= 5",
)
def semantic_neighbors(spark, d):
    return _neighbors(spark, d, 5)


def _neighbors(spark, d, k: int):
    fp = v.v_fp(spark, d)
    memory = _registry(fp).withColumnRenamed("id", "memory_id")
    return S.semantic_neighbors(fp, memory, k)


@query(
    "duplicate_risk",
    views=("v_fp",),
    sql=f"""WITH {_TOP_SQL}, cl AS (SELECT id, count(*) OVER (PARTITION BY family, arity, relation, margin_operator, depth, entities, primitives, tokens) > 1 AS clone FROM fp)
        SELECT id, score AS top_score, CASE WHEN score >= {THRESHOLD} OR clone THEN 'high' WHEN score >= 0.53
        THEN 'medium' ELSE 'low' END AS risk FROM top JOIN cl USING (id) WHERE rank = 1""",
)
def duplicate_risk(spark, d):
    top = _neighbors(spark, d, 1).join(S.clones(v.v_fp(spark, d)), "id")
    return top.select(
        "id", F.col("score").alias("top_score"), C.duplicate_risk(F.col("score"), F.col("clone"), THRESHOLD).alias("risk")
    )


_NEG_SQL = f"""d AS (SELECT doc_id, {tokens_sql('text')} AS t FROM documents),
    b AS (SELECT item_id, {tokens_sql('text')} AS t FROM benchmark),
    sc AS (SELECT doc_id, item_id, round(CASE WHEN len(d.t) + len(b.t) = 0 THEN 0 ELSE CAST(len(list_intersect(d.t, b.t)) AS DOUBLE)
        / (len(d.t) + len(b.t) - len(list_intersect(d.t, b.t))) END, 6) AS score FROM d, b),
    top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, CAST(item_id AS VARCHAR)) AS rank FROM sc)"""


@query(
    "negative_neighbors",
    views=(),
    sql=f"WITH {_NEG_SQL} SELECT doc_id, CAST(rank AS INTEGER) AS rank, item_id, score FROM top WHERE rank <= 5",
)
def negative_neighbors(spark, d):
    return _negatives(spark, d, 5)


def _negatives(spark, d, k: int):
    return S.negative_neighbors(v.v_docs_spread(spark, d), v.table(spark, d, "benchmark"), k, ident="doc_id", name="item_id")


@query(
    "top_k_by_score",
    views=(),
    sql=f"WITH {_NEG_SQL} SELECT doc_id, item_id, score FROM top WHERE rank = 1",
)
def top_k_by_score(spark, d):
    return _negatives(spark, d, 1).select("doc_id", "item_id", "score")


@query(
    "protected_source_match",
    views=(),
    sql=f"""WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws, {tokens_sql('text')} AS t FROM benchmark),
    p AS (SELECT item_id, t, [' ' || ws[1] || ' ', ' ' || ws[2] || ' ' || ws[3] || ' ', ' ' || ws[4] || ' '] AS ph FROM w),
    d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ' AS pad,
        {tokens_sql('text')} AS t FROM documents),
    sc AS (SELECT doc_id, item_id, round(0.75 + CAST(0.10 AS DOUBLE) * {jaccard_sql('d.t', 'p.t')}, 6) AS score,
        CAST(0.76 AS DOUBLE) AS floor FROM d, p WHERE contains(pad, ph[1]) AND contains(pad, ph[2]) AND contains(pad, ph[3]))
    SELECT * FROM sc WHERE score >= floor""",
)
def protected_source_match(spark, d):
    ws = TX.words(F.col("text"))
    word = lambda i: F.try_element_at(ws, F.lit(i))
    groups = F.array(F.array(word(1)), F.array(F.concat_ws(" ", word(2), word(3))), F.array(word(4)))
    sources = v.table(spark, d, "benchmark").select(
        "item_id", groups.alias("groups"), F.lit(0.76).alias("floor"), TX.tokens(F.col("text")).alias("tokens")
    )
    return S.protected_source_match(v.v_docs_spread(spark, d), sources, ident="doc_id", name="item_id")


@query(
    "cell_collisions",
    views=("v_fp",),
    sql="""WITH r AS (SELECT relation, margin_operator, family, min(id) AS name FROM v_fp GROUP BY relation, margin_operator, family, arity)
    SELECT id, name FROM v_fp JOIN r USING (relation, margin_operator, family)""",
)
def cell_collisions(spark, d):
    fp = v.v_fp(spark, d)
    cell = ["relation", "margin_operator", "family"]
    registry = fp.groupBy(*cell, "arity").agg(F.min("id").alias("name"))
    return S.cell_collisions(fp, registry, cell, "id", "name")
